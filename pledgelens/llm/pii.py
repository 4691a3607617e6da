"""Personal data: candidate spans, boosted trees, calibrated thresholds.

High-recall generators propose overlapping spans: the four base patterns, and wider ones for spelled-out e-mail addresses,
spaced or dotted numbers and national phone numbers. A base candidate that passes its check (parts of an address, Luhn
sum, number of digits) is personal data. Boosted trees score the wide candidates from format features
(length, digits, groups, separators, a plus sign, the Luhn sum) and context features (a cue word before, a bracket or quote or
a letter beside it). They are trained on rows of the wide form: confirmed base values written the wide way are the positives, e-mail
addresses included; wide candidates without a cue or with a failing check, and spoilt or refused base values written the wide way, are
the negatives. The fit takes a bounded sample of these rows. A threshold per
kind is calibrated on the rows of all documents: the lowest score at which ``PRECISION`` of the rows above it are
positives, ``FALLBACK`` where there are too few positives, and no wide span of the kind where no score is precise enough.

Everything is DataFrame functions; the trees become expressions, so scoring is row-local with no shuffle.

Defined cases: a null or empty text has no spans; repeated rows and rows without an id give a row each; without a positive and
a negative row there is no model and only base spans; extra columns are left behind but for the named ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unwrapped, wrapped, written
from .spans import listing, tagged, with_matches

_LOCAL = "[A-Za-z0-9._%+-]"
# The base patterns in the order of the kinds. Possessive quantifiers, look-behinds and \\G (the end
# of the match before) find the same places as the plain patterns, in linear time.
BASE_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider candidates of the method, by their kind.
WIDE_PATTERNS = {
    "email_spelled": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._-]{0,63}\x20?(?:[(\[]at[)\]]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}\x20?(?:[(\[]dot[)\]]|\x20dot\x20)\x20?[A-Za-z]{2,24}(?![A-Za-z])",
    "number_dotted": r"(?<![0-9.])[0-9]{3,4}(?:[.][0-9]{3,4}){3}(?![0-9])",
    "phone_national": r"(?<![0-9+(])[(]?0[0-9]{1,4}[)]?(?:[\x20/.-][0-9]{2,6}){1,4}(?![0-9])",
}
#: Words before a candidate that announce personal data.
CUES = "(?i)(?:mail|phone|tel|call|fax|mobile|contact|telefon|tel[eé]fono|t[eé]l[eé]phone|card|iban|ssn)[^A-Za-z0-9\\n]{0,4}$"
#: Rows of a kind and class that the trees are trained on, about; thresholds come from all rows.
SAMPLE = 20_000
TREES, DEPTH = 12, 3
PRECISION = 0.95
#: Positives above a calibrated threshold, at least; a kind with fewer takes the fallback, where the trees' sum is 0.
ENOUGH = 20
FALLBACK = 0.5
#: Digits of a national number.
NATIONAL = (9, 13)
FEATURES = ("length", "digits", "groups", "separators", "plus", "at", "cue", "letter_before", "letter_after", "quoted", "luhn")
BINS = 200


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits' Luhn sum is a multiple of ten."""
    n = F.length(digits)
    # From the right, every second digit counts double, less nine if that has two digits.
    worth = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.when(F.pmod(n - i, F.lit(2)) == 1, F.substr(F.lit("0246813579"), F.substr(digits, i, F.lit(1)).cast("int") + 1, F.lit(1)))
        .otherwise(F.substr(digits, i, F.lit(1))).cast("int"),
    )
    return F.pmod(F.aggregate(worth, F.lit(0), lambda a, x: a + x), F.lit(10)) == 0


def passes(kind: str, value: Column) -> Column:
    """The base check of a match."""
    digits = digits_of(value)
    if kind == "ip":
        # Leading zeros aside, a part of over three digits is over 255.
        return F.forall(F.split(value, "\\."), lambda p: F.coalesce(
            F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255), F.lit(False)
        ))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def features(text: Column, m: Column) -> Column:
    """The format and context features of a candidate."""
    value = m["value"]
    before = F.substr(text, F.greatest(m["start"] - 23, F.lit(1)), F.least(m["start"], F.lit(24)))
    last = F.when(m["start"] > 0, F.substr(text, m["start"], F.lit(1))).otherwise(F.lit(""))
    following = F.substr(text, m["end"] + 1, F.lit(1))
    flag = lambda c: c.cast("double")
    return F.array(
        F.length(value).cast("double"), F.length(digits_of(value)).cast("double"),
        F.size(F.split(value, "[^0-9A-Za-z]+")).cast("double"), F.length(F.regexp_replace(value, "[0-9A-Za-z]", "")).cast("double"),
        flag(F.startswith(value, F.lit("+"))), flag(F.contains(value, F.lit("@"))), flag(before.rlike(CUES)),
        flag(last.rlike("[A-Za-z]")), flag(following.rlike("[A-Za-z]")), flag(F.concat(last, following).rlike("[\"'(\\[]")),
        flag(passes("card", value)),
    )


class _Node(NamedTuple):
    feature: int
    threshold: float
    value: float
    low: "_Node | None"
    high: "_Node | None"


@dataclass
class Model:
    """Boosted trees and the thresholds of the wide kinds."""

    trees: list[tuple[float, _Node]]
    thresholds: dict[str, float]

    def score(self, x: Column) -> Column:
        """The trees' sum as an expression."""
        def of(node: _Node) -> Column:
            if node.low is None:
                return F.lit(node.value)
            return F.when(F.get(x, F.lit(node.feature)) <= node.threshold, of(node.low)).otherwise(of(node.high))

        total = F.lit(0.0)
        for weight, tree in self.trees:
            total = total + F.lit(weight) * of(tree)
        return total

    def level(self, x: Column) -> Column:
        """The score between 0 and 1."""
        return (F.tanh(self.score(x)) + 1) / 2


def _tree(node) -> _Node:
    if node.getClass().getSimpleName() == "LeafNode":
        return _Node(-1, 0.0, node.prediction(), None, None)
    split = node.split()
    return _Node(split.featureIndex(), split.threshold(), node.prediction(), _tree(node.leftChild()), _tree(node.rightChild()))


def _wide_forms(kind: str, value: Column) -> list[tuple[str, Column, Column]]:
    """(wide kind, the base value written that way, 1 or 0): true values as they are, and spoilt."""
    d, ok = digits_of(value), passes(kind, value).cast("double")
    part = lambda a, n=32: F.substr(d, F.lit(a), F.lit(n))
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), F.pmod(F.xxhash64(value), F.lit(len(xs))).cast("int"))
    if kind == "email":
        whole = r"^(.+)@([A-Za-z0-9-]+)(?:\.[A-Za-z0-9-]+)*\.([A-Za-z0-9-]+)$"
        return [("email_spelled", F.regexp_replace(value, F.lit(whole), pick(["$1 at $2 dot $3", "$1[at]$2[dot]$3", "$1 (at) $2 (dot) $3"])), ok)]
    if kind == "card":
        def dotted(d: Column) -> Column:
            cut = F.when(F.length(d) == 14, F.lit("^(.{4})(.{4})(.{3})(.*)$")).otherwise(F.lit("^(.{4})(.{4})(.{4})(.*)$"))
            return F.regexp_replace(d, cut, F.lit("$1.$2.$3.$4"))

        long = F.length(d).between(14, 16)
        spoilt = F.concat(F.substr(d, F.lit(1), F.length(d) - 1), F.pmod(F.substr(d, F.length(d), F.lit(1)).cast("int") + 1, F.lit(10)).cast("string"))
        return [("number_dotted", F.when(long, dotted(d)), ok), ("number_dotted", F.when(long & (ok > 0), dotted(spoilt)), F.lit(0.0))]
    if kind == "phone":
        gap = pick([" ", "-", "/", "."])
        tail = F.when(F.length(d) < 13, part(9)).otherwise(F.concat(part(9, 3), gap, part(12)))
        number = F.concat(F.lit("0"), part(3, 3), gap, part(6, 3), gap, tail)
        date = F.concat(F.lit("0"), part(3, 1), gap, part(4, 2), gap, part(6, 4))
        return [("phone_national", number, ok), ("phone_national", F.when(ok > 0, date), F.lit(0.0))]
    return []


def _found_wide(kind: str, m: Column, x: Column) -> Column:
    """0 for a wide candidate that has no cue or fails its check; null if it may be personal data or is a base span."""
    cue, digits = F.get(x, F.lit(FEATURES.index("cue"))) > 0, F.length(digits_of(m["value"]))
    fine = {"email_spelled": F.lit(True), "number_dotted": passes("card", m["value"]), "phone_national": digits.between(*NATIONAL)}[kind]
    open_ = cue & fine | (passes("ip", m["value"]) if kind == "number_dotted" else F.lit(False))
    return F.when(~open_, F.lit(0.0))


def _rows(docs: DataFrame) -> DataFrame:
    """A row per labelled candidate of the wide form: kind, x (features), y, hash (of the text), at (its start)."""
    patterns = {k: (p, _may(k)) for k, p in (BASE_PATTERNS | WIDE_PATTERNS).items() if k != "ip"}
    found = with_matches(docs, "text", patterns)
    text, lists = F.col("text"), []

    def row(kind: str, m: Column, value: Column, y: Column) -> Column:
        at = F.struct(m["start"].alias("start"), m["end"].alias("end"), value.alias("value"))
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("at"), features(text, at).alias("x"), y.alias("y"))

    def rewritten(kind: str, i: int) -> Column:
        def of(m: Column) -> Column:
            wide, value, y = _wide_forms(kind, m["value"])[i]
            return F.when(value.rlike(f"^(?:{WIDE_PATTERNS[wide]})$"), row(wide, m, value, y))

        return F.transform(kind, of)

    def natural(kind: str) -> Column:
        return F.transform(kind, lambda m: row(kind, m, m["value"], _found_wide(kind, m, features(text, m))))

    lists += [rewritten(k, i) for k in ("email", "card", "phone") for i in range(len(_wide_forms(k, text)))]
    lists += [natural(k) for k in WIDE_PATTERNS]
    labelled = F.filter(F.concat(*lists), lambda r: r.isNotNull() & r["y"].isNotNull())
    return found.select(F.explode(labelled).alias("r"), F.xxhash64("text").alias("hash")).select("r.*", "hash")


def _may(kind: str) -> Column:
    """A cheap condition that every text with a match fulfils."""
    need = {"email": "@", "ip": ".", "phone": "+", "email_spelled": "dot", "number_dotted": ".", "phone_national": "0"}
    return F.contains("text", F.lit(need[kind])) if kind in need else F.lit(True)


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Trees from a sample of the labelled rows, thresholds from all of them."""
    rows = written(_rows(docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))), "pii-rows")
    sizes = {(r.kind, r.y): r.n for r in rows.groupBy("kind", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = {y: sum(min(n, sample) for (_, c), n in sizes.items() if c == y) for y in (0.0, 1.0)}
    if not min(classes.values()):
        return Model([], {})
    # One of so many hashes of text and place, by kind and class; copies of a text count once.
    every = F.lit(1)
    for (kind, y), n in sizes.items():
        every = F.when((F.col("kind") == kind) & (F.col("y") == y), -(-n // sample)).otherwise(every)
    part = rows.where(F.pmod(F.xxhash64("hash", "at"), every) == 0).dropDuplicates(["hash", "at", "kind", "y"])
    weight = F.when(F.col("y") > 0, 1.0 / classes[1.0]).otherwise(1.0 / classes[0.0]) * sum(classes.values()) / 2
    part = part.select(array_to_vector("x").alias("v"), "y", weight.alias("w"))
    fitted = GBTClassifier(featuresCol="v", labelCol="y", weightCol="w", maxIter=TREES, maxDepth=DEPTH, seed=1, cacheNodeIds=False).fit(part)
    model = Model([(w, _tree(t._call_java("rootNode"))) for w, t in zip(fitted.treeWeights, fitted.trees)], {})
    # Scores in bins: at most ``BINS`` rows of a kind.
    binned = rows.select("kind", F.floor(model.level(F.col("x")) * (BINS - 1)).alias("bin"), "y")
    sums = binned.groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits")).collect()
    model.thresholds = thresholds([(r.kind, r.bin, r.n, r.hits) for r in sums])
    return model


def thresholds(sums: list[tuple[str, int, int, float]]) -> dict[str, float]:
    """Per wide kind the lowest precise score, from (kind, bin, rows, positives); the fallback where there are too few positives."""
    out = {}
    for kind in WIDE_PATTERNS:
        own = sorted(((b, n, h) for k, b, n, h in sums if k == kind), reverse=True)
        if sum(h for _, _, h in own) < ENOUGH:
            out[kind] = FALLBACK
            continue
        n = hits = 0.0
        for b, more, h in own:
            n, hits = n + more, hits + h
            if hits >= ENOUGH and hits >= PRECISION * n:
                out[kind] = b / (BINS - 1)
    return out


def scan(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``found``: the spans (start, kind_order, end, kind), in order."""
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept")
    rows = docs.select(kept, F.coalesce(F.col(text), F.lit("")).alias("text"))
    wide = {k: p for k, p in WIDE_PATTERNS.items() if k in model.thresholds}
    found = with_matches(rows, "text", {k: (p, _may(k)) for k, p in (BASE_PATTERNS | wide).items()})

    def confirmed(kind: str) -> Column:
        return F.filter(kind, lambda m: passes(kind, m["value"]))

    def selected(kind: str) -> Column:
        scored = F.transform(kind, lambda m: F.struct(m.alias("m"), features(F.col("text"), m).alias("x")))
        above = F.filter(scored, lambda s: model.level(s["x"]) >= model.thresholds[kind])
        return F.transform(above, lambda s: s["m"])

    tags = [tagged(confirmed(k), i, k) for i, k in enumerate(BASE_PATTERNS)]
    tags += [tagged(selected(k), len(BASE_PATTERNS) + i, k) for i, k in enumerate(wide)]
    return found.select("kept.*", F.sort_array(F.concat(*tags)).alias("found"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = scan(docs, train(docs))
    count = lambda i: F.size(F.filter("found", lambda x: x["kind_order"] == i)).cast("bigint")
    base = F.filter("found", lambda x: x["kind_order"] < len(BASE_PATTERNS))
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE_PATTERNS)],
        F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("found")).alias("spans"),
    )


def _mask(text: Column, found: Column) -> Column:
    """The text with every run of overlapping spans replaced by the first one's kind in brackets."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        between = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        more = F.array(between, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["parts"]).otherwise(F.concat(acc["parts"], more)).alias("parts")
        )

    done = F.aggregate(found, begin, step)
    return F.concat(F.array_join(done["parts"], ""), F.substr(text, done["at"] + 1, F.length(text)))


def redacted(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """The documents with personal data in ``text`` replaced by its kind; other columns stay as they are."""
    model = model or train(docs, text)
    found = scan(wrapped(docs, text), model, text, keep=(text, "__rest"))
    clean = F.when(F.size("found") > 0, _mask(F.col(text), F.col("found"))).otherwise(F.col(text))
    return unwrapped(found.withColumn(text, clean), docs.columns, text)
