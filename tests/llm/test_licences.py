import math
import random
import re

from pledgelens.llm import licences as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def stands(ws, phrase):
    p = phrase.split()
    return [i for i in range(len(ws) - len(p) + 1) if ws[i:i + len(p)] == p]


def brute(all_words):
    counts = {}
    for ws in all_words:
        for w in set(ws):
            counts[w] = counts.get(w, 0) + 1
    idf = {w: math.log((1 + len(all_words)) / (1 + n)) for w, n in counts.items()}
    for ws in all_words:
        places = sorted(i for p in L.BASE_PHRASES for i in stands(ws, p))
        base = sorted(label for p, label in L.BASE_PHRASES.items() if stands(ws, p))
        labels, score = set(base), 1.0 if places else 0.0
        for t in L.TEMPLATES:
            tw = t.words.split()
            if any(w not in idf for w in tw) or not all(stands(ws, p) for p in t.phrases):
                continue
            rare = [w for w in sorted(set(tw), key=lambda w: (-idf[w], w)) if w in ws][:L.RARE]
            votes = {}
            for w in rare:
                for s in {i - j for i, x in enumerate(ws) if x == w for j, y in enumerate(tw) if y == w}:
                    votes[s] = votes.get(s, 0) + 1
            best = max(votes.values(), default=0)
            if best >= min(L.AGREE, len(rare)):
                labels.add(t.label)
                score = max(score, best / len(rare))
        first, last = (places[0], places[-1]) if places else (None, None)
        yield len(ws), len(places), first, last, ",".join(base), ",".join(sorted(labels)), score


def test_scan(spark):
    rnd = random.Random(8)
    lines = [t.words for t in L.TEMPLATES] + [t.words.upper().replace(" ", ", ") for t in L.TEMPLATES]
    lines += ["CC BY", "cc", "by", "all rights", "reserved.", "All Rights Reserved", "general public license", "the", "É x", "apache license", "mit license"]
    texts = [None, "", " .. ", "cc by cc by", "x" * 1000, "word " * 20000 + "CC-BY", *lines]
    texts += [" ".join(rnd.choice(lines) for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    texts += [" ".join(rnd.sample(t.words.split(), len(t.words.split()))) for t in L.TEMPLATES]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "cc by", "clash"), (3, "cc by cc by", "clash")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string").repartition(3)
    got = sorted((str(r.doc_id), *[round(x, 9) if isinstance(x, float) else x for x in r[1:]]) for r in L.scan(docs).collect())
    want = sorted((str(i), *w[:-1], round(w[-1], 9)) for (i, _, _), w in zip(rows, brute([words(t) for _, t, _ in rows])))
    assert [str(x) for x in got] == [str(x) for x in want]
    assert L.scan(docs.limit(0)).count() == 0
