import math
import random
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from pledgelens.llm import bpe, quality

SPACE = " \t\n\r\x0b\x0c"


def split(text):
    words, word = [], ""
    for c in text + " ":
        if c in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    return words


def brute(text):
    text = text or ""
    words = split(text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def corpus():
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdeé\x85\xa0") for _ in range(rnd.randint(1, 5)))
    texts = [None, "", "\n\n \n", "one two", "a b c d e " * 3, "x " * 400, "#*$%&|<> é\U0001f389 a\x1cb"]
    for _ in range(150):
        lines = [" ".join(word() for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(1, 9))]
        texts.append("\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 12))))
    texts += ["日本語の文章です。" * 12, "the quick brown fox jumps over a lazy dog near that old stone bridge " * 1 + "and rests"]
    return texts


def test_base_columns_and_measures(spark):
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    rows = [(i, t, random.Random(i).choice(["en", None, "xx"]), "clash") for i, t in enumerate(corpus())]
    rows += [(None, rows[9][1], "en", "clash"), rows[9], rows[9]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kept string").repartition(3)
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
        assert not (r.base_failed and r.kept)
        if r.n_words:
            ids = lib.encode(r.text, add_special_tokens=False).ids
            assert r.n_tokens == len(ids) and abs(r.chars_per_token - len(r.text) / len(ids)) < 1e-12
            if len(ids) > 1:
                h = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values())
                assert abs(r.token_entropy - h / math.log2(len(ids))) < 1e-9
            band = quality.BANDS.get(r.lang) or quality.BANDS[quality.script(r.text)]
            wide = max(1, math.sqrt(64 / len(ids)))
            inside = band.chars_low / wide <= r.chars_per_token <= band.chars_high * wide and r.fallback_share <= band.fallback_high * wide
            assert r.kept == (inside and r.token_entropy >= band.entropy_low / wide and not r.base_failed)
    assert quality.quality_rules(docs.limit(0)).count() == 0
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and {r.kept for r in kept.collect()} <= {"clash"}
    assert kept.count() == sum(r.kept for r in got)


def test_letters_without_a_piece_fall_back_to_bytes():
    sp = sentencepiece.SentencePieceProcessor(model_file=quality.default_pieces())
    letters = quality.piece_letters(quality.default_pieces())
    for c in "aé日\U0001f389ქ\U0001f9ffñß€":
        ids = [i for i in sp.encode(c) if sp.id_to_piece(i) != "▁"]
        assert (c in letters) == (not any(sp.is_byte(i) for i in ids))


def test_long_runs_of_white_space_and_of_letters():
    """The encoder's stack does not hold such runs; the parts give the ids of the whole."""
    vocabulary, letters = bpe.loaded(bpe.default_vocabulary()), quality.piece_letters(quality.default_pieces())
    words = " ".join(f"word{i}" for i in range(20))
    for gap in (" " * 1_500_000, "\n" * 1_500_000, " \t" * 700_000):
        row = quality.measure(vocabulary, letters, words + gap + "end", "en", quality.BANDS)
        assert row[0] == 21 and row[5] > 20
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    for text in ("ab c " * 20_000, "x" * 70_000 + " y", words + " " * 70_000 + words, "\U0001f389 é " * 15_000):
        assert quality.token_ids(vocabulary, text).tolist() == lib.encode(text, add_special_tokens=False).ids


def test_short_garbage_is_rejected_and_short_prose_kept():
    vocabulary, letters = bpe.loaded(bpe.default_vocabulary()), quality.piece_letters(quality.default_pieces())
    judge = lambda t: quality.measure(vocabulary, letters, t, "en", quality.BANDS)
    garbage = judge("x7Qz 9fK2 pL0v Wq3Z zR8t 4JmX vB6n Y1cD kT5s 8GhU qE2w")
    assert garbage[5] < 64 and garbage[-1] is False
    prose = judge("The ship left the harbour before dawn and nobody on the shore saw it go")
    assert prose[5] < 64 and prose[-1] is True


def test_missing_pieces_are_counted_alike():
    letters = quality.piece_letters(quality.default_pieces())
    for text in ("plain", "ქ🧿" * 5, "".join(map(chr, range(0x12000, 0x12040))) * 3 + " a"):
        assert quality.without_piece(text, letters) == sum(c not in letters and not c.isspace() for c in text)


def test_good_english_is_kept():
    text = ("The museum opened its doors early that morning, and a small crowd of visitors waited outside in the rain. "
            "Inside, the curator explained how each painting had been restored over the previous decade, layer by layer, "
            "until the original colours could finally be seen again by everyone who cared to look closely at them.")
    row = quality.measure(bpe.loaded(bpe.default_vocabulary()), quality.piece_letters(quality.default_pieces()), text, "en", quality.BANDS)
    assert row[-1] is True
