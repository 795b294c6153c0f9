"""Phrase mining against brute force, whatever the sizes of tries, blocks, ranges and groups."""

import random
import re
from collections import Counter, defaultdict

import pytest

from kinespark.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, depth, least, top, within):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, depth + 1):
                f[lang].update(tuple(w[k : k + d]) for k in range(len(w) - d + 1))
    out = []
    for lang, held in f.items():
        held = {p: a for p, a in held.items() if a >= least}
        found = []
        for p, a in held.items():
            inside = [b for q, b in held.items() if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q)))]
            if len(p) < 2 or any(100 * b >= within * a for b in inside):
                continue
            cuts = [(phrases.UNIT * a // (held[p[:k]] + held[p[k:]]), k, held[p[:k]], held[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "é", "Éa", "x\x0by", "z\x01", " w", "new", "york", "city", "hall", "a", "b", "n.y"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "\n", "\t", ". "]) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    texts += ["new york city hall " * 40, "aa " * 500, "\t \n", "", None, "one"]
    out = [(k, t, (None, "en", "de", "und", "a\tb")[k % 5], "clash", k) for k, t in enumerate(texts)]
    return out + [out[7], out[7], (None, None, None, None, None), (None, "new york new york", "en", None, None)]


@pytest.mark.parametrize("sizes", [{}, {"words": 300, "block": 40, "part": 150, "most_ranges": 5}, {"words": 1, "block": 7, "part": 10**9}])
def test_phrases_equal_brute_force(spark, rows, sizes):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = phrases.collocations(docs, least=6, top=25, **sizes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 6, 25, phrases.WITHIN)


def test_depth_and_share_are_parameters(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for depth, within in ((2, 80), (3, 101), (5, 50)):
        assert sorted(map(tuple, phrases.collocations(docs, depth, 9, 1000, within).collect())) == brute(rows, depth, 9, 1000, within)


def test_no_rows_and_no_words_give_none(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, " ,.\n", None), (3, "", "x")], "doc_id long, text string, lang string")
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_long_texts_and_words_are_read_whole(spark):
    text = "alpha beta " * 400_000 + "y" * 5_000_000
    docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    got = {r.phrase: r for r in phrases.collocations(docs).collect()}
    assert got["alpha beta alpha beta"].a == 399_999 and got["alpha beta alpha beta"].n == 800_001


def test_scores_pass_64_bits(spark):
    # 2000000 a is above 2^63; the merged counts stand for a corpus that no test can hold.
    held = [("en", 0, "", 10**14), ("en", 1, "p", 9 * 10**13), ("en", 1, "q", 9 * 10**13 + 1), ("en", 2, "p q", 9 * 10**13 - 7)]
    found = spark.createDataFrame(held, "lang string, depth int, phrase string, f long")
    before = phrases.counts
    phrases.counts = lambda *a, **k: found
    try:
        row = phrases.collocations(found).first()
    finally:
        phrases.counts = before
    assert row.score == 2_000_000 * (9 * 10**13 - 7) // (18 * 10**13 + 1)
