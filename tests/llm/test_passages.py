"""Substring dedup: passages with third holders, and fuzzy ones."""

import random

from kinespark.llm import passages


def make(rng):
    return lambda n: [f"w{rng.getrandbits(40)}" for _ in range(n)]


def test_smaller_ids_with_snippets_hide_no_passage(spark):
    fresh = make(random.Random(3))
    passage, rows = fresh(80), []
    for k in range(13):
        rows.append((k, " ".join([*fresh(30), *passage[6 * k : 6 * k + 10], *fresh(30)])))
    rows += [(100, " ".join([*fresh(30), *passage, *fresh(20)])), (101, " ".join([*fresh(10), *passage, *fresh(40)]))]
    # A passage made of two lines of two earlier documents.
    other = fresh(60)
    rows += [(200, " ".join([*fresh(30), *other[:30], *fresh(30)])), (201, " ".join([*fresh(30), *other[30:], *fresh(30)]))]
    rows += [(202, " ".join([*fresh(30), *other, *fresh(30)])), (203, " ".join([*fresh(50), *other, *fresh(30)]))]
    got = passages.repeats(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, h string, at int"))
    want = {(101, 10, 90, 100, 30, 110, 80, 1.0), (203, 50, 110, 202, 30, 90, 60, 1.0)}
    assert {tuple(r) for r in got.collect()} == want
    named = spark.createDataFrame([(f"d{i:03}", t) for i, t in rows], "doc_id string, text string")
    assert {tuple(r) for r in passages.repeats(named).collect()} == {(f"d{r[0]:03}", *r[1:3], f"d{r[3]:03}", *r[4:]) for r in want}


def test_recall_of_fuzzy_passages(spark):
    rng = random.Random(4)
    fresh = make(rng)
    rows, every, n = [], {}, 0
    for period in (12, 10, 8):
        for _ in range(100):
            one = fresh(60)
            two = list(one)
            for k in range(rng.randrange(period), 60, period):
                two[k] = fresh(1)[0]
            rows += [(n, " ".join([*fresh(30), *one, *fresh(30)])), (n + 1, " ".join([*fresh(20), *two, *fresh(30)]))]
            every[n + 1], n = period, n + 2
    got = {r["doc_id"] for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {p: sum(k in got for k, x in every.items() if x == p) / 100 for p in (12, 10, 8)}
    assert recall[12] >= 0.95 and recall[10] >= 0.9 and recall[8] >= 0.6, recall


def test_very_long_text(spark):
    fresh = make(random.Random(6))
    passage = fresh(70)
    rows = [(1, " ".join([*fresh(150_000), *passage, *fresh(10)])), (2, " ".join(passage)), (3, None), (4, ""), (2, " ".join(passage))]
    got = [tuple(r) for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got == [(2, 0, 70, 1, 150_000, 150_070, 70, 1.0)]


def test_a_passage_reaches_beyond_its_chain(spark):
    fresh = make(random.Random(9))
    passage, rows = fresh(900), []
    # Smaller ids hold snippets of nearly all of it, so that the matches of the two that share it lie far within.
    for k in range(0, 850, 6):
        if not 440 <= k <= 452:
            rows.append((k, " ".join([*fresh(20), *passage[k : k + 46], *fresh(20)])))
    rows += [(2000, " ".join([*fresh(80), *passage, *fresh(30)])), (2001, " ".join([*fresh(10), *passage, *fresh(40)]))]
    got = {tuple(r) for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["first_doc_id"] == 2000}
    assert got == {(2001, 10, 910, 2000, 80, 980, 900, 1.0)}


def test_snippets_of_46_words_hide_none_of_120(spark):
    fresh = make(random.Random(3))
    passage, rows = fresh(120), []
    for k in range(13):
        rows.append((k, " ".join([*fresh(30), *passage[6 * k : 6 * k + 46], *fresh(30)])))
    rows += [(100, " ".join([*fresh(80), *passage, *fresh(20)])), (101, " ".join([*fresh(80), *passage, *fresh(40)]))]
    got = {tuple(r) for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["first_doc_id"] == 100}
    assert got == {(101, 80, 200, 100, 80, 200, 120, 1.0)}
