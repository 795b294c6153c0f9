"""Importance resampling against brute force, and its CRCs against zlib's."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kinespark.llm import automaton, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, run):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[k : k + r]) for r in range(1, run + 1) for k in range(len(w) - r + 1)]


def brute(rows, target, buckets, run, least, percent, seed):
    crc = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = Counter(crc(x) for _, d, *_ in rows for x in features(d, run)[1]), Counter(crc(x) for d in target for x in features(d, run)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in range(buckets)]
    out = []
    for doc, text, *_ in rows:
        words, found = features(text, run)
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[crc(x)] for x in found)
        out.append((doc, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0, x[2]))
    rank = [(x[0], x[2], x[3], x[4], k + 1 if k < percent * len(fit) // 100 else None) for k, x in enumerate(fit)]
    return sorted(rank + [(x[0], x[2], x[3], x[4], None) for x in out if x[1] < least], key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    make = lambda n: " ".join("".join(rng.choice("aBcdé9Ωz") for _ in range(rng.randint(1, 9))) + rng.choice(["", "-", "\n", " ", "_", "@["]) for _ in range(n))
    texts = [make(rng.randint(0, 60)) for _ in range(150)] + [None, "", " \x7f\x00", "w" * 500, "Q" * 3000 + " é" * 40]
    out = [(k, t, "clash", 3) for k, t in enumerate(texts)]
    return out + [out[4], out[4], (None, None, None, None), (None, texts[0], "x", 1)]


@pytest.mark.parametrize(("buckets", "run", "least", "percent"), [(10000, 1, 20, 10), (97, 3, 5, 50), (1, 2, 0, 100)])
def test_draw_equals_brute_force(spark, rows, buckets, run, least, percent):
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, rank long").repartition(3)
    target = [rows[3][1], rows[9][1], None, ""]
    got = resample.draw(docs, spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"), buckets, run, least, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, target, buckets, run, least, percent, resample.SEED)


def test_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows[:40], "doc_id long, text string, a string, b long")
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.draw(docs.limit(0), none).count() == 0
    assert sorted(map(tuple, resample.draw(docs, none).collect()), key=str) == brute(rows[:40], [], 10000, 1, 20, 10, resample.SEED)


def test_long_texts_are_read_whole(spark):
    text = "ab " * 2_000_000 + "x" * 3_000_000
    docs = spark.createDataFrame([(1, text), (2, "ab")], "doc_id long, text string")
    got = resample.draw(docs, docs)
    assert {r.doc_id: r.n_features for r in got.collect()} == {1: 2_000_001, 2: 1}


def test_crcs_and_runs_of_slices():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é,") for _ in range(rng.choice([0, 1, 7, 90, 400]))) for _ in range(300)] + [None, "a" * 1000]
    words = 0
    inside = np.zeros(256, bool)
    inside[list(b"ab")] = inside[128:] = True
    for row, last, offsets, data in automaton.slices(pa.array(texts).slice(5), 64):
        starts, ends = automaton.runs(inside[data], offsets)
        crc = automaton.advance(np.full(len(starts), 0xFFFFFFFF, "u4"), data, starts, ends) ^ 0xFFFFFFFF
        own = [w.encode() for t in texts[5 + row : 5 + last] for w in re.findall("[abé]+", t or "")]
        assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == own
        assert crc.tolist() == [zlib.crc32(w) for w in own]
        words += len(own)
    assert words == sum(len(re.findall("[abé]+", t or "")) for t in texts[5:])
