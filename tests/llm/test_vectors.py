"""Embedding near-dedup against all pairs: strangers, copies, near copies, chains and pairs at the limit."""

import math

import numpy as np
import pytest

from kinespark.llm import vectors

SCHEMA = "vec_id long, embedding array<double>, label int, node string"


def brute(rows, limit):
    good, units = [], []
    for k, (_, v, *_) in enumerate(rows):
        v = None if v is None or any(x is None for x in v) else np.array(v, float)
        if v is not None and len(v) and np.isfinite(v).all() and v.any():
            v = v / np.abs(v).max()
            good.append(k)
            units.append(v / np.linalg.norm(v))
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(good):
        for j, b in enumerate(good[:i]):
            if len(units[i]) == len(units[j]) and units[i] @ units[j] >= limit:
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[find(a)] = find(b)
    ids = {}
    for k, r in enumerate(rows):
        if r[0] is not None and k in set(good):
            ids[find(k)] = min(ids.get(find(k), r[0]), r[0])
    component = [ids.get(find(k)) if k in set(good) else r[0] for k, r in enumerate(rows)]
    return sorted([(r[0], n[k], component[k], r[0] == component[k]) for k, r in enumerate(rows)], key=str)


def rotated(rng, v, cosine):
    w = rng.standard_normal(len(v))
    w -= w @ v / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine * cosine) * w / np.linalg.norm(w)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    held = [rng.standard_normal(24) for _ in range(250)]
    held += [held[0]] * 40 + [-0.0 * held[0] + held[0], held[0] * 3, held[1] * 1e-200, held[1] * 1e200]
    held += [rotated(rng, held[2], c) for c in rng.uniform(0.97, 0.9999, 80)]  # a ball
    held += [rotated(rng, held[3], c) for c in rng.uniform(0.9, 0.96, 60)]  # neighbours of one, not of one another
    chain = held[4]
    for _ in range(15):
        chain = rotated(rng, chain, 0.93)
        held.append(chain)
    held += [rotated(rng, held[250], 0.94) for _ in range(20)]
    out = [(int(k), [float(x) for x in v], 1, "clash") for k, v in enumerate(rng.permutation(np.array(held)))]
    odd = [None, [], [0.0] * 24, [1.0] + [None] * 23, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [5.0], [-5.0], [1e-320] * 24]
    out += [(1000 + k, v, None, None) for k, v in enumerate(odd)]
    return out + [out[5], (None, out[5][1], None, None), (None, out[6][1], None, None), (None, None, None, None), out[-11]]


@pytest.mark.parametrize("block", [512, 7])
def test_links_equal_all_pairs(spark, rows, block):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = vectors.links(docs, recall=1 - 1e-9, block=block)
    assert got.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    want = [(k, n, c, kept or k is None and c is None) for k, n, c, kept in brute(rows, vectors.LIMIT)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_recall_of_pairs_at_the_limit_is_as_calibrated(spark):
    rng = np.random.default_rng(9)
    first = [rng.standard_normal(64) for _ in range(1500)]
    both = first + [rotated(rng, v, 0.9 + 1e-9) for v in first]
    docs = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(both)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.links(docs).collect()}
    assert sum(got[k] > 0 for k in range(1500)) >= 0.98 * 1500


def test_calibration_grows_with_the_nodes():
    sizes = [vectors.calibrated(10**k) for k in range(1, 12)]
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(sizes, sizes[1:]))


def test_an_empty_table_gives_none(spark):
    assert vectors.links(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in vectors.links(spark.createDataFrame([(3, None, 1, "")], SCHEMA)).collect()] == [(3, 0, 3, True)]
