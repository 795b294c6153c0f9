"""Near-dedup by sets of five-word shingles, against brute force."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from kinespark.llm import common, simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 5 else frozenset([tuple(w)] if w else [])


def classes(rows):
    """The smallest id of the class of each id, by all pairs."""
    sets = defaultdict(list)
    for k, text in rows:
        sets[shingles(text)].append(k)
    distinct = list(sets)
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(distinct):
        for j in range(i):
            y = distinct[j]
            if len(x & y) * 5 >= 4 * len(x | y):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, x in enumerate(distinct):
        least[find(i)] += sets[x]
    return {k: min(ids) for ids in least.values() for k in ids}


def change(rng, text, n):
    w = text.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = f"z{rng.getrandbits(40)}"
    return " ".join(w)


def found(spark, rows, dense=simhash.CROWD, block=simhash.BLOCK):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", common.row_key("text"))
    got = simhash.similar(df, dense=dense, block=block).groupBy("root").agg(F.collect_set("doc_id").alias("ids")).collect()
    return {k: min(r["ids"]) for r in got for k in r["ids"]}


def documents():
    rng = random.Random(77)
    text = lambda n: " ".join(f"w{rng.getrandbits(14)}" for _ in range(n))
    rows, pairs = [], []
    for n in (60, 150, 300, 800):
        for _ in range(12):
            one = text(n)
            pairs.append((len(rows), len(rows) + 1))
            rows += [one, change(rng, one, rng.randint(0, max(1, n // 45)))]
    hub = text(200)
    rows += [change(rng, hub, rng.randint(1, 5)) for _ in range(60)]  # a crowd of near copies
    chain = text(200)
    for _ in range(20):  # each like the one before, ends unlike
        rows.append(chain)
        chain = change(rng, chain, 3)
    shared = text(120)
    rows += [shared + " " + text(rng.randint(20, 300)) for _ in range(40)]  # a passage in common, mostly unlike
    rows += [rows[0].upper(), None, "", " \n", "one two", "ONE two", "a b c d e", "a b c d e f", "long " * 50_000, " ".join(f"v{k}" for k in range(200_000))]
    return list(enumerate(rows))


def test_similar_classes_equal_brute_force(spark):
    rows = documents()
    want = classes(rows)
    for dense, block in ((simhash.CROWD, simhash.BLOCK), (2, 3000)):  # the latter in many blocks a band
        assert found(spark, rows, dense, block) == want


def test_pairs_at_the_limit_are_found(spark):
    rng, rows, want = random.Random(8), [], set()
    for k in range(300):
        one = " ".join(f"w{k}x{i}" for i in range(204))  # 200 shingles
        other = one.split()
        n = rng.randint(3, 4)
        for at in range(n):  # 5 shingles each: Jaccard 185 / 215 or 180 / 220
            other[20 + 40 * at] = f"c{k}"
        rows += [(2 * k, one), (2 * k + 1, " ".join(other))]
        want.add(2 * k + 1)
    got = found(spark, rows)
    assert sum(got[k] == k - 1 for k in want) >= 298


def test_dedup_keeps_one_of_each_class(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("clash"))
    out = simhash.dedup(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(classes(rows).values()))
    assert simhash.dedup(df.limit(0)).count() == 0
