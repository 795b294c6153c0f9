"""Categories, questions, ratings, tag quality, repaired JSON, containment and pieces of tracks over rows given here."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kinespark.functions import parse as P
from kinespark.operators import benchmarks as B
from kinespark.operators import joins as J
from kinespark.operators import ordering


def test_categories_by_name_alias_and_part(spark):
    known = ["Action Order", "Camera Motion", "Location-related Motion", "Motion Recognition"]
    dictionary = spark.createDataFrame([(c, k) for k, c in enumerate(known)], "category string, place int")
    want = {"Camera Motion": "Camera Motion", "camera motion": "Camera Motion", "cm": "Camera Motion", "motion": "Camera Motion", "RELATED": "Location-related Motion", "": "Action Order", "zoom": "zoom", "n O": "Action Order", None: None}
    asked = spark.createDataFrame([(n,) for n in want], "name string")
    got = B.resolved(asked, "name", dictionary, {"CM": "Camera Motion"})
    assert {r.name: r.category for r in got.collect()} == want
    assert {r.category for r in B.resolved(asked, "name", dictionary.limit(0), {}).collect()} == set(want)


def test_questions_need_an_answer_and_a_text(spark):
    qa = [("1", "a ", "Q?\n A. x\nB.  y z\nmore\nC no"), ("2", "NA", "Q"), ("3", "na", "Q"), ("4", "", "Q"), ("5", None, "Q"), ("6", "B", ""), ("7", "B", None), (None, "n/a", "A.only")]
    rows = [("k", "MR", None, qa), (None, "AO", "v", qa[:1]), ("z", None, "v", None), ("y", "MR", "v", [])]
    df = spark.createDataFrame(rows, "key string, question_type string, video_path string, qa array<struct<uid: string, answer: string, question: string>>")
    got = [(r.key, r.uid, r.video, r.question, [tuple(o) for o in r.options], r.answer) for r in B.questions(df).collect()]
    first = ("Q?\nmore\nC no", [("A", "x"), ("B", "y z")], "A")
    assert got == [("k", "1", "k.mp4", *first), ("k", "", "k.mp4", "", [("A", "only")], "N/A"), (None, "1", "v", *first)]
    assert [r.key for r in B.questions(df, ["MR"]).collect()] == ["k", "k"]


def test_ratings_of_missing_scores_and_repeated_classes(spark):
    rows = [("s", "x", ["c", "c"], 1.0), ("s", None, [], 0.0), ("l", "x", None, -1.0)]
    df = spark.createDataFrame(rows, "dur string, dom string, cls array<string>, v double")
    got = {tuple(r)[:3]: r.rating for r in B.ratings(df, "dur", ["dom"], "cls", "v").collect()}
    assert got == {
        ("s", "overall", None): "0.500", ("l", "overall", None): "nan", ("overall", "overall", None): "0.500",
        ("s", "dom", "x"): "1.000", ("s", "dom", None): "0.000", ("l", "dom", "x"): "nan", ("overall", "dom", "x"): "1.000", ("overall", "dom", None): "0.000",
        ("s", "cls", "c"): "1.000", ("overall", "cls", "c"): "1.000",
    }
    report = {r.dur: json.loads(r.report) for r in B.rating_report(B.ratings(df, "dur", ["dom"], "cls", "v"), "dur").collect()}
    assert report["s"] == {"overall": {"": "0.500"}, "dom": {"x": "1.000", "": "0.000"}, "cls": {"c": "1.000"}}


def test_tag_quality_of_null_texts(spark):
    df = spark.createDataFrame([(None,), ("<motion>up</motion><motion>stationary, single frame</motion><motion>stationary</motion>",), ("none",)], "t string")
    assert tuple(df.agg(*B.tag_quality(F.col("t"))).first()) == (3, 1, 3, 1, 1, 1)


def test_json_that_breaks_off_anywhere_is_repaired():
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(6 if depth < 3 else 4)
        if kind < 4:
            return rng.choice([1.5, -20, True, None, "a\"]}\\", "", "é"])
        return [value(depth + 1) for _ in range(rng.randrange(4))] if kind == 4 else {f"k{k}": value(depth + 1) for k in range(rng.randrange(4))}

    for _ in range(60):
        whole = {"1": [1, 2, 3, 4], "x": value(0), "y": value(0)}
        text = json.dumps(whole)
        for cut in range(1, len(text) + 1):
            fixed = P.repaired_json(text[:cut])
            try:
                got = json.loads(fixed)
            except ValueError:
                # A literal or number that is cut short is no value.
                assert text[:cut].rstrip()[-1] in "trufalsn-.0123456789"
                continue
            assert isinstance(got, dict) and (cut < 17 or got["1"] == [1, 2, 3, 4] or cut < text.index("]"))
        assert json.loads(P.repaired_json(text)) == whole


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"1": [1, 2, 3, 4}, "2": [5, 6, 7, 8]', {"1": [1, 2, 3, 4]}),
        ('{"1": [1, 2, 3, 4]]}, x', {"1": [1, 2, 3, 4]}),
        ('[{"1": [1, 2, 3, 4], ', {"1": [1, 2, 3, 4]}),
        ('{"1": [1, 2, 3, 4], "2"', {"1": [1, 2, 3, 4]}),
        ('{"1": [1, 2, 3, 4], "2": ', {"1": [1, 2, 3, 4]}),
        ('{"1": [1, 2, 3, true], "2": [[1, 2, 3, 4]]}', {}),
        ('[["7", [1, 2, 3, 4]], ["8", [1, 2', {"7": [1, 2, 3, 4]}),
        ("}]", {}),
    ],
)
def test_boxes_of_broken_json(text, want):
    assert P.repaired_boxes("see " + text) == want


def test_containment_equals_all_pairs_without_a_row_for_each_bucket(spark):
    rng = random.Random(2)
    spans = [(k, rng.choice("ab"), float(a := rng.choice([rng.uniform(-1e6, 1e6), rng.randrange(-8, 9)])), a + rng.choice([0.0, 0.5, 1.0, 64.0, 3e7, 10 ** rng.uniform(-2, 6), -1.0])) for k in range(150)]
    spans += [(900, None, 0.0, 1.0), (901, "a", None, 1.0), (902, "c", 0.0, 1.0)]
    points = [(k, rng.choice("ab"), rng.choice([float(rng.randrange(-9, 9)), rng.uniform(-1e6, 3e6), rng.choice(spans)[2]])) for k in range(200)]
    p, s = spark.createDataFrame(points, "p long, g string, t double"), spark.createDataFrame(spans, "k long, g string, a double, b double")
    fits = lambda q, r: q[2] is not None and None not in r[2:] and r[2] <= q[2] <= r[3]
    for unit in (0.25, 1.0, 1000.0):
        got = J.containing_join(p, s, ["g"], "t", "a", "b", unit).select("p", "k").collect()
        assert sorted(map(tuple, got)) == sorted((q[0], r[0]) for q in points for r in spans if q[1] == r[1] and fits(q, r))
    got = J.containing_join(p, s.drop("g"), [], "t", "a", "b").select("p", "k").collect()
    assert sorted(map(tuple, got)) == sorted((q[0], r[0]) for q in points for r in spans if fits(q, r))
    # A span of a year at a tenth of a second makes two rows.
    year = spark.createDataFrame([(1, "a", 0.0, 3.2e7)], "k long, g string, a double, b double")
    assert J.containing_join(spark.range(0, 100).select(F.lit("a").alias("g"), (F.col("id") * 1e6).alias("t")), year, ["g"], "t", "a", "b", 0.1).count() == 33


def test_totals_of_containment_equal_all_pairs_without_the_pairs(spark):
    rng = random.Random(3)
    at = lambda: rng.choice([float(rng.randrange(-9, 9)), rng.randrange(-(10**9), 10**9) / 1000])
    spans = [(k % 140, rng.choice("ab"), a := at(), a + rng.choice([0.0, 0.5, 7.0, 3e5, 1e6, -1.0])) for k in range(160)] + [(900, None, 0.0, 1.0), (901, "a", None, 1.0), (902, "c", 0.0, 1.0)]
    points = [(rng.choice(["a", "b", None]), rng.choice([at(), rng.choice(spans)[2], rng.choice(spans)[3]])) for _ in range(300)]
    p, s = spark.createDataFrame(points, "g string, t double"), spark.createDataFrame(spans, "k long, g string, a double, b double")
    for keys in (["g"], []):
        want = {}
        for k, g, a, b in spans:
            for h, t in points:
                if (not keys or g is not None and g == h) and None not in (a, t) and a <= t <= b:
                    n, far = want.get(k, (0, 0.0))
                    want[k] = n + 1, far + t - a
        got = {r["k"]: (r["inside"], r["offset"]) for r in J.contained_totals(p.select(*keys, "t"), s, keys, "t", "a", "b", ["k"]).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == n and got[k][1] == pytest.approx(far, abs=1e-3) for k, (n, far) in want.items())
    # 100,000 points in each of 100,000 intervals: ten thousand million pairs, a few hundred thousand rows.
    many = spark.range(100_000).select("id", F.lit("a").alias("g"), (F.col("id") / 1000).alias("t"))
    found = J.contained_totals(many.select("g", "t"), many.select(F.col("id").alias("k"), "g", (-1 - F.col("t")).alias("a"), (F.col("t") + 1000).alias("b")), ["g"], "t", "a", "b", ["k"])
    assert found.filter("inside = 100000").count() == 100_000


def test_pieces_of_a_heavy_key_are_bounded(spark):
    rows = [("heavy", k) for k in range(1000)] + [("light", k) for k in range(3)] + [(None, 7)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    held = ordering.pieces(df, ["k"], [F.col("v")], 64, partitions=8)
    got = {(r.k, r.v): (r.piece, r.place) for r in held.collect()}
    assert got == {(k, v): (v // 64, v % 64) if k else (0, 0) for k, v in rows}


def test_track_of_many_pieces_is_one_row(spark, tmp_path):
    from kinespark.plans.aggregates import PIECE
    from kinespark.queries import QUERIES

    n = 2 * PIECE + 5
    rows = spark.range(n).select(F.lit(1).cast("bigint").alias("user_id"), (n - F.col("id")).alias("event_id"), F.timestamp_seconds(F.col("id") % 7).cast("timestamp_ntz").alias("ts"), F.lit(0.5).alias("value"), F.lit('{"k": 1}').alias("props"), F.lit("a").alias("event_type"))
    rows = rows.union(rows.limit(2).withColumns({"user_id": F.lit(2).cast("bigint"), "event_id": F.lit(None).cast("bigint")}))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {r["obj"]: r["track"] for r in QUERIES["A01_trajectory_build"](spark, str(tmp_path)).collect()}
    assert got == {1: ",".join(str(x) for _, x in sorted((k % 7, n - k) for k in range(n))), 2: None}
