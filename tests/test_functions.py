"""Worked examples, edge cases and properties of the column functions."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinespark.functions import geometry as G
from kinespark.functions import parse as P
from kinespark.functions import text as X
from kinespark.operators import joins as J
from kinespark.operators import rollup as R
from kinespark.operators import trajectory as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def box(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def track(spark, boxes, times=None):
    rows = [("a", k, float((times or range(1, len(boxes) + 1))[k]), [float(x) for x in b]) for k, b in enumerate(boxes)]
    return spark.createDataFrame(rows, "obj string, ord int, t double, box array<double>")


def test_iou(spark):
    assert value(spark, G.iou(box(100, 100, 200, 200), box(150, 150, 250, 250))) == pytest.approx(2500 / 17500)
    assert value(spark, G.iou(box(0, 0, 1), box(0, 0, 1, 1))) == 0
    assert value(spark, G.iou(F.lit(None).cast("array<double>"), box(0, 0, 1, 1))) == 0
    assert value(spark, G.iou_clamped(box(0, 0, 1, 1), box(2, 2, 3, 3))) == 0
    assert value(spark, G.best_iou(box(0, 0, 1, 1), F.array().cast("array<array<double>>"))) == 0


def test_interval_and_proximity(spark):
    assert value(spark, G.interval_iou(*[F.lit(x) for x in (0.0, 1.5, 1.0, 3.0)])) == pytest.approx(0.5 / 3)
    assert value(spark, G.proximity(F.lit(1.0), F.lit(0.0))) == pytest.approx(0.969233, abs=1e-6)
    assert value(spark, G.proximity(F.lit(1.0), F.lit(0.75))) == pytest.approx(0.606531, abs=1e-6)


def test_descriptor(spark):
    got = T.descriptor(track(spark, [[0.1, 0.2, 0.3, 0.4], [0.2, 0.3, 0.4, 0.5], [0.3, 0.4, 0.5, 0.6]])).first()
    assert got.asDict() == {"obj": "a", "n": 3, "dir": "SE", "speed": "fast", "scale": "stable", "shape": "linear", "phase": "constant"}
    one = T.descriptor(track(spark, [[0, 0, 1, 1]])).first()
    assert (one["dir"], one["speed"], one["scale"], one["shape"], one["phase"]) == ("STAT", "stationary", "stable", "stationary", "constant")
    back = T.descriptor(track(spark, [[x, 0, x + 1, 1] for x in (0, 10, 0, 10)])).first()
    assert back["shape"] == "oscillating"
    same = T.descriptor(track(spark, [[0, 0, 1, 1], [5, 0, 6, 1]], [1, 1])).first()
    assert same["speed"] == "stationary"


def test_acceleration_and_smoothness(spark):
    got = T.acceleration(track(spark, [[x, 0, x, 0] for x in (0, 1, 3, 6)], [0, 1, 2, 3])).first()
    assert got["accel"] == pytest.approx(2 / 3)
    assert T.smoothness(track(spark, [[x, 0, x, 0] for x in (0, 20, 20)])).first()["penalty"] == pytest.approx(0.1)


def test_bins_and_scores(spark):
    s = lambda a, b: value(spark, G.direction_score(F.lit(a), F.lit(b)))
    assert [s("E", "SE"), s("N", "S"), s("STAT", "STAT"), s("STAT", "E")] == [0.5, 0, 1, 0]
    assert value(spark, G.ordinal_score(F.lit("odd"), F.lit("odd"), G.SPEEDS)) == 1
    assert tuple(value(spark, G.smart_resize(F.lit(480.0), F.lit(640.0)))) == (364, 504)
    assert tuple(value(spark, G.smart_resize(F.lit(20.0), F.lit(30.0)))) == (56, 84)
    assert value(spark, G.smart_frames(F.lit(300), F.lit(30.0))) == 16


def test_text(spark):
    a, b = F.lit("Object moves right"), F.lit("Object moves rightward")
    assert value(spark, X.token_f1(a, b)) == pytest.approx(2 / 3)
    assert value(spark, X.closeness(a, b)) == pytest.approx(1 - 4 / 22)
    assert value(spark, X.closeness(F.lit(""), F.lit(""))) == 1
    assert X.rouge("the cats sat", "the cat sat") == pytest.approx(1.0)
    assert value(spark, X.simple_accuracy(F.lit("3.0"), F.lit("3"))) == 1


def test_parsers(spark):
    text = "<think><obj>A cup!</obj><box>[1,2,3,4]</box><box>[2,2,3,4]</box>at<t>1.5</t>s <obj>b</obj><box>[0.1,</box>at<t>2</t>s</think>"
    got = value(spark, P.claims(F.lit(text)))
    assert [(c["name"], c["boxes"], c["t"]) for c in got] == [("A cup!", [[1, 2, 3, 4], [2, 2, 3, 4]], 1.5)]
    assert value(spark, P.claims(F.lit(""))) == []
    assert value(spark, P.block(F.lit("none"), "think")) is None
    assert P.choose("The answer is (B).", "ABCD", {}) == "B"
    assert P.choose("", "ABCD", {}) == "API Error"
    assert P.repaired_boxes("x {'1': [1, 2, 3, 4]") == {"1": [1, 2, 3, 4]}


def test_joins(spark):
    assert value(spark, J.one_sided_nearest(F.array(F.lit(1.0), F.lit(5.0), F.lit(9.0)), F.lit(7.0))) == 5
    probe = spark.createDataFrame([(1, "p", 7.0)], "id int, k string, t double")
    build = spark.createDataFrame([("p", 5.0, 0), ("p", 9.0, 1)], "k string, t double, ord int")
    assert J.nearest_join(probe, build, ["k"], 2.0, ["id"]).count() == 0
    assert J.nearest_join(probe, build, ["k"], 2.5, ["id"]).first()["near_ord"] == 0
    assert J.greedy_match(["cup", "red cup"], ["red cup"]) == [0, -1]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.integers(1, 5).flatmap(lambda m: st.lists(st.lists(st.integers(-9, 9), min_size=m, max_size=m), min_size=n, max_size=n))))
def test_assignment_is_optimal(cost):
    import itertools

    got = J.assignment(cost)
    n, m = len(cost), len(cost[0])
    total = sum(cost[i][j] for i, j in enumerate(got) if j >= 0)
    k = min(n, m)
    best = min(sum(cost[i][j] for i, j in zip(rows, cols)) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
    assert total == best and len([j for j in got if j >= 0]) == k


def test_rollups(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "g int, r double")
    got = {(r["g"], r["r"]): r["advantage"] for r in R.advantages(df, ["g"], "r").collect()}
    assert got[1, 2.0] == pytest.approx(0.707007, abs=1e-6) and got[2, 5.0] is None
    four = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4)], "k int, x double")
    assert R.nearest_rank(four, ["k"], "x", [50]).first()["p50"] == 3
    votes = spark.createDataFrame([(1, "A", 0.2), (1, "B", 1.0), (1, "A", 0.6)], "k int, c string, w double")
    assert R.weighted_vote(votes, ["k"], "c", "w").first()["winner"] == "B"


def test_lone_gap(spark):
    assert math.isclose(-(math.log(0.5) + math.log(0.8) + math.log(0.9)) / 3, 0.340550, abs_tol=1e-6)


def test_stems_of_the_published_examples():
    want = "caresses:caress ponies:poni agreed:agre plastered:plaster motoring:motor conflated:conflat troubled:troubl hopping:hop falling:fall hissing:hiss filing:file happy:happi relational:relat conditional:condit digitizer:digit radically:radic vietnamization:vietnam operator:oper feudalism:feudal decisiveness:decis hopefulness:hope formality:formal triplicate:triplic formative:form electrical:electr goodness:good revival:reviv allowance:allow adjustment:adjust adoption:adopt homologous:homolog effective:effect rate:rate cease:ceas controlling:control roll:roll happiness:happi"
    for pair in want.split():
        word, stem = pair.split(":")
        assert X.stem(word) == stem, word


def test_choices_by_stage():
    options = dict(zip("ABCD", ("a red cup", "a blue plate", "a tall tree", "a dog")))
    table = [
        # response, by any form, by stage, any form without content or else the first
        ("The answer is (B).", "B", "B", "B"),
        ("B", "B", "B", "B"),
        ("A. no, then (C)", "C", "A", "C"),
        ("A: x, B. y", "B", "B", "B"),
        ("B. x, A: y", "A", "B", "A"),
        ("(D) first, then (A)", "A", "A", "A"),
        ("we see a dog and a tall tree in it", "C", "C", "A"),
        ("a dog", "No Answer Found", "No Answer Found", "A"),
        ("**C**", "C", "No Answer Found", "C"),
        ("", "API Error", "API Error", "API Error"),
        ("API Error", "API Error", "API Error", "API Error"),
    ]
    for text, one, two, three in table:
        got = (P.choose(text, "ABCD", options), P.choose_staged(text, "ABCD", options), P.choose(text, "ABCD", options, False, "A"))
        assert got == (one, two, three), text


def test_open_answers_are_judged():
    assert P.judge_open("We add. So the total is 1,200 cups", ["1200"])
    assert P.judge_open("x = 3.456", ["3.46"]) and not P.judge_open("x = 3.5", ["3"])
    assert P.judge_open("the animal is a brown dog", ["dog", "cat"]) and not P.judge_open("the animal is a brown dog", ["horse"])
    assert not P.judge_open("it is abc", ["b"]) and P.judge_open("it is b or so", ["b"])
    assert not P.judge_open("", ["x"]) and P.open_answers("") == ["API Error"]


def test_the_nearest_row_must_agree_and_none_falls_back(spark):
    probe = spark.createDataFrame([(1, 0, 10.0, "a"), (2, 0, 20.0, "a")], "id int, k int, t double, obj string")
    build = spark.createDataFrame([(0, 0, 11.0, "b"), (1, 0, 12.0, "a"), (2, 0, 21.0, "a")], "ord int, k int, t double, obj string")
    got = J.nearest_join(probe, build, ["k"], 5.0, ["id"], ["obj"]).collect()
    assert [(r["id"], r["near_ord"]) for r in got] == [(2, 2)]


def test_closeness_is_the_edit_distance_of_whole_texts(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    pairs = [("naïve café", "naive cafe"), ("a" * 70, "a" * 30 + "b" * 50), ("kitten", "sitting"), ("x", "y"), ("same", "same")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.closeness(F.col("a"), F.col("b")).alias("c")).collect()
    for r in got:
        assert r["c"] == pytest.approx(1 - edits(r["a"], r["b"]) / max(len(r["a"]), len(r["b"])))


def test_nearest_rank_with_ties_and_a_heavy_key(spark):
    import random

    rng = random.Random(2)
    rows = [("heavy", float(rng.choice((1, 2, 2, 2, 3)))) for _ in range(700)] + [("wide", rng.random()) for _ in range(900)] + [(None, 5.0), ("one", 7.0), ("none", None)]
    got = {r["k"]: r for r in R.nearest_rank(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", [0, 5, 50, 99, 100]).collect()}
    for key in ("heavy", "wide", None, "one"):
        held = sorted(x for k, x in rows if k == key and x is not None)
        for p in (0, 5, 50, 99, 100):
            assert got[key][f"p{p}"] == held[min(len(held) * p // 100, len(held) - 1)]
    assert "none" not in got


def test_boxes_in_prose_are_scaled_and_repaired(spark):
    text = "see <box>[10, 20.5, 30, 40]</box>, <box>[x]</box> and <box>[]</box>"
    assert value(spark, X.rescale_boxes_udf(F.lit(text), F.lit(0.5))) == "see <box>[5.0, 10.25, 15.0, 20.0]</box>, <box>[x]</box> and <box>[]</box>"
    assert P.repaired_boxes("Here: {'3': [1, 2, 3, 4]") == {"3": [1.0, 2.0, 3.0, 4.0]}
    assert P.repaired_boxes("```json\n[{\"1\": [0, 0, 1, 1]}, {\"2\": [1]}]\n```") == {"1": [0.0, 0.0, 1.0, 1.0]}
    assert P.repaired_boxes("no boxes") == {} and P.repaired_boxes("[oops") == {}
