"""The grounded roll-up over items given here."""

import math

import pytest
from pyspark.sql import functions as F

from kinespark.operators import grounding as N

SCHEMA = "item long, score int, timestamps array<double>, bboxes array<struct<timestamp: int, xmin: double, ymin: double, xmax: double, ymax: double>>, frame_count long, fps double, domain string, " + ", ".join(f"answer_temporal{c} array<double>, answer_temporal_pre{c} string, answer_spatial{c} map<string, array<double>>" for c in N.CHAINS)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("from 01:05 to 2:00", [65.0, 120.0]),
        ("<answer> 3.5 to 7 </answer> and 9", [3.5, 7.0]),
        ("<answer>1\n2</answer>", [1.0, 2.0]),
        ("5s to 9s", []),
        ("1, 2, 3", []),
        ("1:02 to 11:02", []),  # the first clock is replaced within the second, too
        ("", []),
        (None, []),
    ],
)
def test_stated_intervals(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(N.stated_interval(F.col("t"))).first()[0] == want


@pytest.fixture(scope="module")
def items(spark):
    gold = [(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 0.0, 10.0, 10.0)]
    right = {"1": [0.0, 0.0, 10.0, 10.0], "2": [0.0, 0.0, 10.0, 5.0]}
    rows = [
        (1, 3, [0.0, 10.0], gold, 300, 10.0, "a", [0.0, 10.0], "", right, [], "0 5", {"1": [0.0, 0.0]}),
        (2, -1, [0.0, 10.0], gold, 900, 10.0, "a", None, "0 10", None, [5.0, 25.0], "", {}),
        (3, 2, [0.0, 10.0], [], 900, 10.0, None, [10.0, 10.0], "", right, [1.0], "", right),
        (4, None, [0.0, 10.0], gold, 9000, 10.0, "b", [0.0, 10.0], "", right, [0.0, 10.0], "", right),
    ]
    return N.measured(spark.createDataFrame(rows, SCHEMA))


def test_items(items):
    got = {r.item: r for r in items.collect()}
    assert (got[1].tiou, got[1].miou, got[1].aps, got[1].bits) == (1.0, 0.75, [1.0, 1.0, 1.0, 0.5, 0.5], 7)
    assert (got[1].tiou_2, got[1].miou_2, got[1].bits_2) == (0.5, 0.0, 3)
    assert (got[2].tiou, got[2].miou, got[2].tiou_2, got[2].bits_2) == (0.0, 0.0, 0.2, 0)
    assert (got[3].miou, got[3].aps, got[3].bits) == (0.0, [0.0] * 5, 1) and got[4].bits is None
    assert [got[k].duration for k in (1, 2, 4)] == ["Short", "Medium", "Long"]


def test_statistics(items):
    got = {(r.dimension, r.value): r for r in N.statistics(items).collect()}
    assert set(got) == {("overall", None), ("duration", "Short"), ("duration", "Medium"), ("domain", "a"), ("domain", "unknown")}
    every, a = got["overall", None], got["domain", "a"]
    assert (every["items"], every.answered, every.accuracy, every.all_score, every.valid_score) == (4, 3, 0.5, pytest.approx(5 / 3), 2.5)
    assert (a.accuracy, a.r1_30, a.r1_30_2, a.tiou, a.miou, a.ap_50, a.ap_70) == (0.5, 0.5, 0.5, 0.5, 0.375, 0.5, 0.25)
    assert (every.vqa_temp, every.vqa_temp_spat, every.vqa_temp_2, every.temp_spat_2) == (0.25, 0.25, 0.25, 0.0)
    assert a.am == pytest.approx((0.5 + 0.5 + 0.375) / 3) and a.lgm == pytest.approx(-(2 * math.log(0.5) + math.log(0.625)) / 3)
    assert a.mam == pytest.approx((a.am + a.am_2) / 2) and got["duration", "Short"].lgm is None


def test_items_that_meet_conditions(items):
    got = sorted(map(tuple, N.meeting(items, "item").collect()))
    assert got == [(1, "temp_spat", 1), (1, "vqa_spat", 1), (1, "vqa_temp", 1), (1, "vqa_temp_spat", 1), (2, "vqa_temp", 1)]


def test_no_items(items):
    assert N.statistics(items.limit(0)).count() == 0


def test_shares_read_their_values_once(spark):
    share = N._share(F.col("v"), 0.3)
    assert repr(share).count(">=") == 1
    rows = [([0.3, 0.2, 0.9],), ([],), ([0.1],)]
    assert [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(share).collect()] == [2 / 3, 0.0, 0.0]
