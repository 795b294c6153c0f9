"""Evidence chains and their composite score over given texts, well formed and not."""

import math

import pytest
from pyspark.sql import functions as F

from kinespark.functions import evidence as E
from kinespark.operators.evidence import _caption, composite

TWO = "Look.\nStep 1: [2.1s–3.4s] Person <bbox>[120,80,220,350]</bbox> picks up\nMotion: goes up\nDescription: Person picks it up\n\nStep 2: (3.4s, 5s) Ball <bbox>[160,50,210,100]</bbox>\nmotion: flips Description: it hits\nthe wall\n\nAnswer: The wall.\nBecause it did."
#: text -> ((start, end, boxes, motion, description) of each step, answer).
CHAINS = {
    TWO: ([(2.1, 3.4, [[120, 80, 220, 350]], "goes up", "Person picks it up"), (3.4, 5.0, [[160, 50, 210, 100]], "flips", "it hits\nthe wall")], "The wall.\nBecause it did."),
    "step 7: no time is given here at all": ([(0.0, 1.0, [], "", "no time is given here at all")], ""),
    "Step 1: [1-2]\nshort\n[a long line in brackets]\nMotion: a long motion line\n a plain long line \nrest of the text": ([(1.0, 2.0, [], "a long motion line", "a plain long line")], ""),
    "Step 1: x\nStep 2: y answer me. Answer: B": ([(0.0, 1.0, [], "", " x\n"), (0.0, 1.0, [], "", " y ")], "me. Answer: B"),
    "Step 1: x answer: one Step 2: y answer: two! Step 3: z": ([(0.0, 1.0, [], "", " x "), (0.0, 1.0, [], "", " y "), (0.0, 1.0, [], "", " z")], "two!"),
    "Step 1: x answer:  \nStep 2: y": ([(0.0, 1.0, [], "", " x "), (0.0, 1.0, [], "", " y")], "Step 2: y"),
    "To begin\n1. first thing is seen, 1s to 2.5s\n 2. second thing [3-4]\nmore of it\n3.\nFinal answer: the cup": ([(0.0, 1.0, [], "", "To begin"), (1.0, 2.5, [], "", "1. first thing is seen, 1s to 2.5s"), (3.0, 4.0, [], "", "2. second thing [3-4]")], "the cup"),
    "nothing of the kind, but the answer is a dog!!": ([(0.0, 1.0, [], "", "nothing of the kind, but the answer is a dog!!")], "is a dog"),
    "1. a answer: no\n2. b": ([(0.0, 1.0, [], "", "1. a answer: no"), (0.0, 1.0, [], "", "2. b")], "no"),
    "": ([(0.0, 1.0, [], "", "")], ""),
    None: ([(0.0, 1.0, [], "", "")], ""),
    "Step 1: Description:   \n\nStep 2: Motion:": ([(0.0, 1.0, [], "", "Description:"), (0.0, 1.0, [], "", " Motion:")], ""),
    "Step 1: " + "é" * 9 + "\n" + "x " * 120: ([(0.0, 1.0, [], "", ("x " * 120).strip())], ""),
    "Step 1: [9–8] <bbox>[5,5,5,9]</bbox> ends before it starts": ([(9.0, 8.0, [[5, 5, 5, 9]], "", "[9–8] <bbox>[5,5,5,9]</bbox> ends before it starts")], ""),
}


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(CHAINS)], "k long, t string")
    c = E.chain(F.col("t"))
    return {r.k: r for r in df.select("k", c.alias("c"), E.valid(c["steps"]).alias("valid"), E.early(c["steps"]).alias("early"), E.final_answer(F.col("t")).alias("final")).collect()}


@pytest.mark.parametrize("k", range(len(CHAINS)))
def test_chains(parsed, k):
    text, (steps, answer) = list(CHAINS.items())[k]
    got = parsed[k].c
    if text and text.startswith("Step 1: [9"):  # a line that begins with a bracket is no description
        steps = [(*steps[0][:4], " " + steps[0][4])]
    if text and text.startswith("Step 1: Description"):
        steps = [(*steps[0][:4], steps[0][4]), steps[1]]
    for have, want in zip(got.steps, steps, strict=True):
        assert (have.start, have.end, have.boxes, have.motion) == want[:4]
        assert have.description.strip() == want[4].strip()
    assert got.answer == answer


def test_validity_order_and_final_answers(parsed):
    at = {t: k for k, t in enumerate(CHAINS)}
    assert parsed[at[TWO]].valid and not parsed[len(CHAINS) - 1].valid
    assert parsed[at[TWO]].final == "The wall.\nBecause it did." and parsed[at[""]].final == ""
    assert parsed[at["step 7: no time is given here at all"]].final == "step 7: no time is given here at all"


def test_steps_that_start_early(spark):
    texts = ["Step 1: [0-5] a Step 2: [4.95-6] b Step 3: [2-3] c Step 4: [1-9] d", "Step 1: [3-4] a Step 2: [4-5] b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(E.early(E.chain(F.col("t"))["steps"])).collect()] == [[3, 4], [], []]


def test_validity_of_boxes(spark):
    forms = {"[1,2,3,4]": True, "[3,2,3,4]": False, "[1,5,3,4]": False, "[0,0,3840,2160]": True, "[0,0,3841,9]": False, "[0,0,9,2161]": False}
    df = spark.createDataFrame([(f"Step 1: <bbox>{b}</bbox> at [1-1]", w) for b, w in forms.items()], "t string, w boolean")
    assert [r for r in df.select("t", "w", E.valid(E.chain(F.col("t"))["steps"]).alias("v")).collect() if r.v != r.w] == []


def test_think_predict(spark):
    text = "Step 1: [0.5s] a man walks\n Think: (100,200),(300,400)\n Predict: (110,210),(310,410) Predict: (1,2),(3,4)\n Motion: to the left \nStep  2: [soon] \tno boxes here\nstep 3: [2s] only thought\nThink: (0,0),(1000,1000)"
    got = spark.createDataFrame([(text,), ("Step 1: none",), (None,)], "t string").select(E.think_predict(F.col("t")).alias("c"), E.steps(F.col("t")).alias("s")).collect()
    first = got[0].c
    assert [(s.step, s.time, s.description, s.motion) for s in first] == [(1, 0.5, "a man walks", "to the left"), (2, None, "no boxes here", ""), (3, 2.0, "only thought", "")]
    assert first[0].predict == [[0.11, 0.21, 0.31, 0.41], [0.001, 0.002, 0.003, 0.004]] and first[2].think == [[0.0, 0.0, 1.0, 1.0]]
    assert [(s.start, s.end, len(s.boxes)) for s in got[0].s] == [(0.5, 1.5, 2), (2.0, 3.0, 1)]
    assert got[1].c == [] and len(got[1].s) == 1 and got[2].c == []


GOLD = "array<struct<t_s: double, t_e: double, bbox: array<double>, displacements: array<array<double>>, caption: string>>"


def test_composite(spark):
    text = "Step 1: [0-2] <bbox>[0,0,10,10]</bbox> <bbox>[3,4,13,14]</bbox>\nDescription: a cup falls Step 2: [5-6] <bbox>[0,0,10,10]</bbox>"
    gold = [(1.0, 2.0, [5.0, 0.0, 15.0, 10.0], [[6.0, 8.0]], "a cup"), (None, None, None, [[1.0, 1.0]], ""), (0.0, 1.0, [0.0, 0.0, 1.0, 1.0], None, "x")]
    rows = [(0, text, gold), (1, text, []), (2, text, None), (3, None, gold[:1]), (4, "Step 1: <bbox>[0,0,10,10]</bbox> <bbox>[0,0,10,10]</bbox> <bbox>[900,0,910,10]</bbox> long enough", [(0.0, 1.0, [0.0, 0.0, 10.0, 10.0], [[0.0, 0.0]], "long enough")])]
    df = spark.createDataFrame(rows, f"k long, t string, g {GOLD}")
    got = {r.k: r for r in composite(df, "t", "g").collect()}
    first = got[0]
    second = " [5-6] <bbox>[0,0,10,10]</bbox>"
    assert first.spatial == pytest.approx(50 / 150) and first.temporal == pytest.approx((0.5 + 0) / 2)
    assert first.motion == pytest.approx(0.4 + 0.4 * 0.5 + 0.2)
    assert first.caption == pytest.approx((0.6 * 2 * 2 / 5 + 0.4 * (1 - 6 / 11)) / 2), second
    assert first.score == pytest.approx(0.25 * first.spatial + 0.15 * first.temporal + 0.35 * first.motion + 0.2 * first.caption)
    assert got[1].score == got[2].score == 0
    assert (got[3].spatial, got[3].temporal, got[3].motion) == (0, 0, 0)
    # A still gold against a still first move and a jump: the one pair is alike, half the moves are jumps.
    assert got[4].motion == pytest.approx(0.4 * 0 + 0.4 * 1 + 0.2 * 0.5) and got[4].temporal == 1 and math.isclose(got[4].spatial, 1)


def test_final_answer_reads_no_steps(spark):
    found = repr(E.final_answer(F.col("t")))
    assert "box_start" not in found and "Motion" not in found and "nswer" in found


def test_patterns_stand_once_in_a_chain_and_its_score(spark):
    t = F.col("t")
    chain = repr(E.chain(t))
    assert "final" not in repr(E.chain_steps(t)) and chain.count("final") == 1
    z = F.struct(F.struct(F.lit("a line moves").alias("description")).alias("p"), F.struct(F.lit("a line").alias("caption")).alias("g"))
    assert repr(_caption(z)).count("(?U)") == 2
