"""Messages and checks of rows that are odd: unknown tasks and subjects, nulls, malformed tags."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kinespark.functions import prompts as M

SYSTEMS = {t: t.upper() for t in M.ALL_TASKS}


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize("task", ["", "visual qa", None])
def test_unknown_tasks_and_subjects_are_errors(spark, task):
    for column in (M.conversation(F.col("t").cast("string"), F.lit("q"), SYSTEMS), M.domain(F.col("t").cast("string"))):
        with pytest.raises(PySparkException, match="unknown"):
            one(spark, column, t=task)


def test_paths_below_roots(spark):
    roots = dict.fromkeys(M.TASKS, "/r/")
    made = lambda path, source="s": M.training_messages(F.lit(M.TRACKED_TASK), F.lit(source), F.lit(path), F.lit("q"), F.lit("t"), F.lit("a"), SYSTEMS, roots, {"p": "/own"})
    got = [one(spark, made(*x))[1].content[0].value for x in (("a/b.mp4",), ("/abs.mp4",), ("c", "p"))]
    assert got == ["/r/a/b.mp4", "/abs.mp4", "/own/c"]
    held = one(spark, made("x"))
    assert [m.role for m in held] == ["system", "user", "assistant"] and held[1].content[1].value == "q" and held[2].content[0].value == "<think>t</think>\n<answer>a</answer>"


def test_checklists_of_nothing(spark):
    assert not any(one(spark, M.checklist(F.lit(None).cast("string"))))


def test_shown_steps_of_odd_texts(spark):
    text = "a  b<t>x</t>c <t>3</t> <motion obj=\"p\" dir=\"N\"/> d<obj>o</obj><box>[1.5]</box>at<t>1</t>s"
    got = [(s.kind, s.text, s.box, s.time) for s in one(spark, M.shown_steps(F.col("t")), t=text)]
    assert got == [
        ("word", "a", None, None), ("word", "b", None, None), ("word", "<t>x</t>", None, None), ("word", "c", None, None), ("moment", "<t>3</t>", None, 3.0),
        ("word", "<motion", None, None), ("word", 'obj="p"', None, None), ("word", 'dir="N"/>', None, None), ("word", "d", None, None), ("sighting", "<obj>o</obj><box>[1.5]</box>at<t>1</t>s", [1.5], 1.0),
    ]
    assert one(spark, M.shown_steps(F.lit(None).cast("string"))) == []


def test_templates_and_seconds(spark):
    assert one(spark, M.filled("{a} {b} {c}", a=F.lit(1), b=F.lit(None).cast("string"))) == "1  {c}"
    assert one(spark, M.whole_seconds(F.lit(0.5), F.lit(0.7))) == [] and one(spark, M.whole_seconds(F.lit(1.0), F.lit(2.9))) == [1, 2]
