"""Rows that share ids, clashing names, ties, empty and very long texts: one matrix for the operators on documents."""

import random

import pytest
from pyspark.sql import functions as F

from kinespark.llm import common, decontaminate, licences, mixing, passages, pii, quality, secrets, simhash, tokens

CLASH = ["_key", "_row", "mark", "kept", "n_words", "_lines", "h", "at", "doc", "first", "digest", "item_id", "taken", "_number", "size", "spans"]


def bench(spark):
    return spark.createDataFrame([(1, "a benchmark item of some words that no document here holds at all")], "item_id long, text string")


OPERATORS = {
    "mix": mixing.mix,
    "blend": mixing.blend,
    "repeats": passages.repeats,
    "pii": pii.scan,
    "licences": licences.scan,
    "secrets": secrets.scan,
    "redact": secrets.redact,
    "classes": simhash.classes,
    "dedup": simhash.dedup,
    "tokens": tokens.count,
    "matches": lambda df: decontaminate.matches(df, bench(df.sparkSession)),
    "clean": lambda df: decontaminate.clean(df, bench(df.sparkSession)),
    "measure": quality.measure,
    "rules": quality.clean,
}


def documents(spark):
    rng = random.Random(51)
    text = " ".join(f"w{rng.getrandbits(30)}" for _ in range(80))
    rows = [(1, text, "a"), (1, text, "a"), (2, text, "a"), (3, None, "a"), (4, "", None), (5, " \n\t\n", "b"), (None, text, "b"), (None, None, None)]
    rows += [(6, "long " * 250_000, "c"), (7, "x" * 1_000_000, "c"), (8, "9" * 6000 + ".1.1.1", "c"), (9, "\n" * 100_000, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names_change_nothing_and_empty_tables_give_none(spark, name):
    plain, run = documents(spark), OPERATORS[name]
    wide = plain
    for c in CLASH:
        wide = wide.withColumn(c, F.lit("clash"))
    got, out = run(plain), run(wide)
    columns = got.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, out.select(*columns).collect()), key=str)
    if name in ("redact", "dedup", "clean", "rules"):
        assert out.columns == wide.columns
    assert run(wide.limit(0)).count() == 0


def test_rows_that_share_an_id_are_kept_by_their_texts(spark):
    one, two = [" ".join(f"{c}{k}" for k in range(60)) for c in "pq"]
    df = spark.createDataFrame([(1, one), (1, two), (1, one), (2, two), (3, one + " x"), (None, None), (None, "z y x")], "doc_id long, text string")
    got = sorted(map(tuple, simhash.dedup(df).collect()), key=str)
    assert [(k, t) for k, t in got if t in (one, two)] == sorted([(1, one), (1, two)])
    assert (None, None) in got and (None, "z y x") in got


def test_blend_returns_each_text_with_its_words(spark):
    df = documents(spark).withColumn("lang", F.lit("en")).withColumn("taken", F.lit("clash"))
    got, want = mixing.blend(df), mixing.mix(df)
    assert got.columns == ["doc_id", "text", "source", "lang", "size", "source_size", "target", "taken"]
    key = ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, got.select(*key).collect()), key=str) == sorted(map(tuple, want.select(*key).collect()), key=str)


def test_a_cluster_must_name_its_shared_folder():
    class Session:
        class conf:
            held = {"spark.master": "spark://host:7077"}
            get = staticmethod(lambda k, d=None: Session.conf.held.get(k, d))

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session)
    Session.conf.held["spark.checkpoint.dir"] = "s3://shared/folder/"
    assert common.shared_dir(Session) == "s3://shared/folder"
