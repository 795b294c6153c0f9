"""Arrays in byte ranges, archives, listings, metrics of a run and distributed row numbers, on files and rows made here."""

import io
import json
import random
import tarfile
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark.operators import ordering
from kinespark.operators.metrics import Metrics
from kinespark.sources import archives, arrays
from kinespark.sources import listing as L


def values(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([None, True, -1.5, 10**12])
    if kind < 4:
        return "".join(rng.choice(['"', "\\", "[", "]", "{", "}", ",", "é", "a", "\n", "\\\\", '\\"']) for _ in range(rng.randrange(9)))
    if kind == 4:
        return [values(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"{values(rng, 9)}" if rng.random() < 0.5 else "k": values(rng, depth + 1) for _ in range(rng.randrange(4))} if kind == 5 else {}


@pytest.mark.parametrize("split", [1, 3, 7, 64, 10**6])
@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_give_what_json_gives(split, indent, tmp_path):
    rng = random.Random(split)
    data = [values(rng) for _ in range(60)]
    raw = np.frombuffer(json.dumps(data, indent=indent, ensure_ascii=False).encode(), "u1")
    state, got = (0, 0, 0), []
    for start in range(0, len(raw), split):
        blocks = lambda at=start: (raw[k : k + 5] for k in range(at, len(raw), 5))
        got += arrays.records(blocks(), split, *state)
        ends = arrays.summary(raw[k : min(k + 5, start + split)] for k in range(start, min(len(raw), start + split), 5))
        quoted, escaped, depth = ends[arrays.STATES.index(state[:2])]
        state = (quoted, escaped, state[2] + depth)
    assert [json.loads(x) for x in got if x.strip()] == data and state == (0, 0, 0)


def test_array_files_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(2)
    data = [{"k": k, "s": "".join(rng.choice('ab"\\[]{},\n é') for _ in range(30)), "v": rng.choice([None, 1.5, -2.0])} for k in range(3000)]
    odd = [None, 3, "x", [1, 2]]
    (tmp_path / "one.json").write_text(json.dumps(data[:2500] + odd, ensure_ascii=False))  # a single line
    (tmp_path / "two.json").write_text("\ufeff \n" + json.dumps(data[2500:], indent=2))
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "blank.json").write_text(" \n")
    (tmp_path / "object.json").write_text('{"k": [1, {"k": 2}, 3]}')
    (tmp_path / "_hidden.json").write_text('[{"k": -1}]')
    held = arrays.load_array(spark, str(tmp_path), "k long, s string, v double", split=5000)
    assert held.rdd.getNumPartitions() > 20
    assert sorted((r.k, r.s, r.v) for r in held.collect()) == [(r["k"], r["s"], r["v"]) for r in data]
    assert sorted(r.value for r in arrays.elements(spark, str(tmp_path / "one.json"), 999).collect() if not r.value.startswith("{")) == ['"x"', "3", "[1, 2]", "null"]
    assert arrays.elements(spark, str(tmp_path / "none.json")).count() == 0


def test_a_broken_array_is_read_to_its_end(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"k": 1}, , {"k": 2}, {"k": 3, "s": "no en')
    assert [r.value for r in arrays.elements(spark, str(tmp_path), 4).collect()] == ['{"k": 1}', '{"k": 2}', '{"k": 3, "s": "no en']


def test_written_arrays_are_json(spark, tmp_path):
    df = spark.range(0, 50, 1, 4).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit('a\n"['), F.col("id").cast("string"))).alias("s"))
    for indent in (True, False):
        arrays.dump_array(df, str(tmp_path / str(indent)), indent)
        held = [x.read_text() for x in (tmp_path / str(indent)).glob("part-*") if x.stat().st_size]
        assert sorted((r["id"], r["s"]) for x in held for r in json.loads(x)) == sorted(map(tuple, df.collect()))
        assert not indent or all(x.startswith('[\n  {\n    "id"') for x in held)
    arrays.dump_array(df.limit(0), str(tmp_path / "empty"))
    assert arrays.elements(spark, str(tmp_path / "empty")).count() == 0


def test_a_large_array_is_scanned_in_linear_time():
    block = np.frombuffer((b'{"a": "' + b"\\\\" * 50 + b'"},') * 20_000, "u1")
    began = time.time()
    arrays.summary(iter([block]))
    assert time.time() - began < 5


def archive(kind, rows):
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("folder/", b"")
            for name, data in rows:
                z.writestr(name, data)
    else:
        with tarfile.open(fileobj=out, mode="w:gz" if kind != "tar" else "w") as t:
            folder = tarfile.TarInfo("folder")
            folder.type = tarfile.DIRTYPE
            t.addfile(folder)
            for name, data in rows:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_members_of_nested_and_broken_archives(spark, tmp_path):
    rng = random.Random(6)
    rows = [("a/x.mp4", rng.randbytes(2500)), ("b/é.txt", b""), ("a/x.mp4", b"again"), ("c", rng.randbytes(100_000))]
    want = {}
    for place, end in (("", "zip"), ("deep/er", "tar.gz"), ("deep", "tar"), ("deep", "TGZ")):
        (tmp_path / place).mkdir(parents=True, exist_ok=True)
        path = tmp_path / place / f"held.{end}"
        path.write_bytes(archive(end.lower(), rows))
        want[str(path)] = rows
    (tmp_path / "plain.txt").write_bytes(b"x")
    (tmp_path / "bad.zip").write_bytes(b"no zip")
    (tmp_path / "cut.tar.gz").write_bytes(archive("tar.gz", rows)[:40_000])
    got = archives.members(spark, str(tmp_path), piece=1000).collect()
    held, errors = {}, {}
    for r in sorted(got, key=lambda r: (r.archive, r.place, r.piece or 0)):
        path = r.archive.removeprefix("file:")
        if r.error:
            errors[path] = r.error
            continue
        assert len(r.bytes) <= 1000
        name, data = held.setdefault((path, r.place), (r.member, b""))
        held[path, r.place] = (name, data + r.bytes)
    for path, rows in want.items():
        assert [held[path, k] for k in range(len(rows))] == rows
    assert set(errors) == {str(tmp_path / "bad.zip"), str(tmp_path / "cut.tar.gz")}
    assert held[str(tmp_path / "cut.tar.gz"), 0] == rows[0]  # what comes before the break
    assert archives.members(spark, str(tmp_path / "absent")).count() == 0


@pytest.mark.parametrize("kind", ["zip", "tar", "tar.gz"])
def test_archives_that_are_written_are_read(spark, tmp_path, kind):
    df = spark.range(0, 40, 1, 4).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("member"), F.repeat(F.lit("ab"), F.col("id").cast("int") * 9).cast("binary").alias("bytes"))
    root = f"file://{tmp_path}/out"
    archives.dump_archives(df, root, kind)
    got = archives.members(spark, root).select("member", "bytes", "error").collect()
    assert sorted((r.member, bytes(r.bytes)) for r in got) == sorted((r.member, bytes(r.bytes)) for r in df.collect())
    assert archives.archives(spark, root).count() == 4


def test_listing_find_and_census(spark, tmp_path):
    for name in ("v/gqa/1.mp4", "v/gqa/sub/2.mp4", "v/stgr/2.mp4", "v/stgr/3.txt", "v/2.mp4x", "json/a.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    listed = L.listing(spark, str(tmp_path), ".mp4")
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    wanted = spark.createDataFrame([("1",), ("2",), ("9",), (None,)], "vid string")
    found = {r.vid: r.found for r in L.find(listed, wanted, "vid", F.concat("vid", F.lit(".mp4"))).collect()}
    assert {k: v and v.split(f"{tmp_path}/")[1] for k, v in found.items()} == {"1": "v/gqa/1.mp4", "2": "v/gqa/sub/2.mp4", "9": None, None: None}
    folders = spark.createDataFrame([(f"{tmp_path}/{x}",) for x in ("v", "v/gqa", "v/gqa/", "v/stgr", "json", "none")], "folder string")
    counts = {r.folder.removeprefix(f"{tmp_path}/"): (r.n_files, r.n_bytes, r.present) for r in L.census(listed, folders).collect()}
    assert counts == {"v": (3, 9, True), "v/gqa": (2, 6, True), "v/gqa/": (2, 6, True), "v/stgr": (1, 3, True), "json": (0, 0, False), "none": (0, 0, False)}
    every = L.listing(spark, str(tmp_path))
    assert [tuple(r) for n in (["1.mp4", "a.json"], ["1.mp4", "b.json"]) for r in L.complete(every, n).collect()] == [(0, True), (1, False)]
    assert L.listing(spark, str(tmp_path / "absent")).count() == 0


def test_metrics_are_measured_beside_the_run_and_begin_anew(spark, tmp_path):
    metrics = Metrics()
    for k in (10, 20):
        metrics.through(spark.range(k), rows=F.count(F.lit(1)), mean=F.avg("id"), none=F.avg(F.when(F.col("id") < 0, 1.0))).write.parquet(str(tmp_path / str(k)))
    assert metrics.emit() == {"rows": 15.0, "mean": 7.0}
    assert metrics.emit() == {}
    metrics.through(spark.range(0), rows=F.count(F.lit(1)), mean=F.avg("id")).collect()
    assert metrics.emit() == {"rows": 0.0}


@pytest.mark.parametrize("rows", [0, 1, 5, 100])
def test_numbers_and_chunks(spark, rows):
    rng = random.Random(rows)
    data = [(rng.choice([None, *range(20)]), k, "clash") for k in range(rows)]
    df = spark.createDataFrame(data, "v int, k long, chunk string").repartition(7)
    held = ordering.numbered(df, [F.col("v").desc(), F.col("k").asc()], partitions=5)
    want = sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    got = {r.number: (r.v, r.k) for r in held.collect()}
    assert got == {k + 1: x[:2] for k, x in enumerate(want)}
    for rule in ("remainder", "ceil", "floor"):
        chunk = {r.number: r.part for r in ordering.chunked(held, 4, rule, "part").collect()}
        sizes = {"remainder": [rows // 4 + (k < rows % 4) for k in range(4)], "ceil": [max(0, min(-(-rows // 4), rows - k * -(-rows // 4))) for k in range(4)], "floor": [rows // 4] * 3 + [rows - 3 * (rows // 4)]}[rule]
        if rule == "floor" and rows < 4:
            continue  # all but the last are empty, in any numbering
        assert [chunk[k + 1] for k in range(rows)] == [c for c, n in enumerate(sizes) for _ in range(n)]


def test_rows_are_numbered_as_they_are_read(spark):
    df = spark.range(0, 1000, 1, 9)
    assert ordering.numbered(df, []).filter("number != id + 1").count() == 0
