"""Archives (zip, tar, tar.gz) as rows of their members, and rows as archives.

Archives are found by a recursive listing that reads no contents. Each is opened by one task, which gives its members in
order as pieces of up to `piece` bytes, so that neither an archive nor a member need fit into memory.

Defined results: folders and links are left out; an empty member has one empty piece; an archive that can't be opened or breaks off gives the
pieces before that, then one row with its error and neither member nor bytes; members that share a name keep their place;
a folder without archives gives no rows.
"""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .listing import listing
from .stores import opened

PIECE = 1 << 20
#: Endings by kind; the first that fits counts.
KINDS = {".zip": "zip", ".tar.gz": "tar.gz", ".tgz": "tar.gz", ".tar": "tar"}
SCHEMA = "archive string, place int, member string, piece int, bytes binary, error string"


def _members(f, kind: str) -> Iterator[tuple[str, object]]:
    if kind == "zip":
        with zipfile.ZipFile(f) as held:
            for info in held.infolist():
                if not info.is_dir():
                    with held.open(info) as member:
                        yield info.filename, member
    else:
        with tarfile.open(fileobj=f, mode="r|gz" if kind == "tar.gz" else "r|") as held:
            for info in held:
                if info.isfile():
                    yield info.name, held.extractfile(info)


def _pieces(path: str, kind: str, piece: int) -> Iterator[tuple]:
    store, within = opened(path)
    place = 0
    try:
        with store.open_input_file(within) as f:
            for place, (name, member) in enumerate(_members(f, kind)):
                number, data = 0, member.read(piece)
                while data or not number:
                    yield path, place, name, number, data, None
                    number, data = number + 1, member.read(piece) if data else b""
    except (OSError, EOFError, ValueError, tarfile.TarError, zipfile.BadZipFile, zipfile.zlib.error, NotImplementedError, RuntimeError) as e:  # broken, encrypted or unknown compression
        yield path, place, None, None, None, f"{type(e).__name__}: {e}"


def _expand(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for path, kind in zip(batch.column("path").to_pylist(), batch.column("kind").to_pylist()):
                held, size = [], 0
                for row in _pieces(path, kind, piece):
                    held.append(row)
                    size += len(row[4] or b"") + 100
                    if size >= piece:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), types)], names)

    return run


def archives(spark: SparkSession, root: str) -> DataFrame:
    """The listing of archives below a folder, with their kind."""
    low = F.lower("name")
    kind = F.coalesce(*[F.when(low.endswith(end), k) for end, k in KINDS.items()])
    return listing(spark, root).withColumn("kind", kind).filter(F.col("kind").isNotNull())


def members(spark: SparkSession, root: str, piece: int = PIECE) -> DataFrame:
    """Each archive's members in pieces, as SCHEMA says; the listing is dealt out first, so that archives are read side by side."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives(spark, root).select("path", "kind").repartition(parts, "path").mapInArrow(_expand(piece), SCHEMA)


def dump_archives(df: DataFrame, path: str, kind: str) -> None:
    """Writes (member, bytes) rows as one archive a partition. A task that is run again writes a file of its own; only the
    archives that the job reports stay, the rest is deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = f"part-{uuid.uuid4().hex}.{kind}", None
        store, within = opened(path)
        rows = ((n, b) for batch in batches for n, b in zip(batch.column("member").to_pylist(), batch.column("bytes").to_pylist()))
        for member, data in rows:
            if held is None:
                store.create_dir(within, recursive=True)
                out = store.open_output_stream(f"{within}/{name}", compression=None)
                held = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) if kind == "zip" else tarfile.open(fileobj=out, mode="w|gz" if kind == "tar.gz" else "w|")
            if kind == "zip":
                held.writestr(member, data)
            else:
                info = tarfile.TarInfo(member)
                info.size = len(data)
                held.addfile(info, io.BytesIO(data))
        if held is not None:
            held.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    done = {r["name"] for r in df.select("member", "bytes").mapInArrow(run, "name string").collect()}  # one row a partition
    store, within = opened(path)
    from pyarrow import fs

    for x in store.get_file_info(fs.FileSelector(within, allow_not_found=True)):
        if x.base_name.startswith("part-") and x.base_name not in done:
            store.delete_file(x.path)
