"""Arrays, archives, listings, row numbers and metrics of a run (S01, S02, S16, S17, S19, S22, K01, K07, L12 of the survey).

Each query writes what it reads from the tables, by partition, and reads it back."""

from pyspark.sql import functions as F

from kinespark.operators import ordering
from kinespark.operators.metrics import Metrics
from kinespark.sources import archives, arrays
from kinespark.sources import listing as L
from kinespark.sources.shared import shared_path
from kinespark.sources.tables import table

from .registry import query


@query("S01_S02_K01_json_array", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def s01(spark, d):
    path = shared_path(spark, "array")
    arrays.dump_array(table(spark, d, "documents"), path)
    return arrays.load_array(spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint", split=1 << 20)


def _texts(spark, d):
    # Members of nested folders, of the ids' names; empty texts are members, too.
    name = F.concat_ws("/", "lang", F.coalesce("source", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return table(spark, d, "documents").select(name.alias("member"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"), "lang")


@query("S16_archive_members", "SELECT lang || '/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS member, md5(coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents")
def s16(spark, d):
    root, held = shared_path(spark, "archives"), _texts(spark, d)
    kinds = {"zip": F.col("lang") == "en", "tar.gz": F.col("lang") == "de", "tar": ~F.coalesce(F.col("lang").isin("en", "de"), F.lit(False))}
    for kind, fits in kinds.items():
        archives.dump_archives(held.filter(fits), f"{root}/{kind.replace('.', '-')}/deep", kind)
    whole = archives.members(spark, root, piece=1 << 20).filter(F.col("error").isNull())
    # A member's pieces are in order of their number; a text here has few.
    whole = whole.groupBy("archive", "place", "member").agg(F.sort_array(F.collect_list(F.struct("piece", "bytes"))).alias("p"))
    text = F.aggregate("p", F.lit("").cast("binary"), lambda a, x: F.concat(a, x["bytes"]))
    return whole.select("member", F.md5(text).alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"))


def _tree(spark, d):
    root = shared_path(spark, "tree")
    table(spark, d, "documents").select("doc_id", "lang", "source").write.partitionBy("lang", "source").json(root)
    return root


@query("S17_S19_S22_file_census", "SELECT lang AS folder, 1 AS present FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL) UNION ALL SELECT 'xx', 0")
def s17(spark, d):
    root = _tree(spark, d)
    listed = L.listing(spark, root, ".json")
    base = root.removeprefix("file://")
    wanted = table(spark, d, "documents").filter("lang is not null").select("lang").distinct().union(spark.createDataFrame([("xx",)], "lang string"))
    held = L.census(listed, wanted.withColumn("path", F.concat(F.lit(f"{base}/lang="), "lang")), "path")
    return held.select(F.col("lang").alias("folder"), F.col("present").cast("int").alias("present"))


@query("S19_find_by_name", "SELECT item_id, item_id % 3 < 2 AS found FROM benchmark")
def s19(spark, d):
    root = shared_path(spark, "find")
    items = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 3).alias("third"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    name = F.concat(F.col("item_id").cast("string"), F.lit(".mp4"))
    _write_files(items.filter("third < 2").select(F.concat(F.lit("a/b"), F.col("third").cast("string"), F.lit("/"), name).alias("member"), "bytes"), root)
    found = L.find(L.listing(spark, root, ".mp4"), items.select("item_id"), "item_id", name)
    ends = F.col("found").endswith(F.concat(F.lit("/"), name))
    return found.select("item_id", F.coalesce(ends, F.lit(False)).alias("found"))


def _write_files(df, root):
    """Each row as a file of its own."""

    def run(batches):
        from kinespark.sources.stores import opened

        for batch in batches:
            for member, data in zip(batch.column("member").to_pylist(), batch.column("bytes").to_pylist()):
                store, path = opened(f"{root}/{member}")
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path, compression=None) as out:
                    out.write(data)
            yield batch.select(["member"])

    df.mapInArrow(run, "member string").count()


@query("K07_observed_metrics", "SELECT 'mean' AS metric, round(avg(l_discount * 10), 6) AS value FROM lineitem UNION ALL SELECT 'positive', count(*) FILTER (l_discount > 0)::DOUBLE FROM lineitem UNION ALL SELECT 'rows', count(*)::DOUBLE FROM lineitem")
def k07(spark, d):
    metrics, reward = Metrics(), F.col("l_discount") * 10
    main = metrics.through(table(spark, d, "lineitem"), rows=F.count(F.lit(1)), mean=F.avg(reward), positive=F.count_if(reward > 0))
    main.write.parquet(shared_path(spark, "run"))  # the run that is measured
    return metrics.frame(spark).withColumn("value", F.round("value", 6))


_SIZES = "n AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)"


@query("L12_contiguous_chunks", f"WITH {_SIZES} SELECT k, i + 1 AS number, CAST(CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS even, CAST(i // CAST(ceil(n / 7.0) AS BIGINT) AS INTEGER) AS ceiling, CAST(least(6, i // (n // 7)) AS INTEGER) AS floored FROM n")
def l12(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    out = ordering.numbered(df, [F.col("o_totalprice").desc(), F.col("k").asc()])
    for rule, name in (("remainder", "even"), ("ceil", "ceiling"), ("floor", "floored")):
        out = ordering.chunked(out, 7, rule, name)
    return out.select("k", "number", "even", "ceiling", "floored")
