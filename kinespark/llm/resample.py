"""Importance resampling towards a target distribution, over hashed word features.

Every text's UTF-8 bytes are classified by a lookup table, words start and end where the class changes, and the CRC-32
of all features of a slice advance together, one byte a step (`automaton`). Counts of the features' buckets over the
corpus and over the target give each bucket's gain, floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))); a
document's weight is the sum of its features' gains. A seeded Gumbel deviate of its id is added, and the highest scores
are drawn, which is sampling without replacement in proportion to exp(weight / 1000).

Defined results: words are runs of digits, letters a to z (A-Z lower-cased) and bytes above 0x7F; a null or empty text
has no feature, weight 0 and is never drawn unless `least` is 0; equal scores go to the smaller doc_id, null first, and
then to fewer features; a null doc_id draws as the empty id; repeated rows count and draw one by one;
very long texts and words are read whole; an empty corpus gives an empty result, an empty target counts 0 everywhere;
columns beyond doc_id and text are ignored.

Scale: texts are read twice and never shuffled. Each task sends the bucket counts of its rows, at most `buckets` rows, to
one combined sum; only the table of `buckets` gains (a parameter, 80 KB) goes through the driver and to the tasks. Scores are
five longs a document; they are sorted by range and numbered by the counts of their partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.operators.ordering import numbered

from .common import cut

BUCKETS, RUN, LEAST, PERCENT, SEED = 10000, 1, 20, 10, 2024


def _word_bytes():
    import numpy as np

    lut = np.zeros(256, bool)
    lut[48:58] = lut[97:123] = lut[128:] = True
    return lut


def _features(texts: pa.Array, buckets: int, run: int) -> Iterator[tuple]:
    """(first row, last row + 1, words a row, features a row, buckets of the features in order of their rows)."""
    import numpy as np

    from . import automaton as A

    inside = A.lower_case(_word_bytes())
    for row, last, offsets, data in A.slices(texts):
        starts, ends = A.runs(inside[data], offsets)
        data = A.LOWER[data]
        first = np.searchsorted(starts, offsets)  # of each text, its first word
        words = np.diff(first)
        owner = np.repeat(np.arange(last - row), words)
        left = first[1:][owner] - np.arange(len(starts))  # words from here to the text's end
        state, found, owners = np.full(len(starts), 0xFFFFFFFF, "u4"), [], []
        at = np.arange(len(starts))
        for k in range(run):
            at = at[left[at] > k]
            if k:  # one space, then the next word
                state[at] = A.TABLE[(state[at] ^ 32) & 255] ^ (state[at] >> 8)
            state[at] = A.advance(state[at], data, starts[at + k], ends[at + k])
            found.append((state[at] ^ 0xFFFFFFFF) % np.uint32(buckets))
            owners.append(owner[at])
        found, owners = np.concatenate(found), np.concatenate(owners)
        if run > 1:
            order = np.argsort(owners, kind="stable")
            found, owners = found[order], owners[order]
        yield row, last, words, np.bincount(owners, minlength=last - row), found


def counts(docs: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """(bucket, n): occurrences of features, over all texts; buckets without any are left out."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        held = np.zeros(buckets, "i8")
        for batch in batches:
            for *_, found in _features(batch.column(0), buckets, run):
                held += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["bucket", "n"])

    each = docs.select("text").mapInArrow(tally, "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> list[int]:
    """The gain of each bucket, from the counts of both tables."""
    s, t = counts(docs, buckets, run).withColumnRenamed("n", "s"), counts(target, buckets, run).withColumnRenamed("n", "t")
    held = {r["bucket"]: (r["s"] or 0, r["t"] or 0) for r in s.join(t, "bucket", "full").collect()}  # at most `buckets` rows
    both = [held.get(k, (0, 0)) for k in range(buckets)]
    all_s, all_t = (float(sum(x[k] for x in both)) for k in (0, 1))
    gain = lambda s, t: math.floor(1000 * math.log((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets))))
    return [gain(s, t) for s, t in both]


def weighed(docs: DataFrame, gained: list[int], run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document."""
    buckets = len(gained)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = np.array(gained, "i8")
        for batch in batches:
            for row, last, words, each, found in _features(batch.column("text"), buckets, run):
                sums, ends = np.concatenate([[0], np.cumsum(table[found])]), np.concatenate([[0], np.cumsum(each)])
                made = [pa.array(x, pa.int64()) for x in (words, each, sums[ends[1:]] - sums[ends[:-1]])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, last - row), *made], ["doc_id", "n_words", "n_features", "weight"])

    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    return docs.select("doc_id", "text").mapInArrow(weigh, schema)


def draw(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, n_features, weight, score and rank, which is null for those not drawn.

    Of the documents with `least` words or more, `percent` of a hundred are drawn.
    """
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(mark, 1, 8), 16, 10).cast("double")
    deviate = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")
    scored = weighed(docs, gains(docs, target, buckets, run), run).withColumn("score", F.col("weight") + deviate)
    scored = cut(scored, "scores")
    fit = scored.filter(F.col("n_words") >= least)
    drawn = fit.count() * percent // 100
    ranked = numbered(fit, [F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc()], "rank", write=cut)
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < least).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*columns, rank.alias("rank")).union(rest)


def sql(buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> str:
    """The same of single words, in DuckDB's SQL; the CRC goes byte by byte over the distinct words."""
    word = lambda t: f"SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w{t}"
    step = "CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
    return f"""WITH RECURSIVE bits(i, k, x) AS (SELECT i, 0, i::UBIGINT FROM range(256) t(i) UNION ALL SELECT i, k + 1, {step.format(x="x")} FROM bits WHERE k < 8),
crcs AS (SELECT list(x ORDER BY i) AS c FROM bits WHERE k = 8),
dw AS ({word(", doc_id")} FROM documents), bw AS ({word("")} FROM benchmark),
vocabulary AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
bytes AS (SELECT w, list_transform(string_split(rtrim(regexp_replace(hex(encode(w)), '(..)', '\\1 ', 'g')), ' '), lambda b: ('0x' || b)::UBIGINT) AS b FROM vocabulary),
hashed AS (SELECT w, xor(list_reduce(b, lambda a, y: xor(c[1 + (xor(a, y) & 255)::BIGINT], a >> 8), 4294967295::UBIGINT), 4294967295::UBIGINT) % {buckets} AS bucket FROM bytes, crcs),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {buckets})::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT sum(t) FROM t) + {buckets})::DOUBLE)))::BIGINT AS g FROM s FULL JOIN t USING (bucket)),
held AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS weight FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
score AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || d.doc_id), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score FROM documents d LEFT JOIN held USING (doc_id)),
fit AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM score WHERE n_features >= {least})
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN r <= {percent} * n // 100 THEN r END AS rank FROM score LEFT JOIN fit USING (doc_id)"""
