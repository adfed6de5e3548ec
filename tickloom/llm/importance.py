"""Target-distribution importance resampling on hashed word n-grams.

Equal texts are collapsed by grouping the full text. Features are made once a
text and kept as bucket numbers; counts are multiplied by how often a text
occurs. A text's weight, the mean log ratio of target and corpus over its
features, is computed once and joined back to all its documents, whose Gumbel
noise then decides: the highest scores are a sample without replacement by
weight.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import partitions, stored, table
from tickloom.llm.words import PATTERN, texts_of, words_of

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 25, 7


def buckets_of(raw: bytes, n_buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all single words and pairs of neighbours: CRC-32 of their bytes, modulo ``n_buckets``."""
    words = words_of(raw)
    single = list(map(zlib.crc32, words))
    # A pair's checksum goes on from that of its first word.
    pairs = map(zlib.crc32, [b" " + w for w in words[1:]], single)
    return (np.fromiter((*single, *pairs), dtype=np.uint32) % np.uint32(n_buckets)).astype("<u4")


def collapsed(docs: DataFrame, text_col: str = "text", n_buckets: int = BUCKETS) -> DataFrame:
    """One row a distinct text: ``sha``, ``copies``, ``n_features`` and ``buckets`` (unsigned 32-bit, little-endian); null is the empty text."""

    def rows(batches):
        for batch in batches:
            found = [buckets_of(raw, n_buckets) for raw in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(b) for b in found], type=pa.int64()), pa.array([b.tobytes() for b in found], type=pa.binary())],
                ["sha", "copies", "n_features", "buckets"],
            )

    texts = docs.groupBy(F.coalesce(F.col(text_col), F.lit("")).alias("body")).agg(F.count(F.lit(1)).alias("copies"))
    return texts.select(F.unhex(F.sha2("body", 256)).alias("sha"), "copies", "body").mapInArrow(rows, "sha binary, copies long, n_features long, buckets binary")


def bucket_counts(texts: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all documents. What reaches the driver is one number a bucket."""

    def rows(batches):
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for copies, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, dtype="<u4")
                if len(own) * 8 > n_buckets:
                    total += copies * np.bincount(own, minlength=n_buckets)
                else:
                    np.add.at(total, own, copies)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = texts.select("copies", "buckets").mapInArrow(rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_buckets, dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, for each bucket."""
    n, s, t = len(corpus), corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """``sha``, ``n_features`` and ``weight`` of every text; no features weigh 0."""

    def rows(batches):
        for batch in batches:
            n = batch.column(1).to_numpy()
            total = [int(gain[np.frombuffer(raw, dtype="<u4")].sum()) for raw in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(total, dtype=np.int64) // np.maximum(n, 1))], ["sha", "n_features", "weight"])

    return texts.select("sha", "n_features", "buckets").mapInArrow(rows, "sha binary, n_features long, weight long")


def ranked(rows: DataFrame, *order, label: str = "ranked") -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3...) in the given order, sorted by ranges of it.

    Parts report how many rows they have; those numbers, one a part, give each
    part's first rank. Equal keys are one row's repeats or ranked in any order.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id())
    placed = stored(placed, label)
    part = F.shiftright("__place", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())  # one row a part
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "__part long, __before long")
    placed = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.withColumn("rank", F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__before", "__place")


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n_buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``id``, ``n_features``, ``weight`` and ``score`` of every row of ``docs``."""
    texts = stored(collapsed(docs, text_col, n_buckets), "features")
    gain = gains(bucket_counts(texts, n_buckets), bucket_counts(collapsed(target, target_col, n_buckets), n_buckets))
    weights = stored(weighed(texts, gain), "weights")
    # Stored, so that a join with a very common text can be divided.
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("sha")).join(weights, "sha")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.select("id", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, n_buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """A sample of ``docs`` that is distributed like ``target``: every row with its weight, score and rank.

    Of the N rows with at least ``min_words`` words, those with the
    floor(``percent`` * N / 100) highest scores are drawn; ``rank`` is null for
    the others. Null and empty texts have no features, weigh 0 and are not
    drawn. Ties go to the smaller id, a null id last (its noise is that of an
    empty id); rows that repeat an id and a text have the same score and a rank
    each. An empty ``target`` or ``docs`` has no features: weights then follow
    from the smoothing alone. Other columns are ignored.

    Returns ``id_col``, ``n_features``, ``weight``, ``score``, ``rank``.
    """
    rows = stored(scored(docs, target, id_col, text_col, target_col, n_buckets, seed), "scores")
    # n words have 2n - 1 features.
    enough = F.col("n_features") >= 2 * min_words - 1
    drawn = rows.filter(enough).count() * percent // 100
    order = ranked(rows.filter(enough), F.desc("score"), F.asc_nulls_last("id"))
    out = order.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(rows.filter(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = {
    "op12_importance": rf"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
x AS (
  SELECT 'd' AS side, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}') AS words FROM x),
f AS (
  SELECT side, rid, unnest(words) AS feature FROM w
  UNION ALL SELECT side, rid, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM w),
c AS (SELECT side, rid, feature, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT feature, hex(feature) AS hx FROM (SELECT DISTINCT feature FROM c)),
k AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT))),
           lambda a, b: xor(a >> 8, tab.crc[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, tab),
s AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM c JOIN k USING (feature) GROUP BY bucket),
z AS (SELECT coalesce(sum(s), 0)::DOUBLE AS big_s, coalesce(sum(t), 0)::DOUBLE AS big_t FROM s),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (big_s + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (big_t + 10000)))) AS gain FROM s, z),
m AS (SELECT rid, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM c JOIN k USING (feature) JOIN g USING (bucket) WHERE side = 'd' GROUP BY rid),
r AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN m USING (rid) WHERE side = 'd'),
o AS (SELECT *, n_words >= 20 AS enough, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS total FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= 25 * total // 100 THEN place END AS rank FROM o
"""
}
