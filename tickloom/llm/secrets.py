"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every historical version of a path is addressed by the SHA-256 of its content.
Only pairs of blob and rule version that the ledger lacks are scanned, once
each, and the findings are joined back to every path that holds the blob.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import scratch_root, table

RULE_VERSION = "1"
_KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
#: (kind, pattern, group that is measured, its least length, what a text must have); the first three are the base kinds.
RULES = (
    ("assign", rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, rf"""({_KEYWORD})["']?\x20*[:=]"""),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    # Runs are maximal, so those of 24 and more are the base kind's matches that do not fail.
    ("hex", r"[0-9a-f]{24,}", 0, 24, r"[0-9a-f]{24}"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"PRIVATE KEY-----"),
    ("forge", r"gh[opsru]_[A-Za-z0-9]{36,}", 0, 1, r"gh[opsru]_[A-Za-z0-9]{36}"),
    ("chat", r"xox[abeprs]-[A-Za-z0-9-]{10,}", 0, 1, r"xox[abeprs]-"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ"),
)
BASE = ("assign", "access", "hex")
#: Matches whose places are summed together.
RUN = 256
_SPAN = "struct<start:int,rank:int,kind:string,stop:int>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value made once, though inner functions ask for it again and again."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans_of(text: Column, rank: int) -> Column:
    """Spans (code points, end exclusive) of rule ``rank`` in ``text``.

    Matches are leftmost and do not overlap. The pieces between them give their
    places: a match starts after the pieces and matches before it. Lengths are
    summed run by run, so that a text with very many matches stays cheap.
    """
    kind, pattern, group, least, needs = RULES[rank]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("found"), measured.alias("measured"))
    none = F.array().cast(f"array<{_SPAN}>")

    def step(acc, x):
        begin = acc["at"] + F.length(x["piece"])
        stop = begin + F.length(x["found"])
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), stop.alias("stop"))
        more = F.when(F.length(x["measured"]) >= least, F.array(span)).otherwise(none)
        return F.struct(stop.alias("at"), F.concat(acc["spans"], more).alias("spans"))

    def whole(matches):
        run = lambda i: F.slice(matches, i * RUN + 1, F.lit(RUN))
        runs = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / RUN).cast("int"))
        total = lambda xs, f: F.aggregate(xs, F.lit(0), lambda acc, x: acc + f(x))
        sums = F.transform(runs, lambda i: total(run(i), lambda x: F.length(x["piece"]) + F.length(x["found"])))
        spans = lambda before: F.transform(
            runs, lambda i: F.aggregate(run(i), F.struct(total(F.slice(before, F.lit(1), i), lambda x: x).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
        )
        return F.when(F.size(matches) > 0, F.flatten(_bound(sums, spans))).otherwise(none)

    # The piece behind the last match has none beside it.
    spans = _bound(F.filter(zipped, lambda x: x["found"].isNotNull()), whole)
    return F.when(F.rlike(text, F.lit(needs)), spans).otherwise(none)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """``blob_id``, ``rule_version`` and ``spans`` by start, then rule order."""
    hits = blobs.select("blob_id", *(spans_of(F.col("text"), i).alias(f"s{i}") for i in range(len(RULES))))
    return hits.select("blob_id", F.lit(RULE_VERSION).alias("rule_version"), F.array_sort(F.concat(*(f"s{i}" for i in range(len(RULES))))).alias("spans"))


def versions_of(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Historical versions (``path``, ``blob_id``, ``text``); a null text is empty."""
    return docs.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob_id", F.sha2("text", 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows: the findings of every blob that ``ledger`` does not have at this rule version."""
    # A blob without any rule's trigger has no findings: its text need not move.
    blobs = versions.select("blob_id", F.when(F.rlike("text", F.lit("|".join(r[4] for r in RULES))), F.col("text")).alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob_id"), "blob_id", "left_anti")
    return scan_blobs(blobs.groupBy("blob_id").agg(F.first("text").alias("text")).select("blob_id", F.coalesce("text", F.lit("")).alias("text")))


def ledger_at(spark: SparkSession, path: str) -> DataFrame:
    """The ledger in the folder ``path``, which is made if it is not there; partitioned by rule version."""
    empty = spark.createDataFrame([], f"blob_id string, spans array<{_SPAN}>, rule_version string")
    empty.write.mode("ignore").partitionBy("rule_version").parquet(path)
    return spark.read.schema(empty.schema).parquet(path)


def record(versions: DataFrame, path: str) -> DataFrame:
    """Scan what the ledger at ``path`` has not seen, append it, and return the whole ledger.

    A run that is broken off appends nothing, so the next one scans the same
    blobs again.
    """
    unseen = scan_unseen(versions, ledger_at(versions.sparkSession, path))
    unseen.select("blob_id", "spans", "rule_version").write.mode("append").partitionBy("rule_version").parquet(path)
    return ledger_at(versions.sparkSession, path)


def findings(versions: DataFrame, ledger: DataFrame, *columns: Column) -> DataFrame:
    """``path``, ``blob_id`` and ``spans`` of every version, from a ledger that has all its blobs.

    With ``columns``, these are made once a blob and come out in place of
    ``spans``. Equal texts share one scan; rows that repeat a path are reported
    each, and a null path stays null. An empty text has no spans, an empty
    table gives no rows, and columns other than path and text are never read.
    """
    now = ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob_id", *(columns or (F.col("spans"),)))
    return versions.select("path", "blob_id").join(now, "blob_id")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, through a ledger of this run's own in the shared folder."""
    versions = versions_of(table(spark, sf_dir, "documents"))
    ledger = record(versions, f"{scratch_root(spark).rstrip('/')}/tickloom-ledger-{uuid.uuid4().hex}")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    out = findings(versions, ledger, *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
    return out.withColumnRenamed("path", "doc_id").drop("blob_id")


def _oracle() -> str:
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS p FROM d"
        for i, (kind, pattern, group, least, _) in enumerate(RULES)
        for p in [pattern.replace("'", "''")]
    )
    size = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({kinds}),
s AS (SELECT doc_id, rank, kind, least, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': {size.format("p[1:i]")} + {size.format("m[1:i-1]")}, 'n': length(m[i]), 'v': length(v[i])}})) AS r FROM k WHERE len(m) > 0),
u AS (SELECT doc_id, rank, kind, CAST(r.a AS BIGINT) AS a, kind || ':' || CAST(r.a AS BIGINT) || ':' || CAST(r.a + r.n AS BIGINT) AS span FROM s WHERE r.v >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY a, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY a, rank) AS spans FROM u GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


ORACLE = {"op6_secret_scan": _oracle()}
