"""Exact deduplication by a Golomb-coded fingerprint exchange.

Partitions sort the 64-bit fingerprints of their documents and send them, as
Golomb-Rice coded gaps, to the owner of each hash range. Owners answer every
message with a bitmap of the fingerprints that occur elsewhere too. Only
documents with such a fingerprint are shuffled with their text, grouped by the
bytes themselves, so that colliding fingerprints never merge two texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bloom, verdicts
from tickloom.llm.common import partitions, stored, table

#: What normalisation deletes: the characters [\x20\x09-\x0D].
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Fingerprints that one owner decodes at once, on average.
OWNER_KEYS = 250_000
#: Fingerprints that one task codes at once.
MESSAGE_KEYS = 4_000_000
FILTER_BYTES = 16 << 20


def rice_encode(values: np.ndarray) -> bytes:
    """Golomb-Rice code of a sorted, distinct uint64 array.

    Layout: count, remainder width and unary length as uint32, the unary
    quotients (a one ends each), then the remainders, all as packed bits.
    """
    n = len(values)
    if not n:
        return np.zeros(3, dtype="<u4").tobytes()
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = max(1.0, float(values[-1]) / n)
    k = int(min(58, max(0, np.ceil(np.log2(mean * np.log(2))))))
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    head = np.array([n, k, len(unary)], dtype="<u4").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def rice_decode(data: bytes) -> np.ndarray:
    """Inverse of :func:`rice_encode`."""
    n, k, unary_bits = (int(x) for x in np.frombuffer(data, dtype="<u4", count=3))
    if not n:
        return np.zeros(0, dtype=np.uint64)
    split = 12 + (unary_bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(data[12:split], dtype=np.uint8), count=unary_bits)
    gaps = (np.diff(np.flatnonzero(unary), prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(data[split:], dtype=np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
        gaps |= (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _width(n_owners: int) -> np.uint64:
    return np.uint64((1 << 64) // n_owners + 1)


def _messages(n_owners: int):
    """Coded messages of one partition's fingerprints; they leave it sorted and compressed, in rounds of MESSAGE_KEYS."""
    width = _width(n_owners)

    def message(held: list[np.ndarray], number: int) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        owner = (keys // width).astype(np.int64)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        coded, twice = [], []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
            coded.append(rice_encode(keys[a:b] - np.uint64(owner[a]) * width))
            twice.append(np.packbits(counts[a:b] > 1).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * len(first), type=pa.int64()), pa.array(owner[first]), pa.array(coded, type=pa.binary()), pa.array(twice, type=pa.binary())],
            ["sender", "owner", "coded", "twice"],
        )

    def send(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy().view(np.uint64))
                size += batch.num_rows
            if size >= MESSAGE_KEYS:
                yield message(held, number)
                number, held, size = number + 1, [], 0
        if held:
            yield message(held, number)

    return send


def _reply(group: pa.Table) -> pa.Table:
    """One bitmap a message: set where a fingerprint came more than once."""
    lists = [rice_decode(x) for x in group.column("coded").to_pylist()]
    keys, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = keys[counts > 1]
    bitmaps = []
    for own, twice in zip(lists, group.column("twice").to_pylist(), strict=True):
        at = np.minimum(np.searchsorted(shared, own), max(0, len(shared) - 1))
        hit = (shared[at] == own) if len(shared) else np.zeros(len(own), dtype=bool)
        hit |= np.unpackbits(np.frombuffer(twice, dtype=np.uint8), count=len(own)).astype(bool)
        bitmaps.append(np.packbits(hit).tobytes())
    return pa.table({"sender": group.column("sender"), "owner": group.column("owner"), "bitmap": pa.array(bitmaps, type=pa.binary())})


def _receive(n_owners: int):
    width = _width(n_owners)

    def read(batches):
        for batch in batches:
            found = []
            for owner, coded, bitmap in zip(*(batch.column(c).to_pylist() for c in ("owner", "coded", "bitmap")), strict=True):
                own = rice_decode(coded) + np.uint64(owner) * width
                found.append(own[np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), count=len(own)).astype(bool)])
            keys = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["fingerprint"])

    return read


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def fingerprint_exchange(prints: DataFrame) -> DataFrame:
    """Fingerprints (``fingerprint``, not null) that more than one row of ``prints`` has.

    Only coded messages and bitmaps are shuffled, never a fingerprint itself.
    """
    n_owners = max(partitions(prints.sparkSession), prints.count() // OWNER_KEYS + 1)
    sent = stored(prints.select("fingerprint").mapInArrow(_messages(n_owners), "sender long, owner long, coded binary, twice binary"), "messages")
    # Written, so that no task has Python workers for both the replies and what is done with them.
    replies = stored(sent.groupBy("owner").applyInArrow(_reply, "sender long, owner long, bitmap binary"), "replies")
    received = sent.select("sender", "owner", "coded").join(replies, ["sender", "owner"])
    return received.mapInArrow(_receive(n_owners), "fingerprint long").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts, one row a document.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; null
    counts as empty, and empty texts equal each other. The row with the most
    code points in its original text stays, the smallest id among ties; a null
    id is larger than any other. Rows that repeat an id with the same text get
    the same verdict. An empty table gives an empty result; extra columns of
    ``docs`` are ignored, whatever their names.

    Returns ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).select(
        "id", "body", normalised(F.col("body")).alias("norm")
    )
    prints = stored(
        rows.select("id", F.xxhash64("norm").alias("fingerprint"), F.unhex(F.sha2("norm", 256)).alias("sha")),
        "prints",
    )
    shared = stored(fingerprint_exchange(prints), "shared")
    bits = bloom.build(shared, "fingerprint", bloom.block_count(shared.count(), FILTER_BYTES))
    suspects = bloom.probe(rows.select("id", "norm", F.length("body").alias("size"), F.xxhash64("norm").alias("fingerprint")), "fingerprint", bits)
    suspects = suspects.join(shared, "fingerprint", "left_semi")
    groups = (
        suspects.groupBy("fingerprint", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct(-F.col("size"), F.col("id").isNull(), "id")).alias("best"))
        .filter("group_size > 1")
        .select(F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size", F.col("best.id").alias("keep_id"))
    )
    # Rows whose fingerprint nobody shares stay where they are.
    maybe, alone = bloom.split(prints, "fingerprint", bits)
    out = maybe.select("id", "sha").join(groups, "sha", "left")
    out = out.unionByName(alone.select("id", "sha", F.lit(None).cast("long").alias("group_size"), F.lit(None).cast(docs.schema[id_col].dataType).alias("keep_id")))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one that :func:`exact_groups` keeps.

    A verdict is of an id and a text together: other texts of a dropped id, or
    of a null id, stay. Of rows that repeat both, one stays. Nulls, empty texts
    and empty tables are as there; all columns of ``docs`` come back.
    """
    groups = exact_groups(docs, id_col, text_col).filter("group_size > 1").groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"))
    named = stored(groups.agg(F.first("kept").alias("kept"), (F.count(F.lit(1)) > 1).alias("many")), "verdicts")
    return verdicts.settle(docs, named, {"id": docs[id_col], "sha": F.sha2(normalised(docs[text_col]), 256)})


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = {
    "op7_exact_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(body) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
}
