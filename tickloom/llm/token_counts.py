"""Token counts of documents in flat token files, by a scan for separators.

The files are ids only: no index says where a document ends. They are read in
byte ranges; every block of a file is searched for end-of-document ids at once,
and documents that cross blocks are stitched by a prefix scan over the blocks'
counts and last separators.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import partitions, scratch_root, stored, table
from tickloom.llm.tokens import VOCABULARY, encoder

END_ID = 50_256
DTYPE = "<u2"
BLOCK_TOKENS = 1 << 18
#: Blocks that the first level of the prefix scan takes together, and blocks that a task reads on average.
SUPER_BLOCKS, TASK_BLOCKS = 4096, 64


def _folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; Spark writes local ones with a single slash."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri) if rest else (fs.LocalFileSystem(), uri)


def _name(file: str):
    return F.element_at(F.split(file, "/"), -1)


def read_flat(spark: SparkSession, path: str, dtype: str = DTYPE, block_tokens: int = BLOCK_TOKENS, manifest: DataFrame | None = None) -> DataFrame:
    """Blocks (``file``, ``block``, ``ids``) of the flat files at ``path``, a folder or pattern that both Spark and pyarrow can open.

    With a ``manifest`` only files that it names are read: what a task left
    behind that was lost half-way is not one of them.

    Spark lists names and lengths; tasks read ranges, so a file may have any
    size. A file whose size is not a multiple of the item size is an error; an
    empty one has no blocks.
    """
    item = np.dtype(dtype).itemsize
    step = block_tokens * item

    def rows(batches):
        name = source = None
        for batch in batches:
            for file, block, size in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "size")), strict=True):
                if size % item:
                    raise ValueError(f"{file}: {size} bytes are no whole number of {dtype} ids")
                if file != name:
                    system, place = _folder(file)
                    name, source = file, system.open_input_file(place)
                ids = source.read_at(min(step, size - block * step), block * step)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([ids], type=pa.binary())], ["file", "block", "ids"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).filter("size > 0")
    if manifest is not None:
        files = files.join(manifest.select(F.col("file").alias("__name")).distinct(), _name("file") == F.col("__name"), "left_semi")
    blocks = files.select("file", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / step))).alias("block"))
    n = max(partitions(spark), (files.agg(F.sum(F.ceil(F.col("size") / step))).first()[0] or 0) // TASK_BLOCKS)
    return blocks.repartition(n, "file", F.floor(F.col("block") / TASK_BLOCKS)).sortWithinPartitions("file", "block").mapInArrow(rows, "file string, block long, ids binary")


def write_flat(docs: DataFrame, folder: str, block_tokens: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write ``docs`` (``doc_id``, ``text``) as flat files in ``folder``, one for each partition, and return the manifest beside them.

    Null texts are empty, ids may be null and repeat. The manifest (``file``,
    ``block``, ``closes``) has the ids of the documents whose end-of-document
    id each block holds, in order; the scan of the files does not read it. A
    task that is run again writes a file of another name, and only files in the
    manifest count.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches):
        from pyspark import TaskContext

        context, encode, sink, size = TaskContext.get(), encoder(vocabulary), None, 0
        name, block, closes = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.bin", 0, []

        def row(names):
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block]), pa.array([names], type=pa.list_(id_type))], ["file", "block", "closes"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype(DTYPE)
                if sink is None:
                    system, place = _folder(name)
                    sink = system.open_output_stream(place)
                sink.write(ids.tobytes())
                size += len(ids)
                while (size - 1) // block_tokens > block:
                    yield row(closes)
                    block, closes = block + 1, []
                closes.append(doc)
        if sink is not None:
            sink.close()
            yield row(closes)

    system, place = _folder(folder)
    system.create_dir(place)
    return stored(docs.select("doc_id", "text").mapInArrow(rows, f"file string, block long, closes array<{kind}>"), "manifest")


def separators(blocks: DataFrame, end_id: int = END_ID, dtype: str = "<u2") -> DataFrame:
    """``file``, ``block``, ``size`` and ``ends`` (places of ``end_id`` in the block); further columns stay."""
    more = [f for f in blocks.schema.fields if f.name not in ("file", "block", "ids")]

    def rows(batches):
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), dtype=dtype) if x.is_valid else np.zeros(0, dtype=dtype) for x in batch.column("ids")]
            ends = pa.array([np.flatnonzero(x == end_id).astype(np.int64) for x in found], type=pa.list_(pa.int64()))
            own = [batch.column("file"), batch.column("block"), pa.array([len(x) for x in found], type=pa.int64()), ends]
            yield pa.RecordBatch.from_arrays([*own, *(batch.column(f.name) for f in more)], ["file", "block", "size", "ends", *(f.name for f in more)])

    return blocks.select("file", "block", "ids", *(f.name for f in more)).mapInArrow(rows, ", ".join(["file string, block long, size long, ends array<long>", *(f"`{f.name}` {f.dataType.simpleString()}" for f in more)]))


def documents_of(found: DataFrame) -> DataFrame:
    """Documents of scanned blocks (:func:`separators`): ``file``, ``ordinal``, ``start``, ``n_tokens``.

    ``n_tokens`` leaves the separator out, so two separators in a row hold an
    empty document. Ids after a file's last separator are a document too, with
    ``closed`` false; a file that ends in one has none, and so has an empty
    table. ``place`` is the separator's number in its block, null if not closed.
    """
    last = F.element_at("ends", -1)
    up = Window.partitionBy("file", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = found.withColumn("super", F.floor(F.col("block") / SUPER_BLOCKS))
    # Blocks of one file have the same size but for its last.
    sums = rows.select("file", "super", "block", "size", F.size("ends").cast("long").alias("n"), F.when(F.size("ends") > 0, last).alias("last"))
    width = sums.groupBy("file").agg(F.max("size").alias("width"), F.max("block").alias("blocks"))
    sums = sums.join(width, "file").withColumn("last", F.col("block") * F.col("width") + F.col("last"))
    totals = sums.groupBy("file", "super").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    over = Window.partitionBy("file").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "super", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n0"), F.max("last").over(over).alias("last0"))
    carried = sums.select("file", "super", "block", "width", "blocks", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("n1"), F.max("last").over(up).alias("last1"))
    carried = carried.join(totals, ["file", "super"]).select(
        "file", "block", "width", "blocks", (F.col("n0") + F.col("n1")).alias("before"), F.coalesce("last1", "last0", F.lit(-1)).alias("previous")
    )
    rows = found.join(carried, ["file", "block"])
    origin = F.col("block") * F.col("width")
    stop = F.when(F.col("block") == F.col("blocks"), F.array((origin + F.col("size")).cast("long"))).otherwise(F.array().cast("array<long>"))
    ends = F.concat(F.transform("ends", lambda x: x + origin), stop)
    rows = rows.select(*(c for c in found.columns if c not in ("size", "ends")), "before", "previous", F.size("ends").alias("n"), ends.alias("ends"))
    starts = F.concat(F.array((F.col("previous") + 1).cast("long")), F.transform("ends", lambda x: x + 1))
    rows = rows.withColumn("starts", starts)
    out = rows.select(*(c for c in rows.columns if c not in ("ends", "starts")), F.posexplode(F.arrays_zip("starts", "ends")).alias("i", "x")).filter("x.ends IS NOT NULL")
    closed = F.col("i") < F.col("n")
    length = (F.col("x.ends") - F.col("x.starts")).cast("long")
    return out.select(
        *(c for c in out.columns if c not in ("before", "previous", "n", "i", "x", "block")),
        (F.col("before") + F.col("i")).cast("long").alias("ordinal"), F.col("x.starts").alias("start"), length.alias("n_tokens"),
        closed.alias("closed"), F.when(closed, F.col("i")).alias("place"),
    ).filter("closed OR n_tokens > 0")


def counted(docs: DataFrame, folder: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id``, ``file``, ``ordinal``, ``start`` and ``n_tokens`` of ``docs`` (``doc_id``, ``text``), through flat files in ``folder``.

    Null and empty texts have no tokens; repeated rows are counted each, and an
    empty table gives no rows.
    """
    manifest = write_flat(docs, folder, block_tokens).withColumn("file", _name("file"))
    if manifest.isEmpty():
        out = documents_of(separators(docs.sparkSession.createDataFrame([], "file string, block long, ids binary"))).withColumn("closes", F.array().cast(manifest.schema["closes"].dataType))
    else:
        found = stored(separators(read_flat(docs.sparkSession, folder, block_tokens=block_tokens, manifest=manifest)), "separators")
        out = documents_of(found.withColumn("file", _name("file")).join(manifest, ["file", "block"]))
    return out.select(F.element_at("closes", F.col("place") + 1).alias("doc_id"), "file", "ordinal", "start", "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of ``documents``, written as flat files in the shared folder and found again in them."""
    return counted(table(spark, sf_dir, "documents"), f"{scratch_root(spark).rstrip('/')}/tickloom-flat-{uuid.uuid4().hex}")


ORACLE: dict[str, str] = {}
