"""SimHash near-duplicates with pivot distance tables.

Fingerprints are compared only where they agree in some blocks of bits: with at
most four differing bits, four of their blocks can differ, so no link is
missed. There are six blocks, seven or eight by the number of fingerprints, so
that the runs to compare stay short; which links are found is the same for all.
Of these pairs, those whose Hamming distances to a set of reference
fingerprints (pivots) differ by more than four in any coordinate are discarded
by the triangle inequality; the survivors are verified bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import near_text, pivots
from tickloom.llm.common import partitions, stored, table
from tickloom.llm.components import components

WORDS, RADIUS = 4, 4
#: Blocks in which fingerprints agree, and chance runs of a key, on average, from which one more is asked for.
AGREE, CHANCE_RUN = (2, 3, 4), 16


def fingerprint(raw: bytes) -> int:
    """SimHash of UTF-8 text: XXH64 of every shingle of four words, repeats included; a bit is set if it is in over half of them."""
    return near_text.fingerprint_of(near_text.shingles(near_text.words_of(raw), WORDS))


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` (signed long) of every row; null texts count as empty."""

    def rows(batches):
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(rows, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def agreeing_blocks(n: int) -> int:
    """Blocks of ``RADIUS + k`` that keys take, for ``n`` fingerprints."""
    return next((k for k in AGREE if n <= CHANCE_RUN << (64 * k // (RADIUS + k))), AGREE[-1])


def _keys(fp, agree: int):
    """One key for each choice of ``agree`` blocks, unlike those of other choices."""
    edges = [64 * i // (RADIUS + agree) for i in range(RADIUS + agree + 1)]
    block = [(b - a, F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))) for a, b in zip(edges, edges[1:], strict=False)]
    keys = []
    for i, chosen in enumerate(combinations(block, agree)):
        key = F.lit(i).cast("long")
        for width, bits in chosen:
            key = F.shiftleft(key, width) + bits
        keys.append(key)
    return F.array(*keys)


def _run_links(batches):
    """Links of a partition sorted by key."""
    for (keys, fps), _ in pivots.whole_runs(batches):
        i, j = pivots.near_in_runs(keys, fps.view(np.uint64), RADIUS)
        yield pa.RecordBatch.from_arrays([pa.array(fps[i]), pa.array(fps[j])], ["a", "b"])


def links(fps: DataFrame, agree: int | None = None) -> DataFrame:
    """Links (``a``, ``b``) between the distinct fingerprints in ``fps`` (``fp``), enough of them to connect all that are connected."""
    keyed = fps.select(F.explode(_keys(F.col("fp"), agree or agreeing_blocks(fps.count()))).alias("key"), "fp")
    n = partitions(fps.sparkSession)
    return keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_run_links, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups, one row a document.

    Texts are whole, lower-cased A-Z; words are ``[^\\x20\\x09-\\x0D]+`` and a
    text of fewer than four is one shingle. Null, empty and blank texts have
    fingerprint zero, which links like any other. ``component_id`` is the
    smallest id that is reachable; rows with a null id get that of their group,
    null if none has one. Repeated rows are reported each, an empty table gives
    no rows, and other columns are ignored.

    Returns ``id_col``, ``fingerprint`` (16 hex digits) and ``component_id``.
    """
    prints = stored(with_fingerprint(docs, id_col, text_col), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes))
    nodes = stored(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = stored(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")  # written, so that a large component is divided
    labels = nodes.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-equal texts: fingerprints of five words propose, shingles decide; see :mod:`near_text`."""
    return near_text.keep_one(docs, id_col, text_col)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
