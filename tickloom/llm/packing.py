"""Packing documents into fixed windows by lexical retrieval.

1. Texts become token ids, once; how many documents have a term and how long
   documents are is counted over the whole corpus.
2. A document's three heaviest terms by these counts order the corpus, so that
   documents about the same things stand together whatever partition they came
   from. Ranges of that order are the partitions, runs of them the shards.
3. Each shard has a BM25 inverted index with the corpus' counts. A seed document
   opens a window; its nearest unused neighbours by all of its terms fill the
   rest, the last of them cut so that the window is exactly full.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import partitions, stored, table
from tickloom.llm.tokens import ADDED, VOCABULARY, encoder

WINDOW = 1024
END_ID = 0
#: A shard is closed when it has this many documents or ids.
SHARD_DOCS, SHARD_TOKENS = 512, 500_000
#: Ids of a partition on average, and ids that one record batch takes.
PARTITION_TOKENS, BATCH_TOKENS = 4_000_000, 1_000_000
#: BM25 parameters; terms that a document is placed by; share of a shard's documents from which a term has a dense row.
K1, B, PLACED_BY, DENSE = 1.2, 0.75, 3, 1 / 8
SCHEMA = "doc_id {}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Counts:
    """Counts over the whole corpus: documents, documents that have each term, mean length."""

    n: int
    df: np.ndarray
    mean: float

    def weights(self, terms: np.ndarray, tf: np.ndarray, size) -> np.ndarray:
        """BM25 weights of ``terms`` in documents of ``size`` ids."""
        df = self.df[terms]
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        return (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(1.0, self.mean)))).astype(np.float32)

    @staticmethod
    def of(docs: list[np.ndarray]) -> Counts:
        seen = np.concatenate([np.unique(d) for d in docs])
        return Counts(len(docs), np.bincount(seen), sum(map(len, docs)) / max(1, len(docs)))


def _terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and how often it has it, of all terms of all documents by document and term; one sort for all."""
    key = np.sort(np.repeat(np.arange(len(docs)), [len(d) for d in docs]) << 32 | np.concatenate(docs))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, tf = key[first], np.diff(first, append=len(key))
    return key >> 32, key & 0xFFFFFFFF, tf


class Index:
    """BM25 postings of the documents of one shard; terms are token ids.

    Terms that many documents have are rows of a matrix, whose products give
    their part of all scores at once; all others are lists.
    """

    def __init__(self, docs: list[np.ndarray], counts: Counts):
        self.n = n = len(docs)
        doc, term, tf = _terms(docs)
        weight = counts.weights(term, tf, np.array([len(d) for d in docs])[doc])
        own = np.bincount(term)
        shared = own[term] > 1
        term, doc, weight = term[shared], doc[shared], weight[shared]
        dense = own[term] > max(2, DENSE * n)
        names, row = np.unique(term[dense], return_inverse=True)
        matrix, has = np.zeros((len(names), n), dtype=np.float32), np.zeros((n, len(names)), dtype=np.float32)
        matrix[row, doc[dense]] = weight[dense]
        has[doc[dense], row] = 1
        self.common = has @ matrix
        term, doc, weight = term[~dense], doc[~dense], weight[~dense]
        names, term = np.unique(term, return_inverse=True)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.size = np.bincount(term, minlength=len(names))
        self.start = np.cumsum(self.size) - self.size
        order = np.argsort(doc, kind="stable")
        self.terms, self.first = term[order], np.r_[0, np.cumsum(np.bincount(doc, minlength=n))]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents for all terms of document ``seed``."""
        terms = self.terms[self.first[seed] : self.first[seed + 1]]
        size, end = self.size[terms], np.cumsum(self.size[terms])
        at = np.repeat(self.start[terms] + size - end, size) + np.arange(end[-1] if len(end) else 0)
        return self.common[seed] + np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def _first(score: np.ndarray, count: int) -> list[int]:
    """Places of the ``count`` greatest scores, equal ones in their order, also those of which only some fit."""
    if not count:
        return []
    last = np.partition(score, len(score) - count)[len(score) - count]
    better = np.flatnonzero(score > last)
    better = better[np.argsort(-score[better], kind="stable")]
    return [*better.tolist(), *np.flatnonzero(score == last)[: count - len(better)].tolist()]


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, counts: Counts | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard, whose documents are shorter than ``window``.

    Documents are cut freely. Every sequence is full but what is left at last,
    which is dealt to sequences whose lengths are powers of two.
    """
    pieces, sequence = [], 0
    at = [0] * len(docs)
    rest = np.array([len(d) for d in docs])
    unused = rest > 0
    if not unused.any():
        return pieces
    index = Index(docs, counts or Counts.of(docs))
    tail: list[tuple[int, int, int]] = []
    seed, pointer = None, 0
    while True:
        if seed is None:
            while pointer < len(docs) and not unused[pointer]:
                pointer += 1
            if pointer == len(docs):
                break
            seed = pointer
            unused[seed] = False
        current, filled = [(seed, at[seed], int(rest[seed]))], int(rest[seed])
        query, seed = seed, None
        ranked = None
        while filled < window:
            if ranked is None:
                score = np.where(unused, index.scores(query), -1.0)
                ranked = _first(score, min(32, int(unused.sum())))
            if not ranked:
                if not unused.any():
                    break
                ranked = None
                continue
            d = ranked.pop(0)
            unused[d] = False
            take = min(window - filled, int(rest[d]))
            current.append((d, at[d], take))
            filled += take
            at[d] += take
            rest[d] -= take
            if rest[d]:
                seed = d  # its tail opens the next window
        if filled < window:
            tail = current
            break
        offset = 0
        for d, start, length in current:
            pieces.append((d, start, length, sequence, offset))
            offset += length
        sequence += 1
    left = sum(x[2] for x in tail)
    while left:
        room, offset = 1 << (left.bit_length() - 1), 0
        left -= room
        while room:
            d, start, length = tail[0]
            take = min(room, length)
            pieces.append((d, start, take, sequence, offset))
            offset, room = offset + take, room - take
            tail[0] = (d, start + take, length - take)
            if take == length:
                tail.pop(0)
        sequence += 1
    return pieces


def tokenised(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str = VOCABULARY, added: str | None = ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``row`` (a number of the row), ``whole`` (ids that fill windows by themselves), ``ids`` (those behind) and ``size`` of every row.

    Ids are little-endian uint32, with ``end_id`` behind the last.
    """

    def rows(batches):
        encode = encoder(vocabulary, added)
        for batch in batches:
            found, first, size = [], 0, 0
            for i, text in enumerate(batch.column(2)):
                found.append(np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4"))
                size += len(found[-1])
                if size >= BATCH_TOKENS or i == batch.num_rows - 1:
                    part = batch.slice(first, i + 1 - first)
                    full = [len(x) - len(x) % window for x in found]
                    ids = (pa.array([x[:n].tobytes() for x, n in zip(found, full, strict=True)], type=pa.binary()), pa.array([x[n:].tobytes() for x, n in zip(found, full, strict=True)], type=pa.binary()))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *ids, pa.array([len(x) for x in found], type=pa.int64())], ["id", "row", "whole", "ids", "size"])
                    found, first, size = [], i + 1, 0

    numbered = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return numbered.mapInArrow(rows, f"id {docs.schema[id_col].dataType.simpleString()}, row long, whole binary, ids binary, size long")


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u4") for x in batch.column("ids")]


def count_terms(tokens: DataFrame) -> Counts:
    """Counts over the ``ids`` of all documents, in one pass; what reaches the driver is one number a term of the vocabulary, and two more."""

    def rows(batches):
        df, n, size = np.zeros(1 << 16, dtype=np.int64), 0, 0
        for batch in batches:
            for ids in _ids(batch):
                if not len(ids):
                    continue
                if (top := int(ids.max())) >= len(df):
                    df = np.pad(df, (0, top + 1))
                df[ids] += 1  # once a term, however often the document has it
                n, size = n + 1, size + len(ids)
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, [-1, -2])), pa.array(np.append(df[terms], [n, size]))], ["term", "df"])

    found = tokens.select("ids").mapInArrow(rows, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    term, number = found.column("term").to_numpy(), found.column("df").to_numpy()
    df = np.zeros(1 + max(0, term.max(initial=0)), dtype=np.int64)
    df[term[term >= 0]] = number[term >= 0]
    n, size = (int(number[term == k].sum()) for k in (-1, -2))
    return Counts(n, df, size / max(1, n))


def heaviest(docs: list[np.ndarray], counts: Counts) -> np.ndarray:
    """The ``PLACED_BY`` terms that weigh most in each document among those of two documents or more, the smaller of equal ones first, -1 for none."""
    heavy = np.full((len(docs), PLACED_BY), -1, dtype=np.int64)
    doc, term, tf = _terms(docs)
    known = counts.df[term] > 1
    doc, term, tf = doc[known], term[known], tf[known]
    weight = counts.weights(term, tf, np.array([len(d) for d in docs])[doc])
    for place in range(PLACED_BY if len(doc) else 0):
        start = np.flatnonzero(np.diff(doc, prepend=-1))
        most = np.maximum.reduceat(weight, start)
        at = np.flatnonzero(weight == np.repeat(most, np.diff(start, append=len(doc))))
        at = at[np.flatnonzero(np.diff(doc[at], prepend=-1))]
        at = at[weight[at] >= 0]
        heavy[doc[at], place] = term[at]
        weight[at] = -1
    return heavy


def placed(tokens: DataFrame, counts: Counts) -> DataFrame:
    """``tokens`` with ``t0``, ``t1`` and so on: the terms that weigh most in each document among those of two documents or more, -1 for none."""
    sent = tokens.sparkSession.sparkContext.broadcast(counts)
    names = [f"t{i}" for i in range(PLACED_BY)]

    def rows(batches):
        own = sent.value
        for batch in batches:
            docs = _ids(batch)
            heavy = np.concatenate([heaviest(docs[a : a + SHARD_DOCS], own) for a in range(0, len(docs), SHARD_DOCS)] or [np.zeros((0, PLACED_BY), dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(heavy[:, i])) for i in range(PLACED_BY))], [*batch.schema.names, *names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(rows, schema + "".join(f", {c} long" for c in names))


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str = VOCABULARY, added: str | None = ADDED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all rows of ``docs``; each id lies in exactly one piece.

    A document is the ids of its whole text, where tokens that ``added`` lists
    are found, and then ``end_id``; null and empty texts are that id alone.
    What fills whole windows is cut off first and moves no more; the index is
    over what is left of each document. Rows that repeat an id, and null ids,
    are packed like others; equal scores are filled in the order of the shard.
    An empty table gives no pieces; other columns are ignored.

    Returns ``id_col``, ``start``, ``length``, ``ids`` (little-endian uint32),
    ``doc_tokens``, ``sequence_id`` (of partition and running number; odd for
    windows of one document) and ``offset``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = SCHEMA.format(kind).replace("doc_id", f"`{id_col}`", 1)
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    tokens = stored(tokenised(docs, window, end_id, vocabulary, added, id_col, text_col), "tokens")
    counts = count_terms(tokens)
    n_parts = max(partitions(docs.sparkSession), int(counts.n * counts.mean) // PARTITION_TOKENS + 1)
    order = [*(f"t{i}" for i in range(PLACED_BY)), "row"]
    # The row's number is the last key, so documents of one term, or copies of one text, go to as many partitions as they need.
    # Written once: Spark samples the keys for the ranges before it deals the rows out.
    ready = stored(placed(tokens.select("id", "row", "ids", "size").filter(F.octet_length("ids") > 0), counts), "placed")
    ordered = ready.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def whole(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 32
        for batch in batches:
            for own, ids, size in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data = ids.as_buffer()
                n, step = data.size // (4 * window), 4 * window
                for a in range(0, n, 1024):
                    part = np.arange(a, min(n, a + 1024))
                    pieces = pa.array([data.slice(i * step, step).to_pybytes() for i in part.tolist()], type=pa.binary())
                    columns = [pa.array([own.as_py()] * len(part), type=batch.schema.field(0).type), pa.array(part * window), pa.array(np.full(len(part), window)), pieces, pa.array([size.as_py()] * len(part), type=pa.int64()), pa.array(2 * (sequence + part) + 1), pa.array(0 * part)]
                    yield pa.RecordBatch.from_arrays(columns, names)
                sequence += n

    def shard(own, texts, sizes, base):
        pieces = pack_shard(texts, window, sent.value)
        doc, start, length, sequence, offset = (np.array(c, dtype=np.int64) for c in zip(*pieces, strict=True))
        behind = sizes - np.array([len(t) for t in texts], dtype=np.int64)
        for a in range(0, len(doc), 1024):
            part = slice(a, a + 1024)
            d = doc[part]
            ids = pa.array([texts[i][s : s + n].tobytes() for i, s, n in zip(d.tolist(), start[part].tolist(), length[part].tolist(), strict=True)], type=pa.binary())
            columns = [own.take(pa.array(d)), pa.array(behind[d] + start[part]), pa.array(length[part]), ids, pa.array(sizes[d]), pa.array(2 * (base + sequence[part])), pa.array(offset[part])]
            yield pa.RecordBatch.from_arrays(columns, names)
        return int(sequence.max()) + 1

    def rows(batches):
        from pyspark import TaskContext

        base, own, texts, sizes, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for batch in batches:
            first = 0
            for i, (ids, n) in enumerate(zip(_ids(batch), batch.column("size").to_pylist(), strict=True)):
                texts.append(ids)
                sizes.append(n)
                size += len(ids)
                if size >= SHARD_TOKENS or len(texts) >= SHARD_DOCS:
                    own.append(batch.column(0).slice(first, i + 1 - first))
                    base += yield from shard(pa.concat_arrays(own), texts, np.array(sizes), base)
                    own, texts, sizes, size, first = [], [], [], 0, i + 1
            if first < batch.num_rows:
                own.append(batch.column(0).slice(first))
        if texts:
            yield from shard(pa.concat_arrays(own), texts, np.array(sizes), base)

    cut = tokens.select("id", "whole", "size").filter(F.octet_length("whole") > 0).mapInArrow(whole, schema)
    return cut.unionByName(ordered.select("id", "ids", "size").mapInArrow(rows, schema))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


ORACLE: dict[str, str] = {}
