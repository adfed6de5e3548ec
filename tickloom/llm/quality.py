"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

Each labelled good document is preferred to each labelled poor one. The score of
a document is linear in its text features; its weights minimise the logistic
loss of feature differences over all pairs. A quantile of the training scores,
the share of poor documents, is the threshold.

The pairs are never listed. What a pair adds to the loss, its gradient and its
Hessian is a smooth function of the difference of two scores, times products of
features. Such a function equals, to the last digits of a double, its polynomial
on short cells of scores. So each task sums up, by label and cell, the features
of its rows at the nodes of the cell, and the driver adds the pairs of nodes.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bloom
from tickloom.llm.common import partitions, stored, table
from tickloom.operators import exact

#: Preference pairs that :func:`fit_pairs` draws for each row.
PAIRS_PER_ROW = 8
RIDGE = 1e-3
#: Nodes of a cell of scores, which is 1 wide: the functions' nearest poles are pi away, so polynomials of this degree are exact to 1e-15.
NODES = 14
_PLACES = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)
_BASIS = np.cos(np.arange(NODES)[:, None] * np.arccos(_PLACES)) * np.where(np.arange(NODES) == 0, 1, 2)[:, None] / NODES
FILTER_BYTES, STEPS = 16 << 20, 60
FEATURES = (
    "upper_share", "mark_share", "symbol_share", "bang_share", "bar_share", "digit_share", "repeat_share", "top_share", "distinct_share",
    "word_length", "log_words", "blank_share", "lone_mark_share", "capital_share",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_UPPER, _LOWERCASE, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(bytes(range(48, 58)))
_MARKS = _class(b".,;:?'\"()-")
_SYMBOLS = _class(b"#$%&*+/<=>@[\\]^_`{}~")
_BLANK = _class(b" \t\n\r\x0b\x0c")


def features(text: str | None) -> list[float]:
    """Numbers between about 0 and 1 that describe the whole text; null and blank texts give zeros."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    total, n = float(len(raw)), len(words)
    tally = Counter(words)
    upper = count @ _UPPER
    return [
        upper / max(1.0, upper + count @ _LOWERCASE),
        count @ _MARKS / total,
        count @ _SYMBOLS / total,
        count[33] / total,
        count[124] / total,
        count @ _DIGIT / total,
        sum(map(eq, words, words[1:])) / n,
        max(tally.values()) / n if n > 4 else 0.2,
        len(tally) / n,
        min(1.0, len(text) / n / 20),
        math.log1p(n) / 10,
        count @ _BLANK / total,
        sum(len(w) == 1 and not w.isalnum() for w in tally) and sum(c for w, c in tally.items() if len(w) == 1 and not w.isalnum()) / n,
        sum(c for w, c in tally.items() if w[:1].isupper()) / n,
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """``id`` and ``x`` (array of features) of ``docs`` (``id``, ``text``, and further columns that stay)."""

    def rows(batches):
        for batch in batches:
            x = pa.array([features(t.as_py()) for t in batch.column("text")], type=pa.list_(pa.float64()))
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), x], [*names, "x"])

    kept = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(rows, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "x array<double>"]))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs_per_row: int = PAIRS_PER_ROW, ridge: float = RIDGE) -> dict:
    """Weights, means, scales and the threshold from features and 0/1 labels, on drawn pairs of rows that one process holds; :func:`train` takes all pairs instead.

    Rows of one label only, or none, give weights of zero: every score is then
    the sigmoid of 0, and counts as good.
    """
    d = x.shape[1] if x.ndim == 2 and len(x) else len(FEATURES)
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        return {"weights": np.zeros(d), "mean": np.zeros(d), "scale": np.ones(d), "threshold": 0.0}
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = (x - mean) / scale
    draw = np.random.default_rng(7)
    n = pairs_per_row * max(len(good), len(poor))
    # Every row of the larger side appears, so no preference is left out by chance.
    win = np.resize(draw.permutation(good), n) if len(good) >= len(poor) else draw.choice(good, n)
    lose = draw.choice(poor, n) if len(good) >= len(poor) else np.resize(draw.permutation(poor), n)
    diff = z[win] - z[lose]
    w = np.zeros(d)
    for _ in range(30):  # Newton steps on the pairwise logistic loss
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        gradient = diff.T @ (p - 1) / n + ridge * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(d)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    scores = np.sort(margins(z, w))
    at = len(poor)  # the quantile that is the share of poor rows
    return {"weights": w, "mean": mean, "scale": scale, "threshold": float((scores[at - 1] + scores[at]) / 2)}


def margins(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores before the threshold; row by row, so that equal texts score alike to the last bit wherever they stand in a batch."""
    return (z * w).sum(axis=1)


def node_sums(z: np.ndarray, s: np.ndarray) -> dict[int, np.ndarray]:
    """For each cell of scores ``s`` the sums of 1, ``z`` and the products of ``z``, spread over the cell's nodes (``[node, sum]``)."""
    cell = np.floor(s).astype(np.int64)
    spread = np.cos(np.arange(NODES) * np.arccos(np.clip(2 * (s - cell) - 1, -1, 1))[:, None]) @ _BASIS
    rows, columns = np.triu_indices(z.shape[1])
    own = np.column_stack([np.ones(len(z)), z, z[:, rows] * z[:, columns]])
    return {int(c): spread[cell == c].T @ own[cell == c] for c in np.unique(cell)}


def pair_sums(good: dict[int, np.ndarray], poor: dict[int, np.ndarray], d: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss, gradient and Hessian over all pairs of a good and a poor row, from their sums at the nodes."""
    at = lambda cells: np.concatenate([c + (_PLACES + 1) / 2 for c in sorted(cells)])
    sums = lambda cells: np.concatenate([cells[c] for c in sorted(cells)])
    y, b = at(poor), sums(poor)
    loss, gradient, both, mixed = 0.0, np.zeros(d), np.zeros(d * (d + 1) // 2), np.zeros((d, d))
    for c in sorted(good):  # the nodes of one cell against all others, so that little is held
        u = (c + (_PLACES + 1) / 2)[:, None] - y
        a, lost = good[c], np.exp(-np.logaddexp(0, u))  # lost: the sigmoid of -u
        curve = lost * np.exp(-np.logaddexp(0, -u))
        loss += a[:, 0] @ np.logaddexp(0, -u) @ b[:, 0]
        gradient += b[:, 1 : d + 1].T @ (a[:, 0] @ lost) - a[:, 1 : d + 1].T @ (lost @ b[:, 0])
        both += a[:, d + 1 :].T @ (curve @ b[:, 0]) + b[:, d + 1 :].T @ (a[:, 0] @ curve)
        mixed += a[:, 1 : d + 1].T @ curve @ b[:, 1 : d + 1]
    hessian = np.zeros((d, d))
    hessian[np.triu_indices(d)] = both
    hessian += np.triu(hessian, 1).T - mixed - mixed.T
    pairs = sum(x[:, 0].sum() for x in good.values()) * b[:, 0].sum()
    return loss / pairs, gradient / pairs, hessian / pairs


def _all_pairs(rows: DataFrame, mean: np.ndarray, scale: np.ndarray):
    """A function of weights: :func:`pair_sums` over ``rows`` (``y``, ``x``), with the ridge."""
    d = len(mean)

    def part(weights):
        def sums(batches):
            from pyspark import TaskContext

            held = {}
            for batch in batches:
                y, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, d)
                for label in (0, 1):
                    z = (x[y == label] - mean) / scale
                    for c, found in node_sums(z, margins(z, weights)).items():
                        held[label, c] = held.get((label, c), 0) + found
            keys = sorted(held)
            columns = [pa.array([k[0] for k in keys], type=pa.int32()), pa.array([k[1] for k in keys], type=pa.int64()), pa.array([TaskContext.get().partitionId()] * len(keys), type=pa.int32()), pa.array([held[k].tobytes() for k in keys], type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["y", "cell", "part", "sums"])

        return sums

    def add(batches):
        held = {}
        for batch in batches:
            for y, c, raw in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                held[y, c] = held.get((y, c), 0) + np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], type=pa.int32()), pa.array([k[1] for k in held], type=pa.int64()), pa.array([x.tobytes() for x in held.values()], type=pa.binary())], ["y", "cell", "sums"])

    def at(weights):
        parts = rows.select("y", "x").mapInArrow(part(weights), "y int, cell long, part int, sums binary")
        # What the driver sees is bounded by the cells, which are as many as scores are wide.
        found = parts.repartition(partitions(rows.sparkSession), "y", "cell").sortWithinPartitions("y", "cell", "part").mapInArrow(add, "y int, cell long, sums binary").toArrow()
        cells = ({}, {})
        for y, c, raw in zip(*(found.column(i).to_pylist() for i in range(3)), strict=True):
            cells[y][c] = np.frombuffer(raw).reshape(NODES, -1)
        loss, gradient, hessian = pair_sums(cells[1], cells[0], d)
        return loss + RIDGE / 2 * weights @ weights, gradient + RIDGE * weights, hessian + RIDGE * np.eye(d)

    return at


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """Fit on all rows of ``labels`` (``doc_id``, ``label``) and all pairs of a good and a poor one.

    Labels that are null or not 0 or 1 are left out, and so are ids that
    ``docs`` lacks. Rows that repeat an id count once, with the means of their
    features. Rows of one label only, or none, give weights of zero: every
    score is then the sigmoid of 0, and counts as good.
    """
    d, spark = len(FEATURES), docs.sparkSession
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
    chosen = stored(chosen.distinct().withColumn("h", F.xxhash64("id")), "labels")
    bits = bloom.build(chosen, "h", bloom.block_count(chosen.count(), FILTER_BYTES))
    sent = spark.sparkContext.broadcast(bits)

    def labelled(batches):
        for batch in batches:
            own = batch.filter(pa.array(bloom.contains(sent.value, batch.column(1).to_numpy())))
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([features(t.as_py()) for t in own.column(2)], type=pa.list_(pa.float64()))], ["id", "x"])

    asked = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("h"), "text")
    found = asked.mapInArrow(labelled, f"id {asked.schema['id'].dataType.simpleString()}, x array<double>").join(chosen.select("id", "y"), "id")
    means = F.array(*(F.avg(F.col("x")[i]) for i in range(d)))
    rows = stored(found.groupBy("id", "y").agg(means.alias("x")).select("y", "x"), "labelled")
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"), *(f(F.col("x")[i]).alias(f"{f.__name__}{i}") for f in (F.avg, F.stddev_pop) for i in range(d))).first()
    poor = told["n"] - (told["good"] or 0)
    if not poor or not told["good"]:
        return {"weights": np.zeros(d), "mean": np.zeros(d), "scale": np.ones(d), "threshold": 0.0}
    mean, scale = (np.round([told[f"{f}{i}"] for i in range(d)], 12) for f in ("avg", "stddev_pop"))
    scale[scale < 1e-9] = 1.0
    at = _all_pairs(rows, mean, scale)
    w = np.zeros(d)
    loss, gradient, hessian = at(w)
    for _ in range(STEPS):  # Newton steps, halved where they lead uphill
        step = np.linalg.solve(hessian, gradient)
        if np.abs(step).max() < 1e-9:
            break
        for _ in range(STEPS):
            now = at(w - step)
            if now[0] <= loss + 1e-13:
                break
            step /= 2
        w = w - step
        loss, gradient, hessian = now
    w = np.round(w, 8)  # the order of sums does not show
    own = rows.select("x").mapInArrow(_margins(w, mean, scale), "s double")
    ends = exact.order_statistics(stored(own, "margins"), {"s": [poor - 1, poor]})["s"]
    return {"weights": w, "mean": mean, "scale": scale, "threshold": (ends[poor - 1] + ends[poor]) / 2}


def _margins(w: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    def rows(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, len(w))
            yield pa.RecordBatch.from_arrays([pa.array(margins((x - mean) / scale, w))], ["s"])

    return rows


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1, 0.5 at the threshold) of every row, from its whole text alone.

    Null, empty and blank texts have features of zero and the score that
    follows; a null id stays null, repeated rows are scored each, equal texts
    get equal scores. An empty table gives no rows; other columns are ignored.
    """
    w, mean, scale, threshold = model["weights"], model["mean"], model["scale"], model["threshold"]
    field = docs.schema[id_col]

    def rows(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(w))
            s = 1 / (1 + np.exp(-np.clip(margins((x - mean) / scale, w) - threshold, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(rows, f"`{id_col}` {field.dataType.simpleString()}, score double")


def training_labels(labels: DataFrame) -> DataFrame:
    """Labelled rows that may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """Rows of ``docs`` whose score reaches the threshold, all their columns.

    A score equal to the threshold stays. Nulls, empty texts and repeated rows
    are judged as in :func:`score`, each row by itself; an empty table gives no
    rows, and further columns are passed on whatever their names.
    """
    names = docs.columns
    w, mean, scale, threshold = model["weights"], model["mean"], model["scale"], model["threshold"]
    at = names.index("text")

    def rows(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(-1, len(w))
            keep = margins((x - mean) / scale, w) >= threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(rows, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, training_labels(table(spark, sf_dir, "labels")))
    out = score(docs, model)
    return out.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


ORACLE: dict[str, str] = {}
