"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other
parameters keeps its template. Windows of five template words of the benchmark
are hash-joined with those of the documents. A match counts where the slots
agree: along one alignment, every value of the item stands for one value of the
document, the one most of its slots have. Windows of equal words, whatever their
case, count always. An item is found where such windows cover enough of it.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as h

from tickloom.llm import bloom, verdicts
from tickloom.llm.common import stored, table

WINDOW, COVERAGE = 5, 0.8
#: Least share of a window's words that are words, not placeholders, in fifths: a template of slots alone says nothing.
LEXICAL = 2
#: Items that share a window from which it is joined among the items that a document may hold.
OFTEN = 64
#: Keeps hashes of windows of words apart from those of templates.
_VERBATIM = 1 << 8
FILTER_BYTES = 16 << 20
UNITS = frozenset(
    "meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres millimeter millimeters millimetre millimetres"
    " gram grams kilogram kilograms milligram milligrams gallon gallons pint pints quart quarts cup cups degree cent dollar euro euros watt watts volt volts"
    " mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs pound pounds oz ounce ounces t ton tons ml l liter liters litre litres"
    " s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent degrees dollars cents usd eur"
    " mph kmh kph hz khz mhz w kw v a c f k".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*%?")
_QUANTITY = re.compile(r"([+-]?[$€£]?\d+(?:[.,]\d+)*)([a-zA-Z°]{1,7})")
_STRIP = re.compile(r"^[\W_]+|[\W_]+$")
NUMBER, NAME, UNIT = 1, 2, 3
#: Flags of a word: kind where it opens a sentence, kind elsewhere, ends a sentence, is a unit after a number.
_BREAK = "\x00"
CACHED_WORDS = 400_000
#: Words of the benchmark that are sent to all tasks at most.
VOCABULARY = 500_000


class Canon:
    """Template words of texts: two 64-bit hashes a word (template and value), kinds and flags, cached.

    With a ``vocabulary``, lower-case words outside it that are no units share
    one row: no window that has one can match.
    """

    def __init__(self, vocabulary: frozenset[str] | None = None):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self):
        self.rows: dict[str, int] = {}
        self.fresh: list[tuple] = [(0, 0, 0, 0, False, False, False), (0, 0, 0, 0, True, False, False)]
        self.hashes = np.zeros((2, 0), dtype=np.uint64)
        self.flags = np.zeros((5, 0), dtype=np.int8)
        self.used = 0

    def settle(self):
        """Take the rows learnt since the last call into the arrays, which double when full."""
        need = self.used + len(self.fresh)
        if need > self.hashes.shape[1]:
            room = max(need, 2 * self.hashes.shape[1], 1 << 14) - self.hashes.shape[1]
            self.hashes, self.flags = np.pad(self.hashes, ((0, 0), (0, room))), np.pad(self.flags, ((0, 0), (0, room)))
        if self.fresh:
            columns = list(zip(*self.fresh, strict=True))
            self.hashes[:, self.used : need] = np.array(columns[:2], dtype=np.uint64)
            self.flags[:, self.used : need] = np.array(columns[2:], dtype=np.int8)
            self.used, self.fresh = need, []

    def learn(self, raw: str) -> int:
        known = self.vocabulary
        if known is not None and raw.isalpha() and raw.islower() and raw not in known and raw not in UNITS:
            self.rows[raw] = 0
            return 0
        if raw == _BREAK:
            row = (0, 0, 0, 0, True, False, True)
        else:
            core = raw if raw.isalpha() else _STRIP.sub("", raw)
            low = core.lower()
            ends = raw[-1] in ".!?:;" or raw[-2:-1] in (".", "!", "?")
            if not core:
                row = (0, 0, 0, 0, ends, False, True)
            elif core[0].isdigit() and (_NUMBER.fullmatch(core) or _QUANTITY.fullmatch(core)):
                row = (h(b"\x01"), h(low), NUMBER, NUMBER, ends, False, False)
            elif core[0].isupper() and core[1:].islower():
                row = (h(low), h(low), 0, NAME, ends, low in UNITS, False)
            elif known is not None and low not in known and low not in UNITS:
                self.rows[raw] = int(ends)
                return int(ends)
            else:
                row = (h(low), h(low), 0, 0, ends, low in UNITS, False)
        self.rows[raw] = at = self.used + len(self.fresh)
        self.fresh.append(row)
        return at

    def words(self, texts: list[str]):
        """Arrays over all texts together: template hash, value hash, kind, and the text's number."""
        if len(self.rows) > CACHED_WORDS:
            self.clear()
        get, learn = self.rows.get, self.learn
        split = [t.replace("\n", f" {_BREAK} ").split() for t in texts]
        index = [[i if (i := get(w)) is not None else learn(w) for w in words] for words in split]
        sizes = np.array([len(x) for x in index], dtype=np.int64)
        flat = np.concatenate([np.array(x, dtype=np.int64) for x in index]) if index else np.zeros(0, dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        self.settle()
        template, value = (c[flat] for c in self.hashes)
        opening, elsewhere, ends, unit, empty = (c[flat] for c in self.flags)
        opens = np.r_[True, (owner[1:] != owner[:-1]) | (ends[:-1] > 0)][: len(flat)]
        kind = np.where(opens, opening, elsewhere)
        kept = empty == 0
        template, value, kind, owner, unit = template[kept], value[kept], kind[kept], owner[kept], unit[kept]
        after = np.r_[False, (kind[:-1] == NUMBER) & (owner[1:] == owner[:-1])][: len(kind)]
        kind = np.where((unit > 0) & after, UNIT, kind)
        for code in (NAME, UNIT):
            template = np.where(kind == code, np.uint64(h(bytes([code]))), template)
        return template, value, kind, owner


def windows(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of each window of ``size`` words (hashes)."""
    n = max(0, len(words) - size + 1)
    mixed = np.full(n, (size + salt) * 0x9E3779B97F4A7C15 % (1 << 64), dtype=np.uint64)
    for j in range(size):
        mixed = (mixed ^ words[j : j + n]) * np.uint64(0x9FB21C651E98DF25)
        mixed ^= mixed >> np.uint64(28)
    return mixed


def judged(template: np.ndarray, kind: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window lies in one text and has no unknown word, and whether it also has words enough for a template."""
    n = len(template) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    words, unknown = np.r_[0, np.cumsum(kind == 0)], np.r_[0, np.cumsum(template == 0)]
    whole = (owner[size - 1 :] == owner[:n]) & (unknown[size:] == unknown[:-size])
    return whole, whole & ((words[size:] - words[:-size]) * WINDOW >= min(LEXICAL, size) * size)


def _slots(value, kind, at: int, size: int) -> list[str]:
    return [f"{k}:{v:016x}" for k, v in zip(kind[at : at + size].tolist(), value[at : at + size].tolist(), strict=True) if k]


_FOUND = "pos long, size int, h long, slots array<string>, lexical boolean"


def vocabulary_of(benchmark: DataFrame, most: int = VOCABULARY) -> frozenset[str] | None:
    """The benchmark's words if there are at most ``most``, else None: texts are then canonicalised word by word."""

    def found(batches):
        for batch in batches:
            words = {_STRIP.sub("", w).lower() for t in batch.column(0).to_pylist() for w in (t or "").split()}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(words), type=pa.string())], ["word"])

    words = benchmark.select("text").mapInArrow(found, "word string").distinct().limit(most + 1).toArrow().column("word").to_pylist()
    return frozenset(words) if len(words) <= most else None


def template_windows(rows: DataFrame, sizes: list[int] | None = None, bits: np.ndarray | None = None, vocabulary: frozenset[str] | None = None) -> DataFrame:
    """Windows of ``rows`` (``id``, ``text``): ``id``, ``n_words``, ``pos``, ``size``, ``h``, ``slots``, ``lexical``.

    A window of words enough (``lexical``) comes out with the hash of its
    template and its slots; every window comes out with the hash of its words
    themselves, in lower case, and null ``slots``. Without ``sizes`` a text shorter than ``WINDOW`` words is one window. With
    ``bits``, only windows that the blocked Bloom filter may hold come out.
    """
    sent = rows.sparkSession.sparkContext.broadcast((bits, vocabulary)) if bits is not None else None

    def found(batches):
        canon = Canon(sent.value[1] if sent is not None else None)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                template, value, kind, owner = canon.words([t or "" for t in part.column("text").to_pylist()])
                counts = np.bincount(owner, minlength=part.num_rows)
                out = []
                for size in sizes or range(1, WINDOW + 1):
                    whole, lexical = judged(template, kind, owner, size)
                    for mixed, ok, verbatim in ((windows(template, size), lexical, False), (windows(value, size, _VERBATIM), whole, True)):
                        if sizes is None and size < WINDOW:
                            ok = ok & (counts[owner[: len(ok)]] == size)
                        at = np.flatnonzero(ok)
                        if sent is not None:
                            at = at[bloom.contains(sent.value[0], mixed[at].view(np.int64))]
                        slots = [None if verbatim else _slots(value, kind, i, size) for i in at.tolist()]
                        out += zip(at.tolist(), [size] * len(at), mixed[at].view(np.int64).tolist(), slots, lexical[at].tolist(), strict=True)
                first = np.r_[0, np.cumsum(counts)]
                who = owner[[x[0] for x in out]] if out else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(pa.array(who)), pa.array(counts[who], type=pa.int64()), pa.array([x[0] for x in out] - first[who], type=pa.int64()), pa.array([x[1] for x in out], type=pa.int32()),
                    pa.array([x[2] for x in out], type=pa.int64()), pa.array([x[3] for x in out], type=pa.list_(pa.string())), pa.array([x[4] for x in out], type=pa.bool_()),
                ], ["id", "n_words", "pos", "size", "h", "slots", "lexical"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(found, f"id {kind}, n_words long, {_FOUND}")


def agreeing(hits: list[dict]) -> dict[int, tuple[bool, bool]]:
    """Places of the item whose windows agree along one alignment: whether they are lexical, and whether values differ.

    Every value of the item stands for the value of the document that it meets
    in most windows, for itself among equals. Windows that disagree are
    dropped; those of equal values never are.
    """
    pairs = [list(zip(w["item_slots"] or (), w["slots"] or (), strict=True)) for w in hits]
    best: dict[str, tuple] = {}
    for (i, d), n in Counter(p for own in pairs for p in own).items():
        best[i] = max(best.get(i, (0,)), (n, i == d, d))
    found: dict[int, tuple[bool, bool]] = {}
    for w, own in zip(hits, pairs, strict=True):
        changed = any(i != d for i, d in own)
        if not changed or all(best[i][2] == d for i, d in own):
            lexical, before = found.get(w["at"], (False, False))
            found[w["at"]] = (lexical or w["lexical"], before or changed)
    return found


def _agree(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            rows = [(k, at, *flags) for k, hits in enumerate(part.column("hits").to_pylist()) for at, flags in agreeing(hits).items()]
            who, at, lexical, reworded = zip(*rows, strict=True) if rows else ((), (), (), ())
            who = pa.array(who, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(who), part.column("item").take(who), pa.array(at, type=pa.int64()), pa.array(lexical, type=pa.bool_()), pa.array(reworded, type=pa.bool_())],
                ["id", "item", "at", "lexical", "reworded"],
            )


def rare_windows(items: DataFrame, need: DataFrame, coverage: float) -> DataFrame:
    """``item``, ``h``, ``size`` of windows of which a document that holds the item must have one.

    If a share of ``coverage`` of an item's places is found, so is one of any
    larger share than is left. The places whose windows the fewest items have
    are taken, among all places and among those with words enough.
    """
    places = items.groupBy("item", "item_pos").agg(F.sum("items").alias("shared"), F.max("lexical").alias("lexical")).join(need, "item")
    rank = lambda *by: F.row_number().over(Window.partitionBy("item", *by).orderBy("shared", "item_pos"))
    enough = lambda n: F.col(n) - F.ceil(F.col(n) * coverage - 1e-9) + 1
    places = places.withColumns({"k_all": rank(), "k_lexical": rank("lexical")})
    places = places.filter((F.col("k_all") <= enough("n_all")) | (F.col("lexical") & (F.col("k_lexical") <= enough("n_lexical"))))
    return places.select("item", "item_pos").join(items.select("item", "item_pos", "h", "size"), ["item", "item_pos"]).select("item", "h", "size").distinct()


def _hits(found: DataFrame, items: DataFrame, need: DataFrame, coverage: float) -> DataFrame:
    """Windows of documents with those of the items that the document may hold.

    A window that many items share is joined by the item, among the few that
    its document may hold, not with all items that have it.
    """
    pairs = stored(found.select("id", "h", "size").distinct().join(rare_windows(items, need, coverage), ["h", "size"]).select("id", "item").distinct(), "pairs")
    often = F.col("items") > OFTEN
    seldom = found.join(items.filter(~often), ["h", "size"]).join(pairs, ["id", "item"], "left_semi")
    shared = found.join(items.filter(often).select("h", "size").distinct(), ["h", "size"], "left_semi")
    shared = shared.join(pairs, "id").join(items.filter(often), ["item", "h", "size"])
    return seldom.unionByName(shared)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds.

    Returns ``id_col``, ``item_col``, ``coverage`` (share of the item's windows
    found with consistent slots or word by word: of all, or of those with words
    enough, whichever is more) and ``reworded`` (some slot values differ), for a
    coverage of ``coverage`` or more. Items without words are never found;
    null texts are empty; rows with a null id in either table are left out.
    Repeated rows of one id count as one document. Empty tables give no rows;
    other columns are ignored.
    """
    items = template_windows(benchmark.select(F.col(item_col).alias("id"), F.col(item_text).alias("text")).filter("id IS NOT NULL"))
    items = items.select(F.col("id").alias("item"), F.col("pos").alias("item_pos"), "size", "h", F.col("slots").alias("item_slots"), "lexical")
    items = stored(items.join(items.groupBy("h", "size").agg(F.count_distinct("item").alias("items")), ["h", "size"]), "items")
    lexical = F.when(F.col("lexical"), F.col("item_pos"))
    need = items.groupBy("item").agg(F.count_distinct(lexical).alias("n_lexical"), F.count_distinct("item_pos").alias("n_all"))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most WINDOW values
    bits = bloom.build(items, "h", bloom.block_count(items.count(), FILTER_BYTES))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    words = vocabulary_of(benchmark.select(F.col(item_text).alias("text")))
    found = stored(template_windows(rows, sizes or [WINDOW], bits, words).drop("lexical"), "windows")
    hits = _hits(found, items, need, coverage)
    hits = hits.withColumn("diagonal", F.col("pos") - F.col("item_pos"))
    one = F.struct(F.col("item_pos").alias("at"), "item_slots", "slots", "lexical")
    along = hits.groupBy("id", "item", "diagonal").agg(F.collect_set(one).alias("hits")).select("id", "item", "hits")
    id_type, item_type = (t.schema[c].dataType.simpleString() for t, c in ((along, "id"), (along, "item")))
    found = along.mapInArrow(_agree, f"id {id_type}, item {item_type}, at long, lexical boolean, reworded boolean")
    counts = F.count_distinct(F.when(F.col("lexical"), F.col("at"))).alias("lexical_found"), F.count_distinct("at").alias("found")
    found = found.groupBy("id", "item").agg(*counts, F.max("reworded").alias("reworded")).join(need, "item")
    # Windows of few words match only word by word: where others suffice they are not asked for.
    share = F.greatest(F.try_divide("lexical_found", "n_lexical"), F.try_divide("found", "n_all"))
    return found.filter(share >= coverage).select(F.col("id").alias(id_col), F.col("item").alias(item_col), share.alias("coverage"), "reworded")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item.

    A verdict is of a text, whatever its id: rows with a null id are judged
    like others, and other texts of a dropped id stay. Null and empty texts
    stay, repeated rows go or stay together, an empty benchmark keeps all rows
    and an empty table gives none; all columns of ``docs`` come back.
    """
    digest = F.sha2(docs[text_col], 256)
    gone = contaminated(docs.select(digest.alias("id"), F.col(text_col).alias("text")), benchmark, "id", "text").select(F.col("id").alias("sha")).distinct()
    return verdicts.without(docs, stored(gone, "contaminated"), {"sha": digest})


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE: dict[str, str] = {}
