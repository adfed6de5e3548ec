"""Near-equal texts: SimHash fingerprints propose, shingles decide.

Two texts are near where their sets of five-word shingles have a cosine
similarity of 0.8 or more, the similarity that SimHash estimates. That is up to
22 differing bits of 64, too many for keys of bits. Texts are therefore
compared where the least values of some hash functions over their shingles
agree; fingerprints within these runs are held against each other by pivot
distance tables, and the shingles of what is left are counted. A long run
proposes only a tree of its pairs; if its texts are not all of one group by
then, the shingles of every other pair of it are counted too.

What keys and fingerprints overlook is found last, without chance. A text near
another one shares 0.64 of its shingles with it at least, so the rest of its
shingles and one more hold a shared one. Shingles that no other text has are
told by a coded exchange; few texts have 0.64 of the others. The first of these,
by their hash, make runs, and runs of several groups are looked at as above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import bloom, pivots, substring_dedup, verdicts
from tickloom.llm.common import partitions, stored
from tickloom.llm.components import components

WORDS, SEED, SIMILARITY = 5, 42, 0.8
#: Bits that fingerprints at the least similarity differ by: 13.1 on average, more than 22 in 3 of 1000 pairs.
RADIUS = 22
#: Bits that pairs of a short run may differ by: ten standard deviations more than the average at the least similarity.
WIDE = 45
#: Least values that make a key, and disjoint keys that all of them make.
BANDS, ROWS = 14, 3
#: Three sets of such keys over the same values, any two keys of which share one value at most: at a similarity of 0.8 a pair has no key in common in 1 to 3 of 10,000 cases.
SHIFTS = ((0, 0), (1, 2), (3, 7))
#: Longer runs of a key, as of texts that share a passage, are divided by MORE further keys of two least values each.
LONG_RUN, MORE = 4096, 8
FILTER_BYTES = 16 << 20
#: Shingles of a run that one task holds; longer runs are looked at by pairs of blocks.
RUN_BYTES = 16 << 20
#: Shingles that are coded at once, and text whose shingles one owner decodes on average.
MESSAGE_KEYS, OWNER_TEXT = 1 << 20, 8 << 20
#: Least share of its shingles that a text has in common with a near one.
COMMON = SIMILARITY**2
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS + 2 * MORE, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def words_of(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text, A-Z in lower case."""
    return raw.translate(_LOWER).split()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included; fewer words are one shingle, none are none."""
    from xxhash import xxh64_intdigest

    text = b" ".join(words)
    if len(words) < size:
        return np.array([xxh64_intdigest(text, SEED)] if words else [], dtype=np.uint64)
    width = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stop = np.cumsum(width + 1) - 1
    start = (stop - width)[: len(words) - size + 1].tolist()
    return np.array([xxh64_intdigest(text[a:b], SEED) for a, b in zip(start, stop[size - 1 :].tolist(), strict=True)], dtype=np.uint64)


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash: a bit is set if it is in over half of the hashes; zero without any."""
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a text's shingles."""
    out = np.full(len(_ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    mixed = hashes ^ (hashes >> np.uint64(31))
    for a in range(0, len(mixed), 4096):
        part = mixed[None, a : a + 4096] * _ODD[:, None]
        out = np.minimum(out, (part ^ part >> np.uint64(29)).min(axis=1))
    return out


def _joined(values: np.ndarray, size: int, salt: int) -> np.ndarray:
    """One 64-bit key for each ``size`` values."""
    out = np.arange(salt, salt + len(values) // size, dtype=np.uint64)
    for column in values.reshape(-1, size).T:
        out = (out ^ column) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(28)
    return out.view(np.int64)


def keys_of(least: np.ndarray) -> np.ndarray:
    """The keys of a text from its least values."""
    values = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    turned = (np.column_stack([values[:, 0], np.roll(values[:, 1], -a), np.roll(values[:, 2], -b)]) for a, b in SHIFTS)
    return np.concatenate([_joined(x.ravel(), ROWS, 1 + BANDS * i) for i, x in enumerate(turned)])


_SIGNED = "fp long, keys array<long>, more array<long>"


def signed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` replaced by ``node`` (digest of its words), fingerprint, keys and further keys."""
    kept = [f for f in rows.schema.fields if f.name != "text"]

    def found(batches):
        from hashlib import blake2b

        for batch in batches:
            node, fp, keys, more = [], [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                hashes = shingles(words, WORDS)
                least = least_values(hashes)
                node.append(blake2b(b" ".join(words), digest_size=16).digest())
                fp.append(fingerprint_of(hashes))
                keys.append(keys_of(least) if words else [])
                more.append(_joined(least[BANDS * ROWS :], 2, 1000) if words else [])
            columns = [pa.array(node, type=pa.binary()), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), *(pa.array(x, type=pa.list_(pa.int64())) for x in (keys, more))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *columns], [*(f.name for f in kept), "node", "fp", "keys", "more"])

    return rows.mapInArrow(found, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "node binary", _SIGNED]))


def _pairs(longest: int | None):
    """Proposed pairs of sorted runs, and the members of long runs (``b`` null, with ``key``)."""

    def rows(batches):
        def out(a, b, key):
            return pa.RecordBatch.from_arrays([pa.array(a, type=pa.binary()), pa.array(b, type=pa.binary()), pa.array(key, type=pa.int64())], ["a", "b", "key"])

        for (keys, fps, nodes), part_of_long in pivots.whole_runs(batches, longest):
            if part_of_long:
                yield out(nodes.tolist(), [None] * len(nodes), keys)
                continue
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            size = np.diff(np.r_[first, len(keys)])
            size = np.repeat(size, size)
            long = size > min(pivots.SHORT_RUN, longest or pivots.SHORT_RUN)
            for at in range(0, int(long.sum()), 1 << 16):
                part = np.flatnonzero(long)[at : at + (1 << 16)]
                yield out(nodes[part].tolist(), [None] * len(part), keys[part])
            if longest is not None:
                keys, fps, nodes = (x[size <= longest] for x in (keys, fps, nodes))
            i, j = pivots.near_in_runs(keys, fps.view(np.uint64), RADIUS, WIDE)
            for at in range(0, len(i), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield out(nodes[i[part]].tolist(), nodes[j[part]].tolist(), np.zeros(len(i[part]), dtype=np.int64))

    return rows


def _in_runs(keyed: DataFrame, longest: int | None) -> DataFrame:
    n = partitions(keyed.sparkSession)
    return keyed.select("key", "fp", "node").repartition(n, "key").sortWithinPartitions("key", "fp", "node").mapInArrow(_pairs(longest), "a binary, b binary, key long")


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (``a``, ``b``) of ``nodes`` (``node``, ``fp``, ``keys``, ``more``) that share a key and are near by their fingerprints, and the members (``run``, ``node``) of long runs, of which the pairs are a part only."""
    first = stored(_in_runs(nodes.select(F.explode("keys").alias("key"), "fp", "node"), LONG_RUN), "pairs")
    members = first.filter("b IS NULL").select("key", F.col("a").alias("node"))
    sizes = stored(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "run-sizes")
    members = stored(members.join(sizes, "key"), "members")
    long = members.filter(F.col("n") > LONG_RUN).select("key", "node")
    again = long.join(nodes.select("node", "fp", "more"), "node").select(F.col("key").alias("run"), F.explode("more").alias("value"), "fp", "node")
    second = stored(_in_runs(again.withColumn("key", F.xxhash64("run", "value")), None), "pairs")
    pairs = first.unionByName(second).filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    runs = members.filter(F.col("n") <= LONG_RUN).select(F.col("key").alias("run"), "node").unionByName(second.filter("b IS NULL").select(F.col("key").alias("run"), F.col("a").alias("node")))
    return pairs.distinct(), runs


def _similar(batches):
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= SIMILARITY * np.sqrt(len(x) * len(y)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))


def _grams(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            grams = [np.unique(shingles(words_of(t.as_buffer().to_pybytes()), WORDS)).tobytes() for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(grams, type=pa.binary())], ["node", "grams"])


def grams_of(asked: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Shingle sets (``grams``) of the ``asked`` nodes; ``nodes`` has the ``sha`` of one text of each node, ``rows`` has ``sha`` and ``text``."""
    asked = stored(asked.distinct().join(nodes.select("node", "sha"), "node"), "asked")
    bits = bloom.build(asked.select(F.xxhash64("sha").alias("h")), "h", bloom.block_count(asked.count(), FILTER_BYTES))
    texts = bloom.probe(rows.select("sha", "text", F.xxhash64("sha").alias("h")), "h", bits).join(asked, "sha").select("node", "text")
    # One text a node before the shuffle, shingles behind it: no task has Python workers for both the filter and the shingles.
    return stored(texts.dropDuplicates(["node"]).mapInArrow(_grams, "node binary, grams binary"), "grams")


def verified(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """``pairs`` whose shingles are similar enough."""
    sets = lambda c: grams.select(F.col("node").alias(c), F.col("grams").alias(f"grams_{c}"))
    return pairs.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", "grams_a", "grams_b").mapInArrow(_similar, "a binary, b binary")


def links_between(group: np.ndarray, grams: list[np.ndarray]) -> list[tuple[int, int]]:
    """Similar pairs of texts (places), enough to connect all texts that similar pairs connect; texts of one ``group`` are connected before."""
    size = np.array([len(x) for x in grams], dtype=np.int64)
    _, ids = np.unique(np.concatenate(grams), return_inverse=True)
    stop = np.cumsum(size)
    start, group, links = stop - size, group.copy(), []
    seen = np.zeros(int(ids.max()) + 1, dtype=bool)
    rest = np.arange(len(grams))  # the texts that are still compared, in order
    flat = ids
    for x in range(len(grams)):
        if len(rest) > 64 and x > rest[len(rest) // 2]:  # those behind x only
            rest = rest[rest > x]
            flat = ids[start[rest[0]] :] if len(rest) else ids[:0]
        other = rest[(rest > x) & (group[rest] != group[x])]
        other = other[np.minimum(size[other], size[x]) >= SIMILARITY**2 * np.maximum(size[other], size[x]) - 1e-9 * size[x]]
        if not len(other):
            continue
        seen[ids[start[x] : stop[x]]] = True
        base = len(ids) - len(flat)
        hits = np.concatenate([[0], np.cumsum(seen[flat])])
        both = hits[stop[other] - base] - hits[start[other] - base]
        seen[ids[start[x] : stop[x]]] = False
        for y in other[both >= SIMILARITY * np.sqrt(size[x] * size[other])].tolist():
            if group[y] != group[x]:
                links.append((x, y))
                group[group == group[y]] = group[x]
    return links


def _links(batches):
    for keys, roots, nodes, grams in (c for c, _ in pivots.whole_runs(batches)):
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
            sets = [np.frombuffer(x, dtype=np.uint64) for x in grams[a:b]]
            found = links_between(np.unique(roots[a:b], return_inverse=True)[1], sets)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[a + x] for x, _ in found], type=pa.binary()), pa.array([nodes[a + y] for _, y in found], type=pa.binary())], ["a", "b"])


def missed(runs: DataFrame, roots: DataFrame, grams: DataFrame) -> DataFrame:
    """Similar pairs of long runs (``run``, ``node``) that connect what ``roots`` (``node``, ``root``) leaves apart.

    Runs of one group are done; of runs with the same members one is looked at.
    Where the shingles of a run are more than a task should hold, its members
    are dealt to blocks and every pair of blocks is looked at.
    """
    spark = runs.sparkSession
    named = runs.join(roots, "node", "left").select("run", "node", F.xxhash64(F.coalesce("root", "node")).alias("root"))
    named = stored(named.join(grams.select("node", F.length("grams").alias("bytes")), "node"), "run-members")
    told = named.groupBy("run").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.sum("bytes").alias("bytes"))
    chosen = stored(told.filter("lo <> hi").groupBy("n", "x", "y").agg(F.min("run").alias("run"), F.max("bytes").alias("all")), "mixed-runs")
    blocks = F.ceil(F.col("all") / RUN_BYTES).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (j != F.col("own")) | (F.col("blocks") == 1))
    dealt = named.join(chosen.select("run", blocks.alias("blocks")), "run").withColumn("own", own).select("run", "root", "node", "own", F.explode(others).alias("other"))
    dealt = dealt.select(F.xxhash64("run", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "root", "node")
    rows = dealt.join(grams, "node").select("key", "root", "node", "grams")
    return rows.repartition(partitions(spark), "key").sortWithinPartitions("key", "node").mapInArrow(_links, "a binary, b binary")


def shared_shingles(rows: DataFrame) -> DataFrame:
    """Filter keys (``h``) of the shingles that two or more of ``rows`` (``text``) have."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_owners = max(partitions(rows.sparkSession), size // OWNER_TEXT + 1)
    width = np.uint64((1 << 48) // n_owners + 1)
    _, receive = substring_dedup._exchange(n_owners)

    def send(batches):
        held, n = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(np.unique(shingles(words_of(text.as_buffer().to_pybytes()), WORDS) >> np.uint64(16)))
                n += len(held[-1])
                if n >= MESSAGE_KEYS:
                    yield substring_dedup.messages(np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held]), width)
                    held, n = [], 0
        if n:
            yield substring_dedup.messages(np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held]), width)

    return rows.select("text").mapInArrow(send, "owner long, coded binary, many binary").groupBy("owner").applyInPandas(receive, "h long")


def first_shared(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Of sorted distinct shingles those that a near text has one of: the first of the shared ones; none if too few are shared."""
    shared = hashes[bloom.contains(bits, substring_dedup._filter_key(hashes >> np.uint64(16)))]
    least = int(np.ceil(COMMON * len(hashes) - 1e-6))
    return shared[: max(0, len(shared) - least + 1)]


def common_runs(rows: DataFrame) -> DataFrame:
    """Runs (``run``, ``node``) of the texts of ``rows`` (``text``) such that near texts have a run in common."""
    shared = stored(shared_shingles(rows), "shared")
    sent = rows.sparkSession.sparkContext.broadcast(bloom.build(shared, "h", bloom.block_count(shared.count(), FILTER_BYTES)))

    def found(batches):
        from hashlib import blake2b

        for batch in batches:
            node, runs = [], []
            for text in batch.column(0):
                words = words_of(text.as_buffer().to_pybytes())
                own = first_shared(np.unique(shingles(words, WORDS)), sent.value)
                if len(own):
                    node.append(blake2b(b" ".join(words), digest_size=16).digest())
                    runs.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(node, type=pa.binary()), pa.array(runs, type=pa.list_(pa.int64()))], ["node", "runs"])

    found = stored(rows.select("text").mapInArrow(found, "node binary, runs array<long>").dropDuplicates(["node"]), "first-shared")
    return found.select(F.explode("runs").alias("run"), "node")


def overlooked(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Near pairs that connect what ``roots`` (``node``, ``root``) leaves apart, from :func:`common_runs`."""
    runs = common_runs(rows).join(roots, "node", "left").select("run", "node", F.xxhash64(F.coalesce("root", "node")).alias("root"))
    runs = stored(runs, "common-runs")
    mixed = runs.groupBy("run").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("run")
    runs = stored(runs.join(stored(mixed, "mixed"), "run").select("run", "node"), "open-runs")
    return stored(missed(runs, roots, grams_of(runs.select("node"), nodes, rows)), "overlooked")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-equal texts, the smallest id.

    Groups are what links of near texts connect. Texts are whole; words are
    ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case; a text of fewer than five words
    is one shingle, and texts without words are all equal. A null id is larger
    than any other, among equal ids the smallest SHA-256 of the text stays; of
    rows that repeat both, one stays. Other texts of a dropped id stay. An
    empty table gives no rows; all columns of ``docs`` come back.
    """
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    rows = docs.select(F.col(id_col).alias("id"), sha.alias("sha"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = stored(signed(rows), "signed")
    own = F.struct(F.col("id").isNull().alias("missing"), "id", "sha")
    # Rows of one node have equal fingerprints and keys.
    nodes = prints.groupBy("node").agg(F.min(own).alias("best"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("fp", "keys", "more")))
    nodes = stored(nodes.select("node", "best", F.col("best.sha").alias("sha"), "n", "fp", "keys", "more"), "nodes")
    pairs, runs = candidates(nodes)
    pairs, runs = stored(pairs, "candidates"), stored(runs, "runs")
    grams = grams_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(runs.select("node")), nodes, rows.select("sha", "text"))
    similar = stored(verified(pairs, grams), "similar")
    roots = components(similar)
    more = stored(missed(runs, roots, grams), "missed")
    if more.take(1):
        similar = similar.unionByName(more)
        roots = components(similar)
    more = overlooked(rows.select("sha", "text"), nodes, roots)
    if more.take(1):
        roots = components(similar.unionByName(more))
    linked = nodes.select("node", "best", "n").join(roots, "node", "left").filter("root IS NOT NULL OR n > 1")
    linked = stored(linked.select("node", "best", F.coalesce("root", "node").alias("root")), "linked")
    best = stored(linked.groupBy("root").agg(F.min("best").alias("stays")), "stays")  # written, so that a large group is divided
    judged = prints.select("id", "sha", "node").join(linked.select("node", "root").join(best, "root"), "node")
    kept = F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("sha") == F.col("stays.sha"))
    named = judged.groupBy("id", "sha").agg(F.first(kept).alias("kept"), (F.count(F.lit(1)) > 1).alias("many"))
    return verdicts.settle(docs, stored(named, "verdicts"), {"id": docs[id_col], "sha": sha})
