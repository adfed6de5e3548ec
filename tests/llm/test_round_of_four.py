"""Tests of the fourth round's findings on the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tickloom.llm import near_text, quality, substring_dedup


def test_anchors_are_dealt_evenly_to_their_owners():
    send, _ = substring_dedup._exchange(32)
    text = "".join(map(chr, np.random.default_rng(3).integers(97, 123, 400_000)))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["id", "text"])
    sizes = [len(substring_dedup.rice_decode(x.as_py())) for out in send([batch]) for x in out.column("coded")]
    assert len(sizes) == 32 and max(sizes) < 1.5 * sum(sizes) / 32  # 14 times the mean before


def test_a_string_of_many_contexts_goes_to_its_bucket_once():
    class Flags:
        value = np.ones(1, dtype=bool)

    draw, n = np.random.default_rng(4), 200
    contexts = draw.integers(97, 123, (n, substring_dedup.CONTEXT), dtype=np.uint8)
    contexts[:, 5:60] = contexts[0, 5:60]  # six windows are the same in all
    contexts[:, 4] = contexts[:, 60] = np.arange(n)
    h, least = np.full(n, 77, dtype="<u8"), np.arange(100, 100 + n, dtype="<i8")
    lohi = np.tile(np.array([0, substring_dedup.CONTEXT], dtype=np.uint8), (n, 1))
    row = {"batch": pa.array([9]), **{k: pa.array([x.tobytes()], type=pa.binary()) for k, x in (("contexts", contexts), ("h", h), ("least", least), ("lohi", lohi))}}
    sent = pa.Table.from_batches(list(substring_dedup._to_buckets(1, Flags)([pa.RecordBatch.from_arrays(list(row.values()), list(row))]))).to_pandas()
    assert sum(len(x) // 8 for x in sent["h"]) == 6 + n * (substring_dedup.SPAN - 6)
    back = substring_dedup._merge(sent)
    assert len(back) == len(sent) and sum(len(x) // 4 for x in back["places"]) == n * substring_dedup.SPAN
    left = {"ids": [least.tobytes()], "keys": [least.tobytes()], "occurrences": [np.c_[np.arange(n), np.full(n, 30), np.arange(n)].astype("<i4").tobytes()]}
    spans = substring_dedup._apply(left, back).set_index("id")
    assert sorted(spans.index) == list(range(101, 100 + n))  # all but the first lose the common bytes
    assert {(tuple(a), tuple(b)) for a, b in zip(spans["starts"], spans["stops"], strict=True)} == {((5,), (60,))}


def test_quality_learns_from_all_pairs_of_all_labels(spark):
    from pyspark.sql import functions as F

    draw, n = np.random.default_rng(8), 300
    words = ["Anna", "tree,", "stone", "river!", "###", "42", "X", "be", "of."]
    texts = [" ".join(draw.choice(words, draw.integers(3, 40), p=draw.dirichlet(np.ones(len(words))))) for _ in range(n)]
    x = np.array([quality.features(t) for t in texts])
    y = (x[:, 2] + 0.3 * draw.normal(size=n) * x[:, 2].std() < np.median(x[:, 2])).astype(int)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = quality.train(docs, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int"))
    scale = x.std(0)
    z = (x - x.mean(0)) / np.where(scale < 1e-9, 1, scale)
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])  # every pair
    w = model["weights"]
    gradient = lambda w: diff.T @ (-1 / (1 + np.exp(diff @ w))) / len(diff) + quality.RIDGE * w
    assert np.abs(gradient(w)).max() < 1e-8
    assert np.abs(gradient(quality.fit_pairs(x, y)["weights"])).max() > 1e-4  # drawn pairs, as before
    assert ((np.array([(z[i] * w).sum() for i in range(n)]) < model["threshold"]).sum()) == (y == 0).sum()
    # The sums at the nodes are those of all pairs, wherever the scores lie.
    big = z @ (30 * draw.normal(size=z.shape[1]))
    loss, slope, curve = quality.pair_sums(quality.node_sums(z[y == 1], big[y == 1]), quality.node_sums(z[y == 0], big[y == 0]), z.shape[1])
    u = (big[y == 1][:, None] - big[y == 0][None]).ravel()
    p = 1 / (1 + np.exp(u))
    assert np.isclose(loss, np.logaddexp(0, -u).mean(), rtol=1e-11)
    assert np.allclose(slope, -diff.T @ p / len(u), rtol=1e-10, atol=1e-12) and np.allclose(curve, (diff * (p * (1 - p))[:, None]).T @ diff / len(u), rtol=1e-9, atol=1e-12)
    # More labels than the 20,000 that were read before.
    many = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.lit("! "), (F.col("id") % 7).cast("int")), F.col("id").cast("string")).alias("text"))
    seen = quality.train(many, many.select("doc_id", (F.col("doc_id") < 20_999).cast("int").alias("quality")))
    assert np.isclose(seen["mean"][3], np.mean([quality.features("word " + "! " * (i % 7) + str(i))[3] for i in range(21_000)]), atol=1e-11) and np.abs(seen["weights"]).max() > 0


def test_near_texts_without_a_key_in_common_are_found(spark):
    rows = []
    for i, seed in enumerate((21741, 45026)):  # of 60,000 such pairs the two that share no key
        words = [f"w{x}" for x in np.random.default_rng(seed).integers(0, 1 << 40, 72)]
        rows += [(10 * i, " ".join(words[:61])), (10 * i + 1, " ".join([*words[:50], *words[61:]])), (10 * i + 2, " ".join(words[40:]))]
        sets = [np.unique(near_text.shingles(near_text.words_of(t.encode()), near_text.WORDS)) for _, t in rows[-3:]]
        keys = [near_text.keys_of(near_text.least_values(x)) for x in sets]
        assert len(np.intersect1d(sets[0], sets[1])) == 46 >= 0.8 * 57 and not len(np.intersect1d(keys[0], keys[1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_text.keep_one(docs).collect()) == [0, 2, 10, 12]  # 1 and 11 stayed before


def test_near_sets_have_a_first_shared_shingle_in_common(spark):
    draw = np.random.default_rng(6)
    everything = np.full((1 << 6, 8), 0xFFFFFFFF, dtype=np.uint32)  # a filter that passes all: nothing is told apart
    for _ in range(2000):
        n, m = draw.integers(1, 60, 2)
        pool = draw.integers(0, 1 << 63, n + m, dtype=np.uint64)
        x, y = np.unique(pool[:n]), np.unique(np.r_[pool[: draw.integers(0, n + 1)], pool[n:]])
        if len(np.intersect1d(x, y)) >= near_text.SIMILARITY * np.sqrt(len(x) * len(y)):
            assert len(np.intersect1d(near_text.first_shared(x, everything), near_text.first_shared(y, everything)))
    texts = [(f"a{i} b{i} c{i} d{i} e{i} f{i} x y z u v w",) for i in range(50)]
    shared = {r.h for r in near_text.shared_shingles(spark.createDataFrame(texts, "text string").repartition(3)).collect()}
    assert shared == set(substring_dedup._filter_key(np.unique(near_text.shingles(b"x y z u v w".split(), near_text.WORDS)) >> np.uint64(16)).tolist())
