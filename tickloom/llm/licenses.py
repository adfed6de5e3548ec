"""License scans by diagonal voting.

The hashes of all rolling word k-grams of all texts are joined with those of
the templates. A hit votes for the diagonal on which it lies, the offset
between its place in the text and in the template. Neighbouring diagonals are
merged, so that a few inserted or missing words do not part a notice, and what
they span is verified word by word in the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm import bloom
from tickloom.llm.common import stored, table
from tickloom.llm.words import PATTERN, texts_of, words_of

K = 3
#: Diagonals so close belong to one span; a label needs this share of its template's words, or of the span's if it is longer.
GAP, SHARE = 3, 0.9
FILTER_BYTES = 16 << 20
#: k-grams sent to the join at once.
SENT = 1 << 16

# Phrases that the contract names, and wordings of public licenses as lower-case words.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-3", "gnu lesser general public license version 3"),
    ("agpl-3", "gnu affero general public license version 3"),
    ("mpl-2", "mozilla public license version 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", "eclipse public license version 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "cc0 1 0 universal"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international"),
)


def grams_of(words: list[bytes]) -> np.ndarray:
    """The rolling hash of every run of ``K`` words, from 64-bit hashes of the words."""
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(0, len(each) - K + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(K):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[i : i + n]
    return out.view(np.int64)


def _keys(body):
    """Two 64-bit hashes that stand for a whole text."""
    return F.xxhash64(body).alias("k1"), F.xxhash64(body, F.lit(1)).alias("k2")


def text_grams(texts: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``at`` and ``gram`` of all k-grams of ``texts`` (``k1``, ``k2``, ``body``), at most ``SENT`` at once."""

    def rows(batches):
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            pending, size = [], 0
            for i, raw in enumerate(texts_of(batch.column(2))):
                grams = grams_of(words_of(raw))
                for a in range(0, len(grams), SENT):
                    pending.append((i, a, grams[a : a + SENT]))
                    size += len(pending[-1][2])
                    if size >= SENT:
                        yield _sent(k1, k2, pending)
                        pending, size = [], 0
            if pending:
                yield _sent(k1, k2, pending)

    return texts.mapInArrow(rows, "k1 long, k2 long, at long, gram long")


def _sent(k1, k2, pending) -> pa.RecordBatch:
    sizes = [len(g) for _, _, g in pending]
    of = np.repeat([i for i, _, _ in pending], sizes)
    at = np.concatenate([np.arange(a, a + len(g)) for _, a, g in pending])
    return pa.RecordBatch.from_arrays([pa.array(k1[of]), pa.array(k2[of]), pa.array(at), pa.array(np.concatenate([g for _, _, g in pending]))], ["k1", "k2", "at", "gram"])


def template_grams(spark: SparkSession, templates) -> DataFrame:
    """``gram``, ``template`` (its number) and ``place``; as many rows as the templates have words at most."""
    rows = [(int(g), n, i) for n, (_, text) in enumerate(templates) for i, g in enumerate(grams_of(words_of(text.encode())))]
    return spark.createDataFrame(rows, "gram long, template int, place int")


def spans(grams: DataFrame, templates: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``template`` and ``votes``: the (``diagonal``, ``places``) of merged neighbours.

    A text's copies vote once. The templates are a fixed list, so sending them
    to every task is bounded; no k-gram without a hit is moved.
    """
    hits = grams.join(F.broadcast(templates), "gram").select("k1", "k2", "template", (F.col("at") - F.col("place")).alias("diagonal"), "place").distinct()
    diagonals = hits.groupBy("k1", "k2", "template", "diagonal").agg(F.array_sort(F.collect_list("place")).alias("places"))
    order = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    far = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > GAP).cast("int"), F.lit(0))
    islands = diagonals.withColumn("far", far).withColumn("island", F.sum("far").over(order))
    return islands.groupBy("k1", "k2", "template", "island").agg(F.array_sort(F.collect_list(F.struct("diagonal", "places"))).alias("votes")).drop("island")


def verified(words: list[bytes], template: list[bytes], votes) -> tuple[list[tuple[int, list[int]]], int, int, float]:
    """Of one span: its diagonals with the places that agree word by word, start, stop, and similarity."""
    agree = []
    for diagonal, places in votes:
        held = [p for p in places if words[diagonal + p : diagonal + p + K] == template[p : p + K]]
        if held:
            agree.append((diagonal, held))
    if not agree:
        return agree, 0, 0, 0.0
    covered = {p + i for _, held in agree for p in held for i in range(K)}
    start, stop = min(d + held[0] for d, held in agree), max(d + held[-1] + K for d, held in agree)
    whole = all(i in covered for i, w in enumerate(template) if w.isdigit())  # other numbers make another license
    return agree, start, stop, len(covered) / max(len(template), stop - start) if whole else 0.0


def _judge(base, notices):
    """Findings of each text: phrases of ``base`` by their places, spans of ``notices`` by similarity."""
    templates = [(label, words_of(text.encode())) for label, text in (*base, *notices)]

    def judged(raw: bytes, found) -> tuple:
        words, starts, base_labels, labels, best, places = words_of(raw), [], set(), set(), 0.0, []
        for template, votes in found:
            label, own = templates[template]
            agree, start, stop, share = verified(words, own, votes)
            if template < len(base):
                whole = [d for d, held in agree if len(held) == len(own) - K + 1]
                starts += whole
                places += [(label, d, d + len(own), 1.0) for d in whole]
                if whole:
                    base_labels.add(label)
                    best = 1.0
            elif share >= SHARE:
                labels.add(label)
                best = max(best, share)
                places.append((label, start, stop, share))
            else:
                best = max(best, share)
        return len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels | base_labels)), best, sorted(places)

    return judged


_FOUND = "n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long,score:double>>"


def findings(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    """What the texts of ``docs`` (``k1``, ``k2``, ``body``) hold: one row for each text with a hit, by ``k1`` and ``k2``."""
    found = spans(text_grams(docs), template_grams(docs.sparkSession, (*base, *notices)))
    found = stored(found.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("template", "votes"))).alias("found")), "license-spans")
    # Texts without a hit stay where they are; of the others, one copy is verified.
    bits = bloom.build(found, "k1", bloom.block_count(found.count(), FILTER_BYTES))
    texts = bloom.probe(docs, "k1", bits).groupBy("k1", "k2").agg(F.min("body").alias("body")).join(found, ["k1", "k2"])
    judged = _judge(base, notices)

    def rows(batches):
        for batch in batches:
            for i, raw in enumerate(texts_of(batch.column(2))):
                out = judged(raw, [(x["template"], [(v["diagonal"], v["places"]) for v in x["votes"]]) for x in batch.column(3)[i].as_py()])
                out = (*out[:-1], [dict(zip(("label", "start", "stop", "score"), s, strict=True)) for s in out[-1]])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], *(pa.array([v], type=t) for v, t in zip(out, _TYPES, strict=True))], _NAMES)

    return texts.select("k1", "k2", "body", "found").mapInArrow(rows, f"k1 long, k2 long, {_FOUND}")


_NAMES = ["k1", "k2", *(x.split(" ")[0] for x in _FOUND.split(", "))]
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPAN]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """Licenses named in every row of ``docs``.

    Words are lower-cased A-Z only, places count words from 0. ``n_base``,
    ``first_word``, ``last_word`` and ``base_labels`` are of the phrases in
    ``base``, which must stand word by word. A notice's label needs ``SHARE`` of
    its words in order, with the same numbers and few words between; ``score``
    is the best similarity found, 1 for a phrase, 0 for none. Phrases and
    notices have three words at least. Null and empty texts have no words and
    no labels; repeated rows and rows with a null id are judged each; equal
    texts are verified once. An empty table gives no rows, and other columns
    are ignored.

    Returns ``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels``, ``score`` and ``spans`` (label, first word, end,
    similarity).
    """
    if short := [text for _, text in (*base, *notices) if len(words_of(text.encode())) < K]:
        raise ValueError(f"fewer than {K} words: {short}")
    body = F.coalesce(F.col(text_col), F.lit(""))
    found = stored(findings(docs.select(*_keys(body), body.alias("body")), base, notices), "licenses")

    def counted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(words_of(raw)) for raw in texts_of(batch.column(3))], type=pa.int64())], ["id", "k1", "k2", "n_words"])

    rows = docs.select(F.col(id_col).alias("id"), *_keys(body), body.alias("body")).mapInArrow(counted, f"id {docs.schema[id_col].dataType.simpleString()}, k1 long, k2 long, n_words long")
    out = rows.join(found, ["k1", "k2"], "left")
    blank, none = F.lit(""), F.array().cast(found.schema["spans"].dataType)
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", blank).alias("base_labels"), F.coalesce("labels", blank).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", none).alias("spans"),
    )


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def _values(templates) -> str:
    return ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(templates))


ORACLE = {
    "op13_licenses": rf"""
WITH t AS (SELECT n, label, string_split(body, ' ') AS words, n < {len(BASE)} AS base FROM (VALUES {_values((*BASE, *NOTICES))}) v(n, label, body)),
tg AS (SELECT n, unnest(list_transform(range(1, len(words) - {K - 2}), lambda i: array_to_string(words[i : i + {K - 1}], ' '))) AS gram, unnest(range(len(words) - {K - 1})) AS place FROM t),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}') AS words FROM documents),
dg AS (SELECT rid, unnest(list_transform(range(1, len(words) - {K - 2}), lambda i: array_to_string(words[i : i + {K - 1}], ' '))) AS gram, unnest(range(greatest(0, len(words) - {K - 1}))) AS pos FROM d),
hit AS (SELECT rid, n, pos - place AS diagonal, place FROM dg JOIN tg USING (gram)),
far AS (SELECT rid, n, diagonal, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY rid, n ORDER BY diagonal) > {GAP}, false) AS far FROM (SELECT DISTINCT rid, n, diagonal FROM hit)),
isl AS (SELECT rid, n, diagonal, sum(far::INT) OVER (PARTITION BY rid, n ORDER BY diagonal) AS island FROM far),
cov AS (SELECT rid, n, island, min(diagonal + place) AS start, max(diagonal + place + {K}) AS stop, list(place) AS places FROM hit JOIN isl USING (rid, n, diagonal) GROUP BY ALL),
sim AS (
  SELECT rid, n, label, CASE WHEN len(list_filter(range(len(words)), lambda i: regexp_full_match(words[i + 1], '[0-9]+') AND NOT list_contains(covered, i))) > 0 THEN 0
                             ELSE len(covered)::DOUBLE / greatest(len(words), stop - start) END AS share
  FROM (SELECT cov.*, list_distinct(flatten(list_transform(places, lambda p: range(p, p + {K})))) AS covered FROM cov) JOIN t USING (n) WHERE NOT base),
whole AS (SELECT rid, label, diagonal FROM hit JOIN t USING (n) WHERE base GROUP BY rid, n, label, words, diagonal HAVING count(*) = len(words) - {K - 1}),
a AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_base, min(pos) FILTER (kind = 0) AS first_word, max(pos) FILTER (kind = 0) AS last_word, max(share) AS score,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 0 OR share >= {SHARE}) AS labels
  FROM (SELECT rid, 0 AS kind, label, diagonal AS pos, 1.0::DOUBLE AS share FROM whole UNION ALL SELECT rid, 1, label, NULL, share FROM sim) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (rid)
"""
}
