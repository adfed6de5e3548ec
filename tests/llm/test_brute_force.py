"""Operators that SQL cannot express against plain versions over whole small tables."""

from __future__ import annotations

import hashlib
import random
import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import decontaminate, html_text, packing, quality, simhash, token_counts
from tickloom.llm.tokens import encoder

from test_corpus import docs_frame, exact_expected, near_expected, prose

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------- decontamination


def canonical(text):
    """(template, value, kind) of each word of a text."""
    out, opens = [], True
    for raw in (text or "").replace("\n", " \x00 ").split():
        if raw == "\x00":
            opens = True
            continue
        core = re.sub(r"^[\W_]+|[\W_]+$", "", raw)
        low, ends = core.lower(), raw[-1] in ".!?:;" or raw[-2:-1] in (".", "!", "?")
        if core:
            kind = 0
            if core[0].isdigit() and (re.fullmatch(r"\d+(?:[.,:/]\d+)*", core) or re.fullmatch(r"\d+(?:[.,]\d+)*[a-zA-Z°]{1,7}", core)):
                kind = 1
            elif core[0].isupper() and core[1:].islower() and not opens:
                kind = 2
            if low in decontaminate.UNITS and out and out[-1][2] == 1:
                kind = 3
            out.append((kind or low, low, kind))
        opens = ends
    return out


def held(docs, items, coverage=0.8):
    """(document, item, reworded) by comparing every window with every other."""
    found = set()
    read = {i: canonical(t) for i, t in items if i is not None}
    for doc in {d for d, _ in docs if d is not None}:
        texts = [canonical(t) for d, t in docs if d == doc]
        for item, words in read.items():
            size = min(5, len(words))
            if not size:
                continue
            def window(x, k):
                part = x[k : k + size]
                return tuple(w[0] for w in part), tuple(w[1] for w in part), [f"{w[2]}:{w[1]}" for w in part if w[2]], 5 * sum(not w[2] for w in part) >= min(2, size) * size
            own = [window(words, k) for k in range(len(words) - size + 1)]
            diagonals = {}
            for text in texts:
                for p in range(len(text) - size + 1):
                    template, value, slots, lexical = window(text, p)
                    for k, (t2, v2, s2, l2) in enumerate(own):
                        hits = diagonals.setdefault(p - k, [])
                        if template == t2 and lexical and l2:
                            hits.append((k, s2, slots, l2))
                        if value == v2:
                            hits.append((k, None, None, l2))
            places = {}
            for hits in diagonals.values():
                unique = [dict(zip(("at", "item_slots", "slots", "lexical"), h, strict=True)) for n, h in enumerate(hits) if h not in hits[:n]]
                for at, flags in decontaminate.agreeing(unique).items():
                    places[at] = tuple(a or b for a, b in zip(flags, places.get(at, (False, False)), strict=True))
            n_lexical, lexical = sum(x[3] for x in own), sum(x[0] for x in places.values())
            share = max(len(places) / len(own), lexical / n_lexical if n_lexical else 0)
            if share >= coverage:
                found.add((doc, item, any(x[1] for x in places.values())))
    return found


def other_values(text, draw):
    """The same question with other numbers, names and units."""
    numbers, names, units = {}, {}, {}
    def swap(m):
        w = m[0]
        if w[0].isdigit():
            return numbers.setdefault(w, str(int(w) + draw.randint(1, 90)))
        return names.setdefault(w, draw.choice(["Quentin", "Rosalind", "Thelma", "Ulrich", "Viola", "Wanda"]) if w in NAMES else w)
    text = re.sub(r"\w+", swap, text)
    return re.sub(r"(\d+) (miles|km|hours|minutes|kg|pounds)\b", lambda m: f"{m[1]} {units.setdefault(m[2], draw.choice(['feet', 'meters', 'days', 'seconds', 'tons', 'grams']))}", text)


NAMES = ("Anna", "Boris", "Clara", "David", "Edith", "Felix")


@pytest.fixture(scope="module")
def questions():
    draw = random.Random(21)
    out = []
    for i in range(40):
        words = prose(draw.randint(18, 40), 4000 + i).split()
        for k in range(3, len(words) - 2, draw.randint(5, 8)):
            words[k] = draw.choice([draw.choice(NAMES), str(draw.randint(2, 99)), f"{draw.randint(2, 99)} {draw.choice(['miles', 'km', 'hours', 'minutes', 'kg', 'pounds'])}"])
        out.append((i, " ".join(words)))
    return out


def test_decontamination_equals_brute_force(spark, questions, monkeypatch):
    draw = random.Random(22)
    shared = "Which one of these answers is right for Anna"
    items = [*questions[:20], *((100 + i, f"{shared} {t}") for i, t in questions[20:30]), (200, shared), (201, "two words"), (202, ""), (203, None), (None, "no id here at all")]
    docs = []
    for i, (_, t) in enumerate(items[:36]):
        t = t or ""
        kind = i % 5
        text = t if kind == 0 else other_values(t, draw) if kind in (1, 2) else t.upper() if kind == 3 else " ".join(t.split()[: draw.randint(3, 15)])
        docs.append((i, f"{prose(15, i)}. {text}\n{prose(9, 70 + i)}"))
    docs += [(50, " ".join(t or "" for _, t in items)), (51, None), (51, items[0][1]), (None, items[1][1]), (52, shared), (53, prose(300, 1)), (54, "")]
    expected = held(docs, items)
    table = spark.createDataFrame(items, "item_id long, text string")
    for often, words in ((64, decontaminate.vocabulary_of), (64, lambda benchmark: None), (1, decontaminate.vocabulary_of)):
        monkeypatch.setattr(decontaminate, "OFTEN", often)  # windows that many items share
        monkeypatch.setattr(decontaminate, "vocabulary_of", words)  # with and without the benchmark's words
        got = {(r.doc_id, r.item_id, r.reworded) for r in decontaminate.contaminated(docs_frame(spark, docs), table).collect()}
        assert got == expected
    assert {(50, i) for i, t in items if i is not None and t} <= {x[:2] for x in expected}


def test_recall_of_questions_with_other_values(spark, questions):
    """Numbers, names and units replaced: at least nine of ten questions are found, and no clean text is."""
    draw = random.Random(23)
    docs = [(i, f"{prose(40, 10 + i)}. {other_values(t, draw)} {prose(40, 90 + i)}") for i, t in questions] + [(1000 + i, prose(120, 6000 + i)) for i in range(60)]
    table = spark.createDataFrame(questions, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_frame(spark, docs), table).collect()}
    assert len(got & {(i, i) for i, _ in questions}) >= 0.9 * len(questions)
    assert all(d < 1000 for d, _ in got)


def test_benchmark_passages_in_documents(spark):
    """The shared tables, where documents hold items word by word."""
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    flat = lambda t: " ".join((t or "").lower().split())
    rows = [(r.doc_id, flat(r.text)) for r in docs.select("doc_id", "text").collect()]
    planted = {(d, i) for d, t in rows for i, x in items if len(flat(x).split()) >= 5 and flat(x) in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert planted and planted <= got


# -------------------------------------------------------------------- pages


class Article(HTMLParser):
    """Text blocks of the ``article`` elements of well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skipped, self.blocks = 0, [], [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("nav", "header", "footer", "aside", "form", "script", "style") or (tag == "div" and (self.skipped or "ad" in dict(attrs).get("class", "").split())):
            self.skipped.append(tag)
        if tag in html_text.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in html_text.BLOCKS:
            self.blocks.append("")
        if self.skipped and self.skipped[-1] == tag:
            self.skipped.pop()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.blocks[-1] += data


def test_pages_equal_a_plain_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages, html_text.learn_weights(pages)).collect()}
    for r in pages.collect():
        plain = Article()
        plain.feed(r.html or "")
        assert got[r.page_id] == "\n".join(x for b in plain.blocks if (x := " ".join(b.split()))), r.page_id


def test_very_long_pages_and_made_up_elements(spark):
    body = "".join(f"<p>{prose(30, i)}</p>" for i in range(300))
    made_up = "".join(f"<tag{i}>{prose(3, i)}</tag{i}>" for i in range(700))
    page = f"<html><body><nav>menu</nav><article>{body}<div>{made_up}</div></article><footer>end</footer></body></html>"
    pages = spark.createDataFrame([(1, page), (2, page)], "page_id long, html string")
    weights = html_text.learn_weights(pages)
    assert len(weights) <= 2 * len(html_text.KNOWN) + 5
    text = html_text.extract(pages, weights).first().text
    assert text.count("\n") == 300 and "menu" not in text and "end" not in text.split()


# ------------------------------------------------------------------ quality


def test_fit_is_the_least_pairwise_loss():
    draw = np.random.default_rng(4)
    x, y = draw.normal(size=(60, 3)), np.arange(60) % 2
    x[:, 0] += y
    model = quality.fit_pairs(x, y)
    z = (x - model["mean"]) / model["scale"]
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = np.random.default_rng(7)
    n = quality.PAIRS_PER_ROW * 30
    diff = z[np.resize(pairs.permutation(good), n)] - z[pairs.choice(poor, n)]
    loss = lambda w: np.log1p(np.exp(-diff @ w)).mean() + quality.RIDGE / 2 * w @ w
    w = np.zeros(3)
    for _ in range(4000):  # plain gradient descent
        w -= 0.3 * (diff.T @ (-1 / (1 + np.exp(diff @ w))) / n + quality.RIDGE * w)
    assert np.allclose(model["weights"], w, atol=1e-3) and loss(model["weights"]) <= loss(w) + 1e-9
    assert sum(z @ model["weights"] < model["threshold"]) == len(poor)


def test_quality_of_odd_rows(spark):
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (4, long), (None, "a text"), (5, "a text"), (6, "!!!! |||| " * 40)]
    docs = docs_frame(spark, rows).withColumn("score", F.lit("taken")).withColumn("x", F.lit(1))
    model = quality.train(docs, spark.createDataFrame([(4, 1), (6, 0), (4, 1)], "doc_id long, quality int"))
    got = [(r.doc_id, r.score) for r in quality.score(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    assert len({s for i, s in got if i in (1, 2, 3)}) == 1 and len({s for i, s in got if i in (None, 5)}) == 1
    assert quality.keep_good(docs, model).columns == docs.columns


# ------------------------------------------------------------------ packing


def test_packing_of_odd_rows(spark):
    rows = [(None, None), (None, ""), (7, prose(2500, 3)), (7, prose(2500, 3)), (7, "a"), *((100 + i, "same text again") for i in range(3000))]
    pieces = packing.pack(docs_frame(spark, rows)).collect()
    encode = encoder(packing.VOCABULARY, packing.ADDED)
    assert sum(p.length for p in pieces) == sum(len(encode(t or "")) + 1 for _, t in rows)
    sequences = {}
    for p in sorted(pieces, key=lambda p: p.offset):
        assert sequences.get(p.sequence_id, 0) == p.offset
        sequences[p.sequence_id] = p.offset + p.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in sequences.values())
    assert sum(n < 1024 for n in sequences.values()) <= 40  # ends of the shards


# ----------------------------------------------------------------- pipeline


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, prose(60, 1)), (None, prose(60, 1)), (None, prose(70, 2)), (9001, prose(60, 1)), (9001, prose(80, 3)), (9002, None), (9003, ""), (9004, prose(70, 2) + " end"), (9005, prose(80, 3)), (9005, prose(80, 3))]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in odd], docs.schema))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())
    plain = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    kept = spark.createDataFrame(stages["quality"](spark, docs, SF).collect(), docs.schema)
    model = quality.train(docs, quality.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    judge = lambda t: (np.array(quality.features(t)) - model["mean"]) / model["scale"] @ model["weights"] >= model["threshold"]
    assert rows(kept) == sorted((str(i), t or "") for i, t in plain(docs) if judge(t))

    first = spark.createDataFrame(stages["exact_dedup"](spark, kept, SF).collect(), docs.schema)
    keepers = {(x[1], hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()) for x, (_, t) in zip(_verdicts(plain(kept)), plain(kept), strict=True)}
    assert len(rows(first)) == len(keepers) and {(i, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()) for i, t in rows(first)} == keepers

    near = spark.createDataFrame(stages["simhash"](spark, first, SF).collect(), docs.schema)
    assert rows(near) == near_expected(plain(first))

    clean = spark.createDataFrame(stages["decontaminate"](spark, near, SF).collect(), docs.schema)
    texts = list(dict.fromkeys(t for _, t in plain(near)))
    bad = {d for d, _, _ in held(list(enumerate(texts)), items)}
    assert rows(clean) == sorted((str(i), t or "") for i, t in plain(near) if t not in {texts[d] for d in bad})

    pieces = stages["packing"](spark, clean, SF)
    encode = encoder(packing.VOCABULARY, packing.ADDED)
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(encode(t or "")) + 1 for _, t in plain(clean))


def _verdicts(rows):
    """(id, id that stays) of each row, in the order of ``rows``."""
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i))
    return [(str(i), str(min(groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")], key=lambda x: (x[0], x[1], x[2] or 0))[2])) for i, t in rows]


def test_run_gives_the_stages_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    pieces = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    assert simhash.near_groups(docs).count() == docs.count() and exact_expected([(r.doc_id, r.text) for r in docs.collect()])
    assert token_counts.END_ID
