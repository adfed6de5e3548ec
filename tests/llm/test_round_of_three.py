"""Conversation repair, importance resampling and license scans against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tickloom.llm import conversations, importance, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, sha string, gram long, k1 long, copies long, rank long, found string"
TURNS = "conv_id long, turn long, role string, text string, copies long, sha string, tag int, state string"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3, 4, None) for i, t in rows], DOCS).repartition(3)


# Conversations


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_faults(rows):
    """Rows of one conversation in order, each with its fault."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, out = set(), []
    for _, turn, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows):
    """Cost and edits by trying all of them: 0 to 2 insertions around every turn."""
    best = {"": (0, "")}  # the roles so far, shortened to what the grammar asks: what was last, and whether anything was
    def insertions(found):
        out = dict(found)
        for _ in range(2):
            for state, (cost, audit) in list(out.items()):
                to = "a" if state == "u" else "u"
                way = (cost + 3, audit + "I")
                if to not in out or way < out[to]:
                    out[to] = way
        return out

    best = insertions(best)
    for _, role, _, fault in rows:
        nxt = {}
        for state, (cost, audit) in best.items():
            ways = [(state, cost + 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                to = "a" if state == "u" else "u"
                ways.append((to, cost + more + 3, "R"))
                if role[:1] == to or (role[:1] == "s" and state == ""):
                    ways.append((role[:1], cost + more, "K"))
            for to, c, op in ways:
                if to not in nxt or (c, audit + op) < nxt[to]:
                    nxt[to] = (c, audit + op)
        best = insertions(nxt)
    return min(best[k] for k in ("", "a") if k in best)


def plain_report(rows):
    rows = plain_faults(rows)
    counts = Counter(f for *_, f in rows)
    known = [t for t, *_ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit = cheapest(rows) if rows else (0, "")
    lines, at = [], iter(rows)
    for op in audit:
        role, text = next(at)[1:3] if op != "I" else ("", "")
        if op != "D":
            last = lines[-1][0] if lines else ""
            lines.append((role if op == "K" else "assistant" if last == "u" else "user") + ":" + text)
    initials = "".join(x[0] if x[0] != ":" else "" for x in lines)
    assert re.fullmatch("(s?(ua)+)?", initials)
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def odd_turns(seed, conversations_=60, longest=14):
    draw = random.Random(seed)
    rows = []
    for conv in [None, *range(conversations_)]:
        for turn in range(draw.randint(0, longest)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = draw.choice(["Yes.", "No!", "Why?", "cut off", "", " \t", None, f"one {turn}. ", "é.\n"])
            rows.append((conv, draw.choice([turn, turn, turn, turn // 2, None, turn * 3]), role, text))
    return rows


def test_cheapest_edits_are_the_least_of_all():
    """The trellis against every edit string of up to two insertions a place, by enumeration."""
    roles = {"user": "u", "assistant": "a", "system": "s"}
    draw = random.Random(5)
    for _ in range(60):
        rows = [(i, draw.choice(list(roles)), "x", draw.choice([None, None, "truncated", "duplicate", "blank"])) for i in range(draw.randint(0, 3))]
        found = []
        for slots in itertools.product(range(3), repeat=len(rows) + 1):
            for ops in itertools.product("DKR", repeat=len(rows)):
                audit, cost, state, good = "I" * slots[0], 3 * sum(slots), "", True
                emitted = ["*"] * slots[0]
                for (_, role, _, fault), op, n in zip(rows, ops, slots[1:], strict=True):
                    good &= op == "D" or fault not in ("blank", "duplicate")
                    cost += {"D": 4, "K": 0, "R": 3}[op] + (3 if op != "D" and fault == "truncated" else 0)
                    audit += op + "I" * n
                    emitted += ([] if op == "D" else [roles[role] if op == "K" else "*"]) + ["*"] * n
                want = ["".join(x) for x in (["s"] * (emitted[:1] == ["s"]) + ["u", "a"] * (len(emitted) // 2 + 1),)][0][: len(emitted)]
                complete = not emitted or (len(emitted) - (emitted[0] == "s")) % 2 == 0 and len(emitted) > (emitted[0] == "s")
                if good and complete and all(e in ("*", w) for e, w in zip(emitted, want, strict=True)):
                    found.append((cost, audit))
        layer = conversations.BEGIN
        for _, role, _, fault in rows:
            layer = conversations.step(layer, role[0], fault)
        assert min(x for x in (layer[0], layer[3]) if x) == min(found) == cheapest(rows)


@pytest.mark.parametrize("longest", [1, 3, 512])
def test_conversations(spark, longest):
    rows = odd_turns(longest)
    raw = spark.createDataFrame([(*r, 9, "s", 1, "x") for r in rows], TURNS).repartition(3)
    got = conversations.digests(conversations.repair(conversations.damaged(raw), raw, longest))
    by = defaultdict(list)
    for conv in {r[0] for r in rows}:
        by[conv] = []
    for r in plain_damage(rows):
        by[r[0]].append(r)
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == {k: plain_report(v) for k, v in by.items()}


def test_one_long_conversation_spans_partitions(spark):
    """A conversation with a third of the rows, and one text that it repeats again and again."""
    draw = random.Random(2)
    rows = [(0, i, draw.choice(["user", "assistant"]), draw.choice(["Same again.", f"turn {i}.", "cut"])) for i in range(4000)] + [(c, i, "user", f"{c} {i}.") for c in range(1, 900) for i in range(2)]
    rows += [(0, 7, "user", "Same again.")] * 500
    raw = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    damaged = conversations.damaged(raw)
    cut = conversations.segments(conversations.turns(damaged), 100)
    of_it = cut.filter("conv_id = 0").selectExpr("state.rows").toPandas()
    assert len(of_it) > 40 and of_it["rows"].max() <= 100
    got = conversations.digests(conversations.repair(damaged, raw, 100)).filter("conv_id = 0").first()
    assert tuple(got)[1:] == plain_report([r for r in plain_damage(rows) if r[0] == 0])


def test_repaired_rows_and_no_rows(spark):
    raw = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (2, 0, "system", "Be kind."), (2, 1, "assistant", "Hello.")], "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    got = conversations.repair(raw.withColumn("copies", F.lit(1).cast("long"))).collect()
    assert [(r.conv_id, r.place, r.role, r.text) for r in sorted(got, key=lambda r: (r.conv_id, r.place)) if r.place] == [
        (1, 1, "user", "Hi."), (1, 2, "assistant", "Still there?"), (2, 1, "system", "Be kind."), (2, 2, "user", ""), (2, 3, "assistant", "Hello."),
    ]
    empty = raw.limit(0)
    assert conversations.digests(conversations.repair(conversations.damaged(empty), empty)).count() == 0


# Importance


def plain_resample(docs, target, buckets=10_000, least=20, percent=25, seed=7):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        return words, [zlib.crc32(x.encode()) % buckets for x in words + [" ".join(p) for p in itertools.pairwise(words)]]

    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, words, f in made:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = defaultdict(list)
    for n, r in enumerate(order[: percent * len(order) // 100], 1):
        ranks[tuple(r)].append(n)
    out = []
    for r in rows:
        own = ranks.get(tuple(r)) or []
        out.append((*r[:4], own.pop(0) if own else None))
    return Counter(out)


def test_importance(spark):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Größe", "ÀB", "日本", "it's"]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n))
    docs = [(i, text(draw.choice([0, 1, 19, 20, 21, 90]))) for i in range(300)] + [(None, text(40)), (301, None), (302, ""), (303, " \n"), (304, text(20_000))]
    docs += [(400 + i, docs[7][1]) for i in range(200)] + [(5, docs[5][1])] * 3 + [(600, "x " * 30), (601, "x " * 30)]
    target = [text(30) for _ in range(20)] + [None, "", "w1 w2 w3 " * 40]
    got = importance.resample(docs_frame(spark, docs), docs_frame(spark, list(enumerate(target))))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == plain_resample(docs, target)
    few = importance.resample(docs_frame(spark, docs), docs_frame(spark, []), percent=100, min_words=1, n_buckets=16)
    assert Counter(tuple(r) for r in few.collect()) == plain_resample(docs, [], 16, 1, 100)
    assert importance.resample(docs_frame(spark, []), docs_frame(spark, [(1, "a b")])).count() == 0


def test_importance_draws_the_target(spark):
    """Documents in the target's words are drawn more often than others."""
    draw = random.Random(9)
    docs = [(i, " ".join(draw.choices([f"{'t' if i % 4 == 0 else 'o'}{j}" for j in range(80)], k=60))) for i in range(800)]
    target = [(i, " ".join(draw.choices([f"t{j}" for j in range(80)], k=60))) for i in range(50)]
    drawn = [r.doc_id for r in importance.resample(docs_frame(spark, docs), docs_frame(spark, target)).filter("rank is not null").collect()]
    assert len(drawn) == 200 and sum(i % 4 == 0 for i in drawn) > 100  # by chance: 50


# Licenses


def plain_licenses(text):
    words = WORD.findall((text or "").translate(LOWER))
    starts, base, labels, best = [], set(), set(), 0.0
    for label, phrase in licenses.BASE:
        own = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        starts += found
        base |= {label} if found else set()
    for label, notice in licenses.NOTICES:
        own = notice.split()
        hits = defaultdict(set)
        for p in range(len(own) - 2):
            for i in range(len(words) - 2):
                if words[i : i + 3] == own[p : p + 3]:
                    hits[i - p].add(p)
        island, last = [], None
        for diagonal in [*sorted(hits), None]:
            if island and (diagonal is None or diagonal - last > licenses.GAP):
                covered = {p + j for d in island for p in hits[d] for j in range(3)}
                span = max(d + p + 3 for d in island for p in hits[d]) - min(d + p for d in island for p in hits[d])
                if all(i in covered for i, w in enumerate(own) if w.isdigit()):
                    share = len(covered) / max(len(own), span)
                    best = max(best, share)
                    labels |= {label} if share >= licenses.SHARE else set()
                island = []
            if diagonal is not None:
                island, last = [*island, diagonal], diagonal
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), max(best, 1.0 if starts else 0.0)


def test_licenses(spark):
    mit, long_gpl = licenses.NOTICES[0][1], licenses.NOTICES[5][1]
    inserted = mit.split()
    inserted.insert(12, "really")
    cut = mit.split()
    del cut[15]
    texts = [
        None, "", " \n", "mit", "under the", "Released UNDER the MIT-License.", "under the mit licence", "cc by nc " * 50, "cc by nc cc by cc by nc", "Apache License, Version 2.0; apache license version 2",
        mit, mit.upper() + ".", " ".join(inserted), " ".join(cut), " ".join(mit.split()[:14]), long_gpl, long_gpl.replace("2", "3"), long_gpl.replace("version 2", "version"), "é" + mit, "日本 " + mit,
        "licensed under the GNU General Public License, version 3.", "GNU General Public License version 2", "Creative Commons Attribution NonCommercial 4.0 International", "creative commons attribution 4 0 international",
        " ".join(mit.split() * 3), " ".join(f"word{i}" for i in range(40_000)) + " under the mit license",
    ]
    docs = list(enumerate(texts)) + [(None, mit), (3, mit), (3, mit)] + [(100 + i, "See: under the MIT license") for i in range(300)]
    got = licenses.scan(docs_frame(spark, docs))
    assert Counter(tuple(r) for r in got.drop("spans").collect()) == Counter((i, *plain_licenses(t)) for i, t in docs)
    assert plain_licenses(" ".join(inserted))[5] == plain_licenses(" ".join(cut))[5] == "mit" and plain_licenses(long_gpl)[5] == "gpl-2"
    assert [s.asDict() for s in got.filter("doc_id = 5").first().spans] == [{"label": "mit", "start": 1, "stop": 5, "score": 1.0}]
    assert licenses.scan(docs_frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs_frame(spark, []), notices=[("x", "two words")])


def test_common_grams_of_copies_vote_once(spark):
    grams = licenses.text_grams(docs_frame(spark, [(i, "a under the mit license b") for i in range(500)]).selectExpr("1L k1", "2L k2", "text body"))
    found = licenses.spans(grams, licenses.template_grams(spark, licenses.BASE)).collect()
    assert [(r.template, [(v.diagonal, v.places) for v in r.votes]) for r in found] == [(0, [(1, [0, 1])])]


# Pages


@pytest.mark.parametrize("unit", ["<a", '<a "', "<", "<!", "</", "<script ", "<a =\"<a\" ", "<!--", "<a href='", "</script ", "<title", "<p class=\"", "&#", "<a <", "= ", "<div hidden "])
def test_unclosed_markup_takes_linear_time(unit):
    import time

    from tickloom.llm import html_text

    def took(size):
        began = time.thread_time()
        html_text.main_text(unit * (size // len(unit)), {"w": 1.0})
        return time.thread_time() - began

    assert took(1_000_000) < 10 * took(200_000) + 1  # in squared time 25 times


def article(body, before="", after=""):
    return f"<html><head><title>t</title></head><body><nav><a href=/x>menu</a></nav>{before}<article>{body}</article>{after}<footer>end</footer></body></html>"


def test_class_words_are_learnt_not_listed(spark, monkeypatch):
    """Adverts go by what labelled pages say, also with made-up class names and without the list."""
    from tickloom.llm import html_text

    monkeypatch.setattr(html_text, "DOUBTFUL", frozenset())
    names = ["ad", "zorp"]
    pages = [(i, article(f"<h1>head {i}</h1><p>one two three four five six seven eight nine ten {i}</p>", f'<div class="{names[i % 2]}">buy this now and more {i}</div>', f'<div id="{names[i % 2]}">last offer</div>')) for i in range(40)]
    pages += [(100 + i, article(f'<div class="story">the words of a story {i}</div>')) for i in range(5)]
    frame = spark.createDataFrame(pages, "page_id long, html string")
    weights = html_text.learn_weights(frame)
    assert weights["c.ad"] < 0 and weights["c.zorp"] < 0 < weights["c.story"]
    got = {r.page_id: r.text for r in html_text.extract(frame, weights).collect()}
    assert all(got[i] == f"head {i}\none two three four five six seven eight nine ten {i}" for i in range(40))
    real = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    learnt, held_out = (real.filter(f"page_id % 2 = {i}") for i in (0, 1))
    weights = html_text.learn_weights(learnt)
    found = html_text.extract(held_out, weights).collect()
    ads = dict(real.selectExpr("page_id", "regexp_extract(html, '<div class=.ad.>([^<]*)<', 1)").collect())
    assert sum(bool(r.text) and ads[r.page_id].split()[0:4] != r.text.split()[0:4] and ads[r.page_id] not in r.text for r in found) >= 0.98 * len(found)


def test_text_under_doubtful_names_stays():
    from tickloom.llm import html_text

    words = "a page whose text stands in one block of an odd name"
    weights = html_text.weights_from([])
    for name in ("social history", "share price", "ad hoc analysis", "notice of motion", "related-work", "comment on law"):
        assert html_text.main_text(f'<html><body><nav>menu</nav><div class="{name}"><p>{words}</p></div></body></html>', weights) == words
        assert html_text.main_text(article(f'<p>{words}</p><div class="{name}"><p>{words} {words} {words} {words} {words}</p></div>'), weights).count(words) == 6
        assert html_text.main_text(article(f'<p>{words} {words}</p><div class="{name}">small</div>'), weights) == f"{words} {words}"
    assert html_text.main_text(f'<div title="The hidden valley"><p>{words}</p></div>', weights) == words
    assert html_text.main_text(f'<div data-hidden-x=1><p>{words}</p></div><div hidden>no</div><div style="color:red; display : none">no</div>', weights) == words
    assert html_text.main_text(f"<p title=it's>{words}</p><p>it's more text</p>", weights) == f"{words}\nit's more text"


def test_markup_that_no_generator_makes():
    """Hand-made pages: quotes in attributes, unclosed elements, nesting, references, tables, comments of readers."""
    from tickloom.llm import html_text

    weights = html_text.weights_from([])
    long = "word " * 12
    for page, text in (
        (f'<p data-x="a > b">{long}</p>', long.strip()),
        (f"<P>{long}<BR/>tail<Div>block of words</dIV>after all this", f"{long.strip()} tail\nblock of words\nafter all this"),
        (f"<div>{long}<div><div>inner words of a block</div></div></div>", f"{long.strip()}\ninner words of a block"),
        (f"{long}&lt;b&gt; &amp;amp; &#x41;&#66;&nbsp;x", f"{long.strip()} <b> &amp; AB x"),
        (f"<table><tr><td>{long}<td>two of them here<tr><td>three of them here now</table>", f"{long.strip()}\ntwo of them here\nthree of them here now"),
        (f"<main><p>{long}</p><section class=comments><p>First!</p></section></main>", long.strip()),
        (f"<script>if (a < b) {{ '</p>' }}</script ><p>{long}</p><style>p{{}}", long.strip()),
        (f"<p>{long}</p><!-- a -- > b <p>no</p> -->", long.strip()),
        (f"<p>{long}</p><svg><text>no</text></svg><noscript>no</noscript>", long.strip()),
    ):
        assert html_text.main_text(page, weights) == text


# Joins and ties of earlier operators


def test_first_scores_keep_the_order_of_ties():
    import numpy as np

    from tickloom.llm import packing

    draw = np.random.default_rng(6)
    for _ in range(50):
        score = draw.integers(0, 4, 60).astype(float)
        for count in (0, 1, 7, 60):
            assert packing._first(score, count) == sorted(range(60), key=lambda i: (-score[i], i))[:count]


def test_a_node_with_a_third_of_all_links(spark):
    from tickloom.llm import components

    links = [(0, i) for i in range(1, 1500)] + [(10_000 + i, 10_001 + i) for i in range(0, 3000, 3)] + [(0, 20_000), (20_000, 20_001), (None, 3), (5, 5)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in [*range(1500), 20_000, 20_001]) and all(found[10_001 + i] == 10_000 + i for i in range(0, 3000, 3)) and len(found) == 1502 + 2000


def test_one_component_of_most_fingerprints(spark):
    from tickloom.llm import simhash

    words = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(600):
        own = list(words)
        own[i % 200] = f"x{i}"
        texts.append((i, " ".join(own)))
    texts += [(1000 + i, " ".join(f"y{i}z{j}" for j in range(50))) for i in range(50)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs_frame(spark, texts)).collect()}
    prints = {i: int(f, 16) for i, (f, _) in got.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: c for i, (_, c) in got.items()} == {i: find(i) for i in ids}


# Packing: terms of many documents at once, words cut without look-ahead


def test_heaviest_terms_equal_the_plain_definition():
    import numpy as np

    from tickloom.llm import packing

    draw = np.random.default_rng(8)
    docs = [draw.zipf(1.3, k).clip(max=300).astype("<u4") for k in draw.integers(0, 60, 700)] + [np.array([70_000, 9], dtype="<u4")] * 2
    counts = packing.Counts.of(docs)
    expected = []
    for d in docs:
        terms, tf = np.unique(d, return_counts=True)
        known = counts.df[terms] > 1
        terms, weight = terms[known], counts.weights(terms[known], tf[known], len(d))
        expected.append(([int(t) for _, t in sorted(zip(-weight, terms, strict=True))] + [-1] * 3)[:3])
    assert packing.heaviest(docs, counts).tolist() == expected


def test_terms_are_counted_in_one_pass(spark):
    import numpy as np

    from tickloom.llm import packing

    docs = [[5, 5, 7], [], [7, 70_000], [200_000], [5]]
    tokens = spark.createDataFrame([(np.array(d, dtype="<u4").tobytes(),) for d in docs], "ids binary").repartition(3)
    counts = packing.count_terms(tokens)
    assert (counts.n, counts.mean) == (4, 7 / 4)
    assert {int(t): int(counts.df[t]) for t in np.flatnonzero(counts.df)} == {5: 2, 7: 2, 70_000: 1, 200_000: 1}
    empty = packing.count_terms(tokens.limit(0))
    assert (empty.n, empty.mean, empty.df.sum()) == (0, 0, 0)


def test_words_are_cut_alike_without_look_ahead():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from tickloom.llm import tokens

    assert public_tokenizers.PATTERN.endswith(tokens.BEHIND)
    model = Tokenizer.from_file(public_tokenizers.path(tokens.ADDED))
    draw = random.Random(9)
    parts = [" ", "\n", "\t", "\r\n", "\x85", "\xa0", " ", "　", "\x1c", "\x1f", "​", "'s", "'Ve", "a", "Zürich", "日本", "12", "½", "!?", "_", "\0", "\U0001f600", "é"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(30))) for _ in range(3000)]
    texts += [draw.choice([" ", "", "\n"]) + "".join(draw.choice(parts[11:]) + draw.choice(parts[:10]) for _ in range(9)) for _ in range(2000)]
    with_added, plain = tokens.encoder(tokens.VOCABULARY, tokens.ADDED), tokens.encoder()
    for text in texts:
        ids = model.encode(text, add_special_tokens=False).ids
        assert with_added(text).tolist() == ids and plain(text).tolist() == ids, repr(text)
    marked = "a<|endoftext|>b <|unused|> c"
    assert with_added(marked).tolist() == model.encode(marked, add_special_tokens=False).ids
    assert 50256 not in plain(marked) and max(plain(marked)) < 50257
