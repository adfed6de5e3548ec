"""Conversation structure repair by a forward Viterbi pass over a small grammar.

The roles of a repaired conversation are ``(s?(ua)+)?``, by their initials. A
layer of the trellis is a turn; each of its four states (nothing yet, after
``s``, ``u``, ``a``) carries the cheapest edits that lead to it, as (cost, audit
string), and insertions close the layer.

A conversation of any length is cut into segments of the sorted table. A
segment's layers are run from every state it may begin in, which gives a 4 x 4
table; tables of neighbours combine by least sums, so no task needs a whole
conversation for its edits. Only what the results themselves hold whole, one
audit string and one digest a conversation, is put together in one place, from
a stream of rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tickloom.llm.common import partitions, stored, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
BLANKS = " \t\n\v\f\r"
#: Rows of a segment: audit strings grow by copying, so they are kept short until segments are combined.
SEGMENT = 512
#: What is put back together of repaired texts at once.
SENT_BYTES = 1 << 20

_TALLY = ("blank", "duplicate", "truncated", "illegal")
_REPORT = "gaps long, " + ", ".join(f"{k} long" for k in _TALLY) + ", cost long, audit string"


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``copies`` after the damage that CRC-32 of ``conv_id:turn`` modulo 20 chooses; nulls read as one space."""
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), space))
    out = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"), (F.crc32(named) % 20).alias("damage")
    ).filter("damage <> 0")
    text = F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role"))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("damage") == 3, 2).otherwise(1).cast("long").alias("copies"))


def turns(rows: DataFrame) -> DataFrame:
    """Equal rows of ``conv_id``, ``turn``, ``role``, ``text``, ``copies`` put together, with their faults and without their texts."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    ends = F.substring(bare, -1, 1)
    narrow = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("sha"), (bare == "").alias("blank"), (~ends.isin(".", "!", "?")).alias("truncated"), "copies")
    grouped = stored(narrow.groupBy("conv_id", "turn", "role", "sha", "blank", "truncated").agg(F.sum("copies").alias("copies")), "turns")
    # Only texts that come back in other turns are joined, against a stored table, so that a join with a very common one can be divided.
    again = grouped.filter("not blank").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count(F.lit(1)).alias("n"))
    again = stored(again.filter("n > 1").select("c", "r", "s", F.col("first.turn").alias("first"), F.lit(True).alias("seen")), "again")
    joined = grouped.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s")), "left")
    repeats = F.coalesce(F.col("seen"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))
    return joined.select("conv_id", "turn", "role", "sha", "copies", "blank", repeats.alias("repeats"), "truncated", F.substring("role", 1, 1).alias("initial"))


def _least(old, new):
    return new if old is None or new < old else old


def closed(layer: list) -> list:
    """The layer with insertions: a user turn, then an assistant turn. More of them come back to a state at a higher cost."""
    out = list(layer)
    for to, origins in ((AFTER_U, (START, AFTER_S, AFTER_A)), (AFTER_A, (AFTER_U,))):
        for origin in origins:
            if out[origin] is not None:
                out[to] = _least(out[to], (out[origin][0] + INSERT, out[origin][1] + "I"))
    return out


def step(layer: list, initial: str, fault: str | None) -> list:
    """The closed layer behind one more turn."""
    out = [None if x is None else (x[0] + DELETE, x[1] + "D") for x in layer]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for state, x in enumerate(layer):
            if x is None:
                continue
            to = AFTER_A if state == AFTER_U else AFTER_U
            if initial == ("a" if state == AFTER_U else "u"):
                out[to] = _least(out[to], (x[0] + KEEP + more, x[1] + "K"))
            elif initial == "s" and state == START:
                out[AFTER_S] = _least(out[AFTER_S], (x[0] + KEEP + more, x[1] + "K"))
            out[to] = _least(out[to], (x[0] + REROLE + more, x[1] + "R"))
    return closed(out)


BEGIN = closed([(0, ""), None, None, None])


def _unit() -> list:
    return [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


def combined(first: list, then: list) -> list:
    """Layers of two neighbouring runs of turns as those of one."""
    out = []
    for layer in first:
        row = [None] * 4
        for x, ways in zip(layer, then, strict=True):
            for to, y in enumerate(ways):
                if x is not None and y is not None:
                    row[to] = _least(row[to], (x[0] + y[0], x[1] + y[1]))
        out.append(row)
    return out


class Segment:
    """A run of turns of one conversation: its table of layers, and counts that neighbours can add up."""

    def __init__(self, layers: list):
        self.layers, self.rows, self.tally, self.seen = layers, 0, dict.fromkeys(_TALLY, 0), 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, initial: str, fault: str | None) -> None:
        self.layers = [step(layer, initial, fault) for layer in self.layers]
        self.rows += 1
        if fault:
            self.tally[fault] += 1
        if self.first is None:
            self.first = initial
        else:
            self.tally["illegal"] += self.last + initial not in ("su", "ua", "au")
        self.last = initial
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.seen = turn, self.seen + 1

    def then(self, other: Segment) -> Segment:
        out = Segment(combined(self.layers, other.layers))
        out.rows, out.first, out.last = self.rows + other.rows, self.first, other.last
        out.tally = {k: v + other.tally[k] for k, v in self.tally.items()}
        out.tally["illegal"] += self.last + other.first not in ("su", "ua", "au")
        out.low, out.high = (other.low if self.low is None else self.low), (self.high if other.high is None else other.high)
        out.seen = self.seen + other.seen - (self.high is not None and self.high == other.low)
        return out

    def report(self) -> tuple:
        """Gaps, counts, cost and audit of the whole conversation that this segment is."""
        (row,) = self.layers if len(self.layers) == 1 else combined([BEGIN], self.layers)
        cost, audit = min(x for x in (row[START], row[AFTER_A]) if x is not None)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.seen
        return min(gaps, (1 << 63) - 1), *self.tally.values(), cost, audit

    def packed(self) -> dict:
        flat = [x for row in self.layers for x in row]
        state = {k: getattr(self, k) for k in ("rows", "seen", "first", "last", "low", "high")}
        return state | self.tally | {"costs": [-1 if x is None else x[0] for x in flat], "audits": ["" if x is None else x[1] for x in flat]}

    @classmethod
    def unpacked(cls, state: dict) -> Segment:
        flat = [None if cost < 0 else (cost, audit) for cost, audit in zip(state["costs"], state["audits"], strict=True)]
        out = cls([flat[i : i + 4] for i in range(0, len(flat), 4)])
        for k in ("rows", "seen", "first", "last", "low", "high"):
            setattr(out, k, state[k])
        out.tally = {k: state[k] for k in _TALLY}
        return out


def _faults(copies: int, blank: bool, repeats: bool, truncated: bool):
    """Faults of equal rows: the first that applies, and duplicate for all but the first of them."""
    for i in range(copies):
        yield "blank" if blank else "duplicate" if repeats or i else "truncated" if truncated else None


_STATE = "rows long, seen long, first string, last string, low {turn}, high {turn}, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"


def segments(marked: DataFrame, longest: int = SEGMENT) -> DataFrame:
    """Segments of the conversations in ``marked`` (see :func:`turns`): ``conv_id``, the order of their first row, and ``state``."""
    kind = {c: marked.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    state = ",".join(x.replace(" ", ":") for x in _STATE.format(turn=kind["turn"]).split(", "))
    schema = f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, sha binary, state struct<{state}>"
    arrow = _arrow(schema)
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "sha")]

    def rows(batches):
        own, at, done = None, None, []
        first = True
        for batch in batches:
            for conv, turn, role, sha, copies, blank, repeats, truncated, initial in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for fault in _faults(copies, blank, repeats, truncated):
                    if own is None or at[0] != conv or own.rows >= longest:
                        same = own is not None and at[0] == conv
                        if own is not None:
                            done.append((*at, own.packed()))
                        # The conversation of a part's first row may have begun in another part, so its state is not known.
                        own, at = Segment(_unit() if first or same else [BEGIN]), (conv, turn, role, sha)
                        first = False
                    own.add(turn, initial, fault)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "turn", "role", "sha", "state"), x, strict=True)) for x in done], schema=arrow)
                done = []
        if own is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "turn", "role", "sha", "state"), (*at, own.packed()), strict=True))], schema=arrow)

    columns = ["conv_id", "turn", "role", "sha", "copies", "blank", "repeats", "truncated", "initial"]
    return marked.select(columns).repartitionByRange(partitions(marked.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(rows, schema)


def _arrow(schema: str) -> pa.Schema:
    """Of a schema in Spark's words; on the driver only."""
    return to_arrow_schema(StructType.fromDDL(schema))


def reports(cut: DataFrame) -> DataFrame:
    """``conv_id`` and the report of each conversation, from its segments in order.

    Equal numbers of segments are combined first, so that an audit string is
    copied as often as the logarithm of their number.
    """
    schema = f"conv_id {cut.schema['conv_id'].dataType.simpleString()}, {_REPORT}"
    arrow = _arrow(schema)

    def rows(batches):
        stack, conv = [], None
        names = [x.split(" ")[0] for x in schema.split(", ")]

        def whole():
            out = stack[0][1]
            for _, x in stack[1:]:
                out = out.then(x)
            return dict(zip(names, (conv, *out.report()), strict=True))

        for batch in batches:
            done = []
            for own, state in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if stack and own != conv:
                    done.append(whole())
                    stack = []
                conv = own
                stack.append((1, Segment.unpacked(state)))
                while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
                    (n, a), (_, b) = stack[-2:]
                    stack[-2:] = [(2 * n, a.then(b))]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if stack:
            yield pa.RecordBatch.from_pylist([whole()], schema=arrow)

    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "sha")]
    return cut.repartition(partitions(cut.sparkSession), "conv_id").sortWithinPartitions(*order).select("conv_id", "state").mapInArrow(rows, schema)


def repair(rows: DataFrame, ids: DataFrame | None = None, longest: int = SEGMENT) -> DataFrame:
    """Repaired conversations and their reports.

    ``rows`` has ``conv_id``, ``turn``, ``role``, ``text`` and ``copies``, none
    of the last three null; rows of a conversation are taken by turn, null turns
    first, ties by role and then by the SHA-256 of their text. A null
    ``conv_id`` is one conversation. A row's fault is the first of blank,
    duplicate (role and text seen before) and truncated. Edits cost: keep 0,
    rerole 3, delete 4, insert 3, and 3 more where a truncated row stays; of
    equally cheap edits the ASCII-least string is taken. ``ids`` names further
    conversations, which are reported without rows. An empty table gives no
    rows.

    Returns ``conv_id``, ``place`` (0: the report, then 1, 2, 3...), ``role``,
    ``text``, and ``report``, which only place 0 has; each partition has whole
    conversations in order.
    """
    found = reports(stored(segments(turns(rows), longest), "segments"))
    known = rows.select("conv_id").distinct() if ids is None else ids.select("conv_id").distinct()
    names = [x.split(" ")[0] for x in _REPORT.split(", ")]
    empty = F.struct(*(F.lit("" if k == "audit" else 0).cast("string" if k == "audit" else "long").alias(k) for k in names))
    heads = known.join(found.select(F.col("conv_id").alias("c"), F.struct(*names).alias("report")), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    heads = heads.select("conv_id", F.lit(0).alias("tag"), F.coalesce("report", empty).alias("report"))
    texts = rows.select("conv_id", F.lit(1).alias("tag"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("sha"), "text", "copies")
    both = heads.unionByName(texts, allowMissingColumns=True)
    order = [F.asc_nulls_first(c) for c in ("conv_id", "tag", "turn", "role", "sha")]
    report = "struct<" + ",".join(x.replace(" ", ":") for x in _REPORT.split(", ")) + ">"
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, role string, text string, report {report}"
    both = both.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order)
    return both.select("conv_id", "report", "role", "text", "copies").mapInArrow(_repairs(_arrow(schema)), schema)


def _repairs(arrow: pa.Schema):
    names = ("conv_id", "place", "role", "text", "report")

    def rows(batches):
        conv, ops, at, place, last, out, size = None, "", 0, 0, "", [], 0

        def put(role, text):
            nonlocal place, last, size
            place, last, size = place + 1, role[:1], size + len(text)
            out.append((conv, place, role, text, None))

        def forced():
            return "assistant" if last == "u" else "user"

        def inserted():
            nonlocal at
            while at < len(ops) and ops[at] == "I":
                put(forced(), "")
                at += 1

        def sent():
            nonlocal out, size
            batch = pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=arrow)
            out, size = [], 0
            return batch

        for batch in batches:
            for own, report, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if report is not None:
                    inserted()  # what the conversation before still lacks
                    conv, ops, at, place, last = own, report["audit"], 0, 0, ""
                    out.append((conv, 0, None, None, report))
                else:
                    for _ in range(copies):
                        inserted()
                        if ops[at] != "D":
                            put(role if ops[at] == "K" else forced(), text)
                        at += 1
                if size >= SENT_BYTES or len(out) >= 10_000:
                    yield sent()
        inserted()
        if out:
            yield sent()

    return rows


def digests(repaired: DataFrame) -> DataFrame:
    """The report of each conversation with ``repaired_sha256``, of its ``role:text`` lines; ``repaired`` as :func:`repair` returns it."""
    schema = f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, {_REPORT}, repaired_sha256 string"
    arrow = _arrow(schema)
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def rows(batches):
        conv = report = digest = None
        done = []
        for batch in batches:
            for own, place, role, text, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if report is not None:
                        done.append({"conv_id": conv, **report, "repaired_sha256": digest.hexdigest()})
                    conv, report, digest = own, head, hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=arrow).select(names)
                done = []
        if report is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, **report, "repaired_sha256": digest.hexdigest()}], schema=arrow).select(names)

    return repaired.mapInArrow(rows, schema)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "conversations")
    return digests(repair(damaged(raw), raw))


ORACLE = {
    "op11_conversations": r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
d AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(name)), lambda i: ascii(substr(name, i + 1, 1))::BIGINT)),
           lambda a, b: xor(a >> 8, tab.crc[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, tab),
x AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM d WHERE kind <> 0),
o AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM x),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'k' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM o),
v AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS s0, {'c': 1000000000::BIGINT, 'a': ''} AS s1, {'c': 3::BIGINT, 'a': 'I'} AS s2, {'c': 6::BIGINT, 'a': 'II'} AS s3 FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL
  SELECT conv_id, i, s0, s1, s2, list_min([s3, {'c': s2.c + 3, 'a': s2.a || 'I'}]) FROM (
    SELECT conv_id, i, s0, s1, list_min([s2, {'c': s0.c + 3, 'a': s0.a || 'I'}, {'c': s1.c + 3, 'a': s1.a || 'I'}, {'c': s3.c + 3, 'a': s3.a || 'I'}]) AS s2, s3 FROM (
      SELECT v.conv_id, f.i, {'c': s0.c + 4, 'a': s0.a || 'D'} AS s0,
        list_min([{'c': s1.c + 4, 'a': s1.a || 'D'}, {'c': s0.c + t + CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END, 'a': s0.a || 'K'}]) AS s1,
        list_min([{'c': s2.c + 4, 'a': s2.a || 'D'},
          {'c': s0.c + t + CASE WHEN initial = 'u' THEN 0 ELSE 1000000000 END, 'a': s0.a || 'K'}, {'c': s1.c + t + CASE WHEN initial = 'u' THEN 0 ELSE 1000000000 END, 'a': s1.a || 'K'},
          {'c': s3.c + t + CASE WHEN initial = 'u' THEN 0 ELSE 1000000000 END, 'a': s3.a || 'K'},
          {'c': s0.c + t + 3, 'a': s0.a || 'R'}, {'c': s1.c + t + 3, 'a': s1.a || 'R'}, {'c': s3.c + t + 3, 'a': s3.a || 'R'}]) AS s2,
        list_min([{'c': s3.c + 4, 'a': s3.a || 'D'}, {'c': s2.c + t + CASE WHEN initial = 'a' THEN 0 ELSE 1000000000 END, 'a': s2.a || 'K'}, {'c': s2.c + t + 3, 'a': s2.a || 'R'}]) AS s3
      FROM v JOIN (SELECT *, CASE fault WHEN 'k' THEN 0 WHEN 't' THEN 3 ELSE 1000000000 END AS t FROM f) f ON f.i = v.i + 1 AND f.conv_id IS NOT DISTINCT FROM v.conv_id))),
p AS (
  SELECT conv_id, least(s0.c, s3.c) AS cost, list_min([s0, s3]).a AS audit FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM v) WHERE back = 1),
e AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS pos, unnest(string_split(audit, '')) AS op FROM p WHERE audit <> ''),
n AS (SELECT *, count(*) FILTER (op <> 'I') OVER w AS i, count(*) FILTER (op <> 'D') OVER w AS place FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
m AS (
  SELECT n.conv_id, pos, op, place, role, text, initial, first_value(op = 'K' AND initial = 's') OVER (PARTITION BY n.conv_id ORDER BY pos) AS headed
  FROM n LEFT JOIN f ON op <> 'I' AND f.i = n.i AND f.conv_id IS NOT DISTINCT FROM n.conv_id WHERE op <> 'D'),
r AS (
  SELECT conv_id, string_agg(CASE WHEN op = 'K' THEN role WHEN (place - headed::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS body
  FROM m GROUP BY conv_id),
g AS (
  SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
}
