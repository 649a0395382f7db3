"""Conversation structure repair (12): the cheapest edits that make a conversation's roles alternate.

A dynamic program over the rows keeps, for each state of the wanted role pattern `(s?(ua)+)?`, the least
cost and its audit, the string of edits. Audits are persistent: an edit is a node linked to the one before
it, so all audits share their prefixes and a step costs a few nodes. Every node knows its ancestors at
distances of powers of two and a rolling hash of its whole string. Audits of equal cost are compared by
searching their longest common prefix with these; equal hashes are taken as equal strings only after the
linked nodes agree (most often they are the same node), and a collision falls back to the letters.

Rows are sorted by range over (conversation, turn), so a long conversation spreads over tasks and no task
holds more than its range. A conversation inside one range is finished there. One cut by a range border
is put together: the program is associative, so each range gives the best audit for every pair of entry
and exit state, and these are chained. Only the final hash of a cut conversation, which is one chain by
its nature, streams through one task, without being held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestry.llm.common import discard, table, written

BLANKS = " \t\n\x0b\x0c\r"
# States of the pattern: nothing yet, after a leading system row, after a user row, after an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
MODULUS, BASE = (1 << 61) - 1, 1_000_003
# Rows of results that go out together.
BATCH = 1000


class Edits:
    """Edit strings as linked nodes; node 0 is the empty string."""

    def __init__(self, modulus: int = MODULUS):
        self.modulus = modulus
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[]]

    def add(self, node: int, letter: str) -> int:
        """The string of `node` followed by `letter`."""
        up, at, k = [node], node, 0
        while k < len(self.up[at]):
            at = self.up[at][k]
            up.append(at)
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(letter)) % self.modulus)
        self.up.append(up)
        return len(self.letter) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while (rise := self.depth[node] - depth) > 0:
            node = self.up[node][rise.bit_length() - 1]
        return node

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(letters))

    def same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth hold one string, letter by letter down to a shared node."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of a comes before that of b."""
        if a == b:
            return False
        level = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, level), self.ancestor(b, level)
        if self.hash[x] == self.hash[y]:
            return self.depth[a] < self.depth[b] if self.same(x, y) else self.text(a) < self.text(b)
        for k in reversed(range(len(self.up[x]))):
            if k < len(self.up[x]):
                p, q = self.up[x][k], self.up[y][k]
                if self.hash[p] != self.hash[q]:
                    x, y = p, q
        if not self.same(self.up[x][0], self.up[y][0]):
            return self.text(a) < self.text(b)
        return self.letter[x] < self.letter[y]


class Repair:
    """The dynamic program from one entry state; rows are fed in order."""

    def __init__(self, entry: int = NOTHING, modulus: int = MODULUS):
        self.edits = Edits(modulus)
        self.cells: list[tuple[int, int] | None] = [None] * 4
        self.cells[entry] = (0, 0)

    def _offer(self, cells: list, state: int, source: tuple[int, int] | None, price: int, letter: str) -> None:
        if source is None:
            return
        cost, old = source[0] + price, cells[state]
        if old is not None and cost > old[0]:
            return
        node = self.edits.add(source[1], letter)
        if old is None or cost < old[0] or self.edits.less(node, old[1]):
            cells[state] = (cost, node)

    def _inserts(self) -> list:
        """The cells with rows inserted before the next row; more than two in a row never pay."""
        cells = list(self.cells)
        for state in (NOTHING, SYSTEM, ASSISTANT):
            self._offer(cells, USER, self.cells[state], INSERT, "I")
        self._offer(cells, ASSISTANT, cells[USER], INSERT, "I")
        return cells

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        now, new = self._inserts(), [None] * 4
        for state in range(4):
            self._offer(new, state, now[state], DELETE, "D")
        if not must_go:
            more = 1 if truncated else 0
            if initial == "s":
                self._offer(new, SYSTEM, now[NOTHING], KEEP + more, "K")
            for state in range(4):
                target = follows(state)
                if initial == NAMES[target][0]:
                    self._offer(new, target, now[state], KEEP + more, "K")
                self._offer(new, target, now[state], REROLE + more, "R")
        self.cells = new

    def finish(self) -> dict[int, tuple[int, str]]:
        """exit state -> least cost and its audit."""
        return {s: (c[0], self.edits.text(c[1])) for s, c in enumerate(self._inserts()) if c is not None}


def follows(state: int) -> int:
    """The state of a user or assistant row put after `state`."""
    return ASSISTANT if state == USER else USER


def fixed(audit: str, rows: Iterable[tuple[str, str]], state: int = NOTHING) -> Iterator[str]:
    """The repaired lines `role:text` of rows under an audit that starts in `state`."""
    rows = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            state = SYSTEM
        else:
            state = follows(state)
        yield f"{role if edit == 'K' else NAMES[state]}:{text}"


class Tally:
    """Counts of a run of rows, in a form that the next run's can be added to."""

    FIELDS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")

    def __init__(self):
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        one = Tally()
        one.rows, one.first, one.last = 1, initial, initial
        if turn is not None:
            one.turns, one.low, one.high = 1, turn, turn
        if fault:
            setattr(one, fault, 1)
        self.join(one)

    def join(self, other: Tally) -> None:
        """Adds the run that follows; turns rise, so only the border can share one."""
        if other.turns:
            self.turns += other.turns - (self.high == other.low)
            self.low = other.low if self.low is None else self.low
            self.high = other.high
        if other.rows:
            self.illegal += self.rows > 0 and self.last + other.first not in LEGAL
            self.first = other.first if not self.rows else self.first
            self.last = other.last
        for name in ("rows", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(other, name))

    def result(self) -> dict:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


def fault_of(text: str, seen: bool) -> str:
    """The first fault of a row, or an empty string."""
    shown = text.rstrip(BLANKS)
    if not shown:
        return "blank"
    if seen:
        return "duplicate"
    return "" if shown[-1] in ".!?" else "truncated"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage: conv_id, turn, role, text and copies (0: dropped, 2: repeated). Nulls: one space."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    text = F.coalesce("text", blank)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROW = "turn long, role string, text string, copies int, chunk int, pos long"


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in text.split(", "))])


def _batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row.get("text") or "") + len(row.get("audit") or "") + len(row.get("line") or "")
        if len(held) >= BATCH or weight > 1 << 22:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """(conv_id, rows) of each run of rows with one conv_id."""
    own, held = None, []
    for b in batches:
        names = ("conv_id", "turn", "role", "text", "copies")
        for row in zip(*[b.column(n).to_pylist() for n in names], strict=True):
            if held and row[0] != own:
                yield own, held
                held = []
            own = row[0]
            held.append(row[1:])
    if held:
        yield own, held


def _whole(conv: int | None, rows: list[tuple]) -> dict:
    """The finished row of a conversation that lies in one task."""
    tally, program, seen, lines = Tally(), Repair(), set(), []
    for turn, role, text, copies in rows:
        for _ in range(copies):
            fault = fault_of(text, (role, text) in seen)
            seen.add((role, text))
            tally.add(turn, role[:1], fault)
            program.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
            lines.append((role, text))
    ends = program.finish()
    cost, audit = min(ends[s] for s in ENDS if s in ends)
    return {
        "conv_id": conv, **tally.result(), "cost": cost, "audit": audit,
        "repaired_sha256": _digest(fixed(audit, lines)),
    }


def _digest(lines: Iterable[str]) -> str:
    own = hashlib.sha256()
    for k, line in enumerate(lines):
        own.update((("\n" if k else "") + line).encode("utf-8", "surrogatepass"))
    return own.hexdigest()


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished rows of a range's inner conversations; the rows of its first and last one as they are."""
    chunk, schema = TaskContext.get().partitionId(), _schema(f"{RESULT}, {ROW}")
    places = count()

    def left(conv: int | None, rows: list[tuple]) -> Iterator[dict]:
        for turn, role, text, copies in rows:
            yield {
                "conv_id": conv, "turn": turn, "role": role, "text": text, "copies": copies, "chunk": chunk, "pos": next(places),
            }

    def results() -> Iterator[dict]:
        before, first = None, True
        for run in _conversations(batches):
            if before is not None:
                yield from left(*before) if first else [_whole(*before)]
                first = False
            before = run
        if before is not None:
            yield from left(*before)

    yield from _batches(results(), schema)


CHUNK = "name string, conv_id long, chunk int"
COUNTS = "rows long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"
ROUTES = "array<struct<entry:int,exit:int,cost:bigint,audit:string>>"


def _chunk_routes(rows: pa.Table) -> pa.Table:
    """Counts and the best audits between all entry and exit states of a conversation's rows in one range."""
    tally, programs = Tally(), [Repair(entry) for entry in range(4)]
    rows = rows.sort_by("pos")
    for b in rows.to_batches(max_chunksize=BATCH):
        for turn, role, text, copies, new in zip(
            *[b.column(n).to_pylist() for n in ("turn", "role", "text", "copies", "new")], strict=True
        ):
            for copy in range(copies):
                fault = fault_of(text, not new or copy > 0)
                tally.add(turn, role[:1], fault)
                for p in programs:
                    p.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
    routes = [
        {"entry": entry, "exit": end, "cost": cost, "audit": audit}
        for entry, p in enumerate(programs)
        for end, (cost, audit) in p.finish().items()
    ]
    one = {n: rows[n][0].as_py() for n in ("name", "conv_id", "chunk")}
    counts = {n: getattr(tally, n) for n in Tally.FIELDS}
    route = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    schema = pa.schema([*_schema(f"{CHUNK}, {COUNTS}"), ("routes", pa.list_(route))])
    return pa.Table.from_pylist([{**one, **counts, "routes": routes}], schema)


def _chained(chunks: pa.Table) -> pa.Table:
    """A cut conversation's result, a line for each range with the part of the audit that falls to it."""
    tally = Tally()
    # state -> (cost, audit, [(chunk, entry, part)])
    best: dict[int, tuple[int, str, tuple]] = {NOTHING: (0, "", ())}
    for row in chunks.sort_by("chunk").to_pylist():
        part = Tally()
        for n in Tally.FIELDS:
            setattr(part, n, row[n])
        tally.join(part)
        new: dict[int, tuple[int, str, tuple]] = {}
        for r in row["routes"]:
            if r["entry"] not in best:
                continue
            cost, audit, parts = best[r["entry"]]
            offer = (cost + r["cost"], audit + r["audit"], (parts, (row["chunk"], r["entry"], r["audit"])))
            if r["exit"] not in new or offer[:2] < new[r["exit"]][:2]:
                new[r["exit"]] = offer
        best = new
    cost, audit, parts = min((best[s] for s in ENDS if s in best), key=lambda b: b[:2])
    one = {"name": chunks["name"][0].as_py(), "conv_id": chunks["conv_id"][0].as_py(), **tally.result(), "cost": cost}
    lines = []
    while parts:
        parts, (chunk, entry, part) = parts
        lines.append({**one, "audit": audit if not parts else None, "chunk": chunk, "entry": entry, "part": part})
    return pa.Table.from_pylist(lines, _schema(CHAINED))


CHAINED = f"name string, {RESULT.rsplit(', ', 1)[0]}, chunk int, entry int, part string"
LINE = "name string, chunk int, pos long, line string"


def _lines(rows: pa.Table, parts: pa.Table) -> pa.Table:
    """The repaired lines of a conversation's rows in one range."""
    if not rows.num_rows or not parts.num_rows:
        return _schema(LINE).empty_table()
    rows = rows.sort_by("pos")
    each = (
        (role, text)
        for b in rows.to_batches(max_chunksize=BATCH)
        for role, text, copies in zip(*[b.column(n).to_pylist() for n in ("role", "text", "copies")], strict=True)
        for _ in range(copies)
    )
    own = {"name": rows["name"][0].as_py(), "chunk": rows["chunk"][0].as_py()}
    found = fixed(parts["part"][0].as_py(), each, parts["entry"][0].as_py())
    return pa.Table.from_batches(
        list(_batches(({**own, "pos": k, "line": line} for k, line in enumerate(found)), _schema(LINE))), _schema(LINE)
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of sorted lines by name, one line at a time."""
    own, digest, found = None, None, []
    for b in batches:
        for name, line in zip(b.column("name").to_pylist(), b.column("line").to_pylist(), strict=True):
            if name != own:
                if own is not None:
                    found.append({"name": own, "repaired_sha256": digest.hexdigest()})
                own, digest = name, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode("utf-8", "surrogatepass"))
    if own is not None:
        found.append({"name": own, "repaired_sha256": digest.hexdigest()})
    if found:
        yield pa.RecordBatch.from_pylist(found, _schema("name string, repaired_sha256 string"))


def _cut(rows: DataFrame) -> DataFrame:
    """Results of the conversations at range borders."""
    spark = rows.sparkSession
    rows = rows.withColumn("name", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")))
    place = F.shiftleft(F.col("chunk").cast("long"), 40) + F.col("pos")
    digest = F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)
    # The first of equal rows is found by place, which is unique, so no key of the join is hot.
    firsts = rows.filter("copies > 0").groupBy("name", digest.alias("same")).agg(F.min(place).alias("place"))
    firsts = firsts.select("place", F.lit(True).alias("new"))
    told, told_path = written(
        rows.withColumn("place", place).join(firsts, "place", "left").withColumn("new", F.coalesce("new", F.lit(False)))
    )
    routes = told.groupBy("name", "chunk").applyInArrow(_chunk_routes, f"{CHUNK}, {COUNTS}, routes {ROUTES}")
    chained, _ = written(routes.groupBy("name").applyInArrow(_chained, CHAINED))
    parts = chained.select("name", "chunk", "entry", "part")
    lines = told.groupBy("name", "chunk").cogroup(parts.groupBy("name", "chunk")).applyInArrow(_lines, LINE)
    hashes, _ = written(
        lines.repartition("name").sortWithinPartitions("name", "chunk", "pos").mapInArrow(_stream, "name string, repaired_sha256 string")
    )
    discard(spark, told_path)
    empty = hashlib.sha256().hexdigest()
    return (
        chained.filter("audit is not null")
        .join(hashes, "name", "left")
        .withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(empty)))
        .select(*[f.split()[0] for f in RESULT.split(", ")])
    )


def repaired(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and hash of the repaired text of every conversation.

    rows: conv_id, turn, role, text (no nulls in the last two) and copies, how often the row stands
    there (0: not at all, but its conversation is still returned); other columns are ignored.
    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    Rows go by turn, nulls first; rows of one turn by role, then by text (its first 100 characters,
    then its SHA-256). Rows without conv_id are one conversation. A conversation without rows gets
    zeros, an empty audit and the hash of the empty string. An empty table gives no rows. Texts are
    read whole; a very long one takes its own length in memory.
    """
    ties = [F.substring("role", 1, 100), F.substring("text", 1, 100), F.sha2("text", 256)]
    names = ("conv_id", "turn", "role", "text", "copies")
    # The last key only spreads equal rows, which may come in any order.
    sort = ["conv_id", "turn", *[f"__{k}" for k in range(len(ties))]]
    keyed = rows.select(*names, *[t.alias(f"__{k}") for k, t in enumerate(ties)])
    ranged = keyed.withColumn("__spread", F.rand(12)).repartitionByRange(*sort, "__spread").sortWithinPartitions(*sort)
    found, _ = written(ranged.select(*names).mapInArrow(_first_pass, f"{RESULT}, {ROW}"))
    inner = found.filter("pos is null").select(*[f.split()[0] for f in RESULT.split(", ")])
    return inner.unionByName(_cut(found.filter("pos is not null").select("conv_id", *[f.split()[0] for f in ROW.split(", ")])))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(damaged(table(spark, folder, "conversations")))


def _put(x: str, price: str, letter: str, line: str | None) -> str:
    lines = f"list_append({x}.t, {line})" if line else f"{x}.t"
    return f"{{'c': {x}.c + {price}, 'a': {x}.a || '{letter}', 't': {lines}}}"


def _least(*cells: str) -> str:
    return f"list_min([{', '.join(cells)}])"


def _guarded(test: str, cell: str, other: str) -> str:
    return f"CASE WHEN {test} THEN {cell} ELSE {other} END"


def _sql() -> str:
    more = "CASE WHEN r.fault = 'truncated' THEN 1 ELSE 0 END"
    ok = "r.fault NOT IN ('blank', 'duplicate')"
    kept, first = "r.role || ':' || r.text", "r.role[1]"

    def gone(x: str) -> str:
        return _put(x, "3", "D", None)

    def into(role: str, x: str, drop: str) -> list[str]:
        keep = _guarded(f"{ok} AND {first} = '{role[0]}'", _put(x, f"{more}", "K", kept), drop)
        return [keep, _guarded(ok, _put(x, f"2 + {more}", "R", f"'{role}:' || r.text"), drop)]

    insert = {x: _put(x, "2", "I", "'user:'") for x in ("p.e", "p.s", "p.a")}
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
),
coded AS (
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(name, '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS kind
  FROM keyed
),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM rows
),
told AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS before
  FROM placed
),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n,
         {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}} AS e,
         {{'c': 1000000000, 'a': '', 't': CAST([] AS VARCHAR[])}} AS s,
         {{'c': 1000000000, 'a': '', 't': CAST([] AS VARCHAR[])}} AS u,
         {{'c': 1000000000, 'a': '', 't': CAST([] AS VARCHAR[])}} AS a
  FROM conversations
  UNION ALL
  SELECT conv_id, n, {gone("p.e")}, {_least(gone("p.s"), _guarded(f"{ok} AND {first} = 's'", _put("p.e", more, "K", kept), gone("p.s")))},
         {_least(gone("p.u"), *[c for x in ("p.e", "p.s", "p.a") for c in into("user", x, gone("p.u"))])},
         {_least(gone("p.a"), *into("assistant", "p.u", gone("p.a")))}
  FROM (
    SELECT conv_id, n, e, s, u, {_least("p.a", _put("p.u", "2", "I", "'assistant:'"))} AS a, r
    FROM (
      SELECT p.conv_id, r.n, p.e, p.s, {_least("p.u", *insert.values())} AS u, p.a, r
      FROM walk p JOIN told r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.n + 1
    ) p
  ) p
),
last AS (
  SELECT conv_id, {_least("p.e", "p.a", _put("u", "2", "I", "'assistant:'"))} AS best
  FROM (SELECT *, {_least("p.u", *insert.values())} AS u FROM (
    SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1) p) p
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (n > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM told GROUP BY conv_id
)
SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(l.best.c AS BIGINT) AS cost,
       l.best.a AS audit, sha256(array_to_string(l.best.t, chr(10))) AS repaired_sha256
FROM last l LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM l.conv_id
"""


OP12_SQL = _sql()
