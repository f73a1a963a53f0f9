"""Repair of conversations: generalised LR parsing with weighted edits.

The roles of a conversation must follow a grammar: perhaps a system turn, then user and
assistant in turn. The LR(0) automaton of the grammar is built from its rules. Reading the
rows in order, a parser keeps every stack that some edits of the rows so far lead to. The
stacks form a graph: a node is a state on top of a node, and equal ones are one node, so
stacks share what lies below. For each row a stack is shifted by keeping the row or by
giving it another role, or stays as it is when the row is deleted; between rows it is
shifted by an inserted turn. Where edits lead to equal stacks, the least (cost, audit)
stays; the audit is the string of the edits' initials.

Conversations are exchanged by ``conv_id`` and sorted, then read as a stream. A task holds
one batch of rows and, for each of the few stacks, a cost, a running hash and the audit in
pieces that the stacks share. So a conversation of a third of all rows needs one task's
time, since its hash can only be computed in order, but not its memory; nothing but the
audit, a character a row, grows with it.

Defined cases: a null role or text is one space, so a null text is blank; an empty role
has no initial and cannot be kept; a null ``turn`` comes first; rows of the same turn are
ordered by role and text; a null ``conv_id`` is a conversation; repeated rows are damaged
alike and all but the first are duplicates; other columns are not read.
"""

import functools
import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

#: The grammar of role initials; upper case is what rules define, C is the conversation.
GRAMMAR = (("C", ""), ("C", "T"), ("C", "sT"), ("T", "ua"), ("T", "Tua"))
#: Roles that a row can be given and that can be inserted, by initial.
ROLES = {"u": "user", "a": "assistant"}

# What the edits cost, and what an undeleted truncated row adds.
RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

_LEGAL_PAIRS = ("su", "ua", "au")
_CHARS = re.compile(r"[^\x20\x09-\x0D]")


class Parser:
    """The LR(0) automaton of a grammar, and the graph of its stacks.

    A stack is the number of its top node. ``shift(stack, symbol)`` gives the stacks
    that follow, each reduction made or not; ``accepts`` tells whether a stack is that of
    a whole conversation.
    """

    def __init__(self, grammar):
        self.rules = (("", grammar[0][0]), *grammar)
        self.states: dict[frozenset, int] = {}
        self.items: list[frozenset] = []
        start = self._state({(0, 0)})
        self.nodes = {(start, None): 0}
        self.tops = [(start, None)]
        self._shifts: dict[tuple[int, str], tuple[int, ...]] = {}
        self.start = self._reduced(0)

    def _state(self, items) -> int:
        items, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            ahead = self.rules[rule][1][dot : dot + 1]
            for k, (left, _) in enumerate(self.rules):
                if left and left == ahead and (k, 0) not in items:
                    items.add((k, 0))
                    todo.append((k, 0))
        found = frozenset(items)
        if found not in self.states:
            self.states[found] = len(self.items)
            self.items.append(found)
        return self.states[found]

    def _push(self, stack: int, symbol: str) -> int | None:
        state = self.tops[stack][0]
        moved = {(r, d + 1) for r, d in self.items[state] if self.rules[r][1][d : d + 1] == symbol}
        if not moved:
            return None
        node = (self._state(moved), stack)
        if node not in self.nodes:
            self.nodes[node] = len(self.tops)
            self.tops.append(node)
        return self.nodes[node]

    def _reduced(self, stack: int) -> tuple[int, ...]:
        """The stack and all that reductions make of it, without dead ends."""
        out, todo = [], [stack]
        while todo:
            stack = todo.pop()
            if stack in out:
                continue
            out.append(stack)
            for rule, dot in self.items[self.tops[stack][0]]:
                left, right = self.rules[rule]
                if left and dot == len(right):
                    below = stack
                    for _ in right:
                        below = self.tops[below][1]
                    todo.append(self._push(below, left))
        return tuple(k for k in out if self.accepts(k) or self._goes_on(k))

    def _goes_on(self, stack: int) -> bool:
        return any(d < len(self.rules[r][1]) for r, d in self.items[self.tops[stack][0]])

    def shift(self, stack: int, symbol: str) -> tuple[int, ...]:
        if (stack, symbol) not in self._shifts:
            pushed = self._push(stack, symbol)
            self._shifts[stack, symbol] = () if pushed is None else self._reduced(pushed)
        return self._shifts[stack, symbol]

    def accepts(self, stack: int) -> bool:
        return (0, 1) in self.items[self.tops[stack][0]]


@functools.cache
def _parser() -> Parser:
    return Parser(GRAMMAR)


class _Audit:
    """A string that grows at its end and shares its beginning with others."""

    PIECE = 256
    __slots__ = ("before", "piece")

    def __init__(self, before=None, piece=""):
        self.before, self.piece = before, piece

    def __add__(self, letters):
        if len(self.piece) < self.PIECE:
            return _Audit(self.before, self.piece + letters)
        return _Audit(self, letters)

    def __str__(self):
        pieces, at = [], self
        while at is not None:
            pieces.append(at.piece)
            at = at.before
        return "".join(reversed(pieces))


class Repair:
    """The cheapest repair of rows that are given one after the other.

    Audits are compared by the place that their part before the last row took among the
    others, then by the letters since: after a row no audit is the beginning of another.
    """

    def __init__(self):
        self.parser = _parser()
        self.stacks = {k: (0, 0, _Audit(), None) for k in self.parser.start}

    def _merged(self, steps, closed: bool):
        """The least ``(cost, place, letters)`` of each stack; ``steps`` are ``(cost,
        place, letters, stack, origin, output)``. If ``closed``, turns are inserted too."""
        least: dict[int, tuple] = {}
        heap = [(*s[:3], n, *s[3:]) for n, s in enumerate(steps)]
        heapq.heapify(heap)
        n = len(heap)
        while heap:
            cost, place, letters, _, stack, origin, output = heapq.heappop(heap)
            if stack in least:
                continue
            least[stack] = (cost, place, letters, origin, output)
            for symbol in ROLES if closed else ():
                for to in self.parser.shift(stack, symbol):
                    if to not in least:
                        step = (cost + INSERT, place, letters + "I", n, to, origin)
                        heapq.heappush(heap, (*step, (*output, (symbol, None))))
                        n += 1
        return least

    def _kept(self, least):
        """The stacks with audits, hashes and new places."""
        order = sorted({(v[1], v[2]) for v in least.values()})
        place = {key: k for k, key in enumerate(order)}
        old = self.stacks
        audits = {}  # equal audits are one object
        out = {}
        for stack, (cost, before, letters, origin, output) in least.items():
            key = (before, letters)
            if key not in audits:
                audits[key] = old[origin][2] + letters if letters else old[origin][2]
            out[stack] = (cost, place[key], audits[key], self._hashed(old[origin][3], output))
        return out

    @staticmethod
    def _hashed(digest, output):
        if not output:
            return digest
        separator = b"\n" if digest else b""
        digest = digest.copy() if digest else hashlib.sha256()
        for role, text in output:
            role = ROLES.get(role, role) if text is None else role
            digest.update(separator + f"{role}:{text or ''}".encode())
            separator = b"\n"
        return digest

    def _insert(self):
        steps = [(v[0], v[1], "", k, k, ()) for k, v in self.stacks.items()]
        self.stacks = self._kept(self._merged(steps, closed=True))

    def add(self, role: str, text: str, fault: str | None) -> None:
        """``fault`` is ``blank``, ``duplicate``, ``truncated`` or None."""
        before = [(v[0], v[1], "", k, k, ()) for k, v in self.stacks.items()]
        steps = []
        more = TRUNCATED if fault == "truncated" else 0
        closed = self._merged(before, closed=True)
        for stack, (cost, place, letters, origin, output) in closed.items():
            steps.append((cost + DELETE, place, letters + "D", stack, origin, output))
            if fault in ("blank", "duplicate"):
                continue
            for to in self.parser.shift(stack, role[:1]) if role else ():
                kept = (*output, (role, text))
                steps.append((cost + more, place, letters + "K", to, origin, kept))
            for symbol, name in ROLES.items():
                given = (*output, (name, text))
                for to in self.parser.shift(stack, symbol):
                    step = (cost + RE_ROLE + more, place, letters + "R", to, origin, given)
                    steps.append(step)
        self.stacks = self._kept(self._merged(steps, closed=False))

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the cheapest repair to a whole conversation."""
        self._insert()
        ends = [v for k, v in self.stacks.items() if self.parser.accepts(k)]
        cost, _, audit, digest = min(ends, key=lambda v: v[:2])
        return cost, str(audit), (digest or hashlib.sha256()).hexdigest()


def fault_of(text: str, again: bool) -> str | None:
    last = next((c for c in reversed(text) if _CHARS.match(c)), None)
    if last is None:
        return "blank"
    if again:
        return "duplicate"
    return None if last in ".!?" else "truncated"


class _Conversation:
    def __init__(self):
        self.repair = Repair()
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.gaps = 0
        self.first = self.turn = self.initial = None

    def add(self, turn, role, text, again):
        fault = fault_of(text, again)
        if fault:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in _LEGAL_PAIRS:
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None and self.turn is not None and turn > self.turn:
            self.gaps += turn - self.turn - 1
        self.turn = self.turn if turn is None else turn
        self.repair.add(role, text, fault)

    def row(self):
        return (self.gaps, *self.faults.values(), self.illegal, *self.repair.result())


COLUMNS = (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256",
)
_TYPES = [*[(T.LongType(), pa.int64())] * 6, *[(T.StringType(), pa.string())] * 2]


def _repaired(batches):
    key, now, done = None, None, []

    def out(conv_type):
        arrays = [pa.array([k for k, _ in done], conv_type)]
        for n, (_, kind) in enumerate(_TYPES):
            arrays.append(pa.array([row[n] for _, row in done], kind))
        done.clear()
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", *COLUMNS])

    conv_type = None
    for batch in batches:
        conv_type = batch.schema[0].type
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            conv_id, turn, role, text, copies, again = row
            if now is None or conv_id != key:
                if now:
                    done.append((key, now.row()))
                key, now = conv_id, _Conversation()
            for k in range(copies):
                now.add(turn, role, text, again or k > 0)
        if done:
            yield out(conv_type)
    if now:
        done.append((key, now.row()))
        yield out(conv_type)


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` of rows damaged by their key: by the rest of
    its checksum a row is dropped (no copies), emptied, left without ends of sentences,
    repeated, or given to the user."""
    key = F.concat_ws(":", _spaced("conv_id"), _spaced("turn"))
    kind = F.crc32(key.cast("binary")) % 20
    text = (
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    spaced = turns.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        _spaced("role").alias("role"),
        _spaced("text").alias("text"),
        kind.alias("kind"),
    )
    return spaced.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def repair(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``COLUMNS`` for every conversation of ``conv_id, turn, role, text``
    and perhaps ``copies``, how often a row stands there; with 0 it is not there, but its
    conversation is."""
    if "copies" not in turns.columns:
        turns = turns.select("conv_id", "turn", _spaced("role").alias("role"),
                             _spaced("text").alias("text"), F.lit(1).alias("copies"))
    turns = turns.repartition("conv_id")
    # Rows that are not there make no later one a duplicate.
    there = F.col("copies") > 0
    same = Window.partitionBy("conv_id", "role", "text", there).orderBy(F.asc_nulls_first("turn"))
    rows = turns.select(
        "conv_id", "turn", "role", "text", "copies", (F.row_number().over(same) > 1).alias("again")
    ).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again")
    schema = T.StructType([turns.schema["conv_id"]])
    for name, (kind, _) in zip(COLUMNS, _TYPES):
        schema = schema.add(name, kind)
    return rows.mapInArrow(_repaired, schema)


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _sql() -> str:
    """The same as a dynamic programme over four places in the grammar: nothing yet (b),
    after the system (s), the user (u), the assistant (a)."""

    def turn(x, role, text):
        between = f"CASE WHEN {x}.o = '' THEN '' ELSE chr(10) END"
        return f"{x}.o || {between} || {role} || ':' || {text}"

    def step(x, cost, letter, out, when="true"):
        made = f"{{'c': {x}.c + {cost}, 'w': {x}.w || '{letter}', 'o': {out}}}"
        return f"CASE WHEN {x}.c IS NOT NULL AND {when} THEN {made} END"

    def insert(x, role):
        return step(x, INSERT, "I", turn(x, f"'{role}'", "''"))

    def delete(x):
        return step(x, DELETE, "D", f"{x}.o")

    def use(x, symbol):
        more = f"CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END"
        can = "fault NOT IN ('blank', 'duplicate')"
        kept = turn(x, "role", "text")
        out = [step(x, more, "K", kept, f"{can} AND role[1] = '{symbol}'")]
        if symbol in ROLES:
            given = turn(x, f"'{ROLES[symbol]}'", "text")
            out.append(step(x, f"{RE_ROLE} + {more}", "R", given, can))
        return ", ".join(out)

    none = "CASE WHEN false THEN {'c': 0, 'w': '', 'o': ''} END"
    return f"""
WITH RECURSIVE polynomial AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), sums AS (
  SELECT keyed.*, xor(4294967295, list_reduce(
    [4294967295] || list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 20 AS kind
  FROM keyed, polynomial
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
           ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM sums WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS time,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM damaged
), judged AS (
  SELECT *, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1] AS pair,
         CASE WHEN last = '' THEN 'blank' WHEN time > 1 THEN 'duplicate'
              WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM numbered
), steps AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0, 'w': '', 'o': ''}} AS b,
         {none} AS s, {none} AS u, {none} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, {delete("b")}, least({delete("s")}, {use("b", "s")}),
         least({delete("u")}, {use("b", "u")}, {use("s", "u")}, {use("a", "u")}),
         least({delete("a")}, {use("u", "a")})
  FROM (
    SELECT conv_id, pos, role, text, fault, b, s, u, least(a, {insert("u", "assistant")}) AS a
    FROM (
      SELECT steps.conv_id, j.pos, role, text, fault, b, s, a,
             least(u, {insert("b", "user")}, {insert("s", "user")}, {insert("a", "user")}) AS u
      FROM steps JOIN judged j ON j.conv_id IS NOT DISTINCT FROM steps.conv_id
        AND j.pos = steps.pos + 1
    )
  )
), ends AS (
  SELECT conv_id, least(b, a, {insert("u", "assistant")}) AS r
  FROM (
    SELECT conv_id, b, a, least(u, {insert("s", "user")}) AS u
    FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1
  )
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, r.c::BIGINT AS cost, r.w AS audit,
       sha256(r.o) AS repaired_sha256
FROM ends e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


OP12_SQL = _sql()
