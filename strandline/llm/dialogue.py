"""Repair of damaged conversations by the cheapest edits.

The roles that are left have to read as an optional system turn and then pairs of user and assistant, or
nothing. Going backward over the turns, a table holds for every turn and state of that grammar the least
cost to the end; going forward, each step takes the first edit by letter among those on which that cost
is tight. As a state names the next role, the letters fix the repaired turns, which are then hashed.

Turns are dealt out by ranges of conversation and turn, so one conversation may lie in many partitions.
Such a block of turns is summed up by the least costs between its states (a four by four table); these
are folded from the last block to the first, and each block then walks its own turns. What the driver
gathers of them is at most two rows for each partition.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, table

# Blanks, ends of sentences, and what edits cost.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant. The state that a turn put there leads to, and its role.
NEXT, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: The state that a kept turn leads to, by its role's first letter; others can't be kept there.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
FAR = float("inf")
END = (0, 4, 2, 0)
#: Bytes of repaired text in a piece of a conversation that lies in several partitions, at least.
PIECE = 1 << 20


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): turns with nulls as one space, damaged by the hash of conversation and turn.

    A dropped turn stays as a row without role and text that is ``gone``, so that its conversation isn't lost.
    """
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    t = turns.select(turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), space(turns["role"]).alias("role"), space(turns["text"]).alias("text"))
    t = t.withColumn("kind", F.crc32(F.concat(space(F.col("conv_id")), F.lit(":"), space(F.col("turn"))).cast("binary")) % 20)
    k = F.col("kind")
    text = F.when(k == 1, "").when(k == 2, F.translate("text", ENDS, "")).when(k != 0, F.col("text"))
    role = F.when(k == 4, "user").when(k != 0, F.col("role"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(k == 3, 2).otherwise(1)))
    return t.select("conv_id", "turn", role.alias("role"), text.alias("text"), (k == 0).alias("gone"), times.alias("time")).drop("time")


def _dealt(turns: DataFrame, salts: int) -> DataFrame:
    """The turns in order over partitions by range, with what a turn says of itself and whether an earlier one has its role and text."""
    end = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    key = lambda seed: F.xxhash64(F.lit(seed), "conv_id", "role", "text")
    when = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    rows = turns.select("*", (end == "").alias("blank"), (~F.contains(F.lit(ENDS), end)).alias("truncated"), key("a").alias("k1"), key("b").alias("k2"), when.alias("when"))
    told = rows.filter("NOT gone AND NOT blank")
    again = told.groupBy("k1", "k2").agg(F.min("when").alias("first"), F.max("when").alias("last")).filter("first < last").select("k1", "k2", "first")
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(salts)).cast("int")).join(again, ["k1", "k2", "salt"], "left")
    seen = salted.withColumn("earlier", F.coalesce(F.col("when") > F.col("first"), F.lit(False))).drop("when", "first", "salt")
    order = ["conv_id", "turn", "role"]
    ranged = seen.withColumn("begin", F.substring("text", 1, 32)).repartitionByRange(*order, "begin").drop("begin")
    return ranged.sortWithinPartitions(*order, "text").withColumn("block", F.spark_partition_id())


@dataclass
class Block:
    """The turns of one conversation in one partition: first letters, faults, costs and walks."""

    turns: list = field(default_factory=list)
    letters: list[str] = field(default_factory=list)
    #: "b" blank, "d" duplicate, "t" truncated, "" none.
    faults: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    last: tuple = ()

    def take(self, turn, letter: str, blank: bool, truncated: bool, earlier: bool, key: tuple) -> None:
        same, self.last = key == self.last, key
        self.turns.append(turn)
        self.letters.append(letter)
        self.faults.append("b" if blank else "d" if earlier or same else "t" if truncated else "")

    def _back(self, i: int, after: list[float]) -> list[float]:
        """Costs to go before turn i, from those after it."""
        fault, kept = self.faults[i], KEPT.get(self.letters[i], (None,) * 4)
        cost = [DELETE + c for c in after]
        if fault not in ("b", "d"):
            more = TRUNCATED if fault else 0
            for s in range(4):
                cost[s] = min(cost[s], REROLE + more + after[NEXT[s]], more + after[kept[s]] if kept[s] is not None else FAR)
        cost[2], cost[3] = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
        return [min(cost[0], INSERT + cost[2]), min(cost[1], INSERT + cost[2]), cost[2], cost[3]]

    def costs(self, after: list[float]) -> list[list[float]]:
        """Costs to go before each turn, and ``after`` at the end."""
        out = [list(after)]
        for i in reversed(range(len(self.turns))):
            out.append(self._back(i, out[-1]))
        return out[::-1]

    def table(self) -> list[list[float]]:
        """Least cost from each state before the block to each state after its last turn."""
        ends = [self.costs([0 if s == t else FAR for s in range(4)])[0] for t in range(4)]
        return [[ends[t][s] for t in range(4)] for s in range(4)]

    def walk(self, state: int, costs: list[list[float]], final: bool) -> tuple[list[tuple[str, int, int]], int]:
        """(letter, turn, state before) of each edit from a state on, and the state at the end."""
        out, i, n = [], 0, len(self.turns)
        while i < n or final and costs[n][state]:
            letter = "I"
            if i < n:
                after, here = costs[i + 1], costs[i][state]
                fault, kept = self.faults[i], KEPT.get(self.letters[i], (None,) * 4)[state]
                if DELETE + after[state] == here:
                    letter = "D"
                elif INSERT + costs[i][NEXT[state]] != here:
                    letter = "K" if kept is not None and after[kept] + (TRUNCATED if fault else 0) == here else "R"
            out.append((letter, i, state))
            if letter == "K":
                state = kept
            elif letter != "D":
                state = NEXT[state]
            i += letter != "I"
        return out, state

    def repaired(self, edits: list[tuple[str, int, int]]) -> Iterator[str]:
        for letter, i, state in edits:
            if letter != "D":
                role = self.roles[i] if letter == "K" else ROLE[state]
                yield f"{role}:{'' if letter == 'I' else self.texts[i]}"

    def counts(self) -> tuple[int, int, int, int]:
        """Blank, duplicate, truncated turns and neighbours that don't follow each other."""
        f, pairs = self.faults, zip(self.letters, self.letters[1:])
        return f.count("b"), f.count("d"), f.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in pairs)

    def spread(self) -> tuple:
        """Least turn, greatest turn and number of distinct turns."""
        known = [t for t in self.turns if t is not None]
        return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


COLUMNS = ("block", "conv_id", "gone", "turn", "letter", "blank", "truncated", "earlier", "k1", "k2")


def _blocks(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple[int, int | None, Block]]:
    """Each conversation of a partition in turn; ``whole`` says that role and text come, too."""
    at, b = None, None
    for batch in batches:
        for block, conv, gone, turn, letter, blank, truncated, earlier, k1, k2, *more in zip(*(c.to_pylist() for c in batch.columns)):
            if (block, conv) != at:
                if b is not None:
                    yield (*at, b)
                at, b = (block, conv), Block()
            if not gone:
                b.take(turn, letter, blank, truncated, earlier, (turn, k1, k2))
                if whole:
                    b.roles.append(more[0])
                    b.texts.append(more[1])
    if b is not None:
        yield (*at, b)


def _ends(rows: DataFrame, made) -> list[dict]:
    """``made(block, conversation, Block)`` for the first and the last conversation of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        first, last = None, None
        for last in _blocks(batches, False):
            first = first or last
        some = [] if last is None else [first] if first is last else [first, last]
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps({"block": n, "conv_id": c} | made(n, c, b)) for n, c, b in some], pa.string())], names=["row"])

    import json

    return [json.loads(r["row"]) for r in rows.select(*COLUMNS).mapInArrow(run, "row string").collect()]


def _summary(n: int, conv, b: Block) -> dict:
    low, high, distinct = b.spread()
    return {"n": len(b.turns), "counts": b.counts(), "low": low, "high": high, "distinct": distinct, "letters": b.letters[:1] + b.letters[-1:], "table": b.table()}


def _plans(rows: DataFrame) -> dict:
    """For (block, conversation) of conversations in several blocks: entry state, costs after it, whether it is the last, and then what the whole has."""
    found = defaultdict(list)
    for e in sorted(_ends(rows, _summary), key=lambda e: e["block"]):
        found[e["conv_id"]].append(e)
    several = {c: es for c, es in found.items() if len(es) > 1}
    after: dict = {}
    for conv, es in several.items():
        cost = list(END)
        for e in reversed(es):
            after[e["block"], conv] = cost
            cost = [min(e["table"][s][t] + cost[t] for t in range(4)) for s in range(4)]
        es[0]["cost"] = cost[0]

    def exits(n: int, conv, b: Block) -> dict:
        if (n, conv) not in after:
            return {}
        costs = b.costs(after[n, conv])
        return {"exits": [b.walk(s, costs, False)[1] for s in range(4)]}

    through = {(e["block"], e["conv_id"]): e["exits"] for e in _ends(rows, exits) if "exits" in e} if several else {}
    plans = {}
    for conv, es in several.items():
        state, before = 0, ""
        whole = [0, 0, 0, 0]
        for e in es:
            whole = [x + y for x, y in zip(whole, e["counts"])]
            if e["n"]:
                whole[3] += bool(before) and before + e["letters"][0] not in ("su", "ua", "au")
                before = e["letters"][-1]
        known = [e for e in es if e["distinct"]]
        # A turn's rows may go on in the next block.
        shared = sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
        gaps = known[-1]["high"] - known[0]["low"] + 1 - sum(e["distinct"] for e in known) + shared if known else 0
        for e in es:
            at = e["block"], conv
            plans[at] = (state, after[at], e is es[-1], (gaps, *whole, int(es[0]["cost"])))
            state = through[at][state]
    return plans


OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(conversations: DataFrame, salts: int = 16) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text): its faults, the cheapest edits and the repaired text's hash.

    Turns go by turn (nulls first), and turns of one number by role and text, copies side by side. Nulls in
    role, text or turn are read as one space (but a null turn still comes first and counts in no gap). Turns
    without conv_id are one conversation, whose conv_id is null. A role that begins with none of the letters
    s, u and a, or is empty, can't be kept. A conversation without any turn left has zeros, an empty audit
    and the hash of nothing; an empty table gives an empty result. Other columns aren't looked at. A task
    holds the turns of one conversation in one partition; only those that agree in conversation, turn, role and
    the first 32 characters stay together whatever their number.
    """
    rows = checkpointed(_dealt(damaged(conversations), salts).withColumn("letter", F.coalesce(F.substring("role", 1, 1), F.lit(""))))
    plans = _plans(rows)
    own = rows.sparkSession.sparkContext.broadcast(plans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, out = own.value, []
        for n, conv, b in _blocks(batches, True):
            plan = plans.get((n, conv))
            state, after, last, whole = plan or (0, END, True, None)
            costs = b.costs(after)
            edits = b.walk(state, costs, last)[0]
            audit, lines = "".join(e[0] for e in edits), b.repaired(edits)
            if plan is None:
                low, high, distinct = b.spread()
                gaps = high - low + 1 - distinct if distinct else 0
                out.append((conv, gaps, *b.counts(), int(costs[0][0]), audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), n, 0, None))
            else:
                for k, piece in enumerate(_pieces(lines)):
                    out.append((conv, *whole, audit if k == 0 else "", None, n, k, piece))
            if len(out) >= 1000 or plan:
                yield _batch(out)
                out = []
        yield _batch(out)

    kinds = f"{OUT}, block int, piece int, bytes binary"
    done = checkpointed(rows.select(*COLUMNS, "role", "text").mapInArrow(run, kinds)) if plans else rows.select(*COLUMNS, "role", "text").mapInArrow(run, kinds)
    final = done.filter("bytes IS NULL").drop("block", "piece", "bytes")
    return final.unionByName(_joined(done.filter("bytes IS NOT NULL"))) if plans else final


NAMES = [c.split()[0] for c in OUT.split(", ")]


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
    columns = zip(*out) if out else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[*NAMES, "block", "piece", "bytes"])


def _pieces(lines: Iterator[str]) -> Iterator[bytes]:
    """The lines in pieces of at least ``PIECE`` bytes, one empty piece where there is none."""
    held, size, any_ = [], 0, False
    for line in lines:
        held.append(line)
        size += len(line)
        if size >= PIECE:
            yield "\n".join(held).encode()
            held, size, any_ = [], 0, True
    if held or not any_:
        yield "\n".join(held).encode()


def _joined(pieces: DataFrame) -> DataFrame:
    """Conversations of several blocks: their pieces are read in order, and hashed one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept, audit, h, begun = None, None, [], hashlib.sha256(), False
        close = lambda: _batch([(*kept, "".join(audit), h.hexdigest(), 0, 0, None)]).select(NAMES)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (row[0],):
                    if at is not None:
                        yield close()
                    at, kept, audit, h, begun = (row[0],), row[:7], [], hashlib.sha256(), False
                audit.append(row[7])
                if row[-1]:
                    h.update(b"\n" + row[-1] if begun else row[-1])
                    begun = True
        if at is not None:
            yield close()

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece").mapInArrow(run, OUT)


def op12_repair(spark, sf_dir):
    """Faults, cheapest edits and repaired text of every conversation."""
    return repair(table(spark, sf_dir, "conversations"))


def crc(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text."""
    step = "list_reduce(list_concat([xor(c, b)], range(1, 9)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    codes = f"list_transform(string_split({text}, ''), lambda l: ascii(l)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {step}), 4294967295)"


def _steps() -> str:
    """SQL rows (state, letter, cost, next state, role's first letter): every edit in every state."""
    rows = []
    for s in range(4):
        rows += [(s, "D", DELETE, s, ""), (s, "R", REROLE, NEXT[s], "")]
        rows += [(s, "K", 0, to[s], letter) for letter, to in KEPT.items() if to[s] is not None]
    return ", ".join(f"({s}, '{e}', {c}, {t}, '{r}')" for s, e, c, t, r in rows)


#: Forward instead of backward: of each state the cheapest edits so far, ties by letter. At most two turns
#: are put in before a turn and after the last one.
SQL = f"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM base WHERE kind <> 0
), ordered AS (
  SELECT *, row_number() OVER c AS i, left(role, 1) AS letter, lag(left(role, 1)) OVER c AS letter_before,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS time,
         regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS ending
  FROM damaged WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), judged AS (
  SELECT *, CASE WHEN ending = '' THEN 'b' WHEN time > 1 THEN 'd' WHEN ending NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM ordered
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (i > 1 AND letter_before || letter NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
), edits(state, edit, cost, next, letter) AS (VALUES {_steps()}),
puts(state, put, next) AS (VALUES (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3), (0, 'I', 2), (1, 'I', 2), (2, 'I', 3), (3, 'I', 2), (0, 'II', 3), (1, 'II', 3)),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, ''::VARCHAR AS audit FROM counts
  UNION ALL
  SELECT conv_id, i, state, least_.cost, least_.audit FROM (
    SELECT w.conv_id, w.i + 1 AS i, e.next AS state,
           min(struct_pack(cost := w.cost + 2 * length(p.put) + e.cost + CASE WHEN e.edit <> 'D' AND r.fault = 't' THEN 1 ELSE 0 END, audit := w.audit || p.put || e.edit)) AS least_
    FROM walk w JOIN judged r ON r.conv_id = w.conv_id AND r.i = w.i + 1
    JOIN puts p ON p.state = w.state JOIN edits e ON e.state = p.next
    WHERE (e.edit = 'D' OR r.fault NOT IN ('b', 'd')) AND (e.edit <> 'K' OR e.letter = r.letter)
    GROUP BY w.conv_id, w.i, e.next)
), best AS (
  SELECT w.conv_id, min(struct_pack(cost := w.cost + 2 * length(p.put), audit := w.audit || p.put)) AS b
  FROM walk w JOIN counts c ON c.conv_id = w.conv_id AND c.n = w.i JOIN puts p ON p.state = w.state
  WHERE p.next IN (0, 3) GROUP BY w.conv_id
), letters AS (
  SELECT conv_id, unnest(string_split(b.audit, '')) AS edit, unnest(range(1, length(b.audit) + 1)) AS place FROM best WHERE b.audit <> ''
), placed AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER a AS i, count(*) FILTER (edit <> 'D') OVER a AS k
  FROM letters WINDOW a AS (PARTITION BY conv_id ORDER BY place)
), turned AS (
  SELECT p.conv_id, p.place, p.k, p.edit, r.role, r.text, max(CASE WHEN p.k = 1 AND p.edit = 'K' AND r.letter = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS s
  FROM placed p LEFT JOIN judged r ON r.conv_id = p.conv_id AND r.i = p.i AND p.edit <> 'I' WHERE p.edit <> 'D'
), hashed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place)) AS h
  FROM turned GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN hashed USING (conv_id)
"""
