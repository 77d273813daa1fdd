"""Cheapest repair of a conversation's turns, with the edits that lead there.

A repaired conversation has roles (s?(ua)+)?. Row by row, a table over four states (nothing
yet, after s, after u, after a) holds the cheapest edits so far. Their text, one letter an
edit, is a chain of nodes that shares its beginning with other chains; each node has a
rolling hash of all letters up to it and pointers to ancestors 1, 2, 4, ... steps up. Where
two chains cost the same, the one that sorts first stays: the common prefix is searched on
the hashes, and what the hashes call equal is compared letter by letter from the node at
which the chains part.

Conversations lie sorted in range partitions, so one that is longer than a block, or crosses
partitions, is cut into blocks. A block's table is kept for every state it may begin in;
the blocks of a conversation are then chained the same way, with whole blocks as nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .registry import NULL_ID, id_back, id_of, query, stored, table

BLOCK, BLOCK_BYTES = 2048, 8 << 20
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
# The state after the next user or assistant turn.
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
SPACE = " \t\n\x0b\x0c\r"
MOD, BASE = (1 << 61) - 1, 1_000_003


class Node:
    """The last piece of a text of edits; what comes before it is shared."""

    __slots__ = ("text", "depth", "code", "jump")

    def __init__(self, up: Node | None = None, text: str = ""):
        self.text, self.jump = text, []
        self.depth, self.code = (up.depth + len(text), extend(up.code, text)) if up else (0, 0)
        k = 0
        while up is not None:
            self.jump.append(up)
            up, k = (up.jump[k] if k < len(up.jump) else None), k + 1

    def holding(self, d: int) -> Node:
        """The first node of the chain whose text reaches ``d`` letters."""
        x = self
        for k in range(len(x.jump) - 1, -1, -1):
            if k < len(x.jump) and x.jump[k].depth >= d:
                x = x.jump[k]
        return x.holding(d) if x.jump and x.jump[0].depth >= d else x

    def prefix(self, d: int) -> int:
        """Hash of the first ``d`` letters."""
        x = self.holding(d)
        return x.code if x.depth == d else extend(x.jump[0].code, x.text[: d - x.jump[0].depth])

    def spell(self, down_to: Node | None = None) -> str:
        out, x = [], self
        while x is not down_to and x.jump:
            out.append(x.text)
            x = x.jump[0]
        return "".join(reversed(out))


def extend(code: int, text: str) -> int:
    for c in text:
        code = (code * BASE + ord(c)) % MOD
    return code


def before(a: Node, b: Node) -> bool:
    """Whether the text of ``a`` sorts before that of ``b``."""
    if a is b:
        return False
    low, high = 0, min(a.depth, b.depth)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.prefix(mid) == b.prefix(mid) else (low, mid - 1)
    x, y = a, b
    while x is not y:
        if x.depth >= y.depth and x.jump:
            x = x.jump[0]
        else:
            y = y.jump[0]
    left, right = a.spell(x), b.spell(x)
    if left[: low - x.depth] != right[: low - x.depth]:  # equal hashes of different texts
        return left < right
    return left[low - x.depth :][:1] < right[low - x.depth :][:1]


Table = list  # by state: (cost, Node) or None


def _offer(best: Table, state: int, cost: int, up: Node, text: str) -> bool:
    old = best[state]
    if old is not None and old[0] < cost:
        return False
    node = Node(up, text) if text else up
    if old is None or cost < old[0] or before(node, old[1]):
        best[state] = (cost, node)
        return True
    return False


def inserted(best: Table) -> Table:
    """The table with any turns put in here."""
    best, more = list(best), True
    while more:
        more = False
        for state in range(4):
            if best[state] is not None:
                more |= _offer(best, TURN[state], best[state][0] + INSERT, best[state][1], "I")
    return best


def after_row(best: Table, initial: str, delete: bool, truncated: bool) -> Table:
    """The table after one more row of the conversation."""
    new: Table = [None] * 4
    for state, entry in enumerate(inserted(best)):
        if entry is None:
            continue
        cost, node = entry
        _offer(new, state, cost + DELETE, node, "D")
        if delete:
            continue
        cost += TRUNCATED if truncated else 0
        turn = TURN[state]
        if initial == "s" and state == START:
            _offer(new, SYSTEM, cost, node, "K")
        elif initial == ("a" if turn == ASSISTANT else "u"):
            _offer(new, turn, cost, node, "K")
        _offer(new, turn, cost + REROLE, node, "R")
    return new


def finished(best: Table) -> tuple[int, Node]:
    """The cheapest edits that end a conversation."""
    best = inserted(best)
    a, b = best[START], best[ASSISTANT]
    return b if a is None or (b is not None and (b[0] < a[0] or (b[0] == a[0] and before(b[1], a[1])))) else a


def begin(state: int) -> Table:
    best: Table = [None] * 4
    best[state] = (0, Node())
    return best


def replay(rows: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str, str]]:
    """(edit, role, text) of the turns that stay or come in, from the state before the first row."""
    out, at = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit == "K":
            state = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else ASSISTANT
        else:
            state = TURN[state]
            role = ROLE[state]
        out.append((edit, role, text))
    return out


ROWS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
MOVES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
KEY = [("conv", pa.int64()), ("part", pa.int32()), ("block", pa.int32())]
STATS = [(x, pa.int64()) for x in ("first_turn", "last_turn", "n_turns", "blank", "duplicate", "truncated", "illegal")] + [("first_initial", pa.string()), ("last_initial", pa.string())]
BLOCKS = pa.schema([*KEY, ("whole", pa.bool_()), *STATS, ("moves", MOVES), ("rows", ROWS)])
CHAINED = pa.schema([*KEY, ("a", pa.int32()), ("audit", pa.string()), *[(x, pa.int64()) for x in ("cost", "gaps", "blank", "duplicate", "truncated", "illegal")]])
MENDED = pa.schema([*KEY, ("rows", ROWS)])
DIGEST = pa.schema([("conv", pa.int64()), ("sha", pa.string())])
PAIRS = ("su", "ua", "au")


class _Stats:
    def __init__(self):
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.head = self.tail = None

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first = turn if self.first is None else self.first
            self.last = turn
        if self.tail is None:
            self.head = initial
        else:
            self.illegal += self.tail + initial not in PAIRS
        self.tail = initial
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)

    def values(self) -> tuple:
        return (self.first, self.last, self.turns, self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _cut(block_rows: int, block_bytes: int):
    """Sorted rows to blocks; a conversation that surely ends in its only block is repaired at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        state = {"conv": None, "block": 0, "lead": True, "size": 0, "held": 0}
        rows, faults, stats, previous = [], [], _Stats(), None

        def flush(ended: bool) -> None:
            nonlocal rows, faults, stats
            if not rows:
                return
            whole = ended and not state["block"] and not state["lead"]
            moves = []
            for start in (START,) if whole else range(4):
                best = begin(start)
                for (role, _), fault in zip(rows, faults):
                    best = after_row(best, role[:1], fault in ("blank", "duplicate"), fault == "truncated")
                if whole:
                    cost, node = finished(best)
                    moves.append({"a": START, "b": START, "cost": cost, "audit": node.spell()})
                else:
                    moves += [{"a": start, "b": b, "cost": e[0], "audit": e[1].spell()} for b, e in enumerate(best) if e is not None]
            turns = replay(rows, moves[0]["audit"], START) if whole else [("", *r) for r in rows]
            out.append((state["conv"], part, state["block"], whole, *stats.values(), moves, [dict(zip(("edit", "role", "text"), t)) for t in turns]))
            state["held"] += state["size"] + 100
            state["block"], state["size"] = state["block"] + 1, 0
            rows, faults, stats = [], [], _Stats()

        for batch in batches:
            for conv, turn, role, text, fault, again in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "fault", "again"))):
                if previous is None or conv != state["conv"]:
                    flush(True)
                    # The partition's first conversation may have begun in the one before.
                    state.update(conv=conv, block=0, lead=previous is None)
                elif len(rows) >= block_rows or state["size"] >= block_bytes:
                    flush(False)
                if fault != "blank" and (again or previous == (conv, turn, role, text)):
                    fault = "duplicate"
                previous = (conv, turn, role, text)
                stats.add(turn, role[:1], fault)
                rows.append((role, text))
                faults.append(fault)
                state["size"] += len(role) + len(text)
                if len(out) >= 1000 or state["held"] > block_bytes:
                    yield _batch(out, BLOCKS)
                    out.clear()
                    state["held"] = 0
        # The last one may go on in the next partition.
        flush(False)
        yield _batch(out, BLOCKS)

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation, in order, to each block's edits and one row (part -1) for the conversation."""
    conv, best, blocks, total = None, None, [], {}

    def close() -> list[tuple]:
        if best is None:
            return []
        # Trailing insertions belong to the last block.
        cost, node = finished(best)
        pieces, x = [], node
        while x.jump:
            pieces.append(x.text)
            x = x.jump[0]
        pieces.reverse()
        pieces[len(blocks) - 1 :] = ["".join(pieces[len(blocks) - 1 :])]
        out, state = [], START
        for (part, block), audit in zip(blocks, pieces):
            a, state = state, _end(audit, state, ends[part, block])
            out.append((conv, part, block, a, audit, None, None, None, None, None, None))
        gaps = total["last"] - total["first"] + 1 - total["turns"] if total["first"] is not None else 0
        return [*out, (conv, -1, -1, START, "".join(pieces), cost, gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"])]

    ends: dict = {}
    for batch in batches:
        for r in batch.to_pylist():
            if best is None or r["conv"] != conv:
                if rows := close():
                    yield _batch(rows, CHAINED)
                conv, best, blocks = r["conv"], begin(START), []
                ends.clear()
                total = {"first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "tail": None}
            new: Table = [None] * 4
            for m in r["moves"]:
                if best[m["a"]] is not None:
                    _offer(new, m["b"], best[m["a"]][0] + m["cost"], best[m["a"]][1], m["audit"])
            best = new
            blocks.append((r["part"], r["block"]))
            ends[r["part"], r["block"]] = {(m["a"], m["audit"]): m["b"] for m in r["moves"]}
            for k in ("blank", "duplicate", "truncated", "illegal"):
                total[k] += r[k]
            if total["tail"] is not None:
                total["illegal"] += total["tail"] + r["first_initial"] not in PAIRS
            total["tail"] = r["last_initial"]
            if r["first_turn"] is not None:
                total["turns"] += r["n_turns"] - (total["last"] == r["first_turn"])
                total["first"] = r["first_turn"] if total["first"] is None else total["first"]
                total["last"] = r["last_turn"]
    if rows := close():
        yield _batch(rows, CHAINED)


def _end(audit: str, state: int, ends: dict) -> int:
    """The state after a block; one with insertions behind it is the last, where it no longer matters."""
    return ends.get((state, audit), START)


def faults(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text, fault ('blank', 'truncated' or ''), again (role and text stand in an earlier turn)."""
    base = turns.select(id_of("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    base = base.withColumn("fault", F.when(bare == "", F.lit("blank")).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit("")))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    keyed = base.withColumn("key", key)
    # Only keys met more than once come back, each in one row, so hot keys can be split on the other side.
    more = keyed.where("fault <> 'blank'").groupBy("conv", "key").agg(F.min(F.coalesce("turn", F.lit(NULL_ID))).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.coalesce(F.coalesce("turn", F.lit(NULL_ID)) > F.col("first"), F.lit(False))
    return keyed.join(more, ["conv", "key"], "left").select("conv", "turn", "role", "text", "fault", again.alias("again"))


def repair(turns: DataFrame, block_rows: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Repair the conversations of ``turns`` (conv_id, turn, role, text): (audits, repaired).

    ``audits`` has a row per conversation: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit. ``repaired`` has the turns in order of (conv_id, part, block, i):
    edit (K, R or I), role, text.

    Turns are taken by turn, NULL first; equal ones by role, then text. Roles and texts are
    not NULL (callers decide what NULL means); NULL conv_ids are one conversation. Repeated
    rows are duplicates; texts may be empty or of any length (a block is cut at a size in
    bytes); other columns are ignored; an empty table gives empty tables. A conversation of
    any size is dealt over blocks and partitions; only its edits, a letter a turn, come
    together, as the row of ``audits`` has them.
    """
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role")]
    rows = faults(turns).repartitionByRange(n, *order, F.left("text", F.lit(64))).sortWithinPartitions(*order, "text")
    blocks = stored(rows.mapInArrow(_cut(block_rows, block_bytes), from_arrow_schema(BLOCKS)), "blocks")
    whole, split = blocks.where("whole"), blocks.where("NOT whole")
    move = F.col("moves")[0]
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    one = whole.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", move["cost"].alias("cost"), move["audit"].alias("audit"))
    chained = split.drop("rows", "whole").repartition(n, "conv").sortWithinPartitions("conv", "part", "block").mapInArrow(_chain, from_arrow_schema(CHAINED))
    chained = stored(chained, "chained")
    audits = one.union(chained.where("part = -1").select(*one.columns)).select(id_back(F.col("conv")).alias("conv_id"), *one.columns[1:])
    mended = split.select("conv", "part", "block", "rows").join(chained.select("conv", "part", "block", "a", "audit"), ["conv", "part", "block"]).mapInArrow(
        _replay, from_arrow_schema(MENDED))
    pieces = whole.select("conv", "part", "block", "rows").union(mended)
    return audits, pieces.select(id_back(F.col("conv")).alias("conv_id"), "part", "block", "rows")


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            turns = replay([(x["role"], x["text"]) for x in r["rows"]], r["audit"], r["a"])
            yield _batch([(r["conv"], r["part"], r["block"], [dict(zip(("edit", "role", "text"), t)) for t in turns])], MENDED)


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id and SHA-256 of its repaired ``role:text``, joined by newlines, read in order and never held whole."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.array_join(F.transform("rows", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    told = pieces.select(id_of("conv_id").alias("conv"), "part", "block", F.when(F.size("rows") > 0, text).alias("piece"))
    alone = told.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, any_ = None, None, False
        for batch in batches:
            for c, piece in zip(batch.column("conv").to_pylist(), batch.column("piece").to_pylist()):
                if sha is None or c != conv:
                    if sha is not None:
                        yield _batch([(conv, sha.hexdigest())], DIGEST)
                    conv, sha, any_ = c, hashlib.sha256(), False
                if piece is not None:
                    sha.update((("\n" if any_ else "") + piece).encode())
                    any_ = True
        if sha is not None:
            yield _batch([(conv, sha.hexdigest())], DIGEST)

    many = told.join(alone, "conv", "left_semi").repartition(n, "conv").sortWithinPartitions("conv", "part", "block").mapInArrow(run, from_arrow_schema(DIGEST))
    single = told.join(alone, "conv", "left_anti").select("conv", F.sha2(F.coalesce("piece", F.lit("")), 256).alias("sha"))
    return single.union(many).select(id_back(F.col("conv")).alias("conv_id"), "sha")


def damaged(turns: DataFrame) -> DataFrame:
    """The query's damage: by crc32('conv_id:turn') % 20 rows go, lose text or punctuation, are repeated, or become the user's."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    role = F.when(kind == 4, F.lit("user")).otherwise(blank("role"))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    return turns.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n")).drop("n")


def _sql() -> str:
    from .op13_runs import CRC

    crc = CRC.format(x="(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")
    add = lambda e, cost, edit, text="''": f"{{'c': {e}.c + {cost}, 'a': {e}.a || '{edit}', 't': {e}.t || {text}}}"
    never = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    line, user, assistant = "role || ':' || text || chr(10)", "'user:' || chr(10)", "'assistant:' || chr(10)"
    keep = lambda e, initial: f"CASE WHEN k AND substr(role, 1, 1) = '{initial}' THEN {add(e, 'cut', 'K', line)} ELSE {never} END"
    put = lambda e, name: f"CASE WHEN k THEN {add(e, '1 + cut', 'R', name + ' || text || chr(10)')} ELSE {never} END"
    return rf"""
WITH RECURSIVE s AS (SELECT conv_id, turn, {crc} % 20 AS kind, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
g AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM s WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM g),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS is_again,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS is_cut, substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) || substr(role, 1, 1) AS pair, i > 1 AS later FROM n),
r AS (SELECT *, NOT is_blank AND NOT is_again AS k, CASE WHEN is_cut THEN 5 ELSE 0 END AS cut FROM f),
q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_again AND NOT is_blank) AS duplicate,
  count(*) FILTER (k AND is_cut) AS truncated, count(*) FILTER (later AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS rows FROM r GROUP BY conv_id),
t(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 't': ''}}, {never}, {never}, {never} FROM q
  UNION ALL
  SELECT conv_id, i, {add("s0", 2, "D")}, list_min([{add("s1", 2, "D")}, {keep("s0", "s")}]),
    list_min([{add("f2", 2, "D")}, {keep("s0", "u")}, {keep("s1", "u")}, {keep("f3", "u")}, {put("s0", "'user:'")}, {put("s1", "'user:'")}, {put("f3", "'user:'")}]),
    list_min([{add("f3", 2, "D")}, {keep("f2", "a")}, {put("f2", "'assistant:'")}])
  FROM (SELECT *, list_min([s3, {add("f2", 5, "I", assistant)}]) AS f3
    FROM (SELECT r.conv_id, r.i, r.role, r.text, r.k, r.cut, s0, s1, s2, s3, list_min([s2, {add("s0", 5, "I", user)}, {add("s1", 5, "I", user)}, {add("s3", 5, "I", user)}]) AS f2
      FROM t JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i + 1))),
e AS (SELECT conv_id, list_min([s0, s3, {add("f2", 5, "I", assistant)}]) AS best
  FROM (SELECT t.conv_id, s0, s3, list_min([s2, {add("s0", 5, "I", user)}, {add("s1", 5, "I", user)}, {add("s3", 5, "I", user)}]) AS f2 FROM t JOIN q ON q.conv_id IS NOT DISTINCT FROM t.conv_id AND q.rows = t.i)),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(left(best.t, greatest(length(best.t) - 1, 0)), '')) AS repaired_sha256
FROM c LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op12_structure_repair", _sql())
def op12(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    audits, pieces = repair(damaged(turns))
    keyed = lambda df: df.select(id_of("conv_id").alias("conv"), *[c for c in df.columns if c != "conv_id"])
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = turns.select(id_of("conv_id").alias("conv")).distinct().join(keyed(audits), "conv", "left").join(keyed(digests(pieces)), "conv", "left")
    return every.select(id_back(F.col("conv")).alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
