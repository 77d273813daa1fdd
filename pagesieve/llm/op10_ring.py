"""Sharding by a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import query, stored, table

SHARDS, NODES, SEED = 8, 32, 1
# Digits of the order of arrival: histograms have ring arcs x 2^DIGIT cells, rows are fetched below FETCH.
DIGIT, FETCH = 10, 20_000
DIGITS = 6


def ring(shards: int, nodes: int = NODES, seed: int = SEED) -> tuple[list[int], list[int]]:
    """Positions of all virtual nodes on [0, 2^63), ascending, and the shard of each.

    A node's position depends on its shard and number only, so another shard adds nodes
    and leaves the rest where they are.
    """
    at = sorted((int.from_bytes(hashlib.sha256(f"{seed}|{s}|{v}".encode()).digest()[:8], "big") >> 1, s) for s in range(shards) for v in range(nodes))
    return [p for p, _ in at], [s for _, s in at]


def walk(owner: Sequence[int], full: set[int]) -> list[int]:
    """For each node of the ring the first shard clockwise that is not full (-1 if all are)."""
    n, out, now = len(owner), [-1] * len(owner), -1
    for i in [*range(n - 1, -1, -1), *range(n - 1, -1, -1)]:
        now = now if owner[i] in full else owner[i]
        out[i] = now
    return out


def capacities(rows: int, shards: int, epsilon: float = 0.0) -> list[int]:
    """Rows each shard takes: with epsilon 0 as even as whole numbers allow, else (1 + epsilon) times the mean."""
    if epsilon:
        return [int(np.ceil((1 + epsilon) * rows / shards))] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _digit(d: int) -> Column:
    """Digit ``d`` of a row's place in the order of arrival: of ``prio``, then of ``tie`` where prios are equal."""
    return F.shiftrightunsigned(F.col("prio" if d < DIGITS else "tie"), 64 - DIGIT * (d % DIGITS + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1)).cast("int")


def fill_order(keys: DataFrame, owner: list[int], room: list[int]) -> list[tuple[tuple[int, int] | None, list[int]]]:
    """Phases of filling: (place of the last row of the phase, shard of each node during it).

    Rows arrive in order of (prio, tie). As long as no shard gets full, the ring maps nodes
    to shards by the same table, so all that has to be found are the (shards - 1) places
    where one gets full. Each is narrowed down digit by digit with counts by node; only the
    last few rows are looked at one by one.
    """
    phases, full, left = [], set(), list(room)
    full |= {s for s, c in enumerate(left) if c == 0}
    after: tuple[int, int] | None = None
    prefix_counts: dict[tuple, np.ndarray] = {}

    def counts(prefix: tuple[int, ...]) -> np.ndarray:
        """Rows by (next digit, node) among those whose place begins with ``prefix``."""
        if prefix not in prefix_counts:
            rows = keys
            for d, v in enumerate(prefix):
                rows = rows.where(_digit(d) == v)
            table_ = np.zeros((1 << DIGIT, len(owner)), dtype=np.int64)
            got = rows.groupBy(_digit(len(prefix)).alias("d"), "node").count().toArrow()
            table_[got.column("d").to_numpy(), got.column("node").to_numpy()] = got.column("count").to_numpy()
            prefix_counts[prefix] = table_
        return prefix_counts[prefix]

    def rows_in(prefix: tuple[int, ...]) -> list[tuple[int, int, int]]:
        rows = keys
        for d, v in enumerate(prefix):
            rows = rows.where(_digit(d) == v)
        got = rows.select("prio", "tie", "node").toArrow()
        unsigned = lambda c: got.column(c).to_numpy().view(np.uint64).tolist()
        return sorted(zip(unsigned("prio"), unsigned("tie"), got.column("node").to_numpy().tolist()))

    fetched: dict[tuple, list] = {}

    def place(prefix: tuple[int, ...], to: list[int], left: list[int]) -> tuple[int, int] | None:
        """Place of the first row under ``prefix``, after ``after``, that fills a shard; ``left`` is counted down."""
        per = counts(prefix)
        begin = 0
        start_digit = _prefix_of(after, len(prefix) + 1) if after else None
        if start_digit and start_digit[:-1] == prefix:
            begin = start_digit[-1]
        for d in range(begin, 1 << DIGIT):
            if not per[d].any():
                continue
            take = np.zeros(len(left), dtype=np.int64)
            partly = bool(start_digit) and start_digit == (*prefix, d)
            np.add.at(take, np.array(to), per[d])
            if not partly and all(take[s] < left[s] for s in range(len(left)) if take[s]):
                for s in range(len(left)):
                    left[s] -= int(take[s])
                continue
            sub = (*prefix, d)
            if int(per[d].sum()) <= FETCH or len(sub) == 2 * DIGITS:
                fetched.setdefault(sub, None)
                if fetched[sub] is None:
                    fetched[sub] = rows_in(sub)
                for p, t, node in fetched[sub]:
                    if after is not None and (p, t) <= after:
                        continue
                    left[to[node]] -= 1
                    if left[to[node]] == 0:
                        return p, t
            else:
                found = place(sub, to, left)
                if found:
                    return found
        return None

    while len(full) < len(room):
        to = walk(owner, full)
        last = place((), to, left)
        phases.append((last, to))
        if last is None:
            break
        full |= {s for s, c in enumerate(left) if c == 0}
        after = last
    return phases


def _prefix_of(place: tuple[int, int], length: int) -> tuple[int, ...]:
    return tuple((place[0] if d < DIGITS else place[1]) >> (64 - DIGIT * (d % DIGITS + 1)) & ((1 << DIGIT) - 1) for d in range(length))


def shard(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, epsilon: float = 0.0, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row.

    A document's hash is its place on a ring of ``nodes`` virtual nodes a shard; the next
    node clockwise owns it. Documents arrive in the order of another hash, and one whose
    shard is full goes on clockwise to the first shard with room. A shard holds at most
    ``capacities(rows, shards, epsilon)`` rows: with epsilon 0 counts differ by one at most.
    Only documents beyond a shard's room move, and a further shard takes over arcs next to
    its own nodes.

    ``slot`` numbers a shard's rows from 0 in order of arrival. ``size`` is the text's UTF-8
    bytes plus 1, a NULL text has none (size 1, crc32 of nothing). A NULL doc_id is hashed
    as the word "null"; repeated doc_ids have one place and are told apart by a row number.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    at, owner = ring(shards, nodes, seed)
    text = F.coalesce("text", F.lit(""))
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("ring"), name), 1)
    bounds = F.array(*[F.lit(p).cast("long") for p in at])
    node = F.pmod(F.size(F.filter(bounds, lambda b: b < spot)), F.lit(len(at)))
    own = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        node.alias("node"), F.xxhash64(F.lit(seed), F.lit("order"), name).alias("prio"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
    )
    keys = stored(own, "ring-keys")  # the row number is drawn once
    phases = fill_order(keys, owner, capacities(keys.count(), shards, epsilon))

    unsigned = lambda c: F.col(c).bitwiseXOR(F.lit(-(2**63)))  # noqa: E731  same order as the unsigned number
    where = F.lit(-1)
    for last, to in reversed(phases):
        here = F.get(F.array(*[F.lit(s) for s in to]), F.col("node"))
        if last is None:
            where = here
        else:
            p, t = (F.lit(x - 2**63).cast("long") for x in last)
            where = F.when((unsigned("prio") < p) | ((unsigned("prio") == p) & (unsigned("tie") <= t)), here).otherwise(where)
    placed = keys.withColumn("shard", where.cast("int")).withColumn("part", _digit(0))
    # Slots: numbers inside (shard, first digit), which are many small groups, plus the rows of the digits before.
    before = Window.partitionBy("s").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    # At most shards x 2^DIGIT rows.
    starts = stored(placed.groupBy(F.col("shard").alias("s"), F.col("part").alias("d")).agg(F.count("*").alias("n")), "slots")
    starts = starts.select("s", "d", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy(unsigned("prio"), unsigned("tie"))
    numbered = placed.withColumn("k", F.row_number().over(inside)).join(F.broadcast(starts), (F.col("shard") == F.col("s")) & (F.col("part") == F.col("d")))
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("k") - 1).alias("slot"))


@query("op10_bounded_ring")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
