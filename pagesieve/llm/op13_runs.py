"""Periodic runs of words: suffix classes united by decreasing common prefix length.

A run with smallest period q, start s and length n >= 2q means that the suffixes at s and
s + q have a common prefix of exactly n - q words. By Fine and Wilf no position between
them shares that much with s, so when the classes of suffixes with a common prefix of n - q
or more have just been united, s and s + q lie side by side in their class's ordered
positions. Going down through the common prefixes of neighbours in the suffix array
(Kruskal's order), every union that makes two positions i < j neighbours at prefix length l
with l + (j - i) long enough is such a run, namely that from i if the words before i and j
differ (else i lies inside a run and its start is met elsewhere).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.core import let
from .registry import query, slices, table
from .shingles import words_of

MIN_LENGTH, EXPONENT = 6, 4
CHUNK = 512
WORDS = r"[^\x20\x09-\x0D]+"


class Positions:
    """Ordered positions in chunks, so that adding one moves few others."""

    def __init__(self, first: int):
        self.chunks, self.size = [[first]], 1

    def __iter__(self) -> Iterator[int]:
        for c in self.chunks:
            yield from c

    def _chunk(self, x: int) -> int:
        return max(0, bisect.bisect_right(self.chunks, x, key=lambda c: c[0]) - 1) if len(self.chunks) > 1 else 0

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The positions next to ``x`` on both sides."""
        k = self._chunk(x)
        c = self.chunks[k]
        i = bisect.bisect_left(c, x)
        after = c[i] if i < len(c) else self.chunks[k + 1][0] if k + 1 < len(self.chunks) else None
        return (c[i - 1] if i else None), after

    def add(self, x: int) -> None:
        k = self._chunk(x)
        c = self.chunks[k]
        bisect.insort(c, x)
        self.size += 1
        if len(c) > 2 * CHUNK:
            self.chunks[k : k + 1] = [c[:CHUNK], c[CHUNK:]]


def least_prefix(min_length: int, exponent: int) -> int:
    """The shortest common prefix that any run needs: its length less its period."""
    return min(max(min_length, exponent * q) - q for q in range(1, min_length + 1))


def window(min_length: int, exponent: int) -> int:
    """The longest windows of which every one inside a run comes there twice, a period before or behind."""
    return min(max(min_length, exponent * q) - 2 * q + 1 for q in range(1, min_length + 1))


def stretches(ids: np.ndarray, counts: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(first word, number of words) of the parts of texts whose every k words come twice in the part.

    A run lies whole in one of them, since its own k-word windows repeat inside it; all other
    words can be left out. Parts are split again while that drops windows.
    """
    group, at = np.repeat(np.arange(len(counts)), counts), np.arange(len(ids))
    while len(at) >= k:
        word = ids[at]
        code = word[: len(at) - k + 1]
        for i in range(1, k):
            code = pd.factorize(code * np.int64(len(ids)) + word[i : len(at) - k + 1 + i])[0].astype(np.int64)
        inside = group[: len(code)] == group[k - 1 :]
        seen = pd.factorize(code * np.int64(len(at)) + group[: len(code)])[0]
        keep = np.flatnonzero(inside & (np.bincount(seen[inside], minlength=len(code) + 1)[seen] > 1))
        if not len(keep):
            return []
        new = np.flatnonzero(np.append(True, (np.diff(keep) > 1) | (np.diff(group[keep]) > 0)))
        first, size = at[keep[new]], np.diff(np.append(new, len(keep))) + k - 1
        if len(keep) == inside.sum():
            return list(zip(first.tolist(), size.tolist()))
        group = np.repeat(np.arange(len(first)), size)
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return []


def suffix_order(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, and the common prefix length of neighbours in it, read off the same ranks."""
    rank = np.unique(y, return_inverse=True)[1].astype(np.int64)
    levels, n = [rank], len(y)
    while rank.max() + 1 < n:
        step = 1 << len(levels) - 1
        behind = np.zeros(n, dtype=np.int64)
        behind[: max(0, n - step)] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
        levels.append(rank)
    order = np.argsort(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, dtype=np.int64)
    for level in range(len(levels) - 2, -1, -1):
        ranks = np.append(levels[level], -1)
        same = ranks[np.minimum(a + common, n)] == ranks[np.minimum(b + common, n)]
        common += same.astype(np.int64) << level
    return order, common


def find_runs(y: np.ndarray, min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``y``, an array whose last item occurs nowhere else."""
    order, common = suffix_order(y)
    near = np.flatnonzero(common >= least_prefix(min_length, exponent))
    near = near[np.argsort(-common[near], kind="stable")]
    value, place = y.tolist(), order.tolist()
    boss: dict[int, int] = {}
    held: dict[int, Positions] = {}
    found = []

    def top(x: int) -> int:
        while (up := boss.setdefault(x, x)) != x:
            boss[x] = boss[up]
            x = boss[x]
        return x

    def meet(i: int | None, j: int | None, prefix: int) -> None:
        if i is not None and j is not None and prefix + j - i >= max(min_length, exponent * (j - i)) and value[i - 1] != value[j - 1]:
            found.append((i, prefix + j - i, j - i))

    for edge, prefix in zip(near.tolist(), common[near].tolist()):
        a, b = top(edge), top(edge + 1)
        large, small = (held.pop(x, None) or Positions(place[x]) for x in (a, b))
        if large.size < small.size:
            large, small = small, large
        last = after = None
        for x in small:
            before, then = large.around(x)
            if last is None or then != after:
                if last is not None:
                    meet(last, after, prefix)
                meet(before, x, prefix)
            last, after = x, then
        meet(last, after, prefix)
        for x in small:
            large.add(x)
        boss[b] = a
        held[a] = large
    return found


def text_runs(texts: Sequence[bytes], min_length: int = MIN_LENGTH, exponent: int = EXPONENT) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """Words of each text, and its runs by start and period."""
    words, counts = words_of(texts)
    ends = np.cumsum(counts)
    lists = [words[e - n : e] for e, n in zip(ends.tolist(), counts.tolist())]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not words:
        return lists, found
    ids = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    parts = stretches(ids, counts, window(min_length, exponent))
    if parts:
        # Parts stand one after the other, each closed by an item of its own.
        y = np.concatenate([np.append(ids[a : a + n], len(ids) + i) for i, (a, n) in enumerate(parts)])
        begins = np.cumsum([0] + [n + 1 for _, n in parts])
        for start, length, period in find_runs(y, min_length, exponent):
            part = int(np.searchsorted(begins, start, side="right")) - 1
            word = parts[part][0] + start - int(begins[part])
            text = int(np.searchsorted(ends, word, side="right"))
            found[text].append((word - int(ends[text] - counts[text]), length, period))
    return lists, [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


RUNS = "struct<n_words:bigint,found:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, exponent: int = EXPONENT, out: str = "runs") -> DataFrame:
    """The columns of ``docs`` but for the text, and a struct ``out``: n_words, found, collapsed.

    ``found`` lists every run (start, length, period; words counted from 0) by start and
    period: stretches with smallest period q of at least max(min_length, exponent * q) words
    that no neighbouring word extends; exponent is 2 or more. ``collapsed`` has the words,
    joined by one space, without those that any run holds after its first q words.

    Narrow: each text is read once, by itself, without a shuffle. NULL and empty texts have no
    words and no runs; texts of any length are taken whole, in memory that grows with one
    text; repeated rows and equal or NULL ids are rows of their own; an empty table gives an
    empty one. Of runs that tie in length all are listed. A column named ``out`` is replaced, other columns stay.
    """
    others = [c for c in docs.columns if c not in (text, out)]
    kept = F.struct(*[docs[c] for c in others]) if others else F.struct(F.lit(0).alias("none"))
    seen = docs.select(kept.alias("kept"), docs[text].alias("text"))
    schema = StructType([seen.schema["kept"]]).add(out, StructType.fromDDL(f"x {RUNS}")["x"].dataType)
    kind = pa.struct([("n_words", pa.int64()), ("found", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, raws in slices((t.as_py() for t in batch.column("text")), 4 << 20):
                rows = []
                for words, found in zip(*text_runs(raws, min_length, exponent)):
                    keep = np.ones(len(words), dtype=bool)
                    for s, n, q in found:
                        keep[s + q : s + n] = False
                    left = words if not found else [w for w, k in zip(words, keep) if k]
                    rows.append({"n_words": len(words), "found": [dict(zip(("start", "length", "period"), f)) for f in found], "collapsed": b" ".join(left).decode("utf-8", "replace")})
                yield pa.RecordBatch.from_arrays([batch.column("kept").slice(start, len(raws)), pa.array(rows, kind)], ["kept", out])

    done = seen.mapInArrow(run, schema)
    return done.select(*[F.col("kept")[c].alias(c) for c in others], out)


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with the query's repetitions: where crc32(doc_id) % 10 = 0 the words from some place on repeat the first few of them."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(crc / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        period = F.slice(words, a + 1, p)
        tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(F.lit(""))

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORDS), F.lit(0))
    return docs.withColumn("text", F.when(crc % 10 == 0, let(words, repeat)).otherwise(F.col("text")))


# CRC-32 bit by bit; the polynomial is a fixed value.
CRC = "xor(list_reduce([4294967295] || list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i, 1))::BIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"

SQL = rf"""
WITH o AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CASE WHEN doc_id IS NOT NULL THEN {CRC.format(x="CAST(doc_id AS VARCHAR)")} END AS h FROM documents),
c AS (SELECT *, len(w) AS n, h // 10 AS g FROM o),
e AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM c),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
d AS (SELECT rid, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM f),
k AS (SELECT rid, n, i, w[i + 1 : i + 5] AS gram FROM (SELECT rid, n, w, unnest(range(0, n - 4)) AS i FROM d WHERE n > 4)),
m AS (SELECT k.rid, k.i, j.i - k.i AS q FROM k JOIN k j ON k.rid = j.rid AND k.gram = j.gram AND j.i > k.i AND 4 * (j.i - k.i) <= k.n),
s AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m),
l AS (SELECT rid, q, min(i) AS start, count(*) + 4 + q AS length FROM s GROUP BY rid, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.rid = l.rid AND x.q < l.q AND x.start <= l.start AND x.start + x.length >= l.start + l.length)),
t AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS listed, arg_min({{'s': start, 'l': length, 'q': q}}, (-length, start, q)) AS best FROM r GROUP BY rid),
x AS (SELECT DISTINCT rid, unnest(range(start + q, start + length)) AS i FROM r),
y AS (SELECT rid, list(i) AS gone FROM x GROUP BY rid),
z AS (SELECT d.rid, array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(0, n), lambda i: NOT list_contains(gone, i)), lambda i: w[i + 1]) END, ' ') AS kept FROM d LEFT JOIN y USING (rid))
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (rid) LEFT JOIN z USING (rid)
"""


@query("op13_periodic_runs", SQL)
def op13(spark, sf_dir):
    done = runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.get(F.array_sort(F.transform("runs.found", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    listed = F.array_join(F.transform("runs.found", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return done.select("doc_id", F.size("runs.found").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("runs.collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
