"""Near-duplicate documents: SetSketch registers, banding, joint likelihood, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .registry import id_back, id_of, query, slices, stored, table
from .shingles import mixed, shingle_sets

WORDS = 5
PERCENT = 85
# Registers: BANDS * ROWS. At similarity 0.85 a pair shares none of the bands in 4 of 10^8 cases.
BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
# Base and rate of the exponentially spaced values: steps of 0.1 %, 2 bytes a register.
BASE, RATE = 1.001, 20.0
LIMIT = 2**16 - 1
# Buckets beyond this size are dealt to several tasks; sets are compared in blocks of this size.
BUCKET, BLOCK = 20_000, 256
# A bucket member within COVER of a leader starts no cluster of its own; within LINK of a leader it
# belongs to the leader's group. Since 1 - similarity is a metric, two members linked at 0.85 end in
# one group: (1 - COVER) + 0.15 < 1 - LINK, and for salted buckets 2 * (1 - COVER_SALTED) + 0.15 < 1 - LINK.
COVER, COVER_SALTED, LINK = 0.6, 0.82, 0.35

_SEEDS = mixed(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A = (_SEEDS[:REGISTERS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_SEEDS[REGISTERS:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def sketches(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Registers of every set: floor(1 - log_b(least exponential value)), truncated to 2 bytes.

    Register i of a set is a maximum over its elements, so the sketch of a union is the
    maximum of the sketches.
    """
    low = np.full((len(counts), REGISTERS), np.iinfo(np.uint32).max, dtype=np.uint32)
    owner = np.repeat(np.arange(len(counts)), counts)
    x, y = (values >> np.uint64(32)).astype(np.uint32), values.astype(np.uint32)
    for i in range(0, len(values), 4096):
        own = owner[i : i + 4096]
        v = x[i : i + 4096, None] * _A
        v += y[i : i + 4096, None] * _B
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        who = own[starts]
        low[who] = np.minimum(low[who], np.minimum.reduceat(v, starts, axis=0))
    least = -np.log1p(-(low + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(least / RATE) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(sk: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of registers."""
    parts = sk.reshape(len(sk), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mixed(key ^ (parts[:, :, r] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return key.view(np.int64)


_GRID = np.linspace(0, 1, 51)


def likely_similarity(ka: np.ndarray, na: np.ndarray, kb: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sets from both sketches and set sizes, on a grid of 0.02.

    A register of a is above, equal to or below that of b with probabilities that follow
    from the sizes and the similarity.
    """
    above, below = (ka > kb).sum(axis=-1), (ka < kb).sum(axis=-1)
    same = REGISTERS - above - below
    u = (na / (na + nb))[..., None]
    v = 1 - u
    j = np.minimum(_GRID, np.minimum(u / v, v / u))
    log_b = np.log(BASE)
    p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / log_b, 1e-12, 1)
    up, down = p(u - v * j), p(v - u * j)
    at = above[..., None] * np.log(up) + below[..., None] * np.log(down) + same[..., None] * np.log(np.maximum(1 - up - down, 1e-12))
    return np.take_along_axis(j, at.argmax(axis=-1)[..., None], axis=-1)[..., 0]


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for start, texts in slices((x.as_py() for x in batch.column(1)), 1 << 20):
            values, counts = shingle_sets([t.lower() for t in texts], WORDS)
            ends = np.cumsum(counts)
            sk = sketches(values, counts)
            digests = [hashlib.blake2b(values[e - c : e].tobytes(), digest_size=16).digest() for c, e in zip(counts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(start, len(texts)), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in sk], pa.binary())],
                ["id", "n", "digest", "sketch"],
            )


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_array(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS), pa.int64()), pa.array(keys.ravel(), pa.int64())], ["rep", "key"])


def _array(sk: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sk), dtype=np.uint16).reshape(len(sk), REGISTERS)


def _runs(batches: Iterator[pa.RecordBatch], keys: int, least: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by the first ``keys`` columns, at least ``least`` rows each but the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cut = np.flatnonzero(change)
        if len(cut):
            k = int(cut[-1]) + 1
            yield pa.Table.from_batches(held[:-1] + [batch.slice(0, k)])
            held = [batch.slice(k)]
    if held:
        yield pa.Table.from_batches(held)


def _groups(t: pa.Table, keys: int) -> list[tuple[int, int]]:
    change = np.zeros(t.num_rows - 1, dtype=bool)
    for i in range(keys):
        c = t.column(i).to_numpy()
        change |= c[1:] != c[:-1]
    cuts = (np.flatnonzero(change) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, t.num_rows]))


def _clusters(rep: np.ndarray, n: np.ndarray, sk: np.ndarray, cover: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Leaders of one bucket, and edges that join its members to them; members are compared with leaders only."""
    leaders, edges, joined = [0], [], set()
    for i in range(1, len(rep), 128):
        j = min(i + 128, len(rep))
        seen = len(leaders)
        est = _against(sk[i:j], n[i:j], sk[leaders], n[leaders])
        for m in range(i, j):
            row = est[m - i]
            if len(leaders) > seen:
                row = np.append(row, _against(sk[m : m + 1], n[m : m + 1], sk[leaders[seen:]], n[leaders[seen:]])[0])
            near = np.flatnonzero(row >= LINK)
            best = int(row.argmax())
            if len(near):
                edges.append((int(rep[m]), int(rep[leaders[best]])))
                for k in near.tolist():
                    if k != best and (min(k, best), max(k, best)) not in joined:
                        joined.add((min(k, best), max(k, best)))
                        edges.append((int(rep[leaders[k]]), int(rep[leaders[best]])))
            if row[best] < cover:
                leaders.append(m)
    return edges, leaders


def _against(sa: np.ndarray, na: np.ndarray, sb: np.ndarray, nb: np.ndarray) -> np.ndarray:
    out = np.empty((len(sa), len(sb)))
    step = max(1, 50_000 // max(1, len(sa)))
    for i in range(0, len(sb), step):
        out[:, i : i + step] = likely_similarity(sa[:, None, :], na[:, None], sb[None, i : i + step, :], nb[None, i : i + step])
    return out


def _bucket_edges(level: int):
    """Rows (key, salt, salts, rep, n, sketch) in order of key and salt to edges, and to leaders of dealt-out buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 2):
            key, salts, rep, n = (t.column(i).to_numpy() for i in (0, 2, 3, 4))
            sk = _array(t.column(5).to_pylist())
            n = n.astype(float)
            spans = _groups(t, 2)
            pairs = np.array([a for a, b in spans if b - a == 2 and (salts[a] == 1 or level == 2)], dtype=np.int64)
            edges: list[tuple[int, int]] = []
            lead: list[tuple[int, int]] = []
            for i in range(0, len(pairs), 2000):
                p = pairs[i : i + 2000]
                near = p[likely_similarity(sk[p], n[p], sk[p + 1], n[p + 1]) >= LINK]
                edges.extend(zip(rep[near].tolist(), rep[near + 1].tolist()))
            for a, b in spans:
                salted = salts[a] > 1
                if b - a > 2 or (b - a == 2 and salted and level == 1):
                    found, leaders = _clusters(rep[a:b], n[a:b], sk[a:b], 2.0 if level == 2 else COVER_SALTED if salted else COVER)
                    edges.extend(found)
                    if salted and level == 1:
                        lead.extend((int(key[a]), int(rep[a + x])) for x in leaders)
                elif b - a == 1 and salted and level == 1:
                    lead.append((int(key[a]), int(rep[a])))
            edges = list({(max(e), min(e)) for e in edges if e[0] != e[1]})
            yield pa.RecordBatch.from_arrays(
                [pa.array([e[0] for e in edges] + [x[1] for x in lead], pa.int64()), pa.array([e[1] for e in edges] + [None] * len(lead), pa.int64()),
                 pa.array([None] * len(edges) + [x[0] for x in lead], pa.int64())], ["a", "b", "key"])

    return run


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, grp, blocks, block) to one row for each unit of comparison the document takes part in."""
    for batch in batches:
        ids, grp, blocks, block = (batch.column(i).to_numpy() for i in (0, 2, 3, 4))
        for start, texts in slices((x.as_py() for x in batch.column(1)), 1 << 20):
            values, counts = shingle_sets([t.lower() for t in texts], WORDS)
            ends = np.cumsum(counts)
            for k in range(len(texts)):
                i = start + k
                data = values[ends[k] - counts[k] : ends[k]].tobytes()
                other = np.arange(blocks[i])
                lo, hi = np.minimum(other, block[i]), np.maximum(other, block[i])
                m = len(other)
                for s in range(0, m, 64):
                    c = len(other[s : s + 64])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([grp[i]] * c, pa.int64()), pa.array(lo[s : s + 64] * blocks[i] + hi[s : s + 64], pa.int64()), pa.array([block[i]] * c, pa.int64()),
                         pa.array([ids[i]] * c, pa.int64()), pa.array([data] * c, pa.binary())], ["grp", "unit", "block", "id", "elements"])


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of all sets in ``a`` with all in ``b``, from a product of incidence matrices.

    Elements of one side only are left out; the rest are taken in strips.
    """
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    own_a, own_b = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])

    def places(flat, own):
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), dtype=bool)
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], own[hit][order]

    (pa_, ra), (pb_, rb) = places(flat_a, own_a), places(flat_b, own_b)
    for i in range(0, len(both), 4096):
        x, y = np.zeros((len(a), 4096), dtype=np.float32), np.zeros((len(b), 4096), dtype=np.float32)
        for m, p, r in ((x, pa_, ra), (y, pb_, rb)):
            lo, hi = np.searchsorted(p, [i, i + 4096])
            m[r[lo:hi], p[lo:hi] - i] = 1
        out += x @ y.T
    return out


def _linked(t: pa.Table, a: int, b: int, percent: int) -> list[tuple[int, int]]:
    """Spanning edges of the links inside one unit: all pairs of one block, or those between two blocks."""
    ids, block = t.column(3).to_numpy()[a:b], t.column(2).to_numpy()[a:b]
    sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in t.column(4).slice(a, b - a)]
    n = np.array([len(x) for x in sets])
    if b - a == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        linked = 100 * common >= percent * (n[0] + n[1] - common)
        return [(int(max(ids)), int(min(ids)))] if linked and ids[0] != ids[1] else []
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    common = shared_counts([sets[i] for i in left], [sets[i] for i in right]).astype(np.int64)
    link = 100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)
    label = np.arange(b - a)
    while True:
        new = label.copy()
        new[left] = np.minimum(new[left], np.where(link, label[right][None, :], b - a).min(axis=1, initial=b - a))
        new[right] = np.minimum(new[right], np.where(link, new[left][:, None], b - a).min(axis=0, initial=b - a))
        if (new == label).all():
            break
        label = new
    return [(int(max(ids[i], ids[k])), int(min(ids[i], ids[k]))) for i, k in enumerate(label.tolist()) if ids[i] != ids[k]]


def _verified(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 2, 64):
            edges = [e for a, b in _groups(t, 2) if b - a > 1 for e in _linked(t, a, b, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Words are runs without ASCII white space, A-Z in lower case; a document's set holds its
    distinct 5-word shingles (64-bit hashes), with fewer words the whole sequence as one.
    Two documents are linked if 100 * intersection >= ``percent`` * union of the full sets
    (``percent`` of 80 or more). component_id is the smallest doc_id reachable over links,
    kept says that it is the row's own. Documents without words (NULL or empty texts) are
    linked with nothing. Rows of one doc_id are one document. A NULL doc_id counts as the
    smallest id.

    1. Equal sets fall together by a 128-bit digest; their smallest id stands for them.
    2. Band keys of the registers put them into buckets. In a bucket, sketches are held
       against a few leaders by likelihood, which gives groups of possibly linked sets.
    3. Each group's full sets are compared in blocks of 256; a task gets two blocks and
       returns a spanning forest of their links, never their pairs.
    """
    own = docs.select(id_of("doc_id").alias("id"), "text")
    rows = stored(own.mapInArrow(_sketch_rows, "id long, n long, digest binary, sketch binary"), "sketches")
    full = rows.where("n > 0")
    reps = full.groupBy("digest").agg(F.min("id").alias("rep"))
    reps = stored(reps, "reps")
    first = full.join(reps.select(F.col("digest").alias("d"), "rep"), (F.col("digest") == F.col("d")) & (F.col("id") == F.col("rep")))
    sets = stored(first.dropDuplicates(["digest"]).select("rep", "n", "sketch"), "sets")

    keys = sets.select("rep", "sketch").mapInArrow(_band_rows, "rep long, key long")
    counts = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select(F.col("key").alias("k"), F.ceil(F.col("size") / BUCKET).alias("salts"))
    salted = keys.join(counts, F.col("key") == F.col("k")).select("key", F.pmod(F.xxhash64("rep"), F.col("salts")).alias("salt"), "salts", F.col("rep").alias("r"))
    kind = "a long, b long, key long"

    def bucket(members: DataFrame, level: int) -> DataFrame:
        wide = members.join(sets, F.col("r") == F.col("rep")).select("key", "salt", "salts", "rep", "n", "sketch")
        return wide.repartition("key", "salt").sortWithinPartitions("key", "salt", "n", "rep").mapInArrow(_bucket_edges(level), kind)

    found = stored(bucket(salted, 1), "bucket-edges")
    leaders = found.where("key IS NOT NULL").select("key", F.lit(0).cast("long").alias("salt"), F.lit(2).cast("long").alias("salts"), F.col("a").alias("r"))
    across = bucket(leaders, 2)
    groups = components(found.where("b IS NOT NULL").select("a", "b").union(across.where("b IS NOT NULL").select("a", "b")))

    sizes = groups.groupBy("root").agg(F.count("*").alias("size")).select(F.col("root").alias("g"), F.ceil(F.col("size") / BLOCK).alias("blocks"))
    units = groups.join(sizes, F.col("root") == F.col("g")).select(F.col("node"), F.col("root").alias("grp"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    # A merge join at every size: each text travels once, and a hot group's rows are spread by id.
    members = own.join(units.hint("merge"), F.col("id") == F.col("node")).select("id", "text", "grp", "blocks", "block")
    parts = members.mapInArrow(_set_rows, "grp long, unit long, block long, id long, elements binary")
    links = parts.repartition("grp", "unit").sortWithinPartitions("grp", "unit").mapInArrow(_verified(percent), "a long, b long")
    roots = components(links).select(F.col("node"), "root")

    done = rows.select("id", "n", "digest").join(reps.select(F.col("digest").alias("d"), "rep"), F.col("digest") == F.col("d"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("root", "rep", "id")
    return done.select(id_back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), id_back(component).alias("component_id"), (F.col("id") == component).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document with the smallest doc_id of each group stays."""
    gone = near_duplicates(docs).where(~F.col("kept")).select(id_of("doc_id").alias("gone_id")).distinct()
    return docs.join(gone.hint("merge"), id_of(docs["doc_id"]) == gone["gone_id"], "left_anti")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (
  SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS s
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT d AS doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, d = c AS kept FROM m LEFT JOIN n ON n.doc_id = d
"""


@query("op7_setsketch_near_dedup", SQL)
def op7(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
