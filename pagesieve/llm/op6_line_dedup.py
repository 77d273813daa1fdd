"""Line deduplication across documents with two Bloom filters and an exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import fresh, id_of, query, stored, table

SPACES = " \t\n\v\f\r"
MIN_CHARS = 10
# The filter's size: bits for each line, and the most that is ever broadcast (128 MB).
# Beyond that size more lines are suspected and confirmed; the result stays the same.
BITS_PER_LINE = 16
MAX_BITS = 1 << 30
SEGMENT = 1 << 16
BUFFER = 1 << 19


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line without white space at both ends, A-Z in lower case; None where it is too short to count."""
    key = line.strip().lower()
    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
        return key
    return None


def _keys(text: str | None, min_chars: int) -> list[bytes | None]:
    return [line_key(x, min_chars) for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def _bits(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions for each hash; ``bits`` is a power of two."""
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(33)) * np.uint64(0x9E3779B1) >> np.uint64(1) & mask


def _pack(places: np.ndarray) -> bytes:
    """Positions inside a segment: 2 bytes each, or a bitmap where that is shorter."""
    if len(places) < SEGMENT // 16:
        return b"p" + places.astype("<u2").tobytes()
    full = np.zeros(SEGMENT, dtype=bool)
    full[places] = True
    return b"m" + np.packbits(full).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"p":
        return np.frombuffer(data, dtype="<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=1)))


def _partial(bits: int, min_chars: int):
    """Once-seen and twice-seen bits of the task's lines, by segment. A line counts once a document."""

    def flush(parts: list[int]) -> Iterator[pa.RecordBatch]:
        hashes, seen = np.unique(np.array(parts, dtype=np.uint64), return_counts=True)
        once = np.unique(np.concatenate(_bits(hashes, bits)))
        twice = np.unique(np.concatenate(_bits(hashes[seen > 1], bits)))
        cuts = np.flatnonzero(np.diff(once >> np.uint64(16))) + 1
        starts = np.concatenate([[0], cuts, [len(once)]]).astype(int)
        segments, a, b = [], [], []
        for i, j in zip(starts, starts[1:]):
            seg = int(once[i]) >> 16
            lo, hi = np.searchsorted(twice, np.array([seg << 16, (seg + 1) << 16], dtype=np.uint64))
            segments.append(seg)
            a.append(_pack((once[i:j] & np.uint64(0xFFFF)).astype(int)))
            b.append(_pack((twice[lo:hi] & np.uint64(0xFFFF)).astype(int)))
        yield pa.RecordBatch.from_arrays([pa.array(segments, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["segment", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[int] = []
        for batch in batches:
            for text in batch.column(0):
                parts.extend(xxhash.xxh3_64_intdigest(k) for k in {*_keys(text.as_py(), min_chars)} - {None})
                if len(parts) >= BUFFER:
                    yield from flush(parts)
                    parts = []
        if parts:
            yield from flush(parts)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of segment to one twice-seen row a segment, holding one segment at a time."""
    now, once, twice = None, np.zeros(SEGMENT, dtype=bool), np.zeros(SEGMENT, dtype=bool)

    def row() -> Iterator[pa.RecordBatch]:
        places = np.flatnonzero(twice)
        if now is not None and len(places):
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([_pack(places)], pa.binary())], ["segment", "twice"])

    for batch in batches:
        for seg, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if seg != now:
                yield from row()
                now = seg
                once[:] = False
                twice[:] = False
            a, b = _unpack(a), _unpack(b)
            twice[a[once[a]]] = True
            twice[b] = True
            once[a] = True
    yield from row()


def repeated_filter(docs: DataFrame, min_chars: int = MIN_CHARS, bits_per_line: int = BITS_PER_LINE, max_bits: int = MAX_BITS) -> tuple[bytes, int]:
    """The twice-seen Bloom filter over all lines, and its number of bits (at most ``max_bits``).

    Every task sends the bits its lines set, not the lines; once-seen filters are merged
    with OR, and where two of them agree the bit counts as seen twice.
    """
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    bits = SEGMENT
    while bits < min(max_bits, lines * bits_per_line):
        bits *= 2
    parts = docs.select("text").mapInArrow(_partial(bits, min_chars), "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment int, twice binary")
    full = np.zeros(bits // 8, dtype=np.uint8)
    for seg, data in merged.collect():  # at most ``bits`` bits in all
        part = np.zeros(SEGMENT, dtype=bool)
        part[_unpack(bytes(data))] = True
        full[seg * SEGMENT // 8:(seg + 1) * SEGMENT // 8] = np.packbits(part)
    return full.tobytes(), bits


def _in_filter(full: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    a, b = _bits(hashes, bits)
    hit = lambda p: full[p >> np.uint64(3)] >> (7 - (p & np.uint64(7))).astype(np.uint8) & 1
    return (hit(a) & hit(b)).astype(bool)


def repeats(docs: DataFrame, min_chars: int = MIN_CHARS, bits_per_line: int = BITS_PER_LINE, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, hashes): for each document the keys it must lose, as 64-bit hashes.

    Only keys that the twice-seen filter holds are shuffled, as full text, to find those
    really present in two documents and the smallest id among them.
    """
    spark = docs.sparkSession
    own = docs.select(id_of("doc_id").alias("id"), "text")
    data, bits = repeated_filter(own, min_chars, bits_per_line, max_bits)
    shared = spark.sparkContext.broadcast(data)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids, keys, hashes = [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    own_keys = {*_keys(text.as_py(), min_chars)} - {None}
                    ids.extend([doc] * len(own_keys))
                    keys.extend(own_keys)
                hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
                hit = np.flatnonzero(_in_filter(full, bits, hashes)) if keys else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in hit], pa.int64()), pa.array(hashes[hit].view(np.int64) if len(hit) else [], pa.int64()), pa.array([keys[i] for i in hit], pa.binary())],
                    ["id", "hash", "key"],
                )

    found = stored(own.mapInArrow(suspects, "id long, hash long, key binary"), "suspects")
    # Written out, so that the join below has a plain exchange on both sides and a hot key can be split.
    first = stored(found.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last"), "confirmed")
    drop = found.join(first, "key").where("id <> first")
    return drop.groupBy("id").agg(F.collect_set("hash").alias("hashes"))  # bounded by the document's own lines


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, bits_per_line: int = BITS_PER_LINE, max_bits: int = MAX_BITS, out: str = "lines") -> DataFrame:
    """``docs`` with a struct ``out``: n_lines before dropping, n_dropped, and the text kept.

    A text is split at line feeds (NULL or empty: one empty line). A line's key is the line
    without white space at both ends and with A-Z in lower case. Keys of at least
    ``min_chars`` code points that two or more documents hold lose all their lines except
    in the document with the smallest doc_id; repeats inside that document stay. A NULL
    doc_id counts as the smallest id, and rows that share a doc_id are one document. Other
    columns are kept as they are.
    """
    lost = repeats(docs, min_chars, bits_per_line, max_bits)
    lost = lost.select(F.col("id").alias(fresh(docs, "lost_id")), F.col("hashes").alias(hashes := fresh(docs, "lost_hashes")))
    joined = docs.join(lost, id_of(docs["doc_id"]) == lost[lost.columns[0]], "left")

    @F.pandas_udf("n_lines long, n_dropped long, text string")
    def keep(texts: pd.Series, lost_: pd.Series) -> pd.DataFrame:
        rows = []
        for text, gone in zip(texts, lost_):
            text = text or ""
            if gone is None or not len(gone):
                rows.append((text.count("\n") + 1, 0, text))
                continue
            gone, lines = {int(x) & (1 << 64) - 1 for x in gone}, text.split("\n")
            kept = [x for x, k in zip(lines, _keys(text, min_chars)) if k is None or xxhash.xxh3_64_intdigest(k) not in gone]
            rows.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "text"])

    return joined.select(*[docs[c] for c in docs.columns], keep(docs["text"], joined[hashes]).alias(out))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without their repeated lines; n_chars follows the text. No document goes."""
    out = fresh(docs, "lines")
    done = dedup_lines(docs, out=out)
    new = {"text": F.col(f"{out}.text"), "n_chars": F.length(f"{out}.text").cast("long")}
    return done.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


SQL = r"""
WITH l AS (
  SELECT rid, doc_id, p AS pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, lines[p] AS line, p
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) t(p))),
m AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT l.*, m.first IS NOT NULL AND m.first <> l.doc_id AS gone FROM l LEFT JOIN m ON l.k = m.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""


@query("op6_line_dedup", SQL)
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.text"), 256).alias("kept_sha256"))
