"""Order MinHash fingerprints of texts, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import fresh, id_of, query, table

# Words of a k-mer, signature entries, k-mers of a tuple.
K, BINS, TUPLE = 3, 64, 2
# Ranges of ids a shuffle partition holds, on average.
RANGES = 4
# A k-mer's sort value: 6 bits bin, 33 bits hash, 24 bits position, no sign.
POSITION_BITS, HASH_BITS = 24, 39
SPLIT = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _at(a: Column, i: Column) -> Column:
    return F.get(a, i)


def signature(text: Column, k: int = K, bins: int = BINS, tuple_size: int = TUPLE) -> Column:
    """Order MinHash signature: ``bins`` longs, NULL in a bin that no k-mer falls into.

    1. The text's k-mers are runs of k words (between ASCII white space); a text with fewer
       words is one k-mer, a text without words (or NULL) none.
    2. Each k-mer is numbered by its occurrence: the third time it stands in the text it is
       another element than the first time.
    3. One hash deals the numbered k-mers to bins. In each bin the smallest ``tuple_size``
       are taken, a bin with fewer going on in the next bin's (around the end); put back in
       text order their hashes are hashed together.

    Two texts agree in an entry if the same numbered k-mers are least there and stand in the
    same order, so the share of equal entries falls with edits and with moved passages.
    Positions count modulo 2^24 words. Every text is read as a whole.
    """
    mask = F.lit((1 << POSITION_BITS) - 1).cast("long")
    upper = lambda h: F.shiftleft(F.shiftrightunsigned(h, 64 - HASH_BITS), POSITION_BITS)
    shift = 63 - (bins - 1).bit_length()

    def kmers(h: Column) -> Column:
        n = F.size(h)
        each = F.transform(
            F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))),
            lambda i: upper(F.xxhash64(*[_at(h, i + j) for j in range(k)])).bitwiseOR(i.cast("long").bitwiseAND(mask)),
        )
        return F.when(n == 0, F.array().cast("array<long>")).otherwise(F.sort_array(each))

    def numbered(s: Column) -> Column:
        """Sorted (k-mer, position) values to sorted (hash of k-mer and occurrence number, position) values."""
        same = lambda x, y: F.shiftright(x, POSITION_BITS) == F.shiftright(y, POSITION_BITS)
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | ~same(x, _at(s, i - 1)), i)), lambda i: i.isNotNull())
        value = lambda x, o: upper(F.xxhash64(F.shiftright(x, POSITION_BITS), o)).bitwiseOR(x.bitwiseAND(mask))
        run = lambda st: F.flatten(F.transform(st, lambda a, j: let(
            F.coalesce(_at(st, j + 1), F.size(s)) - a,
            lambda m: F.when(m == 1, F.array(value(_at(s, a), F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0), m - 1), lambda o: value(_at(s, a + o), o))),
        )))
        return F.when(F.size(s) == 0, s).otherwise(F.sort_array(let(starts, run)))

    def least(s: Column) -> Column:
        """The first ``tuple_size`` values of each bin."""
        return F.filter(s, lambda x, i: (i < tuple_size) | (F.shiftright(x, shift) != F.shiftright(_at(s, i - tuple_size), shift)))

    def entries(c: Column) -> Column:
        where = F.transform(c, lambda x: F.shiftright(x, shift).cast("int"))
        size = F.size(c)

        def entry(at: Column) -> Column:
            got = [_at(c, F.pmod(at + j, size)) for j in range(tuple_size)]
            if tuple_size == 2:
                a, b = got
                swapped = a.bitwiseAND(mask) > b.bitwiseAND(mask)
                code = lambda x: F.shiftright(x, POSITION_BITS)
                return F.when(size == 1, F.xxhash64(code(a))).when(swapped, F.xxhash64(code(b), code(a))).otherwise(F.xxhash64(code(a), code(b)))
            ordered = F.array_sort(F.transform(F.array_distinct(F.array(*got)), lambda x: F.struct(x.bitwiseAND(mask).alias("p"), F.shiftright(x, POSITION_BITS).alias("h"))))
            return F.xxhash64(F.transform(ordered, lambda x: x["h"]))

        return let(where, lambda w: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: let(
            F.array_position(w, b).cast("int"), lambda p: F.when(p > 0, entry(p - 1)))))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(kmers(h), lambda s: let(numbered(s), lambda v: let(least(v), entries))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries among those that either signature has; 1 where both are empty."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(F.coalesce(x == y, F.lit(False)).cast("int")))
    return let(F.filter(pairs, lambda x: x.isNotNull()), lambda p: F.when(F.size(p) == 0, F.lit(1.0)).otherwise(
        F.aggregate(p, F.lit(0), lambda s, x: s + x) / F.size(p)))


def rendered(sig: Column) -> Column:
    """Signature as a string: 8 hexadecimal digits an entry, '-' for an empty one."""
    return F.array_join(F.transform(sig, lambda x: F.coalesce(F.lower(F.lpad(F.hex(F.shiftrightunsigned(x, 32)), 8, "0")), F.lit("-"))), ".")


def _numbers(values: list[int]) -> Column:
    return F.from_json(F.lit(str(values)), "array<long>")


def _rank(cuts: list[int], value: Column) -> Column:
    """How many of the ascending ``cuts`` are at most ``value``: first by every k-th of them, then by the k between."""
    k = max(1, math.isqrt(len(cuts)))
    upto = lambda a: F.size(F.filter(a, lambda c: c <= value))
    near = lambda j: (j - 1) * k + upto(F.slice(_numbers(cuts), (j - 1) * k + 1, F.lit(k)))
    return let(upto(_numbers(cuts[::k])), lambda j: F.when(j == 0, 0).otherwise(near(j)))


def with_next(docs: DataFrame, order: str, carried: list[str], parts: int | None = None) -> DataFrame:
    """``docs`` with ``next_<column>`` of the row that follows by ``order`` (after the last: the first).

    Rows are dealt to ranges of ``order``, cut at quantiles of it; a row that begins a range
    is also sent to the range before it. So each task looks ahead within its own range, and
    rows travel once. Ties go by the carried columns' hash.
    """
    parts = parts or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Several ranges a partition, so that chance deals them evenly.
    n = RANGES * parts
    first, cuts = docs.agg(F.min(order), F.percentile_approx(order, [i / n for i in range(1, n)], 100 * n)).first()
    cuts = [] if first is None else sorted({int(first), *map(int, cuts)})  # at most ``n`` numbers
    if not cuts:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    bounds, own = _numbers(cuts), _rank(cuts, F.col(order)) - 1
    rng, ahead, tie = (fresh(docs, x) for x in ("range_", "ahead", "tie"))
    last = len(cuts) - 1
    # The row at a cut is also looked at from the range before it, the very first one from the last range.
    before = F.when(F.get(bounds, F.col(rng)) == F.col(order), F.when(F.col(rng) == 0, F.lit(last)).otherwise(F.col(rng) - 1))
    rows = docs.withColumn(rng, own).withColumn(tie, F.xxhash64(*carried))
    looks = rows.select(*docs.columns, tie, F.explode(F.filter(F.array(
        F.struct(F.col(rng).alias(rng), F.lit(0).alias(ahead)), F.when(before.isNotNull(), F.struct(before.cast("int").alias(rng), F.lit(1).alias(ahead))),
    ), lambda x: x.isNotNull())).alias("at")).select(*docs.columns, tie, F.col(f"at.{rng}").alias(rng), F.col(f"at.{ahead}").alias(ahead))
    w = Window.partitionBy(rng).orderBy(ahead, order, tie)
    seen = looks.repartition(max(parts, len(cuts)), rng).select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return seen.where(F.col(ahead) == 0).drop(rng, ahead, tie)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each row's text and of its edited text, and likeness to that and to the next document's.

    The edited text is the text whose last floor(n_chars / 4) code points are replaced by as
    many first ones of the next document by doc_id (all of it, if it is shorter). A NULL text
    is empty, a NULL doc_id the smallest. Rows of one doc_id follow each other by a hash of
    their text. Texts of at most one word have one k-mer.
    """
    key, sig = "order_id", "sig"
    own = docs.select("doc_id", id_of("doc_id").alias(key), F.coalesce("text", F.lit("")).alias("text")).withColumn(sig, signature(F.col("text")))
    both = with_next(own, key, ["text", sig])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    done = both.withColumn("edited", edited).withColumn("edited_sig", signature(F.col("edited")))
    return done.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        rendered(F.col(sig)).alias("fingerprint"), rendered(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col(sig), F.col("edited_sig")).alias("near_edited"), likeness(F.col(sig), F.col(f"next_{sig}")).alias("near_next"),
    )


@query("op3_order_minhash")
def op3(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
