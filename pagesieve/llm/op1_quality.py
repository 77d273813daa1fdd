"""Quality rules whose cutoffs are chosen with a bound on false rejection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import id_of, query, slices, stored, table
from .shingles import window_ids, words_of

WINDOW = 5
# Rules: a measure of the text, and the cutoffs to choose from, loosest first. A text above the cutoff is rejected.
RULES: dict[str, list[float]] = {
    "symbol_share": [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.075, 0.05, 0.04, 0.03, 0.02, 0.01],
    "shout_share": [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.075, 0.05],
    "capital_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "repeat_share": [0.2, 0.15, 0.1, 0.075, 0.05, 0.03],
    "dup_line_share": [0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1],
}
# At most ALPHA of the good texts of a stratum may be rejected by the chosen cutoffs, but for a chance of DELTA.
ALPHA, DELTA = 0.05, 0.05
SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
COUNTS = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_shouts long, n_capitals long, n_letters long, n_lines long"


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact binomial (Clopper-Pearson) upper bound on a share of which k of n were seen: wrong with chance delta at most."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if binomial_cdf(k, n, mid) > delta:
            lo = mid
        else:
            hi = mid
    return hi


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws with chance p."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return 1.0 if k >= n else 0.0
    i = np.arange(k + 1)
    log = math.lgamma(n + 1) - _LGAMMA(i + 1) - _LGAMMA(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(log).sum()))


_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for start, texts in slices((x.as_py() for x in batch.column(1)), 1 << 20):
            words, n_words = words_of(texts)
            size = len(texts)
            raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
            ends = np.cumsum([len(t) for t in texts])
            inside = lambda mask: np.diff(np.append(0, np.append(0, np.cumsum(mask))[ends]))
            space = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
            capital, small = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
            # Code points of words: bytes that begin a character and are no white space.
            chars = inside(((raw & 0xC0) != 0x80) & ~space)
            repeated = np.zeros(size, dtype=np.int64)
            code, owner, at = window_ids(texts, WINDOW)
            if len(code):
                order = np.lexsort((at, code, owner))
                o, c, p = owner[order], code[order], at[order]
                same = (c[1:] == c[:-1]) & (o[1:] == o[:-1])
                twice = np.append(same, False) | np.append(False, same)
                covered = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(covered, p[twice], 1)
                np.add.at(covered, np.minimum(p[twice] + WINDOW, len(words)), -1)
                hit = np.cumsum(covered)[:-1] > 0
                repeated = np.bincount(np.repeat(np.arange(size), n_words)[hit], minlength=size)
            own = [[x for x in t.split(b"\n") if x.split(None, 1)] for t in texts]
            lines = [len(x) for x in own]
            dup = [len(x) - len(set(x)) for x in own]
            cols = [n_words, chars, inside(np.isin(raw, SYMBOLS)), dup, repeated, inside(raw == 33), inside(capital), inside(capital | small), lines]
            yield pa.RecordBatch.from_arrays([ids.slice(start, size), *[pa.array(np.asarray(c, dtype=np.int64)) for c in cols]], [x.split(" ")[0] for x in COUNTS.split(", ")])


def measures(counts: DataFrame) -> DataFrame:
    """Counts with the rules' measures; a text without words or letters has 0."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counts.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "shout_share": share("n_shouts", "n_words"), "capital_share": share("n_capitals", "n_letters"),
        "repeat_share": share("n_repeat_words", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
    })


def choose(good: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, n, and a cutoff for each rule) from labelled good texts' measures.

    In each stratum a rule's cutoffs are tried from the loosest to the strictest; the last one
    before the first whose exact upper bound on the share of good texts it rejects is above
    alpha / rules is taken (NULL: none, the rule rejects nothing there). Trying in a fixed
    order needs no further correction, and delta is divided by the number of strata and
    rules (Bonferroni). So with a chance of 1 - delta, in all strata at once, all rules
    together reject at most alpha of the good texts. A stratum without labelled good texts
    has no cutoffs.
    """
    sums = [F.count("*").alias("n")] + [
        F.array(*[F.sum((F.col(rule) > c).cast("long")) for c in cuts]).alias(rule) for rule, cuts in RULES.items()
    ]
    seen = stored(good.groupBy(F.col(stratum).alias("stratum")).agg(*sums), "holdout")
    strata = max(1, seen.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["stratum", "n"]].copy()
            for rule, cuts in RULES.items():
                chosen = []
                for n, rejected in zip(b["n"], b[rule]):
                    cut = None
                    for c, k in zip(cuts, rejected):
                        if upper_bound(int(k), int(n), delta / (strata * len(RULES))) > alpha / len(RULES):
                            break
                        cut = c
                    chosen.append(cut)
                out[rule] = pd.array(chosen, dtype="Float64")
            yield out

    return stored(seen.mapInPandas(run, f"stratum {dict(good.dtypes)[stratum]}, n long, " + ", ".join(f"{r} double" for r in RULES)), "cutoffs")


def in_holdout(doc_id: Column) -> Column:
    """Four fifths of the labelled rows choose cutoffs; the rest is left to check them."""
    return F.pmod(F.xxhash64(F.lit("holdout"), doc_id), F.lit(5)) != 0


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Verdict on every row of ``docs`` (doc_id, text and the stratum's column).

    base_failed: fewer than 10 words, or more than a fifth of them in repeated 5-word
    windows. kept: base_failed is false and no rule's measure is above its cutoff in the
    text's stratum (see ``choose``); ``failed`` lists the rules that reject. Labels with
    quality 1 outside base_failed are the good texts. Words are runs without ASCII white
    space. A NULL text has no words; a NULL stratum is a stratum of its own; a NULL doc_id
    is judged like any other and never labelled; repeated rows are judged alike.
    """
    own = docs.select(id_of("doc_id").alias("id"), "text", F.col(stratum).alias("stratum"))
    counts = own.select("id", "text", "stratum")
    # The counts and the stratum travel together; nothing but these few numbers is stored.
    kind = dict(docs.dtypes)[stratum]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _count_rows(iter([batch.select([0, 1])])):
                yield pa.RecordBatch.from_arrays([*part.columns, batch.column(2).slice(at, part.num_rows)], [*part.schema.names, "stratum"])
                at += part.num_rows

    rows = measures(stored(counts.mapInArrow(run, f"{COUNTS}, stratum {kind}"), "counts"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    known = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("labelled")).distinct()
    good = rows.where(~base).join(known, F.col("id") == F.col("labelled")).where(in_holdout(F.col("id")))
    cuts = choose(good, "stratum", alpha, delta)
    limits = cuts.select(F.col("stratum").alias("of_stratum"), *[F.col(r).alias(f"{r}_cut") for r in RULES])
    joined = rows.join(limits, F.col("stratum").eqNullSafe(F.col("of_stratum")), "left")
    failed = F.filter(F.array(*[F.when(F.col(r) > F.col(f"{r}_cut"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return joined.select(
        F.nullif("id", F.lit(-(2**63))).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), failed.alias("failed"), "stratum",
    )


@query("op1_risk_controlled_quality")
def op1(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
