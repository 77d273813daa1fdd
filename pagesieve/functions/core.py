"""Small building blocks shared by every Column builder."""

from __future__ import annotations

import contextlib
import functools
import re
from collections.abc import Callable, Iterable

from pyspark import SparkContext
from pyspark.errors import utils as errors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space as browsers define it for text (fixed value). Most characters are printable ASCII, so that is asked first.
_SPACES = r"\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = rf"[[^!-~]&&[{_SPACES}]]"
NOT_SPACE = rf"[!-~[^{_SPACES}]]"
# White space that is more than one blank: a single blank is left as it stands.
_LOOSE = rf"{SPACE}(?:(?<! )|(?={SPACE})){SPACE}*+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and evaluate ``body`` on it.

    Inside lambda bodies Spark does not share sub-expressions, so a one-element
    ``transform`` keeps an expensive value from being computed several times.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(value: Column) -> Column:
    """NULL-safe string: missing values behave like the empty string."""
    return F.coalesce(value.cast("string"), F.lit(""))


def clean(value: Column, limit: int | None = None) -> Column:
    """Collapse white space and trim; optionally keep the first ``limit`` characters."""
    out = F.trim(F.regexp_replace(text_of(value), _LOOSE, " "))
    return F.left(out, F.lit(limit)) if limit else out


def str_array(values: Iterable[str]) -> Column:
    values = list(values)
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def keep_true(*pairs: tuple[Column, Column]) -> Column:
    """Array of the values whose condition holds, in the order given."""
    slots = [F.when(cond, value) for cond, value in pairs]
    return F.filter(F.array(*slots), lambda x: x.isNotNull())


def words_array(value: Column) -> Column:
    """Lower-cased white-space separated tokens."""
    return F.filter(F.split(F.lower(text_of(value)), SPACE + "+"), lambda x: x != "")


def js_round(value: Column) -> Column:
    """Half-up rounding to a LONG, as browsers round positive numbers."""
    return F.floor(value + F.lit(0.5))


def _plain_name(value: Column) -> str | None:
    """Name of a column argument that is nothing but a name."""
    text = value._jc.toString() if hasattr(value, "_jc") else ""
    return text if re.fullmatch(r"[A-Za-z_][\w.]*", text) else None


@contextlib.contextmanager
def _no_call_sites():
    """Large expressions need thousands of small calls; skip recording where each was made."""
    saved = getattr(errors, "_enable_debugging_cache", None)
    errors._enable_debugging_cache = False
    try:
        yield
    finally:
        errors._enable_debugging_cache = saved


def per_session(build: Callable) -> Callable:
    """Build an expression once per Spark context; expressions do not depend on the input.

    Column arguments take part only when they are plain names.
    """
    cache: dict = {}

    @functools.wraps(build)
    def wrapper(*args, **kwargs):
        parts = [id(SparkContext._active_spark_context)]
        for a in (*args, *kwargs.values()):
            part = _plain_name(a) if isinstance(a, Column) else a
            if part is None and isinstance(a, Column):
                return build(*args, **kwargs)
            parts.append((type(a).__name__, part))
        key = (*parts, *kwargs)
        if key not in cache:
            with _no_call_sites():
                cache[key] = build(*args, **kwargs)
        return cache[key]

    return wrapper


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` whose results are computed exactly once.

    A filter or join key on an ordinary computed column is pushed below the
    projection together with a copy of its expression, which costs a second
    evaluation of, say, a whole page parse. Optimizer rules do not move
    predicates on generator output, while those on the other columns still reach
    the scan.
    """
    kept = [F.col(c) for c in df.columns if c not in columns]
    # The generator sees plain columns only; nested fields are read in the projection before it.
    staged = df.select(*kept, *[v.alias(f"settled_{k}") for k, v in columns.items()])
    made = F.struct(*[F.col(f"settled_{k}").alias(k) for k in columns])
    return staged.select(*kept, F.inline(F.array(made)))
