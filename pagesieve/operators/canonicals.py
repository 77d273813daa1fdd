"""Canonical chains over the page table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import keep_true, let
from ..session import stored

MAX_LEVELS = 5
_HOPS = "array<struct<from:string,to:string>>"
_STEP = f"struct<url:string,next:string,final_url:string,count:int,status:int,redirected:boolean,redirects:{_HOPS},error:string>"


def _stops(step: Column) -> Column:
    """Whether a walk ends at this target."""
    return (step["error"] != "") | (step["status"] == 0) | (step["status"] >= 400) | (step["next"] == "") | (step["next"] == step["final_url"])


def _until_repeated(steps: Column) -> Column:
    """The steps before the first URL that came before."""
    urls = F.transform(steps, lambda s: s["url"])
    again = lambda all_: F.array_position(F.transform(all_, lambda u, i: F.array_position(all_, u) <= i), True)
    cut = lambda at: F.when(at > 0, F.slice(steps, F.lit(1), at.cast("int") - 1)).otherwise(steps)
    whole = F.size(F.array_distinct(urls)) == F.size(steps)
    return F.when(whole, steps).otherwise(let(let(urls, again), cut))


def _page_step(pages: DataFrame) -> Column:
    """What a fetch of a page gives."""
    have = set(pages.columns)
    hops = F.coalesce("redirects", F.array().cast(_HOPS)) if "redirects" in have else F.array_repeat(
        F.struct(F.lit("").alias("from"), F.lit("").alias("to")), F.coalesce("hops", F.lit(0)))
    final = F.coalesce(F.nullif("final_url", F.lit("")), "norm_url") if "final_url" in have else F.col("norm_url")
    return F.struct(
        F.col("norm_url").alias("url"), F.coalesce("norm_canonical", F.lit("")).alias("next"), final.alias("final_url"), F.coalesce("canonical_count", F.lit(0)).alias("count"),
        F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("redirected", F.lit(False)).alias("redirected"), hops.cast(_HOPS).alias("redirects"),
        F.coalesce("error", F.lit("")).alias("error"),
    ).cast(_STEP)


def _target_chains(pages: DataFrame, max_levels: int | None) -> DataFrame:
    """``url, steps, end, loop``: each target URL and what follows it, by path doubling.

    In every round a chain that has not ended takes over the chain of the URL at its end, so
    lengths double: chains of n steps need log2(n) rounds. ``end`` is the next URL of a chain
    that goes on, NULL where it ended; a chain that comes back to one of its URLs is a loop
    and ends before it. Chains that ended stay in the files they were written to; only the
    others are joined, with one row per URL on the right.
    """
    step = _page_step(pages)
    # Pages that share a URL count once: the one with the smallest id.
    targets = pages.groupBy(F.col("norm_url").alias("url")).agg(F.min_by(step, "page_id").alias("step"))
    again = F.col("step.next") == F.col("url")
    chains = stored(targets.select(
        "url", F.array("step").alias("steps"), F.when(~_stops(F.col("step")) & ~again, F.col("step.next")).alias("end"), (~_stops(F.col("step")) & again).alias("loop")), "canonical-chains")
    ended, going, length = [], chains, 1
    while max_levels is None or length < max_levels:
        ended.append(going.where("end IS NULL"))
        going = going.where("end IS NOT NULL")
        if going.isEmpty():
            break
        every = going
        for part in ended:
            every = every.unionByName(part)
        tail = every.select(F.col("url").alias("t_url"), F.col("steps").alias("t_steps"), F.col("end").alias("t_end"), F.col("loop").alias("t_loop"))
        both = going.join(tail, F.col("end") == F.col("t_url"), "left").select(
            "url", F.concat("steps", F.coalesce("t_steps", F.array(_unseen(F.col("end"))))).alias("all"), "t_end", F.coalesce("t_loop", F.lit(False)).alias("t_loop"))
        cut = both.select("*", _until_repeated(F.col("all")).alias("steps"))
        back = (F.size("steps") < F.size("all")) | F.coalesce(F.exists("steps", lambda s: s["url"] == F.col("t_end")), F.lit(False))
        going = stored(cut.select("url", "steps", F.when(~back, F.col("t_end")).alias("end"), (back | F.col("t_loop")).alias("loop")), "canonical-chains")
        length *= 2
    for part in ended:
        going = going.unionByName(part)
    return going


def _unseen(url: Column) -> Column:
    """A target that no page is known for."""
    return F.struct(
        url.alias("url"), F.lit("").alias("next"), url.alias("final_url"), F.lit(0).alias("count"), F.lit(0).alias("status"), F.lit(False).alias("redirected"),
        F.array().cast(_HOPS).alias("redirects"), F.lit("network").alias("error")).cast(_STEP)


def canonical_walk(pages: DataFrame, max_levels: int | None = MAX_LEVELS, own: bool = False) -> DataFrame:
    """Follow each page's canonical for up to ``max_levels`` targets, or to the end with None.

    ``pages``: ``page_id, norm_url, norm_canonical, canonical_count, status, redirected,
    error``, and where known ``final_url`` (after redirects, else ``norm_url``) and
    ``redirects`` (array of from/to, else ``hops`` counts them). A walk ends at a fetch
    error, at a missing status or one of 400 and above, and where a target's canonical is
    missing or its own final URL; it is a loop where the canonical was visited before.

    Chains of targets are built once for all pages (see :func:`_target_chains`); a page takes
    the chain of its canonical and is a loop where that leads back to the page. Of pages that
    share a URL the one with the smallest id stands for it; with ``own`` a page that names
    itself as canonical is judged by its own response.
    """
    chains = _target_chains(pages, max_levels)
    itself = (F.col("norm_canonical") == F.col("norm_url")) if own else F.lit(False)
    walks = pages.where("norm_canonical <> ''").select(
        "page_id", "norm_url", F.col("norm_canonical").alias("initial"), F.when(itself, F.array(_page_step(pages))).alias("self"))
    # Such a page needs no chain: it ends there, or comes back to itself after a redirect.
    again = F.exists("self", lambda s: ~_stops(s))
    found = walks.join(chains, F.when(F.col("self").isNull(), F.col("initial")) == F.col("url"), "left").select(
        "page_id", "norm_url", "initial", F.coalesce("self", "steps", F.array(_unseen(F.col("initial")))).alias("steps"), "end", F.coalesce(again, "loop", F.lit(False)).alias("loop"))
    home = F.array_position(F.transform("steps", lambda s: (s["next"] == F.col("norm_url")) & ~_stops(s)), True)
    levels = F.when(F.col("home") > 0, F.slice("steps", F.lit(1), F.col("home").cast("int"))).otherwise(F.col("steps"))
    loop = (F.col("home") > 0) | F.col("loop")
    rows = found.withColumn("home", home).select("page_id", "norm_url", "initial", levels.alias("levels"), loop.alias("loop"), F.col("end").isNotNull().alias("more"))
    if max_levels is None:
        return rows.select("page_id", "norm_url", "initial", "levels", F.lit(False).alias("capped"), "loop")
    over = F.size("levels") > max_levels
    # A walk that is cut before it comes to its end or loop is neither.
    return rows.select(
        "page_id", "norm_url", "initial", F.slice("levels", F.lit(1), F.lit(max_levels)).alias("levels"), (over | (F.col("more") & ~F.col("loop"))).alias("capped"), (F.col("loop") & ~over).alias("loop"))


def canonical_chain(walk: DataFrame) -> DataFrame:
    """Path, stability and issue codes of every walk."""
    c = F.col
    empty = F.array().cast("array<string>")
    append = lambda path, u: F.when(
        (u != "") & (F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit("")) != u), F.concat(path, F.array(u))
    ).otherwise(path)
    start = append(F.array("norm_url"), c("initial"))
    # A target that failed has shown no canonical.
    path = F.aggregate("levels", start, lambda acc, l: F.when(_stops(l), acc).otherwise(append(acc, l["next"])))
    out = walk.withColumns({"path": path, "last": F.try_element_at("levels", F.lit(-1)), "first": F.try_element_at("levels", F.lit(1))})
    loop = c("loop") | (F.size("path") > F.size(F.array_distinct("path")))
    chain = F.flatten(F.transform("levels", lambda l: l["redirects"]))
    hops = F.size(chain)
    trail = F.filter(F.concat(F.transform(F.slice(chain, 1, 1), lambda h: h["from"]), F.transform(chain, lambda h: h["to"])), lambda u: F.coalesce(u, F.lit("")) != "")
    redirect_loop = F.size(trail) > F.size(F.array_distinct(trail))
    redirected = (hops > 0) | F.exists("levels", lambda l: l["redirected"])
    at_level = lambda cond, code: F.transform(F.filter("levels", cond), lambda _: F.lit(code))
    level_codes = F.flatten(
        F.transform(
            "levels",
            lambda l: F.array_compact(
                F.array(
                    F.when(l["error"] != "", F.lit("network-error"))
                    .when(l["status"] == 0, F.lit("missing-status"))
                    .when(l["status"] >= 500, F.lit("http-5xx"))
                    .when(l["status"] >= 400, F.lit("http-4xx")),
                    F.when(l["count"] > 1, F.lit("multiple-canonical")),
                )
            ),
        )
    )
    codes = F.concat(
        level_codes,
        keep_true(
            (loop, F.lit("canonical-loop")),
            (redirect_loop, F.lit("redirect-loop")),
            (F.size("path") > 2, F.lit("multi-hop-canonical")),
            (redirected, F.lit("canonical-redirect")),
            (c("capped"), F.lit("canonical-cap")),
        ),
    )
    stable = (
        (c("last.error") == "") & c("last.status").between(1, 399) & (c("last.next") != "") & (c("last.next") == c("last.final_url"))
        & ~loop & ~c("capped")
    )
    return out.select(
        "page_id",
        "path",
        F.size("levels").alias("levels"),
        (F.size("path") - 1).alias("canonical_hops"),
        hops.alias("redirect_hops"),
        c("first.status").alias("target_status"),
        c("last.status").alias("final_status"),
        c("last.final_url").alias("final_url"),
        stable.alias("stable"),
        loop.alias("loop"),
        redirect_loop.alias("redirect_loop"),
        "capped",
        codes.alias("codes"),
    )
