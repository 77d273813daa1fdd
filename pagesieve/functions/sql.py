"""The library's expressions as SQL functions.

``register`` makes temporary functions of Column builders: a Column's text is SQL but for the
names of operators, so the builder stays the only definition. Spark inlines such functions
when it analyses a query: their plans are those of the DataFrame API, without a call in them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import html as H
from . import urls as U

# Text constants, and names that stand before an opening bracket.
_NAMES = re.compile(r"('(?:[^'\\]|\\.)*')|([A-Za-z_]\w*|[^\s\w'\"(),\[\]`.]+)(?=\()", re.DOTALL)
_SYNTAX = {"CAST", "TRY_CAST", "struct", "WHEN", "THEN", "ELSE", "IN", "AND", "OR", "NOT"}


def to_sql(column: Column) -> str:
    """A Column built by this library as SQL text."""
    return _NAMES.sub(lambda m: m[1] if m[1] else m[2] if m[2] in _SYNTAX else f"`{m[2]}`", column._jc.toString())


def scalar_functions() -> dict[str, tuple[str, str, Column]]:
    """Name to (parameters, result type, body)."""
    u, text = F.col("u"), F.col("t")
    return {
        "normalize_url": ("u STRING", "STRING", U.normalize_url(u, browser=True)),
        "http_url": ("u STRING", "STRING", U.http_url(u, browser=True)),
        "url_host": ("u STRING", "STRING", U.url_host(u, browser=True)),
        "url_origin": ("u STRING", "STRING", U.url_origin(u, browser=True)),
        "resolve_url": ("u STRING, base_url STRING", "STRING", U.absolute_url(u, F.col("base"), browser=True)),
        "classify_param": ("t STRING", "STRING", U.classify_param(text)),
        "pagination_family": ("u STRING", "STRING", U.pagination_family_key(u)),
        "word_count": ("t STRING", "INT", H.word_count(text)),
    }


LINK = "STRUCT<idx: INT, href: STRING, raw_href: STRING, label: STRING, kind: STRING>"


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; their names.

    ``page_links(url, html)`` gives the links of a page as an array of structs, to be taken
    apart by ``inline`` in the query around it. It is no table function, since Spark turns a
    lateral table function that explodes into a join of the table with itself on its
    arguments, here whole page sources.
    """
    names = []
    for name, (parameters, kind, body) in scalar_functions().items():
        text = to_sql(body)
        if "base_url" in parameters:
            text = _bound("base", to_sql(U.split_url(F.col("base_url"), browser=True)), text)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {text}")
        names.append(name)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION page_links(page_url STRING, source STRING) RETURNS ARRAY<{LINK}> RETURN {_links_sql()}")
    return [*names, "page_links"]


def _bound(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` worked out once under a name: the columns of a subquery in a function are
    written out wherever they are used, in a lambda once per element."""
    return f"get(transform(array({value}), `{name}` -> {body}), 0)"


def _links_sql() -> str:
    from ..operators import extract as X

    def one(link: Column) -> Column:
        kind = X.link_kind(link["raw_href"])
        target = F.when(kind == "http", U.absolute_url(link["raw_href"], F.col("base"), browser=True)).otherwise(link["raw_href"])
        return F.struct(link["idx"].alias("idx"), target.alias("href"), link["raw_href"].alias("raw_href"), link["label"].alias("label"), kind.alias("kind"))

    body = to_sql(F.transform("links", one))
    for stage in reversed(X.stages("links")):
        for k, c in stage.items():
            body = _bound(k, to_sql(c), body)
    return _bound("url", "page_url", _bound("html", "source", body))
