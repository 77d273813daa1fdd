"""URL functions as Catalyst expressions.

URLs are split with one regular expression instead of ``parse_url`` because the
web's rules differ from ``java.net.URI``: spaces and non-ASCII characters are
percent-encoded, default ports and dot segments disappear, and back slashes count
as slashes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import clean, let, per_session, text_of
from .hosts import browser_host

_SEP = "\u0001"
_HTTP = r"^(?i)(https?):[/\\]*([^/\\?#@]*@)?([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
_HOST_OK = r"(?i)^(?:[^\s#%/:<>?@\[\\\]^|]+|\[[0-9a-f:.]+\])(?::\d{1,5})?$"
_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
_UNSAFE = r"[^!#-;=?-_a-z|~]"

# A URL that is written as a browser writes it: lower-case host with a name last, no port or user, nothing to encode, no dot segments.
_PLAIN = (
    r"^https?://(?![^?#]*/(?:\.|%2[eE]))[a-z0-9.\-]+\.[a-z][a-z0-9\-]*/[!$%&()*+,\-./0-9:;=@A-Z_a-z~]*"
    r"(?:\?[!$%&()*+,\-./0-9:;=?@A-Z_a-z~]*)?(?:#[!-~]*)?\z"
)

# Parameter names by meaning (fixed values).
FILTER_PARAMS = [
    "filter", "filters", "facet", "facets", "brand", "manufacturer", "color", "colour", "size",
    "material", "attribute", "attributes", "option", "options", "min_price", "max_price", "price_min",
    "price_max", "availability", "stock", "category", "tag",
]
SORT_PARAMS = ["sort", "order", "orderby", "order_by", "dir", "direction"]
PAGE_PARAMS = ["page", "p", "pg", "pageno", "page_no", "offset", "start"]
TRACKING_PARAMS = ["gclid", "dclid", "fbclid", "msclkid", "yclid", "mc_cid", "mc_eid"]
SESSION_PARAMS = ["sid", "session", "sessionid", "session_id", "phpsessid", "jsessionid"]
VARIANT_PARAMS = [
    "variant", "sku", "size", "color", "colour", "option", "options",
    "attribute", "attributes", "style", "material",
]


def _trimmed(u: Column) -> Column:
    return F.regexp_replace(text_of(u), r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")


def _percent(part: Column) -> Column:
    """Percent-encode what a URL may not contain; plain ASCII takes the short way."""
    encoded = F.array_join(
        F.transform(
            F.regexp_extract_all(part, F.lit(f"(?s){_UNSAFE}+|[!#-;=?-_a-z|~]+"), F.lit(0)),
            lambda c: F.when(c.rlike(_UNSAFE), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c),
        ),
        "",
    )
    return F.when(part.rlike(_UNSAFE), encoded).otherwise(part)


def _fold_dots(path: Column) -> Column:
    segments = F.split(F.substring(path, 2, 1 << 30), "/")
    is_up = lambda s: F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e")
    is_here = lambda s: F.lower(s).isin(".", "%2e")
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(is_up(s), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(is_here(s), acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"))
    full = F.when(joined == "/", joined).otherwise(F.concat(joined, tail))
    return F.when(path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), full).otherwise(path)


# Scheme and user, host, and the rest of a reference that names its host; hosts that need more than lower case.
_PLACE = r"(?is)^((?:https?:[/\\]*|[/\\]{2})(?:[^/\\?#@]*@)?)(\[[^\]]*\]|[^/\\?#:@]*)((?::\d*)?(?:[/\\?#].*)?)$"
_ODD = r"(?i)^[\x00-\x20]*(?:https?:[/\\]*|[/\\]{2})[^/\\?#]*?(?:[^\x00-\x7f/\\?#]|%|\[|(?<=[./\\@])(?:[0-9]+|0x[0-9a-f]*)\.?(?::\d*)?(?:[/\\?#\x00-\x20]|$))"


@per_session
def browser_url(u: Column) -> Column:
    """A URL or reference with its host as a browser writes it; everything else as it is.

    For the places where URLs come in: what is resolved, compared or joined later then has
    one form. A host that no browser accepts stays as written.
    """
    text = _trimmed(u)
    host = F.regexp_extract(text, _PLACE, 2)
    whole = lambda h: F.concat(F.regexp_extract(text, _PLACE, 1), h, F.regexp_extract(text, _PLACE, 3))
    # The other URLs, nearly all, cost one look at their beginning.
    return F.when(text_of(u).rlike(_ODD), F.coalesce(let(let(host, browser_host), whole), u)).otherwise(u)


@per_session
def split_url(u: Column, browser: bool = False) -> Column:
    """``struct(scheme, userinfo, host, path, query, fragment)`` of an http(s) URL, else NULL.

    ``host`` carries a non-default port; ``query`` and ``fragment`` keep their mark.
    ``browser`` here and below: see :func:`browser_url`.
    """
    u = browser_url(u) if browser else u

    def build(p: Column) -> Column:
        scheme = F.lower(p[0])
        host = F.when(scheme == "https", F.regexp_replace(F.lower(p[2]), r":(?:0*443)?$", "")).otherwise(
            F.regexp_replace(F.lower(p[2]), r":(?:0*80)?$", "")
        )
        slashes = F.replace(p[3], F.lit("\\"), F.lit("/"))
        path = _fold_dots(_percent(F.when(slashes == "", F.lit("/")).otherwise(slashes)))
        query = F.replace(_percent(p[4]), F.lit("'"), F.lit("%27"))
        port = F.regexp_extract(F.get(p, F.lit(2)), r":0*(\d+)$", 1)
        # Digits without leading zeros, compared as text: a cast of the empty port raises and catches an error per URL.
        ok = (F.size(p) == 6) & F.get(p, F.lit(2)).rlike(_HOST_OK) & ((F.length(port) < 5) | ((F.length(port) == 5) & (port <= "65535")))
        return F.when(
            ok,
            F.struct(
                scheme.alias("scheme"),
                p[1].alias("userinfo"),
                host.alias("host"),
                path.alias("path"),
                query.alias("query"),
                _percent(p[5]).alias("fragment"),
            ),
        )

    marked = F.regexp_replace(_trimmed(u), _HTTP, _SEP.join(f"${i}" for i in range(1, 7)))
    return let(F.split(marked, _SEP), build)


def origin_of(parts: Column) -> Column:
    return F.concat(parts["scheme"], F.lit("://"), parts["host"])


def hostname_of(parts: Column) -> Column:
    return F.regexp_replace(parts["host"], r":\d+$", "")


def href_of(parts: Column, fragment: bool = False) -> Column:
    pieces = [parts["scheme"], F.lit("://"), parts["userinfo"], parts["host"], parts["path"], parts["query"]]
    return F.concat(*pieces, *([parts["fragment"]] if fragment else []))


def _other_scheme(u: Column, fragment: bool) -> Column:
    s = _trimmed(u)
    return s if fragment else F.regexp_replace(s, "#.*$", "")


@per_session
def href(u: Column, *, fragment: bool = True, on_invalid: str = "raw", http_only: bool = False, browser: bool = False) -> Column:
    """Serialised URL. ``on_invalid`` is ``raw``, ``trim``, ``empty`` or ``null``."""
    fallback = {
        "raw": text_of(u),
        "trim": F.trim(text_of(u)),
        "empty": F.lit(""),
        "null": F.lit(None).cast("string"),
    }[on_invalid]

    def pick(parts: Column) -> Column:
        out = F.when(parts.isNotNull(), href_of(parts, fragment))
        if not http_only:
            other = text_of(u).rlike(_SCHEME) & ~text_of(u).rlike(r"^(?i)\s*https?:")
            out = out.when(other, _other_scheme(u, fragment))
        return out.otherwise(fallback)

    # Most URLs need no work: one look tells, and only the others are split and put together again.
    plain = u.rlike(_PLAIN) & ~F.contains(u, F.lit("#")) if fragment else u.rlike(_PLAIN)
    return F.when(plain, F.substring_index(u, "#", 1)).otherwise(let(split_url(u, browser), pick))


@per_session
def normalize_url(u: Column, on_invalid: str = "trim", http_only: bool = False, browser: bool = False) -> Column:
    """Comparable URL: serialised and without fragment; '' stays ''."""
    return href(u, fragment=False, on_invalid=on_invalid, http_only=http_only, browser=browser)


@per_session
def http_url(u: Column, browser: bool = False) -> Column:
    """Comparable URL if it is http(s), else ''."""
    return normalize_url(u, on_invalid="empty", http_only=True, browser=browser)


@per_session
def absolute_url(ref: Column, base: Column, browser: bool = False) -> Column:
    """Resolve ``ref`` against ``base``, a struct from :func:`split_url`; fragment kept."""

    def build(r: Column) -> Column:
        origin = origin_of(base)
        folder = F.regexp_replace(base["path"], r"[^/]*$", "")
        joined = (
            F.when(r.rlike(_SCHEME) | base.isNull(), r)
            .when(r.rlike(r"^[/\\]{2}"), F.concat(base["scheme"], F.lit(":"), r))
            .when(r.rlike(r"^[/\\]"), F.concat(origin, r))
            .when(r.startswith("?"), F.concat(origin, base["path"], r))
            .when(r.startswith("#"), F.concat(origin, base["path"], base["query"], r))
            .otherwise(F.concat(origin, folder, r))
        )
        return F.when(r == "", F.lit("")).otherwise(let(joined, lambda j: href(j)))

    return let(_trimmed(browser_url(ref) if browser else ref), build)


@per_session
def url_host(u: Column, browser: bool = False) -> Column:
    """Lower-case host name without port, '' when the URL is not http(s)."""
    slow = F.coalesce(let(split_url(u, browser), hostname_of), F.lit(""))
    return F.when(u.rlike(_PLAIN), F.regexp_extract(u, "^https?://([^/]+)", 1)).otherwise(slow)


@per_session
def url_origin(u: Column, browser: bool = False) -> Column:
    slow = F.coalesce(let(split_url(u, browser), origin_of), F.lit(""))
    return F.when(u.rlike(_PLAIN), F.regexp_extract(u, "^https?://[^/]+", 0)).otherwise(slow)


@per_session
def url_path(u: Column) -> Column:
    """Path of an http(s) URL, else NULL."""
    return F.when(u.rlike(_PLAIN), F.regexp_extract(u, "^https?://[^/]+([^?#]*)", 1)).otherwise(let(split_url(u), lambda s: s["path"]))


def same_host(a: Column, b: Column) -> Column:
    return (url_host(a) != "") & (url_host(a) == url_host(b))


@per_session
def is_third_party(u: Column, page: Column) -> Column:
    """Different origin; unknown URLs never count as third party."""
    origins = F.struct(url_origin(u).alias("own"), url_origin(page).alias("of_page"))
    return let(origins, lambda o: (o["own"] != "") & (o["of_page"] != "") & (o["own"] != o["of_page"]))


def strip_trailing_slash(path: Column) -> Column:
    out = F.regexp_replace(path, "/+$", "")
    return F.when(out == "", F.lit("/")).otherwise(out)


def search_params(parts: Column) -> Column:
    """Ordered ``array<struct(name, value)>`` of a split URL's query, form-decoded."""
    decode = lambda s: F.coalesce(F.try_url_decode(s), s)
    pairs = F.filter(F.split(F.substring(parts["query"], 2, 1 << 30), "&"), lambda x: x != "")
    return F.coalesce(
        F.transform(
            pairs,
            lambda kv: F.struct(
                decode(F.substring_index(kv, "=", 1)).alias("name"),
                decode(F.when(F.contains(kv, F.lit("=")), F.regexp_replace(kv, r"^[^=]*=", "")).otherwise(F.lit(""))).alias(
                    "value"
                ),
            ),
        ),
        F.array().cast("array<struct<name:string,value:string>>"),
    )


@per_session
def query_params(u: Column) -> Column:
    """Ordered parameters with a non-blank value, each with its class."""
    return F.transform(
        F.filter(let(split_url(u), search_params), lambda p: clean(p["value"]) != ""),
        lambda p: F.struct(
            p["name"].alias("name"), clean(p["value"]).alias("value"), classify_param(p["name"]).alias("kind")
        ),
    )


def classify_param(name: Column) -> Column:
    n = F.lower(clean(name))
    return (
        F.when(n == "", F.lit("other"))
        .when(n.startswith("utm_") | n.isin(TRACKING_PARAMS), F.lit("tracking"))
        .when(n.isin(SESSION_PARAMS) | F.contains(n, F.lit("session")), F.lit("session"))
        .when(n.isin(PAGE_PARAMS) | n.rlike(r"^page\d*$"), F.lit("pagination"))
        .when(n.isin(SORT_PARAMS), F.lit("sort"))
        .when(n.isin(FILTER_PARAMS) | n.rlike(r"^(filter|facet|attr|attribute|option)[_.\-]"), F.lit("filter"))
        .otherwise(F.lit("other"))
    )


def is_page_param(name: Column) -> Column:
    n = F.lower(clean(name))
    return n.isin(PAGE_PARAMS) | n.rlike(r"^page\d*$")


def is_variant_param(name: Column) -> Column:
    n = F.lower(name)
    return n.isin(VARIANT_PARAMS) | n.rlike(r"^(variant|option|attribute)_")


def _rebuild(params: Column) -> Column:
    body = F.array_join(
        F.transform(params, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&"
    )
    return F.when(F.size(params) == 0, F.lit("")).otherwise(F.concat(F.lit("?"), body))


def _without_params(parts: Column, drop, path: Column | None = None) -> Column:
    """URL with the matching parameters removed; an untouched query stays as written."""
    params = search_params(parts)
    kept = F.filter(params, lambda p: ~drop(p["name"]))
    query = F.when(F.exists(params, lambda p: drop(p["name"])), _rebuild(kept)).otherwise(parts["query"])
    return F.concat(
        parts["scheme"], F.lit("://"), parts["userinfo"], parts["host"], parts["path"] if path is None else path, query
    )


def _unpaged_path(path: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(path, r"(?i)(?:^|/)(?:page|p)/\d+(?=/|$)", ""), "/+", "/")
    return F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def _strip(u: Column, build) -> Column:
    return F.coalesce(let(split_url(u), build), F.lit(""))


@per_session
def strip_pagination(u: Column) -> Column:
    return _strip(
        u, lambda s: _without_params(s, lambda n: classify_param(n) == "pagination", _unpaged_path(s["path"]))
    )


@per_session
def strip_non_content(u: Column) -> Column:
    dropped = ("filter", "sort", "tracking", "session", "pagination")
    return _strip(u, lambda s: _without_params(s, lambda n: classify_param(n).isin(*dropped)))


@per_session
def strip_variant_params(u: Column) -> Column:
    return _strip(u, lambda s: _without_params(s, is_variant_param))


@per_session
def variant_params(u: Column) -> Column:
    """Distinct names of variant-like parameters that have a value."""
    params = F.filter(
        let(split_url(u), search_params), lambda p: is_variant_param(p["name"]) & (clean(p["value"]) != "")
    )
    empty = F.array().cast("array<string>")
    return F.coalesce(F.array_distinct(F.transform(params, lambda p: p["name"])), empty)


def _leading_int(value: Column) -> Column:
    return F.regexp_extract(value, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def _page_in_path(path: Column) -> Column:
    return F.regexp_extract(path, r"(?i)(?:^|/)(?:page|p)/(\d+)(?:/|$)", 1)


@per_session
def pagination_param(u: Column) -> Column:
    """``struct(name, number)`` of the first usable page parameter or path part, else NULL."""

    def build(s: Column) -> Column:
        offset = lambda n: F.lower(n).isin("offset", "start")
        usable = lambda p: (classify_param(p["name"]) == "pagination") & (_leading_int(p["value"]) >= 1)
        hit = F.get(F.filter(search_params(s), usable), F.lit(0))
        by_path = _page_in_path(s["path"])

        def pick(h: Column) -> Column:
            number = F.when(offset(h["name"]), F.lit(None)).otherwise(_leading_int(h["value"]))
            path_number = by_path.try_cast("bigint")
            return F.when(
                h.isNotNull(), F.struct(h["name"].alias("name"), number.cast("bigint").alias("number"))
            ).when(
                by_path != "",
                F.struct(
                    F.lit("path").alias("name"), F.when(path_number != 0, path_number).alias("number")
                ),
            )

        return let(hit, pick)

    return let(split_url(u), build)


@per_session
def page_signal(u: Column) -> Column:
    """``struct(detected, number, source, raw)``: the first page-like parameter decides."""

    def build(s: Column) -> Column:
        hit = F.get(F.filter(search_params(s), lambda p: is_page_param(p["name"])), F.lit(0))
        by_path = F.coalesce(_page_in_path(s["path"]), F.lit(""))

        def make(found, number, source, raw):
            return F.struct(
                F.lit(found).alias("detected"),
                number.cast("bigint").alias("number"),
                source.alias("source"),
                raw.alias("raw"),
            )

        def pick(h: Column) -> Column:
            value = _leading_int(h["value"])
            number = F.when(~F.lower(h["name"]).isin("offset", "start") & (value >= 1), value).when(
                F.lower(h["name"]).isin("offset", "start") & (value < 1), F.lit(None)
            )
            path_number = by_path.try_cast("bigint")
            return (
                F.when(h.isNotNull(), make(True, number, h["name"], h["value"]))
                .when(by_path != "", make(True, F.when(path_number != 0, path_number), F.lit("path"), by_path))
                .otherwise(make(False, F.lit(1), F.lit(""), F.lit("")))
            )

        return let(hit, pick)

    return let(split_url(u), build)


@per_session
def pagination_family_key(u: Column) -> Column:
    """URL shared by all pages of a series: page parts dropped, parameters sorted."""

    def build(s: Column) -> Column:
        indexed = F.transform(
            F.filter(search_params(s), lambda p: ~is_page_param(p["name"])),
            lambda p, i: F.struct(p["name"].alias("name"), i.alias("i"), p["value"].alias("value")),
        )
        path = _unpaged_path(s["path"])
        trimmed = F.when((F.length(path) > 1) & path.endswith("/"), F.left(path, F.length(path) - 1)).otherwise(path)
        return F.concat(
            s["scheme"], F.lit("://"), s["userinfo"], s["host"], trimmed, _rebuild(F.array_sort(indexed))
        )

    return _strip(u, build)


@per_session
def url_breadcrumb(u: Column) -> Column:
    """Host and up to three decoded path parts, as search results show them."""

    def build(s: Column) -> Column:
        plus = lambda x: F.replace(x, F.lit("+"), F.lit("%2B"))
        names = F.transform(
            F.slice(F.filter(F.split(s["path"], "/"), lambda x: x != ""), 1, 3),
            lambda x: F.coalesce(F.try_url_decode(plus(x)), x),
        )
        return F.array_join(F.concat(F.array(hostname_of(s)), names), " › ")

    return F.coalesce(let(split_url(u), build), F.lit(""))
