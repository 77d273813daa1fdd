"""HTML tokenising with Catalyst expressions.

A page becomes one array of tokens (comment, raw-text element, tag, text) with a
single linear regular expression, so comments and script bodies never look like
markup. Possessive quantifiers keep the matcher iterative on long input.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import clean, let, str_array, text_of

_ATTRS = r"""(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+"""
_TAG = rf"</?[a-zA-Z][^\s/>]*+{_ATTRS}>"
_BOGUS = r"<[!?/][^>]*+>"
_RAW = rf"<(script|style|textarea|title|xmp|iframe|noembed|noframes|noscript)(?=[\s/>]){_ATTRS}>(?:.*?</\1(?=[\s/>])[^>]*+>|.*+)"
_TOKEN = rf"(?is)<!--(?:.*?-->|.*+)|{_RAW}|{_TAG}|{_BOGUS}|[^<]++|<"
_STRIP = rf"(?is){_TAG}|{_BOGUS}"

# Elements without content (fixed values).
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
RAW_TEXT = ["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"]
# Elements whose text is never read (fixed values).
UNREAD = ["script", "style", "noscript", "template", "svg"]
# Block elements that end an open paragraph (fixed values).
ENDS_PARAGRAPH = [
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu",
    "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
]


# Named references by first letter, and the older names that also hold without a semicolon.
_ENTITIES: dict[str, dict[str, str]] = {}
for _name, _text in html.entities.html5.items():
    if _name.endswith(";"):
        _ENTITIES.setdefault(_name[0], {})[_name[:-1]] = _text
_BARE = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# A bare name before a letter, digit or "=" is left alone, as in the query part of a URL.
_REFERENCE = rf"(?s)[^&]++|&#[0-9]++;?|&#[xX][0-9a-fA-F]++;?|&[A-Za-z][A-Za-z0-9]*+;|&(?:{'|'.join(_BARE)})(?![A-Za-z0-9=;])|&"
_REPLACED = "\ufffd"
# What 0x80 to 0x9F stand for; the bytes Windows-1252 leaves open stand for themselves.
_C1 = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)]


def code_point(number: Column) -> Column:
    """Character for a code point (``chr`` is limited to bytes)."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def decode_entities(value: Column) -> Column:
    """Replace named and numeric character references as browsers do.

    Numbers that name no character (0, surrogates, beyond Unicode) become U+FFFD, those
    from 0x80 to 0x9F are read as Windows-1252. Unknown names stay as they are.
    """
    table = F.from_json(F.lit(json.dumps(_ENTITIES)), "map<string,map<string,string>>")

    def numeric(body: Column) -> Column:
        digits = F.regexp_replace(body, r"^[xX]?0*", "")
        hexa = F.lower(body).startswith("x")
        known = F.length(digits) <= F.when(hexa, 6).otherwise(7)
        padded = F.concat(F.lit("0"), digits)
        number = F.when(known, F.when(hexa, F.conv(padded, 16, 10)).otherwise(padded).try_cast("bigint"))
        return let(number, lambda n: F.when(n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit(_REPLACED))
                   .when(n.between(0x80, 0x9F), F.coalesce(F.get(str_array(_C1), (n - 0x80).cast("int")), code_point(n))).otherwise(code_point(n)))

    def one(t: Column) -> Column:
        body = F.regexp_replace(t, r"^&#?|;$", "")
        named = F.try_element_at(F.try_element_at(table, F.left(body, F.lit(1))), body)
        return F.when(~t.startswith("&") | (t == "&"), t).otherwise(F.coalesce(F.when(t.startswith("&#"), numeric(body)).otherwise(named), t))

    pieces = F.regexp_extract_all(value, F.lit(_REFERENCE), F.lit(0))
    return F.when(F.contains(value, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(value)


def tokens(html_text: Column) -> Column:
    """``array<struct(n, t)>``: ``n`` is the lower-case tag name ('/x' closes, '' is text, '!' comment)."""
    raw = F.regexp_extract_all(text_of(html_text), F.lit(_TOKEN), F.lit(0))
    name = lambda t: F.when(~t.startswith("<"), F.lit("")).otherwise(
        F.coalesce(F.nullif(F.lower(F.regexp_extract(t, r"^<(/?[a-zA-Z][^\s/>]*)", 1)), F.lit("")), F.lit("!"))
    )
    return let(F.transform(raw, lambda t: F.struct(name(t).alias("n"), t.alias("t"))), _without_templates)


def _without_templates(tok: Column) -> Column:
    """Tokens outside template contents, which are no part of the page."""
    none = F.array().cast("array<struct<a:int,b:int>>")
    marks = F.filter(
        F.transform(tok, lambda x, i: F.when(x["n"].isin("template", "/template"), F.struct(x["n"].alias("n"), i.cast("int").alias("i")))),
        lambda m: m.isNotNull(),
    )

    def step(acc: Column, m: Column) -> Column:
        opens = m["n"] == "template"
        closes = ~opens & (acc["depth"] == 1)
        return F.struct(
            F.greatest(acc["depth"] + F.when(opens, 1).otherwise(-1), F.lit(0)).alias("depth"),
            F.when(opens & (acc["depth"] == 0), m["i"]).otherwise(acc["start"]).alias("start"),
            F.when(closes, F.concat(acc["spans"], F.array(F.struct(acc["start"].alias("a"), m["i"].alias("b"))))).otherwise(acc["spans"]).alias("spans"),
        )

    def spans(ms: Column) -> Column:
        # A template left open hides the rest of the page.
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("start"), none.alias("spans"))
        return F.aggregate(ms, start, step, lambda acc: F.when(acc["depth"] > 0, F.concat(acc["spans"], F.array(F.struct(acc["start"].alias("a"), F.size(tok).alias("b"))))).otherwise(acc["spans"]))

    outside = lambda s: F.filter(tok, lambda x, i: ~F.exists(s, lambda p: (i > p["a"]) & (i < p["b"])))
    return let(marks, lambda ms: F.when(F.size(ms) == 0, tok).otherwise(let(spans(ms), outside)))


def elements(tok: Column, *names: str) -> Column:
    return F.filter(tok, lambda x: x["n"].isin(*names))


_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""


def _attr_pattern(name: str) -> str:
    return (
        rf"(?is)^<[^\s/>]+(?:[\s/]+(?!{name}[\s=/>])[^\s=/>]+(?:\s*=\s*{_VALUE})?)*+"
        rf"[\s/]+({name}(?:\s*=\s*{_VALUE})?)(?=[\s/>])"
    )


def has_attr(tag: Column, name: str) -> Column:
    return tag.rlike(_attr_pattern(name))


def attr_raw(tag: Column, name: str) -> Column:
    """Attribute value as written: '' when absent or without a value."""
    return F.regexp_replace(
        F.regexp_extract(tag, _attr_pattern(name), 1), r"""(?is)^[^=]+(?:=\s*["']?|$)|["']$""", ""
    )


def attr(tag: Column, name: str) -> Column:
    """Decoded attribute value: '' when absent or without a value."""
    return let(attr_raw(tag, name), decode_entities)


def inner_raw(token: Column) -> Column:
    """Body of a raw-text element token (script, style, title, textarea)."""
    return F.regexp_replace(token, rf"(?is)^<[a-zA-Z]+{_ATTRS}>|</[a-zA-Z]+[^>]*>$", "")


def text_content(markup: Column) -> Column:
    """Text of a markup fragment, white space collapsed."""
    return clean(decode_entities(F.regexp_replace(markup, _STRIP, "")))


def markup_only(tok: Column) -> Column:
    """Page source without comments and raw-text elements, whose content is text and no markup."""
    return F.array_join(F.transform(F.filter(tok, lambda x: ~x["n"].isin("!", *RAW_TEXT)), lambda x: x["t"]), "")


def runs(markup: Column, name_pattern: str) -> Column:
    """Start tags matching ``name_pattern`` with what follows up to the next such tag."""
    rx = rf"(?is)<(?:{name_pattern})(?=[\s/>]){_ATTRS}>(?:[^<]++|<(?!/?(?:{name_pattern})[\s/>]))*+"
    return F.regexp_extract_all(markup, F.lit(rx), F.lit(0))


def body_tokens(tok: Column) -> Column:
    names = F.transform(tok, lambda x: x["n"])
    at = F.greatest(F.array_position(names, "body"), F.array_position(names, "/head")).cast("int")
    return F.slice(tok, at + 1, F.greatest(F.size(tok), F.lit(1)))


def raw_text(tok: Column) -> Column:
    """All text below the tokens, script and style bodies included."""
    piece = (
        lambda x: F.when(x["n"] == "", decode_entities(x["t"]))
        .when(x["n"].isin(*RAW_TEXT), inner_raw(x["t"]))
        .otherwise(F.lit(""))
    )
    return F.array_join(F.transform(tok, piece), "")


def hidden_reason(tag: Column) -> Column:
    """Why an element is hidden by its own attributes, or NULL."""
    style = F.lower(F.regexp_replace(attr_raw(tag, "style"), r"\s+", ""))
    prop = lambda name, value: style.rlike(rf"(?:^|;){name}:(?:{value})(?:!important)?(?:;|$)")
    reason = (
        F.when(has_attr(tag, "hidden"), F.lit("hidden attribute"))
        .when(F.lower(attr_raw(tag, "aria-hidden")) == "true", F.lit("aria-hidden"))
        .when(prop("display", "none"), F.lit("display:none"))
        .when(prop("visibility", "hidden|collapse"), F.lit("visibility:hidden"))
        .when(prop("content-visibility", "hidden"), F.lit("content-visibility:hidden"))
    )
    return F.when(tag.rlike(r"(?i)hidden|display|visibility"), reason)


def element_label(tag: Column, name: Column) -> Column:
    ident = attr_raw(tag, "id")
    classes = F.slice(F.filter(F.split(clean(attr_raw(tag, "class")), " "), lambda c: c != ""), 1, 2)
    return F.concat(
        name,
        F.when(ident != "", F.concat(F.lit("#"), ident)).otherwise(F.lit("")),
        F.array_join(F.transform(classes, lambda c: F.concat(F.lit("."), c)), ""),
    )


WORD = r"[\p{L}\p{N}]+(?:['’\-][\p{L}\p{N}]+)*"


def word_count(value: Column) -> Column:
    """Unicode words; apostrophes and hyphens join. White space stands in no word, so it is left as it is."""
    return F.regexp_count(text_of(value), F.lit(WORD))


def _implied_end(n: Column) -> tuple[Column, Column]:
    """Open elements a start tag closes, and the elements that shield them."""
    none = str_array([])
    closes = (
        F.when(n == "li", str_array(["li"]))
        .when(n.isin("dt", "dd"), str_array(["dt", "dd"]))
        .when(n == "tr", str_array(["tr"]))
        .when(n.isin("td", "th"), str_array(["td", "th"]))
        .when(n.isin("thead", "tbody", "tfoot"), str_array(["thead", "tbody", "tfoot"]))
        .when(n == "option", str_array(["option"]))
        .when(n.isin(*ENDS_PARAGRAPH), str_array(["p"]))
        .otherwise(none)
    )
    shield = (
        F.when(n == "li", str_array(["ul", "ol", "menu"]))
        .when(n.isin("dt", "dd"), str_array(["dl"]))
        .when(n.isin("td", "th"), str_array(["tr", "table"]))
        .when(n.isin("tr", "thead", "tbody", "tfoot"), str_array(["table"]))
        .when(n == "option", str_array(["select", "datalist"]))
        .otherwise(str_array(["button", "td", "th", "caption", "object", "template"]))
    )
    return closes, shield


def listing_links(tok: Column) -> Column:
    """``links`` of :func:`tree_walk` alone; a page none of whose elements says "item" has none and is not walked."""
    marked = F.exists(
        tok, lambda x: F.contains(x["t"], F.lit("item")) & ~x["n"].isin("", "!", *VOID, *RAW_TEXT) & ~x["n"].startswith("/")
    )
    return F.when(marked, tree_walk(tok, "stack", "listing", "links")["links"]).otherwise(str_array([]))


def tree_walk(tok: Column, *only: str) -> Column:
    """Fold the tokens with an open-element stack.

    Returns ``struct(stack, nodes, depth, hid, unread, listing, visible, hidden, roots, links)``:
    element count, maximum depth, visible and hidden word counts, the hidden roots and
    the links found inside product or item-list microdata. ``only`` names the fields wanted:
    those that need neither words nor hidden roots are folded without them.
    """
    counts = not only

    def classify(x: Column) -> Column:
        n = x["n"]
        is_text, is_close = n == "", n.startswith("/")
        leaf = n.isin(*VOID, *RAW_TEXT)
        kind = F.when(is_text, F.lit(0)).when(is_close, F.lit(2)).when(leaf, F.lit(3)).otherwise(F.lit(1))
        closes, shield = _implied_end(n)
        has_item = F.contains(x["t"], F.lit("item"))
        in_list = F.when(
            has_item & (kind == 1),
            F.contains(F.lower(attr_raw(x["t"], "itemtype")), F.lit("schema.org/product"))
            | (F.lower(attr_raw(x["t"], "itemprop")) == "itemlistelement"),
        )
        reason = hidden_reason(x["t"])
        root = F.when(
            kind.isin(1, 3) & ~n.isin(*UNREAD),
            let(
                reason,
                lambda r: F.when(
                    r.isNotNull(), F.struct(element_label(x["t"], n).alias("element"), r.alias("reason"))
                ),
            ),
        )
        words = F.when(
            is_text | (n == "textarea"), word_count(decode_entities(F.when(is_text, x["t"]).otherwise(inner_raw(x["t"]))))
        ).otherwise(F.lit(0))
        return F.struct(
            n.alias("n"),
            kind.alias("k"),
            F.when(is_close, F.array(F.substring(n, 2, 64))).when(kind != 0, closes).otherwise(str_array([])).alias("c"),
            F.when(is_close, str_array([])).otherwise(shield).alias("s"),
            *([words.alias("w"), root.alias("root")] if counts else []),
            F.coalesce(in_list, F.lit(False)).alias("li"),
            F.when((n == "a") & has_attr(x["t"], "href"), attr_raw(x["t"], "href")).alias("href"),
        )

    last_of = lambda stack, names: F.coalesce(
        F.array_max(F.transform(stack, lambda e, i: F.when(F.array_contains(names, e), i + 1).otherwise(F.lit(0)))),
        F.lit(0),
    )
    # The fields asked for, in their order.
    pick = lambda *fields: F.struct(*[v.alias(k) for k, v in fields if counts or k in only])
    start = pick(
        ("stack", F.array().cast("array<string>")),
        ("nodes", F.lit(0)),
        ("depth", F.lit(0)),
        ("hid", F.lit(0)),
        ("unread", F.lit(0)),
        ("listing", F.lit(0)),
        ("visible", F.lit(0)),
        ("hidden", F.lit(0)),
        ("roots", F.array().cast("array<struct<element:string,reason:string>>")),
        ("links", F.array().cast("array<string>")),
    )

    def step(acc: Column, x: Column) -> Column:
        def at_depth(d: Column) -> Column:
            opens, leaf, text = x["k"] == 1, x["k"] == 3, x["k"] == 0
            below = lambda mark: F.when(mark > d, F.lit(0)).otherwise(mark)
            cut = F.when(d < F.size(acc["stack"]), F.slice(acc["stack"], F.lit(1), d)).otherwise(acc["stack"])
            listing = below(acc["listing"])
            counted = []
            if counts:
                unread, hid = below(acc["unread"]), below(acc["hid"])
                starts_unread = opens & x["n"].isin(*UNREAD) & (unread == 0)
                starts_hidden = (opens | leaf) & (unread == 0) & (hid == 0) & x["root"].isNotNull()
                count = F.when((text | leaf) & (unread == 0), x["w"]).otherwise(F.lit(0))
                counted = [
                    ("nodes", acc["nodes"] + F.when(opens | leaf, 1).otherwise(0)),
                    ("depth", F.when(opens | leaf, F.greatest(acc["depth"], d + 1)).otherwise(acc["depth"])),
                    ("hid", F.when(starts_hidden & opens, d + 1).otherwise(hid)),
                    ("unread", F.when(starts_unread, d + 1).otherwise(unread)),
                    ("visible", acc["visible"] + F.when(hid == 0, count).otherwise(0)),
                    ("hidden", acc["hidden"] + F.when(hid > 0, count).otherwise(0)),
                    ("roots", F.when(starts_hidden, F.concat(acc["roots"], F.array(x["root"]))).otherwise(acc["roots"])),
                ]
            made = {
                "stack": F.when(opens, F.concat(cut, F.array(x["n"]))).otherwise(cut),
                "listing": F.when(opens & x["li"] & (listing == 0), d + 1).otherwise(listing),
                "links": F.when(x["href"].isNotNull() & (listing > 0), F.concat(acc["links"], F.array(x["href"]))).otherwise(acc["links"]),
                **dict(counted),
            }
            order = ("stack", "nodes", "depth", "hid", "unread", "listing", "visible", "hidden", "roots", "links")
            return pick(*[(k, made[k]) for k in order if k in made])

        size = F.size(acc["stack"])
        hit = last_of(acc["stack"], x["c"])
        depth = F.when((F.size(x["c"]) == 0) | (hit == 0), size).otherwise(
            F.when(hit > last_of(acc["stack"], x["s"]), hit - 1).otherwise(size)
        )
        return let(depth, at_depth)

    usable = F.filter(tok, lambda x: x["n"] != "!")
    return F.aggregate(F.transform(usable, classify), start, step)
