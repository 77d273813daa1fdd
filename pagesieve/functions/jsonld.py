"""JSON-LD blocks to typed nodes, as one expression over the block's text.

Whether a text is JSON is asked of ``try_parse_json``. The objects are then listed by a fold
over the text's lexemes, because a VARIANT keeps the fields of an object sorted by name and
the audits need them as written. The fold's state is the innermost open object, the open
ones around it and the objects already closed, so nothing limits depth or number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import clean, let, per_session

ENTRY = "struct<key:string,depth:int,kind:string,val:string,child:int>"
FRAME = f"struct<ord:int,key:string,depth:int,have:array<{ENTRY}>>"
CLOSED = f"struct<ord:int,have:array<{ENTRY}>>"
NODE = "struct<ord:int,types:array<string>,fields:map<string,array<string>>,kids:map<string,array<int>>,offered:boolean>"
BLOCK = f"struct<valid:boolean,types:array<string>,nodes:array<{NODE}>>"

# Node properties the audits read (fixed values).
SINGLE = [
    "name", "sku", "gtin14", "gtin13", "gtin12", "gtin8", "gtin", "url", "@id", "price", "lowPrice", "highPrice",
    "priceCurrency", "ratingValue", "ratingCount", "reviewCount",
]
MANY = ["brand", "availability"]
LINKED = ["offers", "aggregateRating", "review", "item"]
READ = ["@type", *SINGLE, *MANY, "image", "contentUrl", *LINKED]
# What stands for an object where a text is wanted, and for an image (fixed values).
NAMED = ["name", "@id", "url"]
PICTURED = ["url", "contentUrl", "@id"]

# Escaped back slashes and quotes become characters that JSON texts can't hold, so that the
# next quote always ends a string.
_SLASH, _QUOTE = "\u0001", "\u0002"
_LEXEMES = r'"[^"]*+"(?:\s*+:)?|[{}\[\]]|[^\s{}\[\]:,"]++'
_CHUNK = 64
_OUTSIDE, _SKIPPED = -1, -2


def _lexemes(raw: Column) -> Column:
    hidden = F.replace(F.replace(raw, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    return F.regexp_extract_all(hidden, F.lit(_LEXEMES), F.lit(0))


def _string(lexeme: Column) -> Column:
    """Content of a quoted lexeme."""
    inner = F.substring_index(F.substring(lexeme, 2, 1 << 30), '"', 1)
    back = F.replace(F.replace(inner, F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))
    decoded = F.try_parse_json(F.concat(F.lit('"'), back, F.lit('"'))).cast("string")
    return F.when(inner.rlike(f"[\\\\{_SLASH}{_QUOTE}]"), decoded).otherwise(inner)


def _number(lexeme: Column) -> Column:
    """A number as scripts print it: no zeros behind the point, no exponent where it can be avoided."""
    plain = F.when(F.contains(lexeme, F.lit(".")), F.regexp_replace(lexeme, r"\.?0+$", "")).otherwise(lexeme)
    wide = lexeme.try_cast("double")
    whole = F.when((wide == F.floor(wide)) & (F.abs(wide) < 1e18), wide.cast("decimal(38,0)").cast("string")).otherwise(wide.cast("string"))
    return F.when(lexeme.rlike("^-?[0-9.]+$"), F.when(plain == "-0", F.lit("0")).otherwise(plain)).when(lexeme.isin("true", "false"), lexeme).otherwise(whole)


def _entry(key: Column, depth: Column, kind: str, val: Column | None = None, child: Column | None = None) -> Column:
    return F.struct(
        key.alias("key"), depth.alias("depth"), F.lit(kind).alias("kind"),
        (F.lit(None).cast("string") if val is None else val).alias("val"), (F.lit(None).cast("int") if child is None else child).alias("child"),
    )


def _frame(ord_: Column, key: Column, depth: Column, have: Column) -> Column:
    return F.struct(ord_.alias("ord"), key.alias("key"), depth.alias("depth"), have.alias("have"))


def _closed_objects(raw: Column) -> Column:
    """All objects of a valid text, in order of their opening brace, with the entries the audits read."""
    none = F.array().cast(f"array<{ENTRY}>")
    outside = _frame(F.lit(_OUTSIDE), F.lit(""), F.lit(0), none)
    start = F.struct(
        F.lit(0).alias("n"), outside.alias("top"), F.array().cast(f"array<{FRAME}>").alias("open"),
        F.array().cast(f"array<{CLOSED}>").alias("some"), F.array().cast(f"array<array<{CLOSED}>>").alias("full"),
    )

    def step(acc: Column, t: Column) -> Column:
        top, n = acc["top"], acc["n"]
        key, depth, have = top["key"], top["depth"], top["have"]
        first = F.left(t, F.lit(1))
        is_key = (first == '"') & t.endswith(":")
        skipped = (top["ord"] == _SKIPPED) | (key == "@context")
        below = F.when(skipped, F.lit(_SKIPPED)).otherwise(n)
        read = key.isin(READ)
        add = lambda entry: F.when(read, F.concat(have, F.array(entry))).otherwise(have)
        with_have = lambda entry: _frame(top["ord"], key, depth, add(entry))
        new_top = (
            # A name that comes twice counts once, with its last value.
            F.when(is_key, let(_string(t), lambda k: _frame(top["ord"], k, F.lit(0), F.filter(have, lambda e: e["key"] != k))))
            .when(t == "[", _frame(top["ord"], key, depth + 1, F.when(depth == 0, add(_entry(key, depth, "a"))).otherwise(have)))
            .when(t == "]", _frame(top["ord"], key, depth - 1, have))
            .when(t == "{", _frame(below, F.lit(""), F.lit(0), none))
            .when(t == "}", F.get(acc["open"], F.size(acc["open"]) - 1))
            .when(first == '"', with_have(_entry(key, depth, "s", _string(t))))
            .when(t == "null", with_have(_entry(key, depth, "z")))
            .otherwise(with_have(_entry(key, depth, "n", _number(t))))
        )
        parent = _frame(top["ord"], key, depth, add(_entry(key, depth, "o", None, below)))
        opened = (
            F.when(t == "{", F.concat(acc["open"], F.array(parent)))
            .when(t == "}", F.slice(acc["open"], F.lit(1), F.greatest(F.size(acc["open"]) - 1, F.lit(0))))
            .otherwise(acc["open"])
        )
        done = F.when((t == "}") & (top["ord"] >= 0), F.concat(acc["some"], F.array(F.struct(top["ord"].alias("ord"), have.alias("have"))))).otherwise(acc["some"])
        # Closed objects are put aside in chunks, so that adding one copies few others.
        pack = F.size(acc["some"]) >= _CHUNK
        return F.struct(
            F.when((t == "{") & ~skipped, n + 1).otherwise(n).alias("n"), new_top.alias("top"), opened.alias("open"),
            F.when(pack, F.slice(done, F.lit(_CHUNK + 1), F.size(done))).otherwise(done).alias("some"),
            F.when(pack, F.concat(acc["full"], F.array(acc["some"]))).otherwise(acc["full"]).alias("full"),
        )

    return F.aggregate(_lexemes(raw), start, step, lambda acc: F.array_sort(F.flatten(F.concat(acc["full"], F.array(acc["some"])))))


def _direct(have: Column, key: Column) -> Column:
    """The entry right under a name."""
    return F.get(F.filter(have, lambda e: (e["key"] == key) & (e["depth"] == 0)), F.lit(0))


def _listed(have: Column, key: Column) -> Column:
    """Values under a name: the one there, or those of the list there."""
    return F.filter(have, lambda e: (e["key"] == key) & (e["depth"] <= 1) & ~e["kind"].isin("a", "z"))


def _of_child(objects: Column, entry: Column, names: list[str], use) -> Column:
    """``use(entry)`` for the first of some names that an entry's object has."""
    have = F.get(objects, entry["child"])["have"]
    found = F.filter(F.transform(F.array(*[F.lit(x) for x in names]), lambda k: _direct(have, k)), use)
    return F.get(found, F.lit(0))


def _text(entry: Column) -> Column:
    return F.when(entry["kind"].isin("s", "n"), clean(entry["val"])).otherwise(F.lit(""))


def _truthy(e: Column) -> Column:
    return F.when(e["kind"] == "s", e["val"] != "").when(e["kind"] == "n", ~e["val"].isin("0", "false")).otherwise(e["kind"].isin("o", "a"))


def _scalar(objects: Column, entry: Column) -> Column:
    """A value as text; an object stands for its name, id or address."""
    return F.when(entry["kind"] == "o", let(_of_child(objects, entry, NAMED, lambda e: e.isNotNull()), lambda e: F.coalesce(_text(e), F.lit("")))).otherwise(_text(entry))


def _image(objects: Column, entry: Column) -> Column:
    return (
        F.when(entry["kind"] == "o", let(_of_child(objects, entry, PICTURED, lambda e: F.coalesce(_truthy(e), F.lit(False))), lambda e: F.coalesce(_scalar(objects, e), F.lit(""))))
        .when(entry["kind"] == "s", _text(entry))
        .otherwise(F.lit(""))
    )


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _node(objects: Column, o: Column) -> Column:
    have = o["have"]
    filled = lambda values: F.filter(values, lambda v: v != "")
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    single = F.transform(_names(SINGLE), lambda k: let(_direct(have, k), lambda e: F.when(e.isNotNull(), pair(k, F.array(_scalar(objects, e))))))
    many = F.transform(_names(MANY), lambda k: pair(k, filled(F.transform(_listed(have, k), lambda e: _scalar(objects, e)))))
    images = pair(F.lit("image"), filled(F.transform(_listed(have, F.lit("image")), lambda e: _image(objects, e))))
    linked = F.transform(_names(LINKED), lambda k: pair(k, F.transform(F.filter(_listed(have, k), lambda e: e["kind"] == "o"), lambda e: e["child"])))
    types = F.filter(_listed(have, F.lit("@type")), lambda e: _truthy(e) & (e["kind"] != "o"))
    return F.struct(
        o["ord"].alias("ord"),
        F.transform(types, lambda e: clean(e["val"])).alias("types"),
        F.map_from_entries(F.concat(F.filter(single, lambda p: p.isNotNull()), many, F.array(images))).alias("fields"),
        F.map_from_entries(F.filter(linked, lambda p: F.size(p["value"]) > 0)).alias("kids"),
        F.coalesce(_truthy(_direct(have, F.lit("offers"))), F.lit(False)).alias("offered"),
    )


def _block(raw: Column) -> Column:
    def build(objects: Column) -> Column:
        types = F.flatten(F.transform(objects, lambda o: F.transform(F.filter(_listed(o["have"], F.lit("@type")), lambda e: _truthy(e) & (e["kind"] != "o")), lambda e: e["val"])))
        return F.struct(F.lit(True).alias("valid"), F.array_sort(F.array_distinct(types)).alias("types"), F.transform(objects, lambda o: _node(objects, o)).alias("nodes"))

    wrong = F.struct(F.lit(False).alias("valid"), F.array().cast("array<string>").alias("types"), F.array().cast(f"array<{NODE}>").alias("nodes"))
    # ``try_parse_json`` ignores what follows a value; inside a list and an object nothing can.
    valid = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), raw, F.lit("}"))).isNotNull()
    return F.when(valid, let(_closed_objects(raw), build)).otherwise(wrong)


@per_session
def parse_blocks(raws: Column) -> Column:
    """``array<struct(valid, types, nodes)>`` of the texts of a page's JSON-LD blocks, in order.

    ``nodes`` has every object outside of ``@context`` in order of its opening brace: its
    types, the properties the audits read as texts, and the places of linked objects.
    """
    return F.coalesce(F.transform(raws, _block), F.array().cast(f"array<{BLOCK}>"))
