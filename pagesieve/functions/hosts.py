"""Host names as browsers serialise them: punycode, IPv4 numbers and IPv6 groups, as expressions.

Letters outside ASCII are lower-cased, full-width forms become plain ones and invisible
characters go, then each such label is written in punycode. Composed and decomposed accents
are not brought to one form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let

# Parameters of punycode (fixed values).
_BASE, _LEAST, _MOST, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Other full stops, invisible characters, and what no host may contain (fixed values).
_STOPS = "。．｡"
_INVISIBLE = r"[­͏᠋-᠍​⁠⁤︀-️﻿]"
_FORBIDDEN = r"[\x00-\x20\x7f#%/:<>?@\[\\\]^|]"
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94))
_PLAIN = r"^[a-z0-9!$&'()*+,;=_~.\-]+$"
_NUMBER_LAST = r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$"


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _digit(value: Column) -> Column:
    return F.substring(F.lit(_DIGITS), (value + 1).cast("int"), F.lit(1))


def _variable_length(delta: Column, bias: Column) -> Column:
    """Digits of one distance; the last is the first below its threshold."""

    def step(acc: Column, k: Column) -> Column:
        q, out = acc["q"], acc["out"]
        t = F.least(F.greatest(k - bias, _long(_LEAST)), _long(_MOST))
        return (
            F.when(q < 0, acc)
            .when(q < t, F.struct(_long(-1).alias("q"), F.concat(out, _digit(q)).alias("out")))
            .otherwise(let(t, lambda t: F.struct(F.floor((q - t) / (_BASE - t)).alias("q"), F.concat(out, _digit(t + (q - t) % (_BASE - t))).alias("out"))))
        )

    places = F.array(*[_long(_BASE * i) for i in range(1, 13)])
    return F.aggregate(places, F.struct(delta.alias("q"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def _adapted(delta: Column, count: Column, first: Column) -> Column:
    """Bias after a distance."""

    def step(acc: Column, _: Column) -> Column:
        d = acc["d"]
        more = d > ((_BASE - _LEAST) * _MOST) // 2
        return F.struct(F.when(more, F.floor(d / (_BASE - _LEAST))).otherwise(d).alias("d"), F.when(more, acc["k"] + _BASE).otherwise(acc["k"]).alias("k"))

    halved = F.when(first, F.floor(delta / _DAMP)).otherwise(F.floor(delta / 2))
    start = let(halved, lambda d: d + F.floor(d / count))
    rounds = F.array(*[F.lit(i) for i in range(8)])
    return F.aggregate(
        rounds, F.struct(start.alias("d"), _long(0).alias("k")), step,
        lambda acc: acc["k"] + F.floor((_BASE - _LEAST + 1) * acc["d"] / (acc["d"] + _SKEW)),
    )


def punycode(label: Column) -> Column:
    """A label with letters outside ASCII, encoded (without the ``xn--``)."""
    chars = F.regexp_extract_all(label, F.lit("(?s)."), F.lit(0))

    def encode(points: Column) -> Column:
        plain = F.regexp_replace(label, r"[^\x00-\x7f]", "")
        count = F.length(plain).cast("bigint")
        state = lambda n, delta, bias, done, out: F.struct(n.alias("n"), delta.alias("delta"), bias.alias("bias"), done.alias("done"), out.alias("out"))

        def point(n: Column):
            def step(acc: Column, c: Column) -> Column:
                emit = state(
                    n, _long(0), _adapted(acc["delta"], acc["done"] + 1, acc["done"] == count), acc["done"] + 1,
                    F.concat(acc["out"], _variable_length(acc["delta"], acc["bias"])),
                )
                return F.when(c == n, emit).otherwise(state(n, acc["delta"] + F.when(c < n, 1).otherwise(0), acc["bias"], acc["done"], acc["out"]))

            return step

        def rise(acc: Column, n: Column) -> Column:
            before = state(n, acc["delta"] + (n - acc["n"]) * (acc["done"] + 1), acc["bias"], acc["done"], acc["out"])
            return F.aggregate(points, before, point(n), lambda a: state(n + 1, a["delta"] + 1, a["bias"], a["done"], a["out"]))

        start = state(_long(_FIRST), _long(0), _long(_BIAS), count, F.when(count > 0, F.concat(plain, F.lit("-"))).otherwise(F.lit("")))
        rises = F.array_sort(F.array_distinct(F.filter(points, lambda c: c >= _FIRST)))
        return F.aggregate(rises, start, rise, lambda acc: acc["out"])

    return let(F.transform(chars, lambda c: F.ascii(c).cast("bigint")), encode)


def _named(host: Column) -> Column:
    """Lower-case host with labels in ASCII, NULL if it has a character no host may have."""
    decoded = F.when(F.contains(host, F.lit("%")), F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B")))).otherwise(host)
    mapped = F.regexp_replace(F.lower(F.translate(F.translate(decoded, _STOPS, "..."), *_WIDE)), _INVISIBLE, "")
    encoded = F.array_join(
        F.transform(F.split(mapped, r"\."), lambda x: F.when(x.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("xn--"), punycode(x))).otherwise(x)), "."
    )
    return F.when((mapped != "") & ~mapped.rlike(_FORBIDDEN), encoded)


def _ipv4(host: Column) -> Column:
    """Dotted form of up to four numbers, each decimal, octal (0…) or hexadecimal (0x…); the last fills what is left."""

    def number(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0x0*|^0+(?=.)", "")
        return (
            F.when(F.length(digits) > 12, F.lit(None).cast("bigint"))
            .when(p.rlike("^0x[0-9a-f]*$"), F.coalesce(F.conv(digits, 16, 10).try_cast("bigint"), _long(0)))
            .when(p.rlike("^0[0-7]+$"), F.conv(digits, 8, 10).try_cast("bigint"))
            .when(p.rlike("^(?:0|[1-9][0-9]*)$"), p.try_cast("bigint"))
        )

    def whole(n: Column) -> Column:
        size, last = F.size(n), F.get(n, F.size(n) - 1)
        head = F.slice(n, F.lit(1), F.greatest(size - 1, F.lit(0)))
        ok = (size <= 4) & ~F.exists(n, lambda x: x.isNull()) & ~F.exists(head, lambda x: x > 255) & (last < F.pow(F.lit(256.0), 5 - size))
        value = F.aggregate(F.transform(head, lambda x, i: x * F.pow(F.lit(256.0), 3 - i).cast("bigint")), last, lambda a, x: a + x)
        return F.when(ok, let(value, lambda v: F.concat_ws(".", *[(F.shiftright(v, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)])))

    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), number), whole)


# An IPv4 address at the end of an IPv6 one, and the first run of n zero groups.
_DOTTED = r"(?:^|:)((?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3})$"
_ZEROS = [rf"^(?:(.*?):)??0(?::0){{{n - 1}}}(?::(.*))?$" for n in range(8, 1, -1)]


def _ipv6(inner: Column) -> Column:
    """Groups without leading zeros, the first longest run of two or more zero groups as ``::``."""
    octets = F.transform(F.split(F.regexp_extract(inner, _DOTTED, 1), r"\."), lambda x: F.lpad(F.conv(x, 10, 16), 2, "0"))
    plain = F.when(
        F.contains(inner, F.lit(".")),
        F.when(inner.rlike(_DOTTED), F.concat(F.regexp_replace(inner, r"[^:]*$", ""), F.regexp_replace(F.array_join(octets, ""), "^(....)", "$1:"))),
    ).otherwise(inner)
    # On both sides of "::" (or on its only side) no groups or groups between single colons.
    sides = F.transform(F.split(plain, "::"), lambda s: F.filter(F.split(s, ":"), lambda _: s != ""))

    def fill(s: Column) -> Column:
        none = F.array().cast("array<string>")
        missing = 8 - F.size(F.flatten(s))
        zeros = F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0)))
        return F.when(
            ((F.size(s) == 1) & (missing == 0)) | ((F.size(s) == 2) & (missing > 0)),
            F.flatten(F.array(F.get(s, F.lit(0)), zeros, F.coalesce(F.get(s, F.lit(1)), none))),
        )

    def compress(groups: Column) -> Column:
        short = F.array_join(F.transform(groups, lambda x: F.regexp_replace(x, "^0+(?=.)", "")), ":")
        cut = lambda acc, p: F.when(F.contains(acc, F.lit("::")), acc).otherwise(F.regexp_replace(acc, p, F.lit("$1::$2")))
        joined = F.aggregate(F.lit(_ZEROS), short, cut)
        return F.when(F.forall(groups, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.concat(F.lit("["), joined, F.lit("]")))

    return let(let(sides, fill), compress)


def browser_host(host: Column) -> Column:
    """A host without its port as a browser writes it, NULL if a browser takes it for no host."""

    def build(h: Column) -> Column:
        named = lambda d: F.when(d.rlike(_NUMBER_LAST), _ipv4(d)).otherwise(d)
        return (
            F.when(h.rlike(_PLAIN) & ~h.rlike(_NUMBER_LAST), h)
            .when(h.rlike(r"^\[[0-9a-f:.]+\]$"), _ipv6(F.substring(h, F.lit(2), F.length(h) - 2)))
            .otherwise(let(_named(h), named))
        )

    return let(F.lower(host), build)
