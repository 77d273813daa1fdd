import ipaddress

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
import pytest

from pagesieve.functions import hosts as H, urls as U

lit = F.lit


@pytest.mark.parametrize(
    "given_, expected",
    [
        ("HTTP://Example.COM:80/a/../b/./c?x=1#f", "http://example.com/b/c?x=1"),
        ("https://ex.com", "https://ex.com/"),
        ("https://ex.com:443/a", "https://ex.com/a"),
        ("https://ex.com:8443/a/", "https://ex.com:8443/a/"),
        ("https://ex.com/é x", "https://ex.com/%C3%A9%20x"),
        ("https:\\\\ex.com\\a", "https://ex.com/a"),
        ("  https://ex.com/a\n", "https://ex.com/a"),
        ("https://ex.com/%2e%2e/a", "https://ex.com/a"),
        ("https://ex.com/a/..", "https://ex.com/"),
        ("mailto:x@y.z", "mailto:x@y.z"),
        ("not a url ", "not a url"),
        ("", ""),
    ],
)
def test_normalize_url(value, given_, expected):
    assert value(U.normalize_url(lit(given_))) == expected


# Host names as browsers write them; the long ones are the examples of the punycode standard.
HOSTS = [
    ("münchen.de", "xn--mnchen-3ya.de"), ("BÜCHER.example", "xn--bcher-kva.example"), ("faß.de", "xn--fa-hia.de"), ("日本語.jp", "xn--wgv71a119e.jp"),
    ("例え.テスト", "xn--r8jz45g.xn--zckzah"), ("мойдомен.рф", "xn--d1acklchcc.xn--p1ai"), ("ليهمابتكلموشعربي؟", "xn--egbpdaj6bu4bxfgehfvwxn"),
    ("3年B組金八先生", "xn--3b-ww4c5e180e575a65lsy2b"), ("安室奈美恵-with-super-monkeys", "xn---with-super-monkeys-pc58ag80a8qai00g7n9n"), ("😀.example", "xn--e28h.example"),
    ("ｅｘａｍｐｌｅ．com", "example.com"), ("例え。jp", "xn--r8jz45g.jp"), ("ex\u00adample.com", "example.com"), ("a%41b", "aab"), ("m%C3%BCnchen.de", "xn--mnchen-3ya.de"), ("a%20b", None), ("a_b.c", "a_b.c"),
    ("0x7f.1", "127.0.0.1"), ("0300.1", "192.0.0.1"), ("4294967295", "255.255.255.255"), ("4294967296", None), ("256.1", None), ("1.2.3.4.5", None), ("09.1", None), ("0x.0x0", "0.0.0.0"), ("1.2.3.", "1.2.0.3"),
    ("1e3", "1e3"), ("1.2.3.x", "1.2.3.x"), ("a.1", None), ("0xffffffffffff1", None),
    ("[::1]", "[::1]"), ("[::]", "[::]"), ("[1:0:0:4:0:0:0:8]", "[1:0:0:4::8]"), ("[1:0:0:2:0:0:3:4]", "[1::2:0:0:3:4]"), ("[0:0:1::]", "[0:0:1::]"), ("[1:0:2:3:4:5:6:7]", "[1:0:2:3:4:5:6:7]"),
    ("[2001:DB8:0:0:8:800:200C:417A]", "[2001:db8::8:800:200c:417a]"), ("[::ffff:1.2.3.4]", "[::ffff:102:304]"), ("[1:2:3:4:5:6:1.2.3.4]", "[1:2:3:4:5:6:102:304]"),
    ("[::1.2.3]", None), ("[1:2:3:4:5:6:7]", None), ("[1::2::3]", None), ("[:1]", None), ("[12345::]", None), ("[1:2:3:4:5:6:7:8::]", None), ("[:::]", None), ("[]", None), ("", None), ("a b", None),
]


def test_hosts_as_browsers_write_them(spark):
    df = spark.createDataFrame(HOSTS, "host string, expected string")
    got = df.select("host", H.browser_host(F.col("host")).alias("host_"), U.normalize_url(F.concat(lit("http://"), "host", lit(":080/x")), "null", browser=True).alias("url")).collect()
    assert [(r["host"], r["host_"]) for r in got] == HOSTS
    # What no browser takes for a host stays as written, if it can be part of a URL.
    assert [r["url"] for r, (_, h) in zip(got, HOSTS) if h] == [f"http://{h}/x" for _, h in HOSTS if h]


def test_urls_with_odd_hosts(value):
    for given_, expected in [
        ("https://user@MÜNCHEN.de:8443/ä?ö#ü", "https://user@xn--mnchen-3ya.de:8443/%C3%A4?%C3%B6#%C3%BC"), ("//0x7f.1/x", "https://127.0.0.1/x"), ("http:\\\\[0:0::1]\\a", "http://[::1]/a"),
        ("/münchen/1.2", "https://ex.com/m%C3%BCnchen/1.2"), ("http://ex.com/1.2", "http://ex.com/1.2"), ("mailto:ü@1.2", "mailto:ü@1.2"),
    ]:
        assert value(U.absolute_url(lit(given_), U.split_url(lit("https://ex.com/")), browser=True)) == expected
    assert value(U.url_host(lit("http://2130706433/"), browser=True)) == "127.0.0.1"


@given(st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, 0xFFFF]) | st.integers(0, 0xFFFF)), min_size=8, max_size=8))
@settings(max_examples=20, deadline=None)
def test_ipv6_like_the_standard_library(value, groups):
    text = ":".join(f"{g:x}" for (g,) in groups)
    assert value(H.browser_host(lit(f"[{text}]"))) == f"[{ipaddress.IPv6Address(text).compressed}]"


def test_invalid_input_variants(value):
    assert value(U.normalize_url(lit(" x "), "raw")) == " x "
    assert value(U.http_url(lit("ftp://a/b"))) == ""
    assert value(U.http_url(lit("http://a b/"))) == ""
    assert value(U.href(lit("x"), on_invalid="null")) is None


@pytest.mark.parametrize(
    "ref, expected",
    [
        ("x", "https://ex.com/a/x"), ("/y", "https://ex.com/y"), ("//z.com/q", "https://z.com/q"), ("?p=2", "https://ex.com/a/b?p=2"),
        ("#h", "https://ex.com/a/b?c=1#h"), ("../k", "https://ex.com/k"), ("./", "https://ex.com/a/"), ("http://o.com", "http://o.com/"),
        ("mailto:a", "mailto:a"), ("", ""),
    ],
)
def test_absolute_url(value, ref, expected):
    base = U.split_url(lit("https://ex.com/a/b?c=1"))
    assert value(U.absolute_url(lit(ref), base)) == expected


def test_origins(value):
    assert value(U.is_third_party(lit("https://a.com/x"), lit("https://a.com/")))is False
    assert value(U.is_third_party(lit("http://a.com/x"), lit("https://a.com/"))) is True
    assert value(U.is_third_party(lit("nope"), lit("https://a.com/"))) is False
    assert value(U.url_host(lit("https://A.com:81/"))) == "a.com"


@pytest.mark.parametrize(
    "name, kind",
    [
        ("utm_source", "tracking"), ("GCLID", "tracking"), ("mysession", "session"), ("page2", "pagination"), ("start", "pagination"),
        ("order", "sort"), ("color", "filter"), ("attr-size", "filter"), ("", "other"), ("q", "other"),
    ],
)
def test_classify_param(value, name, kind):
    assert value(U.classify_param(lit(name))) == kind


def test_pagination_functions(value):
    u = lit("https://ex.com/list/page/3?sort=a&page=2&b=1")
    assert value(U.strip_pagination(u)) == "https://ex.com/list?sort=a&b=1"
    assert value(U.pagination_family_key(u)) == "https://ex.com/list?b=1&sort=a"
    assert value(U.pagination_param(u)).asDict() == {"name": "page", "number": 2}
    assert value(U.pagination_param(lit("https://ex.com/?offset=20")))["number"] is None
    assert value(U.pagination_param(lit("https://ex.com/?page=x"))) is None
    assert value(U.page_signal(lit("https://ex.com/?page=x"))).asDict() == {"detected": True, "number": None, "source": "page", "raw": "x"}
    assert value(U.page_signal(lit("https://ex.com/p/7/"))).asDict() == {"detected": True, "number": 7, "source": "path", "raw": "7"}
    assert value(U.page_signal(lit("https://ex.com/")))["detected"] is False


def test_strip_functions(value):
    assert value(U.strip_non_content(lit("https://e.com/?utm_a=1&q=x+y&color=red"))) == "https://e.com/?q=x+y"
    assert value(U.strip_variant_params(lit("https://e.com/p?color=red"))) == "https://e.com/p"
    assert value(U.variant_params(lit("https://e.com/p?Color=red&sku=&option_a=1"))) == ["Color", "option_a"]
    assert value(U.url_breadcrumb(lit("https://e.com/a%20b/c/d/e"))) == "e.com › a b › c › d"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "..", ".", "c%20d"]), max_size=6))
def test_normalising_twice_changes_nothing(value, parts):
    once = value(U.normalize_url(lit("https://ex.com/" + "/".join(parts))))
    assert value(U.normalize_url(lit(once))) == once
    assert "/../" not in once and not once.endswith("/..")


def test_ports_beyond_the_range_are_no_urls(value):
    from pyspark.sql import functions as F

    from pagesieve.functions import hosts as H, urls as U

    for port, want in (("65535", "https://e.com:65535/"), ("00080", "https://e.com:00080/"), ("65536", ""), ("99999", ""), ("123456789012", "")):
        got = value(U.http_url(F.lit(f"https://e.com:{port}/")))
        assert (got != "") == (want != ""), port
