"""References, markup in text, labels and robots patterns that real pages contain."""

import html

import pytest
from pyspark.sql import functions as F

from pagesieve.functions import html as H
from pagesieve.operators import images, robots
from pagesieve.session import checkpoint_dir


@pytest.mark.parametrize("text", ["&#x110000;", "&#99999999999999999999;", "&#0;", "&#xD800;", "&#128;&#x9f;&#x81;", "&#65 b", "&#x41", "&#;&#x;", "&amp;amp;", "&check;&NotEqualTilde;", "&copy c", "&nosuch;", "& &", "&#0000000000000000000000065;"])
def test_references_as_browsers_read_them(value, text):
    assert value(H.decode_entities(F.lit(text))) == html.unescape(text).replace("\x81", "\x81")


def test_bare_names_before_letters_stay(value):
    assert value(H.decode_entities(F.lit("/x?a=1&copy=2&region=3&lt4"))) == "/x?a=1&copy=2&region=3&lt4"


def names(value, source):
    return [x["n"] for x in value(H.tokens(F.lit(source)))]


def test_template_contents_are_no_part_of_the_page(value):
    assert names(value, "<b><template><a><template><i></template><u></template></b><p>") == ["b", "template", "/template", "/b", "p"]
    assert names(value, "</template><a><template><i>") == ["/template", "a", "template"]
    assert names(value, "<iframe><a></iframe><noscript><img></noscript><br>") == ["iframe", "noscript", "br"]


def test_labels(value):
    got = [value(images.ms_label(F.lit(x))) for x in (0.0, 12.34, 100.0, 999.4, 1500.0, None)]
    assert got == ["0.0 ms", "12.3 ms", "100 ms", "999 ms", "1.50 s", "0.0 ms"]
    assert [value(images.transfer_label(F.lit(x))) for x in (0, 512, 2048, 3 << 20)] == ["0 B", "512 B", "2.0 KB", "3.00 MB"]


CASES = [("/a*b", "/axxb/c", True), ("/a*b$", "/abab", True), ("/a*b$", "/abc", False), ("/*.php$", "/x.php?y", False), ("/*.php$", "/x.php", True), ("/a$", "/a", True), ("/a$", "/ab", False),
         ("/a*$", "/abc", True), ("/*b*$", "/abc", True), ("/*x*$", "/abc", False), ("*", "/", True), ("/p**q", "/p1q", True), ("/a.b", "/axb", False), ("/a*aa$", "/aaa", True), ("/a*b*b$", "/ab", False)]


@pytest.mark.parametrize("rule, path, want", CASES)
def test_robots_patterns(value, rule, path, want):
    assert value(F.regexp_like(F.lit(path), robots.rule_regex(F.lit(rule)))) == want
    assert not want or path.startswith(value(robots.rule_start(F.lit(rule))))


def test_a_rule_of_many_stars_does_not_hang(value):
    rule, path = "/" + "*a" * 40 + "*b$", "/" + "a" * 5000
    assert value(F.regexp_like(F.lit(path), robots.rule_regex(F.lit(rule)))) is False


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        checkpoint_dir(Session())
