"""JSON-LD blocks against a plain reading of the parsed value."""

import json
import random

from pyspark.sql import functions as F

from pagesieve.functions import jsonld as J
from pagesieve.operators import schema as S


def plain(value):
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    return " ".join(str(value).split())


def scalar(value):
    if isinstance(value, dict):
        value = next((value[k] for k in ("name", "@id", "url") if k in value), None)
        return plain(value) if isinstance(value, (str, int, float)) else ""
    return "" if value is None or isinstance(value, list) else plain(value)


def image(value):
    if isinstance(value, dict):
        value = next((value[k] for k in ("url", "contentUrl", "@id") if value.get(k)), None)
    elif not isinstance(value, str):
        return ""
    return scalar(value)


def listed(value):
    return [] if value is None else value if isinstance(value, list) else [value]


def block(raw):
    try:
        root = json.loads(raw, parse_constant=lambda n: 1 / 0)
    except (ValueError, ZeroDivisionError):
        return (False, [], [])
    found, types, stack = [], set(), [root]
    while stack:
        value = stack.pop()
        if isinstance(value, dict):
            types.update(str(t) for t in listed(value.get("@type")) if t)
            found.append(value)
            stack.extend(reversed([v for k, v in value.items() if k != "@context"]))
        elif isinstance(value, list):
            stack.extend(reversed(value))
    order = {id(n): i for i, n in enumerate(found)}
    nodes = []
    for i, n in enumerate(found):
        fields = {k: [scalar(n[k])] for k in J.SINGLE if k in n}
        for k in (*J.MANY, "image"):
            fields[k] = [s for s in map(image if k == "image" else scalar, listed(n.get(k))) if s]
        kids = {k: [order[id(v)] for v in listed(n.get(k)) if isinstance(v, dict)] for k in J.LINKED}
        nodes.append((i, [plain(t) for t in listed(n.get("@type")) if t], fields, {k: v for k, v in kids.items() if v}, bool(n.get("offers")) or isinstance(n.get("offers"), (list, dict))))
    return (True, sorted(types), nodes)


def made(r, depth=0):
    kind = r.random()
    if depth > 4 or kind < 0.45:
        return r.choice(["a", "", " b  c ", 'q"uo\\te', "tab\tline\n", "{not} [a] list, : \\", "é😀", 5, 0, 12.5, 1e3, -3, True, False, None, "http://x/", "\\", '\\"', "Product", "Offer"])
    if kind < 0.6:
        return [made(r, depth + 1) for _ in range(r.randint(0, 3))]
    keys = r.sample([*J.READ, "@context", "@graph", "other", 'we"ird', "sl\\ash"], r.randint(0, 7))
    return {k: r.choice(["Product", ["Product", "Thing"], "Offer", "ListItem", ""]) if k == "@type" else made(r, depth + 1) for k in keys}


def read(spark, texts):
    df = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)], "page_id long, jsonld array<string>").repartition(4)
    out = {}
    for r in S.with_schemas(df).collect():
        s = r["schemas"][0]
        out[r["page_id"]] = (s["valid"], list(s["types"]), [(n["ord"], list(n["types"]), {k: list(v) for k, v in n["fields"].items()}, {k: list(v) for k, v in n["kids"].items()}, n["offered"]) for n in s["nodes"]])
    return [out[i] for i in range(len(texts))]


def test_like_a_plain_reading(spark):
    r = random.Random(8)
    texts = []
    for i in range(400):
        value = {"@type": "Product", **v} if isinstance(v := made(r), dict) else v
        texts.append(json.dumps(value, ensure_ascii=i % 2 == 0, indent=r.choice([None, 2]), separators=r.choice([None, (",", ":"), (" , ", " : ")])))
    assert read(spark, texts) == [block(t) for t in texts]


def test_order_is_that_of_the_text(spark):
    text = '{"@type":"WebPage","mainEntity":{"@type":"Product","name":"first"},"about":{"@type":"Product","name":"second"}}'
    assert [n[2].get("name") for n in read(spark, [text])[0][2]] == [None, ["first"], ["second"]]


def test_numbers_as_scripts_print_them(spark):
    shown = {"12.50": "12.5", "100": "100", "1.0": "1", "0.10": "0.1", "1e3": "1000", "-0": "0", "12345678901234567890": "12345678901234567890", "1.5e2": "150", "10.00": "10"}
    got = read(spark, [f'{{"price": {n}}}' for n in shown])
    assert [g[2][0][2]["price"][0] for g in got] == list(shown.values())


def test_wrong_texts(spark):
    texts = ["", "{", "}", "]", '{"a":1,}', "{'a':1}", "[1,2", '{"a" 1}', "NaN", "nonsense", '"open', '{"a":"\t"}', '{"a":01}', "{}}", "[]", "{}", '"text"', "12", "null", ' {"@type":"A"} ']
    assert read(spark, texts) == [block(t) for t in texts]


def test_deep_wide_and_missing(spark):
    deep = '{"item":' * 400 + '{"name":"x"}' + "}" * 400
    wide = json.dumps({"@graph": [{"@type": "Product", "name": f"n{i}", "brand": {"name": f"b{i}"}} for i in range(3000)]})
    got = read(spark, [deep, wide])
    assert len(got[0][2]) == 401 and got[0][2][400][2]["name"] == ["x"] and got[0][2][0][3] == {"item": [1]}
    assert len(got[1][2]) == 6001 and got[1] == block(wide)
    none = spark.createDataFrame([(1, None), (2, [])], "page_id long, jsonld array<string>")
    assert [r["schemas"] for r in S.with_schemas(none).collect()] == [[], []]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, ["{}"])], "page_id long, jsonld array<string>")
    plan = S.schema_nodes(S.with_schemas(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert S.with_schemas(df).select(F.size("schemas").alias("n")).first()["n"] == 1
