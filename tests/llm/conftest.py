import os
import random
import sys

import pytest

sys.path[:0] = [__file__.rsplit("/tests/", 1)[0], os.path.dirname(__file__)]

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy int, score double"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs everywhere, empty and very long texts, ties, repeated rows, and columns with names operators use."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, line = prose(120), "A line that several documents share"
    rows = [(None, None), (None, "null id, with some words in it"), (1, ""), (2, None), (3, "   \n\t "), (4, base), (5, base), (6, base.upper()), (7, base.replace("a", "b", 3)),
            (8, "one"), (8, "one"), (9, "One two"), (10, prose(30_000)), (11, f"{line}\n{prose(8)}\n  {line.upper()}\t"), (12, f"x\n{line}"), (13, f"{line}\r\n{line}"),
            (14, "漢字 é 😀 " * 40), (15, "漢字 é 😀 " * 40), (16, "w" * 50_000), (17, base + " " + prose(3)), (18, "<|endoftext|> and 'll  <|endoftext|"), (19, "\u0085  a\x1cb"), (20, "\n\n\n")]
    full = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s1", None]), len(t or ""), 1, 0.5) for i, t in rows]
    return spark.createDataFrame(full + [(30 + k, prose(r.randint(1, 60)), "en", "s0", 1, 1, 0.5) for k in range(30)], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def duck():
    """Run SQL over the given frames: duck(sql, documents=frame)."""
    import duckdb

    def run(sql, **frames):
        con = duckdb.connect()
        for name, frame in frames.items():
            con.register(f"{name}_", frame.toArrow())
            con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_")
        cur = con.execute(sql)
        return [d[0] for d in cur.description], cur.fetchall()

    return run


@pytest.fixture(scope="session")
def same(duck):
    """Assert that a frame has the rows of the SQL."""
    from check import rows

    def run(df, sql, **frames):
        names, got = duck(sql, **frames)
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got)

    return run
