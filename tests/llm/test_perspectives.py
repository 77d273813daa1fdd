from pagesieve.llm import op2_perspectives as P

TURNS = "conv_id long, turn int, role string, text string, block int"


def turns(spark, many=700):
    rows = [(1, 0, "system", "be kind", 1), (1, 1, "ann", "hi", 1), (1, 2, "bob", "", 1), (1, 3, "cy", None, 1), (1, 4, None, "noise", 1), (1, None, "ann", "early", 1),
            (2, 0, "ann", "a", 1), (2, 0, "ann", "a", 1), (2, 0, "bob", "tie", 1), (3, 0, "system", "alone", 1), (None, 1, "ann", "no id", 1), (None, 2, "bob", "è 😀\nx", 1), (4, 0, None, None, 1)]
    return spark.createDataFrame(rows + [(9, i, ("ann", "bob")[i % 2], f"turn {i}", 1) for i in range(many)], TURNS)


def test_matches_sql(spark, same):
    t = turns(spark)
    same(P.rotate(t), P.SQL, conversations=t)
    assert P.rotate(t.limit(0)).count() == 0


def test_block_borders_do_not_matter(spark, same):
    t = turns(spark, 40)
    for block in (1, 3, 1000):
        same(P.rotate(t, block=block), P.SQL, conversations=t)


def test_dialogues_and_masks(spark):
    got = {(r["conv_id"], r["perspective"]): r for r in P.dialogues(P.rotate(turns(spark))).collect()}
    x = got[(1, "bob")]
    assert x["text"] == "<|user|>ann\nearly\n<|system|>\nbe kind\n<|user|>ann\nhi\n<|assistant|>\n\n<|user|>cy\n\n<|user|>unknown\nnoise\n"
    assert [x["text"][m["start"] : m["end"]] for m in x["masks"]] == ["\n"]
    assert [got[(1, "ann")]["text"][m["start"] : m["end"]] for m in got[(1, "ann")]["masks"]] == ["early\n", "hi\n"]
    assert (3, "system") not in got and not [k for k in got if k[0] == 4]
    assert len(got[(9, "ann")]["masks"]) == 350
