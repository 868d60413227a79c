from recuento.llm.chat import render_maximal

KIND = "conv_id long, turn long, role string, text string, place string"


def test_snapshots_are_collapsed(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "bye")]
    rows = [(1, i, *t) for i, t in enumerate(talk[:1])]
    rows += [(2, i, *t) for i, t in enumerate(talk)] + [(3, i, *t) for i, t in enumerate(talk)]
    rows += [(4, i, *t) for i, t in enumerate(talk[:2])] + [(4, 0, *talk[0])]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 0, None, None), (None, 3, "user", "lost"), (7, 0, "userh", "i")]
    found = {r.conv_id: r for r in render_maximal(spark.createDataFrame([(*r, "x") for r in rows], KIND).repartition(4)).collect()}
    assert set(found) == {2, 5, 6, 7, None}
    assert (found[2].n_turns, found[2].n_copies) == (3, 2)
    assert found[2].chat == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    assert found[6].chat == "<|im_start|>\n<|im_end|>\n"


def test_order_of_turns_is_part_of_the_hash(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "b"), (2, 1, "user", "a"), (3, 0, "user", "b")]
    df = spark.createDataFrame([(*r, "x") for r in rows], KIND)
    assert sorted(r.conv_id for r in render_maximal(df).collect()) == [1, 2]
    assert render_maximal(df.limit(0)).count() == 0
    plan = render_maximal(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
