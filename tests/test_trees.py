"""Tree differences: how often levels are written."""

from lexspan.operators import trees


def test_levels_follow_each_other_in_one_pass(spark, monkeypatch):
    written, materialize = [], trees.materialize
    monkeypatch.setattr(trees, "materialize", lambda df, label: (written.append(label), materialize(df, label))[1])
    frame = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "k int, j string")
    old = frame('{"a":{"b":[1,{"c":1}]}}', '{"a": 1}', "[1,2]", '{"a":[[[[[[1]]]]]]}')
    new = frame('{"a":{"b":[1,{"c":2}]}}', '{"a":1.0}', "[1]", '{"a":[[[[[[2]]]]]]}')
    got = sorted(map(tuple, trees.tree_diff(old, new, key="k", json="j").collect()))
    assert got == [(0, "a.b[1].c", "changed"), (2, ".length", "length"), (3, "a[0][0][0][0][0][0]", "changed")]
    assert len(written) == 3  # eight levels
