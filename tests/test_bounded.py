"""What tasks hold, hand on and shuffle is bounded by queries and blocks, not by the input."""

from pyspark.sql import functions as F

from lexspan.operators import accounting, lexical, pruned, segment, vectors
from lexspan.plans import catalogue
from lexspan.streaming.lexical import LexicalStream


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_streamed_search_shuffles_no_row_for_each_query_and_document(spark, tmp_path):
    index = LexicalStream(spark, str(tmp_path / "i"))
    index.merge(spark.createDataFrame([(i, f"a b w{i}") for i in range(40)], "doc long, text string"), "0")
    queries = lexical.tokenized(spark.createDataFrame([(q, f"a w{q}") for q in range(5)], "i long, t string"), "i", "t")
    found = index.search(queries, 3, digits=6)
    assert "keys=[qid" not in _plan(found) and "Generate" not in _plan(found)
    assert {r.qid: r.doc for r in found.where("rank = 1").collect()} == {q: q for q in range(5)}


def test_a_batch_that_changes_nothing_writes_no_terms(spark, tmp_path):
    index = LexicalStream(spark, str(tmp_path / "i"))
    index.merge(spark.createDataFrame([(1, "a b a", 2), (1, "a b a", 2), (None, "c", 1)], "doc long, text string, version int"), "0")
    index.merge(spark.createDataFrame([(1, "old", 1)], "doc long, text string, version int"), "1")
    assert spark.read.parquet(str(tmp_path / "i/batch-1/terms")).count() == 0
    assert sorted(map(str, index.postings().collect())) == sorted(["Row(term='a', doc=1, tf=2, dl=3)", "Row(term='b', doc=1, tf=1, dl=3)", "Row(term='c', doc=None, tf=1, dl=1)"])


def test_a_task_hands_on_k_rows_a_query_whatever_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(3000)] + [(5000 + i, [1.0, i / 10]) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc long, vector array<double>").orderBy(F.desc("doc")).coalesce(1)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid long, vector array<double>")
    part = vectors._block(docs, queries, 2, 0, 2000, 10, 6)
    assert part.count() == 20 and sorted(r.doc for r in part.where("qid = 1").collect()) == list(range(10))


def test_best_equals_a_whole_sort():
    import numpy as np
    import pyarrow as pa

    g = np.random.default_rng(1)
    for digits, positive, k in ((None, False, 3), (1, False, 7), (1, True, 5), (2, True, 400)):
        scores, docs = np.round(g.normal(size=(6, 300)), 2), g.permutation(300)
        scores[5] = -1
        held = lexical.Best(6, k, digits, positive=positive)
        for at in range(0, 300, 40):
            held.add(scores[:, at : at + 40], pa.array(docs[at : at + 40]))
        got = [tuple(r.values()) for b in held.rows(list(range(6)), pa.int64()) for r in b.to_pylist()]
        s = scores if digits is None else np.round(scores, digits)
        want = [(q, d, s[q, c]) for q in range(6) for d, c in [(int(docs[c]), c) for c in sorted(range(300), key=lambda c: (-s[q, c], docs[c])) if s[q, c] > 0 or not positive][:k]]
        assert got == want


def test_a_worker_remembers_runs_by_their_characters(spark):
    words = spark.createDataFrame([("ab", 3), ("c", 2)], "word string, count long")
    made = segment.segmenter(words, hidden=False, runs="[a-z]+", cut="[a-z]+", lower=True, stop=frozenset())
    name = lambda i: "".join(chr(97 + int(d)) for d in f"{i:010d}")
    for at in range(0, 100_000, 5000):
        assert made.segment([name(i) for i in range(at, at + 5000)])[0] == ["ab" if w == "ab" else w for w in made.paths([name(at)])[0]]
    assert sum(map(len, made.memory)) <= segment.REMEMBERED + 50_000
    texts = [None, "", "abc" * 3] + ["abc ab " * 30_000] * 3  # a batch in several parts
    got = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(segment.dictionary_tokens(made, spark)(F.col("t")).alias("x"))
    assert [r.n for r in got.select(F.size("x").alias("n")).collect()] == [0, 0, 6] + [90_000] * 3


def test_prices_go_to_the_traces(spark):
    traces = spark.createDataFrame([("a", 1_000_000, 0)] * 4 + [("b", 0, 1_000_000)], "provider string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("a", "1.5", "0"), ("b", "0", "2")], "provider string, i string, o string").selectExpr("provider", "cast(i as decimal(12,6)) input_price", "cast(o as decimal(12,6)) output_price")
    got = accounting.priced(traces, prices)
    assert "Exchange hashpartitioning" not in _plan(got) and "SortMergeJoin" not in _plan(got)
    assert sorted(float(r.cost) for r in got.collect()) == [1.5] * 4 + [2.0]


def test_pruned_search_shuffles_no_row_for_each_query_document_and_term(spark, tmp_path):
    docs = lexical.tokenized(spark.createDataFrame([(i, f"a b w{i}") for i in range(60)], "i long, t string"), "i", "t")
    pruned.BlockIndex.save(docs, str(tmp_path / "i"), block=4)
    index = pruned.BlockIndex.load(spark, str(tmp_path / "i"))
    found = index.search(lexical.tokenized(spark.createDataFrame([(q, f"a w{q}") for q in range(5)], "i long, t string"), "i", "t"), 3, digits=6)
    assert "sum(" not in _plan(found) and "Generate" not in _plan(found)
    assert {r.qid: r.doc for r in found.where("rank = 1").collect()} == {q: q for q in range(5)}
    assert index.maxima.count() == index.postings.select("block").distinct().count()


def test_gold_is_what_holds_a_question_even_inside_words(spark, tmp_path):
    texts = [None, "", "xfoo bar baz quxy", "Foo bar baz qux", "foo bar baz-qux", "?!", "one", "a b c d e f g h"]
    asked = ["foo bar baz qux", "ne", "", "?", "b c d e f g", None, "zz yy xx ww"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = catalogue._gold(spark, str(tmp_path))
    assert "SortMergeJoin" not in _plan(got) and "Generate" not in _plan(got)
    assert sorted(map(tuple, got.collect())) == sorted((q, d) for q, a in enumerate(asked) for d, x in enumerate(texts) if a is not None and x is not None and a in x)
