"""Stored lexical indexes: pruned blocks and signed batches give the rows of BM25 over the documents as they are."""

import random

import pytest
from pyspark.sql import functions as F

from lexspan.operators import lexical, nearest, pruned, vectors
from lexspan.streaming.lexical import LexicalStream


def _words(rng, n, spread=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % spread}" for _ in range(n))


def _rows(df):
    return [tuple(r) for r in df.orderBy("qid", "rank").select("qid", "doc", "score", "rank").collect()]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    texts = [(i, _words(rng, rng.randint(0, 60)) + (f" rare{i // 7}" if i % 3 else "")) for i in range(600)] + [(1000, None), (1001, ""), (1002, "w1"), (1003, "w1")]
    asked = [(q, _words(rng, rng.randint(1, 12)) + f" rare{q * 3} w1 w1") for q in range(25)] + [(98, "nothing of it"), (99, ""), (100, "w1")]
    docs = lexical.materialize(lexical.tokenized(spark.createDataFrame(texts, "i long, t string"), "i", "t"), "test-docs")
    return docs, lexical.tokenized(spark.createDataFrame(asked, "i long, t string"), "i", "t")


@pytest.mark.parametrize("block,seeds,k", [(1, 1, 3), (16, 8, 10), (100, 2, 10), (10_000, 8, 10)])
def test_pruned_search_equals_bm25(spark, corpus, tmp_path, block, seeds, k):
    docs, queries = corpus
    pruned.BlockIndex.save(docs, str(tmp_path / "i"), block=block)
    index = pruned.BlockIndex.load(spark, str(tmp_path / "i"))
    got, counted = index.searched(queries, k, digits=6, seeds=seeds)
    assert _rows(got) == _rows(lexical.bm25(docs, queries, k=k, digits=6)) and got.count() > 20
    n = counted.agg(F.sum("blocks").alias("blocks"), F.sum("read").alias("read")).first()
    assert 0 < n.read <= n.blocks


def test_a_rare_term_lets_most_blocks_be(spark, tmp_path):
    rng = random.Random(5)
    texts = [(i, _words(rng, 30, 50) + (f" key{i} " * 3 if i < 40 else "")) for i in range(2000)]
    docs = lexical.materialize(lexical.tokenized(spark.createDataFrame(texts, "i long, t string"), "i", "t"), "test-docs")
    queries = lexical.tokenized(spark.createDataFrame([(q, f"key{q} w1 w2") for q in range(40)], "i long, t string"), "i", "t")
    pruned.BlockIndex.save(docs, str(tmp_path / "i"))
    got, counted = pruned.BlockIndex.load(spark, str(tmp_path / "i")).searched(queries, 1, digits=6)
    assert {r.qid: r.doc for r in got.collect()} == {q: q for q in range(40)}
    n = counted.agg(F.sum("blocks").alias("blocks"), F.sum("read").alias("read")).first()
    assert n.read < 0.1 * n.blocks


def test_block_index_edges(spark, tmp_path):
    none = lexical.tokenized(spark.createDataFrame([], "i long, t string"), "i", "t")
    pruned.BlockIndex.save(none, str(tmp_path / "none"))
    assert pruned.BlockIndex.load(spark, str(tmp_path / "none")).search(lexical.tokenized(spark.createDataFrame([(1, "a")], "i long, t string"), "i", "t")).count() == 0
    spark.createDataFrame([("x",)], "format string").write.json(str(tmp_path / "bad/format"))
    with pytest.raises(ValueError, match="format"):
        pruned.BlockIndex.load(spark, str(tmp_path / "bad"))


def _anew(spark, live, queries):
    rows = [(d, t) for d, (_, t) in live.items() if t is not None]
    return _rows(lexical.bm25(lexical.tokenized(spark.createDataFrame(rows, "i long, t string"), "i", "t"), queries, k=5, digits=6)) if rows else []


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_index_equals_one_built_anew(spark, tmp_path, seed):
    rng = random.Random(seed)
    queries = lexical.tokenized(spark.createDataFrame([(q, _words(rng, 4, 12)) for q in range(8)], "i long, t string"), "i", "t")
    index, live = LexicalStream(spark, str(tmp_path / "i")), {}
    assert index.search(queries, 5).count() == 0 and index.batches() == []
    for n in range(6):
        batch = [(rng.randint(0, 25), rng.choice([None, "", _words(rng, 8, 12), _words(rng, 5, 12)]), rng.randint(0, 6)) for _ in range(25)]
        batch = list({(d, v): (d, t, v) for d, t, v in batch}.values())  # ties of versions have a test of their own
        batch = [(d, t, v) for d, t, v in batch if live.get(d, (-1,))[0] != v]
        for d, t, v in batch:
            if v > live.get(d, (-1,))[0]:
                live[d] = (v, t)
        df = spark.createDataFrame(batch, "doc long, text string, version int")
        index.merge(df, str(n))
        if n % 2:  # a batch that is tried again overwrites itself
            index.merge(df, str(n))
        if n == 3:
            index.fold()
            assert len(index.batches()) == 1
        assert _rows(index.search(queries, 5, digits=6)) == _anew(spark, live, queries)
        stats = index.stats().first()
        assert stats.n_docs == sum(t is not None for _, t in live.values())
    df = {r.term: r.df for r in index.frequencies().collect()}
    assert df == {w: sum(w in t.split() for _, t in live.values() if t) for w in {w for _, t in live.values() if t for w in t.split()}}


def test_streamed_ties_nulls_and_order(spark, tmp_path):
    rows = [[(1, "a b", 2), (None, "c", 0), (2, None, 5)], [(1, "a c", 2), (2, "late", 4), (1, "old", 1)], [(None, "d d", None), (3, "", 0), (1, None, 2)]]
    seen = []
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        index = LexicalStream(spark, str(tmp_path / "".join(map(str, order))))
        for k in order:
            index.merge(spark.createDataFrame(rows[k], "doc long, text string, version int").selectExpr("*", "1 AS sign", "2 AS hash", "3 AS live"), str(k))
        seen.append((sorted(map(str, index.postings().collect())), sorted(map(str, index.frequencies().collect())), index.stats().first()))
    assert seen[0] == seen[1] == seen[2] and seen[0][2].n_docs == 3


# --- vectors by pivot ---


def _vectors(rng, n, dims, centres):
    import numpy as np

    g = np.random.default_rng(rng.randint(0, 10**6))
    c = g.normal(size=(centres, dims)) * 4
    x = c[g.integers(0, centres, n)] + g.normal(size=(n, dims)) * 0.3
    return [(i, [float(v) for v in r]) for i, r in enumerate(x)]


@pytest.mark.parametrize("settings", [{}, {"pivots": 3, "rings": 5, "cell": 20}, {"pivots": 1, "rings": 1, "cell": 7}])
def test_pivot_search_equals_a_whole_scan(spark, tmp_path, settings):
    rng = random.Random(7)
    rows = _vectors(rng, 900, 12, 30) + [(1000 + i, [1.0] + [0.0] * 11) for i in range(60)] + [(2000, [0.0] * 12), (2001, [0.0] * 12), (2002, [float("nan")] + [1.0] * 11)]
    asked = [(q, v) for q, v in rows[:900:45]] + [(5000, [-1.0] * 12), (5001, [0.0] * 12), (5002, [2.0] + [0.0] * 11)]
    kind = "vector array<double>"
    docs, queries = spark.createDataFrame(rows, f"doc long, {kind}").repartition(4), spark.createDataFrame(asked, f"qid long, {kind}")
    nearest.PivotIndex.save(docs, str(tmp_path / "p"), **settings)
    got, counted = nearest.PivotIndex.load(spark, str(tmp_path / "p")).searched(queries, 10, digits=6)
    assert _rows(got) == _rows(vectors.cosine_top_k(docs, queries, k=10, digits=6))
    n = {r.qid: (r.read, r.vectors) for r in counted.collect()}
    assert all(a <= b == len(rows) for a, b in n.values())
    if not settings:  # of 30 clusters a query reads few
        assert sum(n[q][0] for q, _ in asked[:20]) < 0.4 * sum(n[q][1] for q, _ in asked[:20])


def test_pivot_index_edges(spark, tmp_path):
    kind = "vector array<float>"
    queries = spark.createDataFrame([(1, [1.0, 0.0])], f"qid long, {kind}")
    for name, rows in (("none", []), ("zeros", [(1, [0.0, 0.0]), (2, [0.0, 0.0])])):
        nearest.PivotIndex.save(spark.createDataFrame(rows, f"doc long, {kind}"), str(tmp_path / name))
        got = nearest.PivotIndex.load(spark, str(tmp_path / name)).search(queries, 5).collect()
        assert [(r.doc, r.score) for r in got] == [(d, 0.0) for d, _ in rows]
