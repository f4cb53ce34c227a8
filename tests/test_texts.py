"""What tasks make of whole texts equals what columns and units make of them, and no row for each word leaves them."""

import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexspan.functions.text import word_tokens
from lexspan.functions.words import Needles, md5_heads, word_lists
from lexspan.operators import chunking, lexical, retrieval, vectors
from lexspan.plans import catalogue


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _odd_texts(n, marks=" \n\t。！？；a。 \x1c\x85 　\xa0é"):
    g = random.Random(7)
    made = ["".join(g.choice(marks) if g.random() < p else g.choice("abcXYZ019") for _ in range(g.randrange(0, 2600))) for p in (0.01, 0.1, 0.5, 0.9) for _ in range(n)]
    return [None, "", "\n", " ", "。", "a。", "x" * 2300, "b" * 1000 + "。 ", "c" * 1001 + "。  ", " " * 1500, *made]


def test_words_of_texts_equal_word_tokens(spark):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{x} A{x}b" for x in points[i : i + 500]) for i in range(0, len(points), 500)] + [None, "", " ", "KKK İİx", "K"] + _odd_texts(5)
    want = [r.w for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(word_tokens(F.col("t")).alias("w")).collect()]
    for lo, hi in ((0, len(texts)), (3, 2200), (len(texts) - 3, len(texts))):
        size, words = word_lists(pa.array(texts, pa.string())[lo:hi])
        assert size.tolist() == [len(w) for w in want[lo:hi]] and words.to_pylist() == [x for w in want[lo:hi] for x in w]
    assert word_lists(pa.array([], pa.string()))[0].tolist() == []


def test_needles_are_found_where_texts_hold_them():
    g = random.Random(3)
    texts = ["".join(g.choice("abé") for _ in range(g.randrange(0, 60))) for _ in range(400)] + ["", "a" * 40, "0123456", "01234567", "x01234567", "01234567x"]
    needles = ["", "a", "é", "a" * 20, "a" * 40, "01234567", "x0123456", "0123456"] + [t[i : i + n] for t in texts[:80] for i, n in ((0, 8), (3, 12), (1, 25))]
    for part in (texts, texts[-3:], [""], []):
        got = Needles(needles).found(pa.array(part, pa.string()))
        assert sorted(got) == sorted((r, i) for r, t in enumerate(part) for i, x in enumerate(needles) if x in t)


def test_md5_heads_equal_hashlib():
    g = random.Random(1)
    words = ["", "a", *("x" * n for n in (54, 55, 56, 63, 64, 119, 200))] + ["".join(g.choice("abé09") for _ in range(g.randrange(1, 70))) for _ in range(9000)]
    want = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words]
    assert md5_heads(pa.array(words)).tolist() == want and md5_heads(pa.array(words)[5:900]).tolist() == want[5:900] and not len(md5_heads(pa.array([], pa.string())))


def test_terms_of_many_queries_score_the_same_by_a_matrix(spark):
    g = np.random.default_rng(2)
    weights = spark.createDataFrame([(q, f"t{t:02d}", float(g.random())) for q in range(30) for t in range(25) if t % 5 == 0 or (q + t) % 7 == 0], "qid long, term string, weight double")
    block = lexical.Block(weights)
    row, term = np.divmod(np.flatnonzero(g.random(40 * len(block.terms)) < 0.4), len(block.terms))
    share = g.random(len(row))
    assert 0 < block._matrix()[1].shape[1] < len(block.terms)
    assert np.allclose(block.scores(40, row, term, share, dense=True), block.scores(40, row, term, share), rtol=1e-12, atol=0)


def test_chunks_of_lines_equal_chunks_of_units(spark, tmp_path):
    titles = ["s", None, "", "two words"]
    rows = [(i, t, titles[i % 4]) for i, t in enumerate(_odd_texts(12))]
    for name, more in (("once", []), ("shared", [(3, "a\nb", "s"), (None, "one。two", "s"), (None, "three", None)])):
        made = [(rows[i][0], rows[i][1] if i != 3 else "zz", *rows[i][2:]) for i in range(len(rows))] if more else rows
        # an id that is shared has lines of other numbers, so that their order is given
        more = [(d, "\n" * 3 + t if d == 3 else t, s) for d, t, s in more[:2]]
        folder = str(tmp_path / name)
        spark.createDataFrame(made + more, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
        for strategy in ("structure", "fixed"):
            got = catalogue._line_chunks(spark, folder, strategy)
            want = chunking.chunked(catalogue._units(spark, folder), strategy).select("chunk_id", "doc_id", "text")
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 50
            assert more or "Exchange" not in _plan(got)


def test_counts_of_texts_equal_those_of_tokens(spark, monkeypatch):
    texts = [None, "", "a a b", "B c K", "a"] + [f"w{i % 7} w{i} a" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc int, text string")
    tokens = lexical.tokenized(docs, "doc", "text")
    for terms in (lexical.TERMS, 5):
        monkeypatch.setattr(lexical, "TERMS", terms)
        monkeypatch.setattr(lexical, "TEXT", 30 if terms == 5 else lexical.TEXT)
        for given in (docs, tokens):
            df, stats = lexical.statistics(given)
            assert sorted(map(tuple, df.collect())) == sorted(map(tuple, lexical.document_frequencies(tokens).collect()))
            assert stats.collect() == lexical.corpus_stats(tokens).collect()
    df, stats = lexical.statistics(docs.limit(0))
    assert df.count() == 0 and tuple(stats.first()) == (0, None)


def test_retrievers_of_texts_equal_those_of_tokens(spark):
    g = random.Random(5)
    texts = [None, "", "?!"] + [" ".join(f"W{int(g.paretovariate(0.7)) % 300}" for _ in range(g.randrange(1, 80))) for _ in range(500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, text string").repartition(3)
    asked = lexical.tokenized(spark.createDataFrame([(q, f"w{q} w1 w{q} w{3 * q} zz") for q in range(20)], "i long, t string"), "i", "t")
    tokens = lexical.tokenized(docs, "doc", "text")
    for block in (2000, 6):
        of_texts, of_tokens = (sorted(map(tuple, lexical.bm25(x, asked, k=7, digits=6, block=block).collect())) for x in (docs, tokens))
        assert of_texts == of_tokens and len(of_texts) == 140
        queries = vectors.hashed_vectors(asked).withColumnRenamed("doc", "qid")
        near = vectors.cosine_top_k(docs, queries, k=7, digits=6, block=block, made=vectors.hashed)
        assert sorted(map(tuple, near.collect())) == sorted(map(tuple, vectors.cosine_top_k(vectors.hashed_vectors(tokens), queries, k=7, digits=6, block=block).collect()))


def test_grid_hands_on_no_tokens_and_sends_candidates_to_texts(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b w{i} {'x ' * i}") for i in range(50)], "doc long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    written = []
    monkeypatch.setattr(retrieval, "materialize", lambda df, label: (written.append((label, df.columns)), lexical.materialize(df, label))[1])
    asked = spark.createDataFrame([(q, f"a w{q}") for q in range(5)], "qid long, question string")
    got = retrieval.retrieve_grid(spark.read.parquet(str(tmp_path / "docs")), asked, {"x": retrieval.RetrievalConfig()})["x"]
    assert {r.qid: r.doc for r in got.where("rank = 1").collect()} == {q: q for q in range(5)}
    assert written and all("tokens" not in columns for _, columns in written)
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString()
    assert np.all([r.rank <= 5 for r in got.collect()])
