"""Registered queries of stored indexes, lexical and of vectors, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspan.operators import lexical, nearest, pruned
from lexspan.plans.catalogue import BM25, NEAR, _tokens, query, t
from lexspan.scratch import scratch_path
from lexspan.streaming.lexical import LexicalStream


@query("bm25_pruned_topk", f"WITH {BM25} SELECT qid, doc, score, rank FROM bm WHERE rank <= 10")
def bm25_pruned_topk(spark, sf):
    """The rows of bm25_topk from a stored index of blocks, most of which aren't read."""
    path = scratch_path(spark, "blocks")
    pruned.BlockIndex.save(_tokens(spark, sf), path)
    return pruned.BlockIndex.load(spark, path).search(lexical.tokenized(t(spark, sf, "benchmark"), "item_id", "text"), 10, digits=6)


#: The documents that are live at the end: all but those that a last batch takes away, which are those of one source.
LIVE = BM25.replace("FROM documents)", "FROM documents WHERE source <> 'src3' AND text IS NOT NULL)")


@query("bm25_streamed_topk", f"WITH {LIVE} SELECT qid, doc, score, rank FROM bm WHERE rank <= 10")
def bm25_streamed_topk(spark, sf):
    """BM25 over an index that four batches made: first halves of texts, whole texts in their place, a source taken away, and the
    first halves again, which come late and change nothing."""
    d = t(spark, sf, "documents")
    half = d.select(F.col("doc_id").alias("doc"), F.expr("substring(text, 1, int(char_length(text) / 2))").alias("text"), F.lit(1).alias("version"))
    index = LexicalStream(spark, scratch_path(spark, "lexical-stream"))
    index.merge(half, "0")
    index.merge(d.select(F.col("doc_id").alias("doc"), "text", F.lit(2).alias("version")), "1")
    index.merge(d.where("source = 'src3'").select(F.col("doc_id").alias("doc"), F.lit(None).cast("string").alias("text"), F.lit(3).alias("version")), "2")
    index.merge(half, "3")
    return index.search(lexical.tokenized(t(spark, sf, "benchmark"), "item_id", "text"), 10, digits=6)


@query("cosine_pivot_topk", f"WITH {NEAR} SELECT qid, doc, score, rank FROM near")
def cosine_pivot_topk(spark, sf):
    """The rows of cosine_topk from vectors stored by pivot, of which a query reads the cells that can hold its neighbours."""
    e = t(spark, sf, "embeddings")
    path = scratch_path(spark, "pivots")
    nearest.PivotIndex.save(e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector")), path)
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return nearest.PivotIndex.load(spark, path).search(queries, 10, digits=6)
