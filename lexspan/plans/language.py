"""Registered queries of dictionary segmentation and their DuckDB SQL. The dictionary is what both engines count in `benchmark`."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspan.operators import lexical, segment
from lexspan.plans.catalogue import query, t


def _dictionary(spark, sf):
    """Runs of two to six small letters of the benchmark's items, with their counts."""
    words = t(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.where(F.char_length("word").between(2, 6)).groupBy("word").agg(F.count("*").alias("count"))


#: From each run's end on, the best weight of every rest of the run, and its words; ties go to the longer first word.
SEGMENTS = """
dict AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) BETWEEN 2 AND 6 GROUP BY w),
total AS (SELECT sum(n)::DOUBLE AS n FROM dict),
weights AS (SELECT w, round(1000000 * ln(dict.n / total.n))::BIGINT AS weight FROM dict, total),
unknown AS (SELECT round(1000000 * ln(1 / n))::BIGINT AS weight FROM total),
dr AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS runs FROM documents),
er AS (SELECT row_id, unnest(runs) AS run, unnest(range(len(runs))) AS i FROM dr),
runs AS (SELECT DISTINCT run FROM er),
places AS (SELECT run, unnest(range(length(run))) AS pos FROM runs),
spans AS (SELECT run, pos, unnest(range(1, least(6, length(run) - pos) + 1)) AS k FROM places),
edges AS (SELECT run, pos, k, coalesce(weights.weight, unknown.weight) AS weight FROM spans LEFT JOIN weights ON w = substr(run, pos + 1, k), unknown WHERE k = 1 OR w IS NOT NULL),
path AS (SELECT run, length(run) AS pos, [0::BIGINT] AS best, [''] AS words FROM runs
         UNION ALL
         SELECT run, pos, list_prepend(top.score, best), list_prepend(substr(run, pos + 1, top.k) || ' ' || words[top.k], words)
         FROM (SELECT run, e.pos, any_value(best) AS best, any_value(words) AS words, max({score: weight + best[k], k: k}) AS top
               FROM path JOIN edges e USING (run) WHERE e.pos = path.pos - 1 GROUP BY run, e.pos)),
cut AS (SELECT run, words[1] AS words FROM path WHERE pos = 0),
seg AS (SELECT row_id, string_agg(words, '' ORDER BY i) AS words FROM er JOIN cut USING (run) GROUP BY row_id)
"""


@query(
    "dictionary_segments",
    f"WITH RECURSIVE {SEGMENTS} SELECT doc_id, len(string_split(coalesce(words, ''), ' ')) - 1 AS n_tokens, sha256(rtrim(coalesce(words, ''), ' ')) AS tokens_sha256 FROM dr LEFT JOIN seg USING (row_id)",
)
def dictionary_segments(spark, sf):
    made = segment.segmenter(_dictionary(spark, sf), hidden=False, runs="[a-z]+", cut="[a-z]+", lower=True, stop=frozenset())
    tokens = segment.dictionary_tokens(made, spark)
    d = t(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("tokens"))
    return d.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(F.encode(F.array_join("tokens", " "), "UTF-8"), 256).alias("tokens_sha256"))


@query("bm25_dictionary_topk")
def bm25_dictionary_topk(spark, sf):
    """BM25 over the dictionary's words, unknown characters by the hidden Markov model."""
    made = segment.segmenter(_dictionary(spark, sf), runs="[a-z]+", cut="[a-z]+", lower=True, stop=frozenset())
    tokens = segment.dictionary_tokens(made, spark)
    docs = lexical.materialize(lexical.tokenized(t(spark, sf, "documents"), "doc_id", "text", tokens), "dictionary-tokens")
    queries = lexical.materialize(lexical.tokenized(t(spark, sf, "benchmark"), "item_id", "text", tokens), "dictionary-queries")
    return lexical.bm25(docs, queries, k=10, digits=6)
