"""Prompts, refusals in two layers, and citations, as columns over a batch of answers. Generation is an injected function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import citation

# The phrase by which an answer refuses, and what stands for an empty context.
REFUSAL = "知識庫中沒有相關資訊"
NO_CONTEXT = "(無檢索結果)"
STAGES = ("no_hits", "threshold", "llm")


def context_blocks(hits: DataFrame) -> DataFrame:
    """qid, context: "[rank] citation\\ncontent" of each hit in order. hits: qid, rank, doc_title, article_label, content."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), citation(F.col("doc_title"), F.col("article_label")), F.lit("\n"), F.col("content"))
    rows = hits.select("qid", F.struct("rank", line.alias("line")).alias("x")).groupBy("qid").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select("qid", F.array_join(F.transform("x", lambda x: x["line"]), "\n\n").alias("context"))


def prompts(questions: DataFrame, hits: DataFrame, template: str = "{context}\n\n{question}") -> DataFrame:
    """qid, prompt. The original question goes in, not the expanded one."""
    before, after = template.split("{question}")
    left, right = before.split("{context}")
    context = F.coalesce("context", F.lit(NO_CONTEXT))
    return questions.join(context_blocks(hits), "qid", "left").select("qid", F.concat(F.lit(left), context, F.lit(right), F.col("question"), F.lit(after)).alias("prompt"))


def gate(n_hits: Column, top_score: Column, threshold: float, reranked: bool) -> Column:
    """no_hits, threshold or null: what is refused before generation. A score at the threshold passes; without a reranker scores
    have another meaning and aren't compared."""
    below = (top_score < threshold) if reranked else F.lit(False)
    return F.when(n_hits == 0, "no_hits").when(below, "threshold")


def answer(questions: DataFrame, hits: DataFrame, generate: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *, threshold: float, reranked: bool) -> DataFrame:
    """qid, stage, text, refused, cited. generate maps Arrow batches of (qid, prompt) to (qid, text), for questions past the gate."""
    tops = hits.groupBy("qid").agg(F.count("*").alias("n_hits"), F.max_by("score", -F.col("rank")).alias("top_score"))
    gated = questions.join(tops, "qid", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0))).withColumn("stage", gate(F.col("n_hits"), F.col("top_score"), threshold, reranked))
    open_ = prompts(gated.where("stage is null").select("qid", "question"), hits)
    kind = questions.schema["qid"].dataType.simpleString()
    made = open_.mapInArrow(generate, f"qid {kind}, text string")
    told = gated.join(made, "qid", "left").withColumn("stage", F.when(F.col("stage").isNotNull(), F.col("stage")).when(F.contains(F.col("text"), F.lit(REFUSAL)), "llm"))
    refused = F.col("stage").isNotNull()
    cites = F.when(refused, F.array().cast("array<int>")).otherwise(cited(F.col("text"), F.col("n_hits")))
    text = F.coalesce("text", F.lit(f"{REFUSAL},無法回答此問題。"))
    return told.select("qid", "stage", text.alias("text"), refused.alias("refused"), cites.alias("cited"))


def cited(text: Column, n_hits: Column) -> Column:
    """Numbers in [n] or ［n］ that name a hit, distinct and sorted."""
    found = F.regexp_extract_all(text, F.lit(r"[\[［]([0-9]{1,9})[\]］]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: x.cast("int")), lambda i: (i >= 1) & (i <= n_hits))))


def cited_sources(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, index and the hit's columns of each citation."""
    each = answers.select("qid", F.explode("cited").alias("index"))
    return each.join(hits.withColumnRenamed("rank", "index"), ["qid", "index"])


def refusal_stage(refused: Column, n_retrieved: Column, top_score: Column, threshold: float) -> Column:
    """The stage of a trace that doesn't record it: null if not refused, 'ambiguous' if the score is at the threshold."""
    return F.when(~refused, None).when(n_retrieved == 0, "no_hits").when(top_score == threshold, "ambiguous").when(top_score < threshold, "threshold").otherwise("llm")


def stage_violations(traces: DataFrame) -> DataFrame:
    """Rows whose refused flag and stage disagree, or whose stage is unknown."""
    odd = F.col("refused") != F.col("refusal_stage").isNotNull()
    unknown = F.col("refusal_stage").isNotNull() & ~F.col("refusal_stage").isin(*STAGES)
    return traces.where(odd | unknown).select("qid", F.when(odd, "refused_and_stage_disagree").otherwise("unknown_stage").alias("violation"))


def routed(primary: Column, primary_error: Column, fallback: Column) -> Column:
    """One fallback for operational errors; a policy error is final."""
    return F.when(primary_error.isNull(), primary).when(primary_error == "operational", fallback)


def judge_scores(raw: Column) -> Column:
    """faithfulness and relevancy out of a judge's answer with a JSON object somewhere in it; null unless both are 1 to 5."""
    block = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    got = F.from_json(block, "faithfulness int, relevancy int")
    fits = lambda c: got[c].between(1, 5)
    return F.when(fits("faithfulness") & fits("relevancy"), got)
