"""Retrieval, refusal and answer metrics over traces, threshold sweeps, and the choice of thresholds that are nowhere worse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.operators.answers import STAGES


def share(condition: Column, of: Column | None = None, empty: float | None = 0.0) -> Column:
    """Share of the rows of `of` for which the condition holds; `empty` where there is none."""
    of = F.lit(True) if of is None else of
    got = F.try_divide(F.count(F.when(of & condition, 1)).cast("double"), F.count(F.when(of, 1)))
    return F.coalesce(got, F.lit(empty)) if empty is not None else got


def hit_at(k: int, of: Column | None = None) -> Column:
    return share(F.coalesce(F.col("rank") <= k, F.lit(False)), of)


def mrr_at(k: int, of: Column | None = None) -> Column:
    of = F.lit(True) if of is None else of
    return F.coalesce(F.avg(F.when(of, F.when(F.col("rank") <= k, F.lit(1.0) / F.col("rank")).otherwise(0.0))), F.lit(0.0))


def retrieval_metrics(traces: DataFrame, *by: str, hit_k: int = 5, mrr_k: int = 10) -> DataFrame:
    """questions, answerable, hit, mrr and mean latency of answerable questions. traces: answerable, rank, elapsed_ms."""
    a = F.col("answerable")
    return traces.groupBy(*by).agg(
        F.count("*").alias("questions"), F.count(F.when(a, 1)).alias("answerable"), hit_at(hit_k, a).alias("hit"), mrr_at(mrr_k, a).alias("mrr"),
        F.avg(F.when(a, F.col("elapsed_ms"))).alias("mean_ms"),
    )


def threshold_sweep(traces: DataFrame, thresholds: Sequence[float], *by: str) -> DataFrame:
    """For each threshold, how many questions a gate would refuse: traces (answerable, top_score). One pass; a row is compared
    with each of the stated thresholds, and nothing but counts is shuffled."""
    values = sorted(set(thresholds))
    if len(values) != len(thresholds):
        raise ValueError("thresholds must be distinct")
    each = traces.select(*by, "answerable", "top_score", F.explode(F.array(*map(F.lit, map(float, values)))).alias("threshold"))
    low, a = F.col("top_score") < F.col("threshold"), F.col("answerable")
    return each.groupBy(*by, "threshold").agg(
        F.count(F.when(a & low, 1)).alias("false_refusals"), share(low, a).alias("false_refusal_rate"),
        F.count(F.when(~a & low, 1)).alias("unanswerable_refusals"), share(low, ~a).alias("unanswerable_coverage"),
    )


def pareto_better(sweeps: DataFrame, dataset: str, production: float) -> DataFrame:
    """Thresholds that refuse no more answerable and no fewer unanswerable questions than production in every data set, and
    differ in one. sweeps: threshold_sweep() by a data set column."""
    base = sweeps.where(F.col("threshold") == production).select(dataset, F.col("false_refusal_rate").alias("f0"), F.col("unanswerable_coverage").alias("c0"))
    both = sweeps.where(F.col("threshold") != production).join(F.broadcast(base), dataset)  # a row for each data set
    f, c = F.col("false_refusal_rate"), F.col("unanswerable_coverage")
    judged = both.groupBy("threshold").agg(F.every((f <= F.col("f0")) & (c >= F.col("c0"))).alias("ok"), F.some((f != F.col("f0")) | (c != F.col("c0"))).alias("differs"))
    return judged.where("ok and differs").select("threshold")


def e2e_metrics(traces: DataFrame, *by: str) -> DataFrame:
    """traces: qid, answerable, refused, refusal_stage, n_cited, faithfulness and relevancy (null where not judged)."""
    a, refused, stage = F.col("answerable"), F.col("refused"), F.col("refusal_stage")
    direct = F.coalesce(stage.isin("no_hits", "threshold"), F.lit(False))
    judged = a & F.col("faithfulness").isNotNull()
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("qid"))))
    return traces.groupBy(*by).agg(
        F.count("*").alias("n_questions"), F.count(F.when(a, 1)).alias("n_answerable"), F.count(F.when(judged, 1)).alias("n_judged"),
        F.count(F.when(~refused, 1)).alias("n_answered"), F.count(F.when(~direct, 1)).alias("n_generation_calls"),
        ids(a & refused).alias("false_refusals"), share(refused, a).alias("false_refusal_rate"),
        F.avg(F.when(judged, F.col("faithfulness"))).alias("avg_faithfulness"), F.avg(F.when(judged, F.col("relevancy"))).alias("avg_relevancy"),
        share(F.col("faithfulness") >= 4, judged, None).alias("pct_faithfulness_ge4"),
        F.count(F.when(~refused & (F.col("n_cited") > 0), 1)).alias("n_answers_with_citations"),
        share(F.col("n_cited") > 0, ~refused, None).alias("citation_parse_coverage"),
        F.count(F.when(~a, 1)).alias("n_unanswerable"), share(refused, ~a, None).alias("refusal_accuracy"), ids(~a & ~refused).alias("missed_refusals"),
        share(direct, a).alias("direct_false_refusal_rate"), share(direct, ~a, None).alias("direct_unanswerable_coverage"),
    )


def refusals_by_stage(traces: DataFrame) -> DataFrame:
    """A row for each stage, those without refusals too."""
    spark, a = traces.sparkSession, F.col("answerable")
    stages = spark.createDataFrame([(s,) for s in STAGES], "refusal_stage string")
    got = traces.where("refusal_stage is not null").groupBy("refusal_stage").agg(F.count(F.when(a, 1)).alias("answerable"), F.count(F.when(~a, 1)).alias("unanswerable"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return stages.join(got, "refusal_stage", "left").select("refusal_stage", zero("answerable"), zero("unanswerable"))


def regression_summary(results: DataFrame) -> DataFrame:
    """results: n_expected, n_found, route_ok, threshold_ok. Recall is over all expected sources together."""
    return results.agg(
        F.count("*").alias("cases"), F.coalesce(F.try_divide(F.sum("n_found").cast("double"), F.sum("n_expected")), F.lit(0.0)).alias("source_recall"),
        share(F.col("route_ok")).alias("route_accuracy"), share(F.col("threshold_ok")).alias("threshold_accuracy"),
        F.coalesce(F.every(F.col("route_ok") & F.col("threshold_ok") & (F.col("n_found") == F.col("n_expected"))), F.lit(False)).alias("passed"),
    )
