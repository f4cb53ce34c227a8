"""Exact costs of model calls, running budgets and the choice of questions for a cross-check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MILLION = 1_000_000
#: Rows of a price list that is sent whole.
MOST_PRICES = 100_000


def cost(input_tokens: Column, output_tokens: Column, input_per_million: str, output_per_million: str) -> Column:
    """Exact, as decimal(34,13): token counts below 10**12, prices a million as decimal text of six places at most. Wider types
    would make Spark round the quotient."""
    price = lambda p: F.lit(p).cast("decimal(12,6)")
    whole = input_tokens.cast("decimal(12,0)") * price(input_per_million) + output_tokens.cast("decimal(12,0)") * price(output_per_million)
    return (whole / F.lit(MILLION).cast("decimal(7,0)")).cast("decimal(34,13)")


def priced(traces: DataFrame, prices: DataFrame, by: str = "provider") -> DataFrame:
    """traces with cost by a price list (by, input_price, output_price: decimal(12,6) a million tokens); one without a price fails the
    job. A price list has a row for each provider; up to MOST_PRICES of them go to the traces, which stay where they are, as all traces of
    a few providers would else meet in as few tasks."""
    listed = prices.select(by, "input_price", "output_price")
    few = listed.limit(MOST_PRICES + 1).count() <= MOST_PRICES
    priced_ = traces.drop("cost").join(F.broadcast(listed) if few else listed, by, "left")
    whole = F.col("input_tokens").cast("decimal(12,0)") * F.col("input_price") + F.col("output_tokens").cast("decimal(12,0)") * F.col("output_price")
    exact = (whole / F.lit(MILLION).cast("decimal(7,0)")).cast("decimal(34,13)")
    known = F.assert_true(F.col("input_price").isNotNull() & F.col("output_price").isNotNull() | (F.spark_partition_id() < 0), F.concat(F.lit("no price for "), F.coalesce(F.col(by).cast("string"), F.lit("null"))))
    return priced_.where(known.isNull()).withColumn("cost", exact).drop("input_price", "output_price")


def provider_metrics(traces: DataFrame, by: str = "provider") -> DataFrame:
    """traces: by, refusal_verdict, citation_verdict (0 or 1), input_tokens, output_tokens, cost (decimal), elapsed_ms."""
    return traces.groupBy(by).agg(
        F.count("*").alias("requests"), F.avg("refusal_verdict").alias("refusal_accuracy"), F.avg("citation_verdict").alias("citation_success_rate"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), F.avg("elapsed_ms").alias("avg_latency_ms"),
    )


def running_budget(requests: DataFrame, cap: str, *, by: str = "account", order: str = "seq", cut: int = 1_000_000) -> DataFrame:
    """An audit of calls that all ran: spent_before, and can_start, whether a call's worst case (max_cost) then still fitted. Every
    call is charged, also one that shouldn't have started; which calls a budget lets start is ledger.admission().

    An account's requests are summed in two steps, over spans of `cut` of the order and within them, so that no task has an
    account's whole history.
    """
    cell = requests.withColumn("_cut", F.floor(F.col(order) / cut))
    sums = cell.groupBy(by, "_cut").agg(F.sum("cost").alias("_s"))
    earlier = F.sum("_s").over(Window.partitionBy(by).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1))
    start = sums.withColumn("_start", F.coalesce(earlier, F.lit(0))).drop("_s")
    inside = F.sum("cost").over(Window.partitionBy(by, "_cut").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    got = cell.join(start, [by, "_cut"]).withColumn("spent_before", F.coalesce(inside, F.lit(0)) + F.col("_start"))
    return got.withColumn("can_start", F.col("max_cost") <= F.lit(cap).cast("decimal(34,13)") - F.col("spent_before")).drop("_cut", "_start")


def crosscheck_rows(questions: DataFrame, evidence: DataFrame, *, maximum: int, answerable: int = 3, unanswerable: int = 2) -> DataFrame:
    """qid and phase: the first few questions of both kinds that the gate lets through, in order, then the rest up to a maximum.

    questions: qid, pos, answerable. evidence: qid, threshold_refused. The report has `maximum` rows at most.
    """
    eligible = questions.join(evidence, "qid").where(~F.col("threshold_refused"))
    kinds = Window.partitionBy("answerable").orderBy("pos", "qid")
    first = F.row_number().over(kinds) <= F.when(F.col("answerable"), answerable).otherwise(unanswerable)
    # the first of each kind and the first of all: two bounded lists
    heads = [eligible.where(F.col("answerable") == a).orderBy("pos", "qid").limit(maximum) for a in (True, False)]
    few = heads[0].unionByName(heads[1]).withColumn("_initial", first)
    place = F.row_number().over(Window.partitionBy("_initial").orderBy("pos", "qid"))
    ranked = few.withColumn("_n", place)
    keep = F.col("_initial") | (F.col("_n") <= maximum - answerable - unanswerable)
    return ranked.where(keep).select("qid", F.when(F.col("_initial"), "initial").otherwise("expansion").alias("phase"))
