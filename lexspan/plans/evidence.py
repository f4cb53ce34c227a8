"""Registered queries of the evidence operators and their DuckDB SQL. Traces and cases are derived from tables by rules that both
engines share, over all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspan.operators import accounting, evidence
from lexspan.operators.checks import violations
from lexspan.plans.catalogue import THRESHOLDS, query, t
from lexspan.scratch import materialize, scratch_path
from lexspan.sources import sinks

# --- rows ------------------------------------------------------------------------------------------------------------

ROWS = """
ev AS (SELECT CASE WHEN event_id % 97 = 0 THEN ' ' ELSE 'q' || event_id END AS qid, event_id, event_type, event_type IN ('click', 'view') AS answerable,
              CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 13 END AS rank, (event_id * 37 % 1013) / 1000.0::DOUBLE AS top_score,
              CASE WHEN event_id % 89 = 0 THEN -value ELSE value END AS elapsed_ms FROM events)
"""
GOOD = "event_id % 97 <> 0 AND (rank IS NULL OR rank >= 1) AND top_score <= 1 AND elapsed_ms >= 0"


def _rows(spark, sf):
    i = F.col("event_id")
    return t(spark, sf, "events").select(
        F.when(i % 97 == 0, " ").otherwise(F.concat(F.lit("q"), i.cast("string"))).alias("qid"), "event_id", "event_type", F.col("event_type").isin("click", "view").alias("answerable"),
        F.when(i % 3 != 0, i % 13).alias("rank"), ((i * 37 % 1013) / F.lit(1000.0)).alias("top_score"), F.when(i % 89 == 0, -F.col("value")).otherwise(F.col("value")).alias("elapsed_ms"),
    )


def _good(spark, sf):
    rows = _rows(spark, sf)
    bad = violations(rows, evidence.reliability_rules(), "event_id").select("event_id").distinct()
    return rows.join(bad, "event_id", "left_anti")


@query(
    "trace_violations",
    f"""WITH {ROWS}, v AS (SELECT event_id, unnest([CASE WHEN event_id % 97 = 0 THEN 'qid' END, CASE WHEN rank < 1 THEN 'rank' END, CASE WHEN top_score > 1 THEN 'top_score' END,
    CASE WHEN elapsed_ms < 0 THEN 'elapsed_ms' END]) AS violation FROM ev) SELECT * FROM v WHERE violation IS NOT NULL""",
)
def trace_violations(spark, sf):
    return violations(_rows(spark, sf), evidence.reliability_rules(), "event_id")


@query("private_traces", f"WITH {ROWS} SELECT qid, answerable, rank, round(top_score, 4) AS top_score, top_score < 0.03 AS threshold_refused, round(elapsed_ms, 1) AS elapsed_ms FROM ev WHERE {GOOD}")
def private_traces(spark, sf):
    return evidence.private_trace(_good(spark, sf), 0.03)


#: Traces as JSON with a field too few or too many, a judge that isn't an object, a source without its article.
JSON = """
js AS (SELECT doc_id, '{"qid":"q","answerable":true,"refused":false,"refusal_stage":null,"top_score":0.5,' || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '"elapsed_ms":1,' END ||
              CASE WHEN doc_id % 11 = 0 THEN '"answer":"secret",' ELSE '' END || '"q_type":"a","judge":' || CASE WHEN doc_id % 5 = 0 THEN '3' WHEN doc_id % 5 = 1 THEN 'null' ELSE
              '{"faithfulness":1,"relevancy":2' || CASE WHEN doc_id % 13 = 0 THEN ',"reason":"r"' ELSE '' END || '}' END || ',"cited_sources":[{"doc":"d","article":"a"}' ||
              CASE WHEN doc_id % 17 = 0 THEN ',{"doc":"e"}' ELSE '' END || ']}' AS j FROM labels)
"""


@query(
    "trace_field_issues",
    """SELECT doc_id, problem FROM (SELECT doc_id, unnest([CASE WHEN doc_id % 7 = 0 THEN 'missing:elapsed_ms' END, CASE WHEN doc_id % 11 = 0 THEN 'unexpected:answer' END,
    CASE WHEN doc_id % 5 = 0 THEN 'judge_not_an_object' END, CASE WHEN doc_id % 5 > 1 AND doc_id % 13 = 0 THEN 'judge_unexpected:reason' END,
    CASE WHEN doc_id % 17 = 0 THEN 'source_missing:article' END]) AS problem FROM labels) WHERE problem IS NOT NULL""",
)
def trace_field_issues(spark, sf):
    i = F.col("doc_id")
    text = lambda *xs: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in xs))
    some = lambda c, x, y="": F.when(c, F.lit(x)).otherwise(F.lit(y))
    judge = F.when(i % 5 == 0, "3").when(i % 5 == 1, "null").otherwise(text('{"faithfulness":1,"relevancy":2', some(i % 13 == 0, ',"reason":"r"'), "}"))
    j = text(
        '{"qid":"q","answerable":true,"refused":false,"refusal_stage":null,"top_score":0.5,', some(i % 7 == 0, "", '"elapsed_ms":1,'), some(i % 11 == 0, '"answer":"secret",'),
        '"q_type":"a","judge":', judge, ',"cited_sources":[{"doc":"d","article":"a"}', some(i % 17 == 0, ',{"doc":"e"}'), "]}",
    )
    return evidence.field_issues(t(spark, sf, "labels").select("doc_id", j.alias("j")), "e2e", key="doc_id", json="j")


@query(
    "threshold_contract",
    """WITH c AS (SELECT doc_id AS qid, CASE WHEN doc_id % 17 = 0 THEN 'no_hits' WHEN doc_id % 5 = 0 THEN 'threshold' WHEN doc_id % 11 = 0 THEN 'llm' END AS stage,
       CASE WHEN doc_id % 34 = 0 OR doc_id % 29 = 0 THEN NULL ELSE (doc_id * 37 % 101) / 1000.0::DOUBLE END AS s FROM labels),
    v AS (SELECT qid, unnest([CASE WHEN stage = 'no_hits' AND s IS NOT NULL THEN 'no_hits_with_score' END, CASE WHEN stage IS DISTINCT FROM 'no_hits' AND s IS NULL THEN 'score_missing' END,
       CASE WHEN stage = 'threshold' AND s >= 0.03 THEN 'refused_above_gate' END, CASE WHEN stage IS DISTINCT FROM 'no_hits' AND stage IS DISTINCT FROM 'threshold' AND s < 0.03 THEN 'passed_below_gate' END]) AS violation FROM c)
    SELECT * FROM v WHERE violation IS NOT NULL""",
)
def threshold_contract(spark, sf):
    i = F.col("doc_id")
    rows = t(spark, sf, "labels").select(
        i.alias("qid"), F.when(i % 17 == 0, "no_hits").when(i % 5 == 0, "threshold").when(i % 11 == 0, "llm").alias("refusal_stage"),
        F.when((i % 34 != 0) & (i % 29 != 0), (i * 37 % 101) / F.lit(1000.0)).alias("top_score"),
    )
    return violations(rows, evidence.threshold_rules(0.03), "qid")


# --- cases -----------------------------------------------------------------------------------------------------------

#: Orders as cases, their line items as hits.
CASES = """
ca AS (SELECT o_orderkey AS qid, o_orderkey % 5 <> 0 AS answerable, CASE WHEN o_orderkey % 5 = 0 THEN []::BIGINT[] WHEN o_orderkey % 3 = 0 THEN [o_orderkey % 10, (o_orderkey + 1) % 10] ELSE [o_orderkey % 10] END AS sources,
              [(o_orderkey + 5) % 10] AS prohibited, o_orderkey % 5 = 0 AS expect, o_orderkey % 4 = 0 AS r1, o_orderkey % 8 = 0 AS fired, (o_orderkey * 7 % 100) / 100.0::DOUBLE < 0.2 AS refused,
              (o_orderkey * 7 % 100) / 100.0::DOUBLE AS top_score FROM orders),
hi AS (SELECT l_orderkey AS qid, list(DISTINCT l_partkey % 10) AS found FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1),
cs AS (SELECT ca.*, len(sources) AS n_expected, len(list_intersect(sources, coalesce(found, []))) AS n_found, len(list_intersect(prohibited, coalesce(found, []))) AS n_prohibited FROM ca LEFT JOIN hi USING (qid)),
sc AS (SELECT qid, answerable, n_expected, n_found, n_prohibited, n_found = n_expected AND n_prohibited = 0 AS source_ok, NOT r1 OR fired AS route_ok, refused = expect AS threshold_ok, top_score,
              CASE WHEN answerable THEN NOT refused AND n_found = n_expected AND n_prohibited = 0 ELSE refused = expect AND n_found = n_expected AND n_prohibited = 0 END AND refused = expect AND (NOT r1 OR fired) AS passed FROM cs)
"""


def _cases(spark, sf):
    k = F.col("o_orderkey")
    none, route = F.array().cast("array<string>"), F.array(F.lit("r"))
    o = t(spark, sf, "orders")
    cases = o.select(
        k.alias("qid"), (k % 5 != 0).alias("answerable"), F.when(k % 5 == 0, F.array().cast("array<bigint>")).when(k % 3 == 0, F.array(k % 10, (k + 1) % 10)).otherwise(F.array(k % 10)).alias("sources"),
        F.array((k + 5) % 10).alias("prohibited"), F.when(k % 4 == 0, route).otherwise(none).alias("required_routes"), none.alias("prohibited_routes"), (k % 5 == 0).alias("expect_refusal"),
    )
    score = (k * 7 % 100) / F.lit(100.0)
    seen = o.select(k.alias("qid"), F.when(k % 8 == 0, route).otherwise(none).alias("routes"), (score < 0.2).alias("threshold_refused"), score.alias("top_score"))
    hits = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), (F.col("l_partkey") % 10).alias("source"), F.col("l_linenumber").alias("rank"))
    return cases, evidence.case_scores(cases, hits, seen), hits, seen


@query("case_scores", f"WITH {CASES} SELECT * FROM sc")
def case_scores(spark, sf):
    return _cases(spark, sf)[1]


SUMMARY = """
su AS (SELECT count(*) AS total, count(*) FILTER (WHERE answerable) AS answerable, count(*) FILTER (WHERE NOT answerable) AS unanswerable, round(sum(n_found)::DOUBLE / sum(n_expected), 6) AS source_recall_at_5,
  round(count(*) FILTER (WHERE answerable AND passed)::DOUBLE / count(*) FILTER (WHERE answerable), 6) AS answerable_pass_rate, round(count(*) FILTER (WHERE threshold_ok)::DOUBLE / count(*), 6) AS threshold_refusal_accuracy,
  round(count(*) FILTER (WHERE route_ok)::DOUBLE / count(*), 6) AS route_accuracy, bool_and(passed) AS passed FROM sc)
"""


@query("case_summary", f"WITH {CASES}, {SUMMARY} SELECT * FROM su")
def case_summary(spark, sf):
    return evidence.case_summary(_cases(spark, sf)[1])


@query(
    "case_results",
    f"""WITH {CASES}, rk AS (SELECT qid, list(s || '@' || rank ORDER BY s) AS ranks FROM (SELECT l_orderkey AS qid, (l_partkey % 10)::VARCHAR AS s, min(l_linenumber) AS rank FROM lineitem GROUP BY 1, 2) GROUP BY qid)
    SELECT sc.*, array_to_string(coalesce(ranks, []), ',') AS source_ranks, CASE WHEN ca.fired THEN 'r' ELSE '' END AS applied_routes, ca.expect AS threshold_expected, CASE WHEN NOT ca.answerable THEN 'threshold' END AS expected_stage,
           CASE WHEN ca.refused THEN 'threshold' END AS refusal_stage, NOT ca.refused AS generation_allowed, ca.refused AS threshold_refused FROM sc JOIN ca USING (qid) LEFT JOIN rk USING (qid)""",
)
def case_results(spark, sf):
    """Of the orders' first line item for each source."""
    cases, _, hits, seen = _cases(spark, sf)
    first = hits.groupBy("qid", F.col("source").cast("string").alias("source")).agg(F.min("rank").alias("rank"))
    text = lambda c: F.col(c).cast("array<string>").alias(c)
    named = cases.select("qid", "answerable", text("sources"), text("prohibited"), "required_routes", "prohibited_routes", "expect_refusal", F.when(~F.col("answerable"), "threshold").alias("expected_stage"))
    found = evidence.case_results(named, first, seen)
    ranks = F.transform(F.map_entries("source_ranks"), lambda e: F.concat_ws("@", e["key"], e["value"].cast("string")))
    return found.withColumns({"source_ranks": F.array_join(ranks, ","), "applied_routes": F.array_join("applied_routes", ",")})


@query(
    "case_violations",
    "SELECT o_orderkey AS qid, 'overlap' AS violation FROM orders WHERE o_orderkey % 7 = 1 UNION ALL SELECT o_orderkey, 'refusal' FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 6 = 0",
)
def case_violations(spark, sf):
    """Cases that require what they prohibit, or expect an answerable question to be refused."""
    k = F.col("o_orderkey")
    cases = t(spark, sf, "orders").select(
        k.alias("qid"), k.alias("k"), (k % 5 != 0).alias("answerable"), F.when(k % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k)).alias("sources"),
        F.when(k % 7 == 1, F.array(k)).otherwise(F.array(-k)).alias("prohibited"), (k % 6 == 0).alias("expect_refusal"),
    )
    cases = cases.withColumn("sources", F.when((k := F.col("k")) % 7 == 1, F.array(k)).otherwise(F.col("sources"))).withColumn("answerable", F.col("answerable") | (F.col("k") % 7 == 1))
    cases = cases.withColumn("expect_refusal", F.col("expect_refusal") & (F.col("k") % 5 != 0)).withColumn("qid", F.col("qid").cast("string"))
    return violations(cases, evidence.case_rules(), "qid").select(F.col("qid").cast("long").alias("qid"), "violation")


@query(
    "class_findings",
    f"""WITH {ROWS}, g AS (SELECT event_type, count(*) FILTER (WHERE answerable) AS yes, count(*) FILTER (WHERE NOT answerable) AS no FROM ev GROUP BY event_type)
    SELECT 'reliability' AS artifact, event_type AS subject, problem FROM (SELECT event_type, unnest([CASE WHEN yes = 0 THEN 'no_answerable' END, CASE WHEN no = 0 THEN 'no_unanswerable' END]) AS problem FROM g) WHERE problem IS NOT NULL""",
)
def class_findings(spark, sf):
    """Types of events whose rows are all answerable, or none."""
    return evidence.class_findings("reliability", _rows(spark, sf), "event_type")


@query(
    "dataset_findings",
    """SELECT 'orders' AS artifact, k::VARCHAR AS subject, unnest(list_filter([CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN n > 0 AND c IS NULL THEN 'unexpected' END, CASE WHEN n IS NULL THEN 'missing' END], lambda x: x IS NOT NULL)) AS problem
    FROM (SELECT coalesce(o_custkey, c) AS k, n, c FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) FULL JOIN (SELECT c_custkey AS c FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c)""",
)
def dataset_findings(spark, sf):
    """Customers of orders against a stated set of customers."""
    have = t(spark, sf, "orders").select(F.col("o_custkey").alias("qid"))
    return evidence.dataset_findings("orders", have, t(spark, sf, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("qid")))


ROUTES = "ro AS (SELECT c_nationkey % 2 = 0 AS expected, c_nationkey % 2 = 0 OR c_custkey % 9 = 0 AS fired, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 7 END AS rank FROM customer)"


def _routes(spark, sf):
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    return t(spark, sf, "customer").select((n % 2 == 0).alias("expected"), ((n % 2 == 0) | (k % 9 == 0)).alias("fired"), F.when(k % 4 > 0, k % 7).alias("rank"))


ROUTE_SUMMARY = """
rs AS (SELECT count(*) FILTER (WHERE expected AND fired) AS positive_routes, count(*) FILTER (WHERE NOT expected AND NOT fired) AS collision_routes_avoided, count(*) FILTER (WHERE expected AND rank <= 5) AS positive_hit_at_5,
  count(*) FILTER (WHERE expected AND rank = 1) AS positive_hit_at_1, bool_and(expected = fired) AND bool_and(NOT expected OR coalesce(rank <= 5, false)) AS passed FROM ro)
"""


@query("route_summary", f"WITH {ROUTES}, {ROUTE_SUMMARY} SELECT * FROM rs")
def route_summary(spark, sf):
    return evidence.route_summary(_routes(spark, sf))


@query("unanswerable_scores", f"WITH {ROWS} SELECT event_type, list(round(top_score, 4) ORDER BY event_id) AS scores FROM ev WHERE NOT answerable GROUP BY event_type")
def unanswerable_scores(spark, sf):
    return evidence.unanswerable_scores(_rows(spark, sf).withColumn("pos", F.col("event_id")), "event_type")


@query("keys_beyond_the_whole", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def keys_beyond_the_whole(spark, sf):
    return evidence.not_in(t(spark, sf, "orders").select(F.col("o_custkey").alias("k")), t(spark, sf, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("k")))


# --- evidence --------------------------------------------------------------------------------------------------------

METRICS = f"""
mt AS (SELECT event_type, unnest([{{'m': 'questions', 'v': count(*)::DOUBLE}}, {{'m': 'answerable', 'v': count(*) FILTER (WHERE answerable)::DOUBLE}}, {{'m': 'unanswerable', 'v': count(*) FILTER (WHERE NOT answerable)::DOUBLE}},
         {{'m': 'hit_at_5', 'v': coalesce(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE answerable), 0)}}, {{'m': 'mrr_at_10', 'v': coalesce(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END) FILTER (WHERE answerable), 0)}}]) AS x
       FROM ev WHERE {GOOD} GROUP BY event_type)
"""


def _reliability(spark, sf):
    """Metrics by type of event as they are and as they are said to be: hits by a tenth too high, questions of views unsaid."""
    made = evidence.reliability_metrics(_good(spark, sf), THRESHOLDS, "event_type", complete=False)
    made = materialize(made, "metrics")
    said = made.where("not (event_type = 'view' and metric = 'questions')").withColumn("value", F.when((F.col("metric") == "hit_at_5") & (F.col("event_type") == "click"), F.col("value") + 0.1).otherwise(F.col("value")))
    return said, made


@query("reliability_metrics", f"WITH {ROWS}, {METRICS} SELECT event_type, x.m AS metric, round(x.v, 9) AS value FROM mt")
def reliability_metrics(spark, sf):
    named = F.col("metric").isin("questions", "answerable", "unanswerable", "hit_at_5", "mrr_at_10")
    return _reliability(spark, sf)[1].where(named).withColumn("value", F.round("value", 9))


RELIABILITY = f"""
re AS (SELECT event_type, x.m AS metric, CASE WHEN x.m = 'hit_at_5' THEN round(x.v + 0.1, 9) END AS published, round(x.v, 9) AS recomputed, CASE WHEN x.m = 'hit_at_5' THEN 'differs' ELSE 'unpublished' END AS problem
       FROM mt WHERE (event_type = 'click' AND x.m = 'hit_at_5') OR (event_type = 'view' AND x.m = 'questions'))
"""


@query("reliability_evidence", f"WITH {ROWS}, {METRICS}, {RELIABILITY} SELECT * FROM re")
def reliability_evidence(spark, sf):
    found = evidence.mismatches(*_reliability(spark, sf), "event_type")
    return found.withColumns({c: F.round(c, 9) for c in ("published", "recomputed")})


@query("route_evidence", f"WITH {ROUTES}, {ROUTE_SUMMARY} SELECT 'positive_hit_at_1' AS metric, (positive_hit_at_1 + 1)::DOUBLE AS published, positive_hit_at_1::DOUBLE AS recomputed, 'differs' AS problem FROM rs")
def route_evidence(spark, sf):
    made = evidence.unpivoted(evidence.route_summary(_routes(spark, sf)).drop("passed"))
    said = made.withColumn("value", F.when(F.col("metric") == "positive_hit_at_1", F.col("value") + 1).otherwise(F.col("value")))
    return evidence.mismatches(said, made)


@query("regression_evidence", f"WITH {CASES}, {SUMMARY} SELECT 'total' AS metric, NULL::DOUBLE AS published, total::DOUBLE AS recomputed, 'unpublished' AS problem FROM su UNION ALL SELECT 'cases', 5, NULL, 'missing'")
def regression_evidence(spark, sf):
    made = evidence.unpivoted(evidence.case_summary(_cases(spark, sf)[1]))
    said = made.withColumn("value", F.when(F.col("metric") == "total", 5.0).otherwise(F.col("value"))).withColumn("metric", F.when(F.col("metric") == "total", "cases").otherwise(F.col("metric")))
    return evidence.mismatches(said, made)


def _calls(spark, sf):
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    return t(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("qid"), (n % 2 == 0).alias("answerable"), F.col("l_returnflag").alias("requested_provider"), F.col("l_returnflag").alias("actual_provider"), F.lit("m").alias("model"),
        (F.col("l_linestatus") == "F").alias("refused"), (q % 3).alias("citation_count"), q.alias("input_tokens"), F.col("l_extendedprice").cast("long").alias("output_tokens"), F.col("l_tax").alias("elapsed_ms"),
    )


def _prices(spark):
    return spark.createDataFrame([("A", "0.30", "2.50"), ("N", "0.20", "1.20"), ("R", "0.10", "0.40")], "actual_provider string, i string, o string").selectExpr("actual_provider", "cast(i as decimal(12,6)) as input_price", "cast(o as decimal(12,6)) as output_price")


PRICED = """
pr AS (SELECT * FROM (VALUES ('A', 30, 250), ('N', 20, 120), ('R', 10, 40)) AS x(p, i, o)),
pc AS (SELECT l_returnflag AS actual_provider, trunc(l_quantity)::BIGINT AS q, trunc(l_extendedprice)::BIGINT AS e, l_linestatus = 'F' AS refused, l_linenumber % 2 = 0 AS answerable,
              (trunc(l_quantity)::BIGINT * i + trunc(l_extendedprice)::BIGINT * o)::HUGEINT AS units FROM lineitem JOIN pr ON p = l_returnflag)
"""


@query("cost_by_price_list", f"WITH {PRICED} SELECT actual_provider, count(*) AS calls, sum(units)::BIGINT AS hundredths FROM pc GROUP BY actual_provider")
def cost_by_price_list(spark, sf):
    """Sums of exact costs, in hundredths of a millionth."""
    made = accounting.priced(_calls(spark, sf), _prices(spark), "actual_provider")
    return made.groupBy("actual_provider").agg(F.count("*").alias("calls"), (F.sum("cost") * 100_000_000).cast("long").alias("hundredths"))


@query(
    "provider_evidence",
    f"WITH {PRICED} SELECT actual_provider, 'refusal_accuracy' AS metric, 1.5::DOUBLE AS published, round(avg(CASE WHEN refused = NOT answerable THEN 1.0::DOUBLE ELSE 0 END), 9) AS recomputed, 'differs' AS problem FROM pc WHERE actual_provider = 'R' GROUP BY 1",
)
def provider_evidence(spark, sf):
    made = materialize(evidence.provider_metrics(_calls(spark, sf), _prices(spark)), "metrics")
    planted = (F.col("actual_provider") == "R") & (F.col("metric") == "refusal_accuracy")
    return evidence.mismatches(made.withColumn("value", F.when(planted, 1.5).otherwise(F.col("value"))), made, "actual_provider").withColumn("recomputed", F.round("recomputed", 9))


@query(
    "release_findings",
    f"""WITH {ROWS}, {METRICS}, {RELIABILITY},
    v AS (SELECT event_id, unnest([CASE WHEN event_id % 97 = 0 THEN 'qid' END, CASE WHEN rank < 1 THEN 'rank' END, CASE WHEN top_score > 1 THEN 'top_score' END, CASE WHEN elapsed_ms < 0 THEN 'elapsed_ms' END]) AS violation FROM ev)
    SELECT 'trace' AS artifact, event_id::VARCHAR AS subject, violation AS problem FROM v WHERE violation IS NOT NULL UNION ALL SELECT 'reliability', event_type, metric || ':' || problem FROM re
    UNION ALL SELECT 'files', url, 'sensitive' FROM pages WHERE starts_with(regexp_replace(url, '^[a-z]+://[^/]*/', ''), 'prompts/') OR starts_with(regexp_replace(url, '^[a-z]+://[^/]*/', ''), 'data/raw/')""",
)
def release_findings(spark, sf):
    """All checks of a release as one table of findings."""
    path = F.regexp_replace("url", "^[a-z]+://[^/]*/", "")
    files = t(spark, sf, "pages").where(evidence.is_sensitive_path(path))
    return evidence.verify([
        evidence.row_findings("trace", _rows(spark, sf), evidence.reliability_rules(), "event_id"), evidence.metric_findings("reliability", *_reliability(spark, sf), "event_type"),
        evidence.findings("files", files, F.col("url"), F.lit("sensitive")),
    ])


@query("official_export", f"WITH {ROWS} SELECT qid, answerable, rank, round(top_score, 4) AS top_score, top_score < 0.03 AS threshold_refused, round(elapsed_ms, 1) AS elapsed_ms FROM ev WHERE {GOOD}")
def official_export(spark, sf):
    """The public trace as it is read back, after it was written and checked against what would be written again."""
    path, public = scratch_path(spark, "official"), evidence.private_trace(_good(spark, sf), 0.03)
    for check in (False, True):
        sinks.write_or_check(public, path, check=check)
    return spark.read.schema(public.schema).parquet(path)


# --- scalars ---------------------------------------------------------------------------------------------------------


@query(
    "sensitive_paths",
    """WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '.env' WHEN 1 THEN 'data\\raw\\' || page_id WHEN 2 THEN 'src/plan.md' WHEN 3 THEN 'plan.md' WHEN 4 THEN '.env/x' ELSE 'prompts/' || page_id END AS path FROM pages)
    SELECT page_id, path FROM p WHERE path IN ('.env', 'plan.md') OR starts_with(replace(path, '\\', '/'), 'data/raw/') OR starts_with(path, 'prompts/')""",
)
def sensitive_paths(spark, sf):
    i = F.col("page_id")
    n = i.cast("string")
    path = F.when(i % 6 == 0, ".env").when(i % 6 == 1, F.concat(F.lit("data\\raw\\"), n)).when(i % 6 == 2, "src/plan.md").when(i % 6 == 3, "plan.md").when(i % 6 == 4, ".env/x").otherwise(F.concat(F.lit("prompts/"), n))
    return t(spark, sf, "pages").select("page_id", path.alias("path")).where(evidence.is_sensitive_path(F.col("path")))


@query(
    "normalized_errors",
    """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'policy' WHEN event_id % 2 = 0 AND event_id % 5 = 0 AND event_id % 3 = 0 THEN 'http_401' WHEN event_id % 5 = 0 THEN 'http_400' WHEN event_id % 5 = 1 THEN 'http_429' WHEN event_id % 5 = 2 THEN 'timeout'
    WHEN event_id % 5 = 3 THEN 'transport_or_service' ELSE 'unclassified' END AS kind FROM events""",
)
def normalized_errors(spark, sf):
    i = F.col("event_id")
    name = F.when(i % 5 == 2, "ReadTimeout").when(i % 5 == 3, "APIConnectionError").otherwise("ValueError")
    message = F.when(i % 13 == 0, "Blocked by the filter").when(i % 3 == 0, "API key not valid.").otherwise("x")
    status = F.when(i % 5 == 0, "400").when(i % 5 == 1, "429").when(i % 5 == 4, "teapot")
    return t(spark, sf, "events").select("event_id", evidence.normalized_error(F.when(i % 2 == 0, "gemini").otherwise("openai"), name, message, status).alias("kind"))


@query("revision_pins", "SELECT doc_id, doc_id % 3 = 0 AS pinned FROM documents")
def revision_pins(spark, sf):
    i = F.col("doc_id")
    digest = F.sha1(F.coalesce("text", F.lit("")))
    return t(spark, sf, "documents").select("doc_id", evidence.is_pinned(F.when(i % 3 == 0, digest).when(i % 3 == 1, F.substring(digest, 1, 39)).otherwise("main")).alias("pinned"))
