"""Published evidence against what its rows say: validators, field lists, contracts, scores of cases, metrics made anew.

Every check is a DataFrame of findings (see FINDING), so that checks of many artifacts are one union and nothing is right unless that
is empty. Metrics are unpivoted to a row each and meet the published ones in a full outer join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.operators import accounting, evaluation
from lexspan.operators.checks import held, violations

FINDING = ("artifact", "subject", "problem")

# Fields of public traces; paths that aren't published; what tells kinds of provider errors.
FIELDS = {
    "ablation": ("answerable", "chunking", "elapsed_ms", "qid", "rank", "reranker", "retrieval", "top_score"),
    "e2e": ("answerable", "cited_sources", "elapsed_ms", "judge", "q_type", "qid", "refusal_stage", "refused", "top_score"),
    "reliability": ("qid", "answerable", "rank", "top_score", "threshold_refused", "elapsed_ms"),
}
JUDGE_FIELDS = ("faithfulness", "relevancy")
SOURCE_FIELDS = ("article", "doc")
SENSITIVE_PATHS = (
    ".claude/", ".env", ".venv/", ".worktrees/", "data/raw/", "docs/superpowers/", "eval/runs/", "indexes/", "prompts/", "provider/", "storage/", "answers/",
    "INTERVIEW_PREP.md", "STARTUP.md", "plan.md",
)
POLICY_WORDS = ("safety", "policy", "content_filter", "blocked")
OPERATIONAL_STATUS = (400, 401, 403, 404, 408, 409, 429, 500, 502, 503, 504)
OPERATIONAL_WORDS = ("connection", "timeout", "authentication", "permission", "ratelimit", "servererror", "notfound", "serviceunavailable")
BAD_KEY_WORDS = ("api key not valid", "api key expired", "api_key_invalid", "invalid api key")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def any_of(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


# --- rows ------------------------------------------------------------------------------------------------------------


def reliability_rules() -> dict[str, Column]:
    """Rules for qid, answerable, rank, top_score and elapsed_ms."""
    return {
        "qid": ~blank(F.col("qid")), "answerable": F.col("answerable").isNotNull(), "rank": F.col("rank").isNull() | (F.col("rank") >= 1),
        "top_score": finite(F.col("top_score")) & F.col("top_score").between(0, 1), "elapsed_ms": finite(F.col("elapsed_ms")) & (F.col("elapsed_ms") >= 0),
    }


def provider_rules() -> dict[str, Column]:
    """Rules for qid, requested_provider, actual_provider, model, citation_count, tokens, cost and elapsed_ms."""
    same = (F.col("requested_provider") == F.col("actual_provider")) & (F.col("requested_provider") != "")
    rules = {"qid": ~blank(F.col("qid")), "provider": same, "model": ~blank(F.col("model")), "elapsed_ms": finite(F.col("elapsed_ms")) & (F.col("elapsed_ms") >= 0)}
    return rules | {c: F.col(c) >= 0 for c in ("citation_count", "input_tokens", "output_tokens", "cost")}


def case_rules() -> dict[str, Column]:
    """Rules for cases: qid, answerable, sources, prohibited, expect_refusal. No source is both required and prohibited."""
    n = F.coalesce(F.size("sources"), F.lit(0))
    return {
        "qid": ~blank(F.col("qid")), "sources": F.when(F.col("answerable"), n > 0).otherwise(n == 0), "overlap": ~F.arrays_overlap("sources", "prohibited"),
        "repeated": F.size(F.array_distinct("sources")) == F.size("sources"), "refusal": ~(F.col("answerable") & F.col("expect_refusal")),
    }


def compact_case_rules() -> dict[str, Column]:
    """case_rules() and the rest of what a reviewed case keeps. Cases also have question, category, rationale, expected_stage,
    required_routes, prohibited_routes and style_tags."""
    refuses, stage, answerable = F.col("expect_refusal"), F.col("expected_stage"), F.col("answerable")
    filled = lambda c: F.size(F.col(c)) > 0
    names = lambda c: ~F.exists(F.col(c), blank) & (F.size(F.array_distinct(F.transform(F.col(c), lambda x: F.trim(x)))) == F.size(F.col(c)))
    texts = {c: ~blank(F.col(c)) for c in ("question", "category", "rationale")}
    return case_rules() | texts | {
        "answerable": answerable.isNotNull() & refuses.isNotNull(),
        "stage": F.when(answerable, stage.isNull()).otherwise(F.coalesce(stage.isin("threshold", "llm"), F.lit(False)) & (refuses == (stage == "threshold"))),
        "routes": names("required_routes") & names("prohibited_routes"), "route_overlap": ~F.arrays_overlap("required_routes", "prohibited_routes"),
        "prohibited": F.size(F.array_distinct("prohibited")) == F.size("prohibited"), "style_tags": filled("style_tags") & names("style_tags"),
    }


def route_case_rules(*sources: str) -> dict[str, Column]:
    """Rules for cases of one route: qid, question, expect_expansion, sources (just these where the route should fire), style_tags."""
    want = F.when(F.col("expect_expansion"), F.array(*map(F.lit, sources)).cast("array<string>")).otherwise(F.array().cast("array<string>"))
    tags = F.col("style_tags")
    return {
        "qid": ~blank(F.col("qid")), "question": ~blank(F.col("question")), "expect_expansion": F.col("expect_expansion").isNotNull(), "sources": F.col("sources") == want,
        "style_tags": (F.size(tags) > 0) & ~F.exists(tags, blank),
    }


def dataset_findings(artifact: str, rows: DataFrame, expected: DataFrame, key: str = "qid") -> DataFrame:
    """Ids that repeat, that the stated set (a table of the same key) doesn't have, and that it has alone."""
    n = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
    want = expected.select(F.col(key).alias("_w")).distinct()
    both = n.join(want, F.col("_k").eqNullSafe(F.col("_w")), "full_outer")
    problem = F.filter(F.array(F.when(F.col("_n") > 1, "repeated"), F.when(F.col("_n").isNotNull() & F.col("_w").isNull(), "unexpected"), F.when(F.col("_n").isNull(), "missing")), lambda x: x.isNotNull())
    return findings(artifact, both.select(F.coalesce("_k", "_w").alias("_k"), F.explode(problem).alias("_p")), F.col("_k"), F.col("_p"))


def class_findings(artifact: str, traces: DataFrame, by: str) -> DataFrame:
    """Groups that have no answerable, or no unanswerable, question: their rates say nothing. No traces at all is a finding, too."""
    a = F.col("answerable")
    n = traces.groupBy(by).agg(F.count(F.when(a, 1)).alias("_yes"), F.count(F.when(~a, 1)).alias("_no"))
    problem = F.filter(F.array(F.when(F.col("_yes") == 0, "no_answerable"), F.when(F.col("_no") == 0, "no_unanswerable")), lambda x: x.isNotNull())
    each = findings(artifact, n.select(by, F.explode(problem).alias("_p")), F.col(by), F.col("_p"))
    none = traces.agg(F.count("*").alias("_n")).where("_n = 0").select(F.lit(artifact).alias("artifact"), F.lit(None).cast("string").alias("subject"), F.lit("no_rows").alias("problem"))
    return each.unionByName(none)


def threshold_rules(threshold: float) -> dict[str, Column]:
    """What refusal_stage says of top_score: none without hits; else finite, and below the threshold just where that refused."""
    score, nothing = F.col("top_score"), F.coalesce(F.col("refusal_stage") == "no_hits", F.lit(False))
    by_gate = F.coalesce(F.col("refusal_stage") == "threshold", F.lit(False))
    ok = finite(score)
    return {
        "no_hits_with_score": ~nothing | score.isNull(), "score_missing": nothing | score.isNotNull(), "score_not_finite": nothing | score.isNull() | ok,
        "refused_above_gate": nothing | ~ok | ~by_gate | (score < threshold), "passed_below_gate": nothing | ~ok | by_gate | (score >= threshold),
    }


def field_difference(found: Column, expected: Sequence[str]) -> Column:
    """Entries "unexpected:x" and "missing:x" of two sets of names."""
    want = F.array(*map(F.lit, expected))
    told = lambda kind, names: F.transform(F.array_sort(names), lambda x: F.concat(F.lit(f"{kind}:"), x))
    return F.concat(told("unexpected", F.array_except(found, want)), told("missing", F.array_except(want, found)))


def field_issues_at(rows: DataFrame, kind: Sequence[str] | str, *, key: str, json: str) -> DataFrame:
    """key, place, problem: fields that a JSON object has beyond the list of its kind, or lacks; for e2e traces also those of the judge
    and of each cited source. What isn't an object is one problem. The place is empty, `judge` or `cited_sources[i]`."""
    keys = lambda c: F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    at = lambda place, c: F.transform(c, lambda x: F.struct(place.alias("place"), x.alias("problem")))
    parts = [at(F.lit(""), F.when(F.json_object_keys(json).isNull(), F.array(F.lit("not_an_object"))).otherwise(field_difference(keys(F.col(json)), FIELDS[kind] if isinstance(kind, str) else kind)))]
    if kind == "e2e":
        judge, cited = F.get_json_object(json, "$.judge"), F.from_json(F.get_json_object(json, "$.cited_sources"), "array<string>")
        told = lambda prefix, c: F.transform(c, lambda x: F.concat(F.lit(prefix), x))
        shaped = lambda prefix, c, names: F.when(F.json_object_keys(c).isNull(), F.array(F.lit(f"{prefix}not_an_object"))).otherwise(told(prefix, field_difference(keys(c), names)))
        parts.append(F.when(judge.isNotNull(), at(F.lit("judge"), shaped("judge_", judge, JUDGE_FIELDS))))
        place = lambda i: F.concat(F.lit("cited_sources["), i.cast("string"), F.lit("]"))
        parts.append(F.flatten(F.transform(cited, lambda s, i: at(place(i), shaped("source_", s, SOURCE_FIELDS)))))
    none = F.array().cast("array<struct<place:string,problem:string>>")
    return rows.select(key, F.explode(F.concat(*(F.coalesce(p, none) for p in parts))).alias("_x")).select(key, "_x.place", "_x.problem")


def field_issues(rows: DataFrame, kind: Sequence[str] | str, *, key: str, json: str) -> DataFrame:
    """key, problem: each kind of field_issues_at() once for each row's key."""
    return field_issues_at(rows, kind, key=key, json=json).select(key, "problem").distinct()


def private_trace(rows: DataFrame, threshold: float) -> DataFrame:
    """The public fields of reliability rows and nothing else; rows that break a rule fail the job, whatever is read of them."""
    if not 0 <= threshold <= 1:
        raise ValueError("a threshold lies between 0 and 1")
    refused = F.col("top_score") < threshold
    kept = held(rows, reliability_rules(), "trace")
    return kept.select("qid", "answerable", "rank", F.round("top_score", 4).alias("top_score"), refused.alias("threshold_refused"), F.round("elapsed_ms", 1).alias("elapsed_ms"))


def private_provider_trace(rows: DataFrame) -> DataFrame:
    """The public fields of provider rows with their verdicts: refused just where there is no answer; cited just where not refused.
    Rows that break a rule fail the job."""
    rows = held(rows, provider_rules(), "provider trace")
    refused, cited = F.col("refused"), F.col("citation_count") > 0
    return rows.select(
        "qid", "answerable", "requested_provider", "actual_provider", "model", "refused", "citation_count", "input_tokens", "output_tokens", "cost",
        (refused == ~F.col("answerable")).cast("int").alias("refusal_verdict"), (refused != cited).cast("int").alias("citation_verdict"), F.round("elapsed_ms", 1).alias("elapsed_ms"),
    )


# --- cases -----------------------------------------------------------------------------------------------------------


def case_scores(cases: DataFrame, hits: DataFrame, observed: DataFrame, *, top: int = 5) -> DataFrame:
    """What became of each case. cases: qid, answerable, sources, prohibited, required_routes, prohibited_routes (arrays), expect_refusal.
    hits: qid, source, rank. observed: qid, routes, threshold_refused, top_score. Only hits up to `top` are gathered."""
    near = hits.where(F.col("rank") <= top).groupBy("qid").agg(F.collect_set("source").alias("_found"))
    both = cases.join(observed, "qid", "left").join(near, "qid", "left")
    found = F.coalesce("_found", F.array().cast(hits.schema["source"].dataType.simpleString().join(("array<", ">"))))
    routes = F.coalesce("routes", F.array().cast("array<string>"))
    n = lambda wanted: F.size(F.array_intersect(wanted, found))
    source_ok = (F.col("n_found") == F.col("n_expected")) & (F.col("n_prohibited") == 0)
    route_ok = (F.size(F.array_except("required_routes", routes)) == 0) & ~F.arrays_overlap("prohibited_routes", routes)
    threshold_ok = F.col("threshold_refused").eqNullSafe(F.col("expect_refusal"))
    answer_ok = F.when(F.col("answerable"), ~F.col("threshold_refused") & F.col("source_ok")).otherwise(F.col("threshold_ok") & F.col("source_ok"))
    counted = both.withColumns({"n_expected": F.size("sources"), "n_found": n(F.col("sources")), "n_prohibited": n(F.col("prohibited"))})
    judged = counted.withColumns({"source_ok": source_ok, "route_ok": route_ok, "threshold_ok": threshold_ok})
    return judged.select(
        "qid", "answerable", "n_expected", "n_found", "n_prohibited", "source_ok", "route_ok", "threshold_ok", F.round("top_score", 6).alias("top_score"),
        F.coalesce(answer_ok & F.col("threshold_ok") & F.col("route_ok"), F.lit(False)).alias("passed"),
    )


def case_results(cases: DataFrame, hits: DataFrame, observed: DataFrame, *, top: int = 5) -> DataFrame:
    """case_scores() with what they rest on: source_ranks, applied_routes, refusal stages, whether generation is allowed. Hits of a
    question are a retriever's list. A blank source, a rank below 1 or a source twice in a list fails the job, as does a score that
    is missing, negative or not finite, a blank or repeated route, or a verdict that is missing."""
    hits = held(hits, {"source": ~blank(F.col("source").cast("string")), "rank": F.col("rank") >= 1}, "hit")
    lists = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.trim(F.col("source").cast("string")).alias("source"), "rank"))).alias("_hits"))
    lists = held(lists, {"repeated": F.size(F.array_distinct(F.transform("_hits", lambda x: x["source"]))) == F.size("_hits")}, "hit list")
    routes = F.transform("routes", lambda x: F.trim(x))
    seen = held(observed, {
        "routes": ~F.exists("routes", blank) & (F.size(F.array_distinct(routes)) == F.size("routes")), "threshold_refused": F.col("threshold_refused").isNotNull(),
        "top_score": finite(F.col("top_score")) & (F.col("top_score") >= 0),
    }, "observation").withColumn("routes", F.array_sort(routes))
    scores = case_scores(cases, hits, seen, top=top)
    more = cases.select("qid", F.col("expect_refusal").alias("threshold_expected"), "expected_stage").join(seen.select("qid", F.col("routes").alias("applied_routes"), "threshold_refused"), "qid", "left")
    ranks = F.coalesce(F.map_from_entries("_hits"), F.create_map().cast("map<string,int>"))
    joined = scores.join(more, "qid").join(lists, "qid", "left")
    return joined.withColumns({
        "source_ranks": ranks, "refusal_stage": F.when(F.col("threshold_refused"), "threshold"), "generation_allowed": ~F.col("threshold_refused"),
    }).drop("_hits")


def case_summary(results: DataFrame) -> DataFrame:
    """One row over case_scores(): recall is over all expected sources together."""
    a = F.col("answerable")
    rate = lambda c, of=None: F.round(evaluation.share(c, of), 6)
    return results.agg(
        F.count("*").alias("total"), F.count(F.when(a, 1)).alias("answerable"), F.count(F.when(~a, 1)).alias("unanswerable"),
        F.round(F.coalesce(F.try_divide(F.sum("n_found").cast("double"), F.sum("n_expected")), F.lit(0.0)), 6).alias("source_recall_at_5"),
        rate(F.col("passed"), a).alias("answerable_pass_rate"), rate(F.col("threshold_ok")).alias("threshold_refusal_accuracy"), rate(F.col("route_ok")).alias("route_accuracy"),
        F.coalesce(F.every("passed"), F.lit(False)).alias("passed"),
    )


def route_summary(cases: DataFrame) -> DataFrame:
    """One row. cases: expected (a route should fire), fired, rank. Nothing has passed without cases of both kinds."""
    yes, fired = F.col("expected"), F.col("fired")
    n = lambda c: F.count(F.when(c, 1))
    found = cases.agg(
        n(yes & fired).alias("positive_routes"), n(~yes & ~fired).alias("collision_routes_avoided"), n(yes & (F.col("rank") <= 5)).alias("positive_hit_at_5"),
        n(yes & (F.col("rank") == 1)).alias("positive_hit_at_1"), n(yes).alias("_yes"), n(~yes).alias("_no"),
    )
    all_ok = (F.col("positive_routes") == F.col("_yes")) & (F.col("collision_routes_avoided") == F.col("_no")) & (F.col("positive_hit_at_5") == F.col("_yes"))
    return found.withColumn("passed", all_ok & (F.col("_yes") > 0) & (F.col("_no") > 0)).drop("_yes", "_no")


def unanswerable_scores(traces: DataFrame, *by: str) -> DataFrame:
    """by, scores: rounded top scores of unanswerable questions in the order of pos. A report over stated question sets."""
    rows = traces.where(~F.col("answerable")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", F.round("top_score", 4).alias("s")))).alias("x"))
    return rows.select(*by, F.transform("x", lambda x: x["s"]).alias("scores"))


def not_in(part: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows of part that whole doesn't have: empty where it is a subset."""
    return part.distinct().exceptAll(whole.distinct())


# --- evidence --------------------------------------------------------------------------------------------------------


def unpivoted(metrics: DataFrame, *by: str) -> DataFrame:
    """by, metric, value: a row for each other column."""
    names = [c for c in metrics.columns if c not in by]
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names)))
    return metrics.select(*by, each.alias("x")).select(*by, "x.metric", "x.value")


def mismatches(published: DataFrame, recomputed: DataFrame, *by: str, tolerance: float = 1e-9) -> DataFrame:
    """by, metric, published, recomputed, problem (missing, unpublished or differs). Both have by, metric, value."""
    a = published.select(*by, "metric", F.col("value").alias("published"), F.lit(1).alias("_a"))
    b = recomputed.select(*by, "metric", F.col("value").alias("recomputed"), F.lit(1).alias("_b"))
    x, y = F.col("published"), F.col("recomputed")
    near = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x), F.abs(y)), F.lit(False))
    problem = F.when(F.col("_a").isNull(), "unpublished").when(F.col("_b").isNull(), "missing").when(~near, "differs")
    return a.join(b, [*by, "metric"], "full_outer").select(*by, "metric", "published", "recomputed", problem.alias("problem")).where("problem is not null")


def reliability_metrics(traces: DataFrame, thresholds: Sequence[float], by: str, *, complete: bool = True) -> DataFrame:
    """by, metric, value: retrieval metrics, and the sweep's under names that begin with their threshold. A group without questions
    of both kinds fails the job; if not `complete`, a kind without questions has rates of 0 (see class_findings)."""
    a = F.col("answerable")
    whole = traces.groupBy(by).agg(
        F.count("*").alias("questions"), F.count(F.when(a, 1)).alias("answerable"), F.count(F.when(~a, 1)).alias("unanswerable"),
        evaluation.hit_at(5, a).alias("hit_at_5"), evaluation.mrr_at(10, a).alias("mrr_at_10"), F.round(F.avg("elapsed_ms"), 1).alias("avg_latency_ms"),
    )
    if complete:
        whole = held(whole, {"both_kinds": (F.col("answerable") > 0) & (F.col("unanswerable") > 0)}, "group of traces")
    swept = unpivoted(evaluation.threshold_sweep(traces, thresholds, by), by, "threshold")
    named = swept.select(by, F.concat_ws(":", F.col("threshold").cast("string"), "metric").alias("metric"), "value")
    return unpivoted(whole, by).unionByName(named)


def provider_metrics(traces: DataFrame, prices: DataFrame) -> DataFrame:
    """actual_provider, metric, value of provider rows, whose costs are made anew from a price list (see accounting.priced)."""
    public = private_provider_trace(accounting.priced(traces, prices, "actual_provider"))
    return unpivoted(accounting.provider_metrics(public, "actual_provider"), "actual_provider")


def findings(artifact: str, found: DataFrame, subject: Column, problem: Column) -> DataFrame:
    return found.select(F.lit(artifact).alias("artifact"), subject.cast("string").alias("subject"), problem.cast("string").alias("problem"))


def row_findings(artifact: str, rows: DataFrame, rules: Mapping[str, Column], key: str = "qid") -> DataFrame:
    return findings(artifact, violations(rows, rules, key), F.col(key), F.col("violation"))


def metric_findings(artifact: str, published: DataFrame, recomputed: DataFrame, by: str) -> DataFrame:
    found = mismatches(published, recomputed, by)
    return findings(artifact, found, F.col(by), F.concat_ws(":", "metric", "problem"))


def verify(parts: Sequence[DataFrame]) -> DataFrame:
    """All findings; evidence is right if there are none (see checks.require_none)."""
    return reduce(DataFrame.unionByName, parts)


# --- scalars ---------------------------------------------------------------------------------------------------------


def is_sensitive_path(path: Column) -> Column:
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return reduce(lambda a, b: a | b, (F.startswith(plain, F.lit(p)) if p.endswith("/") else plain == p for p in SENSITIVE_PATHS))


def normalized_error(provider: Column, class_name: Column, message: Column, status: Column) -> Column:
    """policy, http_<status>, timeout, transport_or_service or unclassified. A refused key of one provider counts as http_401."""
    name, said, code = F.lower(F.coalesce(class_name, F.lit(""))), F.lower(F.coalesce(message, F.lit(""))), status.try_cast("int")
    return (
        F.when(any_of(name, POLICY_WORDS) | any_of(said, POLICY_WORDS), "policy")
        .when((provider == "gemini") & (code == 400) & any_of(said, BAD_KEY_WORDS), "http_401")
        .when(code.isin(*OPERATIONAL_STATUS), F.concat(F.lit("http_"), code.cast("string")))
        .when(F.contains(name, F.lit("timeout")), "timeout").when(any_of(name, OPERATIONAL_WORDS), "transport_or_service").otherwise("unclassified")
    )


def is_pinned(revision: Column) -> Column:
    """Whether a model's revision is a full commit id."""
    return F.coalesce(revision.rlike("^[0-9a-f]{40}$"), F.lit(False))
