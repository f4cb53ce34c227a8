"""Budgets, tree differences and evidence rules: against plain readings, and whatever columns are read."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lexspan.operators import accounting, evidence, ledger, trees

# --- budgets ---

CALLS = "account string, seq long, max_cost decimal(34,13), cost decimal(34,13), _most int"


def _ledger(rows, cap):
    """Account by account, one call after the other."""
    out, spent = [], {}
    for account, seq, most, cost, _ in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2], r[3])):
        before = spent.get(account, Decimal(0))
        ok = most <= cap - before
        out.append((str(account), seq, most, cost, before, ok))
        spent[account] = before + (cost if ok else 0)
    return sorted(out)


@pytest.mark.parametrize("span,fan", [(1, 2), (7, 3), (60, 4), (2048, 32)])
def test_admission_equals_the_ledger(spark, span, fan):
    rng, rows = random.Random(span), []
    for account, n in (("a", 400), ("b", 40), (None, 3), ("", 1)):
        for i in range(n):
            most = rng.choice([0, 1, rng.randint(0, 300)])
            rows.append((account, i // 2, Decimal(most) / 1000, Decimal(rng.randint(0, most)) / 1000, i))
    rows += rows[:5]
    got = ledger.admission(spark.createDataFrame(rows, CALLS).repartition(5), "5.5", span=span, fan=fan).collect()
    assert sorted((str(r.account), r.seq, r.max_cost, r.cost, r.spent_before, r.admitted) for r in got) == _ledger(rows, Decimal("5.5"))
    assert any(not r.admitted for r in got) and sorted(str(r._most) for r in got) == sorted(str(r[4]) for r in rows)


def test_a_refused_call_costs_nothing(spark):
    d = lambda x: Decimal(x)
    calls = spark.createDataFrame([("a", 1, d(6), d(6), 0), ("a", 2, d(6), d(6), 0), ("a", 3, d(3), d(3), 0)], CALLS)
    assert [(r.admitted, int(r.spent_before)) for r in ledger.admission(calls, 10).orderBy("seq").collect()] == [(True, 0), (False, 6), (True, 6)]
    assert ledger.admission(calls.limit(0), 10).count() == 0


@pytest.mark.parametrize("row", [("a", 1, Decimal(1), Decimal(2), 0), ("a", 1, Decimal(1), Decimal(-1), 0), ("a", None, Decimal(1), Decimal(1), 0), ("a", 1, None, Decimal(1), 0), ("a", 1, Decimal(1), None, 0)])
def test_calls_that_a_ledger_cant_account_for(spark, row):
    with pytest.raises(Exception, match="worst case"):
        ledger.admission(spark.createDataFrame([row], CALLS), 10).count()


def test_caps_and_clashing_names(spark):
    calls = spark.createDataFrame([("a", 1, Decimal(1), Decimal(1), 0)], CALLS)
    for cap in (0, -1, 10**6):
        with pytest.raises(ValueError, match="cap"):
            ledger.admission(calls, cap)
    with pytest.raises(ValueError, match="rename"):
        ledger.admission(calls.withColumn("admitted", F.lit(1)), 1)


def test_prompt_bound(spark):
    row = spark.createDataFrame([("aé中", None)], "a string, b string").select(ledger.prompt_bound(F.col("a"), F.lit("x")).alias("n"), ledger.prompt_bound(F.col("a"), F.col("b")).alias("none")).first()
    assert (row.n, row.none) == (1024 + 6 + 1, None)


# --- trees ---


def _paths(a, b, path="", tolerance=1e-12):
    if isinstance(a, dict) and isinstance(b, dict):
        out = []
        for k in sorted({*a, *b}):
            at = f"{path}.{k}" if path else k
            out += [(at, "added" if k not in a else "removed")] if k not in a or k not in b else _paths(a[k], b[k], at)
        return out
    if isinstance(a, list) and isinstance(b, list):
        out = [(f"{path}.length", "length")] if len(a) != len(b) else []
        return out + [x for i, (p, q) in enumerate(zip(a, b, strict=False)) for x in _paths(p, q, f"{path}[{i}]")]
    number = lambda x: isinstance(x, (int, float))
    same = abs(a - b) <= tolerance * max(1, abs(a), abs(b)) if number(a) and number(b) else type(a) is type(b) and a == b
    return [] if same else [(path or "root", "changed")]


def _tree(rng, depth):
    kind = rng.random()
    if depth and kind < 0.4:
        return {rng.choice(["a", "b", "c", "k", "é x", "path"]): _tree(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if depth and kind < 0.7:
        return [_tree(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([None, True, False, 0, 1, 2, -7, 1.0, 2.5, 1e300, 12345678901, "", "x", "1", "null", "{}", "中"])


def _moved(rng, x):
    if rng.random() < 0.15:
        return _tree(rng, 2)
    if isinstance(x, dict):
        return {k: _moved(rng, v) for k, v in x.items() if rng.random() > 0.1} | ({"new": 1} if rng.random() < 0.1 else {})
    if isinstance(x, list):
        return [_moved(rng, v) for v in x] + ([None] if rng.random() < 0.1 else [])
    return x + 1e-14 if isinstance(x, float) and rng.random() < 0.5 else x


def test_tree_diff_equals_a_plain_walk(spark):
    rng = random.Random(3)
    pairs = [(a, _moved(rng, a)) for a in (_tree(rng, 6) for _ in range(250))] + [([1, 2], [1, 2.0, 3]), ({"k": 1}, {"k": True}), ([[[[[[[[1]]]]]]]], [[[[[[[[2]]]]]]]]), ("x", "x"), (5, "5")]
    frame = lambda s: spark.createDataFrame([(i, json.dumps(p[s])) for i, p in enumerate(pairs)], "k int, j string")
    got = sorted((r.k, r.path, r.kind) for r in trees.tree_diff(frame(0), frame(1), key="k", json="j").collect())
    assert got == sorted((i, *x) for i, (a, b) in enumerate(pairs) for x in _paths(a, b))
    assert len({x[2] for x in got}) == 4


def test_tree_diff_edges(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path int, a string")
    old = frame([(1, None), (2, "not json"), (3, "not json"), (4, "{}"), (None, "[1]"), (6, "{}"), (6, '{"x":1}'), (7, '{"a":1,"a":2}')])
    new = frame([(1, "{}"), (2, "not json"), (3, "other"), (5, "{}"), (None, "[2]"), (6, "{}"), (7, '{"a":1,"a":2}')])
    got = sorted(map(str, ((r.path, r[1], r.kind) for r in trees.tree_diff(old.withColumnRenamed("path", "path_"), new.withColumnRenamed("path", "path_"), key="path_", json="a").withColumnRenamed("path_", "p").toDF("path", "at", "kind").collect())))
    assert got == sorted(map(str, [(1, "root", "added"), (3, "_text", "changed"), (4, "root", "removed"), (5, "root", "added"), (None, "[0]", "changed"), (6, "x", "removed")]))
    assert trees.tree_diff(old.limit(0), new.limit(0), key="path", json="a").count() == 0


# --- evidence ---


def test_rules_hold_whatever_is_read(spark):
    rows = spark.createDataFrame([("b", True, 0, 5.0, -2.0)], "qid string, answerable boolean, rank int, top_score double, elapsed_ms double")
    public = evidence.private_trace(rows, 0.5)
    for read in [[c] for c in public.columns] + [[]]:
        with pytest.raises(Exception, match="trace breaks rule"):
            public.select(*read).count() if read else public.count()
        with pytest.raises(Exception, match="trace breaks rule"):
            public.select(*read, F.lit(1).alias("one")).collect()
    call = spark.createDataFrame([("p", 10, 20)], "provider string, input_tokens int, output_tokens int")
    price = spark.sql("select 'q' as provider, cast(0.3 as decimal(12,6)) as input_price, cast(2.5 as decimal(12,6)) as output_price")
    for found in (accounting.priced(call, price), accounting.priced(call, price).select("input_tokens"), accounting.priced(call, price).select(F.lit(1).alias("one"))):
        with pytest.raises(Exception, match="no price"):
            found.collect()
        with pytest.raises(Exception, match="no price"):
            found.count()
    provider = spark.createDataFrame([("q", True, "a", "b", "m", False, 1, 1, 1, Decimal(1), 1.0)], "qid string, answerable boolean, requested_provider string, actual_provider string, model string, refused boolean, citation_count int, input_tokens int, output_tokens int, cost decimal(34,13), elapsed_ms double")
    with pytest.raises(Exception, match="breaks rule provider"):
        evidence.private_provider_trace(provider).select("qid").count()


def test_summaries_demand_both_kinds(spark):
    rows = lambda xs: spark.createDataFrame(xs, "expected boolean, fired boolean, rank int")
    assert [evidence.route_summary(rows(x)).first().passed for x in ([], [(True, True, 1)], [(False, False, None)], [(True, True, 1), (False, False, None)])] == [False, False, False, True]
    traces = spark.createDataFrame([("a", True, 1, 0.5, 1.0), ("a", False, None, 0.1, 1.0), ("b", True, 1, 0.5, 1.0)], "g string, answerable boolean, rank int, top_score double, elapsed_ms double")
    with pytest.raises(Exception, match="both_kinds"):
        evidence.reliability_metrics(traces, [0.3], "g").count()
    assert evidence.reliability_metrics(traces.where("g = 'a'"), [0.3], "g").count() > 6
    assert [(r.subject, r.problem) for r in evidence.class_findings("x", traces, "g").collect()] == [("b", "no_unanswerable")]
    assert [r.problem for r in evidence.class_findings("x", traces.limit(0), "g").collect()] == ["no_rows"]


CASE = "qid string, question string, category string, rationale string, answerable boolean, sources array<string>, prohibited array<string>, expect_refusal boolean, expected_stage string, required_routes array<string>, prohibited_routes array<string>, style_tags array<string>"
GOOD = {"qid": "c", "question": "q", "category": "k", "rationale": "r", "answerable": True, "sources": ["x"], "prohibited": [], "expect_refusal": False, "expected_stage": None, "required_routes": ["r"], "prohibited_routes": ["s"], "style_tags": ["t"]}


@pytest.mark.parametrize(
    "change,broken",
    [
        ({}, set()), ({"question": " "}, {"question"}), ({"category": None}, {"category"}), ({"rationale": ""}, {"rationale"}), ({"answerable": None}, {"answerable", "sources", "stage"}),
        ({"expected_stage": "llm"}, {"stage"}), ({"answerable": False, "sources": []}, {"stage"}), ({"answerable": False, "sources": [], "expected_stage": "llm"}, set()),
        ({"answerable": False, "sources": [], "expected_stage": "llm", "expect_refusal": True}, {"stage"}), ({"answerable": False, "sources": [], "expected_stage": "threshold", "expect_refusal": True}, set()),
        ({"required_routes": ["r", "r "]}, {"routes"}), ({"prohibited_routes": [" "]}, {"routes"}), ({"prohibited_routes": ["r"]}, {"route_overlap"}), ({"prohibited": ["y", "y"]}, {"prohibited"}),
        ({"style_tags": []}, {"style_tags"}), ({"style_tags": ["t", ""]}, {"style_tags"}), ({"style_tags": ["t", "t"]}, {"style_tags"}), ({"prohibited": ["x"]}, {"overlap"}), ({"expect_refusal": True}, {"refusal"}),
    ],
)
def test_compact_case_rules(spark, change, broken):
    from lexspan.operators.checks import violations

    case = spark.createDataFrame([tuple((GOOD | change).values())], CASE)
    assert {r.violation for r in violations(case, evidence.compact_case_rules(), "qid").collect()} == broken


def test_route_cases_and_stated_sets(spark):
    from lexspan.operators.checks import violations

    rows = [("a", "q", True, ["s"], ["t"]), ("b", "q", False, [], ["t"]), ("c", " ", True, [], ["t"]), ("d", "q", None, ["s"], []), ("e", "q", False, ["s"], [""])]
    cases = spark.createDataFrame(rows, "qid string, question string, expect_expansion boolean, sources array<string>, style_tags array<string>")
    found = {(r.qid, r.violation) for r in violations(cases, evidence.route_case_rules("s"), "qid").collect()}
    assert found == {("c", "question"), ("c", "sources"), ("d", "expect_expansion"), ("d", "sources"), ("d", "style_tags"), ("e", "sources"), ("e", "style_tags")}
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "qid string")
    got = evidence.dataset_findings("x", ids(["a", "a", "z", None]), ids(["a", "b"])).collect()
    assert sorted((str(r.subject), r.problem) for r in got) == [("None", "unexpected"), ("a", "repeated"), ("b", "missing"), ("z", "unexpected")]


def test_field_issues_keep_their_places(spark):
    j = '{"answerable":1,"cited_sources":["x",{"doc":1},{"doc":2}],"elapsed_ms":1,"judge":{"relevancy":1},"q_type":1,"qid":1,"refusal_stage":1,"refused":1,"top_score":1}'
    found = evidence.field_issues_at(spark.createDataFrame([(1, j), (1, "[]")], "k int, j string"), "e2e", key="k", json="j").collect()
    assert sorted((r.place, r.problem) for r in found) == [
        ("", "not_an_object"), ("cited_sources[0]", "source_not_an_object"), ("cited_sources[1]", "source_missing:article"), ("cited_sources[2]", "source_missing:article"), ("judge", "judge_missing:faithfulness")
    ]


def test_case_results_rest_on_sound_lists(spark):
    cases = spark.createDataFrame([("a", True, ["x", "y"], ["z"], ["r"], ["s"], False, None), ("b", False, [], ["z"], [], [], True, "threshold")], "qid string, answerable boolean, sources array<string>, prohibited array<string>, required_routes array<string>, prohibited_routes array<string>, expect_refusal boolean, expected_stage string")
    hits = lambda xs: spark.createDataFrame(xs, "qid string, source string, rank int")
    seen = lambda xs: spark.createDataFrame(xs, "qid string, routes array<string>, threshold_refused boolean, top_score double")
    good_hits, good_seen = [("a", "y", 5), ("a", " x ", 1), ("a", "q", 9)], [("a", ["r", "b"], False, 0.9), ("b", [], True, 0.1)]
    got = {r.qid: r for r in evidence.case_results(cases, hits(good_hits), seen(good_seen)).collect()}
    a, b = got["a"], got["b"]
    assert a.source_ranks == {"x": 1, "y": 5, "q": 9} and a.applied_routes == ["b", "r"] and (a.refusal_stage, a.generation_allowed, a.threshold_expected) == (None, True, False)
    assert b.source_ranks == {} and (b.refusal_stage, b.expected_stage, b.generation_allowed, b.passed) == ("threshold", "threshold", False, True)
    for bad in ([("a", "x", 0)], [("a", " ", 1)], [("a", "x", 1), ("a", "x ", 2)]):
        with pytest.raises(Exception, match="breaks rule"):
            evidence.case_results(cases, hits(bad), seen(good_seen)).select("qid", "source_ranks").collect()
    for bad in ([("a", ["r", "r"], False, 0.9)], [("a", [""], False, 0.9)], [("a", [], None, 0.9)], [("a", [], False, -1.0)], [("a", [], False, float("nan"))]):
        with pytest.raises(Exception, match="breaks rule"):
            evidence.case_results(cases, hits(good_hits), seen(bad)).count()
