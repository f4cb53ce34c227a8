"""Budgets that admit calls one after the other: a call starts if its worst case fits what is left, and only then costs anything.

Whether a call starts depends on all before it. To split an account's history over tasks, it is dealt in order by ranges and cut into
spans; a span is a function from what was spent before it to what is spent after it. Such a function adds a constant on
each of a few intervals, so it is two short arrays (Steps). Functions of neighbouring spans are composed in a tree of FAN
children; from the root down each span then learns what was spent before it, and walks its calls with that. No task has an
account's history, and no account's spans are in one task but as FAN functions.

Amounts are whole UNITS of a currency's unit, so sums are exact.

Defined results. Calls of one account and place in the order go by worst case, then cost, nulls first. A null or negative cost or worst case,
a cost above its worst case, and a null place fail the job: a ledger can't go on after what it can't account for. A null account is an
account. No calls: no rows. The input may have columns of any name but those that the operator adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.scratch import materialize

#: Parts of a currency's unit; a cost of decimal(34,13) is a whole number of them.
UNITS = 10**13
#: Calls in a span, functions that are composed into one.
SPAN, FAN = 2048, 32
#: What a chat message adds to its texts' bytes, at most, in tokens. A fixed value.
ENVELOPE = 1024
MADE = ("spent_before", "admitted")


def prompt_bound(*texts: Column) -> Column:
    """Input tokens that a prompt takes at most: a token has a byte at least. A null text fails closed: the bound is null."""
    total = F.lit(ENVELOPE).cast("long")
    for x in texts:
        total = total + F.octet_length(F.encode(x, "UTF-8")).cast("long")
    return total


@dataclass
class Steps:
    """x + add[i] for at[i] <= x < at[i + 1]; at[0] is 0."""

    at: np.ndarray
    add: np.ndarray

    @classmethod
    def none(cls) -> Steps:
        return cls(np.zeros(1, np.int64), np.zeros(1, np.int64))

    def __call__(self, x: int) -> int:
        return x + int(self.add[np.searchsorted(self.at, x, side="right") - 1])

    def _merged(self) -> Steps:
        keep = np.append(True, self.add[1:] != self.add[:-1])
        return Steps(self.at[keep], self.add[keep])

    def split(self, at: np.ndarray) -> Steps:
        """The same with a piece beginning at each of these places."""
        every = np.unique(np.concatenate((self.at, at)))
        return Steps(every, self.add[np.searchsorted(self.at, every, side="right") - 1])

    def then_call(self, most: int, cost: int, cap: int) -> Steps:
        """Followed by a call: what is at cap - most or below goes up by the cost."""
        limit = cap - most
        ends = np.append(self.at[1:], cap + 1)  # nothing above the cap is ever spent
        cut = limit - self.add + 1
        one = self.split(cut[(cut > self.at) & (cut < ends)])
        return Steps(one.at, one.add + np.where(one.at + one.add <= limit, cost, 0))._merged()

    def then(self, other: Steps, cap: int) -> Steps:
        """Followed by another function."""
        ends = np.append(self.at[1:], cap + 1)
        low, high = self.at + self.add, ends + self.add  # images of the pieces
        a, b = np.searchsorted(other.at, low, side="right"), np.searchsorted(other.at, high, side="left")
        n = np.maximum(b - a, 0)
        inner = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        one = self.split(other.at[inner] - np.repeat(self.add, n))
        return Steps(one.at, one.add + other.add[np.searchsorted(other.at, one.at + one.add, side="right") - 1])._merged()


def _units(c: Column) -> Column:
    return (c.cast("decimal(34,13)") * UNITS).cast("long")


def admission(requests: DataFrame, cap: str | Decimal, *, by: str = "account", order: str = "seq", most: str = "max_cost", cost: str = "cost", span: int = SPAN, fan: int = FAN) -> DataFrame:
    """requests with spent_before (decimal(34,13)) and admitted. cap: of each account, below 900,000."""
    top = int(Decimal(str(cap)) * UNITS)
    if not 0 < top < 9 * 10**18:
        raise ValueError("a cap is a positive amount below 900,000")
    if clash := sorted(set(MADE) & set(requests.columns)):
        raise ValueError(f"columns {clash} are made by the operator; rename them")
    m, c = _units(F.col(most)), _units(F.col(cost))
    sound = F.coalesce((m >= c) & (c >= 0) & F.col(order).isNotNull(), F.lit(False))
    checked = requests.where(F.assert_true(sound | (F.spark_partition_id() < 0), F.lit("a call's cost must lie between nothing and its worst case, and its place be known")).isNull())
    names = [f"_c{i}" for i in range(len(requests.columns))]
    rows = checked.select(*(F.col(x).alias(n) for x, n in zip(requests.columns, names, strict=True)), m.alias("_most"), c.alias("_cost"))
    account, place = names[requests.columns.index(by)], names[requests.columns.index(order)]
    dealt = rows.repartitionByRange(account, place, "_most", "_cost").sortWithinPartitions(account, place, "_most", "_cost")
    # written in order, with each row's span and its place there: what reads it again has the same spans
    rows = materialize(_spans(dealt, account, span), "ledger")
    spans = rows.groupBy(account, "_span").applyInArrow(_function(account, top), _function_type(rows, account))
    order_of = Window.partitionBy(account).orderBy("_span")
    levels = [materialize(spans.withColumn("_k", (F.row_number().over(order_of) - 1).cast("long")), "ledger-level")]
    while (levels[-1].agg(F.max("_k")).first()[0] or 0) >= fan:
        parents = levels[-1].withColumn("_up", F.floor(F.col("_k") / fan)).groupBy(account, "_up").applyInArrow(_composed(account, top), _function_type(rows, account, "_up"))
        levels.append(materialize(parents.withColumnRenamed("_up", "_k").withColumn("_span", F.col("_k")), "ledger-level"))
    start = None
    for level in reversed(levels):
        start = _started(level.withColumn("_up", F.floor(F.col("_k") / fan)), start, account, rows)
    given = start.select(F.col(account).alias("_a"), F.col("_span").alias("_s"), F.col("_start"))
    joined = rows.join(given, F.col(account).eqNullSafe(F.col("_a")) & (F.col("_span") == F.col("_s"))).drop("_a", "_s")
    walked = joined.groupBy(account, "_span").applyInArrow(_walk(top), T.StructType([*joined.schema.fields, T.StructField("_before", T.LongType()), T.StructField("_in", T.BooleanType())]))
    before = (F.col("_before").cast("decimal(20,0)") / F.lit(UNITS).cast("decimal(14,0)")).cast("decimal(34,13)")
    return walked.select(*(F.col(n).alias(x) for x, n in zip(requests.columns, names, strict=True)), before.alias("spent_before"), F.col("_in").alias("admitted"))


def _spans(dealt: DataFrame, account: str, span: int) -> DataFrame:
    """dealt with _span, which grows along an account, and _i, the row's place in it."""
    schema = T.StructType([*dealt.schema.fields, T.StructField("_span", T.LongType()), T.StructField("_i", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n, held = TaskContext.get().partitionId() << 32, span, None
        for b in batches:
            spans, places = [], []
            for a in b[account].to_pylist():
                if n == span or a != held:
                    number, n, held = number + 1, 0, a
                spans.append(number)
                places.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, pa.int64()), pa.array(places, pa.int64())], names=[*b.schema.names, "_span", "_i"])

    return dealt.mapInArrow(run, schema)


def _function_type(rows: DataFrame, account: str, key: str = "_span") -> T.StructType:
    long = T.ArrayType(T.LongType())
    return T.StructType([rows.schema[account], T.StructField(key, T.LongType()), T.StructField("_at", long), T.StructField("_add", long)])


def _row(b: pa.Table, names: list[str], key: str, f: Steps) -> pa.Table:
    long = pa.list_(pa.int64())
    return pa.table([b[names[0]].slice(0, 1), b[key].slice(0, 1), pa.array([f.at], long), pa.array([f.add], long)], names=[*names, "_at", "_add"])


def _function(account: str, cap: int):
    def run(b: pa.Table) -> pa.Table:
        b, f = b.sort_by("_i"), Steps.none()
        for most, cost in zip(b["_most"].to_pylist(), b["_cost"].to_pylist(), strict=True):
            f = f.then_call(most, cost, cap)
        return _row(b, [account, "_span"], "_span", f)

    return run


def _steps(b: pa.Table) -> list[Steps]:
    return [Steps(np.array(x, np.int64), np.array(y, np.int64)) for x, y in zip(b["_at"].to_pylist(), b["_add"].to_pylist(), strict=True)]


def _composed(account: str, cap: int):
    def run(b: pa.Table) -> pa.Table:
        b, f = b.sort_by("_k"), Steps.none()
        for g in _steps(b):
            f = f.then(g, cap)
        return _row(b, [account, "_up"], "_up", f)

    return run


def _started(children: DataFrame, parents: DataFrame | None, account: str, rows: DataFrame) -> DataFrame:
    """account, _k, _span, _start of a level, from what was spent before its parents (nothing, above the root)."""
    if parents is None:
        wanted = children.withColumn("_from", F.lit(0).cast("long"))
    else:
        own = parents.select(F.col(account).alias("_a"), F.col("_k").alias("_p"), F.col("_start").alias("_from"))
        wanted = children.join(own, F.col(account).eqNullSafe(F.col("_a")) & (F.col("_up") == F.col("_p"))).drop("_a", "_p")
    schema = T.StructType([rows.schema[account], *(T.StructField(x, T.LongType()) for x in ("_k", "_span", "_start"))])

    def run(b: pa.Table) -> pa.Table:
        b = b.sort_by("_k")
        spent, out = b["_from"][0].as_py(), []
        for f in _steps(b):
            out.append(spent)
            spent = f(spent)
        return pa.table([b[account], b["_k"], b["_span"], pa.array(out, pa.int64())], names=[account, "_k", "_span", "_start"])

    return materialize(wanted.groupBy(account, "_up").applyInArrow(run, schema), "ledger-starts")


def _walk(cap: int):
    def run(b: pa.Table) -> pa.Table:
        b = b.sort_by("_i")
        spent, before, admitted = b["_start"][0].as_py(), [], []
        for most, cost in zip(b["_most"].to_pylist(), b["_cost"].to_pylist(), strict=True):
            before.append(spent)
            admitted.append(most <= cap - spent)
            spent += cost if admitted[-1] else 0
        return b.append_column("_before", pa.array(before, pa.int64())).append_column("_in", pa.array(admitted, pa.bool_()))

    return run
