"""Mixing sources to target weights by entropy balancing.

Every word of the corpus starts with rate 1. Among the rates that bring each group's words to its target, those of the
least relative entropy are wanted; they are exponential tilts, rate = exp(sum of the duals of the document's groups), no
higher than the cap. The convex dual is solved by Newton steps, block by block where there are several constraint
columns: a step needs a gradient (words taken less target) and a curvature for each group, which are sums that Spark
aggregates over cells, the distinct combinations of the constraint columns with their exact word counts. Rates then
become whole copies by systematic rounding: a source's documents are put in the order of their sizes, and the running sum of rates
is rounded, so that whatever is rounded away from one document goes to the next of about its size. No task sorts a source:
documents are dealt into size classes (16 to an octave) and within these by a hash of their id into cells, whose sizes are
known first; a document's place is the number of documents in the cells before its own and its place in that. Where the running sum
starts is one of STARTS evenly spaced values, the one that brings the source's words nearest to its target.

Defined results. A null text has size 0. A null source is a source of its own, the last. Repeated rows are separate
documents. Documents of size 0 may get copies but take no words. No documents: no rows. Ties of size go by id; rows that tie in both
are alike. Clashing column names: the input keeps all its columns, but for those named as the operator's own (MADE), which take their
place; inner names begin with "_mix_".
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.llm.common import materialize, table

CYCLE = (5, 2, 1)
CAP = 3
#: Documents in a cell, about; values at which a running sum may start.
CELL, STARTS = 4096, 32
#: Newton ends when every group's words are within this share of its target.
CLOSE = 1e-11
STEPS = 60
#: Rates are rounded to such parts before the running sums, which are then exact.
PARTS = 1_000_000


#: Columns that the operator adds.
MADE = ("size", "source_size", "target", "rate", "copies")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets_by_weight(sources: DataFrame, *, cycle: Sequence[float] = CYCLE, cap: int = CAP) -> DataFrame:
    """source, source_size, target of each source: shares by weight, stopped at cap times the size, the rest shared anew.

    `sources` has a row for each source. The level is raised until it stops no further source; each pass is one aggregate.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, map(float, cycle))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1).cast("int"))
    ranked = materialize(sources.select("source", "source_size", w.alias("w")), "mix-sources")
    level = 0.0
    stopped = (F.col("source_size") * cap) <= F.col("w") * F.lit(level)
    while True:
        whole, held, weight, n = ranked.agg(
            F.sum("source_size"), F.sum(F.when(stopped, F.col("source_size") * cap)), F.sum(F.when(~stopped, F.col("w"))), F.count(F.when(stopped, 1))
        ).first()
        if not weight:
            break
        level = (whole - (held or 0)) / weight
        stopped = (F.col("source_size") * cap) <= F.col("w") * F.lit(level)
        if ranked.where(stopped).count() == n:
            break
    target = F.when(stopped, (F.col("source_size") * cap).cast("double")).otherwise(F.col("w") * F.lit(level))
    return ranked.select("source", "source_size", target.alias("target"))


def balance(cells: DataFrame, targets: Mapping[str, DataFrame], *, cap: float = CAP) -> DataFrame:
    """cells with their rate. cells: the constraint columns and `words`, a row for each combination. targets: for each
    constraint column a DataFrame (that column, target)."""
    names = list(targets)
    rate = F.least(F.lit(float(cap)), F.exp(sum((F.col(f"_dual_{c}") for c in names), F.lit(0.0))))
    state = cells
    for c in names:
        t = targets[c].select(F.col(c).alias("_value"), F.col("target").alias(f"_target_{c}"))
        state = state.join(t, F.col(c).eqNullSafe(F.col("_value")), "left").drop("_value").withColumn(f"_dual_{c}", F.lit(0.0))
    state = materialize(state, "mix-state")
    for step in range(STEPS * len(names)):
        c = names[step % len(names)]
        taken = F.col("words") * rate
        slope = F.when(rate < cap, taken).otherwise(0.0)
        if len(names) == 1:  # a cell is a group
            sums = state.withColumns({"_g": taken, "_h": slope})
        else:
            by = state.groupBy(F.col(c).alias("_value")).agg(F.sum(taken).alias("_g"), F.sum(slope).alias("_h"))
            sums = state.join(by, F.col(c).eqNullSafe(F.col("_value")), "left").drop("_value")
        gap, target = F.col(f"_target_{c}") - F.col("_g"), F.col(f"_target_{c}")
        # at the cap a group has no slope: a unit step down, if it has too much, leaves it
        full = F.when(F.col("_h") > 0, gap / F.col("_h")).when(gap < -CLOSE * target, F.lit(-1.0)).otherwise(0.0)
        moved = F.col(f"_dual_{c}") + F.greatest(F.lit(-2.0), F.least(F.lit(2.0), full))
        state = materialize(sums.withColumn(f"_dual_{c}", F.when(F.abs(gap) > CLOSE * target, moved).otherwise(F.col(f"_dual_{c}"))).drop("_g", "_h"), "mix-state")
        if _worst(state, names, rate) <= CLOSE:
            break
    return state.withColumn("rate", rate).select(*cells.columns, "rate")


def _worst(state: DataFrame, names: Sequence[str], rate: Column) -> float:
    worst = 0.0
    for c in names:
        t = F.first(f"_target_{c}")
        gaps = state.groupBy(c).agg(F.abs(F.sum(F.col("words") * rate) - t).alias("gap"), t.alias("t"))
        worst = max(worst, gaps.agg(F.max(F.when(F.col("t") > 0, F.col("gap") / F.col("t")))).first()[0] or 0.0)
    return worst


def _salt(id_col: Column, n: Column) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), n)


def _size_class(size: Column) -> Column:
    """32 times the number of bits and the first five of them: sizes of a class differ by a sixteenth at most."""
    bits = F.length(F.bin(size))
    shift = lambda name, n: F.call_function(name, size, n.cast("int"))
    return bits * 32 + F.when(bits > 5, shift("shiftright", bits - 5)).otherwise(shift("shiftleft", 5 - bits))


def _copies(start: Column, cap: int) -> Column:
    """Of a document, by its source's parts and its place in the source."""
    upto = F.col("_mix_place") * F.col("_mix_parts") + start
    return F.least(F.lit(cap), F.floor(upto / PARTS) - F.floor((upto - F.col("_mix_parts")) / PARTS)).cast("int")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, cap: int = CAP) -> DataFrame:
    """docs with size, source_size, target, rate and copies; taken words are copies * size. size_col: a column of sizes, where they are
    known; else words are counted, once for the plan and once for the rows."""
    size = F.col(size_col) if size_col else word_count(F.col(text_col))
    own = [c for c in docs.columns if c not in MADE]
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("_mix_key")
    # the plan is made from ids and sizes alone, written once
    slim = materialize(docs.select(F.col(id_col).alias("_mix_id"), F.col(source_col).alias("_mix_source"), key, size.cast("long").alias("_mix_size")), "mix-sizes")
    classes = slim.groupBy("_mix_source", "_mix_key", _size_class(F.col("_mix_size")).alias("_mix_class")).agg(F.sum("_mix_size").alias("words"), F.count("*").alias("n"))
    classes = materialize(classes, "mix-classes")
    cells = materialize(classes.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("words").alias("words")), "mix-cells")
    targets = targets_by_weight(cells.select("source", F.col("words").alias("source_size")), cap=cap)
    rates = balance(cells, {"source": targets}, cap=cap)
    plan = rates.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "words")
    plan = plan.withColumn("parts", F.round(F.col("rate") * PARTS).cast("long")).select("source", *(F.col(c).alias(f"_mix_{c}") for c in ("source_size", "target", "rate", "parts")))
    plan = classes.join(plan, F.col("_mix_source").eqNullSafe(F.col("source"))).withColumn("_mix_cells", F.ceil(F.col("n") / CELL).cast("long")).drop("_mix_source", "source", "words", "n")
    plan = materialize(plan, "mix-plan")
    cell = ["_mix_key", "_mix_class", "_mix_cell"]

    def dealt(rows: DataFrame, id_: str) -> DataFrame:
        found = rows.withColumn("_mix_class", _size_class(F.col("_mix_size"))).join(plan, ["_mix_key", "_mix_class"])
        return found.withColumn("_mix_cell", _salt(F.col(id_), F.col("_mix_cells")))

    before = F.sum("count").over(Window.partitionBy("_mix_key").orderBy(F.desc("_mix_class"), "_mix_cell").rowsBetween(Window.unboundedPreceding, -1))
    bases = materialize(dealt(slim, "_mix_id").groupBy(*cell).count().select(*cell, F.coalesce(before, F.lit(0)).alias("_mix_before")), "mix-bases")

    def placed(rows: DataFrame, id_: str) -> DataFrame:
        inside = F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc("_mix_size"), F.col(id_).asc_nulls_last()))
        return dealt(rows, id_).join(bases, cell).withColumn("_mix_place", F.col("_mix_before") + inside)

    tried = [F.sum(_copies(F.lit(u * PARTS // STARTS), cap) * F.col("_mix_size")).alias(f"_{u}") for u in range(STARTS)]
    sums = placed(slim, "_mix_id").groupBy("_mix_key").agg(F.round(F.first("_mix_target")).cast("long").alias("t"), *tried)
    gaps = F.array_min(F.array(*(F.struct(F.abs(F.col(f"_{u}") - F.col("t")).alias("gap"), F.lit(u).alias("u")) for u in range(STARTS))))
    starts = materialize(sums.select("_mix_key", (gaps["u"] * (PARTS // STARTS)).cast("long").alias("_mix_start")), "mix-starts")
    whole = docs.select(*own, key, size.cast("long").alias("_mix_size"))
    found = placed(whole, id_col).join(starts, "_mix_key").withColumn("_mix_copies", _copies(F.col("_mix_start"), cap))
    return found.select(*own, *(F.col(f"_mix_{c}").alias(c) for c in MADE))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # counted once and written: the sums and the rounding read ids and sizes, not texts
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "mix-sizes")
    found = mix(sized, size_col="words")
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


#: DuckDB SQL for op9_mixing: the dual has a closed form where each document is in one group.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
     w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
     r AS (SELECT *, 3 * source_size / w AS ratio FROM w),
     c AS (SELECT *, coalesce(sum(3 * source_size) OVER before, 0) AS held, sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wt,
                  sum(source_size) OVER () AS whole FROM r WINDOW before AS (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     lv AS (SELECT min_by((whole - held)::DOUBLE / wt, ratio) AS level FROM c WHERE (whole - held)::DOUBLE / wt < ratio),
     t AS (SELECT source, source_size, n, CASE WHEN level IS NULL OR 3 * source_size <= w * level THEN (3 * source_size)::DOUBLE ELSE w * level END AS target FROM r, lv),
     b AS (SELECT *, length(bin(size)) * 32 + CASE WHEN length(bin(size)) > 5 THEN size >> (length(bin(size)) - 5) ELSE size << (5 - length(bin(size))) END AS class FROM d),
     m AS (SELECT source, class, ceil(count(*) / 4096.0)::BIGINT AS cells FROM b GROUP BY ALL),
     p AS (SELECT b.doc_id, b.source, b.size, b.class, source_size, target,
                  CASE WHEN source_size = 0 THEN 1000000 ELSE round(least(3.0::DOUBLE, target / source_size) * 1000000) END::BIGINT AS parts,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % cells AS cell
           FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source JOIN m ON m.source IS NOT DISTINCT FROM b.source AND m.class = b.class),
     k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY class DESC, cell, size DESC, doc_id NULLS LAST) AS place FROM p),
     g AS (SELECT source, u, abs(sum(size * least(3, (place * parts + u * 31250) // 1000000 - ((place - 1) * parts + u * 31250) // 1000000)) - any_value(round(target)::BIGINT)) AS gap
           FROM k, range(32) AS x(u) GROUP BY source, u),
     h AS (SELECT source, u * 31250 AS start FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY gap, u) AS r FROM g) WHERE r = 1)
SELECT doc_id, size, source_size, target, (size * least(3, (place * parts + start) // 1000000 - ((place - 1) * parts + start) // 1000000))::BIGINT AS taken
FROM k JOIN h ON h.source IS NOT DISTINCT FROM k.source
"""
