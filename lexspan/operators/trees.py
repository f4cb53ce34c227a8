"""Differences of JSON trees, to any depth: objects by key, arrays by place with their lengths.

Both trees are variants in one row, joined once by their key. A level of the trees is a projection: what differs is taken apart, a row
for each key or place, and what is equal as text ends there, so a level holds no more than the parts of trees that still
differ. A few levels follow each other in one pass over the rows, with what was found before in them; then what is found and what
is still open is written, once, and read again until nothing is open. The deepest difference sets how often.

Defined results. Of arrays of different lengths, places that both have are compared; the length is one difference. true and false
count as 1 and 0, and numbers are the same within the tolerance. A null is only equal to a null. A text that isn't JSON is
compared as a text. A key on one side only: its tree was added or removed, as one difference; the same of a key that
repeats in old or new, where all rows of the one side meet all of the other. A null text is no tree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.scratch import materialize

TOLERANCE = 1e-12
#: Levels in one pass.
LEVELS = 3


def _variant(text: Column) -> Column:
    """A text that isn't JSON is a string."""
    parsed = F.try_parse_json(text)
    return F.coalesce(parsed, F.to_variant_object(F.struct(text.alias("_text"))))


def _kinds(side: str) -> dict[str, Column]:
    as_type = lambda t: F.expr(f"try_cast({side} AS {t})")
    return {f"{side}_map": as_type("map<string, variant>"), f"{side}_list": as_type("array<variant>")}


def _same(tolerance: float) -> Column:
    """Whether two leaves are equal."""
    number = lambda s: F.when(F.expr(f"schema_of_variant({s})").isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | F.expr(f"schema_of_variant({s})").startswith("DECIMAL"), F.expr(f"try_cast(try_cast({s} AS string) AS double)"))
    truth = lambda s: F.when(F.expr(f"schema_of_variant({s})") == "BOOLEAN", F.expr(f"try_cast({s} AS int)").cast("double"))
    a, b = (F.coalesce(truth(s), number(s)) for s in ("a", "b"))
    gap = F.abs(a - b) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs(a), F.abs(b)))
    text = lambda s: F.when(F.expr(f"schema_of_variant({s})") == "STRING", F.expr(f"try_cast({s} AS string)"))
    nothing = F.expr("is_variant_null(a) AND is_variant_null(b)")
    return F.coalesce(gap, F.lit(False)) | F.coalesce(text("a") == text("b"), F.lit(False)) | nothing


def tree_diff(old: DataFrame, new: DataFrame, *, key: str, json: str, tolerance: float = TOLERANCE) -> DataFrame:
    """key, path, kind (added, removed, length, changed). Paths are `a.b[0].c`, `a.length`, and `root` where the trees themselves differ."""
    side = lambda df, name: df.where(F.col(json).isNotNull()).select(F.col(key).alias("_key"), F.col(json).alias(name))
    a, b = side(old, "a"), side(new, "b").withColumnRenamed("_key", "_other")
    both = a.join(b, F.col("_key").eqNullSafe(F.col("_other")), "full_outer").where("NOT (a <=> b)")
    whole = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
    at_key = F.when(F.col("a").isNull(), F.col("_other")).otherwise(F.col("_key"))
    level = both.select(at_key.alias("_key"), F.lit("").alias("path"), _variant(F.col("a")).alias("a"), _variant(F.col("b")).alias("b"), whole.alias("kind"))
    level, found = level.where("kind IS NOT NULL OR NOT (to_json(a) <=> to_json(b))"), []
    while True:
        for _ in range(LEVELS):
            level = _next(level, tolerance)
        level = materialize(level, "tree")
        found.append(level.where("kind IS NOT NULL").select("_key", "path", "kind"))
        level = level.where("kind IS NULL")
        if level.isEmpty():
            break
    out = reduce(DataFrame.unionByName, found)
    return out.select(F.col("_key").alias(key), F.when(F.col("path") == "", "root").otherwise(F.col("path")).alias("path"), "kind")


def _next(level: DataFrame, tolerance: float) -> DataFrame:
    """What is found, and the next level's parts that differ: _key, path, a, b, kind (set of what is found)."""
    open_ = F.col("kind").isNull()
    kinds = _kinds("a") | _kinds("b")
    level = level.withColumns({name: F.when(open_, made) for name, made in kinds.items()})
    objects = F.col("a_map").isNotNull() & F.col("b_map").isNotNull()
    lists = F.col("a_list").isNotNull() & F.col("b_list").isNotNull()
    none = F.lit(None).cast("variant")
    row = lambda path, a, b, kind: F.struct(path.alias("path"), a.alias("a"), b.alias("b"), kind.cast("string").alias("kind"))
    end = lambda path, kind: F.array(row(path, none, none, kind))
    nothing = F.slice(end(F.col("path"), F.lit("")), 1, 0)

    def field(k: Column) -> Column:
        has_a, has_b = F.map_contains_key("a_map", k), F.map_contains_key("b_map", k)
        path = F.when(F.col("path") == "", k).otherwise(F.concat("path", F.lit("."), k))
        return row(path, F.try_element_at("a_map", k), F.try_element_at("b_map", k), F.when(~has_a, "added").when(~has_b, "removed"))

    fields = F.transform(F.array_union(F.map_keys("a_map"), F.map_keys("b_map")), field)
    n = F.least(F.size("a_list"), F.size("b_list"))
    pairs = F.arrays_zip(F.slice("a_list", F.lit(1), n).alias("a"), F.slice("b_list", F.lit(1), n).alias("b"))
    places = F.transform(pairs, lambda x, i: row(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")), x["a"], x["b"], F.lit(None)))
    size = F.when(F.size("a_list") != F.size("b_list"), end(F.concat("path", F.lit(".length")), F.lit("length"))).otherwise(nothing)
    differs = lambda x: x["kind"].isNotNull() | ~F.to_json(x["a"]).eqNullSafe(F.to_json(x["b"]))
    parts = F.when(~open_, end(F.col("path"), F.col("kind"))).when(objects, F.filter(fields, differs)).when(lists, F.concat(size, F.filter(places, differs)))
    parts = parts.when(~_same(tolerance), end(F.col("path"), F.lit("changed")))
    return level.select("_key", F.explode(parts).alias("x")).select("_key", "x.path", "x.a", "x.b", "x.kind")
