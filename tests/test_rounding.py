"""Rounding against Python's, which goes by exact binary values, too."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from lexspan.functions.rounding import round_exact


def _doubles(rng, n):
    out = [0.0, -0.0, 0.5, 1.5, 2.5, -0.5, 2.675, 1.005, 0.125, 0.375, 1e300, -1e300, 5e-324, float("inf"), float("-inf"), float("nan"), 2.0**52 + 0.5, 2.0**53, 4503599627370497.5]
    while len(out) < n:
        kind = rng.random()
        if kind < 0.3:
            out.append(rng.random() * 10 ** rng.randint(-3, 9))
        elif kind < 0.6:  # at and beside ties
            x = (rng.randint(-(10**6), 10**6) + 0.5) / 10 ** rng.randint(0, 8)
            out.append(rng.choice([x, math.nextafter(x, math.inf), math.nextafter(x, -math.inf)]))
        elif kind < 0.8:
            out.append(rng.randint(-(2**20), 2**20) / 2 ** rng.randint(0, 20))
        elif kind < 0.9:
            out.append(rng.uniform(2**50, 2**55) / 10 ** rng.randint(0, 9))
        else:
            x = struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))[0]
            out.append(x)
    return out


def _same(a, b):
    return a is b or a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b)))


def test_rounding_equals_pythons_on_a_million_doubles(spark):
    xs = _doubles(random.Random(6), 250_000)
    digits = (0, 1, 4, 6)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").repartition(8)
    assert df.select(round_exact(F.lit(None), 2).alias("x")).first().x is None
    rows = df.select("i", *(round_exact(F.col("x"), n).alias(f"d{n}") for n in digits)).toPandas().sort_values("i")
    for n in digits:
        want = [x if x is None or not math.isfinite(x) else round(x, n) for x in xs]
        bad = [(x, g, w) for x, g, w in zip(xs, rows[f"d{n}"].tolist(), want, strict=True) if not (_same(g, w) or (w is None and math.isnan(g)))]
        assert not bad, bad[:5]


def test_rounding_of_many_digits(spark):
    xs = [x for x in _doubles(random.Random(7), 5000) if x is not None and math.isfinite(x)]
    row = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    for n in (9, 15, 22):
        got = {r.i: r.y for r in row.select("i", round_exact(F.col("x"), n).alias("y")).collect()}
        bad = [(x, got[i], round(x, n)) for i, x in enumerate(xs) if got[i] != round(x, n)]
        assert not bad, (n, bad[:5])
    with pytest.raises(ValueError):
        round_exact(F.col("x"), 23)
