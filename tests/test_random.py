from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions.random import gamma, uniform


@pytest.mark.parametrize("shape", [0.1, 0.5, 1.0, 3.0])
def test_gamma_numbers_have_mean_and_variance_of_their_shape(spark, shape):
    drawn = np.array([r.g for r in spark.range(4000).select(gamma(shape, F.lit("s"), F.col("id")).alias("g")).collect()])
    assert (drawn >= 0).all()
    assert abs(drawn.mean() - shape) < 5 * np.sqrt(shape / 4000) and abs(drawn.var() - shape) < 0.35 * shape
    again = np.array([r.g for r in spark.range(4000).repartition(3).select("id", gamma(shape, F.lit("s"), F.col("id")).alias("g")).orderBy("id").collect()])
    assert (again == drawn).all()


def test_uniform_numbers(spark):
    u = np.array([r.u for r in spark.range(2000).select(uniform(F.lit("x"), F.col("id")).alias("u")).collect()])
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.04 and len(set(u)) > 1990
