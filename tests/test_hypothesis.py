"""Randomised checks of the exact distributed quantile and the stratified cut."""
import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from epicohort.operators import quantiles
from epicohort.operators.quantiles import exact_quantiles


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=300),
       st.sampled_from([0.0, 0.0001, 0.1, 0.5, 0.9, 0.9999, 1.0]))
def test_exact_quantile_matches_numpy(spark, values, p):
    quantiles.CELLS, quantiles.LISTED = 4, 3
    df = spark.createDataFrame([(float(v) / 4,) for v in values], "x double")
    try:
        got = exact_quantiles(df, "x", [p], accuracy=50).collect()[0].q
    finally:
        quantiles.CELLS, quantiles.LISTED = 1_024, 4_096
    assert abs(got - np.quantile(np.array(values, dtype=float) / 4, p)) < 1e-9
