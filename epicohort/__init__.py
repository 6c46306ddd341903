"""epicohort: observational cohort, panel and event-study analytics on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a small
result object holding DataFrames) built from Spark SQL expressions, so
Catalyst plans it and the rows stay on the executors.  Only k x k model
matrices and bounded result tables ever reach the driver.
"""

from epicohort.config import StudyConfig, FIXTURE_CONFIG

__all__ = ["StudyConfig", "FIXTURE_CONFIG"]
