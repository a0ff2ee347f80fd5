"""Table jobs for wide, survey-like data on Spark.

Every job takes and returns DataFrames. The data passes are Spark plans; only
bounded results (one row per test, model, column or quantile bucket) reach Python.
"""

from censusloom.errors import SurveyError

__all__ = ["SurveyError"]
