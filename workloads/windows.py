"""Ranks, positions, bins, folds and the holdout split."""

from __future__ import annotations

from pyspark.sql import functions as F

from censusloom.operators.layout import fit_layout
from censusloom.operators.ranks import average_ranks, in_training_part, row_positions, stratified_folds, target_bins
from workloads.registry import query
from workloads.tables import table

_RANKS = """SELECT DISTINCT event_type, value, count(*) OVER (PARTITION BY event_type, value) AS ties,
  rank() OVER (PARTITION BY event_type ORDER BY value)
    + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2::DOUBLE AS avg_rank FROM events"""


def _ranks(spark, sf_dir, rows_per_bucket):
    events = table(spark, sf_dir, "events")
    layout = fit_layout(events, "value", rows_per_bucket)
    counts = events.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("_count"))
    ranked = average_ranks(counts, ["event_type"], "value", layout)
    return ranked.select("event_type", "value", F.col("_count").alias("ties"), "avg_rank")


@query("average_ranks", _RANKS)
def average_ranks_query(spark, sf_dir):
    return _ranks(spark, sf_dir, 1_000_000)


@query("average_ranks_bucketed", _RANKS)
def average_ranks_bucketed(spark, sf_dir):
    """The plan used beyond what one task can order, forced by a small bucket size."""
    return _ranks(spark, sf_dir, 500)


@query(
    "row_positions_bucketed",
    """SELECT event_id, CAST(floor(value / 50) AS BIGINT) AS band,
    row_number() OVER (ORDER BY floor(value / 50), event_id) AS position FROM events""",
)
def row_positions_bucketed(spark, sf_dir):
    """A few heavily tied values, so that single values are split over key buckets."""
    events = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("value") / 50).alias("band"))
    return row_positions(events, "band", "event_id", rows_per_bucket=500)[0]


_BINNED = """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r,
    count(*) OVER () AS n FROM orders),
  b AS (SELECT o_orderkey, CAST(greatest(ceil((r - 1) * 10::DOUBLE / (n - 1)) - 1, 0) AS INTEGER) AS target_bin FROM r)"""


@query("target_bins", f"{_BINNED} SELECT o_orderkey, target_bin FROM b")
def target_bins_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return target_bins(orders, "o_totalprice", "o_orderkey")[0].drop("o_totalprice")


FOLDS_SQL = f"""{_BINNED} SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY target_bin
  ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM b"""


def _folds(spark, sf_dir, **settings):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return stratified_folds(orders, "o_totalprice", "o_orderkey", **settings).drop("o_totalprice")


@query("stratified_folds", FOLDS_SQL)
def stratified_folds_query(spark, sf_dir):
    return _folds(spark, sf_dir)


@query("stratified_folds_bucketed", FOLDS_SQL)
def stratified_folds_bucketed(spark, sf_dir):
    """The plan used beyond what one task can order, forced by a small bucket size."""
    return _folds(spark, sf_dir, rows_per_bucket=500)


@query(
    "holdout_split",
    """SELECT o_orderkey, ('0x' || substr(md5('42:' || o_orderkey), 1, 8))::BIGINT % 100 < 80 AS training
    FROM orders""",
)
def holdout_split(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", in_training_part(F.col("o_orderkey")).alias("training")
    )
