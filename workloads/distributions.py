"""Grouped distributions, multi-select effects and chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from censusloom.functions.scalars import rounded
from censusloom.operators import charts as C
from censusloom.operators import distributions as D
from censusloom.operators import sketches as K
from workloads.registry import query
from workloads.tables import (
    PRIORITY_LABELS, SCORED_ORDERS, TAG_TOKENS, USER_DAYS, scored_orders, table, tagged_events, user_days,
)

_ORDER_FEATURES = ["o_orderpriority", "o_orderstatus"]
_ORDER_LONG = " UNION ALL ".join(
    f"SELECT '{name}' AS feature, {name} AS category, o_totalprice AS x FROM orders" for name in _ORDER_FEATURES
)
_CATEGORIES = f"""SELECT feature, category, count(*) AS respondents, round(quantile_cont(x, 0.5), 4) AS median,
  round(avg(x), 4) AS mean, round(quantile_cont(x, 0.25), 4) AS q25, round(quantile_cont(x, 0.75), 4) AS q75
  FROM ({_ORDER_LONG}) WHERE x > 0 GROUP BY feature, category HAVING count(*) >= 20"""


def _valid_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_totalprice") > 0)


@query("category_distribution", _CATEGORIES)
def category_distribution(spark, sf_dir):
    return rounded(D.category_distribution(_valid_orders(spark, sf_dir), _ORDER_FEATURES, "o_totalprice"), 4)


@query("category_distribution_bucketed", _CATEGORIES)
def category_distribution_bucketed(spark, sf_dir):
    """The plan used beyond what one task can order, forced by a small bucket size."""
    orders = _valid_orders(spark, sf_dir)
    return rounded(
        D.category_distribution(orders, _ORDER_FEATURES, "o_totalprice", rows_per_bucket=1_000), 4
    )


@query(
    "top_categories",
    """SELECT feature, category, respondents, median FROM (SELECT *, row_number() OVER
      (PARTITION BY feature ORDER BY median DESC, category) AS place FROM (
      SELECT 'p_brand' AS feature, p_brand AS category, count(*) AS respondents,
        round(quantile_cont(p_retailprice, 0.5), 4) AS median FROM part GROUP BY p_brand HAVING count(*) >= 20
      UNION ALL SELECT 'p_name', p_name, count(*), round(quantile_cont(p_retailprice, 0.5), 4)
        FROM part GROUP BY p_name HAVING count(*) >= 20)) WHERE place <= 10""",
)
def top_categories(spark, sf_dir):
    grouped = D.category_distribution(table(spark, sf_dir, "part"), ["p_brand", "p_name"], "p_retailprice")
    return rounded(D.top_categories(grouped, 10), 4).select("feature", "category", "respondents", "median")


@query(
    "ordinal_trend",
    f"""SELECT 'Priority' AS feature, CAST(priority_order AS INTEGER) AS "order", o_orderpriority AS category,
    count(*) AS respondents, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
    round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(quantile_cont(o_totalprice, 0.75), 4) AS q75
    FROM {SCORED_ORDERS} WHERE priority_order IS NOT NULL GROUP BY ALL HAVING count(*) >= 20""",
)
def ordinal_trend(spark, sf_dir):
    levels = {"priority_order": ("Priority", PRIORITY_LABELS)}
    return rounded(D.ordinal_trend(scored_orders(spark, sf_dir), levels, "o_totalprice"), 4)


@query(
    "token_frequency",
    f"""SELECT 'tags' AS "column", token, count(*) AS rows FROM {TAG_TOKENS} GROUP BY token""",
)
def token_frequency(spark, sf_dir):
    return D.token_frequency(tagged_events(spark, sf_dir), ["tags"])


@query(
    "distinct_options",
    f"SELECT DISTINCT unnest(string_split(types, ';')) AS option FROM {USER_DAYS}",
)
def distinct_options(spark, sf_dir):
    return D.distinct_options(user_days(spark, sf_dir), "types")


MULTISELECT = f"""WITH s AS (SELECT types, total, log_total FROM {USER_DAYS} WHERE total > 0),
  o AS (SELECT DISTINCT unnest(string_split(types, ';')) AS option FROM s),
  x AS (SELECT option, list_contains(string_split(types, ';'), option) AS has, total, log_total FROM s, o)
  SELECT option, count(*) FILTER (has) AS selected_rows, count(*) FILTER (NOT has) AS unselected_rows,
    round(quantile_cont(total, 0.5) FILTER (has), 4) AS selected_median,
    round(quantile_cont(total, 0.5) FILTER (NOT has), 4) AS unselected_median,
    round(corr(has::INT, log_total), 8) AS point_biserial_r,
    round(abs(corr(has::INT, log_total)), 8) AS absolute_r
  FROM x GROUP BY option HAVING count(*) FILTER (has) >= 20 AND count(*) FILTER (NOT has) >= 20"""


def _effects(spark, sf_dir, **settings):
    rows = user_days(spark, sf_dir).where("total > 0")
    effects = D.multiselect_effects(rows, "types", "total", "log_total", **settings)
    return effects.select(
        "option", "selected_rows", "unselected_rows",
        *[F.round(name, 4).alias(name) for name in ("selected_median", "unselected_median")],
        *[F.round(name, 8).alias(name) for name in ("point_biserial_r", "absolute_r")],
    )


@query("multiselect_effects", MULTISELECT)
def multiselect_effects(spark, sf_dir):
    return _effects(spark, sf_dir)


@query("multiselect_effects_bucketed", MULTISELECT)
def multiselect_effects_bucketed(spark, sf_dir):
    """The plan used beyond what one task can order, forced by a small bucket size."""
    return _effects(spark, sf_dir, rows_per_bucket=200)


@query(
    "histogram",
    """WITH v AS (SELECT 'value' AS "column", value AS x FROM events
        UNION ALL SELECT 'log_value', ln(1 + value) FROM events),
      r AS (SELECT "column", min(x) AS lo, (max(x) - min(x)) / 50 AS w FROM v GROUP BY "column"),
      b AS (SELECT "column", x, lo, w, least(floor((x - lo) / w), 49) AS rough FROM v JOIN r USING ("column")),
      c AS (SELECT "column", CAST(CASE WHEN x < lo + rough * w THEN rough - 1
        WHEN rough < 49 AND x >= lo + (rough + 1) * w THEN rough + 1 ELSE rough END AS INTEGER) AS bin,
        count(*) AS n FROM b GROUP BY ALL),
      g AS (SELECT "column", lo, w, CAST(i AS INTEGER) AS bin FROM r, range(50) t(i))
    SELECT g."column", g.bin, round(lo + g.bin * w, 6) AS low, round(lo + (g.bin + 1) * w, 6) AS high,
      coalesce(n, 0) AS count FROM g LEFT JOIN c ON g."column" = c."column" AND g.bin = c.bin""",
)
def histogram(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("log_value", F.log1p("value"))
    return rounded(C.histogram(events, ["value", "log_value"], 50), 6)


@query(
    "density_curve",
    """WITH f AS (SELECT count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS lo,
        (max(value) - min(value)) / 199 AS step FROM events),
      g AS (SELECT CAST(i AS INTEGER) AS point, lo + i * step AS x FROM f, range(200) t(i))
    SELECT point, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - value) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())), 9)
      AS density FROM g, f, events GROUP BY point, x""",
)
def density_curve(spark, sf_dir):
    curve = C.density_curve(table(spark, sf_dir, "events"), "value")
    return curve.select("point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query(
    "density_curve_binned",
    """WITH f AS (SELECT count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS lo,
        (max(value) - min(value)) / 199 AS step FROM events),
      g AS (SELECT CAST(i AS INTEGER) AS point, lo + i * step AS x FROM f, range(200) t(i))
    SELECT point, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - value) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())), 6)
      AS density FROM g, f, events GROUP BY point, x""",
)
def density_curve_binned(spark, sf_dir):
    """The same curve from fine bins: its cost does not follow the number of values."""
    curve = C.density_curve(table(spark, sf_dir, "events"), "value", binned=True)
    return curve.select("point", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


_T = "(z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3))"


@query(
    "regression_band",
    f"""WITH l AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a,
        avg(l_quantity) AS m, regr_sxx(l_extendedprice, l_quantity) AS sxx, min(l_quantity) AS lo, max(l_quantity) AS hi,
        sqrt((regr_syy(l_extendedprice, l_quantity) - pow(regr_sxy(l_extendedprice, l_quantity), 2)
          / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)) AS s, (count(*) - 2)::DOUBLE AS v, 1.959963984540054 AS z
        FROM lineitem),
      g AS (SELECT *, CAST(i AS INTEGER) AS point, lo + i * (hi - lo) / 49 AS x FROM l, range(50) t(i)),
      r AS (SELECT *, a + b * x AS fitted, {_T} * s * sqrt(1 / n::DOUBLE + pow(x - m, 2) / sxx) AS reach FROM g)
    SELECT point, round(x, 6) AS x, round(fitted, 4) AS fitted, round(fitted - reach, 4) AS t_low, round(fitted + reach, 4) AS t_high,
      true AS bootstrap_agrees FROM r""",
)
def regression_band(spark, sf_dir):
    """The analytic band; the bootstrap band has the same width up to its own error."""
    lines = table(spark, sf_dir, "lineitem").withColumn("line", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey"))
    band = C.regression_band(lines, "l_quantity", "l_extendedprice", "line", points=50, replicates=1000)
    wide = F.col("high") - F.col("low")
    agrees = (F.abs(wide / (F.col("t_high") - F.col("t_low")) - 1) < 0.25) & F.col("fitted").between(F.col("low"), F.col("high"))
    return band.select(
        "point", F.round("x", 6).alias("x"), *[F.round(c, 4).alias(c) for c in ("fitted", "t_low", "t_high")], agrees.alias("bootstrap_agrees")
    )


@query(
    "quantile_sketches",
    f"""SELECT feature, category, count(*) AS rows, round(avg(x), 4) AS mean, min(x) AS low, max(x) AS high,
      true AS q25_within_1_pct, true AS median_within_1_pct, true AS q75_within_1_pct FROM ({_ORDER_LONG}) WHERE x > 0 GROUP BY feature, category""",
)
def quantile_sketches(spark, sf_dir):
    """Sketches of four increments, merged; their quartiles have ranks within 1 % of the exact ones."""
    orders = _valid_orders(spark, sf_dir)
    long = D.long_categories(orders, _ORDER_FEATURES, ["o_orderkey", "o_totalprice"])
    keys = ["feature", "category"]
    parts = [K.quantile_sketches(long.where(F.col("o_orderkey") % 4 == i), keys, "o_totalprice") for i in range(4)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    found = K.sketched_quantiles(K.merge_sketches(every, keys), D.QUARTILES)
    met = long.select(*keys, "o_totalprice").join(found, keys)
    ranks = [
        (F.abs(F.avg((F.col("o_totalprice") <= F.col(name)).cast("double")) - share) < 0.01).alias(f"{name}_within_1_pct")
        for name, share in D.QUARTILES.items()
    ]
    return met.groupBy(*keys, "rows", F.round("mean", 4).alias("mean"), "low", "high").agg(*ranks)


@query(
    "regression_line",
    """SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
    round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(avg(l_quantity), 6) AS mean_x,
    round(regr_sxx(l_extendedprice, l_quantity), 2) AS sxx,
    round(sqrt((regr_syy(l_extendedprice, l_quantity) - pow(regr_sxy(l_extendedprice, l_quantity), 2)
      / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 4) AS residual_sd,
    min(l_quantity) AS min_x, max(l_quantity) AS max_x FROM lineitem""",
)
def regression_line(spark, sf_dir):
    line = C.regression_line(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    places = {"slope": 6, "intercept": 4, "mean_x": 6, "sxx": 2, "residual_sd": 4}
    return line.select(*[F.round(n, places[n]).alias(n) if n in places else n for n in line.columns])


@query(
    "fixed_sample",
    "SELECT event_id, value FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 1000",
)
def fixed_sample(spark, sf_dir):
    """The sampling operator; its row count is its parameter."""
    return C.fixed_sample(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 1000)
