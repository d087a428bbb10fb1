"""Reusable fragments of the checking SQL."""

from __future__ import annotations


def otsu_sql(source: str, keys: str, value: str, prefix: str = "") -> str:
    """CTEs ``{prefix}otsu(keys, n, threshold, ratio)`` over ``source``."""
    using = keys
    p = prefix
    return f"""
{p}rng AS (SELECT {keys}, min({value}) AS lo, max({value}) AS hi, count({value}) AS n FROM {source} WHERE {value} IS NOT NULL GROUP BY {keys}),
{p}hist AS (SELECT {keys}, lo, hi, n, CAST(CASE WHEN hi > lo THEN least(floor(({value} - lo) / (hi - lo) * 256.0), 255) ELSE 0 END AS BIGINT) AS bin, count(*) AS cnt
  FROM {source} JOIN {p}rng USING ({using}) WHERE {value} IS NOT NULL GROUP BY ALL),
{p}mom AS (SELECT {keys}, lo, hi, n, bin,
  CAST(sum(cnt) OVER (PARTITION BY {keys} ORDER BY bin ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS nb,
  CAST(sum(cnt * bin) OVER (PARTITION BY {keys} ORDER BY bin ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS sb,
  CAST(sum(cnt) OVER (PARTITION BY {keys}) AS DOUBLE) AS nt,
  CAST(sum(cnt * bin) OVER (PARTITION BY {keys}) AS DOUBLE) AS st,
  CAST(sum(cnt * bin * bin) OVER (PARTITION BY {keys}) AS DOUBLE) AS qt FROM {p}hist),
{p}crit AS (SELECT *, CASE WHEN nt > nb THEN (nt * sb - nb * st) * (nt * sb - nb * st) / (nb * (nt - nb)) ELSE 0 END AS between_var, nt * qt - st * st AS spread FROM {p}mom),
{p}otsu AS (SELECT {keys}, n, CASE WHEN hi > lo THEN lo + (bin + 0.5) * (hi - lo) / 256.0 ELSE lo END AS threshold,
  CASE WHEN spread > 0 THEN least(greatest(between_var / spread, 0.0), 1.0) ELSE 0.0 END AS ratio
  FROM {p}crit QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY between_var DESC, bin) = 1)"""


def gate_sql(source: str, keys: str, value: str, fixed: str, above: bool = True, prefix: str = "") -> str:
    """CTEs up to ``{prefix}gate(keys, n_pixels, n_valid, value, method, passed, ratio, positive_fraction, hits)``."""
    p = prefix
    op = ">=" if above else "<="
    over = f"({fixed}) - threshold" if above else f"threshold - ({fixed})"
    return otsu_sql(source, keys, value, prefix) + f""",
{p}cnt AS (SELECT {keys}, count(*) AS n_pixels, count({value}) AS n_valid,
  count(*) FILTER ({value} {op} threshold) AS oh, count(*) FILTER ({value} {op} ({fixed})) AS fh,
  any_value(threshold) AS threshold, any_value(ratio) AS ratio
  FROM {source} LEFT JOIN {p}otsu USING ({keys}) GROUP BY {keys}),
{p}dec AS (SELECT *, CASE WHEN n_valid > 0 THEN oh / n_valid END AS positive_fraction FROM {p}cnt),
{p}dec2 AS (SELECT *, coalesce(ratio >= 0.5 AND least(positive_fraction, 1 - positive_fraction) >= 0.05 AND {over} <= 0.1, false) AS passed FROM {p}dec),
{p}gate AS (SELECT {keys}, n_pixels, n_valid, CASE WHEN passed THEN threshold ELSE ({fixed}) END AS value,
  CASE WHEN passed THEN 'otsu' ELSE 'fixed_fallback' END AS method, passed, ratio, positive_fraction,
  CASE WHEN passed THEN oh ELSE fh END AS hits FROM {p}dec2)"""


def index_sql(name: str) -> str:
    positive, negative = {
        "NDVI": ("nir", "red"), "NDWI": ("green", "nir"), "MNDWI": ("green", "swir"), "NDBI": ("swir", "nir"),
    }[name]
    return f"CASE WHEN {positive} + {negative} <> 0 THEN ({positive} - {negative}) / ({positive} + {negative}) END"
