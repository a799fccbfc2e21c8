"""Query of the URL filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyfolio.llm.registry import query, table
from tallyfolio.llm.url_filter import LOWER, RULES, UPPER, judge_urls

FIXED_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(h, p, v) AS (VALUES {', '.join(str(r) for r in FIXED_RULES)}
), fits AS (
  SELECT page_id, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT parts.page_id, host, path, fits.rule, coalesce(fits.v, 'allow') AS verdict
FROM parts LEFT JOIN fits ON parts.page_id = fits.page_id AND k = 1
"""


@query("op5_url_filter", SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(FIXED_RULES, RULES))
