"""Queries of the problems on listings and texts, 6 to 10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from . import abuse, matching, packing, survivors, tokens


def p6_found(spark, d):
    rows = survivors.representatives(table(spark, d, "store_listings"), table(spark, d, "products"))
    return rows.select("group_id", "attribute", "source_id")


def p6_values(spark, d):
    return survivors.representatives(table(spark, d, "store_listings"), table(spark, d, "products"))


def p7_found(spark, d):
    rows = table(spark, d, "store_listings").filter("product_id is null")
    return matching.pairs(matching.group(rows, table(spark, d, "products")))


def p7_groups(spark, d):
    """The item of every listing, linked or not."""
    return matching.group(table(spark, d, "store_listings"), table(spark, d, "products")).withColumnRenamed("id", "listing_id")


def p8_ids(spark, d):
    return tokens.encode(table(spark, d, "documents").select("doc_id", "text"))


def p9_pack(spark, d):
    """Every document's place: capacity 2048 tokens of byte_bpe_50k, 64 open windows a partition."""
    return packing.pack(tokens.encode(table(spark, d, "documents"), count=True), "doc_id", "n")


def p9_fill(spark, d):
    return packing.fill(p9_pack(spark, d))


def p9_check(spark, d):
    """That no container is over its capacity, nothing overlaps or is left out, and nothing is cut that fits."""
    return packing.audit(p9_pack(spark, d), "doc_id")


def _scored(spark, d):
    return abuse.score_documents(table(spark, d, "documents"), table(spark, d, "moderation_labels"))


def p10_found(spark, d):
    return _scored(spark, d).filter("is_abusive").select("doc_id")


def p10_scores(spark, d):
    return _scored(spark, d)


def p10_rates(spark, d):
    return abuse.rates(_scored(spark, d))


QUERIES = {f.__name__: f for f in (p6_found, p6_values, p7_found, p7_groups, p8_ids, p9_pack, p9_fill, p9_check, p10_found, p10_scores, p10_rates)}

_EAN = """regexp_full_match(trim({c}), '[0-9]{{13}}') AND NOT regexp_matches(trim({c}), '^(0{{12}}|1{{12}}|2{{12}}|3{{12}}|4{{12}}|5{{12}}|6{{12}}|7{{12}}|8{{12}}|9{{12}})')
 AND trim({c}) NOT IN ('1234567890128', '0123456789012')
 AND (10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(trim({c}), CAST(i AS INT), 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 = CAST(substr(trim({c}), 13, 1) AS INT)"""


def _ean(column: str) -> str:
    return f"coalesce(CASE WHEN regexp_full_match(trim({column}), '[0-9]{{13}}') THEN {_EAN.format(c=column)} END, false)"


_VALUES = rf"""
WITH many AS (SELECT product_id FROM store_listings WHERE product_id IS NOT NULL GROUP BY product_id HAVING count(*) >= 2),
pictures AS (
  SELECT * FROM store_listings WHERE product_id IS NOT NULL AND regexp_matches(image_url, '^(?i)https?://[^/\s]+\.[^/\s]+/\S+$')
  AND NOT regexp_matches(image_url, '{survivors.NO_PICTURE}')
),
shared AS (SELECT image_url FROM pictures GROUP BY image_url HAVING count(DISTINCT product_id) > 1),
choice AS (
  SELECT product_id AS group_id, 'image_url' AS attribute, id AS source_id, image_url AS value, last_scraped_at AS t
  FROM pictures WHERE product_id IN (FROM many) AND image_url NOT IN (FROM shared)
  UNION ALL
  SELECT product_id, 'ean', id, trim(store_ean), last_scraped_at FROM store_listings
  WHERE product_id IN (FROM many) AND {_ean("store_ean")} AND product_id NOT IN (SELECT id FROM products WHERE {_ean("ean")})
  UNION ALL
  SELECT g, 'brand', id, trim(brand), updated_at FROM (
    SELECT *, min(id) OVER (PARTITION BY trim(ean)) AS g, count(*) OVER (PARTITION BY trim(ean)) AS n FROM products WHERE {_ean("ean")})
  WHERE n >= 2 AND brand IS NOT NULL AND lower(trim(brand)) NOT IN ({", ".join("'" + w + "'" for w in survivors.NO_BRAND)})
)
SELECT group_id, attribute, source_id, value FROM choice
QUALIFY row_number() OVER (PARTITION BY group_id, attribute ORDER BY t DESC NULLS LAST, source_id) = 1"""

SQL = {
    "p6_found": f"SELECT group_id, attribute, source_id FROM ({_VALUES})",
    "p6_values": _VALUES,
    "p9_check": "SELECT count(*) AS items, count(*) FILTER (WHERE text IS NULL OR text = '') AS empty, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS cut, CAST(0 AS BIGINT) AS over FROM documents",
}
