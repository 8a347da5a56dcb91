"""Queries of whole flows: ingest, propagation, feeds, categories, linkage in stages, copies, seeds, shards, the daily run."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import flows as W
from ..operators import linkage as L
from ..session import shared_folder, table
from ..sources import sinks as K
from .registry import Registry
from .texts import field_sql

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: When the batch of items comes in: half a day after it some listings are still fresh.
NOW = datetime(2024, 12, 30, 6, 0, tzinfo=timezone.utc)
_STAMP = "TIMESTAMPTZ '2024-12-30 06:00:00+00'"


def _items(s, d):
    """An item for each listing that would pass validation: the last observed price, other picture, label and path."""
    stores = table(s, d, "stores").select(F.col("id").alias("store_id"), F.col("chain").alias("store_chain"), F.col("name").alias("store_name"))
    seen = table(s, d, "price_history").filter("scraped_at is not null and price is not null").groupBy(F.col("listing_id").alias("id")).agg(F.max_by("price", F.struct("scraped_at", "id")).alias("seen"))
    rows = table(s, d, "store_listings").join(seen, "id", "left").join(stores, "store_id")
    price = F.coalesce("seen", "current_price")
    return rows.filter((price > 0) & (price <= 100000) & (F.trim("store_product_name") != "") & (F.trim("store_chain") != "")).select(
        F.col("id").alias("item_id"), "store_chain", "store_name", "store_sku", "store_product_url", "store_product_name", price.alias("current_price"), "unit_price",
        F.upper("unit_label").alias("unit_label"), F.coalesce("in_stock", F.lit(True)).alias("in_stock"), "store_ean", "store_manufacturer_ref",
        F.concat("image_url", F.lit("?v=2")).alias("image_url"), F.replace("category_path", F.lit(" > "), F.lit(">")).alias("category_path"),
    )


_INGEST = f"""WITH seen AS (SELECT listing_id, arg_max(price, (scraped_at, id)) AS price FROM price_history WHERE scraped_at IS NOT NULL AND price IS NOT NULL GROUP BY 1),
items AS (
  SELECT l.id AS item_id, s.chain, s.name, l.store_sku AS sku, l.store_product_url AS url, l.store_product_name AS pname, coalesce(seen.price, l.current_price) AS price, l.unit_price, upper(l.unit_label) AS unit_label,
  coalesce(l.in_stock, true) AS in_stock, l.store_ean, l.store_manufacturer_ref, l.image_url || '?v=2' AS image_url, replace(l.category_path, ' > ', '>') AS category_path
  FROM store_listings l JOIN stores s ON s.id = l.store_id LEFT JOIN seen ON seen.listing_id = l.id
  WHERE coalesce(seen.price, l.current_price) > 0 AND coalesce(seen.price, l.current_price) <= 100000 AND trim(l.store_product_name) <> '' AND trim(s.chain) <> ''),
placed AS (
  SELECT *, coalesce((SELECT min(x.id) FROM stores x WHERE x.chain = items.chain AND x.name = items.name), (SELECT min(x.id) FROM stores x WHERE x.chain = items.chain)) AS store,
  coalesce(nullif(sku, ''), nullif(right(coalesce(url, ''), 50), ''), 'unknown') AS key FROM items),
firsts AS (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY store, key ORDER BY item_id) = 1),
met AS (
  SELECT l.*, f.*, l.id IS NULL AS is_new, f.item_id IS NOT NULL AND (l.id IS NULL OR l.last_scraped_at IS NULL OR {_STAMP} - INTERVAL 12 HOUR >= l.last_scraped_at) AS taken
  FROM store_listings l FULL JOIN firsts f ON f.store = l.store_id AND f.key = l.store_sku)
"""


@query(_INGEST + f"""SELECT coalesce(store_id, store) AS store_id, coalesce(store_sku, key) AS store_sku, id, old_price, CASE WHEN is_new THEN url ELSE store_product_url END AS store_product_url,
CASE WHEN taken THEN pname ELSE store_product_name END AS store_product_name, CASE WHEN taken THEN price ELSE current_price END AS current_price, CASE WHEN taken THEN unit_price_1 ELSE unit_price END AS unit_price,
CASE WHEN taken THEN unit_label_1 ELSE unit_label END AS unit_label, CASE WHEN taken THEN in_stock_1 ELSE in_stock END AS in_stock, CASE WHEN taken THEN store_ean_1 ELSE store_ean END AS store_ean,
CASE WHEN taken THEN store_manufacturer_ref_1 ELSE store_manufacturer_ref END AS store_manufacturer_ref, CASE WHEN taken THEN image_url_1 ELSE image_url END AS image_url,
CASE WHEN taken THEN category_path_1 ELSE category_path END AS category_path, CASE WHEN taken THEN {_STAMP} ELSE last_scraped_at END AS last_scraped_at,
CASE WHEN is_new THEN 'inserted' WHEN taken THEN 'updated' ELSE 'kept' END AS action FROM (SELECT * FROM met)""")
def upsert_listings(s, d):
    """The next snapshot after a batch: nine fields overwritten, old price and URL kept, fresh listings left alone, new ones added."""
    return W.ingest(table(s, d, "store_listings"), table(s, d, "stores"), _items(s, d), NOW).drop("product_id", "changed")


@query(_INGEST + "SELECT coalesce(store_id, store) AS store_id, coalesce(store_sku, key) AS store_sku, price FROM met WHERE taken AND (is_new OR nullif(current_price, 0) IS DISTINCT FROM price)")
def upsert_history(s, d):
    """The rows that the batch adds to the price history: first prices, and prices that moved."""
    rows = W.ingest(table(s, d, "store_listings"), table(s, d, "stores"), _items(s, d), NOW)
    return rows.filter("changed").select("store_id", "store_sku", F.col("current_price").alias("price"))


_FILL = ", ".join(f"coalesce(nullif(p.{c}, ''), f.{c}, p.{c}) AS {c}" for c in W.FILLED)


@query(f"""WITH items AS (SELECT l.product_id, l.id, l.store_product_name AS name, p.manufacturer, 'Offre ' || l.store_product_name AS description FROM store_listings l JOIN products p ON p.id = l.product_id),
f AS (SELECT product_id, arg_min(manufacturer, id) FILTER (WHERE manufacturer <> '') AS manufacturer, arg_min(description, id) FILTER (WHERE description <> '') AS description,
{", ".join(f"arg_min({c}, id) FILTER (WHERE {c} <> '') AS {c}" for c in W.FILLED)} FROM (SELECT product_id, id, manufacturer, description, {", ".join(f"substr({field_sql(c)}, 1, {n}) AS {c}" for c, n in W.FILLED.items())} FROM items) GROUP BY 1)
SELECT p.id, coalesce(nullif(p.brand, ''), f.manufacturer, p.brand) AS brand, coalesce(nullif(p.description, ''), f.description, p.description) AS description, {_FILL} FROM products p LEFT JOIN f ON f.product_id = p.id""")
def propagate_product(s, d):
    """Brand, description and the columns read from names, filled in products where they are empty."""
    makers = table(s, d, "products").select(F.col("id").alias("product_id"), "manufacturer")
    items = table(s, d, "store_listings").join(makers, "product_id").select(
        "product_id", F.col("id").alias("item_id"), F.col("store_product_name").alias("product_name"), "manufacturer", F.concat(F.lit("Offre "), "store_product_name").alias("description")
    )
    return W.propagate(table(s, d, "products"), items)


# --- categories ---

#: Categories in which rules meet a slug: every third rule has none, so that the rules after it are asked.
_SLUGS = sorted({slug for i, (_, slug) in enumerate(L.CATEGORY_RULES) if i % 3 != 1})
_SLUG_ROWS = ", ".join(f"({10_000_000 + i}, '{slug}')" for i, slug in enumerate(_SLUGS))


def _categories(s, d):
    more = s.createDataFrame([(10_000_000 + i, slug) for i, slug in enumerate(_SLUGS)], "id long, slug string")
    return table(s, d, "categories").select("id", "slug").unionByName(more)


def _rule_sql(pattern: str, text: str) -> str:
    if "(?!" in pattern:  # RE2 does not look ahead: what the rule excludes is taken out of the text first
        start = pattern.index("scie\\s+(?!")
        end = pattern.index(")", start)
        excluded = pattern[start + len("scie\\s+(?!") : end]
        rest = pattern[:start] + pattern[end + 2 :]
        return f"(regexp_matches({text}, '{rest}') OR regexp_matches(regexp_replace({text}, 'scie\\s(?:{excluded})', '#', 'g'), 'scie\\s'))"
    return f"regexp_matches({text}, '{pattern}')"


@query(f"""WITH c AS (SELECT slug, max(id) AS id FROM (SELECT id, slug FROM categories UNION ALL SELECT * FROM (VALUES {_SLUG_ROWS})) GROUP BY slug),
f AS (SELECT product_id, first(category_path ORDER BY id) AS path FROM store_listings WHERE product_id IS NOT NULL GROUP BY 1),
t AS (SELECT p.id, lower(coalesce(p.name, '') || coalesce(' ' || nullif(f.path, ''), '')) AS t FROM products p LEFT JOIN f ON f.product_id = p.id WHERE p.category_id IS NULL),
hits AS ({" UNION ALL ".join(f"SELECT t.id, {i} AS n, '{slug}' AS slug FROM t WHERE {_rule_sql(p, 't')}" for i, (p, slug) in enumerate(L.CATEGORY_RULES))})
SELECT t.id, x.category_id FROM t LEFT JOIN (SELECT hits.id, arg_min(c.id, n) AS category_id FROM hits JOIN c ON c.slug = hits.slug GROUP BY 1) x ON x.id = t.id""")
def categorize(s, d):
    """A category for each product without one: the first rule that fits and whose slug there is."""
    return L.categorize(table(s, d, "products"), table(s, d, "store_listings"), _categories(s, d))


@query("SELECT DISTINCT category_path FROM store_listings WHERE category_path IS NOT NULL ORDER BY category_path")
def sorted_categories(s, d):
    return table(s, d, "store_listings").filter("category_path is not null").select("category_path").distinct().orderBy("category_path")


# --- linkage in stages ---

_NUMBER = lambda x: f"replace({x}, ',', '.')"
_KEY = {
    "color": lambda n: field_sql("color", n), "finish": lambda n: field_sql("finish", n),
    "volume": lambda n: _NUMBER(f"regexp_replace(lower({field_sql('volume', n)}), '\\s+', '', 'g')"), "weight": lambda n: _NUMBER(f"regexp_replace(lower({field_sql('weight', n)}), '\\s+', '', 'g')"),
    "dimensions": lambda n: f"regexp_replace(lower({field_sql('dimensions', n)}), '\\s+', '', 'g')", "power": lambda n: f"regexp_replace(lower({field_sql('power', n)}), '\\s+', '', 'g')",
    "pack": lambda n: f"nullif(regexp_extract({field_sql('pack_size', n)}, '[0-9]+', 0), '')",
}
_BAD = f"""many AS (SELECT product_id FROM store_listings WHERE product_id IS NOT NULL GROUP BY 1 HAVING count(*) > 3),
lk AS (SELECT id, product_id, {", ".join(f"{f('store_product_name')} AS {k}" for k, f in _KEY.items())} FROM store_listings WHERE product_id IN (FROM many)),
pk AS (SELECT id, {", ".join(f"{f('name')} AS {k}" for k, f in _KEY.items())} FROM products WHERE id IN (FROM many)),
bad AS (SELECT lk.id AS listing_id, lk.product_id FROM lk JOIN pk ON pk.id = lk.product_id WHERE {" OR ".join(f"lk.{k} <> pk.{k}" for k in _KEY)})"""


@query(f"WITH {_BAD} SELECT listing_id, product_id FROM bad")
def unmatch_bad(s, d):
    """Listings of products with more than three whose fields contradict the product's name."""
    return L.incompatible(table(s, d, "store_listings"), table(s, d, "products"))


_STAGES = """ean AS (SELECT ean, min(id) AS id FROM products WHERE trim(ean) <> '' GROUP BY 1),
o AS (SELECT * FROM open WHERE trim(store_ean) <> ''),
m AS (SELECT store_ean, min(id) AS first, first(store_manufacturer_ref ORDER BY id) AS ref FROM o WHERE store_ean NOT IN (SELECT ean FROM ean) GROUP BY 1),
made AS (SELECT store_ean, ref, (SELECT max(id) FROM products) + row_number() OVER (ORDER BY first) AS id FROM m),
by_ean AS (SELECT o.id AS listing_id, coalesce(ean.id, made.id) AS product_id, CASE WHEN made.id IS NULL THEN 'ean' ELSE 'ean_new' END AS rule FROM o LEFT JOIN ean ON ean.ean = o.store_ean LEFT JOIN made ON made.store_ean = o.store_ean),
ref AS (SELECT r, min(id) AS id FROM (SELECT manufacturer_ref AS r, id FROM products UNION ALL SELECT ref, id FROM made) WHERE trim(r) <> '' GROUP BY 1),
by_ref AS (SELECT o.id AS listing_id, ref.id AS product_id, 'ref' AS rule FROM open o JOIN ref ON ref.r = o.store_manufacturer_ref WHERE o.id NOT IN (SELECT listing_id FROM by_ean))"""


@query(f"WITH open AS (SELECT * FROM store_listings WHERE product_id IS NULL), {_STAGES} SELECT * FROM by_ean UNION ALL SELECT * FROM by_ref")
def match_stages(s, d):
    """The unlinked listings that EAN and then reference link, with the products that new EANs make."""
    return W.link_all(table(s, d, "store_listings"), table(s, d, "products")).filter("rule in ('ean', 'ean_new', 'ref')")


@query(f"""WITH {_BAD}, open AS (SELECT l.* FROM store_listings l WHERE product_id IS NULL OR id IN (SELECT listing_id FROM bad)), {_STAGES}
SELECT bad.listing_id, bad.product_id AS was, x.product_id, coalesce(x.rule, 'by name') AS rule FROM bad LEFT JOIN (SELECT * FROM by_ean UNION ALL SELECT * FROM by_ref) x ON x.listing_id = bad.listing_id""")
def fix_matches(s, d):
    """The listings detached by unmatch_bad, linked anew; what goes by name is only marked so here (see fix_by_name)."""
    rows = W.relink(table(s, d, "store_listings"), table(s, d, "products"))
    named = F.col("rule").isin("name", "name_new", "none")
    return rows.select("listing_id", "was", F.when(~named, F.col("product_id")).alias("product_id"), F.when(named, "by name").otherwise(F.col("rule")).alias("rule"))


@query(None)
def fix_by_name(s, d):
    """The detached listings that neither EAN nor reference links, with the product their name finds or makes."""
    return W.relink(table(s, d, "store_listings"), table(s, d, "products")).filter("rule in ('name', 'name_new')")


# --- feeds, copies, seeds, shards ---

_CHAIN = "(SELECT min(chain) FROM stores)"
_OFFERS = """SELECT l.id AS row, l.store_product_name AS name, l.store_sku AS sku, l.store_ean AS ean, CASE WHEN l.current_price > 0 THEN l.current_price + CASE WHEN l.id % 3 = 0 THEN 1 ELSE 0 END END AS price FROM store_listings l"""


def _feed_rows(s, d):
    # one more than the largest price of the column has a digit more than the column: the sum keeps its own type
    price = F.when(F.col("current_price") > 0, F.col("current_price") + F.when(F.col("id") % 3 == 0, 1).otherwise(0))
    return table(s, d, "store_listings").select(F.col("id").alias("row"), F.col("store_product_name").alias("name"), F.col("store_sku").alias("sku"), F.col("store_ean").alias("ean"), price.alias("price"))


def _feed_sql(store: str) -> str:
    return f"""WITH feed AS (SELECT row, substr(name, 1, 255) AS name, nullif(substr(sku, 1, 50), '') AS sku, nullif(substr(ean, 1, 13), '') AS ean, CAST(price AS DECIMAL(10,2)) AS price FROM ({_OFFERS}) WHERE name IS NOT NULL AND price IS NOT NULL),
k AS (SELECT sku, arg_min(name, row) AS name, first(ean ORDER BY row) AS ean, arg_max(price, row) AS price FROM feed WHERE sku IS NOT NULL GROUP BY 1),
own AS (SELECT * FROM store_listings WHERE store_id = {store})
SELECT o.id, coalesce(o.store_sku, k.sku) AS sku, CASE WHEN o.id IS NULL THEN k.name ELSE o.store_product_name END AS name, CASE WHEN o.id IS NULL THEN k.ean ELSE o.store_ean END AS ean, coalesce(k.price, o.current_price) AS price,
CASE WHEN o.id IS NULL THEN 'inserted' WHEN k.price IS DISTINCT FROM o.current_price AND k.price IS NOT NULL THEN 'updated' ELSE 'kept' END AS action, CAST({store} AS BIGINT) AS store_id FROM own o FULL JOIN k ON k.sku = o.store_sku
UNION ALL SELECT NULL, NULL, name, ean, price, 'inserted', CAST({store} AS BIGINT) FROM feed WHERE sku IS NULL"""


@query(_feed_sql(f"(SELECT min(id) FROM stores WHERE chain = {_CHAIN})"))
def feed_import(s, d):
    """A feed of all offers laid over the listings of a chain's first store by sku."""
    chain = table(s, d, "stores").agg(F.min("chain")).head()[0]
    return W.import_feed(table(s, d, "store_listings"), table(s, d, "stores"), _feed_rows(s, d), chain)


@query(_feed_sql("(SELECT max(id) + 1 FROM stores)"))
def feed_import_new_chain(s, d):
    """The same feed for a chain without a store: one is made, and every offer is new to it."""
    return W.import_feed(table(s, d, "store_listings"), table(s, d, "stores"), _feed_rows(s, d), "chaîne sans magasin")


def _copied(s, d):
    """A source of the listings as another database keeps them, stock as figures; every 50th figure is no number."""
    stock = F.when(F.col("id") % 50 == 0, "oui").otherwise(F.col("in_stock").cast("int").cast("string"))
    source = table(s, d, "store_listings").select(F.col("id").cast("string").alias("id"), "store_product_name", stock.alias("in_stock"))
    target = table(s, d, "store_listings").filter("product_id is not null").select("id", "store_product_name", F.col("in_stock").cast("int").alias("in_stock"))
    return target, source, {"id": "bigint", "in_stock": "int"}


@query("""WITH t AS (SELECT id, store_product_name, CAST(in_stock AS INT) AS in_stock FROM store_listings WHERE product_id IS NOT NULL)
SELECT * FROM t UNION ALL SELECT id, store_product_name, CAST(in_stock AS INT) FROM store_listings WHERE id % 50 <> 0 AND id NOT IN (SELECT id FROM t)""")
def copy_insert_ignore(s, d):
    """Listings copied, cast, into a table that has the linked ones already."""
    target, source, casts = _copied(s, d)
    return W.copy_rows(target, source, "id", casts)[0]


@query("""WITH n AS (SELECT count(*) AS read, count(product_id) AS before, count(*) FILTER (WHERE id % 50 = 0) AS quarantined, count(*) FILTER (WHERE id % 50 <> 0 AND product_id IS NULL) AS added FROM store_listings)
SELECT before, read, quarantined, before + added AS after, added, read - quarantined - added AS ignored FROM n""")
def copy_report(s, d):
    """The counts of that copy, which must add up."""
    target, source, casts = _copied(s, d)
    return W.copy_report(target, source, "id", casts)


_SEED = {"Peinture": ["Lasures", "Enduits"], "Outillage": ["Perceuses"]}


@query("""SELECT 'empty' AS target, * FROM (VALUES (CAST(1 AS BIGINT), 'Peinture', CAST(NULL AS BIGINT)), (2, 'Outillage', NULL), (3, 'Lasures', 1), (4, 'Enduits', 1), (5, 'Perceuses', 2)) t(id, name, parent_id)
UNION ALL SELECT 'seeded', id, name, parent_id FROM categories""")
def seed_tree(s, d):
    """A two-level seed flattened to rows, put into an empty table and into one that has rows, which stays as it is."""
    have = table(s, d, "categories").select("id", "name", "parent_id")
    seed = C.seed_rows(s, _SEED)
    put = lambda target, name: C.seed_if_empty(target, seed).select(F.lit(name).alias("target"), F.col("id").cast("long").alias("id"), "name", F.col("parent_id").cast("long").alias("parent_id"))
    return put(s.createDataFrame([], have.schema), "empty").unionByName(put(have, "seeded"))


@query("""WITH n AS (SELECT count(*) AS n, greatest(1, count(*) // 7) AS size FROM products)
SELECT id, k AS at, CAST(least(k // size, 6) AS BIGINT) AS shard FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM products), n""")
def shard_chunk(s, d):
    """Seven contiguous shards by id, the last with the rest."""
    return W.shard(table(s, d, "products").select("id"), "id", 7)


@query("SELECT id, name, brand FROM products")
def sink_snapshot(s, d):
    """Products written as two versions of a snapshot; the last whole one is read."""
    at = f"{shared_folder(s)}/sink-{uuid.uuid4().hex}"
    rows = table(s, d, "products").select("id", "name", "brand")
    K.write_snapshot(rows.filter("brand is not null"), at)
    K.write_snapshot(rows, at)
    return K.read_snapshot(s, at)


@query("SELECT id, store_id, CAST(current_price AS VARCHAR) AS current_price, store_product_name FROM store_listings")
def sink_backup(s, d):
    """Listings written as a backup of JSON lines and read again."""
    at = f"{shared_folder(s)}/backup-{uuid.uuid4().hex}"
    K.write_backup(table(s, d, "store_listings").select("id", "store_id", F.col("current_price").cast("string").alias("current_price"), "store_product_name"), at)
    return s.read.schema("id long, store_id long, current_price string, store_product_name string").json(at)


@query(None)
def daily_run(s, d):
    """The rows each stage of the daily run writes."""
    return W.run_summary(W.daily_run(table(s, d, "store_listings"), table(s, d, "products"), _categories(s, d)))
