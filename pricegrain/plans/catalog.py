"""Queries over the catalogue tables: filters, joins, aggregates, windows, set operations and serving queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators.hot import with_previous
from ..session import table
from .registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


# --- filters and joins ---


@query("""SELECT l.id, l.store_id, l.store_product_name FROM store_listings l WHERE store_id IN (SELECT id FROM stores WHERE chain = 'Castelbrico' OR chain = (SELECT min(chain) FROM stores))""")
def chain_listings(s, d):
    stores = table(s, d, "stores")
    first = stores.agg(F.min("chain").alias("chain"))
    ids = stores.join(F.broadcast(first), "chain", "left_semi").unionByName(stores.filter("chain = 'Castelbrico'")).select(F.col("id").alias("store_id"))
    return table(s, d, "store_listings").join(ids, "store_id", "left_semi").select("id", "store_id", "store_product_name")


@query("""SELECT id, store_ean, store_manufacturer_ref FROM store_listings WHERE product_id IS NULL AND (trim(store_ean) <> '' OR trim(store_manufacturer_ref) <> '')""")
def unmatched_by_id(s, d):
    rows = table(s, d, "store_listings").filter(F.col("product_id").isNull() & (C.present("store_ean") | C.present("store_manufacturer_ref")))
    return rows.select("id", "store_ean", "store_manufacturer_ref")


@query("""SELECT id, current_price FROM store_listings WHERE current_price < 0.10 OR current_price > 10000 ORDER BY current_price, id LIMIT 5""")
def suspicious_prices(s, d):
    return table(s, d, "store_listings").filter("current_price < 0.10 or current_price > 10000").select("id", "current_price").orderBy("current_price", "id").limit(5)


@query("""SELECT l.id, coalesce((SELECT min(x.id) FROM stores x WHERE x.chain = s.chain AND x.name = s.name), (SELECT min(x.id) FROM stores x WHERE x.chain = s.chain)) AS store_id
FROM store_listings l JOIN stores s ON s.id = l.store_id""")
def resolve_store(s, d):
    stores = table(s, d, "stores")
    items = table(s, d, "store_listings").select("id", "store_id").join(stores.select(F.col("id").alias("store_id"), "chain", F.col("name").alias("store_name")), "store_id").select("id", "chain", "store_name")
    return C.resolve_store(items, stores).select("id", "store_id")


@query("""WITH p AS (SELECT ean, min(id) AS product_id FROM products WHERE trim(ean) <> '' GROUP BY ean)
SELECT l.id AS listing_id, p.product_id FROM store_listings l JOIN p ON p.ean = l.store_ean WHERE l.product_id IS NULL AND trim(store_ean) <> ''""")
def match_ean(s, d):
    return C.link_by_code(table(s, d, "store_listings"), table(s, d, "products"), "store_ean", "ean")


@query("""WITH p AS (SELECT manufacturer_ref AS r, min(id) AS product_id FROM products WHERE trim(manufacturer_ref) <> '' GROUP BY 1)
SELECT l.id AS listing_id, p.product_id FROM store_listings l JOIN p ON p.r = l.store_manufacturer_ref WHERE l.product_id IS NULL AND trim(store_manufacturer_ref) <> ''""")
def match_ref(s, d):
    return C.link_by_code(table(s, d, "store_listings"), table(s, d, "products"), "store_manufacturer_ref", "manufacturer_ref")


@query("""WITH p AS (SELECT ean, min(id) AS known FROM products WHERE trim(ean) <> '' GROUP BY ean),
o AS (SELECT id, store_ean, store_product_name FROM store_listings WHERE product_id IS NULL AND trim(store_ean) <> ''),
m AS (SELECT store_ean, min(id) AS first, arg_min(store_product_name, id) AS name FROM o WHERE store_ean NOT IN (SELECT ean FROM p) GROUP BY store_ean),
n AS (SELECT store_ean, name, (SELECT max(id) FROM products) + row_number() OVER (ORDER BY first) AS made FROM m)
SELECT o.id AS listing_id, coalesce(p.known, n.made) AS product_id, n.made IS NOT NULL AS created, n.name FROM o LEFT JOIN p ON p.ean = o.store_ean LEFT JOIN n ON n.store_ean = o.store_ean""")
def match_ean_create(s, d):
    return C.link_or_create(table(s, d, "store_listings"), table(s, d, "products"))


@query("""SELECT product_id, first(category_path ORDER BY id) AS category_path FROM store_listings WHERE product_id IS NOT NULL GROUP BY product_id""")
def first_listing(s, d):
    rows = table(s, d, "store_listings").filter("product_id is not null")
    return rows.groupBy("product_id").agg(F.min_by("category_path", "id").alias("category_path"))


@query("""SELECT l.id FROM store_listings l WHERE EXISTS (SELECT 1 FROM stores s WHERE s.id = l.store_id AND s.website IS NOT NULL)""")
def semi_chain(s, d):
    return table(s, d, "store_listings").join(table(s, d, "stores").filter("website is not null").select(F.col("id").alias("store_id")), "store_id", "left_semi").select("id")


@query("""SELECT id FROM products p WHERE NOT EXISTS (SELECT 1 FROM store_listings l WHERE l.product_id = p.id)""")
def anti_seen(s, d):
    return table(s, d, "products").join(table(s, d, "store_listings").select(F.col("product_id").alias("id")), "id", "left_anti").select("id")


@query("""SELECT c.id AS category_id, c.name, p.name AS parent_name, (SELECT count(*) FROM categories k WHERE k.parent_id = c.id) AS children FROM categories c LEFT JOIN categories p ON p.id = c.parent_id""")
def category_rollup(s, d):
    c = table(s, d, "categories")
    parents = c.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    children = c.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("children"))
    return c.join(parents, "parent_id", "left").join(children, "id", "left").select(F.col("id").alias("category_id"), "name", "parent_name", F.coalesce("children", F.lit(0)).alias("children"))


@query("""SELECT l.id AS probe_id, l.id AS listing_id, l.last_scraped_at AS at, (SELECT arg_max(h.price, (h.scraped_at, h.id)) FROM price_history h WHERE h.listing_id = l.id AND h.scraped_at <= l.last_scraped_at) AS price
FROM store_listings l WHERE l.last_scraped_at IS NOT NULL""")
def asof_price(s, d):
    probes = table(s, d, "store_listings").filter("last_scraped_at is not null").select(F.col("id").alias("probe_id"), F.col("id").alias("listing_id"), F.col("last_scraped_at").alias("at"))
    return C.as_of(table(s, d, "price_history").filter("scraped_at is not null"), probes, "listing_id", "scraped_at", "price", "at")


# --- aggregates ---

_FIGURES = """SELECT p.id, p.min_price, p.max_price, p.listing_count, f.low, f.high, coalesce(f.n, 0) AS n FROM products p LEFT JOIN (
  SELECT product_id, min(current_price) FILTER (WHERE current_price <> 0) AS low, max(current_price) FILTER (WHERE current_price <> 0) AS high, count(*) AS n FROM store_listings WHERE product_id IS NOT NULL GROUP BY 1) f ON f.product_id = p.id"""


@query(f"SELECT id, low, high, n FROM ({_FIGURES})")
def denorm_prices(s, d):
    return C.denormalise(table(s, d, "products"), table(s, d, "store_listings")).select("id", "low", "high", "n")


@query(f"SELECT count(*) AS changed FROM ({_FIGURES}) WHERE low IS DISTINCT FROM min_price OR high IS DISTINCT FROM max_price OR n IS DISTINCT FROM listing_count")
def denorm_changes(s, d):
    rows = C.denormalise(table(s, d, "products"), table(s, d, "store_listings"))
    same = F.col("low").eqNullSafe(F.col("min_price")) & F.col("high").eqNullSafe(F.col("max_price")) & F.col("n").eqNullSafe(F.col("listing_count"))
    return rows.agg(F.count_if(~same).alias("changed"))


@query("SELECT product_id, count(*) AS n FROM store_listings WHERE product_id IS NOT NULL GROUP BY product_id HAVING count(*) > 3")
def multi_listing(s, d):
    return table(s, d, "store_listings").filter("product_id is not null").groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 3")


@query("SELECT min(current_price) AS low, max(current_price) AS high, round(avg(CAST(current_price AS DOUBLE)), 4) AS mean, count(current_price) AS n FROM store_listings WHERE current_price > 0")
def price_stats(s, d):
    return table(s, d, "store_listings").filter("current_price > 0").agg(
        F.min("current_price").alias("low"), F.max("current_price").alias("high"), F.round(F.avg(F.col("current_price").cast("double")), 4).alias("mean"), F.count("current_price").alias("n")
    )


@query("""WITH f AS (SELECT store_id, current_price AS v, count(*) AS w FROM store_listings WHERE current_price > 0 GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY store_id ORDER BY v) AS upto, sum(w) OVER (PARTITION BY store_id) AS n FROM f)
SELECT store_id, min(v) AS upper_median FROM c WHERE upto > n // 2 GROUP BY store_id""")
def upper_median(s, d):
    """Element n // 2 of the sorted prices of each store: from weighted values, so no list is collected."""
    freq = table(s, d, "store_listings").filter("current_price > 0").groupBy("store_id", "current_price").agg(F.count(F.lit(1)).alias("w"))
    store = Window.partitionBy("store_id")
    cum = freq.withColumn("upto", F.sum("w").over(store.orderBy("current_price"))).withColumn("n", F.sum("w").over(store))
    return cum.filter("upto > n div 2").groupBy("store_id").agg(F.min("current_price").alias("upper_median"))


@query("""SELECT store_id, round(avg(CASE WHEN trim(store_ean) <> '' THEN 1.0 ELSE 0 END), 6) AS with_ean, round(avg(CASE WHEN trim(store_manufacturer_ref) <> '' THEN 1.0 ELSE 0 END), 6) AS with_ref,
round(avg(CASE WHEN trim(category_path) <> '' THEN 1.0 ELSE 0 END), 6) AS with_category, round(avg(CASE WHEN in_stock THEN 1.0 ELSE 0 END), 6) AS in_stock FROM store_listings GROUP BY store_id""")
def coverage(s, d):
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return table(s, d, "store_listings").groupBy("store_id").agg(
        share(C.present("store_ean")).alias("with_ean"), share(C.present("store_manufacturer_ref")).alias("with_ref"),
        share(C.present("category_path")).alias("with_category"), share(F.col("in_stock")).alias("in_stock"),
    )


@query("SELECT store_product_name, count(*) AS n FROM store_listings GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, store_product_name LIMIT 5")
def dup_names(s, d):
    return table(s, d, "store_listings").groupBy("store_product_name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "store_product_name").limit(5)


@query("SELECT c.id AS category_id, c.name, count(*) AS n FROM categories c JOIN products p ON p.category_id = c.id WHERE c.id NOT IN (SELECT parent_id FROM categories WHERE parent_id IS NOT NULL) GROUP BY 1, 2")
def category_counts(s, d):
    c = table(s, d, "categories")
    leaves = c.join(c.select(F.col("parent_id").alias("id")).filter("id is not null"), "id", "left_anti")
    n = table(s, d, "products").groupBy(F.col("category_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return leaves.join(n, "id").select(F.col("id").alias("category_id"), "name", "n")


@query("""SELECT spider_name, CAST(sum(items_scraped) AS BIGINT) AS items, CAST(sum(errors) AS BIGINT) AS errors, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE finished_at IS NULL) AS open,
CAST(sum(epoch_us(finished_at) - epoch_us(started_at)) // 1000000 AS BIGINT) AS seconds FROM scrape_runs GROUP BY spider_name""")
def run_summary(s, d):
    return table(s, d, "scrape_runs").groupBy("spider_name").agg(
        F.sum("items_scraped").cast("long").alias("items"), F.sum("errors").cast("long").alias("errors"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("finished_at").isNull()).alias("open"), F.expr("sum(unix_micros(finished_at) - unix_micros(started_at)) div 1000000").alias("seconds"),
    )


@query("""SELECT id, spider_name, status, CAST((epoch_us(finished_at) - epoch_us(started_at)) // 1000000 AS BIGINT) AS seconds, lag(items_scraped) OVER (PARTITION BY spider_name ORDER BY started_at, id) AS items_before,
finished_at IS NOT NULL AND epoch_us(finished_at) - epoch_us(started_at) > 1800000000 AS over_limit FROM scrape_runs""")
def run_journal(s, d):
    runs = table(s, d, "scrape_runs")
    took = F.expr("unix_micros(finished_at) - unix_micros(started_at)")
    before = F.lag("items_scraped").over(Window.partitionBy("spider_name").orderBy("started_at", "id"))
    return runs.select("id", "spider_name", "status", F.expr("(unix_micros(finished_at) - unix_micros(started_at)) div 1000000").alias("seconds"), before.alias("items_before"), F.coalesce(took > 1_800_000_000, F.lit(False)).alias("over_limit"))


@query("SELECT count(*) FILTER (WHERE product_id IS NOT NULL) AS matched, count(*) AS total, (SELECT count(*) FROM products WHERE listing_count > 0) AS active FROM store_listings")
def match_totals(s, d):
    active = table(s, d, "products").agg(F.count_if(F.col("listing_count") > 0).alias("active")).head()["active"]
    return table(s, d, "store_listings").agg(F.count("product_id").alias("matched"), F.count(F.lit(1)).alias("total")).withColumn("active", F.lit(active).cast("long"))


@query("""SELECT c.parent_id, p.category_id, count(*) AS n, min(p.min_price) AS low FROM products p JOIN categories c ON c.id = p.category_id GROUP BY ROLLUP (c.parent_id, p.category_id)""")
def category_cube(s, d):
    """An addition to the reference: subtotals over the two lowest levels of the category tree."""
    c = table(s, d, "categories").select(F.col("id").alias("category_id"), "parent_id")
    return table(s, d, "products").join(c, "category_id").rollup("parent_id", "category_id").agg(F.count(F.lit(1)).alias("n"), F.min("min_price").alias("low"))


@query("""SELECT 'listings' AS measure, CAST(count(*) AS DOUBLE) AS value FROM store_listings UNION ALL SELECT 'low', CAST(min(current_price) AS DOUBLE) FROM store_listings UNION ALL SELECT 'high', CAST(max(current_price) AS DOUBLE) FROM store_listings
UNION ALL SELECT 'without_price', CAST(count(*) FILTER (WHERE current_price IS NULL OR current_price = 0) AS DOUBLE) FROM store_listings UNION ALL SELECT 'very_low', CAST(count(*) FILTER (WHERE current_price < 0.10) AS DOUBLE) FROM store_listings
UNION ALL SELECT 'very_high', CAST(count(*) FILTER (WHERE current_price > 10000) AS DOUBLE) FROM store_listings UNION ALL SELECT 'with_ean', CAST(count(*) FILTER (WHERE trim(store_ean) <> '') AS DOUBLE) FROM store_listings
UNION ALL SELECT 'in_stock', CAST(count(*) FILTER (WHERE in_stock) AS DOUBLE) FROM store_listings""")
def quality_report(s, d):
    p = F.col("current_price")
    one = table(s, d, "store_listings").agg(
        F.count(F.lit(1)).cast("double").alias("listings"), F.min(p).cast("double").alias("low"), F.max(p).cast("double").alias("high"), F.count_if(p.isNull() | (p == 0)).cast("double").alias("without_price"),
        F.count_if(p < 0.10).cast("double").alias("very_low"), F.count_if(p > 10000).cast("double").alias("very_high"), F.count_if(C.present("store_ean")).cast("double").alias("with_ean"), F.count_if("in_stock").cast("double").alias("in_stock"),
    )
    return one.unpivot([], one.columns, "measure", "value")


# --- windows, change logs, upserts ---

_SEEN = "SELECT * FROM price_history WHERE scraped_at IS NOT NULL"


@query(f"SELECT listing_id, id, price, before FROM (SELECT *, lag(price) OVER (PARTITION BY listing_id ORDER BY scraped_at, id) AS before FROM ({_SEEN})) WHERE before IS DISTINCT FROM price")
def price_changes(s, d):
    rows = with_previous(table(s, d, "price_history").filter("scraped_at is not null"), "listing_id", "scraped_at", "id", "price", "last")
    return rows.filter("last.v is distinct from price").select("listing_id", "id", "price", F.col("last.v").alias("before"))


@query(f"""SELECT listing_id, id, before - price AS drop FROM (SELECT *, lag(price) OVER (PARTITION BY listing_id ORDER BY scraped_at, id) AS before FROM ({_SEEN})) WHERE price > 0 AND price < before""")
def price_drop(s, d):
    rows = with_previous(table(s, d, "price_history").filter("scraped_at is not null"), "listing_id", "scraped_at", "id", "price", "last")
    return rows.filter("price > 0 and price < last.v").select("listing_id", "id", (F.col("last.v") - F.col("price")).alias("drop"))


@query(f"SELECT listing_id, CAST(scraped_at AS DATE) AS day, arg_min(id, (scraped_at, id)) AS id FROM ({_SEEN}) GROUP BY 1, 2")
def first_in_batch(s, d):
    """The first row of each listing and day, a day being a batch."""
    rows = table(s, d, "price_history").filter("scraped_at is not null").withColumn("day", F.to_date("scraped_at"))
    return rows.groupBy("listing_id", "day").agg(F.min_by("id", F.struct("scraped_at", "id")).alias("id"))


@query(f"SELECT listing_id, CAST(scraped_at AS DATE) AS day, arg_max(price, (scraped_at, id)) AS price FROM ({_SEEN}) GROUP BY 1, 2")
def last_in_feed(s, d):
    rows = table(s, d, "price_history").filter("scraped_at is not null").withColumn("day", F.to_date("scraped_at"))
    return rows.groupBy("listing_id", "day").agg(F.max_by("price", F.struct("scraped_at", "id")).alias("price"))


@query("SELECT store_ean, min(id) AS id FROM store_listings WHERE store_ean IS NOT NULL GROUP BY store_ean")
def dedup_first(s, d):
    return table(s, d, "store_listings").filter("store_ean is not null").groupBy("store_ean").agg(F.min("id").alias("id"))


@query("SELECT id, row_number() OVER (ORDER BY id) - 1 AS at, (row_number() OVER (ORDER BY id) - 1) % 7 AS shard FROM products")
def shard_mod(s, d):
    return C.row_numbers(table(s, d, "products").select("id"), "id", "k").select("id", (F.col("k") - 1).alias("at"), ((F.col("k") - 1) % 7).alias("shard"))


@query("SELECT DISTINCT url FROM (SELECT store_product_url AS url FROM store_listings UNION ALL SELECT website FROM stores) WHERE url IS NOT NULL")
def union_links(s, d):
    a = table(s, d, "store_listings").select(F.col("store_product_url").alias("url"))
    return a.unionByName(table(s, d, "stores").select(F.col("website").alias("url"))).filter("url is not null").distinct()


# --- serving queries: names only in the reference, so the simplest meaning is taken ---

_OFFERS = "SELECT l.product_id, l.store_id, l.current_price, l.id FROM store_listings l WHERE product_id IS NOT NULL AND current_price > 0"


_BIGGEST = {c: f"(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)" for c, t in (("category_id", "products"), ("store_id", "store_listings"), ("brand", "products"))}


@query("SELECT p.id, p.name, p.min_price FROM products p WHERE p.min_price BETWEEN 5 AND 1000 ORDER BY p.min_price, p.id LIMIT 50 OFFSET 50")
def product_list(s, d):
    """Page 2 of the products in a price range, 50 a page."""
    return C.product_page(table(s, d, "products"), table(s, d, "store_listings"), price=(5, 1000), page=2)


@query(f"""SELECT p.id, p.name, p.min_price FROM products p WHERE p.min_price BETWEEN 1 AND 10000 AND p.category_id = {_BIGGEST["category_id"]} ORDER BY p.min_price, p.id LIMIT 50""")
def product_list_category(s, d):
    """The first page of the largest category."""
    products = table(s, d, "products")
    return C.product_page(products, table(s, d, "store_listings"), price=(1, 10000), category=C.most_frequent(products, "category_id"))


@query(f"""SELECT p.id, p.name, p.min_price FROM products p WHERE p.brand = {_BIGGEST["brand"]} AND p.id IN (SELECT product_id FROM store_listings WHERE store_id = {_BIGGEST["store_id"]}) ORDER BY p.min_price NULLS LAST, p.id LIMIT 50""")
def product_list_store(s, d):
    """The first page of the commonest brand's products that the largest store holds."""
    products, listings = table(s, d, "products"), table(s, d, "store_listings")
    return C.product_page(products, listings, brand=C.most_frequent(products, "brand"), store=C.most_frequent(listings, "store_id"))


@query("""SELECT p.id, p.name, l.id AS listing_id, l.store_id, l.current_price FROM products p LEFT JOIN store_listings l ON l.product_id = p.id WHERE p.slug = (SELECT min(slug) FROM products)""")
def product_detail(s, d):
    p = table(s, d, "products")
    slug = p.agg(F.min("slug").alias("slug")).head()["slug"]
    listings = table(s, d, "store_listings").select(F.col("id").alias("listing_id"), "store_id", "current_price", F.col("product_id").alias("id"))
    return p.filter(F.col("slug") == slug).select("id", "name").join(listings, "id", "left")


@query("""WITH RECURSIVE down AS (SELECT id, id AS top, 0 AS level FROM categories WHERE parent_id IS NULL UNION ALL SELECT c.id, d.top, d.level + 1 FROM categories c JOIN down d ON c.parent_id = d.id)
SELECT d.top AS category_id, count(*) AS products, min(p.min_price) AS low FROM down d JOIN products p ON p.category_id = d.id GROUP BY 1""")
def category_products(s, d):
    """Products under each root category, however deep."""
    from ..operators.tree import hierarchy

    c = table(s, d, "categories")
    roots = c.filter("parent_id is null").select(F.col("id").alias("root"))
    tree = hierarchy(c).select(F.col("id").alias("category_id"), "root").join(roots, "root", "left_semi")
    found = table(s, d, "products").select("category_id", "min_price").join(tree, "category_id")
    return found.groupBy(F.col("root").alias("category_id")).agg(F.count(F.lit(1)).alias("products"), F.min("min_price").alias("low"))


@query("""SELECT id, name, CAST(len(list_intersect(string_split(lower(name), ' '), ['peinture', 'blanc', 'mat'])) AS INT) AS hits FROM products WHERE len(list_intersect(string_split(lower(name), ' '), ['peinture', 'blanc', 'mat'])) > 0 ORDER BY hits DESC, id LIMIT 20""")
def search(s, d):
    """Products by the number of distinct query words in their name."""
    hits = F.size(F.array_intersect(F.split(F.lower("name"), " "), F.array(F.lit("peinture"), F.lit("blanc"), F.lit("mat"))))
    return table(s, d, "products").select("id", "name", hits.alias("hits")).filter("hits > 0").orderBy(F.desc("hits"), "id").limit(20)


@query("SELECT name, count(*) AS n FROM products WHERE lower(name) LIKE 'vis%' GROUP BY name ORDER BY n DESC, name LIMIT 10")
def autocomplete(s, d):
    return table(s, d, "products").filter(F.lower("name").startswith("vis")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(10)


@query("SELECT chain, count(*) AS stores, min(city) AS city FROM stores GROUP BY chain")
def store_list(s, d):
    return table(s, d, "stores").groupBy("chain").agg(F.count(F.lit(1)).alias("stores"), F.min("city").alias("city"))


@query(f"SELECT product_id, store_id, id, current_price, rank() OVER (PARTITION BY product_id ORDER BY current_price, id) AS place, min(current_price) OVER (PARTITION BY product_id) AS low FROM ({_OFFERS})")
def price_table(s, d):
    """The offers of every product by price, with place and lowest price."""
    rows = table(s, d, "store_listings").filter("product_id is not null and current_price > 0").select("product_id", "store_id", "id", "current_price")
    product = Window.partitionBy("product_id")
    return rows.withColumn("place", F.rank().over(product.orderBy("current_price", "id")).cast("long")).withColumn("low", F.min("current_price").over(product))


@query(f"SELECT listing_id, CAST(date_trunc('month', scraped_at) AS DATE) AS month, min(price) AS low, max(price) AS high, arg_max(price, (scraped_at, id)) AS last FROM ({_SEEN}) WHERE price > 0 GROUP BY 1, 2")
def price_series(s, d):
    rows = table(s, d, "price_history").filter("scraped_at is not null and price > 0")
    return rows.groupBy("listing_id", F.to_date(F.date_trunc("month", "scraped_at")).alias("month")).agg(F.min("price").alias("low"), F.max("price").alias("high"), F.max_by("price", F.struct("scraped_at", "id")).alias("last"))


@query("SELECT product_id, count(*) AS n FROM store_listings WHERE product_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, product_id LIMIT 20")
def popular(s, d):
    return table(s, d, "store_listings").filter("product_id is not null").groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "product_id").limit(20)


@query("SELECT 'color' AS facet, color AS value, count(*) AS n FROM products WHERE color IS NOT NULL GROUP BY color UNION ALL SELECT 'finish', finish, count(*) FROM products WHERE finish IS NOT NULL GROUP BY finish")
def facets(s, d):
    """Counts of both facets in one pass."""
    each = F.explode(F.array(F.struct(F.lit("color").alias("facet"), F.col("color").alias("value")), F.struct(F.lit("finish"), F.col("finish")).cast("struct<facet:string,value:string>")))
    return table(s, d, "products").select(each.alias("x")).select("x.*").filter("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, name, round(12742.0 * asin(sqrt(pow(sin(radians((CAST(lat AS DOUBLE) - 45.75) / 2)), 2) + cos(radians(45.75)) * cos(radians(CAST(lat AS DOUBLE))) * pow(sin(radians((CAST(lng AS DOUBLE) - 4.85) / 2)), 2))), 3) AS km
FROM stores WHERE lat IS NOT NULL AND lng IS NOT NULL ORDER BY km, id LIMIT 10""")
def nearest_store(s, d):
    lat, lng = F.col("lat").cast("double"), F.col("lng").cast("double")
    h = F.pow(F.sin(F.radians((lat - 45.75) / 2)), 2) + F.cos(F.radians(F.lit(45.75))) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians((lng - 4.85) / 2)), 2)
    rows = table(s, d, "stores").filter("lat is not null and lng is not null")
    return rows.select("id", "name", F.round(12742.0 * F.asin(F.sqrt(h)), 3).alias("km")).orderBy("km", "id").limit(10)
