"""Queries of feeds, sitemaps, page extraction, validation and streams.

The pages, feeds and sitemaps are written from the products and listings, so that the SQL can say what must be
read out of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_folder, table
from ..sources import pages as P
from ..streaming import prices as ST
from .registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql


def _products(s, d):
    return table(s, d, "products")


def _escaped(c):
    """A text as it stands in a page: signs and some accents as entities."""
    out = F.coalesce(c, F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("é", "&eacute;"), ("²", "&sup2;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def _ld_page(s, d):
    """Pages with a breadcrumb and a product script, brand and image in several shapes."""
    price = F.col("min_price").cast("string")
    offer = F.struct(price.alias("price"), F.lit("https://schema.org/InStock").alias("availability"))
    one = F.struct(F.lit("Product").alias("@type"), F.col("name"), F.col("slug").alias("sku"), F.col("ean").alias("gtin13"), F.struct(F.col("brand").alias("name")).alias("brand"), F.array("image_url").alias("image"), offer.alias("offers"))
    two = F.struct(F.lit("Product").alias("@type"), F.col("name"), F.col("slug").alias("sku"), F.col("ean").alias("gtin"), F.col("brand").alias("brand"), F.col("image_url").alias("image"), F.array(offer).alias("offers"))
    script = F.when(F.col("id") % 2 == 0, F.to_json(one)).otherwise(F.concat(F.lit("["), F.to_json(two), F.lit("]")))
    crumb = F.to_json(F.struct(F.lit("BreadcrumbList").alias("@type"), F.array(F.struct(F.lit("Accueil").alias("name")), F.struct(F.coalesce("unit", F.lit("")).alias("name")), F.struct(F.col("slug").alias("name"))).alias("itemListElement")))
    shown = _escaped("name")
    head = F.concat(F.lit('<html><head><title>'), shown, F.lit('</title><meta property="og:title" content="'), shown, F.lit('"><meta content="'), F.coalesce(price, F.lit("")), F.lit('" property="product:price"></head><body><h1 class="t">'), shown, F.lit("</h1>"))
    ld = lambda c: F.concat(F.lit('<script type="application/ld+json">'), c, F.lit(";</script>"))
    tail = F.concat(F.lit('<span itemprop="sku" content="'), F.col("slug"), F.lit('"></span><b itemprop="price">'), F.coalesce(price, F.lit("")), F.lit('</b><a href="/p/'), F.col("slug"), F.lit('">x</a><a href="/c/'), F.coalesce("unit", F.lit("u")), F.lit('">y</a><a href="/p/'), F.col("slug"), F.lit('">z</a></body></html>'))
    return _products(s, d).select("id", F.concat(head, ld(F.lit("{broken")), ld(crumb), ld(script), tail).alias("page"))


@query("""SELECT id, nullif(trim(name), '') AS name, nullif(trim(slug), '') AS sku, CASE WHEN length(regexp_replace(ean, '[^0-9]', '', 'g')) IN (8, 13) THEN regexp_replace(ean, '[^0-9]', '', 'g') END AS ean,
nullif(trim(brand), '') AS brand, nullif(trim(image_url), '') AS image, CAST(min_price AS DECIMAL(12,2)) AS price, true AS in_stock FROM products""")
def jsonld_product(s, d):
    rows = P.ld_objects(_ld_page(s, d), "page", "Product")
    fields = P.ld_product()
    return rows.select("id", *[fields[f].alias(f) for f in ("name", "sku", "ean", "brand", "image", "price", "in_stock")])


@query("SELECT id, CASE WHEN trim(coalesce(unit, '')) <> '' THEN unit || ' > ' ELSE '' END || slug AS crumbs FROM products")
def jsonld_breadcrumb(s, d):
    return P.ld_objects(_ld_page(s, d), "page", "BreadcrumbList").select("id", F.array_join(P.ld_breadcrumb(), " > ").alias("crumbs"))


@query("SELECT product_id AS id, nullif(trim(l.store_sku), '') AS sku, nullif(trim(p.slug), '') AS name, l.id AS url FROM store_listings l JOIN products p ON p.id = l.product_id WHERE trim(l.store_sku) <> ''")
def jsonld_variants(s, d):
    """Product groups whose variants are their listings; variants take the group's name."""
    listings = table(s, d, "store_listings").filter("product_id is not null and trim(store_sku) != ''")
    variants = listings.groupBy(F.col("product_id").alias("id")).agg(F.collect_list(F.struct(F.col("store_sku").alias("sku"), F.col("id").cast("string").alias("url"))).alias("hasVariant"))
    groups = _products(s, d).select("id", "slug").join(variants, "id").select("id", F.to_json(F.struct(F.lit("ProductGroup").alias("@type"), F.col("slug").alias("name"), "hasVariant")).alias("j"))
    rows = P.ld_variants(P.ld_objects(groups.select("id", F.concat(F.lit('<script type="application/ld+json">'), "j", F.lit("</script>")).alias("page")), "page", "ProductGroup").drop("page"))
    return rows.select("id", "sku", "name", F.col("url").cast("long").alias("url"))


@query("""SELECT id, k AS name, json_extract_string(specifications, '$."' || k || '"') AS value FROM (SELECT id, specifications, unnest(json_keys(specifications)) AS k FROM products WHERE specifications IS NOT NULL)""")
def jsonld_props(s, d):
    """All additional properties of each product, written as the list a page holds and read back as a map."""
    given = F.map_entries(F.from_json("specifications", "map<string,string>"))
    rows = _products(s, d).filter("specifications is not null").select("id", F.to_json(F.struct(F.lit("Product").alias("@type"), F.transform(given, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))).alias("additionalProperty"))).alias("j"))
    found = P.ld_objects(rows.select("id", F.concat(F.lit('<script type="application/ld+json">'), "j", F.lit("</script>")).alias("page")), "page", "Product")
    return found.select("id", F.explode(P.ld_properties()).alias("name", "value"))


@query("SELECT id, slug AS sku, CAST(min_price AS VARCHAR) AS price FROM products")
def microdata(s, d):
    return _ld_page(s, d).select("id", P.microdata(F.col("page"), "sku").alias("sku"), P.microdata(F.col("page"), "price").alias("price"))


@query("SELECT id, nullif(trim(name), '') AS title, CAST(min_price AS VARCHAR) AS price FROM products")
def meta_fallback(s, d):
    return _ld_page(s, d).select("id", P.meta(F.col("page"), "og:title").alias("title"), P.meta(F.col("page"), "product:price").alias("price"))


@query("SELECT id, nullif(trim(name), '') AS title, nullif(trim(name), '') AS h1 FROM products")
def page_title_h1(s, d):
    return _ld_page(s, d).select("id", P.heading(F.col("page"), "title").alias("title"), P.heading(F.col("page"), "h1").alias("h1"))


@query("SELECT id, '/p/' || slug AS link FROM products UNION ALL SELECT id, '/c/' || coalesce(unit, 'u') FROM products")
def page_links(s, d):
    """The distinct links of each page, at most 30 as the reference takes."""
    return _ld_page(s, d).select("id", F.explode(F.slice(P.links(F.col("page")), 1, 30)).alias("link"))


@query("SELECT id, 0 AS card, nullif(trim(name), '') AS name, CAST(min_price AS VARCHAR) AS price FROM products UNION ALL SELECT id, 1, 'second', NULL FROM products")
def html_cards(s, d):
    card = F.concat(F.lit('<ul><li class="card big"><span class="name"><b>'), _escaped("name"), F.lit('</b></span><br><i class="price">'), F.coalesce(F.col("min_price").cast("string"), F.lit("")), F.lit('</i></li><li class="card"><span class="name">second</span></li></ul>'))
    return P.html_cards(_products(s, d).select("id", card.alias("page")), "id", "page", "card", {"name": "name", "price": "price"})


@query("SELECT id, slug AS code, CAST(min_price AS DECIMAL(12,2)) AS price, true AS orderable FROM products WHERE min_price IS NOT NULL")
def js_state(s, d):
    """An inline object literal with unquoted keys, !0, single quotes, undefined and trailing commas."""
    text = F.concat(F.lit("window.state = {articles:[{code:'"), "slug", F.lit("',net_price:"), F.col("min_price").cast("string"), F.lit(",old:undefined,orderable:!0,},],};"))
    v = P.state_json(F.col("page"), r"window\.state")
    rows = _products(s, d).filter("min_price is not null").select("id", text.alias("page")).select("id", v.alias("v"))
    return rows.select("id", P.get("$.articles[0].code").alias("code"), P.get("$.articles[0].net_price").try_cast("decimal(12,2)").alias("price"), F.try_variant_get("v", "$.articles[0].orderable", "boolean").alias("orderable"))


@query("SELECT id, nullif(trim(name), '') AS name FROM products")
def next_data(s, d):
    text = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), F.to_json(F.struct(F.struct(F.struct(F.struct("name").alias("product")).alias("pageProps")).alias("props"))), F.lit("</script>"))
    return _products(s, d).select("id", text.alias("page")).select("id", P.next_data(F.col("page")).alias("v")).select("id", P.get("$.props.pageProps.product.name").alias("name"))


@query("SELECT id, slug AS sku, nullif(trim(name), '') AS name, CAST(min_price AS DECIMAL(12,2)) AS price FROM products")
def datalayer_items(s, d):
    price = F.col("min_price").cast("string")
    a = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("slug").alias("id"), "name", price.alias("price"))).alias("impressions")).alias("ecommerce")))
    b = F.to_json(F.struct(F.array(F.struct(F.col("slug").alias("item_id"), F.col("name").alias("item_name"), price.alias("price"))).alias("productListItems")))
    return P.data_layer_items(_products(s, d).select("id", F.when(F.col("id") % 2 == 0, a).otherwise(b).alias("layer")), "layer")


@query("SELECT id, name AS label, CAST(id AS VARCHAR) AS value, 1 AS found FROM products")
def suggest_groups(s, d):
    answer = F.to_json(F.struct(F.array(F.struct(F.col("name").alias("label"), F.col("id").cast("string").alias("value"))).alias("compressedProducts"), F.lit(1).alias("numberOfFoundProducts")))
    return P.suggest_rows(_products(s, d).select("id", answer.alias("r")), "r")


_URL = "store_product_url"


@query(f"SELECT store_id, {_URL} AS url FROM store_listings WHERE regexp_matches({_URL}, '\\.html$|/$')")
def sitemap_urls(s, d):
    """URLs with an ending of interest out of one sitemap for each listing."""
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url>\n<loc> '), F.replace(_URL, F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url></urlset>"))
    rows = table(s, d, "store_listings").filter(f"{_URL} is not null").select("store_id", xml.alias("xml"))
    return P.sitemap_rows(rows, "xml", "store_id", r"\.html$|/$")


@query(f"SELECT s.id AS store_id, l.{_URL} AS url FROM stores s JOIN store_listings l ON l.store_id = s.id WHERE l.{_URL} IS NOT NULL")
def sitemap_index(s, d):
    """Two levels: an index of sitemaps, one for each store, joined to the sitemaps' own rows."""
    stores = table(s, d, "stores")
    index = stores.select(F.col("id").alias("store_id"), F.concat(F.lit("<sitemapindex><sitemap><loc>https://maps.example/"), F.col("id").cast("string"), F.lit(".xml</loc></sitemap></sitemapindex>")).alias("xml"))
    named = P.sitemap_rows(index, "xml", "store_id").withColumnRenamed("url", "map")
    maps = table(s, d, "store_listings").filter(f"{_URL} is not null").select(
        F.concat(F.lit("https://maps.example/"), F.col("store_id").cast("string"), F.lit(".xml")).alias("map"), F.concat(F.lit("<urlset><url><loc>"), F.replace(_URL, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url></urlset>")).alias("xml")
    )
    return named.join(P.sitemap_rows(maps, "xml", "map"), "map").select("store_id", "url")


@query(f"SELECT DISTINCT store_id, {_URL} AS url FROM store_listings WHERE {_URL} IS NOT NULL")
def sitemap_gzip(s, d):
    """Sitemaps as gzip files, at most 50,000 URLs each, read as bytes and inflated."""
    path = f"{shared_folder(s)}/maps-{abs(hash((d, s.sparkContext.applicationId)))}"
    line = F.concat(F.lit("<url><loc>"), F.replace(_URL, F.lit("&"), F.lit("&amp;")), F.lit("</loc><s>"), F.col("store_id").cast("string"), F.lit("</s></url>"))
    table(s, d, "store_listings").filter(f"{_URL} is not null and store_id is not null").select(line.alias("value")).distinct().write.mode("overwrite").option("maxRecordsPerFile", 50_000).text(path, compression="gzip")
    rows = P.read_files(s, path).select(F.explode(F.regexp_extract_all("text", F.lit(r"<loc>([^<]*)</loc><s>([0-9]*)</s>"), 0)).alias("x"))
    return rows.select(F.regexp_extract("x", r"<s>([0-9]+)</s>", 1).cast("long").alias("store_id"), P.sitemap_locations(F.col("x"))[0].alias("url"))


@query(f"SELECT store_id, {_URL} AS url FROM store_listings WHERE {_URL} IS NOT NULL")
def sitemap_xpath(s, d):
    """Well-formed sitemaps by a path over the parsed document."""
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '), F.replace(F.replace(_URL, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(" </loc></url></urlset>"))
    rows = table(s, d, "store_listings").filter(f"{_URL} is not null").select("store_id", xml.alias("xml"))
    return rows.select("store_id", F.explode(P.sitemap_nodes(F.col("xml"))).alias("url"))


_LAST = "(SELECT max(last_scraped_at) FROM store_listings)"


@query(f"""SELECT {_URL} AS url, max(last_scraped_at) AS fetched_at, arg_max(store_product_name, (last_scraped_at, sha256('<title>' || store_product_name || '</title>'))) AS title FROM store_listings
WHERE {_URL} IS NOT NULL AND store_product_name IS NOT NULL AND epoch_us({_LAST}) - epoch_us(last_scraped_at) <= 7 * 86400000000 GROUP BY 1""")
def captured_pages(s, d):
    """The last capture of each page within a week of the newest one."""
    rows = table(s, d, "store_listings").filter(f"{_URL} is not null and store_product_name is not null and last_scraped_at is not null")
    captures = rows.select(F.col(_URL).alias("url"), F.encode(F.concat(F.lit("<title>"), "store_product_name", F.lit("</title>")), "UTF-8").alias("body"), F.col("last_scraped_at").alias("fetched_at"))
    newest = table(s, d, "store_listings").agg(F.max("last_scraped_at")).head()[0]
    return P.captured_pages(captures, F.lit(newest), 168).select("url", "fetched_at", F.regexp_extract("text", "(?s)<title>(.*)</title>", 1).alias("title"))


_RAW = """'x = {"sku" : "' || slug || '", "name": "' || replace(coalesce(name, ''), '"', '') || '", "price":' || CASE WHEN id % 2 = 0 THEN '"' || coalesce(CAST(min_price AS VARCHAR), '') || '"' ELSE coalesce(CAST(min_price AS VARCHAR), '') END || '}'"""


@query("SELECT id, CASE WHEN name <> '' AND min_price > 0 THEN replace(name, '\"', '') END AS name, CASE WHEN name <> '' AND min_price > 0 THEN slug END AS sku, CASE WHEN name <> '' AND min_price > 0 THEN CAST(min_price AS DECIMAL(12,2)) END AS price FROM products")
def last_resort(s, d):
    """Name, sku and price found by pattern in a page without any structure."""
    price = F.coalesce(F.col("min_price").cast("string"), F.lit(""))
    page = F.concat(F.lit('x = {"sku" : "'), "slug", F.lit('", "name": "'), F.replace(F.coalesce("name", F.lit("")), F.lit('"'), F.lit("")), F.lit('", "price":'), F.when(F.col("id") % 2 == 0, F.concat(F.lit('"'), price, F.lit('"'))).otherwise(price), F.lit("}"))
    return _products(s, d).select("id", *[c.alias(n) for n, c in P.last_resort(page).items()])


@query("""SELECT id, nullif(regexp_replace(store_manufacturer_ref, '^[\\[\\](){}]+|[\\[\\](){}]+$', '', 'g'), '') AS maker_ref, CAST(1200000 + id AS VARCHAR) AS article, CAST(id AS VARCHAR) AS ref, CASE WHEN regexp_full_match(store_ean, '[0-9]{13}') THEN store_ean END AS ean
FROM store_listings WHERE NOT regexp_matches(coalesce(store_manufacturer_ref, ''), '\\s') AND store_manufacturer_ref <> ''""")
def page_labels(s, d):
    """What stands behind the labels of a page's text."""
    number = (F.col("id") + 1_200_000).cast("string")
    spaced = F.concat(F.substring(number, 1, 4), F.lit(" "), F.substring(number, 5, 20))
    text = F.concat(F.lit("Fabricant : ["), "store_manufacturer_ref", F.lit("] Art. N° "), spaced, F.lit(" / Réf. "), F.col("id").cast("string"), F.lit(" EAN: "), F.coalesce("store_ean", F.lit("-")), F.lit(" fin"))
    rows = table(s, d, "store_listings").filter(r"store_manufacturer_ref != '' and not store_manufacturer_ref rlike '\\s'").select("id", text.alias("text"))
    return rows.select("id", *[P.page_label(F.col("text"), w).alias(w) for w in P.PAGE_LABELS])


@query("""SELECT id, 'https://shop.example/api?categoryFilter=' || f || '&pageIndex=' || n AS url FROM (SELECT id, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) AS f, unnest(generate_series(2, 1 + id % 5)) AS n
FROM (SELECT id, md5(CAST(id AS VARCHAR)) AS m FROM categories))""")
def page_pagination(s, d):
    """The further pages of each category page, from its filter and number of pages."""
    m = F.md5(F.col("id").cast("string"))
    name = F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 20))
    page = F.concat(F.lit("<script>x({categoryFilter: '"), name, F.lit("', totalPages: "), (1 + F.col("id") % 5).cast("string"), F.lit("})</script>"))
    return P.further_pages(table(s, d, "categories").select("id", page.alias("page")), "page", "https://shop.example/api?categoryFilter={filter}&pageIndex={page}")


@query("""SELECT DISTINCT 'https://shop.example/c/' || p.slug AS url, 'https://shop.example/c/' || p.slug || '/' || c.slug AS link FROM categories c JOIN categories p ON p.id = c.parent_id""")
def subcategories(s, d):
    """The links of each category's page that lead to its subcategories: no pages, blog, cart or the page itself."""
    c = table(s, d, "categories").select("parent_id", F.col("slug").alias("child"))
    rows = table(s, d, "categories").select(F.col("id").alias("parent_id"), F.concat(F.lit("https://shop.example/c/"), "slug").alias("url")).join(c, "parent_id")
    links = ["{u}/{c}", "{u}", "{u}/", "/blog/{c}/x/y", "/checkout/a/b/{c}", "{u}/{c}.html", "{u}/{c}?p=2"]
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{u}"), F.col("url")), F.lit("{c}"), F.col("child"))
    html = F.concat(*[x for t in links for x in (F.lit('<a href="'), fill(t), F.lit('">x</a>'))])
    rule = P.UrlRule(not_ends=".html", least_slashes=4, without=("/blog/", "/page/", "/checkout/", "?", "#"))
    return P.subcategories(rows.select("url", html.alias("page")), "url", "page", rule)


_FEED = """SELECT CAST(id AS VARCHAR) AS product_id, nullif(trim(name), '') AS name, CAST(abs(min_price) AS DECIMAL(12,2)) AS price, nullif(trim(brand), '') AS brand, nullif(trim(ean), '') AS ean, 'EUR' AS currency, true AS in_stock FROM products"""


def _feed_file(s, d, kind):
    """A feed written to the shared folder, once for each folder of tables."""
    path = f"{shared_folder(s)}/feed-{kind}-{abs(hash((d, s.sparkContext.applicationId)))}"
    rows = _products(s, d).select(F.col("id").alias("aw_product_id"), F.col("name").alias("product_name"), F.col("min_price").cast("string").alias("search_price"), F.col("brand").alias("brand_name"), F.col("ean"))
    if kind == "csv":
        rows.write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        rows.write.mode("overwrite").format("xml").option("rowTag", "product").option("rootTag", "products").save(path)
    return path


def _feed_columns(df):
    return df.select("product_id", "name", "price", "brand", "ean", "currency", "in_stock")


@query(_FEED)
def feed_csv(s, d):
    return _feed_columns(P.normalise_feed(P.read_csv_feed(s, _feed_file(s, d, "csv"))))


@query(_FEED)
def feed_xml(s, d):
    fields = ["aw_product_id", "product_name", "search_price", "brand_name", "ean"]
    return _feed_columns(P.normalise_feed(P.read_xml_feed(s, _feed_file(s, d, "xml"), fields)))


def _raw_feed(s, d):
    return _products(s, d).select(
        F.col("id").cast("string").alias("id"), F.col("name").alias("title"), F.lit(" ").alias("product_name"), F.concat(F.col("min_price").cast("string"), F.lit(" EUR")).alias("price"),
        F.col("brand").alias("manufacturer"), F.col("ean").alias("gtin"), F.lit("").alias("stock_status"),
    )


@query("SELECT CAST(id AS VARCHAR) AS product_id, nullif(trim(name), '') AS name, CAST(abs(min_price) AS DECIMAL(12,2)) AS price, nullif(trim(brand), '') AS brand, nullif(trim(ean), '') AS ean, 'EUR' AS currency, true AS in_stock FROM products")
def feed_normalize(s, d):
    return _feed_columns(P.normalise_feed(_raw_feed(s, d)))


@query("SELECT CAST(id AS VARCHAR) AS product_id FROM products WHERE trim(name) <> '' AND min_price IS NOT NULL")
def feed_filter(s, d):
    return P.normalise_feed(_raw_feed(s, d)).filter("name is not null and price is not null").select("product_id")


def _items(s, d):
    chains = table(s, d, "stores").select(F.col("id").alias("store_id"), F.col("chain").alias("store_chain"))
    rows = table(s, d, "store_listings").select("id", "store_id", F.col("store_product_name").alias("product_name"), F.col("current_price").cast("string").alias("price"), F.col("unit_label").alias("unit_price"))
    return rows.join(chains, "store_id", "left")


_REASON = """CASE WHEN nullif(trim(store_product_name), '') IS NULL THEN 'no name' WHEN current_price IS NULL THEN 'no price' WHEN current_price <= 0 THEN 'price not above 0' WHEN current_price > 100000 THEN 'price above 100000' WHEN nullif(trim(chain), '') IS NULL THEN 'no chain' END"""


@query(f"SELECT l.id, CAST(current_price AS DECIMAL(12,2)) AS price FROM store_listings l LEFT JOIN stores s ON s.id = l.store_id WHERE {_REASON} IS NULL")
def validate_items(s, d):
    return P.validate(_items(s, d)).filter("reject_reason is null").select("id", "price")


@query(f"SELECT {_REASON} AS reject_reason, count(*) AS n FROM store_listings l LEFT JOIN stores s ON s.id = l.store_id WHERE {_REASON} IS NOT NULL GROUP BY 1")
def reject_reasons(s, d):
    return P.validate(_items(s, d)).filter("reject_reason is not null").groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


# --- streams ---


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_tumbling(s, d):
    """Daily windows over the event stream, run to its end."""
    return ST.run_to_end(ST.tumbling(ST.event_stream(s, d)), "complete").withColumns({"day": F.to_date("day"), "total": F.round("total", 4)})


@query("""SELECT user_id, event_id, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE value IS NOT NULL) WHERE before IS DISTINCT FROM value""")
def stream_price_changes(s, d):
    """Value changes of each user by keyed state: as the batch change log where events arrive in order."""
    return ST.run_to_end(ST.changes(ST.event_stream(s, d)), "append")


@query("SELECT DISTINCT event_id, user_id FROM events")
def stream_dedup(s, d):
    """A stream that brings every event twice, each let through once within the watermark."""
    stream = ST.event_stream(s, d).select("event_id", "user_id", "ts")
    return ST.run_to_end(ST.once(stream.unionByName(ST.event_stream(s, d).select("event_id", "user_id", "ts")), "event_id").select("event_id", "user_id"), "append")


@query("""WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMPTZ '2000-01-01 00:00:00+00') AS a FROM (SELECT *, ts::TIMESTAMPTZ AS t FROM events)),
b AS (SELECT a AS start, event_type, value FROM w UNION ALL SELECT a - INTERVAL 12 HOUR, event_type, value FROM w)
SELECT CAST(start AS TIMESTAMPTZ) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY 1, 2""")
def stream_sliding(s, d):
    """Windows of a day that begin every twelve hours."""
    return ST.run_to_end(ST.sliding(ST.event_stream(s, d)), "complete").withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 6 * 3600000000 THEN 0 ELSE 1 END AS begins FROM events),
k AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id, CAST(min(ts) AS TIMESTAMPTZ) AS start, count(*) AS n FROM k GROUP BY user_id, session""")
def stream_sessions(s, d):
    """Sessions of each user: events at most six hours apart."""
    return ST.run_to_end(ST.sessions(ST.event_stream(s, d)), "complete")


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id AS id, epoch_us(ts) AS t FROM events),
n AS (SELECT user_id, id, min({'t': t, 'id': id}) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 43200000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM s),
a AS (SELECT user_id, arg_min(id, (t, id)) AS id FROM s GROUP BY 1 UNION ALL SELECT n.user_id, n.nxt.id FROM a JOIN n ON n.id = a.id WHERE n.nxt IS NOT NULL)
SELECT user_id, id AS event_id FROM a""")
def stream_freshness(s, d):
    """The freshness rule as keyed state: an event within twelve hours of the user's last accepted one is skipped."""
    return ST.run_to_end(ST.fresh(ST.event_stream(s, d)), "append")


@query("""WITH RECURSIVE s AS (SELECT listing_id, id, epoch_us(scraped_at) AS t FROM price_history WHERE scraped_at IS NOT NULL AND listing_id IS NOT NULL),
n AS (SELECT listing_id, id, min({'t': t, 'id': id}) OVER (PARTITION BY listing_id ORDER BY t RANGE BETWEEN 43200000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM s),
a AS (SELECT listing_id, arg_min(id, (t, id)) AS id FROM s GROUP BY 1 UNION ALL SELECT n.listing_id, n.nxt.id FROM a JOIN n ON n.id = a.id WHERE n.nxt IS NOT NULL)
SELECT listing_id, id FROM a""")
def freshness_skip(s, d):
    """Price rows accepted when a listing is written at most once in 12 hours after the last accepted one."""
    return ST.accepted(table(s, d, "price_history"))
