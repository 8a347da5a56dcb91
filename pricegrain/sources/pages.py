"""Extraction from captured pages, feeds and sitemaps: bytes and text that are already here; nothing is fetched."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import blank_null, feed_price, html_decode, url_join

# --- fixed values: where feeds and data layers keep a field, in order ---
FEED_ALIASES = {
    "product_id": ["product_id", "aw_product_id", "merchant_product_id", "id"],
    "name": ["product_name", "title", "name", "aw_product_name"],
    "description": ["description", "product_description", "aw_product_description"],
    "price": ["price", "search_price", "base_price", "aw_product_price"],
    "url": ["deep_link", "deeplink", "merchant_deep_link", "aw_deep_link", "product_url", "link"],
    "image_url": ["image_url", "merchant_image_url", "aw_image_url", "image", "img_url"],
    "brand": ["brand_name", "brand", "manufacturer", "aw_brand_name"],
    "ean": ["ean", "gtin", "upc", "barcode", "aw_ean"],
    "category": ["merchant_category", "category", "product_category", "aw_category"],
    "sku": ["merchant_product_id", "sku", "mpn", "model_number"],
    "currency": ["currency", "aw_currency"],
    "in_stock": ["in_stock", "stock_status", "availability"],
}
IN_STOCK = ["1", "true", "yes", "in stock", "instock", ""]
# --- end of fixed values ---


def read_csv_feed(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A feed with a header row, all columns text; a byte-order mark is dropped. Quoted fields may hold line ends."""
    return spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', quote='"')


def _inflated(bodies: pd.Series) -> pd.Series:
    """Bytes as text: gzip inflated, UTF-8 with replacement of what is none."""
    return bodies.map(lambda b: None if b is None else (gzip.decompress(b) if bytes(b[:2]) == b"\x1f\x8b" else bytes(b)).decode("utf-8", errors="replace"))


def inflate(body: Column) -> Column:
    return F.pandas_udf(_inflated, StringType())(body)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path and text of captured files (sitemaps, pages), gzip or not; a file is one row, as the web's limits keep them small."""
    return spark.read.format("binaryFile").load(path).select("path", inflate(F.col("content")).alias("text"))


def captured_pages(captures: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """url, fetched_at and text of the last capture of each URL that is at most `hours` old; captures have url, body, fetched_at."""
    age = F.unix_micros(now) - F.unix_micros("fetched_at")
    recent = captures.filter((age >= 0) & (age <= hours * 3_600_000_000))
    last = recent.groupBy("url").agg(F.max_by(F.struct("fetched_at", "body"), F.struct("fetched_at", F.sha2("body", 256))).alias("x"))
    return last.select("url", "x.fetched_at", inflate(F.col("x.body")).alias("text"))


def read_xml_feed(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Every <product> element at any depth as a row of text columns; tag names folded to lower case and `_`."""
    schema = ", ".join(f"`{f}` string" for f in fields)
    raw = spark.read.format("xml").option("rowTag", "product").schema(schema).load(path)
    return raw.select(*[F.col(f"`{f}`").alias(re.sub("[- ]", "_", f.lower())) for f in fields])


def normalise_feed(raw: DataFrame) -> DataFrame:
    """The twelve feed fields: each the first non-blank of its columns that exist; price as decimal; blank stock is in stock."""
    have = {c.lower(): c for c in raw.columns}
    pick = lambda names: F.coalesce(*[blank_null(F.col(f"`{have[n]}`")) for n in names if n in have], F.lit(None).cast("string"))
    out = {field: pick(names) for field, names in FEED_ALIASES.items()}
    out["price"] = feed_price(out["price"])
    out["currency"] = F.coalesce(out["currency"], F.lit("EUR"))
    out["in_stock"] = F.lower(F.coalesce(out["in_stock"], F.lit(""))).isin(IN_STOCK)
    return raw.select(*[c.alias(n) for n, c in out.items()])


def sitemap_locations(xml: Column, pattern: str = ".*") -> Column:
    """All <loc> values of a sitemap or sitemap index that match the pattern, whatever the namespace."""
    found = F.regexp_extract_all(F.regexp_replace(xml, r'\sxmlns="[^"]*"', ""), F.lit(r"(?s)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), 1)
    return F.filter(F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))), lambda u: u.rlike(pattern))


def sitemap_nodes(xml: Column) -> Column:
    """The same by a path over the parsed document, for well-formed sitemaps of any namespace."""
    return F.transform(F.xpath(xml, F.lit("//*[local-name()='loc']/text()")), lambda u: F.trim(u))


def sitemap_rows(df: DataFrame, xml: str, key: str, pattern: str = ".*") -> DataFrame:
    return df.select(key, F.explode(sitemap_locations(F.col(xml), pattern)).alias("url"))


def ld_scripts(page: Column) -> Column:
    """The bodies of all ld+json scripts, trailing `;` cut."""
    bodies = F.regexp_extract_all(page, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    return F.transform(bodies, lambda b: F.regexp_replace(F.trim(b), ";$", ""))


def ld_objects(df: DataFrame, page: str, kind: str) -> DataFrame:
    """Adds `v`: the first object of @type `kind` among the page's scripts (an object, a list or a @graph), as VARIANT.

    Invalid JSON is skipped; a page without such an object has v null.
    """
    parsed = df.withColumn("_all", F.filter(F.transform(ld_scripts(F.col(page)), lambda b: F.try_parse_json(b)), lambda v: v.isNotNull()))
    each = F.flatten(F.transform("_all", lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array(v))))
    of = F.filter(each, lambda v: F.try_variant_get(v, "$['@type']", "string") == kind)
    return parsed.withColumn("v", F.try_element_at(of, F.lit(1))).drop("_all")


def get(path: str, v: str | Column = "v") -> Column:
    return blank_null(F.try_variant_get(v, path, "string"))


def ld_product(v: str | Column = "v") -> dict[str, Column]:
    """The fields of a JSON-LD Product, with the shapes sources write them in."""
    digits = F.regexp_replace(F.coalesce(get("$.gtin13", v), get("$.gtin", v), F.substring(get("$.gtin14", v), 1, 13), F.regexp_extract(get("$.productID", v), r"^ean:(.*)$", 1)), "[^0-9]", "")
    mpn = get("$.mpn", v)
    return {
        "name": get("$.name", v),
        "sku": get("$.sku", v),
        "mpn": F.when(~mpn.rlike("^[0-9]{13}$"), mpn),
        "ean": F.coalesce(F.when(F.length(digits).isin(8, 13), digits), F.when(mpn.rlike("^[0-9]{13}$"), mpn)),
        "brand": F.coalesce(get("$.brand.name", v), F.when(~F.coalesce(get("$.brand", v), F.lit("")).startswith("{"), get("$.brand", v))),
        "image": F.coalesce(get("$.image.url", v), get("$.image[0]", v), F.when(~F.coalesce(get("$.image", v), F.lit("")).rlike(r"^[\[{]"), get("$.image", v))),
        "price": F.coalesce(get("$.offers.price", v), get("$.offers[0].price", v)).try_cast("decimal(12,2)"),
        "in_stock": F.coalesce(get("$.offers.availability", v), get("$.offers[0].availability", v)).endswith("InStock"),
    }


def ld_breadcrumb(v: str | Column = "v", drop: tuple[str, ...] = ("Accueil", "Home")) -> Column:
    names = F.transform(F.try_variant_get(v, "$.itemListElement", "array<variant>"), lambda x: F.coalesce(F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$.item.name", "string")))
    return F.filter(names, lambda n: n.isNotNull() & (F.trim(n) != "") & ~n.isin(list(drop)))


def ld_properties(v: str | Column = "v") -> Column:
    """additionalProperty as a map; of equal names the last."""
    items = F.try_variant_get(v, "$.additionalProperty", "array<variant>")
    pairs = F.transform(items, lambda x: F.struct(F.try_variant_get(x, "$.name", "string").alias("key"), F.try_variant_get(x, "$.value", "string").alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["key"].isNotNull()))


def ld_variants(df: DataFrame) -> DataFrame:
    """A ProductGroup in `v` as rows of its variants, which inherit name and brand; a group without variants is one row."""
    each = df.withColumn("_x", F.explode_outer(F.try_variant_get("v", "$.hasVariant", "array<variant>")))
    inherit = lambda p: F.coalesce(get(p, "_x"), get(p))
    return each.select(
        *[c for c in df.columns if c != "v"], inherit("$.sku").alias("sku"), inherit("$.name").alias("name"), inherit("$.gtin13").alias("ean"),
        F.coalesce(get("$.brand.name", "_x"), get("$.brand.name")).alias("brand"), get("$.url", "_x").alias("url"),
    )


def state_json(page: Column, variable: str) -> Column:
    """An inline JavaScript object literal as VARIANT: keys quoted, !0/!1, single quotes, trailing commas and undefined mended."""
    body = F.regexp_extract(page, rf"(?s){variable}\s*=\s*(\{{.*?\}});", 1)
    steps = [(r"\bundefined\b", "null"), ("!0", "true"), ("!1", "false"), (r"'([^'\\]*)'", '"$1"'), (r"([{,]\s*)([A-Za-z_$][\w$]*)\s*:", '$1"$2":'), (r",\s*([}\]])", "$1")]
    for pattern, to in steps:
        body = F.regexp_replace(body, pattern, to)
    return F.try_parse_json(body)


def next_data(page: Column) -> Column:
    return F.try_parse_json(F.nullif(F.regexp_extract(page, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit("")))


def data_layer_items(df: DataFrame, layer: str) -> DataFrame:
    """Rows of a data layer's impressions, items or product list; fields under either of their names."""
    v = F.try_parse_json(F.col(layer))
    arrays = [F.try_variant_get(v, p, "array<variant>") for p in ("$.ecommerce.impressions", "$.ecommerce.items", "$.productListItems")]
    each = df.withColumn("_x", F.explode(F.coalesce(*arrays)))
    return each.select(
        *[c for c in df.columns if c != layer], F.coalesce(get("$.id", "_x"), get("$.item_id", "_x")).alias("sku"),
        F.coalesce(get("$.name", "_x"), get("$.item_name", "_x")).alias("name"), get("$.price", "_x").try_cast("decimal(12,2)").alias("price"),
    )


def suggest_rows(df: DataFrame, response: str) -> DataFrame:
    """Rows of compressedProducts of a suggest answer."""
    schema = "compressedProducts array<struct<label:string,value:string,image:string>>, numberOfFoundProducts int"
    r = df.withColumn("_r", F.from_json(response, schema))
    return r.withColumn("_x", F.explode("_r.compressedProducts")).select(*[c for c in df.columns if c != response], "_x.label", "_x.value", F.col("_r.numberOfFoundProducts").alias("found"))


def microdata(page: Column, prop: str) -> Column:
    """The content attribute of an itemprop, else the text of its element."""
    content = F.regexp_extract(page, rf'(?is)itemprop="{prop}"[^>]*content="([^"]*)"', 1)
    return html_decode(F.coalesce(blank_null(content), blank_null(F.regexp_extract(page, rf'(?is)itemprop="{prop}"[^>]*>([^<]*)<', 1))))


def meta(page: Column, name: str) -> Column:
    """og: or named meta tags, attributes in either order."""
    one = F.regexp_extract(page, rf'(?is)<meta[^>]*(?:property|name)="{name}"[^>]*content="([^"]*)"', 1)
    return html_decode(F.coalesce(blank_null(one), blank_null(F.regexp_extract(page, rf'(?is)<meta[^>]*content="([^"]*)"[^>]*(?:property|name)="{name}"', 1))))


def heading(page: Column, tag: str) -> Column:
    return html_decode(blank_null(F.regexp_replace(F.regexp_extract(page, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", " ")))


def links(page: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(page, F.lit(r'(?is)<a[^>]*href="([^"#]+)"'), 1))


# --- fixed values: last resorts and labels in the text of a page ---
LAST_RESORT = {"price": r'"price"\s*:\s*"?([0-9.]+)"?', "name": r'"name"\s*:\s*"([^"]+)"', "sku": r'"sku"\s*:\s*"([^"]+)"'}
PAGE_LABELS = {"maker_ref": r"Fabricant\s*:\s*(\S+)", "article": r"Art\.\s*N[°o]\s*([0-9\s]+[0-9])", "ref": r"R[ée]f\.?\s*([0-9]+)", "ean": r"(?:EAN|GTIN)\s*:?\s*([0-9]{13})"}
PAGES_OF, PAGES_TOTAL = r"categoryFilter:\s*'([0-9a-f-]{36})'", r"totalPages:\s*([0-9]+)"
# --- end of fixed values ---


def last_resort(page: Column) -> dict[str, Column]:
    """name, sku and price found anywhere in the raw page; all null without a name and a price above 0."""
    name, sku, price = (F.nullif(F.regexp_extract(page, LAST_RESORT[k], 1), F.lit("")) for k in ("name", "sku", "price"))
    number = price.try_cast("decimal(12,2)")
    good = name.isNotNull() & (number > 0)
    return {"name": F.when(good, name), "sku": F.when(good, sku), "price": F.when(good, number)}


def page_label(text: Column, which: str) -> Column:
    """What stands behind a label of a page's text; brackets around a maker's reference are cut, spaces inside an article number."""
    found = F.nullif(F.regexp_extract(text, PAGE_LABELS[which], 1), F.lit(""))
    if which == "maker_ref":
        return F.regexp_replace(found, r"^[\[\](){}]+|[\[\](){}]+$", "")
    return F.replace(found, F.lit(" "), F.lit("")) if which == "article" else found


def further_pages(df: DataFrame, page: str, address: str) -> DataFrame:
    """A row for each page of a listing page from the second on, as `url`: `address` with {filter} and {page} replaced."""
    name, total = F.regexp_extract(page, PAGES_OF, 1), F.regexp_extract(page, PAGES_TOTAL, 1).try_cast("int")
    known = df.withColumn("_n", F.when(name != "", total)).filter("_n > 1")
    each = known.withColumn("_p", F.explode(F.sequence(F.lit(2), "_n")))
    url = F.replace(F.replace(F.lit(address), F.lit("{filter}"), name), F.lit("{page}"), F.col("_p").cast("string"))
    return each.withColumn("url", url).drop("_n", "_p", page)


@dataclass(frozen=True)
class UrlRule:
    """Shape of the URLs of one source that are wanted: end, number of slashes, figures, and parts that must not be in it."""

    ends: str = ""
    not_ends: str = ""
    least_slashes: int = 0
    most_slashes: int = 1_000
    figures: int = 0  # so many figures in a row
    without: tuple[str, ...] = ()

    def fits(self, url: Column) -> Column:
        slashes = F.size(F.split(url, "/")) - 1
        ok = url.endswith(self.ends) & (slashes >= self.least_slashes) & (slashes <= self.most_slashes)
        ok = ok & url.rlike(f"[0-9]{{{self.figures},}}") if self.figures else ok
        ok = ok & ~url.endswith(self.not_ends) if self.not_ends else ok
        for part in self.without:
            ok = ok & ~F.contains(url, F.lit(part))
        return ok


def subcategories(df: DataFrame, url: str, page: str, rule: UrlRule) -> DataFrame:
    """The links of a page, joined to its URL, that lead to another page of the wanted shape, each once."""
    links_ = df.select(F.col(url), F.explode(links(F.col(page))).alias("_l")).withColumn("link", url_join(F.col(url), F.col("_l")))
    other = F.regexp_replace("link", "/+$", "") != F.regexp_replace(url, "/+$", "")
    return links_.filter(rule.fits(F.col("link")) & other).select(url, "link").distinct()


class _Cards(HTMLParser):
    """Cards: elements whose class names the card; in them the text of elements whose class names a field."""

    def __init__(self, card: str, fields: dict[str, str]):
        super().__init__()
        self.card, self.fields = card, fields
        self.rows: list[dict] = []
        self.stack: list[tuple[str, str | None, bool]] = []

    def handle_starttag(self, tag, attrs):
        names = (dict(attrs).get("class") or "").split()
        opens = self.card in names
        if opens:
            self.rows.append({})
        which = next((f for f, c in self.fields.items() if c in names), None)
        if tag not in ("br", "img", "input", "meta", "link", "hr"):
            self.stack.append((tag, which, opens))

    def handle_endtag(self, tag):
        while self.stack:
            if self.stack.pop()[0] == tag:
                break

    def handle_data(self, data):
        if self.rows and any(o for _, _, o in self.stack):
            which = next((w for _, w, _ in reversed(self.stack) if w), None)
            if which and data.strip():
                self.rows[-1][which] = (self.rows[-1].get(which, "") + " " + data.strip()).strip()


def html_cards(df: DataFrame, key: str, page: str, card: str, fields: dict[str, str]) -> DataFrame:
    """One row for each card of a page, fields by class name; pages are parsed in Arrow batches."""
    kind = df.schema[key].dataType.simpleString()
    names = list(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key].tolist(), batch[page].tolist(), strict=True):
                parser = _Cards(card, fields)
                parser.feed(text or "")
                out += [[k, i, *(r.get(f) for f in names)] for i, r in enumerate(parser.rows)]
            yield pd.DataFrame(out, columns=[key, "card", *names])

    return df.select(key, page).mapInPandas(run, f"{key} {kind}, card int, " + ", ".join(f"{f} string" for f in names))


def validate(items: DataFrame) -> DataFrame:
    """Adds price (decimal or null), unit_price and reject_reason (null for accepted items): name, price or chain missing or out of range."""
    price = F.col("price").try_cast("double")
    reason = (
        F.when(blank_null(F.col("product_name")).isNull(), "no name").when(F.col("price").isNull(), "no price").when(price.isNull(), "price is no number")
        .when(F.isnan(price) | (price <= 0), "price not above 0").when(price > 100000, "price above 100000").when(blank_null(F.col("store_chain")).isNull(), "no chain")
    )
    return items.withColumn("reject_reason", reason).withColumn("unit_price", F.col("unit_price").try_cast("decimal(12,2)")).withColumn("price", price.try_cast("decimal(12,2)"))
