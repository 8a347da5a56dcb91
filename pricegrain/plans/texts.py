"""Queries of the text functions, specifications, linkage by name, categories, slugs and brands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import specs as S
from ..functions import text as T
from ..operators import linkage as L
from ..session import table
from ..sources.pages import UrlRule
from .registry import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql

_REPLACED = "lower(trim({c}))"
for _sign, _text in T.LIGATURES:
    _REPLACED = f"replace({_REPLACED}, '{_sign.replace(chr(39), chr(39) * 2)}', '{_text.replace(chr(39), chr(39) * 2)}')"
_PLAIN = f"translate({_REPLACED}, '{T.ACCENTED}', '{T.PLAIN}')"
_FILLERS = "[" + ", ".join(f"'{w}'" for w in T.FILLERS) + "]"


def _canonical(c: str) -> str:
    words = f"array_to_string(list_filter(string_split_regex(trim({_PLAIN.format(c=c)}), '\\s+'), lambda w: NOT list_contains({_FILLERS}, w)), ' ')"
    return f"coalesce(trim(regexp_replace(regexp_replace({words}, '[^a-zA-Z0-9_\\s.,/]', ' ', 'g'), '\\s+', ' ', 'g')), '')"


@query(f"SELECT id, {_canonical('name')} AS canonical FROM products")
def canonical_name(s, d):
    return table(s, d, "products").select("id", T.canonical_name(F.col("name")).alias("canonical"))


@query(f"SELECT id, array_to_string(string_split({_canonical('name')}, ' ')[1:2], ' ') AS block FROM products")
def block_key(s, d):
    return table(s, d, "products").select("id", T.block_key(F.col("name")).alias("block"))


_ENTITIES = [("&eacute;", "é"), ("&egrave;", "è"), ("&agrave;", "à"), ("&acirc;", "â"), ("&ecirc;", "ê"), ("&icirc;", "î"), ("&ocirc;", "ô"), ("&ucirc;", "û"), ("&ccedil;", "ç"), ("&Eacute;", "É"), ("&Agrave;", "À"), ("&deg;", "°"), ("&sup2;", "²"), ("&times;", "×"), ("&Oslash;", "Ø"), ("&oslash;", "ø"), ("&reg;", "®"), ("&nbsp;", " "), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
_DECODED = "store_product_name"
for _sign, _text in _ENTITIES:
    _DECODED = f"replace({_DECODED}, '{_sign.replace(chr(39), chr(39) * 2)}', '{_text.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT id, {_DECODED} AS name FROM store_listings")
def html_decode(s, d):
    return table(s, d, "store_listings").select("id", T.html_decode("store_product_name").alias("name"))


@query(f"SELECT id, trim(regexp_replace({_DECODED}, '[\\s   　]+', ' ', 'g')) AS name FROM store_listings")
def clean_name(s, d):
    return table(s, d, "store_listings").select("id", T.collapse(T.html_decode("store_product_name")).alias("name"))


@query("SELECT id, CASE WHEN length(regexp_replace(store_ean, '[^0-9]', '', 'g')) = 13 THEN regexp_replace(store_ean, '[^0-9]', '', 'g') END AS ean FROM store_listings")
def clean_ean(s, d):
    return table(s, d, "store_listings").select("id", T.clean_ean(F.col("store_ean")).alias("ean"))


@query("""SELECT id, CASE WHEN brand IS NOT NULL THEN coalesce(array_to_string(list_transform(regexp_extract_all(brand, '\\p{L}+|[^\\p{L}]+'), lambda r: upper(r[1:1]) || lower(r[2:])), ''), '') END AS brand FROM products""")
def title_case(s, d):
    return table(s, d, "products").select("id", T.title_case(F.col("brand")).alias("brand"))


@query("SELECT id, array_to_string(list_transform(string_split(category_path, '>'), lambda x: trim(x)), ' > ') AS path, CAST(len(string_split(category_path, '>')) AS INT) AS levels FROM store_listings WHERE category_path IS NOT NULL")
def category_path(s, d):
    parts = T.path_parts(F.col("category_path"))
    return table(s, d, "store_listings").filter("category_path is not null").select("id", F.array_join(parts, " > ").alias("path"), F.size(parts).alias("levels"))


_SLUG = "substr(regexp_replace(regexp_replace(trim(regexp_replace(translate(lower(name), '" + T.ACCENTED + "', '" + T.PLAIN + "'), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 200)"


@query(f"SELECT id, {_SLUG} AS slug FROM products")
def slug_base(s, d):
    return table(s, d, "products").select("id", T.slug_base(F.col("name")).alias("slug"))


@query(None)
def slugs(s, d):
    """A unique slug for every product, numbered on where the plain one is taken; smaller ids first."""
    return L.assign_slugs(table(s, d, "products").select("id", "name"))


_HTML = "'<div><p>' || coalesce(description, '') || '</p><br/><b>' || coalesce(brand, '') || '</b></div>'"


@query(f"SELECT id, substr(trim(regexp_replace(regexp_replace({_HTML}, '<[^>]*>', ' ', 'g'), '[\\s  ]+', ' ', 'g')), 1, 500) AS plain FROM products")
def strip_tags(s, d):
    page = F.concat(F.lit("<div><p>"), F.coalesce("description", F.lit("")), F.lit("</p><br/><b>"), F.coalesce("brand", F.lit("")), F.lit("</b></div>"))
    return table(s, d, "products").select("id", T.strip_tags(page).alias("plain"))


_BRAND_CASE = "CASE " + " ".join(f"WHEN contains(lower(name), '{b}') THEN '{b.title()}'" for b in T.BRANDS) + " END"


@query(f"SELECT id, {_BRAND_CASE} AS brand FROM products WHERE brand IS NULL")
def extract_brand(s, d):
    """The first brand of the whole list in the name of each product without one."""
    return table(s, d, "products").filter("brand is null").select("id", T.extract_brand(F.col("name")).alias("brand"))


@query(f"SELECT id, {_BRAND_CASE.replace('lower(name)', 'lower(l)')} AS brand FROM (SELECT id, name || ' ' || [{', '.join(repr(b) for b in T.BRANDS)}][CAST(id % {len(T.BRANDS)} AS INT) + 1] AS l FROM products)")
def extract_brand_known(s, d):
    """The same on names that all hold a brand of the list, each in turn."""
    names = F.concat("name", F.lit(" "), F.element_at(F.array(*[F.lit(b) for b in T.BRANDS]), (F.col("id") % len(T.BRANDS)).cast("int") + 1))
    return table(s, d, "products").select("id", T.extract_brand(names).alias("brand"))


_PRICE = "CASE id % 4 WHEN 0 THEN replace(CAST(current_price AS VARCHAR), '.', ',') || ' €' WHEN 1 THEN '1 ' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') || ',50 €' WHEN 2 THEN '1.' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') || ',5' ELSE CAST(current_price AS VARCHAR) || ' € TTC' END"


def _price_text():
    padded = F.lpad((F.col("id") % 1000).cast("string"), 3, "0")
    plain = F.col("current_price").cast("string")
    return (
        F.when(F.col("id") % 4 == 0, F.concat(F.replace(plain, F.lit("."), F.lit(",")), F.lit(" €"))).when(F.col("id") % 4 == 1, F.concat(F.lit("1 "), padded, F.lit(",50 €")))
        .when(F.col("id") % 4 == 2, F.concat(F.lit("1."), padded, F.lit(",5"))).otherwise(F.concat(plain, F.lit(" € TTC")))
    )


@query(f"""SELECT id, CASE WHEN regexp_full_match(x, '-?[0-9]+(\\.[0-9]+)?') THEN CAST(round(TRY_CAST(x AS DECIMAL(18,6)), 2) AS DECIMAL(12,2)) END AS price FROM (
SELECT id, replace(regexp_replace(regexp_replace({_PRICE}, '[€$\\s]', '', 'g'), '\\.([0-9]{{3}}([^0-9]|$))', '\\1', 'g'), ',', '.') AS x FROM store_listings)""")
def parse_price(s, d):
    return table(s, d, "store_listings").select("id", T.parse_price(_price_text()).alias("price"))


@query(f"""SELECT id, CASE WHEN regexp_full_match(x, '[0-9]+(\\.[0-9]+)?') THEN CAST(TRY_CAST(x AS DECIMAL(18,6)) AS DECIMAL(12,2)) END AS price FROM (SELECT id, replace(regexp_replace({_PRICE}, '[^0-9.,]', '', 'g'), ',', '.') AS x FROM store_listings)""")
def feed_price(s, d):
    return table(s, d, "store_listings").select("id", T.feed_price(_price_text()).alias("price"))


@query("""SELECT id, TRY_CAST(replace(nullif(regexp_extract('Prix : ' || CAST(current_price AS VARCHAR) || ' € H.T. soit ' || CAST(old_price AS VARCHAR) || ' €', '([0-9]+(?:[.,][0-9]+)?)\\s*€\\s*H\\.?T', 1), ''), ',', '.') AS DECIMAL(12,2)) AS price FROM store_listings""")
def ht_price(s, d):
    text = F.concat(F.lit("Prix : "), F.col("current_price").cast("string"), F.lit(" € H.T. soit "), F.col("old_price").cast("string"), F.lit(" €"))
    return table(s, d, "store_listings").select("id", T.ht_price(text).alias("price"))


@query("""SELECT id, CAST(CAST(floor(abs(current_price)) AS BIGINT) || '.' || right(CAST(current_price AS VARCHAR), 2) AS DECIMAL(12,2)) AS price FROM store_listings""")
def split_price(s, d):
    text = F.concat(F.floor(F.abs("current_price")).cast("string"), F.lit(" € "), F.right(F.col("current_price").cast("string"), F.lit(2)))
    return table(s, d, "store_listings").select("id", T.split_price(text).alias("price"))


@query("SELECT id, CASE WHEN in_stock AND id % 7 <> 0 AND old_price > current_price THEN old_price END AS old_price FROM store_listings")
def old_price(s, d):
    """The price before: only if both flags to show it are set and it is above the price (here stock and the id stand for the flags)."""
    rows = table(s, d, "store_listings")
    return rows.select("id", T.old_price(F.col("old_price"), F.col("current_price"), F.col("in_stock"), F.col("id") % 7 != 0).alias("old_price"))


_PATH = "regexp_replace(regexp_replace(store_product_url, '[?#].*$', ''), '/$', '')"


@query(f"""SELECT id, array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_extract({_PATH}, '([^/]+)$', 1), '\\.html?$', ''), '-p?[0-9]{{7,10}}$', ''), '-'), lambda w: CASE WHEN length(w) > 2 THEN upper(w[1:1]) || w[2:] ELSE w END), ' ') AS name FROM store_listings WHERE store_product_url IS NOT NULL""")
def url_product(s, d):
    return table(s, d, "store_listings").filter("store_product_url is not null").select("id", T.url_name(F.col("store_product_url")).alias("name"))


@query("""SELECT id, CASE WHEN len(p) < 2 THEN '' ELSE coalesce(array_to_string(list_transform(p[1:len(p) - 1], lambda x: array_to_string(list_transform(regexp_extract_all(replace(x, '-', ' '), '\\p{L}+|[^\\p{L}]+'), lambda r: upper(r[1:1]) || lower(r[2:])), '')), ' > '), '') END AS category FROM (
SELECT id, list_filter(string_split(regexp_replace(regexp_replace(store_product_url, '^https?://[^/]+/?|[?#].*$', '', 'g'), '/$', ''), '/'), lambda x: x <> '') AS p FROM store_listings WHERE store_product_url IS NOT NULL)""")
def url_category(s, d):
    return table(s, d, "store_listings").filter("store_product_url is not null").select("id", T.url_category(F.col("store_product_url")).alias("category"))


@query("""SELECT id, coalesce(nullif(trim(store_sku), ''), nullif(regexp_extract(store_product_url, '-p?([0-9]+)/?(?:\\.html)?(?:\\?.*)?$', 1), ''), right(store_product_url, 50), 'unknown') AS sku FROM store_listings""")
def sku_fallback(s, d):
    return table(s, d, "store_listings").select("id", T.sku_fallback(F.col("store_sku"), F.col("store_product_url")).alias("sku"))


@query("SELECT id, store_product_url || CASE WHEN contains(store_product_url, '?') THEN '&' ELSE '?' END || 'ref=feed' AS url FROM store_listings WHERE store_product_url IS NOT NULL")
def url_param(s, d):
    return table(s, d, "store_listings").filter("store_product_url is not null").select("id", T.add_param(F.col("store_product_url"), "ref", "feed").alias("url"))


@query("""SELECT l.id, CASE WHEN regexp_matches(image_url, '^https?://') THEN image_url WHEN starts_with(image_url, '//') THEN 'https:' || image_url WHEN starts_with(image_url, '/') THEN regexp_extract(store_product_url, '^(https?://[^/]+)', 1) || image_url
ELSE regexp_replace(store_product_url, '[^/]*$', '') || image_url END AS url FROM store_listings l WHERE image_url IS NOT NULL AND store_product_url IS NOT NULL""")
def url_join(s, d):
    rows = table(s, d, "store_listings").filter("image_url is not null and store_product_url is not null")
    return rows.select("id", T.url_join(F.col("store_product_url"), F.col("image_url")).alias("url"))


_KEYS = ["peinture", "perceuse", "vis", "cheville", "silicone", "carrelage", "disque", "cable"]


@query("SELECT id, store_product_url FROM store_listings WHERE regexp_matches(store_product_url, '" + "|".join(_KEYS) + "')")
def url_keyword_filter(s, d):
    return table(s, d, "store_listings").filter(F.col("store_product_url").rlike("|".join(_KEYS))).select("id", "store_product_url")


@query("""SELECT id, ends_with(u, '.html') AS page, ends_with(u, '.html') AND slashes = 3 AND regexp_matches(u, '[0-9]{4,}') AS flat, NOT ends_with(u, '.html') AND slashes >= 4 AND NOT contains(u, '/blog/') AND NOT contains(u, '?') AS shop
FROM (SELECT id, store_product_url AS u, len(string_split(store_product_url, '/')) - 1 AS slashes FROM store_listings WHERE store_product_url IS NOT NULL)""")
def url_shape(s, d):
    """URLs against the shapes that three sources ask for."""
    rules = {"page": UrlRule(ends=".html"), "flat": UrlRule(ends=".html", least_slashes=3, most_slashes=3, figures=4), "shop": UrlRule(not_ends=".html", least_slashes=4, without=("/blog/", "?"))}
    rows = table(s, d, "store_listings").filter("store_product_url is not null")
    return rows.select("id", *[r.fits(F.col("store_product_url")).alias(n) for n, r in rules.items()])


# --- specifications ---

#: What names are made longer by in turn, so that every field occurs.
_EXTRA = [
    "ép. 12 mm Long. 2,5 m grain 120", "Mandrin de 13 mm 1500 tr/min couple 60 Nm", "CLÉ de 12 mm lame 48 Dents", "Charge 150 KG 7 Marches 8 bars", "câble 2,5 mm² IP44 16 A",
    'embout PH2 Torx T20 carré 1/2"', "scie sauteuse sans fil 18V 4Ah", "PINCE COUPANTE à cliquet", "foret béton SDS-Plus", "disque diamant Ø 125 mm acier inoxydable blanc cassé mate lot de 10",
    "trépan percussions Brushless 2,5 kg", "filaire pneumatique 750 g 0,75 l 60 x 40 cm",
]


def _spec_names(s, d):
    extra = F.element_at(F.array(*[F.lit(x) for x in _EXTRA]), (F.col("id") % len(_EXTRA)).cast("int") + 1)
    return table(s, d, "products").select("id", F.concat("name", F.lit(" "), extra).alias("name"))


_SPEC_NAMES = "(SELECT id, name || ' ' || [" + ", ".join(f"'{x}'" for x in _EXTRA) + f"][CAST(id % {len(_EXTRA)} AS INT) + 1] AS name FROM products)"


def _re(pattern: str, ignore: bool, n: str = "name", group: int = 0) -> str:
    return f"nullif(trim(regexp_extract({n}, '{pattern.replace(chr(39), chr(39) * 2)}', {group}{', ' + chr(39) + 'i' + chr(39) if ignore else ''})), '')"


def _terms(terms: list[str], n: str) -> str:
    padded = f"' ' || regexp_replace(lower({n}), '[^0-9a-zà-öø-ÿœ_]', ' ', 'g') || ' '"
    words = ", ".join(f"'{t}'" for t in terms)
    return f"list_filter([{words}], lambda t: contains({padded}, ' ' || t || ' '))[1]"


def field_sql(which: str, n: str = "name") -> str:
    """SQL of functions.specs.field."""
    if which == "length":  # RE2 takes the end of ASCII letters for the end of a word: 50 mètres is no 50 m
        return _re("(" + S.PATTERNS[which][0].removesuffix("\\b") + ")(?:$|[^\\p{L}\\p{N}_])", False, n, 1)
    if which in S.PATTERNS:
        return _re(*S.PATTERNS[which], f"lower({n})" if which in S.SMALL else n)
    if which == "weight":
        return f"coalesce({_re(S.WEIGHT_KG, True, n)}, {_re(S.WEIGHT_G, False, n)})"
    if which == "power":
        found = _re(S.POWER, False, n, 1)
        return f"CASE WHEN TRY_CAST(regexp_extract({found}, '^[0-9]+', 0) AS INT) >= 10 THEN {found} END"
    if which == "amperage":
        return f"CASE WHEN {_re(*S.PATTERNS['battery'], n)} IS NULL THEN {_re(S.AMPERAGE, False, n)} END"
    if which in ("color", "material"):
        return _terms(S.longest_first(S.COLORS if which == "color" else S.MATERIALS), n)
    if which == "finish":
        term = _terms(S.FINISHES, n)
        return f"CASE {term} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.FINISH_NAMES.items()) + f" ELSE {term} END"
    edge = "[^\\p{L}\\p{N}_]"
    test = (lambda p: f"regexp_matches(lower({n}), '(^|{edge}){p}($|{edge})')") if which == "tool_type" else (lambda p: f"contains(lower({n}), '{p}')")
    return "CASE " + " ".join(f"WHEN {test(p)} THEN '{v}'" for p, v in S.LABELS[which]) + " END"


def _fields_sql(fields: list[str]) -> str:
    return "SELECT id, " + ", ".join(f"{field_sql(f)} AS {f}" for f in fields) + f" FROM {_SPEC_NAMES}"


@query(_fields_sql(list(S.PATTERNS)))
def specs_patterns(s, d):
    return _spec_names(s, d).select("id", *[S.field(F.col("name"), f).alias(f) for f in S.PATTERNS])


@query(_fields_sql(["weight", "power", "amperage"]))
def specs_power(s, d):
    return _spec_names(s, d).select("id", *[S.field(F.col("name"), f).alias(f) for f in ("weight", "power", "amperage")])


@query(_fields_sql(["color", "material", "finish"]))
def specs_terms(s, d):
    return _spec_names(s, d).select("id", *[S.field(F.col("name"), f).alias(f) for f in ("color", "material", "finish")])


@query(_fields_sql(list(S.LABELS)))
def specs_labels(s, d):
    return _spec_names(s, d).select("id", *[S.field(F.col("name"), f).alias(f) for f in S.LABELS])


@query(f"SELECT id, {field_sql('color', 'store_product_name')} AS color FROM store_listings")
def single_color(s, d):
    """The one colour a listing's name is compared by."""
    return table(s, d, "store_listings").select("id", S.field(F.col("store_product_name"), "color").alias("color"))


@query(None)
def specs_map(s, d):
    """All fields of a name as JSON; what the source's own specifications say wins."""
    given = F.from_json("specifications", "map<string,string>")
    return table(s, d, "products").select("id", F.to_json(S.specs(F.col("name"), given)).alias("specs"))


@query("""SELECT id, TRY_CAST(replace(nullif(regexp_extract(name, '([0-9]+(?:[.,][0-9]+)?)\\s*x\\s*([0-9]+(?:[.,][0-9]+)?)\\s*(?:x\\s*([0-9]+(?:[.,][0-9]+)?)\\s*)?(?:mm|cm|m)\\b', 1, 'i'), ''), ',', '.') AS DOUBLE) AS length,
TRY_CAST(replace(nullif(regexp_extract(name, '([0-9]+(?:[.,][0-9]+)?)\\s*x\\s*([0-9]+(?:[.,][0-9]+)?)\\s*(?:x\\s*([0-9]+(?:[.,][0-9]+)?)\\s*)?(?:mm|cm|m)\\b', 2, 'i'), ''), ',', '.') AS DOUBLE) AS width,
TRY_CAST(replace(nullif(regexp_extract(name, '([0-9]+(?:[.,][0-9]+)?)\\s*x\\s*([0-9]+(?:[.,][0-9]+)?)\\s*(?:x\\s*([0-9]+(?:[.,][0-9]+)?)\\s*)?(?:mm|cm|m)\\b', 3, 'i'), ''), ',', '.') AS DOUBLE) AS height,
TRY_CAST(replace(nullif(regexp_extract(name, '(?:ø|diam(?:etre)?\\.?\\s*)([0-9]+(?:[.,][0-9]+)?)\\s*(?:mm|cm)?\\b', 1, 'i'), ''), ',', '.') AS DOUBLE) AS diameter,
TRY_CAST(replace(nullif(regexp_extract(name, '(?:ep\\.?|epaisseur)\\s*([0-9]+(?:[.,][0-9]+)?)\\s*(?:mm|cm)?\\b', 1, 'i'), ''), ',', '.') AS DOUBLE) AS thickness FROM (SELECT id, name || CASE id % 3 WHEN 0 THEN ' Ø12,5 mm EP. 3 mm' WHEN 1 THEN ' diam 40 epaisseur 1.5cm' ELSE '' END AS name FROM products)""")
def dims_struct(s, d):
    number = r"([0-9]+(?:[.,][0-9]+)?)"
    sides = rf"(?iu){number}\s*x\s*{number}\s*(?:x\s*{number}\s*)?(?:mm|cm|m)\b"
    part = lambda p, g: F.replace(F.nullif(F.regexp_extract("name", p, g), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    more = F.when(F.col("id") % 3 == 0, " Ø12,5 mm EP. 3 mm").when(F.col("id") % 3 == 1, " diam 40 epaisseur 1.5cm").otherwise("")
    return table(s, d, "products").select("id", F.concat("name", more).alias("name")).select(
        "id", *[part(sides, g).alias(n) for g, n in enumerate(("length", "width", "height"), 1)],
        part(rf"(?iu)(?:ø|diam(?:etre)?\.?\s*){number}\s*(?:mm|cm)?\b", 1).alias("diameter"), part(rf"(?iu)(?:ep\.?|epaisseur)\s*{number}\s*(?:mm|cm)?\b", 1).alias("thickness"),
    )


@query("""SELECT id, TRY_CAST(replace(nullif(regexp_extract(name, '([0-9]+(?:[.,][0-9]+)?)\\s*kg\\b', 1, 'i'), ''), ',', '.') AS DOUBLE) AS weight_kg, TRY_CAST(replace(nullif(regexp_extract(name, '([0-9]+(?:[.,][0-9]+)?)\\s*(?:l|litres?)(?:[^0-9A-Za-zÀ-ÿ_]|$)', 1, 'i'), ''), ',', '.') AS DOUBLE) AS volume_l,
TRY_CAST(replace(nullif(regexp_extract(name, '([0-9]+(?:[.,][0-9]+)?)\\s*(?:m|metres?)(?:[^0-9A-Za-zÀ-ÿ_]|$)', 1, 'i'), ''), ',', '.') AS DOUBLE) AS length_m FROM products""")
def volume_weight(s, d):
    part = lambda p: F.replace(F.nullif(F.regexp_extract("name", r"(?iu)([0-9]+(?:[.,][0-9]+)?)\s*" + p + r"\b", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return table(s, d, "products").select("id", part("kg").alias("weight_kg"), part("(?:l|litres?)").alias("volume_l"), part("(?:m|metres?)").alias("length_m"))


def backfilled(products):
    """id, the found specs as JSON and the six columns they fill of products without specifications.

    A column that is null or empty takes the found value; specifications stay null where nothing was found.
    """
    rows = products.filter("specifications is null").withColumn("found", S.specs(F.col("name")))
    filled = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.try_element_at("found", F.lit(c)), F.col(c)).alias(c) for c in BACKFILLED]
    return rows.select("id", F.when(F.size("found") > 0, F.to_json("found")).alias("specifications"), *filled)


BACKFILLED = ("color", "volume", "weight", "dimensions", "finish", "pack_size")


@query("SELECT id, coalesce(" + ", ".join(field_sql(f) for f in S.FIELDS) + ") IS NOT NULL AS has_specs, " + ", ".join(f"coalesce(nullif({c}, ''), {field_sql(c)}, {c}) AS {c}" for c in BACKFILLED) + " FROM products WHERE specifications IS NULL")
def spec_backfill(s, d):
    """Products without specifications: whether their name gives any, and the six columns after filling the empty ones."""
    return backfilled(table(s, d, "products")).select("id", F.col("specifications").isNotNull().alias("has_specs"), *BACKFILLED)


@query(None)
def spec_backfill_json(s, d):
    """The specifications themselves, as JSON."""
    return backfilled(table(s, d, "products")).select("id", "specifications")


# --- linkage by name, categories ---



@query(None)
def fuzzy_candidates(s, d):
    """Unlinked listings and products of one block with compatible fields and their score, from 85 on."""
    return L.candidates(table(s, d, "store_listings"), table(s, d, "products"))


@query(None)
def fuzzy_top1(s, d):
    best = F.row_number().over(Window.partitionBy("listing_id").orderBy(F.desc("score"), "product_id"))
    return L.candidates(table(s, d, "store_listings"), table(s, d, "products")).withColumn("k", best).filter("k = 1").drop("k")


@query(None)
def match_fuzzy(s, d):
    """Greedy linkage: a listing takes the best product of its block, else becomes a product later ones can take."""
    return L.greedy(table(s, d, "store_listings"), table(s, d, "products"))


@query("""WITH RECURSIVE n AS (SELECT id, list_sort(string_split_regex(trim(lower(name)), '\\s+')) AS x, list_sort(string_split_regex(trim(lower(canonical_name)), '\\s+')) AS y FROM products WHERE name IS NOT NULL AND canonical_name IS NOT NULL),
t AS (SELECT id, string_split(array_to_string(x, ' '), '') AS a, string_split(array_to_string(y, ' '), '') AS b FROM n),
r AS (SELECT id, a, b, 1 AS i, list_transform(range(len(b) + 1), lambda j: CAST(0 AS BIGINT)) AS line FROM t
UNION ALL SELECT id, a, b, i + 1, list_prepend(CAST(0 AS BIGINT), list_transform(range(1, len(b) + 1), lambda j: greatest(line[j + 1], list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN b[k] = a[i] THEN line[k] + 1 ELSE 0 END))))) FROM r WHERE i <= len(a))
SELECT id, round(200.0 * line[len(b) + 1] / (len(a) + len(b)), 4) AS score FROM r WHERE i = len(a) + 1""")
def token_sort_ratio(s, d):
    """Score of each product's name against its canonical name.

    By bit rows in Arrow batches: the same in array functions of the JVM takes a hundred times as long (102 s against
    under 1 s for 8,000 names), for they copy the row of the table for each letter.
    """
    rows = table(s, d, "products").filter("name is not null and canonical_name is not null")
    return rows.select("id", F.round(L.ratio(F.lower("name"), F.lower("canonical_name")), 4).alias("score"))
