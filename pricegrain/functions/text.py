"""Text, identifier, URL and price functions: Column -> Column."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values: letters, filler words, brands and header words ---
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
LIGATURES = [("œ", "oe"), ("æ", "ae"), ("ß", "ss"), ("²", "2"), ("³", "3"), ("×", "x"), ("ø", "o"), ("€", "EUR"), ("°", "deg"), ("½", " 1/2"), ("¼", " 1/4"), ("’", "'"), ("–", "-"), ("—", "--"), ("®", "(r)"), (" ", " ")]
FILLERS = ["le", "la", "les", "de", "du", "des", "un", "une", "et", "ou", "en", "pour", "avec", "sans", "sur"]
BRANDS = [
    "bosch", "makita", "dewalt", "metabo", "hilti", "magnusson", "dexter", "stanley", "facom", "wurth", "fischer", "spit", "milwaukee", "festool",
    "karcher", "ryobi", "hitachi", "tollens", "zolpan", "sika", "weber", "knauf", "placo", "legrand", "schneider", "hager", "grohe", "hansgrohe",
    "geberit", "roca", "jacob delafon", "ideal standard", "goodhome", "diall", "dremel", "black+decker", "einhell", "parkside", "brenner",
]
# --- end of fixed values ---


def blank_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def transliterate(c: Column) -> Column:
    """ASCII for the accented letters, ligatures and signs of French names; applied to lower case."""
    out = F.translate(c, ACCENTED, PLAIN)
    for sign, text in LIGATURES:
        out = F.replace(out, F.lit(sign), F.lit(text))
    return out


def canonical_name(c: Column) -> Column:
    """Lower, ASCII, without filler words and signs other than . , /; the empty text for null."""
    words = F.split(F.trim(transliterate(F.lower(F.trim(c)))), r"\s+")
    kept = F.array_join(F.filter(words, lambda w: ~w.isin(FILLERS)), " ")
    spaced = F.regexp_replace(kept, r"[^a-zA-Z0-9_\s.,/]", " ")
    return F.coalesce(F.trim(F.regexp_replace(spaced, r"\s+", " ")), F.lit(""))


def block_key(c: Column) -> Column:
    """The first two words of the canonical name."""
    return F.array_join(F.slice(F.split(canonical_name(c), " "), 1, 2), " ")


@F.pandas_udf(StringType())
def html_decode(names: pd.Series) -> pd.Series:
    """All named and numeric entities; the JVM has no function for them."""
    return names.map(lambda x: None if x is None else html.unescape(x))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_ean(c: Column) -> Column:
    """The digits if there are 13 of them."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(digits) == 13, digits)


def title_case(c: Column) -> Column:
    """A capital after anything that is no letter, small letters elsewhere."""
    runs = F.regexp_extract_all(c, F.lit(r"(?U)(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")


def path_parts(c: Column) -> Column:
    return F.transform(F.split(c, ">"), lambda x: F.trim(x))


def slug_base(c: Column) -> Column:
    """ASCII letters and figures joined by `-`, cut to 200; letters without a plain form are dropped."""
    ascii_ = F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(ascii_), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 200)


def strip_tags(c: Column) -> Column:
    return F.substring(collapse(F.regexp_replace(c, "<[^>]*>", " ")), 1, 500)


def extract_brand(c: Column, brands: list[str] = BRANDS) -> Column:
    """The first brand of the list that is a part of the name, in title case."""
    low = F.lower(c)
    found = F.filter(F.array(*[F.lit(b) for b in brands]), lambda b: F.contains(low, b))
    return title_case(F.try_element_at(found, F.lit(1)))


def parse_price(c: Column) -> Column:
    """French price text: `1 234,56 €`, `1.234,56`; a point before three figures groups. Else null."""
    bare = F.regexp_replace(c, r"[€$\s  ]", "")
    plain = F.replace(F.regexp_replace(bare, r"\.([0-9]{3}(?:[^0-9]|$))", "$1"), F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.round(plain.try_cast("decimal(18,6)"), 2).cast("decimal(12,2)"))


def feed_price(c: Column) -> Column:
    """Figures, points and commas of a feed price; null with two separators."""
    plain = F.replace(F.regexp_replace(c, "[^0-9.,]", ""), F.lit(","), F.lit("."))
    return F.when(plain.rlike(r"^[0-9]+(\.[0-9]+)?$"), plain.try_cast("decimal(18,6)").cast("decimal(12,2)"))


def ht_price(c: Column) -> Column:
    """The first figure before `€ H.T.`; grouped thousands are cut off as in the reference semantics."""
    return F.replace(F.nullif(F.regexp_extract(c, r"([0-9]+(?:[.,][0-9]+)?)\s*€\s*H\.?T", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(12,2)")


def split_price(c: Column) -> Column:
    """`399 € 00` is 399.00; anything else as parse_price."""
    euros, rest = F.regexp_extract(c, r"^\s*([0-9]+)\s*€\s*([0-9]{2})\s*$", 1), F.regexp_extract(c, r"^\s*([0-9]+)\s*€\s*([0-9]{2})\s*$", 2)
    return F.coalesce(F.when(euros != "", F.concat(euros, F.lit("."), rest).try_cast("decimal(12,2)")), parse_price(c))


def old_price(base: Column, net: Column, show_base: Column, show_discount: Column) -> Column:
    """The base price where both flags show it and it is above the net price."""
    return F.when(show_base & show_discount & (base > net), base)


def url_join(base: Column, link: Column) -> Column:
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    return (
        F.when(link.rlike("^https?://"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), link))
    )


def add_param(url: Column, name: str, value: str) -> Column:
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit(f"{name}={value}"))


def url_name(url: Column) -> Column:
    """A readable name from the last part of a URL: `-` to space, words over two letters capitalised, file end cut."""
    last = F.regexp_replace(F.regexp_replace(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]+)/?$", 1), r"\.html?$", ""), r"-p?[0-9]{7,10}$", "")
    return F.array_join(F.transform(F.split(last, "-"), lambda w: F.when(F.length(w) > 2, F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 255))).otherwise(w)), " ")


def url_category(url: Column) -> Column:
    """The parts of a URL's path but the last, title-cased, joined by ` > `."""
    path = F.regexp_replace(F.regexp_replace(url, r"^https?://[^/]+/?|[?#].*$", ""), "/$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.array_join(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: title_case(F.replace(p, F.lit("-"), F.lit(" ")))), " > ")


def sku_fallback(sku: Column, url: Column) -> Column:
    """The sku, else the number at the end of the URL, else its last 50 characters, else `unknown`."""
    number = F.nullif(F.regexp_extract(url, r"-p?([0-9]+)/?(?:\.html)?(?:\?.*)?$", 1), F.lit(""))
    return F.coalesce(blank_null(sku), number, F.right(url, F.lit(50)), F.lit("unknown"))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, as rows of the usual table folded over the letters."""
    letters = F.split(b, "")
    start = F.array_repeat(F.lit(0), F.size(letters) + 1)

    def row(previous: Column, letter: Column) -> Column:
        return F.reduce(
            F.sequence(F.lit(1), F.size(letters)), F.array(F.lit(0)),
            lambda done, j: F.concat(
                done,
                F.array(
                    F.when(F.get(letters, j - 1) == letter, F.get(previous, j - 1) + 1).otherwise(F.greatest(F.get(previous, j), F.get(done, j - 1)))
                ),
            ),
        )

    return F.when((a == "") | (b == ""), 0).otherwise(F.element_at(F.reduce(F.split(a, ""), start, row), -1))


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(F.trim(c), r"\s+")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    """200 * common subsequence / joint length of the texts with sorted words; 0 for two empty texts."""
    x, y = sorted_tokens(a), sorted_tokens(b)
    return F.coalesce(F.try_divide(F.lit(200.0) * common_subsequence(x, y), (F.length(x) + F.length(y))), F.lit(0.0))
