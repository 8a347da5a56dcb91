"""Problem 6: the best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: words and parts of addresses that stand for nothing ---
NO_PICTURE = r"(?i)(no[-_]?image|placeholder|visuel[-_]a[-_]venir|image[-_]non[-_]disponible|default[-_]product|/1x1\.|coming[-_]soon|no[-_]?photo|blank\.(?:gif|png))"
NO_BRAND = ["", "-", "divers", "inconnu", "inconnue", "sans marque", "null", "none", "non renseigné", "non renseigne", "n.c.", "nc", "n/c", "n/a", "na", "non communiqué", "?", "autre", "generique", "générique"]
FILLER_EAN = ["1234567890128", "0123456789012"]
# --- end of fixed values ---


def usable_ean(ean: str | Column) -> Column:
    """13 digits with a right control digit that are no filler number (one digit repeated, or counted up)."""
    code = F.trim(F.col(ean) if isinstance(ean, str) else ean)
    digit = lambda i: F.substring(code, i, 1).try_cast("int")
    total = sum((digit(i) * (1 if i % 2 else 3) for i in range(1, 13)), F.lit(0))
    right = F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)) == digit(13)
    same = code.rlike(r"^([0-9])\1{11}")
    return F.coalesce(F.when(code.rlike("^[0-9]{13}$"), right & ~same & ~code.isin(FILLER_EAN)), F.lit(False))


def usable_brand(brand: str | Column) -> Column:
    brand = F.col(brand) if isinstance(brand, str) else brand
    return F.coalesce(~F.lower(F.regexp_replace(brand, r"^[\s ]+|[\s ]+$", "")).isin(NO_BRAND), F.lit(False))


def full_address(url: str | Column) -> Column:
    """A whole http(s) address with host and path that is not by its name a stand-in for a missing picture."""
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(url.rlike(r"^(?i)https?://[^/\s]+\.[^/\s]+/\S+$") & ~url.rlike(NO_PICTURE), F.lit(False))


def survive(
    rows: DataFrame, group: str, source: str, time: str, fields: dict[str, Column], priority: Column | None = None,
    about: dict[str, Column] | None = None, where: dict[str, Column] | None = None,
) -> DataFrame:
    """(group_id, attribute, source_id, value): for each group and field the surviving value and the row it is from.

    One aggregation: per field the maximum of (non-null, source priority, time, -source, value), so a hot group
    is combined on the map side. `fields` gives the value of each field, null where it is not usable. The most
    recent row wins; a null time is the oldest, then the smaller source id. Without a usable value there is no
    row. `about` are further aggregates of the group, on which the conditions `where` by field may stand. Null
    groups form no group; repeated rows change nothing; an empty table gives no rows.
    """
    rank = priority if priority is not None else F.lit(0)
    best = [
        F.max(F.when(v.isNotNull(), F.struct(rank.alias("rank"), F.col(time).alias("t"), (-F.col(source)).alias("minus"), v.alias("value")))).alias(f"best_{name}")
        for name, v in fields.items()
    ]
    more = [v.alias(name) for name, v in (about or {}).items()]
    found = rows.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("group_id")).agg(*best, *more)
    kept = {name: F.when((where or {}).get(name, F.lit(True)), F.col(f"best_{name}")) for name in fields}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("attribute"), best.alias("best")) for name, best in kept.items()]))
    return found.select("group_id", each.alias("x")).filter("x.best is not null").select(
        "group_id", "x.attribute", (-F.col("x.best.minus")).alias("source_id"), "x.best.value"
    )


def representatives(listings: DataFrame, products: DataFrame) -> DataFrame:
    """(group_id, attribute, source_id, value) of picture, EAN and brand.

    Picture and EAN: groups are products held by at least two listings, the rows are the listings; the EAN only
    where the product's own is not usable. Brand: groups are products that share a usable EAN, named by the
    smallest id. A picture that listings of different products use is a stand-in, besides those known by name.
    """
    text = F.lit(None).cast("string")
    linked = listings.filter("product_id is not null").select("id", "product_id", "image_url", "store_ean", F.col("last_scraped_at").alias("t"))
    codes = linked.select("product_id", "id", "t", text.alias("image_url"), F.when(usable_ean("store_ean"), F.trim("store_ean")).alias("ean"), F.lit(1).alias("n"), F.lit(0).alias("own"))
    # of equal pictures of one product only the row that would win goes on, so a stand-in is not a hot key
    pictures = linked.filter(full_address("image_url")).groupBy("image_url", "product_id").agg(F.max(F.struct("t", (-F.col("id")).alias("minus"))).alias("x"))
    shared = pictures.groupBy("image_url").agg(F.min("product_id").alias("a"), F.max("product_id").alias("b")).filter("a != b").select("image_url")
    pictures = pictures.join(shared, "image_url", "left_anti").select(
        "product_id", (-F.col("x.minus")).alias("id"), "x.t", "image_url", text.alias("ean"), F.lit(0).alias("n"), F.lit(0).alias("own")
    )
    own = products.filter("id is not null").select(
        F.col("id").alias("product_id"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("timestamp").alias("t"), text.alias("image_url"),
        text.alias("ean"), F.lit(0).alias("n"), F.when(usable_ean("ean"), 1).otherwise(0).alias("own"),
    )
    of_listings = survive(
        codes.unionByName(pictures).unionByName(own), "product_id", "id", "t", {"image_url": F.col("image_url"), "ean": F.col("ean")},
        about={"n": F.sum("n"), "own": F.max("own")}, where={"image_url": F.col("n") >= 2, "ean": (F.col("n") >= 2) & (F.col("own") == 0)},
    )
    coded = products.filter(usable_ean("ean")).select("id", F.trim("ean").alias("code"), F.col("updated_at").alias("t"), F.when(usable_brand("brand"), F.trim("brand")).alias("brand"))
    of_products = survive(coded, "code", "id", "t", {"brand": F.col("brand")}, about={"a": F.min("id"), "b": F.max("id")}, where={"brand": F.col("a") != F.col("b")})
    names = coded.groupBy(F.col("code").alias("group_id")).agg(F.min("id").alias("first"))
    of_products = of_products.join(names, "group_id").select(F.col("first").alias("group_id"), "attribute", "source_id", "value")
    return of_listings.unionByName(of_products)
