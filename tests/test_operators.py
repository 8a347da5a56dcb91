"""Relational, text, source and streaming operators on small inline tables."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from pricegrain.functions import specs, text
from pricegrain.operators import catalog, hot, linkage
from pricegrain.sources import pages, sinks
from pricegrain.streaming import prices
from pyspark.sql import functions as F

DAY = datetime(2024, 1, 1)


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_prices(spark):
    rows = ["12,50 €", "1 234,56€", "1.234,56", "0.125", "12,50 € TTC", "", None, "-1", "100000.01"]
    assert values(spark, rows, text.parse_price) == [None if x is None else Decimal(x) for x in ("12.50", "1234.56", "1234.56", "125.00", None, None, None, "-1.00", "100000.01")]
    assert values(spark, ["399 € 00", "12,5"], text.split_price) == [Decimal("399.00"), Decimal("12.50")]
    assert values(spark, ["EUR 12,5", "1.2.3", ""], text.feed_price) == [Decimal("12.50"), None, None]
    assert values(spark, ["à 12,40 € H.T. / 14 €", "1 234,50 € HT", "x"], text.ht_price) == [Decimal("12.40"), Decimal("234.50"), None]


def test_names(spark):
    assert values(spark, ["  Œillet d'angle DE 5 m² (à visser) ", None, "le la les"], text.canonical_name) == ["oeillet d angle 5 m2 a visser", "", ""]
    assert values(spark, ["black+decker", "L'ORÉAL pro", None], text.title_case) == ["Black+Decker", "L'Oréal Pro", None]
    assert values(spark, ["Œuf à la coque ²", "--A  b--"], text.slug_base) == ["uf-a-la-coque", "a-b"]
    assert values(spark, ["3-760-123456789-0", "12345678", "ABC"], text.clean_ean) == [None, None, None]
    assert values(spark, ["376-0123456-789"], text.clean_ean) == ["3760123456789"]
    assert values(spark, ["vis Black+Decker bosch"], text.extract_brand) == ["Bosch"]
    assert values(spark, ["Tom &amp; Jerry &eacute;t&eacute;", None], text.html_decode) == ["Tom & Jerry été", None]


def test_both_scores_agree(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("ab c") for _ in range(rng.randrange(12))), "".join(rng.choice("ab c") for _ in range(rng.randrange(12)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.token_sort_ratio(F.trim("a"), F.trim("b")).alias("x"))
    for r in df.collect():
        assert abs(r.x - linkage.score(r.a.strip(), r.b.strip())) < 1e-9


def test_specs(spark):
    name = "Perceuse à percussion sans fil 18V 4Ah blanc cassé satinée lot de 12, 500 g, PH2, IP44, 2,5 L 30 x 40 cm"
    df = spark.createDataFrame([(name, {"color": "rouge", "volume": ""})], "n string, given map<string,string>")
    got = df.select(specs.specs(F.col("n"), F.col("given")).alias("m")).head()["m"]
    assert got["color"] == "rouge" and got["volume"] == "2,5 L" and got["power"] == "18V" and got["battery"] == "4Ah" and got["finish"] == "satin"
    assert got["tool_type"] == "sans fil" and got["weight"] == "500 g" and got["bit_type"] == "PH2" and got["ip_rating"] == "IP44" and got["dimensions"] == "30 x 40 cm" and "amperage" not in got
    pair = spark.createDataFrame([("Vis 5x40 lot de 100", "Vis 5x40 lot de 200"), ("Vis 5x40", "vis noir 5 X 40")], "a string, b string")
    assert [r.c for r in pair.select(specs.compatible(specs.key_specs(F.col("a")), specs.key_specs(F.col("b"))).alias("c")).collect()] == [False, True]


def test_linkage_by_name_is_whole(spark):
    rng = random.Random(8)
    words, ends = ["vis", "visseuse", "Perceuse", "per", "20", "peinture"], ["4Ah", "4.0 Ah", "axe 50", "axe 40", "par 5", "blanc", "noir", "2,5 L", "2.5 l", "lot de 10", "5x40", "mat"]

    def some():
        parts = [rng.choice(["zolmar bois inox", "zolmar bois laiton", "ostrane murale"]), *rng.sample(ends, 2)]
        rng.shuffle(parts)
        return " ".join([rng.choice(words), *parts, "garantie deux ans france" * rng.randrange(2)])

    products = [(i, some()) for i in range(1, 90)] + [(90, None), (91, ""), (92, "!!"), (93, "visseuse sans fil 18V 4Ah"), (94, "serrure encastrer axe 50")]
    listings = [(i, None, some()) for i in range(1, 260)] + [(301, None, "visseuse sans fil 18V 4.0 Ah"), (302, None, "serrure encastrer axe 40"), (303, None, ""), (304, None, "de la"), (305, None, None), (306, 1, "vis"), (307, None, "serrure " + "a" * 150), (308, None, "serrure " + "a" * 148 + "b")]
    rng.shuffle(listings)
    pdf, ldf = spark.createDataFrame(products, "id long, name string"), spark.createDataFrame(listings, "id long, product_id long, store_product_name string")
    shape = lambda df, c: {r.id: (r.c, tuple(r.k)) for r in df.filter(f"{c} is not null").select("id", text.canonical_name(F.col(c)).alias("c"), specs.key_specs(F.col(c)).alias("k")).collect()}
    known, mine = shape(pdf, "name"), shape(ldf.filter("product_id is null"), "store_product_name")

    def near(a, b):
        if not a[0] or not b[0] or not b[0].split()[0].startswith(a[0].split()[0]) or any(x and y and x != y for x, y in zip(a[1], b[1], strict=True)):
            return 0
        return linkage.score(a[0], b[0])

    pairs = {(i, p): round(near(a, b), 6) for i, a in mine.items() for p, b in known.items() if near(a, b) >= 85}
    assert {(r.listing_id, r.product_id): r.score for r in linkage.candidates(ldf, pdf).collect()} == pairs and {(301, 93), (302, 94)} <= set(pairs)
    want, after = {}, list(known.items())
    for i in sorted(mine):
        value, _, of = max(((near(mine[i], b), -n, p) for n, (p, b) in enumerate(after)), default=(0, 0, 0))
        want[i] = of if value >= 85 else -i
        if value < 85:
            after.append((-i, mine[i]))
    assert {r.listing_id: r.product_id for r in linkage.greedy(ldf, pdf).collect()} == want
    assert any(v < 0 and v != -i for i, v in want.items()) and want[308] == -307 and want[303] == -303 and want[304] == -304


def test_backfill(spark):
    from pricegrain.plans import texts

    rows = [(1, "Vernis 2,5 L mat noir", None, "rouge", None, "", None, None, None), (2, "Marteau", None, None, "", None, None, None, None), (3, "Vernis 2,5 L", "{}", None, None, None, None, None, None), (4, None, None, None, None, None, None, None, None)]
    got = {r.id: r for r in texts.backfilled(spark.createDataFrame(rows, "id long, name string, specifications string, color string, volume string, weight string, dimensions string, finish string, pack_size string")).collect()}
    assert set(got) == {1, 2, 4} and got[1][2:] == ("rouge", "2,5 L", "", None, "mat", None)
    assert '"volume":"2,5 L"' in got[1].specifications and '"finish":"mat"' in got[1].specifications and got[2].specifications is None and got[2].volume == "" and got[4][1:] == (None,) * 7
    assert texts.spec_backfill_json(spark, "/root/testdata/sf0.001").filter("specifications is not null").count() > 0


def test_missing_brands_are_searched_in_the_whole_list(spark, tmp_path):
    from pricegrain.plans import texts

    rows = [(1, "Perceuse MAKITA 18V", None), (2, "lavabo Jacob Delafon", None), (3, "scie Black+Decker", "x"), (4, "ponceuse black+decker", None), (5, "vis", None), (6, None, None), (7, "Hansgrohe", None)]
    spark.createDataFrame(rows, "id long, name string, brand string").write.parquet(str(tmp_path / "products.parquet"))
    got = {r.id: r.brand for r in texts.extract_brand(spark, str(tmp_path)).collect()}
    assert got == {1: "Makita", 2: "Jacob Delafon", 4: "Black+Decker", 5: None, 6: None, 7: "Grohe"}


def test_upsert(spark):
    schema = "k int, s string, price int, t timestamp, action string"
    old = spark.createDataFrame([(1, "a", 10, DAY, ""), (2, "b", 20, DAY, ""), (3, None, 30, DAY, "")], schema)
    new = spark.createDataFrame([(1, "a", 11, DAY + timedelta(1), ""), (1, "a", 12, DAY + timedelta(2), ""), (2, "b", 5, DAY - timedelta(1), ""), (4, "d", 40, DAY, ""), (3, None, 31, DAY + timedelta(1), "")], schema)
    out = catalog.upsert(old, new, ["k", "s"], ["price"], "t")
    assert sorted((r.k, r.price, r.action) for r in out.collect()) == [(1, 12, "updated"), (2, 20, "kept"), (3, 30, "kept"), (3, 31, "inserted"), (4, 40, "inserted")]
    again = catalog.upsert(out.drop("action"), new.filter("s is not null"), ["k", "s"], ["price"], "t")
    assert again.filter("action != 'kept'").count() == 0


def test_slugs_are_greedy_in_order_of_id(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["foo", "Foo", "foo 1", "foo 1 1", "bar", "été", "!!", "foo-2"])) for i in range(80)]
    got = {r.id: r.slug for r in linkage.assign_slugs(spark.createDataFrame(rows, "id long, name string")).collect()}
    base = dict(zip([i for i, _ in rows], values(spark, [n for _, n in rows], text.slug_base), strict=True))
    taken, want = set(), {}
    for i, _ in rows:
        slug, k = base[i], 1
        while slug in taken:
            slug, k = f"{base[i]}-{k}", k + 1
        taken.add(slug)
        want[i] = slug
    assert len(set(got.values())) == len(rows) and {i: s for i, s in got.items() if base[i] in ("bar", "ete")} == {i: s for i, s in want.items() if base[i] in ("bar", "ete")}
    assert got == want


@pytest.mark.parametrize("hot_rows", [10**9, 10])
def test_windows_across_blocks(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(hot, "HOT_SHARE", 0.0)
    monkeypatch.setattr(hot, "BLOCK_ROWS", 15)
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, 2]), rng.choice([None, 1, 2, 3]), DAY + timedelta(hours=rng.randrange(900))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, listing_id long, price int, scraped_at timestamp")
    got = {r.id: r.last.v if r.last else "none" for r in hot.with_previous(df, "listing_id", "scraped_at", "id", "price", "last", hot_rows).collect()}
    want, accepted, last, taken = {}, set(), {}, {}
    for i, k, p, t in sorted(rows, key=lambda r: (r[3], r[0])):
        want[i] = last.get(k, "none")
        last[k] = p
        if k not in taken or t - taken[k] >= timedelta(hours=12):
            taken[k] = t
            accepted.add(i)
    assert got == want
    assert {r.id for r in prices.accepted(df, 12, hot_rows).collect()} == accepted


def test_pages_and_feeds(spark, tmp_path):
    page = '<title>T</title><meta content="c" property="og:x"><script type="application/ld+json">{bad</script><script type="application/ld+json">[{"@type":"X"},{"@type":"Product","name":"N","mpn":"3760123456789","image":{"url":"u"},"offers":[{"price":"12.5","availability":"http://schema.org/InStock"}]}];</script>'
    row = pages.ld_objects(spark.createDataFrame([(page,), ("nothing",), (None,)], "page string"), "page", "Product").select(*[c.alias(n) for n, c in pages.ld_product().items()])
    found = row.filter("name is not null").head()
    assert (found.name, found.ean, found.mpn, found.image, found.price, found.in_stock) == ("N", "3760123456789", None, "u", Decimal("12.50"), True) and row.count() == 3
    (tmp_path / "f.csv").write_text('﻿aw_product_id,title,price,stock_status,ean\n1,"Vis, 5x40","12,50 EUR",,\n2,,x,No,123\n', encoding="utf-8")
    feed = pages.normalise_feed(pages.read_csv_feed(spark, str(tmp_path / "f.csv"))).orderBy("product_id").collect()
    assert [(r.product_id, r.name, r.price, r.in_stock, r.ean) for r in feed] == [("1", "Vis, 5x40", Decimal("12.50"), True, None), ("2", None, None, False, "123")]
    (tmp_path / "f.xml").write_text("<a><b><product><Product-Name>P</Product-Name><price>3</price></product></b></a>")
    assert [(r.name, r.price) for r in pages.normalise_feed(pages.read_xml_feed(spark, str(tmp_path / "f.xml"), ["Product-Name", "price"])).collect()] == [("P", Decimal("3.00"))]
    items = spark.createDataFrame([("n", "1", "c", "x"), ("n", "NaN", "c", "1"), ("n", "abc", "c", None), (" ", "1", "c", None), ("n", None, "c", None), ("n", "100000.01", "c", None), ("n", "1", None, None)], "product_name string, price string, store_chain string, unit_price string")
    assert [r.reject_reason for r in pages.validate(items).collect()] == [None, "price not above 0", "price is no number", "no name", "no price", "price above 100000", "no chain"]


def test_sinks(spark, tmp_path):
    df, at = spark.range(3), str(tmp_path / "s")
    assert sinks.write_snapshot(df, at) == 1 and sinks.write_snapshot(df.limit(1), at) == 2
    assert sinks.read_snapshot(spark, at).count() == 1 and sinks.read_snapshot(spark, at, 1).count() == 3
    sinks.write_backup(df, str(tmp_path / "b"))
    with pytest.raises(Exception, match="already exists"):
        sinks.write_backup(df, str(tmp_path / "b"))


def test_a_stray_date_moves_no_block(spark):
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 40 == 0, F.col("id")).alias("k"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("t"))
    rows = rows.unionByName(spark.createDataFrame([(-1, 7, datetime(1970, 1, 1)), (-2, 7, datetime(2300, 1, 1))], "id long, k long, t timestamp")).withColumn("k", F.when(F.col("id") % 40 == 0, F.col("k")).otherwise(7))
    rows = rows.withColumn("k", F.when(F.col("id") % 4 == 1, None).otherwise(F.col("k")))
    blocks = hot.find_blocks(rows, "k", "t", 5_000)
    assert {k for k, _ in blocks.hot} == {7, None}
    sizes = {}
    for r in blocks.place(rows, "t", "id").groupBy("k", "block").count().collect():
        sizes.setdefault(r.k, []).append(r["count"])
    assert all(len(sizes[k]) == 8 and max(sizes[k]) < 2 * sum(sizes[k]) / 8 for k in (7, None)) and sizes[80] == [1]


def test_freshness_of_a_hot_burst(spark, monkeypatch):
    monkeypatch.setattr(hot, "BLOCK_ROWS", 50)
    rng = random.Random(11)
    rows = [(i, 1 if i % 5 else rng.randrange(2, 6), DAY + timedelta(minutes=rng.randrange(60_000))) for i in range(3000)] + [(9000, None, DAY), (9001, 1, None)]
    df = spark.createDataFrame(rows, "id long, listing_id long, scraped_at timestamp")
    taken, want = {}, set()
    for i, k, t in sorted((r for r in rows if r[1] and r[2]), key=lambda r: (r[2], r[0])):
        if k not in taken or t - taken[k] >= timedelta(hours=12):
            taken[k] = t
            want.add(i)
    assert {r.id for r in prices.accepted(df, 12, 100).collect()} == want
    assert prices.accepted(df.limit(0)).count() == 0


def test_ingest(spark):
    from pricegrain.operators import flows

    now = datetime(2024, 6, 1, 12)
    schema = "id long, product_id long, store_id long, store_sku string, store_product_url string, store_product_name string, current_price decimal(10,2), old_price decimal(10,2), unit_price decimal(10,2), unit_label string, in_stock boolean, store_ean string, store_manufacturer_ref string, image_url string, category_path string, last_scraped_at timestamp, action string"
    row = lambda i, store, sku, price, t: (i, 5, store, sku, f"u{i}", f"old {i}", None if price is None else Decimal(price), Decimal("9.99"), None, None, True, None, None, None, None, t, "x")
    listings = [row(1, 1, "a", "1.00", now - timedelta(days=2)), row(2, 1, "b", "2.00", now - timedelta(hours=3)), row(3, 1, None, "3.00", None), row(4, 1, "c", "4.00", None), row(5, 2, "a", "0.00", now - timedelta(days=2))]
    stores = spark.createDataFrame([(1, "shop", "north"), (2, "shop", "south"), (3, "other", None)], "id long, chain string, name string")
    items_schema = "item_id long, store_chain string, store_name string, store_sku string, store_product_url string, store_product_name string, current_price decimal(10,2), unit_price decimal(10,2), unit_label string, in_stock boolean, store_ean string, store_manufacturer_ref string, image_url string, category_path string, id long"
    item = lambda i, chain, name, sku, price, url="https://x.example/p": (i, chain, name, sku, url, f"new {i}", Decimal(price), None, "kg", False, "e", "r", "i", "c", 0)
    items = [item(1, "shop", "north", "a", "1.50"), item(2, "shop", "north", "a", "1.75"), item(3, "shop", "north", "b", "9.00"), item(4, "shop", "nowhere", "c", "4.00"), item(5, "shop", "south", "a", "5.00"), item(6, "gone", None, "z", "1.00"), item(7, "shop", "north", "", "7.00"), item(8, "shop", "south", None, "8.00", None), item(9, "shop", None, "d", "6.00")]
    out = flows.ingest(spark.createDataFrame(listings, schema), stores, spark.createDataFrame(items, items_schema), now).collect()
    got = {(r.store_id, r.store_sku): (r.action, r.changed, str(r.current_price), r.store_product_name, r.store_product_url) for r in out}
    assert len(out) == 8 and got == {
        (1, "a"): ("updated", True, "1.50", "new 1", "u1"), (1, "b"): ("kept", False, "2.00", "old 2", "u2"), (1, None): ("kept", False, "3.00", "old 3", "u3"),
        (1, "c"): ("updated", False, "4.00", "new 4", "u4"), (2, "a"): ("updated", True, "5.00", "new 5", "u5"), (1, "https://x.example/p"): ("inserted", True, "7.00", "new 7", "https://x.example/p"),
        (2, "unknown"): ("inserted", True, "8.00", "new 8", None), (1, "d"): ("inserted", True, "6.00", "new 9", "https://x.example/p"),
    }
    assert all(str(r.old_price) == "9.99" for r in out if r.id) and {r.last_scraped_at for r in out if r.action != "kept"} == {now}
    empty = flows.ingest(spark.createDataFrame([], schema), stores, spark.createDataFrame([], items_schema), now)
    assert empty.count() == 0


def test_feeds_and_copies(spark):
    from pricegrain.operators import flows

    stores = spark.createDataFrame([(4, "shop"), (2, "shop"), (9, "other")], "id long, chain string")
    listings = spark.createDataFrame([(1, 2, "a", "A", None, Decimal("1.00")), (2, 2, "b", "B", None, None), (3, 4, "c", "C", None, Decimal("1.00"))], "id long, store_id long, store_sku string, store_product_name string, store_ean string, current_price decimal(10,2)")
    feed = [(1, "A2", "a", None, "1.00"), (2, "B2", "b", None, "2.00"), (3, "N", "n", "12345678901234", "3.00"), (4, "N2", "n", None, "4.00"), (5, "X", None, None, "5.00"), (6, "X", "", None, "5.00"), (7, None, "q", None, "1.00"), (8, "Q", "q", None, None), (9, "L" * 300, "k" * 60, None, "1.00")]
    rows = spark.createDataFrame([(*f[:4], None if f[4] is None else Decimal(f[4])) for f in feed], "row long, name string, sku string, ean string, price decimal(10,2)")
    got = sorted((r.sku or "", r.name[:5], r.action, str(r.price), r.ean, r.store_id) for r in flows.import_feed(listings, stores, rows, "shop").collect())
    assert got == sorted([("a", "A", "kept", "1.00", None, 2), ("b", "B", "updated", "2.00", None, 2), ("n", "N", "inserted", "4.00", "1234567890123", 2), ("", "X", "inserted", "5.00", None, 2), ("", "X", "inserted", "5.00", None, 2), ("k" * 50, "LLLLL", "inserted", "1.00", None, 2)])
    assert {r.store_id for r in flows.import_feed(listings, stores, rows, "new").collect()} == {10}
    target = spark.createDataFrame([(1, 1)], "id long, in_stock int")
    source = spark.createDataFrame([("1", "0"), ("2", "1"), ("2", "1"), ("x", "1"), ("3", "ja"), (None, "1"), ("4", None)], "id string, in_stock string")
    after, bad = flows.copy_rows(target, source, "id", {"id": "bigint", "in_stock": "int"})
    assert sorted((r.id, r.in_stock) for r in after.collect()) == [(1, 1), (2, 1), (4, None)] and sorted(r.reason for r in bad.collect()) == ["id", "id", "in_stock"]
    report = flows.copy_report(target, source, "id", {"id": "bigint", "in_stock": "int"}).head()
    assert (report.before, report.read, report.quarantined, report.added, report.ignored, report.after) == (1, 7, 3, 2, 2, 3)
    shards = {r.id: (r.at, r.shard) for r in flows.shard(spark.createDataFrame([(i * 3,) for i in range(10)], "id long"), "id", 4).collect()}
    assert [shards[i * 3][1] for i in range(10)] == [0, 0, 1, 1, 2, 2, 3, 3, 3, 3]
    assert {r.shard for r in flows.shard(spark.createDataFrame([(1,), (2,)], "id long"), "id", 4).collect()} == {0, 1}


def _limit_offers(spark, folder):
    """Listings at the largest price of their column, with and without sku; every third offer of the feed costs one more."""
    schema = "id long, store_id long, store_sku string, store_product_name string, store_ean string, current_price decimal(10,2)"
    listings = [(3, 2, "a", "A", None, Decimal("99999999.99")), (4, 2, "b", "B", None, Decimal("99999999.99")), (6, 2, None, "C", None, Decimal("99999999.99")), (9, 2, "d", "D", None, Decimal("0.00"))]
    spark.createDataFrame(listings, schema).write.parquet(f"{folder}/store_listings.parquet")
    spark.createDataFrame([(2, "shop"), (3, "zoo")], "id long, chain string").write.parquet(f"{folder}/stores.parquet")


def test_a_feed_price_larger_than_the_listings_column(spark, tmp_path):
    from pricegrain.plans import flows as plans

    _limit_offers(spark, tmp_path)
    got = sorted((r.id or 0, r.sku or "", r.name, r.action, str(r.price), r.store_id) for r in plans.feed_import(spark, str(tmp_path)).collect())
    assert got == [(0, "", "C", "inserted", "100000000.99", 2), (3, "a", "A", "updated", "100000000.99", 2), (4, "b", "B", "kept", "99999999.99", 2), (6, "", "C", "kept", "99999999.99", 2), (9, "d", "D", "kept", "0.00", 2)]


def test_a_new_chain_takes_prices_larger_than_the_listings_column(spark, tmp_path):
    from pricegrain.plans import flows as plans

    _limit_offers(spark, tmp_path)
    got = sorted((r.id, r.sku or "", r.name, r.action, str(r.price), r.store_id) for r in plans.feed_import_new_chain(spark, str(tmp_path)).collect())
    assert got == [(None, "", "C", "inserted", "100000000.99", 4), (None, "a", "A", "inserted", "100000000.99", 4), (None, "b", "B", "inserted", "99999999.99", 4)]


def test_a_new_chain_beside_the_largest_store_id(spark, tmp_path):
    from pricegrain.plans import flows as plans

    schema = "id long, store_id long, store_sku string, store_product_name string, store_ean string, current_price decimal(10,2)"
    for at, (largest, kind) in {"long": (2**63 - 2, "bigint"), "more": (2**63 - 1, "decimal(20,0)")}.items():
        folder = f"{tmp_path}/{at}"
        spark.createDataFrame([(1, largest, "a", "A", "1", Decimal("1.00")), (3, 2, None, "B", None, Decimal("2.00"))], schema).write.parquet(f"{folder}/store_listings.parquet")
        spark.createDataFrame([(2, "shop"), (largest, "zoo")], "id long, chain string").write.parquet(f"{folder}/stores.parquet")
        rows = plans.feed_import_new_chain(spark, folder)
        assert dict(rows.dtypes)["store_id"] == kind
        got = sorted((r.id, r.sku or "", r.name, r.ean, r.action, str(r.price), int(r.store_id)) for r in rows.collect())
        assert got == [(None, "", "B", None, "inserted", "3.00", largest + 1), (None, "a", "A", "1", "inserted", "1.00", largest + 1)]


def test_propagation_and_categories(spark):
    from pricegrain.operators import flows

    products = spark.createDataFrame([(1, "", None, None, "rouge", None, None, None, None), (2, "B", "d", None, None, None, None, None, None), (3, None, None, None, None, None, None, None, None)], "id long, brand string, description string, volume string, color string, weight string, dimensions string, pack_size string, finish string")
    items = spark.createDataFrame([(1, 2, "Vernis 5 L noir mat", "M2", "late"), (1, 1, "Vernis 2,5 L bleu", None, ""), (2, 3, "Colle 4 kg", "M", "x"), (None, 4, "Colle", "M", "x")], "product_id long, item_id long, product_name string, manufacturer string, description string")
    got = {r.id: r for r in flows.propagate(products, items).collect()}
    assert (got[1].brand, got[1].description, got[1].volume, got[1].color, got[1].finish) == ("M2", "late", "2,5 L", "rouge", "mat")
    assert (got[2].brand, got[2].description, got[2].weight) == ("B", "d", "4 kg") and got[3].brand is None
    named = spark.createDataFrame([(1, "Scie sauteuse 18V", None), (2, "scie égoïne", None), (3, "Vernis", 8), (4, "truc", None), (5, None, None), (6, "objet", None)], "id long, name string, category_id long")
    listings = spark.createDataFrame([(1, 4, None), (2, 4, "Outils > Marteaux"), (3, 6, "Outils > Marteaux")], "id long, product_id long, category_path string")
    slugs = spark.createDataFrame([(10, "outillage-main"), (11, "outillage-main"), (12, "outillage")], "id long, slug string")
    assert {r.id: r.category_id for r in linkage.categorize(named, listings, slugs).collect()} == {1: None, 2: 11, 4: None, 5: None, 6: 11}


def test_sources_of_pages(spark, tmp_path):
    import gzip

    (tmp_path / "a.xml.gz").write_bytes(gzip.compress("<urlset><url><loc>https://x.example/é</loc></url></urlset>".encode()))
    (tmp_path / "b.xml").write_bytes(b"<loc>https://x.example/b</loc>\xff")
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in pages.read_files(spark, str(tmp_path)).collect()}
    assert "/é</loc>" in texts["a.xml.gz"] and texts["b.xml"].endswith("�")
    captures = [("u", b"old", DAY), ("u", gzip.compress(b"new"), DAY + timedelta(hours=20)), ("u", b"future", DAY + timedelta(hours=30)), ("v", b"stale", DAY - timedelta(days=2)), ("w", None, DAY + timedelta(hours=23))]
    got = pages.captured_pages(spark.createDataFrame(captures, "url string, body binary, fetched_at timestamp"), F.lit(DAY + timedelta(hours=24)), 24)
    assert {r.url: r.text for r in got.collect()} == {"u": "new", "w": None}
    raw = spark.createDataFrame([('{"name" : "N", "price": "12.5", "sku":"s"}',), ('"name":"N","price":0',), ("",), (None,)], "page string").select(*[c.alias(n) for n, c in pages.last_resort(F.col("page")).items()])
    assert [tuple(r) for r in raw.collect()] == [("N", "s", Decimal("12.50"))] + [(None, None, None)] * 3
    rule = pages.UrlRule(ends=".html", least_slashes=3, most_slashes=3, figures=4)
    assert values(spark, ["https://x.example/a-1234.html", "https://x.example/c/a-1234.html", "https://x.example/a-12.html", None], rule.fits, "string") == [True, False, False, None]
    page = "x categoryFilter: '0123456789abcdef0123456789abcdef0123', totalPages: 3"
    assert [r.url for r in pages.further_pages(spark.createDataFrame([(1, page), (2, "none"), (3, None)], "id int, page string"), "page", "f={filter}&p={page}").orderBy("url").collect()] == [f"f=0123456789abcdef0123456789abcdef0123&p={i}" for i in (2, 3)]
