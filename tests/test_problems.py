"""Problems 1 to 5 on small tables: brute force, and nulls, ties, repeats, empty tables and clashing names."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from decimal import Decimal
from statistics import median

import pytest
from pyspark.sql import functions as F

from pricegrain.operators import history, hot, skew, spikes, tree, units

DAY = datetime(2024, 1, 1)
HISTORY = "id long, listing_id long, price decimal(10,2), scraped_at timestamp, block string, kept int"
LISTINGS = "id long, store_id long, current_price decimal(10,2), last_scraped_at timestamp, usual int"


def d(x):
    return None if x is None else Decimal(str(x))


# --- 1 ---


def test_key_profile_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([None, *range(40)]), "x", 0) for _ in range(900)]
    got = {r["k"]: r for r in skew.key_profile(spark.createDataFrame(rows, "k long, v int, _k string, _w int").drop("_k").withColumnRenamed("_w", "n_rows"), "k", "v").collect()}
    by = defaultdict(list)
    for k, v, *_ in rows:
        by[k].append(v)
    assert set(got) == set(by)
    for k, values in by.items():
        known = sorted(v for v in values if v is not None)
        top = max(Counter(known).values())
        r = got[k]
        assert (r.n_rows, r.n_known, r.n_values) == (len(values), len(known), len(set(known)))
        assert r.mode == min(v for v, n in Counter(known).items() if n == top)
        assert r.p50 == known[-(-len(known) // 2) - 1] and r.p90 == next(v for i, v in enumerate(known, 1) if i >= 0.9 * len(known))


def test_key_profile_edges(spark):
    schema = "k long, v decimal(10,2)"
    assert skew.key_profile(spark.createDataFrame([], schema), "k", "v").count() == 0
    r = skew.key_profile(spark.createDataFrame([(7, None), (7, None)], schema), "k", "v").head()
    assert (r.n_rows, r.n_values, r.mode, r.p50) == (2, 0, None, None)
    rows = spark.createDataFrame([(1, d(2))] * 19 + [(2, d(1))] + [(None, d(1))] * 20, schema)
    assert [r.k for r in skew.heavy_keys(rows, "k", "v", 0.05).collect()] == [1]


# --- 2 ---

PRODUCTS = "id long, volume string, weight string, dimensions string, description string, specifications string, category_id long, unit string, name string"


def quantities(spark, rows):
    full = [(i, v, w, m, desc, spec, 1, None, "x") for i, (v, w, m, desc, spec) in enumerate(rows, 1)]
    out = units.convert_products(spark.createDataFrame(full, PRODUCTS))
    return {(r.id, r.attribute): (r.amount, r.status) for r in out.collect()}


def test_units_are_read_exactly(spark):
    rows = [
        ("1 000 mL", "2 lb", "1 1/2\" x 3/8″", None, None),
        ("± 0,75 litres", "env. 22.1Kg", "Ø 8 x 40 mm", None, None),
        ("2 US gal", "15 oz", "12,5cmX1,6mm", None, None),
        ("16 US fl oz", "0,02073t", "L. 510 x l. 680 x ép. 680 mm", None, None),
        ("300cm³", "100 gr.", "1,35×0,6×0,145m", None, None),
    ]
    got = quantities(spark, rows)
    amounts = {k: v[0] for k, v in got.items()}
    assert [amounts[i, "volume"] for i in range(1, 6)] == [1000, 750, 7571, 473, 300]
    assert [amounts[i, "weight"] for i in range(1, 6)] == [907, 22100, 425, 20730, 100]
    assert (amounts[1, "dim1"], amounts[1, "dim2"]) == (38100, 9525)
    assert (amounts[2, "dim1"], amounts[2, "dim2"]) == (8000, 40000)
    assert (amounts[3, "dim1"], amounts[3, "dim2"]) == (125000, 1600)
    assert [amounts[4, f"dim{k}"] for k in (1, 2, 3)] == [510000, 680000, 680000]
    assert [amounts[5, f"dim{k}"] for k in (1, 2, 3)] == [1350000, 600000, 145000]


def test_a_figure_alone_takes_the_unit_stated_elsewhere(spark):
    rows = [
        ("1200", None, None, "Peinture. Contenance (en cl) : 1200. Sur demande.", None),
        ("28", "25", "125 x 1", None, '{"volume": "28 cl", "poids net": "25 kg", "format": "125 x 1 mm"}'),
        ("30", None, None, "Poids : 30 kg. Volume : 31 ml.", None),
        ("N/C", "", "selon modèle", None, None),
        (None, None, None, None, None),
    ]
    got = quantities(spark, rows)
    assert got[1, "volume"] == (12000, "confirmed")
    assert got[2, "volume"] == (280, "confirmed") and got[2, "weight"] == (25000, "confirmed") and got[2, "dim1"] == (125000, "confirmed")
    assert got[3, "volume"][1] in ("review", "inferred")
    assert not [k for k in got if k[0] in (4, 5)]


def test_masked_units_are_found(spark):
    got = units.masked_accuracy(spark.read.parquet("/root/testdata/sf0.1/products.parquet"))
    assert got["accuracy"] >= 0.98 and got["confident"] >= 0.6 and got["overall"] >= 0.9
    assert units.isotonic([(0.1, 1, 9), (0.2, 0, 4), (0.5, 9, 9), (0.6, 8, 9)]) == [(0.1, 1 / 14), (0.5, 17 / 19)]
    assert units.isotonic([]) == []


def test_of_several_stated_units_the_likelier_one_confirms(spark):
    rows = [(f"{n} L", None, None, "", None) for n in (1, 2, 3, 5, 10) for _ in range(30)] + [(f"{n} ml", None, None, "", None) for n in (250, 400, 500, 750, 900) for _ in range(30)]
    rows += [("750", None, None, "Contient 750 l pour le bac, soit 750 ml par pot.", None)]
    got = quantities(spark, rows)
    assert got[len(rows), "volume"] == (750, "confirmed")


def test_unit_labels(spark):
    labels = {
        "€/kg": ("per_kg", 1250), "€ HT / tonne": ("per_kg", 1), "€ les 100g": ("per_kg", 12500), "€/100 ml": ("per_l", 12500), "€/ml": ("per_m", 1250), "€/m lin.": ("per_m", 1250),
        "€ les 100 m²": ("per_m2", 13), "€/dm²": ("per_m2", 125000), "€ le cent": ("per_piece", 13), "€/lot de 10": ("per_piece", 125), " € L'UNITÉ": ("per_piece", 1250), "€/hl": ("per_l", 13),
        "€/sachet": None, "€ par jour (loc.)": None, "TTC": None, "": None, None: None,
    }
    rows = spark.createDataFrame([(i, d("12.50"), x) for i, x in enumerate(labels)], "id long, unit_price decimal(10,2), unit_label string")
    got = {r.id: (r.attribute, r.amount) for r in units.convert_unit_prices(rows).collect()}
    assert {i: got.get(i) for i in range(len(labels))} == dict(enumerate(labels.values()))
    assert units.convert_unit_prices(rows.limit(0)).count() == 0


# --- 3 and 4 ---


def prices(seed=3):
    rng = random.Random(seed)
    rows, i = [], 0
    for listing in (1, 2, 3, 4):
        for k in range({1: 400, 2: 60, 3: 6, 4: 3}[listing]):
            i += 1
            t = DAY + timedelta(hours=6 * k) if rng.random() > 0.03 else None
            p = d(round(rng.uniform(10, 14), 2))
            if listing == 1 and 100 <= k < 180:
                p = d(11)
            p = {0: d(-1), 1: d(99999999), 2: d(60), 3: d(2)}.get(rng.randrange(60), p)
            rows.append((i, listing, p, t, "x", 1))
            if rng.random() < 0.05:
                i += 1
                rows.append((i, listing, rng.choice([p, d(12)]), t, "x", 1))
    rows.append((i + 1, None, d(-5), DAY, "x", 1))
    rows.append((i + 2, 1, None, DAY, "x", 1))
    rng.shuffle(rows)
    listings = [(1, 9, d(100), DAY + timedelta(days=40), 0), (2, 9, d(12), DAY + timedelta(days=3), 0), (3, None, None, None, 0), (5, 8, d(0), None, 0)]
    return rows, listings


def brute_cases(rows, listings):
    cases = set()
    by = defaultdict(list)
    for r in rows:
        if r[2] is not None:
            by[r[1]].append(r)
    usual = {}
    for k, own in by.items():
        good = [r[2] for r in own if 0 < r[2] <= 100000]
        if k is not None and len(good) >= 5:
            usual[k] = median(good)
    far = lambda k, p: p <= 0 or p > 100000 or (k in usual and (p >= 4 * usual[k] or 4 * p <= usual[k]))
    for k, own in by.items():
        cases |= {("price_history", r[0]) for r in own if far(k, r[2])}
        last = {}
        for r in own:
            if r[3] is not None and k is not None:
                last[r[3]] = max(last.get(r[3], r), r, key=lambda x: x[0])
        kept = [last[t] for t in sorted(last)]
        runs, moved = [], [True] + [False] * (len(kept) - 1)
        for i, r in enumerate(kept):
            if i and kept[i - 1][2] != r[2]:
                moved[i] = True
            if moved[i]:
                runs.append([])
            runs[-1].append(i)
        for run in runs:
            outside = [i for i in range(len(kept)) if i not in set(run)]
            if len(run) >= 8 and len(outside) >= 20 and 10 * sum(moved[i] for i in outside) >= 9 * len(outside):
                a, b, p = kept[run[0]][3], kept[run[-1]][3], kept[run[0]][2]
                cases |= {("price_history", r[0]) for r in own if r[3] is not None and a <= r[3] <= b and r[2] == p}
    return cases | {("store_listings", r[0]) for r in listings if r[2] is not None and far(r[0], r[2])}


@pytest.mark.parametrize("hot_rows", [10**9, 20])
def test_spikes_match_brute_force(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(hot, "HOT_SHARE", 0.0)
    monkeypatch.setattr(hot, "BLOCK_ROWS", 40)
    rows, listings = prices()
    got = spikes.flag_prices(spark.createDataFrame(rows, HISTORY), spark.createDataFrame(listings, LISTINGS), hot_rows=hot_rows)
    found = {(r.record_kind, r.record_id) for r in got.filter("is_case").collect()}
    want = brute_cases(rows, listings)
    assert found == want and any(k == "price_history" for k, _ in want)
    assert got.filter("stuck").count() > 20


def test_the_cutoff_is_the_tail_quantile_of_normal_prices(spark):
    rng = random.Random(6)
    rows = [(i, 1 + i % 40, d(round(100 * 2.718281828 ** (rng.choice([-1, 1]) * rng.expovariate(10)), 2)), DAY + timedelta(hours=i), "", 0) for i in range(40_000)]
    rows += [(50_000 + i, 1 + i % 40, d(rng.choice([900, 4])), DAY + timedelta(hours=i, minutes=1), "", 0) for i in range(1_500)]
    listings = [(i, 9, d(100), DAY, 0) for i in range(1, 41)]
    got = spikes.flag_prices(spark.createDataFrame(rows, HISTORY), spark.createDataFrame(listings, LISTINGS)).filter("record_kind = 'price_history'")
    r = got.agg(F.max("cutoff").alias("cutoff"), F.expr("count_if(tail and record_id < 50000)").alias("n"), F.expr("count_if(is_case and record_id >= 50000)").alias("far")).head()
    # the residual is exponential of mean 0.1: one in a thousand lies above 0.69, whatever the spikes
    assert 0.6 < r.cutoff < 0.78 and 15 <= r.n <= 80 and r.far == 1_500


def test_spikes_on_empty_tables(spark):
    assert spikes.flag_prices(spark.createDataFrame([], HISTORY), spark.createDataFrame([], LISTINGS)).count() == 0


@pytest.mark.parametrize("hot_rows", [10**9, 20])
def test_cases_are_found_without_a_fit(spark, monkeypatch, hot_rows):
    from pricegrain.plans import problems

    def fitted(*_):
        raise AssertionError("the fit decides no case")

    monkeypatch.setattr(spikes, "tail_cutoffs", fitted)
    monkeypatch.setattr(hot, "HOT_SHARE", 0.0)
    monkeypatch.setattr(hot, "BLOCK_ROWS", 40)
    rows, listings = prices()
    got = spikes.find_cases(spark.createDataFrame(rows, HISTORY), spark.createDataFrame(listings, LISTINGS), hot_rows=hot_rows)
    assert sorted((r.record_kind, r.record_id) for r in got.collect()) == sorted(brute_cases(rows, listings))
    assert problems.p3_found(spark, "/root/testdata/sf0.001").count() > 0
    assert spikes.find_cases(spark.createDataFrame([], HISTORY), spark.createDataFrame([], LISTINGS)).count() == 0


def test_the_cutoff_decides_what_is_unusual(spark):
    rng = random.Random(8)
    history, listings = [], [(i, i % 2, d(100), DAY, 0) for i in range(1, 41)]
    for i in range(20_000):
        listing = 1 + i % 40
        history.append((i, listing, d(round(100 * 2.718281828 ** (rng.choice([-1, 1]) * rng.expovariate(25 if listing % 2 else 10)), 2)), DAY + timedelta(hours=i), "", 0))
    history += [(50_000 + i, 1 + i, d(160), DAY + timedelta(hours=i, minutes=1), "", 0) for i in range(40)]
    flagged = lambda rules: spikes.flag_prices(spark.createDataFrame(history, HISTORY), spark.createDataFrame(listings, LISTINGS), rules).filter("tail and not is_case and record_id >= 50000")
    # 160 is unusual where prices move by a twenty-fifth, and not where they move by a tenth, unless the risk is larger
    assert {r.record_id % 2 for r in flagged(spikes.SpikeRules()).collect()} == {0} and flagged(spikes.SpikeRules()).count() == 20
    assert flagged(spikes.SpikeRules(risk=0.02)).count() == 40


def brute_versions(rows, listings):
    by = defaultdict(dict)
    for i, k, p, t, *_ in rows:
        if None not in (k, p, t):
            by[k][t, 0] = max(by[k].get((t, 0), (i, p)), (i, p))
    for i, _, p, t, *_ in listings:
        if None not in (p, t):
            by[i][t, 1] = (i, p)
    out = []
    for k, seen in by.items():
        before = None
        for (t, kind), (i, p) in sorted(seen.items()):
            if before is None or p != before:
                out.append((k, kind, i, t))
            before = p
    return out


@pytest.mark.parametrize("hot_rows", [10**9, 20])
def test_versions_match_brute_force(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(hot, "HOT_SHARE", 0.0)
    monkeypatch.setattr(hot, "BLOCK_ROWS", 40)
    rows, listings = prices(5)
    found = history.price_versions(spark.createDataFrame(rows, HISTORY), spark.createDataFrame(listings, LISTINGS), hot_rows)
    want = brute_versions(rows, listings)
    assert sorted((r.key, r.kind, r.id) for r in found.collect()) == sorted(w[:3] for w in want)
    ends = {(r.key, r.kind, r.id): r.valid_to for r in history.periods(found, ["price"], hot_rows).collect()}
    by = defaultdict(list)
    for k, kind, i, t in want:
        by[k].append((t, kind, i))
    for k, own in by.items():
        own.sort()
        for a, b in zip(own, [*own[1:], (None,)], strict=True):
            assert ends[k, a[1], a[2]] == b[0]


def test_satellite_append_and_edges(spark):
    schema = "key long, t timestamp, kind int, id long, a string, b int, hash_diff string"
    old = spark.createDataFrame([(1, DAY, 0, 1, "x", 1, "-"), (1, DAY + timedelta(1), 0, 2, "x", None, "-"), (1, DAY + timedelta(2), 0, 3, "x", None, "-")], schema)
    base = history.satellite(old, ["a", "b"])
    assert sorted(r.id for r in base.collect()) == [1, 2]
    news = spark.createDataFrame([(1, DAY + timedelta(3), 0, 4, "x", None, "-"), (1, DAY + timedelta(4), 0, 5, "y", None, "-"), (2, DAY, 0, 6, None, None, "-"), (1, DAY, 0, 7, "late", 1, "-"), (None, DAY, 0, 8, "n", 1, "-")], schema)
    assert sorted(r.id for r in history.append(base, news, ["a", "b"]).collect()) == [5, 6]
    # a late row hides no later one of its own values
    more = spark.createDataFrame([(1, DAY, 0, 1, "z", 1, "-"), (1, DAY + timedelta(9), 0, 9, "z", 1, "-"), (1, DAY + timedelta(10), 0, 10, "z", 1, "-")], schema)
    assert [r.id for r in history.append(base, more, ["a", "b"]).collect()] == [9]
    assert history.satellite(old.limit(0), ["a"]).count() == 0


# --- 5 ---


def brute_tree(links):
    up = {}
    for i, p in links:
        if i is not None:
            up.setdefault(i, []).append(p)
    up = {i: min((p for p in ps if p is not None), default=None) for i, ps in up.items()}
    out = {}
    for i in up:
        path, x = [], i
        while x is not None and x in up and x not in path:
            path.append(x)
            x = up[x]
        loop = x is not None and x in path
        out[i] = (None if loop else path[::-1], loop and x == i, loop and x != i)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    links = [(1, None), (2, 2), (3, 4), (4, 5), (5, 3), (6, 3), (7, 6), (8, 999), (9, 10), (10, 9), (None, 1)]
    links += [(i, i - 1) for i in range(20, 50)] + [(i, rng.choice([1, 8, 25, 6])) for i in range(60, 90)] + [(i, rng.randrange(60, i)) for i in range(90, 130)]
    links += [(1, None), (60, None)]
    got = {r.id: (r.path, r.on_cycle, r.below_cycle) for r in tree.hierarchy(spark.createDataFrame([(*x, "n", 0) for x in links], "id long, parent_id long, path string, depth int")).collect()}
    assert got == brute_tree(links)


def test_hierarchy_edges(spark):
    empty = spark.createDataFrame([], "id long, parent_id long")
    assert tree.hierarchy(empty).count() == 0
    one = tree.hierarchy(spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, parent_id long"))
    assert sorted((r.ancestor, r.descendant, r.distance) for r in tree.descendants(one).collect()) == [(1, 2, 1), (1, 3, 2), (2, 3, 1)]
    assert [(r.depth, r.root) for r in one.orderBy("id").collect()] == [(0, 1), (1, 1), (2, 1)]


def test_a_hot_parent_and_cycles_alone(spark):
    links = [(1, None), (2, 1)] + [(i, 2) for i in range(10, 1500)] + [(2001, 2002), (2002, 2003), (2003, 2001), (2004, 2003)] + [(3000, 3000), (3001, 3000)]
    df = spark.createDataFrame(links, "id long, parent_id long")
    assert {r.id for r in tree.cycles(df).collect()} == {2001, 2002, 2003, 3000}
    got = {r.id: (r.path, r.on_cycle, r.below_cycle) for r in tree.hierarchy(df).collect()}
    assert got == brute_tree(links)
    assert tree.cycles(df.limit(0)).count() == 0
