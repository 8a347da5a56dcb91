"""Problems 6 to 10: brute force, exact round trips, held-out accuracy, and the edge cases."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from compare import difference, duck

from pricegrain.llm import abuse, matching, names, packing, queries, survivors, tokens

FOLDER = "/root/testdata/sf0.001"
DAY = datetime(2024, 1, 1)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    assert difference(spark, duck(FOLDER), FOLDER, name, queries.QUERIES[name], queries.SQL[name]) == ""


# --- 6 ---

LISTINGS = "id long, product_id long, image_url string, store_ean string, last_scraped_at timestamp, n int, own int, t string"
PRODUCTS = "id long, ean string, brand string, updated_at timestamp, code string"


def test_survivors(spark):
    good, other = "2946391575964", "2953318235740"
    listings = [
        (1, 1, "https://a.example/1.jpg", good, DAY, 0, 0, ""), (2, 1, "https://a.example/2.jpg", None, DAY + timedelta(1), 0, 0, ""), (3, 1, "https://a.example/no-image.jpg", "9999999999994", DAY + timedelta(2), 0, 0, ""),
        (4, 2, "https://a.example/4.jpg", other, None, 0, 0, ""), (5, 2, "https://a.example/5.jpg", other, None, 0, 0, ""),
        (6, 3, "https://a.example/2.jpg2", good, DAY, 0, 0, ""), (7, None, "https://a.example/7.jpg", good, DAY, 0, 0, ""),
        (8, 4, "https://a.example/s.jpg", "2946391575965", DAY, 0, 0, ""), (9, 4, "//a.example/9.jpg", " " + good + " ", DAY - timedelta(1), 0, 0, ""), (10, 5, "https://a.example/s.jpg", None, DAY, 0, 0, ""), (11, 5, None, None, DAY, 0, 0, ""),
    ]
    products = [(1, None, "x", DAY, ""), (2, good, "Inconnu", DAY, ""), (3, None, None, None, ""), (4, "0000000000000", "x", DAY, ""), (5, good, " Brumac ", None, ""), (6, good, "Later", DAY, ""), (7, other, "Lone", DAY, "")]
    got = sorted((r.group_id, r.attribute, r.source_id, r.value) for r in survivors.representatives(spark.createDataFrame(listings, LISTINGS), spark.createDataFrame(products, PRODUCTS)).collect())
    assert got == [(1, "ean", 1, good), (1, "image_url", 2, "https://a.example/2.jpg"), (2, "brand", 6, "Later"), (2, "image_url", 4, "https://a.example/4.jpg"), (4, "ean", 9, good)]
    assert survivors.representatives(spark.createDataFrame([], LISTINGS), spark.createDataFrame([], PRODUCTS)).count() == 0


# --- 7 ---


def test_names_are_read_alike():
    common, brands = frozenset(["panneau", "isolant", "lot", "de"]), {"brumac": "brumac"}
    a = names.read_name("Isolant panneau Brumac® Zorubal Éco 1,35X0,6X0,145 m bte 4", common, brands)
    b = names.read_name("BRUMAC - Panneau isolant - Zorubal Eco - 1350 x 600 x 145mm - lot de 4", common, brands)
    assert a == b and a.pack == "4" and dict(a.sizes)["dim"] == "1350x600x145" and a.range == "zorubal"
    assert names.read_name("Peinture fa&ccedil;ade 2,5 litres gris anthr. satinée", common, brands).traits == {"gris", "anthracite", "satin"}
    assert names.read_name("Disque 125 x 1 x5", common, brands).pack == "5" and names.read_name(None, common, brands).kind == ""
    assert names.near("zorubal", "zorbual") and names.near("zorubal", "zorubbal") and not names.near("zorubal", "zirobal")


def test_an_item_with_many_spellings_is_one_cluster(spark):
    rng = random.Random(5)
    word, letters = "zorubalimek", "abcdefghijklmnopqrstuvwxyz"

    def slip():
        i, how = rng.randrange(len(word)), rng.randrange(3)
        return word[:i] + (rng.choice(letters) if how < 2 else "") + word[i + (how != 1) :]

    brands, others = ["Brumac", "Ostrane", "Tiravex", "Jaltec"], ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) + "x" for _ in range(150)]
    rows = [(i, f"Vernis parquet 5 L mat Brumac {word if rng.random() < 0.6 else slip()}") for i in range(1, 401)]
    rows += [(1000 + i, f"{('Lasure bois 2 L', 'Vernis parquet 5 L mat', 'Enduit de lissage sac 5 kg')[i % 3]} {brands[i % 4]} {others[i % 150]}") for i in range(800)]
    df = spark.createDataFrame([(i, n, None, None) for i, n in rows], "id long, store_product_name string, store_ean string, store_manufacturer_ref string")
    products = spark.createDataFrame([(b,) for b in brands for _ in range(3)], "brand string")
    got = {r.id: r.cluster for r in matching.group(df, products).collect()}
    assert len({got[i] for i in range(1, 401)}) == 1 and not {got[i] for i in range(1, 401)} & {c for i, c in got.items() if i > 1000}


def test_clustering_goes_on_until_no_edge_is_left(spark):
    # a path whose ranks fall along it: a round settles two nodes
    edges = [(x, y, 2, (1, 100 - x, -x), (1, 100 - y, -y)) for i in range(20) for x, y in ((i, i + 1), (i + 1, i))]
    rank = "struct<complete: int, n: long, minus: long>"
    got = {r.node: r.pivot for r in matching.cluster(spark.createDataFrame(edges, f"a long, b long, w int, ra {rank}, rb {rank}"), matching.MatchRules()).collect()}
    assert got == {i: i - i % 2 for i in range(20)}
    with pytest.raises(RuntimeError, match="left after 3 rounds"):
        matching.cluster(spark.createDataFrame(edges, f"a long, b long, w int, ra {rank}, rb {rank}"), matching.MatchRules(most_rounds=3))


MATCHED = "id long, store_product_name string, store_ean string, store_manufacturer_ref string, node string, cluster int"


def test_listings_are_grouped(spark):
    rng = random.Random(2)
    brands, kinds = ["Brumac", "Ostrane", "Tiravex", "Jaltec"], ["Vernis parquet {} mat", "Lasure bois {} noyer satin", "Enduit de lissage sac {}", "Peinture façade {} blanc mat"]
    rows, truth, i = [], {}, 0
    for item in range(60):
        brand, kind, word = rng.choice(brands), kinds[item % 4], "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) + "x"
        unit = [("{} kg", "{} kilos"), ("{} L", "{} litres")][item % 4 != 2]
        size = rng.choice([1, 2, 5, 10])
        for k in range(rng.randrange(1, 6)):
            i += 1
            parts = [kind.format(unit[k % 2].format(size)), brand.upper() if k % 2 else brand, word if k != 3 else word[:2] + word[3] + word[2] + word[4:]]
            rng.shuffle(parts)
            rows.append((i, " ".join(parts) + (" PROMO" if k == 2 else ""), None, None, "", 0))
            truth[i] = item
    rows += [(1001, None, None, None, "", 0), (1002, "", "2946391575964", None, "", 0), (1003, None, "2946391575964", None, "", 0)]
    products = spark.createDataFrame([(n, b) for n, b in enumerate(brands * 3)], "id long, brand string")
    groups = matching.group(spark.createDataFrame(rows, MATCHED), products, matching.MatchRules(share=0.05, least=8))
    got = {(r.listing_id_a, r.listing_id_b) for r in matching.pairs(groups).collect()}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert groups.count() == len(rows)
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.97 * len(got)
    assert not [p for p in got if max(p) > 1000]


def test_no_listings(spark):
    empty = spark.createDataFrame([], MATCHED)
    assert matching.group(empty, spark.createDataFrame([], "id long, brand string")).count() == 0


# --- 8 ---


@pytest.mark.parametrize(("chunk", "overlap"), [(tokens.CHUNK, tokens.OVERLAP), (64, 24), (7, 3)])
def test_ids_are_those_of_the_library(spark, chunk, overlap):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    library.encode_special_tokens = True
    texts = ["", None, "   \n\n  ", "Bonjour l'été, c'est 12,5 m² !\n\n\tfin  ", "a" * 300, "x  y\r\n" * 40, "<|endoftext|> 😀👍🏽 é́ œ" * 9, "mot " * 500, " " * 200 + "z", "1234567890" * 30 + "'s''s 'll"]
    rows = [(i, x, "ids") for i, x in enumerate(texts)]
    got = {r.doc_id: list(r.ids) for r in tokens.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), chunk=chunk, overlap=overlap).collect()}
    assert got == {i: library.encode(x, add_special_tokens=False).ids if x else [] for i, x in enumerate(texts)}
    assert all(tokens.decode(got[i]) == (x or "") for i, x in enumerate(texts))
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, texts[4]), (1, texts[4]), (None, texts[5]), (None, None)], "doc_id long, text string")
    assert sorted(r.n for r in tokens.encode(twice, chunk=chunk, overlap=overlap, count=True).collect()) == sorted([0, len(got[5]), len(got[4]), len(got[4])])


# --- 9 ---


def test_packing_keeps_every_item(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0, -3, 100, 101, 250, *[rng.randrange(1, 100) for _ in range(20)]]), "c", 0) for i in range(1500)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, n int, container string, length int"), "doc_id", "n", 100, 8, 64).collect()
    size = defaultdict(int)
    filled = defaultdict(list)
    for r in out:
        size[r.doc_id] += r.length
        if r.container is not None:
            filled[r.container].append((r.offset, r.length))
        assert (r.container is None) == (r.length == 0)
    assert dict(size) == {i: max(n or 0, 0) for i, n, *_ in rows}
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    assert not [r for r in out if r.piece and dict((i, n) for i, n, *_ in rows)[r.doc_id] <= 100]
    total = sum(size.values())
    assert total / (100 * len(filled)) > 0.9
    assert packing.pack(spark.createDataFrame([], "doc_id long, n int"), "doc_id", "n").count() == 0


# --- 10 ---


def test_spellings_become_one():
    assert abuse.normalise("C-O-N-N-A-R-D") == abuse.normalise("connard") == abuse.normalise("cooonnnaaard") == abuse.normalise("c0nn4rd") == abuse.normalise("соnnаrd")
    assert abuse.normalise("Il me faut 12,5 kg") == abuse.normalise("il me faut 7 KG")
    assert abuse.windows("") == [] and abuse.windows("  \n ") == []


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["Livraison en {} jours, carton intact.", "Le coloris {} ne ressemble pas à la photo.", "La notice est mal traduite mais on s'en sort.", "Comment tuer la mousse d'un mur en {} jours ?", "Je suis furieux, remboursez-moi {} euros.", "Produit solide, je recommande."]
    rude = ["ferme ta gueule espèce de {}", "va crever sale {}", "les {} n'ont rien à faire ici, dehors", "je vais te casser les dents {}"]
    names_ = ["crétin", "abruti", "idiot", "tocard"]
    texts, bad = [], []
    for _ in range(n):
        parts = [rng.choice(plain).format(rng.randrange(90)) for _ in range(rng.randrange(2, 6))]
        is_bad = rng.random() < 0.2
        if is_bad:
            line = rng.choice(rude).format(rng.choice(names_))
            line = rng.choice([line, line.upper(), line.replace("e", "eee"), line.replace("a", "@")])
            parts.insert(rng.randrange(len(parts) + 1), line + " !")
        texts.append(" ".join(parts))
        bad.append(is_bad)
    return texts, bad


def test_held_out_accuracy_with_wrong_labels():
    texts, bad = corpus(700, 1)
    rng = random.Random(9)
    model = abuse.fit(texts, [not b if rng.random() < 0.04 else b for b in bad])
    of = abuse.scorer(model)
    fresh, truth = corpus(300, 2)
    said = [max(map(of, abuse.windows(t)), default=-1) > model.threshold for t in fresh]
    hit = sum(a and b for a, b in zip(said, truth, strict=True))
    assert hit / sum(truth) > 0.9 and hit / max(1, sum(said)) > 0.9


def test_scores_of_odd_documents(spark):
    docs = [(1, None, "s", 0), (2, "", None, 0), (3, "  ", "s", 0), (4, "Produit solide. " * 3000, "s", 0), (5, "ferme ta gueule", "s", 0)]
    documents = spark.createDataFrame(docs, "doc_id long, text string, source string, score int")
    labels = spark.createDataFrame([(4, "ok"), (5, "unsure"), (None, "abusive"), (99, "abusive"), (5, None)], "doc_id long, verdict string")
    rows = {r.doc_id: r for r in abuse.score_documents(documents, labels).collect()}
    assert [rows[i].score for i in (1, 2, 3)] == [None] * 3 and not any(r.is_abusive for r in rows.values())
    assert {(r.source, r.documents) for r in abuse.rates(abuse.score_documents(documents, labels)).collect()} == {("s", 4), (None, 1)}
    assert abuse.score_documents(documents.limit(0), labels.limit(0)).count() == 0


def test_clusters_do_not_depend_on_partitions_and_kinds_are_learnt(spark):
    rng = random.Random(3)
    rows = [(i, f"{rng.choice(['Brouette', 'Vernis parquet', 'Seau maçon'])} {rng.choice([80, 100, 120])} L {rng.choice(['Brumac', 'Ostrane', 'Tiravex', ''])} {rng.choice(['zorubal', 'zorubla', 'milenad', 'pastorel', 'gidomur'])}", None, None) for i in range(1, 400)]
    rows += [(900, "Brouette 100 L Brumac zorubal", None, None), (901, "Brouette 100 L Brumac zorubal", None, None), (902, "Vernis", "2946391575964", None), (903, "Vernis", "2946391575964", None), (904, "Vernis", None, None), (905, "Vernis", "2953318235740", None)]
    df = spark.createDataFrame(rows, "id long, store_product_name string, store_ean string, store_manufacturer_ref string")
    products = spark.createDataFrame([(b,) for b in ("Brumac", "Ostrane", "Tiravex") * 3], "brand string")
    got = []
    for parts in ("3", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got.append({r.id: r.cluster for r in matching.group(df, products, matching.MatchRules(window=3, share=0.05, least=8)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got[0] == got[1] and len(set(got[0].values())) > 10
    assert got[0][900] == got[0][901] and got[0][902] == got[0][903] != got[0][905] and len({got[0][i] for i in (902, 904, 905)}) == 3
