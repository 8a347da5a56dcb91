"""Linkage of listings to products by name, category rules and slugs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import specs as S
from ..functions import text as T
from ..session import written

THRESHOLD = 85.0

# --- fixed values: ordered patterns and the category they name ---
CATEGORY_RULES = [
    (r"peinture\s+int[eé]rieure|peinture\s+mur|peinture\s+plafond", "peinture-interieure"),
    (r"peinture\s+ext[eé]rieure|peinture\s+fa[cç]ade", "peinture-exterieure"),
    (r"lasure|vernis|vitrificateur", "lasure-vernis"),
    (r"enduit|sous.couche|pr[eé]paration|rebouchage|lissage", "enduit-preparation"),
    (r"peinture|rouleau|pinceau|b[âa]che|ruban.*masqu", "peinture"),
    (r"perceuse|visseuse|perforateur|meuleuse|ponceuse|scie\s+(?:sauteuse|circulaire|sabre)|rabot|d[eé]fonceuse|d[eé]coupeur|cloueur", "outillage-electroportatif"),
    (r"tournevis|marteau|pince|cl[eé]|niveau|m[eè]tre|scie\s+(?!sauteuse|circulaire)|cisaille|lime|burin|spatule|truelle|cutter|couteau|equerre|compas", "outillage-main"),
    (r"vis\b|boulon|[eé]crou|cheville|rivet|agrafe|clou|rondelle|tige\s+filet", "visserie-fixation"),
    (r"mesure|tra[cç]age|laser|d[eé]tecteur|t[eé]l[eé]m[eè]tre", "mesure-tracage"),
    (r"outillage|outil|servante|caisse.*outil|coffret|rangement.*atelier|[eé]tabli", "outillage"),
    (r"c[aâ]ble|gaine|fil\s+[eé]lectrique|c[aâ]blage", "cables-fils"),
    (r"interrupteur|prise|appareillage|va.et.vient", "appareillage"),
    (r"tableau\s+[eé]lectrique|disjoncteur|diff[eé]rentiel|module", "tableau-electrique"),
    (r"[eé]clairage|ampoule|led|spot|plafonnier|lampe|luminaire|projecteur|r[eé]glette", "eclairage"),
    (r"[eé]lectricit[eé]|domino|connecteur|bornier|goulotte", "electricite"),
    (r"tuyau|raccord|tube|cuivre|per|multicouche|pvc|soudure|brasure", "tuyauterie-raccords"),
    (r"robinet|mitigeur|robinetterie|vanne", "robinetterie"),
    (r"wc|toilette|lavabo|vasque|baignoire|douche|sanitaire|siphon", "sanitaire"),
    (r"chauffage|radiateur|chauffe.eau|thermostat|po[eê]le", "chauffage"),
    (r"plomberie|joint|t[eé]flon|filasse", "plomberie"),
    (r"ciment|mortier|ragr[eé]age", "ciment-mortier"),
    (r"b[eé]ton|ferraillage|armature|treillis", "beton"),
    (r"brique|parpaing|bloc|agglo", "briques-parpaings"),
    (r"acier|fer|m[eé]tal|profil[eé]", "acier-ferraillage"),
    (r"charpente|bois\s+(?:de\s+)?construct|madrier|bastaing|chevron|lambourde|poutre", "bois-charpente"),
    (r"couverture|toiture|tuile|go[uû]tti[eè]re|ardoise|fa[iî]ti[eè]re", "couverture-toiture"),
    (r"gros.oeuvre|coffrage|[eé]tai|[eé]chafaudage", "gros-oeuvre"),
    (r"isolation|isolant|laine.*(?:verre|roche)|polystyr[eè]ne|placo.*phonique", "isolation"),
    (r"pl[aâ]tre|placo|cloison|rail|montant|ossature", "platrerie-cloisons"),
    (r"menuiserie|fen[eê]tre|porte|volet|store|portail|escalier", "menuiserie"),
    (r"carrelage|fa[iï]ence|mosaique|cr[eé]dence|sol.*mur", "carrelage-sol"),
    (r"fa[cç]ade|cr[eé]pi|enduit.*fa[cç]ade|ravalement", "facade-enduit"),
    (r"parquet|stratifi[eé]|lino|vinyl|moquette|sol\s+(?:pvc|souple|stratifi)", "carrelage-sol"),
    (r"serrure|verrou|cylindre|poign[eé]e.*porte|cadenas", "serrurerie"),
    (r"boulonnerie|goujon|tige", "boulonnerie"),
    (r"charni[eè]re|ferrure|[eé]querr|support|console|cr[eé]maill[eè]re", "charnieres-ferrures"),
    (r"quincaillerie", "quincaillerie"),
]
# --- end of fixed values ---


def _lcs(a: str, b: str) -> int:
    """Common subsequence by a bit row over the letters of `a`."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for y in b:
        kept = row & where.get(y, 0)
        row = ((row + kept) | (row - kept)) & full
    return len(a) - row.bit_count()


def score(a: str, b: str) -> float:
    """As functions.text.token_sort_ratio, for Python."""
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 200.0 * _lcs(x, y) / (len(x) + len(y)) if x or y else 0.0


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


KEYS = ("color", "volume", "dimensions", "weight", "finish", "power", "pack")
NODES_A_SIDE = 4_000  # of one block compared at once; larger blocks are cut into pieces, each against each


def _named(df: DataFrame, name: str, as_id: str) -> DataFrame:
    """Rows with canonical name and key fields in one text (an empty part for none); null names are left out."""
    k = S.key_specs(F.col(name))
    rows = df.filter(F.col(name).isNotNull()).select(F.col("id").alias(as_id), T.canonical_name(F.col(name)).alias("canon"), k.alias("k"))
    return rows.select(as_id, "canon", F.concat_ws("\x1f", *[F.coalesce(F.col(f"k.{x}"), F.lit("")) for x in KEYS]).alias("keys"))


def _letters(texts: list[str], points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, numbers of the letters padded with len(points), counts of each letter) of texts."""
    size = np.array([len(t) for t in texts])
    at = np.searchsorted(points, np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4"))
    padded = np.full((len(texts), int(size.max())), len(points), dtype=np.int64)
    padded[np.arange(padded.shape[1]) < size[:, None]] = at
    counts = np.bincount(np.repeat(np.arange(len(texts)), size) * len(points) + at, minlength=len(texts) * len(points))
    return size, padded, counts.reshape(len(texts), len(points))


def _bits(rows: np.ndarray) -> np.ndarray:
    """Rows of truth values as 64-bit words."""
    packed = np.packbits(rows, axis=1)
    more = -packed.shape[1] % 8 if packed.shape[1] else 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, more)))).view(np.uint64)


def _lcs_pairs(where: np.ndarray, i: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """`_lcs` of many pairs at once: bit rows of 64-bit words with carry; `where` is [name, letter, word]."""
    words = where.shape[2]
    full = np.uint64(2**64 - 1)
    row = np.full((words, len(i)), full)
    for t in range(y.shape[1]):
        at, carry = where[i, y[:, t]], None
        for w in range(words):
            kept = row[w] & at[:, w]
            total = row[w] + kept
            over = total < kept
            if carry is not None:
                total += carry
                over |= total < carry
            row[w] = total | (row[w] & ~at[:, w])
            carry = over.astype(np.uint64)
    left = np.clip(size[i][None, :] - 64 * np.arange(words)[:, None], 0, 64)
    used = np.where(left == 64, full, (np.uint64(1) << (left % 64).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~row & used).sum(axis=0).astype(np.int64)


def similar(a: list[tuple[str, str]], b: list[tuple[str, str]], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of all pairs of (canonical name, key fields) that are compatible and score `threshold` or more.

    Left names with the same key fields meet only the right names whose fields are compatible. The letters two names
    share, each counted, bound their common subsequence: as sets of bits their intersection gives the bound of all
    these pairs, and only pairs that can reach the threshold are scored. No pair is lost.
    """
    names = [[" ".join(sorted(n.split())) for n, _ in side] for side in (a, b)]
    points = np.unique(np.frombuffer("".join(names[0] + names[1]).encode("utf-32-le"), dtype="<u4"))
    (la, xa, ca), (lb, xb, cb) = (_letters(n, points) for n in names)
    cap = np.minimum(ca.max(axis=0), cb.max(axis=0))
    letter = np.repeat(np.arange(len(points)), cap)
    nth = np.arange(len(letter)) - np.repeat(np.cumsum(cap) - cap, cap)
    ua, ub = (_bits(c[:, letter] > nth) for c in (ca, cb))
    known: dict[str, int] = {"": 0}
    ka, kb = (np.array([[known.setdefault(x, len(known)) for x in k.split("\x1f")] for _, k in side]) for side in (a, b))
    left_keys, left_of = np.unique(ka, axis=0, return_inverse=True)
    right_keys, right_of = np.unique(kb, axis=0, return_inverse=True)
    order = np.argsort(left_of.ravel(), kind="stable")
    ends = np.cumsum(np.bincount(left_of.ravel(), minlength=len(left_keys)))
    pairs = []
    for k, key in enumerate(left_keys):
        fits = ((right_keys == key) | (right_keys == 0) | (key == 0)).all(axis=1)
        j = np.flatnonzero(fits[right_of.ravel()])
        rows = order[ends[k - 1] if k else 0 : ends[k]]
        step = max(1, 1_000_000 // max(1, len(j) * ub.shape[1]))
        for start in range(0, len(rows) if len(j) else 0, step):
            i = rows[start : start + step]
            shared = np.bitwise_count(ua[i][:, None, :] & ub[j][None, :, :]).sum(axis=2, dtype=np.int64)
            p, q = np.nonzero(200.0 * shared >= threshold * (la[i][:, None] + lb[j][None, :]))
            pairs.append((i[p], j[q]))
    empty = np.zeros(0, dtype=np.int64)
    if not pairs:
        return empty, empty, empty.astype(float)
    i, j = (np.concatenate(c) for c in zip(*pairs, strict=True))
    by_left = np.argsort(i, kind="stable")
    i, j = i[by_left], j[by_left]
    words = -(-int(la.max()) // 64)
    step = max(1, 32_000_000 // (8 * words * (len(points) + 1)))  # left names whose bit rows are held at once
    out = []
    for start in range(0, len(a), step):
        size, letters = la[start : start + step], xa[start : start + step]
        where = np.zeros((len(size), len(points) + 1, words), dtype=np.uint64)
        for t in range(int(size.max())):
            where[np.arange(len(where)), letters[:, t], t // 64] |= np.uint64(1 << t % 64)
        where[:, len(points)] = 0
        lo, hi = np.searchsorted(i, [start, start + step])
        for at in range(lo, hi, 100_000):
            p, q = i[at : min(hi, at + 100_000)], j[at : min(hi, at + 100_000)]
            value = 200.0 * _lcs_pairs(where, p - start, xb[q][:, : int(lb[q].max())], size) / (la[p] + lb[q])
            good = value >= threshold
            out.append((p[good], q[good], value[good]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (empty, empty, empty.astype(float))


def edges(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of nodes (node, canon, keys): all pairs where the right first word starts with the left one.

    A right node meets the block of each prefix of its first word that is the first word of a left node. Blocks are
    cut into pieces of a bounded number of nodes, each left piece against each right one. Empty names meet none.
    """
    word = F.split("canon", " ")[0]
    a = left.filter("canon != ''").select("node", "canon", "keys", word.alias("block"))
    prefixes = F.transform(F.sequence(F.lit(1), F.length(word)), lambda n: F.substring(word, F.lit(1), n))
    b = right.filter("canon != ''").select("node", "canon", "keys", F.explode(prefixes).alias("block"))
    parts = lambda df, n: df.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / NODES_A_SIDE).cast("int").alias(n))
    sizes = parts(a, "of_a").join(parts(b, "of_b"), "block")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.join(sizes, "block").select("block", own(F.col("of_a")).alias("i"), each("of_b").alias("j"), F.lit(0).alias("side"), "node", "canon", "keys")
    b = b.join(sizes, "block").select("block", each("of_a").alias("i"), own(F.col("of_b")).alias("j"), F.lit(1).alias("side"), "node", "canon", "keys")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def compared() -> pd.DataFrame:
            (ids, x), (others, y) = (([r[0] for r in side], [r[1:] for r in side]) for side in sides)
            i, j, value = similar(x, y, threshold)
            return pd.DataFrame({"a": np.array(ids, dtype=np.int64)[i], "b": np.array(others, dtype=np.int64)[j], "score": value})

        current, sides = None, ([], [])
        for batch in batches:
            for block, i, j, side, *row in zip(*(batch[c].tolist() for c in ("block", "i", "j", "side", "node", "canon", "keys")), strict=True):
                if (block, i, j) != current:
                    if sides[0] and sides[1]:
                        yield compared()
                    current, sides = (block, i, j), ([], [])
                sides[side].append(tuple(row))
        if sides[0] and sides[1]:
            yield compared()

    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = a.unionByName(b).repartition(tasks, "block", "i", "j").sortWithinPartitions("block", "i", "j")
    return rows.mapInPandas(run, "a long, b long, score double")


def _nodes(rows: DataFrame, as_id: str) -> DataFrame:
    """Rows of one canonical name and the same key fields are one node, with its first and last id."""
    return rows.groupBy("canon", "keys").agg(F.min(as_id).alias("node"), F.max(as_id).alias("last"))


def candidates(listings: DataFrame, products: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(listing_id, product_id, score) of unlinked listings and products whose first word starts with the listing's.

    Pairs whose key fields agree and that score `threshold` or more; null and empty names meet none.
    """
    left = written(_named(listings.filter("product_id is null"), "store_product_name", "listing_id"))
    right = written(_named(products, "name", "product_id"))
    a, b = written(_nodes(left, "listing_id")), written(_nodes(right, "product_id"))
    found = edges(a, b, threshold).select(F.col("a").alias("node_a"), F.col("b").alias("node_b"), F.round("score", 6).alias("score"))
    lefts = left.join(a.select("canon", "keys", F.col("node").alias("node_a")), ["canon", "keys"]).select("listing_id", "node_a")
    rights = right.join(b.select("canon", "keys", F.col("node").alias("node_b")), ["canon", "keys"]).select("product_id", "node_b")
    return lefts.join(found, "node_a").join(rights, "node_b").select("listing_id", "product_id", "score")


def _makers(nodes: DataFrame, sees: DataFrame) -> DataFrame:
    """(node) of the nodes that make a product: those that see no earlier one that makes one.

    `sees` is (a, b), b an earlier node than a. In a round the nodes that see none left make one, those that see
    a maker make none; the first node left is always settled, so the rounds end.
    """
    making = written(nodes.select("node").join(sees.select(F.col("a").alias("node")), "node", "left_anti"))
    made, left = making, sees
    while True:
        none = written(left.join(making.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).distinct())
        kept = written(left.join(none.select(F.col("node").alias("a")), "a", "left_anti").join(none.select(F.col("node").alias("b")), "b", "left_anti"))
        making = written(left.select(F.col("a").alias("node")).distinct().join(none, "node", "left_anti").join(kept.select(F.col("a").alias("node")), "node", "left_anti"))
        made, left = made.unionByName(making), kept
        if left.isEmpty():
            return made


def greedy(listings: DataFrame, products: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(listing_id, product_id, made) as if unlinked listings were taken one after the other by ascending id.

    A listing takes the best of the products whose first word starts with its own: the highest score of `threshold`
    or more, at equal scores the smallest id, products made here last. A listing that meets none makes one (made
    true, product_id the listing's id negated), which later listings can meet. All pairs are found first; a name
    makes a product if no product and no earlier maker is near, and then each listing takes its best. Listings
    with an empty name score nothing and make one each; null names are left out.
    """
    left = written(_named(listings.filter("product_id is null"), "store_product_name", "listing_id"))
    nodes = written(_nodes(left, "listing_id"))
    given = written(edges(nodes, written(_nodes(_named(products, "name", "product_id"), "product_id")), threshold))
    free = written(nodes.filter("canon != ''").join(given.select(F.col("a").alias("node")), "node", "left_anti"))
    among = written(edges(nodes, free, threshold).filter("a != b"))
    made = written(_makers(free, among.filter("b < a").join(free.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b")))
    best = given.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("score", F.lit(1).alias("old"), (-F.col("b")).alias("minus"))).alias("choice"))
    taken = among.join(made.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b", "score").unionByName(made.select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(100.0).alias("score")))
    later = taken.select(F.col("a").alias("node"), F.struct("score", F.lit(0).alias("old"), (-F.col("b")).alias("minus")).alias("choice"))
    rows = written(left.join(nodes.select("canon", "keys", "node"), ["canon", "keys"]).select("listing_id", "node"))
    choices = rows.join(best.unionByName(later), "node").filter((F.col("choice.old") == 1) | (-F.col("choice.minus") < F.col("listing_id")))
    chosen = choices.groupBy("listing_id").agg(F.max("choice").alias("choice"))
    product = F.when(F.col("choice.old") == 1, -F.col("choice.minus")).otherwise(F.coalesce(F.col("choice.minus"), -F.col("listing_id")))
    return rows.join(chosen, "listing_id", "left").select("listing_id", product.alias("product_id")).withColumn("made", F.col("product_id") < 0)


def incompatible(listings: DataFrame, products: DataFrame) -> DataFrame:
    """(listing_id, product_id) of products with more than three listings where the key fields of the names differ."""
    many = listings.filter("product_id is not null").groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 3").select("product_id")
    names = products.select(F.col("id").alias("product_id"), S.key_specs(F.col("name")).alias("of_product")).join(many, "product_id", "left_semi")
    # fields are read from the names of these products' listings only
    own = listings.join(many, "product_id", "left_semi")
    rows = own.select(F.col("id").alias("listing_id"), "product_id", S.key_specs(F.col("store_product_name")).alias("of_listing")).join(names, "product_id")
    return rows.filter(~S.compatible(F.col("of_listing"), F.col("of_product"))).select("listing_id", "product_id")


def categorize(products: DataFrame, listings: DataFrame, categories: DataFrame, rules: list[tuple[str, str]] = CATEGORY_RULES) -> DataFrame:
    """(id, category_id) of the products without a category: the first rule that fits and whose slug is a category's.

    The text is the product's name and the category path of its first listing, where that has one. Of categories
    with one slug the last id counts; null where no rule is left. A null name is an empty one.
    """
    path = listings.filter("product_id is not null").groupBy(F.col("product_id").alias("id")).agg(F.min_by("category_path", "id").alias("path"))
    slugs = [slug for _, slug in rules]
    known = {r["slug"]: r["id"] for r in categories.filter(F.col("slug").isin(slugs)).groupBy("slug").agg(F.max("id").alias("id")).collect()}  # one row a rule at most
    text = F.lower(F.concat(F.coalesce("name", F.lit("")), F.coalesce(F.concat(F.lit(" "), F.nullif("path", F.lit(""))), F.lit(""))))
    found: Column = F.lit(None).cast("long")
    for pattern, slug in reversed(rules):
        if slug in known:
            found = F.when(F.col("text").rlike("(?u)" + pattern), F.lit(known[slug]).cast("long")).otherwise(found)
    open_ = products.filter("category_id is null").select("id", "name").join(path, "id", "left")
    return open_.select("id", text.alias("text")).select("id", found.alias("category_id"))


def assign_slugs(products: DataFrame) -> DataFrame:
    """(id, slug), unique: the plain slug for the smallest id, then `-1`, `-2` ... where that is free.

    Suffixes only add `-digits`, so products whose slugs are equal without such ends form a closed group. A group
    with one plain slug only is numbered by a window; the others, where `foo` and `foo-1` meet, are assigned one
    after the other in pandas.
    """
    rows = products.select("id", T.slug_base(F.col("name")).alias("base")).withColumn("stem", F.regexp_replace("base", r"(-[0-9]+)+$", ""))
    kinds = rows.groupBy("stem").agg(F.count_distinct("base").alias("bases"))
    rows = rows.join(kinds, "stem")
    plain = rows.filter("bases = 1").withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy("id")))
    plain = plain.select("id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), (F.col("k") - 1).cast("string"))).alias("slug"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        after: dict[str, int] = {}
        out = []
        for r in group.sort_values("id").itertuples():
            slug, k = r.base, after.get(r.base, 1)
            while slug in taken:
                slug, k = f"{r.base}-{k}", k + 1
            after[r.base] = k
            taken.add(slug)
            out.append((r.id, slug))
        return pd.DataFrame(out, columns=["id", "slug"])

    mixed = rows.filter("bases > 1").select("id", "base", "stem").groupBy("stem").applyInPandas(run, "id long, slug string")
    return plain.unionByName(mixed)
