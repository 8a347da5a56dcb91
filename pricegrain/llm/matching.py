"""Problem 7: listings of the same item, by multi-pass sorted neighbourhood and correlation clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread, written
from .names import FINISHES, FORMS, KNOWN, fold, near, read_name
from .survivors import usable_brand, usable_ean

ACCENTS = ("àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
SIGNATURE = ["kind", "brand", "range", "suffix", "sizes", "traits", "pack"]
#: What a node is compared by: hashes of its parts, 0 for a part it does not say.
PARTS = ["block", "brand_h", "range_h", "suffix_h", "finish", "form", "other"]
MOST_BRANDS = 100_000


@dataclass(frozen=True)
class MatchRules:
    window: int = 8  # neighbours compared on each side in a pass
    share: float = 0.004  # words in at least this share of all names are no range
    least: int = 12  # and in at least so many names
    most_rounds: int = 10_000  # of clustering, an error beyond; each settles a pivot at least


def _words(names: Column) -> Column:
    folded = F.translate(F.lower(F.regexp_replace(names, r"&([a-zA-Z])(?:acute|grave|circ|uml|cedil);", "$1")), *ACCENTS)
    return F.array_distinct(F.filter(F.split(folded, r"[^a-z]+"), lambda w: F.length(w) > 1))


def vocabulary(listings: DataFrame, products: DataFrame, rules: MatchRules) -> tuple[frozenset, dict[str, str]]:
    """(common words of names, first word of a brand -> brand), bounded by the share asked for and by MOST_BRANDS.

    Brands beyond that bound, the least frequent, are read as words of a range.
    """
    known = products.filter(usable_brand("brand")).groupBy(F.trim(F.lower("brand")).alias("b")).count().orderBy(F.desc("count"), "b").limit(MOST_BRANDS).collect()
    brands: dict[str, str] = {}
    for r in known:  # brands by falling frequency; of two with one first word the more frequent
        name = re.sub(r"[^a-z ]", "", re.sub(r" (?:sas|sarl|sa)$", "", fold(r["b"])))
        first = name.split()[0] if name.split() else ""
        if len(first) >= 4 and first not in KNOWN:
            brands.setdefault(first, name)
    n = listings.count()
    named = listings.select(_words(F.col("store_product_name")).alias("words"))
    brand = F.xxhash64(F.try_element_at(F.filter("words", lambda w: w.isin(list(brands))), F.lit(1))) if brands else F.lit(None).cast("long")
    known_brand = F.when(F.exists("words", lambda w: w.isin(list(brands))), brand) if brands else brand
    words = named.select("words", known_brand.alias("brand")).select(F.explode("words").alias("w"), "brand").groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min("brand").alias("low"), F.max("brand").alias("high"))
    # a word that goes with one brand only is a range, however many listings one item has
    several = F.lit(len(brands) < 3) | (F.col("low") != F.col("high"))
    common = frozenset(r["w"] for r in words.filter((F.col("n") >= max(rules.least, rules.share * n)) & several).collect())
    return common, brands


def read(listings: DataFrame, common: frozenset, brands: dict[str, str]) -> DataFrame:
    """id, the signature of the name, and the codes ean and ref (null where not usable)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name in batch["name"]:
                a = read_name(name, common, brands)
                rows.append((a.kind, a.brand, a.range, a.suffix, " ".join(f"{k}:{v}" for k, v in a.sizes), " ".join(sorted(a.traits)), a.pack))
            codes = {c: batch[c].tolist() for c in ("id", "ean", "ref")}
            yield pd.DataFrame({**codes, **dict(zip(SIGNATURE, map(list, zip(*rows, strict=True)), strict=True))} if rows else {c: [] for c in ["id", "ean", "ref", *SIGNATURE]})

    ref = F.upper(F.regexp_replace(F.regexp_replace("store_manufacturer_ref", r"(?i)^\s*r[ée]f\.?\s*", ""), "[^A-Za-z0-9]", ""))
    raw = listings.select(
        "id", F.col("store_product_name").alias("name"), F.when(usable_ean("store_ean"), F.trim("store_ean")).alias("ean"), F.when(F.length(ref) >= 5, ref).alias("ref")
    )
    return spread(raw).mapInPandas(run, "id long, ean string, ref string, kind string, brand string, range string, suffix string, sizes string, traits string, pack string")


def _two_slips(a: str, b: str) -> bool:
    """At most two edits apart, for words of eight letters or more."""
    if min(len(a), len(b)) < 7 or abs(len(a) - len(b)) > 2:
        return False
    row = list(range(len(b) + 1))
    before: list[int] = []
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
    return row[-1] <= 2


_ROW = ["pass", "node", "complete", "n", "code", *PARTS]
_EDGE = "a long, b long, w int, a_complete int, b_complete int, a_n long, b_n long"
_SLID = f"{_EDGE}, part int, pass int, key string, node long, complete int, n long, code long, {', '.join(f'{p} long' for p in PARTS)}, range string"
_SLID_ARROW = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]]) for f in _SLID.split(", ")])


def _compare(c: dict[str, np.ndarray], words: list[str], begin: int, window: int) -> dict[str, np.ndarray]:
    """Agreeing pairs of rows at most `window` apart whose later row is at `begin` or after; w as in `neighbours`.

    Soft token alignment: kind, sizes and pack must agree, range words may differ by a slip of the pen (two where
    all else agrees), brand and traits where both have them. With the same code saying less is enough. Rows with a
    `part` are compared with those of other parts only.
    """
    found = []
    for k in range(1, window + 1):
        i = np.arange(max(begin, k), len(words))
        a = i - k
        ok = (c["pass"][a] == c["pass"][i]) & (c["block"][a] == c["block"][i]) & (c["code"][a] == c["code"][i]) & (c["node"][a] != c["node"][i])
        if "part" in c:
            ok &= c["part"][a] != c["part"][i]
        a, i = a[ok], i[ok]
        same = {p: c[p][a] == c[p][i] for p in PARTS}
        ok = np.ones(len(a), dtype=bool)
        for p in ("brand_h", "finish", "form", "other"):
            ok &= same[p] | (c[p][a] == 0) | (c[p][i] == 0)
        both = (c["range_h"][a] != 0) & (c["range_h"][i] != 0)
        ok &= same["suffix_h"] | ~both
        traits = same["finish"] & same["form"] & same["other"]
        for x in np.nonzero(ok & both & ~same["range_h"])[0]:
            one, two = words[a[x]], words[i[x]]
            ok[x] = near(one, two) or (same["brand_h"][x] and c["brand_h"][a[x]] != 0 and traits[x] and _two_slips(one, two))
        full = (same["brand_h"] | both) & (same["range_h"] | both) & traits
        w = np.where(full | (c["code"][a] != 0), 2, 1)
        found.append({"a": c["node"][a[ok]], "b": c["node"][i[ok]], "w": w[ok], **{f"{s}_{n}": c[n][x[ok]] for s, x in (("a", a), ("b", i)) for n in ("complete", "n")}})
    return {n: np.concatenate([f[n] for f in found]) for n in found[0]}


def _slide(window: int, seams: bool):
    """Pairs of a sorted partition within the window; with `seams` its first and last rows too, which meet those of other partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = [*_ROW, *([] if seams else ["part"])]
        tail: pa.Table | None = None
        first: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            begin = tail.num_rows if tail is not None else 0
            table = pa.concat_tables([tail, table]) if tail is not None else table
            columns = {n: table.column(n).to_numpy() for n in names}
            found = _compare(columns, table.column("range").to_pylist(), begin, window)
            n = len(found["a"])
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if f.name in found else pa.nulls(n, f.type) for f in _SLID_ARROW], schema=_SLID_ARROW)
            if seams:
                head = table.slice(begin)
                first = head if first is None else first if first.num_rows >= window else pa.concat_tables([first, head])
                first = first.slice(0, 2 * window)
            tail = table.slice(max(0, table.num_rows - window))
        if seams and first is not None:
            # of a short partition the first rows are all there are
            edge = first if first.num_rows < 2 * window else pa.concat_tables([first.slice(0, window), tail])
            n = edge.num_rows
            own = {"w": pa.array([-1] * n, pa.int32()), "part": pa.array([part] * n, pa.int32())}
            for b in pa.table({f.name: own[f.name] if f.name in own else edge.column(f.name).cast(f.type) if f.name in edge.column_names else pa.nulls(n, f.type) for f in _SLID_ARROW}, schema=_SLID_ARROW).to_batches():
                yield b

    return run


def with_parts(nodes: DataFrame) -> DataFrame:
    """Nodes with the hashes they are compared by."""
    said = lambda c: F.when(c != "", F.xxhash64(c)).otherwise(F.lit(0).cast("long"))
    traits = F.filter(F.split("traits", " "), lambda t: t != "")
    of = lambda words: F.concat_ws(" ", F.filter(traits, lambda t: t.isin(sorted(words))))
    colour = F.concat_ws(" ", F.filter(traits, lambda t: ~t.isin(sorted(FINISHES | FORMS))))
    return nodes.select(
        "*", F.xxhash64("kind", "sizes", "pack").alias("block"), *[said(F.col(c)).alias(f"{c}_h") for c in ("brand", "range", "suffix")],
        said(of(FINISHES)).alias("finish"), said(of(FORMS)).alias("form"), said(colour).alias("other"),
    )


def neighbours(nodes: DataFrame, codes: DataFrame, rules: MatchRules) -> DataFrame:
    """(a, b, w, ...) of agreeing nodes that are neighbours in a pass; w 2: the same item, 1: nothing speaks against it but one says less.

    The last rows of a partition meet the first ones of the next in a table of two windows a partition, so what is
    compared does not depend on the partitions.
    """
    order = lambda *c: F.concat_ws("|", *c)
    keys = [
        (0, order("range", "kind", "sizes", "pack", "traits", "brand")),
        (1, order("kind", "sizes", "pack", "brand", "traits", "range")),
        (2, order("kind", "sizes", "pack", F.reverse("range"), "traits")),
        (3, order("kind", "brand", F.array_join(F.array_sort(F.array_distinct(F.split("range", ""))), ""), "sizes", "pack", "traits")),
    ]
    columns = ["node", "complete", "n", *PARTS, "range"]
    none = F.lit(0).cast("long").alias("code")
    named = nodes.filter("range != ''").select(*columns, none, F.explode(F.array(*[F.struct(F.lit(k).alias("pass"), key.alias("key")) for k, key in keys])).alias("x")).select("x.pass", "x.key", "code", *columns)
    unnamed = nodes.filter("range = ''").select(F.lit(1).alias("pass"), keys[1][1].alias("key"), none, *columns)
    coded = codes.select("pass", order("key", "kind", "sizes", "pack").alias("key"), F.xxhash64("key").alias("code"), *columns)
    rows = named.unionByName(unnamed).unionByName(coded)
    ordered = rows.repartitionByRange("pass", "key", "node").sortWithinPartitions("pass", "key", "node")
    found = written(ordered.mapInArrow(_slide(rules.window, True), _SLID))
    seams = found.filter("w = -1").select("part", "pass", "key", "code", *columns)
    across = seams.coalesce(1).sortWithinPartitions("pass", "key", "node").mapInArrow(_slide(rules.window, False), _SLID)
    edges = found.filter("w > 0").unionByName(across)
    both = edges.select("a", "b", "w", "a_complete", "b_complete", "a_n", "b_n").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", F.col("b_complete").alias("a_complete"), F.col("a_complete").alias("b_complete"), F.col("b_n").alias("a_n"), F.col("a_n").alias("b_n"))
    )
    # more parts said, then more listings, then the smaller id
    rank = lambda s: F.struct(F.col(f"{s}_complete").alias("complete"), F.col(f"{s}_n").alias("n"), (-F.col(s)).alias("minus"))
    return written(both.groupBy("a", "b").agg(F.max("w").alias("w"), F.max(rank("a")).alias("ra"), F.max(rank("b")).alias("rb")))


def cluster(edges: DataFrame, rules: MatchRules) -> DataFrame | None:
    """(node, pivot) of the nodes with agreeing edges, by correlation clustering in parallel rounds; None without any.

    In a round the nodes that rank above all their remaining agreeing neighbours are pivots; each takes the
    neighbours for which it is the highest-ranking pivot, until no agreeing neighbours are left.
    """
    strong = edges.filter("w = 2")
    if strong.isEmpty():
        return None
    done = None
    for _ in range(rules.most_rounds):
        best = strong.groupBy("a").agg(F.max("rb").alias("top"), F.first("ra").alias("ra"))
        pivots = best.filter("ra > top").select(F.col("a").alias("pivot"))
        taken = strong.join(pivots, strong["a"] == pivots["pivot"]).groupBy(F.col("b").alias("node")).agg(F.max_by("pivot", "ra").alias("pivot"))
        new = written(taken.unionByName(pivots.select(F.col("pivot").alias("node"), "pivot")))
        done = new if done is None else done.unionByName(new)
        gone = new.select("node")
        strong = written(strong.join(gone, strong["a"] == gone["node"], "left_anti").join(gone, strong["b"] == gone["node"], "left_anti"))
        if strong.isEmpty():
            return written(done)
    raise RuntimeError(f"agreeing neighbours are left after {rules.most_rounds} rounds of clustering")


def lean(edges: DataFrame, done: DataFrame) -> DataFrame:
    """`done` and the nodes that say less and stand alone whose weak neighbours are all in one cluster: they join it."""
    weak = edges.filter("w = 1")
    own = done.select(F.col("node").alias("a"), F.col("pivot").alias("own"))
    other = done.select(F.col("node").alias("b"), F.col("pivot").alias("of"))
    alone = weak.join(own, "a", "left").filter("own is null").filter("rb > ra")
    asked = alone.join(other, "b", "left").groupBy("a").agg(
        F.min(F.coalesce("of", "b")).alias("x"), F.max(F.coalesce("of", "b")).alias("y")
    )
    joined = written(asked.filter("x = y").select(F.col("a").alias("node"), F.col("x").alias("pivot")))
    # a node that others join while it joins another leads them along
    lead = joined.select(F.col("node").alias("pivot"), F.col("pivot").alias("further"))
    joined = joined.join(lead, "pivot", "left").select("node", F.coalesce("further", "pivot").alias("pivot"))
    return done.unionByName(joined)


def closed(nodes: DataFrame, codes: DataFrame, rules: MatchRules) -> DataFrame:
    """(node, pivot): pivots and nodes alone pass through the windows again until no two of them agree.

    A window reaches few of the spellings of an item with many listings; those that were taken no longer stand
    between the pivots in the next passes. Each turn takes one node at least, so the turns end.
    """
    edges = all_edges = neighbours(nodes, codes, rules)
    done = nodes.sparkSession.createDataFrame([], "node long, pivot long")
    while (step := cluster(edges, rules)) is not None:
        further = step.select(F.col("node").alias("pivot"), F.col("pivot").alias("further"))
        moved = done.join(further, "pivot", "left").select("node", F.coalesce("further", "pivot").alias("pivot"))
        done = written(moved.unionByName(step.join(done.select("node"), "node", "left_anti")))
        taken = done.filter("node != pivot").select("node")
        edges = neighbours(nodes.join(taken, "node", "left_anti").select(nodes.columns), codes.join(taken, "node", "left_anti").select(codes.columns), rules)
        all_edges = all_edges.unionByName(edges)
    return lean(all_edges.groupBy("a", "b").agg(F.max("w").alias("w"), F.max("ra").alias("ra"), F.max("rb").alias("rb")), done)


def group(listings: DataFrame, products: DataFrame, rules: MatchRules = MatchRules()) -> DataFrame:
    """(id, cluster) of every listing: the same cluster for listings of the same item.

    Listings whose names read alike make one node; nodes are compared in several sorted passes (orders of the
    parts, and EAN and reference) and clustered. A name that says neither range nor brand is one item with its like
    only where they share a usable code. A listing with a null name, or one without any word, is compared by nothing
    and stays alone; a null code is no code; an empty table gives no rows.
    """
    common, brands = vocabulary(listings, products, rules)
    rows = written(read(listings, common, brands))
    named = rows.filter("kind != ''")
    complete = (F.when(F.col("range") != "", 4).otherwise(0) + F.when(F.col("brand") != "", 1).otherwise(0) + F.size(F.split("traits", " ")) * F.when(F.col("traits") != "", 1).otherwise(0) * 2).cast("int")
    nodes = written(with_parts(named.groupBy(*SIGNATURE).agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")).withColumn("complete", complete)))
    # what says nothing but its kind is not one item because it reads alike
    vague = (F.col("range") == "") & (F.col("brand") == "")
    codes = [
        named.filter(f"{c} is not null").filter(~vague).select(F.lit(k).alias("pass"), F.col(c).alias("key"), *SIGNATURE).distinct()
        for k, c in ((10, "ean"), (11, "ref"))
    ]
    each = written(codes[0].unionByName(codes[1]).join(nodes, SIGNATURE))
    of = closed(nodes.filter(~vague), each, rules)
    placed = nodes.filter(~vague).join(of, "node", "left").select(*SIGNATURE, F.coalesce("pivot", "node").alias("cluster"))
    code = F.coalesce("ean", "ref")
    bare = named.filter(vague & code.isNotNull()).groupBy(*SIGNATURE, code.alias("code")).agg(F.min("id").alias("cluster_by_code"))
    joined = rows.withColumn("code", F.when(vague, code)).join(placed, SIGNATURE, "left").join(bare, [*SIGNATURE, "code"], "left")
    return joined.select("id", F.coalesce("cluster", "cluster_by_code", "id").alias("cluster"))


def pairs(groups: DataFrame) -> DataFrame:
    """(listing_id_a, listing_id_b) of each cluster, smaller id first."""
    a, b = groups.select(F.col("id").alias("listing_id_a"), "cluster"), groups.select(F.col("id").alias("listing_id_b"), "cluster")
    return a.join(b, "cluster").filter("listing_id_a < listing_id_b").select("listing_id_a", "listing_id_b")
