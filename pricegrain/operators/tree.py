"""Problem 5: parent-child links to full hierarchies by tree contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, written


def _contract(links: DataFrame, node: str, parent: str, most_rounds: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(core, records, rounds): what contraction leaves, and all nodes it took out with what they were tied to.

    Each round rakes all leaves and, of every unary chain, splices out an independent set of inner nodes (those whose
    hash is below that of both neighbours that could go too), noting the nodes between as a segment on the child's
    link. Roots and self-loops wait. Sides of joins are broadcast once few enough nodes are left.
    """
    rows = links.select(F.col(node).alias("id"), F.col(parent).alias("up")).filter("id is not null")
    rows = rows.groupBy("id").agg(F.min("up").alias("up"))
    known = rows.select(F.col("id").alias("up"), F.lit(True).alias("known"))
    alive = rows.join(known, "up", "left").select("id", F.when(F.col("known"), F.col("up")).alias("up"), F.array().cast("array<bigint>").alias("seg"))
    done = F.col("up").isNull() | (F.col("up") == F.col("id"))
    records: DataFrame | None = None
    n: int | None = None  # nodes left, once counted
    for k in range(most_rounds):
        small = n is not None and n <= BROADCAST_ROWS
        side = F.broadcast if small else (lambda df: df)
        # read by several joins; its lineage begins at the table of the round before
        alive = alive if small else alive.persist()
        children = alive.filter(F.col("up").isNotNull()).groupBy(F.col("up").alias("id")).agg(
            F.count(F.lit(1)).alias("children"), F.min("id").alias("child")
        )
        state = alive.join(side(children), "id", "left")
        hashed = F.xxhash64("id", F.lit(k))
        can = F.when(~done & (F.col("children") == 1) & (F.col("child") != F.col("id")), hashed)
        state = state.withColumn("own", can)
        state = state if small else state.persist()
        chosen = state.filter("own is not null")
        above = chosen.select(F.col("id").alias("up"), F.col("own").alias("own_above"))
        below = chosen.select(F.col("id").alias("child"), F.col("own").alias("own_below"))
        least = lambda c: F.col(c).isNull() | (F.col("own") < F.col(c))
        goes = chosen.join(side(above), "up", "left").join(side(below), "child", "left").filter(least("own_above") & least("own_below")).select("id", F.lit(True).alias("splice"))
        tossed = state.join(side(goes), "id", "left").select(
            "id", "up", "seg", "child", F.coalesce("splice", F.lit(False)).alias("splice"), (~done & F.col("children").isNull()).alias("rake")
        )
        tossed, counts = written(tossed, {"open": F.count_if(~done), "left": F.count_if(~F.col("splice") & ~F.col("rake"))})
        if not small:
            alive.unpersist()
            state.unpersist()
        if not counts["open"]:
            return tossed.select("id", F.coalesce(F.col("up") == F.col("id"), F.lit(False)).alias("loops")), records, k
        n = counts["left"]
        gone = tossed.filter("splice or rake").select("id", "up", "seg", F.when(F.col("splice"), F.col("child")).alias("child"))
        records = gone if records is None else records.unionByName(gone)
        bridged = tossed.filter("splice").select(F.col("id").alias("up"), F.col("up").alias("above"), F.col("seg").alias("seg_above"))
        left = tossed.filter("not splice and not rake").select("id", "up", "seg").join(side(bridged), "up", "left")
        alive = left.select(
            "id", F.coalesce("above", "up").alias("up"),
            F.when(F.col("above").isNull(), F.col("seg")).otherwise(F.concat("seg_above", F.array("up"), "seg")).alias("seg"),
        )
    raise RuntimeError("tree contraction did not end")


def _jumped(rows: DataFrame, to: str, join, rounds: int) -> DataFrame:
    """Pointers `to` of recorded nodes followed to the end: each jump doubles their reach, and no chain is longer than two a round."""
    for _ in range(max(1, (2 * rounds).bit_length())):
        following = rows.select(*[F.col(c).alias(f"next_{c}") for c in rows.columns])
        rows = written(join(rows.join(following, F.col(to) == F.col("next_id"), "left")))
    return rows


def _on_cycle(core: DataFrame, records: DataFrame | None, rounds: int) -> DataFrame:
    """(id) of all nodes on cycles: a node that was spliced out is on one if its only child at the time is."""
    loops = core.filter("loops").select("id")
    if records is None or loops.isEmpty():
        return loops
    ends = _jumped(records.filter("child is not null").select("id", "child"), "child", lambda j: j.select("id", F.coalesce("next_child", "child").alias("child")), rounds)
    return loops.unionByName(ends.join(loops.select(F.col("id").alias("child")), "child", "left_semi").select("id"))


def cycles(links: DataFrame, node: str = "id", parent: str = "parent_id", most_rounds: int = 400) -> DataFrame:
    """(id) of the nodes that are their own ancestor, by the contraction of `hierarchy` without paths."""
    return _on_cycle(*_contract(links, node, parent, most_rounds))


def hierarchy(links: DataFrame, node: str = "id", parent: str = "parent_id", most_rounds: int = 400) -> DataFrame:
    """path (array of ids from the root), depth (root 0), root, on_cycle and below_cycle of every node.

    Tree contraction (`_contract`) leaves roots, and nodes that are their own parent: cycles contracted to one node.
    The recorded contractions are then undone: a node's path is the path of the node it was tied to, the segment
    between and itself; as a record's node was tied to one that went later, the records are followed by jumps that
    double, until each is tied to the core.

    A null parent, or one that is not in the table, makes a root. Nodes on or below a cycle have null path,
    depth and root. Rows with a null id are ignored; of rows with one id the one with the least parent counts
    (null last). Other columns are not touched; an empty table gives no rows. The rounds grow with the
    logarithm of the nodes.
    """
    core, records, rounds = _contract(links, node, parent, most_rounds)
    cycle = _on_cycle(core, records, rounds).select("id", F.lit(True).alias("on_cycle"))
    solved = core.select("id", F.col("id").alias("root"), F.array("id").alias("path"))
    if records is not None:
        tied = records.select("id", "up", F.concat("seg", F.array("id")).alias("tail"))
        join = lambda j: j.select("id", F.coalesce("next_up", "up").alias("up"), F.when(F.col("next_id").isNull(), F.col("tail")).otherwise(F.concat("next_tail", "tail")).alias("tail"))
        solved = solved.unionByName(_jumped(tied, "up", join, rounds).select("id", F.col("up").alias("root"), F.concat(F.array("up"), "tail").alias("path")))
    loops = core.filter("loops").select(F.col("id").alias("root"), F.lit(True).alias("lost"))
    out = solved.join(loops, "root", "left").join(cycle, "id", "left")
    on, lost = F.coalesce("on_cycle", F.lit(False)), F.coalesce("lost", F.lit(False))
    kept = lambda c: F.when(~lost, c)
    return out.select("id", kept(F.col("path")).alias("path"), kept(F.size("path") - 1).alias("depth"), kept(F.col("root")).alias("root"), on.alias("on_cycle"), (lost & ~on).alias("below_cycle"))


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every node and each node below it, from a result of `hierarchy`."""
    below = tree.filter("path is not null").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return below.filter("at < depth").select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
