"""Parent-child links brought to full hierarchies by bottom-up leaf peeling.

A round peels all leaves, or, where that would take less than half of the nodes, every leaf together with the unbranched chain above it, so
that the number of rounds is bounded by the logarithm of the number of nodes even where chains are very long. What is peeled
sends its nodes' number to the parent it hangs from. As soon as a count proves that few nodes are left, one task peels the rest
level by level. What is left when no leaf remains are exactly the cycles. The reverse order of peeling then gives paths
and depths: a chain takes those of the node it hangs from, which was peeled later.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumatable.functions.text import path_parts, strip_space
from lumatable.runtime import Rounds, ship, table

SEPARATOR = "|"
#: Nodes up to which, after they were counted, one task peels the rest, and characters of paths it gathers before it gives them on.
LOCAL_NODES, GATHERED_CHARS = 50_000, 4_000_000


def _chains(active: DataFrame, rounds: Rounds, n_active: int) -> DataFrame | None:
    """The chains that can be peeled: leaf, top's parent, and nodes from the leaf up with the nodes' sizes; None where no leaf is left.
    Where at least half of the nodes are leaves, the chains are these alone.

    Each leaf and each node with one active child points to that child; doubling the pointers finds how far below its leaf lies.
    """
    children = active.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"), F.min("id").alias("child"))
    below = active.join(children, "id", "left").where("n_children is null or n_children = 1")
    links = rounds.keep(below.select("id", "parent", "name", "extra", F.coalesce("child", "id").alias("to"), F.when(F.col("n_children").isNull(), 0).otherwise(1).cast("bigint").alias("steps"), F.col("n_children").isNull().alias("at_leaf")))
    leaves, unbranched = links.agg(F.count_if("at_leaf"), F.count_if(~F.col("at_leaf"))).first()
    if not leaves:
        return None
    while unbranched and 2 * leaves < n_active:
        far = links.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"), F.col("at_leaf").alias("at_leaf2"))
        # a link whose target was not found points at a branching node and leads to no leaf
        links = rounds.keep(
            links.join(far, "to", "left")
            .where("at_leaf or to2 is not null")
            .select("id", "parent", "name", "extra", F.when(F.col("at_leaf"), F.col("to")).otherwise(F.col("to2")).alias("to"), F.when(F.col("at_leaf"), F.col("steps")).otherwise(F.col("steps") + F.col("steps2")).alias("steps"), (F.col("at_leaf") | F.col("at_leaf2")).alias("at_leaf"), F.col("at_leaf").alias("done"))
        )
        # links that go round a cycle never reach a leaf; all others do within as many doublings as the longest chain has bits
        fresh, unbranched = links.agg(F.count_if(F.col("at_leaf") & ~F.col("done")), F.count_if(~F.col("at_leaf"))).first()
        links = links.drop("done")
        if not fresh:
            break
    return links.where("at_leaf").select("id", "parent", "name", "extra", F.col("to").alias("leaf"), "steps")


HIERARCHY = "id bigint, root_id bigint, depth int, path array<string>, n_descendants bigint"


def _peel_here(ids: np.ndarray, parents: np.ndarray, names: list[str], extra: np.ndarray) -> Iterator[tuple]:
    """Rows (id, root_id, depth, path, n_descendants) of nodes that fit into memory; `parents` holds places in `ids`, -1 for none."""
    n = len(ids)
    waiting, sizes, layers = np.bincount(parents[parents >= 0], minlength=n), extra.astype(np.int64), []
    layer = np.nonzero(waiting == 0)[0]
    while len(layer):
        layers.append(layer)
        above = parents[layer]
        hung, above = layer[above >= 0], above[above >= 0]
        np.add.at(sizes, above, sizes[hung] + 1)
        np.subtract.at(waiting, above, 1)
        above = np.unique(above)
        layer = above[waiting[above] == 0]
    root, depth, peeled = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    for layer in layers:
        peeled[layer] = True
    for start in np.nonzero(~peeled)[0]:  # residual nodes are cycles
        if root[start] < 0:
            ring, at = [start], parents[start]
            while at != start:
                ring.append(at)
                at = parents[at]
            root[ring] = min(ids[ring])
    for layer in reversed(layers):
        above = parents[layer]
        top = above < 0
        root[layer], depth[layer] = np.where(top, ids[layer], root[above]), np.where(top, 0, np.where(depth[above] < 0, -1, depth[above] + 1))
    below = defaultdict(list)
    for i in np.nonzero(depth > 0)[0].tolist():
        below[parents[i]].append(i)
    stack, path = np.nonzero(depth == 0)[0].tolist(), []
    while stack:  # parents before children, so that the path at hand only grows and shrinks at its end
        i = stack.pop()
        path[depth[i] :] = [names[i]]
        yield ids[i], root[i], depth[i], list(path), sizes[i]
        stack.extend(below[i])
    for i in np.nonzero(depth < 0)[0].tolist():
        yield ids[i], root[i], -1, [], -1


def _peel_in_one_task(active: DataFrame) -> DataFrame:
    ship(active.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:
            return
        nodes = pd.concat(held).sort_values("id")
        ids, known = nodes.id.to_numpy(), nodes.parent.notna().to_numpy()
        parents = np.full(len(ids), -1, np.int64)
        parents[known] = np.searchsorted(ids, nodes.parent[known].to_numpy().astype(np.int64))
        rows, chars = [], 0
        for row in _peel_here(ids, parents, nodes.name.tolist(), nodes.extra.to_numpy()):
            rows.append(row)
            chars += 8 + sum(map(len, row[3]))
            if chars >= GATHERED_CHARS:
                yield pd.DataFrame(rows, columns=["id", "root_id", "depth", "path", "n_descendants"])
                rows, chars = [], 0
        yield pd.DataFrame(rows, columns=["id", "root_id", "depth", "path", "n_descendants"])

    return active.select("id", "parent", "name", "extra").repartition(1).mapInPandas(run, HIERARCHY)


def _cycles(active: DataFrame, rounds: Rounds) -> DataFrame:
    """Residual nodes, all on cycles: doubling gives each the smallest id of its cycle."""
    cycle = rounds.keep(active.select("id", F.col("parent").alias("to"), F.least("id", "parent").alias("least_id"), F.lit(True).alias("changed")))
    while not cycle.where("changed").isEmpty():
        ahead = cycle.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("least_id").alias("least2"))
        cycle = rounds.keep(cycle.join(ahead, "to").select("id", F.col("to2").alias("to"), F.least("least_id", "least2").alias("least_id"), (F.col("least2") < F.col("least_id")).alias("changed")))
    return cycle.select("id", F.col("least_id").alias("root_id"), F.lit(-1).alias("depth"), F.array().cast("array<string>").alias("path"), F.lit(-1).cast("bigint").alias("n_descendants"))


def hierarchy(nodes: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """For nodes (id, parent, name), one row each: root_id, depth, path (names from the root, an array), n_descendants.

    A node whose parent is null or missing is a root of depth 0. Nodes on a cycle, or above which a cycle lies, have depth -1, the
    cycle's smallest id as root_id, an empty path and n_descendants -1; a node that names itself is a cycle of one. Rows
    without an id are dropped; an id that occurs more than once counts once, with its smallest (parent, name). A null
    name counts as empty.
    """
    spark = nodes.sparkSession
    rounds, peeled = Rounds(spark, "peel"), Rounds(spark, "peeled")
    once = nodes.where("id is not null").groupBy(F.col("id").cast("bigint").alias("id")).agg(F.min(F.struct(F.col("parent").cast("bigint").alias("parent"), F.coalesce("name", F.lit("")).alias("name"))).alias("one")).select("id", "one.parent", "one.name")
    known = once.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    active = rounds.keep(once.join(known, "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("parent"), "name", F.lit(0).cast("bigint").alias("extra")))
    layers: list[DataFrame] = []
    while (n_active := active.count()) > local_nodes:
        chains = _chains(active, rounds, n_active)
        if chains is None:
            break
        # sizes below: each node's own and its side branches', summed from the leaf up along the chain
        upward = Window.partitionBy("leaf").orderBy("steps")
        sized = chains.withColumn("n_descendants", F.sum(F.col("extra") + 1).over(upward) - 1).withColumn("top", F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("steps"))) == 1)
        layer = peeled.keep(sized.select("id", "parent", "name", "leaf", "steps", "n_descendants", "top"))
        layers.append(layer)
        sent = layer.where("top and parent is not null").groupBy(F.col("parent").alias("id")).agg(F.sum(F.col("n_descendants") + 1).alias("got"))
        rest = active.join(layer.select("id"), "id", "left_anti").join(sent, "id", "left")
        active = rounds.keep(rest.select("id", "parent", "name", (F.col("extra") + F.coalesce("got", F.lit(0))).alias("extra")))
        rounds.forget(but=1)
    done = [peeled.keep(_peel_in_one_task(active) if n_active <= local_nodes else _cycles(active, rounds))]
    rounds.forget()
    empty = F.array().cast("array<string>")
    for layer in reversed(layers):
        downward = Window.partitionBy("leaf").orderBy(F.desc("steps")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy("leaf").orderBy(F.desc("steps")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        own = layer.select("id", "leaf", "n_descendants", F.collect_list("name").over(downward).alias("names"), F.first("parent").over(whole).alias("above"), F.first("id").over(whole).alias("top_id"))
        upper = _union(done).select(F.col("id").alias("above"), F.col("root_id").alias("up_root"), F.col("depth").alias("up_depth"), F.col("path").alias("up_path"))
        hung = own.join(upper.join(layer.where("top").select(F.col("parent").alias("above")).distinct(), "above", "left_semi"), "above", "left")
        cyclic = F.col("up_depth") == -1
        done.append(
            peeled.keep(
                hung.select(
                    "id",
                    F.coalesce("up_root", "top_id").alias("root_id"),
                    F.when(cyclic, -1).otherwise(F.coalesce(F.col("up_depth"), F.lit(-1)) + F.size("names")).cast("int").alias("depth"),
                    F.when(cyclic, empty).otherwise(F.concat(F.coalesce("up_path", empty), "names")).alias("path"),
                    F.when(cyclic, F.lit(-1)).otherwise(F.col("n_descendants")).cast("bigint").alias("n_descendants"),
                )
            )
        )
    return _union(done)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def descendants(nodes: DataFrame) -> DataFrame:
    """All pairs (ancestor_id, descendant_id, distance) of nodes that hang from a root: descendant lists, from each node's path of ids."""
    ids = hierarchy(nodes.select("id", "parent", F.col("id").cast("string").alias("name"))).where("depth >= 0")
    return ids.select(F.col("id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "up")).where("at < depth").select(F.col("up").cast("bigint").alias("ancestor_id"), "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))


def tag_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tags").select("id", F.col("parent_id").alias("parent"), strip_space(F.col("name")).alias("name"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p4_found: each tag's root, depth, path and number of descendants, compared with the stored sidebar paths."""
    full = hierarchy(tag_nodes(spark, sf_dir)).withColumn("full_path", F.array_join("path", SEPARATOR))
    stored = table(spark, sf_dir, "hierarchical_tag_items").where("id is not null").groupBy("id").agg(F.min(F.struct("full_path")).alias("stored"))
    same = path_parts(F.col("stored.full_path")) == path_parts(F.col("full_path"))
    return full.join(stored, "id", "left").select(F.col("id").alias("tag_id"), "root_id", "depth", "full_path", "n_descendants", F.when(F.col("stored").isNull(), -1).when(same, 1).otherwise(0).alias("stored_ok"))


def descendant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query p4_descendants: all (ancestor_id, descendant_id, distance) pairs of the tags."""
    return descendants(tag_nodes(spark, sf_dir))
