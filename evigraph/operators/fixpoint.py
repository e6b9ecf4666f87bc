"""Iterative graph operators: reachability, widest paths, components, levels.

Each round joins the frontier only, writes it to the checkpoint folder (lineage stays short, lost executors are survived),
and stops when nothing new appears. Driver state is one count per round.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.sources.shared import dropping_shuffles, shared_dir


def cut(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    with dropping_shuffles(df.sparkSession):
        return df.select("*").checkpoint()  # a query made here, so that its shuffle files go with it


def reach(edges: DataFrame, roots: DataFrame, max_depth: int | None = 40) -> DataFrame:
    """GRA-02: (root, node, depth): nodes within max_depth steps (None: any), at their least distance; the root itself at 0."""
    return spread(cut(edges.select("src", "dst").distinct()), roots.select(F.col("id").alias("root"), F.col("id").alias("node")), max_depth)


def spread(step: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node, depth) from starts(root, node), of which a root may have many; step(src, dst) has no repeats."""
    seen = frontier = cut(starts.select("root", "node", F.lit(0).alias("depth")).distinct())
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        found = frontier.join(step, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


class Shared(NamedTuple):
    """pairs(root, id), kids(id, way), ends(id, end), beyond(ways, node, depth); see shared_reach()."""

    pairs: DataFrame
    kids: DataFrame
    ends: DataFrame
    beyond: DataFrame


def shared_reach(edges: DataFrame, nodes: DataFrame, roots: DataFrame, max_depth: int, stops: DataFrame | None = None) -> Shared:
    """What roots(id) reach in at most max_depth (2 or more) steps over edges to nodes(id), told in parts that many roots share, so that no row is
    written for a root and a node far from it. Nothing goes on from stops(id).

    A root reaches itself, the nodes that its edges lead to (pairs), and what lies two steps off or more. The latter is the same for all roots with
    the same nodes two steps off, and is walked once for them. Nodes two steps off from which no edge leads on (ends) are told apart, so that more
    roots have the same others. kids(id, way): a node of `pairs` and the number of the set of the others behind it, null if it is empty. A root's `ways`
    is the sorted array of its kids' numbers. beyond(ways, node, depth): what is reached from there, the depth from the root (2 or more)."""
    if max_depth < 2:
        raise ValueError("max_depth must be 2 or more")
    e = edges.select("src", "dst")
    pairs = e.toDF("root", "id").join(roots.select(F.col("id").alias("root")), "root", "left_semi")
    there = cut(e.select(F.col("dst").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi"))
    goers = there
    if stops is not None:
        pairs, goers = pairs.join(stops.select(F.col("id").alias("root")), "root", "left_anti"), there.join(stops.select("id"), "id", "left_anti")
    # a node that no edge leads to is never gone on from
    step = cut(e.join(goers.toDF("src"), "src", "left_semi").join(there.toDF("dst"), "dst", "left_semi").distinct().select("src", "dst"))
    first = cut(pairs.select("id").distinct().join(there, "id", "left_semi"))
    goes = step.select(F.col("src").alias("dst")).distinct().withColumn("goes", F.lit(True))
    behind = cut(first.join(step, F.col("id") == F.col("src")).join(goes, "dst", "left").select("id", "dst", "goes"))
    sets = behind.where("goes").groupBy("id").agg(F.array_sort(F.collect_set("dst")).alias("on"))
    sets = cut(sets)
    numbers = cut(sets.select("on").distinct().withColumn("way", F.monotonically_increasing_id()))
    kids = cut(first.join(sets.join(numbers, "on").select("id", "way"), "id", "left"))
    ways = cut(pairs.join(kids.where("way is not null"), "id").groupBy("root").agg(F.array_sort(F.collect_set("way")).alias("ways")).select("ways").distinct())
    starts = ways.select("ways", F.explode("ways").alias("way")).join(numbers, "way").select(F.col("ways").alias("root"), F.explode("on").alias("node"))
    beyond = spread(step, starts, max_depth - 2).select(F.col("root").alias("ways"), "node", (F.col("depth") + 2).alias("depth"))
    return Shared(pairs, kids, behind.where("goes is null").select("id", F.col("dst").alias("end")), beyond)


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id of all nodes that any root reaches, the roots included; a node is visited once."""
    step = cut(edges.select("src", "dst").distinct())
    seen = frontier = cut(roots.select("id").distinct())
    while True:
        found = frontier.join(step, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = cut(found.join(seen, "id", "left_anti"))
        if not frontier.take(1):
            return seen
        seen = cut(seen.unionByName(frontier))


def reach_counts(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """GRA-07: root, reached: how many nodes a root reaches, itself aside.

    Counted on the condensation of what the roots reach, with bitmaps: from the components that lead nowhere up, a component's bitmap is
    that of its members or-ed with those of the components that it leads to. An edge between components is joined once, and what is
    shuffled are bitmaps (4 KB for 32,768 nodes, those without a bit aside) that are or-ed before the shuffle, not pairs of nodes."""
    live = cut(reached(edges, roots))
    step = edges.where("src <> dst").join(live.toDF("src"), "src", "left_semi").join(live.toDF("dst"), "dst", "left_semi").select("src", "dst").distinct()
    parts = cut(strong_components(step, live))
    side = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    down = cut(step.join(side("src"), "src").join(side("dst"), "dst").where("csrc <> cdst").select("csrc", "cdst").distinct())
    # the longest way down; a feedback edge lies within a component
    height = cut(levels(down.select(F.col("cdst").alias("src"), F.col("csrc").alias("dst")), parts.select(F.col("component").alias("node"), "component").distinct()))
    # nodes far down, which many reach, are numbered side by side, so that few bitmaps hold them
    numbered = cut(parts.join(height, "component").orderBy("level", "component", "node").select("node", "component", F.monotonically_increasing_id().alias("n")))
    own = cut(numbered.groupBy("component", F.bitmap_bucket_number("n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits")))
    done = own.join(height.where("level = 0"), "component", "left_semi")
    for at in range(1, (height.agg(F.max("level")).first()[0] or 0) + 1):
        here = height.where(F.col("level") == at)
        below = down.join(here.select(F.col("component").alias("csrc")), "csrc", "left_semi").join(done.withColumnRenamed("component", "cdst"), "cdst").select(F.col("csrc").alias("component"), "bucket", "bits")
        both = below.unionByName(own.join(here, "component", "left_semi"))
        done = cut(done.unionByName(both.groupBy("component", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))))
    counts = done.groupBy("component").agg((F.sum(F.bitmap_count("bits")) - 1).alias("reached"))
    return roots.select(F.col("id").alias("node")).distinct().join(parts, "node").join(counts, "component").select(F.col("node").alias("root"), "reached")


def widest(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """GRA-08: (node, width): best over all paths to a root, of the least confidence on the path; reversed edges, so callers.

    Rounds go on until no width rises; each writes only the widths that did."""
    step = cut(edges.groupBy("src", "dst").agg(F.max("confidence").alias("w")))
    seen = changed = cut(roots.select(F.col("id").alias("node"), F.lit(1.0).alias("width")).distinct())
    while True:
        offer = changed.join(step, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), F.least("width", "w").alias("width")).groupBy("node").agg(F.max("width").alias("offer"))
        best = seen.groupBy("node").agg(F.max("width").alias("width"))
        changed = cut(offer.join(best, "node", "left").where("width is null or offer > width").select("node", F.col("offer").alias("width")))
        if not changed.take(1):
            return best
        seen = seen.unionByName(changed)


def _least_reaching(step: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches it, itself included."""
    colours = changed = cut(nodes.select("node", F.col("node").alias("colour")))
    while True:
        offer = changed.join(step, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("offer"))
        changed = cut(offer.join(colours, "node").where("offer < colour").select("node", F.col("offer").alias("colour")))
        if not changed.take(1):
            return colours
        colours = cut(colours.unionByName(changed).groupBy("node").agg(F.min("colour").alias("colour")))


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """GRA-05: (node, component): the least node that it reaches and is reached from; alone, itself.

    Each turn trims nodes without a way in or out, colours the rest by the least node that reaches them, and takes the nodes that
    reach their colour's node within the colour: these are components. A round touches an edge once; no pairs of nodes arise."""
    all_ = nodes.select(F.col("id").alias("node")).distinct()
    step = cut(edges.where("src <> dst").select("src", "dst").distinct().join(all_.toDF("src"), "src", "left_semi").join(all_.toDF("dst"), "dst", "left_semi"))
    found = []
    while True:
        while True:
            rest = cut(step.join(step.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(step.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            done = rest.count() == step.count()
            step = rest
            if done:
                break
        if not step.take(1):
            break
        colours = _least_reaching(step, step.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
        side = lambda x: colours.toDF(x, f"c{x}")  # noqa: B023, E731
        within = cut(step.join(side("src"), "src").join(side("dst"), "dst").where("csrc = cdst").select("src", "dst"))
        members = reach(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colours.where("node = colour").select(F.col("node").alias("id")), None)
        members = cut(members.select("node", F.col("root").alias("component")))
        found.append(members)
        gone = members.select("node")
        step = cut(step.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti"))
    if not found:
        return all_.select("node", F.col("node").alias("component"))
    members = found[0]
    for more in found[1:]:
        members = members.unionByName(more)
    return all_.join(members, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def levels(edges: DataFrame, components: DataFrame) -> DataFrame:
    """GRA-06: (component, level): the longest path of the condensation that ends there; feedback edges lie within components."""
    side = lambda x: components.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    step = cut(edges.join(side("src"), "src").join(side("dst"), "dst").where("csrc <> cdst").select("csrc", "cdst").distinct())
    at = cut(components.select("component").distinct().withColumn("level", F.lit(0)))
    while True:  # a condensation has no cycle, so levels stop rising
        up = at.join(step, F.col("component") == F.col("csrc")).groupBy(F.col("cdst").alias("component")).agg((F.max("level") + 1).alias("offer"))
        moved = cut(at.join(up, "component", "left").select("component", F.greatest("level", F.coalesce("offer", F.lit(0))).alias("level"), "level"))
        changed = moved.toDF("component", "level", "was")
        at = changed.select("component", "level")
        if not changed.where("level > was").take(1):
            return at


def propagate(edges: DataFrame, capabilities: DataFrame) -> DataFrame:
    """GRA-09: (node, capability): what a node has itself or calls, directly or not; callee to caller."""
    step = cut(edges.select("src", "dst").distinct())
    have = frontier = cut(capabilities.select("node", "capability").distinct())
    while True:
        found = frontier.join(step, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "capability").distinct()
        frontier = cut(found.join(have, ["node", "capability"], "left_anti"))
        if not frontier.take(1):
            return have
        have = have.unionByName(frontier)
