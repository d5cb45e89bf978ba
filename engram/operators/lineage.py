"""Descendants in depth-first order, for forests of any depth and with cycles.

A memory replaces at most one other, so what replaces what is a forest in which a tree may hang on a cycle. The order
comes from the tour that enters a node, visits its children by (created_at, id) and leaves it. Its steps are known locally: from entering a node
to its first child, from leaving it to its next sibling or to leaving its parent. Following the steps by doubling, with the
number of nodes entered, gives every node its position, depth and subtree size in as many rounds as the logarithm of the tour. There are
no paths and no recursion, and each step has one predecessor, so no join key is hot.

A cycle is cut at its least id. A memory on the cycle has all of it as descendants; where they stand follows from the cut order
by arithmetic (``descendants``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered

Save = Callable[[DataFrame], DataFrame]
#: Width of the bins by which ranges of positions meet positions.
BIN = 256


def _on_cycles(links: DataFrame, save: Save) -> DataFrame:
    """(id, least) of the nodes of ``links`` (id, parent) on cycles, with the least id of their cycle."""
    rounds = math.ceil(math.log2(links.count() + 2)) + 1
    going = links
    for _ in range(rounds):  # whoever has an ancestor so far up is below a cycle, and that ancestor is on it
        going = save(going.join(going.select(F.col("id").alias("parent"), F.col("parent").alias("next")), "parent").select("id", F.col("next").alias("parent")))
        if going.isEmpty():
            break
    round_ = going.select(F.col("parent").alias("id")).distinct()
    at = save(links.join(round_, "id", "left_semi").select("id", "parent", F.col("id").alias("least")))
    while True:
        far = at.select(F.col("id").alias("parent"), F.col("parent").alias("next"), F.col("least").alias("other"))
        new = save(at.join(far, "parent").select("id", F.col("next").alias("parent"), F.least("least", "other").alias("least")))
        same = new.join(at, ["id", "least"], "left_anti").isEmpty()
        at = new
        if same:
            return at.select("id", "least")


def positions(rows: DataFrame, save: Save) -> DataFrame:
    """(id, root, pos, size, depth, cut, last_depth, enter) of ``rows`` (id, supersedes_id, created_at).

    ``root``: the tree's; ``pos``: how many nodes of the tree come before; ``size``: nodes of the subtree with its root. Nodes on a
    cycle have ``cut``: the cycle's least id, at which it is cut, the depth of the node above that cut, and the position at which the cut
    tree would stand below it. ``id`` occurs once; links to unknown ids and to the node itself count as none.
    """
    named = save(rows.select("id", F.when(F.col("supersedes_id") != F.col("id"), F.col("supersedes_id")).alias("parent"), "created_at"))
    linked = named.where("parent is not null").join(named.select(F.col("id").alias("parent")), "parent", "left_semi")
    linked = save(linked.select("id", "parent", "created_at"))
    cycles = save(_on_cycles(linked.select("id", "parent"), save))
    cuts = save(cycles.where("id = least").select("id").join(linked, "id"))
    children = linked.join(cuts.select("id"), "id", "left_anti")
    beside = save(ordered.previous(children, ["parent", "created_at", "id"], ["parent", "id"], save).withColumn("older", F.when(F.col("prev.parent") == F.col("parent"), F.col("prev.id"))))
    first = beside.where("older is null").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    younger = beside.where("older is not null").select(F.col("older").alias("id"), F.col("id").alias("sibling"))
    nodes = named.select("id").join(first, "id", "left").join(younger, "id", "left").join(beside.select("id", "parent"), "id", "left")
    enter = F.struct(F.lit(0).alias("side"), F.coalesce("child", "id").alias("to"), F.col("child").isNull().cast("int").alias("to_side"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("up"))
    leave = F.struct(F.lit(1).alias("side"), F.coalesce("sibling", "parent").alias("to"), F.col("sibling").isNull().cast("int").alias("to_side"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("up"))
    steps = save(nodes.select("id", F.explode(F.array(enter, leave)).alias("s")).select("id", "s.*", F.col("id").alias("end")))
    # n: nodes entered and up: levels gained from a step to the place it points to; without one, to the end of the tour.
    while not (going := steps.where("to is not null")).isEmpty():
        far = steps.select(F.col("id").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("next"), F.col("to_side").alias("next_side"), F.col("n").alias("more"), F.col("up").alias("higher"), F.col("end").alias("last"))
        moved = going.join(far, ["to", "to_side"]).select("id", "side", F.col("next").alias("to"), F.col("next_side").alias("to_side"), (F.col("n") + F.col("more")).alias("n"), (F.col("up") + F.col("higher")).alias("up"), F.col("last").alias("end"))
        steps = save(moved.unionByName(steps.where("to is null")))
    ins, outs = steps.where("side = 0"), steps.where("side = 1").select("id", F.col("n").alias("n_out"))
    found = ins.join(outs, "id").select("id", F.col("end").alias("root"), "n", (F.col("n") - F.col("n_out")).alias("size"), (-F.col("up")).alias("depth"))
    whole = found.where("id = root").select("root", F.col("n").alias("all"))
    found = save(found.join(whole, "root").select("id", "root", (F.col("all") - F.col("n")).alias("pos"), "size", "depth"))
    # Where the node of the cut stands among its siblings.
    above = cuts.select(F.col("id").alias("cut"), F.col("parent"), F.col("created_at").alias("t")).join(found.select(F.col("id").alias("parent"), "pos", "depth"), "parent")
    older = above.select("cut", "parent", "t").join(children, "parent").where(F.struct("created_at", "id") < F.struct(F.col("t"), F.col("cut")))
    older = older.join(found.select("id", (F.col("pos") + F.col("size")).alias("after")), "id").groupBy("cut").agg(F.max("after").alias("after"))
    place = above.join(older, "cut", "left").select("cut", F.col("depth").alias("last_depth"), F.coalesce("after", F.col("pos") + 1).alias("enter"))
    own = cycles.select("id", F.col("least").alias("cut")).join(place, "cut")
    return found.join(own, "id", "left").select("id", "root", "pos", "size", "depth", "cut", "last_depth", "enter")


def descendants(places: DataFrame, focuses: DataFrame) -> DataFrame:
    """(focus, position, id, depth) of all descendants of the stated ``focuses`` (id), in depth-first order, positions from 1. ``places``: a table of ``positions``."""
    f = places.join(focuses.select("id").distinct(), "id", "left_semi")
    # Trees: the positions after the focus, as many as its subtree has. On a cycle: all of the tree, turned.
    whole = places.where("id = root").select("root", F.col("size").alias("all"))
    f = f.join(whole, "root").select(
        F.col("id").alias("focus"), "root", F.col("pos").alias("s"), F.col("size").alias("z"), F.col("depth").alias("d"), "last_depth", "enter", "all",
        F.when(F.col("cut").isNull(), F.col("pos")).otherwise(F.lit(0)).alias("low"), F.when(F.col("cut").isNull(), F.col("pos") + F.col("size")).otherwise(F.col("all")).alias("high"),
    )
    cut = f.withColumn("bin", F.explode(F.sequence(F.floor(F.col("low") / BIN), F.floor((F.col("high") - 1) / BIN))))
    x = places.select("id", "root", F.col("pos").alias("p"), F.col("depth").alias("dx"), F.floor(F.col("pos") / BIN).alias("bin"))
    met = cut.join(x, ["root", "bin"]).where("p >= low and p < high and id <> focus")
    inside = (F.col("p") >= F.col("s")) & (F.col("p") < F.col("s") + F.col("z"))
    turned = F.when(inside, F.col("p") - F.col("s") + F.when(F.col("p") >= F.col("enter"), F.col("all") - F.col("z")).otherwise(0))
    turned = turned.otherwise(F.col("enter") - F.col("s") + F.when(F.col("p") < F.col("s"), F.col("p")).otherwise(F.col("p") - F.col("z")))
    position = F.when(F.col("enter").isNull(), F.col("p") - F.col("s")).otherwise(turned)
    depth = F.when(F.col("enter").isNull() | inside, F.col("dx") - F.col("d")).otherwise(F.col("dx") + F.col("last_depth") - F.col("d") + 1)
    return met.select("focus", position.cast("long").alias("position"), "id", depth.cast("int").alias("depth"))
