"""Hierarchies of groups too large for one task: the same heavy chains by distributed rounds, each written to the shared folder.

As many rounds as the group is deep (trimming, levels, sizes), as its cycles are long (separation of cycles), and as the logarithm
of its nodes (chains and what hangs on them). Nothing is gathered in one task but a node's own path and descendants, where they are
asked for, and blocks of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from condnet.common import materialize

_G = ["g", "n"]
#: Tasks over which the rows of one chain spread; buckets of a node's children; places of the heavy-first order in a block.
SALTS, BUCKETS, BLOCK = 16, 64, 4096


def _trimmed(links: DataFrame) -> DataFrame:
    """Links whose start has a link in and whose end has a link out, again and again."""
    links = materialize(links, "trim")
    n = links.count()
    while n:
        left = links.join(links.select("g", F.col("c").alias("p")).distinct(), ["g", "p"], "left_semi").join(links.select("g", F.col("p").alias("c")).distinct(), ["g", "c"], "left_semi")
        links = materialize(left.select("g", "p", "c"), "trim")
        n, before = links.count(), n
        if n == before:
            break
    return links


def _color(links: DataFrame) -> DataFrame:
    """(g, n, color): the largest node that reaches each node, itself included."""
    nodes = links.select("g", F.explode(F.array("p", "c")).alias("n")).distinct()
    color = materialize(nodes.withColumn("color", F.col("n")), "color")
    new = color
    while True:
        sent = new.withColumnRenamed("n", "p").join(links, ["g", "p"]).groupBy("g", F.col("c").alias("n")).agg(F.max("color").alias("got"))
        new = materialize(sent.join(color, _G).where("got > color").select("g", "n", F.col("got").alias("color")), "new")
        if new.isEmpty():
            return color
        color = materialize(color.join(new.withColumnRenamed("color", "better"), _G, "left").select("g", "n", F.coalesce("better", "color").alias("color")), "color")


def cycles(links: DataFrame) -> DataFrame:
    """(g, n): nodes on a cycle."""
    found = links.where("p = c").select("g", F.col("p").alias("n")).distinct()
    core = _trimmed(links.where("p <> c"))
    while not core.isEmpty():
        color = _color(core)
        inside = core.join(color.select("g", F.col("n").alias("p"), F.col("color").alias("a")), ["g", "p"]).join(color.select("g", F.col("n").alias("c"), F.col("color").alias("b")), ["g", "c"]).where("a = b")
        inside = materialize(inside.select("g", "p", "c", F.col("a").alias("color")), "inside")
        # back from each colour's own node: what reaches it is its component
        seen = front = materialize(color.where("n = color").select("g", "n", "color"), "front")
        while not front.isEmpty():
            back = inside.join(front.select("g", F.col("n").alias("c"), "color"), ["g", "c", "color"]).select("g", F.col("p").alias("n"), "color").distinct()
            front = materialize(back.join(seen, ["g", "n", "color"], "left_anti"), "front")
            seen = materialize(seen.unionByName(front), "seen")
        size = seen.groupBy("g", "color").agg(F.count("*").alias("k")).where("k > 1")
        found = materialize(found.unionByName(seen.join(size, ["g", "color"], "left_semi").select("g", "n")).distinct(), "found")
        gone = seen.select("g", "n")
        core = core.join(gone.withColumnRenamed("n", "p"), ["g", "p"], "left_anti").join(gone.withColumnRenamed("n", "c"), ["g", "c"], "left_anti")
        core = _trimmed(core.select("g", "p", "c"))
    return found


def _spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """left joined with right, of which each key has one row: any number of left rows of a key spread over `SALTS` tasks."""
    salt = right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__s", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salt, [*keys, "__s"]).drop("__s")


def _tree(links: DataFrame) -> DataFrame:
    """(g, n, up, size): every node that a root reaches below its parent on a shortest way, with the size of its subtree."""
    root = links.select("g", F.col("p").alias("n")).distinct().join(links.select("g", F.col("c").alias("n")).distinct(), _G, "left_anti")
    level = materialize(root.select("g", "n", F.col("n").alias("origin"), F.lit(None).cast("long").alias("up")), "level")
    levels, seen = [level], level.select("g", "n")
    while True:
        step = level.select("g", F.col("n").alias("p"), "origin").join(links, ["g", "p"]).join(seen.withColumnRenamed("n", "c"), ["g", "c"], "left_anti")
        best = step.groupBy("g", F.col("c").alias("n")).agg(F.min(F.struct("origin", F.col("p").alias("up"))).alias("x"))
        level = materialize(best.select("g", "n", "x.origin", "x.up"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = materialize(seen.unionByName(level.select("g", "n")), "seen")
    # subtree sizes, from the deepest level up
    below, tree = None, None
    for lv in reversed(levels):
        lv = lv.select("g", "n", "up")
        lv = lv.withColumn("size", F.lit(1).cast("long")) if below is None else lv.join(below, _G, "left").select("g", "n", "up", (F.coalesce("s", F.lit(0)) + 1).alias("size"))
        lv = materialize(lv, "sized")
        tree = lv if tree is None else tree.unionByName(lv)
        below = lv.where("up is not null").groupBy("g", F.col("up").alias("n")).agg(F.sum("size").alias("s"))
    return materialize(tree, "tree")


def _chains(tree: DataFrame) -> DataFrame:
    """(g, n, up, size, light, head, pos): each node's heavy chain and its place on it, by doubling the way up; after k rounds 2^k places are passed. light: size of the subtrees of its parent that come before it."""
    heavy = tree.where("up is not null").groupBy("g", "up").agg(F.max(F.struct("size", -F.col("n"), "n")).alias("x")).select("g", "x.n", F.lit(True).alias("heavy"), F.col("x.size").alias("first"), "up")
    # of the other children in any order: sums by hash bucket, then within the bucket, so that no task holds a node's children
    kids = tree.where("up is not null").join(heavy.select("g", "n", "heavy"), _G, "left").where("heavy is null").withColumn("b", F.pmod(F.xxhash64("n"), F.lit(BUCKETS)).cast("int"))
    own = Window.partitionBy("g", "up", "b").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = kids.groupBy("g", "up", "b").agg(F.sum("size").alias("t"))
    total = total.withColumn("before", F.sum("t").over(Window.partitionBy("g", "up").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("t")).join(heavy.select("g", "up", "first"), ["g", "up"])
    kids = kids.withColumn("mine", F.sum("size").over(own) - F.col("size")).join(total.select("g", "up", "b", (F.col("before") + F.col("first")).alias("before")), ["g", "up", "b"])
    light = kids.select("g", "n", (F.col("mine") + F.col("before")).alias("light"))
    nodes = tree.join(heavy.select("g", "n", "heavy"), _G, "left").join(light, _G, "left")
    nodes = materialize(nodes.select("g", "n", "up", "size", F.coalesce("light", F.lit(0)).alias("light"), F.coalesce("heavy", F.lit(False)).alias("heavy")), "nodes")
    way = materialize(nodes.select("g", "n", F.when(F.col("heavy"), F.col("up")).otherwise(F.col("n")).alias("to"), F.when(F.col("heavy"), 1).otherwise(0).cast("long").alias("pos"), (~F.col("heavy")).alias("done")), "way")
    while not way.where("not done").isEmpty():
        # nodes under way of one chain all point to different places
        on = way.where("not done").join(way.select("g", F.col("n").alias("to"), F.col("to").alias("next"), F.col("pos").alias("more"), F.col("done").alias("end")), ["g", "to"])
        way = materialize(way.where("done").unionByName(on.select("g", "n", F.col("next").alias("to"), (F.col("pos") + F.col("more")).alias("pos"), F.col("end").alias("done"))), "way")
    return materialize(nodes.join(way.select("g", "n", F.col("to").alias("head"), "pos"), _G), "chains")


def far(links: DataFrame, full: bool) -> DataFrame:
    """The nodes of links (g, p, c), as hierarchy() gives them."""
    cyc = materialize(cycles(links), "cycles").withColumn("on_cycle", F.lit(True))
    all_nodes = links.select("g", F.explode(F.array("p", "c")).alias("n")).distinct()
    nodes = _chains(_tree(links))
    # chains from the roots' down: at most log2(nodes) rounds. base: nodes on the segments before; tin: place of the head in heavy-first order; segs: those segments
    heads = nodes.where("pos = 0").select("g", F.col("n").alias("head"), "up", "light")
    on = nodes.select("g", F.col("n").alias("up"), F.col("head").alias("on"), F.col("pos").alias("at"))
    heads = materialize(heads.where("up is not null").join(on, ["g", "up"]).select("g", "head", "on", "at", "light").unionByName(heads.where("up is null").select("g", "head", *(F.lit(None).cast("long").alias(c) for c in ("on", "at", "light")))), "heads")
    seg = F.struct(F.col("on").alias("h"), (F.col("at") + 1).alias("k"))
    none = F.array().cast("array<struct<h: bigint, k: bigint>>")
    level = materialize(heads.where("on is null").select("g", "head", F.col("head").alias("root"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("tin"), none.alias("segs")), "chain")
    chains = level
    while True:
        above = level.select("g", F.col("head").alias("on"), "root", "base", "tin", "segs")
        got = _spread_join(heads.where("on is not null"), above, ["g", "on"], "head")
        segs = F.concat("segs", F.array(seg)) if full else F.col("segs")
        level = materialize(got.select("g", "head", "root", (F.col("base") + F.col("at") + 1).alias("base"), (F.col("tin") + F.col("at") + 1 + F.col("light")).alias("tin"), segs.alias("segs")), "chain")
        if level.isEmpty():
            break
        chains = chains.unionByName(level)
    placed = _spread_join(nodes.select("g", "n", "size", "head", "pos"), chains.select("g", "head", "root", "base", "tin"), ["g", "head"], "n")
    tree = materialize(placed.select("g", "n", "size", "head", "pos", "root", (F.col("base") + F.col("pos")).alias("depth"), (F.col("tin") + F.col("pos")).alias("tin")), "placed")
    out = all_nodes.join(tree, _G, "left").join(cyc, _G, "left")
    mark = lambda c: F.when(F.col("on_cycle"), -1).otherwise(F.col(c)).cast("long").alias(c)
    cols = [F.col("g").alias("grp"), F.col("n").alias("node"), mark("root"), mark("depth"), F.coalesce(F.col("size") - 1, F.lit(0)).alias("n_descendants"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle")]
    if not full:
        return out.select(*cols)
    # paths: each chain's nodes in order, cut where the next chain hangs; a node's path has its chain's nodes anyway
    inside = lambda x: F.transform(F.sort_array(F.collect_list(x)), lambda y: y["n"])
    own = materialize(tree.groupBy("g", "head").agg(inside(F.struct("pos", "n")).alias("own")), "own")
    parts = chains.select("g", "head", F.posexplode("segs").alias("j", "s")).select("g", "head", "j", F.col("s.h").alias("on"), F.col("s.k").alias("k"))
    parts = _spread_join(parts, own.withColumnRenamed("head", "on"), ["g", "on"], "head").select("g", "head", F.struct("j", F.slice("own", F.lit(1), F.col("k").cast("int")).alias("x")).alias("x"))
    before = parts.groupBy("g", "head").agg(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda y: y["x"])).alias("before"))
    whole = own.join(before, ["g", "head"], "left")
    empty = F.array().cast("array<bigint>")
    path = _spread_join(tree.select("g", "n", "head", "pos"), whole, ["g", "head"], "n").select("g", "n", F.concat(F.coalesce("before", empty), F.slice("own", F.lit(1), (F.col("pos") + 1).cast("int"))).alias("path"))
    # descendants: the interval behind a node, from blocks of the heavy-first order
    block = lambda c: F.floor(c / BLOCK)
    blocks = tree.groupBy("g", "root", block(F.col("tin")).alias("b")).agg(inside(F.struct("tin", "n")).alias("x"))
    lo, hi = F.col("tin") + 1, F.col("tin") + F.col("size") - 1
    asked = tree.where("size > 1").select("g", "n", "root", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(block(lo), block(hi))).alias("b"))
    start = F.greatest(F.col("lo") - F.col("b") * BLOCK, F.lit(0)).cast("int")
    cut = F.slice("x", start + 1, F.least(F.col("hi") - F.col("b") * BLOCK, F.lit(BLOCK - 1)).cast("int") - start + 1)
    desc = asked.join(blocks, ["g", "root", "b"]).select("g", "n", cut.alias("x")).groupBy("g", "n").agg(F.sort_array(F.flatten(F.collect_list("x"))).alias("descendants"))
    out = out.join(path, _G, "left").join(desc, _G, "left")
    return out.select(*cols, F.coalesce("path", empty).alias("path"), F.coalesce("descendants", empty).alias("descendants"))
