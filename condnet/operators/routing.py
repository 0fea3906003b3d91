"""Route selection from conditional policies: candidates, best routes, policy updates, policy synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condnet.operators.algebra import c_join, hops


def set_path_val(var: Column, conds: Column, constants: bool = False) -> Column:
    """The value that the first `==` condition gives a variable: its other side; '_' stays; '' where none says so (with constants: a constant stays too)."""
    parts = F.transform(F.coalesce(conds, F.array().cast("array<string>")), lambda c: F.split(c, " ", 3))
    mine = F.filter(parts, lambda p: (F.size(p) == 3) & (F.get(p, F.lit(1)) == "==") & ((F.get(p, F.lit(0)) == var) | (F.get(p, F.lit(2)) == var)))
    first = F.get(mine, F.lit(0))
    value = F.when(F.get(first, F.lit(0)) == var, F.get(first, F.lit(2))).otherwise(F.get(first, F.lit(0)))
    missing = F.when(~var.rlike("^[a-zA-Z]"), var).otherwise(F.lit("")) if constants else F.lit("")
    return F.when(var == "_", F.lit("_")).otherwise(F.coalesce(value, missing))


def extend_values(df: DataFrame, constants: bool = False) -> DataFrame:
    """(dest, path, min_len) with path variables replaced by the values their conditions give them."""
    return df.select("dest", set_path_val(F.col("path"), F.col("condition"), constants).alias("path"), "min_len")


def update_policy(policy: DataFrame, delta: DataFrame) -> DataFrame:
    """Policies whose min_len a shorter announcement of the same dest beats get its length (the least of them) and the condition l(path) <= it."""
    best = delta.where(F.col("len_path").isNotNull() & F.col("dest").isNotNull()).groupBy(F.col("dest").alias("__d")).agg(F.min("len_path").alias("__m"))
    j = policy.join(best, policy["dest"] == best["__d"], "left")
    beaten = F.coalesce(F.col("min_len") > F.col("__m"), F.lit(False))
    text = F.concat(F.lit("l("), F.col("path"), F.lit(") <= "), F.col("__m").cast("string"))
    new = {"min_len": F.when(beaten, F.col("__m")).otherwise(F.col("min_len")), "condition": F.when(beaten, F.array(text)).otherwise(F.col("condition"))}
    return j.select(*(new.get(c, F.col(c)).alias(c) for c in policy.columns))


def new_candidates(current: DataFrame, delta: DataFrame, apply_withdrawals: bool = False) -> DataFrame:
    """(dest, path, len_path): current routes of the dests that the change mentions, and the changed routes, each once.

    By default the operation flag isn't looked at; with apply_withdrawals, withdrawn routes are taken away instead of added.
    """
    mine = current.join(delta.select("dest").distinct(), "dest", "left_semi").select("dest", "path", F.col("min_len").cast("int").alias("len_path"))
    if not apply_withdrawals:
        return mine.union(delta.select("dest", "path", F.col("len_path").cast("int"))).distinct()
    gone = delta.where("operation = 'W'").select("dest", "path")
    return mine.union(delta.where("operation = 'A'").select("dest", "path", F.col("len_path").cast("int"))).distinct().join(gone, ["dest", "path"], "left_anti")


def best_routes(policy: DataFrame, candidates: DataFrame, split: bool = True) -> DataFrame:
    """The policies joined with the candidate routes that they allow."""
    return c_join(policy, candidates, [("dest", "==", "dest"), ("path", "==", "path")], path_len=True, split=split)


def bgp_step(policy: DataFrame, current: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round of announcements: the new policies and the new best routes."""
    new = update_policy(policy, delta)
    return new, extend_values(best_routes(new, new_candidates(current, delta)))


def shortest_by_dest(routes: DataFrame) -> DataFrame:
    """(dest, n, min_hops): routes and least hops of each dest."""
    return routes.groupBy("dest").agg(F.count("*").alias("n"), F.min(hops(F.col("path"))).alias("min_hops"))


def first_seen(rib: DataFrame, sizes: tuple[int, int, int] = (333, 333, 334)) -> DataFrame:
    """(dest, cls, k): the first prefixes of a RIB (seq, dest, path) in order, cut into the classes x, y and z; k counts within a class from 1."""
    n = sum(sizes)
    first = rib.groupBy("dest").agg(F.min("seq").alias("first")).orderBy("first", "dest").limit(n)
    at = F.row_number().over(Window.orderBy("first", "dest"))  # n rows, a parameter
    a, b = sizes[0], sizes[0] + sizes[1]
    ranked = first.withColumn("at", at)
    cls = F.when(F.col("at") <= a, "x").when(F.col("at") <= b, "y").otherwise("z")
    return ranked.select("dest", cls.alias("cls"), (F.col("at") - F.when(F.col("at") <= a, 0).when(F.col("at") <= b, a).otherwise(b)).cast("int").alias("k"))


def synthesize(rib: DataFrame, sizes: tuple[int, int, int] = (333, 333, 334)) -> tuple[DataFrame, DataFrame]:
    """(policies, candidate routes) from a RIB (seq, dest, path) of distinct positions.

    Class x: shortest path, l(x1), l(x3), ... <= least hops, all distinct routes. Class y: static, the route seen first, all
    routes. Class z: filtered, z2 == nopath, one route.
    """
    seen = rib.join(F.broadcast(first_seen(rib, sizes)), "dest")
    per = seen.groupBy("dest", "cls", "k").agg(F.min(hops(F.col("path"))).cast("int").alias("least"), F.min_by("path", "seq").alias("first_path"))
    var = F.when(F.col("cls") == "x", F.concat(F.lit("x"), F.col("k") * 2 - 1)).when(F.col("cls") == "y", F.concat(F.lit("y"), F.col("k"))).otherwise(F.lit("z2"))
    cond = (
        F.when(F.col("cls") == "x", F.concat(F.lit("l("), var, F.lit(") <= "), F.col("least")))
        .when(F.col("cls") == "y", F.concat(var, F.lit(" == "), F.col("first_path"))).otherwise(F.lit("z2 == nopath"))
    )
    length = F.when(F.col("cls") == "x", F.col("least")).otherwise(F.lit(-1))
    policies = per.select("dest", var.alias("path"), length.alias("min_len"), F.array(cond).alias("condition"))
    x = seen.where("cls = 'x'").select("dest", "path").distinct().join(per.select("dest", "least"), "dest").select("dest", "path", F.col("least").alias("min_len"))
    y = seen.where("cls = 'y'").select("dest", "path", F.lit(-1).alias("min_len"))
    z = per.where("cls = 'z'").select("dest", F.col("first_path").alias("path"), F.lit(-1).alias("min_len"))
    return policies, x.unionByName(y).unionByName(z)


def announcements(updates: DataFrame, selected: DataFrame) -> DataFrame:
    """(dest, operation, path, len_path): UPDATE rows (kind, dest, path) of selected prefixes, each once; a kind with an A in it announces."""
    u = updates.join(selected.select("dest").distinct(), "dest", "left_semi")
    return u.select("dest", F.when(F.col("kind").contains("A"), "A").otherwise("W").alias("operation"), "path", hops(F.col("path")).cast("int").alias("len_path")).distinct()
