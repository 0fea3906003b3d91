"""Shortest paths over links, paths as forwarding rows, and their differences."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condnet.common import materialize, parts


def active(tp: DataFrame) -> DataFrame:
    """(sid, nid): links in use, in both directions, each once."""
    e = tp.where("isactive = 1").select("sid", "nid")
    return e.union(e.select("nid", "sid")).where("sid is not null and nid is not null and sid <> nid").distinct()


#: Directed links (16 bytes each) up to which every task gets the whole graph.
BOUND = 2_000_000


class Links:
    """All links in compressed rows over node numbers that keep the order of the ids."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.ids = np.unique(np.concatenate([a, b]))
        u, v = np.searchsorted(self.ids, a), np.searchsorted(self.ids, b)
        order = np.lexsort((v, u))
        self.to = v[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=len(self.ids)))])

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Node numbers, -1 where an id has no link."""
        if not len(self.ids):
            return np.full(len(ids), -1)
        k = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[k] == ids, k, -1)

    def search(self, start: int, ends: np.ndarray, forward: bool, max_hops: int | None) -> list[np.ndarray]:
        """The smallest shortest sequence between start and each of the ends (numbers), read from start if forward, else from the end; empty where there is none."""
        n = len(self.ids)
        depth, by = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        depth[start] = 0
        front, missing = np.array([start]), len(np.unique(ends)) - int((ends == start).any())
        wanted = np.zeros(n, bool)
        wanted[ends] = True
        for level in islice(count(1), max_hops):
            if not len(front) or missing <= 0:
                break
            width = self.at[front + 1] - self.at[front]
            first = np.cumsum(width) - width
            v = self.to[np.repeat(self.at[front] - first, width) + np.arange(width.sum())]
            place = np.repeat(np.arange(len(front)), width)  # forward, front is in the order of its sequences
            new = depth[v] < 0
            v, place = v[new], place[new]
            key = place if forward else front[place]
            order = np.lexsort((key, v))
            v, place = v[order], place[order]
            one = np.ones(len(v), bool)
            one[1:] = v[1:] != v[:-1]
            v, place = v[one], place[one]
            depth[v], by[v] = level, front[place]
            missing -= int(wanted[v].sum())
            front = v[np.lexsort((v, place))] if forward else v
        out = []
        for e in ends.tolist():
            if depth[e] < 0:
                out.append(self.ids[:0])
                continue
            seq = np.empty(depth[e] + 1, np.int64)
            for k in range(depth[e] + 1):
                seq[k] = e
                e = by[e]
            out.append(self.ids[seq[::-1] if forward else seq])
        return out


def _near(edges: DataFrame, wanted: DataFrame, start: str, end: str, max_hops: int | None) -> DataFrame:
    """Searches in tasks that hold the whole graph; a start's ends are at most as many as the graph's nodes."""
    spark = edges.sparkSession
    e = edges.select(F.col("sid").cast("long"), F.col("nid").cast("long")).toArrow()  # at most BOUND links
    sent = spark.sparkContext.broadcast((e.column(0).to_numpy(), e.column(1).to_numpy()))
    schema = T.StructType([T.StructField(start, T.LongType()), T.StructField(end, T.LongType()), T.StructField("pv", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = Links(*sent.value)
        for b in batches:
            s, t = b.column(0).to_numpy(), b.column(1).to_numpy()
            ns, nt = links.find(s), links.find(t)
            pv = [links.ids[:0]] * len(b)
            known = np.flatnonzero((ns >= 0) & (nt >= 0))
            known = known[np.argsort(ns[known], kind="stable")]
            for part in np.split(known, np.flatnonzero(np.diff(ns[known])) + 1) if len(known) else []:
                for i, p in zip(part, links.search(int(ns[part[0]]), nt[part], start == "src", max_hops)):
                    pv[i] = p
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pv, pa.list_(pa.int64()))], names=schema.names)

    return wanted.select(start, end).repartition(parts(spark), start).sortWithinPartitions(start).mapInArrow(run, schema)


def _inner(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, inner links): each node (n) with the node where searches for it start (core): a node with one link starts at its neighbour, unless that has no other link either; and the links between cores."""
    nodes = materialize(edges.groupBy("sid").agg(F.count("*").alias("deg"), F.min("nid").alias("to")), "nodes")
    end = nodes.where("deg = 1").join(nodes.where("deg > 1").select(F.col("sid").alias("to")), "to", "left_semi").select(F.col("sid").alias("n"), F.col("to").alias("core"))
    places = materialize(nodes.select(F.col("sid").alias("n")).join(end, "n", "left").select("n", F.coalesce("core", "n").alias("core")), "places")
    ends = places.where("n <> core").select("n")
    inner = edges.join(ends.withColumnRenamed("n", "sid"), "sid", "left_anti").join(ends.withColumnRenamed("n", "nid"), "nid", "left_anti")
    return places, inner.select("sid", "nid")


def shortest_paths(tp: DataFrame, pairs: DataFrame, max_hops: int | None = None, bound: int = BOUND) -> DataFrame:
    """(fid, src, dst, pv): for each pair the node sequence with fewest links; of several the smallest sequence; [] where there is none.

    max_hops: farther ends count as unreachable; by default the search goes on until nothing new is found.

    Nodes with one link (hosts) are taken off first, so that only the paths between their neighbours are searched, each once.
    Searches start from the endpoints of which there are fewer distinct ones. While the links left are at most `bound`, counted
    first, every task gets them all and searches by itself. Beyond that, breadth-first search goes level by level over tables: links
    go both ways, so what a step finds anew lies in neither of the last two levels; every level is written to the shared folder, and
    a search whose ends are all found goes no further. A pair of a node with itself has that one node as its path if the node
    has a link. Counting, and the levels, run when the function is called.
    """
    edges = materialize(active(tp).select(F.col("sid").cast("long"), F.col("nid").cast("long")), "edges")
    places, edges = _inner(edges)
    ends = pairs.where("src is not null and dst is not null").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()
    at = lambda c: places.select(F.col("n").alias(c), F.col("core").alias(f"{c}_core"))
    ends = materialize(ends.join(at("src"), "src").join(at("dst"), "dst"), "ends")
    between = _between(edges, ends.where("src <> dst and src_core <> dst_core").select(F.col("src_core").alias("src"), F.col("dst_core").alias("dst")).distinct(), max_hops, bound)
    p = ends.join(between.select(F.col("src").alias("src_core"), F.col("dst").alias("dst_core"), "pv"), ["src_core", "dst_core"], "left")
    tail = lambda c: F.when(F.col(c) != F.col(f"{c}_core"), F.array(c)).otherwise(F.array().cast("array<bigint>"))
    inner = F.when(F.col("src_core") == F.col("dst_core"), F.array("src_core")).otherwise(F.col("pv"))
    whole = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.concat(tail("src"), inner, tail("dst")))
    p = p.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), whole.alias("pv"))
    return _joined(pairs, p if max_hops is None else p.where(F.size("pv") <= max_hops + 1))


def _between(edges: DataFrame, wanted: DataFrame, max_hops: int | None, bound: int) -> DataFrame:
    """(src, dst, pv): paths of distinct pairs of different nodes; null or [] where there is none."""
    edges, wanted = materialize(edges, "inner"), materialize(wanted, "pairs")
    n = wanted.agg(F.count_distinct("src").alias("s"), F.count_distinct("dst").alias("d")).first()
    start, end = ("src", "dst") if n["s"] <= n["d"] else ("dst", "src")
    if edges.count() <= bound:
        return _near(edges, wanted, start, end, max_hops).select("src", "dst", F.when(F.size("pv") > 0, F.col("pv")).alias("pv"))
    left = wanted.select(F.col(start).alias("start"), F.col(end).alias("at"))
    hop = edges.select(F.col("sid").alias("at"), F.col("nid").alias("to"))
    level = left.select("start").distinct().join(hop, F.col("start") == F.col("at"), "left_semi")
    level = materialize(level.select("start", F.col("start").alias("at"), F.array("start").alias("pv")), "level")
    before, found = level.limit(0), None
    for _ in islice(count(), None if max_hops is None else max_hops + 1):
        hit = materialize(level.join(left, ["start", "at"]), "hits")
        found = hit if found is None else found.unionByName(hit)
        if not hit.isEmpty():
            left = materialize(left.join(hit, ["start", "at"], "left_anti"), "left")
            if left.isEmpty():
                break
        go = level.join(left.select("start").distinct(), "start", "left_semi")
        step = go.join(hop, "at").select("start", F.col("to").alias("at"), F.concat("pv", F.array("to")).alias("pv") if start == "src" else F.concat(F.array("to"), "pv").alias("pv"))
        old = level.select("start", "at").unionByName(before.select("start", "at"))
        before, level = level, materialize(step.groupBy("start", "at").agg(F.min("pv").alias("pv")).join(old, ["start", "at"], "left_anti"), "level")
        if level.isEmpty():
            break
    return found.select(F.col("start").alias(start), F.col("at").alias(end), "pv")


def _joined(pairs: DataFrame, p: DataFrame) -> DataFrame:
    out = pairs.select("fid", "src", "dst").join(p, (F.col("src") == F.col("__s")) & (F.col("dst") == F.col("__d")), "left")
    return out.select("fid", "src", "dst", F.coalesce("pv", F.array().cast("array<bigint>")).alias("pv"))


def path_triples(paths: DataFrame) -> DataFrame:
    """(fid, pid, sid, nid): every inner node of a path with its neighbours; n - 2 rows for n nodes, however long the path."""
    p = paths.where(F.size("pv") > 2).select("fid", "pv", F.explode(F.sequence(F.lit(1), F.size("pv") - 2)).alias("i"))
    return p.select("fid", F.get("pv", F.col("i") - 1).alias("pid"), F.get("pv", F.col("i")).alias("sid"), F.get("pv", F.col("i") + 1).alias("nid"))


def path_entries(paths: DataFrame) -> DataFrame:
    """(fid, pid, sid, nid): as path_triples, with the first node's row (null, first, second) before; n - 1 rows."""
    p = paths.where(F.size("pv") > 1).select("fid", "pv", F.explode(F.sequence(F.lit(0), F.size("pv") - 2)).alias("i"))
    before = F.when(F.col("i") > 0, F.get("pv", F.col("i") - 1))
    return p.select("fid", before.alias("pid"), F.get("pv", F.col("i")).alias("sid"), F.get("pv", F.col("i") + 1).alias("nid"))


def difference(desired: DataFrame, installed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to install, to delete), as sets."""
    cols = ["fid", "pid", "sid", "nid"]
    a, b = (x.select(*(F.col(c).cast("long").alias(c) for c in cols)) for x in (desired, installed))
    return a.subtract(b), b.subtract(a)


def link_state(tp: DataFrame, events: DataFrame) -> DataFrame:
    """tp after events (seq, sid, nid, up): the last event of a link, in either direction, decides; a link that comes up and isn't there is added both ways."""
    a, b = F.least("sid", "nid"), F.greatest("sid", "nid")
    last = events.groupBy(a.alias("__a"), b.alias("__b")).agg(F.max_by("up", "seq").alias("__up"))
    t = tp.join(last, (F.least("sid", "nid") == F.col("__a")) & (F.greatest("sid", "nid") == F.col("__b")), "left")
    new = t.select(*(F.coalesce("__up", "isactive").cast("int").alias("isactive") if c == "isactive" else F.col(c) for c in tp.columns))
    up = last.where("__up = 1").select(F.explode(F.array(F.struct(F.col("__a").alias("sid"), F.col("__b").alias("nid")), F.struct(F.col("__b").alias("sid"), F.col("__a").alias("nid")))).alias("x")).select("x.*")
    fresh = up.join(tp, ["sid", "nid"], "left_anti")
    kinds = dict(tp.dtypes)
    fill = {"sid": F.col("sid"), "nid": F.col("nid"), "isactive": F.lit(1), "ishost": F.lit(0)}
    return new.unionByName(fresh.select(*(fill.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in tp.columns)))


def new_ports(ports: DataFrame, tp: DataFrame, events: DataFrame) -> DataFrame:
    """ports (sid, nid, port) with those of links that come up and weren't there, from events (seq, sid, nid, up, port1, port2): port1 is that of sid, port2 that of nid; the first such event of a link counts."""
    both = F.explode(F.array(F.struct("sid", "nid", F.col("port1").alias("port")), F.struct(F.col("nid").alias("sid"), F.col("sid").alias("nid"), F.col("port2").alias("port")))).alias("x")
    up = events.where("up = 1").select("seq", both).groupBy("x.sid", "x.nid").agg(F.min_by("x.port", "seq").alias("port"))
    return ports.select("sid", "nid", "port").unionByName(up.join(tp.select("sid", "nid"), ["sid", "nid"], "left_anti").select("sid", "nid", "port"))


def hop_position(path: Column, hop: Column) -> Column:
    """The place of a hop's first occurrence in a space-separated path, from 1; 0 where it isn't there."""
    return F.array_position(F.split(path, " "), hop)


def reroute(tp: DataFrame, cf: DataFrame, rm: DataFrame, down: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tp, to delete, to install) after links (sid, nid) went down: all rows of the flows that used one, and those flows' new paths over what is left."""
    both = down.select("sid", "nid").union(down.select(F.col("nid"), F.col("sid"))).distinct()
    hit = cf.join(both, ["sid", "nid"], "left_semi").select("fid").distinct()
    left = tp.join(both.withColumn("__down", F.lit(1)), ["sid", "nid"], "left").select(*(F.when(F.col("__down") == 1, 0).otherwise(F.col("isactive")).cast("int").alias("isactive") if c == "isactive" else F.col(c) for c in tp.columns))
    dele = cf.join(hit, "fid", "left_semi").select("fid", "pid", "sid", "nid")
    ins = path_triples(shortest_paths(left, rm.join(hit, "fid", "left_semi")))
    return left, dele, ins


def next_free(df: DataFrame, col: str) -> DataFrame:
    """The smallest positive whole number that isn't in a column."""
    ids = df.where(F.col(col) > 0).select(F.col(col).cast("long").alias("id")).distinct()
    # an id is followed by a gap, or 1 itself is free
    after = ids.select((F.col("id") + 1).alias("id")).join(ids, "id", "left_anti")
    one = df.sparkSession.range(1, 2).join(ids, "id", "left_anti")
    return after.unionByName(one).agg(F.min("id").alias("next_id"))
