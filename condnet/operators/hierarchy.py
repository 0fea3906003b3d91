"""Parent-child links of unknown depth to full hierarchies, with nodes on cycles told apart.

Method: after separating cycles, every node hangs below the root that reaches it in the fewest links; subtree sizes label
heavy chains; in heavy-first order a chain is one interval, so a node's path is its chain segments put together (at most
log2(n) of them), its root the first segment's head, its depth their length, and its descendants are one interval behind it, given
in ascending order. Groups (flows) that fit a task are solved many at a time in numpy; a group with more than `LOCAL` distinct links
is solved by distributed rounds over the same chains and intervals, with the same result.

Defined cases: links with a null end or group are no links; repeated links count once; a link to itself is a cycle; a root
has a link out and none in; among roots at equal distance the smallest id counts, then the smallest parent; nodes that no
root reaches and that lie on no cycle have root, depth and path null; nodes on cycles have root and depth -1. An empty table
gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condnet.common import materialize, parts

#: Link rows of one group that are solved in one task.
LOCAL = 1_000_000
#: Link rows that a task solves at a time.
BATCH = 300_000


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers first[i] .. first[i] + count[i] - 1."""
    total = int(count.sum())
    offs = np.cumsum(count) - count
    return np.repeat(first - offs, count) + np.arange(total)


class _Graph:
    """Outgoing links in compressed rows."""

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray):
        order = np.argsort(u, kind="stable")
        self.to = v[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n))])

    def out(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.at[nodes + 1] - self.at[nodes]
        return np.repeat(nodes, count), self.to[_expand(self.at[nodes], count)]


def _trim(n: int, g: _Graph, deg: np.ndarray) -> np.ndarray:
    """Nodes left when those without a link in are taken away again and again."""
    deg = deg.copy()
    left = np.ones(n, bool)
    front = np.flatnonzero(deg == 0)
    while len(front):
        left[front] = False
        _, to = g.out(front)
        np.subtract.at(deg, to, 1)
        to = np.unique(to)
        front = to[(deg[to] == 0) & left[to]]
    return left


def _on_cycle(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Nodes on a cycle: self links, and strongly connected components of what trimming leaves."""
    on = np.zeros(n, bool)
    on[u[u == v]] = True
    core = _trim(n, _Graph(n, u, v), np.bincount(v, minlength=n))
    core &= _trim(n, _Graph(n, v, u), np.bincount(u, minlength=n))
    keep = core[u] & core[v] & (u != v)
    if not keep.any():
        return on
    ids = np.flatnonzero(core)
    new = np.zeros(n, np.int64)
    new[ids] = np.arange(len(ids))
    g = _Graph(len(ids), new[u[keep]], new[v[keep]])
    at, to = g.at.tolist(), g.to.tolist()
    m = len(ids)
    index, low, stack, comp = [-1] * m, [0] * m, [], [-1] * m
    seen = 0
    for s in range(m):
        if index[s] >= 0:
            continue
        work = [(s, at[s])]
        index[s] = low[s] = seen
        seen += 1
        stack.append(s)
        while work:
            x, i = work.pop()
            deeper = False
            while i < at[x + 1]:
                y = to[i]
                i += 1
                if index[y] < 0:
                    work.append((x, i))
                    index[y] = low[y] = seen
                    seen += 1
                    stack.append(y)
                    work.append((y, at[y]))
                    deeper = True
                    break
                if comp[y] < 0:
                    low[x] = min(low[x], index[y])
            if deeper:
                continue
            if low[x] == index[x]:
                size, k = 0, len(stack) - 1
                while stack[k] != x:
                    k -= 1
                size = len(stack) - k
                for y in stack[k:]:
                    comp[y] = x
                    if size > 1:
                        on[ids[y]] = True
                del stack[k:]
            if work:
                p = work[-1][0]
                low[p] = min(low[p], low[x])
    return on


def solve(grp: np.ndarray, par: np.ndarray, child: np.ndarray, full: bool) -> dict[str, np.ndarray | pa.Array]:
    """Every node of the links' groups. full: with path and descendants."""
    nodes, node_code = np.unique(np.concatenate([par, child]), return_inverse=True)
    groups, g = np.unique(grp, return_inverse=True)
    key = np.concatenate([g, g]) * np.int64(len(nodes)) + node_code
    ids, code = np.unique(key, return_inverse=True)
    n, m = len(ids), len(par)
    link = np.unique(code[:m] * np.int64(n) + code[m:])
    u, v = link // n, link % n
    name = nodes[ids % len(nodes)]
    cyc = _on_cycle(n, u, v)
    graph = _Graph(n, u, v)
    is_root = np.ones(n, bool)
    is_root[v] = False
    seen = is_root.copy()
    origin = np.where(is_root, np.arange(n), -1)  # the root that settles ties
    up = np.full(n, -1, np.int64)
    front = np.flatnonzero(is_root)
    levels = [front]
    while len(front):
        a, b = graph.out(front)
        new = ~seen[b]
        a, b = a[new], b[new]
        # ids ascend by (group, name): comparing indices of one group compares names
        order = np.lexsort((a, origin[a], b))
        a, b = a[order], b[order]
        first = np.ones(len(b), bool)
        first[1:] = b[1:] != b[:-1]
        front, by = b[first], a[first]
        seen[front], origin[front], up[front] = True, origin[by], by
        if len(front):
            levels.append(front)
    size = np.ones(n, np.int64)
    for lv in levels[:0:-1]:
        np.add.at(size, up[lv], size[lv])
    # siblings heavy first, then by name; a chain goes on through the heavy child
    kids = np.flatnonzero(up >= 0)
    kids = kids[np.lexsort((kids, -size[kids], up[kids]))]
    heavy = np.zeros(n, bool)
    if len(kids):
        first = np.ones(len(kids), bool)
        first[1:] = up[kids[1:]] != up[kids[:-1]]
        heavy[kids[first]] = True
        before = np.cumsum(size[kids]) - size[kids]
        before -= np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(kids))))
        shift = np.zeros(n, np.int64)
        shift[kids] = before + 1
    tin = np.full(n, -1, np.int64)
    head = np.arange(n)
    roots = levels[0]
    tin[roots] = np.cumsum(size[roots]) - size[roots]
    for lv in levels[1:]:
        tin[lv] = tin[up[lv]] + shift[lv]
        h = lv[heavy[lv]]
        head[h] = head[up[h]]
    # up a node's chain to its head, on to the chain that this one hangs on, to a root: the last head is the root, the segments' lengths make the depth
    reached = np.flatnonzero(seen)
    depth, root = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    cur, mine = reached, reached
    segments = []
    while len(cur):
        long = tin[cur] - tin[head[cur]] + 1
        segments.append((cur, mine, long))
        depth[mine] += long
        root[mine] = head[cur]
        cur = up[head[cur]]
        go = cur >= 0
        cur, mine = cur[go], mine[go]
    out: dict = {"grp": groups[ids // len(nodes)], "node": name, "cyc": cyc, "reached": seen, "root": np.where(seen, name[root], -1), "depth": depth, "size": np.where(seen, size - 1, 0)}
    if full:
        order = np.empty(len(reached), np.int64)
        order[tin[reached]] = reached
        offs = np.concatenate([[0], np.cumsum(depth + 1)])  # none where unreached
        vals, end = np.empty(offs[-1], np.int64), offs[1:].copy()
        for cur, mine, long in segments:
            end[mine] -= long
            vals[_expand(end[mine], long)] = name[order[_expand(tin[head[cur]], long)]]
        out["path"] = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(vals))
        below = np.where(seen, size - 1, 0)
        offs = np.concatenate([[0], np.cumsum(below)])
        vals = name[order[_expand(tin + 1, below)]]
        vals = vals[np.lexsort((vals, np.repeat(np.arange(n), below)))]
        out["descendants"] = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(vals))
    return out


def links(df: DataFrame, group: str, hops: list[str]) -> DataFrame:
    """(g, p, c): the links between neighbouring columns of hops, with repetitions."""
    pairs = [F.struct(F.col(a).cast("long").alias("p"), F.col(b).cast("long").alias("c")) for a, b in zip(hops, hops[1:])]
    return df.where(F.col(group).isNotNull()).select(F.col(group).cast("long").alias("g"), F.explode(F.array(*pairs)).alias("x")).select("g", "x.p", "x.c").where("p is not null and c is not null")


def _schema(full: bool) -> T.StructType:
    s = T.StructType([T.StructField(c, T.LongType()) for c in ("grp", "node", "root", "depth", "n_descendants")])
    s.add("on_cycle", T.BooleanType())
    if full:
        s.add("path", T.ArrayType(T.LongType())).add("descendants", T.ArrayType(T.LongType()))
    return s


def hierarchy(df: DataFrame, group: str, hops: list[str], full: bool = False, local: int = LOCAL) -> DataFrame:
    """(grp, node, root, depth, n_descendants, on_cycle[, path, descendants]): a row for every node of the group's links.

    hops: columns of which each hands over to the next; two columns give one link a row, three give two.
    """
    width = len(hops) - 1
    ids = [F.col(h).cast("long").alias(f"h{i}") for i, h in enumerate(hops)]
    src = df.where(F.col(group).isNotNull()).select(F.col(group).cast("long").alias("g"), *ids)
    schema = _schema(full)

    def emit(got: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(got)
        width = t.num_columns - 2
        g = t.column("g").to_numpy()
        cols = [t.column(f"h{i}").combine_chunks() for i in range(width + 1)]
        ok = [c.is_valid().to_numpy(zero_copy_only=False) for c in cols]
        val = [c.fill_null(0).to_numpy() for c in cols]
        both = [ok[i] & ok[i + 1] for i in range(width)]
        if not any(b.any() for b in both):
            return
        r = solve(*(np.concatenate(x) for x in ([g[b] for b in both], [val[i][b] for i, b in enumerate(both)], [val[i + 1][b] for i, b in enumerate(both)])), full)
        cyc, no = r["cyc"], ~r["cyc"] & ~r["reached"]
        mark = lambda x: pa.array(np.where(cyc, -1, x), pa.int64(), mask=no)
        cols = [pa.array(r["grp"]), pa.array(r["node"]), mark(r["root"]), mark(r["depth"]), pa.array(r["size"]), pa.array(cyc)]
        yield pa.RecordBatch.from_arrays(cols + ([r["path"], r["descendants"]] if full else []), names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, rows = [], 0
        for b in batches:  # sorted by group: cut where one ends
            t = pa.Table.from_batches([b])
            got.append(t)
            rows += len(t)
            if rows >= BATCH:
                g = t.column("g").to_numpy()
                cut = int(np.searchsorted(g, g[-1]))
                if cut:
                    yield from emit([*got[:-1], t.slice(0, cut)])
                    got, rows = [t.slice(cut)], len(t) - cut
                elif len(got) > 1 and got[-2].column("g")[-1].as_py() != g[-1]:
                    yield from emit(got[:-1])
                    got, rows = [t], len(t)
        if got:
            yield from emit(got)

    spark = df.sparkSession
    # redelivered rows repeat a link; a group's distinct rows decide where it is solved
    large = src.groupBy("g").count().where(F.col("count") * width > local).select("g")
    large = materialize(large, "large")
    small = src
    if any_large := not large.isEmpty():
        small = src.join(large, "g", "left_anti")
    solved = lambda rows: rows.repartition(parts(spark), "g").sortWithinPartitions("g").mapInArrow(run, schema)
    near = solved(small)
    if not any_large:
        return near
    from condnet.operators.hierarchy_far import far

    # a group may be large by repeated links alone: what fits after taking each once is solved in a task, too
    rest = materialize(links(src.join(large, "g", "left_semi"), "g", [f"h{i}" for i in range(width + 1)]).distinct(), "links")
    huge = materialize(rest.groupBy("g").count().where(F.col("count") > local).select("g"), "huge")
    once = rest.join(huge, "g", "left_anti").select("g", F.col("p").alias("h0"), F.col("c").alias("h1"))
    out = near.unionByName(solved(once))
    return out if huge.isEmpty() else out.unionByName(far(rest.join(huge, "g", "left_semi").select("g", "p", "c"), full).select(*schema.names))
