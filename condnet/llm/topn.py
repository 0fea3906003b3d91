"""The N best items of every group, whatever the group's size.

Method: partition lower bounds. Where a partition has N items of a group, the score of its N-th best is a valid bound for the
group: `bounds` takes from every partition that score alone and keeps the tightest of each group. `within` joins the bounds and
drops the rows beyond them where they lie, before any shuffle. `ranked` ranks the survivors: each partition hands on its own N
best of every group, so a group, however large, moves at most N rows a partition.

The bounds that are sent to every task are those of the `HEAVY` groups with most rows (a parameter, with keys of at most
`KEY` characters, so their size is bounded); rows of the other groups aren't compared with a bound and go to the ranking as their
partitions' N best. The result is the same with any number of bounds.

Defined cases: rows with a null group or null item id are no candidates; a null score is worse than any other; rows with the
same group and id count once, with the best score; the score columns are compared in order, smaller first, ties by id; a group
with fewer than N items gives them all; an empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condnet.common import materialize

#: Rows a partition buffers before it prunes, and kept rows after which it hands them on.
BUFFER, KEEP = 200_000, 1_000_000
#: Groups whose bounds are sent to every task, and characters of their keys at most.
HEAVY, KEY = 50_000, 256
_WORST = np.iinfo(np.int64).max


def _prune(t: pa.Table, groups: list[str], scores: int, n: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The n best rows of each group in t (columns groups, s0.., i, and `rows` where counted), which of them is the n-th, and how many rows its group has."""
    code = np.zeros(len(t), np.int64)
    for g in groups:
        enc = t.column(g).combine_chunks().dictionary_encode()
        code = np.unique(code * (len(enc.dictionary) + 1) + enc.indices.fill_null(len(enc.dictionary)).to_numpy(), return_inverse=True)[1] if len(groups) > 1 else enc.indices.to_numpy()
    key = [t.column(f"s{k}").combine_chunks().fill_null(_WORST).to_numpy() for k in range(scores)]
    item = t.column("i").to_numpy()
    size = np.bincount(code, t.column("rows").to_numpy() if "rows" in t.schema.names else None).astype(np.int64)
    order = np.lexsort((*key[::-1], item, code))  # rows of one id together, best first
    c, i = code[order], item[order]
    first = np.ones(len(order), bool)
    first[1:] = (c[1:] != c[:-1]) | (i[1:] != i[:-1])
    order = order[first]
    order = order[np.lexsort((item[order], *(k[order] for k in key[::-1]), code[order]))]
    c = code[order]
    start = np.ones(len(c), bool)
    start[1:] = c[1:] != c[:-1]
    at = np.flatnonzero(start)
    rank = np.arange(len(c)) - np.repeat(at, np.diff(np.append(at, len(c))))
    best = rank < n
    # a group's rows so far are counted on its best row
    rows = np.where(rank[best] == 0, size[c[best]], 0)
    return t.take(pa.array(order[best])), rank[best] == n - 1, rows


def _local(groups: list[str], scores: int, n: int, names: list[str], bound: bool):
    """Each partition's n best rows of every group; or, of groups with n, the n-th best score and how many rows the partition has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, rows, kept = [], 0, 0

        def prune() -> tuple[pa.Table, np.ndarray, np.ndarray]:
            return _prune(pa.concat_tables(got), groups, scores, n)

        def emit(t: pa.Table, nth: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
            if bound:
                code = np.cumsum(size > 0) - 1  # rows of a group stand together, its best first
                t = t.set_column(t.schema.get_field_index("rows"), "rows", pa.array(size[size > 0][code]))
                t = t.filter(pa.array(nth))
            yield from t.select(names).combine_chunks().to_batches(max_chunksize=50_000)

        for b in batches:
            t = pa.Table.from_batches([b])
            got.append(t.append_column("rows", pa.array(np.ones(len(t), np.int64))) if bound else t)
            rows += len(b)
            if rows - kept >= max(BUFFER, kept):
                t, nth, size = prune()
                if bound:
                    t = t.set_column(t.schema.get_field_index("rows"), "rows", pa.array(size))
                if len(t) > KEEP:
                    yield from emit(t, nth, size)
                    got, rows, kept = [], 0, 0
                else:
                    got, rows, kept = [t], len(t), len(t)
        if rows:
            yield from emit(*prune())

    return run


def _source(df: DataFrame, group: Column, scores: list[Column], item: Column, more: list[Column]) -> DataFrame:
    return df.select(group.alias("g"), *(s.cast("long").alias(f"s{j}") for j, s in enumerate(scores)), item.cast("long").alias("i"), *more).where("g is not null and i is not null")


def bounds(df: DataFrame, group: Column, scores: list[Column], item: Column, n: int) -> DataFrame:
    """(g, rows, bound): of groups of which some partition has n items, the tightest of the partitions' n-th best scores, and the rows of those partitions. Written."""
    src = _source(df, group, scores, item, [])
    names = ["g", *(f"s{j}" for j in range(len(scores))), "rows"]
    out = T.StructType([*(src.schema[c] for c in names[:-1]), T.StructField("rows", T.LongType())])
    score = F.struct(*(F.coalesce(f"s{j}", F.lit(_WORST)).alias(f"s{j}") for j in range(len(scores))))
    nth = src.mapInArrow(_local(["g"], len(scores), n, names, True), out)
    return materialize(nth.groupBy("g").agg(F.sum("rows").alias("rows"), F.min(score).alias("bound")), "bounds")


def within(df: DataFrame, group: Column, scores: list[Column], limits: DataFrame) -> DataFrame:
    """The rows of df whose scores are at most their group's bound; all rows of groups without one."""
    sent = limits.where(F.char_length("g") <= KEY) if dict(limits.dtypes)["g"] == "string" else limits
    sent = sent.orderBy(F.desc("rows"), "g").limit(HEAVY).select(F.col("g").alias("__g"), F.col("bound").alias("__bound"))
    score = F.struct(*(F.coalesce(s.cast("long"), F.lit(_WORST)).alias(f"s{j}") for j, s in enumerate(scores)))
    return df.join(F.broadcast(sent), group == F.col("__g"), "left").where(F.col("__bound").isNull() | (score <= F.col("__bound"))).drop("__g", "__bound")


def nearest(df: DataFrame, group: list[str], scores: list[str], item: str, n: int) -> DataFrame:
    """The rows of df without those that a partition's n best of their group beat; columns of whole numbers, none null but in group."""
    k = len(scores)
    src = df.select(*group, *(F.col(s).cast("long").alias(f"s{j}") for j, s in enumerate(scores)), F.col(item).cast("long").alias("i"))
    got = src.mapInArrow(_local(group, k, n, src.columns, False), src.schema)
    return got.select(*group, *(F.col(f"s{j}").alias(s) for j, s in enumerate(scores)), F.col("i").alias(item))


def ranked(df: DataFrame, group: Column, scores: list[Column], item: Column, n: int) -> DataFrame:
    """(g, s0.., i, rank): the n best items of each group by the scores (whole numbers), then by item."""
    k = len(scores)
    src = _source(df, group, scores, item, [])
    kept = src.mapInArrow(_local(["g"], k, n, src.columns, False), src.schema)
    score = F.struct(*(F.coalesce(f"s{j}", F.lit(_WORST)).alias(f"s{j}") for j in range(k)), F.col("i"))
    by = Window.partitionBy("g")
    # at most n rows a partition and group are here; of the rows of one id, which repeat between partitions, the best counts
    again = F.coalesce(F.lag("i").over(by.orderBy("i", "score")) == F.col("i"), F.lit(False))
    once = kept.withColumn("score", score).withColumn("again", again).where("not again")
    top = once.withColumn("rank", F.row_number().over(by.orderBy("score"))).where(F.col("rank") <= n)
    return top.select("g", *(F.col(f"score.s{j}").alias(f"s{j}") for j in range(k)), "i", F.col("rank").cast("long").alias("rank"))


def top_n(df: DataFrame, group: Column, scores: list[Column], item: Column, n: int) -> DataFrame:
    """(g, s0.., i, rank): the n best items of each group: bounds of the partitions, rows within them, ranked."""
    return ranked(within(df, group, scores, bounds(df, group, scores, item, n)), group, scores, item, n)
