"""Runs of identical or near-identical neighbours in ordered sequences, each as one event.

Method: boundary interval lookup. Run starts are gathered into a sorted array per chunk, every event is assigned to its run
by binary search in that array, and runs are aggregated. `packed_runs` does so for sequences packed in one field;
`event_runs` for long tables, whose chunks are ranges of (entity, order): a run that crosses a chunk's border is joined from
the chunks' border runs alone, so an entity may hold any share of the rows.

Defined cases: null and empty sequences have no runs; events with a null entity or order are left out; a null event equals
only a null event; rows repeated with the same entity, order and id count once. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condnet.common import materialize, parts
from condnet.operators.packed import Packing, unpack


def as_number(hops: pa.Array) -> pa.Array:
    """The AS number of each hop in any customary spelling: digits, leading zeros, AS before it, two 16-bit halves with a dot; null where it is none."""
    t = pc.utf8_lower(hops)
    t = pc.replace_substring_regex(t, r"^as", "")
    plain = pc.match_substring_regex(t, r"^[0-9]{1,18}$")
    dotted = pc.match_substring_regex(t, r"^[0-9]{1,9}\.[0-9]{1,9}$")
    none = pa.scalar(None, pa.string())
    num = pc.if_else(plain, t, none).cast(pa.int64())
    parts = pc.extract_regex(pc.if_else(dotted, t, none), r"^(?P<hi>[0-9]+)\.(?P<lo>[0-9]+)$")
    halves = pc.add(pc.multiply(pc.struct_field(parts, "hi").cast(pa.int64()), 65536), pc.struct_field(parts, "lo").cast(pa.int64()))
    return pc.coalesce(num, halves)


def run_table(offs: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first position from 1, length) of each run in the sequences code[offs[r]:offs[r + 1]]."""
    n = len(code)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    start = np.ones(n, bool)
    start[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
    bounds = np.flatnonzero(start)  # sorted run starts
    run = np.searchsorted(bounds, np.arange(n), "right") - 1
    return row[bounds], bounds - offs[row[bounds]] + 1, np.bincount(run, minlength=len(bounds))


def packed_runs(df: DataFrame, row_id: str, value: str, how: Packing, same: Callable[[pa.Array], pa.Array], least: int = 2) -> DataFrame:
    """(row_id, first_pos, run_len): each maximal run of at least `least` neighbours in df[value] that `same` maps to one value; what it maps to null equals only an equal text."""
    src = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(value).alias("v"))
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("row_id", "first_pos", "run_len")])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = unpack(b.column(1), how)
            vals = lists.flatten()
            if not len(vals):
                continue
            num = same(vals)
            text = pc.if_else(num.is_valid(), pa.scalar(None, pa.string()), pc.utf8_lower(vals)).dictionary_encode().indices.fill_null(-1)
            code = np.unique(np.stack([num.fill_null(-1).to_numpy(), text.to_numpy()]), axis=1, return_inverse=True)[1] if num.null_count else num.to_numpy()
            row, first, size = run_table(lists.offsets.to_numpy().astype(np.int64), code)
            k = size >= least
            if k.any():
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[k])), pa.array(first[k], pa.int64()), pa.array(size[k], pa.int64())], names=out.names)

    return src.where("v is not null").mapInArrow(go, out)


def event_runs(df: DataFrame, entity: str, order: str, event: str, row_id: str, chunks: int | None = None, same: Callable[[Column], Column] | None = None) -> DataFrame:
    """(entity, event, first_at, last_at, events): runs of equal neighbours by (order, row_id) within an entity; order is a timestamp or number, its unit that of last_at - first_at.

    same: what near-identical events are mapped to; neighbours mapped to one value are one run, shown by its first event.
    """
    spark = df.sparkSession
    shown = F.col(event).cast("string")
    src = df.select(F.col(entity).alias("e"), F.col(order).alias("o"), F.col(row_id).alias("r"), shown.alias("v"), (same(shown) if same else shown).cast("string").alias("k")).where("e is not null and o is not null").dropDuplicates(["e", "o", "r"])
    kind = src.schema
    out = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("seq", T.LongType()), T.StructField("edge", T.BooleanType()), kind["e"], kind["v"], kind["k"], T.StructField("first_at", kind["o"].dataType), T.StructField("last_at", kind["o"].dataType), T.StructField("n", T.LongType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId()
        seq, held, leading = 0, None, True  # held: the last run so far, a table of one row, still open

        def rows(runs: pa.Table, edge: bool) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            n = len(runs)
            head = {"chunk": pa.array(np.full(n, chunk, np.int32)), "seq": pa.array(np.arange(seq, seq + n)), "edge": pa.array(np.full(n, edge))}
            seq += n
            yield from pa.table(head | {c: runs.column(c) for c in runs.schema.names}).combine_chunks().to_batches()

        for b in batches:
            if not len(b):
                continue
            e, o, v, k = (b.column(i) for i in (0, 1, 3, 4))
            ec = e.dictionary_encode().indices.to_numpy()
            kc = k.dictionary_encode(null_encoding="encode").indices.to_numpy()
            code = ec.astype(np.int64) * (int(kc.max()) + 1) + kc
            _, first, size = run_table(np.array([0, len(code)]), code)
            at, last = pa.array(first - 1), pa.array(first - 2 + size)
            runs = pa.table({"e": e.take(at), "v": v.take(at), "k": k.take(at), "first_at": o.take(at), "last_at": o.take(last), "n": pa.array(size, pa.int64())})
            if held is not None:
                if all(held.column(c)[0].as_py() == runs.column(c)[0].as_py() for c in ("e", "k")):
                    held = held.set_column(4, "last_at", runs.column("last_at").slice(0, 1)).set_column(5, "n", pa.array([held.column("n")[0].as_py() + int(size[0])], pa.int64()))
                    runs = runs.slice(1)
                runs = pa.concat_tables([held, runs])
            # the first and the last run of a chunk may go on in its neighbours
            if leading and len(runs) > 1:
                yield from rows(runs.slice(0, 1), True)
                runs, leading = runs.slice(1), False
            if len(runs) > 1:
                yield from rows(runs.slice(0, len(runs) - 1), False)
            held = runs.slice(len(runs) - 1)
        if held is not None:
            yield from rows(held, True)

    # written, as it is read twice and each execution would draw other range borders
    got = materialize(src.repartitionByRange(chunks or parts(spark), "e", "o", "r").sortWithinPartitions("e", "o", "r").mapInArrow(go, out), "runs")
    inner = got.where("not edge").select("e", "v", "first_at", "last_at", "n")
    # at most two border runs per chunk: those of one entity that follow one another with the same event are one run
    w = Window.partitionBy("e").orderBy("chunk", "seq")
    edges = got.where("edge").withColumn("gap", F.coalesce(F.lag("k").over(w).eqNullSafe(F.col("k")) & ((F.lag("chunk").over(w) < F.col("chunk"))), F.lit(False)))
    edges = edges.withColumn("run", F.sum(F.when(F.col("gap"), 0).otherwise(1)).over(w))
    joined = edges.groupBy("e", "run").agg(F.min_by("v", F.struct("chunk", "seq")).alias("v"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.sum("n").alias("n")).drop("run")
    return inner.unionByName(joined).select(F.col("e").alias(entity), F.col("v").alias(event), "first_at", "last_at", F.col("n").alias("events"))
