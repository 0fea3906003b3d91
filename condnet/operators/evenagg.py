"""Results per key at even cost, whatever share of the rows one key holds.

Method: every equal split of the input encodes its keys by a dictionary and reduces its rows into dense accumulator arrays
(bincount for counts, scatter-reduce for the rest). The arrays are cut into blocks of keys; the blocks of all splits are
summed by a distributed, streaming reduction into the block's own dense arrays. A key, however heavy, is one array entry per
split. Memory of a task: the keys of its block, never the rows of a key.

Defined cases: rows with the same id count once, with the smallest key and measures; a null key is a key of its own (it counts for the
table only where heavy keys are asked for); null measures are skipped; an empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condnet.common import materialize, parts

#: Keys that a task's dictionary may hold before its arrays are handed on.
LIMIT = 400_000
_OPS = {"sum": (np.add, 0), "min": (np.minimum, np.iinfo(np.int64).max), "max": (np.maximum, np.iinfo(np.int64).min)}


class _Dense:
    """Dense accumulators over a growing dictionary of keys; column 0 counts rows."""

    def __init__(self, ops: list[str]):
        self.ops, self.keys, self.pending = ops, None, []
        self.rows = 0

    def add(self, keys: pa.Array, cols: list[np.ndarray], valid: list[np.ndarray]) -> None:
        self.pending.append((keys, cols, valid))
        self.rows += len(keys)
        if self.rows > LIMIT:
            self.fold()

    def fold(self) -> None:
        if not self.pending:
            return
        chunks = [k for k, _, _ in self.pending]
        if self.keys is not None:
            chunks.append(self.keys)
        enc = pa.chunked_array(chunks).combine_chunks().dictionary_encode(null_encoding="encode")
        codes, size = enc.indices.to_numpy(), len(enc.dictionary)
        out, new_n = [], []
        old = self.acc if self.keys is not None else None
        for i, op in enumerate(self.ops):
            ufunc, start = _OPS[op]
            vals = [c[i] for _, c, _ in self.pending]
            oks = [v[i] for _, _, v in self.pending]
            if old is not None:
                vals.append(old[i][0])
                oks.append(old[i][1])
            v, ok = np.concatenate(vals), np.concatenate(oks)
            if op == "sum" and ok.all() and (not len(v) or np.abs(v).max() < 2**53 / max(1, len(v))):
                acc = np.bincount(codes, weights=v, minlength=size).astype(np.int64)
            else:
                acc = np.full(size, start, np.int64)
                ufunc.at(acc, codes[ok], v[ok])
            n = np.bincount(codes[ok], minlength=size) > 0
            out.append((acc, n))
            new_n.append(n)
        self.keys, self.acc, self.pending, self.rows = enc.dictionary, out, [], 0

    def take(self) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]] | None:
        self.fold()
        if self.keys is None:
            return None
        got = self.keys, self.acc
        self.keys = None
        return got


def _masked(acc: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    return pa.array(acc[0], pa.int64(), mask=~acc[1])


def per_key(df: DataFrame, key: str, measures: dict[str, tuple[str, str]] | None = None, row_id: str | None = None, blocks: int | None = None) -> DataFrame:
    """(key, n, measures): rows and measures of each key. measures: name -> (column of whole numbers, 'sum' | 'min' | 'max'). row_id: rows with the same id count once."""
    measures = measures or {}
    blocks = blocks or 4 * parts(df.sparkSession)
    cols = [F.col(key).alias("k"), *(F.col(c).cast("long").alias(f"m{i}") for i, (c, _) in enumerate(measures.values()))]
    src = df.select(*cols) if row_id is None else df.select(F.col(row_id).alias("i"), *cols)
    if row_id is not None:  # ids spread evenly: the shuffle makes the equal splits
        names = src.columns[1:]
        src = src.groupBy("i").agg(*(F.min(c).alias(c) for c in names)).select(*names)
    kind = src.schema["k"].dataType
    # the block of a key: a hash that every split computes alike
    src = src.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)))
    ops = ["sum", *(op for _, op in measures.values()), "max"]
    out = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)), *(T.StructField(f"a{i}", T.ArrayType(T.LongType())) for i in range(len(ops) - 1))])

    def cut(got: tuple) -> Iterator[pa.RecordBatch]:
        keys, (*acc, (b, _)) = got
        order = np.argsort(b, kind="stable")
        ids, first = np.unique(b[order], return_index=True)
        offs = pa.array(np.append(first, len(order)).astype(np.int32))
        at = pa.array(order)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.ListArray.from_arrays(offs, keys.take(at)), *(pa.ListArray.from_arrays(offs, _masked(a).take(at)) for a in acc)], names=out.names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _Dense(ops)
        for x in batches:
            vals, ok = [np.ones(len(x), np.int64)], [np.ones(len(x), bool)]
            for c in x.columns[1:]:
                vals.append(c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                ok.append(c.is_valid().to_numpy(zero_copy_only=False))
            d.add(x.column(0), vals, ok)
            if d.keys is not None and len(d.keys) > LIMIT:
                yield from cut(d.take())
        if got := d.take():
            yield from cut(got)

    final = T.StructType([T.StructField(key, kind), T.StructField("n", T.LongType()), *(T.StructField(m, T.LongType()) for m in measures)])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = _Dense(ops[:-1])
        for x in batches:
            flat = [pc.list_flatten(c) for c in x.columns[1:]]
            d.add(flat[0], [c.fill_null(0).to_numpy(zero_copy_only=False) for c in flat[1:]], [c.is_valid().to_numpy(zero_copy_only=False) for c in flat[1:]])
        if got := d.take():
            keys, acc = got
            yield pa.RecordBatch.from_arrays([keys, *(_masked(a) for a in acc)], names=final.names)

    return src.mapInArrow(split, out).repartition(parts(df.sparkSession), "b").mapInArrow(reduce, final)


def heavy_keys(df: DataFrame, key: str, row_id: str | None = None, percent: int = 2) -> DataFrame:
    """(key_val, n, total): keys with at least percent % of the rows of the table, of which rows without a key are part. At most 100 / percent rows."""
    n = materialize(per_key(df, key, row_id=row_id), "keys")
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    heavy = n.where(F.col(key).isNotNull()).join(F.broadcast(total), F.col("n") * 100 >= F.col("total") * percent)
    return heavy.select(F.col(key).cast("string").alias("key_val"), "n", "total")
