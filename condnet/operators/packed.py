"""Several values packed in one field: one row per value, with its position.

Method: the bytes of a whole Arrow batch are scanned at once. Byte classes come from a lookup table, quoted regions from quote
parity (cumulative sums over matched quotes), bracket depth from cumulative sums per element; what is left of delimiters gives
the offsets of the pieces, from which list arrays are built and flattened with their parent's ordinal.

Defined cases: a null or empty field, or one of delimiters only, gives no row; an unclosed quote is an ordinary character; an
unclosed bracket protects the rest of its element; repeated rows give repeated values (see `once`). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Packing:
    """How values are packed.

    delimiters: bytes that always separate (outside protection); words: words that separate where blanks or delimiters
    stand on both sides; blank_separates: whether blanks are delimiters too; quotes: quote bytes; after: a quote whose
    last non-blank predecessor is one of these bytes opens a protected region up to the next equal quote (any other quote
    only encloses and separates); brackets: round brackets protect what they hold; drop: pieces that are no value.
    """

    delimiters: bytes
    words: tuple[bytes, ...] = ()
    blank_separates: bool = False
    quotes: bytes = b"\"'"
    after: bytes = b""
    brackets: bool = False
    drop: tuple[bytes, ...] = ()


#: A path: every ASCII character but letters, digits, '.', ':' and '_' only encloses or separates hops.
PATH = Packing(bytes(b for b in range(128) if not (chr(b).isalnum() or b in b".:_")), blank_separates=True, drop=(b"_",))
#: A condition: comparisons joined by , ; | & line ends, braces or the word and; Or(...) is one value.
CONDITION = Packing(b",;|&\n{}", words=(b"and",), after=b"=<>", brackets=True)


def _lut(of: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(of, np.uint8)] = True
    return t


def _protected(data: np.ndarray, elem: np.ndarray, quote: np.ndarray, opener: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes inside or at protected quotes, quotes that protect): each opener reaches to the next equal quote of its element."""
    n = len(data)
    inside = np.zeros(n + 1, np.int32)
    used = np.zeros(n, bool)
    at = np.flatnonzero(opener)
    if not len(at):
        return inside[:n] > 0, used
    close = np.full(len(at), -1, np.int64)
    for q in np.unique(data[at]):
        same = np.flatnonzero(quote & (data == q))
        mine = np.flatnonzero(data[at] == q)
        k = np.searchsorted(same, at[mine], "right")
        ok = k < len(same)
        to = same[np.minimum(k, len(same) - 1)]
        ok &= elem[to] == elem[at[mine]]
        close[mine[ok]] = to[ok]
    at, close = at[close >= 0], close[close >= 0]
    if not len(at):
        return inside[:n] > 0, used
    # an opener within an earlier region is content: follow the chain opener -> first opener behind its closer, by pointer doubling
    m = len(at)
    nxt = np.append(np.searchsorted(at, close, "right"), m)
    reach = np.zeros(m + 1, bool)
    first = np.ones(m, bool)
    first[1:] = elem[at[1:]] != elem[at[:-1]]
    reach[:m] = first
    for _ in range(max(1, m).bit_length()):
        reach[nxt[reach]] = True
        nxt = nxt[nxt]
    at, close = at[reach[:m]], close[reach[:m]]
    inside[at] += 1
    inside[close + 1] -= 1
    used[at] = used[close] = True
    return np.cumsum(inside[:n]) > 0, used


def pieces(data: np.ndarray, offs: np.ndarray, how: Packing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte behind the last, element) of every value in the elements data[offs[i]:offs[i + 1]], in order."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    blank = _lut(_BLANK)[data]
    sep = _lut(how.delimiters)[data] | (blank if how.blank_separates else False)
    begins = offs[:-1][offs[1:] > offs[:-1]]
    elem = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    kept = np.zeros(n, bool)
    quote = _lut(how.quotes)[data]
    if how.after and quote.any():
        at = np.where(blank, -1, np.arange(n))
        at[begins] = begins  # blanks at the start look no further back
        last = np.maximum.accumulate(at)
        prev = np.empty(n, np.int64)
        prev[0], prev[1:] = -1, last[:-1]
        prev[begins] = -1
        opener = quote & (prev >= 0) & _lut(how.after)[data[prev]]
        kept, used = _protected(data, elem, quote, opener)
        # an unclosed opener is content, every other quote encloses
        sep |= quote & ~used & ~opener
    elif quote.any():
        sep |= quote
    if how.brackets:
        step = ((data == ord("(")).astype(np.int64) - (data == ord(")"))) * ~kept
        if step.any():
            depth = np.cumsum(step)
            before = np.zeros(len(offs), np.int64)
            before[:-1] = np.concatenate([[0], depth])[offs[:-1]]
            depth = depth - before[elem]
            low = np.minimum.accumulate(depth - elem * (2 * n + 2)) + elem * (2 * n + 2)
            kept = kept | (depth - np.minimum(low, 0) > 0)
    sep &= ~kept
    for w in how.words:
        k = len(w)
        if n < k:
            continue
        low = data | 0x20
        hit = np.ones(n - k + 1, bool)
        for i, b in enumerate(w):
            hit &= low[i : n - k + 1 + i] == b
        at = np.flatnonzero(hit)
        at = at[(elem[at] == elem[at + k - 1]) & ~kept[at]]
        edge = sep | blank
        left = np.isin(at, begins) | edge[np.maximum(at - 1, 0)]
        ends = at + k
        right = (ends >= n) | edge[np.minimum(ends, n - 1)] | (elem[np.minimum(ends, n - 1)] != elem[at])
        at = at[left & right]
        for i in range(k):
            sep[at + i] = True
    # a piece: from its first to its last byte that is neither separator nor an outer blank
    solid = ~sep & ~(blank & ~kept)
    pos = np.flatnonzero(solid)
    if not len(pos):
        return none, none, none
    cuts = np.cumsum(sep)
    cut = np.ones(len(pos), bool)
    cut[1:] = (cuts[pos[1:]] != cuts[pos[:-1]]) | (elem[pos[1:]] != elem[pos[:-1]])
    first = np.flatnonzero(cut)
    starts = pos[first]
    ends = pos[np.append(first[1:], len(pos)) - 1] + 1
    keep = np.ones(len(starts), bool)
    for d in how.drop:
        same = ends - starts == len(d)
        for i, b in enumerate(d):
            same &= data[np.minimum(starts + i, n - 1)] == b
        keep &= ~same
    starts, ends = starts[keep], ends[keep]
    return starts, ends, elem[starts]


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    offs = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    idx = np.repeat(starts - offs[:-1], size) + np.arange(offs[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data[idx]))).cast(pa.string())


def elements(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, row of each element) of a string or list<string> array; null rows and elements are left out."""
    if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
        rows = pc.list_parent_indices(col).to_numpy(zero_copy_only=False)
        flat = pc.list_flatten(col)
    else:
        rows, flat = np.arange(len(col)), col
    ok = flat.is_valid().to_numpy(zero_copy_only=False)
    if not ok.all():
        flat, rows = flat.drop_null(), rows[ok]
    flat = flat.cast(pa.large_string())
    if not len(flat):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), rows
    offs = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    buf = flat.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[offs[0] : offs[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0], rows


def unpack(col: pa.Array, how: Packing) -> pa.ListArray:
    """The list of values of each row."""
    data, offs, rows = elements(col)
    starts, ends, elem = pieces(data, offs, how)
    per = np.bincount(rows[elem], minlength=len(col)) if len(elem) else np.zeros(len(col), np.int64)
    at = np.zeros(len(col) + 1, np.int32)
    np.cumsum(per, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), _gather(data, starts, ends))


def flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(values, position from 1, parent's ordinal)."""
    parent = pc.list_parent_indices(lists)
    at = lists.offsets.to_numpy()
    pos = np.arange(at[0], at[-1]) - at[:-1][parent.to_numpy()] + 1
    return lists.flatten(), pos, parent


def split_packed(df: DataFrame, row_id: str, value: str, how: Packing) -> DataFrame:
    """(row_id, pos, val): every value of df[value] (string or array of strings), numbered from 1 within its row."""
    src = df.select(F.col(row_id).alias("row_id"), F.col(value).alias("v"))
    out = T.StructType([src.schema["row_id"], T.StructField("pos", T.LongType()), T.StructField("val", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            val, pos, parent = flat(unpack(b.column(1), how))
            if len(val):
                yield pa.RecordBatch.from_arrays([b.column(0).take(parent), pa.array(pos, pa.int64()), val], names=out.names)

    return src.where(F.col("v").isNotNull()).mapInArrow(run, out)


def once(df: DataFrame, row_id: str, *cols: str) -> DataFrame:
    """(row_id, cols): one row per id; redelivered rows are equal in these columns. Ids spread evenly, so does the shuffle."""
    return df.where(F.col(row_id).isNotNull()).select(row_id, *cols).dropDuplicates([row_id])
