"""Encoding of whole texts by a public tokenizer, and back.

Method: monoid tree reduction. A long text is halved again and again; leaves are encoded, neighbours are joined by encoding a
window around their border anew. The window grows on either side until it ends at a *certain boundary*: a place where the
tokenizer's pattern splits whatever stands around it (text before white space, letters before digits or punctuation, ...).
Tokens left and right of such a window can't change, so the joined ids are those of the whole text. Decoding concatenates
up the tree. Leaves use the same property: they are cut at certain boundaries into short pieces, whose ids are remembered.

Defined cases: null and empty texts give an empty list; texts are taken as they are (no normalising, strings of special
tokens are ordinary text); equal texts give equal ids; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public tokenizers' files lie on every machine.
TOKENIZERS = "/opt/tokenizers"
#: Characters of a leaf; first size of a border window; pieces that are remembered, and how long they may be.
LEAF, WINDOW, PIECES, PIECE = 1 << 10, 64, 300_000, 40

# Fixed value: the pre-tokenizing pattern that belongs to the byte-level vocabularies.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPACE = " \t\n\r\x0b\x0c"
_PIECES = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: White space besides the ASCII one, which the pieces don't cut at.
_OTHER_SPACE = re.compile("[\x85\xa0  -     　]")
_PUNCT = r"!-/:-@\[-`{-~"
_CERTAIN = re.compile(rf"(?<=\S)[{_SPACE}]|(?<=[A-Za-z])[0-9{_PUNCT}]|(?<=[0-9])[A-Za-z{_PUNCT}]")


class _Remembered(dict):
    """Ids (as bytes of int32) of pieces, computed when first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.asarray(self.encode(piece), np.int32).tobytes()
        if len(piece) <= PIECE:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


class ByteBPE:
    """A byte-level BPE vocabulary given as ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {i: b for b, i in ranks.items()}
        self.size = np.zeros(max(self.bytes) + 1, np.int64)
        for i, b in self.bytes.items():
            self.size[i] = len(b)
        # named by its file: tiktoken may keep encodings by name
        self.direct = tiktoken.Encoding(path, pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known = _Remembered(self.direct)

    def leaf(self, text: str) -> np.ndarray:
        if not text.isascii() and _OTHER_SPACE.search(text):
            return np.asarray(self.direct(text), np.int32)
        return np.frombuffer(b"".join(map(self.known.__getitem__, _PIECES.findall(text))), np.int32)

    def encode(self, text: str) -> np.ndarray:
        return self.leaf(text) if len(text) <= LEAF else self._tree(text, 0, len(text))

    def _tree(self, text: str, a: int, b: int) -> np.ndarray:
        if b - a <= LEAF:
            return self.leaf(text[a:b])
        m = (a + b) // 2
        return self._join(text, a, m, b, self._tree(text, a, m), self._tree(text, m, b))

    def _join(self, text: str, a: int, m: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        x, w = None, WINDOW
        while x is None:
            low = max(a, m - w)
            found = next(_CERTAIN.finditer(text, low, m), None)
            x = found.start() if found and found.start() > low else a if low == a else None
            w *= 2
        y, w = None, WINDOW
        while y is None:
            high = min(b, m + w)
            found = None
            for found in _CERTAIN.finditer(text, m + 1, high):
                pass
            y = found.start() if found else b if high == b else None
            w *= 2
        return np.concatenate([self._cut(left, text[x:m], False), self.leaf(text[x:y]), self._cut(right, text[m:y], True)])

    def _cut(self, ids: np.ndarray, text: str, front: bool) -> np.ndarray:
        """ids without those of text at their front or end."""
        size, n = len(text.encode()), 256
        while True:
            part = self.size[ids[:n] if front else ids[::-1][:n]]
            k = int(np.searchsorted(np.cumsum(part), size, "left")) + 1 if size else 0
            if k <= len(part):
                return ids[k:] if front else ids[: len(ids) - k]
            n *= 4

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()


class Whole:
    """A tokenizer whose splits depend on more than a window (it normalises the text or merges across words): whole texts only."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            self.direct = sentencepiece.SentencePieceProcessor(model_file=path).encode
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            self.direct = lambda s: t.encode(s, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.direct(text), np.int32)


# The tokenizers' files.
FILES = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken", "word_bpe_49k": "word_bpe_49k.json", "piece_bpe_32k": "piece_bpe_32k.model"}
_loaded: dict[str, ByteBPE | Whole] = {}


def tokenizer(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> ByteBPE | Whole:
    """The tokenizer, loaded once per process."""
    path = f"{folder}/{FILES[name]}"
    if path not in _loaded:
        _loaded[path] = (ByteBPE if path.endswith(".tiktoken") else Whole)(path)
    return _loaded[path]


def encode(df: DataFrame, row_id: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(row_id, ids): the token ids of each text."""
    src = df.select(F.col(row_id), F.col(text).alias("t"))
    out = T.StructType([T.StructField(row_id, src.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        none = np.zeros(0, np.int32)
        for b in batches:
            ids = [t.encode(x) if x else none for x in b.column(1).to_pylist()]
            offs = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offs[1:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([none, *ids])))], names=out.names)

    return src.mapInArrow(run, out)


def lengths(df: DataFrame, row_id: str, text: str, keep: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(row_id, keep, n_tokens): the number of tokens of each text."""
    src = df.select(F.col(row_id), *keep, F.col(text).alias("t"))
    out = T.StructType([*src.schema.fields[:-1], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        for b in batches:
            n = [len(t.encode(x)) if x else 0 for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=out.names)

    return src.mapInArrow(run, out)


def decode(df: DataFrame, row_id: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(row_id, text): the texts of the ids of a byte-level vocabulary; an empty list gives an empty text."""
    src = df.select(row_id, "ids")
    out = T.StructType([src.schema[0], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(name, folder)
        for b in batches:
            lists = b.column(1)
            flat, offs = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(flat[i:j]) for i, j in zip(offs, offs[1:])], pa.string())], names=out.names)

    return src.mapInArrow(run, out)
