"""Subject areas of documents, by mined class-association rules.

Method: rules {words} -> subject are mined by parallel frequent-pattern growth. Items are counted in parallel over all
documents. Every input split grows its documents' items into pattern trees of its own (of at most `TREE` items each), whose
conditional bases give the partial counts of longer patterns, summed by pattern over all trees: no task ever holds a class's
documents. A rule's confidence is calibrated (smoothed, as if all subjects were equally frequent, and for a longer pattern drawn
to that of its best part as by `PRIOR` more documents, so that a few documents prove little). Patterns grow from any
part that isn't nearly certain (`CERTAIN`) and that, if it has several words, tops its own parts by `IMPROVE`; a longer rule that
doesn't top every part of it by `IMPROVE` is redundant and pruned. So a rule has as many words as improve it, at most 1 / IMPROVE.
The first rules come from the labelled examples, whose words cover the subjects only in part; they label the documents that they
are sure of, and rules are mined anew over examples and all documents, twice. Every document is then scored by the evidence of
the rules that match it, each word through its best rule; the words of a longer rule together count as often as the rarest of them.

Parameters: an item needs `SUPPORT` of the labelled documents and at least 4 of them, so there are at most (mean number of distinct
words of a document) / SUPPORT rule items; a document's subject needs `SHARE` of its evidence and `DENSITY` of its words.

Defined cases: null, blank and word-free texts have no subject; repeated and tied documents are scored each by themselves;
without examples there are no rules and no rows; examples with a null subject or text are left out. Words are runs of
letters, cut at the humps of mixed-case names, in lower case. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from condnet.common import materialize

#: Of rules of one word and of several; smoothing of counts per class; documents for which the best part of a longer pattern speaks.
SUPPORT, CONFIDENCE, LONG_CONFIDENCE, CERTAIN, IMPROVE, SMOOTH, PRIOR = 2e-4, 0.6, 0.8, 0.9, 0.1, 0.1, 10
#: A document labels rules where one subject has this share of at least so many matches.
SURE, MATCHES = 0.9, 5
#: Evidence for a subject: its share, its words of all words, its words at least; what lies within STRETCH names of a longer text is a passing line; a text has so many subjects at most.
SHARE, DENSITY, LEAST, STRETCH, MOST = 0.2, 0.006, 2, 16, 2

#: Bytes of text cut into words at a time; items of one pattern tree; nodes of a conditional base at a time.
SLICE, TREE, ROWS = 4 << 20, 2_000_000, 1 << 16

_NO_NAME = r"[^\p{L}\p{No}\p{Nl}]+"
_HUMPS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^A-Z]+")


class _Parts(dict):
    """Names to their words."""

    def __missing__(self, name: str) -> list[str]:
        got = [name] if name.islower() else [w.lower() for w in _HUMPS.findall(name)]
        if len(self) > 300_000:
            self.clear()
        self[name] = got
        return got


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers first[i] .. first[i] + count[i] - 1."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def words(texts: pa.Array, parts: _Parts) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each text: (text, word, number of occurrences, first and last place among the names of the text), in the order of texts."""
    lists = pc.split_pattern_regex(texts, pattern=_NO_NAME)
    doc, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    some = pc.greater(pc.binary_length(flat), 0)
    doc, names = doc[some.to_numpy(zero_copy_only=False)], flat.filter(some).dictionary_encode()
    own = np.searchsorted(doc, np.arange(len(texts)))  # each text's first name
    place = np.arange(len(doc)) - own[doc]
    cut = [parts[n] for n in names.dictionary.to_pylist()]
    vocabulary = pa.array([w for c in cut for w in c], pa.string()).dictionary_encode()
    width = np.fromiter(map(len, cut), np.int64, len(cut))
    at = np.cumsum(width) - width
    code = names.indices.to_numpy()
    word = vocabulary.indices.to_numpy()[_spread(at[code], width[code])]
    doc, place = np.repeat(doc, width[code]), np.repeat(place, width[code])
    key = doc * np.int64(max(1, len(vocabulary.dictionary))) + word
    order = np.argsort(key, kind="stable")  # places ascend within a word
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(key)) - 1 if len(key) else first
    return doc[order[first]], vocabulary.dictionary.take(pa.array(word[order[first]])), last - first + 1, place[order[first]], place[order[last]]


def bags(df: DataFrame, row_id: str, text: str, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(id, keep, words, counts, first, last, total): the distinct words of each text that has any, with how often and where they stand."""
    src = df.select(F.col(row_id).alias("id"), *keep, F.col(text).alias("t")).where("t is not null")
    out = T.StructType([*src.schema.fields[:-1], T.StructField("words", T.ArrayType(T.StringType())), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("counts", "first", "last")), T.StructField("total", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts()
        for whole in batches:
            size = np.cumsum(pc.binary_length(whole.column(whole.num_columns - 1)).fill_null(0).to_numpy())
            edges = [0, *(np.flatnonzero(np.diff(size // SLICE)) + 1).tolist(), len(whole)]
            for a, z in zip(edges, edges[1:]):
                b = whole.slice(a, z - a)
                doc, word, *facts = words(b.column(b.num_columns - 1), parts)
                some = np.unique(doc)
                offs = pa.array(np.append(np.searchsorted(doc, some), len(doc)).astype(np.int32))
                cols = [c.take(pa.array(some)) for c in b.columns[:-1]]
                cols += [pa.ListArray.from_arrays(offs, word), *(pa.ListArray.from_arrays(offs, pa.array(f.astype(np.int32))) for f in facts)]
                cols.append(pa.array(np.bincount(doc, facts[0], len(b))[some].astype(np.int64)))
                yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return src.mapInArrow(run, out)


@dataclass
class Rules:
    """Rules by their words, in alphabetical order: (class, calibrated confidence)."""

    single: dict[str, tuple[int, float]] = field(default_factory=dict)
    longer: dict[tuple[str, ...], tuple[int, float]] = field(default_factory=dict)

    def arrays(self, classes: int) -> _Arrays:
        names = sorted({*self.single, *(w for ws in self.longer for w in ws)})
        number = {w: i for i, w in enumerate(names)}
        cls, weight = np.full(len(names), -1, np.int64), np.zeros(len(names))
        for w, (c, conf) in self.single.items():
            cls[number[w]], weight[number[w]] = c, _weight(conf, classes)
        rules = sorted(self.longer)
        of = np.full((len(rules), max(map(len, rules), default=0)), -1, np.int64)
        for i, ws in enumerate(rules):
            of[i, : len(ws)] = [number[w] for w in ws]
        got = [self.longer[r] for r in rules]
        return _Arrays(pa.array(names, pa.string()), cls, weight, of, np.array([c for c, _ in got], np.int64), np.array([_weight(f, classes) for _, f in got]))


@dataclass
class _Arrays:
    """Rules as arrays: the words of all rules; class and weight of each as a rule by itself (-1: none); the words of each longer rule (-1: no more); their classes and weights."""

    words: pa.Array
    cls: np.ndarray
    weight: np.ndarray
    longer: np.ndarray
    longer_cls: np.ndarray
    longer_weight: np.ndarray


def _weight(confidence: float, classes: int) -> float:
    """Evidence of a rule: nothing at chance, 1 at certainty."""
    return max(0.0, (confidence - 1 / classes) / (1 - 1 / classes)) if classes > 1 else 1.0


class _Batch:
    """The words of a batch of documents as codes."""

    def __init__(self, b: pa.RecordBatch):
        lists = b.column(b.schema.get_field_index("words"))
        enc = pc.list_flatten(lists).dictionary_encode()
        self.names = enc.dictionary
        self.code = enc.indices.to_numpy()
        self.doc = pc.list_parent_indices(lists).to_numpy()
        self.count, self.first, self.last = (pc.list_flatten(b.column(b.schema.get_field_index(c))).to_numpy() for c in ("counts", "first", "last"))
        self.docs = len(b)

    def evidence(self, r: _Arrays, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document and class: weighted and plain number of word occurrences that match, each by the word's best rule, and the stretch of text they lie in."""
        found = pc.index_in(self.names, value_set=r.words).fill_null(-1).to_numpy()
        w = found[self.code] if len(found) else np.zeros(0, np.int64)
        cls, wt = np.append(r.cls, -1), np.append(r.weight, 0.0)  # at -1: no rule
        kind, weight, count = cls[w], wt[w], self.count
        at, rule, n = self._longer(r, w)
        if len(at):
            # a word's best longer rule counts if it beats the word by itself
            order = np.lexsort((-rule, r.longer_weight[rule], at))
            at, rule, n = at[order], rule[order], n[order]
            best = np.append(at[1:] != at[:-1], True)
            at, rule, n = at[best], rule[best], n[best]
            best = r.longer_weight[rule] > weight[at]
            at, rule, n = at[best], rule[best], n[best]
            count = count.astype(np.float64)
            # the words of a rule together are one piece of evidence
            kind[at], weight[at], count[at] = r.longer_cls[rule], r.longer_weight[rule], n / (r.longer[rule] >= 0).sum(1)
        ok = kind >= 0
        cell = self.doc[ok] * classes + kind[ok]
        size = self.docs * classes
        shape = (self.docs, classes)
        low, high = np.full(size, np.iinfo(np.int64).max), np.full(size, -1, np.int64)
        np.minimum.at(low, cell, self.first[ok])
        np.maximum.at(high, cell, self.last[ok])
        stretch = np.where(high >= 0, high - np.minimum(low, high), 0)
        return np.bincount(cell, count[ok] * weight[ok], size).reshape(shape), np.bincount(cell, count[ok], size).reshape(shape), stretch.reshape(shape)

    def _longer(self, r: _Arrays, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of a word, longer rule, occurrences): where all words of a rule stand in a document; occurrences are those of its rarest word there."""
        none = np.zeros(0, np.int64)
        used = np.zeros(len(r.words) + 1, bool)
        used[r.longer[r.longer >= 0]] = True
        at = np.flatnonzero(used[w]) if len(r.longer) else none
        if not len(at):
            return none, none, none
        here, size = w[at], np.int64(len(r.words))
        often = np.append(np.bincount(here, minlength=size), len(w) + 1)
        first = r.longer[np.arange(len(r.longer)), often[r.longer].argmin(1)]  # each rule's rarest word of the batch
        by_word = at[np.argsort(here, kind="stable")]
        start = np.cumsum(often[:-1]) - often[:-1]
        rule = np.repeat(np.arange(len(first)), often[first])
        doc = self.doc[by_word[_spread(start[first], often[first])]]
        key = self.doc[at] * size + here
        order = np.argsort(key)
        key = key[order]
        places = []
        for j in range(r.longer.shape[1]):
            word = r.longer[rule, j]
            k = np.minimum(np.searchsorted(key, doc * size + word), len(key) - 1)
            there = (word < 0) | (key[k] == doc * size + word)
            places.append(np.where(word < 0, -1, at[order[k]]))
            rule, doc, places = rule[there], doc[there], [p[there] for p in places]
        n = np.min([np.where(p < 0, np.iinfo(np.int64).max, self.count[p]) for p in places], axis=0)
        ok = [p >= 0 for p in places]
        return np.concatenate([p[o] for p, o in zip(places, ok)]), np.concatenate([rule[o] for o in ok]), np.concatenate([n[o] for o in ok])

    def sure(self, rules: _Arrays, classes: int) -> np.ndarray:
        """The class of each document that the rules are sure of, else -1."""
        e, n, _ = self.evidence(rules, classes)
        best = e.argmax(1)
        rows = np.arange(self.docs)
        return np.where((n[rows, best] >= MATCHES) & (e[rows, best] >= SURE * e.sum(1)), best, -1)


class _Tree:
    """A pattern tree: documents' items, most frequent first, share their prefixes; each node has the documents of each class that pass it."""

    def __init__(self, doc: np.ndarray, item: np.ndarray, tally: np.ndarray):
        """item: ascending within a document, documents in order; tally: documents by classes."""
        n, wide = len(tally), np.int64(item.max() + 1) if len(item) else 1
        length = np.bincount(doc, minlength=n)
        start = np.cumsum(length) - length
        at, parent, items, levels, total = np.zeros(n, np.int64), [np.array([-1])], [np.array([-1])], [], 1
        for k in range(length.max() if n else 0):
            alive = np.flatnonzero(length > k)
            key, to = np.unique(at[alive] * wide + item[start[alive] + k], return_inverse=True)
            parent.append(key // wide)
            items.append(key % wide)
            at[alive] = total + to
            levels.append((total, total + len(key)))
            total += len(key)
        self.parent, self.item = np.concatenate(parent), np.concatenate(items)
        self.tally = np.zeros((total, tally.shape[1]), np.int64)
        np.add.at(self.tally, at, tally)
        for a, z in reversed(levels):
            np.add.at(self.tally, self.parent[a:z], self.tally[a:z])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of items, documents by class): every two items that stand on one branch."""
        classes = self.tally.shape[1]
        node, cls = np.nonzero(self.tally[1:])
        node += 1
        wide = self.item.max() + 1
        keys, counts, up = [], [], self.parent[node]
        while len(node):
            go = up > 0
            node, cls, up = node[go], cls[go], up[go]
            key, to = np.unique((self.item[up] * wide + self.item[node]) * classes + cls, return_inverse=True)
            keys.append(key)
            counts.append(np.bincount(to, self.tally[node, cls], len(key)))
            up = self.parent[up]
        if not keys:
            return np.zeros((0, 2), np.int64), np.zeros((0, classes), np.int64)
        key, to = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(to, np.concatenate(counts), len(key)).astype(np.int64)
        pair, to = np.unique(key // classes, return_inverse=True)
        out = np.zeros((len(pair), classes), np.int64)
        out[to, key % classes] = n
        return np.stack([pair // wide, pair % wide], 1), out

    def grow(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(those of the patterns that occur, documents by class), counted in the conditional base of each pattern's last item. patterns: rows of as many items, ascending."""
        sets, counts = [], []
        for item in np.intersect1d(patterns[:, -1], self.item):
            mine = patterns[patterns[:, -1] == item]
            kept = np.unique(mine[:, :-1])
            column = np.full(int(max(kept[-1], self.item.max())) + 1, -1)
            column[kept] = np.arange(len(kept))
            mine = mine[np.lexsort(mine.T[::-1])]
            total = np.zeros((len(mine), self.tally.shape[1]), np.int64)
            nodes = np.flatnonzero(self.item == item)
            for at in range(0, len(nodes), ROWS):
                node = nodes[at : at + ROWS]
                base = np.zeros((len(kept), len(node)), bool)  # which of the other items stand above each node
                up, k = self.parent[node], np.arange(len(node))
                while len(k):
                    go = up > 0
                    up, k = up[go], k[go]
                    c = column[self.item[up]]
                    base[c[c >= 0], k[c >= 0]] = True
                    up = self.parent[up]
                tally, last, here = self.tally[node], None, None
                for i, p in enumerate(column[mine[:, :-1]]):
                    if last is None or (p[:-1] != last).any():  # neighbours share all but one
                        last, here = p[:-1], np.flatnonzero(np.logical_and.reduce(base[p[:-1]]))
                    total[i] += tally[here[base[p[-1]][here]]].sum(0)
            some = total.any(1)
            sets.append(mine[some])
            counts.append(total[some])
        return (np.concatenate(sets), np.concatenate(counts)) if sets else (patterns[:0], self.tally[:0])


def _confidence(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Calibrated confidence per class of patterns with these counts per class."""
    rate = (counts + SMOOTH) / np.maximum(sizes, 1)
    rate[:, sizes == 0] = 0
    return rate / rate.sum(1, keepdims=True)


def mine(bagged: DataFrame, classes: int, rules: Rules | None, longer: bool, least: int = 4) -> Rules:
    """Rules from bags with a label, and (with rules) from those without that the rules are sure of."""
    spark = bagged.sparkSession
    sent = spark.sparkContext.broadcast(rules.arrays(classes) if rules else None)
    at = bagged.schema.names.index("label")

    def labels(b: pa.RecordBatch, x: _Batch) -> np.ndarray:
        given = b.column(at)
        own = given.fill_null(-1).to_numpy()
        if sent.value is None or not given.null_count:
            return own
        return np.where(given.is_valid().to_numpy(zero_copy_only=False), own, x.sure(sent.value, classes))

    cols = [f"c{i}" for i in range(classes)]
    counted = T.StructType([T.StructField("w", T.StringType()), *(T.StructField(c, T.LongType()) for c in cols)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Batch(b)
            y = labels(b, x)
            ok = y[x.doc] >= 0
            n = np.bincount(x.code[ok] * classes + y[x.doc[ok]], minlength=len(x.names) * classes).reshape(-1, classes)
            some = n.any(1)
            n = np.vstack([n[some], np.bincount(y[y >= 0], minlength=classes)])
            names = pa.concat_arrays([x.names.filter(pa.array(some)), pa.array([""], x.names.type)])  # no word: sizes of the classes
            yield pa.RecordBatch.from_arrays([names, *(pa.array(c, pa.int64()) for c in n.T)], names=counted.names)

    items = bagged.mapInArrow(count, counted).groupBy("w").agg(*(F.sum(c).alias(c) for c in cols))
    items = materialize(items, "items")
    head = items.where("w = ''").collect()
    if not head or not any(head[0][c] for c in cols):
        return Rules()
    sizes = np.array([head[0][c] for c in cols], np.int64)
    support = max(least, int(np.ceil(SUPPORT * sizes.sum())))
    frequent = F.greatest(*cols) >= support if classes > 1 else F.col(cols[0]) >= support
    # at most (mean distinct words of a document) / SUPPORT items
    got = items.where(frequent).where("w <> ''").toPandas()
    names = got["w"].tolist()
    counts = got[cols].to_numpy(np.int64).reshape(-1, classes)
    conf = _confidence(counts, sizes)
    best = conf.argmax(1) if len(conf) else np.zeros(0, np.int64)
    out = Rules()
    growing: dict[str, int] = {}
    for i, w in enumerate(names):
        c = conf[i, best[i]]
        if c >= CONFIDENCE and counts[i, best[i]] >= support:
            out.single[w] = (int(best[i]), float(c))
        if 1.9 / (classes + 1) <= c < CERTAIN:  # tells something, but not all
            growing[w] = i
    if not longer or len(growing) < 2:
        return out
    words_ = sorted(growing, key=lambda w: (-counts[growing[w]].sum(), w))  # rank to word, most frequent first
    # confidences per class of the patterns known so far, by their items' ranks
    known: dict[tuple[int, ...], np.ndarray] = {(k,): conf[growing[w]] for k, w in enumerate(words_)}
    order = spark.sparkContext.broadcast(pa.array(words_, pa.string()))
    kept = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("items", T.ArrayType(T.IntegerType()))])

    def transactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _Batch(b)
            y = labels(b, x)
            rank = pc.index_in(x.names, value_set=order.value).fill_null(-1).to_numpy()
            r = rank[x.code] if len(rank) else np.zeros(0, np.int64)
            ok = (r >= 0) & (y[x.doc] >= 0)
            r, doc = r[ok], x.doc[ok]
            o = np.lexsort((r, doc))
            doc, first = np.unique(doc[o], return_index=True)
            offs = np.append(first, len(r)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(y[doc], pa.int32()), pa.ListArray.from_arrays(pa.array(offs), pa.array(r[o].astype(np.int32)))], names=kept.names)

    rows = materialize(bagged.mapInArrow(transactions, kept).where(F.size("items") > 1), "transactions")
    grown = T.StructType([T.StructField("items", T.ArrayType(T.IntegerType())), *(T.StructField(c, T.LongType()) for c in cols)])

    def level(wanted: np.ndarray | None) -> dict[tuple[int, ...], np.ndarray]:
        """The frequent ones of the wanted patterns, or of all pairs, with their documents by class."""
        asked = spark.sparkContext.broadcast(wanted)

        def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[_Tree]:
            got, size = [], 0
            for b in chain(batches, [None]):
                if b is not None and len(b):
                    got.append(b)
                    size += len(pc.list_flatten(b.column(1)))
                if got and (b is None or size >= TREE):
                    t = pa.Table.from_batches(got).combine_chunks()
                    lists = t.column(1).combine_chunks()
                    one = np.zeros((len(t), classes), np.int64)
                    one[np.arange(len(t)), t.column(0).to_numpy()] = 1
                    yield _Tree(pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy().astype(np.int64), one)
                    got, size = [], 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for tree in trees(batches):
                sets, n = tree.pairs() if asked.value is None else tree.grow(asked.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * sets.shape[1]), pa.array(sets.ravel().astype(np.int32)))
                if len(lists):
                    yield pa.RecordBatch.from_arrays([lists, *(pa.array(np.ascontiguousarray(c)) for c in n.T)], names=grown.names)

        total = rows.mapInArrow(run, grown).groupBy("items").agg(*(F.sum(c).alias(c) for c in cols))
        # patterns with support: at most (patterns of a document) / SUPPORT
        got = total.where(frequent).toPandas()
        return dict(zip(map(tuple, got["items"]), got[cols].to_numpy(np.int64)))

    found = level(None)
    pairs = set(found)
    while found:
        sets = list(found)
        n = np.array([found[p] for p in sets]).reshape(-1, classes)
        c = _confidence(n, sizes)
        known |= dict(zip(sets, c))
        grows = []
        for i, p in enumerate(sets):
            k = int(c[i].argmax())
            parts = [known.get(q) for q in (p[:j] + p[j + 1 :] for j in range(len(p)))]
            base = max(float(q[k]) for q in parts if q is not None)
            docs = int(n[i].sum())
            sure = (docs * float(c[i, k]) + PRIOR * base) / (docs + PRIOR)
            if sure < base + IMPROVE:
                continue
            if sure >= LONG_CONFIDENCE and n[i, k] >= support:
                out.longer[tuple(sorted(words_[j] for j in p))] = (k, sure)
            if sure < CERTAIN:
                grows.append(p)
        # what grows takes any item that is frequent with each of its own
        more = {tuple(sorted((*p, j))) for p in grows for j in range(len(words_)) if j not in p and all(tuple(sorted((i, j))) in pairs for i in p)}
        found = level(np.array(sorted(more), np.int64)) if more else {}
    return out


def learn(bagged: DataFrame, examples: DataFrame, subjects: list[str], rounds: int = 2) -> Rules:
    """Rules from the examples (subject, text), then from the examples and all bags together."""
    at = F.create_map(*(x for i, s in enumerate(subjects) for x in (F.lit(s), F.lit(i)))) if subjects else F.lit(None)
    labelled = bags(examples.where("subject is not null").withColumn("label", at[F.col("subject")].cast("long")).where("label is not null"), "example_id", "text", ["label"])
    labelled = materialize(labelled, "examples")
    rules = mine(labelled, len(subjects), None, longer=True, least=3)
    cols = ["words", "counts", "first", "last"]
    both = bagged.select(F.lit(None).cast("long").alias("label"), *cols).unionByName(labelled.select("label", *cols))
    for k in range(rounds):
        if not rules.single:
            break
        rules = mine(both, len(subjects), rules, longer=k == rounds - 1)
    return rules


def areas(docs: DataFrame, examples: DataFrame, listed: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, subject, share): the subjects of each document, with their share of its evidence."""
    subjects = sorted(r[0] for r in listed.select("subject").where("subject is not null").distinct().collect())  # the list of areas, fixed
    src = docs.select(row_id, text)
    out = T.StructType([T.StructField(row_id, src.schema[row_id].dataType), T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType())])
    if not subjects:
        return docs.sparkSession.createDataFrame([], out)
    bagged = materialize(bags(src, row_id, text), "bags")
    rules = docs.sparkSession.sparkContext.broadcast(learn(bagged, examples, subjects).arrays(len(subjects)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            e, n, stretch = _Batch(b).evidence(rules.value, len(subjects))
            share = e / np.maximum(e.sum(1, keepdims=True), 1e-12)
            total = b.column(b.schema.get_field_index("total")).to_numpy()[:, None]
            passing = (stretch < STRETCH) & (stretch.max(1, keepdims=True) >= STRETCH)
            place = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
            d, s = np.nonzero((place < MOST) & (share >= SHARE) & (n >= LEAST) & (n >= DENSITY * total) & ~passing)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array(subjects).take(pa.array(s)), pa.array(share[d, s])], names=out.names)

    return bagged.mapInArrow(run, out)
