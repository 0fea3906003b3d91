"""The operators for training-data pipelines against brute force, exact round trips and held-out labels, and their defined cases."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations, groupby, product
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from condnet.llm import mixing, subjects, tokens
from condnet.llm.runs import as_number, event_runs, packed_runs
from condnet.llm.topn import bounds, nearest, top_n, within
from condnet.operators.packed import PATH


def rows(df):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=str)


# best N of every group


def test_top_n(spark, monkeypatch):
    rnd = random.Random(3)
    data = [(i % 900, rnd.choice(["hot"] * 5 + ["a", "b", None, "c"]), rnd.choice([None, 1, 2, 2, 3]), rnd.choice([0, 1])) for i in range(1200)]
    data = [*{d[0]: d for d in data}.values()]
    data += data[:150] + [(None, "a", 0, 0), (5000, "one", 7, None)]
    df = spark.createDataFrame(data, "rank long, g string, s0 int, score int").repartition(4)
    monkeypatch.setattr("condnet.llm.topn.BUFFER", 50)
    for n in (1, 3, 1000):
        groups = defaultdict(set)
        for i, g, a, b in data:
            if g is not None and i is not None:
                groups[g].add((9**20 if a is None else a, 9**20 if b is None else b, i))
        want = [(g, i, r) for g, v in groups.items() for r, (_, _, i) in enumerate(sorted(v)[:n], 1)]
        got = top_n(df, F.col("g"), [F.col("s0"), F.col("score")], F.col("rank"), n)
        assert rows(got.select("g", "i", "rank")) == sorted(want, key=str)
    assert top_n(df.limit(0), F.col("g"), [F.col("s0")], F.col("rank"), 3).count() == 0


# runs


def test_packed_runs(spark):
    data = [(1, "1 AS1 as01 2 2 1"), (2, "0.7,7;7 8"), (3, None), (4, ""), (5, "x X 1.1 65537"), (6, "5"), (7, "{3, 3} 3"), (8, "_")]
    df = spark.createDataFrame(data, "first_pos long, run_len string")
    got = rows(packed_runs(df, "first_pos", "run_len", PATH, as_number))
    assert got == sorted([(1, 1, 3), (1, 4, 2), (2, 1, 3), (5, 1, 2), (5, 3, 2), (7, 1, 3)], key=str)
    assert rows(packed_runs(df.limit(0), "first_pos", "run_len", PATH, as_number)) == []
    long = spark.createDataFrame([(1, " ".join(["7"] * 100_000 + ["8"] * 50_000))], "id long, p string")
    assert rows(packed_runs(long, "id", "p", PATH, as_number)) == [(1, 1, 100_000), (1, 100_001, 50_000)]


@pytest.mark.parametrize("chunks", [1, 3, 9])
def test_event_runs(spark, chunks):
    rnd = random.Random(chunks)
    data = [(rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.choice([None, *range(60)]), i, rnd.choice(["a", "a", "a", "b", None])) for i in range(400)]
    data += [(4, t, 1000 + t, "z") for t in range(120)] + data[:20]
    df = spark.createDataFrame(data, "e int, seq int, chunk int, n string")
    want = []
    seen = sorted({d[:3]: d for d in data if d[0] is not None and d[1] is not None}.values(), key=lambda d: d[:3])
    for (e, v), g in groupby(seen, key=lambda d: (d[0], d[3])):
        g = list(g)
        want.append((e, v, g[0][1], g[-1][1], len(g)))
    assert rows(event_runs(df, "e", "seq", "n", "chunk", chunks)) == sorted(want, key=str)


def test_near_identical_events(spark):
    data = [(1, 1, 1, "Ping"), (1, 2, 2, "ping "), (1, 3, 3, "PING"), (1, 4, 4, "pong"), (1, 5, 5, None), (1, 6, 6, None), (2, 1, 7, "ping")]
    df = spark.createDataFrame(data, "e int, t int, id int, v string")
    for chunks in (1, 4):
        got = rows(event_runs(df, "e", "t", "v", "id", chunks, same=lambda c: F.lower(F.trim(c))))
        assert got == sorted([(1, "Ping", 1, 3, 3), (1, "pong", 4, 4, 1), (1, None, 5, 6, 2), (2, "ping", 1, 1, 1)], key=str)


def test_bounds_leave_ties_in(spark):
    data = [("hot", 5, i) for i in range(400)] + [("hot", 1, 1000), ("hot", 4, 1001), (None, 4, 2)] + [(None, 1, 1), ("x" * 300, 9, 7), ("b", None, 8)]
    df = spark.createDataFrame(data, "g string, s int, i int").repartition(3)
    args = F.col("g"), [F.col("s")], F.col("i")
    b = bounds(df, *args, 2)
    assert b.where("g = 'hot'").first()["bound"][0] in (4, 5)
    assert within(df.where("g is not null"), *args[:2], b.where("bound.s0 = 5")).count() >= 404
    assert rows(top_n(df, *args, 2).select("g", "i")) == sorted([("hot", 1001), ("hot", 1000), ("x" * 300, 7), ("b", 8)], key=str)
    once = nearest(df.where("s is not null").withColumn("p", F.col("s") % 2), ["g", "p"], ["s"], "i", 1)
    assert 1 <= once.where("g = 'hot' and p = 1").count() <= df.rdd.getNumPartitions()


# tokens


def test_encoding_trees(monkeypatch):
    t = tokens.tokenizer()
    monkeypatch.setattr(tokens, "LEAF", 40)
    monkeypatch.setattr(tokens, "WINDOW", 2)
    rnd = random.Random(2)
    pool = [*"aZ9'st .,\n\té\u3000\xa0к\x1c\r-_", "'s", "  ", "\n\n", "'ll", "<|endoftext|>", "🚀"]
    for _ in range(1500):
        s = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 300)))
        ids = t.encode(s)
        assert ids.tolist() == t.direct(s) and t.decode(ids) == s, s
    for s in ("a" * 3000, "あ" * 2000, " " * 3000, "9" * 2000 + "b" * 2000, "é" * 777 + "x" * 900, "\n \n" * 500):
        assert t.encode(s).tolist() == t.direct(s)


def test_encode_and_decode(spark):
    data = [(1, "def f(x):\n    return x"), (2, None), (3, ""), (4, " \n"), (5, "naïve 🚀 \ufeff"), (6, "word " * 60_000), (1, "def f(x):\n    return x")]
    df = spark.createDataFrame(data, "id long, ids string")
    got = tokens.encode(df, "id", "ids")
    direct = tokens.tokenizer().direct
    assert rows(got) == sorted(((i, tuple(direct(s or ""))) for i, s in data), key=str)
    assert rows(tokens.decode(got, "id")) == sorted(((i, s or "") for i, s in data), key=str)
    assert rows(tokens.lengths(df, "id", "ids", [])) == sorted(((i, len(direct(s or ""))) for i, s in data), key=str)
    assert tokens.encode(df.limit(0), "id", "ids").count() == 0
    for name in tokens.FILES:
        assert len(tokens.tokenizer(name).encode("two words")) > 0


def test_same_ids_as_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for s in ("x  = 1\n\n\tif a:\r\n", "It's <|endoftext|> 1234 \u2028 \u3000z", "\x85a\xa0 b", "don't  \n  stop"):
        assert t.encode(s, add_special_tokens=False).ids == tokens.tokenizer().encode(s).tolist()


# mixing


def test_knapsack():
    rnd = random.Random(0)
    for _ in range(200):
        length = np.array(rnd.sample(range(1, 30), rnd.randint(1, 4)))
        count = np.array([rnd.randint(0, 4) for _ in length])
        budget = rnd.randint(0, 90)
        take = mixing.knapsack(length, count, budget)
        sums = (sum(a * b for a, b in zip(length, x)) for x in product(*(range(k + 1) for k in count)))
        assert (take <= count).all() and (take * length).sum() == max(s for s in sums if s <= budget)


def test_fit_large():
    rng = np.random.default_rng(1)
    length, count = np.arange(1, 3000), rng.integers(0, 40_000, 2999)
    total = int((length * count).sum())
    for part, cap in ((0.43, 2), (1.7, 2), (5.0, 2), (0.0001, 1)):
        whole, extra = mixing.fit(length, count, int(total * part), cap)
        got = whole * total + int((length * extra).sum())
        assert (extra <= count).all() and got == min(int(total * part), cap * total) and whole + (extra > 0).any() <= cap


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 7)
    rnd = random.Random(1)
    names = ["a", " A ", "b", "c", None, "other", "B\t"]
    docs = [(i, rnd.choice(names), rnd.choice(["", None, "x", "x y z", "one two three four five", "w " * 20])) for i in range(400)] + [(900, "d", "")]
    docs += docs[:40]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    listed = spark.createDataFrame([("A", 0.3, 1), ("b", 0.2, 3), ("c", 0.3, 2), ("d", 0.1, 2), ("none", 0.1, 9)], "source string, target_share double, max_repeats int")
    sizes = mixing.counted(df)
    assert sizes.count() == 401
    total = sizes.agg(F.sum("n_tokens")).first()[0]
    mixed = mixing.mix(sizes, listed)
    got = {r.source: r for r in mixing.shares(mixed, sizes, listed).collect()}
    assert set(got) == {"a", "b", "c", "d", "none"} and got["d"].tokens == 0 and got["none"].documents == 0
    have = Counter()
    for r in sizes.collect():
        have[r.source] += r.n_tokens
    for s, share, cap in (("a", 0.3, 1), ("b", 0.2, 3), ("c", 0.3, 2)):
        assert abs(got[s].target_tokens - share * total) <= 0.5 + 1e-9
        want = min(got[s].target_tokens, cap * have[s])
        assert want - 2 <= got[s].tokens <= want and got[s].most_used <= cap and abs(got[s].share_of_all - got[s].tokens / total) < 1e-12
    assert rows(mixed) == rows(mixing.mix(sizes, listed)) and mixed.groupBy("doc_id").count().where("count > 1").count() == 0
    assert rows(mixed) != rows(mixing.mix(sizes, listed, seed=7))
    assert mixing.mix(sizes.limit(0), listed).count() == 0


# subjects

AREAS = {"tea": "leaf kettle infuser steep teapot oolong sencha matcha".split(), "sea": "anchor sail mast harbour keel rudder tide buoy".split(), "sky": "comet nebula orbit quasar meteor eclipse zenith pulsar".split()}
FILLER = "value item list state row total index name".split()


def made(rnd, areas, lines=14):
    out = []
    for k in range(lines):
        ws = AREAS[areas[k % len(areas)]] if areas else FILLER
        out.append(f"    // the {rnd.choice(ws)} comes before {rnd.choice(FILLER)}\n    int {rnd.choice(ws)}{rnd.choice(FILLER).title()} = {rnd.choice(ws)};")
    return "\n".join(out)


def test_subjects_held_out(spark):
    rnd = random.Random(8)
    truth = {}
    docs = []
    for i in range(900):
        areas = rnd.choice([["tea"], ["sea"], ["sky"], ["tea", "sky"], []])
        truth[i] = set(areas)
        docs.append((i, made(rnd, areas)))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "1;2;3"), (1004, made(rnd, ["sea"], 30) + "\n// the comet and the orbit of it\n" + made(rnd, ["sea"], 30))]
    # examples show half of each area's words
    ex = [(i, a, " ".join(f"the {rnd.choice(AREAS[a][:4])} has {rnd.choice(FILLER)}" for _ in range(3))) for i, a in enumerate(["tea", "sea", "sky"] * 12)]
    ex += [(99, "tea", "the mast has value"), (100, None, "x"), (101, "sea", None)]
    examples = spark.createDataFrame(ex, "example_id long, subject string, text string")
    listed = spark.createDataFrame([(a,) for a in AREAS], "subject string")
    got = defaultdict(set)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).repartition(3)
    for r in subjects.areas(df, examples, listed).collect():
        got[r.doc_id].add(r.subject)
    right = sum(got[i] == t for i, t in truth.items())
    assert right >= 0.97 * len(truth)
    assert got[1004] == {"sea"} and not any(got[i] for i in range(1000, 1004))
    rules = subjects.learn(subjects.bags(df, "doc_id", "text"), examples, sorted(AREAS))
    known = {w for ws in AREAS.values() for w in ws}
    assert known <= set(rules.single) and all(sorted(AREAS)[rules.single[w][0]] == a for a, ws in AREAS.items() for w in ws)
    assert subjects.areas(df, examples.limit(0), listed).count() == 0 and subjects.areas(df.limit(0), examples, listed).count() == 0
    assert subjects.areas(df, examples, listed.limit(0)).count() == 0


def test_longer_rules(spark):
    """Words that say nothing alone but a lot together make a rule, of any length; what a part of it already says makes no longer one."""
    data = [(i, 0, "red round sure") for i in range(30)] + [(100 + i, 1, "red flat other") for i in range(30)] + [(200 + i, 2, "blue round third") for i in range(30)]
    df = spark.createDataFrame(data, "example_id long, label long, text string")
    r = subjects.mine(subjects.bags(df, "example_id", "text", ["label"]), 3, None, longer=True)
    assert {w: v[0] for w, v in r.single.items()} == {"sure": 0, "other": 1, "third": 2, "flat": 1, "blue": 2}
    assert {p: v[0] for p, v in r.longer.items()} == {("red", "round"): 0}
    # three words of which any two stand in both classes
    three = [(i, 0, "one two six") for i in range(60)] + [(100 * k + i, 1, t) for k, t in ((1, "one two"), (2, "one six"), (3, "two six"), (4, "none")) for i in range(60)]
    df = spark.createDataFrame(three, "example_id long, label long, text string").repartition(3)
    r = subjects.mine(subjects.bags(df, "example_id", "text", ["label"]), 2, None, longer=True)
    assert {p: v[0] for p, v in r.longer.items()} == {("one", "six", "two"): 0}
    # a few documents prove little
    few = [(i, i % 2, "mild warm" if i % 2 else "mild" if i % 4 else "warm") for i in range(12)]
    df = spark.createDataFrame(few, "example_id long, label long, text string")
    assert not subjects.mine(subjects.bags(df, "example_id", "text", ["label"]), 2, None, longer=True).longer


def test_pattern_trees():
    rnd = random.Random(4)
    docs = [sorted(rnd.sample(range(9), rnd.randint(0, 6))) for _ in range(300)]
    docs += [[0, 1, 2, 3]] * 20
    cls = [rnd.randrange(3) for _ in docs]
    flat = np.array([i for d in docs for i in d])
    one = np.zeros((len(docs), 3), np.int64)
    one[np.arange(len(docs)), cls] = 1
    tree = subjects._Tree(np.repeat(np.arange(len(docs)), [len(d) for d in docs]), flat, one)

    def brute(p):
        return [sum(set(p) <= set(d) and c == k for d, c in zip(docs, cls)) for k in range(3)]

    sets, n = tree.pairs()
    assert {tuple(s): list(c) for s, c in zip(sets.tolist(), n.tolist())} == {p: brute(p) for p in combinations(range(9), 2) if any(brute(p))}
    for size in (2, 3, 4):
        asked = np.array([p for p in combinations(range(10), size) if sum(p) % 3])
        sets, n = tree.grow(asked)
        assert {tuple(s): list(c) for s, c in zip(sets.tolist(), n.tolist())} == {p: brute(p) for p in map(tuple, asked.tolist()) if any(brute(p))}
    none = subjects._Tree(flat[:0], flat[:0], one[:0])
    assert not len(none.pairs()[0]) and not len(none.grow(np.array([[0, 1, 2]]))[0])


def test_evidence():
    """Each word counts by its best rule, the words of a longer rule together as often as the rarest of them."""
    r = subjects.Rules({"a": (0, 0.7), "z": (1, 0.9)}, {("a", "b", "c"): (1, 0.95), ("b", "c"): (0, 0.8)})
    bag = pa.RecordBatch.from_pydict({"words": [["a", "b", "c", "x"], ["b", "c"], ["a", "b", "z"], []], "counts": [[5, 2, 3, 1], [4, 1], [1, 1, 1], []], "first": [[0, 1, 2, 3], [0, 1], [0, 1, 2], []], "last": [[9, 9, 9, 3], [7, 8], [0, 1, 2], []]})
    e, n, _ = subjects._Batch(bag).evidence(r.arrays(2), 2)
    assert np.allclose(n, [[0, 2], [1, 0], [1, 1], [0, 0]])
    assert np.allclose(e, [[0, 2 * 0.9], [0.6, 0], [0.4, 0.8], [0, 0]])
    assert subjects._Batch(bag).evidence(subjects.Rules().arrays(2), 2)[1].sum() == 0


def test_words():
    texts = pa.array(["fooBar HTTPServer x_y foo", "", "12;", "naïve ½x İx"])
    doc, word, n, first, last = subjects.words(texts, subjects._Parts())
    got = {(d, w): tuple(x) for d, w, *x in zip(doc.tolist(), word.to_pylist(), n.tolist(), first.tolist(), last.tolist())}
    assert {w: x[0] for (d, w), x in got.items() if d == 0} == {"foo": 2, "bar": 1, "http": 1, "server": 1, "x": 1, "y": 1} and got[0, "foo"][1:] == (0, 4)
    assert (3, "naïve") in got and not any(d in (1, 2) for d, _ in got)


# the queries


def test_registered_alone():
    from condnet.llm import registry

    assert {"p1_found", "p2_found", "p7_ids", "p8_mix", "p9_found"} <= set(registry.QUERIES) and set(registry.ORACLE) <= set(registry.QUERIES)
    root = Path(__file__).parents[2] / "condnet"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "condnet.llm" in p.read_text()]


def test_digest_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    out = tokens.decode(tokens.encode(df, "doc_id", "text"), "doc_id").select(F.md5("text")).first()[0]
    assert out == hashlib.md5(b"").hexdigest()
