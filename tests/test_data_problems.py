"""The core operators for data problems against brute force, and their defined cases."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from condnet.operators.evenagg import heavy_keys, per_key
from condnet.operators.hierarchy import hierarchy
from condnet.operators.packed import CONDITION, PATH, once, split_packed
from condnet.operators.references import orphans, parents


def rows(df):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=str)


# packed values


def test_split_paths(spark):
    data = [(1, "1 AS2,{3;4}->5|6"), (2, None), (3, ""), (4, "_"), (5, "'7, 8'\t\"9\""), (6, " ;,, "), (7, "65.1/_/x"), (8, "é7 8"), (1, "1 AS2,{3;4}->5|6")]
    df = spark.createDataFrame(data, "row_id int, pos string").withColumnRenamed("row_id", "val")  # clashing names
    got = rows(split_packed(once(df, "val", "pos"), "val", "pos", PATH))
    want = [(1, i, v) for i, v in enumerate(["1", "AS2", "3", "4", "5", "6"], 1)] + [(5, 1, "7"), (5, 2, "8"), (5, 3, "9"), (7, 1, "65.1"), (7, 2, "x"), (8, 1, "é7"), (8, 2, "8")]
    assert got == sorted(want, key=str)
    assert rows(split_packed(df.limit(0), "val", "pos", PATH)) == []


def test_split_conditions(spark):
    data = [
        (1, ["x == 'a, b' and y != 2", None, " ", '"l(x) <= 3;;z == 4"']),
        (2, None),
        (3, []),
        (4, ['Or(a == 1, b != "2; 3") AND c == 5 6 | d < 7']),
        (5, ['{"p == 1","Or(q == 2, q == 3)"}', "'r == 4', s == nopath"]),
        (6, ["xand == 1\nband != 2 && t == \"u and v | w\""]),
        (7, ['k == "open, m == 1']),
        (8, ["Or(a == 1, b == 2 , c == 3"]),
    ]
    df = spark.createDataFrame(data, "id long, c array<string>")
    got = defaultdict(list)
    for i, _, v in sorted(rows(split_packed(df, "id", "c", CONDITION)), key=lambda r: r[:2]):
        got[i].append(v)
    assert got[1] == ["x == 'a, b'", "y != 2", "l(x) <= 3", "z == 4"]
    assert got[4] == ['Or(a == 1, b != "2; 3")', "c == 5 6", "d < 7"]
    assert got[5] == ["p == 1", "Or(q == 2, q == 3)", "r == 4", "s == nopath"]
    assert got[6] == ["xand == 1", "band != 2", 't == "u and v | w"']
    assert got[7] == ['k == "open', "m == 1"] and got[8] == ["Or(a == 1, b == 2 , c == 3"] and set(got) == {1, 4, 5, 6, 7, 8}


def test_split_long(spark):
    text = ",".join(map(str, range(200_000)))
    df = spark.createDataFrame([(1, text)], "id long, v string")
    r = split_packed(df, "id", "v", PATH).agg(F.count("*"), F.max("pos"), F.sum(F.col("val").cast("long"))).first()
    assert tuple(r) == (200_000, 200_000, sum(range(200_000)))
    quoted = spark.createDataFrame([(1, [" and ".join(f"x == 'a, {i}'" for i in range(20_000))])], "id long, v array<string>")
    assert split_packed(quoted, "id", "v", CONDITION).count() == 20_000


# results per key


def test_per_key(spark):
    rnd = random.Random(5)
    data = [(i, rnd.choice(["hot"] * 6 + ["a", "b", None, "", "C"]), rnd.choice([None, -3, 0, 7, 2**40])) for i in range(3000)]
    data += data[:200]
    df = spark.createDataFrame(data, "n long, k string, sum long").repartition(5)
    got = {r[0]: tuple(r[1:]) for r in per_key(df, "k", {"s": ("sum", "sum"), "lo": ("sum", "min"), "hi": ("sum", "max")}, row_id="n").collect()}
    want = defaultdict(list)
    for _, k, v in {r[0]: r for r in data}.values():
        want[k].append(v)
    assert set(got) == set(want)
    for k, vs in want.items():
        known = [v for v in vs if v is not None]
        assert got[k] == (len(vs), sum(known), min(known), max(known))
    heavy = rows(heavy_keys(df, "k", "n", percent=20))
    assert [h[0] for h in heavy] == ["hot"] and heavy[0][2] == 3000
    assert rows(per_key(df.limit(0), "k")) == [] and rows(heavy_keys(df.limit(0), "k")) == []
    assert rows(per_key(df.where("k is null"), "k"))[0][0] is None


# hierarchies


def brute(links):
    links = set(links)
    nodes = {x for e in links for x in e}
    adj = {x: [b for a, b in links if a == x] for x in nodes}

    def reach(s):
        seen, todo = set(), list(adj[s])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += adj[x]
        return seen

    best = {}
    for r in sorted(x for x in nodes if not any(b == x for _, b in links)):
        d, q = {r: 0}, [r]
        for x in q:
            for y in adj[x]:
                if y not in d:
                    d[y] = d[x] + 1
                    q.append(y)
        for x in d:
            best[x] = min(best.get(x, (10**9, 0)), (d[x], r))
    return {x: (-1, -1, True) if x in reach(x) else (*best[x][::-1], False) if x in best else (None, None, False) for x in nodes}


@pytest.mark.parametrize("local", [10**6, 8, 0])
def test_hierarchy(spark, local):
    rnd = random.Random(4 + local)
    data = []
    for g in range(1, 9 if local else 5):
        n = rnd.randint(2, 9)
        data += [(g, rnd.randint(1, n), rnd.randint(1, n), rnd.choice([None, rnd.randint(1, n)])) for _ in range(rnd.randint(1, 9))]
    data += data[:3] + [(None, 1, 2, 3), (99, None, 5, None), (98, 1, 1, None)]
    df = spark.createDataFrame(data, "grp int, root int, node int, path int")
    links = defaultdict(set)
    for g, a, b, c in data:
        if g is not None:
            links[g] |= {e for e in ((a, b), (b, c)) if None not in e}
    got = hierarchy(df, "grp", ["root", "node", "path"], full=True, local=local).collect()
    want = {(g, x): v for g, e in links.items() if e for x, v in brute(e).items()}
    assert {(r.grp, r.node): (r.root, r.depth, r.on_cycle) for r in got} == want
    path = {(r.grp, r.node): r.path for r in got}
    for r in got:
        assert not r.path or r.path[-1] == r.node and all(e in links[r.grp] for e in zip(r.path, r.path[1:]))
        below = sorted(n for (g, n), p in path.items() if g == r.grp and n != r.node and r.node in p)
        assert sorted(r.descendants) == below and r.n_descendants == len(below)
    assert hierarchy(df.limit(0), "grp", ["root", "node"]).count() == 0


def test_hierarchy_deep(spark):
    df = spark.range(3000).select(F.lit(1).alias("g"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    r = hierarchy(df, "g", ["a", "b"]).agg(F.max("depth"), F.max("n_descendants"), F.min("root"), F.count("*")).first()
    assert tuple(r) == (3000, 3000, 0, 3001)


# references


@pytest.mark.parametrize("bound", [10**6, 0])
def test_orphans(spark, bound):
    rnd = random.Random(9)
    day = lambda k: None if k is None else datetime(2024, 1, 1) + timedelta(days=k)
    spans = [(rnd.randint(1, 12), rnd.choice([None, rnd.randint(0, 100)]), rnd.choice([None, rnd.randint(0, 100)])) for _ in range(30)] + [(None, 1, 2)]
    refs = [(i, rnd.choice([None, *range(1, 15)]), rnd.choice([3, 4, 5, 20]), rnd.choice([None, rnd.randint(0, 100)])) for i in range(400)]
    refs += refs[:50]
    p = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in spans], "id int, key timestamp, until timestamp")
    r = spark.createDataFrame([(i, a, b, day(t)) for i, a, b, t in refs], "lo long, at int, period int, row_id timestamp")
    want = set()
    for i, a, b, t in refs:
        for f, k in (("at", a), ("period", b)):
            if t is not None and k is not None and not any(s == k and (x is None or x <= t) and (y is None or t < y) for s, x, y in spans):
                want.add((i, f, day(t).strftime("%Y-%m")))
    got = orphans(r, parents(p, "id", "key", "until"), "lo", ["at", "period"], "row_id", bound=bound)
    assert rows(got) == sorted(want, key=str)
    if bound:
        none = orphans(r, parents(p.limit(0), "id", "key", "until"), "lo", ["at"], "row_id")
        assert none.count() == len({i for i, a, _, t in refs if a is not None and t is not None})
        assert orphans(r.limit(0), parents(p, "id", "key", "until"), "lo", ["at"], "row_id").count() == 0
        assert max(Counter(map(tuple, got.collect())).values()) == 1


def test_far_hierarchy_of_one_large_tree(spark, monkeypatch):
    """Chains, what hangs on them, blocks of the order: the distributed rounds against the numpy way."""
    monkeypatch.setattr("condnet.operators.hierarchy_far.BLOCK", 7)
    monkeypatch.setattr("condnet.operators.hierarchy_far.SALTS", 2)
    rnd = random.Random(11)
    data = [(1, 1000 + rnd.randrange(max(0, i - 7), i), 1000 + i) for i in range(1, 90)] + [(1, 1040, 1035), (1, 5, 1080), (1, 700, 701), (1, 701, 700)]
    df = spark.createDataFrame(data, "g int, a int, b int")
    near, far = (sorted(map(tuple, hierarchy(df, "g", ["a", "b"], full=True, local=n).collect()), key=str) for n in (10**6, 0))
    assert near == far and len(near) == 93
