"""Registered queries take all rows of their tables, on small tables of this file's own."""

from collections import defaultdict

from condnet.plans.registry import QUERIES


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def orders(spark, tmp_path, data):
    spark.createDataFrame(data, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def test_all_announcements_are_read(spark, tmp_path):
    data = [(k, k % 3, "FOOP"[k * 7 % 4]) for k in range(1, 60)]
    d = orders(spark, tmp_path, data)
    path = lambda k: " ".join(str(100 + k * m % 37) for m in (1, 3, 5, 7)[: k % 4 + 1])
    current, new, least, policy = {}, set(), {}, defaultdict(list)
    for k, c, st in data:
        dest = f"10.1.{c}.0/24"
        if st == "F":
            current[dest] = min(current.get(dest, "~"), path(k))
            policy[dest].append((k, k % 4))
        if st == "O":
            new.add((dest, path(k), k % 4 + 1))
            least[dest] = min(least.get(dest, 9), k % 4 + 1)
    assert any(k % 3 for k, _, st in data if st == "O")
    cand = new | {(dest, p, 4) for dest, p in current.items() if dest in least}
    assert rows(QUERIES["bgp_new_candidates"](spark, d)) == sorted(cand, key=str)
    short = {dest: min(max(n for _, n in v), least.get(dest, 9)) for dest, v in policy.items()}
    var = {dest: f"x{min(k for k, _ in v)}" for dest, v in policy.items()}
    assert rows(QUERIES["bgp_update_policy"](spark, d)) == sorted(((dest, var[dest], n, f"l({var[dest]}) <= {n}") for dest, n in short.items()), key=str)
    best = [(dest, p) for dest, p, _ in cand if dest in short and len(p.split()) <= short[dest]]
    assert rows(QUERIES["bgp_best_routes"](spark, d).select("dest", "path", "condition")) == sorted(((dest, var[dest], f"l({var[dest]}) == {len(p.split())}; {var[dest]} == {p}") for dest, p in best), key=str)
    assert rows(QUERIES["c_extend_values"](spark, d).select("dest", "path")) == sorted(best, key=str)


def test_redundancy_is_decided_for_all_lists(spark, tmp_path):
    data = [(k, c, "O") for k in range(6) for c in range(15)]
    d = orders(spark, tmp_path, [(6 * i + k, c, st) for i, (k, c, st) in enumerate(data)])
    values = [*"01234", "9"]
    want = []
    for i, (k, c, _) in enumerate(data):
        x, y, z = (str(c % m) for m in (5, 3, 2))
        # worlds (x, y) in which each condition holds
        holds = {
            0: [lambda a, b: a == x, lambda a, b: a == y], 1: [lambda a, b: a == x, lambda a, b: a != y], 2: [lambda a, b: z == "1", lambda a, b: True],
            3: [lambda a, b: a != "1", lambda a, b: b != y, lambda a, b: a != "1"], 4: [lambda a, b: False], 5: [],
        }[k]
        worlds = [{(a, b) for a in values for b in values if h(a, b)} for h in holds]
        want.append((6 * i + k, any(p <= q for m, p in enumerate(worlds) for n, q in enumerate(worlds) if m != n)))
    got = rows(QUERIES["c_has_redundant"](spark, d))
    assert len(got) == 90 and got == sorted(want, key=str)


def test_paths_of_any_length(spark, tmp_path):
    from condnet.operators import graph

    tp = spark.range(1200).selectExpr("id as sid", "id + 1 as nid", "1 as isactive")
    pairs = spark.createDataFrame([(1, 0, 1200), (2, 1200, 0), (3, 0, 9999)], "fid long, src long, dst long")
    assert {r.fid: r.pv for r in graph.shortest_paths(tp, pairs).collect()} == {1: [*range(1201)], 2: [*range(1200, -1, -1)], 3: []}
    assert [len(r.pv) for r in graph.shortest_paths(tp, pairs, max_hops=3).collect()] == [0, 0, 0]
    near = spark.createDataFrame([(1, 0, 3), (2, 0, 4)], "fid long, src long, dst long")
    assert rows(graph.shortest_paths(tp, near, max_hops=3, bound=0).select("fid", "pv")) == [(1, [0, 1, 2, 3]), (2, [])]
    # supplier k shares part k with the next one; supplier 9 shares none
    spark.createDataFrame([(s, p) for s in range(1, 5) for p in (s - 1, s)] + [(9, 99)], "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert rows(QUERIES["sp_hops_bfs"](spark, str(tmp_path))) == [(1000001, 0), (1000002, 2), (1000003, 4), (1000004, 6)]


def test_length_selection_keeps_constant_paths(spark, tmp_path):
    spark.createDataFrame([(2, 1), (3, 1), (4, 1), (7, 1), (9, 2)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    assert rows(QUERIES["c_select_length"](spark, str(tmp_path))) == sorted(
        [
            ("10.0.1.0/24", "l(x2) <= 3; x2 != [FURNITURE]; x2 != [MACHINERY]"), ("10.0.1.0/24", "l(x4) <= 3; x4 == [BUILDING]"), ("10.0.1.0/24", "l([BUILDING]) <= 3"),
            ("d7", "d7 != 10.0.3.0/24; l([BUILDING]) <= 3"), ("10.0.2.0/24", "l([BUILDING]) <= 3"),
        ], key=str,
    )


def test_all_flows_are_learned_from(spark, tmp_path):
    data = [(k, k % 7, "O") for k in range(1, 80)]
    d = orders(spark, tmp_path, data)
    spark.createDataFrame([(c,) for c in range(7)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    flows = {(c + 2000000, k % 10 + 1000000) for k, c, _ in data}
    acl = {(c + 2000000, k % 10 + 1000000) for k, c, _ in data if k % 5 == 0}
    learned = {(b, a) for a, b in flows if (a - 2000000) % 3 == 0} - acl
    assert rows(QUERIES["fw_learn"](spark, d)) == sorted(((a, b, 1) for a, b in [*acl, *learned]), key=str)
