"""Routes, topologies, paths, applications, messages and streams on small examples."""

import pytest
from pyspark.sql import functions as F

from condnet.operators import apps, graph, routing
from condnet.sources import text, topology
from condnet.streaming.changes import Controller


def rows(df):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=str)


# routes


def test_announcement_round(spark):
    t = text.demo(spark)
    new = routing.update_policy(t["bgp_policy"], t["routes_delta"])
    assert {r.dest: (r.min_len, r.condition) for r in new.collect()}["1.6.68.0/22"] == (1, ["l(x579) <= 1"])
    assert rows(new.where("dest <> '1.6.68.0/22'")) == rows(t["bgp_policy"].where("dest <> '1.6.68.0/22'"))
    cand = routing.new_candidates(t["current_best_routes"], t["routes_delta"])
    assert cand.count() == 8
    best = routing.best_routes(new, cand)
    assert rows(best) == sorted(
        [
            ("1.6.68.0/22", "x579", 1, ("x579 == 9583", "l(x579) == 1")), ("1.6.4.0/22", "x531", 2, ("x531 == 23673 9583", "l(x531) == 2")),
            ("1.6.188.0/24", "y5", -1, ("y5 == 3303 6453 9583", "l(y5) == 3")),
        ], key=str,
    )
    assert rows(routing.extend_values(best)) == rows(routing.bgp_step(t["bgp_policy"], t["current_best_routes"], t["routes_delta"])[1])
    assert {r.dest: r.path for r in routing.extend_values(best).collect()} == {"1.6.68.0/22": "9583", "1.6.4.0/22": "23673 9583", "1.6.188.0/24": "3303 6453 9583"}


def test_set_path_val(spark):
    df = spark.createDataFrame([("x", ["l(x) == 2", "x == 1 2", "x == 3"]), ("_", ["_ == 1"]), ("y", ["7 8 == y"]), ("z", ["z != 1"]), ("5", None)], "p string, c array<string>")
    assert [r[0] for r in df.select(routing.set_path_val(F.col("p"), F.col("c"))).collect()] == ["1 2", "_", "", "", ""]
    assert [r[0] for r in df.select(routing.set_path_val(F.col("p"), F.col("c"), constants=True)).collect()][-1] == "5"


def test_records_and_synthesis(spark, tmp_path):
    f = tmp_path / "rib.txt"
    lines = ["p1|1 2 3", "p1|1 2", "p1|1 2", "p2|9 {8}", "p3|4", "p1|7 7 7 7", "p3|5 6", "p4|1", "p5|2", "p4|3"]
    f.write_text("".join(f"T|1|B|x|y|{line}|IGP\n" for line in lines))
    rib = text.read_records(spark, str(f))
    policies, routes = routing.synthesize(rib, (1, 2, 1))
    assert rows(policies) == [("p1", "x1", 2, ("l(x1) <= 2",)), ("p2", "y1", -1, ("y1 == 9 8",)), ("p3", "y2", -1, ("y2 == 4",)), ("p4", "z2", -1, ("z2 == nopath",))]
    assert rows(routes) == sorted([("p1", "1 2 3", 2), ("p1", "1 2", 2), ("p1", "7 7 7 7", 2), ("p2", "9 8", -1), ("p3", "4", -1), ("p3", "5 6", -1), ("p4", "1", -1)], key=str)
    u = tmp_path / "upd.txt"
    u.write_text("T|1|A|x|y|p1|1 2|IGP\nT|1|A|x|y|p1|1 2|IGP\nT|1|W|x|y|p2\nT|1|A|x|y|p9|1\n")
    assert rows(routing.announcements(text.read_records(spark, str(u)), policies)) == [("p1", "A", "1 2", 2), ("p2", "W", "", 1)]


# topologies


def test_topologies(spark):
    t = topology.tables(spark, topology.topology("linear,4"))
    assert {r.name: r.sid for r in t["switches"].collect()} == {f"s{i}": i for i in range(1, 5)}
    assert {r.name: r.hid for r in t["hosts"].collect()} == {f"h{i}": i + 4 for i in range(1, 5)}
    assert t["tp"].count() == 14 and t["tp"].where("bw is null").count() == 14
    assert rows(t["ports"].where("sid = 2")) == [(2, 1, 2), (2, 3, 3), (2, 6, 1)] and rows(t["ports"].where("sid = 6")) == [(6, 2, 0)]
    assert [r.ip for r in t["hosts"].orderBy("hid").collect()] == [f"10.0.0.{i}" for i in range(1, 5)]
    size = lambda s: (len(s.switches), len(s.hosts), len(s.links))
    assert size(topology.topology("fattree,4")) == (20, 16, 48) and size(topology.topology("tree,depth=2,fanout=3")) == (4, 9, 12)
    assert size(topology.topology("linear,3,2")) == (3, 6, 8) and size(topology.topology("empty")) == (0, 0, 0) and size(topology.topology("minimal")) == (1, 2, 2)
    assert topology.reversed_single(3).links[0] == ("h1", "s1", 0, 3)
    with pytest.raises(ValueError):
        topology.topology("fattree,3")
    with pytest.raises(ValueError):
        topology.topology("ring,3")


def test_isp_files(spark, tmp_path):
    (tmp_path / "7_nodes.txt").write_text("1\n2\n3\n")
    (tmp_path / "7_edges.txt").write_text("1 2\n2 1\n3 3\n2 3\n")
    nodes, links = text.read_isp(spark, str(tmp_path), 7)
    assert nodes.count() == 3 and rows(links) == [("1", "2"), ("2", "3")]


def test_searches_agree(spark):
    import random

    rnd = random.Random(6)
    for nodes, links in ((12, 18), (30, 34)):
        tp = spark.createDataFrame([(rnd.randint(1, nodes), rnd.randint(1, nodes), rnd.choice([1, 1, 1, 0])) for _ in range(links)], "sid int, nid int, isactive int")
        for few in (3, nodes):
            ends = [(i, rnd.randint(1, few), rnd.randint(1, nodes)) for i in range(40)]
            for turn in (False, True):
                pairs = spark.createDataFrame([(i, b, a) if turn else (i, a, b) for i, a, b in ends], "fid long, src long, dst long")
                assert rows(graph.shortest_paths(tp, pairs)) == rows(graph.shortest_paths(tp, pairs, bound=0))


def test_paths(spark):
    t = topology.tables(spark, topology.diamond())  # s1..s4 = 1..4, h1 = 5, h2 = 6
    pairs = spark.createDataFrame([(1, 5, 6), (2, 6, 5), (3, 5, 99), (4, 5, 5), (5, None, 6)], "fid long, src long, dst long")
    p = graph.shortest_paths(t["tp"], pairs)
    assert {r.fid: r.pv for r in p.collect()} == {1: [5, 1, 2, 4, 6], 2: [6, 4, 2, 1, 5], 3: [], 4: [5], 5: []}
    assert rows(graph.path_triples(p.where("fid = 1"))) == [(1, 1, 2, 4), (1, 2, 4, 6), (1, 5, 1, 2)]
    assert len(rows(graph.path_entries(p.where("fid = 1")))) == 4 and graph.path_entries(p.where("fid = 1")).where("pid is null").first().sid == 5
    cf = graph.path_triples(p)
    tp, dele, ins = graph.reroute(t["tp"], cf, pairs, spark.createDataFrame([(2, 1)], "sid int, nid int"))
    assert tp.where("isactive = 0").count() == 2 and dele.count() == 6
    assert rows(ins.where("fid = 1")) == [(1, 1, 3, 4), (1, 3, 4, 6), (1, 5, 1, 3)]
    to_ins, to_del = graph.difference(ins, cf)
    assert to_ins.count() == 6 and to_del.count() == 6
    up = graph.link_state(tp, spark.createDataFrame([(1, 1, 2, 1), (2, 4, 9, 1)], "seq int, sid int, nid int, up int"))
    assert up.where("isactive = 0").count() == 0 and up.count() == t["tp"].count() + 2
    assert graph.next_free(spark.createDataFrame([(1,), (2,), (4,), (-3,), (None,)], "x int"), "x").first()[0] == 3
    assert graph.next_free(spark.createDataFrame([], "x int"), "x").first()[0] == 1


# applications


def test_firewall_run(spark):
    t = topology.tables(spark, topology.linear(4))
    s = apps.State.start(spark, t["tp"])
    for u in (8, 6):
        s = apps.allow_user(s, u)
    s = apps.allow_pair(s, 8, 7)
    o = apps.Orchestrator()
    o.load("rt", "fw")
    assert o.order() == ["fw", "rt"]
    s = o.run(apps.add_flow(s, 8, 7))
    assert (s.rm.count(), s.cf.count(), s.clock) == (1, 2, 1)
    assert rows(s.acl.select("end1", "end2")) == [(7, 8), (8, 7)]
    s = apps.add_flow(s, 5, 6).written()
    assert rows(apps.fw_violation(s.rm, s.acl)) == [(2,)]
    s = o.run(s)
    assert (s.rm.count(), s.cf.count(), apps.fw_violation(s.rm, s.acl).count()) == (1, 2, 0)
    s = apps.del_flow(s, fid=1).written()
    assert rows(s.acl.select("end1", "end2")) == [(8, 7)]
    s = o.run(s)
    assert (s.rm.count(), s.cf.count()) == (0, 0)


def test_flow_lifecycle(spark):
    t = topology.tables(spark, topology.single(3))
    o = apps.Orchestrator(auto=True)
    o.load("rt")
    s = o.after(apps.add_flow(apps.State.start(spark, t["tp"]), 2, 3))
    assert (s.rm.count(), s.cf.count()) == (1, 1)
    m = apps.flow_messages(apps.flow_details(s.cf, t["ports"], s.rm, t["switches"], t["hosts"]))
    assert m.count() == 5 and m.where("kind = 'barrier'").count() == 1
    assert [r.text for r in apps.command_text(m).orderBy("n").collect()][0] == "ovs-ofctl add-flow s1 nw_src=10.0.0.1,nw_dst=10.0.0.2,dl_type=2048,priority=10,action=output:2"
    s = o.after(apps.del_flow(s, src=2, dst=3))
    assert (s.rm.count(), s.cf.count()) == (0, 0)


def test_null_aware_firewall(spark):
    rm = spark.createDataFrame([(1, 1, 2, 1), (2, 1, 3, 1), (3, None, 2, 1), (4, None, 9, 1), (5, 1, 9, 0), (6, 4, None, 1), (7, None, None, 1)], "fid long, src long, dst long, fw int")
    for allowed in ([(1, 2)], [(1, 2), (None, 3)], [(1, None)], [(None, None)], []):
        acl = spark.createDataFrame(allowed, "end1 long, end2 long")
        rm.createOrReplaceTempView("t_rm")
        acl.createOrReplaceTempView("t_acl")
        want = rows(spark.sql("SELECT fid FROM t_rm WHERE fw = 1 AND (src, dst) NOT IN (SELECT end1, end2 FROM t_acl)"))
        assert rows(apps.fw_violation(rm, acl)) == want, allowed


def test_repairs(spark):
    rm = spark.createDataFrame([(1, 5, 6, 2, 0, 0), (2, 5, 7, None, 0, None), (3, 8, 7, 9, 1, 0)], "fid long, src long, dst long, vol int, fw int, lb int")
    rates = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "fid long, rate int")
    assert rows(apps.rate_violation(rm, rates)) == [(1, 5, 2)]
    assert [r.vol for r in apps.rate_repair(rm, rates).orderBy("fid").collect()] == [5, None, 9]
    chains = spark.createDataFrame([(1, 2, "FW"), (4, 3, "LB")], "gid1 int, gid2 int, mb string")
    groups = spark.createDataFrame([(1, [5]), (2, [6]), (3, [6, 7]), (4, [5, 8])], "gid int, sid_array array<int>")
    assert rows(apps.chain_pairs(chains, groups)) == sorted([(5, 6, "FW"), (5, 6, "LB"), (5, 7, "LB"), (8, 6, "LB"), (8, 7, "LB")], key=str)
    assert rows(apps.chain_violation(rm, chains, groups)) == sorted([(1, "FW"), (1, "LB"), (3, "LB")], key=str)
    fixed = apps.chain_repair(rm, chains, groups)
    assert [(r.fw, r.lb) for r in fixed.orderBy("fid").collect()] == [(1, 1), (0, None), (1, 1)] and apps.chain_violation(fixed, chains, groups).count() == 0


def test_changes_and_routing_states(spark):
    log = spark.createDataFrame([(1, 1, 5, 6, 1), (2, 1, 5, 6, 0), (3, 2, 5, 7, 1), (4, 3, 1, 2, 0), (5, 3, 3, 4, 1)], "seq long, fid long, src long, dst long, isadd int")
    assert rows(apps.net_change(log)) == [(1, True, False, None, None), (2, False, True, 5, 7), (3, True, True, 3, 4)]
    ev = [
        (1, "ri", 1, 5, 6), (2, "rd", 1, 5, 6),  # comes and goes before a run: cancelled out
        (3, "rd", 2, 5, 6), (4, "ri", 2, 5, 6),  # goes and comes back: cancelled out
        (5, "cd", 4, None, None), (6, "cd", 4, None, None), (7, "rd", 5, 5, 7), (8, "cd", 5, None, None), (9, "ri", 6, 5, 99),
    ]
    events = spark.createDataFrame([(*e, None, None) for e in ev] + [(10, "ru", 3, 5, 7, 5, 6), (11, "ru", 7, 1, 1, 1, 1)], "seq long, kind string, fid long, src long, dst long, old_src long, old_dst long")
    v = apps.routing_violations(events)
    assert rows(v.select("fid", "status")) == sorted([(1, -1), (2, -1), (3, 1), (3, 2), (4, 3), (5, 2), (6, 1)], key=str)
    t = topology.tables(spark, topology.linear(4))
    rm = spark.createDataFrame([(f, 5, 6) for f in (2, 3, 4, 6)], "fid long, src long, dst long")
    cf = spark.createDataFrame([(3, 5, 1, 2), (5, 5, 1, 2), (2, 5, 1, 2)], "fid long, pid long, sid long, nid long")
    rm2, cf2 = apps.routing_repair(t["tp"], rm, cf, v)
    assert rows(rm2.select("fid")) == [(2,), (3,)]
    assert rows(cf2) == sorted([(2, 5, 1, 2), (3, None, 5, 1), (3, 5, 1, 2), (3, 1, 2, 3), (3, 2, 3, 7)], key=str)
    urm = spark.createDataFrame([(1, "I", 9, 1, 2), (2, "U", 2, 7, 8), (3, "D", 3, None, None)], "seq long, op string, fid long, host1 long, host2 long")
    assert rows(apps.apply_urm(rm.withColumn("vol", F.lit(None).cast("int")), urm)) == sorted([(4, 5, 6, None), (6, 5, 6, None), (9, 1, 2, 1), (2, 7, 8, 1)], key=str)


CHANGE = "seq long, op string, fid long, src long, dst long, vol int, fw int, lb int"


def test_stream(spark, tmp_path):
    t = topology.tables(spark, topology.single(3))
    o = apps.Orchestrator()
    o.load("rt")
    seen = []
    start = lambda: Controller(apps.State.start(spark, t["tp"]), o, str(tmp_path / "state"), lambda s, e: seen.append((e, s.rm.count(), s.cf.count())))
    c, src = start(), tmp_path / "in"
    for i, r in enumerate([("I", 1, 2, 3, 1, 0, 0), ("D", 1, None, None, None, None, None)]):
        spark.createDataFrame([(i, *r)], CHANGE).coalesce(1).write.mode("append").parquet(str(src))
        q = c.start(spark.readStream.schema(CHANGE).parquet(str(src)), str(tmp_path / "cp"))
        q.processAllAvailable()
        q.stop()
    assert [x[1:] for x in seen] == [(1, 1), (0, 0)]
    c.batch(spark.createDataFrame([(9, "I", 5, 2, 3, 1, 0, 0)], CHANGE), 0)  # delivered before
    assert c.state.rm.count() == 0
    c.batch(spark.createDataFrame([(10, "I", 6, 2, 3, 1, 0, 0)], CHANGE), 7)
    # another process on the same folder goes on from there
    again = start()
    assert (again.done, again.state.clock, again.state.rm.count(), again.state.cf.count()) == (7, 3, 1, 1)
    again.batch(spark.createDataFrame([(11, "D", 6, None, None, None, None, None)], CHANGE), 8)
    assert again.state.rm.count() == again.state.cf.count() == 0 and len(list((tmp_path / "state").iterdir())) <= 2


def test_changes_in_their_order(spark, tmp_path):
    """One batch with several changes of a flow is as good as a batch for each."""
    t = topology.tables(spark, topology.single(3))
    log = [(1, "I", 1, 2, 3, 1, 0, 0), (2, "I", 2, 2, 4, 1, 0, 0), (3, "D", 1, None, None, None, None, None), (4, "I", 1, 2, 4, 1, 0, 0), (5, "D", 2, None, None, None, None, None)]
    one = apps.State.start(spark, t["tp"], users=spark.createDataFrame([(2,)], "uid bigint"))
    many = one
    one = apps.apply_changes(apps.change_flows(one, spark.createDataFrame(log, CHANGE)))
    for x in log:
        many = apps.apply_changes(apps.change_flows(many, spark.createDataFrame([x], CHANGE))).written()
    for k in ("rm", "cf", "acl"):
        assert rows(getattr(one, k)) == rows(getattr(many, k)), k
    assert {r.fid for r in one.rm.collect()} == {1}


def test_scripts(spark):
    assert text.statements("select 1; -- no; \n/* ; */ select ';'\n;") == ["select 1", "select ';'"]
    assert text.run_sql(spark, "CREATE OR REPLACE TEMP VIEW v1 AS SELECT 1 AS a; SELECT a + 1 AS b FROM v1;").first().b == 2
    assert text.run_commands(["# x", "", " a ", "b"], str.upper) == ["A", "B"]
    assert "dest" in text.show(text.demo(spark)["bgp_policy"]) and text.watch(text.synthetic_routes(spark, 300), 7).count() == 7
    assert rows(text.synthetic_routes(spark, 128).select("dest").distinct())[-1] == ("10.0.1.0",)


def test_topology_messages(spark):
    a = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 4, 1)], "sid int, nid int, isactive int")
    b = spark.createDataFrame([(1, 2, 0), (2, 1, 1), (5, 6, 1)], "sid int, nid int, isactive int")
    assert rows(apps.topology_messages(a, b, ["sid", "nid"])) == [("add", 5, 6, 1), ("change", 1, 2, 0), ("del", 3, 4, None)]
    assert rows(apps.latest(spark.createDataFrame([(1, 1), (1, 2)], "k int, o int"), ["k"], "o")) == [(1, 2)]


def test_state_and_sinks(spark, tmp_path):
    t = topology.tables(spark, topology.single(3))
    s = apps.reinit(apps.add_flow(apps.State.start(spark, t["tp"], clock=4), 2, 3))
    assert (s.rm.count(), s.delta.count(), s.clock, s.tp.count()) == (0, 0, 0, 6)
    cf = spark.createDataFrame([(1, 5, 1, 2), (1, 1, 2, 6)], "fid long, pid long, sid long, nid long")
    assert apps.refuse_updates(cf, cf.limit(1)).count() == 1
    with pytest.raises(ValueError):
        apps.refuse_updates(cf, cf.withColumn("nid", F.col("nid") + 1))
    for k in (1, 2):
        assert text.load(cf.limit(k), str(tmp_path / "cf")).count() == k
    text.output(cf)
    assert spark.table("output").count() == 2
    o = apps.Orchestrator()
    o.load("rt", "fw")
    o.unload("fw")
    assert o.order() == ["rt"]
    o.reset()
    assert o.order() == [] and o.run(s).clock == 1
    with pytest.raises(ValueError):
        o.load("nothing")


def test_paths_of_ends(spark):
    """Hosts, nodes that only have each other, nodes with themselves, unknown ones: as a plain search over all links finds them."""
    import random

    rnd = random.Random(3)
    links = {(rnd.randint(1, 9), rnd.randint(1, 9)) for _ in range(12)} | {(20 + i, rnd.randint(1, 9)) for i in range(6)} | {(40, 41), (50, 51), (50, 52), (50, 53)}
    adj = {}
    for a, b in links:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)

    def brute(s, t):
        level = {s: (s,)} if s in adj and t in adj else {}
        seen = set(level)
        while level:
            if t in level:
                return level[t]
            new = {}
            for x, p in level.items():
                for y in adj[x] - seen:
                    new[y] = min(new.get(y, p + (y,)), p + (y,))
            seen |= set(new)
            level = new
        return ()

    ends = [1, 2, 3, 9, 20, 21, 22, 25, 40, 41, 50, 51, 52, 77]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in ends for b in ends)]
    tp = spark.createDataFrame([(a, b, 1) for a, b in links], "sid int, nid int, isactive int")
    df = spark.createDataFrame([*pairs, (900, None, 1), (901, 1, None)], "fid long, src long, dst long")
    want = {i: brute(a, b) for i, a, b in pairs} | {900: (), 901: ()}
    assert {r.fid: tuple(r.pv) for r in graph.shortest_paths(tp, df).collect()} == want
    few = graph.shortest_paths(tp, df, max_hops=2)
    assert {r.fid: tuple(r.pv) for r in few.collect()} == {i: p if len(p) <= 3 else () for i, p in want.items()}
    far = graph.shortest_paths(tp, df.where("fid % 5 = 0 or fid > 899"), bound=0)
    assert {r.fid: tuple(r.pv) for r in far.collect()} == {i: p for i, p in want.items() if i % 5 == 0 or i > 899}
