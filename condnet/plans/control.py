"""Queries for readers, sinks, applications, administration, messages and streams, each over whole tables, with its SQL."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condnet.common import materialize, scratch, table
from condnet.operators import apps, graph, routing
from condnet.operators.algebra import natural_join
from condnet.plans.encodings import duck, spark_table
from condnet.plans.reference import _ACL, _CV, _HOPS, _LOG, _PV, _RATES, _RM, _SEEN, _SIZES, _TRI, _acl, _flat, _groups, _installed, _paths, _text, _tp
from condnet.plans.reference import ORACLE as _OF
from condnet.sources import text, topology
from condnet.streaming.changes import Controller

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


_A = duck("asroutes")

# readers and sinks


def _records(spark: SparkSession, d: str, kind: F.Column) -> DataFrame:
    """The routes as lines of routing records, written to the shared folder and read again."""
    a = spark_table(spark, d, "asroutes")
    line = F.concat_ws("|", F.lit("TABLE"), F.lit("0"), kind, F.lit("10.0.0.1"), F.lit("64500"), F.col("dest"), F.concat(F.lit("{"), "path", F.lit("}")), F.lit("IGP"))
    return text.read_records(spark, text.write_lines(a.select(line), scratch(spark, "records")))


@_add(f"SELECT CASE st WHEN 'F' THEN 'B' ELSE st END AS kind, dest, path, count(*) AS n FROM {_A} GROUP BY ALL")
def src_records(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d, F.when(F.col("st") == "F", "B").otherwise(F.col("st")))
    return r.groupBy("kind", "dest", "path").agg(F.count("*").alias("n"))


@_add(f"SELECT DISTINCT dest, CASE WHEN st = 'O' THEN 'A' ELSE 'W' END AS operation, path, ({_HOPS})::INT AS len_path FROM {_A} WHERE dest IN (SELECT dest FROM {_SEEN})")
def src_announcements(spark: SparkSession, d: str) -> DataFrame:
    """Announcements from the lines of a file, for the prefixes seen first."""
    rib = spark_table(spark, d, "asroutes").select(F.col("rid").alias("seq"), "dest", "path")
    return routing.announcements(_records(spark, d, F.when(F.col("st") == "O", "A").otherwise("W")), routing.first_seen(rib, _SIZES))


def _isp(spark: SparkSession, d: str, half: DataFrame) -> str:
    """Links as the files of an ISP topology: each link in both directions, and links of nodes to themselves."""
    folder = scratch(spark, "isp")
    n = half.select(F.explode(F.array(F.col("sid").cast("string"), F.col("nid").cast("string"))).alias("n")).distinct()
    text.write_lines(n, f"{folder}/7_nodes.txt")
    pair = lambda a, b: half.select(F.concat_ws(" ", a, b))
    text.write_lines(pair("sid", "nid").union(pair("nid", "sid")).union(pair("nid", "nid")), f"{folder}/7_edges.txt")
    return folder


@_add(f"SELECT DISTINCT least(sid::VARCHAR, nid::VARCHAR) AS a, greatest(sid::VARCHAR, nid::VARCHAR) AS b FROM {duck('tp_half')} WHERE sid <> nid")
def src_isp_links(spark: SparkSession, d: str) -> DataFrame:
    return text.read_isp(spark, _isp(spark, d, spark_table(spark, d, "tp_half").select("sid", "nid")), 7)[1]


_NATIONS = "(SELECT n_regionkey + 100 AS sid, n_nationkey + 200 AS nid FROM nation)"


@_add(f"""
  WITH e AS (SELECT DISTINCT 's' || least(sid::VARCHAR, nid::VARCHAR) AS a, 's' || greatest(sid::VARCHAR, nid::VARCHAR) AS b FROM {_NATIONS}),
  n AS (SELECT name, row_number() OVER (ORDER BY name)::INT AS id FROM (SELECT a AS name FROM e UNION SELECT b FROM e))
  SELECT x.id AS sid, y.id AS nid, 0 AS ishost, 1 AS isactive FROM e JOIN n x ON x.name = a JOIN n y ON y.name = b UNION ALL SELECT y.id, x.id, 0, 1 FROM e JOIN n x ON x.name = a JOIN n y ON y.name = b""")
def topo_isp(spark: SparkSession, d: str) -> DataFrame:
    """An ISP topology by its spec, numbered and with links both ways."""
    half = table(spark, d, "nation").select((F.col("n_regionkey") + 100).alias("sid"), (F.col("n_nationkey") + 200).alias("nid"))
    return topology.tables(spark, topology.topology("isp,7", spark, _isp(spark, d, half)))["tp"].select("sid", "nid", "ishost", "isactive")


_LINEAR = "(SELECT i + 7 AS a, i AS b, 1 AS h FROM range(1, 8) t(i) UNION ALL SELECT i, i - 1, 0 FROM range(2, 8) t(i))"


@_add(f"SELECT a::INT AS sid, b::INT AS nid, h AS ishost FROM {_LINEAR} UNION ALL SELECT b::INT, a::INT, h FROM {_LINEAR}")
def topo_spec(spark: SparkSession, d: str) -> DataFrame:
    """A topology from the text of its spec."""
    return topology.tables(spark, topology.topology("linear, k=7"))["tp"].select("sid", "nid", "ishost")


@_add("SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY o_custkey")
def src_sql_script(spark: SparkSession, d: str) -> DataFrame:
    """The result of an SQL script: of its last statement."""
    script = """
      -- orders; all of them
      CREATE OR REPLACE TEMPORARY VIEW condnet_orders AS SELECT o_custkey, o_orderkey, ';' AS mark FROM parquet.`{d}/orders.parquet`;
      /* by customer; */
      SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM condnet_orders WHERE mark = ';' GROUP BY o_custkey;"""
    return text.run_sql(spark, script.replace("{d}", d))


@_add("SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def src_commands(spark: SparkSession, d: str) -> DataFrame:
    """A script of commands, each counting a table."""
    count = lambda line: table(spark, d, line.split()[1]).agg(F.lit(line.split()[1]).alias("name"), F.count("*").alias("n"))
    got = text.run_commands(["# tables", "count region", "", "count orders  ", "  # and", "count events"], count)
    return got[0].unionByName(got[1]).unionByName(got[2])


@_add("SELECT c_custkey, c_nationkey FROM customer")
def sink_load(spark: SparkSession, d: str) -> DataFrame:
    """A table that is loaded again holds the new rows alone."""
    path = scratch(spark, "load")
    text.load(table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey")), path)
    return text.load(table(spark, d, "customer").select("c_custkey", "c_nationkey"), path)


@_add("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey = 3")
def sink_output(spark: SparkSession, d: str) -> DataFrame:
    """The last result kept as the view `output`."""
    text.output(table(spark, d, "supplier"))
    text.output(spark.table("output").where("s_nationkey = 3").select("s_suppkey", "s_nationkey"))
    return spark.table("output")


@_add("""
  WITH r AS (SELECT r_regionkey::VARCHAR AS k, r_name AS n FROM region), w AS (SELECT greatest(max(len(k)), len('r_regionkey')) AS a, greatest(max(len(n)), len('r_name')) AS b FROM r)
  SELECT rtrim(rpad('r_regionkey', a::INT, ' ') || '  r_name') AS line FROM w UNION ALL SELECT repeat('-', a) || '  ' || repeat('-', b) FROM w UNION ALL SELECT rtrim(rpad(k, a::INT, ' ') || '  ' || n) FROM r, w""")
def sink_show(spark: SparkSession, d: str) -> DataFrame:
    """A table as text."""
    lines = text.show(table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), 100).split("\n")
    return spark.createDataFrame([(x,) for x in lines], "line string")


# fixed values: how many demo candidates each prefix has, and the best routes that the demo's announcements lead to
@_add("SELECT * FROM (VALUES ('1.6.4.0/22', 34, 2), ('1.6.68.0/22', 34, 2), ('1.6.188.0/24', 34, -1), ('1.22.208.0/24', 1, -1)) v(dest, n, min_len)")
def demo_candidates(spark: SparkSession, d: str) -> DataFrame:
    return text.demo(spark)["routes"].groupBy("dest").agg(F.count("*").cast("int").alias("n"), F.min("min_len").alias("min_len"))


@_add("SELECT * FROM (VALUES ('1.6.68.0/22', '9583', 1), ('1.6.4.0/22', '23673 9583', 2), ('1.6.188.0/24', '3303 6453 9583', -1)) v(dest, path, min_len)")
def demo_best_routes(spark: SparkSession, d: str) -> DataFrame:
    t = text.demo(spark)
    return routing.bgp_step(t["bgp_policy"], t["current_best_routes"], t["routes_delta"])[1]


# fixed values: of the demo's instances the first holds in every world, the second in none
@_add("SELECT * FROM (VALUES ('instance1', '1.2.3.4', '[ABC]', ''), ('instance1', '5.6.7.8', '[AC]', '')) v(tab, dest, path, condition)")
def demo_instances(spark: SparkSession, d: str) -> DataFrame:
    from condnet.operators.normalize import normalize

    t = text.demo(spark)
    return _flat(normalize(t["instance1"].select(F.lit("instance1").alias("tab"), "*").unionByName(t["instance2"].select(F.lit("instance2").alias("tab"), "*"))))


@_add(_OF["c_join_norm"])
def c_join_natural(spark: SparkSession, d: str) -> DataFrame:
    """The join on all columns that both tables have."""
    return natural_join(spark_table(spark, d, "policy_ct"), spark_table(spark, d, "routes_ct"), shown=_text)


# state and administration


def _flows(spark: SparkSession, d: str) -> DataFrame:
    """The requests between a customer and a supplier that there are."""
    src, dst = table(spark, d, "customer").select((F.col("c_custkey") + 2000000).alias("src")), table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("dst"))
    return spark_table(spark, d, "rm").join(src, "src", "left_semi").join(dst, "dst", "left_semi").select("fid", "src", "dst", "vol", "fw", "lb")


@_add(f"SELECT count(*) AS tp, 0::BIGINT AS rm, 0::BIGINT AS delta, 0::BIGINT AS cf, 0 AS clock FROM ({_OF['topo_links']})")
def state_reinit(spark: SparkSession, d: str) -> DataFrame:
    """Everything is emptied but the topology."""
    s = apps.reinit(replace(apps.insert_flows(apps.State.start(spark, _tp(spark, d)), _flows(spark, d)), clock=5))
    n = lambda name: getattr(s, name).agg(F.count("*").alias(name))
    return n("tp").crossJoin(n("rm")).crossJoin(n("delta")).crossJoin(n("cf")).withColumn("clock", F.lit(s.clock))


@_add(f"SELECT max(fid) + 1 AS fid, 7 AS src, 8 AS dst, CAST(NULL AS INT) AS vol, 1 AS fw, CAST(NULL AS INT) AS lb FROM {_RM} UNION ALL SELECT fid, src, dst, vol, fw, lb FROM {_RM}")
def admin_add_flow(spark: SparkSession, d: str) -> DataFrame:
    """A flow added by its ends takes the next id."""
    s = replace(apps.State.start(spark, _tp(spark, d)), rm=spark_table(spark, d, "rm"))
    return apps.add_flow(s, 7, 8).rm


@_add(f"SELECT fid FROM {_RM} WHERE NOT (src = 2000001 AND dst = 1000001) AND fid <> 7")
def admin_del_flow(spark: SparkSession, d: str) -> DataFrame:
    """Flows removed by their pair and by id."""
    s = replace(apps.State.start(spark, _tp(spark, d)), rm=spark_table(spark, d, "rm"))
    return apps.del_flow(apps.del_flow(s, src=2000001, dst=1000001), fid=7).rm.select("fid")


@_add(f"SELECT 'acl' AS tab, end1, end2 FROM {_ACL} WHERE end1 <> 2000005 OR end2 <> 1000005 UNION ALL SELECT 'acl', 1, 2 UNION ALL SELECT 'users', c_custkey, NULL FROM customer WHERE c_custkey <> 3 UNION ALL SELECT 'users', 9000000, NULL")
def admin_acl(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and users allowed and forbidden by hand."""
    s = replace(apps.State.start(spark, _tp(spark, d), acl=_acl(spark, d)), users=table(spark, d, "customer").select(F.col("c_custkey").alias("uid")))
    s = apps.forbid_user(apps.allow_user(s, 9000000), 3)
    s = apps.forbid_pair(apps.allow_pair(s, 1, 2), 2000005, 1000005)
    return s.acl.select(F.lit("acl").alias("tab"), "end1", "end2").unionByName(s.users.select(F.lit("users").alias("tab"), F.col("uid").alias("end1"), F.lit(None).cast("bigint").alias("end2")))


@_add(f"SELECT * FROM {_TRI} WHERE fid NOT IN (SELECT fid FROM {_RM} WHERE fw = 1)")
def cf_no_updates(spark: SparkSession, d: str) -> DataFrame:
    """Rows of firewalled flows go: no row is changed in place, so nothing is refused."""
    t = materialize(graph.path_triples(_paths(spark, d)), "triples")
    return apps.refuse_updates(t, t.join(spark_table(spark, d, "rm").where("fw = 1"), "fid", "left_anti"))


@_add(f"SELECT *, 1 AS clock FROM {_TRI}")
def cf_handshake(spark: SparkSession, d: str) -> DataFrame:
    """What is installed after the differences are exchanged: what is wanted."""
    t = materialize(graph.path_triples(_paths(spark, d)), "triples")
    s = replace(apps.State.start(spark, _tp(spark, d)), cf=_installed(t))
    s = apps.handshake(s, *graph.difference(t, s.cf))
    return s.cf.withColumn("clock", F.lit(s.clock))


# applications

_KIND = "CASE WHEN event_id % 5 = 0 THEN 'rd' WHEN event_id % 5 = 1 THEN 'ru' WHEN event_id % 5 = 2 THEN 'cd' ELSE 'ri' END"


@_add(f"""
  WITH RECURSIVE l AS (SELECT user_id AS fid, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, {_KIND} AS kind,
      {{'s': user_id + 2000000, 'd': event_id % 3 + 1000000}} AS e, {{'s': user_id + 2000000, 'd': event_id // 3 % 3 + 1000000}} AS o FROM events),
  v AS (SELECT DISTINCT fid, 0::BIGINT AS k, NULL::STRUCT(s BIGINT, d BIGINT) AS v1, NULL::STRUCT(s BIGINT, d BIGINT) AS v2, false AS v3, NULL::STRUCT(s BIGINT, d BIGINT) AS vm FROM l
    UNION ALL SELECT v.fid, l.k,
      CASE WHEN kind = 'ru' AND e <> o THEN e WHEN kind = 'ri' AND NOT coalesce(v2 = e, false) THEN e WHEN kind = 'rd' THEN NULL ELSE v1 END,
      CASE WHEN kind = 'ru' AND e <> o AND v1 IS NULL THEN o WHEN kind = 'ri' AND v2 = e THEN NULL WHEN kind = 'rd' AND v1 IS NULL THEN e ELSE v2 END,
      v3 OR (kind = 'cd' AND v2 IS NULL), CASE WHEN kind = 'ri' AND v2 = e THEN v2 WHEN kind = 'rd' AND v1 IS NOT NULL THEN v1 ELSE vm END
    FROM v JOIN l ON l.fid = v.fid AND l.k = v.k + 1),
  f AS (SELECT * FROM v WHERE k = (SELECT max(l.k) FROM l WHERE l.fid = v.fid))
  SELECT fid, v1.s AS src, v1.d AS dst, 1 AS status FROM f WHERE v1 IS NOT NULL UNION ALL SELECT fid, v2.s, v2.d, 2 FROM f WHERE v2 IS NOT NULL
  UNION ALL SELECT fid, NULL, NULL, 3 FROM f WHERE v3 UNION ALL SELECT fid, vm.s, vm.d, -1 FROM f WHERE vm IS NOT NULL""")
def rt_state_machine(spark: SparkSession, d: str) -> DataFrame:
    """Requests inserted, deleted and moved and forwarding rows deleted, folded to what is left to repair, in the order of repair."""
    k, u = F.col("event_id"), F.col("user_id")
    kind = F.when(k % 5 == 0, "rd").when(k % 5 == 1, "ru").when(k % 5 == 2, "cd").otherwise("ri")
    log = table(spark, d, "events").select(
        k.alias("seq"), kind.alias("kind"), u.alias("fid"), (u + 2000000).alias("src"), (k % 3 + 1000000).alias("dst"), (u + 2000000).alias("old_src"), (F.floor(k / 3) % 3 + 1000000).alias("old_dst")
    )
    return apps.by_status(apps.routing_violations(log))


@_add(f"SELECT fid, CASE WHEN i > 0 THEN pv[i] END AS pid, pv[i + 1] AS sid, pv[i + 2] AS nid FROM (SELECT fid, pv, unnest(range(0, len(pv) - 1)) AS i FROM {_PV}) WHERE fid NOT IN (SELECT fid FROM {_RM} WHERE fw = 1)")
def rt_repair_run(spark: SparkSession, d: str) -> DataFrame:
    """Requests come, firewalled ones go again; the application of routing states installs the paths of the others."""
    o = apps.Orchestrator()
    s = o.loading(apps.State.start(spark, _tp(spark, d)), "states")
    rm = _flows(spark, d)
    s = apps.delete_flows(apps.insert_flows(s, rm), rm.where("fw = 1"))
    return o.run(s).cf


@_add(f"""
  SELECT r.fid, CASE WHEN rate > vol THEN rate ELSE vol END AS vol, CASE WHEN r.fid IN (SELECT fid FROM {_CV} WHERE mb = 'FW') THEN 1 ELSE fw END AS fw,
    CASE WHEN r.fid IN (SELECT fid FROM {_CV} WHERE mb = 'LB') THEN 1 ELSE lb END AS lb FROM {_RM} r LEFT JOIN {_RATES} p ON r.fid = p.fid""")
def orch_together(spark: SparkSession, d: str) -> DataFrame:
    """Two applications as one, run automatically; one that was unloaded before does nothing."""
    o = apps.Orchestrator(auto=True)
    o.known["both"] = apps.together("both", apps.BANDWIDTH, apps.CHAIN)
    s = apps.State.start(spark, _tp(spark, d), rm=spark_table(spark, d, "rm"), rates=spark_table(spark, d, "rates"), chains=spark_table(spark, d, "chains"), groups=_groups(spark, d))
    s = o.loading(s, "fw", "both")
    return o.after(o.unloading(s, "fw")).rm.select("fid", "vol", "fw", "lb")


@_add(f"""
  SELECT 'rate' AS app, count(*) AS n FROM {_RM} r JOIN {_RATES} p ON r.fid = p.fid WHERE rate > vol UNION ALL SELECT 'fw', count(*) FROM {_RM} WHERE fw = 1 AND (src, dst) NOT IN (SELECT end1, end2 FROM {_ACL})
  UNION ALL SELECT 'policies', count(*) FROM supplier""")
def orch_violations(spark: SparkSession, d: str) -> DataFrame:
    """How many violations each loaded application sees; those of policies are all policies."""
    o = apps.Orchestrator(known={})
    o.discover(apps)
    s = apps.State.start(spark, _tp(spark, d), rm=spark_table(spark, d, "rm"), rates=spark_table(spark, d, "rates"), acl=_acl(spark, d), policies=spark_table(spark, d, "policy_ct"))
    s = o.loading(s, "policies", "rate", "fw")
    out = None
    for name, views in o.violations(s).items():
        for v in views:
            got = v.agg(F.lit(name).alias("app"), F.count("*").alias("n"))
            out = got if out is None else out.unionByName(got)
    return out


# links


_DETOUR = """(SELECT 1 AS sid, n_nationkey + 10 AS nid FROM nation UNION ALL SELECT 2, n_nationkey + 10 FROM nation UNION ALL SELECT s_nationkey + 10, s_suppkey + 1000000 FROM supplier UNION ALL SELECT c_nationkey + 10, c_custkey + 2000000 FROM customer)"""


@_add(f"""
  WITH f AS (SELECT fid, src, dst, c_nationkey + 10 AS a, s_nationkey + 10 AS b FROM {_RM} JOIN customer ON c_custkey + 2000000 = src JOIN supplier ON s_suppkey + 1000000 = dst
    WHERE c_nationkey <> s_nationkey AND (c_nationkey = 3 OR s_nationkey = 3))
  SELECT op, fid, pid, sid, nid FROM (SELECT *, 'del' AS op, 1 AS m FROM f UNION ALL SELECT *, 'ins', 2 FROM f) p,
    LATERAL (VALUES (src, a, m), (a, m, b), (m, b, dst)) t(pid, sid, nid)""")
def reroute_detour(spark: SparkSession, d: str) -> DataFrame:
    """The rows that go and those that come when a link goes down and there is another way: nations have two hubs."""
    n, s, c = (table(spark, d, t) for t in ("nation", "supplier", "customer"))
    link = lambda df, a, b: df.select(a.cast("bigint").alias("sid"), b.cast("bigint").alias("nid"), F.lit(1).alias("isactive"))
    col = F.col
    half = [link(n, F.lit(h), col("n_nationkey") + 10) for h in (1, 2)] + [link(s, col("s_nationkey") + 10, col("s_suppkey") + 1000000), link(c, col("c_nationkey") + 10, col("c_custkey") + 2000000)]
    tp = half[0].unionByName(half[1]).unionByName(half[2]).unionByName(half[3])
    rm = _flows(spark, d).select("fid", "src", "dst")
    cf = materialize(graph.path_triples(graph.shortest_paths(tp, rm)), "triples")
    _, dele, ins = graph.reroute(tp, cf, rm, spark.createDataFrame([(13, 1)], "sid bigint, nid bigint"))
    return dele.select(F.lit("del").alias("op"), "*").unionByName(ins.select(F.lit("ins").alias("op"), "*"))


@_add(f"SELECT sid, nid, port FROM ({_OF['topo_ports']}) UNION ALL SELECT * FROM (VALUES (3, 7777777, 41), (7777777, 3, 1)) v(sid, nid, port)")
def link_ports(spark: SparkSession, d: str) -> DataFrame:
    """Ports after links came up, of which one is new."""
    # fixed values: a known link comes up again, a new one twice
    ev = spark.createDataFrame([(1, 0, 1, 1, 90, 91), (2, 3, 7777777, 1, 41, 1), (3, 7777777, 3, 1, 8, 9), (4, 0, 2, 0, 1, 1)], "seq long, sid long, nid long, up int, port1 int, port2 int")
    tp = _tp(spark, d)
    return graph.new_ports(topology.next_ports(tp, F.col("sid") < 1000000, "nid"), tp, ev)


@_add(f"SELECT rid, coalesce(list_position(string_split(path, ' '), '105'), 0) AS place FROM {_A}")
def hop_places(spark: SparkSession, d: str) -> DataFrame:
    """Where a hop stands on each path."""
    return spark_table(spark, d, "asroutes").select("rid", graph.hop_position(F.col("path"), F.lit("105")).alias("place"))


# messages

_DETAILS = f"(SELECT t.fid, t.sid, 's' || t.sid::VARCHAR AS switch, '10.0.0.' || src::VARCHAR AS src_ip, '10.0.0.' || dst::VARCHAR AS dst_ip, 'm' || src::VARCHAR AS src_mac, 'm' || dst::VARCHAR AS dst_mac, (t.sid % 7)::INT AS outport, (t.pid % 7)::INT AS revport FROM {_TRI} t JOIN {_RM} r ON t.fid = r.fid)"


def _details(spark: SparkSession, d: str) -> DataFrame:
    t = materialize(graph.path_triples(_paths(spark, d)), "triples")
    text_ = lambda p, c: F.concat(F.lit(p), c)
    return t.join(spark_table(spark, d, "rm").select("fid", "src", "dst"), "fid").select(
        "fid", "pid", "sid", "nid", text_("s", "sid").alias("switch"), F.lit(None).cast("string").alias("dpid"), text_("10.0.0.", "src").alias("src_ip"), text_("m", "src").alias("src_mac"),
        text_("10.0.0.", "dst").alias("dst_ip"), text_("m", "dst").alias("dst_mac"), (F.col("sid") % 7).cast("int").alias("outport"), (F.col("pid") % 7).cast("int").alias("revport"),
    )


@_add(f"""
  SELECT fid, sid, n, switch, CASE WHEN n < 5 THEN 4 END AS command, CASE n WHEN 1 THEN src_ip WHEN 2 THEN dst_ip END AS nw_src, CASE n WHEN 1 THEN dst_ip WHEN 2 THEN src_ip END AS nw_dst,
    CASE n WHEN 3 THEN src_mac WHEN 4 THEN dst_mac END AS dl_src, CASE WHEN n < 3 THEN 10 WHEN n < 5 THEN 1 END AS priority FROM {_DETAILS}, (VALUES (1), (2), (3), (4), (5)) v(n)""")
def flow_messages_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is sent when flows are deleted."""
    return apps.flow_messages(_details(spark, d), apps.DELETE_STRICT).select("fid", "sid", "n", "switch", "command", "nw_src", "nw_dst", "dl_src", "priority")


@_add(f"""
  SELECT fid, sid, n, 'ovs-ofctl ' || CASE WHEN c = 0 THEN 'add-flow ' ELSE '--strict del-flows ' END || switch || ' ' || CASE n WHEN 1 THEN 'nw_src=' || src_ip || ',nw_dst=' || dst_ip || ',dl_type=2048,priority=10'
      WHEN 2 THEN 'nw_src=' || dst_ip || ',nw_dst=' || src_ip || ',dl_type=2048,priority=10' WHEN 3 THEN 'dl_src=' || src_mac || ',dl_type=2054,priority=1' ELSE 'dl_src=' || dst_mac || ',dl_type=2054,priority=1' END
    || CASE WHEN c = 0 THEN ',action=output:' || CASE n WHEN 1 THEN outport::VARCHAR WHEN 2 THEN revport::VARCHAR ELSE 'flood' END ELSE '' END AS text
  FROM {_DETAILS}, (VALUES (1), (2), (3), (4)) v(n), (VALUES (0), (4)) w(c)""")
def flow_commands(spark: SparkSession, d: str) -> DataFrame:
    """The switch commands that add and that delete each flow."""
    t = materialize(_details(spark, d), "details")
    return apps.command_text(apps.flow_messages(t)).unionByName(apps.command_text(apps.flow_messages(t, apps.DELETE_STRICT)))


@_add("""
  SELECT 'del' AS op, s_suppkey AS id, NULL AS nation FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'change', s_suppkey, 99 FROM supplier WHERE s_nationkey = 4
  UNION ALL SELECT 'add', c_custkey + 5000000, c_nationkey FROM customer""")
def topology_messages(spark: SparkSession, d: str) -> DataFrame:
    """What is told of nodes that go, change and come."""
    before = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    after = before.where("nation <> 3").withColumn("nation", F.when(F.col("nation") == 4, 99).otherwise(F.col("nation")))
    new = table(spark, d, "customer").select((F.col("c_custkey") + 5000000).alias("id"), F.col("c_nationkey").alias("nation"))
    return apps.topology_messages(before, after.unionByName(new), ["id"])


@_add("SELECT event_id, lpad((us // 1000 % 1000)::VARCHAR, 3, '0') || '.' || lpad((us % 1000000)::VARCHAR, 6, '0') AS took FROM (SELECT event_id, epoch_us(ts) % 10000000000 AS us FROM events)")
def profile_times(spark: SparkSession, d: str) -> DataFrame:
    """Times as the profile shows them."""
    return table(spark, d, "events").select("event_id", apps.ms_us(F.unix_micros(F.col("ts").cast("timestamp")) % 10_000_000_000).alias("took"))


# streams


@_add(f"SELECT fid, src, dst FROM (SELECT *, coalesce(max(CASE WHEN isadd = 0 THEN seq END) OVER (PARTITION BY fid), -1) AS last FROM {_LOG}) WHERE isadd = 1 AND seq > last")
def stream_controller(spark: SparkSession, d: str) -> DataFrame:
    """A stream of insertions and deletions kept as state from batch to batch: the requests that are there in the end."""
    schema = table(spark, d, "events").schema
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(schema)
    stream = stream.parquet(path) if os.path.isdir(path) else stream.option("pathGlobFilter", "events.parquet").parquet(d)
    none = F.lit(None).cast("int")
    op = F.when(F.col("event_type").isin("error", "purchase"), "D").otherwise("I")
    changes = stream.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("fid"), (F.col("user_id") + 2000000).alias("src"), (F.col("event_id") % 10 + 1000000).alias("dst"), none.alias("vol"), none.alias("fw"), none.alias("lb"))
    folder = scratch(spark, "controller")
    c = Controller(apps.State.start(spark, _tp(spark, d)), apps.Orchestrator(), f"{folder}/state")
    c.start(changes, f"{folder}/progress", once=True).awaitTermination()
    return c.state.rm.select("fid", "src", "dst")
