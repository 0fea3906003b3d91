"""One query per operator over the driver's tables, with its SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from condnet.common import materialize, shared_dir, table
from condnet.operators import apps, graph, normalize, routing
from condnet.operators.algebra import Or, Pred, c_condition, c_data, c_join, c_join_data, c_project, c_select, c_union, hops
from condnet.operators.predicates import SQL_NAMES, is_var, possibly, register
from condnet.operators.sqlfront import query
from condnet.plans.encodings import duck, spark_table
from condnet.sources import topology
from condnet.sources.text import synthetic_routes, watch
from condnet.streaming.changes import net_change_of_stream

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _text(c: Column) -> Column:
    """A condition list as text, as a set."""
    return F.array_join(F.sort_array(c), "; ")


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("condition", _text(F.col("condition")))


_P, _R, _A = duck("policy_ct"), duck("routes_ct"), duck("asroutes")
_LIST = "array_to_string(list_sort(condition), '; ')"
_ON = [("dest", "==", "dest"), ("path", "==", "path")]


def _var(c: str) -> str:
    return f"coalesce(regexp_matches({c}, '^[a-zA-Z]'), false)"


def _poss(op: str, a: str, b: str) -> str:
    return f"(coalesce({a} {op} {b}, false) OR {_var(a)} OR {_var(b)})"


# conditional tables

_NORM_JOIN = f"""
  SELECT CASE WHEN pd THEN p.dest ELSE r.dest END AS dest, CASE WHEN pp THEN p.path ELSE r.path END AS path, r.flag,
    CASE WHEN pp THEN p.path || ' == ' || r.path WHEN pd THEN p.dest || ' == ' || r.dest ELSE '' END AS condition
  FROM (SELECT *, {_var("dest")} AS pd, {_var("path")} AS pp FROM {_P}) p JOIN {_R} r ON (pd OR p.dest = r.dest) AND (pp OR p.path = r.path)
  WHERE NOT (pd AND r.dest = '10.0.3.0/24')
    AND NOT (pp AND list_contains(condition, p.path || ' != ' || r.path)) AND NOT (pp AND len(condition) = 1 AND NOT list_contains(condition, p.path || ' == ' || r.path))"""


@_add(_NORM_JOIN.replace("list_contains(condition", "list_contains(p.condition").replace("len(condition)", "len(p.condition)"))
def c_join_norm(spark: SparkSession, d: str) -> DataFrame:
    """Policies joined with routes, conditions normalised."""
    return c_join(spark_table(spark, d, "policy_ct"), spark_table(spark, d, "routes_ct"), _ON, shown=_text)


_DATA_JOIN = f"SELECT p.dest AS l_dest, p.path AS l_path, r.dest AS r_dest, r.path AS r_path, r.flag AS r_flag FROM {_P} p JOIN {_R} r ON {_poss('=', 'p.dest', 'r.dest')} AND {_poss('=', 'p.path', 'r.path')}"


@_add(_DATA_JOIN)
def c_join_data_phase(spark: SparkSession, d: str) -> DataFrame:
    return c_join_data(spark_table(spark, d, "policy_ct"), spark_table(spark, d, "routes_ct"), _ON).drop("l_condition", "r_condition")


@_add(f"""
  SELECT CASE WHEN {_var("p.dest")} THEN p.dest ELSE r.dest END AS dest, CASE WHEN {_var("p.path")} THEN p.path ELSE r.path END AS path, flag,
    array_to_string(list_sort(list_concat(p.condition, list_value(p.dest || ' == ' || r.dest, p.path || ' == ' || r.path))), '; ') AS condition
  FROM {_P} p JOIN {_R} r ON {_poss('=', 'p.dest', 'r.dest')} AND {_poss('=', 'p.path', 'r.path')}""")
def c_join_condition_phase(spark: SparkSession, d: str) -> DataFrame:
    return c_join(spark_table(spark, d, "policy_ct"), spark_table(spark, d, "routes_ct"), _ON, solve=False, shown=_text)


@_add(_NORM_JOIN.replace("list_contains(condition", "list_contains(p.condition").replace("len(condition)", "len(p.condition)"))
def c_join_sql_text(spark: SparkSession, d: str) -> DataFrame:
    """The same join from a query's text."""
    t = {"policy_ct": spark_table(spark, d, "policy_ct"), "routes_ct": spark_table(spark, d, "routes_ct")}
    return query("SELECT * FROM policy_ct, routes_ct WHERE policy_ct.dest = routes_ct.dest AND policy_ct.path = routes_ct.path;", t, shown=_text)


def _sel(sql_filter: str, text: str, norm: str) -> str:
    return f"SELECT dest, path, condition FROM (SELECT dest, path, {norm} AS condition FROM (SELECT *, {text} AS added FROM {_P} WHERE {sql_filter})) WHERE condition IS NOT NULL"


@_add(_sel(_poss("!=", "path", "'[MACHINERY]'"), "path || ' != [MACHINERY]'", f"""
  CASE WHEN NOT {_var("path")} THEN {_LIST} WHEN list_contains(condition, path || ' == [MACHINERY]') THEN NULL
    WHEN list_contains(condition, path || ' == [BUILDING]') THEN path || ' == [BUILDING]'
    ELSE array_to_string(list_sort(list_distinct(list_append(condition, added))), '; ') END"""))
def c_select_neq(spark: SparkSession, d: str) -> DataFrame:
    return _flat(c_select(spark_table(spark, d, "policy_ct"), [Pred("path", "!=", "[MACHINERY]")]))


@_add(_sel(_poss("=", "path", "'[BUILDING]'"), "path || ' == [BUILDING]'", f"CASE WHEN {_var('path')} THEN added ELSE {_LIST} END"))
def c_select_eq(spark: SparkSession, d: str) -> DataFrame:
    return _flat(c_select(spark_table(spark, d, "policy_ct"), [Pred("path", "==", "[BUILDING]")]))


@_add(_sel(f"{_poss('<', 'path', repr('[C'))}", "path || ' < [C'", f"""
  CASE WHEN NOT {_var("path")} THEN {_LIST} WHEN list_contains(condition, path || ' == [BUILDING]') THEN path || ' == [BUILDING]' ELSE path || ' < [C' END"""))
def c_select_range(spark: SparkSession, d: str) -> DataFrame:
    return _flat(c_select(spark_table(spark, d, "policy_ct"), [Pred("path", "<", "[C")]))


@_add(f"SELECT dest, path, len_path, '' AS condition FROM {_A} WHERE len_path >= 3")
def c_select_int(spark: SparkSession, d: str) -> DataFrame:
    """A comparison of whole numbers is one of numbers, and filters."""
    return _flat(c_select(spark_table(spark, d, "asroutes"), [Pred("len_path", ">=", 3)], ["dest", "path", "len_path"]))


@_add(f"SELECT dest, array_to_string(list_sort(list_append(condition, 'l(' || path || ') <= 3')), '; ') AS condition FROM {_P}")
def c_select_length(spark: SparkSession, d: str) -> DataFrame:
    """A length comparison doesn't filter; it joins the conditions and is left to the solver."""
    p = spark_table(spark, d, "policy_ct").withColumn("len", F.concat(F.lit("l("), "path", F.lit(")")))
    return _flat(c_select(p, [Pred("len", "<=", 3, deferred=True)], ["dest"]))


@_add(f"SELECT path, 'l(' || path || ') == ' || k::VARCHAR AS condition FROM (SELECT path, substr(path, 2)::INT % 7 AS k FROM {_P} WHERE {_var('path')}) WHERE k <= 3")
def c_select_length_decided(spark: SparkSession, d: str) -> DataFrame:
    """What the lengths already known leave of a length comparison: a contradiction where they are longer, nothing to add where they aren't."""
    p = spark_table(spark, d, "policy_ct").where(is_var(F.col("path")))
    text = F.concat(F.lit("l("), "path", F.lit(")"))
    known = p.select("path", F.array(F.concat(text, F.lit(" == "), (F.substring("path", 2, 20).cast("int") % 7).cast("string"))).alias("condition"), text.alias("len"))
    return _flat(c_select(known, [Pred("len", "<=", 3, deferred=True)], ["path"]))


@_add(_sel(f"({_poss('=', 'path', repr('[BUILDING]'))} OR {_poss('=', 'path', repr('[MACHINERY]'))})", "'Or(' || path || ' == [BUILDING], ' || path || ' == [MACHINERY])'", f"""
  CASE WHEN NOT {_var("path")} THEN {_LIST} WHEN list_contains(condition, path || ' == [BUILDING]') THEN path || ' == [BUILDING]'
    ELSE array_to_string(list_sort(list_append(list_filter(condition, lambda c: NOT contains(c, 'FURNITURE')), added)), '; ') END"""))
def c_select_or(spark: SparkSession, d: str) -> DataFrame:
    return _flat(c_select(spark_table(spark, d, "policy_ct"), [Or((Pred("path", "==", "[BUILDING]"), Pred("path", "==", "[MACHINERY]")))]))


@_add(f"SELECT dest, path, array_to_string(list_sort(list_append(condition, path || ' != [MACHINERY]')), '; ') AS condition FROM {_P} WHERE {_poss('!=', 'path', repr('[MACHINERY]'))}")
def c_select_steps(spark: SparkSession, d: str) -> DataFrame:
    """The data and the condition phase alone."""
    p = [Pred("path", "!=", "[MACHINERY]")]
    return _flat(c_condition(c_data(spark_table(spark, d, "policy_ct"), p), p))


@_add(f"SELECT dest, {_LIST} AS condition FROM {_P} UNION ALL SELECT dest, '' FROM {_R}")
def c_project_union(spark: SparkSession, d: str) -> DataFrame:
    return _flat(c_union(c_project(spark_table(spark, d, "policy_ct"), ["dest"]), c_project(spark_table(spark, d, "routes_ct"), ["dest"])))


_LISTS = """(SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN list_value('x == ' || (o_custkey % 5)::VARCHAR, 'x == ' || (o_custkey % 3)::VARCHAR)
  WHEN 1 THEN list_value('x == ' || (o_custkey % 5)::VARCHAR, 'x != ' || (o_custkey % 3)::VARCHAR) WHEN 2 THEN list_value('1 == ' || (o_custkey % 2)::VARCHAR, '2 != 3')
  WHEN 3 THEN list_value('x != 1', 'y != ' || (o_custkey % 3)::VARCHAR, 'x != 1') WHEN 4 THEN list_value('y == nopath') ELSE CAST([] AS VARCHAR[]) END AS condition FROM orders)"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey")
    n = lambda m: (c % m).cast("string")
    cond = (
        F.when(k == 0, F.array(F.concat(F.lit("x == "), n(5)), F.concat(F.lit("x == "), n(3)))).when(k == 1, F.array(F.concat(F.lit("x == "), n(5)), F.concat(F.lit("x != "), n(3))))
        .when(k == 2, F.array(F.concat(F.lit("1 == "), n(2)), F.lit("2 != 3"))).when(k == 3, F.array(F.lit("x != 1"), F.concat(F.lit("y != "), n(3)), F.lit("x != 1")))
        .when(k == 4, F.array(F.lit("y == nopath"))).otherwise(F.array().cast("array<string>"))
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), cond.alias("condition"))


_BAD = """(id % 6 = 4 OR (id % 6 = 2 AND condition[1] = '1 == 0') OR (id % 6 = 0 AND condition[1] <> condition[2])
  OR (id % 6 = 1 AND replace(condition[1], ' == ', ' != ') = condition[2]))"""


@_add(f"SELECT id, {_BAD} AS bad FROM {_LISTS}")
def c_norm_contradiction(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("id", normalize.is_contradiction("condition").alias("bad"))


@_add(f"SELECT id, (id % 6 = 5 OR (id % 6 = 2 AND condition[1] = '1 == 1')) AS always FROM {_LISTS}")
def c_norm_tautology(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("id", normalize.is_tautology("condition").alias("always"))


_LEFT = """CASE id % 6 WHEN 0 THEN condition[1] WHEN 1 THEN condition[1] WHEN 2 THEN '' WHEN 3 THEN CASE WHEN condition[2] = 'x' THEN '' ELSE array_to_string(list_sort(list_distinct(condition)), '; ') END ELSE '' END"""


@_add(f"SELECT id, {_LEFT} AS condition FROM {_LISTS} WHERE NOT {_BAD}")
def c_norm_redundant(spark: SparkSession, d: str) -> DataFrame:
    return _flat(normalize.normalize(_lists(spark, d)))


@_add(f"""
  SELECT id, CASE id % 6 WHEN 0 THEN condition[1] = condition[2] WHEN 1 THEN replace(condition[1], ' == ', ' != ') <> condition[2] WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS redundant FROM {_LISTS}""")
def c_has_redundant(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d).select("id", normalize.has_redundant("condition").alias("redundant"))


@_add(f"SELECT 'policy' AS tab, {_var('dest')} AS dest_var, {_var('path')} AS path_var, count(*) AS n FROM {_P} GROUP BY ALL UNION ALL SELECT 'routes', {_var('dest')}, {_var('path')}, count(*) FROM {_R} GROUP BY ALL")
def is_var_profile(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for tab, name in (("policy", "policy_ct"), ("routes", "routes_ct")):
        got = spark_table(spark, d, name).groupBy(F.lit(tab).alias("tab"), is_var(F.col("dest")).alias("dest_var"), is_var(F.col("path")).alias("path_var")).agg(F.count("*").alias("n"))
        out = got if out is None else out.unionByName(got)
    return out


@_add("SELECT o_orderkey AS id, " + ", ".join(f"{_poss('=' if op == '==' else op, 'a', 'b')} AS {name}" for name, op in SQL_NAMES.items())
      + " FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'v1' WHEN o_orderkey % 7 = 1 THEN NULL ELSE (o_custkey % 13)::VARCHAR END AS a, CASE WHEN o_orderkey % 11 = 0 THEN 'w' ELSE (o_orderkey % 13)::VARCHAR END AS b FROM orders)")
def predicate_matrix(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    a = F.when(k % 7 == 0, "v1").when(k % 7 == 1, F.lit(None)).otherwise((F.col("o_custkey") % 13).cast("string"))
    b = F.when(k % 11 == 0, "w").otherwise((k % 13).cast("string"))
    return table(spark, d, "orders").select(k.alias("id"), *(possibly(op, a, b).alias(name) for name, op in SQL_NAMES.items()))


# routes

_HOPS = "CASE WHEN path = '_' THEN 0 ELSE len(string_split(path, ' ')) END"
_POL = f"(SELECT dest, 'x' || min(rid)::VARCHAR AS path, (max(len_path) - 1)::INT AS min_len, list_value('l(x' || min(rid)::VARCHAR || ') <= ' || (max(len_path) - 1)::VARCHAR) AS condition FROM {_A} WHERE st = 'F' GROUP BY dest)"
_DEL = f"(SELECT dest, 'A' AS operation, path, len_path FROM {_A} WHERE st = 'O')"
_UPD = f"""(SELECT p.dest, p.path, CASE WHEN min_len > m THEN m ELSE min_len END AS min_len, CASE WHEN min_len > m THEN list_value('l(' || p.path || ') <= ' || m::VARCHAR) ELSE condition END AS condition
  FROM {_POL} p LEFT JOIN (SELECT dest, min(len_path) AS m FROM {_DEL} GROUP BY dest) d ON p.dest = d.dest)"""
_CUR = f"(SELECT dest, min(path) AS path, 4 AS min_len FROM {_A} WHERE st = 'F' GROUP BY dest)"
_NEW = f"(SELECT dest, path, min_len AS len_path FROM {_CUR} WHERE dest IN (SELECT dest FROM {_DEL}) UNION SELECT dest, path, len_path FROM {_DEL})"
_BEST = f"""(SELECT p.dest, p.path, min_len, p.path || ' == ' || n.path AS c1, 'l(' || p.path || ') == ' || ({_HOPS.replace("path", "n.path")})::VARCHAR AS c2, n.path AS value
  FROM {_UPD} p JOIN {_NEW} n ON p.dest = n.dest WHERE {_HOPS.replace("path", "n.path")} <= regexp_extract(p.condition[1], '<= (.*)', 1)::INT)"""


def _policy(spark: SparkSession, d: str) -> DataFrame:
    a = spark_table(spark, d, "asroutes").where("st = 'F'").groupBy("dest").agg(F.concat(F.lit("x"), F.min("rid")).alias("path"), (F.max("len_path") - 1).alias("min_len"))
    return a.select("dest", "path", "min_len", F.array(F.concat(F.lit("l("), "path", F.lit(") <= "), "min_len")).alias("condition"))


def _delta(spark: SparkSession, d: str) -> DataFrame:
    return spark_table(spark, d, "asroutes").where("st = 'O'").select("dest", F.lit("A").alias("operation"), "path", "len_path")


def _current(spark: SparkSession, d: str) -> DataFrame:
    return spark_table(spark, d, "asroutes").where("st = 'F'").groupBy("dest").agg(F.min("path").alias("path"), F.lit(4).alias("min_len"))


@_add(f"SELECT rid, ({_HOPS})::INT AS hops FROM {_A}")
def path_len(spark: SparkSession, d: str) -> DataFrame:
    return spark_table(spark, d, "asroutes").select("rid", hops(F.col("path")).cast("int").alias("hops"))


@_add(f"SELECT dest, count(*) AS n, min({_HOPS})::INT AS min_hops FROM {_A} GROUP BY dest")
def spath_by_dest(spark: SparkSession, d: str) -> DataFrame:
    return routing.shortest_by_dest(spark_table(spark, d, "asroutes"))


@_add(f"SELECT a.rid, a.dest, a.path FROM {_A} a JOIN (SELECT dest, min({_HOPS}) AS m FROM {_A} GROUP BY dest) m ON a.dest = m.dest AND {_HOPS.replace('path', 'a.path')} = m")
def spath_routes(spark: SparkSession, d: str) -> DataFrame:
    """The routes as short as their dest's shortest."""
    a = spark_table(spark, d, "asroutes")
    return a.join(routing.shortest_by_dest(a), "dest").where(hops(F.col("path")) == F.col("min_hops")).select("rid", "dest", "path")


@_add(f"SELECT dest, path, min_len, condition[1] AS condition FROM {_UPD}")
def bgp_update_policy(spark: SparkSession, d: str) -> DataFrame:
    u = routing.update_policy(_policy(spark, d), _delta(spark, d))
    return u.withColumn("condition", F.get("condition", F.lit(0)))


@_add(f"SELECT * FROM {_NEW}")
def bgp_new_candidates(spark: SparkSession, d: str) -> DataFrame:
    return routing.new_candidates(_current(spark, d), _delta(spark, d))


@_add(f"SELECT dest, path, min_len, array_to_string(list_sort(list_value(c1, c2)), '; ') AS condition FROM {_BEST}")
def bgp_best_routes(spark: SparkSession, d: str) -> DataFrame:
    new = routing.update_policy(_policy(spark, d), _delta(spark, d))
    return _flat(routing.best_routes(new, routing.new_candidates(_current(spark, d), _delta(spark, d))))


@_add(f"SELECT dest, value AS path, min_len FROM {_BEST}")
def c_extend_values(spark: SparkSession, d: str) -> DataFrame:
    return routing.bgp_step(_policy(spark, d), _current(spark, d), _delta(spark, d))[1]


_SEEN = f"(SELECT dest, CASE WHEN k <= 60 THEN 'x' WHEN k <= 120 THEN 'y' ELSE 'z' END AS cls, CASE WHEN k <= 60 THEN k WHEN k <= 120 THEN k - 60 ELSE k - 120 END AS k FROM (SELECT dest, row_number() OVER (ORDER BY min(rid), dest) AS k FROM {_A} GROUP BY dest) WHERE k <= 180)"
_SIZES = (60, 60, 60)


def _rib(spark: SparkSession, d: str) -> DataFrame:
    return spark_table(spark, d, "asroutes").select(F.col("rid").alias("seq"), "dest", "path")


@_add(f"SELECT dest, cls, k::INT AS k FROM {_SEEN}")
def rib_first_n(spark: SparkSession, d: str) -> DataFrame:
    return routing.first_seen(_rib(spark, d), _SIZES)


@_add(f"""
  SELECT s.dest, CASE cls WHEN 'x' THEN 'x' || (2 * k - 1)::VARCHAR WHEN 'y' THEN 'y' || k::VARCHAR ELSE 'z2' END AS path, CASE cls WHEN 'x' THEN min({_HOPS.replace("path", "a.path")}) ELSE -1 END::INT AS min_len,
    CASE cls WHEN 'x' THEN 'l(x' || (2 * k - 1)::VARCHAR || ') <= ' || min({_HOPS.replace("path", "a.path")})::VARCHAR WHEN 'y' THEN 'y' || k::VARCHAR || ' == ' || arg_min(a.path, rid) ELSE 'z2 == nopath' END AS condition
  FROM {_SEEN} s JOIN {_A} a ON s.dest = a.dest GROUP BY s.dest, cls, k""")
def rib_policies(spark: SparkSession, d: str) -> DataFrame:
    return routing.synthesize(_rib(spark, d), _SIZES)[0].withColumn("condition", F.get("condition", F.lit(0)))


@_add(f"""
  SELECT DISTINCT s.dest, a.path, (min({_HOPS.replace("path", "a.path")}) OVER (PARTITION BY s.dest))::INT AS min_len FROM {_SEEN} s JOIN {_A} a ON s.dest = a.dest WHERE cls = 'x'
  UNION ALL SELECT s.dest, a.path, -1 FROM {_SEEN} s JOIN {_A} a ON s.dest = a.dest WHERE cls = 'y'
  UNION ALL SELECT s.dest, arg_min(a.path, rid), -1 FROM {_SEEN} s JOIN {_A} a ON s.dest = a.dest WHERE cls = 'z' GROUP BY s.dest""")
def rib_candidates(spark: SparkSession, d: str) -> DataFrame:
    return routing.synthesize(_rib(spark, d), _SIZES)[1]


@_add(f"SELECT DISTINCT dest, CASE WHEN st = 'O' THEN 'A' ELSE 'W' END AS operation, path, ({_HOPS})::INT AS len_path FROM {_A} WHERE st <> 'F' AND dest IN (SELECT dest FROM {_SEEN})")
def rib_announcements(spark: SparkSession, d: str) -> DataFrame:
    a = spark_table(spark, d, "asroutes").where("st <> 'F'").select(F.when(F.col("st") == "O", "BGP4MP|A").otherwise("BGP4MP|W").alias("k"), "dest", "path")
    return routing.announcements(a.select(F.get(F.split("k", r"\|"), F.lit(1)).alias("kind"), "dest", "path"), routing.first_seen(_rib(spark, d), _SIZES))


@_add("SELECT '10.0.' || (i // 127)::VARCHAR || '.' || (i % 127)::VARCHAR AS dest, p AS path FROM range(500) t(i), (VALUES ('[ABC]'), ('[ADEC]')) v(p)")
def synthetic_routing(spark: SparkSession, d: str) -> DataFrame:
    return synthetic_routes(spark, 500).drop("condition")


# topology and paths

_HALF = duck("tp_half")
_RM = duck("rm")


def _tp(spark: SparkSession, d: str) -> DataFrame:
    return topology.both_ways(spark_table(spark, d, "tp_half")).withColumn("isactive", F.lit(1)).withColumn("bw", F.lit(None).cast("int"))


@_add(f"SELECT sid, nid, ishost, 1 AS isactive, CAST(NULL AS INT) AS bw FROM {_HALF} UNION SELECT nid, sid, ishost, 1, NULL FROM {_HALF}")
def topo_links(spark: SparkSession, d: str) -> DataFrame:
    return _tp(spark, d)


@_add("SELECT s_suppkey + 1000000 AS id FROM supplier UNION SELECT c_custkey + 2000000 FROM customer UNION SELECT s_suppkey + 1000000 FROM supplier")
def topo_nodes_union(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id")), table(spark, d, "customer").select((F.col("c_custkey") + 2000000).alias("id"))
    return s.union(c).union(s).distinct()


@_add(f"SELECT sid, nid, (row_number() OVER (PARTITION BY sid ORDER BY nid) - CASE WHEN sid < 1000000 THEN 0 ELSE 1 END)::INT AS port FROM (SELECT sid, nid FROM {_HALF} UNION SELECT nid, sid FROM {_HALF})")
def topo_ports(spark: SparkSession, d: str) -> DataFrame:
    return topology.next_ports(_tp(spark, d), F.col("sid") < 1000000, "nid")


_PAIRS = f"(SELECT fid, src, dst FROM {_RM} WHERE src IN (SELECT c_custkey + 2000000 FROM customer) AND dst IN (SELECT s_suppkey + 1000000 FROM supplier))"
# the tree is region over nation over hosts: the path is known from the ends' nations
_PV = f"""(SELECT p.fid, p.src, p.dst, CASE WHEN c_nationkey = s_nationkey THEN list_value(src, c_nationkey + 10, dst)
    WHEN a.n_regionkey = b.n_regionkey THEN list_value(src, c_nationkey + 10, a.n_regionkey + 1, s_nationkey + 10, dst)
    ELSE list_value(src, c_nationkey + 10, a.n_regionkey + 1, 0, b.n_regionkey + 1, s_nationkey + 10, dst) END::BIGINT[] AS pv
  FROM {_PAIRS} p JOIN customer ON c_custkey + 2000000 = src JOIN supplier ON s_suppkey + 1000000 = dst JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey)"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer").select((F.col("c_custkey") + 2000000).alias("src")), table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("dst"))
    rm = spark_table(spark, d, "rm").select("fid", "src", "dst").join(c, "src", "left_semi").join(s, "dst", "left_semi")
    return graph.shortest_paths(_tp(spark, d), rm)


@_add(f"SELECT fid, src, dst, array_to_string(pv, ' ') AS pv FROM {_PV}")
def sp_tree_path(spark: SparkSession, d: str) -> DataFrame:
    p = _paths(spark, d)
    return p.select("fid", "src", "dst", F.array_join(F.transform("pv", lambda x: x.cast("string")), " ").alias("pv"))


_TRI = f"(SELECT fid, pv[i] AS pid, pv[i + 1] AS sid, pv[i + 2] AS nid FROM (SELECT fid, pv, unnest(range(1, len(pv) - 1)) AS i FROM {_PV}))"


@_add(f"SELECT * FROM {_TRI}")
def cf_triples(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_triples(_paths(spark, d))


@_add(f"SELECT fid, CASE WHEN i > 0 THEN pv[i] END AS pid, pv[i + 1] AS sid, pv[i + 2] AS nid FROM (SELECT fid, pv, unnest(range(0, len(pv) - 1)) AS i FROM {_PV})")
def cf_entries(spark: SparkSession, d: str) -> DataFrame:
    return graph.path_entries(_paths(spark, d))


_OLD = f"(SELECT * FROM {_TRI} WHERE fid % 4 <> 0 UNION ALL SELECT fid, pid, sid, nid + 1 FROM {_TRI} WHERE fid % 4 = 0)"


def _installed(t: DataFrame) -> DataFrame:
    return t.select("fid", "pid", "sid", F.when(F.col("fid") % 4 == 0, F.col("nid") + 1).otherwise(F.col("nid")).alias("nid"))


@_add(f"SELECT * FROM {_TRI} EXCEPT SELECT * FROM {_OLD}")
def cf_ins(spark: SparkSession, d: str) -> DataFrame:
    t = materialize(graph.path_triples(_paths(spark, d)), "triples")
    return graph.difference(t, _installed(t))[0]


@_add(f"SELECT * FROM {_OLD} EXCEPT SELECT * FROM {_TRI}")
def cf_del(spark: SparkSession, d: str) -> DataFrame:
    t = materialize(graph.path_triples(_paths(spark, d)), "triples")
    return graph.difference(t, _installed(t))[1]


@_add("""
  WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
  w(s, hops) USING KEY (s) AS (SELECT 1::BIGINT, 0 UNION SELECT b.s, min(w.hops) + 2 FROM w JOIN e a ON a.s = w.s JOIN e b ON b.p = a.p WHERE b.s NOT IN (SELECT s FROM recurring.w) GROUP BY b.s)
  SELECT s + 1000000 AS node, hops::INT AS hops FROM w""")
def sp_hops_bfs(spark: SparkSession, d: str) -> DataFrame:
    """Links between supplier 1 and every supplier that can be reached, over shared parts."""
    e = table(spark, d, "lineitem").select((F.col("l_suppkey") + 1000000).alias("sid"), (F.col("l_partkey") + 3000000).alias("nid"), F.lit(1).alias("isactive")).distinct()
    pairs = e.select("sid").distinct().select(F.col("sid").alias("fid"), F.lit(1000001).cast("long").alias("src"), F.col("sid").alias("dst"))
    p = graph.shortest_paths(e, pairs)
    return p.where(F.size("pv") > 0).select(F.col("dst").alias("node"), (F.size("pv") - 1).alias("hops"))


@_add(f"SELECT fid, src, dst FROM {_PV} WHERE list_contains(pv, 1) AND (list_contains(pv, 0))")
def reroute_down(spark: SparkSession, d: str) -> DataFrame:
    """Flows that lose their path when the link between the root and region 0 goes down: the tree has no other."""
    paths = materialize(_paths(spark, d), "paths")
    cf = graph.path_triples(paths)
    down = spark.createDataFrame([(0, 1)], "sid bigint, nid bigint")
    _, dele, ins = graph.reroute(_tp(spark, d), cf, paths.select("fid", "src", "dst"), down)
    lost = dele.select("fid").distinct().join(ins.select("fid").distinct(), "fid", "left_anti")
    return paths.join(lost, "fid", "left_semi").select("fid", "src", "dst")


@_add("SELECT min(x) AS next_id FROM range(1, (SELECT count(*) + 2 FROM orders)) t(x) WHERE x NOT IN (SELECT o_orderkey FROM orders)")
def next_free_id(spark: SparkSession, d: str) -> DataFrame:
    return graph.next_free(table(spark, d, "orders"), "o_orderkey")


@_add(f"""
  WITH t AS (SELECT sid, nid, ishost, 1 AS isactive FROM {_HALF} UNION SELECT nid, sid, ishost, 1 FROM {_HALF})
  SELECT sid, nid, CASE WHEN least(sid, nid) = 0 AND greatest(sid, nid) IN (1, 2) THEN 0 ELSE isactive END AS isactive FROM t UNION ALL SELECT * FROM (VALUES (3, 7777777, 1), (7777777, 3, 1))""")
def link_events(spark: SparkSession, d: str) -> DataFrame:
    # fixed values: two links go down, one comes back and goes again, one is new
    ev = spark.createDataFrame([(1, 0, 1, 0), (2, 2, 0, 0), (3, 0, 3, 0), (4, 3, 0, 1), (5, 3, 7777777, 1)], "seq long, sid long, nid long, up int")
    return graph.link_state(_tp(spark, d), ev).select("sid", "nid", "isactive")


# applications

_ACL = duck("acl")


@_add(f"SELECT fid FROM {_RM} WHERE fw = 1 AND (src, dst) NOT IN (SELECT end1, end2 FROM {_ACL})")
def fw_violation(spark: SparkSession, d: str) -> DataFrame:
    return apps.fw_violation(spark_table(spark, d, "rm"), spark_table(spark, d, "acl"))


@_add(f"SELECT fid, src, dst FROM {_RM} WHERE NOT coalesce(fw = 1 AND (src, dst) NOT IN (SELECT end1, end2 FROM {_ACL}), false)")
def fw_repair(spark: SparkSession, d: str) -> DataFrame:
    rm = spark_table(spark, d, "rm")
    return rm.join(apps.fw_violation(rm, spark_table(spark, d, "acl")), "fid", "left_anti").select("fid", "src", "dst")


_USERS = "(SELECT c_custkey + 2000000 AS uid FROM customer WHERE c_custkey % 3 = 0)"


def _users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_custkey % 3 = 0").select((F.col("c_custkey") + 2000000).alias("uid"))


def _acl(spark: SparkSession, d: str) -> DataFrame:
    return spark_table(spark, d, "acl").withColumn("allow", F.lit(1))


@_add(f"SELECT end1, end2, 1 AS allow FROM {_ACL} UNION ALL SELECT DISTINCT dst, src, 1 FROM {_RM} WHERE src IN (SELECT uid FROM {_USERS}) AND (src, dst) NOT IN (SELECT end2, end1 FROM {_ACL})")
def fw_learn(spark: SparkSession, d: str) -> DataFrame:
    return apps.learn(_acl(spark, d), _users(spark, d), spark_table(spark, d, "rm"))


_BACK = f"(SELECT DISTINCT dst AS end1, src AS end2 FROM {_RM})"


@_add(f"""
  SELECT end1, end2, 1 AS allow FROM {_BACK} WHERE (end1, end2) NOT IN (SELECT dst, src FROM {_RM} WHERE src IN (SELECT uid FROM {_USERS}) GROUP BY dst, src HAVING count(*) = count(*) FILTER (fid % 2 = 0))""")
def fw_forget(spark: SparkSession, d: str) -> DataFrame:
    """Even flows are removed; pairs of listed users that then have no flow are forgotten."""
    rm = spark_table(spark, d, "rm")
    acl = rm.select(F.col("dst").alias("end1"), F.col("src").alias("end2"), F.lit(1).alias("allow")).distinct()
    return apps.forget(acl, _users(spark, d), rm, rm.where("fid % 2 = 0"))


_RATES = duck("rates")


@_add(f"SELECT r.fid, rate AS req, vol AS asgn FROM {_RM} r JOIN {_RATES} p ON r.fid = p.fid WHERE rate > vol")
def rate_violation(spark: SparkSession, d: str) -> DataFrame:
    return apps.rate_violation(spark_table(spark, d, "rm"), spark_table(spark, d, "rates"))


@_add(f"SELECT r.fid, CASE WHEN rate > vol THEN rate ELSE vol END AS vol FROM {_RM} r LEFT JOIN {_RATES} p ON r.fid = p.fid")
def rate_repair(spark: SparkSession, d: str) -> DataFrame:
    return apps.rate_repair(spark_table(spark, d, "rm"), spark_table(spark, d, "rates")).select("fid", "vol")


_CHAINS, _MEMBERS = duck("chains"), duck("members")


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return spark_table(spark, d, "members").groupBy("gid").agg(F.sort_array(F.collect_list("sid")).alias("sid_array"))


@_add(f"SELECT a.sid AS sid1, b.sid AS sid2, mb FROM {_CHAINS} c JOIN {_MEMBERS} a ON a.gid = gid1 JOIN {_MEMBERS} b ON b.gid = gid2")
def chain_expand(spark: SparkSession, d: str) -> DataFrame:
    return apps.chain_pairs(spark_table(spark, d, "chains"), _groups(spark, d))


_CV = f"(SELECT fid, mb FROM {_RM} r JOIN {_MEMBERS} a ON a.sid = src JOIN {_MEMBERS} b ON b.sid = dst JOIN {_CHAINS} c ON gid1 = a.gid AND gid2 = b.gid WHERE (mb = 'FW' AND fw = 0) OR (mb = 'LB' AND lb = 0))"


@_add(f"SELECT * FROM {_CV}")
def chain_violation(spark: SparkSession, d: str) -> DataFrame:
    return apps.chain_violation(spark_table(spark, d, "rm"), spark_table(spark, d, "chains"), _groups(spark, d))


@_add(f"SELECT fid, CASE WHEN fid IN (SELECT fid FROM {_CV} WHERE mb = 'FW') THEN 1 ELSE fw END AS fw, CASE WHEN fid IN (SELECT fid FROM {_CV} WHERE mb = 'LB') THEN 1 ELSE lb END AS lb FROM {_RM}")
def chain_repair(spark: SparkSession, d: str) -> DataFrame:
    return apps.chain_repair(spark_table(spark, d, "rm"), spark_table(spark, d, "chains"), _groups(spark, d)).select("fid", "fw", "lb")


@_add(f"SELECT fid, pid, sid, nid FROM {_TRI} WHERE fid NOT IN (SELECT fid FROM {_TRI} WHERE sid = 1)")
def switch_repair(spark: SparkSession, d: str) -> DataFrame:
    return apps.switch_repair(graph.path_triples(_paths(spark, d)), 1)


_LOG = duck("rm_log")


@_add(f"SELECT fid, max(CASE WHEN isadd = 0 THEN 1 ELSE 0 END) = 1 AS deleted, arg_max(isadd, seq) = 1 AS added, CASE WHEN arg_max(isadd, seq) = 1 THEN arg_max(src, seq) END AS src, CASE WHEN arg_max(isadd, seq) = 1 THEN arg_max(dst, seq) END AS dst FROM {_LOG} GROUP BY fid")
def rm_net_change(spark: SparkSession, d: str) -> DataFrame:
    return apps.net_change(spark_table(spark, d, "rm_log"))


@_add(f"""
  WITH last AS (SELECT fid, arg_max(CASE WHEN isadd = 0 THEN 'D' ELSE 'I' END, seq) AS op, arg_max(src, seq) AS h1, arg_max(dst, seq) AS h2 FROM {_LOG} GROUP BY fid)
  SELECT fid, src, dst, vol FROM {_RM} WHERE fid NOT IN (SELECT fid FROM last) UNION ALL SELECT fid, h1, h2, 1 FROM last WHERE op <> 'D'""")
def urm_apply(spark: SparkSession, d: str) -> DataFrame:
    log = spark_table(spark, d, "rm_log").select("seq", F.when(F.col("isadd") == 0, "D").otherwise("I").alias("op"), "fid", F.col("src").alias("host1"), F.col("dst").alias("host2"))
    return apps.apply_urm(spark_table(spark, d, "rm"), log).select("fid", "src", "dst", "vol")


@_add(f"""
  WITH keep AS (SELECT fid FROM {_RM} WHERE NOT coalesce(fw = 1 AND (src, dst) NOT IN (SELECT end1, end2 FROM {_ACL}), false))
  SELECT t.fid, pid, sid, nid FROM {_TRI} t WHERE fid IN (SELECT fid FROM keep)""")
def orch_run_once(spark: SparkSession, d: str) -> DataFrame:
    """All flows wait as additions; the firewall runs before routing."""
    paths_src = table(spark, d, "customer").select((F.col("c_custkey") + 2000000).alias("src"))
    paths_dst = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("dst"))
    rm = spark_table(spark, d, "rm").join(paths_src, "src", "left_semi").join(paths_dst, "dst", "left_semi").select("fid", "src", "dst", "vol", "fw", "lb")
    s = apps.State.start(spark, _tp(spark, d), acl=_acl(spark, d))
    s = apps.insert_flows(s, rm).written()
    o = apps.Orchestrator()
    o.load("rt", "fw")
    return o.run(s).cf


@_add(f"""
  WITH m AS (SELECT t.fid, t.sid, 's' || t.sid::VARCHAR AS switch, '10.0.0.' || src::VARCHAR AS src_ip, '10.0.0.' || dst::VARCHAR AS dst_ip, (t.sid % 7)::INT AS outport, (t.pid % 7)::INT AS revport FROM {_TRI} t JOIN {_RM} r ON t.fid = r.fid)
  SELECT fid, sid, n, switch, CASE n WHEN 1 THEN src_ip WHEN 2 THEN dst_ip END AS nw_src, CASE n WHEN 1 THEN outport WHEN 2 THEN revport WHEN 5 THEN NULL ELSE 65531 END AS "out", CASE WHEN n < 3 THEN 10 WHEN n < 5 THEN 1 END AS priority
  FROM m, (VALUES (1), (2), (3), (4), (5)) v(n)""")
def flow_messages(spark: SparkSession, d: str) -> DataFrame:
    t = materialize(graph.path_triples(_paths(spark, d)), "triples")
    rm = spark_table(spark, d, "rm")
    out = t.join(rm.select("fid", "src", "dst"), "fid", "left").select("fid", "pid", "sid", "nid", F.concat(F.lit("s"), "sid").alias("switch"), F.lit(None).cast("string").alias("dpid"), F.concat(F.lit("10.0.0."), "src").alias("src_ip"), F.lit(None).cast("string").alias("src_mac"), F.concat(F.lit("10.0.0."), "dst").alias("dst_ip"), F.lit(None).cast("string").alias("dst_mac"), (F.col("sid") % 7).cast("int").alias("outport"), (F.col("pid") % 7).cast("int").alias("revport"))
    return apps.flow_messages(out).select("fid", "sid", "n", "switch", "nw_src", "out", "priority")


_SW = "(SELECT sid, any_value(dpid) AS dpid, any_value(ip) AS ip, max(name) AS name FROM switches GROUP BY sid)"
_HO = "(SELECT hid, max(ip) AS ip, max(lower(mac)) AS mac FROM hosts GROUP BY hid)"


@_add(f"""
  WITH c AS (SELECT DISTINCT fid, pid, sid, nid FROM cf WHERE fid IS NOT NULL), p AS (SELECT DISTINCT sid, nid, (nid % 48 + 1)::INT AS port FROM tp WHERE nid IS NOT NULL),
  r AS (SELECT fid, max(src) AS src, max(dst) AS dst FROM rm GROUP BY fid)
  SELECT c.fid, c.pid, c.sid, c.nid, s.name AS switch, a.ip AS src_ip, b.mac AS dst_mac, p1.port AS outport, p2.port AS revport
  FROM c LEFT JOIN p p1 ON p1.sid = c.sid AND p1.nid = c.nid LEFT JOIN p p2 ON p2.sid = c.sid AND p2.nid = c.pid LEFT JOIN r ON r.fid = c.fid
  LEFT JOIN {_SW} s ON s.sid = c.sid LEFT JOIN {_HO} a ON a.hid = r.src LEFT JOIN {_HO} b ON b.hid = r.dst""")
def flow_details(spark: SparkSession, d: str) -> DataFrame:
    cf = table(spark, d, "cf").where("fid is not null").select("fid", "pid", "sid", "nid").distinct()
    ports = table(spark, d, "tp").where("nid is not null").select("sid", "nid", (F.col("nid") % 48 + 1).cast("int").alias("port")).distinct()
    rm = table(spark, d, "rm").groupBy("fid").agg(F.max("src").alias("src"), F.max("dst").alias("dst"))
    sw = table(spark, d, "switches").groupBy("sid").agg(F.max("name").alias("name"), F.max("dpid").alias("dpid"))
    ho = table(spark, d, "hosts").groupBy("hid").agg(F.max("ip").alias("ip"), F.max(F.lower("mac")).alias("mac"))
    return apps.flow_details(cf, ports, rm, sw, ho).select("fid", "pid", "sid", "nid", "switch", "src_ip", "dst_mac", "outport", "revport")


@_add("SELECT event_type AS name, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS total FROM events GROUP BY ROLLUP (event_type)")
def profile_summary(spark: SparkSession, d: str) -> DataFrame:
    return apps.profile_summary(table(spark, d, "events").select(F.col("event_type").alias("name"), F.round(F.col("value") * 100).cast("long").alias("ms")))


@_add("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25")
def limit_watch(spark: SparkSession, d: str) -> DataFrame:
    """The first rows in order, as a watch shows them."""
    return watch(table(spark, d, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey"), 25)


@_add("SELECT s_suppkey AS sid, lpad(lower(to_hex(s_suppkey)), 12, '0') AS dpid, '10.' || (s_suppkey // 65536 % 256)::VARCHAR || '.' || (s_suppkey // 256 % 256)::VARCHAR || '.' || (s_suppkey % 256)::VARCHAR AS ip FROM supplier")
def addresses(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("sid"))
    return s.select("sid", topology.default_dpid(F.concat(F.lit("s"), "sid")).alias("dpid"), topology.host_ip(F.col("sid")).alias("ip"))


_MATRIX = ORACLE["predicate_matrix"]


@_add(_MATRIX)
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The comparisons as SQL functions."""
    register(spark)
    calls = ", ".join(f"{name}(a, b) AS {name}" for name in SQL_NAMES)
    text = f"""
      SELECT id, {calls} FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'v1' WHEN o_orderkey % 7 = 1 THEN NULL ELSE CAST(o_custkey % 13 AS STRING) END AS a,
        CASE WHEN o_orderkey % 11 = 0 THEN 'w' ELSE CAST(o_orderkey % 13 AS STRING) END AS b FROM {{orders}})"""
    return spark.sql(text, orders=table(spark, d, "orders"))


@_add(ORACLE["rm_net_change"])
def stream_net_change(spark: SparkSession, d: str) -> DataFrame:
    """The log of changes as a stream: each micro-batch adds its flows' state to a table, which is merged at the end."""
    schema = table(spark, d, "events").schema
    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(schema)
    stream = stream.parquet(path) if os.path.isdir(path) else stream.option("pathGlobFilter", "events.parquet").parquet(d)
    kind = F.when(F.col("event_type").isin("error", "purchase"), 0).otherwise(1)
    log = stream.select(F.col("event_id").alias("seq"), F.col("user_id").alias("fid"), (F.col("user_id") + 2000000).alias("src"), (F.col("event_id") % 10 + 1000000).alias("dst"), kind.alias("isadd"))
    return net_change_of_stream(log, f"{shared_dir(spark)}/condnet-stream-{uuid.uuid4().hex}")
