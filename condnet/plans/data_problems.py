"""Queries p3 to p6 over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condnet.common import dest_key, table
from condnet.operators.evenagg import heavy_keys, per_key
from condnet.operators.hierarchy import hierarchy
from condnet.operators.packed import CONDITION, PATH, once, split_packed
from condnet.operators.references import micros, orphans, parents


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for tab, row_id, value, how in (("routes", "rid", "path", PATH), ("bgp_policy", "polid", "condition", CONDITION)):
        got = split_packed(once(table(spark, d, tab), row_id, value), row_id, value, how).select(F.lit(tab).alias("tab"), F.col("row_id").cast("long").alias("row_id"), "pos", "val")
        out = got if out is None else out.unionByName(got)
    return out


def _routes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "routes").select("rid", dest_key("dest").alias("dest"), F.when(F.col("min_len") >= 0, F.col("min_len")).alias("min_len"), micros("seen_at").alias("seen_us"))


def _cf(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cf").select("cfid", "sid", "fid", micros("installed_at").alias("at_us"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    dests = heavy_keys(_routes(spark, d), "dest", "rid").select(F.lit("routes").alias("tab"), "key_val")
    return dests.unionByName(heavy_keys(_cf(spark, d), "sid", "cfid").select(F.lit("cf").alias("tab"), "key_val"))


def p4_dests(spark: SparkSession, d: str) -> DataFrame:
    """Per dest key: routes, known lengths, and when seen."""
    return per_key(_routes(spark, d), "dest", {"sum_len": ("min_len", "sum"), "min_len": ("min_len", "min"), "max_len": ("min_len", "max"), "first_seen_us": ("seen_us", "min"), "last_seen_us": ("seen_us", "max")}, row_id="rid")


def p4_switches(spark: SparkSession, d: str) -> DataFrame:
    """Per switch: forwarding rows, and when installed."""
    return per_key(_cf(spark, d), "sid", {"first_at_us": ("at_us", "min"), "last_at_us": ("at_us", "max")}, row_id="cfid")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "cf"), "fid", ["pid", "sid", "nid"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).where("on_cycle or depth > 16")
    return n.select(F.col("grp").alias("fid"), "node", "root", "depth")


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Every node of every flow with its path from the root, depth, root and all descendants."""
    n = hierarchy(table(spark, d, "cf"), "fid", ["pid", "sid", "nid"], full=True)
    return n.withColumnRenamed("grp", "fid")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """As p5_nodes, with path and descendants as text."""
    n = p5_nodes(spark, d)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return n.select("fid", "node", "root", "depth", "n_descendants", "on_cycle", text("path"), text("descendants"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    hosts = parents(table(spark, d, "hosts"), "hid", "added_at", "removed_at")
    switches = parents(table(spark, d, "switches"), "sid", "added_at", "removed_at")
    out = None
    for tab, row_id, fields, at, spans in (("rm", "fid", ["src", "dst"], "requested_at", hosts), ("cf", "cfid", ["sid"], "installed_at", switches), ("tp", "tpid", ["nid"], "seen_at", hosts.unionByName(switches))):
        got = orphans(table(spark, d, tab), spans, row_id, fields, at).select(F.lit(tab).alias("tab"), "*")
        out = got if out is None else out.unionByName(got)
    return out


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p6_periods(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, field and month."""
    return _orphans(spark, d).groupBy("tab", "field", "period").agg(F.count("*").alias("orphans"))


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p4_dests, p4_switches, p5_found, p5_nodes, p5_paths, p6_found, p6_periods)}

_VALUE = r"""Or\([^)]*\)|[a-z]\w*(?:\(\w+\))? (?:==|!=|<=|>=|<|>) (?:"[^"]*"|''[^'']*''|[0-9a-z.:/]+(?: [0-9]+)*)"""
_KEY = "nullif(lower(trim(dest, ' \t')), '')"
_ROUTES = f"(SELECT rid, min({_KEY}) AS dest, min(CASE WHEN min_len >= 0 THEN min_len END) AS min_len, min(epoch_us(seen_at)) AS seen_us FROM routes GROUP BY rid)"
_CF = "(SELECT cfid, min(sid) AS sid, min(epoch_us(installed_at)) AS at_us FROM cf GROUP BY cfid)"
_ORPHANS = """
  SELECT 'rm' AS tab, fid::BIGINT AS row_id, f.field, strftime(requested_at, '%Y-%m') AS period
  FROM rm, (VALUES ('src'), ('dst')) f(field)
  WHERE requested_at IS NOT NULL AND CASE field WHEN 'src' THEN src ELSE dst END IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hosts h
    WHERE h.hid = CASE field WHEN 'src' THEN src ELSE dst END AND (added_at IS NULL OR added_at <= requested_at) AND (removed_at IS NULL OR requested_at < removed_at))
  UNION SELECT 'cf', cfid, 'sid', strftime(installed_at, '%Y-%m') FROM cf
  WHERE installed_at IS NOT NULL AND sid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM switches s
    WHERE s.sid = cf.sid AND (added_at IS NULL OR added_at <= installed_at) AND (removed_at IS NULL OR installed_at < removed_at))
  UNION SELECT 'tp', tpid, 'nid', strftime(seen_at, '%Y-%m') FROM tp
  WHERE seen_at IS NOT NULL AND nid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT hid AS id, added_at, removed_at FROM hosts UNION ALL SELECT sid, added_at, removed_at FROM switches) s
    WHERE s.id = tp.nid AND (added_at IS NULL OR added_at <= seen_at) AND (removed_at IS NULL OR seen_at < removed_at))"""
_TREE = """
  WITH RECURSIVE e AS (
    SELECT DISTINCT fid::BIGINT AS fid, a::BIGINT AS a, b::BIGINT AS b
    FROM (SELECT fid, pid AS a, sid AS b FROM cf UNION ALL SELECT fid, sid, nid FROM cf) WHERE fid IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL),
  reach AS (SELECT fid, a, b FROM e UNION SELECT r.fid, r.a, e.b FROM reach r JOIN e ON r.fid = e.fid AND r.b = e.a),
  roots AS (SELECT DISTINCT fid, a AS root FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.fid = e.fid AND x.b = e.a)),
  walk AS (SELECT fid, root, root AS node, 0::BIGINT AS depth FROM roots
    UNION SELECT w.fid, w.root, e.b, w.depth + 1 FROM walk w JOIN e ON e.fid = w.fid AND e.a = w.node WHERE w.depth < 60),
  best AS (SELECT fid, node, min(depth) AS depth FROM walk GROUP BY ALL),
  found AS (SELECT b.fid, b.node, min(w.root) AS root, b.depth FROM best b JOIN walk w USING (fid, node, depth) GROUP BY ALL),
  cyc AS (SELECT DISTINCT fid, a AS node FROM reach WHERE a = b)"""
ORACLE = {
    "p3_found": rf"""
  WITH r AS (SELECT rid, any_value(path) AS path FROM routes GROUP BY rid), c AS (SELECT polid, any_value(condition) AS condition FROM bgp_policy GROUP BY polid),
  lists AS (SELECT 'routes' AS tab, rid AS row_id, list_filter(regexp_extract_all(path, '[A-Za-z0-9._:]+'), lambda x: x <> '_') AS vals FROM r
    UNION ALL SELECT 'bgp_policy', polid, flatten(list_transform(list_filter(condition, lambda e: e IS NOT NULL), lambda e: regexp_extract_all(e, '{_VALUE}'))) FROM c)
  SELECT tab, row_id, unnest(range(1, len(vals) + 1))::BIGINT AS pos, unnest(vals) AS val FROM lists WHERE len(vals) > 0""",
    "p4_found": f"""
  WITH r AS {_ROUTES}, c AS {_CF}
  SELECT 'routes' AS tab, dest AS key_val FROM r WHERE dest IS NOT NULL GROUP BY dest HAVING count(*) * 50 >= (SELECT count(*) FROM r)
  UNION ALL SELECT 'cf', sid::VARCHAR FROM c WHERE sid IS NOT NULL GROUP BY sid HAVING count(*) * 50 >= (SELECT count(*) FROM c)""",
    "p4_dests": f"SELECT dest, count(*) AS n, sum(min_len)::BIGINT AS sum_len, min(min_len)::BIGINT AS min_len, max(min_len)::BIGINT AS max_len, min(seen_us) AS first_seen_us, max(seen_us) AS last_seen_us FROM {_ROUTES} GROUP BY dest",
    "p4_switches": f"SELECT sid, count(*) AS n, min(at_us) AS first_at_us, max(at_us) AS last_at_us FROM {_CF} GROUP BY sid",
    "p5_found": _TREE
    + """
  SELECT fid, node, -1::BIGINT AS root, -1::BIGINT AS depth FROM cyc
  UNION ALL SELECT fid, node, root, depth FROM found WHERE depth > 16 AND NOT EXISTS (SELECT 1 FROM cyc c WHERE c.fid = found.fid AND c.node = found.node)""",
    "p5_paths": _TREE
    + """,
  up AS (SELECT f.fid, f.node, min(e.a) AS up FROM found f JOIN e ON e.fid = f.fid AND e.b = f.node JOIN found p ON p.fid = e.fid AND p.node = e.a AND p.root = f.root AND p.depth = f.depth - 1 GROUP BY ALL),
  p AS (SELECT fid, node, [node] AS path FROM found WHERE depth = 0 UNION ALL SELECT up.fid, up.node, list_append(p.path, up.node) FROM up JOIN p ON p.fid = up.fid AND p.node = up.up),
  below AS (SELECT fid, a AS node, count(*) AS n, string_agg(node::VARCHAR, ' ' ORDER BY node) AS descendants FROM (SELECT fid, node, unnest(path[:-2]) AS a FROM p) GROUP BY ALL)
  SELECT n.fid, n.node, CASE WHEN c.node IS NOT NULL THEN -1 ELSE f.root END AS root, CASE WHEN c.node IS NOT NULL THEN -1 ELSE f.depth END AS depth, coalesce(b.n, 0) AS n_descendants, c.node IS NOT NULL AS on_cycle,
    coalesce(array_to_string(p.path, ' '), '') AS path, coalesce(b.descendants, '') AS descendants
  FROM (SELECT fid, a AS node FROM e UNION SELECT fid, b FROM e) n LEFT JOIN found f ON f.fid = n.fid AND f.node = n.node LEFT JOIN cyc c ON c.fid = n.fid AND c.node = n.node
  LEFT JOIN p ON p.fid = n.fid AND p.node = n.node LEFT JOIN below b ON b.fid = n.fid AND b.node = n.node""",
    "p6_found": _ORPHANS,
    "p6_periods": f"SELECT tab, field, period, count(*) AS orphans FROM ({_ORPHANS}) GROUP BY ALL",
}
