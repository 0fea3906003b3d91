"""The driver's business tables read as network tables, by one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from condnet.common import table

_TEXT = {
    "policy_ct": (
        "supplier",
        """
SELECT CASE WHEN s_suppkey % 50 = 7 THEN 'd' || CAST(s_suppkey AS STRING) ELSE '10.0.' || CAST(s_nationkey AS STRING) || '.0/24' END AS dest,
  CASE WHEN s_suppkey % 2 = 0 THEN 'x' || CAST(s_suppkey AS STRING) ELSE '[BUILDING]' END AS path,
  CASE WHEN s_suppkey % 4 = 0 THEN ARR('x' || CAST(s_suppkey AS STRING) || ' == [BUILDING]')
    WHEN s_suppkey % 4 = 2 THEN ARR('x' || CAST(s_suppkey AS STRING) || ' != [MACHINERY]', 'x' || CAST(s_suppkey AS STRING) || ' != [FURNITURE]')
    WHEN s_suppkey % 50 = 7 THEN ARR('d' || CAST(s_suppkey AS STRING) || ' != 10.0.3.0/24') ELSE EMPTY END AS condition
FROM {supplier}""",
    ),
    "routes_ct": ("customer", "SELECT '10.0.' || CAST(c_nationkey AS STRING) || '.0/24' AS dest, '[' || c_mktsegment || ']' AS path, CAST(c_custkey AS STRING) AS flag, EMPTY AS condition FROM {customer}"),
    "asroutes": (
        "orders",
        """
SELECT o_orderkey AS rid, o_orderstatus AS st, '10.1.' || CAST(o_custkey % 200 AS STRING) || '.0/24' AS dest,
  CAST(100 + o_orderkey % 37 AS STRING) || CASE WHEN o_orderkey % 4 >= 1 THEN ' ' || CAST(100 + (o_orderkey * 3) % 37 AS STRING) ELSE '' END
    || CASE WHEN o_orderkey % 4 >= 2 THEN ' ' || CAST(100 + (o_orderkey * 5) % 37 AS STRING) ELSE '' END
    || CASE WHEN o_orderkey % 4 >= 3 THEN ' ' || CAST(100 + (o_orderkey * 7) % 37 AS STRING) ELSE '' END AS path,
  CAST(o_orderkey % 4 + 1 AS INT) AS len_path
FROM {orders}""",
    ),
    "tp_half": (
        "region nation supplier customer",
        """
SELECT CAST(0 AS BIGINT) AS sid, CAST(r_regionkey + 1 AS BIGINT) AS nid, 0 AS ishost FROM {region}
UNION ALL SELECT CAST(n_regionkey + 1 AS BIGINT), CAST(n_nationkey + 10 AS BIGINT), 0 FROM {nation}
UNION ALL SELECT CAST(s_nationkey + 10 AS BIGINT), s_suppkey + 1000000, 1 FROM {supplier}
UNION ALL SELECT CAST(c_nationkey + 10 AS BIGINT), c_custkey + 2000000, 1 FROM {customer}""",
    ),
    "rm": (
        "orders",
        """
SELECT o_orderkey AS fid, o_custkey + 2000000 AS src, o_orderkey % 10 + 1000000 AS dst, CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 10 END AS INT) AS vol,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE NULL END AS fw, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE NULL END AS lb
FROM {orders}""",
    ),
    "acl": ("orders", "SELECT DISTINCT o_custkey + 2000000 AS end1, o_orderkey % 10 + 1000000 AS end2 FROM {orders} WHERE o_orderkey % 5 = 0"),
    "rates": ("orders", "SELECT o_orderkey AS fid, CAST(o_orderkey % 7 AS INT) AS rate FROM {orders} WHERE o_orderkey % 2 = 0"),
    "rm_log": (
        "events",
        """
SELECT event_id AS seq, user_id AS fid, user_id + 2000000 AS src, event_id % 10 + 1000000 AS dst, CASE WHEN event_type IN ('error', 'purchase') THEN 0 ELSE 1 END AS isadd
FROM {events}""",
    ),
    "chains": (
        "nation",
        "SELECT CAST(a.n_nationkey AS INT) AS gid1, CAST(b.n_nationkey + 100 AS INT) AS gid2, CASE WHEN (a.n_nationkey + b.n_nationkey) % 2 = 0 THEN 'FW' ELSE 'LB' END AS mb FROM {nation} a CROSS JOIN {nation} b",
    ),
    "members": (
        "customer supplier",
        """
SELECT CAST(c_nationkey AS INT) AS gid, c_custkey + 2000000 AS sid FROM {customer}
UNION ALL SELECT CAST(s_nationkey + 100 AS INT), s_suppkey + 1000000 FROM {supplier} WHERE s_suppkey < 10""",
    ),
}


def spark_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    names, text = _TEXT[name]
    text = text.replace("ARR(", "array(").replace("EMPTY", "cast(array() as array<string>)")
    return spark.sql(text, **{n: table(spark, d, n) for n in names.split()})


def duck(name: str) -> str:
    """The same as a subquery."""
    names, text = _TEXT[name]
    text = text.replace("ARR(", "list_value(").replace("EMPTY", "CAST([] AS VARCHAR[])")
    return "(" + text.format(**{n: n for n in names.split()}).strip() + ")"
