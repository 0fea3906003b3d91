"""Queries p1, p2, p7, p8 and p9 over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from condnet.common import dest_key, table
from condnet.llm.mixing import counted, mix, shares
from condnet.llm.runs import as_number, event_runs, packed_runs
from condnet.llm.subjects import areas
from condnet.llm.tokens import decode, encode
from condnet.llm.topn import bounds, nearest, ranked, within
from condnet.operators.packed import PATH


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    routes = table(spark, d, "routes").where("min_len >= 0").select(dest_key("dest").alias("dest"), "rid", "min_len", "path").where("dest is not null")
    best = table(spark, d, "current_best_routes").select(dest_key("dest").alias("dest"), "path", F.lit(0).alias("other")).where("dest is not null and path is not null").distinct()
    # bounds by length alone, as the other scores come after it
    dest, length, rid = F.col("dest"), F.col("min_len"), F.col("rid")
    left = within(routes, dest, [length], bounds(routes, dest, [length], rid, 3))
    # of one path of a dest only the three best can be among the dest's: a partition hands on no more, however many copies there are
    left = nearest(left, ["dest", "path"], ["min_len"], "rid", 3)
    top = ranked(left.join(best, ["dest", "path"], "left"), dest, [length, F.coalesce("other", F.lit(1))], rid, 3)
    return top.select(F.col("g").alias("dest"), F.col("i").alias("rid"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    # runs first, so that rows delivered again are told by their few runs, not by their paths
    runs = packed_runs(table(spark, d, "routes").where("rid is not null"), "rid", "path", PATH, as_number)
    return runs.groupBy(F.col("row_id").alias("rid"), "first_pos").agg(F.max("run_len").alias("run_len"))


def p2_event_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the same event type of a user in order of time, each with its count and duration."""
    runs = event_runs(table(spark, d, "events"), "user_id", "ts", "event_type", "event_id")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return runs.select("user_id", "event_type", us("first_at").alias("first_us"), (us("last_at") - us("first_at")).alias("duration_us"), "events")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """There and back: the digest of each text as decoded from its ids."""
    return decode(p7_ids(spark, d), "doc_id").select("doc_id", F.md5("text").alias("md5"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: each document used and how often."""
    return mix(counted(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares asked for and reached."""
    sizes, listed = counted(table(spark, d, "documents")), table(spark, d, "mix_targets")
    return shares(mix(sizes, listed), sizes, listed)


def _areas(spark: SparkSession, d: str) -> DataFrame:
    return areas(table(spark, d, "documents"), table(spark, d, "subject_examples"), table(spark, d, "subjects"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _areas(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each area has, and how many characters of text."""
    docs = table(spark, d, "documents").select("doc_id", F.char_length("text").alias("chars"))
    return _areas(spark, d).join(docs, "doc_id").groupBy("subject").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_event_runs, p7_ids, p7_decoded, p8_mix, p8_shares, p9_found, p9_composition)}

_KEY = "nullif(lower(trim(dest, ' \t')), '')"
ORACLE = {
    "p1_found": f"""
  WITH r AS (SELECT DISTINCT rid, {_KEY} AS dest, min_len, path FROM routes WHERE min_len >= 0),
  b AS (SELECT DISTINCT {_KEY} AS dest, path FROM current_best_routes WHERE path IS NOT NULL)
  SELECT r.dest, rid FROM r LEFT JOIN b ON r.dest = b.dest AND r.path = b.path WHERE r.dest IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY r.dest ORDER BY min_len, b.dest IS NULL, rid) <= 3""",
    "p2_found": r"""
  WITH r AS (SELECT rid, any_value(path) AS path FROM routes WHERE path <> '_' GROUP BY rid),
  h AS (SELECT rid, unnest(regexp_extract_all(path, '[A-Za-z0-9._:]+')) AS hop, unnest(range(1, len(regexp_extract_all(path, '[A-Za-z0-9._:]+')) + 1)) AS pos FROM r),
  n AS (SELECT rid, pos, CASE WHEN regexp_full_match(t, '[0-9]+') THEN t::BIGINT WHEN regexp_full_match(t, '[0-9]+\.[0-9]+') THEN split_part(t, '.', 1)::BIGINT * 65536 + split_part(t, '.', 2)::BIGINT END AS num
    FROM (SELECT *, regexp_replace(lower(hop), '^as', '') AS t FROM h)),
  g AS (SELECT *, pos - row_number() OVER (PARTITION BY rid, num ORDER BY pos) AS isle FROM n)
  SELECT rid, min(pos)::BIGINT AS first_pos, count(*) AS run_len FROM g GROUP BY rid, num, isle HAVING count(*) >= 2""",
    "p2_event_runs": """
  WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS isle
    FROM (SELECT DISTINCT user_id, ts, event_id, event_type FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL))
  SELECT user_id, event_type, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) - min(epoch_us(ts)) AS duration_us, count(*) AS events FROM e GROUP BY user_id, event_type, isle""",
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS md5 FROM documents",
}
