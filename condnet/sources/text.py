"""Text sources and sinks: routing tables, updates, topology files, SQL and command scripts, demo tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(seq, kind, dest, path): pipe-separated routing records, field 3 the kind, 6 the prefix, 7 the path (braces dropped). seq orders lines within a file, and files by name."""
    t = spark.read.text(path)
    f = F.split("value", r"\|")
    seq = F.struct(F.input_file_name(), F.monotonically_increasing_id())
    return t.where(F.size(f) >= 6).select(seq.alias("seq"), F.get(f, F.lit(2)).alias("kind"), F.get(f, F.lit(5)).alias("dest"), F.regexp_replace(F.coalesce(F.get(f, F.lit(6)), F.lit("")), "[{}]", "").alias("path"))


def read_isp(spark: SparkSession, folder: str, number: int | str) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of an ISP topology given as <number>_nodes.txt and <number>_edges.txt; links once whatever their direction, none to itself."""
    nodes = spark.read.text(f"{folder}/{number}_nodes.txt").select(F.trim("value").alias("node")).where("node <> ''").distinct()
    pair = F.split(F.trim("value"), r"\s+")
    e = spark.read.text(f"{folder}/{number}_edges.txt").select(F.get(pair, F.lit(0)).alias("a"), F.get(pair, F.lit(1)).alias("b")).where("a is not null and b is not null and a <> b")
    return nodes, e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def statements(text: str) -> list[str]:
    """The statements of an SQL script: cut at semicolons outside quotes, -- and /* */ comments dropped."""
    out, buf, i, quote = [], "", 0, ""
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif text.startswith("--", i):
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
            continue
        elif text.startswith("/*", i):
            i = text.find("*/", i) + 2 if "*/" in text[i:] else len(text)
            continue
        elif c in "'\"`":
            quote = c
        elif c == ";":
            out.append(buf.strip())
            buf, i = "", i + 1
            continue
        buf += c
        i += 1
    return [s for s in [*out, buf.strip()] if s]


def run_sql(spark: SparkSession, text: str) -> DataFrame | None:
    """Run a script's statements in order; the last one's result."""
    got = None
    for s in statements(text):
        got = spark.sql(s)
    return got


def run_commands(lines: Iterable[str], do: Callable[[str], object]) -> list:
    """Run each command of a script; blank lines and # comments are skipped."""
    return [do(x) for x in (line.strip() for line in lines) if x and not x.startswith("#")]


def synthetic_routes(spark: SparkSession, n: int) -> DataFrame:
    """Two routes for each of n prefixes 10.0.<i // 127>.<i % 127>: [ABC] and [ADEC]."""
    i = F.col("id")
    dest = F.concat(F.lit("10.0."), F.floor(i / 127), F.lit("."), i % 127)
    return spark.range(n).select(dest.alias("dest"), F.explode(F.array(F.lit("[ABC]"), F.lit("[ADEC]"))).alias("path"), F.array().cast("array<string>").alias("condition"))


def watch(df: DataFrame, n: int | None = None) -> DataFrame:
    """The first n rows, or all."""
    return df if n is None else df.limit(n)


def show(df: DataFrame, n: int = 20) -> str:
    """Rows as a text table."""
    rows = [[str(x) for x in r] for r in df.limit(n).collect()]
    width = [max(map(len, c)) for c in zip(df.columns, *rows)]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in width]), *map(line, rows)])


#: The demo candidates, paths by prefix and least length.
CANDIDATES = {
    ("1.6.4.0/22", 2): [
        "3303 6453 9583", "23673 9583", "20912 3257 1299 9583", "8492 31133 174 9583", "3561 209 3356 1299 9583", "7018 1299 9583", "31019 43531 9583", "34224 6453 9583", "37100 6461 7473 9583", "3549 3356 1299 9583",
        "3130 2914 1299 9583", "2152 7473 9583", "293 3320 9583", "6939 9583", "2497 3491 9583", "53767 14315 6453 6453 9583", "3257 1299 9583", "701 3320 9583", "5413 6461 7473 9583", "22652 6461 7473 9583", "3741 174 9583",
        "7660 4635 3491 3491 9583", "2914 3491 9583", "24441 3491 3491 9583", "1221 4637 3320 9583", "11686 174 9583", "20130 6939 9583", "57866 6461 7473 9583", "49788 1299 9583", "18106 9583", "1403 1299 9583",
        "3549 3356 174 9583", "1299 9583", "3130 1239 6453 9583",
    ],
    ("1.6.68.0/22", 2): [
        "3303 6453 9583", "23673 3491 174 9583", "20912 3257 1299 9583", "8492 31133 174 9583", "3561 209 3356 1299 9583", "7018 1299 9583", "31019 43531 9583", "34224 6453 9583", "37100 6453 9583", "3130 2914 1299 9583",
        "22652 6453 9583", "293 3320 9583", "6939 9583", "3549 3356 1299 9583", "2914 6453 9583", "53767 14315 6453 6453 9583", "3257 1299 9583", "701 3320 9583", "49788 1299 9583", "5413 1299 9583", "7660 2516 3320 9583",
        "2497 6453 9583", "3741 174 9583", "57866 1299 9583", "2152 3356 6453 9583", "24441 3491 3491 6453 9583", "1221 4637 3320 9583", "11686 174 9583", "20130 6939 9583", "18106 6939 9583", "1403 1299 9583",
        "3549 3356 174 9583", "1299 9583", "3130 1239 6453 9583",
    ],
    ("1.6.188.0/24", -1): [
        "3303 6453 9583", "23673 3491 174 9583", "20912 3257 1299 9583", "8492 31133 174 9583", "3561 209 3356 1299 9583", "7018 1299 9583", "31019 43531 9583", "34224 6453 9583", "37100 6453 9583", "49788 1299 9583",
        "3130 2914 1299 9583", "22652 6453 9583", "293 3320 9583", "6939 9583", "3549 3356 1299 9583", "2914 6453 9583", "53767 14315 6453 6453 9583", "3257 1299 9583", "701 3320 9583", "5413 1299 9583", "7660 2516 3320 9583",
        "2497 6453 9583", "3741 174 9583", "57866 1299 9583", "2152 3356 6453 9583", "24441 3491 3491 6453 9583", "1221 4637 3320 9583", "11686 174 9583", "20130 6939 9583", "18106 6939 9583", "1403 1299 9583",
        "3549 3356 174 9583", "1299 9583", "3130 2914 1299 9583",
    ],
    ("1.22.208.0/24", -1): [
        "3303 9498 45528",
    ],
}


def demo(spark: SparkSession) -> dict[str, DataFrame]:
    """Small tables to try things on: policies, routes and announcements; conditional tables and instances of them."""
    # fixed values: the demo rows
    policy = [("1.6.68.0/22", "x579", 2, ["l(x579) <= 2"]), ("1.6.4.0/22", "x531", 2, ["l(x531) <= 2"]), ("1.6.188.0/24", "y5", -1, ["y5 == 3303 6453 9583"]), ("1.22.208.0/24", "z2", -1, ["z2 == nopath"])]
    current = [("1.6.188.0/24", "3303 6453 9583", -1), ("1.6.4.0/22", "23673 9583", 2), ("1.6.68.0/22", "6939 9583", 2)]
    delta = [
        ("1.6.68.0/22", "A", "3130 2914 1299 9583", 4), ("1.6.68.0/22", "A", "9583", 1), ("1.6.4.0/22", "A", "3130 2914 1299 9583", 4),
        ("1.6.188.0/24", "A", "2914 6453 9583", 3), ("1.22.208.0/24", "A", "3130 2914 1299 9498 45528", 5),
    ]
    ctable = "dest string, path string, condition array<string>"
    return {
        "bgp_policy": spark.createDataFrame(policy, "dest string, path string, min_len int, condition array<string>"),
        "routes": spark.createDataFrame([(d, p, n) for (d, n), paths in CANDIDATES.items() for p in paths], "dest string, path string, min_len int"),
        "current_best_routes": spark.createDataFrame(current, "dest string, path string, min_len int"),
        "routes_delta": spark.createDataFrame(delta, "dest string, operation string, path string, len_path int"),
        "policy1": spark.createDataFrame([("1.2.3.4", "x", ["x == [ABC]"]), ("y", "z", ["y != 1.2.3.5", "y != 1.2.3.4"])], ctable),
        "policy2": spark.createDataFrame([("1.2.3.4", "[ABC]", "u", ["u == 1"]), ("5.6.7.8", "[ABC]", "u", ["u != 1"]), ("1.2.3.4", "[AC]", "v", ["v == 1"]), ("5.6.7.8", "[AC]", "v", ["v != 1"])], "dest string, path string, flag string, condition array<string>"),
        "policy3": spark.createDataFrame([("1.2.3.4", "x", ["x == [ADC]"])], ctable),
        "routing": spark.createDataFrame([("1.2.3.4", "[ABC]", []), ("1.2.3.4", "[AC]", []), ("1.2.3.5", "[ADC]", []), ("5.6.7.8", "[ABC]", []), ("5.6.7.8", "[AC]", [])], ctable),
        "instance1": spark.createDataFrame([("1.2.3.4", "[ABC]", ["[ABC] == [ABC]"]), ("5.6.7.8", "[AC]", ["5.6.7.8 != 1.2.3.5", "5.6.7.8 != 1.2.3.4"])], ctable),
        "instance2": spark.createDataFrame([("1.2.3.4", "[AC]", ["[AC] == [ABC]"]), ("1.2.3.5", "[ADC]", ["1.2.3.5 != 1.2.3.5", "1.2.3.5 != 1.2.3.4"])], ctable),
    }


def write_lines(lines: DataFrame, path: str) -> str:
    """Write a column of text as lines of the files of a folder."""
    lines.write.mode("overwrite").text(path)
    return path


def load(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at a path by df, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def output(df: DataFrame, name: str = "output") -> DataFrame:
    """Keep a result as the view of a name, replaced by the next one."""
    df.createOrReplaceTempView(name)
    return df
