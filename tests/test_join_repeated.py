import random

import pytest
from pyspark.sql import functions as F

from condnet.operators.algebra import c_join, c_join_data, natural_join
from condnet.operators.sqlfront import query
from tests.test_ctables import ct

ON = [("dest", "==", "dest"), ("path", "==", "path")]


@pytest.fixture
def policy(spark):
    return ct(spark, [(f"d{i}", "[A]", [f"d{i} != 2"]) if i % 5 == 0 else (str(i % 4), f"x{i}" if i % 2 else "[A]", [f"x{i} == [A]"] if i % 3 == 0 else []) for i in range(30)], ["dest", "path"])


@pytest.fixture
def routes(spark):
    rnd = random.Random(11)
    cell = lambda *c: rnd.choice(c)
    return ct(spark, [(cell("0", "1", "2", "y", None), cell("[A]", "[B]"), str(k // 2), cell([], [], None, ["k == 1"])) for k in range(600)], ["dest", "path", "flag"])


def rows(df):
    return sorted(map(repr, df.collect()))


def shares(df):
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


def on_top(df):
    """The operators of the plan, from the result down to the first join."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return text[: text.index("Join")]


def test_join_data_of_repeated_cells_in_parts(spark, policy, routes):
    """Many routes share the path that all policies of a variable dest are joined by: they come out in parts, not all in one task."""
    got = c_join_data(policy, routes, ON)
    assert rows(got) == rows(c_join_data(policy, routes, ON, split=False))
    wild, alike = policy.where("dest like 'd%'"), routes.where("path = '[A]' and dest in ('0', '1', '2')").withColumn("dest", F.lit("1"))
    assert shares(c_join_data(wild, alike, ON)) < 0.9
    one = routes.select("dest", "path", "condition")
    assert rows(c_join_data(policy, one, ON)) == rows(c_join_data(policy, one, ON, split=False))


def test_join_data_of_one_key_in_many_parts(spark, policy):
    """A key that thousands of rows share is joined in more than eight parts, for as many tasks as there are."""
    key = policy.where("dest = '0' and path = '[A]'")
    many = ct(spark, [("0", "[A]", str(k), []) for k in range(5000)], ["dest", "path", "flag"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = c_join_data(key, many, ON)
        assert got.count() == 5000 * key.count() > 0
        assert got.select("r_flag").distinct().count() == 5000
        assert shares(got) < 1 / 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("solve", [True, False])
def test_conditions_of_repeated_cells_once(spark, policy, routes, solve):
    """Conditions are made, decided and shown below the join that brings in the rows."""
    shown = lambda c: F.array_join(F.sort_array(c), "; ")
    want = c_join(policy, routes, ON, split=False, solve=solve)
    got = c_join(policy, routes, ON, solve=solve)
    assert rows(got) == rows(want)
    text = c_join(policy, routes, ON, solve=solve, shown=shown)
    assert rows(text) == rows(want.withColumn("condition", shown(F.col("condition"))))
    for df in (got, text):
        assert not any(x in on_top(df) for x in ("ArrowEvalPython", "array_append", "sort_array"))
    assert got.columns == want.columns and got.dtypes == want.dtypes


def test_natural_join_and_query_text_of_repeated_cells_once(spark, policy, routes):
    text = query("SELECT * FROM policy, routes WHERE policy.dest = routes.dest AND policy.path = routes.path", {"policy": policy, "routes": routes})
    for df, op in ((natural_join(policy, routes), "=="), (text, "=")):
        assert rows(df) == rows(c_join(policy, routes, [(a, op, b) for a, _, b in ON], split=False))
        assert "ArrowEvalPython" not in on_top(df)


def test_repeated_cells_of_other_types(spark):
    """Cells that are equal but differ as text are not joined as one."""
    a = spark.createDataFrame([("x", 0.0), ("1", 1.0)], "p string, q double")
    b = spark.createDataFrame([("1", z, i) for i in range(20) for z in (0.0, -0.0)], "p string, q double, n int")
    got = c_join(a, b, [("p", "==", "p"), ("q", "<=", "q")], solve=False)
    assert rows(got) == rows(c_join(a, b, [("p", "==", "p"), ("q", "<=", "q")], split=False, solve=False))
