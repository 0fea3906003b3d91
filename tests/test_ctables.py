import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from condnet.operators import solver
from condnet.operators.algebra import Or, Pred, c_join, c_join_data, c_project, c_select, c_union, natural_join
from condnet.operators.conditions import parse
from condnet.operators.normalize import normalize
from condnet.operators.predicates import OPS, is_var, possibly, register
from condnet.operators.sqlfront import query


def ct(spark, rows, cols):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols) + ", condition array<string>")


# fixed values: the demo tables policy1 and policy2, and what their join must give
@pytest.fixture
def policy1(spark):
    return ct(spark, [("1.2.3.4", "x", ["x == [ABC]"]), ("y", "z", ["y != 1.2.3.5", "y != 1.2.3.4"])], ["dest", "path"])


@pytest.fixture
def policy2(spark):
    return ct(spark, [("1.2.3.4", "[ABC]", "u", ["u == 1"]), ("5.6.7.8", "[ABC]", "u", ["u != 1"]), ("1.2.3.4", "[AC]", "v", ["v == 1"]), ("5.6.7.8", "[AC]", "v", ["v != 1"])], ["dest", "path", "flag"])


def rows(df):
    return sorted(tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect())


# fixed value
JOINED = [("1.2.3.4", "x", "u", ("x == [ABC]", "u == 1")), ("y", "z", "u", ("u != 1", "y == 5.6.7.8", "z == [ABC]")), ("y", "z", "v", ("v != 1", "y == 5.6.7.8", "z == [AC]"))]


def test_select_golden(policy1):
    assert rows(c_select(policy1, [Pred("path", "!=", "[ABC]")])) == [("y", "z", ("y != 1.2.3.5", "y != 1.2.3.4", "z != [ABC]"))]


@pytest.mark.parametrize("split", [True, False])
def test_join_golden(policy1, policy2, split):
    assert rows(c_join(policy1, policy2, [("dest", "==", "dest"), ("path", "==", "path")], split=split)) == JOINED
    assert rows(natural_join(policy1, policy2, split=split)) == JOINED


def test_sql_front(spark, policy1, policy2):
    t = {"policy1": policy1, "policy2": policy2}
    assert rows(query("SELECT * FROM policy1, policy2 WHERE policy1.dest = policy2.dest AND policy1.path = policy2.path;", t)) == JOINED
    assert rows(query("select * from policy1 where path != '[ABC]'", t)) == [("y", "z", ("y != 1.2.3.5", "y != 1.2.3.4", "z != [ABC]"))]
    assert rows(query("SELECT dest FROM policy1 WHERE (path = '[ABC]' OR path = '[AC]') AND dest <> '1.2.3.4'", t)) == [("y", ("y != 1.2.3.5", "y != 1.2.3.4", "Or(z == [ABC], z == [AC])"))]
    assert rows(query("SELECT * FROM policy1", t)) == rows(policy1)
    assert [r[:2] for r in rows(query("SELECT dest, flag FROM policy1 JOIN policy2 ON policy1.dest = policy2.dest", t))]
    with pytest.raises(ValueError):
        query("DELETE FROM policy1", t)


def test_ground_instances(spark):
    # fixed values: the demo's instances and its list for the solver
    i1 = ct(spark, [("1.2.3.4", "[ABC]", ["[ABC] == [ABC]"]), ("5.6.7.8", "[AC]", ["5.6.7.8 != 1.2.3.5", "5.6.7.8 != 1.2.3.4"])], ["dest", "path"])
    i2 = ct(spark, [("1.2.3.4", "[AC]", ["[AC] == [ABC]"]), ("1.2.3.5", "[ADC]", ["1.2.3.5 != 1.2.3.5", "1.2.3.5 != 1.2.3.4"])], ["dest", "path"])
    assert rows(normalize(i1)) == [("1.2.3.4", "[ABC]", ()), ("5.6.7.8", "[AC]", ())]
    assert rows(normalize(i2)) == []


def test_lengths_and_nopath():
    assert solver.is_contradiction(["l(x579) <= x580", "x579 == 6939 9583", "x580 == 2", "l(x579) == 2", "4 <= x580"])
    assert not solver.is_contradiction(["l(x531) <= x532", "x531 == 1299 9583", "x532 == 2", "l(x531) == 2"])
    assert solver.is_contradiction(["y == nopath"])
    assert solver.normalized(("l(x) <= 10", "l(x) <= 9")) == ("l(x) <= 9",)
    assert solver.normalized(("y5 == 3303 6453", "y5 == 3303 6453", "l(y5) == 2")) == ("y5 == 3303 6453", "l(y5) == 2")
    assert solver.is_contradiction(["l(x) < 0"])
    assert solver.is_tautology(["Or(a == 1, a != 1)"]) and not solver.is_tautology(["Or(a == 1, b != 1)"])
    assert solver.is_contradiction(["1 <= n", "n <= 2", "n != 1", "n != 2"])
    assert solver.is_contradiction(["a < b", "b < a"]) and solver.is_contradiction(["a <= b", "b <= a", "a != b"]) is True
    assert parse("Or(x == 1 2, l(y) != 'a, b')")[1].right == "a, b"


def holds(cond, world):
    val = lambda t: world.get(t, t)
    test = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    return any(test[a.op](val(a.left), val(a.right)) for a in cond)


@pytest.mark.parametrize("kind", ["string", "int"])
def test_solver_against_brute_force(kind):
    rnd = random.Random(7)
    for _ in range(400):
        names = ["x", "y", "z"][: rnd.randint(1, 3)]
        if kind == "string":
            consts, ops = ["1", "3", "5"], ["==", "!=", "<", ">"]  # neighbours lie apart, so gaps don't decide
            domain = ["", "0", "1", "2", "2a", "2b", "3", "4", "4a", "4b", "5", "6", "6a", "6b"]
        else:
            names, consts, ops = [f"l({n})" for n in names], ["1", "2", "4"], list(OPS)
            domain = list(range(0, 9))

        def atom():
            l, r = rnd.choice(names), rnd.choice([*names, *consts])
            return f"{l} {rnd.choice(ops)} {r}"

        conds = [atom() if rnd.random() < 0.8 else f"Or({atom()}, {atom()})" for _ in range(rnd.randint(1, 4))]
        parsed = [parse(c) for c in conds]
        worlds = [dict(zip(names, v)) | ({c: int(c) for c in consts} if kind == "int" else {}) for v in product(domain, repeat=len(names))]
        sat = [w for w in worlds if all(holds(c, w) for c in parsed)]
        assert solver.is_contradiction(conds) == (not sat), conds
        assert solver.is_tautology(conds) == (len(sat) == len(worlds)), conds
        left = [parse(c) for c in solver.remove_redundant(conds)]
        assert [w for w in worlds if all(holds(c, w) for c in left)] == sat, conds


def test_possibly(spark):
    df = spark.createDataFrame([("1", "2"), ("10", "2"), ("x", "2"), ("2", None), (None, None), ("[A]", "a")], "a string, b string")
    got = {op: [r[0] for r in df.select(possibly(op, F.col("a"), F.col("b"))).collect()] for op in OPS}
    assert got["<"] == [True, True, True, False, False, True]
    assert got["=="] == [False, False, True, False, False, True]
    assert [r[0] for r in df.select(is_var(F.col("a"))).collect()] == [False, False, True, False, False, False]
    register(spark)
    assert spark.sql("SELECT less('10', '2'), equal('x', '1'), is_var(NULL), hops('1 2'), hops('_')").first() == (True, True, False, 2, 0)


def test_join_split_same_bag(spark):
    rnd = random.Random(3)
    cell = lambda: rnd.choice(["1", "2", "3", "x", "y", None])
    a = ct(spark, [(cell(), cell(), None) for _ in range(40)], ["p", "q"])
    b = ct(spark, [(cell(), cell(), ["k == 1"]) for _ in range(40)], ["p", "q"])
    on = [("p", "==", "p"), ("q", "==", "q")]
    assert rows(c_join_data(a.drop("condition"), b.drop("condition"), on).na.fill("")) == rows(c_join_data(a.drop("condition"), b.drop("condition"), on, split=False).na.fill(""))


def test_defined_cases(spark, policy1):
    nulls = ct(spark, [("1", "x", None), ("2", "y", [None, "y == 1"]), (None, None, [])], ["dest", "path"])
    assert rows(normalize(nulls).na.fill("")) == [("", "", ()), ("1", "x", ()), ("2", "y", ("y == 1",))]
    assert rows(c_select(policy1.limit(0), [Pred("dest", "==", "1")])) == []
    assert rows(c_select(policy1, [Or((Pred("dest", "==", "7"), Pred("dest", "==", "1.2.3.4")))], ["dest"])) == [("1.2.3.4", ("x == [ABC]",)), ("y", ("y != 1.2.3.4", "Or(y == 7, y == 1.2.3.4)"))]
    assert len(rows(c_union(policy1, c_project(policy1, ["dest", "path"])))) == 4
    ints = spark.createDataFrame([(1, "a", ["a == 1"]), (10, "b", None)], "n int, v string, condition array<string>")
    assert [r[0] for r in rows(c_select(ints, [Pred("n", ">", 2)]))] == [10]


def test_query_text_of_two_tables(spark):
    a = spark.createDataFrame([(1, "[A]", 5), (2, "x", 6)], "k int, path string, only int")
    b = spark.createDataFrame([(1, "[B]"), (2, "[C]")], "k int, path string")
    t = {"a": a, "b": b}
    got = query("SELECT k, path FROM a, b WHERE a.k = b.k AND b.path = '[B]'", t)
    assert [(r.k, r.path, r.condition) for r in got.collect()] == [(1, "[A]", [])]
    got = query("SELECT k, path FROM a, b WHERE a.k = b.k AND a.path = '[B]' AND only = 6", t)
    assert [(r.k, r.path, r.condition) for r in got.collect()] == [(2, "x", ["x == [B]"])]
    for bad in ("path = '[B]'", "(a.path = '[A]' or b.path = '[B]')", "nothing = 1", "a.other = 1"):
        with pytest.raises(ValueError):
            query(f"SELECT * FROM a, b WHERE a.k = b.k AND {bad}", t)
    one = query("SELECT path FROM a WHERE not_equal(path, '[A]') and (equal(path, '[B]') or equal('[C]', path))", t)
    assert [(r.path, r.condition) for r in one.collect()] == [("x", ["Or(x == [B], x == [C])"])]


def test_lists_reach_the_solver_unchanged(spark):
    import random

    rnd = random.Random(5)
    atoms = ["1 == 1", "1 == 2", "[A] != [A]", "[AB] == [A B]", "x == 1", "x != 1", "y == x", "x == x", "x != x", "l(x) <= 3", "l(x) == 2", "2 <= 1", "01 <= 1", "x == 'q q'", "1 == '1'", "Or(x == 1, 1 == 1)", "y == nopath", "3 == 3 nopath", "x == a 5:b", "x  == 1", "x==1", None, "x == a\x1fb", "é == é", "1 ==  1"]
    data = [(i, [rnd.choice(atoms) for _ in range(rnd.randint(0, 4))]) for i in range(400)] + [(1000, None)]
    got = {r.id: tuple(r.condition) for r in normalize(spark.createDataFrame(data, "id int, condition array<string>")).collect()}
    want = {i: solver.normalized(tuple(c for c in v or () if c is not None)) for i, v in data}
    assert got == {i: v for i, v in want.items() if v is not None}
    with pytest.raises(Exception, match="not a comparison"):
        normalize(spark.createDataFrame([(1, [""])], "id int, condition array<string>")).collect()
