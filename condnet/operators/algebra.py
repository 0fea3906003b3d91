"""Relational algebra over conditional tables.

A conditional table has text cells that are constants or variables, and a list of conditions under which a row exists. Rows are
bags. Selection and join keep what possibly holds and append what must hold to the conditions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condnet.common import parts
from condnet.operators.normalize import normalize
from condnet.operators.predicates import is_var, operator, possibly

COND = "condition"


def _none() -> Column:
    return F.array().cast("array<string>")


@dataclass(frozen=True)
class Pred:
    """column op value; the value is a column's name if `column` is set, else a literal."""

    left: str
    op: str
    right: str | int
    column: bool = False
    #: compare by the solver only, don't filter (lengths, unknown integers)
    deferred: bool = False


@dataclass(frozen=True)
class Or:
    preds: tuple[Pred, ...]


def _side(p: Pred) -> tuple[Column, Column]:
    return F.col(p.left).cast("string"), F.col(str(p.right)).cast("string") if p.column else F.lit(str(p.right))


def _text(p: Pred) -> Column:
    a, b = _side(p)
    return F.concat(a, F.lit(f" {operator(p.op)} "), b)


_WHOLE = ("int", "bigint", "smallint", "tinyint")


def _numbers(p: Pred | Or, kinds: dict[str, str]) -> bool:
    """Whether whole numbers are compared: constants, which the data phase decides for good."""
    if isinstance(p, Or):
        return all(_numbers(q, kinds) for q in p.preds)
    return not p.deferred and kinds.get(p.left) in _WHOLE and (kinds.get(str(p.right)) in _WHOLE if p.column else str(p.right).lstrip("-").isdigit())


def _test(p: Pred, kinds: dict[str, str]) -> Column:
    if p.deferred:
        return F.lit(True)
    a, b = _side(p)
    if _numbers(p, kinds):
        a, b = F.col(p.left), F.col(str(p.right)) if p.column else F.lit(int(p.right))
        ops = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
        return F.coalesce(ops[operator(p.op)], F.lit(False))
    return possibly(p.op, a, b)


def conditions_of(df: DataFrame) -> Column:
    return F.coalesce(F.col(COND), _none()) if COND in df.columns else _none()


def c_data(df: DataFrame, preds: list[Pred | Or]) -> DataFrame:
    """The rows for which every predicate possibly holds."""
    kinds = dict(df.dtypes)
    for p in preds:
        df = df.where(reduce(lambda a, b: a | b, (_test(q, kinds) for q in p.preds)) if isinstance(p, Or) else _test(p, kinds))
    return df


def c_condition(df: DataFrame, preds: list[Pred | Or]) -> DataFrame:
    """The text of every predicate that may involve variables appended to the conditions."""
    out, kinds = conditions_of(df), dict(df.dtypes)
    for p in preds:
        if _numbers(p, kinds):
            continue
        t = F.concat(F.lit("Or("), F.concat_ws(", ", *(_text(q) for q in p.preds)), F.lit(")")) if isinstance(p, Or) else _text(p)
        out = F.array_append(out, t)
    return df.withColumn(COND, out)


def c_select(df: DataFrame, preds: list[Pred | Or], cols: list[str] | None = None, solve: bool = True) -> DataFrame:
    """Selection: data phase, condition phase, projection (conditions always stay), normalisation."""
    out = c_condition(c_data(df, preds), preds)
    if cols is not None:
        out = out.select(*(c for c in cols if c != COND), COND)
    return normalize(out) if solve else out


def c_project(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumn(COND, conditions_of(df)).select(*(c for c in cols if c != COND), COND)


def c_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag union; a side without conditions holds always."""
    a, b = (x.withColumn(COND, conditions_of(x)) for x in (a, b))
    return a.unionByName(b)


def hops(path: Column) -> Column:
    """Hops of a space-separated path; '_' has none."""
    return F.when(path == "_", 0).otherwise(F.size(F.split(path, " ")))


def _prefixed(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns))


def c_join_data(left: DataFrame, right: DataFrame, on: list[tuple[str, str, str]], split: bool = True) -> DataFrame:
    """All pairs for which every comparison possibly holds, as columns l_<name> and r_<name>.

    split: by which of the columns compared for equality are variables. The patterns that occur are looked up first (a few
    rows); each two of them are hash-joined on the columns that are constants on both sides, and only patterns without such a
    column, whose rows all match, need a nested loop. The patterns are disjoint, so pairs come out once. Without split: one
    join on the disjunctions (for comparison). Where the right side repeats the cells that are compared, its distinct cells
    are joined, and its rows filled in.
    """
    out = _filled(left, right, on, split, [b for _, _, b in on], lambda pairs: pairs, ROWS)
    return out.select(*(f"l_{c}" for c in left.columns), *(f"r_{c}" for c in right.columns))


def _pairs(lt: DataFrame, rt: DataFrame, on: list[tuple[str, str, str]], patterns: list[list[tuple[bool, ...]]] | None) -> DataFrame:
    """The rows of lt and rt for which every comparison possibly holds; patterns: which of the columns compared for equality are variables, if the join is split by them."""
    pairs = [(F.col(f"l_{a}").cast("string"), operator(op), F.col(f"r_{b}").cast("string")) for a, op, b in on]
    if patterns is None:
        return lt.join(rt, reduce(lambda x, y: x & y, (possibly(op, a, b) for a, op, b in pairs)))
    equal = [(a, b) for a, op, b in pairs if op == "=="]
    rest = [possibly(op, a, b) for a, op, b in pairs if op != "=="]

    def pattern(sides: list[Column], bits: tuple[bool, ...]) -> Column:
        return reduce(lambda x, y: x & y, (is_var(s) if v else ~is_var(s) for s, v in zip(sides, bits)))

    out = None
    for m in patterns[0]:
        l_part = lt.where(pattern([a for a, _ in equal], m))
        for n in patterns[1]:
            r_part = rt.where(pattern([b for _, b in equal], n))
            keys = [a == b for (a, b), v, w in zip(equal, m, n) if not v and not w]
            cond = [*keys, *rest]
            j = l_part.join(r_part, reduce(lambda x, y: x & y, cond)) if cond else l_part.crossJoin(r_part)
            out = j if out is None else out.unionByName(j)
    return lt.limit(0).crossJoin(rt.limit(0)) if out is None else out


def _patterns(df: DataFrame, sides: list[Column], key: Column | None = None) -> tuple[list[tuple[bool, ...]], float]:
    """Which of the columns are variables: the patterns that rows have, at most two to the number of columns. With a key also how many rows have the same one, about."""
    seen = df.select(*(is_var(s).alias(f"v{i}") for i, s in enumerate(sides)), *(() if key is None else (key.alias("k"),))).groupBy(*(f"v{i}" for i in range(len(sides))))
    got = seen.agg(F.count("*").alias("n"), F.lit(0).alias("k") if key is None else F.approx_count_distinct("k").alias("k")).collect()
    return sorted(tuple(r[: len(sides)]) for r in got), sum(r.n for r in got) / max(1, sum(r.k for r in got))


#: Rows that have the same key are joined by it in so many parts, by a hash of their other cells.
SALTS = 8
#: In more parts where pairs are small, so that each has so many rows, on average: the copies of the pairs stay under a hundredth of the result.
ROWS = 128
#: A side that repeats its keys so many times, on average, is joined by its distinct keys.
REPEATED = 4
#: Of these types equal cells are the same cell, also as text.
_EXACT = ("string", "array<string>", "boolean", "date", "timestamp", "timestamp_ntz", *_WHOLE)


def _filled(left: DataFrame, right: DataFrame, on: list[tuple[str, str, str]], split: bool, cells: list[str], finish: Callable[[DataFrame], DataFrame], size: int | None = None) -> DataFrame:
    """The pairs for which every comparison possibly holds, with what `finish` makes of them: it sees all of left, but of right only the cells named.

    If rows of right repeat these, each row of left is paired with the distinct ones, so that `finish` decides once what holds for
    many rows, and right's rows are joined to the pairs at the end, in a fixed number of partitions: few and small pairs make a
    large result, which no size of theirs foretells. size: how many rows a part of a key has, on average, where SALTS parts
    would have more.
    """
    lt, rt = _prefixed(left, "l"), _prefixed(right, "r")
    equal = [(F.col(f"l_{a}").cast("string"), F.col(f"r_{b}").cast("string")) for a, op, b in on if operator(op) == "=="]
    if not split or not equal:
        return finish(_pairs(lt, rt, on, None))
    cells = list(dict.fromkeys(f"r_{c}" for c in cells))
    kinds = dict(rt.dtypes)
    others = [c for c in rt.columns if c not in cells]
    exact = all(kinds.get(c) in _EXACT for c in cells)
    key = F.struct(*cells)
    variables, repeated = _patterns(rt, [b for _, b in equal], key if exact else None)
    patterns = [_patterns(lt, [a for a, _ in equal])[0], variables]
    if not exact or repeated < REPEATED:
        return finish(_pairs(lt, rt, on, patterns))
    salts = max(SALTS, int(repeated // size)) if size else SALTS
    hashed = [c for c in others if "map<" not in kinds[c] and "variant" not in kinds[c]]
    rows = rt.select(key.alias("__key"), (F.pmod(F.xxhash64(*hashed), F.lit(salts)) if hashed else F.lit(0)).cast("int").alias("__salt"), *others)
    pairs = finish(_pairs(lt, rt.select(*cells).distinct(), on, patterns)).withColumns({"__key": key, "__salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))})
    at = (parts(left.sparkSession), "__key", "__salt")
    # sorted: the rows of a pair stand together, so that a file holds what they share once
    return pairs.repartition(*at).hint("merge").join(rows.repartition(*at), ["__key", "__salt"]).drop("__key", "__salt")


def c_join(
    left: DataFrame, right: DataFrame, on: list[tuple[str, str, str]], path_len: bool = False, split: bool = True, solve: bool = True, cols: list[str] | None = None, shown: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Join of two conditional tables: conditions of both sides, then one comparison per join column; of an equality's two cells a variable wins, else the right one.

    Columns: those of the left, then those only the right has, then the conditions. path_len: also demand that the
    left path is as long as the right one is in hops, and leave the right side's len_path out. shown: what the conditions are
    given out as, made once for all rows of the right that have the same compared cells and conditions.
    """
    for side in (left, right):
        if any(c.startswith("__") for c in side.columns):
            raise ValueError("column names starting with __ are reserved")
    partner = {a: b for a, op, b in on if op == "=="}
    kinds = dict(left.dtypes)

    def finish(j: DataFrame) -> DataFrame:
        lc = F.coalesce(F.col(f"l_{COND}"), _none()) if COND in left.columns else _none()
        rc = F.coalesce(F.col(f"r_{COND}"), _none()) if COND in right.columns else _none()
        cond = F.concat(lc, rc)
        for a, op, b in on:
            cond = F.array_append(cond, F.concat(F.col(f"l_{a}").cast("string"), F.lit(f" {operator(op)} "), F.col(f"r_{b}").cast("string")))
        if path_len:
            cond = F.array_append(cond, F.concat(F.lit("l("), F.col("l_path"), F.lit(") == "), hops(F.col("r_path")).cast("string")))
        merged = {f"l_{c}": F.when(is_var(F.col(f"l_{c}")), F.col(f"l_{c}")).otherwise(F.col(f"r_{b}")) for c, b in partner.items() if c != COND and kinds.get(c) == "string"}
        out = j.withColumns(merged | {"__cond": cond})
        if solve:
            out = normalize(out, "__cond")
        return out if shown is None else out.withColumn("__cond", shown(F.col("__cond")))

    cells = [*(b for _, _, b in on), *(c for c in right.columns if c == COND or (path_len and c == "path"))]
    j = _filled(left, right, on, split, cells, finish)
    mine = [c for c in left.columns if c != COND]
    only = [c for c in right.columns if c not in left.columns and c != COND and not (path_len and c == "len_path")]
    out = j.select(*(F.col(f"l_{c}").alias(c) for c in mine), *(F.col(f"r_{c}").alias(c) for c in only), F.col("__cond").alias(COND))
    return out if cols is None else out.select(*(c for c in cols if c != COND), COND)


def natural_join(left: DataFrame, right: DataFrame, **kw) -> DataFrame:
    """c_join on all columns that both sides have."""
    return c_join(left, right, [(c, "==", c) for c in left.columns if c in right.columns and c != COND], **kw)
