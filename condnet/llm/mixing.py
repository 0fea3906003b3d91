"""Mixing sources to target weights, sizes counted in tokens.

Method: subset-sum budget fitting. Documents are counted by exact token length per source. A source whose target holds its
tokens k times is taken k times as a whole (k at most the cap); for the rest of its target the lengths are taken in
proportion, the remainder is brought below `BUDGET` by the largest fractions, and a bounded knapsack over the lengths left
(reachable sums with the step that first reached each, counts split into powers of two) fills what remains, as a rule to the token. Documents of a
length are then chosen by a seeded hash; lengths with very many documents are cut into hash buckets, so that no task ranks them all.

Defined cases: sources are compared without blanks around and letter case; documents with null, blank or unlisted sources and
documents without tokens are left out (but count for the total); a listed source without documents gives a row of zeros in
the report; equal listings after that are added, with the smallest cap; a null cap is 1, a null share 0; documents are
identified by their id, repeated rows of an id count once; an empty table gives no documents. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condnet.common import materialize
from condnet.llm.tokens import TOKENIZERS, lengths

#: Tokens that the knapsack fills; documents of one length and source that one task ranks.
BUDGET, BUCKET = 1 << 16, 20_000


def source_key(c: Column | str) -> Column:
    return F.nullif(F.lower(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\r\n"))), F.lit(""))


def knapsack(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that their sum comes closest to budget from below."""
    take = np.zeros(len(length), np.int64)
    by = np.full(budget + 1, -1, np.int32)  # the step that first reaches a sum: all that the way back needs
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    steps: list[tuple[int, int]] = []
    for j in np.argsort(-length, kind="stable"):
        size, left, q = int(length[j]), int(min(count[j], budget // max(1, int(length[j])))), 1
        while left > 0 and not reach[budget]:
            k = min(q, left)
            new = reach[: budget + 1 - size * k] & ~reach[size * k :]
            if new.any():
                by[size * k :][new] = len(steps)
                reach[size * k :] |= new
                steps.append((int(j), k))
            left -= k
            q *= 2
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        j, k = steps[by[at]]
        take[j] += k
        at -= int(length[j]) * k
    return take


def fit(length: np.ndarray, count: np.ndarray, target: int, cap: int) -> tuple[int, np.ndarray]:
    """(whole passes over all documents, documents of each length to use once more)."""
    total = sum(int(a) * int(b) for a, b in zip(length, count))
    none = np.zeros(len(length), np.int64)
    if total <= 0 or target <= 0 or cap <= 0:
        return 0, none
    whole = min(cap, target // total)
    if whole == cap:
        return whole, none
    rest = target - whole * total
    share = [int(c) * rest for c in count]
    extra = np.array([s // total for s in share], np.int64)
    left = rest - sum(int(a) * int(b) for a, b in zip(length, extra))
    for j in sorted(range(len(length)), key=lambda j: (-(share[j] % total), j)):
        if left <= BUDGET:
            break
        if extra[j] < count[j] and left - int(length[j]) >= 0:
            extra[j] += 1
            left -= int(length[j])
    for j in np.argsort(-length, kind="stable"):
        if left <= BUDGET:
            break
        k = min(int(count[j] - extra[j]), (left - BUDGET) // int(length[j]) + (1 if left >= int(length[j]) else 0), left // int(length[j]))
        extra[j] += k
        left -= k * int(length[j])
    if left > 0:
        extra = extra + knapsack(length, count - extra, min(left, BUDGET))
    return whole, extra


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("n_tokens", ignore_index=True)
    whole, extra = fit(pdf["n_tokens"].to_numpy(), pdf["cnt"].to_numpy(), int(pdf["target"].iloc[0]), int(pdf["max_repeats"].iloc[0]))
    return pd.DataFrame({"source": pdf["source"], "n_tokens": pdf["n_tokens"], "cnt": pdf["cnt"], "whole": np.full(len(pdf), whole, np.int64), "extra": extra})


def targets(listed: DataFrame) -> DataFrame:
    return listed.select(source_key("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats")).where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def counted(docs: DataFrame, row_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n_tokens) of all documents, as a written table."""
    src = docs.select(F.col(row_id).alias("doc_id"), source_key(source).alias("source"), F.col(text).alias("text")).where("doc_id is not null")
    n = lengths(src, "doc_id", "text", ["source"], tokenizer, folder)
    return materialize(n.groupBy("doc_id").agg(F.min(F.struct("n_tokens", "source")).alias("x")).select("doc_id", "x.source", "x.n_tokens"), "sizes")


def mix(sizes: DataFrame, listed: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, times): the documents of the mix and how often each is used. sizes: as counted() gives."""
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    goal = targets(listed).withColumn("target", F.round(F.col("target_share") * F.lit(total)).cast("long"))
    full = sizes.where("n_tokens > 0 and source is not null")
    hist = full.groupBy("source", "n_tokens").agg(F.count("*").alias("cnt")).join(goal, "source")
    # rows of a group: distinct lengths of a source, not documents
    plan = hist.groupBy("source").applyInPandas(_plan, "source string, n_tokens long, cnt long, whole long, extra long").where("whole > 0 or extra > 0")
    plan = materialize(plan, "plan")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    placed = full.join(plan, ["source", "n_tokens"]).withColumn("order", order).withColumn("bucket", F.pmod(F.shiftright("order", 20), F.ceil(F.col("cnt") / BUCKET)))
    keep = ["doc_id", "source", "n_tokens"]
    # all or none of a length: nothing to rank
    sure = placed.where("extra = 0 or extra >= cnt").select(*keep, (F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).alias("times"))
    some = placed.where("extra > 0 and extra < cnt")
    by = ["source", "n_tokens", "bucket"]
    before = some.groupBy(*by).agg(F.count("*").alias("here")).withColumn("before", F.sum("here").over(Window.partitionBy("source", "n_tokens").orderBy("bucket")) - F.col("here")).drop("here")
    ranked = some.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("order", "doc_id"))).join(before, by)
    picked = ranked.select(*keep, (F.col("whole") + F.when(F.col("before") + F.col("rn") <= F.col("extra"), 1).otherwise(0)).alias("times"))
    return sure.unionByName(picked).where("times > 0")


def shares(mixed: DataFrame, sizes: DataFrame, listed: DataFrame) -> DataFrame:
    """Per listed source: what was asked for and what was reached, as shares of the tokens of all documents and of the mix."""
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.count("*").alias("documents"), F.max("times").alias("most_used"))
    r = targets(listed).join(got, "source", "left").na.fill(0, ["tokens", "documents", "most_used"])
    all_mixed = F.sum("tokens").over(Window.partitionBy())  # one row a listed source
    return r.select(
        "source", "target_share", "max_repeats", F.round(F.col("target_share") * F.lit(total)).cast("long").alias("target_tokens"), "tokens", "documents", "most_used",
        F.when(F.lit(total > 0), F.col("tokens") / F.lit(total)).alias("share_of_all"), F.when(all_mixed > 0, F.col("tokens") / all_mixed).alias("share_of_mix"),
    )
