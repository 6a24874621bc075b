"""Problem 7: mixing sources to target weights.

Source shares are tempered from what there is towards the targets: a source weighs ``share ** (1 - a) * target ** a``, and the
exponent is bisected to the largest at which no source needs more repetitions than it may have at the given budget (three
quarters of all tokens in ``p7_budget_shares``). Without a budget, the largest one is taken at which the targets themselves can be met (``p7_uses``). With a target
entropy, shares raised to an exponent are the weights, and the exponent is bisected to that entropy (``p7_entropy_shares``: that of
the targets). The weights are then realised as block
permutations: each pass over a source is a pseudo-random order of its texts, cut into blocks by the leading bits of a hash; sums
of blocks tell which are whole within the budget, and only the block at the border is looked into, level by level.

Copies of a text are one text: the first id is used, the others 0 times. Sizes are tokens of a public tokenizer, whose path is a
parameter. Cases: null and blank texts and sources without a target are used 0 times; a source without texts reaches 0, and the
other targets keep their proportions; ties in the hash are ordered by the text's key; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import kept, source_name, spread
from lodestack.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Bits of a hash that a level of blocks takes: 4,096 blocks a source and level.
LEVEL_BITS, LEVELS = 12, 3


def tempered(shares: dict[str, float], target: dict[str, float], exponent: float) -> dict[str, float]:
    """Weights between the shares there are (exponent 0) and the targets (exponent 1); they sum to 1."""
    w = {s: shares[s] ** (1 - exponent) * target[s] ** exponent for s in target if shares.get(s, 0) > 0 and target[s] > 0}
    total = sum(w.values())
    return {s: x / total for s, x in w.items()} if total else {}


def bisected(fits, low: float = 0.0, high: float = 1.0) -> float:
    """The largest exponent that fits, if ``low`` does."""
    if fits(high):
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


def by_entropy(shares: dict[str, float], entropy: float) -> float:
    """The exponent at which shares raised to it, in proportion, have the given entropy (in nats, no more than that of equal ones)."""
    def of(a: float) -> float:
        w = [x**a for x in shares.values() if x > 0]
        total = sum(w)
        return -sum(x / total * math.log(x / total) for x in w)

    low, high = 0.0, 64.0  # entropy falls as the exponent grows
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if of(middle) > entropy else (low, middle)
    return (low + high) / 2


#: An entropy as that of the targets.
TARGETS = "targets"


def quotas(tokens: dict[str, int], target: dict[str, float], repeats: dict[str, int], budget: float | None = None, epochs: float | None = None, entropy: float | str | None = None) -> tuple[dict[str, float], float]:
    """Tokens to take from each source, and the exponent. ``budget``: tokens in all, or ``epochs`` times those of the sources with a target, or as many as the weights allow; ``entropy``: of the weights, in nats, or ``TARGETS``."""
    live = {s: t for s, t in target.items() if t > 0 and tokens.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    if not live:
        return {}, 1.0
    whole = sum(tokens[s] for s in live)
    shares = {s: tokens[s] / whole for s in live}
    supply = {s: tokens[s] * repeats[s] for s in live}
    goal = tempered(shares, live, 1.0)
    budget = whole * epochs if budget is None and epochs is not None else budget
    if entropy is not None:
        entropy = -sum(x * math.log(x) for x in goal.values()) if entropy == TARGETS else entropy
        exponent = by_entropy(shares, min(entropy, math.log(len(shares))))
        weights = {s: x**exponent for s, x in shares.items()}
        total = sum(weights.values())
        most = min(supply[s] * total / w for s, w in weights.items())
        size = most if budget is None else min(most, budget)
        return {s: min(w / total * size, supply[s]) for s, w in weights.items()}, exponent
    if budget is None:
        budget = min(supply[s] / x for s, x in goal.items())
    fits = lambda a: all(x * budget <= supply[s] * (1 + 1e-9) for s, x in tempered(shares, live, a).items())
    exponent = bisected(fits)
    return {s: min(x * budget, supply[s]) for s, x in tempered(shares, live, exponent).items()}, exponent


def sized(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, key, tokens of every document with a text."""

    @F.pandas_udf(T.IntegerType())
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for s in parts:
            yield pd.Series([len(t.encode(x, add_special_tokens=False).ids) for x in s], dtype="int32")

    rows = spread(documents.where("trim(text) <> ''").select("doc_id", "source", "text")).select("doc_id", source_name(F.col("source")).alias("source"), F.md5("text").alias("key"), "text")
    return rows.select("doc_id", "source", "key", tokens("text").alias("tokens"))


def permuted(texts: DataFrame, remainders: DataFrame) -> DataFrame:
    """The keys of ``texts`` (source, key, tokens) that the last, partial pass takes: a prefix of each source's permutation.

    ``remainders``: source, rest (tokens the pass may take), one row a source.
    """
    h = F.xxhash64("key")
    bits = [F.shiftrightunsigned(h, 64 - LEVEL_BITS * (k + 1)).bitwiseAND((1 << LEVEL_BITS) - 1).alias(f"b{k}") for k in range(LEVELS)]
    rows = texts.select("source", "key", "tokens", h.alias("h"), *bits)
    left, taken = remainders, None
    for k in range(LEVELS + 1):
        inner = rows.join(F.broadcast(left), ["source", *(f"b{i}" for i in range(k))])
        if k < LEVELS:
            sums = inner.groupBy("source", *(f"b{i}" for i in range(k + 1)), "rest").agg(F.sum("tokens").alias("size"))
            order = [f"b{k}"]
        else:
            sums, order = inner.withColumnRenamed("tokens", "size"), ["h", "key"]
        w = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        placed = sums.withColumn("upto", F.sum("size").over(w))
        if k == LEVELS:  # the text across the border is taken if most of it fits
            whole = placed.where(F.col("upto") - F.col("size") / 2 <= F.col("rest")).select("key")
            return taken.unionByName(whole)
        placed = kept(placed)
        whole = rows.join(F.broadcast(placed.where("upto <= rest").select("source", *(f"b{i}" for i in range(k + 1)))), ["source", *(f"b{i}" for i in range(k + 1))], "left_semi").select("key")
        taken = whole if taken is None else taken.unionByName(whole)
        left = placed.where("upto > rest and upto - size < rest").select("source", *(f"b{i}" for i in range(k + 1)), (F.col("rest") - (F.col("upto") - F.col("size"))).alias("rest"))


def mixture(documents: DataFrame, weights: DataFrame, tokenizer: str = TOKENIZER, budget: float | None = None, epochs: float | None = None, entropy: float | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, uses) of every document, and the shares reached, one row a source of ``weights``."""
    spark = documents.sparkSession
    rows = kept(sized(documents, tokenizer))
    firsts = kept(rows.groupBy("key").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("f")).select("key", "f.*"))
    goals = {r.source: r for r in weights.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect()}  # one row a source
    there = {r.source: r.tokens for r in firsts.groupBy("source").agg(F.sum("tokens").alias("tokens")).where(F.col("source").isin(*goals)).collect()}
    take, exponent = quotas(there, {s: g.target_share for s, g in goals.items()}, {s: g.max_repeats for s, g in goals.items()}, budget, epochs, entropy)
    plan = [(s, int(x // there[s]), float(x % there[s])) for s, x in take.items()]
    passes = spark.createDataFrame(plan, "source string, passes int, rest double")
    extra = permuted(firsts, passes.where("rest > 0").select("source", "rest")).select("key", F.lit(1).alias("more"))
    used = firsts.join(F.broadcast(passes.select("source", "passes")), "source").join(extra, "key", "left").select("doc_id", (F.col("passes") + F.coalesce("more", F.lit(0))).alias("uses"))
    sizes = rows.select("doc_id", "source", "tokens")
    uses = documents.select("doc_id", source_name(F.col("source")).alias("source")).join(sizes.drop("source"), "doc_id", "left").join(used, "doc_id", "left").select("doc_id", "source", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"))
    reached = uses.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.max("uses").alias("most_uses"))
    reached = reached.withColumn("all_tokens", F.sum("used_tokens").over(Window.partitionBy()))  # over one row a source
    goal = weights.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    shares = goal.join(reached, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.coalesce(F.col("used_tokens") / F.nullif("all_tokens", F.lit(0)), F.lit(0.0)).alias("share_reached"), F.lit(exponent).alias("exponent"),
    )
    return uses, shares


def p7_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))[1]


def p7_budget_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares at a budget of three quarters of all tokens: sources that may not be repeated often enough bring the exponent below 1."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"), epochs=0.75)[1]


def p7_entropy_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares that are as even as the targets, in the order of the sources' own sizes."""
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"), entropy=TARGETS)[1]


QUERIES = {"p7_uses": p7_uses, "p7_shares": p7_shares, "p7_budget_shares": p7_budget_shares, "p7_entropy_shares": p7_entropy_shares}
