"""Prompts under a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.text import tokens, truncated

#: Shares of a budget; what they leave or exceed is taken from the context.
SHARES = {"preamble": 0.1, "context": 0.5, "diffs": 0.3, "insights": 0.1, "instructions": 0.1}


def allocated(total: Column, shares: dict[str, float] | None = None) -> dict[str, Column]:
    """Tokens of each section: shares are rounded down; the context takes what is left over, or gives what is too much, down to 0."""
    part = {k: F.floor(total * v).cast("long") for k, v in (shares or SHARES).items()}
    rest = total - sum(part.values(), F.lit(0))
    return part | {"context": F.greatest(part["context"] + rest, F.lit(0)).cast("long")}


def within_budget(chunks: DataFrame, group: list[str], order: list, text: str, budget: int, buffer: float = 1.1) -> DataFrame:
    """The longest prefix of each group's ranked chunks whose estimated tokens stay within the budget; 0 or less keeps all."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce(F.length(text), F.lit(0))).over(w)
    out = chunks.withColumn("used_tokens", F.ceil(total / 4 * buffer).cast("long"))
    return out if budget <= 0 else out.where(F.col("used_tokens") <= budget)


def proportional(texts: DataFrame, group: list[str], text: str, budget: int) -> DataFrame:
    """Each text's share of the group's budget by its tokens, rounded down; those left without any drop out, as do groups without tokens."""
    w = Window.partitionBy(*group)
    n = tokens(F.col(text))
    share = F.floor(F.try_divide(n, F.sum(n).over(w)) * budget).cast("long")
    return texts.withColumn("tokens", n).withColumn("share", share).where("share > 0")


def context_by_file(chunks: DataFrame, group: list[str], lines: int = 10) -> DataFrame:
    """group, file, section: each file's chunks in order of lines, a header and the first lines of each."""
    head = F.array_join(F.slice(F.split("content", "\n"), 1, lines), "\n")
    entry = F.concat(F.upper(F.coalesce("chunk_type", F.lit("unknown"))), F.lit(" ("), F.col("start_line"), F.lit("-"), F.col("end_line"), F.lit(")\n"), head)
    rows = chunks.where("content is not null and file is not null").groupBy(*group, "file").agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "id", entry.alias("entry")))).alias("e"))
    return rows.select(*group, "file", F.array_join(F.transform("e", lambda x: x["entry"]), "\n\n").alias("section"))


#: Kinds of chunks, the most telling first.
KIND_PRIORITY = {"function": 5, "class": 4, "method": 3, "module": 2, "block": 1}


def prioritised(chunks: DataFrame, group: list[str], kind: str, score: str, *ties: str) -> DataFrame:
    """place: chunks of a group by their kind, then by score, then by ``ties``; unknown kinds come last."""
    priority = F.lit(0)
    for k, v in KIND_PRIORITY.items():
        priority = F.when(F.col(kind) == k, v).otherwise(priority)
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(priority), F.desc_nulls_last(score), *ties)))


def assembled(sections: list[Column]) -> Column:
    """Sections that aren't blank, a blank line between them."""
    return F.array_join(F.filter(F.array(*sections), lambda x: F.trim(x) != ""), "\n\n")


def composed(sections: DataFrame, names: list[str], budget: int, notice: str) -> DataFrame:
    """text, token_count, budget_used, budget_remaining, truncated: the prompt of each row's sections, cut to the budget where it is longer; null sections count as blank."""
    whole = assembled([F.coalesce(n, F.lit("")) for n in names])
    used = tokens(F.col("_whole"))
    out = sections.withColumn("_whole", whole).withColumn("budget_used", used).withColumn("truncated", used > budget)
    out = out.withColumn("text", truncated(F.col("_whole"), F.lit(budget), notice)).withColumn("budget_remaining", F.lit(budget) - F.col("budget_used"))
    return out.withColumn("token_count", tokens(F.col("text"))).drop("_whole")


def preview(sections: DataFrame, names: list[str], budget: int) -> DataFrame:
    """Tokens of each section (name_tokens), estimated, utilisation in percent, warning: above the budget, above four fifths of it, or null."""
    out = sections
    for n in names:
        out = out.withColumn(f"{n}_tokens", tokens(F.col(n)))
    out = out.withColumn("estimated", sum((F.col(f"{n}_tokens") for n in names), F.lit(0))).withColumn("utilisation", F.col("estimated") / budget * 100)
    return out.withColumn("warning", F.when(F.col("utilisation") > 100, "over budget").when(F.col("utilisation") > 80, "high utilisation"))
