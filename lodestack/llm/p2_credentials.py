"""Problem 2: credentials embedded in source code and configuration.

1. Each chunk gives the literals that may be credentials, by their name, their shape or a comment's cue.
2. The literals are indexed over the whole corpus; values that many owners share are placeholders and drop out, rare ones are
   confirmed. Counting is two-step (value and owner, then value), so that one placeholder in a third of all files is no hot task.
3. Every text is scanned again for the confirmed values under any name. One gram of each value (eight characters, or six of a
   shorter one) goes into a Bloom filter, sized by their number; all grams of all texts are tested against it, at every offset.
   Texts with a hit, an equi-join on the grams brings their values, and an automaton built from these reads the texts again and
   tells the places. More values than one filter of 2 ** ``FILTER_MOST`` bits holds take several passes.

Cases: null contents give nothing; a line in two chunks is reported for both; repeated deliveries count once; empty tables give
empty results; values, lines and texts may be of any length; a value is found again inside longer runs, but not inside a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import FILTER_EACH, FILTER_MOST, cut, extension, filter_bits, filter_of, kept, latest, salted_join, spread
from lodestack.sources.tables import table

#: More owners than this share a placeholder, not a credential.
MAX_OWNERS = 3
#: Characters of texts that are tested together.
TOGETHER = 1 << 19
#: Rows up to which the table of grams is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 200_000

SPAN = T.ArrayType(T.StructType([*(T.StructField(x, T.IntegerType()) for x in ("line", "start", "stop")), *(T.StructField(x, T.StringType()) for x in ("kind", "value"))]))


@F.pandas_udf(SPAN)
def literals(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from lodestack.llm.credentials import candidates

    names = ("line", "start", "stop", "kind", "value")
    for contents, exts in parts:
        yield pd.Series([[dict(zip(names, x)) for x in candidates(t, e)] if t else [] for t, e in zip(contents, exts)], dtype=object)


@F.pandas_udf(T.LongType())
def gram_of(values: pd.Series) -> pd.Series:
    """The gram by which texts are searched for a value."""
    from lodestack.llm.credentials import anchor

    return pd.Series([anchor(v) for v in values], dtype="int64")


def candidate_literals(chunks: DataFrame) -> DataFrame:
    """One row a candidate: chunk_id, commit_sha, repository, line of the file, start and stop in the content, kind, value."""
    return (
        chunks.where("content <> ''")
        .select("id", "commit_sha", "repository", "start_line", F.explode(literals("content", extension(F.col("file")))).alias("c"))
        .select(F.col("id").alias("chunk_id"), "commit_sha", "repository", (F.coalesce("start_line", F.lit(1)) + F.col("c.line")).cast("int").alias("line"), "c.start", "c.stop", "c.kind", "c.value")
    )


def confirmed(candidates: DataFrame, commits: DataFrame) -> DataFrame:
    """The candidates whose value no more than ``MAX_OWNERS`` owners share; repositories lost in chunks come from the commits."""
    known = commits.groupBy("commit_sha").agg(F.max("repository").alias("of_commit"))
    lost = candidates.where("repository is null").join(known, "commit_sha", "left").select("value", F.col("of_commit").alias("repository"))
    owned = candidates.where("repository is not null").select("value", "repository").unionByName(lost)
    owners = owned.select("value", F.coalesce(F.substring_index("repository", "/", 1), F.lit("")).alias("owner")).distinct()
    rare = owners.groupBy("value").agg(F.count("*").alias("owners")).where(F.col("owners") <= MAX_OWNERS)
    return salted_join(candidates, rare.select("value"), "value", "left_semi")


def rescan(chunks: DataFrame, secrets: DataFrame) -> DataFrame:
    """chunk_id, line, start, stop, value of every place that holds one of ``secrets`` (value), under any name."""
    anchors = kept(secrets.select("value", gram_of("value").alias("gram")))
    n = anchors.count()
    passes = max(1, math.ceil(n * FILTER_EACH / (1 << FILTER_MOST)))
    parts = [anchors.where(F.pmod("gram", F.lit(passes)) == k) if passes > 1 else anchors for k in range(passes)]
    found = [_pass(chunks, part, math.ceil(n / passes), n <= BROADCAST_ROWS) for part in parts]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _pass(chunks: DataFrame, anchors: DataFrame, n: int, small: bool) -> DataFrame:
    bits = filter_bits(n)
    held = chunks.sparkSession.sparkContext.broadcast(filter_of(anchors, "gram", bits))

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Texts that may hold a value, with the grams that tell so."""
        from lodestack.llm.credentials import probable

        table = held.value
        for b in batches:
            grams, part, size = [], [], 0
            for t in b["content"]:
                if size > TOGETHER:
                    grams, part, size = grams + probable(part, table, bits), [], 0
                part.append(t)
                size += len(t)
            grams += probable(part, table, bits)
            if any(grams):
                yield b[np.array([len(g) > 0 for g in grams])].assign(grams=[g for g in grams if g])

    texts = chunks.where("content <> ''").select(F.xxhash64("id", "start_line", "content").alias("key"), F.col("id").alias("chunk_id"), F.coalesce("start_line", F.lit(1)).alias("start_line"), "content")
    suspected = kept(texts.mapInPandas(suspects, "key long, chunk_id string, start_line int, content string, grams array<long>"))
    grams = suspected.select("key", F.explode("grams").alias("gram"))
    known = anchors.select("gram", "value")
    told = grams.join(F.broadcast(known), "gram") if small else salted_join(grams, known, "gram")
    values = told.groupBy("key").agg(F.collect_set("value").alias("values"))
    return suspected.drop("grams").join(values, "key").drop("key").mapInPandas(located, "chunk_id string, line int, start int, stop int, value string")


def located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs an automaton of a batch's values over its texts and keeps the places where a value is no part of a longer word."""
    import ahocorasick

    for b in batches:
        automaton = ahocorasick.Automaton()
        for v in {v for own in b["values"] for v in own}:
            automaton.add_word(v, v)
        automaton.make_automaton()
        rows = []
        for r in b.itertuples(index=False):
            text = r.content
            for end, v in automaton.iter(text):
                start = end + 1 - len(v)
                if v[0].isalnum() and text[start - 1 : start].isalnum() or v[-1].isalnum() and text[end + 1 : end + 2].isalnum():
                    continue
                rows.append((r.chunk_id, r.start_line + text.count("\n", 0, start), start, end + 1, v))
        yield pd.DataFrame(rows, columns=["chunk_id", "line", "start", "stop", "value"])


def credentials(chunks: DataFrame, commits: DataFrame) -> DataFrame:
    """chunk_id, line, start, stop, value of every credential: those found by their context and those found again elsewhere."""
    chunks = spread(chunks)
    found = cut(confirmed(cut(candidate_literals(chunks)), commits))
    again = rescan(chunks, found.select("value").distinct())
    return found.select("chunk_id", "line", "start", "stop", "value").unionByName(again).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "code_chunks").select("id", "commit_sha", "repository", "file", "start_line", "content")
    return credentials(chunks, table(spark, sf_dir, "commits")).select("chunk_id", "line").distinct()


@F.pandas_udf(T.StringType())
def masked(contents: pd.Series, spans: pd.Series) -> pd.Series:
    """Stars in place of the characters inside the spans; line breaks, quotes and joints of split literals stay."""
    import re

    out = []
    for text, own in zip(contents, spans):
        for s in [] if own is None else own:
            part = text[s["start"] : s["stop"]]
            part = re.sub(r"-----(?:BEGIN|END)[^-\n]*-----|[^\s\"'`\\]+", lambda m: m[0] if m[0] in ("+", ".", "&") or m[0].startswith("-----") else "*" * len(m[0]), part)
            text = text[: s["start"]] + part + text[s["stop"] :]
        out.append(text)
    return pd.Series(out, dtype=object)


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's newest text, with only its credentials masked; null where all deliveries lost it."""
    chunks = table(spark, sf_dir, "code_chunks")
    found = credentials(chunks.select("id", "commit_sha", "repository", "file", "start_line", "content"), table(spark, sf_dir, "commits"))
    spans = found.groupBy("chunk_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    text = latest(chunks.select("id", "content", "ingested_at"), ["id"], "content").withColumnRenamed("id", "chunk_id")
    return text.join(spans, "chunk_id", "left").select("chunk_id", F.when(F.col("spans").isNull(), F.col("content")).otherwise(masked("content", "spans")).alias("content"))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
