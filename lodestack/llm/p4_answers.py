"""Problem 4: broken prompt and response pairs.

Ordered rules, each of which may add a defect: emptiness, unclosed delimiters, abrupt endings, refusals, copies of the prompt,
language. An ending without a mark is judged by the corpus: the words before it, some of them left open, are looked up among
those of all answers, and it counts as abrupt where such words rarely stand before the end of a sentence or line.

Cases: null answers (in every delivery) and blank ones are ``empty``; an answer without its prompt is judged without it; repeated
deliveries count once, the one that has its text; long texts are judged whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.answers import GENERAL
from lodestack.llm.common import cut, filter_bits, filter_of, in_filter, latest
from lodestack.sources.tables import table

#: Occurrences that a pattern needs before it tells anything, and the share of ends below which an ending is abrupt.
LEAST, SHARE = 6, 0.5
STRINGS = T.ArrayType(T.StringType())
JUDGED = T.StructType([T.StructField("defects", STRINGS), T.StructField("before", T.ArrayType(T.LongType()))])
@F.pandas_udf(JUDGED)
def judged(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    from lodestack.llm.answers import defects

    for texts, prompts in parts:
        yield pd.DataFrame([defects(t, p) for t, p in zip(texts, prompts)], columns=["defects", "before"])


def pattern_counts(answers: DataFrame, wanted: DataFrame) -> DataFrame:
    """pattern, n, ends: how often each of ``wanted`` (pattern) stands in answers (raw_response), and before an end. Other patterns are dropped where they are found, by a Bloom filter sized by the number of wanted ones."""
    bits = filter_bits(wanted.count())
    held = answers.sparkSession.sparkContext.broadcast(filter_of(wanted, "pattern", bits))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from lodestack.llm.answers import body_of, end_grams

        table = held.value
        for batch in batches:
            seen, ended = [], []
            for t in batch["raw_response"]:
                if body_of(t)[0] == "text":
                    codes, ends = end_grams(t)
                    flat = codes.ravel()
                    at = in_filter(flat, table, bits)
                    seen.append(flat[at])
                    ended.append(ends[at // codes.shape[1]])
            if seen:
                keys, place = np.unique(np.concatenate(seen), return_inverse=True)
                yield pd.DataFrame({"pattern": keys.astype(np.int64), "n": np.bincount(place, minlength=len(keys)), "ends": np.bincount(place, np.concatenate(ended), len(keys)).astype(np.int64)})

    every = answers.where("raw_response <> ''").select("raw_response").mapInPandas(counted, "pattern long, n long, ends long")
    return every.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).join(wanted, "pattern", "left_semi")


def answer_defects(responses: DataFrame, prompts: DataFrame) -> DataFrame:
    """response_id, defect: one row a defect. ``responses``: id, prompt_id, raw_response, created_at; ``prompts``: id, text, created_at."""
    answers = latest(responses.select("id", "prompt_id", "raw_response", "created_at"), ["id"], "raw_response", "created_at")
    asked = latest(prompts.select(F.col("id").alias("prompt_id"), F.col("text").alias("prompt"), "created_at"), ["prompt_id"], "prompt", "created_at").select("prompt_id", "prompt")
    rows = cut(answers.join(asked, "prompt_id", "left").select("id", judged("raw_response", "prompt").alias("j")))
    plain = rows.select(F.col("id").alias("response_id"), F.explode("j.defects").alias("defect"))

    open_ends = rows.where("size(j.before) > 0").select("id", F.posexplode("j.before").alias("place", "pattern"))
    seen = pattern_counts(answers, open_ends.select("pattern").distinct())
    share = (F.col("ends") - 1) / (F.col("n") - 1)  # without the answer itself
    told = open_ends.join(seen, "pattern").where(F.col("n") > LEAST).withColumn("share", share)
    best = told.groupBy("id").agg(F.max_by("share", F.struct(F.col("place") != GENERAL, F.abs(F.col("share") - 0.5), -F.col("place"))).alias("share"))
    abrupt = open_ends.select("id").distinct().join(best, "id", "left").where(F.coalesce("share", F.lit(0.0)) < SHARE)
    return plain.unionByName(abrupt.select(F.col("id").alias("response_id"), F.lit("truncated").alias("defect"))).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_defects(table(spark, sf_dir, "cloud_responses"), table(spark, sf_dir, "prompts"))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with each defect, and with any, per model."""
    responses = table(spark, sf_dir, "cloud_responses")
    models = responses.groupBy(F.col("id").alias("response_id")).agg(F.coalesce(F.max("model"), F.lit("unknown")).alias("model"))
    found = answer_defects(responses, table(spark, sf_dir, "prompts"))
    kinds = found.groupBy("response_id").agg(F.array_append(F.collect_set("defect"), F.lit("any")).alias("defects"))
    total = models.groupBy("model").agg(F.count("*").alias("answers"))
    return models.join(kinds, "response_id").select("model", F.explode("defects").alias("defect")).groupBy("model", "defect").agg(F.count("*").alias("found")).join(total, "model").withColumn("share", F.round(F.col("found") / F.col("answers"), 6))


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates}
