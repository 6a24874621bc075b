"""Problem 8: sentence boundaries across languages and scripts.

Learned without labels, per language, from all documents: which words begin and end lines of their own (starters and enders),
which stand before a period in the middle of sentences (abbreviations), and which follow a period's word as a rule
(collocations), each by log-likelihood ratios of counts. Every period, mark, line break and, in Thai, space is then classified
with these statistics (``sentences``). The counting is one distributed aggregation. Of the learned model, the ``MODEL_ROWS`` most
frequent rows are broadcast; if there are more, each text names its other words, by a Bloom filter of the rest, and gets their rows
by a join, so that every text is split by the whole model.

Cases: null and blank texts have no units; a text without any mark is units by its lines; copies of a text are split alike; very
long texts are split whole; null and wrong languages are replaced by what the text shows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import HUMAN, filter_bits, filter_of, in_filter, kept, salted_join, spelling, spread
from lodestack.sources.tables import table

#: Rows of the model that are broadcast.
MODEL_ROWS = 200_000
#: Log-likelihood ratios above this are not chance (0.5 %); occurrences that make a word's absence from starts and ends telling.
CHANCE, OFTEN = 7.88, 8
#: Counts that a task gathers before it hands them on.
GATHERED = 200_000


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, kind, a, b, n: the events of a task's texts, added up as far as memory allows."""
    from lodestack.llm.answers import CODE, language
    from lodestack.llm.sentences import events

    total: Counter = Counter()

    def frame() -> pd.DataFrame:
        return pd.DataFrame([(*k, n) for k, n in total.items()], columns=["lang", "kind", "a", "b", "n"])

    for batch in batches:
        for text, label in zip(batch["text"], batch["lang"]):
            lang = language(CODE.sub(" ", text)) or label
            for (kind, a, b), n in events(text, lang).items():
                total[lang, kind, a, b] += n
            if len(total) > GATHERED:
                yield frame()
                total.clear()
    yield frame()


def ratio(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunning's log-likelihood ratio that two shares, k1 of n1 and k2 of n2, differ."""
    def ll(k: Column, n: Column, p: Column) -> Column:
        q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
        return k * F.log(q) + (n - k) * F.log(1 - q)

    m2 = F.greatest(n2, F.lit(1e-9))
    p = (k1 + k2) / (n1 + m2)
    return -2 * (ll(k1, n1, p) + ll(k2, m2, p) - ll(k1, n1, k1 / n1) - ll(k2, m2, k2 / m2))


def tendency(counts: DataFrame, kind: str) -> DataFrame:
    """lang, a, n, value: whether a word begins (kind s) or ends (kind e) lines: 1 it does, -1 it doesn't, 0 not known."""
    words = counts.where("kind = 'w'").select("lang", "a", F.col("n").cast("double"))
    hits = counts.where(F.col("kind") == kind).select("lang", "a", F.col("n").cast("double").alias("k"))
    whole = words.where("a not like '^%' or a = '^'").groupBy("lang").agg(F.sum("n").alias("all_n")).join(hits.groupBy("lang").agg(F.sum("k").alias("all_k")), "lang")
    x = words.join(hits, ["lang", "a"], "left").join(F.broadcast(whole), "lang").withColumn("k", F.least(F.coalesce("k", F.lit(0.0)), "n"))
    share, base = F.col("k") / F.col("n"), F.col("all_k") / F.col("all_n")
    llr = ratio(F.col("k"), F.col("n"), F.greatest(F.col("all_k") - F.col("k"), F.lit(0.0)), F.greatest(F.col("all_n") - F.col("n"), F.lit(1.0)))
    value = F.when((share > base) & ((llr > CHANCE) | (share >= 0.5) & (F.col("n") > 1)), 1.0).when((share < base) & (llr > CHANCE) | (F.col("k") == 0) & (F.col("n") >= OFTEN), -1.0).otherwise(0.0)
    return x.select("lang", "a", "n", value.alias("value"))


def periods(counts: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, a, n) of abbreviations and (lang, a, b, n) of collocations across a period."""
    before = counts.where("kind = 'p'").select("lang", "a", "b", F.col("n").cast("double").alias("m"))
    known = starts.select("lang", F.col("a").alias("b"), F.col("value").alias("s"))
    x = before.join(known, ["lang", "b"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    upper = F.col("b").startswith("^")
    middle = (F.col("b").isin(",", "<n>")) | upper & (F.col("s") < 0) | ~upper & ~F.col("b").isin("¶", "<id>") & (F.col("s") <= 0)
    final = (F.col("b") == "¶") | ~F.col("b").isin(",", "<n>", "<id>") & (F.col("s") > 0)
    per = x.groupBy("lang", "a").agg(F.sum("m").alias("k"), F.sum(F.when(middle, F.col("m")).otherwise(0.0)).alias("middle"), F.sum(F.when(final & ~middle, F.col("m")).otherwise(0.0)).alias("final"))
    words = counts.where("kind = 'w'").select("lang", "a", F.col("n").cast("double"))
    sums = words.groupBy("lang").agg(F.sum("n").alias("all_n")).join(per.groupBy("lang").agg(F.sum("k").alias("all_k")), "lang")
    y = per.join(words, ["lang", "a"]).join(F.broadcast(sums), "lang").withColumn("n", F.greatest("n", "k"))
    # Kiss and Strunk: how much better "always with a period" explains the counts, less for long words and bare occurrences
    p1 = F.least(F.greatest(F.col("all_k") / F.col("all_n"), F.lit(1e-9)), F.lit(1 - 1e-9))
    bare = F.col("n") - F.col("k")
    llr = -2 * (F.col("k") * F.log(p1) + bare * F.log(1 - p1) - F.col("k") * F.log(F.lit(0.99)) - bare * F.log(F.lit(0.01)))
    size = F.greatest(F.length(F.translate("a", ".", "")), F.lit(1)).cast("double")
    score = llr * F.exp(-size) * (F.length("a") - F.length(F.translate("a", ".", "")) + 1) * F.when(bare < 50, F.pow(size, -bare)).otherwise(0.0)
    inside = F.col("middle") / (F.col("middle") + F.col("final") + 1e-9)
    short = y.where(~F.col("a").rlike(r"^[<\d]") & (inside >= 0.25) & (F.col("middle") >= 2) & ((F.col("k") / F.col("n") >= 0.5) | (inside >= 0.9) & (F.col("middle") >= 5)) & ((score >= 0.3) | (F.col("middle") >= 3)))
    total = Window.partitionBy("lang", "a")
    follow = before.where("b not in ('¶', ',', '<n>', '<id>') and a not like '<%'").withColumn("k", F.sum("m").over(total)).where("m >= 5 and m >= 0.6 * k")
    return short.select("lang", "a", "n"), follow.select("lang", "a", "b", F.col("m").alias("n"))


def model_rows(documents: DataFrame) -> DataFrame:
    """what, lang, a, b, value, n: the model, one row a word or pair; what is starts, ends, short or pairs, as ``sentences.Model`` takes them."""
    counts = kept(documents.mapInPandas(counted, "lang string, kind string, a string, b string, n long").groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n")))
    starts = kept(tendency(counts, "s"))
    ends = tendency(counts.where("a not like '^%'"), "e")
    short, pairs = periods(counts, starts)
    empty = F.lit("").alias("b")
    return kept(
        starts.where("value <> 0").select(F.lit("starts").alias("what"), "lang", "a", empty, "value", "n")
        .unionByName(ends.where("value <> 0").select(F.lit("ends").alias("what"), "lang", "a", empty, "value", "n"))
        .unionByName(short.select(F.lit("short").alias("what"), "lang", "a", empty, F.lit(1.0).alias("value"), "n"))
        .unionByName(pairs.select(F.lit("pairs").alias("what"), "lang", "a", "b", F.lit(1.0).alias("value"), "n"))
    )


def placed(rows, model: dict[str, dict] | None = None) -> dict[str, dict]:
    """Rows of the model (what, lang, a, b, value) as ``sentences.Model`` takes them, added to ``model`` if there is one."""
    model = model or {"starts": {}, "ends": {}, "short": {}, "pairs": {}}
    for r in rows:
        if r["what"] in ("starts", "ends"):
            model[r["what"]].setdefault(r["lang"], {})[r["a"]] = r["value"]
        else:
            model[r["what"]].setdefault(r["lang"], set()).add(r["a"] if r["what"] == "short" else (r["a"], r["b"]))
    return model


def learned(rows: DataFrame) -> tuple[dict[str, dict], DataFrame | None]:
    """The most frequent rows of a model, and the others as a table (h: hash of the word, and their columns), or None if there are none."""
    order = F.desc("n"), "what", "lang", "a", "b"
    held = rows.orderBy(*order).limit(MODEL_ROWS).collect()
    if rows.count() <= MODEL_ROWS:
        return placed(held), None
    last = held[-1]
    key, mark = F.struct(-F.col("n"), "what", "lang", "a", "b"), F.struct(*(F.lit(x) for x in (-last.n, last.what, last.lang, last.a, last.b)))
    return placed(held), kept(rows.where(key > mark).select(hash_of("a").alias("h"), "what", "lang", "a", "b", "value"))


@F.pandas_udf(T.LongType())
def hash_of(words: pd.Series) -> pd.Series:
    from xxhash import xxh64_intdigest

    return pd.Series([xxh64_intdigest(w) - (1 << 63) for w in words], dtype="int64")


def rare_rows(documents: DataFrame, rest: DataFrame) -> DataFrame:
    """doc_id, rows: the rows of ``rest`` whose words stand in a document."""
    n = rest.count()
    bits = filter_bits(n)
    held = documents.sparkSession.sparkContext.broadcast(filter_of(rest, "h", bits))

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        from lodestack.llm.sentences import forms_in

        table = held.value
        for batch in batches:
            docs, hashes = [], []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                h = np.array([xxh64_intdigest(x) - (1 << 63) for x in forms_in(text)], dtype=np.int64)
                own = h[in_filter(h.view(np.uint64), table, bits)]
                docs.extend([doc] * len(own))
                hashes.extend(own.tolist())
            yield pd.DataFrame({"doc_id": pd.Series(docs, dtype="int64"), "h": pd.Series(hashes, dtype="int64")})

    words = documents.select("doc_id", "text").mapInPandas(named, "doc_id long, h long")
    return salted_join(words, rest, "h").groupBy("doc_id").agg(F.collect_list(F.struct("what", "lang", "a", "b", "value")).alias("rows"))


def sentence_units(documents: DataFrame) -> DataFrame:
    """doc_id, start_char, end_char of every unit. ``documents``: doc_id, text, lang; doc_id is unique."""
    rows = spread(documents.where("trim(text) <> ''").select("doc_id", "text", spelling(F.col("lang"), HUMAN, "en").alias("lang")))
    model, rest = learned(model_rows(rows.select("text", "lang")))
    held = documents.sparkSession.sparkContext.broadcast(model)  # MODEL_ROWS rows
    if rest is not None:
        rows = rows.join(rare_rows(rows, rest), "doc_id", "left")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from lodestack.llm.answers import CODE, language
        from lodestack.llm.sentences import Model, units

        model = Model(**held.value)
        tell = lambda t: language(CODE.sub(" ", t))
        for batch in batches:
            out = []
            for doc, text, label, more in zip(batch["doc_id"], batch["text"], batch["lang"], batch["rows"] if "rows" in batch else [None] * len(batch)):
                own = model if more is None else model.with_rows(placed(more))
                out.extend((doc, a, b) for a, b in units(text, own, tell(text) or label, tell))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["doc_id", "start_char", "end_char"])
                    out = []
            yield pd.DataFrame(out, columns=["doc_id", "start_char", "end_char"])

    return rows.mapInPandas(split, "doc_id long, start_char int, end_char int")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES = {"p8_found": p8_found}
