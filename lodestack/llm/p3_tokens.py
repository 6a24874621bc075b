"""Problem 3: token budget per source and language.

Texts fall into words; the distinct words form prefix tries, one range of the sorted words a partition, however many share a
prefix, along which the states of the exact pair merging are carried (``bpe``), so that a shared prefix is merged once. The counts at the ends of the words are then joined to
the texts: the most frequent words (at most ``FREQUENT``, a bound on what is broadcast) without a shuffle, all others by word.
Texts are keyed by digest, so copies are counted once and weighed by their number.

Cases: null texts are left out, empty ones have no tokens; null or misspelt sources, languages and repositories get their normal
name or ``unknown``/``und``/``other``; a hot word is either frequent and broadcast, or bounded by not being so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import HUMAN, LANGUAGES, code_language, kept, source_name, spelling
from lodestack.sources.tables import table

#: Words whose counts are broadcast: at most 20,000, none longer than 64 characters.
FREQUENT = 20_000
FREQUENT_LENGTH = 64


def words_of(texts: DataFrame) -> DataFrame:
    """key, word of every word of every text."""
    return texts.select("key", F.explode(F.split("text", r"(?U)\s+")).alias("word")).where("word <> ''")


def word_counts(words: DataFrame, merges: DataFrame) -> DataFrame:
    """word, times, tokens: one row a distinct word. ``merges`` is the tokenizer, of fixed size."""
    rules = [(r.merge_rank, r.left_piece, r.right_piece) for r in merges.select("merge_rank", "left_piece", "right_piece").collect()]

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from lodestack.llm.bpe import Pieces

        pieces = Pieces(rules)
        for b in batches:
            yield b.assign(tokens=list(pieces.counts(b["word"])))

    distinct = kept(words.groupBy("word").agg(F.count("*").alias("times")))  # range partitioning reads it twice
    return distinct.repartitionByRange("word").sortWithinPartitions("word").mapInPandas(slices, "word string, times long, tokens int")


def token_counts(texts: DataFrame, merges: DataFrame) -> DataFrame:
    """key, tokens of each distinct key of ``texts`` (key, text); rows that share a key hold the same text."""
    words = words_of(texts)
    counts = kept(word_counts(words, merges))
    frequent = counts.where(F.length("word") <= FREQUENT_LENGTH).orderBy(F.desc("times"), "word").limit(FREQUENT).select("word", F.col("tokens").alias("known"))
    seen = words.join(F.broadcast(frequent), "word", "left")
    easy = seen.where("known is not null").groupBy("key").agg(F.sum("known").alias("tokens"))
    hard = seen.where("known is null").select("word", "key").join(counts.select("word", "tokens").hint("shuffle_hash"), "word").groupBy("key").agg(F.sum("tokens").alias("tokens"))
    rows = texts.groupBy("key").agg(F.count("*").alias("rows"))
    total = easy.unionByName(hard).groupBy("key").agg(F.sum("tokens").alias("tokens"))
    return rows.join(total, "key", "left").select("key", (F.coalesce("tokens", F.lit(0)) / F.col("rows")).cast("long").alias("tokens"))


def texts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, text, table, id, source, language, area of every text of both tables."""
    areas = table(spark, sf_dir, "repositories").select("repository", "area")
    hits = table(spark, sf_dir, "retrieved_chunks").select(
        F.col("content").alias("text"), F.lit("retrieved_chunks").alias("table"), F.concat_ws(":", "retrieval_id", "hit_rank").alias("id"), source_name(F.col("collection")).alias("source"), code_language(F.col("language")).alias("language"), "repository",
    )
    docs = table(spark, sf_dir, "documents").select(
        "text", F.lit("documents").alias("table"), F.col("doc_id").cast("string").alias("id"), source_name(F.col("source")).alias("source"), spelling(F.col("lang"), HUMAN, "und").alias("language"), "repository",
    )
    rows = hits.unionByName(docs).where("text is not null").withColumn("key", F.unhex(F.md5("text")))
    return rows.join(F.broadcast(areas), "repository", "left").withColumn("area", F.coalesce("area", F.lit("unknown")))


def p3_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each text: of every hit and of every document."""
    texts = texts_of(spark, sf_dir)
    return texts.select("key", "table", "id", "source", "language", "area").join(token_counts(texts.select("key", "text"), table(spark, sf_dir, "tokenizer_merges")), "key").drop("key")


def p3_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and area, and for each of them alone; ``distinct_tokens`` counts copies of a text once a slice."""
    texts = texts_of(spark, sf_dir)
    tokens = token_counts(texts.select("key", "text"), table(spark, sf_dir, "tokenizer_merges"))
    copies = texts.groupBy("key", "table", "source", "language", "area").agg(F.count("*").alias("texts")).join(tokens, "key")
    slices = F.explode(F.array(*(F.struct(*(F.col(c).alias(c) if c in kept else F.lit("*").alias(c) for c in ("source", "language", "area"))) for kept in (("source", "language", "area"), ("source",), ("language",), ("area",)))))
    per_text = copies.select("key", "table", slices.alias("s"), "texts", "tokens").groupBy("key", "table", "s").agg(F.sum("texts").alias("texts"), F.max("tokens").alias("tokens"))
    return per_text.groupBy("table", "s.source", "s.language", "s.area").agg(F.sum("texts").alias("texts"), F.sum(F.col("texts") * F.col("tokens")).alias("tokens"), F.sum("tokens").alias("distinct_tokens"))


def _spelt(column: str, names: dict[str, str], default: str) -> str:
    """SQL for the normal name of each spelling."""
    pairs = " ".join(f"WHEN '{y}' THEN '{k}'" for k, v in names.items() for y in dict.fromkeys([k, *v.split()]))
    key = f"lower(trim({column}))"
    return f"coalesce(CASE {key} {pairs} END, CASE regexp_extract({key}, '^([a-z]+)[-_]', 1) {pairs} END, '{default}')"


_TEXTS_SQL = f"""t AS (SELECT content AS text, 'retrieved_chunks' AS "table", concat(retrieval_id, ':', hit_rank) AS id, collection AS source, {_spelt("language", LANGUAGES, "other")} AS language, repository FROM retrieved_chunks WHERE content IS NOT NULL
UNION ALL SELECT text, 'documents', CAST(doc_id AS VARCHAR), source, {_spelt("lang", HUMAN, "und")}, repository FROM documents WHERE text IS NOT NULL),
x AS (SELECT t.* EXCLUDE (source, repository), coalesce(replace(lower(trim(source)), '-', '_'), 'unknown') AS source, coalesce(area, 'unknown') AS area FROM t LEFT JOIN repositories r ON t.repository = r.repository),
w AS (SELECT text, unnest(list_filter(regexp_split_to_array(text, '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x0b]+'), lambda y: y <> '')) AS word FROM (SELECT DISTINCT text FROM x)),
m AS (SELECT list({{'a': concat(chr(1), left_piece, chr(2), chr(1), right_piece, chr(2)), 'b': concat(chr(1), left_piece, right_piece, chr(2))}} ORDER BY merge_rank) AS rules FROM tokenizer_merges),
d AS (SELECT DISTINCT word FROM w),
p AS (SELECT word,
  list_reduce(list_prepend({{'a': '', 'b': array_to_string(list_transform(string_split(concat(chr(9601), word), ''), lambda c: concat(chr(1), c, chr(2))), '')}}, rules), lambda s, r: {{'a': '', 'b': replace(s.b, r.a, r.b)}}).b AS pieces FROM d, m),
k AS (SELECT text, CAST(sum(len(pieces) - len(replace(pieces, chr(1), ''))) AS BIGINT) AS tokens FROM w JOIN p USING (word) GROUP BY 1),
y AS (SELECT x.*, coalesce(tokens, 0) AS tokens FROM x LEFT JOIN k ON x.text = k.text)"""

SQL = {
    "p3_text_tokens": f"""WITH {_TEXTS_SQL} SELECT "table", id, source, language, area, tokens FROM y""",
    "p3_token_totals": f"""WITH {_TEXTS_SQL}, g AS (SELECT "table", text, tokens, unnest([{{'s': source, 'l': language, 'a': area}}, {{'s': source, 'l': '*', 'a': '*'}}, {{'s': '*', 'l': language, 'a': '*'}}, {{'s': '*', 'l': '*', 'a': area}}]) AS slice FROM y),
u AS (SELECT "table", slice, text, count(*) AS texts, max(tokens) AS tokens FROM g GROUP BY 1, 2, 3)
SELECT "table", slice.s AS source, slice.l AS language, slice.a AS area, CAST(sum(texts) AS BIGINT) AS texts, CAST(sum(texts * tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS BIGINT) AS distinct_tokens FROM u GROUP BY 1, 2, 3, 4""",
}
QUERIES = {"p3_text_tokens": p3_text_tokens, "p3_token_totals": p3_token_totals}
