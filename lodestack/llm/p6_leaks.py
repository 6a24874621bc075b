"""Problem 6: evaluation texts leaking into training text.

A case holds a passage of an item: 15 words in a row as they are (or the whole of a shorter item); or 15 words with single ones
replaced or put in between, half of which lie in the item's own seeds; or most of the item's own words in any order. Seeds are runs of
three words in one spelling. Every run of 15 words of an item is searched for, however many items share it, except in its standing
instruction: an opening that several texts share and that is their lesser part on average.

Seeds tell content from phrases where words were replaced: a seed is the item's own unless it stands in many different surroundings.
Texts that share the 15 words up to a seed, or from it on, share a passage there and count once, so passages that many items share
stay their own. Documents are searched for runs and own seeds through a Bloom filter, sized by their number, and an equi-join. A pair
that shares a run is compared word by word; one that shares two seeds is tiled: longest matches first, without overlap (``tiling``).

Cases: null and empty texts leak nothing and are leaked by nothing; items of fewer than four words are skipped; copies of a
document are separate rows, and an item in several suites is reported for each; a text of any length is searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import filter_bits, filter_of, in_filter, kept, spread
from lodestack.sources.tables import table

#: Words of a seed; seeds that a pair needs; shortest tile; words of a passage; share that reordered passages cover.
SEED, HITS, TILE, PASSAGE, COVER = 3, 2, 3, 15, 0.6
#: What is said to be shared: more than so many texts, and for phrases more than one in so many, as chance meetings grow with the texts. Words of an opening.
SHARED, ONE_IN, OPENING = 2, 150, 6
#: Seeds and runs of items up to which their table is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 500_000
#: Words of texts that are looked up in the filter at once.
BLOCK = 50_000

LONGS, STRINGS = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())


def run_hashes(hashes: np.ndarray, n: int, of: int = SEED) -> np.ndarray:
    """64-bit hashes of the runs of n words, in order, from those of the runs of ``of`` words, at most n."""
    h, count = hashes.view(np.uint64), max(0, len(hashes) + of - n)
    out = np.full(count, n, dtype=np.uint64)
    for k in [*range(0, n - of, of), n - of]:
        out = (out ^ h[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
    return out.view(np.int64)


def word_hashes(tokens: list[str]) -> list[int]:
    from xxhash import xxh64_intdigest

    return list(map(xxh64_intdigest, tokens))


def seed_hashes(tokens: list[str]) -> np.ndarray:
    """64-bit hashes of the seeds of a row of words, in order."""
    return run_hashes(np.array(word_hashes(tokens), dtype=np.uint64), SEED, 1)


def run_length(rest: int) -> int:
    """Words in a row that make a case of an item with so many words outside its standing instruction; 0: none do."""
    return min(PASSAGE, rest) if rest >= SEED + HITS - 1 else 0


def opening_hashes(tokens: list[str]) -> list[int]:
    """64-bit hashes of the openings of ``OPENING`` and more words, in order."""
    from xxhash import xxh64

    h, out = xxh64(), []
    for i, w in enumerate(tokens, 1):
        h.update(w + " ")
        if i >= OPENING:
            out.append(h.intdigest() - (1 << 63))
    return out


PARTS = [("tokens", STRINGS), ("seeds", LONGS), ("before", LONGS), ("after", LONGS), ("openings", LONGS), ("text", T.LongType())]


@F.pandas_udf(T.StructType([T.StructField(*x) for x in PARTS]))
def split_item(texts: pd.Series) -> pd.DataFrame:
    """Words, seeds, the passages up to and from each seed, openings, and what tells one text from another: its last words, as standing instructions only open texts. A passage that the text is too short for is the text."""
    from xxhash import xxh64_intdigest

    from lodestack.llm.tiling import words

    rows = []
    for t in texts:
        tokens = words(t or "")
        seeds, text = seed_hashes(tokens), xxh64_intdigest(" ".join(tokens[-PASSAGE:])) - (1 << 63)
        runs, short = run_hashes(seeds, PASSAGE).tolist(), [text] * min(len(seeds), PASSAGE - SEED)
        rows.append((tokens, seeds.tolist(), short + runs, runs + short, opening_hashes(tokens), text))
    return pd.DataFrame(rows, columns=[k for k, _ in PARTS])


@F.pandas_udf(LONGS)
def item_runs(seeds: pd.Series, starts: pd.Series) -> pd.Series:
    """Hashes of the runs of words, one of which makes a case, of items whose own words begin at ``starts``."""

    def one(h: np.ndarray, start: int) -> list[int]:
        n = run_length(len(h) + SEED - 1 - start)
        return run_hashes(np.array(h[start:], dtype=np.int64), n).tolist() if n else []

    return pd.Series([one(*x) for x in zip(seeds, starts)])


def item_keys(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, tokens, start: where its words after the standing instruction begin, own: the places of its own seeds) and (key, item_id, hits) of own seeds, and of runs, one of which is enough."""
    split = kept(items.where("text is not null").select("item_id", split_item("text").alias("s")).select("item_id", "s.*"))
    texts = split.agg(F.count_distinct("text")).first()[0]
    opened = split.select("item_id", "text", F.size("tokens").alias("words"), F.posexplode("openings").alias("k", "opening")).withColumn("k", F.col("k") + OPENING)
    shared = opened.groupBy("opening", "k", "text").agg(F.avg("words").alias("words")).groupBy("opening", "k").agg(F.count("*").alias("texts"), F.avg("words").alias("words"))
    # openings that go on from each other in the same texts are one, the longest; of those that fewer and fewer texts share, the one that accounts for most words
    longest = opened.select("item_id", "opening").join(shared.where(F.col("texts") > SHARED), "opening").groupBy("item_id", "texts").agg(F.max("k").alias("k"), F.max_by("words", "k").alias("words"))
    starts = longest.where(F.col("words") > 2 * F.col("k")).groupBy("item_id").agg(F.max_by("k", F.struct((F.col("texts") - 1) * F.col("k"), "k")).alias("start"))
    split = kept(split.join(starts, "item_id", "left").fillna(0, ["start"]))
    places = split.select("item_id", "text", "start", F.posexplode(F.arrays_zip("seeds", "before", "after")).alias("place", "s")).select("item_id", "text", "start", "place", F.col("s.seeds").alias("seed"), "s.before", "s.after")
    counted = places.groupBy("seed").agg(F.least(*(F.count_distinct(c) for c in ("text", "before", "after"))).alias("texts"))
    own = kept(places.where("place >= start").join(counted.where(F.col("texts") <= max(SHARED, texts // ONE_IN)), "seed").select("item_id", "place", "seed"))
    marks = own.groupBy("item_id").agg(F.collect_set("place").alias("own"))
    marked = split.select("item_id", "tokens", "start").join(marks, "item_id", "left").withColumn("own", F.coalesce("own", F.array().cast("array<int>")))
    runs = split.select("item_id", F.explode(item_runs("seeds", "start")).alias("key"))
    keys = own.select(F.col("seed").alias("key"), "item_id", F.lit(1).alias("hits")).union(runs.select("key", "item_id", F.lit(HITS).alias("hits"))).distinct()
    return kept(marked), kept(keys)


@F.pandas_udf(T.BooleanType())
def leaked(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    from lodestack.llm.tiling import holds, passage, tiles

    def one(item: list[str], start: int, own: list[int], run: bool, document: list[str]) -> bool:
        item, document = list(item), list(document)
        if run and holds(item[start:], document, run_length(len(item) - start)):
            return True
        best, share = passage(tiles(item, document, TILE), list(own), len(item), SEED)
        return best >= PASSAGE or share >= COVER

    for columns in parts:
        yield pd.Series([one(*x) for x in zip(*columns)])


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of every document that holds a passage of an item."""
    tokens_of, keys = item_keys(items)
    lengths = sorted({n for r in tokens_of.select(F.least(F.size("tokens") - F.col("start"), F.lit(PASSAGE)).alias("n")).distinct().collect() if (n := run_length(r.n))})  # at most PASSAGE rows
    n = keys.count()
    bits = filter_bits(n)
    held = documents.sparkSession.sparkContext.broadcast(filter_of(keys, "key", bits))

    def holders(block: list[tuple[int, list[str], list[int]]]) -> Iterator[tuple[int, list[str], list[int]]]:
        """Of texts with the hashes of their words: those that hold seeds or runs of items, by the filter, with these."""
        table, at = held.value, np.repeat(np.arange(len(block)), [len(x) for *_, x in block])
        h = run_hashes(np.array([y for *_, x in block for y in x], dtype=np.uint64), SEED, 1)
        held_by, keys, run = [], [], []
        for n in (SEED, *lengths):
            r = h if n == SEED else run_hashes(h, n)
            hit = in_filter(r.view(np.uint64), table, bits)
            hit = hit[at[hit] == at[hit + n - 1]]  # within one text
            held_by.append(at[hit])
            keys.append(r[hit])
            run.append(np.full(len(hit), n > SEED))
        by, keys, run = (np.concatenate(x) for x in (held_by, keys, run))
        order = np.argsort(by, kind="stable")
        by, keys, run = by[order], keys[order], run[order]
        for a, b in zip(starts := np.flatnonzero(np.diff(by, prepend=-1)), [*starts[1:], len(by)]):
            own = np.unique(keys[a:b])
            if len(own) >= HITS or run[a:b].any():
                yield block[by[a]][0], block[by[a]][1], own.tolist()

    def suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Words, and seeds and runs, of texts that hold those of items, by the filter; nothing of the others."""
        from lodestack.llm.tiling import words

        for batch in batches:
            rows, block, size = [], [], 0
            for doc, t in zip(batch["doc_id"], batch["text"]):
                tokens = words(t)
                block.append((doc, tokens, word_hashes(tokens)))
                size += len(tokens)
                if size >= BLOCK:
                    rows += holders(block)
                    block, size = [], 0
            if rows := rows + (list(holders(block)) if block else []):
                yield pd.DataFrame(rows, columns=["doc_id", "tokens", "keys"])

    found = kept(spread(documents.where("text is not null").select("doc_id", "text")).mapInPandas(suspects, "doc_id long, tokens array<string>, keys array<long>"))
    small = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    shared = found.select("doc_id", F.explode("keys").alias("key")).join(small(keys), "key").groupBy("doc_id", "item_id")
    hits = shared.agg(F.sum("hits").alias("hits"), (F.max("hits") == HITS).alias("run")).where(F.col("hits") >= HITS)
    pairs = hits.select("doc_id", "item_id", "run").join(found.select("doc_id", F.col("tokens").alias("document")), "doc_id").join(tokens_of, "item_id")
    return pairs.where(leaked("tokens", "start", "own", "run", "document")).select("doc_id", "item_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"))


def p6_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test item with the number of documents and of sources that hold a passage of it."""
    items = table(spark, sf_dir, "eval_items")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = leaks(docs.select("doc_id", "text"), items).join(docs.select("doc_id", "source"), "doc_id")
    counts = found.groupBy("item_id").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"))
    return items.select("item_id", "suite").join(counts, "item_id", "left").fillna(0, ["documents", "sources"])


QUERIES = {"p6_found": p6_found, "p6_leaked_items": p6_leaked_items}
