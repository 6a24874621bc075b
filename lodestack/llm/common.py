"""What several operators share: normal spellings, and latest deliveries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.sources.shared import cut, kept  # noqa: F401  (used by the operators)

#: Spellings of the code languages, by the extensions and aliases people write.
LANGUAGES = {
    "typescript": "ts tsx typescript", "javascript": "js jsx mjs cjs javascript", "python": "py python python3", "go": "go golang", "dart": "dart", "java": "java", "rust": "rs rust",
    "c": "c h ansi-c",
}
#: Spellings of the human languages, by ISO 639 codes with two and three letters.
HUMAN = {
    "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish", "pt": "pt por portuguese", "ja": "ja jp jpn japanese", "zh": "zh cn zho chi chinese", "ru": "ru rus russian",
    "ko": "ko kr kor korean", "hi": "hi hin hindi", "ar": "ar ara arabic", "th": "th tha thai", "el": "el ell gre greek",
}


def spelling(column: Column, names: dict[str, str], default: str) -> Column:
    """The normal name of each spelling: case, blanks and regions don't count; unknown and null become the default."""
    pairs = [F.lit(x) for k, v in names.items() for y in v.split() for x in (y, k)]
    key = F.lower(F.trim(column))
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.element_at(F.create_map(*pairs), F.regexp_extract(key, r"^([a-z]+)[-_]", 1)), F.lit(default))


def code_language(column: Column) -> Column:
    return spelling(column, LANGUAGES, "other")


def extension(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1))


def source_name(column: Column) -> Column:
    """Sources differ in case, blanks and dashes only."""
    return F.coalesce(F.translate(F.lower(F.trim(column)), "-", "_"), F.lit("unknown"))


def latest(df: DataFrame, keys: list[str], value: str, order: str = "ingested_at") -> DataFrame:
    """One row a key: the newest delivery that still has its value. Other columns come from the same delivery; nothing is collected."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(value).isNotNull(), F.col(order), F.col(value)))
    return df.groupBy(*keys).agg(newest.alias("_")).select(*keys, *[F.col("_")[c].alias(c) for c in rest])


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """An equi-join whose left side may have hot keys: it is spread over ``salts`` parts a key, and the right side, of few rows a key, is repeated for them."""
    spread = left.withColumn("_salt", (F.rand(7) * salts).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [key, "_salt"], how).drop("_salt")


def spread(scan: DataFrame) -> DataFrame:
    """A scan with work for every core: as it is if it has as many partitions, else dealt out anew. For costly work on few files only; large inputs aren't shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: Bits of a Bloom filter for each hash in it, and its bits at least and at most, as powers of two: no more than 64 MiB are broadcast.
FILTER_EACH, FILTER_LEAST, FILTER_MOST = 32, 20, 29
#: A hash sets the bits that it names after each of these shifts.
SHIFTS = (0, 7, 14, 21, 28, 35)
#: Bits of a filter that one row brings to the driver, as a power of two.
BLOCK_BITS = 16


def filter_bits(n: int) -> int:
    """The size of the filter for n hashes, as a power of two."""
    return min(FILTER_MOST, max(FILTER_LEAST, math.ceil(math.log2(max(1, n * FILTER_EACH)))))


def filter_of(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A Bloom filter of 2 ** bits bits over a column of 64-bit hashes. Blocks of it are put together by the executors; the driver gets no more than its bytes, however many hashes there are."""
    block = min(BLOCK_BITS, bits)
    named = F.array(*(F.shiftrightunsigned(column, k).bitwiseAND((1 << bits) - 1) for k in SHIFTS))
    place = hashes.where(F.col(column).isNotNull()).select(F.explode(named).alias("bit"))
    places = place.select(F.shiftright("bit", block).alias("block"), F.col("bit").bitwiseAND((1 << block) - 1).cast("int").alias("place")).distinct()

    def filled(own: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << block, dtype=np.uint8)
        on[own["place"].to_numpy()] = 1
        return pd.DataFrame({"block": own["block"].iloc[:1], "data": [np.packbits(on, bitorder="little").tobytes()]})

    out, size = np.zeros(1 << (bits - 3), dtype=np.uint8), 1 << (block - 3)
    for r in places.groupBy("block").applyInPandas(filled, "block long, data binary").toLocalIterator():
        out[r.block * size : (r.block + 1) * size] = np.frombuffer(r.data, dtype=np.uint8)
    return out


def in_filter(hashes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The places of the unsigned 64-bit hashes that the filter may hold."""
    at, mask = np.arange(len(hashes)), np.uint64((1 << bits) - 1)
    for k in SHIFTS:
        b = (hashes[at] >> np.uint64(k)) & mask
        at = at[(table[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        if not len(at):
            break
    return at
