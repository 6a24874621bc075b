"""Operators that make rows of chunks out of files: line windows in closed form, blocks, and brace-bounded declarations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def line_windows(files: DataFrame, key: str, text: str, size: int = 50, overlap: int = 5) -> DataFrame:
    """key, start_line, end_line, content: windows of ``size`` lines that share ``overlap``; blank windows are dropped.

    The k-th window starts at line k (size - overlap); no state runs from one to the next, so windows are a sequence per row.
    Null texts have none. ``overlap`` must be less than ``size``.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    lines = F.split(F.col(text), "\n")
    n = F.size(lines)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int") * step, F.lit(step))
    rows = files.where(F.col(text).isNotNull()).select(key, lines.alias("_lines"), F.explode(starts).alias("_start"))
    end = F.least(F.col("_start") + size, F.size("_lines"))
    return rows.select(key, (F.col("_start") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("_lines", F.col("_start") + 1, end - F.col("_start")), "\n").alias("content")).where(F.regexp_replace("content", r"[ \t\r\n]", "") != "")


def fixed_blocks(files: DataFrame, key: str, text: str, size: int = 100) -> DataFrame:
    """key, block, start_line, end_line, lines: consecutive blocks without overlap; a blank file is one block."""
    n = F.size(F.split(F.col(text), "\n"))
    rows = files.where(F.col(text).isNotNull()).select(key, n.alias("_n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("block"))
    start = F.col("block") * size + 1
    end = F.least(start + size - 1, F.col("_n"))
    return rows.select(key, "block", start.alias("start_line"), end.alias("end_line"), (end - start + 1).alias("lines"))


#: Where declarations begin, by language; group 1 is the name.
HEADS = {
    "go": r"^func (?:\([^)]*\) )?([A-Za-z_][A-Za-z0-9_]*)", "rust": r"^(?:pub )?(?:fn|impl(?:<[^>]*>)?|trait|struct|enum) ?([A-Za-z_][A-Za-z0-9_]*)", "dart": r"^(?:abstract )?(?:class|enum|extension) ([A-Za-z_][A-Za-z0-9_]*)",
    "typescript": r"^(?:export )?(?:default )?(?:async )?(?:abstract )?(?:function\*?|class|interface|enum) ([A-Za-z_$][A-Za-z0-9_$]*)", "javascript": r"^(?:export )?(?:async )?(?:function\*?|class) ([A-Za-z_$][A-Za-z0-9_$]*)",
    "java": r"^(?:public |final |abstract )*(?:class|interface|enum|record) ([A-Za-z_][A-Za-z0-9_]*)", "c": r"^(?:static )?(?:[a-z_]+ )+\*?([a-z_][a-z0-9_]*)\(",
}


def declarations(chunks: DataFrame, keys: list[str], text: str, language: str, start: str | None = None, owner: str | None = None) -> DataFrame:
    """keys, owner, name, start_line, end_line: top-level declarations of brace languages.

    A declaration begins at a line of column 0 that its language's pattern takes and ends at the next line that is a lone
    closing brace in column 0, or on its own line. ``keys`` name a file; its rows may be chunks that share lines, with the number
    of their first line in ``start``. Only heads and closing lines leave a chunk; a line that several chunks hold counts once and
    goes to the first of them (``owner``). Where lines are missing before the next closing line, the end is unknown and null.
    """
    opens = lambda x: F.coalesce(*[F.when(F.col(language) == n, x.rlike(head)) for n, head in HEADS.items()])
    named = lambda x: F.coalesce(*[F.when(F.col(language) == n, F.regexp_extract(x, head, 1)) for n, head in HEADS.items()])
    closes = lambda x: x.rlike(r"^[})]+[;,]?\s*$")
    first = F.coalesce(F.col(start), F.lit(1)) if start else F.lit(1)
    rows = chunks.where(F.col(text).isNotNull() & F.col(language).isin(*HEADS)).select(
        *keys, (F.col(owner) if owner else F.lit("")).alias("_owner"), F.col(language), first.cast("int").alias("_start"), F.split(F.col(text), "\n").alias("_lines"),
    )
    numbered = F.filter(F.transform("_lines", lambda x, i: F.struct((F.col("_start") + i).alias("line"), x.alias("text"))), lambda m: opens(m["text"]) | closes(m["text"]))
    marks = F.transform(numbered, lambda m: F.struct(m["line"].alias("line"), F.when(opens(m["text"]), named(m["text"])).alias("name"), closes(m["text"]).alias("closes"), m["text"].rlike(r"\}\s*$|;\s*$").alias("alone")))
    pieces = rows.select(*keys, "_owner", "_start", (F.col("_start") + F.size("_lines")).alias("_stop"), marks.alias("_marks"))
    w = Window.partitionBy(*keys).orderBy("_start", "_stop")
    pieces = pieces.withColumn("_before", F.max("_stop").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    pieces = pieces.withColumn("_part", F.sum(F.coalesce((F.col("_start") > F.col("_before")).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = pieces.withColumn("_parts", F.max("_part").over(Window.partitionBy(*keys)))
    found = pieces.select(*keys, "_owner", "_start", "_part", "_parts", F.explode("_marks").alias("_m"))
    once = found.groupBy(*keys, F.col("_m.line").alias("_line")).agg(F.min(F.struct("_start", "_owner", "_part", "_parts", "_m")).alias("_f"))
    later = Window.partitionBy(*keys).orderBy("_line").rowsBetween(0, Window.unboundedFollowing)
    heads = once.withColumn("_end", F.min(F.when(F.col("_f._m.closes"), F.struct("_line", "_f._part"))).over(later)).where("_f._m.name is not null")
    end = F.when(F.col("_f._m.alone"), F.col("_line")).when(F.col("_end._part") == F.col("_f._part"), F.col("_end._line")).when(F.col("_end").isNull() & (F.col("_f._part") == F.col("_f._parts")), F.col("_line"))
    return heads.select(*keys, *([F.col("_f._owner").alias(owner)] if owner else []), F.col("_f._m.name").alias("name"), F.col("_line").alias("start_line"), end.alias("end_line"))


def flags(text: Column) -> list[Column]:
    """has_comments, has_functions, has_classes, line_count of a chunk."""
    t = F.coalesce(text, F.lit(""))
    return [
        t.rlike(r"(?m)^\s*(?://|#|/\*|\*)").alias("has_comments"), t.rlike(r"\b(?:function|def|func|fn)\b|=>").alias("has_functions"), t.rlike(r"\b(?:class|interface|struct|enum|trait)\b").alias("has_classes"), F.size(F.split(t, "\n")).alias("line_count"),
    ]


#: Lines of column 0 that a chunk begins with, by language: kind and pattern; group 1 is the name. The first that fits counts.
BRACE_HEADS = {
    "go": [("function", r"^func\s+([^(]+)\("), ("method", r"^func\s*\([^)]+\)\s+([^(]+)\(")],
    "rust": [("function", r"^fn\s+([^(]+)\("), ("class", r"^impl\s+([^{]+)\s*\{")],
}


def brace_chunks(lines: DataFrame, keys: list[str], language: str) -> DataFrame:
    """keys, kind, name, start_line, end_line: functions, methods and implementations of the files that ``keys`` name, out of their ``lines`` (keys, pos from 0, line).

    A chunk ends at the first line with a closing brace at which as many lines with opening as with closing braces have passed since
    its head; if there is none, at its head. A file without any is one chunk of kind ``file``. One pass: levels are a running sum over
    a file, and the end of a head is the next closing line of its level.
    """
    line = F.coalesce("line", F.lit(""))
    opens, closes = F.contains(line, F.lit("{")).cast("int"), F.contains(line, F.lit("}")).cast("int")
    kind = F.coalesce(*[F.when(line.rlike(p), F.lit(k)) for k, p in BRACE_HEADS[language]])
    name = F.coalesce(*[F.when(line.rlike(p), F.trim(F.regexp_extract(line, p, 1))) for _, p in BRACE_HEADS[language]])
    upto = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select(*keys, "pos", opens.alias("_o"), closes.alias("_c"), kind.alias("kind"), name.alias("name"))
    marked = marked.withColumn("_level", F.sum(F.col("_o") - F.col("_c")).over(upto)).withColumn("_n", F.max("pos").over(Window.partitionBy(*keys)) + 1).withColumn("_any", F.max("kind").over(Window.partitionBy(*keys)))
    heads = marked.where("kind is not null").select(*keys, "pos", "kind", "name", (F.col("_level") - F.col("_o") + F.col("_c")).alias("_level"), F.lit(None).cast("int").alias("_end"))
    ends = marked.where("_c = 1").select(*keys, "pos", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"), "_level", F.col("pos").alias("_end"))
    later = Window.partitionBy(*keys, "_level").orderBy(F.desc("pos"), F.col("kind").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = heads.unionByName(ends).withColumn("_end", F.last("_end", ignorenulls=True).over(later)).where("kind is not null")
    chunks = found.select(*keys, "kind", "name", (F.col("pos") + 1).alias("start_line"), (F.coalesce("_end", "pos") + 1).alias("end_line"))
    whole = marked.where("_any is null and pos = 0").select(*keys, F.lit("file").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(1).alias("start_line"), F.col("_n").alias("end_line"))
    return chunks.unionByName(whole)


#: Trimmed lines of Dart after which a window may end.
GOOD_END = r"^$|^\}$|^\}\);$|^\}\)$|^(?:import|export) |^(?:const|var|final|late)\s+\w+[^=]*$|^(?:class|abstract class|enum|typedef)\s+\w+|^(?:Future<.*>|void|bool|String|int|double|dynamic)\s+\w+\s*\("


def seeking_windows(lines: DataFrame, keys: list[str], size: int = 80, overlap: int = 3) -> DataFrame:
    """keys, start_line, end_line: windows of at most ``size`` lines that end at a good boundary where there is one, out of ``lines`` (keys, pos from 0, line).

    A window ends after the last line of it that is a good boundary; without any, before the last line that is no good cut; else at
    its full size. The next begins ``overlap`` lines before that end. Windows of blank lines are left out. Where a window ends is worked
    out for every line by windows of rows; only the walk from end to end is a loop, over one file's numbers.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    text = F.trim(F.regexp_replace(F.coalesce("line", F.lit("")), r"\s+$|^\s+", ""))
    good, bad, blank = text.rlike(GOOD_END), bad_cut(text), text == ""
    flag = F.when(good, 1).otherwise(0) + F.when(bad, 2).otherwise(0) + F.when(blank, 4).otherwise(0)
    files = lines.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", flag.cast("int").alias("f")))), lambda x: x["f"]).alias("flags"))

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*(getattr(r, k) for k in keys), a + 1, e) for r in b.itertuples(index=False) for a, e in walk(np.asarray(r.flags), size, overlap)]
            yield pd.DataFrame(rows, columns=[*keys, "start_line", "end_line"])

    schema = T.StructType([*(f for f in files.schema.fields if f.name in keys), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())])
    return files.mapInPandas(walked, schema)


def bad_cut(text: Column) -> Column:
    """A line that shouldn't be the last of a window: a call or condition that goes on, an operator of null or logic, an open long string."""
    has = lambda x: F.contains(text, F.lit(x))
    quotes = (has('"""') | has("'''")) & ~text.endswith('"""') & ~text.endswith("'''")
    return has("(") & ~has(")") & ~has(";") | has("?.") | has("??") | has("&&") | has("||") | quotes | text.rlike(r"\b(?:if|for|while|do)\s*\([^)]*$") & ~has("{")


def walk(flags: np.ndarray, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) from 0 of a file's windows; flags: 1 a good boundary, 2 a bad cut, 4 a blank line."""
    n, at, first = len(flags), 0, True
    good, bad = np.flatnonzero(flags & 1), np.flatnonzero(flags & 2)
    while at < n:
        start = at if first else max(0, at - overlap)
        end = min(n, start + size)
        last = np.searchsorted(good, end) - 1
        cut = np.searchsorted(bad, end) - 1
        if last >= 0 and good[last] >= start:
            stop = int(good[last]) + 1
        elif cut >= 0 and bad[cut] >= start:
            stop = int(bad[cut])
        else:
            stop = end
        stop = end if stop <= start else stop
        if not (flags[start:stop] & 4).all():
            yield start, stop
            first = False
        at = stop if stop > at else at + 1  # a window that ends in its own overlap goes on by a line
