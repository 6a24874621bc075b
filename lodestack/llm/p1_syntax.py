"""Problem 1: source files that do not parse.

Every chunk is lexed on its own into a map from lexer state to lexer state, with a summary of its brackets (``lexers``). Maps
compose associatively: those of a block of ``BLOCK`` lines first, wherever its chunks lie, then those of a file version's blocks; text
itself isn't shuffled. A version whose composed map ends in code with no bracket left over is then read by the local grammar of its
language (``grammars``), level by level of its balanced brackets. Versions that maps can't tell, as chunks share other than
``OVERLAP`` lines or one ends inside an expression of a template, are few: their texts are put together and lexed as one.

Cases: an empty file is valid; a chunk whose text every delivery lost, or that is missing, leaves its version ``incomplete``, which is
no case; a last line that isn't given is counted; repeated deliveries of a chunk count once, the newest that has its text; very long files are rows of short summaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import code_language, cut, extension, spread
from lodestack.sources.tables import table

EXTENSIONS = ("ts", "js", "py", "go", "dart", "java", "rs", "c")
#: Lines that neighbouring chunks of a file share as a rule; lines of a block, whose maps are composed first.
OVERLAP, BLOCK = 5, 4_500
#: File versions up to which the list of those that maps can't tell is broadcast.
BROADCAST_ROWS = 200_000
ENTRY, FIELD = "\x1e", "\x1f"


@F.pandas_udf(T.StringType())
def piece_map(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The map of each chunk, without the lines that the chunk before it holds too; null stays null."""
    from lodestack.llm.lexers import LEXERS, brackets

    def one(text: str | None, ext: str, start: int) -> str | None:
        if text is None:
            return None
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        if start == 1:
            text = text.removeprefix("﻿")
        else:
            text = "\n".join(text.split("\n")[OVERLAP:])
        if not text.strip():
            return ""
        lexer = LEXERS[ext]
        maps = lexer.map("\n" + text if lexer.lines else text, start == 1)
        return ENTRY.join(FIELD.join((before, after, brackets(kinds), kinds)) for before, (after, kinds) in maps.items())

    for contents, exts, starts in parts:
        yield pd.Series([one(*x) for x in zip(contents, exts, starts)], dtype=object)


SPAN = T.StructType([T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("map", T.StringType()), T.StructField("status", T.StringType())])


def entries(text: str) -> dict[str, list[str]]:
    """A map as text: state before -> [state after, bracket summary, classes]."""
    return {x[0]: x[1:] for x in (e.split(FIELD) for e in text.split(ENTRY)) if len(x) == 4}


def composed(pieces: list[dict]) -> tuple[int, int, str, str | None]:
    """(first line, last line, map, status) of pieces in order; a status other than None is what keeps their maps from composing."""
    from lodestack.llm.lexers import joined

    first, line, status = pieces[0]["start_line"], None, None
    whole: dict[str, list] | None = None
    for p in pieces:
        if p["map"] is None or p["end_line"] is None or p.get("status") == "incomplete" or line is not None and p["start_line"] > line:
            return first, p["end_line"], "", "incomplete"
        if line is not None and p["start_line"] + OVERLAP != line or p.get("status"):
            status = p.get("status") or "again"
        line = p["end_line"] + 1
        own = entries(p["map"])
        if whole is None:
            whole = {k: [v[0], v[1], [v[2]]] for k, v in own.items()}
        else:
            for state in own.keys() - whole.keys():  # left out so far: it stayed as it was
                whole[state] = [state, "", []]
            for v in whole.values():
                after, summary, classes = own.get(v[0], (v[0], "", ""))
                v[:] = after, joined(v[1], summary), [*v[2], classes]
    return first, line - 1, ENTRY.join(FIELD.join((k, a, b, "".join(c))) for k, (a, b, c) in (whole or {}).items()), status


@F.pandas_udf(SPAN)
def block_map(blocks: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for groups in blocks:
        yield pd.DataFrame([composed(list(g)) for g in groups], columns=SPAN.names)


def judged(ext: str, state: str, left: str, classes: str) -> str:
    """valid, or the failure, of a whole file's end state, bracket summary and classes."""
    from lodestack.llm.grammars import valid
    from lodestack.llm.lexers import CODE

    return "unclosed text" if state != CODE else "unbalanced" if left else "valid" if valid(ext, classes) else "grammar"


@F.pandas_udf(T.StringType())
def verdict(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Composes the maps of each file version's blocks, which come in order, and tells valid, incomplete, again or the failure."""
    from lodestack.llm.lexers import CODE, DEEP

    def one(ext: str, blocks: list[dict]) -> str:
        first, _, text, status = composed(list(blocks))
        if first != 1 or status == "incomplete":
            return "incomplete"
        state, left, classes = entries(text).get(CODE, (CODE, "", ""))
        return "again" if status or state == DEEP else judged(ext, state, left, classes)

    for exts, groups in parts:
        yield pd.Series([one(e, g) for e, g in zip(exts, groups)], dtype=object)


@F.pandas_udf(T.StringType())
def whole_verdict(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The same from the texts of a version's chunks, by their line numbers."""
    from lodestack.llm.lexers import CODE, LEXERS, brackets

    def one(ext: str, chunks: list[dict]) -> str:
        lines: list[str] = []
        for c in chunks:
            own = c["content"].replace("\r\n", "\n").replace("\r", "\n").split("\n")
            lines.extend(own[max(0, len(lines) + 1 - c["start_line"]) :])
        text, lexer = "\n".join(lines).removeprefix("\ufeff"), LEXERS[ext]
        if not text.strip():
            return "valid"
        state, classes = lexer.map("\n" + text if lexer.lines else text, True)[CODE]
        return judged(ext, state, brackets(classes), classes)

    for exts, groups in parts:
        yield pd.Series([one(e, g) for e, g in zip(exts, groups)], dtype=object)


def file_syntax(chunks: DataFrame) -> DataFrame:
    """One row a file version with one of ``EXTENSIONS``: commit_sha, file, language, repository, status.

    ``chunks`` needs commit_sha, file, start_line, end_line, content, ingested_at, repository; more columns don't matter.
    """
    version, ext = ["commit_sha", "file"], extension(F.col("file"))
    start = F.coalesce("start_line", F.lit(1))
    source = chunks.where(ext.isin(*EXTENSIONS) & F.col("commit_sha").isNotNull())
    end = F.coalesce("end_line", start + F.size(F.split("content", "\n")) - 1)
    maps = source.select(*version, "repository", start.alias("start_line"), "ingested_at", end.alias("end_line"), piece_map("content", ext, start).alias("map"))
    newest = F.max_by(F.struct("end_line", "map"), F.struct(F.col("map").isNotNull(), "ingested_at", "map"))
    pieces = maps.groupBy(*version, "start_line").agg(newest.alias("p"), F.max("repository").alias("repository"))
    ordered = lambda x: F.sort_array(F.collect_list(F.struct(*x)))
    blocks = pieces.groupBy(*version, F.floor(F.col("start_line") / BLOCK).alias("block")).agg(ordered(["start_line", "p.end_line", "p.map"]).alias("pieces"), F.max("repository").alias("repository"))
    spans = blocks.select(*version, "repository", block_map("pieces").alias("b"))
    files = spans.groupBy(*version).agg(ordered(["b.start_line", "b.end_line", "b.map", "b.status"]).alias("blocks"), F.max("repository").alias("repository"))
    told = cut(files.select(*version, "repository", verdict(ext, "blocks").alias("status")))
    few = told.where("status = 'again'").select(*version)
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    texts = source.where("content is not null").select(*version, start.alias("start_line"), "ingested_at", "content").join(few, version, "left_semi")
    latest = texts.groupBy(*version, "start_line").agg(F.max_by("content", F.struct("ingested_at", "content")).alias("content"))
    again = latest.groupBy(*version).agg(ordered(["start_line", "content"]).alias("chunks")).select(*version, whole_verdict(ext, "chunks").alias("whole"))
    joined = told.join(again, version, "left").withColumn("status", F.coalesce("whole", "status"))
    return joined.select(*version, code_language(ext).alias("language"), "repository", "status")


def source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that ``file_syntax`` reads."""
    return table(spark, sf_dir, "code_chunks").select("commit_sha", "file", "start_line", "end_line", "content", "ingested_at", "repository")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = file_syntax(spread(source_chunks(spark, sf_dir)))
    return status.where(~F.col("status").isin("valid", "incomplete")).select("commit_sha", "file")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of files that don't parse, per repository and language; a repository lost in chunks is taken from the commit."""
    status = file_syntax(spread(source_chunks(spark, sf_dir))).where("status <> 'incomplete'")
    known = table(spark, sf_dir, "commits").groupBy("commit_sha").agg(F.max("repository").alias("of_commit"))
    bad = F.count_if(F.col("status") != "valid")
    return (
        status.join(known, "commit_sha", "left")
        .groupBy(F.coalesce("repository", "of_commit", F.lit("unknown")).alias("repository"), "language")
        .agg(F.count("*").alias("files"), bad.alias("invalid"), F.round(bad / F.count("*"), 6).alias("share"))
    )


QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates}
