"""Files of a folder, and exported version history, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions.globs import regex
from lodestack.functions.text import extension, language_of

#: Extensions of files that hold no text.
BINARY = ("png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "gz", "tar", "exe", "dll", "so", "dylib", "class", "jar", "woff", "woff2", "ttf", "mp3", "mp4", "bin")


def walk(spark: SparkSession, root: str, include: tuple[str, ...] = ("**",), exclude: tuple[str, ...] = (), max_bytes: int = 10 * 1024 * 1024, max_depth: int = 10) -> DataFrame:
    """relative_path, size, modified, extension, language, is_binary, content of the files under a folder.

    Hidden files and folders, too deep, too large and excluded ones are left out; an excluded folder takes what is under it along.
    Listing and reading are Spark's; sizes and times prune before contents are read. Text that isn't UTF-8 has its bad
    bytes replaced. Empty files have nothing to read, so Spark leaves them out.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base) + "/", "")
    x = files.where(F.col("length") <= max_bytes).select(relative.alias("relative_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    parts = F.split("relative_path", "/")
    x = x.where((F.size(parts) <= max_depth + 1) & ~F.exists(parts, lambda p: p.startswith(".")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    x = x.where(F.lit(False) if not include else _any(F.col("relative_path"), include))
    if exclude:
        x = x.where(~F.exists(prefixes, lambda p: _any(p, exclude)))
    ext = extension(F.col("relative_path"))
    binary = ext.isin(*BINARY) | (F.expr("instr(hex(substring(content, 1, 512)), '00') > 0") & F.expr("exists(sequence(1, least(length(content), 512)), i -> substring(content, i, 1) = X'00')"))
    return x.select("relative_path", "size", "modified", ext.alias("extension"), language_of(F.col("relative_path")).alias("language"), F.coalesce(binary, F.lit(False)).alias("is_binary"), F.col("content").cast("string").alias("content"))


def _any(path, patterns):
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(regex(p))
    return out


LOG_HEAD = "\x1e"


def commits_of(log: DataFrame, text: str = "value") -> DataFrame:
    """Commits from the text of ``git log --numstat --format=%x1e%H%x1f%P%x1f%an%x1f%ae%x1f%aI%x1f%s``, one row a commit.

    Binary files have "-" for their counts and add no lines; a commit with two parents is a merge. Each row of ``log`` is one
    exported log, of one repository or a part of one.
    """
    entries = log.select(F.explode(F.split(F.col(text), LOG_HEAD)).alias("e")).where("trim(e) <> ''")
    lines = F.split("e", r"\r?\n")
    head = F.split(lines[0], "\x1f")
    stats = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.rlike(r"^(?:\d+|-)\t(?:\d+|-)\t"))
    total = lambda k: F.aggregate(stats, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(F.split(x, "\t")[k].try_cast("bigint"), F.lit(0)))
    parents = F.filter(F.split(head[1], " "), lambda p: p != "")
    return entries.select(
        head[0].alias("commit_sha"), F.substring(head[0], 1, 7).alias("short_hash"), parents.alias("parent_hashes"), head[2].alias("author"), head[3].alias("author_email"), F.try_to_timestamp(head[4]).alias("commit_date"), head[5].alias("message"),
        F.transform(stats, lambda x: F.split(x, "\t", 3)[2]).alias("files"), total(0).alias("lines_added"), total(1).alias("lines_deleted"), (F.size(parents) > 1).alias("is_merge"),
    )


def recent(commits: DataFrame, n: int, since: str | None = None, author: str | None = None) -> DataFrame:
    """The n newest commits, of an author or since a time if given; ties go by hash."""
    x = commits
    if since:
        x = x.where(F.col("commit_date") >= F.lit(since).cast("timestamp"))
    if author:
        x = x.where(F.col("author") == author)
    return x.orderBy(F.desc("commit_date"), "commit_sha").limit(n)


def reviews(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON reviews; files that don't fit the schema are left out, the newest of a repeated id stays."""
    x = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").option("multiLine", True).json(path).where("_broken is null and id is not null").drop("_broken")
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("timestamp"), *[c for c in x.columns if c not in ("id", "timestamp") and dict(x.dtypes)[c] == "string"])
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
