"""Problem 5: generated, minified or vendored source files.

Linear support-vector classifiers on hashed character n-grams, of the text, of its structure and of its header, and on path
components. There are no labels, so files of the fitting sample that give themselves away (a generator's or another project's
header, a tool's file name, a third party's folder, minified lines, tables of data, numbered members) are its positives; in the
result only the classifier's score counts. Giveaway headers are masked: every file with a header is in the fit twice, once with
its header masked, so that text, structure and path must tell such files without it. Files that the first fit takes for foreign
are no negatives in the second. Fitting uses a bounded sample of file versions; every chunk is then scored, and as a score is a
mean over n-grams, chunks add up to files without shuffling text. A header is the leading comments of a file's first chunk.

Cases: null contents count for nothing; empty files are hand-written; repeated deliveries count once; long files are scored whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import cut, extension, spread
from lodestack.llm.p1_syntax import EXTENSIONS, OVERLAP
from lodestack.sources.shared import new_path
from lodestack.sources.tables import table

#: File versions that the classifier is fitted on, at most (about).
SAMPLE = 9_000
#: Slots of the hashed n-grams of text and of structure, of headers, and of path components.
BITS, HEAD_BITS, PATH_BITS = 14, 12, 12
GRAMS, HEADS, PATHS = 1 << BITS, 1 << HEAD_BITS, 1 << PATH_BITS
SIZE = 2 * GRAMS + HEADS + PATHS
#: What the n-grams of each view sum to, and the weight of one path component.
VIEWS = {"raw": 100.0, "form": 100.0, "head": 200.0}
PATH_WEIGHT = 4.0
#: Regularisation and steps of a fit.
REG, STEPS = 1e-4, 30

#: What generators and other projects write at the top of files, and where tools put files.
GENERATED = re.compile(r"(?im)code generated by|@generated\b|auto-?generated\b|automatically generated|automatisch (?:erzeugt|generiert)|g[ée]n[ée]r[ée] automatiquement|generado automáticamente|自動生成|自动生成|generated (?:code|file)\b|^[\W_]*(?:this (?:file|code) (?:is|was|has been) )?generated (?:by|from) \S+|do not (?:edit|modify) (?:this file|by hand)")
COPIED = re.compile(r"(?i)\bupstream: ?https?://|\b(?:imported|copied|vendored|taken) from \S+ v?[\d.]+\b.*(?:without|un|not)|\(c\) \d{4}(?:-\d{4})? the \S+ (?:contributors|authors)|copyright (?:\(c\) )?\d{4}(?:-\d{4})? \S+ (?:project|authors|contributors)\b")
#: Where such a header names its project.
PROJECT = re.compile(r"(?i)(?:imported|copied|vendored|taken) from (\S+)|\bthe (\S+) (?:contributors|authors)|copyright (?:\(c\) )?\d{4}(?:-\d{4})? (\S+) project\b|upstream: ?https?://\S+?/([\w.-]+)/")
BUNDLED = re.compile(r"(?m)\A/\*! ?[\w.-]+ v?\d|^//[#@] ?sourceMappingURL=")
FOLDERS = {"vendor", "node_modules", "third_party", "third-party", "thirdparty", "pods", "godeps", "bower_components", "jspm_packages", "carthage", "site-packages"}
TOOL_NAMES = re.compile(r"(?:_pb2(?:_grpc)?\.pyi?|\.pb\.go|_pb\.js|\.pb-c\.[ch]|\.pb\.(?:dart|cc|h)|\.g\.dart|\.freezed\.dart|\.gen\.\w+|outerclass\.java|\.designer\.cs|\.min\.js|[-.]bundle\.js|_generated\.\w+|\.generated\.\w+)$", re.I)
COMMENT_LINE = re.compile(r"^\s*(?://|#(?!include|if|define|pragma|\[|!\[)|/\*|\*|\"\"\"|--|<!--)")
LOWER = bytes(48 if 48 <= b < 58 else 32 if b in (9, 13) else b + 32 if 65 <= b < 91 else b for b in range(256))
NAMES = re.compile(rb"[a-z_$\x80-\xff]+")
NUMBERS = re.compile(rb"[0a-f]*0[0a-fx.]*")


def head(text: str) -> tuple[str, str]:
    """The leading comments of a file and the rest."""
    lines = text.split("\n")
    n = 0
    while n < len(lines) and (not lines[n].strip() or COMMENT_LINE.match(lines[n])):
        n += 1
    return "\n".join(lines[:n]), "\n".join(lines[n:])


LONG = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{40,}+")
DATA = re.compile(rf"(?:0x[0-9a-fA-F]+|-?\d+(?:\.\d+)?|\"[\w +/=-]*\"|'[\w +/=-]*')\s*[,\])}}]|{LONG.pattern}")


NUMBERED = re.compile(r"(?<![\w$.])([A-Za-z_$]++)(\d{1,4})\b")


def traits(text: str, first: bool, shared: int = 0) -> dict:
    """What a chunk adds to its file's giveaways, without its first ``shared`` lines, which only give context.

    sure: what its header or a bundler's line says; lengths, chars, blanks, commas, data, long: of its
    lines, for tables and minified lines; stems, rows: numbered names, and how often lines have which of them; lines: declared ones.
    """
    comments, rest = head(text) if first else ("", text)
    lines = rest.split("\n")[shared:]
    own = "\n".join(lines)
    since = len(rest) - len(own)
    stems: dict[str, set[int]] = {}
    rows: Counter = Counter()
    declared = 0
    for x in lines:
        found = NUMBERED.findall(x)
        for stem, number in found:
            stems.setdefault(stem, set()).add(int(number))
        if len(x.strip()) > 3 and not COMMENT_LINE.match(x):
            declared += 1
            if found:
                rows[tuple(sorted({stem for stem, _ in found}))] += 1
    commas, long = own.count(","), bool(LONG.search(own))
    return {
        "sure": first and bool(GENERATED.search(comments) or COPIED.search(comments)) or bool(BUNDLED.search(text if first else own)), "lengths": [len(x) for x in lines if x.strip()], "chars": len(own), "blanks": own.count(" "),
        "commas": commas, "long": long, "data": sum(len(m[0]) for m in DATA.finditer(rest) if m.end() > since), "stems": {k: sorted(v) for k, v in stems.items()}, "rows": list(rows.items()), "lines": declared,
    }


def dense(own: list[dict]) -> bool:
    """Minified lines, or a table of data: hardly any blanks or words for the characters there are."""
    total = lambda k: sum(t[k] for t in own)
    size, lengths = total("chars") + len(own) - 1, sorted(n for t in own for n in t["lengths"])
    if size < 200 or not lengths:
        return False
    longest = lengths[-max(1, len(lengths) // 2) :]
    if sum(longest) / len(longest) > 300 and total("blanks") / size < 0.08:
        return True
    if total("commas") < size / 30 and not any(t["long"] for t in own):
        return False
    return total("data") > 0.6 * size


def enumerated(own: list[dict]) -> bool:
    """A tool's members: one stem numbered from 0 or 1 upwards without gaps, on most lines of what is declared."""
    seen: dict[str, set[int]] = {}
    for t in own:
        for stem, numbers in t["stems"].items():
            seen.setdefault(stem, set()).update(numbers)
    runs = {s for s, n in seen.items() if len(n) >= 6 and min(n) <= 1 and max(n) - min(n) + 1 == len(n)}
    lines = sum(t["lines"] for t in own)
    return bool(runs) and lines >= 6 and sum(n for t in own for stems, n in t["rows"] if not runs.isdisjoint(stems)) >= 0.4 * lines


def given_away(path: str, own: list[dict]) -> bool:
    """Whether a file says by itself that nobody on the team wrote it, by the traits of its chunks in order."""
    return bool(FOLDERS & set(path.lower().split("/")[:-1])) or bool(TOOL_NAMES.search(path)) or bool(own) and (any(t["sure"] for t in own) or dense(own) or enumerated(own))


def giveaway(path: str, text: str) -> bool:
    return given_away(path, [traits(text, True)])


def hashed(data: bytes, n: int, bits: int, base: int) -> np.ndarray:
    """Slots of the runs of n bytes."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    if len(b) < n:
        return np.empty(0, dtype=np.int64)
    h = np.zeros(len(b) - n + 1, dtype=np.uint32)
    for i in range(n):
        h = h * np.uint32(0x01000193) + b[i : len(b) - n + 1 + i]
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64) + base


TELLING = re.compile(r"(?m)^.*(?:sourceMappingURL|@generated|DO NOT EDIT).*$")
KEY = re.compile(r"-----BEGIN [^-]*-----[\s\S]*?(?:-----END [^-]*-----|\Z)")


def parted(text: str, first: bool) -> tuple[str, str]:
    """(header, body) of a chunk: its leading comments and lines that give a file away, and the rest, without keys, whose characters look like data."""
    comments, body = head(text) if first else ("", text)
    if any(x in body for x in ("sourceMappingURL", "@generated", "DO NOT EDIT")):
        comments = "\n".join([comments, *TELLING.findall(body)])
        body = TELLING.sub("", body)
    return comments, KEY.sub("", body) if "-----BEGIN " in body else body


def slots(text: str, first: bool) -> dict[str, np.ndarray]:
    """Slots of a chunk's n-grams by view: five characters of the body, six of its structure, without names, five of the header."""
    comments, body = parted(text, first)
    raw = re.sub(rb" *\n\s*|  +", b" ", body.encode("utf-8", "replace").translate(LOWER))
    top = re.sub(rb"\s+", b" ", re.sub(rb"[0.]*0[0.]*", b"0", comments.lower().encode("utf-8", "replace").translate(LOWER)))
    return {"raw": hashed(raw, 5, BITS, 0), "form": hashed(NUMBERS.sub(b"0", NAMES.sub(b"a", raw)), 6, BITS, GRAMS), "head": hashed(top, 5, HEAD_BITS, 2 * GRAMS)}


def path_slots(path: str) -> list[int]:
    """Hashes of folders, of their place, of the words of the name and of its ending; digits don't count."""
    *folders, name = re.sub(r"\d+(?:\.\d+)*", "0", path.lower()).split("/")
    words = [w for w in re.split(r"[-_.]", name) if w]
    marks = [*(f"d:{x}" for x in folders), *(f"p:{a}/{b}" for a, b in zip(["^", *folders], folders))]
    marks += [f"w:{w}" for w in [*words[:-1], *(w for d in folders for w in re.split(r"[-_.]", d) if w != d)]]
    marks += ["e:" + re.sub(r"^[a-z0]+", "", name), "n:" + "/".join(folders)]
    return [2 * GRAMS + HEADS + zlib.crc32(m.encode()) % PATHS for m in marks]


def own_lines(text: str, start: int, line: int) -> str:
    """A chunk's text from ``line`` of the file on; what comes before is in the chunk before it too."""
    return text if start == line else "\n".join(text.split("\n")[max(0, line - start) :])


def project(text: str) -> str | None:
    """The other project that a file's header names."""
    comments = head(text)[0]
    m = COPIED.search(comments) and PROJECT.search(comments)
    return next(x for x in m.groups() if x).lower().replace("_", "-") if m else None


EXAMPLE = T.StructType([
    T.StructField("label", T.DoubleType()), T.StructField("project", T.StringType()), T.StructField("headed", T.BooleanType()), T.StructField("keys", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType())),
])


@F.pandas_udf(EXAMPLE)
def example(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The label of a file version by its own giveaways, the project its header names, and its features: shares of n-grams, marks of the path."""

    def one(path: str, chunks: list) -> tuple:
        own, line, views, top = [], 1, {k: [] for k in VIEWS}, ""
        for c in chunks:
            start, text = c["start_line"], (c["content"] or "").replace("\r\n", "\n")
            own.append(traits(text, start == 1, max(0, line - start)))
            top = text if start == 1 else top
            for k, h in slots(own_lines(text, start, line), start == 1).items():
                views[k].append(h)
            line = start + text.count("\n") + 1
        values: dict[int, float] = {}
        for k, parts in views.items():
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            values.update(zip(keys.tolist(), (counts / max(1, counts.sum()) * VIEWS[k]).tolist()))
        headed = any(2 * GRAMS <= k < 2 * GRAMS + HEADS for k in values)
        for k in path_slots(path):
            values[k] = values.get(k, 0.0) + PATH_WEIGHT
        keys = sorted(values)
        return float(given_away(path, own)), project(top), headed, keys, [values[k] for k in keys]

    for paths, groups in parts:
        yield pd.DataFrame([one(p, g) for p, g in zip(paths, groups)], columns=EXAMPLE.names)


def sampled(chunks: DataFrame, size: int) -> DataFrame:
    """commit_sha, file, repository, label, project, headed, keys, values of about ``size`` file versions, taken by a hash of their key."""
    firsts = chunks.where("start_line = 1").count()
    part = min(1.0, size / max(1, firsts))
    own = chunks.where((F.pmod(F.xxhash64("commit_sha", "file"), F.lit(1_000_003)) < part * 1_000_003) & F.col("content").isNotNull())
    pieces = own.groupBy("commit_sha", "file", "start_line").agg(F.max_by("content", F.struct("ingested_at", "content")).alias("content"), F.max("repository").alias("repository"))
    files = pieces.groupBy("commit_sha", "file").agg(F.sort_array(F.collect_list(F.struct("start_line", "content"))).alias("chunks"), F.max("repository").alias("repository"))
    return files.select("commit_sha", "file", "repository", example("file", "chunks").alias("e")).select("commit_sha", "file", "repository", "e.*")


def vectors(examples: DataFrame) -> DataFrame:
    """Rows of the fit (label, weight, features): every file, and files with a header once more with it masked, each at half its weight."""
    headed = F.col("headed")
    copies = F.explode(F.when(headed, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    rows = examples.select("label", headed.alias("headed"), copies.alias("masked"), F.arrays_zip("keys", "values").alias("kv"))
    in_head = lambda x: (x["keys"] >= 2 * GRAMS) & (x["keys"] < 2 * GRAMS + HEADS)
    kv = F.when(F.col("masked"), F.filter("kv", lambda x: ~in_head(x))).otherwise(F.col("kv"))
    sparse = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(SIZE).alias("size"), kv["keys"].alias("indices"), kv["values"].alias("values"))
    weight = F.when(F.col("label") == 1, 4.0).otherwise(1.0) * F.when(headed, 0.5).otherwise(1.0)
    path = new_path(examples.sparkSession, "examples")
    rows.select("label", weight.alias("weight"), sparse.alias("features")).write.parquet(path)
    schema = T.StructType([T.StructField("label", T.DoubleType()), T.StructField("weight", T.DoubleType()), T.StructField("features", VectorUDT())])
    return examples.sparkSession.read.schema(schema).parquet(path)


def fitted(examples: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and intercept. Files under the name of a project that other files' headers name are labelled too; unlabelled files that the first fit takes for foreign are left out of the second."""
    if examples.select("label").distinct().count() < 2:
        return np.zeros(SIZE), -1.0
    names = [r.project for r in examples.groupBy("project").count().where("project is not null and count > 1").select("project").collect()]  # at most one a sampled file
    steps = F.transform(F.split(F.translate(F.lower("file"), "_", "-"), "/"), lambda x: F.regexp_replace(x, r"(?:-v?\d[\d.]*)?(?:\.[a-z]+)?$", ""))
    examples = examples.withColumn("label", F.when(F.arrays_overlap(steps, F.array(*map(F.lit, names))), 1.0).otherwise(F.col("label"))) if names else examples
    rows = vectors(examples)
    svm = LinearSVC(maxIter=STEPS, regParam=REG, weightCol="weight", standardization=False)
    first = svm.fit(rows)
    clean = first.transform(rows).where("label = 1 or prediction = 0").drop("rawPrediction", "prediction")
    second = svm.fit(clean)
    return second.coefficients.toArray(), second.intercept


def scored(chunks: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """commit_sha, file, score, masked of every file version: a positive score means that nobody on the team wrote it; ``masked`` is the score without its header.

    Text stays where it is: chunks give sums of weights, and these make up the score of the whole file.
    """
    held = chunks.sparkSession.sparkContext.broadcast(weights)  # SIZE numbers
    schema = T.StructType([T.StructField(x, T.DoubleType()) for k in VIEWS for x in (k, f"{k}_n")] + [T.StructField("path", T.DoubleType())])

    @F.pandas_udf(schema)
    def parts_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        w = held.value

        def one(text: str, path: str, start: int) -> list[float]:
            own = own_lines(text.replace("\r\n", "\n"), start, start + (OVERLAP if start > 1 else 0))
            out = [x for h in slots(own, start == 1).values() for x in (w[h].sum(), float(len(h)))]
            return [*out, w[path_slots(path)].sum() * PATH_WEIGHT]

        for contents, paths, starts in batches:
            yield pd.DataFrame([one(*x) for x in zip(contents, paths, starts)], columns=schema.names)

    pieces = spread(chunks.where("content is not null")).select("commit_sha", "file", "start_line", parts_of("content", "file", "start_line").alias("s"))
    pieces = pieces.groupBy("commit_sha", "file", "start_line").agg(F.max("s").alias("s"))
    share = lambda k: F.coalesce(F.sum(f"s.{k}") / F.nullif(F.sum(f"s.{k}_n"), F.lit(0.0)), F.lit(0.0)) * VIEWS[k]
    sums = pieces.groupBy("commit_sha", "file").agg((share("raw") + share("form") + F.max("s.path") + intercept).alias("masked"), share("head").alias("top"), F.sum(F.col("s.raw_n") + F.col("s.form_n") + F.col("s.head_n")).alias("grams"))
    empty = F.col("grams") == 0
    return sums.select("commit_sha", "file", F.when(empty, -1.0).otherwise(F.col("masked") + F.col("top")).alias("score"), F.when(empty, -1.0).otherwise(F.col("masked")).alias("masked"))


@F.pandas_udf(T.StringType())
def traits_of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for contents, starts in parts:
        yield pd.Series([json.dumps(traits(t.replace("\r\n", "\n"), s == 1, 0 if s == 1 else OVERLAP)) for t, s in zip(contents, starts)], dtype=object)


@F.pandas_udf(T.BooleanType())
def certain(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Giveaways of whole files, from the traits of their chunks in order."""
    for paths, own in parts:
        yield pd.Series([given_away(p, [json.loads(t["traits"]) for t in ts]) for p, ts in zip(paths, own)], dtype=bool)


def labelled(chunks: DataFrame) -> DataFrame:
    """commit_sha, file, repository, label of every file version, by its own giveaways."""
    own = spread(chunks.where("content is not null")).select("commit_sha", "file", "start_line", "repository", "ingested_at", traits_of("content", "start_line").alias("traits"))
    pieces = own.groupBy("commit_sha", "file", "start_line").agg(F.max_by("traits", F.struct("ingested_at", "traits")).alias("traits"), F.max("repository").alias("repository"))
    files = pieces.groupBy("commit_sha", "file").agg(F.sort_array(F.collect_list(F.struct("start_line", "traits"))).alias("own"), F.max("repository").alias("repository"))
    return files.select("commit_sha", "file", "repository", certain("file", "own").alias("label"))


def source_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "code_chunks").select("commit_sha", "file", F.coalesce("start_line", F.lit(1)).alias("start_line"), "content", "repository", "ingested_at")
    return chunks.where(extension(F.col("file")).isin(*EXTENSIONS) & F.col("commit_sha").isNotNull())


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = source_chunks(spark, sf_dir)
    weights, intercept = fitted(cut(sampled(chunks, SAMPLE)))
    return scored(chunks, weights, intercept).where("score > 0").select("commit_sha", "file")


def p5_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, headers (shown or masked), predicted, files over all files of repositories that the fit never saw; labels are the files' own giveaways."""
    chunks = source_chunks(spark, sf_dir)
    held_out = F.pmod(F.crc32(F.coalesce("repository", F.lit(""))), F.lit(4)) == 0
    weights, intercept = fitted(cut(sampled(chunks, SAMPLE)).where(~held_out))
    found = scored(chunks, weights, intercept).join(labelled(chunks).where(held_out), ["commit_sha", "file"])
    views = F.explode(F.array(F.struct(F.lit("shown").alias("headers"), (F.col("score") > 0).alias("predicted")), F.struct(F.lit("masked").alias("headers"), (F.col("masked") > 0).alias("predicted"))))
    return found.select("label", views.alias("v")).groupBy("label", "v.headers", "v.predicted").agg(F.count("*").alias("files"))


QUERIES = {"p5_found": p5_found, "p5_validation": p5_validation}
