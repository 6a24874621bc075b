"""Filters, projections and scalar functions over the chunk table, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.functions import text as X
from lodestack.functions.globs import regex
from lodestack.functions.scoring import ENTRY_NAMES, FOLDER_RULES, NAME_RULES, TYPE_BONUS, code_quality, file_importance, recency, relevance
from lodestack.operators.filters import compiled
from lodestack.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def chunks(spark, d):
    return table(spark, d, "code_chunks")


def filtered(spark, d, spec, *columns):
    return chunks(spark, d).where(compiled(spec)[0]).select(*columns)


@query("""SELECT id, file, language, chunk_type FROM code_chunks WHERE language IN ('typescript','python','go') AND NOT coalesce(chunk_type IN ('class','other'), false) AND NOT coalesce(file IN ('src/index.ts'), false)""")
def filter_in_notin(spark, d):
    return filtered(spark, d, {"languages": ["typescript", "python", "go"], "exclude_chunk_types": ["class", "other"], "exclude_files": ["src/index.ts"]}, "id", "file", "language", "chunk_type")


GLOBS = {"file_patterns": ["{src,lib,app}/**/*.{ts,py}"], "exclude_patterns": ["**/*_test.*", "src/legacy/**"]}


@query(f"""SELECT id, file FROM code_chunks WHERE regexp_matches(file, '{regex(GLOBS["file_patterns"][0])}') AND NOT coalesce(regexp_matches(file, '{regex(GLOBS["exclude_patterns"][0])}'), false) AND NOT coalesce(regexp_matches(file, '{regex(GLOBS["exclude_patterns"][1])}'), false)""")
def filter_glob(spark, d):
    return filtered(spark, d, GLOBS, "id", "file")


@query("""SELECT id, complexity, CAST(len(coalesce(imports, [])) AS INTEGER) AS n_imports FROM code_chunks WHERE complexity >= 5 AND complexity <= 15 AND epoch(created_at) >= 1704067200 AND epoch(created_at) <= 1735689600 AND coalesce(len(imports), 0) > 0""")
def filter_range(spark, d):
    spec = {"min_complexity": 5, "max_complexity": 15, "created_after": "2024-01-01 00:00:00+00:00", "created_before": "2025-01-01 00:00:00+00:00", "has_imports": True}
    return filtered(spark, d, spec, "id", "complexity", F.size("imports").alias("n_imports"))


@query("""SELECT id, branch, start_line FROM code_chunks WHERE branch IN ('main','master','trunk') AND start_line >= 40 AND start_line < 400 AND chunk_type = 'block'""")
def filter_custom(spark, d):
    return filtered(spark, d, {"custom": {"branch": {"match": {"any": ["main", "master", "trunk"]}}, "start_line": {"range": {"gte": 40, "lt": 400}}, "chunk_type": "block"}}, "id", "branch", "start_line")


@query("""SELECT id, coalesce(language, 'unknown') AS language, coalesce(chunk_type, 'unknown') AS chunk_type, coalesce(start_line, 1) AS start_line, coalesce(end_line, 1) AS end_line, coalesce(author, 'Unknown') AS author, coalesce(branch, 'main') AS branch FROM code_chunks""")
def projection_defaults(spark, d):
    unknown = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return chunks(spark, d).select("id", unknown("language", "unknown"), unknown("chunk_type", "unknown"), unknown("start_line", 1), unknown("end_line", 1), unknown("author", "Unknown"), unknown("branch", "main"))


@query("""SELECT id, regexp_extract(file, '([^/]*)$', 1) AS base, array_to_string(list_slice(string_split(file, '/'), greatest(len(string_split(file, '/')) - 2, 1), len(string_split(file, '/'))), '/') AS tail, lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM code_chunks""")
def path_projection(spark, d):
    return chunks(spark, d).select("id", X.basename(F.col("file")).alias("base"), X.last_segments(F.col("file"), 3).alias("tail"), X.extension(F.col("file")).alias("ext"))


LANGUAGE_CASE = "CASE lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.EXTENSION_LANGUAGE.items()) + " ELSE 'unknown' END"


@query(f"""SELECT {LANGUAGE_CASE} AS detected, count(*) AS chunks, count(DISTINCT file) AS files, count(*) FILTER (WHERE lower(trim(language)) = {LANGUAGE_CASE}) AS agreeing FROM code_chunks GROUP BY 1""")
def language_detect(spark, d):
    detected = X.language_of(F.col("file"))
    return chunks(spark, d).select(detected.alias("detected"), "file", F.coalesce(F.lower(F.trim("language")) == detected, F.lit(False)).alias("same")).groupBy("detected").agg(F.count("*").alias("chunks"), F.count_distinct("file").alias("files"), F.count_if("same").alias("agreeing"))


@query("""SELECT id, CAST(ceil(coalesce(length(content), 0) / 4.0) AS BIGINT) AS tokens, CAST(ceil(coalesce(length(content), 0) / 4.0 * 1.1) AS BIGINT) AS buffered FROM code_chunks""")
def token_estimate(spark, d):
    return chunks(spark, d).select("id", X.tokens(F.col("content")).alias("tokens"), X.tokens(F.col("content"), 1.1).alias("buffered"))


@query("""SELECT doc_id, CASE WHEN length(t) > 50 THEN concat(trim(substring(t, 1, 50)), '...') ELSE trim(t) END AS preview FROM (SELECT doc_id, translate(coalesce(text, ''), chr(10) || chr(13), '  ') AS t FROM documents)""")
def content_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", X.preview(F.col("text"), 50).alias("preview"))


@query("""SELECT id, sha256(content) AS digest, sha256(content) = sha256 AS same FROM code_chunks WHERE content IS NOT NULL""")
def content_digest(spark, d):
    digest = F.sha2("content", 256)
    return chunks(spark, d).where("content is not null").select("id", digest.alias("digest"), (digest == F.col("sha256")).alias("same"))


CUT = "substring(text, 1, 240)"


def _back(mark: str, pattern: str, keep: int) -> str:
    at = f"(length(regexp_extract({CUT}, '(?s)^(.*){pattern}', 1)) + 1)"
    return f"WHEN contains({CUT}, {mark}) AND {at} - 1 > 192 THEN substring({CUT}, 1, {at} - {keep})"


@query(f"""SELECT doc_id, CASE WHEN ceil(length(text) / 4.0) <= 60 THEN text ELSE concat(CASE {_back("chr(10)", "\\n", 1)} {_back("' '", " ", 1)} {_back("'.'", "[.]", 0)} ELSE {CUT} END, ' [cut]') END AS short FROM documents WHERE text IS NOT NULL""")
def truncate_text(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.truncated(F.col("text"), F.lit(60), " [cut]").alias("short"))


def _plain_sql(c: str) -> str:
    for pattern, to in X.MARKDOWN:
        t = to.replace("$1", "\\1")
        t = f"'{t}'" if "\n" not in t else "chr(10) || chr(10)"
        c = f"regexp_replace({c}, '{pattern}', {t}, 'g')"
    return f"regexp_replace({c}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')"


@query(f"""SELECT id, {_plain_sql("raw_response")} AS plain FROM cloud_responses WHERE raw_response IS NOT NULL""")
def markdown_clean(spark, d):
    return table(spark, d, "cloud_responses").where("raw_response is not null").select("id", X.plain(F.col("raw_response")).alias("plain"))


def _count(p: str) -> str:
    return f"len(regexp_extract_all(coalesce(content, ''), '{p}'))"


@query(
    r"""WITH t AS (SELECT id, coalesce(content, '') AS c FROM code_chunks)
SELECT id, CAST(greatest(2 * len(regexp_extract_all(c, '\b(if|for|while|do|switch|try|catch|else|elif)\b')) + 3 * len(regexp_extract_all(c, '\bfunction\b|\b=>\b|\bdef\b|\bclass\b|\binterface\b'))
  + floor(len(regexp_extract_all(c, '[-+*/%=<>&^|!~?]+')) / 3.0) + floor(len(regexp_extract_all(c, '[{(\[]')) / 2.0), 1) AS BIGINT) AS score FROM t"""
)
def regex_complexity(spark, d):
    return chunks(spark, d).select("id", X.complexity(F.col("content")).alias("score"))


_IMPORTS_SQL = X.IMPORTS.replace("'", "''")


@query(f"""SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(content, ''), '{_IMPORTS_SQL}', 1))), ',') AS modules FROM code_chunks""")
def import_extract(spark, d):
    return chunks(spark, d).select("id", F.array_join(X.imports(F.col("content")), ",").alias("modules"))


@query(r"""SELECT id, regexp_matches(coalesce(content, ''), '(?m)^\s*(?://|#|/\*|\*)') AS has_comments, regexp_matches(coalesce(content, ''), '\b(?:function|def|func|fn)\b|=>') AS has_functions, regexp_matches(coalesce(content, ''), '\b(?:class|interface|struct|enum|trait)\b') AS has_classes, CAST(len(string_split(coalesce(content, ''), chr(10))) AS INTEGER) AS line_count FROM code_chunks""")
def content_flags(spark, d):
    from lodestack.operators.chunkers import flags

    return chunks(spark, d).select("id", *flags(F.col("content")))


def _rules(column: str, rules: list) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{'|'.join(w)}') THEN {v}" for w, v in rules) + " END"


_NAME, _FOLDER = "lower(regexp_extract(file, '([^/]*)$', 1))", "lower(regexp_extract(file, '([^/]*)/[^/]*$', 1))"
IMPORTANCE_SQL = f"greatest(0.5, {_rules(_NAME, NAME_RULES)}, {_rules(_FOLDER, FOLDER_RULES)}, CASE WHEN {_NAME} IN ({', '.join(repr(x) for x in ENTRY_NAMES)}) THEN 0.95 END)"


@query(f"""SELECT DISTINCT file, round(CAST({IMPORTANCE_SQL} AS DOUBLE), 6) AS importance FROM code_chunks""")
def path_importance(spark, d):
    return chunks(spark, d).select("file", F.round(file_importance(F.col("file")), 6).alias("importance")).distinct()


_BONUS = "CASE chunk_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_BONUS.items()) + " ELSE 0.0 END"


@query(f"""SELECT id, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN complexity > 0 AND complexity < 10 THEN 0.05 WHEN complexity >= 10 AND complexity < 20 THEN 0.02 ELSE 0.0 END + CASE WHEN coalesce(len(dependencies), 0) > 0 THEN 0.1 ELSE 0.0 END + CASE WHEN coalesce(len(imports), 0) > 0 THEN 0.1 ELSE 0.0 END + {_BONUS}))::DOUBLE, 6) AS quality FROM code_chunks""")
def code_quality_factor(spark, d):
    return chunks(spark, d).select("id", F.round(code_quality(F.col("complexity"), F.col("dependencies"), F.col("imports"), F.col("chunk_type")), 6).alias("quality"))


TERMS = "cache session token"
_HITS = " + ".join(f"CAST(contains(lower(coalesce(content, '')), '{t}') AS DOUBLE)" for t in TERMS.split())
_PATH = " OR ".join(f"contains(lower(file), '{t}')" for t in TERMS.split())


@query(f"""SELECT id, round(greatest(0.0, least(1.0, CASE WHEN {_HITS} = 3 THEN 0.9 ELSE ({_HITS}) / 3 * 0.7 END + CASE WHEN {_PATH} THEN 0.1 ELSE 0.0 END + CASE WHEN chunk_type IN ('function','class','method') THEN 0.05 ELSE 0.0 END)), 6) AS relevance FROM code_chunks""")
def relevance_terms(spark, d):
    return chunks(spark, d).select("id", F.round(relevance(TERMS, F.col("content"), F.col("file"), F.col("chunk_type")), 6).alias("relevance"))


AS_OF = 1767225600


@query(f"""SELECT id, round(greatest(0.0, least(1.0, power(0.9, ({AS_OF} - epoch(created_at)) / 86400.0 / 30))), 6) AS recency FROM code_chunks WHERE created_at IS NOT NULL""")
def recency_decay(spark, d):
    return chunks(spark, d).where("created_at is not null").select("id", F.round(recency(F.col("created_at"), F.timestamp_seconds(F.lit(AS_OF))), 6).alias("recency"))


@query("""SELECT file, coalesce(language, 'unknown') AS language, len(content) AS n FROM code_chunks WHERE content IS NOT NULL AND len(content) BETWEEN 500 AND 1500 AND contains(lower(content), 'async') AND contains(lower(content), 'await')""")
def code_pattern_async(spark, d):
    low = F.lower("content")
    return chunks(spark, d).where(F.length("content").between(500, 1500) & F.contains(low, F.lit("async")) & F.contains(low, F.lit("await"))).select("file", F.coalesce("language", F.lit("unknown")).alias("language"), F.length("content").cast("bigint").alias("n"))


@query("""WITH u AS (SELECT id, flatten(list_transform(list_filter(string_split(content, ''), lambda c: c <> ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] ELSE [unicode(c)] END)) AS units FROM code_chunks WHERE content IS NOT NULL),
h AS (SELECT id, list_reduce(list_prepend(0::BIGINT, units), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM u)
SELECT id, lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 36)) AS hash FROM h""")
def content_hash32(spark, d):
    return chunks(spark, d).where("content is not null").select("id", X.hash32(F.col("content")).alias("hash"))
