"""Scores in parts, prompts put together under a budget, objects in answers, and chunks of whole source files, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.functions import scoring as S
from lodestack.functions.vectors import euclidean
from lodestack.operators import answers as A
from lodestack.operators import chunkers as C
from lodestack.operators import diffs as D
from lodestack.operators import nodes as N
from lodestack.operators import prompts as P
from lodestack.operators.filters import compiled
from lodestack.plans.filters import AS_OF, IMPORTANCE_SQL
from lodestack.plans.retrieval import file_chunks
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


#: A query as users ask it: its words, the languages and files they prefer, and weights for these.
ASKED, LANGUAGES, FILES = "cache queue lock", ["typescript", "go"], ["src/", "lib/"]
CUSTOM = {"query_term_match": 0.05, "language_match": 0.03, "file_match": 0.02}
LABELS = {"semantic": "Semantic Similarity", "recency": "Recency", "file_importance": "File Importance", "query_term_match": "queryTermMatch", "language_match": "languageMatch", "file_match": "fileMatch"}


def _factors():
    return {
        "semantic": F.col("semantic_score"), "recency": S.recency(F.col("retrieved_at"), F.timestamp_seconds(F.lit(AS_OF))), "file_importance": S.file_importance(F.coalesce("file", F.lit(""))),
        "query_term_match": S.term_match(ASKED, F.col("content")), "language_match": S.any_match(F.lower("language"), LANGUAGES), "file_match": S.any_match(F.col("file"), FILES),
    }


_FACTOR_SQL = f"""SELECT retrieval_id, hit_rank, chunk_id, semantic_score AS semantic,
  coalesce(greatest(0.0, least(1.0, power(0.9, ({AS_OF} - epoch(retrieved_at)) / 86400.0 / 30))), 0.5) AS recency, CAST({IMPORTANCE_SQL.replace('(file,', "(coalesce(file, ''),")} AS DOUBLE) AS file_importance,
  (CAST(contains(lower(coalesce(content, '')), 'cache') AS INT) + CAST(contains(lower(coalesce(content, '')), 'queue') AS INT) + CAST(contains(lower(coalesce(content, '')), 'lock') AS INT)) / 3.0::DOUBLE AS query_term_match,
  CASE WHEN contains(lower(language), 'typescript') OR contains(lower(language), 'go') THEN 1.0 ELSE 0.0 END::DOUBLE AS language_match,
  CASE WHEN contains(file, 'src/') OR contains(file, 'lib/') THEN 1.0 ELSE 0.0 END::DOUBLE AS file_match
FROM retrieved_chunks WHERE semantic_score IS NOT NULL"""
_TOTAL_SQL = "greatest(0.0, least(1.0, semantic * 0.7 + recency * 0.2 + file_importance * 0.1 + query_term_match * 0.05 + language_match * 0.03 + file_match * 0.02))"


def _three(x: str) -> str:
    return f"printf('%.3f', floor({x} * 1000 + 0.5) / 1000)"


@query(f"""WITH f AS ({_FACTOR_SQL}) SELECT retrieval_id, hit_rank, chunk_id, round(semantic * 0.7, 6) AS semantic, round(recency * 0.2, 6) AS recency, round(file_importance * 0.1, 6) AS file_importance,
round(query_term_match * 0.05, 6) AS query_term_match, round(language_match * 0.03, 6) AS language_match, round(file_match * 0.02, 6) AS file_match, round({_TOTAL_SQL}, 6) AS total FROM f""")
def score_breakdown(spark, d):
    """What each factor, the query's own ones too, adds to the score of every hit."""
    x, f, w = table(spark, d, "retrieved_chunks").where("semantic_score is not null"), _factors(), S.WEIGHTS | CUSTOM
    parts = [F.round(F.element_at(F.array(c), 1), 6).alias(n) for n, c in zip(f, S.contributions(f, w))]
    return x.select("retrieval_id", "hit_rank", "chunk_id", *parts, F.round(S.hybrid(f, w), 6).alias("total"))


@query(f"""WITH f AS ({_FACTOR_SQL}) SELECT retrieval_id, hit_rank, chunk_id, concat('Total Score: ', {_three(_TOTAL_SQL)}, chr(10), 'Semantic Similarity: ', {_three('semantic')}, ' (weight: 0.7)', chr(10), 'Recency: ', {_three('recency')}, ' (weight: 0.2)', chr(10),
'File Importance: ', {_three('file_importance')}, ' (weight: 0.1)', chr(10), 'queryTermMatch: ', {_three('query_term_match')}, ' (weight: 0.05)', chr(10), 'languageMatch: ', {_three('language_match')}, ' (weight: 0.03)', chr(10), 'fileMatch: ', {_three('file_match')}, ' (weight: 0.02)') AS explanation FROM f""")
def score_explanation(spark, d):
    x = table(spark, d, "retrieved_chunks").where("semantic_score is not null")
    return x.select("retrieval_id", "hit_rank", "chunk_id", S.explanation(_factors(), S.WEIGHTS | CUSTOM, LABELS).alias("explanation"))


_RANKED_SQL = """k AS (SELECT id, max(lower(chunk_type)) AS kind FROM code_chunks GROUP BY 1), h AS (SELECT retrieval_id, chunk_id, max(score) AS score, max(file) AS file, max(content) AS content FROM retrieved_chunks GROUP BY 1, 2),
r AS (SELECT h.*, row_number() OVER (PARTITION BY retrieval_id ORDER BY CASE kind WHEN 'function' THEN 5 WHEN 'class' THEN 4 WHEN 'method' THEN 3 WHEN 'module' THEN 2 WHEN 'block' THEN 1 ELSE 0 END DESC, score DESC NULLS LAST, chunk_id) AS place FROM h LEFT JOIN k ON h.chunk_id = k.id)"""


def _ranked(spark, d):
    kinds = table(spark, d, "code_chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.max(F.lower("chunk_type")).alias("kind"))
    hits = table(spark, d, "retrieved_chunks").groupBy("retrieval_id", "chunk_id").agg(*[F.max(c).alias(c) for c in ("score", "file", "content")])
    return P.prioritised(hits.join(kinds, "chunk_id", "left"), ["retrieval_id"], "kind", "score", "chunk_id")


@query(f"WITH {_RANKED_SQL} SELECT retrieval_id, chunk_id, place FROM r")
def chunks_by_priority(spark, d):
    return _ranked(spark, d).select("retrieval_id", "chunk_id", "place")


BUDGET, INTRO, TASK, NOTICE = 400, "You review source code with care.", "Report every real problem.", " [cut]"
_SECTIONS_SQL = f"""{_RANKED_SQL}, e AS (SELECT retrieval_id, place, concat(coalesce(file, ''), chr(10), coalesce(content, '')) AS entry FROM r),
c AS (SELECT retrieval_id, string_agg(entry, chr(10) || chr(10) ORDER BY place) AS context FROM (SELECT *, ceil(sum(length(entry)) OVER (PARTITION BY retrieval_id ORDER BY place ROWS UNBOUNDED PRECEDING) / 4 * 1.1) AS used FROM e) WHERE used <= 200 GROUP BY 1),
v AS (SELECT chunk_id, id, max(concat('- [', coalesce(lower(severity), 'unknown'), '] ', coalesce(summary, ''))) AS line FROM review_insights WHERE chunk_id IS NOT NULL GROUP BY 1, 2),
n AS (SELECT retrieval_id, string_agg(line, chr(10) ORDER BY id) AS insights FROM (SELECT DISTINCT r.retrieval_id, v.id, v.line FROM r JOIN v ON r.chunk_id = v.chunk_id) GROUP BY 1),
s AS (SELECT q.retrieval_id, '{INTRO}' AS preamble, coalesce(context, '') AS context, coalesce(insights, '') AS insights, '{TASK}' AS instructions FROM (SELECT DISTINCT retrieval_id FROM r) q LEFT JOIN c USING (retrieval_id) LEFT JOIN n USING (retrieval_id))"""
_NAMES = ["preamble", "context", "insights", "instructions"]
_CUT, _LIMIT = f"substring(whole, 1, {BUDGET * 4})", 0.8 * BUDGET * 4


def _place(pattern: str) -> str:
    return f"(length(regexp_extract({_CUT}, '(?s)^(.*){pattern}', 1)) + 1)"


_SHORT_SQL = f"""CASE WHEN ceil(length(whole) / 4.0) <= {BUDGET} THEN whole ELSE concat(CASE WHEN contains({_CUT}, chr(10)) AND {_place(chr(92) + 'n')} - 1 > {_LIMIT} THEN substring({_CUT}, 1, {_place(chr(92) + 'n')} - 1)
WHEN contains({_CUT}, ' ') AND {_place(' ')} - 1 > {_LIMIT} THEN substring({_CUT}, 1, {_place(' ')} - 1) WHEN contains({_CUT}, '.') AND {_place('[.]')} - 1 > {_LIMIT} THEN substring({_CUT}, 1, {_place('[.]')}) ELSE {_CUT} END, '{NOTICE}') END"""


def _sections(spark, d):
    """preamble, context, insights, instructions of every retrieval: its chunks by priority within half the budget, and the insights on them."""
    ranked = _ranked(spark, d)
    entries = ranked.select("retrieval_id", "place", F.concat(F.coalesce("file", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit(""))).alias("entry"))
    inside = P.within_budget(entries, ["retrieval_id"], ["place"], "entry", BUDGET // 2)
    context = inside.groupBy("retrieval_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]), "\n\n").alias("context"))
    line = F.concat(F.lit("- ["), F.coalesce(F.lower("severity"), F.lit("unknown")), F.lit("] "), F.coalesce("summary", F.lit("")))
    notes = table(spark, d, "review_insights").where("chunk_id is not null").groupBy("chunk_id", "id").agg(F.max(line).alias("line"))
    insights = ranked.select("retrieval_id", "chunk_id").join(notes, "chunk_id").groupBy("retrieval_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("id", "line"))), lambda x: x["line"]), "\n").alias("insights"))
    every = ranked.select("retrieval_id").distinct().join(context, "retrieval_id", "left").join(insights, "retrieval_id", "left")
    return every.select("retrieval_id", F.lit(INTRO).alias("preamble"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("context", "insights")], F.lit(TASK).alias("instructions"))


@query(f"""WITH {_SECTIONS_SQL}, w AS (SELECT retrieval_id, array_to_string(list_filter([preamble, context, insights, instructions], lambda x: trim(x) <> ''), chr(10) || chr(10)) AS whole FROM s), x AS (SELECT retrieval_id, whole, {_SHORT_SQL} AS text FROM w)
SELECT retrieval_id, md5(text) AS digest, CAST(ceil(length(text) / 4.0) AS BIGINT) AS token_count, CAST(ceil(length(whole) / 4.0) AS BIGINT) AS budget_used, CAST({BUDGET} - ceil(length(whole) / 4.0) AS BIGINT) AS budget_remaining, ceil(length(whole) / 4.0) > {BUDGET} AS truncated FROM x""")
def composed_prompts(spark, d):
    return P.composed(_sections(spark, d), _NAMES, BUDGET, NOTICE).select("retrieval_id", F.md5("text").alias("digest"), "token_count", "budget_used", "budget_remaining", "truncated")


@query(f"""WITH {_SECTIONS_SQL}, t AS (SELECT retrieval_id, {', '.join(f'CAST(ceil(length({n}) / 4.0) AS BIGINT) AS {n}_tokens' for n in _NAMES)} FROM s), u AS (SELECT *, {' + '.join(f'{n}_tokens' for n in _NAMES)} AS estimated FROM t)
SELECT *, round(estimated / {BUDGET}.0 * 100, 6)::DOUBLE AS utilisation, CASE WHEN estimated / {BUDGET}.0 * 100 > 100 THEN 'over budget' WHEN estimated / {BUDGET}.0 * 100 > 80 THEN 'high utilisation' END AS warning FROM u""")
def composition_preview(spark, d):
    return P.preview(_sections(spark, d), _NAMES, BUDGET).drop(*_NAMES).withColumn("utilisation", F.round("utilisation", 6))


def _answers(spark, d):
    return table(spark, d, "cloud_responses").where("raw_response is not null").groupBy("id").agg(F.max("raw_response").alias("raw_response"))


@query()
def answer_json(spark, d):
    """The JSON of every answer: of its fence, its first balanced object, or the whole; null if there is none."""
    return _answers(spark, d).select("id", A.json_text(F.col("raw_response")).alias("json"))


@query()
def answer_objects(spark, d):
    """All outermost objects of every answer, one row each, in order."""
    return _answers(spark, d).select("id", F.posexplode(A.objects(F.col("raw_response"))).alias("ordinal", "json"))


_LINES_SQL = """c AS (SELECT commit_sha, file, coalesce(start_line, 1) AS s, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM code_chunks WHERE content IS NOT NULL AND commit_sha IS NOT NULL AND regexp_matches(lower(file), '[.]{ext}$')),
l AS (SELECT commit_sha, file, s + i - 1 - 1 AS pos, arg_min(x, (s, x)) AS line FROM (SELECT commit_sha, file, s, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM c) GROUP BY 1, 2, 3)"""


def _lines(spark, d, language):
    """commit_sha, file, pos, line of all files of a language, each line once."""
    chunks = file_chunks(spark, d).where((F.col("language") == language) & (F.col("path") != ""))
    return D.chunk_lines(chunks, ["version", "path"], "content", "start_line").withColumnsRenamed({"version": "commit_sha", "path": "file"})


def _brace_sql(ext: str, heads: list[tuple[str, str]]) -> str:
    kind = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{k}'" for k, p in heads) + " END"
    name = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN trim(regexp_extract(line, '{p}', 1))" for _, p in heads) + " END"
    return f"""WITH {_LINES_SQL.replace('{ext}', ext)},
m AS (SELECT *, {kind} AS kind, {name} AS name, CAST(contains(line, '{{') AS INT) AS o, CAST(contains(line, '}}') AS INT) AS c FROM l),
v AS (SELECT *, sum(o - c) OVER (PARTITION BY commit_sha, file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS level FROM m),
h AS (SELECT v.commit_sha, v.file, v.pos, v.kind, v.name, min(e.pos) AS stop FROM v LEFT JOIN v e ON v.commit_sha = e.commit_sha AND v.file = e.file AND e.c = 1 AND e.pos >= v.pos AND e.level = v.level - v.o + v.c WHERE v.kind IS NOT NULL GROUP BY 1, 2, 3, 4, 5)
SELECT commit_sha, file, kind, name, CAST(pos + 1 AS INTEGER) AS start_line, CAST(coalesce(stop, pos) + 1 AS INTEGER) AS end_line FROM h
UNION ALL SELECT commit_sha, file, 'file', NULL, 1, CAST(max(pos) + 1 AS INTEGER) FROM m GROUP BY 1, 2 HAVING max(kind) IS NULL"""


@query(_brace_sql("go", [("function", r"^func\s+([^(]+)\("), ("method", r"^func\s*\([^)]+\)\s+([^(]+)\(")]))
def go_chunks(spark, d):
    return C.brace_chunks(_lines(spark, d, "go"), ["commit_sha", "file"], "go").select("commit_sha", "file", "kind", "name", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))


@query(_brace_sql("rs", [("function", r"^fn\s+([^(]+)\("), ("class", r"^impl\s+([^{]+)\s*\{")]))
def rust_chunks(spark, d):
    return C.brace_chunks(_lines(spark, d, "rust"), ["commit_sha", "file"], "rust").select("commit_sha", "file", "kind", "name", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"))


@query()
def dart_windows(spark, d):
    return C.seeking_windows(_lines(spark, d, "dart"), ["commit_sha", "file"])


@query("""SELECT q.vec_id AS id, round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])), 6) AS distance FROM embeddings q JOIN embeddings r ON r.vec_id = q.vec_id + 1""")
def neighbour_distances(spark, d):
    """The Euclidean distance of every vector to that of the next id."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v.join(v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("other")), "id").select("id", F.round(euclidean(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("""WITH i AS (SELECT id, max(coalesce(lower(category), 'unknown')) AS category, max(coalesce(lower(severity), 'unknown')) AS severity, max(confidence) AS confidence FROM review_insights GROUP BY 1)
SELECT category, severity, count(*) AS n, round(coalesce(avg(confidence), 0), 6) AS confidence, grouping(category, severity) AS level FROM i GROUP BY GROUPING SETS ((category), (severity), ())""")
def insight_summary(spark, d):
    """Insights by category, by severity and in all, with their mean confidence."""
    i = table(spark, d, "review_insights").groupBy("id").agg(*[F.max(F.coalesce(F.lower(c), F.lit("unknown"))).alias(c) for c in ("category", "severity")], F.max("confidence").alias("confidence"))
    both = i.groupingSets([["category"], ["severity"], []], "category", "severity").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("confidence"), F.grouping_id("category", "severity").alias("level"))
    return both.select("category", "severity", "n", "confidence", F.col("level").cast("bigint").alias("level"))


@query("""WITH c AS (SELECT DISTINCT id, coalesce(repository, 'unknown') AS repository, coalesce(lower(chunk_type), 'unknown') AS kind, content FROM code_chunks WHERE content IS NOT NULL) SELECT repository, kind, count(*) AS chunks, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines, round(avg(length(content)), 4) AS mean_length FROM c GROUP BY CUBE (repository, kind)""")
def chunk_rollup(spark, d):
    """Chunks, lines and mean length by repository and kind, and for all of each."""
    c = table(spark, d, "code_chunks").where("content is not null").select("id", F.coalesce("repository", F.lit("unknown")).alias("repository"), F.coalesce(F.lower("chunk_type"), F.lit("unknown")).alias("kind"), "content").distinct()
    return c.cube("repository", "kind").agg(F.count("*").alias("chunks"), F.sum(F.size(F.split("content", "\n"))).cast("bigint").alias("lines"), F.round(F.avg(F.length("content")), 4).alias("mean_length"))


@query("""WITH r AS (SELECT DISTINCT chunk_id, file, category, round(confidence, 6) AS confidence FROM review_insights WHERE chunk_id IS NOT NULL AND confidence IS NOT NULL), t AS (SELECT chunk_id, max(file) AS file, avg(confidence) AS score FROM r GROUP BY 1) SELECT file, count(*) AS chunks, round(avg(score), 6) AS score FROM t GROUP BY 1""")
def scores_by_file(spark, d):
    """The mean over a file's chunks of the mean over each chunk's reviews."""
    r = table(spark, d, "review_insights").where("chunk_id is not null and confidence is not null").select("chunk_id", "file", "category", F.round("confidence", 6).alias("confidence")).distinct()
    t = r.groupBy("chunk_id").agg(F.max("file").alias("file"), F.avg("confidence").alias("score"))
    return t.groupBy("file").agg(F.count("*").alias("chunks"), F.round(F.avg("score"), 6).alias("score"))


@query("""WITH m AS (SELECT commit_sha, max(repository) AS repository, max(commit_date) AS day FROM commits GROUP BY 1), i AS (SELECT DISTINCT commit_sha, 1 AS hit FROM code_chunks WHERE commit_sha IS NOT NULL) SELECT repository, count(*) AS commits, CAST(count(hit) AS BIGINT) AS indexed, count(*) - count(hit) AS skipped, arg_max(m.commit_sha, (day, m.commit_sha)) AS last_commit FROM m LEFT JOIN i USING (commit_sha) GROUP BY 1""")
def commit_index_stats(spark, d):
    """Commits of each repository with and without chunks, and the last one."""
    m = table(spark, d, "commits").groupBy("commit_sha").agg(F.max("repository").alias("repository"), F.max("commit_date").alias("at"))
    i = table(spark, d, "code_chunks").select("commit_sha").where("commit_sha is not null").distinct().withColumn("hit", F.lit(1))
    x = m.join(i, "commit_sha", "left")
    return x.groupBy("repository").agg(F.count("*").alias("commits"), F.count("hit").alias("indexed"), (F.count("*") - F.count("hit")).alias("skipped"), F.max_by("commit_sha", F.struct("at", "commit_sha")).alias("last_commit"))


@query("""SELECT id, concat('File: ', coalesce(file, ''), chr(10), 'Language: ', coalesce(lower(language), 'unknown'), CASE WHEN coalesce(len(dependencies), 0) > 0 THEN concat(chr(10), 'Dependencies: ', array_to_string(dependencies, ', ')) ELSE '' END, chr(10), 'Content:', chr(10), content) AS text FROM (SELECT DISTINCT id, file, language, dependencies, content FROM code_chunks WHERE content IS NOT NULL)""")
def embedding_texts(spark, d):
    """The labelled text of a chunk that an embedding is made from."""
    c = table(spark, d, "code_chunks").where("content is not null").select("id", "file", "language", "dependencies", "content").distinct()
    needs = F.when(F.coalesce(F.size("dependencies"), F.lit(0)) > 0, F.concat(F.lit("\nDependencies: "), F.array_join("dependencies", ", "))).otherwise("")
    return c.select("id", F.concat(F.lit("File: "), F.coalesce("file", F.lit("")), F.lit("\nLanguage: "), F.coalesce(F.lower("language"), F.lit("unknown")), needs, F.lit("\nContent:\n"), F.col("content")).alias("text"))


@query("""WITH a AS (SELECT author, branch FROM code_chunks WHERE author IS NOT NULL AND branch IS NOT NULL AND len(dependencies) > 0 GROUP BY 1, 2 ORDER BY count(*) DESC, author, branch LIMIT 1)
SELECT id, commit_sha, c.author, c.branch FROM code_chunks c JOIN a ON c.author = a.author AND c.branch = a.branch WHERE coalesce(len(dependencies), 0) > 0""")
def filter_author_branch(spark, d):
    """Chunks with dependencies on the most frequent branch of an author."""
    x = table(spark, d, "code_chunks")
    most = x.where("author is not null and branch is not null and size(dependencies) > 0").groupBy("author", "branch").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author", "branch").first()
    if most is None:
        return x.limit(0).select("id", "commit_sha", "author", "branch")
    return x.where(compiled({"author": most.author, "branch": most.branch, "has_dependencies": True})[0]).select("id", "commit_sha", "author", "branch")


@query("""WITH f AS (SELECT commit_sha, file, max(repository) AS repository, max(end_line) AS lines, min(created_at) AS created FROM code_chunks WHERE commit_sha IS NOT NULL AND file IS NOT NULL AND repository IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY lines DESC NULLS LAST, file, commit_sha) AS largest, row_number() OVER (PARTITION BY repository ORDER BY created NULLS LAST, file, commit_sha) AS oldest, row_number() OVER (PARTITION BY repository ORDER BY created DESC NULLS LAST, file, commit_sha) AS newest FROM f)
SELECT repository, commit_sha, file, largest <= 10 AS is_largest, oldest <= 10 AS is_oldest, newest <= 10 AS is_newest FROM r WHERE largest <= 10 OR oldest <= 10 OR newest <= 10""")
def extreme_files(spark, d):
    """The ten largest, oldest and newest files of each repository; the number is the feature."""
    f = table(spark, d, "code_chunks").where("commit_sha is not null and file is not null and repository is not null").groupBy("commit_sha", "file").agg(F.max("repository").alias("repository"), F.max("end_line").alias("lines"), F.min("created_at").alias("created"))
    place = lambda order: F.row_number().over(Window.partitionBy("repository").orderBy(order, "file", "commit_sha")) <= 10
    x = f.select("repository", "commit_sha", "file", place(F.desc_nulls_last("lines")).alias("is_largest"), place(F.asc_nulls_last("created")).alias("is_oldest"), place(F.desc_nulls_last("created")).alias("is_newest"))
    return x.where("is_largest or is_oldest or is_newest")


def _nodes(spark, d, *languages):
    chunks = file_chunks(spark, d).where(F.col("language").isin(*languages) & (F.col("path") != ""))
    lines = D.chunk_lines(chunks, ["version", "path", "language"], "content", "start_line").withColumnsRenamed({"version": "commit_sha", "path": "file"})
    return N.nodes(lines, ["commit_sha", "file"], "language")


@query()
def script_nodes(spark, d):
    """Classes, functions, methods and the like of all TypeScript and JavaScript files."""
    return _nodes(spark, d, "typescript", "javascript")


@query()
def dart_nodes(spark, d):
    """Classes, functions and runs of imports of all Dart files."""
    return _nodes(spark, d, "dart")
