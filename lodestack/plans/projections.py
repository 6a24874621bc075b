"""Projections, defaults and small filters over reviews, commits and hits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.functions import scoring as S
from lodestack.operators.answers import REVIEW
from lodestack.plans.filters import AS_OF
from lodestack.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _commits(spark, d):
    return table(spark, d, "commits").groupBy("commit_sha").agg(*[F.max(c).alias(c) for c in ("short_hash", "repository", "author", "branch", "message", "commit_date", "lines_added", "lines_deleted")])


_COMMITS = "(SELECT commit_sha, max(short_hash) AS short_hash, max(repository) AS repository, max(author) AS author, max(branch) AS branch, max(message) AS message, max(commit_date) AS commit_date, max(lines_added) AS lines_added, max(lines_deleted) AS lines_deleted FROM commits GROUP BY 1)"


@query(f"""SELECT commit_sha, concat('Commit ', coalesce(short_hash, substring(commit_sha, 1, 7)), ' by ', coalesce(author, 'Unknown'), ' on ', coalesce(branch, 'main'), chr(10), coalesce(message, ''), chr(10), '+', coalesce(lines_added, 0), ' -', coalesce(lines_deleted, 0)) AS document FROM {_COMMITS}""")
def commit_documents(spark, d):
    """The text of a commit that is searched, with a default for each thing that isn't known."""
    name, on = F.coalesce("short_hash", F.substring("commit_sha", 1, 7)), F.coalesce("branch", F.lit("main"))
    counts = [F.lit("+"), F.coalesce("lines_added", F.lit(0)), F.lit(" -"), F.coalesce("lines_deleted", F.lit(0))]
    return _commits(spark, d).select("commit_sha", F.concat(F.lit("Commit "), name, F.lit(" by "), F.coalesce("author", F.lit("Unknown")), F.lit(" on "), on, F.lit("\n"), F.coalesce("message", F.lit("")), F.lit("\n"), *counts).alias("document"))


@query("""WITH i AS (SELECT id, max(file) AS file, max(coalesce(lower(category), 'unknown')) AS category FROM review_insights GROUP BY 1) SELECT file, concat(count(*), CASE WHEN count(*) = 1 THEN ' issue' ELSE ' issues' END, ' found: ', array_to_string(list_sort(list(DISTINCT category)), ', ')) AS sentence FROM i GROUP BY 1""")
def insight_sentences(spark, d):
    """What was found in each file, in words."""
    i = table(spark, d, "review_insights").groupBy("id").agg(F.max("file").alias("file"), F.max(F.coalesce(F.lower("category"), F.lit("unknown"))).alias("category"))
    n = F.count("*")
    return i.groupBy("file").agg(F.concat(n, F.when(n == 1, " issue").otherwise(" issues"), F.lit(" found: "), F.array_join(F.array_sort(F.collect_set("category")), ", ")).alias("sentence"))


@query("""WITH r AS (SELECT id, max(prompt_id) AS prompt_id, max(model) AS model, max(raw_response) AS raw FROM cloud_responses GROUP BY 1), p AS (SELECT id, max(git_commit) AS git_commit FROM prompts GROUP BY 1)
SELECT r.id, CASE WHEN contains(raw, '"issues"') THEN 'review' ELSE 'summary' END AS kind, concat(coalesce(model, 'unknown'), ' review of ', coalesce(substring(git_commit, 1, 8), 'working tree')) AS title, length(coalesce(raw, '')) AS size FROM r JOIN p ON r.prompt_id = p.id""")
def review_metadata(spark, d):
    """Kind, title and size of every review whose prompt is known."""
    r = table(spark, d, "cloud_responses").groupBy("id").agg(F.max("prompt_id").alias("prompt_id"), F.max("model").alias("model"), F.max("raw_response").alias("raw"))
    p = table(spark, d, "prompts").groupBy(F.col("id").alias("prompt_id")).agg(F.max("git_commit").alias("git_commit"))
    kind = F.when(F.contains(F.col("raw"), F.lit('"issues"')), "review").otherwise("summary")
    title = F.concat(F.coalesce("model", F.lit("unknown")), F.lit(" review of "), F.coalesce(F.substring("git_commit", 1, 8), F.lit("working tree")))
    return r.join(p, "prompt_id").select("id", kind.alias("kind"), title.alias("title"), F.length(F.coalesce("raw", F.lit(""))).cast("bigint").alias("size"))


@query("""SELECT retrieval_id, hit_rank, concat('### ', coalesce(file, 'unknown'), ' (', coalesce(lower(language), 'text'), ', score ', printf('%.2f', floor(coalesce(hybrid_score, score, 0) * 100 + 0.5) / 100), ')', chr(10), coalesce(content, '')) AS document FROM retrieved_chunks""")
def hit_documents(spark, d):
    """Every hit as a document of the review's context."""
    score = F.format_string("%.2f", F.floor(F.coalesce("hybrid_score", "score", F.lit(0.0)) * 100 + 0.5) / 100)
    text = F.concat(F.lit("### "), F.coalesce("file", F.lit("unknown")), F.lit(" ("), F.coalesce(F.lower("language"), F.lit("text")), F.lit(", score "), score, F.lit(")\n"), F.coalesce("content", F.lit("")))
    return table(spark, d, "retrieved_chunks").select("retrieval_id", "hit_rank", text.alias("document"))


@query("""SELECT id, concat(coalesce(category, 'unknown'), ' (', coalesce(severity, 'unknown'), ') in ', coalesce(file, 'unknown'), ': ', coalesce(summary, ''), CASE WHEN suggestion IS NOT NULL THEN concat(' -> ', suggestion) ELSE '' END) AS text FROM (SELECT DISTINCT id, category, severity, file, summary, suggestion FROM review_insights)""")
def insight_texts(spark, d):
    """The text of an insight that an embedding is made from."""
    word = lambda c: F.coalesce(c, F.lit("unknown"))
    x = table(spark, d, "review_insights").select("id", "category", "severity", "file", "summary", "suggestion").distinct()
    return x.select("id", F.concat(word("category"), F.lit(" ("), word("severity"), F.lit(") in "), word("file"), F.lit(": "), F.coalesce("summary", F.lit("")), F.when(F.col("suggestion").isNotNull(), F.concat(F.lit(" -> "), "suggestion")).otherwise("")).alias("text"))


@query(f"""WITH c AS {_COMMITS}, gone AS (SELECT commit_sha FROM c WHERE epoch(commit_date) < {AS_OF} - 365 * 86400) SELECT 'commits' AS what, count(*) AS kept FROM c WHERE commit_sha NOT IN (SELECT commit_sha FROM gone) UNION ALL SELECT 'chunks', count(*) FROM code_chunks WHERE coalesce(commit_sha NOT IN (SELECT commit_sha FROM gone), true)""")
def cascade_delete(spark, d):
    """Commits and chunks that are left once commits of more than a year ago go with their chunks."""
    c = _commits(spark, d)
    gone = c.where(F.unix_micros("commit_date") < (AS_OF - 365 * 86400) * 1_000_000).select("commit_sha")
    left = lambda rows, what: rows.select("commit_sha").join(gone, "commit_sha", "left_anti").groupBy().agg(F.lit(what).alias("what"), F.count("*").alias("kept"))
    return left(c, "commits").unionByName(left(table(spark, d, "code_chunks"), "chunks"))


@query(f"""SELECT commit_sha, repository, CAST(floor(({AS_OF} - epoch(commit_date)) / 86400) AS BIGINT) AS days FROM {_COMMITS} WHERE epoch(commit_date) < {AS_OF} - 180 * 86400 ORDER BY commit_date, commit_sha""")
def old_commits(spark, d):
    """Commits older than 180 days, the oldest first."""
    age = (F.lit(AS_OF * 1_000_000) - F.unix_micros("commit_date")) / 86_400_000_000
    x = _commits(spark, d).where(F.unix_micros("commit_date") < (AS_OF - 180 * 86400) * 1_000_000)
    return x.select("commit_sha", "repository", F.floor(age).cast("bigint").alias("days"), "commit_date").orderBy("commit_date", "commit_sha").drop("commit_date")


@query("""WITH i AS (SELECT id, max(file) AS file, max(lower(severity)) AS severity, max(confidence) AS confidence FROM review_insights GROUP BY 1) SELECT id, file, CASE WHEN severity IN ('low', 'info') THEN 'resolved' ELSE 'pending' END AS status, CASE WHEN severity IN ('low', 'info') THEN concat('marked by severity: ', severity) END AS reason FROM i""")
def status_update(spark, d):
    """The status of every insight once those of some severities are marked, with the reason."""
    i = table(spark, d, "review_insights").groupBy("id").agg(F.max("file").alias("file"), F.max(F.lower("severity")).alias("severity"))
    done = F.col("severity").isin("low", "info")
    return i.select("id", "file", F.when(done, "resolved").otherwise("pending").alias("status"), F.when(done, F.concat(F.lit("marked by severity: "), "severity")).alias("reason"))


@query("""WITH i AS (SELECT id, max(file) AS file, max(confidence) AS confidence FROM review_insights GROUP BY 1) SELECT id, file, row_number() OVER (PARTITION BY file ORDER BY confidence DESC NULLS LAST, id) AS place FROM i QUALIFY place <= 20""")
def insights_per_file(spark, d):
    """The twenty most certain insights of each file; the number is the feature."""
    i = table(spark, d, "review_insights").groupBy("id").agg(F.max("file").alias("file"), F.max("confidence").alias("confidence"))
    return i.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy(F.desc_nulls_last("confidence"), "id"))).where("place <= 20").select("id", "file", "place")


@query("""SELECT doc_id, e.vec_id IS NOT NULL AS has_vector, CAST(coalesce(len(e.embedding), 0) AS INTEGER) AS dimensions FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""")
def vectors_attached(spark, d):
    """Every document with the size of its vector, if it has one."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("n"))
    return table(spark, d, "documents").select("doc_id").join(e, "doc_id", "left").select("doc_id", F.col("n").isNotNull().alias("has_vector"), F.coalesce("n", F.lit(0)).alias("dimensions"))


@query("""WITH k AS (SELECT DISTINCT file FROM code_chunks WHERE file IS NOT NULL), f AS (SELECT DISTINCT repository, unnest(files) AS file FROM commits) SELECT f.repository, count(*) AS files, CAST(count(k.file) AS BIGINT) AS stored FROM f LEFT JOIN k ON f.file = k.file GROUP BY 1""")
def files_stored(spark, d):
    """How many of the files that each repository's commits name have chunks."""
    k = table(spark, d, "code_chunks").where("file is not null").select("file").distinct().withColumn("hit", F.lit(1))
    f = table(spark, d, "commits").select("repository", F.explode("files").alias("file")).distinct()
    return f.join(k, "file", "left").groupBy("repository").agg(F.count("*").alias("files"), F.count("hit").alias("stored"))


@query("""WITH o AS (SELECT id, max(commit_sha) AS own FROM code_chunks GROUP BY 1), c AS (SELECT r.retrieval_id, min(o.own) AS current FROM retrieved_chunks r JOIN o ON r.chunk_id = o.id WHERE r.hit_rank = 1 GROUP BY 1)
SELECT r.retrieval_id, r.hit_rank, r.chunk_id FROM retrieved_chunks r JOIN o ON r.chunk_id = o.id JOIN c ON r.retrieval_id = c.retrieval_id WHERE o.own <> c.current""")
def similar_of_other_commits(spark, d):
    """Hits that don't belong to the commit of their retrieval's first hit."""
    o = table(spark, d, "code_chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.max("commit_sha").alias("own"))
    r = table(spark, d, "retrieved_chunks").select("retrieval_id", "hit_rank", "chunk_id").join(o, "chunk_id")
    c = r.where("hit_rank = 1").groupBy("retrieval_id").agg(F.min("own").alias("current"))
    return r.join(c, "retrieval_id").where("own <> current").select("retrieval_id", "hit_rank", "chunk_id")


@query("""SELECT doc_id, ceil(length(text) / 4.0) <= 100 AS fits, CASE WHEN length(text) = 0 THEN 1.0 ELSE round(least(ceil(length(text) / 4.0), 100) / ceil(length(text) / 4.0), 6) END::DOUBLE AS ratio FROM documents WHERE text IS NOT NULL""")
def budget_fits(spark, d):
    """Whether a text fits a budget of 100 tokens, and the share of it that does; 1 for an empty one."""
    n = F.ceil(F.length("text") / 4)
    return table(spark, d, "documents").where("text is not null").select("doc_id", (n <= 100).alias("fits"), F.when(n == 0, 1.0).otherwise(F.round(F.least(n, F.lit(100)) / n, 6)).alias("ratio"))


@query("""SELECT DISTINCT file, regexp_replace(replace(replace(file, chr(92), '/'), '//', '/'), '^\\./', '') AS path FROM code_chunks WHERE file IS NOT NULL""")
def sanitised_paths(spark, d):
    """Paths with slashes of one kind, none doubled, and no leading dot."""
    clean = F.regexp_replace(F.replace(F.translate("file", "\\", "/"), F.lit("//"), F.lit("/")), r"^\./", "")
    return table(spark, d, "code_chunks").where("file is not null").select("file", clean.alias("path")).distinct()


@query("""WITH c AS (SELECT DISTINCT id, file, language, content FROM code_chunks WHERE content IS NOT NULL) SELECT id, md5(concat('Review {language}: ', coalesce(file, ''), chr(10), coalesce(lower(language), 'text'), chr(10), content, chr(10), '{code}')) AS digest FROM c""")
def template_filled(spark, d):
    """A template whose every placeholder is filled at its first place only; values are taken as they are."""
    c = table(spark, d, "code_chunks").where("content is not null").select("id", "file", "language", "content").distinct()
    text = F.lit("Review {{language}: {file}\n{lang}\n{code}\n{code}")
    for name, value in (("file", F.coalesce("file", F.lit(""))), ("lang", F.coalesce(F.lower("language"), F.lit("text"))), ("code", F.col("content"))):
        at = F.locate("{" + name + "}", text)
        text = F.concat(F.substring(text, F.lit(1), at - 1), value, F.substring(text, at + len(name) + 2, F.length(text)))
    return c.select("id", F.md5(F.replace(text, F.lit("{{language}"), F.lit("{language}"))).alias("digest"))


@query("""SELECT retrieval_id, hit_rank, round(greatest(0.0, least(1.0, semantic_score * 0.4 + (CAST(contains(lower(coalesce(content, '')), 'cache') AS INT) + CAST(contains(lower(coalesce(content, '')), 'queue') AS INT)) / 2.0::DOUBLE * 0.3 + CASE WHEN contains(file, 'src/') THEN 0.2 ELSE 0.0 END + CASE WHEN contains(lower(language), 'go') THEN 0.1 ELSE 0.0 END)), 6) AS score FROM retrieved_chunks WHERE semantic_score IS NOT NULL""")
def weighted_fusion(spark, d):
    """Similarity and the query's words, path and language, by their weights."""
    factors = {"semantic": F.col("semantic_score"), "keyword": S.term_match("cache queue", F.col("content")), "path": S.any_match(F.col("file"), ["src/"]), "language": S.any_match(F.lower("language"), ["go"])}
    score = S.hybrid(factors, {"semantic": 0.4, "recency": 0.0, "file_importance": 0.0, "keyword": 0.3, "path": 0.2, "language": 0.1})
    return table(spark, d, "retrieved_chunks").where("semantic_score is not null").select("retrieval_id", "hit_rank", F.round(score, 6).alias("score"))


@query("""WITH f AS (SELECT DISTINCT commit_sha, file, lower(language) AS language, end_line FROM code_chunks WHERE epoch(created_at) > 1704067200 AND lower(language) IN ('python', 'java') AND length(content) BETWEEN 200 AND 4000) SELECT language, count(*) AS chunks, CAST(sum(end_line) AS BIGINT) AS lines FROM f GROUP BY 1""")
def files_since(spark, d):
    """Chunks of two languages since a day and within a range of sizes."""
    x = table(spark, d, "code_chunks").where((F.unix_micros("created_at") > 1_704_067_200_000_000) & F.lower("language").isin("python", "java") & F.length("content").between(200, 4000))
    return x.select("commit_sha", "file", F.lower("language").alias("language"), "end_line").distinct().groupBy("language").agg(F.count("*").alias("chunks"), F.sum("end_line").alias("lines"))


@query("""WITH r AS (SELECT id, max(created_at) AS created FROM cloud_responses GROUP BY 1) SELECT id, CAST(coalesce(epoch(created), 0) AS BIGINT) AS created, row_number() OVER (ORDER BY coalesce(epoch_us(created), 0) DESC, id) AS place FROM r QUALIFY place <= 100""")
def latest_reviews(spark, d):
    """The hundred latest reviews; those without a date count as the oldest."""
    r = table(spark, d, "cloud_responses").groupBy("id").agg(F.max("created_at").alias("created"))
    top = r.select("id", F.coalesce(F.unix_micros("created"), F.lit(0)).alias("us")).orderBy(F.desc("us"), "id").limit(100)
    return top.select("id", F.floor(F.col("us") / 1_000_000).cast("bigint").alias("created"), F.row_number().over(Window.orderBy(F.desc("us"), "id")).alias("place"))


@query("""WITH f AS (SELECT DISTINCT commit_sha, unnest(files) AS file FROM commits), k AS (SELECT DISTINCT commit_sha, file, 1 AS hit FROM code_chunks) SELECT f.commit_sha, count(*) AS files, CAST(count(hit) AS BIGINT) AS indexed FROM f LEFT JOIN k ON k.commit_sha = f.commit_sha AND k.file = f.file GROUP BY 1""")
def commit_index_coverage(spark, d):
    """How many of the files that a commit names have chunks of it."""
    f = table(spark, d, "commits").select("commit_sha", F.explode("files").alias("file")).distinct()
    k = table(spark, d, "code_chunks").select("commit_sha", "file").distinct().withColumn("hit", F.lit(1))
    return f.join(k, ["commit_sha", "file"], "left").groupBy("commit_sha").agg(F.count("*").alias("files"), F.count("hit").alias("indexed"))


@query("""WITH h AS (SELECT retrieval_id, chunk_id, max(score) AS score, max(file) AS file FROM retrieved_chunks WHERE file LIKE 'src/%' GROUP BY 1, 2) SELECT retrieval_id, chunk_id, row_number() OVER (PARTITION BY retrieval_id ORDER BY score DESC NULLS LAST, chunk_id) AS place FROM h QUALIFY place <= 50""")
def hits_in_directory(spark, d):
    """The fifty best hits of each retrieval below a directory; the number is the feature."""
    h = table(spark, d, "retrieved_chunks").where(F.col("file").startswith("src/")).groupBy("retrieval_id", "chunk_id").agg(F.max("score").alias("score"))
    return h.withColumn("place", F.row_number().over(Window.partitionBy("retrieval_id").orderBy(F.desc_nulls_last("score"), "chunk_id"))).where("place <= 50").select("retrieval_id", "chunk_id", "place")


@query(r"""SELECT doc_id, regexp_matches(lower(text), '\b(security|injection|credential|password|secret|deadlock|data loss)\b') AS escalate, regexp_matches(text, '(?m)^\s*(//|#)\s*(resolved|fixed|done)\b') AS resolves, regexp_matches(text, '^(feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)(\([^)]*\))?!?: ') AS conventional FROM documents WHERE text IS NOT NULL""")
def keyword_rules(spark, d):
    """Texts that ask for attention, that resolve something, or that follow the convention of commit messages."""
    x = table(spark, d, "documents").where("text is not null")
    return x.select(
        "doc_id", F.lower("text").rlike(r"\b(security|injection|credential|password|secret|deadlock|data loss)\b").alias("escalate"), F.col("text").rlike(r"(?m)^\s*(//|#)\s*(resolved|fixed|done)\b").alias("resolves"),
        F.col("text").rlike(r"^(feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)(\([^)]*\))?!?: ").alias("conventional"),
    )


@query("""WITH r AS (SELECT id, max(raw_response) AS raw FROM cloud_responses GROUP BY 1), j AS (SELECT id, CAST(raw AS JSON) AS j FROM r WHERE starts_with(raw, '{') AND json_valid(raw)), i AS (SELECT id, unnest(CAST(json_extract(j, '$.issues[*]') AS JSON[])) AS x, generate_subscripts(CAST(json_extract(j, '$.issues[*]') AS JSON[]), 1) AS n FROM j)
SELECT id AS review_id, CAST(n AS INTEGER) AS ordinal, json_extract_string(x, '$.file') AS file, CAST(json_extract_string(x, '$.line') AS INTEGER) AS line, lower(json_extract_string(x, '$.category')) AS category, lower(json_extract_string(x, '$.severity')) AS severity, json_extract_string(x, '$.comment') AS summary, 0.8::DOUBLE AS confidence FROM i""")
def insights_fanned_out(spark, d):
    """One insight row for every issue of the reviews that are JSON as a whole, as they are stored beside the review."""
    r = table(spark, d, "cloud_responses").groupBy("id").agg(F.max("raw_response").alias("raw")).where(F.col("raw").startswith("{") & F.get_json_object("raw", "$").isNotNull())
    i = r.select("id", F.posexplode(F.from_json("raw", REVIEW)["issues"]).alias("n", "x"))
    return i.select(F.col("id").alias("review_id"), (F.col("n") + 1).alias("ordinal"), "x.file", "x.line", F.lower("x.category").alias("category"), F.lower("x.severity").alias("severity"), F.col("x.comment").alias("summary"), F.lit(0.8).alias("confidence"))


@query("""WITH c AS (SELECT DISTINCT id, file, language, content, complexity FROM code_chunks) SELECT id, file, CASE WHEN language IS NOT NULL THEN content ELSE '' END AS content, CASE WHEN complexity > 5 THEN complexity END AS complexity FROM c""")
def optional_columns(spark, d):
    """Chunks whose content or metadata is left out on condition, as callers ask."""
    c = table(spark, d, "code_chunks").select("id", "file", "language", "content", "complexity").distinct()
    return c.select("id", "file", F.when(F.col("language").isNotNull(), F.col("content")).otherwise("").alias("content"), F.when(F.col("complexity") > 5, F.col("complexity")).alias("complexity"))


@query("""WITH c AS (SELECT DISTINCT id, repository, length(content) AS size FROM code_chunks WHERE content IS NOT NULL AND repository IS NOT NULL), t AS (SELECT repository, count(*) AS chunks, sum(size) AS size FROM c GROUP BY 1), f AS (SELECT repository, count(DISTINCT file) AS files FROM code_chunks WHERE repository IS NOT NULL GROUP BY 1) SELECT repository, round(chunks / files, 6)::DOUBLE AS chunks_per_file, round(size / chunks, 4)::DOUBLE AS size_per_chunk FROM t JOIN f USING (repository)""")
def mean_per_file(spark, d):
    """Chunks a file and characters a chunk of each repository."""
    x = table(spark, d, "code_chunks").where("repository is not null")
    t = x.where("content is not null").select("id", "repository", F.length("content").alias("size")).distinct().groupBy("repository").agg(F.count("*").alias("chunks"), F.sum("size").alias("size"))
    f = x.groupBy("repository").agg(F.count_distinct("file").alias("files"))
    return t.join(f, "repository").select("repository", F.round(F.col("chunks") / F.col("files"), 6).alias("chunks_per_file"), F.round(F.col("size") / F.col("chunks"), 4).alias("size_per_chunk"))
