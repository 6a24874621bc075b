"""Search, joins, chunking, stores, answers and streams over the given tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.functions.scoring import file_importance, hybrid, recency
from lodestack.functions.text import code_language
from lodestack.functions.vectors import nearest
from lodestack.operators import answers as A
from lodestack.operators import chunkers as C
from lodestack.operators import diffs as D
from lodestack.operators import joins as J
from lodestack.operators import prompts as P
from lodestack.operators import store as S
from lodestack.plans.filters import AS_OF, _rules
from lodestack.functions.scoring import FOLDER_RULES, NAME_RULES
from lodestack.sources.tables import table
from lodestack.streaming import windows as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[]))"
NAME, FOLDER = "lower(regexp_extract(path, '([^/]*)$', 1))", "lower(regexp_extract(path, '([^/]*)/[^/]*$', 1))"


@query(f"""WITH r AS (SELECT e.vec_id, e.embedding, d.created_at, concat(d.source, '/', e.vec_id, '.md') AS path FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE d.lang IN ('en', 'de', 'fr')),
c AS (SELECT q.vec_id AS query_id, r.vec_id AS id, {COS} AS s, created_at, path FROM embeddings q JOIN r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS cand FROM c QUALIFY cand <= 100),
h AS (SELECT query_id, id, round(greatest(0.0, least(1.0, s * 0.7 + greatest(0.0, least(1.0, power(0.9, ({AS_OF} - epoch(created_at)) / 86400.0 / 30))) * 0.2 + greatest(0.5, {_rules(NAME, NAME_RULES)}, {_rules(FOLDER, FOLDER_RULES)}) * 0.1)), 6) AS score FROM t)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h QUALIFY rank <= 10""")
def hybrid_search_topk(spark, d):
    """Filter, a hundred candidates by similarity, then ten by the hybrid score, for every fiftieth vector as a query."""
    docs = table(spark, d, "documents").where(F.col("lang").isin("en", "de", "fr")).select(F.col("doc_id").alias("id"), "created_at", "source")
    rows = vectors(spark, d).join(docs, "id")
    found = nearest(vectors(spark, d).where("id % 50 = 0"), rows, 100).join(docs, "id")
    score = hybrid({"semantic": F.col("score"), "recency": recency(F.col("created_at"), F.timestamp_seconds(F.lit(AS_OF))), "file_importance": file_importance(F.concat("source", F.lit("/"), "id", F.lit(".md")))})
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.select("query_id", "id", F.round(score, 6).alias("score")).withColumn("rank", F.row_number().over(w)).where("rank <= 10")


@query(f"""WITH c AS (SELECT q.vec_id AS query_id, r.vec_id AS id, {COS} AS s FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0) SELECT query_id, id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM c QUALIFY rank <= 5""")
def batch_knn_top5(spark, d):
    v = vectors(spark, d)
    return nearest(v.where("id % 50 = 0"), v, 5).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH c AS (SELECT q.vec_id AS query_id, r.vec_id AS id, {COS} AS s FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM c QUALIFY rank <= 20) SELECT query_id, count(*) AS hits, round(max(s), 6) AS best FROM t WHERE s >= 0.3 GROUP BY query_id""")
def vector_search_threshold(spark, d):
    v = vectors(spark, d)
    return nearest(v.where("id % 50 = 0"), v, 20, least=0.3).groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("best"))


@query("""WITH h AS (SELECT retrieval_id, chunk_id, max(score) AS score, max(semantic_score) AS semantic FROM retrieved_chunks GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY retrieval_id ORDER BY score DESC NULLS LAST, chunk_id) AS a, row_number() OVER (PARTITION BY retrieval_id ORDER BY semantic DESC NULLS LAST, chunk_id) AS b FROM h) SELECT retrieval_id, chunk_id, round(1.0 / (60 + a) + 1.0 / (60 + b), 9) AS rrf FROM r""")
def rrf_fusion(spark, d):
    h = table(spark, d, "retrieved_chunks").groupBy("retrieval_id", "chunk_id").agg(F.max("score").alias("score"), F.max("semantic_score").alias("semantic"))
    place = lambda c: F.row_number().over(Window.partitionBy("retrieval_id").orderBy(F.desc_nulls_last(c), "chunk_id"))
    return h.withColumn("a", place("score")).withColumn("b", place("semantic")).select("retrieval_id", "chunk_id", F.round(1.0 / (F.col("a") + 60) + 1.0 / (F.col("b") + 60), 9).alias("rrf"))


@query("""WITH r AS (SELECT collection, chunk_id, max(score) AS best FROM retrieved_chunks WHERE score >= 0.1 GROUP BY 1, 2) SELECT collection, chunk_id, best, row_number() OVER (PARTITION BY collection ORDER BY best DESC, chunk_id) AS place FROM r QUALIFY place <= 10""")
def results_per_source(spark, d):
    """The ten best of each collection; the number is the feature."""
    best = table(spark, d, "retrieved_chunks").where("score >= 0.1").groupBy("collection", "chunk_id").agg(F.max("score").alias("best"))
    return best.withColumn("place", F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("best"), "chunk_id"))).where("place <= 10")


@query("""WITH c AS (SELECT DISTINCT id, repository, file, start_line, end_line FROM code_chunks WHERE repository IS NOT NULL), i AS (SELECT DISTINCT id, repository, file, line, severity FROM review_insights WHERE line IS NOT NULL), m AS (SELECT c.id, i.severity FROM c JOIN i ON c.repository = i.repository AND c.file = i.file AND i.line BETWEEN c.start_line AND c.end_line) SELECT id AS chunk_id, count(*) AS insights, count(*) FILTER (WHERE lower(severity) IN ('critical', 'high')) AS grave FROM m GROUP BY id""")
def insight_interval_join(spark, d):
    chunks = table(spark, d, "code_chunks").where("repository is not null").select(F.col("id").alias("chunk_id"), "repository", "file", "start_line", "end_line").distinct()
    points = table(spark, d, "review_insights").select("id", "repository", "file", "line", "severity").distinct()
    return J.interval_join(chunks, points, ["repository", "file"], "start_line", "end_line", "line").groupBy("chunk_id").agg(F.count("*").alias("insights"), F.count_if(F.lower("severity").isin("critical", "high")).alias("grave"))


SPLIT = 1730419200


@query(f"""WITH o AS (SELECT repository, file, sha256, max(id) AS id FROM code_chunks WHERE epoch(ingested_at) < {SPLIT} AND repository IS NOT NULL AND sha256 IS NOT NULL GROUP BY 1, 2, 3), n AS (SELECT repository, file, sha256, max(id) AS id FROM code_chunks WHERE epoch(ingested_at) >= {SPLIT} AND repository IS NOT NULL AND sha256 IS NOT NULL GROUP BY 1, 2, 3) SELECT coalesce(o.repository, n.repository) AS repository, coalesce(o.file, n.file) AS file, coalesce(o.sha256, n.sha256) AS sha256, CASE WHEN o.id IS NULL THEN 'add' WHEN n.id IS NULL THEN 'delete' ELSE 'unchanged' END AS action, coalesce(o.id, n.id) AS id FROM o FULL JOIN n ON o.repository = n.repository AND o.file = n.file AND o.sha256 = n.sha256""")
def chunk_delta(spark, d):
    x = table(spark, d, "code_chunks").where("repository is not null").select("repository", "file", "sha256", "id", "ingested_at")
    border = F.timestamp_seconds(F.lit(SPLIT))
    return J.delta(x.where(F.col("ingested_at") < border), x.where(F.col("ingested_at") >= border), ["repository", "file"], "sha256", "id")


@query("""WITH c AS (SELECT DISTINCT sha256(content) AS key FROM retrieved_chunks WHERE content IS NOT NULL) SELECT coalesce(lower(trim(language)), 'unknown') AS language, count(*) AS chunks, count(c.key) AS hits, count(*) - count(c.key) AS misses FROM (SELECT DISTINCT id, language, sha256 FROM code_chunks) k LEFT JOIN c ON k.sha256 = c.key GROUP BY 1""")
def embedding_cache_partition(spark, d):
    cached = table(spark, d, "retrieved_chunks").where("content is not null").select(F.sha2("content", 256).alias("sha256")).distinct().withColumn("hit", F.lit(1))
    wanted = table(spark, d, "code_chunks").select("id", "language", "sha256").distinct()
    return wanted.join(cached, "sha256", "left").groupBy(F.coalesce(F.lower(F.trim("language")), F.lit("unknown")).alias("language")).agg(F.count("*").alias("chunks"), F.count("hit").alias("hits"), (F.count("*") - F.count("hit")).alias("misses"))


@query("""SELECT DISTINCT c.commit_sha, c.repository FROM commits c WHERE NOT EXISTS (SELECT 1 FROM code_chunks k WHERE k.commit_sha = c.commit_sha)""")
def commits_not_indexed(spark, d):
    return table(spark, d, "commits").join(table(spark, d, "code_chunks").select("commit_sha"), "commit_sha", "left_anti").select("commit_sha", "repository").distinct()


@query("""SELECT id, file FROM code_chunks WHERE file IN (SELECT unnest(files) FROM commits WHERE is_merge)""")
def chunks_of_changed_files(spark, d):
    changed = table(spark, d, "commits").where("is_merge").select(F.explode("files").alias("file"))
    return table(spark, d, "code_chunks").join(changed, "file", "left_semi").select("id", "file")


@query("""WITH k AS (SELECT DISTINCT id, commit_sha FROM code_chunks), m AS (SELECT r.retrieval_id, k.commit_sha, min(r.hit_rank) AS first_rank FROM retrieved_chunks r JOIN k ON r.chunk_id = k.id GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY retrieval_id ORDER BY first_rank, commit_sha) AS place FROM m QUALIFY place <= 5), c AS (SELECT commit_sha, max(message) AS message FROM commits GROUP BY 1) SELECT retrieval_id, t.commit_sha, first_rank, place, message FROM t LEFT JOIN c ON t.commit_sha = c.commit_sha""")
def related_commits(spark, d):
    owner = table(spark, d, "code_chunks").select(F.col("id").alias("chunk_id"), "commit_sha").distinct()
    hits = table(spark, d, "retrieved_chunks").select("retrieval_id", "chunk_id", "hit_rank").join(owner, "chunk_id").groupBy("retrieval_id", "commit_sha").agg(F.min("hit_rank").alias("first_rank"))
    top = hits.withColumn("place", F.row_number().over(Window.partitionBy("retrieval_id").orderBy("first_rank", "commit_sha"))).where("place <= 5")
    return top.join(table(spark, d, "commits").groupBy("commit_sha").agg(F.max("message").alias("message")), "commit_sha", "left")


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) SELECT l.event_id, l.user_id, round(r.value, 6) AS last_value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def events_as_of(spark, d):
    e = table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return J.as_of(left, right, ["user_id"], "ts", ["value"]).select("event_id", "user_id", F.round("last_value", 6).alias("last_value"))


@query("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, l, unnest(generate_series(0, CAST(greatest(ceil((len(l) - 50) / 45.0), 0) AS BIGINT))) * 45 AS b FROM s), x AS (SELECT doc_id, CAST(b + 1 AS BIGINT) AS start_line, CAST(least(b + 50, len(l)) AS BIGINT) AS end_line, array_to_string(list_slice(l, b + 1, least(b + 50, len(l))), chr(10)) AS content FROM w) SELECT doc_id, start_line, end_line, md5(content) AS digest FROM x WHERE regexp_replace(content, '[ \\t\\r\\n]', '', 'g') <> ''""")
def line_windows_50_5(spark, d):
    w = C.line_windows(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return w.select("doc_id", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"), F.md5("content").alias("digest"))


@query("""WITH s AS (SELECT id, len(string_split(content, chr(10))) AS n FROM code_chunks WHERE content IS NOT NULL), b AS (SELECT id, n, unnest(generate_series(0, CAST(floor((n - 1) / 20.0) AS BIGINT))) AS block FROM s) SELECT id, CAST(block AS INTEGER) AS block, CAST(block * 20 + 1 AS INTEGER) AS start_line, CAST(least(block * 20 + 20, n) AS INTEGER) AS end_line, CAST(least(block * 20 + 20, n) - block * 20 AS INTEGER) AS lines FROM b""")
def fixed_blocks_20(spark, d):
    return C.fixed_blocks(table(spark, d, "code_chunks").select("id", "content"), "id", "content", 20).select("id", *[F.col(c).cast("int").alias(c) for c in ("block", "start_line", "end_line", "lines")])


def file_chunks(spark, d):
    """Chunks with the key of their file version; one without a commit or file stands for itself."""
    lone = F.col("commit_sha").isNull() | F.col("file").isNull()
    return table(spark, d, "code_chunks").where("content is not null").select("id", "content", "start_line", code_language(F.col("language"), F.col("file")).alias("language"), F.when(lone, F.col("id")).otherwise(F.col("commit_sha")).alias("version"), F.when(~lone, F.col("file")).otherwise("").alias("path"))


@query()
def declaration_chunks(spark, d):
    """Declarations of whole file versions, by lines of the file; id is the first chunk that holds the declaration's first line."""
    return C.declarations(file_chunks(spark, d), ["version", "path"], "content", "language", "start_line", "id").select("id", "name", "start_line", "end_line")


@query(
    r"""WITH k AS (SELECT id, CASE WHEN commit_sha IS NULL OR file IS NULL THEN id ELSE commit_sha END AS version, CASE WHEN commit_sha IS NULL OR file IS NULL THEN '' ELSE file END AS path, coalesce(start_line, 1) AS s, content FROM code_chunks WHERE content IS NOT NULL),
w AS (SELECT DISTINCT version, path FROM k WHERE contains(content, '@@ -')), x AS (SELECT k.* FROM k JOIN w USING (version, path)),
l AS (SELECT version, path, s + i - 2 AS pos, arg_min(y, (s, y)) AS line FROM (SELECT version, path, s, unnest(string_split_regex(content, '\r?\n')) AS y, generate_subscripts(string_split_regex(content, '\r?\n'), 1) AS i FROM x) GROUP BY 1, 2, 3),
h AS (SELECT *, regexp_matches(line, '^@@ -\d+(,\d+)? \+\d+(,\d+)? @@') AS head FROM l), n AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY version, path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS hunk FROM h),
g AS (SELECT version, path, count(*) FILTER (WHERE starts_with(line, '+')) AS added, count(*) FILTER (WHERE starts_with(line, '-')) AS deleted FROM n WHERE hunk > 0 AND NOT head AND NOT starts_with(line, 'diff --git ') AND NOT regexp_matches(line, '^(---|\+\+\+) [ab/]') AND NOT starts_with(line, chr(92)) GROUP BY 1, 2),
f AS (SELECT version, path, arg_min(id, (s, id)) AS id FROM x GROUP BY 1, 2)
SELECT id, added, deleted, CASE WHEN added > 0 AND deleted = 0 THEN 'added' WHEN deleted > 0 AND added = 0 THEN 'deleted' ELSE 'modified' END AS status FROM g JOIN f USING (version, path)"""
)
def unified_diff_lines(spark, d):
    """Status of every file version with hunks in any of its chunks; id is that of its first chunk."""
    chunks, key = file_chunks(spark, d), ["version", "path"]
    chunks = chunks.join(chunks.where("content like '%@@ -%'").select(*key).distinct(), key, "left_semi")
    status = D.change_status(D.hunk_lines(D.chunk_lines(chunks, key, "content", "start_line"), key), *key)
    return status.join(chunks.groupBy(*key).agg(F.min(F.struct(F.coalesce("start_line", F.lit(1)), "id"))["id"].alias("id")), key).select("id", "added", "deleted", "status")


@query()
def answer_findings(spark, d):
    answers = table(spark, d, "cloud_responses").select("id", "raw_response").where("raw_response is not null").groupBy("id").agg(F.max("raw_response").alias("raw_response"))
    return A.findings(A.parsed(answers, "id", "raw_response"), "id").groupBy("id", "severity").agg(F.count("*").alias("findings"))


@query("""SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, event_type IN ('signup', 'error', 'click', 'view', 'purchase') AS known_type, value BETWEEN 0 AND 1000000 AS in_range FROM events""")
def validate_rows(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").isNotNull().alias("has_k"), F.col("event_type").isin("signup", "error", "click", "view", "purchase").alias("known_type"), F.col("value").between(0, 1000000).alias("in_range"))


@query("""WITH k AS (SELECT DISTINCT id, commit_sha, file, chunk_type, start_line, end_line, content FROM code_chunks WHERE content IS NOT NULL), e AS (SELECT *, concat(upper(coalesce(chunk_type, 'unknown')), ' (', start_line, '-', end_line, ')', chr(10), array_to_string(list_slice(string_split(content, chr(10)), 1, 10), chr(10))) AS entry FROM k) SELECT commit_sha, file, md5(string_agg(entry, chr(10) || chr(10) ORDER BY start_line, end_line, id, entry)) AS digest, count(*) AS chunks FROM e GROUP BY 1, 2""")
def prompt_context_by_file(spark, d):
    k = table(spark, d, "code_chunks").where("content is not null").select("id", "commit_sha", "file", "chunk_type", "start_line", "end_line", "content").distinct()
    n = k.groupBy("commit_sha", "file").agg(F.count("*").alias("chunks"))
    return P.context_by_file(k, ["commit_sha"]).select("commit_sha", "file", F.md5("section").alias("digest")).join(n, ["commit_sha", "file"])


@query("""SELECT id, file, sha256, CAST(epoch(ingested_at) AS BIGINT) AS arrived FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC NULLS LAST, file DESC NULLS LAST, sha256 DESC NULLS LAST) AS n FROM code_chunks) WHERE n = 1""")
def upsert_last_wins(spark, d):
    rows = table(spark, d, "code_chunks").select("id", "ingested_at", "file", "sha256")
    return S.newest(rows, "id", ["ingested_at"]).select("id", "file", "sha256", F.unix_timestamp("ingested_at").alias("arrived"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'""")
def op_log_replay(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))
    return S.replayed(log, "user_id", "event_id", "op").select("user_id", "event_id", "event_type")


@query("""SELECT id, file FROM code_chunks WHERE NOT coalesce(file IN (SELECT file FROM review_insights WHERE lower(severity) = 'critical'), false)""")
def delete_by_file(spark, d):
    gone = table(spark, d, "review_insights").where(F.lower("severity") == "critical").select("file")
    return table(spark, d, "code_chunks").select("id", "file").join(gone, "file", "left_anti")


@query("""SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2""")
def stream_tumbling(spark, d):
    out = W.drained(W.tumbling(W.event_stream(spark, f"{d}/events.parquet"), "1 hour"), "update", ["start", "event_type"])
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("v", 4).alias("v"))


@query("""SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800, CAST(floor(epoch(ts) / 1800) AS BIGINT) * 1800 - 1800]) AS s FROM events) GROUP BY 1, 2""")
def stream_sliding(spark, d):
    out = W.drained(W.sliding(W.event_stream(spark, f"{d}/events.parquet"), "1 hour", "30 minutes"), "update", ["start", "event_type"])
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS first FROM events), g AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS stop, count(*) AS n FROM g GROUP BY user_id, s""")
def stream_sessions(spark, d):
    out = W.drained(W.sessions(W.event_stream(spark, f"{d}/events.parquet"), "30 minutes"), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n")


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def stream_distinct(spark, d):
    return W.drained(W.distinct_events(W.event_stream(spark, f"{d}/events.parquet"), ["user_id", "event_type"]), "append").select("user_id", "event_type")
