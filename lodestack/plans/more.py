"""Validation, review search, paging, maps, formats and running figures, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.operators import answers as A
from lodestack.operators import validate as V
from lodestack.sources.files import recent
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


def broken(df, key, rules):
    return df.select(key, F.explode(V.violations(rules)).alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"))


def _list(x) -> str:
    return ", ".join(f"'{v}'" for v in x)


def _sql(table_name: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS rows FROM {table_name} WHERE {c} HAVING count(*) > 0" for n, c in rules.items())


@query(_sql("code_chunks", {
    "id": "id IS NULL OR id = ''", "file": "file IS NULL OR starts_with(file, '/') OR contains(file, '..')", "language": f"NOT coalesce(language IN ({_list(V.LANGUAGES)}), false)", "lines": "coalesce(start_line < 1 OR end_line < start_line, true)",
    "sha256": "NOT coalesce(regexp_matches(sha256, '^[0-9a-f]{64}$'), false)", "commit": "NOT coalesce(regexp_matches(commit_sha, '^[0-9a-f]{7,40}$'), false)", "content": "content IS NULL",
}))
def validate_chunks(spark, d):
    return broken(table(spark, d, "code_chunks"), "id", V.chunk_rules())


@query(_sql("review_insights", {
    "line": "line < 1", "severity": f"NOT coalesce(severity IN ({_list(V.SEVERITIES)}), false)", "category": f"NOT coalesce(category IN ({_list(V.CATEGORIES)}), false)", "summary": "coalesce(length(summary) = 0, true)", "confidence": "confidence NOT BETWEEN 0 AND 1",
}))
def validate_insights(spark, d):
    return broken(table(spark, d, "review_insights"), "id", V.insight_rules())


@query(_sql("prompts", {"top_k": "NOT coalesce(top_k BETWEEN 1 AND 100, false)", "budget": "NOT coalesce(token_budget BETWEEN 1000 AND 100000, false)", "text": "coalesce(length(text) = 0, true)", "count": "token_count < 0"}))
def validate_prompts(spark, d):
    return broken(table(spark, d, "prompts"), "id", V.prompt_rules())


@query("""SELECT sha256, min(id) AS class_id, count(DISTINCT id) AS members, count(DISTINCT repository) AS repositories FROM code_chunks WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(DISTINCT id) > 1""")
def duplicate_chunks(spark, d):
    x = table(spark, d, "code_chunks").where("sha256 is not null").groupBy("sha256")
    return x.agg(F.min("id").alias("class_id"), F.count_distinct("id").alias("members"), F.count_distinct("repository").alias("repositories")).where("members > 1")


@query("""SELECT retrieval_id, hit_rank, chunk_id, concat('semantic=', printf('%.4f', semantic_score), ', total=', printf('%.4f', coalesce(hybrid_score, score))) AS explanation FROM retrieved_chunks WHERE semantic_score IS NOT NULL""")
def score_explain(spark, d):
    x = table(spark, d, "retrieved_chunks").where("semantic_score is not null")
    return x.select("retrieval_id", "hit_rank", "chunk_id", F.concat(F.lit("semantic="), F.format_string("%.4f", F.col("semantic_score")), F.lit(", total="), F.format_string("%.4f", F.coalesce("hybrid_score", "score"))).alias("explanation"))


@query("""SELECT id, model, CAST(epoch(created_at) AS BIGINT) AS created FROM (SELECT DISTINCT id, model, created_at FROM cloud_responses) ORDER BY created_at DESC, id LIMIT 20 OFFSET 40""")
def reviews_page(spark, d):
    """The third page of 20 reviews; the page is the feature."""
    x = table(spark, d, "cloud_responses").select("id", "model", "created_at").distinct()
    return x.orderBy(F.desc("created_at"), "id").offset(40).limit(20).select("id", "model", F.unix_timestamp("created_at").alias("created"))


@query("""SELECT id, status, total_tokens FROM cloud_responses WHERE model LIKE 'review-%' AND status = 'success' AND epoch(created_at) BETWEEN 1717200000 AND 1735689600 AND coalesce(len(validation_errors), 0) = 0 AND total_tokens >= 100""")
def review_search(spark, d):
    x = table(spark, d, "cloud_responses")
    between = F.col("created_at").between(F.timestamp_seconds(F.lit(1717200000)), F.timestamp_seconds(F.lit(1735689600)))
    return x.where(F.col("model").startswith("review-") & (F.col("status") == "success") & between & (F.coalesce(F.size("validation_errors"), F.lit(0)) <= 0) & (F.col("total_tokens") >= 100)).select("id", "status", "total_tokens")


@query("""SELECT id, confidence, tags IS NOT NULL AND list_has_any(tags, ['io', 'ci']) AS tagged FROM (SELECT DISTINCT id, confidence, tags FROM review_insights WHERE confidence >= 0.3 AND category IS NOT NULL) ORDER BY confidence DESC, id LIMIT 50""")
def insight_top(spark, d):
    """The fifty surest insights; the number is the feature."""
    x = table(spark, d, "review_insights").where("confidence >= 0.3 and category is not null").select("id", "confidence", "tags").distinct()
    top = x.orderBy(F.desc("confidence"), "id").limit(50)
    return top.select("id", "confidence", F.coalesce(F.arrays_overlap("tags", F.array(F.lit("io"), F.lit("ci"))), F.lit(False)).alias("tagged"))


@query("""WITH c AS (SELECT file, coalesce(lower(severity), 'unknown') AS severity, count(*) AS n FROM (SELECT DISTINCT id, file, severity FROM review_insights) GROUP BY 1, 2) SELECT file, string_agg(concat(severity, '=', n), ',' ORDER BY severity) AS severities, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY file""")
def insight_maps_by_file(spark, d):
    x = table(spark, d, "review_insights").select("id", "file", "severity").distinct().groupBy("file", F.coalesce(F.lower("severity"), F.lit("unknown")).alias("severity")).agg(F.count("*").alias("n"))
    m = x.groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("m"), F.sum("n").alias("total"))
    return m.select("file", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("severities"), "total")


@query("""SELECT vec_id, CAST(len(embedding) * 8 + length(concat('{"vec_id":', vec_id, ',"label":', label, '}')) AS BIGINT) AS bytes FROM embeddings""")
def cache_entry_size(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (F.size("embedding") * 8 + F.length(F.to_json(F.struct("vec_id", "label")))).cast("bigint").alias("bytes"))


@query("""SELECT id, sha256(concat(file, ':', start_line, '-', end_line)) AS stable_id FROM code_chunks WHERE file IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL""")
def chunk_ids(spark, d):
    x = table(spark, d, "code_chunks").where("file is not null and start_line is not null and end_line is not null")
    return x.select("id", F.sha2(F.concat("file", F.lit(":"), "start_line", F.lit("-"), "end_line"), 256).alias("stable_id"))


@query("""SELECT commit_sha, author, CAST(epoch(commit_date) AS BIGINT) AS at FROM (SELECT DISTINCT commit_sha, author, commit_date FROM commits) WHERE epoch(commit_date) >= 1717200000 ORDER BY commit_date DESC, commit_sha LIMIT 100""")
def commits_recent(spark, d):
    """The hundred newest commits since a date; the number is the feature."""
    x = table(spark, d, "commits").select("commit_sha", "author", "commit_date").distinct()
    return recent(x, 100, since="2024-06-01 00:00:00+00:00").select("commit_sha", "author", F.unix_timestamp("commit_date").alias("at"))


@query("""WITH h AS (SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, day, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS done, round(sum(n) OVER (PARTITION BY event_type ORDER BY day) * 1.0 / row_number() OVER (PARTITION BY event_type ORDER BY day), 6) AS per_day FROM h""")
def running_progress(spark, d):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).alias("day")
    x = table(spark, d, "events").groupBy("event_type", day).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("day")
    done = F.sum("n").over(w)
    return x.select("event_type", "day", "n", done.alias("done"), F.round(done / F.row_number().over(w), 6).alias("per_day"))


@query("""SELECT coalesce(chunk_type, 'unknown') AS chunk_type, round(quantile_cont(length(content), 0.5), 4) AS median, round(quantile_cont(length(content), 0.9), 4) AS p90, max(length(content)) AS longest FROM code_chunks WHERE content IS NOT NULL GROUP BY 1""")
def chunk_length_percentiles(spark, d):
    n = F.length("content")
    return table(spark, d, "code_chunks").where("content is not null").groupBy(F.coalesce("chunk_type", F.lit("unknown")).alias("chunk_type")).agg(F.round(F.percentile(n, F.lit(0.5)), 4).alias("median"), F.round(F.percentile(n, F.lit(0.9)), 4).alias("p90"), F.max(n).cast("bigint").alias("longest"))


@query("""SELECT repository, CASE WHEN b < 1024 THEN concat(b, ' B') WHEN b < 1048576 THEN concat(printf('%.1f', b / 1024.0), ' KB') ELSE concat(printf('%.1f', b / 1048576.0), ' MB') END AS size FROM (SELECT repository, CAST(sum(length(content)) AS BIGINT) AS b FROM code_chunks WHERE repository IS NOT NULL GROUP BY 1)""")
def human_sizes(spark, d):
    b = F.col("b")
    x = table(spark, d, "code_chunks").where("repository is not null").groupBy("repository").agg(F.sum(F.length("content")).alias("b"))
    text = F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).when(b < 1048576, F.concat(F.format_string("%.1f", b / 1024.0), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", b / 1048576.0), F.lit(" MB")))
    return x.select("repository", text.alias("size"))


@query("""SELECT model, count(*) AS answers, count(*) FILTER (WHERE status = 'success') AS ok, CASE WHEN count(*) FILTER (WHERE status <> 'success') * 10 > count(*) THEN 'check errors' ELSE 'fine' END AS advice FROM cloud_responses GROUP BY model""")
def rollup_advice(spark, d):
    bad = F.count_if(F.col("status") != "success")
    return table(spark, d, "cloud_responses").groupBy("model").agg(F.count("*").alias("answers"), F.count_if(F.col("status") == "success").alias("ok"), F.when(bad * 10 > F.count("*"), "check errors").otherwise("fine").alias("advice"))


@query("""SELECT id, CAST(len(o) AS INTEGER) AS objects, md5(coalesce(o[1], '')) AS first_digest FROM (SELECT id, regexp_extract_all(coalesce(raw_response, ''), '(\\{[^{}]*\\})', 1) AS o FROM cloud_responses)""")
def json_objects(spark, d):
    o = A.flat_objects(F.col("raw_response"))
    return table(spark, d, "cloud_responses").select("id", F.size(o).alias("objects"), F.md5(F.coalesce(F.get(o, 0), F.lit(""))).alias("first_digest"))


#: Words of messages that tell a kind of change, the first that fits counts.
CHANGE_KINDS = {"fix": "fix|bug", "feature": "feat|add", "refactor": "refactor|rename|clean", "performance": "perf|speed", "test": "test", "chore": "chore|bump"}


@query("SELECT kind, count(*) AS commits, CAST(sum(lines_added + lines_deleted) AS BIGINT) AS lines FROM (SELECT DISTINCT commit_sha, lines_added, lines_deleted, CASE " + " ".join(f"WHEN regexp_matches(lower(message), '^(?:{p})') THEN '{k}'" for k, p in CHANGE_KINDS.items()) + " ELSE 'other' END AS kind FROM commits) GROUP BY kind")
def commit_kinds(spark, d):
    message, kind = F.lower("message"), F.lit("other")
    for k, p in reversed(CHANGE_KINDS.items()):
        kind = F.when(message.rlike(f"^(?:{p})"), k).otherwise(kind)
    x = table(spark, d, "commits").select("commit_sha", "lines_added", "lines_deleted", kind.alias("kind")).distinct()
    return x.groupBy("kind").agg(F.count("*").alias("commits"), F.sum(F.col("lines_added") + F.col("lines_deleted")).alias("lines"))


@query("""WITH p AS (SELECT DISTINCT commit_sha, unnest(parent_hashes) AS parent FROM commits), r AS (SELECT DISTINCT commit_sha, repository FROM commits) SELECT r.repository, count(*) AS edges, count(k.commit_sha) AS known, count(*) FILTER (WHERE k.repository = r.repository) AS same FROM p JOIN r ON p.commit_sha = r.commit_sha LEFT JOIN r k ON p.parent = k.commit_sha GROUP BY r.repository""")
def commit_parents(spark, d):
    c = table(spark, d, "commits")
    edges = c.select("commit_sha", F.explode("parent_hashes").alias("parent")).distinct()
    owner = c.select("commit_sha", "repository").distinct()
    known = owner.select(F.col("commit_sha").alias("parent"), F.col("repository").alias("of_parent"), F.lit(1).alias("there"))
    x = edges.join(owner, "commit_sha").join(known, "parent", "left")
    return x.groupBy("repository").agg(F.count("*").alias("edges"), F.count("there").alias("known"), F.count_if(F.col("of_parent") == F.col("repository")).alias("same"))
