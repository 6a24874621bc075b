"""Aggregations, windows and set operations over the domain tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestack.operators import prompts as P
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


def insights(spark, d):
    """Repeated deliveries of an insight count once, the earliest; at the same time the one whose columns come first."""
    x = table(spark, d, "review_insights")
    rest = [c for c in x.columns if c != "id"]
    return x.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("created_at", *[c for c in rest if c != "created_at"])).alias("_")).select("id", "_.*")


INSIGHTS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM review_insights) WHERE rn = 1)"


@query(f"""SELECT file, coalesce(lower(category), 'unknown') AS category, coalesce(lower(severity), 'unknown') AS severity, count(*) AS n FROM {INSIGHTS} GROUP BY 1, 2, 3""")
def insight_counts_by_file(spark, d):
    return insights(spark, d).groupBy("file", F.coalesce(F.lower("category"), F.lit("unknown")).alias("category"), F.coalesce(F.lower("severity"), F.lit("unknown")).alias("severity")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT coalesce(lower(category), 'unknown') AS category, count(*) AS n FROM {INSIGHTS} GROUP BY 1) SELECT category, n, row_number() OVER (ORDER BY n DESC, category) AS place FROM c QUALIFY row_number() OVER (ORDER BY n DESC, category) <= 5""")
def insight_top_categories(spark, d):
    n = insights(spark, d).groupBy(F.coalesce(F.lower("category"), F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "category").limit(5)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "category")))


@query("""SELECT model, status, grouping(model) AS g_model, grouping(status) AS g_status, count(*) AS responses, round(avg(processing_time_ms), 4) AS avg_ms, round(avg(total_tokens), 4) AS avg_tokens, CAST(sum(length(raw_response)) AS BIGINT) AS chars FROM cloud_responses GROUP BY GROUPING SETS ((), (model), (status), (model, status))""")
def review_stats_grouping_sets(spark, d):
    x = table(spark, d, "cloud_responses").withColumn("chars", F.length("raw_response"))
    return x.groupingSets([[], [F.col("model")], [F.col("status")], [F.col("model"), F.col("status")]], "model", "status").agg(
        F.grouping("model").cast("bigint").alias("g_model"), F.grouping("status").cast("bigint").alias("g_status"), F.count("*").alias("responses"), F.round(F.avg("processing_time_ms"), 4).alias("avg_ms"), F.round(F.avg("total_tokens"), 4).alias("avg_tokens"), F.sum("chars").alias("chars"),
    )


@query("""SELECT repository, count(*) AS chunks, count(DISTINCT file) AS files, CAST(sum(length(content)) AS BIGINT) AS chars, max(end_line) AS longest, CAST(max(epoch(ingested_at)) AS BIGINT) AS newest FROM code_chunks WHERE repository IS NOT NULL GROUP BY repository""")
def file_stats(spark, d):
    x = table(spark, d, "code_chunks").where("repository is not null")
    return x.groupBy("repository").agg(F.count("*").alias("chunks"), F.count_distinct("file").alias("files"), F.sum(F.length("content")).alias("chars"), F.max("end_line").alias("longest"), F.max(F.unix_timestamp("ingested_at")).alias("newest"))


@query("""WITH f AS (SELECT repository, file, max(end_line) AS lines FROM code_chunks WHERE repository IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY lines DESC, file) AS rank FROM f) SELECT * FROM r WHERE rank <= 10""")
def repo_stats_topn(spark, d):
    files = table(spark, d, "code_chunks").where("repository is not null").groupBy("repository", "file").agg(F.max("end_line").alias("lines"))
    return files.withColumn("rank", F.row_number().over(Window.partitionBy("repository").orderBy(F.desc("lines"), "file"))).where("rank <= 10")


@query("""SELECT coalesce(lower(trim(language)), 'unknown') AS language, count(*) AS chunks, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent FROM code_chunks GROUP BY 1""")
def language_breakdown(spark, d):
    n = table(spark, d, "code_chunks").groupBy(F.coalesce(F.lower(F.trim("language")), F.lit("unknown")).alias("language")).agg(F.count("*").alias("chunks"))
    total = F.sum("chunks").over(Window.partitionBy())  # over one row a language
    return n.select("language", "chunks", F.round(F.col("chunks") * 100.0 / total, 4).alias("percent"))


@query("""WITH c AS (SELECT DISTINCT commit_sha, repository, files, lines_added, lines_deleted, is_merge FROM commits), e AS (SELECT repository, count(DISTINCT f) AS files FROM (SELECT repository, unnest(files) AS f FROM c) GROUP BY 1) SELECT c.repository, count(*) AS commits, count(*) FILTER (WHERE is_merge) AS merges, CAST(sum(lines_added) AS BIGINT) AS added, CAST(sum(lines_deleted) AS BIGINT) AS deleted, coalesce(max(e.files), 0) AS files FROM c LEFT JOIN e ON c.repository = e.repository GROUP BY c.repository""")
def commit_range_summary(spark, d):
    c = table(spark, d, "commits").select("commit_sha", "repository", "files", "lines_added", "lines_deleted", "is_merge").distinct()
    files = c.select("repository", F.explode("files").alias("f")).distinct().groupBy("repository").agg(F.count("*").alias("files"))
    sums = c.groupBy("repository").agg(F.count("*").alias("commits"), F.count_if("is_merge").alias("merges"), F.sum("lines_added").alias("added"), F.sum("lines_deleted").alias("deleted"))
    return sums.join(files, "repository", "left").fillna(0, ["files"])


@query("""SELECT commit_sha, concat_ws(', ', message, concat('+', lines_added, '-', lines_deleted, ' lines'), concat(len(files), CASE WHEN len(files) = 1 THEN ' file' ELSE ' files' END, ' modified'), CASE WHEN is_merge THEN 'merge commit' END) AS summary FROM commits""")
def commit_summary_text(spark, d):
    n = F.size("files")
    return table(spark, d, "commits").select("commit_sha", F.concat_ws(", ", "message", F.concat(F.lit("+"), "lines_added", F.lit("-"), "lines_deleted", F.lit(" lines")), F.concat(n, F.when(n == 1, " file").otherwise(" files"), F.lit(" modified")), F.when(F.col("is_merge"), "merge commit")).alias("summary"))


@query("""SELECT event_type, count(*) AS accesses, count(DISTINCT user_id) AS entries, round(count(*) * 1.0 / count(DISTINCT user_id), 6) AS per_entry, round(sum(value), 2) AS bytes, count(*) FILTER (WHERE value > 50) AS hits FROM events GROUP BY event_type""")
def cache_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("accesses"), F.count_distinct("user_id").alias("entries"), F.round(F.count("*") / F.count_distinct("user_id"), 6).alias("per_entry"), F.round(F.sum("value"), 2).alias("bytes"), F.count_if(F.col("value") > 50).alias("hits"))


@query(f"""SELECT file, CASE WHEN sum(bad) > 5 THEN 'high' WHEN sum(bad) > 2 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS findings FROM (SELECT file, CASE WHEN lower(severity) IN ('critical', 'high') THEN 1 ELSE 0 END AS bad FROM {INSIGHTS}) GROUP BY file""")
def severity_bucket(spark, d):
    bad = F.count_if(F.lower("severity").isin("critical", "high"))
    return insights(spark, d).groupBy("file").agg(F.when(bad > 5, "high").when(bad > 2, "medium").otherwise("low").alias("bucket"), F.count("*").alias("findings"))


@query(f"""SELECT review_id, round(avg(0.5 + CASE WHEN length(summary) > 50 THEN 0.2 ELSE 0 END + CASE WHEN lower(severity) IN ('critical', 'high') THEN 0.2 ELSE 0 END + CASE WHEN suggestion IS NOT NULL THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS quality, count(*) AS comments FROM {INSIGHTS} WHERE review_id IS NOT NULL GROUP BY review_id""")
def quality_scores(spark, d):
    score = F.lit(0.5) + F.when(F.length("summary") > 50, 0.2).otherwise(0.0) + F.when(F.lower("severity").isin("critical", "high"), 0.2).otherwise(0.0) + F.when(F.col("suggestion").isNotNull(), 0.1).otherwise(0.0)
    return insights(spark, d).where("review_id is not null").groupBy("review_id").agg(F.round(F.avg(score), 6).alias("quality"), F.count("*").alias("comments"))


@query("""WITH s AS (SELECT retrieval_id, hit_rank, chunk_id, CAST(ceil(sum(coalesce(length(content), 0)) OVER (PARTITION BY retrieval_id ORDER BY hit_rank, chunk_id ROWS UNBOUNDED PRECEDING) / 4.0 * 1.1) AS BIGINT) AS used_tokens FROM retrieved_chunks) SELECT * FROM s WHERE used_tokens <= 1000""")
def budget_prefix_trim(spark, d):
    hits = table(spark, d, "retrieved_chunks").select("retrieval_id", "hit_rank", "chunk_id", "content")
    return P.within_budget(hits, ["retrieval_id"], ["hit_rank", "chunk_id"], "content", 1000).drop("content")


@query("""WITH t AS (SELECT retrieval_id, hit_rank, CAST(ceil(coalesce(length(content), 0) / 4.0) AS BIGINT) AS tokens FROM retrieved_chunks), s AS (SELECT *, CAST(floor(CAST(tokens AS DOUBLE) / sum(tokens) OVER (PARTITION BY retrieval_id) * 500) AS BIGINT) AS share FROM t) SELECT * FROM s WHERE share > 0""")
def proportional_budget(spark, d):
    hits = table(spark, d, "retrieved_chunks").select("retrieval_id", "hit_rank", "content")
    return P.proportional(hits, ["retrieval_id"], "content", 500).drop("content")


@query("""SELECT id, token_budget, CAST(floor(token_budget * 0.1) AS BIGINT) AS preamble, CAST(greatest(floor(token_budget * 0.5) + token_budget - floor(token_budget * 0.1) * 3 - floor(token_budget * 0.5) - floor(token_budget * 0.3), 0) AS BIGINT) AS context, CAST(floor(token_budget * 0.3) AS BIGINT) AS diffs, CAST(floor(token_budget * 0.1) AS BIGINT) AS insights, CAST(floor(token_budget * 0.1) AS BIGINT) AS instructions FROM prompts""")
def token_budget_allocation(spark, d):
    return table(spark, d, "prompts").select("id", "token_budget", *[c.alias(k) for k, c in P.allocated(F.col("token_budget")).items()])


@query(f"""WITH k AS (SELECT id, file, line, category, row_number() OVER (PARTITION BY file, line, category, substring(summary, 1, 50) ORDER BY created_at, id) AS n FROM {INSIGHTS}) SELECT id, file, line, category FROM k WHERE n = 1""")
def comment_dedup_first(spark, d):
    w = Window.partitionBy("file", "line", "category", F.substring("summary", 1, 50)).orderBy("created_at", "id")
    return insights(spark, d).withColumn("n", F.row_number().over(w)).where("n = 1").select("id", "file", "line", "category")


@query("""WITH l AS (SELECT user_id, CAST(max(epoch_us(ts)) AS BIGINT) AS last_us, round(sum(value), 4) AS size FROM events GROUP BY 1), s AS (SELECT *, row_number() OVER (ORDER BY last_us DESC, user_id) AS place FROM l) SELECT user_id, last_us, size FROM s WHERE place <= 100""")
def lru_keep(spark, d):
    """The 100 entries last used; the capacity is the feature."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"), F.round(F.sum("value"), 4).alias("size"))
    return last.orderBy(F.desc("last_us"), "user_id").limit(100)


@query("""SELECT user_id, count(*) AS entries, count(*) FILTER (WHERE epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts) > 604800) AS expired FROM events GROUP BY user_id""")
def ttl_expired(spark, d):
    age = F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("entries"), F.count_if(age > 604800).alias("expired"))


@query("""WITH m AS (SELECT id, model, created_at, row_number() OVER (PARTITION BY model ORDER BY created_at DESC, id DESC) AS place FROM (SELECT DISTINCT id, model, created_at FROM cloud_responses)) SELECT id, model, place FROM m WHERE place <= 1000""")
def retention_latest(spark, d):
    """The newest thousand reviews of each model; the number is the feature."""
    w = Window.partitionBy("model").orderBy(F.desc("created_at"), F.desc("id"))
    return table(spark, d, "cloud_responses").select("id", "model", "created_at").distinct().withColumn("place", F.row_number().over(w)).where("place <= 1000").select("id", "model", "place")


@query("""SELECT file FROM (SELECT DISTINCT file FROM code_chunks WHERE file IS NOT NULL) INTERSECT SELECT file FROM (SELECT DISTINCT file FROM review_insights WHERE file IS NOT NULL)""")
def files_reviewed(spark, d):
    return table(spark, d, "code_chunks").select("file").where("file is not null").intersect(table(spark, d, "review_insights").select("file").where("file is not null"))


@query("""SELECT file FROM code_chunks WHERE file IS NOT NULL EXCEPT SELECT file FROM review_insights""")
def files_not_reviewed(spark, d):
    return table(spark, d, "code_chunks").select("file").where("file is not null").subtract(table(spark, d, "review_insights").select("file"))


@query("""SELECT id, 'chunk' AS kind, created_at IS NOT NULL AS dated FROM code_chunks UNION ALL SELECT id, 'insight', created_at IS NOT NULL FROM review_insights UNION ALL SELECT id, 'response', created_at IS NOT NULL FROM cloud_responses""")
def collections_union(spark, d):
    part = lambda name, kind: table(spark, d, name).select("id", F.lit(kind).alias("kind"), F.col("created_at").isNotNull().alias("dated"))
    return part("code_chunks", "chunk").unionByName(part("review_insights", "insight")).unionByName(part("cloud_responses", "response"))


@query("""SELECT collection, points, CASE WHEN points > 0 AND dated > 0 THEN 'green' WHEN points > 0 OR dated > 0 THEN 'yellow' ELSE 'red' END AS health FROM (SELECT 'code_chunks' AS collection, count(*) AS points, count(content) AS dated FROM code_chunks UNION ALL SELECT 'prompts', count(*), count(text) FROM prompts UNION ALL SELECT 'cloud_responses', count(*), count(raw_response) FROM cloud_responses UNION ALL SELECT 'review_insights', count(*), count(summary) FROM review_insights)""")
def collection_health(spark, d):
    parts = [table(spark, d, n).agg(F.lit(n).alias("collection"), F.count("*").alias("points"), F.count(c).alias("full")) for n, c in (("code_chunks", "content"), ("prompts", "text"), ("cloud_responses", "raw_response"), ("review_insights", "summary"))]
    x = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return x.select("collection", "points", F.when((F.col("points") > 0) & (F.col("full") > 0), "green").when((F.col("points") > 0) | (F.col("full") > 0), "yellow").otherwise("red").alias("health"))


@query("""SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def lineitem_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("bigint").alias("g1"), F.grouping("l_linestatus").cast("bigint").alias("g2"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT n_name, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderpriority)""")
def orders_rollup(spark, d):
    nation = F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name"))  # 25 rows, fixed
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.rollup("n_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
