"""JSON out of model answers, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REVIEW = "summary string, severity string, issues array<struct<file:string,line:int,category:string,severity:string,comment:string,suggestion:string>>"
SEVERITIES = ("critical", "high", "medium", "low", "info")


#: Pieces of a text that matter for its braces: escaped characters, quotes, braces, and runs of others.
PIECES = r'(\\[\s\S]|["{}]|[^\\"{}]+|\\)'


def object_spans(text: Column) -> Column:
    """array<struct<a, n>>: where outermost balanced objects of a text begin (from 1) and how long they are; braces in strings don't count."""
    size = lambda x: F.length(x).cast("int")
    start = F.struct(F.lit(1).alias("pos"), F.lit(0).alias("depth"), F.lit(False).alias("string"), F.lit(0).alias("a"), F.array().cast("array<struct<a:int,n:int>>").alias("spans"))

    def step(s: Column, x: Column) -> Column:
        quote = (x == '"') & (s["depth"] > 0)
        opens, closes = (x == "{") & ~s["string"], (x == "}") & ~s["string"] & (s["depth"] > 0)
        done = closes & (s["depth"] == 1)
        return F.struct(
            (s["pos"] + size(x)).alias("pos"), (s["depth"] + opens.cast("int") - closes.cast("int")).alias("depth"), (s["string"] != quote).alias("string"),
            F.when(opens & (s["depth"] == 0), s["pos"]).otherwise(s["a"]).alias("a"),
            F.when(done, F.array_append(s["spans"], F.struct(s["a"].alias("a"), (s["pos"] + 1 - s["a"]).alias("n")))).otherwise(s["spans"]).alias("spans"),
        )

    return F.aggregate(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(1)), start, step, lambda s: s["spans"])


def is_json(text: Column) -> Column:
    return F.get_json_object(text, "$").isNotNull()


def objects(answer: Column) -> Column:
    """All outermost objects of an answer in order, up to the first that isn't JSON; objects inside others belong to these."""
    texts = F.transform(object_spans(answer), lambda s: F.substring(answer, s["a"], s["n"]))
    whole = F.aggregate(texts, F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("out")), lambda s, x: F.when(s["on"] & is_json(x), F.struct(F.lit(True).alias("on"), F.array_append(s["out"], x).alias("out"))).otherwise(F.struct(F.lit(False).alias("on"), s["out"].alias("out"))), lambda s: s["out"])
    return whole


def json_text(answer: Column) -> Column:
    """The first fenced block if it is JSON, else the first balanced object if it is, else the whole answer if it is; else null."""
    fenced = F.trim(F.regexp_extract(answer, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1))
    first = F.get(object_spans(answer), F.lit(0))
    balanced = F.substring(answer, first["a"], first["n"])
    whole = F.trim(answer)
    return F.when((fenced != "") & is_json(fenced), fenced).when(is_json(balanced), balanced).when(is_json(whole), whole)


def parsed(answers: DataFrame, key: str, text: str) -> DataFrame:
    """key, review, valid: the review of an answer as a struct; what isn't JSON is null."""
    x = answers.select(key, json_text(F.col(text)).alias("_json"))
    return x.select(key, F.when(F.get_json_object("_json", "$").isNotNull(), F.from_json("_json", REVIEW)).alias("review"), F.get_json_object("_json", "$").isNotNull().alias("valid"))


def findings(reviews: DataFrame, key: str) -> DataFrame:
    """One row a finding; unknown severities become medium, missing categories style, and lines start at 1."""
    x = reviews.where("review is not null").select(key, F.posexplode("review.issues").alias("ordinal", "i"))
    severity = F.lower(F.col("i.severity"))
    return x.select(key, "ordinal", "i.file", F.greatest(F.coalesce("i.line", F.lit(1)), F.lit(1)).alias("line"), F.coalesce(F.nullif(F.lower("i.category"), F.lit("")), F.lit("style")).alias("category"), F.when(severity.isin(*SEVERITIES), severity).otherwise("medium").alias("severity"), F.coalesce("i.comment", F.lit("")).alias("comment"))


def flat_objects(answer: Column) -> Column:
    """All objects of an answer that hold no others, in order; for texts without braces in strings."""
    return F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"(\{[^{}]*\})"), F.lit(1))
