"""Helpers that run on the driver, and columns against plain Python."""

import re
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions import globs, text
from lodestack.functions.vectors import cosine, euclidean, nearest
from lodestack.operators.filters import compiled, lint


@pytest.mark.parametrize(
    "pattern,path,expected",
    [
        ("src/**/*.ts", "src/a.ts", True), ("src/**/*.ts", "src/a/b/c.ts", True), ("src/*.ts", "src/a/b.ts", False), ("**/test/**", "a/test/b", True), ("dist/**", "dist", True), ("dist/**", "distx/a", False),
        ("*.{ts,js}", "a.js", True), ("*.{ts,js}", "a.jsx", False), ("a?.py", "ab.py", True), ("a?.py", "a/.py", False), ("a.b", "axb", False), ("{a,{b,c}}/x", "c/x", True),
    ],
)
def test_glob(pattern, path, expected):
    assert bool(re.match(globs.regex(pattern), path)) is expected


def test_hash32(spark):
    def plain(s):
        h = 0
        for u in s.encode("utf-16-le")[::2], :
            pass
        units = np.frombuffer(s.encode("utf-16-le"), dtype=np.uint16)
        for u in units:
            h = (h * 31 + int(u)) & 0xFFFFFFFF
        h = h - (1 << 32) if h >= 1 << 31 else h
        h, out = abs(h), ""
        while h:
            h, r = divmod(h, 36)
            out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        return out or "0"

    values = ["abc", "", "a" * 200, "Straße 😀", "\x00\n"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.hash32(F.col("v")).alias("h")).collect()
    assert {r.v: r.h for r in got} == {v: plain(v) for v in values}


def test_vectors_and_neighbours(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 8)).round(3)
    m[7] = 0
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "id long, vector array<float>")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in nearest(df.where("id % 10 = 0"), df, 3).collect()}
    f = m.astype(np.float32).astype(np.float64)
    n = np.linalg.norm(f, axis=1)
    for q in range(0, 60, 10):
        s = [(-(f[q] @ f[j]) / (n[q] * n[j]) if n[j] else 0.0, j) for j in range(60) if j != q]
        for k, (score, j) in enumerate(sorted(s)[:3], 1):
            assert got[q, k][0] == j and abs(got[q, k][1] + score) < 1e-9
    assert nearest(df.limit(0), df, 3).count() == 0
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    r = spark.range(1).select(cosine(a, a).alias("one"), cosine(a, b).alias("zero"), cosine(a, F.array(F.lit(1.0))).alias("none"), euclidean(a, b).alias("five")).head()
    assert (round(r.one, 9), r.zero, r.none, r.five) == (1.0, 0.0, None, 5.0)


def test_neighbours_with_equal_vectors(spark):
    rng = np.random.default_rng(7)
    copy, ids = [float(x) for x in rng.normal(size=67)], rng.permutation(400)
    rows = [(int(i), copy if i % 4 else [float(x) for x in rng.normal(size=67)]) for i in ids]
    df = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)
    queries = [1, 3, 399, 398]
    got = nearest(df.where(F.col("id").isin(queries)), df, 5).orderBy("query_id", "rank").collect()
    want = [i for i in range(1, 400) if i % 4]
    for q in queries:
        assert [r.id for r in got if r.query_id == q] == [i for i in want if i != q][:5]
    assert len({r.score for r in got}) == 1


def test_exclusions_keep_nulls(spark):
    df = spark.createDataFrame([(1, "go", None, 4), (2, None, ["x"], None), (3, "c", [], 9)], "id int, language string, imports array<string>, complexity int")
    ids = lambda spec: sorted(r.id for r in df.where(compiled(spec)[0]).collect())
    assert ids({"exclude_languages": ["go"]}) == [2, 3]
    assert ids({"has_imports": False}) == [1, 3]
    assert ids({"custom": {"complexity": {"range": {"gt": 4, "lte": 9}}}}) == [3]
    assert ids({}) == [1, 2, 3] and compiled({})[2] == ["No filters specified"]
    assert lint({"languages": ["go"], "exclude_languages": ["go"], "files": []}) == ["languages and exclude_languages share go", "files is empty"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab*?/.{},", max_size=12))
def test_globs_compile(pattern):
    re.compile(globs.regex(pattern))


def test_core_without_llm():
    code = "import sys; sys.modules['lodestack.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q[:2] in ('p1', 'p2')] and 'batch_knn_top5' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True)
