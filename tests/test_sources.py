"""Folder scans, exported history and review stores."""

from pyspark.sql import functions as F

from lodestack.sources import files


def test_walk(spark, tmp_path):
    root = tmp_path / "repo"
    for name, content in {"src/a.ts": b"let a = 1;\n", "src/deep/b.py": b"x\xffy", "src/deep/c.png": b"\x89PNG", "node_modules/x/a.js": b"a", ".git/config": b"x", "bin/tool": b"ab\x00c", "big.md": b"x" * 2000, "empty.go": b""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    x = files.walk(spark, str(root), exclude=("node_modules/**",), max_bytes=1000)
    rows = {r.relative_path: r for r in x.collect()}
    assert sorted(rows) == ["bin/tool", "src/a.ts", "src/deep/b.py", "src/deep/c.png"]
    assert {p for p, r in rows.items() if r.is_binary} == {"bin/tool", "src/deep/c.png"}
    assert rows["src/a.ts"].language == "typescript" and rows["src/a.ts"].content == "let a = 1;\n"
    assert [r.relative_path for r in files.walk(spark, str(root), include=("src/**/*.{ts,py}",), max_depth=1).collect()] == ["src/a.ts"]


def test_commits(spark):
    log = "\x1eabcdef1234\x1fp1 p2\x1fAnn\x1fa@x\x1f2024-05-01T10:00:00+02:00\x1ffix: x\n\n3\t1\tsrc/a.ts\n-\t-\timg.png\n\x1e99\x1f\x1fBob\x1f\x1fbad\x1f\n"
    rows = {r.commit_sha: r for r in files.commits_of(spark.createDataFrame([(log,), ("",), (None,)], "value string")).collect()}
    a, b = rows["abcdef1234"], rows["99"]
    assert (a.short_hash, a.files, a.lines_added, a.lines_deleted, a.is_merge, a.message) == ("abcdef1", ["src/a.ts", "img.png"], 3, 1, True, "fix: x")
    assert (b.files, b.lines_added, b.is_merge, b.commit_date) == ([], 0, False, None)
    x = spark.createDataFrame([("b", "2024-01-01", "u"), ("a", "2024-01-01", "u"), ("c", "2023-01-01", "v")], "commit_sha string, commit_date string, author string").withColumn("commit_date", F.col("commit_date").cast("timestamp"))
    assert [r.commit_sha for r in files.recent(x, 1, author="u").collect()] == ["a"]
    assert files.recent(x, 9, since="2024-01-01").count() == 2


def test_reviews(spark, tmp_path):
    for name, text in {"a.json": '{"id": "r1", "timestamp": "2024-01-01", "title": "x"}', "b.json": '{"id": "r1", "timestamp": "2024-02-01", "title": "y"}', "c.json": '{"id": ', "d.json": '{"title": "z"}'}.items():
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in files.reviews(spark, str(tmp_path), "id string, timestamp string, title string").collect()] == [("r1", "2024-02-01", "y")]
