"""Operators against brute force on small tables, with nulls, ties, repeats and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.functions import vectors
from lodestack.operators import answers, chunkers, diffs, joins, prompts, store
from lodestack.plans import retrieval
from lodestack.streaming import windows


@pytest.mark.parametrize("size,overlap", [(50, 5), (7, 3), (3, 0)])
def test_line_windows(spark, size, overlap):
    random.seed(size)
    texts = [(i, "\n".join(random.choice(["x", "", "  ", "line"]) for _ in range(random.randint(1, 160)))) for i in range(30)] + [(98, ""), (99, None)]
    got = sorted(tuple(r) for r in chunkers.line_windows(spark.createDataFrame(texts, "k int, t string"), "k", "t", size, overlap).collect())
    want = []
    for k, t in texts:
        lines, at = (t.split("\n"), 0) if t is not None else ([], 0)
        while lines:
            part = lines[at : at + size]
            if "\n".join(part).strip():
                want.append((k, at + 1, at + len(part), "\n".join(part)))
            if at + size >= len(lines):
                break
            at += size - overlap
    assert got == sorted(want)
    with pytest.raises(ValueError):
        chunkers.line_windows(spark.range(1), "id", "id", 5, 5)


def test_declarations(spark):
    go = "package a\n\nfunc One(x int) int {\n\treturn x\n}\n\nfunc (s *S) Two() {\n\tif x {\n\t}\n}\n\nfunc three() {}\n"
    rows = chunkers.declarations(spark.createDataFrame([(1, go, "go"), (2, None, "go"), (3, "x", "other")], "id int, t string, l string"), ["id"], "t", "l").collect()
    assert sorted((r.name, r.start_line, r.end_line) for r in rows) == [("One", 3, 5), ("Two", 7, 10), ("three", 12, 12)]


def chunked(text, size=50, overlap=5):
    lines = text.split("\n")
    return [(at + 1, "\n".join(lines[at : at + size])) for at in range(0, max(1, len(lines) - overlap), size - overlap)]


def test_declarations_of_later_chunks(spark, tmp_path):
    go = "package a\n" + "\n" * 46 + "func One() {\n" + "\tx()\n" * 9 + "}\n" + "\n" * 60 + "func Two() {\n\ty()\n}\nfunc three() {}\n"
    rows = [(f"{v}{s}", v, "a.go", label, s, c) for v, label in (("c", "golang"), ("n", None)) for s, c in chunked(go)]
    rows += [(f"g{s}", "g", "a.go", "go", s, c if s != 46 else None) for s, c in chunked(go)] + [rows[0], ("z", None, None, "go", 1, "func z() {\n}"), ("o", "o", "a.txt", "other", 1, "func o() {}")]
    spark.createDataFrame(rows, "id string, commit_sha string, file string, language string, start_line int, content string").write.parquet(str(tmp_path / "code_chunks.parquet"))
    got = sorted((r.id, r.name, r.start_line, r.end_line) for r in retrieval.declaration_chunks(spark, str(tmp_path)).collect())
    whole = [("1", "One", 48, 58), ("91", "Two", 119, 121), ("91", "three", 122, 122)]
    assert got == sorted([(v + i, *x) for v in "cn" for i, *x in whole] + [("g1", "One", 48, None), ("g91", "Two", 119, 121), ("g91", "three", 122, 122), ("z", "z", 1, 2)])


def test_diffs_of_later_chunks(spark, tmp_path):
    diff = "diff --git a/x b/x\n@@ -1,60 +1,61 @@\n" + " same\n" * 45 + "+new\n" * 2 + " same\n" * 14 + "diff --git a/y b/y\n@@ -1 +0,0 @@\n-old\n"
    rows = [(f"d{s}", "d", "x.diff", None, s, c) for s, c in chunked(diff)]
    spark.createDataFrame([*rows, rows[1]], "id string, commit_sha string, file string, language string, start_line int, content string").write.parquet(str(tmp_path / "code_chunks.parquet"))
    assert [(r.id, r.added, r.deleted, r.status) for r in retrieval.unified_diff_lines(spark, str(tmp_path)).collect()] == [("d1", 2, 1, "modified")]


def test_interval_join(spark):
    random.seed(1)
    chunks = [(i, random.choice("ab"), s, s + random.randint(-1, 200)) for i in range(40) for s in [random.randint(1, 400)]] + [(90, "a", None, 5)]
    points = [(i, random.choice("abc"), random.choice([None, 0, *range(1, 500)])) for i in range(80)]
    got = joins.interval_join(spark.createDataFrame(chunks, "c int, f string, s int, e int"), spark.createDataFrame(points, "p int, f string, at int"), ["f"], "s", "e", "at")
    want = sorted((c, p) for c, f, s, e in chunks for p, g, at in points if f == g and None not in (s, e, at) and s <= at <= e)
    assert sorted((r.c, r.p) for r in got.collect()) == want


def test_delta_and_as_of(spark):
    old = spark.createDataFrame([("f", "h1", "1"), ("f", "h1", "2"), ("f", "h2", "3"), ("g", None, "4")], "file string, d string, id string")
    new = spark.createDataFrame([("f", "h1", "9"), ("f", "h3", "8")], "file string, d string, id string")
    assert sorted((r.d, r.action, r.id) for r in joins.delta(old, new, ["file"], "d", "id").collect()) == [("h1", "unchanged", "2"), ("h2", "delete", "3"), ("h3", "add", "8")]
    assert {r.action for r in joins.delta(old, old, ["file"], "d", "id").collect()} == {"unchanged"}
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, "v", 9)], "id int, u string, t int")
    right = spark.createDataFrame([("u", 5, 7.0), ("u", 2, 1.0), ("v", 10, 2.0)], "u string, t int, x double")
    assert sorted((r.id, r.last_x) for r in joins.as_of(left, right, ["u"], "t", ["x"]).collect()) == [(1, 7.0), (2, None), (3, None)]


def test_diff_lines(spark):
    text = "diff --git a/x b/x\n@@ -1,3 +1,4 @@ head\n one\n-two\n+2\n+more\n three\n@@ -9 +10 @@\n-nine\ndiff --git a/y b/y\n@@ -0,0 +1 @@\n+new\n"
    lines = diffs.diff_lines(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t")
    got = [(r.file_no, r.hunk_no, r.kind, r.old_line, r.new_line, r.content) for r in lines.where("content <> ''").orderBy("pos").collect()]
    assert got == [
        (1, 1, "context", 1, 1, "one"), (1, 1, "deletion", 2, None, "two"), (1, 1, "addition", None, 2, "2"), (1, 1, "addition", None, 3, "more"), (1, 1, "context", 3, 4, "three"), (1, 2, "deletion", 9, None, "nine"), (2, 3, "addition", None, 1, "new"),
    ]
    assert [tuple(r) for r in diffs.change_status(lines, "id").collect()] == [(1, 3, 2, "modified")]


def test_answers(spark):
    rows = [("a", '```json\n{"summary": "s", "issues": [{"file": "f", "line": 0, "severity": "HIGH", "comment": "c {"}]}\n```'), ("b", 'Here: {"issues": [{"severity": "odd", "category": ""}]}'), ("c", "no json"), ("d", '{"issues": [')]
    parsed = answers.parsed(spark.createDataFrame(rows, "id string, t string"), "id", "t")
    assert {r.id: r.valid for r in parsed.collect()} == {"a": True, "b": True, "c": False, "d": False}
    assert sorted((r.id, r.line, r.category, r.severity) for r in answers.findings(parsed, "id").collect()) == [("a", 1, "style", "high"), ("b", 1, "style", "medium")]


def test_budgets(spark):
    r = spark.range(1).select(*[c.alias(k) for k, c in prompts.allocated(F.lit(8000)).items()]).head().asDict()
    assert r == {"preamble": 800, "context": 3200, "diffs": 2400, "insights": 800, "instructions": 800}
    df = spark.createDataFrame([("g", i, "x" * 40) for i in range(5)] + [("g", 9, None)], "g string, i int, t string")
    assert [x.i for x in prompts.within_budget(df, ["g"], ["i"], "t", 33).orderBy("i").collect()] == [0, 1, 2]
    assert prompts.within_budget(df, ["g"], ["i"], "t", 0).count() == 6


def test_shares_of_groups_without_tokens(spark):
    """A group whose texts are all null or empty has no share to give; the others get theirs."""
    df = spark.createDataFrame([("a", 1, "x" * 40), ("a", 2, "y" * 120), ("a", 3, ""), ("b", 1, None), ("b", 2, ""), (None, 1, "z"), ("c", 1, None)], "g string, i int, t string")
    assert sorted(tuple(r) for r in prompts.proportional(df, ["g"], "t", 500).where("g is not null").drop("t").collect()) == [("a", 1, 10, 125), ("a", 2, 30, 375)]
    assert [tuple(r) for r in prompts.proportional(df, ["g"], "t", 500).where("g is null").drop("t").collect()] == [(None, 1, 1, 500)]


def test_store(spark):
    rows = lambda x: spark.createDataFrame(x, "id string, n int, op string, v string")
    log = rows([("a", 1, "upsert", "x"), ("a", 2, "upsert", "y"), ("b", 1, "upsert", None), ("b", 5, "delete", "z"), ("c", 1, "upsert", "w"), ("c", 1, "upsert", "w")])
    assert sorted((r.id, r.v) for r in store.replayed(log, "id", "n", "op").collect()) == [("a", "y"), ("c", "w")]
    assert sorted((r.id, r.v) for r in store.merged(log.where("n = 5"), rows([("b", 6, "upsert", "q")]), "id").collect()) == [("b", "q")]
    assert store.newest(log.limit(0), "id", ["n"]).count() == 0


def test_change_stream(spark, tmp_path):
    """Two runs over a growing folder add two folders to the log; what remains is each key's last change."""
    folder, path = str(tmp_path / "in"), str(tmp_path / "log")
    schema = "id string, seq int, op string, v string"
    spark.createDataFrame([("a", 1, "upsert", "x"), ("b", 2, "upsert", "y"), ("a", 3, "delete", None), ("c", 1, "upsert", "z")], schema).write.parquet(folder)
    windows.logged_changes(spark.readStream.schema(schema).parquet(folder), path, "id", ["seq"]).awaitTermination()
    log = spark.read.parquet(path)
    assert log.count() == 3 and sorted((r.id, r.v) for r in store.replayed(log, "id", "seq", "op").collect()) == [("b", "y"), ("c", "z")]


def test_nearest_blocks(spark, monkeypatch):
    """Blocks of any size, broadcast or shuffled, give the brute-force neighbours, ties by id."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 6)).round(1)
    v[40:80] = v[0]
    v[5] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    unit = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) == 0, 1, np.linalg.norm(v, axis=1, keepdims=True))
    want = {i: [j for _, j in sorted((-round(float(unit[i] @ unit[j]), 9), j) for j in range(120) if j != i)[:7]] for i in range(0, 120, 10)}
    for q, r, most in ((2_000, 4_000, 100), (3, 11, 100), (3, 11, 0)):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", q)
        monkeypatch.setattr(vectors, "ROW_BLOCK", r)
        monkeypatch.setattr(vectors, "BROADCAST_QUERIES", most)
        got: dict = {}
        for x in vectors.nearest(df.where("id % 10 = 0"), df, 7).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append(x.id)
        assert got == want
    assert vectors.nearest(df.limit(0), df, 7).count() == 0 == vectors.nearest(df, df.limit(0), 7).count()


def scanned(text):
    """Outermost balanced objects, character by character."""
    out, depth, string, escape, start = [], 0, False, False, 0
    for i, c in enumerate(text):
        if escape:
            escape = False
        elif c == "\\":
            escape = True
        elif c == '"' and depth:
            string = not string
        elif c == "{" and not string:
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and not string and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


def test_objects_of_answers(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice('{}"\\a:1, \n') for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += ['Two: {"a": "}{", "b": {"c": 1}} and {"d": "\\"}"} {broken} {"e": 2}', 'x {"a": 1} then } and {', "", None, '```json\n{"f": [1, {"g": 2}]}\n``` {"h": 3}', "[1, 2]", '"é😀" {"k": "😀"} z']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r for r in df.select("i", answers.object_spans(F.col("t")).alias("s"), answers.objects(F.col("t")).alias("o"), answers.json_text(F.col("t")).alias("j"), F.transform(answers.object_spans(F.col("t")), lambda s: F.substring(F.col("t"), s["a"], s["n"])).alias("x")).collect()}
    assert all(got[i].x == (scanned(t) if t else [] if t == "" else got[i].x) for i, t in enumerate(texts))
    n = 300
    assert got[n].o == ['{"a": "}{", "b": {"c": 1}}', '{"d": "\\"}"}'] and got[n].j == got[n].o[0] and got[n + 1].o == ['{"a": 1}']
    assert got[n + 2].j is None and got[n + 3].j is None and got[n + 4].j == '{"f": [1, {"g": 2}]}' and got[n + 5].j == "[1, 2]" and got[n + 6].j == '{"k": "😀"}'


def file_lines(spark, files):
    rows = [("c", f, i, x) for f, t in files.items() for i, x in enumerate(t.split("\n"))]
    return spark.createDataFrame(rows, "v string, file string, pos int, line string")


def test_brace_chunks(spark):
    go = "package a\n\nfunc One() {\n\tif x {\n\t}\n}\nfunc (s *S) Two(a int) int {\n\treturn 1\n}\nfunc line() { return }\nfunc open() {\n\tx()"
    rust = "use a;\nfn one(x: u8) {\n    y();\n}\nimpl<T> B {\n    fn in() {\n    }\n}\nimpl A {\n}\nfn f()\nwhere X {\n}\n"
    got = lambda lang, t: sorted((r.kind, r.name, r.start_line, r.end_line) for r in chunkers.brace_chunks(file_lines(spark, {"f": t}), ["v", "file"], lang).collect())
    assert got("go", go) == [("function", "One", 3, 6), ("function", "line", 10, 10), ("function", "open", 11, 11), ("method", "Two", 7, 9)]
    assert got("rust", rust) == [("class", "A", 9, 10), ("function", "f", 11, 13), ("function", "one", 2, 4)]
    assert got("go", "package a\n\n// nothing") == [("file", None, 1, 3)]
    assert chunkers.brace_chunks(file_lines(spark, {"f": go}).limit(0), ["v", "file"], "go").count() == 0


def test_seeking_windows(spark):
    """Against the walk by its definition, line by line."""
    rng = random.Random(9)
    pool = ["", "}", "});", "import 'a';", "final x", "final y = 1;", "class A {", "  foo(a,", "  b && c", "void f(int a) {", "x();", "if (a", "\u201c}", "Future<int> g() {", "   ", '"""open', "late z"]
    good = lambda x: x == "" or x in ("}", "});", "})") or x.startswith(("import ", "export ")) or (x.split(" ")[0] in ("const", "var", "final", "late") and "=" not in x and len(x.split(" ")) > 1) or x.startswith(("class A", "void f(", "Future<int> g("))
    bad = lambda x: "(" in x and ")" not in x and ";" not in x or "&&" in x or '"""' in x and not x.endswith('"""')

    def slow(lines, size, overlap):
        out, at = [], 0
        while at < len(lines):
            start = max(0, at - (overlap if out else 0))
            end = min(len(lines), start + size)
            stop = next((i + 1 for i in range(end - 1, start - 1, -1) if good(lines[i].strip())), None)
            if stop is None:
                stop = next((i for i in range(end - 1, start - 1, -1) if bad(lines[i].strip())), end)
            stop = end if stop <= start else stop
            if "".join(lines[start:stop]).strip():
                out.append((start + 1, stop))
            at = stop if stop > at else at + 1
        return out

    files = {f"f{i}": [rng.choice(pool) for _ in range(rng.randint(1, 60))] for i in range(40)} | {"long": ["x();"] * 200}
    df = file_lines(spark, {k: "\n".join(v) for k, v in files.items()})
    for size, overlap in ((80, 3), (7, 2), (5, 0)):
        got: dict = {}
        for r in chunkers.seeking_windows(df, ["v", "file"], size, overlap).orderBy("file", "start_line", "end_line").collect():
            got.setdefault(r.file, []).append((r.start_line, r.end_line))
        assert got == {k: sorted(slow(v, size, overlap)) for k, v in files.items() if slow(v, size, overlap)}


def test_prompt_parts(spark):
    df = spark.createDataFrame([("g", "block", 0.9, 1), ("g", "function", 0.1, 2), ("g", None, 1.0, 3), ("g", "function", 0.1, 1), ("g", "class", None, 5)], "g string, kind string, score double, id int")
    assert [r.id for r in prompts.prioritised(df, ["g"], "kind", "score", "id").orderBy("place").collect()] == [1, 2, 5, 1, 3]
    parts = spark.createDataFrame([("a" * 40, " ", "b" * 40, None), ("a", "", "", "")], "p string, q string, r string, s string")
    rows = prompts.composed(parts, ["p", "q", "r", "s"], 10, " [cut]").collect()
    assert [(r.budget_used, r.budget_remaining, r.truncated) for r in rows] == [(21, -11, True), (1, 9, False)] and rows[0].text == "a" * 40 + " [cut]"
    assert [(r.estimated, r.warning) for r in prompts.preview(parts, ["p", "q", "r", "s"], 24).collect()] == [(21, "high utilisation"), (1, None)]


SCRIPT = """import { A } from './a';

export class Queue<T> extends Base {
  private items: T[] = [];

  constructor(private readonly size: number) {
    super();
  }

  push(item: T, { force }: Options = {}): void {
    if (this.items.length > this.size && !force) {
      throw new Error(`full { ${item} `);
    }
    this.items.push(item);
  }

  get short(): number { return 1; }
}

interface Shape {
  area: number;
  name?: string;
}

export const run = async (jobs: Job[]) => {
  for (const j of jobs) {
    await j.go(function done(x) {
      return x ? 1 : 2; // }
    });
  }
};

enum Kind {
  A,
}

function* walk(a = '{') {
  while (a) { yield a; }
}
"""
DART = """import 'dart:io';
import 'package:a/b.dart';

abstract class Shape extends Base {
  final int size = 1;

  double area(int x) {
    if (x > 1 && x < 3) {
      return 2.0;
    }
    return 1.0;
  }

  int one() { return 1; }
}

enum Kind { a, b }

Future<void> load(String path) async {
  final f = File(path);
  for (var l in f.readAsLinesSync()) {
    print('{$l');
  }
}
"""


def test_nodes_of_files(spark):
    """Classes, functions, methods, imports, enums, nesting and malformed files."""
    from lodestack.operators.nodes import nodes, nodes_of

    assert [x[:6] for x in nodes_of(SCRIPT, False)] == [
        ("class", "class", "Queue", 3, 18, 0), ("constructor", "function", "constructor", 6, 8, 1), ("method", "method", "push", 10, 15, 1), ("interface", "class", "Shape", 20, 23, 0), ("arrow", "function", "run", 25, 31, 0),
        ("function", "function", "done", 27, 29, 1), ("enum", "statement", "Kind", 33, 35, 0), ("function", "function", "walk", 37, 39, 0),
    ]
    assert [x[6] for x in nodes_of(SCRIPT, False)][2] == 4
    assert [x[:6] for x in nodes_of(DART, True)] == [("module", "module", None, 1, 2, 0), ("class", "class", "Shape", 4, 15, 0), ("method", "method", "area", 7, 12, 1), ("function", "function", "load", 19, 24, 0)]
    assert nodes_of("", True) == nodes_of("}}}{{{", False) == nodes_of("class A {\n x() {\n", False) == []
    assert [x[2] for x in nodes_of("class A {\n x() {\n }\n}\n}\nfunction f() {\n\n}\n", False)] == ["A", "f"]
    lines = file_lines(spark, {"q.ts": SCRIPT, "z.ts": "let a = 1;"}).withColumn("lang", F.lit("typescript"))
    got = nodes(lines, ["v", "file"], "lang")
    assert got.count() == 8 and {r.file for r in got.collect()} == {"q.ts"} and nodes(lines.limit(0), ["v", "file"], "lang").count() == 0
