"""Classes, functions, methods and the like of whole source files, by their braces: a scanner for scripts and Dart, one file a row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What holds no code: comments, strings, templates and regular expressions after an operator.
SKIPPED = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|r?\"\"\"[\s\S]*?(?:\"\"\"|\Z)|r?'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`|(?<=[=(,:!&|?])\s*/(?![/*])(?:[^/\\\n]|\\.)+/")
CALLED = {"if", "for", "while", "switch", "catch", "with", "function", "return", "do", "else", "try", "assert"}
TYPES = {"function": "function", "arrow": "function", "constructor": "function", "method": "method", "class": "class", "interface": "class", "namespace": "module", "module": "module", "enum": "statement"}
NAMED = re.compile(r"\b(class|interface|enum|namespace|module|mixin|extension)\s+([\w$.]+)")
BRANCHES = re.compile(r"\b(?:if|for|while|do|switch|try|catch)\b")
CALL = re.compile(r"([\w$#]+)\s*(?:<[^<>()]*>)?\s*\Z")


def masked(text: str) -> str:
    """The text with blanks in place of what holds no code; lines and places stay."""
    return SKIPPED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def pairs_of(code: str) -> dict[int, int]:
    """Each bracket's partner, both ways; brackets that don't match have none."""
    out, stack = {}, []
    for m in re.finditer(r"[()\[\]{}]", code):
        if m[0] in "([{":
            stack.append(m.start())
        elif stack and code[stack[-1]] + m[0] in ("()", "[]", "{}"):
            out[m.start()] = stack.pop()
            out[out[m.start()]] = m.start()
    return out


def header(code: str, pairs: dict[int, int], at: int) -> int:
    """Where the statement that a brace at ``at`` belongs to begins; parameters in round brackets are passed over."""
    k = at - 1
    while k >= 0:
        if code[k] in ")]" and k in pairs:
            k = pairs[k]
        elif code[k] in ";{}([,":
            break
        k -= 1
    k += 1
    return k + len(code[k:at]) - len(code[k:at].lstrip())


def classified(code: str, pairs: dict[int, int], at: int, parent: str | None, dart: bool) -> tuple[str, str | None, int] | None:
    """(kind, name, start) of what a brace opens, or None if it is a block or an object."""
    start = header(code, pairs, at)
    before = code[start:at].rstrip()
    m = NAMED.match(re.sub(r"^(?:(?:export|default|abstract|declare|const|sealed|base|final)\s+)+", "", before))
    if m:
        return ("class" if m[1] in ("mixin", "extension") else m[1]), m[2], start
    if before.endswith("=>"):
        end = start + len(before) - 2
        while end > start and code[end - 1].isspace():
            end -= 1
        begin = pairs[end - 1] if end and code[end - 1] == ")" and end - 1 in pairs else end - len(re.search(r"[\w$]*\Z", code[start:end])[0])
        name = re.search(r"([\w$]+)\s*(?::[^=]*)?[=:]\s*(?:async\s*)?\Z", code[start:begin])
        return "arrow", name[1] if name else None, begin
    tail = re.sub(r"\s*(?:async\*?|sync\*)\Z", "", before) if dart else re.sub(r"\)\s*:[^()]*\Z", ")", before)
    if not tail.endswith(")") or start + len(tail) - 1 not in pairs:
        return None
    opened = pairs[start + len(tail) - 1]
    f = re.search(r"(?:\basync\s+)?\bfunction\b\s*\*?\s*([\w$]*)\s*(?:<[^<>()]*>)?\s*\Z", code[start:opened])
    if f and not dart:
        return "function", f[1] or None, start + f.start() if re.search(r"[=(,:?]|\breturn\b", code[start : start + f.start()]) else start
    called = CALL.search(code[start:opened])
    if not called or called[1] in CALLED or re.search(r"=|\b(?:new|return|await|throw)\b", code[start:opened]):
        return None
    if dart:
        return ("method" if parent == "class" else "function"), called[1], start
    return (("constructor" if called[1] == "constructor" else "method"), called[1], start) if parent in ("class", "object") else None


def complexity(kind: str, code: str, dart: bool) -> int:
    """Fixed rules of the two languages: branches, ternaries and logic in scripts; members of classes, branches and runs of operators in Dart."""
    if not dart:
        return 1 + 2 * len(BRANCHES.findall(code)) + len(re.findall(r"\?(?![.?:)\],;=])", code)) + code.count("&&") + code.count("||")
    if kind == "class":
        return 5 + 2 * len(re.findall(r"\w+\s*\([^)]*\)\s*\{", code)) + len(re.findall(r"(?:final|var|const|late)\s+\w+", code))
    return 2 + len(BRANCHES.findall(code)) + len(re.findall(r"[+\-*/%=<>&^|!~?]+", code)) // 3


def nodes_of(text: str, dart: bool) -> list[tuple[str, str, str | None, int, int, int, int]]:
    """(kind, type, name, start_line, end_line, depth, complexity) of one file, in order. In scripts those of 3 and more lines; in Dart classes, functions and methods of 5 and more, and runs of imports."""
    code = masked(text)
    pairs = pairs_of(code)
    breaks = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: _rank(breaks, at) + 1
    out: list = []
    open_: list[tuple[int, str]] = []
    for m in re.finditer(r"\{", code):
        at = m.start()
        while open_ and open_[-1][0] < at:
            open_.pop()
        if at not in pairs:
            continue
        parent = open_[-1][1] if open_ else None
        found = classified(code, pairs, at, parent, dart)
        kind = found[0] if found else "object" if re.search(r"[=(,:?\[]\s*\Z|\breturn\s*\Z", code[max(0, at - 40) : at]) else "block"
        if found:
            a, b = line(found[2]), line(pairs[at])
            depth = sum(1 for _, k in open_ if k not in ("object", "block"))
            if dart and (kind == "class" or kind in ("function", "method") and b - a + 1 >= 5) or not dart and b - a + 1 >= 3:
                out.append((kind, TYPES[kind], found[1], a, b, depth, complexity(kind, code[found[2] : pairs[at] + 1], dart)))
        open_.append((pairs[at], kind))
    if dart:
        for m in re.finditer(r"(?m)^[ \t]*(?:import|export) [^\n]*(?:\n[ \t]*(?:import|export) [^\n]*)*", code):
            out.append(("module", "module", None, line(m.start()), line(m.end()), 0, 1))
    return sorted(out, key=lambda x: (x[3], x[4], x[0]))


def _rank(breaks: list[int], at: int) -> int:
    from bisect import bisect_left

    return bisect_left(breaks, at)


FOUND = T.ArrayType(T.StructType([*(T.StructField(x, T.StringType()) for x in ("kind", "type", "name")), *(T.StructField(x, T.IntegerType()) for x in ("start_line", "end_line", "depth", "complexity"))]))


@F.pandas_udf(FOUND)
def _found(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    names = FOUND.elementType.names
    for texts, languages in parts:
        yield pd.Series([[dict(zip(names, x)) for x in nodes_of(t, lang == "dart")] for t, lang in zip(texts, languages)], dtype=object)


def nodes(lines: DataFrame, keys: list[str], language: str) -> DataFrame:
    """keys, kind, type, name, start_line, end_line, depth, complexity of the files that ``keys`` name, out of their lines (keys, pos from 0, line) and ``language``.

    Kinds are class, interface, enum, namespace, module, function, arrow, method, constructor; in Dart class, function, method and
    module (a run of imports). Files whose braces don't match give what does; files without any give no row.
    """
    files = lines.groupBy(*keys, language).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("line", F.lit("")).alias("line")))), lambda x: x["line"]), "\n").alias("_text"))
    return files.select(*keys, F.explode(_found("_text", language)).alias("_n")).select(*keys, "_n.*")
