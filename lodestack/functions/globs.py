"""Globs compiled on the driver to regular expressions that Java and RE2 read alike."""

from __future__ import annotations

import re


def braces(pattern: str) -> list[str]:
    """All alternatives of nested ``{a,b}`` groups; an unbalanced brace stands for itself."""
    depth, start = 0, -1
    for i, c in enumerate(pattern):
        if c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                parts, level, last = [], 0, start + 1
                for j in range(start + 1, i):
                    level += (pattern[j] == "{") - (pattern[j] == "}")
                    if pattern[j] == "," and level == 0:
                        parts.append(pattern[last:j])
                        last = j + 1
                parts.append(pattern[last:i])
                return [x for p in parts for x in braces(pattern[:start] + p + pattern[i + 1 :])]
    return [pattern]


def regex(pattern: str) -> str:
    """``**`` spans levels (also none), ``*`` and ``?`` stay within one; a trailing ``/**`` takes the folder itself too."""
    out = []
    for alternative in braces(pattern):
        r, i = "", 0
        while i < len(alternative):
            if alternative.startswith("**/", i):
                r, i = r + "(?:.*/)?", i + 3
            elif alternative.startswith("/**", i) and i + 3 == len(alternative):
                r, i = r + "(?:/.*)?", i + 3
            elif alternative.startswith("**", i):
                r, i = r + ".*", i + 2
            else:
                c = alternative[i]
                r, i = r + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
        out.append(r)
    return f"^(?:{'|'.join(out)})$"
