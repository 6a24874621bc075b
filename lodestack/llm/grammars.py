"""Local grammars over the token classes of ``lexers``: which classes may not meet, level by level of nesting.

A balanced file is judged from the inside out. At each step the innermost brackets hold flat statements; these are tested
against the forbidden neighbours of the language, then each bracket shrinks to one operand (P for round, B for square, C for
curly) and the next level shows. What remains at the end is the outline of the file, tested against the forms that may stand
at the top. The rules say only what no program of the language may contain, so that a file is rejected for cause.
"""

from __future__ import annotations

import re

from lodestack.llm.lexers import INDENT

OPERAND = "[i0sPB]"
#: Fixed for all brace languages: characters, strings and markers that are never tokens; operators without their right side.
ALWAYS = [r"[MXU]|@@", r"[o=.|A]n*[)\]}]", r"(?<!\.)[up]n*[)\]};]", r"[o=.|]n*[;,]", r"=n*[o.:?]", r"\.n*[.0s]", r",n*;", r"[(\[]n*[o=]", r"on*o", r"=n*=", r"[0s]n?[.]?0", r"o$|=$|\.$"]
#: Statements of languages whose line ends don't count.
SEMICOLON = [r";[^{};]+(?<![C;])\}", r"r[^;{}C]*\}", r"(?:=|=k)i(?:\.i)*[PB]*i", r"r[i0s]i", r"0i|i0|0 0|si|0s", r"(?<![@.])iP[i0]", r"I[^(P]"]
#: What no statement of scripts holds: declarations without a name, two returns, functions that are statements without a name, headers of
#: loops with more than three parts, conditions without anything.
STATEMENTS = [r"(?:^n*|;n*|\)\{n*)V[=;o.)]", r"(?<!\.)rr", r"(?:^n*|;n*)k?FP", r"(?<!\.)I\([^()\[\]{}]*(?:;[^()\[\]{}]*){3,}\)", r"(?:^n*|;n*|[)C]n+)I\(n*\)"]
#: Members of interfaces, and types, of which something is missing.
TYPES = [r"ai[^{}()\[\];=]*\{[^{}]*:n*;", r"(?:^n*|;n*|n)k?ai?n*[;=]", r"(?:^n*|;n*)[LV]i:n*[;=]"]
RULES = {
    "js": [*ALWAYS, r"[i0s][i0s]", r"i0", r"B[i0s]", r"(?<!\.)I(?=[i0s{};)\]no=C])", r"F(?=[0s{}C;).=])", r"Fu?[ik][^(lPn]", r"FF", r"Fu?[ik]P[^{C:;n)]", r"[LV][ik](?=[i0s(P{Cou])", r"[LV](?=[^ik{CB\[nu.:,)}=(?;P])", r"c[ik]P", r"Ni(?=n|;|$|\.i)", r"iP[i0s]", r"=n*[LVr;}]", r"An*[;)]", r"[AFLVI]n*$", r"^n*\{n*s:", r"^n*\{n*\}?n*s?:", r"pn*[;)}]?$", r"rn*[)\]]", r"^n*[?),:]", r";n*[?,:]", r"\?n*[;\]}]", r"[,;({\[]n*\.i", *STATEMENTS],
    "go": [*ALWAYS[:2], r"[o=]n*[;,)]", r"=n*[o.:=]", r"iii", r"[0s]i", r"0s|s0", r"i0", r"ip", r"(?:^|n|;)n*[o=,:?]", r"(?<=[}C])n+e", r"e(?![{Ck])", r"F(?=[^i(P])", r"Fi[^(PB\[]", r"oo", r"[?@#A]", r"[^n;]G", r"oA|Rk", r"K(?=[0s{C])", r"=n*[;rK]"],
    "java": [*ALWAYS, *SEMICOLON, r"iii", r"ip", r"#", r"c[ik]P(?![C{ki])", r"[^i]c[^ik]", r"F", r"in?:i?[^,;]*$", r"ss", r"r[^;C{}]*r", r"k?i:i?=", r"A"],
    "dart": [*ALWAYS[:1], r"[o=.]n*[)\]}]", r"(?<!\.)[up][)\]};]", r"[o=.][;,]", *SEMICOLON[:2], *SEMICOLON[2:], r"iii", r"ip", r"ci?P", r"c[ik]P:", r"iiP:", r"^[Ck]*s", r"R", r"#[^iok=u]"],
    "c": [r"[MX]", r"U", r"[o=.|][)\]}]", r"(?<!\.)[up][)\]};]", r"[o=.|][;,]", *SEMICOLON[:2], r"=i(?:\.i)*[PB]*i", r"r[i0]i", r"0i|i0|00", r"(?<![k.])iP[i0](?!.*C$)", r"I[^(P]", r"iiii", r"(?<!k)i:i", r"ip", r"A|[@#]", r"(?:^|;)h*i[{C]", r"s;s|^h*s", r"kikiki"],
    "rs": [*ALWAYS[:1], r"[o=.]n*[)\]}]", r"[up]\]|[o=.][;]", r"=[;o]", r"[i0s][i0s]", r"P[i0]", r"B[i0s](?!$)", r"ki[i0]", r"L[^ik(P\[BCu{0s|g]", r"L[^;{}C]*L", r"[^Kk]i:i?;"],
}
RULES["ts"] = [*RULES["js"], *TYPES]
RULES = {k: re.compile("|".join(f"(?:{x})" for x in v)).search for k, v in RULES.items()}

#: The outline of a file once every bracket has shrunk.
TOPS = {
    "go": re.compile(r"[n;]*Gi(?:[n;]+(?:N(?:[i.]?s|P)|K[^n;]*(?:(?<=[o=,u.(|])n+[^n;]*)*|F[^n;]*C))*[n;]*"),
    "java": re.compile(r"(?:(?:@[i.]+P?)*G[i.]+;)?(?:;|Nk?[i.uo*k]+;)*(?:;|(?:[i.]+|kP?)*@?c[^;C]*C|(?:kP?)*(?:ii|i)P?[^;C]*C)*"),
    "dart": re.compile(r"(?:@[i.]+P?|[NckilgL@][^;C]*(?:C|;)|;)*"),
    "rs": re.compile(r"(?:#p?B)*(?:#B|;|K[^;C]*(?:C(?=[;#Kik]|$)|;|=[^;]*;)|kK[^;]*?(?:C|;)|k?i(?:Di)*pi?[PBC];?)*"),
    "c": re.compile(r"(?:[hGJ;]|[kil][^;C=.R0sou]*(?:[.R0sou](?![^;C]*C))?(?:=[^;]*|[^;C]*)(?:;|C;?))*"),
    "js": None,
    "ts": None,
}

ROUND, SQUARE, CURLY = re.compile(r"\([^()\[\]{}]*\)").sub, re.compile(r"\[[^()\[\]{}]*\]").sub, re.compile(r"\{[^()\[\]{}]*\}").sub
NOTES = re.compile(r"@i(?:\.i)*").sub


def braces(lang: str, s: str) -> bool:
    """Whether balanced classes of a brace language pass."""
    search, top = RULES[lang], TOPS[lang]
    if lang == "java":
        s = NOTES("k", s)
    elif lang == "c":
        if s.count("G") != s.count("J"):
            return False
        s = s.replace("J", "").replace("G", "") if top is None else s.translate({71: "h", 74: "h"})
        s = re.sub("h+", "h", s) if s[:1] == "h" else s
        s = s[:1] * (s[:1] == "h") + s.replace("h", "")
    while True:
        if search(s):
            return False
        t = CURLY("C", SQUARE("B", ROUND("P", s)))
        if t == s:
            break
        s = t
    if set("()[]{}") & set(s):
        return False
    return top is None or bool(top.fullmatch(s.replace("h", "") if lang == "c" else s))


#: Neighbours that no line of Python holds.
PY_LINE = re.compile(r"[MXU]|@@|[i0PBC][i0s]|s[i0]|[o=.]$|[o=.][)\]}:]|[up][)\]}]|[u]$|=[o=.]{1}(?<!==)|\.[^i]|oo|p[)=]|[?;]{2}|[?|]\?|A|^[o=.,:)]|,,|k?\[,|^[hmd][0s]|[{(],|r[:)]|[byx]$").search
PY_SPLIT = re.compile(rf"n([{chr(INDENT)}-{chr(INDENT + 2000)}])").split


def python(s: str) -> bool:
    """Whether balanced classes of Python pass: neighbours, and blocks by their indents."""
    while True:
        t = CURLY("C", SQUARE("B", ROUND("P", s)))
        if t == s:
            break
        for m in re.finditer(r"\(([^()\[\]{}]*)\)|\[([^()\[\]{}]*)\]|\{([^()\[\]{}]*)\}", s):
            inner = re.sub(r"n.", "", m[1] or m[2] or m[3] or "")
            if inner and PY_INNER(inner):
                return False
        s = t
    parts = PY_SPLIT(s)
    stack, opened, before, kinds, tried = [0], False, "", [""], set()
    for width, line in zip([chr(INDENT), *parts[1::2]], parts[0::2]):
        if not line:
            continue
        w = ord(width) - INDENT
        if opened:
            if w <= stack[-1]:
                return False
            stack.append(w)
            kinds.append(before)
        else:
            if w > stack[-1]:
                return False
            while w < stack[-1]:
                tried.discard(stack.pop())
                kinds.pop()
                if stack[-1] in tried and w < stack[-1]:
                    return False
            if w != stack[-1]:
                return False
        if w in tried and line[0] != "x" or kinds[-1] == "m" and (line[0] != "d" or ":" not in line) or line[0] in "md" and line[1:2] == "i" and ":" not in line:
            return False
        tried.discard(w)
        if PY_LINE(line):
            return False
        opened = line[-1] == ":"
        head = before = line[0]
        if head == "k" and line[1:2] == "b":
            head = "b"
        if head in "byx":
            if ":" not in line:
                return False
            if head == "y":
                tried.add(w)
        elif opened and head not in "md":
            return False
    return not opened and not tried


PY_INNER = re.compile(r"[MXU]|[i0PBC][i0s](?!b)|s[i0]|[o=.u]$|[o=.][,)\]}]|,,|^,.|\.[^i]|[;]|[o]o|=[=o]").search


def valid(lang: str, classes: str) -> bool:
    """Whether the whole of a file's token classes, balanced already, may be source of the language. Empty files are valid."""
    if not classes or not classes.strip("nhGJ" + chr(INDENT)):
        return "G" not in classes or lang == "c" and classes.count("G") == classes.count("J")
    return python(classes) if lang == "py" else braces(lang, classes)
