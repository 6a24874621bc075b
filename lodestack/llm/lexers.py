"""Lexers of eight languages, as maps from the state at the start of a piece of text to its end state and token classes.

A piece of a file is lexed without knowing what came before it. Its *map* holds, for every state the text before may have
ended in (code, inside a comment, inside a long string), the state after the piece and the classes of its tokens. Maps
compose, so pieces of a file can be lexed on different executors and put together in any grouping.

Each token becomes one character, its class; the letters are listed in ``CLASSES``.
"""

from __future__ import annotations

import re

CODE = "c"

#: i name, 0 number, s string, t template, U string not closed, X no token of the language, M merge marker,
#: o binary operator, u operator that may also be a prefix, p prefix only, q ++ and --, = assignment, l < , g >, | bar,
#: A fat arrow, R thin arrow, E spread, T range, D ::, n line end (in Python followed by the width of the indent),
#: I keyword that needs a bracket, F function, L let, V const and var, a interface, c class, N import, G package, r return, e else, K item keyword,
#: k any other keyword, b compound keyword of Python (y try, x its handlers, m match, d case), h soft keyword or directive, ( [ { and their closers as they are.
CLASSES = "i0stUXMoupq=lg|ARETDnIFLVacNGJreKkbyxmdh"

INDENT = 0x4E00  # a line's indent of w columns is the character INDENT + w


def words(text: str, kind: str) -> dict[str, str]:
    return dict.fromkeys(text.split(), kind)


NUMBER = r"\d\w*(?:\.\d\w*)?(?:(?<=[eEpP])[+-]\d\w*)?"
NAME = r"[^\W\d]\w*"
DOLLAR_NAME = r"(?:[^\W\d]|\$)[\w$]*"
MARKER = r"(?m:^(?:<{7}|={7}|>{7}|\|{7})(?: [^\n]*|\r)?$)"
DQ, SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
OPEN = r"""["'][^\n]*"""
BLOCK = r"/\*[\s\S]*?\*/"
OPERATORS = {
    **{x: "o" for x in "/ % && || == != <= >= === !== ?? << >>> ** ^ += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= &^ &^= ~/ ~/= // //= @= <=>".split()},
    **{x: "u" for x in "+ - * & <-".split()},
    **{x: "=" for x in "= :=".split()},
    **{x: x for x in "( ) [ ] { } , ; : ? @ # |".split()},
    "!": "p", "~": "p", "++": "q", "--": "q", "<": "l", ">": "g", ".": ".", "?.": ".", "..": "T", "..=": "T", "..<": "T", "...": "E", "...?": "E", "=>": "A", "->": "R", "::": "D", "$": "k", "\\": "X",
}


def operators(text: str) -> str:
    return "|".join(re.escape(x) for x in sorted(text.split(), key=len, reverse=True))


class Lexer:
    """One language: a pattern that cuts text into tokens, keyword classes, and the states other than code.

    ``states``: for each state its opener's test on the last token and the pattern that runs from inside it to its end.
    """

    def __init__(self, tokens: list[str], ops: str, keywords: dict[str, str], states: dict[str, tuple], name: str = NAME, lines: str = "", indent: bool = False, skip: str = r"[ \t\r\f\v ﻿]"):
        blank = skip if lines or indent else skip[:-1] + r"\n]"
        self.cut = re.compile(rf"{blank}*((?:{')|(?:'.join([MARKER, *tokens])})|{name}|{NUMBER}|{operators(ops)}|{lines or '[^ ]'}|[\s\S])").findall
        self.states = {k: (re.compile(opener, re.S).match, re.compile(rest, re.S).match, kind) for k, (opener, rest, kind) in states.items()}
        self.openers = [(k, o, kind) for k, (o, _, kind) in self.states.items()]
        self.keywords, self.indent, self.lines = keywords, indent, bool(lines)
        self.known: dict[str, str] = {}

    def kind(self, x: str) -> str:
        """The class of one token."""
        known = self.keywords.get(x) or OPERATORS.get(x)
        if known:
            return known
        a = x[0]
        if a == "\n" and not self.lines:
            return ""
        if a == "\n" and not x.strip():
            return "n" + (chr(INDENT + min(len(x[1:].expandtabs(8)), 2000)) if self.indent else "")
        if x[:7] in ("<<<<<<<", "=======", ">>>>>>>", "|||||||"):
            return "M"
        if a.isidentifier() or a == "$" and len(x) > 1 or a == "#" and x[1:2].isidentifier() and "\n" not in x and " " not in x:
            if x[-1] in "\"'":
                return "s"
            return "i" if x.replace("$", "_").lstrip("#").isidentifier() else self.special(x)
        if a.isdigit():
            return "0"
        return self.special(x)

    def special(self, x: str) -> str:
        a, z = x[0], x[-1]
        if a in "\"'" or z in "\"'`#" and len(x) > 2 and a not in "/#":
            return "s" if len(x) > 1 and z == a or z in "\"'#" and len(x) > 2 and a.isalpha() else "U"
        if a == "`":
            return "t" if len(x) > 1 and z == "`" else "U"
        return "" if x.isspace() or x[:2] in ("//", "/*") else "X"

    def classes(self, text: str) -> tuple[str, str]:
        """End state and token classes of text that starts in code."""
        known, out = self.known, []
        if len(known) > 200_000:
            known.clear()
        tokens = self.cut(text)
        end, last = CODE, ""
        for x in tokens[-1:]:
            for k, opens, kind in self.openers:
                if opens(x):
                    end, last = k, kind
                    tokens = tokens[:-1]
                    break
        for x in tokens:
            y = known.get(x)
            if y is None:
                y = self.kind(x)
                if len(x) < 40:
                    known[x] = y
            out.append(y)
        return end, "".join(out) + last

    def map(self, text: str, first: bool) -> dict[str, tuple[str, str]]:
        """The map of a piece: of states before to (state after, classes); states left out stay as they are, without tokens."""
        maps = {CODE: self.classes(text)}
        if not first:
            for k, (_, rest, _) in self.states.items():
                m = rest(text)
                if m:
                    maps[k] = self.classes(text[m.end() :])
        return maps


#: The state of a piece that ends inside an expression of a template: only the whole file tells what follows.
DEEP = "?"
TEXT_PARTS = re.compile(r"\\[\s\S]|`|\$\{")
CODE_PARTS = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|[`{}]")


def template_end(text: str, at: int) -> tuple[int | None, str]:
    """Where a template whose text goes on at ``at`` ends, with templates and braces inside it nested to any depth; else None and the state at the end of the text."""
    stack = ["`"]
    while stack:
        m = (TEXT_PARTS if stack[-1] == "`" else CODE_PARTS).search(text, at)
        if not m:
            return None, "T" if len(stack) == 1 else DEEP
        at, x = m.end(), m[0]
        if x == "`":
            if stack[-1] == "`":
                stack.pop()
            else:
                stack.append("`")
        elif x in ("${", "{"):
            stack.append("{")
        elif x == "}":
            stack.pop()
    return at, ""


class Script(Lexer):
    """With regular expressions, which only the token before tells from divisions (the two are cut as one token), and with templates, which nest."""

    def classes(self, text: str) -> tuple[str, str]:
        out, whole = [], re.compile("`" + TEMPLATE).fullmatch
        while True:
            last = self.cut(text)[-1:]
            if not last or last[0][0] != "`" or whole(last[0]):
                end, kinds = super().classes(text)
                return end, "".join(out) + kinds
            at = len(text) - len(last[0])
            end, state = template_end(text, at + 1)
            out.append(super().classes(text[:at])[1] + "t")
            if end is None:
                return state, "".join(out)
            text = text[end:]

    def map(self, text: str, first: bool) -> dict[str, tuple[str, str]]:
        maps = super().map(text, first)
        if not first:
            end, state = template_end(text, 0)
            maps.pop("T", None)
            if end is not None:
                maps["T"] = self.classes(text[end:])
            elif state != "T":
                maps["T"] = state, ""
        return maps

    def special(self, x: str) -> str:
        if x[0] not in "\"'`/#" and "/" in x[1:] and (m := re.match(r"(\n[ \t]*|[a-z]+|\W{1,3}?)[ \t]*/(?![/*=])", x)):
            head = m[1].strip(" \t")
            return ("n" if head == "" or head == "\n" else self.keywords.get(head) or OPERATORS.get(head, "o")) + "s"
        return super().special(x)


REGEX = r"(?:&&|\|\||\?\?|=>|===?|!==?|[(,=:\[!&|?{};+*%^~]|\b(?:return|typeof|case|void|delete|throw)\b)[ \t]*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
TEMPLATE = r"(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`(?:[^`\\]|\\[\s\S])*`)*\})*`"
C_COMMENT = {"C": (r"/\*(?!.*\*/)", r".*?\*/", "")}
JS_WORDS = {
    **words("if while switch for with", "I"), **words("function", "F"), **words("let", "L"), **words("const var", "V"), **words("interface", "a"), **words("class", "c"), **words("import", "N"), **words("return throw", "r"), **words("else", "e"),
    **words("async await of as from get set static public private protected readonly abstract declare type namespace module enum extends implements is keyof infer unique asserts satisfies override accessor export default case break continue do try catch finally new delete typeof instanceof in void yield global require out using debugger", "k"),
}
JS_OPS = "/ % && || == != <= >= === !== ?? << >>> ** ^ += -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= + - * & = ( ) [ ] { } , ; : ? @ | ! ~ ++ -- < > . ?. ... =>"
SCRIPT = dict(
    tokens=[r"//[^\n]*", BLOCK, r"/\*[\s\S]*", REGEX, "`" + TEMPLATE, r"`[\s\S]*", DQ, SQ, OPEN, r"^#![^\n]*", r"#[^\W\d][\w$]*"], ops=JS_OPS, keywords=JS_WORDS,
    states={**C_COMMENT, "T": (r"`(?!.*`$)|`(?=[^`]*$)", TEMPLATE, "t")}, name=DOLLAR_NAME, lines=r"\n",
)
PY_WORDS = {
    **words("if for while def class with else elif", "b"), **words("try", "y"), **words("except finally", "x"), **words("match", "m"), **words("case", "d"), **words("type print exec", "h"), **words("import from", "k"), **words("return raise", "r"),
    **words("and or in is not lambda await async yield global nonlocal del assert pass break continue as", "k"), **words("None True False", "i"),
}
PY_PREFIX = r"(?:[rRbBuUfF]{1,2})?"
F_INNER = r"""\{(?:[^{}\n"']|"[^"\n]*"|'[^'\n]*'|\{[^{}\n]*\})*\}"""
PYTHON = dict(
    tokens=[
        r"\#[^\n]*", r"\\\r?\n", PY_PREFIX + r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""', PY_PREFIX + r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''", PY_PREFIX + r'"""[\s\S]*', PY_PREFIX + r"'''[\s\S]*",
        rf'[fF][rR]?"(?:[^"\\\n{{]|\\.|\{{\{{|{F_INNER})*"', rf"[fF][rR]?'(?:[^'\\\n{{]|\\.|\{{\{{|{F_INNER})*'", PY_PREFIX + DQ, PY_PREFIX + SQ, PY_PREFIX + OPEN,
    ], ops="+ - * / // % ** @ & | ^ ~ << >> <= >= == != < > = += -= *= /= //= %= **= @= &= |= ^= >>= <<= := -> ... ( ) [ ] { } , ; : .", keywords=PY_WORDS,
    states={"D": (r'[rRbBuUfF]{0,2}"""(?!.*""")', r'(?:[^"\\]|\\.|"(?!""))*"""', "s"), "S": (r"[rRbBuUfF]{0,2}'''(?!.*''')", r"(?:[^'\\]|\\.|'(?!''))*'''", "s"), "N": (r"\\$", r"\n[ \t\f]*", "")}, lines=r"\n[ \t\f]*", indent=True,
)
GO = dict(
    tokens=[r"//[^\n]*", BLOCK, r"/\*[\s\S]*", r"`[^`]*`", r"`[\s\S]*", DQ, r"'(?:[^'\\\n]|\\[^\n]{1,10}?)'", OPEN],
    ops="+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! != <= >= := ... ( ) [ ] { } , ; . : ~",
    keywords={**words("package", "G"), **words("import", "N"), **words("func", "F"), **words("type var const", "K"), **words("return", "r"), **words("else", "e"), **words("if for switch select case default break continue go goto defer range struct interface map chan fallthrough", "k")},
    states={**C_COMMENT, "R": (r"`(?!.*`)", r"[^`]*`", "s")}, lines=r"\n",
)
JAVA = dict(
    tokens=[r"//[^\n]*", BLOCK, r"/\*[\s\S]*", r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""', r'"""[\s\S]*', r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\[^\n]{1,8}?)'", OPEN],
    ops="+ - * / % ++ -- == != <= >= < > && || ! ~ & | ^ << += -= *= /= %= &= |= ^= <<= >>= = -> :: ... ( ) [ ] { } , ; . : ? @",
    keywords={**words("package", "G"), **words("import", "N"), **words("class interface enum record", "c"), **words("return throw", "r"), **words("else", "e"), **words("if while switch for synchronized catch", "I"),
              **words("public private protected static final abstract native transient volatile strictfp default sealed non permits extends implements throws new instanceof case break continue do try finally assert yield super this var when", "k")},
    states={**C_COMMENT, "D": (r'"""(?!.*""")', r'(?:[^"\\]|\\.|"(?!""))*"""', "s")}, name=DOLLAR_NAME,
)
RUST_BLOCK = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/"
RUST = dict(
    tokens=[r"//[^\n]*", RUST_BLOCK, r"/\*[\s\S]*", r'b?r##"[\s\S]*?"##', r'b?r#"[\s\S]*?"#', r'b?r"[^"]*"', r'b?r##"[\s\S]*', r'b?r#"[\s\S]*', r'b?r"[\s\S]*', r'[bc]?"(?:[^"\\]|\\[\s\S])*"', r'[bc]?"[\s\S]*', r"b?'(?:[^'\\\n]|\\[^\n]{1,10}?)'", r"'[A-Za-z_]\w*", r"r#[A-Za-z_]\w*"],
    ops="+ - * / % ^ ! & | && || << += -= *= /= %= ^= &= |= <<= >>= = == != > < >= <= @ . .. ... ..= , ; : :: -> => # $ ? ~ ( ) [ ] { }",
    keywords={**words("mod use fn struct enum impl trait const static type extern unsafe pub macro_rules", "K"), **words("let", "L"), **words("return", "r"), **words("else", "e"), **words("as async await break continue crate dyn for if in loop match move mut ref self Self super where while union auto default raw yield box", "k")},
    states={"C": (r"/\*(?!.*\*/$)", r".*?\*/", ""), "H": (r'b?r##"(?!.*"##)', r'.*?"##', "s"), "h": (r'b?r#"(?!.*"#)', r'.*?"#', "s"), "w": (r'b?r"(?!.*")', r'[^"]*"', "s"), "Q": (r'[bc]?"(?!(?:[^"\\]|\\.)*"$)', r'(?:[^"\\]|\\.)*"', "s")},
)
ELSE = r"(?m:^[ \t]*#[ \t]*(?:else|elif)\b)[\s\S]*?(?m:^[ \t]*#[ \t]*endif[^\n]*)"
C = dict(
    tokens=[r"//[^\n]*", BLOCK, r"/\*[\s\S]*", r"\\\r?\n", ELSE, r"(?m:^[ \t]*#[ \t]*(?:else|elif)\b)[\s\S]*", r"(?m:^[ \t]*#[ \t]*(?:if|ifdef|ifndef|endif|define|include|undef|pragma|error|warning|line|import)\b)(?:[^\n\\]|\\[\s\S])*", r'(?:u8|[uUL])?"(?:[^"\\\n]|\\[\s\S])*"', r"[uUL]?'(?:[^'\\\n]|\\[^\n])+'", OPEN],
    ops="+ - * / % ++ -- == != <= >= < > && || ! ~ & | ^ << >> += -= *= /= %= &= |= ^= <<= >>= = -> ... ( ) [ ] { } , ; . : ? ::",
    keywords={**words("if while switch for", "I"), **words("return", "r"), **words("else", "e"), **words("auto break case char const continue default do double enum extern float goto inline int long register restrict short signed sizeof static struct typedef union unsigned void volatile _Bool _Atomic _Static_assert _Noreturn _Alignas _Thread_local bool size_t", "k")},
    states={**C_COMMENT, "E": (r"\s*#[ \t]*(?:else|elif)(?!.*\n[ \t]*#[ \t]*endif)", r"(?:|.*?\n)[ \t]*#[ \t]*endif[^\n]*", "J"), "N": (r"\\$", r"(?:[^\n\\]|\\.)*(?=\n|$)", "")},
)
D_INNER = r"""\$\{(?:[^{}\n]|\{[^{}\n]*\})*\}"""
DART = dict(
    tokens=[r"//[^\n]*", BLOCK, r"/\*[\s\S]*", r'r?"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""', r"r?'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''", r'r?"""[\s\S]*', r"r?'''[\s\S]*", r'r"[^"\n]*"', r"r'[^'\n]*'", rf'"(?:[^"\\\n$]|\\.|\$(?!\{{)|{D_INNER})*"', rf"'(?:[^'\\\n$]|\\.|\$(?!\{{)|{D_INNER})*'", r"r?" + OPEN],
    ops="+ - * / ~/ % ++ -- == != <= >= < > && || ! ~ & | ^ << += -= *= /= ~/= %= &= |= ^= <<= >>= = ?? ??= => .. ... ...? ?. ( ) [ ] { } , ; . : ? @ #",
    keywords={**words("import library part", "N"), **words("class mixin extension enum", "c"), **words("return throw rethrow", "r"), **words("else", "e"), **words("if while switch for catch", "I"),
              **words("abstract as assert async await base break case const continue covariant default deferred do dynamic export extends external factory final finally get hide implements in interface is late native new null on operator required sealed set show static super sync this try typedef var void when with yield of Function", "k")},
    states={**C_COMMENT, "D": (r'r?"""(?!.*""")', r'(?:[^"\\]|\\.|"(?!""))*"""', "s"), "S": (r"r?'''(?!.*''')", r"(?:[^'\\]|\\.|'(?!''))*'''", "s")}, name=DOLLAR_NAME,
)


class CLexer(Lexer):
    def special(self, x: str) -> str:
        y = x.lstrip(" \t")
        if y[:1] == "#":
            word = y[1:].lstrip()
            return "J" if "endif" in x else "" if word[:2] == "el" else "G" if word[:2] == "if" else "h" if word[:1].isalpha() else "X"
        return super().special(x)


class PythonLexer(Lexer):
    def special(self, x: str) -> str:
        if x[0] == "#" or x[0] == "\\" and x[-1:] == "\n":
            return ""
        body = x.lstrip("rRbBuUfF")
        if body[:1] in ("'", '"'):
            return "s" if len(body) > 1 and body[-1] == body[0] else "U"
        return super().special(x)


class RustLexer(Lexer):
    def special(self, x: str) -> str:
        if x[0] == "'" and (len(x) < 3 or x[-1] != "'") and x[1:2].isidentifier():
            return "k"
        if x[:2] == "r#" and x[2:3].isidentifier():
            return "i"
        if x[-1] in "\"'#" and x[0] in "brc\"'":
            return "s" if len(x) > 1 else "U"
        return super().special(x)


LEXERS: dict[str, Lexer] = {
    "ts": Script(**SCRIPT), "js": Script(**SCRIPT), "py": PythonLexer(**PYTHON), "go": Lexer(**GO), "java": Lexer(**JAVA), "rs": RustLexer(**RUST), "c": CLexer(**C), "dart": Lexer(**DART),
}

PAIRS = re.compile(r"\(\)|\[\]|\{\}")
NOT_BRACKETS = re.compile(r"[^()\[\]{}]+")


def brackets(classes: str) -> str:
    """What is left of the brackets of a piece once pairs are taken out: closers, then openers, or a mismatch among them."""
    s = NOT_BRACKETS.sub("", classes)
    while True:
        t = PAIRS.sub("", s)
        if t == s:
            return s
        s = t


def joined(a: str, b: str) -> str:
    """The bracket summary of two neighbouring pieces; associative."""
    return brackets(a + b) if a and b else a or b
