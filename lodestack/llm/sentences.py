"""Sentence units of one text: its blocks and lines, the words that statistics are learned from, and the places where units end."""

from __future__ import annotations

import re
from collections import ChainMap, Counter

LINE = re.compile(r"([^\r\n]*)(\r\n|\n|\r|$)")
FENCE = re.compile(r"[ \t]*(?:>[ \t]?)*(```|~~~)")
HEADING = re.compile(r"[ \t]*#{1,6}[ \t]+\S")
ITEM = re.compile(r"[ \t]*(?:[-*+•‣–][ \t]+|\(?\d{1,3}[.)][ \t]+|\(?[a-z]\)[ \t]+)(?=\S)")
QUOTE = re.compile(r"[ \t]*(?:>[ \t]?)+")
NOTE = re.compile(r"[ \t]*(?://+|#+|--|;|%|/?\*+)[ \t]+(?=\S)|[ \t]*\*+/[ \t]*$|[ \t]*/\*+[ \t]*")
#: How reference lines and subject lines begin.
REFERENCE = re.compile(r"(?i)[ \t]*(?:refs?|references?|see also|fix(?:es|ed)?|close[sd]?|resolve[sd]?|related(?: to)?|issue|change-id|cc|(?:signed-off|co-authored|reviewed|acked|tested|reported|suggested)-by|subject|betreff|objet|asunto|tema|件名|主题|тема)[ \t]?[:：]")
SUBJECT = re.compile(r"[a-z]+(?:\([^)\n]*\))?!?: \S")
RULE = re.compile(r"[ \t]*(?:[-*_=][ \t]*){3,}$|[ \t]*\|.*\|[ \t]*$")
MARK = "\u0300-\u036f\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962\u0963\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"  # signs that go with the letter before
TOKEN = re.compile(rf"`[^`\n]*`|https?://[^\s<>\"]+|[A-Za-z0-9_][\w/-]*(?:\.[A-Za-z]\w*)*\.(?:js|ts|py|go|rs|dart|java|c|json|md|toml|ya?ml)\b|(?:[^\W\d_]\.)+[^\W\d_](?=\.)|\d+(?:[.,:]\d+)*|[^\W\d](?:[\w{MARK}]|['’-](?=\w))*|\S")
INITIALS = re.compile(rf"(?:[^\W\d_]\.)+[^\W\d_]|(?:[^\W\d_A-Za-z][{MARK}]*){{1,3}}(?:\.(?:[^\W\d_A-Za-z][{MARK}]*){{1,3}})+")
MARKED = re.compile(r"[a-z]+[A-Z]|_|\(\)$|^`|/|^[A-Za-z0-9_][\w/-]*\.[a-z]{1,4}$")
OPENERS = "\"'“”„‘’«»‹›「『（([{<*_`¿¡—–-"
TERMINAL = ".!?…。！？｡．।॥؟‼⁇⁈⁉"
HARD = "。！？｡।॥؟"
CLOSERS = "\"'”’“»›」』）)]}*_"
PAIRS = [("“", "”"), ("„", "“"), ("„", "”"), ("«", "»"), ("‹", "›"), ("「", "」"), ("『", "』"), ("（", "）"), ("(", ")"), ("[", "]"), ("‘", "’")]
PROTECTED = re.compile(
    r"`[^`]*`|https?://[^\s<>\"“”«»]+|\"(?=\S)[^\"]+?(?<=\S)\"(?!\w)|(?<![\w’'])'(?=[^\s'])[^'\n]+?'(?!\w)|"
    + "|".join(rf"{re.escape(a)}[^{re.escape(a)}{re.escape(b)}]+{re.escape(b)}" for a, b in PAIRS)
)
ENDING = re.compile(r"[.!?…。！？｡．।॥؟;‼⁇⁈⁉]+")
THAI = re.compile(r"[฀-๿]")
CASELESS = re.compile(r"[฀-๿぀-ヿ一-鿿가-힣ऀ-ॿ؀-ۿ]")


OTHER_SCRIPTS = {"ja", "zh", "ko", "ru", "hi", "ar", "th", "el"}


class Flow:
    """Lines that run on: their text with markers and breaks as blanks, and the place of each character in the whole text."""

    __slots__ = ("text", "at", "starts")

    def __init__(self):
        self.text, self.at, self.starts = "", [], {}

    def add(self, content: str, at: int, marker: int) -> None:
        if self.text:
            self.text += " "
            self.at.append(at)
        self.starts[len(self.text)] = marker
        self.text += content
        self.at.extend(range(at, at + len(content)))


def _kind(token: str) -> str:
    if not token:
        return ""
    if token[0].isdigit():
        return "<n>"
    if len(token) > 1 and MARKED.search(token) and not INITIALS.fullmatch(token):
        return "<id>"
    return token.lower()


class Kinds(dict):
    """kind and form of each token, worked out once while there is room."""

    def __missing__(self, token: str) -> tuple[str, str]:
        x = _kind(token)
        found = x, "^" + x if token and token[0].isupper() and x[0] != "<" else x
        if len(self) > 200_000:
            self.clear()
        if len(token) < 40:
            self[token] = found
        return found


KINDS = Kinds()


def kind_of(token: str) -> str:
    """A token's type: names of code and numbers are one type each, other words count in lower case."""
    return KINDS[token][0]


def form_of(token: str) -> str:
    """As ``kind_of``, with a mark for words that begin with a capital."""
    return KINDS[token][1]


BLANKS, LEAD = re.compile(r"\s*"), re.compile(rf"[{re.escape(OPENERS.replace('`', ''))} \t\xa0]*")
#: What words never reach over, in scripts without blanks.
EDGE = set("。！？，、；：「」『』（）【】…｡．।॥")


def first_word(text: str, at: int = 0) -> str:
    m = TOKEN.match(text, LEAD.match(text, BLANKS.match(text, at).end()).end())
    return m[0] if m else ""


def last_word(text: str, end: int | None = None) -> str:
    """The last word before ``end``."""
    end = len(text) if end is None else end
    while end and text[end - 1] in " \t\xa0*_\"'”’»)]":
        end -= 1
    start = end
    while start and not text[start - 1].isspace() and (text[start - 1] not in EDGE or start == end):
        start -= 1
    tick = text.rfind("`", 0, start)
    if tick >= 0 and "`" in text[start:end] and text.count("`", start, end) % 2:  # a name in backticks with blanks in it
        start = tick
    m = None
    for m in TOKEN.finditer(text, start, end):
        pass
    return m[0] if m else ""


BEFORE = re.compile(rf"(?<![\w.])(?:(?:[^\W\d_]\.[ \u00a0]?)+[^\W\d_]|(?:{INITIALS.pattern}))$")


def word_before(t: str, a: int) -> str:
    """The word before the period at a; initials and the like with their inner periods."""
    if t[a - 1 : a].isalpha() and "." in t[max(0, a - 5) : a] or not t[a - 1 : a].isascii():
        m = BEFORE.search(t, max(0, a - 24), a)
        if m:
            return m[0].replace(" ", "").replace("\u00a0", "")
    return last_word(t, a)


def blocks(text: str, model=None, lang: str = "") -> list:
    """Units that layout alone gives, as (start, end), and flows of running text, in order. ``model`` tells whether a line goes on."""
    lines, at = [], 0
    for m in LINE.finditer(text):
        if m.start() == len(text) and m.start() == m.end() and lines and not m[0]:
            break
        lines.append((m.start(), m[1]))
        if not m[2]:
            break
    out: list = []
    flow: Flow | None = None
    before, mode, i = "", "", 0
    hang: tuple[int, int] | None = None
    while i < len(lines):
        start, line = lines[i]
        stripped = line.strip()
        if not stripped:
            if hang:
                out.append(hang)
            hang, flow, before = None, None, ""
            i += 1
            continue
        lead = start + len(line) - len(line.lstrip())
        end = start + len(line.rstrip())
        f = FENCE.match(line)
        if hang and f:
            out.append(hang)
            hang = None
        if f:
            j = i + 1
            while j < len(lines) and not (FENCE.match(lines[j][1]) and FENCE.match(lines[j][1])[1] == f[1] and not lines[j][1].strip().lstrip("> ").strip("`~")):
                j += 1
            j = min(j, len(lines) - 1)
            last = lines[j]
            while not last[1].strip():
                j -= 1
                last = lines[j]
            out.append((lead, last[0] + len(last[1].rstrip())))
            flow, before = None, ""
            i = j + 1
            continue
        near = [lines[k][1] for k in (i - 1, i + 1) if 0 <= k < len(lines)]
        hashed = re.match(r"[ \t]*#[ \t]", line) and any(re.match(r"[ \t]*#[ \t]+\S", x) for x in near)
        if HEADING.match(line) and not hashed or RULE.match(line) or REFERENCE.match(line) or i == 0 and SUBJECT.match(line):
            if hang:
                out.append(hang)
                hang = None
            out.append((lead, end))
            flow, before = None, ""
            i += 1
            continue
        quote = QUOTE.match(line)
        note = None if quote else NOTE.match(line) if hashed or re.match(r"[ \t]*(?://|--[ \t]|/\*)", line) or mode == "note*" and re.match(r"[ \t]*\*", line) else None
        item = None if note else ITEM.match(line, quote.end() if quote else 0)
        if item and flow is not None and model is not None and mode == "*" and re.match(r"[ \t]*\*[ \t]", line) and len(before) > 30 and before[-1] not in TERMINAL:
            rest = line[item.end() :]
            if (rest[0].islower() or rest[0].isdigit()) and model.start(first_word(rest), lang) <= 0:  # a comment's stars, not items
                flow.add(rest.rstrip(), start + item.end(), lead)
                before = rest.rstrip()
                i += 1
                continue
        marker = item or note or quote
        kind = "quote" if quote else "note*" if note and ("/*" in line or mode == "note*") else "note" if note else ""
        body_at = marker.end() if marker else len(line) - len(line.lstrip())
        body_at += len(line[body_at:]) - len(line[body_at:].lstrip())
        content = line[body_at:].rstrip()
        if not content:  # a marker alone ends what runs, and belongs to what follows
            if hang:
                out.append(hang)
            hang, flow, before = (lead, end), None, ""
            i += 1
            continue
        goes_on = flow is not None and not item and (kind == mode or not kind and mode in ("", "*")) and (model is None or model.goes_on(before, content, lang))
        if not goes_on:
            flow = Flow()
            out.append(flow)
        flow.add(content, start + body_at, hang[0] if hang else lead)
        hang = None
        before, mode = content, "*" if item and line.lstrip()[0] == "*" else kind
        i += 1
    if hang:
        out.append(hang)
    return out


SPACED = re.compile(rf"({TOKEN.pattern})(\s*)")


def wordy(token: str) -> bool:
    return token[0].isalnum() or token[0] == "`" or not token.isascii() and CASELESS.match(token) is not None


def count(out: Counter, words: dict[str, int]) -> None:
    """Adds words by kind, and by form where that differs."""
    for w, n in words.items():
        x, y = KINDS[w]
        out["w", x, ""] = out.get(("w", x, ""), 0) + n
        if y != x:
            out["w", y, ""] = out.get(("w", y, ""), 0) + n


def events(text: str, lang: str) -> Counter:
    """What one text tells: (kind, a, b) with counts. w: word a; s: word a begins a line of its own; e: word a ends one;
    p: word a stands before a period and b after it."""
    out: Counter = Counter()
    for block in blocks(text):
        if isinstance(block, tuple):
            continue
        t = block.text
        if THAI.search(t):
            count(out, Counter(t.split()))
        else:
            toks = SPACED.findall(t)
            seen = Counter([x for x, _ in toks])
            count(out, {x: n for x, n in seen.items() if wordy(x)})
            for k in [k for k, (x, _) in enumerate(toks) if x == "."] if "." in seen else ():
                before, gap = toks[k - 1] if k else ("", " ")
                if gap or not wordy(before):
                    continue
                gap = toks[k][1]
                if (gap or (toks[k + 1][0] if k + 1 < len(toks) else " "))[0] in "._" + CLOSERS:
                    continue
                j = k + 1
                while j < len(toks) and not wordy(toks[j][0]):
                    gap += toks[j][0] + toks[j][1]
                    j += 1
                nxt = "¶" if j == len(toks) and not gap.strip() else ","
                if j < len(toks):
                    if not gap:
                        continue
                    nxt = "," if gap.strip(OPENERS + " \t\xa0") else kind_of(toks[j][0])
                    if nxt not in (",", "<n>", "<id>") and toks[j][0][0].isupper():
                        nxt = "^" + nxt
                out["p", kind_of(before), nxt] += 1
        lead = first_word(t)
        if lead:
            out["s", form_of(lead) if not THAI.search(lead) else re.match(r"\S+", t)[0], ""] += 1
        tail = last_word(t.rstrip(TERMINAL + CLOSERS + " "))
        if THAI.search(t):
            tail = t.split()[-1]
        if tail:
            out["e", kind_of(tail) if not THAI.search(tail) else tail, ""] += 1
    return out


class Either:
    """Whether one of two sets has something."""

    def __init__(self, one, other):
        self.one, self.other = one, other

    def __contains__(self, x: object) -> bool:
        return x in self.one or x in self.other


def forms_in(text: str) -> set[str]:
    """The kinds and forms of all words of a text, under which a model may know them."""
    found = {y for x in {*TOKEN.findall(text)} for y in KINDS[x]}
    return found | {y for x in set(text.split()) for y in (x, *KINDS[x])} if THAI.search(text) else found


class Model:
    """Learned statistics of all languages: starts[lang][word] and ends[lang][word] between -1 (never) and 1 (often); short[lang]: abbreviations; pairs[lang]: an abbreviation with the word that follows it as a rule."""

    def __init__(self, starts: dict, ends: dict, short: dict, pairs: dict):
        self.starts, self.ends, self.short, self.pairs = starts, ends, short, pairs

    def with_rows(self, more: dict[str, dict]) -> Model:
        """This model and the rows of a text's rare words, without copying it."""
        def joined(a: dict, b: dict) -> dict:
            return {**a, **{lang: ChainMap(x, a.get(lang, {})) if isinstance(x, dict) else Either(x, a.get(lang, ())) for lang, x in b.items()}}

        return Model(*(joined(getattr(self, k), more[k]) for k in ("starts", "ends", "short", "pairs")))

    def start(self, word: str, lang: str) -> float:
        """How far a word begins sentences."""
        if not word:
            return 0.0
        return self.starts.get(self.of(word, lang), {}).get(form_of(word), 0.0)

    def end(self, word: str, lang: str) -> float:
        return self.ends.get(self.of(word, lang), {}).get(kind_of(word), 0.0)

    @staticmethod
    def of(word: str, lang: str) -> str:
        """Latin words among those of another script count as English."""
        return "en" if lang in OTHER_SCRIPTS and word.isascii() and word[:1].isalpha() else lang

    def abbreviation(self, word: str, lang: str) -> bool:
        x, lang = kind_of(word), self.of(word, lang)
        return x in self.short.get(lang, ()) or len(word) == 1 and word.isupper() or bool(INITIALS.fullmatch(word))

    def goes_on(self, before: str, content: str, lang: str) -> bool:
        """Whether a line goes on in the next one, in the same block."""
        b = before.rstrip()
        core = b.rstrip(CLOSERS + " ")
        if core and core[-1] in TERMINAL:
            return True  # the flow's own rules tell
        if core and core[-1] in ";,:-–—(/&" or content[0] in TERMINAL:
            return True
        w = first_word(content)
        if not w:
            return True
        s, e = self.start(w, lang), self.end(last_word(b), lang)
        marked = kind_of(w) == "<id>"
        if CASELESS.match(w[0]):
            return e < 0 or s < 0 < 1 and e <= 0
        if marked or content[0] in "`":
            return e < 0 or (e <= 0 and len(b) > 60)
        if w[0].islower() and not re.match(r"v\d", w):
            return not (s > 0 and e >= 0)
        if w[0].isdigit() or w[0].islower():
            return e < 0 or len(b) > 55 and e <= 0
        if s > 0:
            return e < 0 and len(b) + len(w) > 66  # shorter lines are not wrapped
        if s < 0:
            return True
        return e < 0 or e == 0 and len(b) > 60


def cuts(flow: Flow, model: Model, lang: str) -> list[int]:
    """Places in a flow after which a new unit begins."""
    t = flow.text
    if lang == "th" or not t.isascii() and len(THAI.findall(t)) > 0.3 * len(t.replace(" ", "")):
        return thai(t, model)
    guarded = [(m.start(), m.end()) for m in PROTECTED.finditer(t)]
    out: list[int] = []
    begin, g = 0, 0
    i = 0
    spans = iter(guarded)
    span = next(spans, None)

    def unit_start() -> int:
        return out[-1] if out else 0

    def decide(a: int, b: int, inner: bool) -> None:
        """A run of marks t[a:b] and what closes after it; inner: it stands at the end of a protected span that ended at b."""
        marks = ENDING.match(t, a)[0] if not inner else ENDING.search(t[a:b])[0]
        e = b
        while e < len(t) and t[e] in CLOSERS and not (t[e] in "*_\"'" and (e + 1 < len(t) and t[e + 1].isalnum())):
            e += 1
        f = BLANKS.match(t, e).end()
        if f == len(t):
            return
        blank = f - e
        w = first_word(t, f)
        plain = t[f]
        s = model.start(w, lang)
        caseless = bool(CASELESS.match(w[:1] or plain))
        upper = bool(w) and w[0].isupper()
        marked = bool(w) and (kind_of(w) == "<id>" or bool(re.match(r"v\d", w))) or plain == "`"
        lower = bool(w) and w[0].islower() and not marked
        opener = plain in "\"“„«‘¿¡「『(（[" or plain in "-*>" and False
        if inner:
            head = t[unit_start() :].lstrip()
            whole = t[a] in "(（[" and t[unit_start() : a].strip(" *_") == ""
            if any(c in HARD for c in marks) and t[e - 1 : e] in "」』”）»)" and caseless:
                if whole and blank:
                    out.append(e)
                return
            if not blank and not whole:
                return
            if t[a] in "(（[" and not whole:
                # a remark inside a sentence ends nothing, unless the sentence had ended before it
                return
            if whole or upper and s >= 0 or marked and s >= 0 and t[a] not in "(" or opener or lower and s > 0 and t[a] not in "(":
                out.append(e)
            return
        if marks[0] == ";":
            if lang == "el" and (blank or e > b) and not lower:
                out.append(e)
            return
        if any(c in HARD for c in marks):
            out.append(e)
            return
        dots = marks.startswith("...") or "…" in marks
        if dots and not any(c in "?!" for c in marks):
            if blank and (upper and s > 0 or opener and not caseless or upper and s == 0 and not caseless):
                out.append(e)
            return
        if any(c in "?!？！" for c in marks):
            if blank or e > b:
                if not lower or s > 0:
                    out.append(e)
            elif caseless or upper or opener or marked:
                out.append(e)
            return
        # a period
        prev = word_before(t, a)
        pk = kind_of(prev) if prev else ""
        if not blank:
            if e == b and (upper or opener or plain == "`") and prev and (len(prev) > 1 or pk == "<n>") and not model.abbreviation(prev, lang) and (s > 0 or (s == 0 and (pk in ("<id>", "<n>") or t[a - 1] in ")]\"”»`") and upper) or opener or plain == "`"):
                out.append(e)
            elif e == b and upper and s > 0 and len(prev) > 2 and pk[0] != "<":
                out.append(e)
            elif e == b and lower and s > 0 and len(w) > 2 and len(prev) > 3 and pk != "<id>" and not model.abbreviation(prev, lang):
                out.append(e)
            elif e > b and (upper or opener or caseless):
                out.append(e)
            elif re.match(r"[぀-ヿ一-鿿]", w[:1]):
                out.append(e)
            return
        if pk == "<n>" and not re.search(r"\d[.,:]\d", prev) and t[a - 1].isdigit():
            if re.search(r"\d{1,2}\.\d{1,2}$", t[max(0, a - 6) : a]) and not (upper and s > 0):
                return
            if lower and s <= 0 or w[:1].isdigit():
                return
            if upper and s < 0 or upper and s == 0 and lang == "de":
                return
            out.append(e)
            return
        if pk == "<n>" and lower and s <= 0 or caseless and s < 0 and model.end(prev, lang) < 0:
            return
        if prev and (pk, form_of(w) if w else "") in model.pairs.get(model.of(prev, lang), ()):
            return
        if prev and t[a - 1] not in "\"”»)]`" and model.abbreviation(prev, lang):
            if upper and s > 0 and not (len(prev) == 1 and prev.isupper() and len(w) == 1):
                out.append(e)
            elif opener and upper and s > 0:
                out.append(e)
            elif marked and model.end(prev, lang) > 0:
                out.append(e)
            return
        if lower and s < 0 and len(prev) < 5:
            return
        if lower and s < 0 and model.end(prev, lang) <= 0:
            return
        out.append(e)

    while i < len(t):
        while span and span[1] <= i:
            span = next(spans, None)
        if span and span[0] <= i < span[1]:
            a, b = span
            inside = t[a + 1 : b - 1].rstrip("   " + CLOSERS)
            if t[a] not in "`h" and inside and inside[-1] in TERMINAL and not (t[b : b + 1] in ".!?。！？"):
                decide(a, b, True)
            i = b
            continue
        m = ENDING.search(t, i, span[0] if span else len(t))
        if m:
            i = m.start()
            if span:
                m = ENDING.match(t, i)
            if not (m[0] == ";" and lang != "el") and not (m[0] == "." and t[i - 1 : i].isdigit() and t[i + 1 : i + 2].isdigit()) and not (m[0][0] == "." and len(m[0]) == 2):
                decide(i, m.end(), False)
            i = max(m.end(), out[-1] if out else 0)
        else:
            i = span[0] if span else len(t)
    return out


def thai(t: str, model: Model) -> list[int]:
    """Where spaces end sentences: between a word that ends lines and one that begins them."""
    starts, ends = model.starts.get("th", {}), model.ends.get("th", {})
    out = []
    toks = list(re.finditer(r"\S+", t))
    for x, y in zip(toks, toks[1:]):
        a, b = x[0], y[0]
        if a[-1] in TERMINAL and len(a) > 1:
            out.append(x.end())
            continue
        s = starts.get(b if THAI.search(b) else kind_of(b), 0)
        e = ends.get(a if THAI.search(a) else kind_of(a), 0)
        if s > 0 and e > 0 or s > 0 and e == 0 and THAI.search(b) and THAI.search(a):
            out.append(x.end())
    return out


def units(text: str, model: Model, lang: str, tell=None) -> list[tuple[int, int]]:
    """(start, end) of every unit of a text; ``tell`` gives the language of a flow, else the text's."""
    out: list[tuple[int, int]] = []
    for block in blocks(text, model, lang):
        if isinstance(block, tuple):
            out.append(block)
            continue
        own = tell(block.text) if tell else None
        places = cuts(block, model, own or lang)
        start = 0
        for c in [*places, len(block.text)]:
            piece = block.text[start:c]
            lead = len(piece) - len(piece.lstrip())
            core = piece.strip()
            if core:
                a = start + lead
                first = block.starts.get(a, block.at[a])
                out.append((first, block.at[a + len(core) - 1] + 1))
            start = c
    return out
