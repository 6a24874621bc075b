"""Rules on one answer and its prompt: what is prose in it, in which language, whether it ends, refuses or copies."""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np

#: Frequent short words that tell languages in Latin script apart.
STOPWORDS = {
    "en": "the and is are was were of to in that it this for with on not be by at from or as an we you our but has have no does do did should first so if its their which what why when after before then both every one".split(),
    "de": "der die das und ist sind war nicht ein eine einen im in zu mit auf für von den dem des es wird werden bei nach oder auch sich als aus wir aber noch nur wenn falls dass keine kein hier vom zum zur über unter seit bitte rund".split(),
    "fr": "le la les et est sont une un des du de dans pas ne que qui pour sur avec par au aux ce cette nous vous il elle mais ou se en à après avant quand sans où être fait aucun son sa ses deux fois reste depuis selon".split(),
    "es": "el la los las y es son una un de del en no que por para con se al lo su sus como más pero o hay este esta está tras cuando sin si nos desde quedan ningún aquí dos veces qué así".split(),
    "pt": "o a os as e é são uma um do da dos das em no na não que por para com se ao ou seu sua mais mas como está esta este isso foi há sem quando após nos pelo pela".split(),
    "it": "il lo la gli le e è sono una un di del della dei in non che per con si al alla o suo sua più ma come questo questa ha senza quando dopo dal nel nella anche".split(),
}
WEIGHTS: dict[str, dict[str, float]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words:
        WEIGHTS.setdefault(_w, {})[_lang] = 1.0
for _w, _by in WEIGHTS.items():
    for _lang in _by:
        _by[_lang] = 1.0 / len(_by)
MARKS = {"de": set("äöüß"), "fr": set("àâçèêëîïôœùû"), "es": set("ñ¿¡"), "pt": set("ãõ")}
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
SCRIPTS = [("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힣]")), ("zh", re.compile(r"[一-鿿]")), ("ru", re.compile(r"[Ѐ-ӿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("th", re.compile(r"[฀-๿]")), ("el", re.compile(r"[Ͱ-Ͽ]"))]
#: How prompts name the language of the answer.
ASKED = {
    "en": "english englisch anglais inglés ingles 英文 英语 英語 영어", "de": "german deutsch allemand alemán aleman 德文 德语 ドイツ語", "fr": "french französisch français francés 法文 法语 フランス語", "es": "spanish spanisch espagnol español 西班牙文 西班牙语 スペイン語",
    "zh": "chinese chinesisch chinois chino 中文 中国語 汉语", "ja": "japanese japanisch japonais japonés 日文 日语 日本語", "ko": "korean koreanisch coréen coreano 韩文 韩语 韓国語", "pt": "portuguese portugiesisch portugais portugués 葡萄牙文", "ru": "russian russisch russe ruso 俄文 俄语 ロシア語", "it": "italian italienisch italien italiano",
}
ASKED_WORDS = {w: lang for lang, ws in ASKED.items() for w in ws.split()}
ASKS = re.compile(r"(?i)(?:answer|write|reply|respond|antwort\w*|schreib\w*|répond\w*|écri\w*|rédige\w*|respond[ea]\w*|escrib\w*|redacta\w*)[^\n.]{0,40}?\b(?:in|auf|en)\s+(?P<a>[a-zà-ÿ]+)\b|(?:请用|用)(?P<b>英文|英语|德文|德语|法文|法语|西班牙文|西班牙语|中文|日文|日语|韩文|韩语)|(?P<c>英語|ドイツ語|フランス語|スペイン語|中国語|日本語|韓国語)で")

FENCE = re.compile(r"(?m)^[ \t]*(?:```|~~~)[^\n]*\n?[\s\S]*?^[ \t]*(?:```|~~~)[ \t]*$")
CODE = re.compile(r"`[^`\n]*`|https?://\S+|(?<![\w])[\w./-]*\w\.(?:ts|js|py|go|rs|dart|java|c|json|toml|md|ya?ml)\b|\b\w+\(\)?|\b[a-z]+(?:[A-Z]\w*)+\b|\b\w+_\w+\b")
HTML = re.compile(r"<!--[\s\S]*?(?:-->|$)|</?[a-zA-Z][^>\n]*>")
MARKUP = re.compile(r"[\s​-‏⁠﻿ ­#*_`~>|+=\-–—.,:;!?…•·。、，()\[\]{}\"'«»„“”]+")
#: Words that stand in for an answer.
FILLERS = re.compile(r"(?i)^(?:n/?a|null|none|nil|undefined|empty|leer|vide|vacío|tbd|todo|placeholder|response|answer|antwort|réponse|respuesta|json|text|markdown|md|summary|severity|issues|error|low|medium|high|info)?$")
CLOSERS = "\"'”’»）)]}】」』*_`　 \t\r\n"
ENDS = ".!?。！？…؟।"


def values(x: object) -> list[str]:
    """All texts of a JSON value but not its keys; severities and the like are no content."""
    if isinstance(x, dict):
        return [t for k, v in x.items() if k not in ("severity", "category", "file", "line") for t in values(v)]
    if isinstance(x, list):
        return [t for v in x for t in values(v)]
    return [x] if isinstance(x, str) else []


JSON_START = re.compile(r"(?m)^[ \t]*(?:```(?:json)?[ \t]*\n\s*)?(?=[{\[]\s*(?:[\"{\[\]}]|$))", re.I)
BLOCK = re.compile(r"(?m)^[ \t]*(```|~~~)[^\n]*(?:\n[\s\S]*?(?:^[ \t]*\1[ \t]*$|\Z)|\Z)")


def json_start(s: str) -> re.Match | None:
    """Where an answer's JSON begins: at the start of a line, wherever, but not inside a block of other code."""
    blocks, block = BLOCK.finditer(s), None
    for m in JSON_START.finditer(s):
        while block is None or block and block.end() <= m.start():
            block = next(blocks, False)
        if not block or m.start() <= block.start():
            return m
    return None


def body_of(text: str) -> tuple[str, object | None, bool]:
    """(kind, JSON value, unclosed): kind is json if the answer, after any opening words, is JSON, else text."""
    s = text.strip()
    m = json_start(s)
    if not m:
        return "text", None, False
    body = s[m.end() :]
    depth, string, escape, end = 0, False, False, None
    for q in re.finditer(r'\\.|["{}\[\]]', body, re.S):
        c = q[0]
        if string:
            string = c != '"'
        elif c == '"':
            string = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth <= 0:
                end = q.end()
                break
    if end is None:
        return "json", None, True
    try:
        value = json.loads(body[:end], strict=False)
    except ValueError:
        value = [x for x in re.findall(r'"((?:[^"\\]|\\.)*)"', body[:end])]
    fenced = s[m.start() : m.end()].lstrip().startswith("```")
    return "json", value, fenced and "```" not in body[end:]


def prose(text: str) -> str:
    """The words of an answer without code, names, links and markup."""
    kind, value, _ = body_of(text)
    if kind == "json":
        if value is None:
            t = "\n".join(re.findall(r'"(?:summary|comment|suggestion|error|message|title|text)"\s*:\s*"((?:[^"\\]|\\.)*)', text))
            t = t.encode("utf-8", "replace").decode("unicode_escape", "replace").encode("latin-1", "replace").decode("utf-8", "replace") if "\\u" in t else t
        else:
            t = text[: re.search(r"[{\[]", text).start()] + "\n" + "\n".join(values(value))
    else:
        t = text
    t = FENCE.sub("\n", t)
    t = re.sub(r"(?m)^[ \t]*```[\s\S]*\Z", "\n", t)
    return CODE.sub(" ", HTML.sub(" ", t))


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    kind, value, unclosed = body_of(text)
    if kind == "json" and not unclosed:
        before = text[: re.search(r"[{\[]", text).start()]
        rest = before + " ".join(values(value))
        if isinstance(value, (dict, list)) and re.search(r'"(?:file|line)"', text):
            return False
    else:
        if re.search(r"(?m)^```[^\n]*\n\s*\S[\s\S]*^```", text) and not re.search(r"(?m)^```[^\n]*\n\s*```", text):
            return False
        rest = re.sub(r"(?m)^[ \t]*```.*$", " ", HTML.sub(" ", text))
        lines = [x for x in rest.split("\n") if x.strip()]
        if lines and all(re.match(r"\s*#", x) for x in lines):
            return True
    words = [w for w in MARKUP.split(rest) if w]
    return all(FILLERS.match(w) for w in words)


def language(text: str) -> str | None:
    """The language that most of a prose text is in; None if it says too little."""
    counts: Counter = Counter()
    for lang, script in SCRIPTS if not text.isascii() else ():
        n = len(script.findall(text))
        if n:
            counts[lang] = n
    if counts["ja"] and counts["zh"]:  # kana make the Chinese characters around them Japanese, sentence by sentence
        parts = re.split(r"[。！？\n]", text)
        ja = sum(len(SCRIPTS[2][1].findall(p)) for p in parts if SCRIPTS[0][1].search(p))
        counts["ja"] += ja
        counts["zh"] -= ja
    latin: Counter = Counter()
    words = LETTERS.findall(text.lower())
    n_latin = 0
    for w, n in Counter(words).items():
        if w[0] > "ɏ":
            continue
        n_latin += len(w) * n
        for lang, x in WEIGHTS.get(w, {}).items():
            latin[lang] += x * n
        if not w.isascii():
            for lang, marks in MARKS.items():
                if not marks.isdisjoint(w):
                    latin[lang] += 0.5 * n
    best = max(counts, key=counts.get, default=None)
    if best and counts[best] * 2.5 >= n_latin:
        return best if counts[best] >= 4 else None
    top = latin.most_common(2)
    if not top or top[0][1] < 0.9 or len(words) < 3 and n_latin < 8:
        return None
    return top[0][0] if len(top) < 2 or top[0][1] > 1.2 * top[1][1] else None


def wanted(prompt: str) -> str | None:
    """The language that the prompt asks for, else its own."""
    t = FENCE.sub("\n", prompt)
    asked = [ASKED_WORDS.get((m["a"] or m["b"] or m["c"]).lower()) for m in ASKS.finditer(QUOTED.sub(" ", t))]
    named = [x for x in asked if x]
    return named[-1] if named else language(CODE.sub(" ", t))


#: How answers decline, by language; they count outside quotations only.
REFUSALS = re.compile(
    r"(?ix)"
    r"\b(?:i|we)(?:['’]m|\s+am|['’]re|\s+are)?\s*(?:(?:really|very|terribly)\s+)?(?:sorry,?|afraid)?[\s,]*(?:but\s+)?(?:that\s+)?(?:i\s+)?(?:can(?:no|['’]|\s+no)t|(?:am|['’]m)\s+(?:not\s+able|unable|not\s+allowed|not\s+permitted|not\s+in\s+a\s+position)|won['’]t|will\s+not|must\s+decline|decline|refuse|have\s+to\s+(?:pass|decline)|(?:['’]d|would)\s+rather\s+not|prefer\s+not|may\s+not)\b"
    r"|\bunable\s+to\s+(?:help|assist|review|comply|comment)|\bcan(?:no|['’])t\s+(?:help|assist|review|comment|comply|take)\b|not\s+something\s+i\s+can|\bi\s+(?:have|need)\s+to\s+pass\b|request\s+(?:was\s+)?(?:declined|denied|refused)|outside\s+(?:of\s+)?(?:my\s+(?:remit|scope)|what\s+i)|beyond\s+what\s+i\s+(?:may|can)|no\s+review\s+from\s+my\s+side|guidelines\s+(?:prevent|forbid|do\s+not|don['’]t)|policy\s+(?:prevents|forbids)|against\s+my\s+(?:guidelines|policy)|i\s+must\s+(?:refuse|decline)|as\s+an\s+ai\b"
    r"|(?:kann|darf|möchte|will|werde)\s+(?:ich|wir)\b[^.!?]{0,80}\b(?:nicht|kein\w*)\b|\b(?:ich|wir)\s+(?:kann|können|darf|dürfen|möchte|will|werde|lehne)\b[^.!?]{0,80}\b(?:nicht|kein\w*|ab)\b|äußere\s+ich\s+mich\s+nicht|nicht\s+helfen|leider\s+(?:nicht|kein)|(?:anfrage|prüfung)\s+(?:wurde\s+)?(?:abgelehnt|muss\s+ich\s+ablehnen)|übernehme\s+ich\s+nicht|sehe\s+ich\s+ab|nicht\s+zuständig|außerhalb\s+meine\w*"
    r"|je\s+(?:suis\s+désolé\w*[^.]{0,40})?(?:ne\s+(?:peux|puis|suis|souhaite|vais|veux|dois)\b[^.]{0,40}\bpas|préfère\s+ne\s+pas|dois\s+(?:refuser|décliner)|refuse|décline)|il\s+m['’]est\s+impossible|impossible\s+(?:pour\s+moi\s+)?de\s+(?:traiter|vous\s+aider|répondre|donner)|(?:demande|revue)\s+(?:refusée|déclinée)|hors\s+de\s+mon\s+(?:champ|domaine|ressort)|ne\s+me\s+(?:permet\w*|prononcer\w*)|je\s+(?:m['’]abstiens|passe\s+mon\s+tour)"
    r"|\b(?:no\s+(?:puedo|podemos|debo|voy\s+a|quiero)|no\s+me\s+(?:es\s+posible|está\s+permitido|corresponde)|no\s+está\s+(?:permitido|a\s+mi\s+alcance)|prefiero\s+no|me\s+abstengo|lo\s+siento,?\s+(?:pero\s+)?no|solicitud\s+(?:rechazada|denegada)|fuera\s+de\s+mi\s+(?:ámbito|alcance)|debo\s+(?:rechazar|declinar)|tengo\s+que\s+(?:rechazar|declinar|pasar))"
    r"|(?:お応え|お答え|対応|お手伝い|レビュー|確認|回答|コメント|お引き受け|お受け|引き受け)[^。]{0,14}(?:できません|できかね|しかねます|致しかねます|いたしかねます|控え|ご遠慮|遠慮|辞退|お断り|許されて|認められて)|お断り|申し訳(?:ありません|ございません)が[^。]{0,40}(?:できません|かねます|ません)|範囲外|対象外"
    r"|(?:我|本人|我们)?(?:不能|无法|不便|不可以|没办法|不会|拒绝|不方便|不愿|不打算|婉拒)(?:对|为|协助|帮|给|处理|审阅|审查|评论|提供|完成|回答|接受|参与|就|在|发表)|恕我|超出(?:了)?我|请求被拒绝|抱歉[，,]?\s*我?(?:无法|不能)"
    r"|(?:도와|검토|답변|처리)[^.]{0,12}(?:수\s*없|어렵)|не\s+могу|отказываюсь|não\s+posso|prefiro\s+não|non\s+posso"
)
QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」|『[^』\n]*』|(?m:^log:.*$)")
FINDINGS = re.compile(r"`[^`\n]+`|\w/\w+\.\w+|\b\w+\.(?:ts|js|py|go|rs|dart|java)\b|\b\w+_\w+\b|\b[a-z]+[A-Z]\w+|\d")


def is_refusal(text: str) -> bool:
    """Declines instead of reviewing: a declining sentence outside quotations, and nothing else of substance."""
    kind, value, unclosed = body_of(text)
    if kind == "json" and not unclosed:
        parts = values(value)
        if isinstance(value, dict) and value.get("issues"):
            return False
        t = text[: re.search(r"[{\[]", text).start()] + "\n" + "\n".join(parts)
    else:
        t = text
    t = re.sub(r"(?m)^\s*#+.*$|^\s*```.*$", "", t).strip()
    outer = t
    if len(QUOTED.sub("", t).strip()) > 15:
        outer = QUOTED.sub(" ", t)
    if not REFUSALS.search(outer):
        return False
    sentences = [x for x in re.split(r"(?<=[.!?])\s+|(?<=[。！？])|\n+", outer) if x.strip()]
    return not any(FINDINGS.search(x) for x in sentences if not REFUSALS.search(x))


RUNS, UNSPACED = re.compile(r"\w+"), re.compile(r"[぀-ヿ一-鿿]")


def grams(text: str) -> set[str]:
    units: list[str] = []
    for w in RUNS.findall(text.lower()):
        units.extend(w if not w.isascii() and UNSPACED.search(w) else [w])
    return {" ".join(units[i : i + 4]) for i in range(len(units) - 3)}


def copies(text: str, prompt: str) -> bool:
    """Wholly or nearly the prompt's own words: nine tenths of the answer's four-word runs are the prompt's, or it is a cut of it."""
    kind, value, unclosed = body_of(text)
    if kind == "json" and not unclosed:
        text = text[: re.search(r"[{\[]", text).start()] + "\n" + "\n".join(values(value))
    a = grams(text)
    if len(a) < 8:
        x, y = (" ".join(re.sub(r"[^\w]+", " ", t.lower()).split()) for t in (text, prompt))
        return len(x) >= 12 and x in y and len(x) > 0.3 * len(y)
    return len(a & grams(prompt)) >= 0.8 * len(a)


W = r"(?:(?![぀-ヿ一-鿿])\w)"
TOKEN = re.compile(rf"\n[ \t]*\n\s*|`[^`\n]*`|https?://[^\s，。]+|[A-Za-z0-9_.-]*/[A-Za-z0-9_./-]+|[A-Za-z0-9_]+\.(?:config\.)?[a-z]{{1,4}}(?![A-Za-z0-9_])|[぀-ヿ一-鿿]|\d[\d.,]*\d|\d|{W}+(?:['’-]{W}+)*|[^\w\s]")


KNOWN: dict[str, tuple[str, int]] = {}


def classed(x: str) -> str:
    """A token's class: names, paths, numbers and breaks are one each, words count in lower case."""
    if x[0] == "\n":
        return "¶"
    if x[0] == "`" and "/" in x:
        return "<path>"
    if x[0] == "`" or re.search(r"^[a-z]+[A-Z]|_", x) or re.search(r"^[A-Za-z0-9_]+\.(?:config\.)?[a-z]{1,4}$", x) and not x[0].isdigit():
        return "<file>" if "." in x and "`" not in x else "<name>"
    if "/" in x and len(x) > 2:
        return "<path>"
    return "<n>" if x[0].isdigit() else x.lower()


#: What precedes an end, from the particular to the general: which of the last six tokens a pattern holds; the others are any.
PATTERNS = ((2, 3, 4, 5), (0, 1, 4), (1, 2, 3), (3, 5), (3, 4, 5), (2, 3, 4), (2, 4), (2, 3), (4, 5), (3, 4), (5,))
#: The pattern that is the last token alone.
GENERAL = len(PATTERNS) - 1
ENDED = re.compile(r"[\"'”’»)」*]*(?:[.!?。！？…]|\n)")


def coded(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: hashes of the patterns that end with it, whether it is a word, and where it ends."""
    from xxhash import xxh64_intdigest

    kinds, words, ends = [], [], []
    for m in TOKEN.finditer(text):
        x = m[0]
        known = KNOWN.get(x)
        if known is None:
            y = classed(x)
            known = xxh64_intdigest(y), y[0].isalnum() or y[0] == "<"
            if len(KNOWN) > 200_000:
                KNOWN.clear()
            if len(x) < 40:
                KNOWN[x] = known
        kinds.append(known[0])
        words.append(known[1])
        ends.append(m.end())
    start = xxh64_intdigest("¶")
    h = np.array([*[start] * 5, *kinds], dtype=np.uint64)
    codes = np.empty((len(kinds), len(PATTERNS)), dtype=np.uint64)
    for p, held in enumerate(PATTERNS):
        x = np.full(len(kinds), p + 1, dtype=np.uint64)
        for k in held:
            x = (x ^ h[k : k + len(kinds)]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(31)
        codes[:, p] = x * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(29))
    return codes, np.array(words, dtype=bool), np.array(ends, dtype=np.int64)


def end_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The patterns before each word's end in an answer, one row a word, and whether a sentence or line ends there."""
    codes, words, ends = coded(text)
    last = len(text.rstrip())
    return codes[words], np.array([e >= last or ENDED.match(text, e, e + 3) is not None for e in ends[words].tolist()], dtype=bool)


def ending(text: str) -> tuple[str, list[int]]:
    """How an answer ends: whole, cut, or open with the patterns before its end, for the corpus to tell."""
    kind, _, unclosed = body_of(text)
    if kind == "json":
        return ("cut" if unclosed else "whole"), []
    s = text.rstrip()
    if len(re.findall(r"(?m)^[ \t]*(?:[-*]\s+|\d+\.\s+)?```", s)) % 2:
        return "cut", []
    last = s.rsplit("\n", 1)[-1].strip()
    if s.endswith("```"):
        return "whole", []
    line = re.sub(r"```", "", last)
    if line.count("`") % 2 or re.search(r"(?:^|\s)\*\*[^*]*$", line) and line.count("**") % 2 or re.match(r"(?:[-*+]|\d+[.)])\s*(?:\*\*\s*)?$", last):
        return "cut", []
    if re.search(r"\n\s*\n[ \t]*(?:[-–—]{1,2}[ \t]*[\w .-]{2,40}|`?[\w.-]*/?[\w./-]+\.\w{1,5}`?)$", s):
        return "whole", []  # a signature or a file's name on a line of its own
    core = s.rstrip(CLOSERS)
    para = re.split(r"\n\s*\n", s)[-1]
    opened = any(para.count(a) > para.count(b) for a, b in ("“”", "«»", "「」", "（）")) or para.count("(") - len(re.findall(r"\w\)", para)) - para.count("()") > 0 and para.count("(") > para.count(")") or "[" in last and last.count("[") > last.count("]")
    if re.search(r"(?:^|\s)\"[^\"]*$", last) and last.count('"') % 2:
        opened = True
    if opened:
        return "cut", []
    if core and core[-1] in ENDS or s[-1] in ")）]】\"”’»」』" and not last.startswith(("#", "|")):
        return "whole", []
    if core and (core[-1] in ",;:，、；：/(&=+-–—\\" or not core[-1].isalnum() and core[-1] not in "%>"):
        return "cut", []
    return "open", coded(s.rstrip("*_"))[0][-1:].astype(np.int64).ravel().tolist()


def defects(text: str | None, prompt: str | None) -> tuple[list[str], list[int]]:
    """Defects that one answer shows by itself, and the patterns before an end that only the corpus can judge."""
    if is_empty(text):
        return ["empty"], []
    out = ["copies_prompt"] if prompt and copies(text, prompt) else []
    how, runs = ending(text)
    if out and (how == "open" or RUNS.findall(text.lower())[-4:] == RUNS.findall(prompt.lower())[-4:]):  # a copy ends where its prompt does
        how, runs = "whole", []
    if how == "cut":
        out.append("truncated")
    if is_refusal(text):
        out.append("refusal")
    if prompt:
        want, have = wanted(prompt), language(prose(text))
        if want and have and want != have:
            out.append("other_language")
    return out, runs
