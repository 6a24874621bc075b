"""Where a text of code or configuration may hold a credential: the literals worth indexing, found without knowing other files."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np

#: Names of credentials in several languages, as the words a name may end with; "+" joins neighbouring words.
NAMES = set(
    "password passwd passwort passphrase passcode pwd pw pass secret secrets token bearer credential credentials kennwort zugangsdaten senha contrasena contraseña clave mot+de+passe motdepasse parola haslo wachtwoord пароль 密码 パスワード 비밀번호 "
    "apikey accesskey secretkey authtoken authkey clientsecret dbpwd api+key access+key secret+key signing+key license+key licence+key private+key auth+key encryption+key account+key storage+key master+key service+key deploy+key shared+key admin+key root+key hmac+key aes+key app+key client+key".split()
)
#: Words near a credential in a comment.
CUES = re.compile(r"(?i)\b(?:pw|pwd|pass\w*|token|keys?|secret|login|logins|credentials?|creds|until rotation|rotate|bearer|zugang|kennwort|schlüssel|acceso|clave|contraseña|accès|mot de passe|clé|senha|acesso|chave|пароль|ключ|доступ|パスワード|鍵|密码|密钥|비밀번호)\b|パスワード|密码|密钥|비밀번호")
#: A name that ends like one of these, up to its assignment; run over lower case.
STEMS = re.compile(r"(?:pass(?:w(?:or[dt]|d)|phrase|code|e)?|pwd|pw|secrets?|tokens?|keys?|bearer|credentials?|kennwort|zugangsdaten|senha|contrase(?:n|ñ)a|contrasena|clave|parola|haslo|wachtwoord|пароль|密码|パスワード|비밀번호)[\d_]{0,12}[\"'`]?\]?[ \t]*(?:\[\][ \t]*)?[?!]?[ \t]*[:=]")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")
PLACEHOLDER = re.compile(
    r"(?i)^(?:\W*|x{3,}|\*+|0+|1234\w*|.*(?:\$\{|\$\(|\{\{|<[^>]*>|%[A-Z_]+%|%\(|\.\.\.|…).*|\$[A-Z_]\w*|(?:your|my|the|some|any|a)[-_ ].*|.*[-_ ]here|.*(?:changeme|change[-_]me|change[-_]it|replace[-_]?me|example|placeholder|dummy|redacted|insert|todo|fixme|sample|fake|not[-_]?set|set[-_]in).*|"
    r"(?:none|null|nil|undefined|true|false|empty|unset|default|secret|password|passwd|token|user|admin|root|test|testing|foo|bar|string|str|vault|env|ssm|arn|file|kms|op|sops|secretsmanager|projects)(?:[:/].*)?)$"
)
NOT_VALUE = re.compile(r"^(?:sha(?:1|224|256|384|512)[-:].*|md5[-:].*|ssh-(?:rsa|ed25519|dss)\b.*|ecdsa-.*|-----BEGIN.*|\w+://.*|\.{0,2}/(?:[\w.-]+/)*[\w.-]*|[\d.,_:-]+[a-zA-Z%]{0,2}|[a-z]+(?:[A-Z][a-z]+)*|(?:[A-Z][a-z]+)+|[A-Z]+(?:_[A-Z]+)*|[a-z]+(?:[_.-][a-z]+)*|[A-Z][a-z]+(?:[-_ ][A-Z]?[a-z]+)*|.*[\s(){}<>;].*)$", re.S)
KEY_BODY = r"(?:(?:\\[nr]|[\s\"'+#/*|>,;-])*[A-Za-z0-9+/=]{16,})"
SHAPES = re.compile(
    r"(?P<key>-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----(?:" + KEY_BODY + r"(?:\\[nr]|[A-Za-z0-9+/=\s\"'+:,-])*?-----END[A-Z0-9 ]*-----|" + KEY_BODY + r"+|[\s\"'`+\\n]*\Z))"
    r"|(?P<aws>\b(?:AKIA|ASIA)[0-9A-Z]{16}\b)|(?P<gh>\bgh[pousr]_[A-Za-z0-9]{30,}\b|\bgithub_pat_\w{30,})|(?P<slack>\bxox[abeoprs]-[A-Za-z0-9-]{10,})|(?P<jwt>\beyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})"
    r"|(?P<other>\bsk_live_\w{16,}|\brk_live_\w{16,}|\bAIza[\w-]{35}\b|\bglpat-[\w-]{20,}|\bnpm_[A-Za-z0-9]{36}\b|\bSG\.[\w-]{16,}\.[\w-]{16,}|\bya29\.[\w-]{20,})"
    r"|://[^\s/:@\"'`<>{}$]*:(?P<url>[^\s/@\"'`<>{}$]{4,})@"
    r"|\b[Bb]earer[ :]+(?P<bearer>[\w.~+/=-]{12,})|\b[Bb]asic +(?P<basic>[A-Za-z0-9+/]{12,}={0,2})(?![\w ])"
    r"|[?&;](?:access_token|auth_token|token|sig|signature|api_?key|key|password|passwd|pwd|secret|client_secret|auth)=(?P<query>[\w.~+/%-]{8,})"
    r"|(?:\s-u|--user|--proxy-user)[ =]+[\"']?[^\s:\"'@/]+:(?P<user>[^\s\"'@]{4,})|(?:--password|--passwd|--token|--api-key|--secret)[ =]+[\"']?(?P<flag>[^\s\"'-][^\s\"']{5,})"
)
#: One of these stands in every text that a shape is found in.
HINTS = ("-----BEGIN", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat", "xox", "eyJ", "_live_", "AIza", "glpat", "npm_", "SG.", "ya29", "earer", "asic ", " -u", "--user", "--proxy-user", "--password", "--passwd", "--token", "--api-key", "--secret")
QUERY_HINT = re.compile(r"[?&;](?:\w*token|sig|signature|\w*key|password|passwd|pwd|\w*secret|auth)=").search


def hinted(text: str) -> bool:
    return any(h in text for h in HINTS) or "://" in text and "@" in text or "=" in text and ("?" in text or "&" in text or ";" in text) and QUERY_HINT(text) is not None


QUOTED = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`((?:[^`\\\n]|\\.)*)`')
ASSIGNED = re.compile(r"(?<![\w.\-$])([\w.\-$]++)[\"'`]?\]?\s*(?:\[\]\s*)?(?:\?|!)?(?::\s*[&*?\w<>\[\]'| ]{1,40}?\s*)?(?:=>|:=|\?=|=|:)\s*")
#: A value that begins on the next line.
BROKEN = re.compile(r"\s*[(\[{]?\s*\\?\s*")
#: name = value without quotes, to the end of the line, in formats that allow it.
BARE = re.compile(r"(?:^|(?<=\s)|(?<=[/:;]))(?:export\s+|set\s+|ENV\s+|ARG\s+)?([\w.\-]+)\s*(?:=|:\s)\s*(?![\"'`|>&])(\S+)\s*(?:#.*)?$")
BARE_FORMATS = {"env", "ini", "properties", "yaml", "yml", "npmrc", "sh", "bash", "zsh", "cfg", "conf", "toml", "staging", "production", "local", "dev", "pypirc", "netrc", "pgpass", "service", "tfvars", "dockerfile", "prod", "test", "development"}
CODE_FORMATS = {"ts", "tsx", "js", "jsx", "mjs", "py", "go", "dart", "java", "rs", "c", "h", "cpp", "cs", "rb", "php", "kt", "swift", "scala"}
FALLBACK = re.compile(r"\$\{[A-Za-z_]\w*:?[-=]([^}]+)\}")
COMMENT = re.compile(r"^\s*[-+]?\s*(?:#|//|/\*|\*|--|;|<!--|%|\"\"\")+!?\s*(.*?)\s*(?:\*/|-->|\"\"\")?\s*$")
TAIL = re.compile(r"(?:[:=：]\s*|\s)[\"'`]?([^\s\"'`,]{6,}?)[\"'`]?[.,;]?$")
JOIN = re.compile(r"\s*(?:\+|\\|\.\.?|<>|&)?\s*\n[ \t]*[-+]?[ \t]*(?:\+|\.|&)?[ \t]*([\"'`])((?:(?!\1)[^\\\n]|\\.)+)\1")


def credential_name(name: str) -> bool:
    """Whether the last words of a name, digits aside, are those of a credential."""
    w = [x.lower() for x in WORD.findall(name.rsplit(".", 1)[-1] if not re.search(r"\.(?:key|token|pass\w*|secret|pwd)", name) else name.replace(".", "_"))]
    return bool(w) and (w[-1] in NAMES or "+".join(w[-2:]) in NAMES or "+".join(w[-3:]) in NAMES)


def working(value: str) -> bool:
    """Whether a value could be a password or key in use, by its characters."""
    if len(value) < 6 or PLACEHOLDER.match(value) or NOT_VALUE.match(value):
        return False
    lower, upper, digit = any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value)
    return digit or any(c in "!%#~?^$@&*+=" for c in value) or lower and upper and any(c in "._-" for c in value)


def candidates(text: str, ext: str) -> list[tuple[int, int, int, str, str]]:
    """(line from 0, start, end, kind, value) of each literal that may be a credential; kind is shape, name or comment."""
    out: list[tuple[int, int, int, str, str]] = []
    taken: list[tuple[int, int]] = []

    def add(start: int, end: int, kind: str, value: str, at: int | None = None) -> None:
        if not any(a < end and start < b for a, b in taken):
            taken.append((start, end))
            out.append((text.count("\n", 0, start if at is None else at), start, end, kind, value))

    if hinted(text):
        for m in SHAPES.finditer(text):
            kind = m.lastgroup
            value = m[kind]
            if kind == "key":
                add(m.start(), m.end(), "shape", value)
            elif kind in ("aws", "gh", "slack", "jwt", "other") or kind == "query" and not PLACEHOLDER.match(value) and (any(c.isdigit() for c in value)) or kind in ("url", "user", "flag", "bearer", "basic") and not PLACEHOLDER.match(value) and working(value):
                if not re.search(r"EXAMPLE|(.)\1{7}", value):
                    add(m.start(kind), m.end(kind), "shape", value)
    seen = -1
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for hit in STEMS.finditer(low):
        if hit.start() < seen:
            continue
        a = text.rfind("\n", 0, hit.start()) + 1
        b = text.find("\n", hit.start())
        seen = b = len(text) if b < 0 else b
        line, after = text[a:b].rstrip("\r"), None
        for m in ASSIGNED.finditer(line):
            if not credential_name(m[1]):
                continue
            if not after or after[0].start() < m.end():
                after = list(islice(QUOTED.finditer(line, m.end()), 2)) if after is None or after else []
            literals = [] if after and ";" in line[m.end() : after[0].start()] else after
            if literals and (literals[0].start() == m.end() or ext in CODE_FORMATS):
                lookup = re.search(r"(?i)env|vault|secret|config|getProperty|option", line[m.end() : literals[0].start()])
                if lookup and len(literals) > 1:
                    literals = literals[1:]
                elif lookup and not re.search(r"(?:\|\||\?\?|\bor\b|,)\s*$", line[: literals[0].start()]):
                    literals = []
                elif literals and literals[0].start() > m.end() and not lookup and not re.fullmatch(r"[\s(\[{&*rbuf]*|.*(?:\|\||\?\?|\bor\b|[=:,(])\s*[rbuf]?", line[m.end() : literals[0].start()]):
                    literals = []
                for q in literals[:1]:
                    k = q.lastindex
                    value, s, e = q[k], a + q.start(k), a + q.end(k)
                    inner = FALLBACK.search(value)
                    if inner:
                        value, s, e = inner[1], s + inner.start(1), s + inner.end(1)
                    first = s
                    while q.end() == len(line.rstrip(" +\\.&")) or text[e + 1 : e + 2] and JOIN.match(text, e + 1):
                        j = JOIN.match(text, e + 1)
                        if not j:
                            break
                        value, e = value + j[2], j.end(2)
                    if working(value):
                        add(s, e, "name", value, first)
            elif not literals and ext in CODE_FORMATS and BROKEN.fullmatch(line, m.end()):
                j = re.compile(r"[\s(\\]*[-+]?\s*([\"'`])((?:(?!\1)[^\\\n]|\\.)+)\1(?!\s*:)").match(text, b)
                if j:
                    value, e = j[2], j.end(2)
                    while k := JOIN.match(text, e + 1):
                        value, e = value + k[2], k.end(2)
                    if working(value):
                        add(j.start(2), e, "name", value)
        if ext not in CODE_FORMATS and (m := BARE.search(line)) and credential_name(m[1]):
            value, s = m[2], a + m.start(2)
            inner = FALLBACK.search(value)
            if inner:
                value, s = inner[1], s + inner.start(1)
            value = value.rstrip("\"',;")
            if working(value):
                add(s, s + len(value), "name", value)
    if "://" in text or ":" in text:
        for m in re.finditer(r"(?m)^[ \t]*[-+]?[ \t]*(?:#|//|/\*|\*|--|;)[^\n]*[:：=][ \t]*[^\s:]+[ \t]*(?:\*/)?\r?$", text):
            c = COMMENT.match(m[0].rstrip("\r"))
            if c and (t := TAIL.search(c[1])) and working(t[1]) and CUES.search(c[1][: t.start(1)] or "") and not re.search(r"://|_authToken", c[1]):
                s = m.start() + c.start(1) + t.start(1)
                add(s, s + len(t[1]), "comment", t[1])
    return out


#: Characters of the gram by which texts are searched for a value, and of that for values shorter than it.
GRAM, SHORT = 8, 6


def gram_hashes(text: str, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` characters, one an offset."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(a) < size:
        return np.empty(0, dtype=np.uint64)
    h = np.full(len(a) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = h * np.uint64(0x100000001B3) + a[i : len(a) - size + 1 + i]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchor(value: str) -> int:
    """The hash of the gram of a value that is least like other text: without blanks if there is one, with the most digits and changes
    between letters, capitals, digits and marks, and the most different characters. Every working value has ``SHORT`` characters."""
    size = GRAM if len(value) >= GRAM else SHORT
    kinds = ["0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else " " if c.isspace() else "." for c in value]
    odd = [(k == "0") + (a != k) for a, k in zip(["a", *kinds], kinds)]

    def rank(i: int) -> tuple:
        return " " not in kinds[i : i + size], sum(odd[i : i + size]), len(set(value[i : i + size])), i

    best = max(range(len(value) - size + 1), key=rank)
    return int(gram_hashes(value[best : best + size], size).astype(np.int64)[0])


def probable(texts: list[str], table: np.ndarray, bits: int) -> list[list[int]]:
    """For each text the hashes of its grams that the filter knows, as signed numbers; texts are tested together."""
    from lodestack.llm.common import in_filter

    ends = np.cumsum([len(t) + 1 for t in texts])
    whole, out = "\0".join(texts), [set() for _ in texts]
    for size in (GRAM, SHORT):
        h = gram_hashes(whole, size)
        at = in_filter(h, table, bits)
        for row, x in zip(np.searchsorted(ends, at, side="right").tolist(), h[at].astype(np.int64).tolist()):
            out[row].add(x)
    return [sorted(x) for x in out]
