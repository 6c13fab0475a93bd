"""Credentials in code, configuration and command output: find and mask.

A keyword automaton runs over each text once; only the lines around its hits are looked at further. There,
issuer formats, keyed assignments, connection strings, command options, headers and key blocks are matched, the
candidate value is tested for structure (literal, no reference, mask or digest), and masked with a placeholder of
the same length and alphabet, so that quoting and layout of the code around it stay as they are.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import heapq
import json
import re
import string
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:
    ahocorasick = None

# --- fixed values: words and formats ---------------------------------------------------------------------------
#: words of which any match below holds one, in lower case; with ``_PLUS`` a superset of all matches
KEYWORDS = (
    "pass", "pwd", "kennwort", "contraseña", "contrasena", "clave", "senha", "密码", "口令", "パスワード", "secret", "credential", "token", "key",
    "auth", "curl", "mysql", "mariadb", "://", "services/",
    "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_p", "glpat", "npm_", "hf_", "sk-", "sk_", "rk_", "xox", "aiza", "eyj", "pypi-", "dop_v1", "sg.", "shpat_",
)

#: formats by which issuers mark their keys
ISSUERS = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}", r"gh[pousr]_[A-Za-z0-9]{36}", r"github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}", r"github_pat_[A-Za-z0-9_]{40,}", r"glpat-[A-Za-z0-9_-]{20}",
    r"npm_[A-Za-z0-9]{36}", r"hf_[A-Za-z0-9]{30,40}", r"sk-(?:live-|proj-|test-|ant-)?[A-Za-z0-9]{24,}", r"[sr]k_(?:live|test)_[A-Za-z0-9]{20,}", r"xox[abeprs]-[0-9]{6,}(?:-[A-Za-z0-9]+)+",
    r"AIza[A-Za-z0-9_-]{35}", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{20,}", r"pypi-[A-Za-z0-9_-]{50,}", r"dop_v1_[a-f0-9]{64}", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", r"shpat_[a-f0-9]{32}",
)

#: words in a name that make its value a secret
NAME_WORDS = (
    r"pass(?:word|wd|wort|phrase)?|pwd|kennwort|mot_?de_?passe|contrase[nñ]a|clave|senha|密码|口令|パスワード|secret|credentials?|"
    r"(?:auth|access|refresh|bearer|session|id|bot|api|deploy|push|personal)[_-]?token|token|(?:api|access|signing|storage|account|encryption|master|private|client|shared|ssh|hmac|jwt|webhook|auth|service|app)[_-]?key|\w+_key|key_\w+|\w+Key"
)

#: names that hold no secret although a word of them says so
PLAIN_NAMES = re.compile(r"(?i)(?:_|-)(?:path|file|dir|name|id|url|uri|type|len|length|min_length|max_length|count|limit|ttl|hint|policy|size|format|version|env|ref|index|field|column|prefix|expiry|expires)$|^(?:token_type|tokenizer|public_?key|primary_?key|foreign_?key|sort_?key|cache_?key|partition_?key|row_?key|key_?id|keyboard|tokens|max_tokens)$|public")

# a word begins behind no letter or digit, or behind the letter of an escaped line end or tab
_EDGE = r"(?:(?<![A-Za-z0-9])|(?<=\\n)|(?<=\\t))"
_ISSUER = re.compile(_EDGE + "(?:" + "|".join(ISSUERS) + ")(?![A-Za-z0-9])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_NAME_RUN = re.compile(r"[\w.-]+")
_NAME_WORD = re.compile(f"(?i){NAME_WORDS}")
_ASSIGNED = re.compile(r"(?:\\?[\"'])?\s*(?P<op>:=|=>|==|=|:)\s*(?P<value>\\?\"[^\"\n]*?\\?\"|\\?'[^'\n]*?\\?'|[^\s\"'<>,;\\][^\s\"'<>,;\\]*)")
_SPLIT = re.compile(r"(?P<q>\\?[\"'])(?P<a>[A-Za-z0-9_.-]{2,})(?P=q)\s*\+\s*(?P=q)(?P<b>[A-Za-z0-9_.-]+)(?P=q)")
_SCHEME_END = re.compile(r"[a-z0-9+.-]*\Z")
_LOGIN_PART = re.compile(r"[^\s:/@\"'<>]*:(?P<value>[^\s/@\"'<>]{3,})@[A-Za-z0-9.-]+")
_HOOK = re.compile(r"https?://hooks?\.[^\s\"'/]+/services/(?P<value>T[A-Za-z0-9]+/B[A-Za-z0-9]+/[A-Za-z0-9]{16,})")
_HEADER = re.compile(r"(?i)authorization\\?[\"']?\s*[:=]\s*\\?[\"']?(?P<scheme>bearer|token|basic|apikey|digest)\s+(?P<value>[A-Za-z0-9+/=_.~-]{12,})")
#: a command and its option; they are sought one after the other, so that a line is passed over once
_COMMANDS = (
    (re.compile(_EDGE + r"curl\b"), re.compile(r"\s(?:-u|--user)[ =]\\?[\"']?[^\s:\"']+:(?P<value>[^\s\"']+)")),
    (re.compile(_EDGE + r"(?:mysql|mysqldump|mysqladmin|mariadb)\b"), re.compile(r"\s-p(?P<value>[^\s\"'\\]{4,})")),
)
_OPTION = re.compile(r"(?i)--(?:[a-z]+-)*(?:token|password|secret|passwd|api-key|apikey|auth)[= ]\\?[\"']?(?P<value>[^\s\"'\\]+)")
_XML = re.compile(r"(?i)<(?:\w+:)?(?:password|passwd|secret|token|api_?key)>(?P<value>[^<\s]+)</")
_ATTRIBUTE = re.compile(r"(?i)key=\\?[\"'][\w.-]*(?:key|password|secret|token|pwd)\\?[\"']\s+value=\\?[\"'](?P<value>[^\"'\\]+)\\?[\"']")
_LOGIN = re.compile(r"(?i)(?:^|\s)(?:password|passwd)\s+(?P<value>[^\s\"'=:(\\][^\s\"'\\]{7,})(?=\s*$|\\n)")

_REFERENCE = re.compile(r"^\$|^%[A-Z_]+%$|\$\{|\{\{|^<|^![a-z]+$|^@|^env[.:(]|^os\.|^process\.|^vault[:/]|^ssm:|^arn:|^file:|^(?:~|\.{1,2})?(?:/[a-z][a-z0-9_.-]*){2,}/?$|\w\(|^[A-Z_]+\[|secretKeyRef|valueFrom", re.A)
_MASK = re.compile(r"(?i)^[x*•.#_-]+$|^[\[(]?(?:redacted|masked|hidden|removed|filtered|scrubbed)|^[\[(]?(?:none|null|nil|undefined|true|false|empty|todo|tbd|fixme|change_?me|example|sample|dummy|placeholder|prompt|required|optional|bearer|basic|string|str|int|bool|bytes)[\])]?$|^(?:your|my|the|insert|enter)[ _-]|your[_-]|_here$|^replace[ _-]|<[^>]*>|^\.\.\.|^\W*$")
_WORDISH = re.compile(r"^[a-z]+(?:[ _.-][a-z]+)*$|^[A-Z][a-z]+$|^[A-Z_]+$")
_NUMBER = re.compile(r"^[\d.,:_-]+[a-z]{0,3}$")
# -----------------------------------------------------------------------------------------------------------------


def automaton(words: tuple[str, ...]) -> tuple[list[dict[str, int]], list[bool]]:
    """Goto table and ends of an automaton for all words: a state is the longest suffix read that begins a word."""
    go: list[dict[str, int]] = [{}]
    ends, fail = [False], [0]
    for w in words:
        at = 0
        for c in w:
            if c not in go[at]:
                go[at][c] = len(go)
                go.append({})
                ends.append(False)
                fail.append(0)
            at = go[at][c]
        ends[at] = True
    queue = list(go[0].values())
    for state in queue:
        ends[state] |= ends[fail[state]]
        for c, nxt in list(go[state].items()):
            queue.append(nxt)
            fail[nxt] = go[fail[state]].get(c, 0)
        go[state] = {**go[fail[state]], **go[state]}
    return go, ends


def _automaton():
    """A function that yields the places where a keyword ends; the C module's automaton where it is installed."""
    if ahocorasick is None:
        go, ends = automaton(KEYWORDS)

        def scan(text: str) -> Iterator[int]:
            state = 0
            for at, c in enumerate(text):
                state = go[state].get(c, 0)
                if ends[state]:
                    yield at

        return scan
    a = ahocorasick.Automaton()
    for w in KEYWORDS:
        a.add_word(w, len(w))
    a.make_automaton()
    return lambda text: (hit[0] for hit in a.iter(text))


_scan = None
#: between the parts of a divided literal; any white space may stand there
_PLUS = re.compile(r"\+[^\S\n]*\\?[\"']")
#: letters that the expressions take for s and i without regard to case
_FOLD = str.maketrans("ſıİ", "sii")


def hit_lines(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the lines with a keyword, in order."""
    global _scan
    if _scan is None:
        _scan = _automaton()
    low = text.lower()
    if len(low) != len(text):  # case folding changed the length: fold letter by letter
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    if not low.isascii():
        low = low.translate(_FOLD)
    out: list[tuple[int, int]] = []
    stop = -1
    found = _scan(low)
    plus = [m.start() for m in _PLUS.finditer(text)] if "+" in text else []
    for at in heapq.merge(found, plus) if plus else found:
        if at < stop:
            continue
        begin = text.rfind("\n", 0, at + 1) + 1 if text[at] != "\n" else text.rfind("\n", 0, at) + 1
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if out and out[-1][0] == begin:
            continue
        out.append((begin, end))
        stop = end
    return out


def literal(value: str, strict: bool) -> bool:
    """Whether a value is a literal secret. ``strict``: the name alone proves little, so the value must look made up."""
    v = value.strip().rstrip(")]}:;,")  # what closes the code around a bare value
    if len(v) < 6 or _REFERENCE.search(v) or _MASK.search(v) or _NUMBER.match(v) or _WORDISH.match(v):
        return False
    if len(set(v)) < 4 or " " in v:
        return False
    classes = sum(bool(re.search(c, v)) for c in ("[a-z]", "[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    if strict:
        return len(v) >= 16 and classes >= 2 and bool(re.search(r"\d", v))
    return classes >= 3 or (classes >= 2 and (bool(re.search(r"\d", v)) or len(v) >= 10))


def basic_credentials(value: str) -> bool:
    """Whether base64 text decodes to user and password."""
    try:
        plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except (binascii.Error, ValueError):
        return False
    user, colon, password = plain.partition(":")
    return bool(colon and user and password and plain.isprintable())


def _unquote(m: re.Match) -> tuple[int, int, bool]:
    a, b = m.span("value")
    s = m.string
    quoted = False
    for q in ('\\"', "\\'", '"', "'"):
        if s.startswith(q, a) and b - a >= 2 * len(q) and s.endswith(q, a, b):
            return a + len(q), b - len(q), True
        if s.startswith(q, a):
            quoted = True
            a += len(q)
            if s.startswith(q[-1], b - 1):
                b -= 1
            if s[b - 1:b] == "\\":
                b -= 1
            break
    return a, b, quoted


def _urls(line: str) -> Iterator[re.Match]:
    """Logins with a password in addresses; every part of the line belongs to one ``://`` at most."""
    last = 0
    at = line.find("://")
    while at >= 0:
        scheme = _SCHEME_END.search(line[max(last, at - 64):at]).group().lstrip("0123456789+.-")
        before = line[at - len(scheme) - 1:at - len(scheme)]
        if scheme and (not before.isascii() or not before.isalnum() or line[at - len(scheme) - 2:at - len(scheme)] in ("\\n", "\\t")):
            if m := _LOGIN_PART.match(line, at + 3):
                yield m
        last = at + 3
        at = line.find("://", last)


def _options(line: str) -> Iterator[re.Match]:
    """Values of a command's options: each option needs a command between it and the option before."""
    for command, option in _COMMANDS:
        at = 0
        while (c := command.search(line, at)) and (o := option.search(line, c.end())):
            yield o
            at = o.end()


def _assignments(line: str) -> Iterator[tuple[str, re.Match]]:
    """(name, match of operator and value) of names with a word of secrets in their last part.

    A name is a whole run of word characters, dots and dashes, so a line is passed over once, however long.
    """
    done = 0
    for run in _NAME_RUN.finditer(line):
        if run.start() < done:
            continue
        name = run.group().rsplit(".", 1)[-1]
        if len(name) > 2 and (m := _ASSIGNED.match(line, run.end())) and _NAME_WORD.search(name):
            yield name.strip("_-"), m
            done = m.end()


_BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
_SUMMED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})")


def verdict_of(value: str) -> str | None:
    """What a value's own checksum or structure says: ``valid``, ``invalid``, or null where its format has none.

    Tokens with a prefix end in the CRC-32 of their random part, in six base-62 digits; the head of a web token is
    the JSON of an object with its algorithm. Retired issuers and test accounts hand out tokens without valid
    sums, so the verdict is reported and only values that cannot be random are dropped (``made_up``).
    """
    if m := _SUMMED.fullmatch(value):
        n, digits = zlib.crc32(m[1].encode()), ""
        while n:
            n, r = divmod(n, 62)
            digits = _BASE62[r] + digits
        return "valid" if digits.rjust(6, "0") == m[2] else "invalid"
    if value.startswith("eyJ") and value.count(".") == 2:
        try:
            return "valid" if "alg" in json.loads(base64.urlsafe_b64decode(value.split(".")[0] + "===")) else "invalid"
        except (ValueError, TypeError):
            return "invalid"
    return None


def made_up(value: str) -> bool:
    """Whether a value with an issuer's format has the variety of a random one: no letter fills a third of it."""
    body = value[4:]
    return len(set(body)) >= 4 and max(map(body.count, set(body))) * 3 <= len(body) or verdict_of(value) == "valid"


def line_spans(line: str) -> list[tuple[int, int]]:
    """Spans of secret values that begin in one line (key blocks aside)."""
    spans = [m.span() for m in _ISSUER.finditer(line) if made_up(m.group())]
    for rx in (_HOOK, _OPTION, _XML, _ATTRIBUTE, _LOGIN):
        for m in rx.finditer(line):
            if rx is _HOOK or literal(m["value"], False):
                spans.append(m.span("value"))
    for found in (_urls(line), _options(line)):
        spans += [m.span("value") for m in found if literal(m["value"], False)]
    for m in _HEADER.finditer(line):
        if basic_credentials(m["value"]) if m["scheme"].lower() == "basic" else literal(m["value"], True):
            spans.append(m.span("value"))
    for m in _SPLIT.finditer(line):
        if _ISSUER.fullmatch(m["a"] + m["b"]):
            spans += [m.span("a"), m.span("b")]
    for name, m in _assignments(line):
        if PLAIN_NAMES.search(name):
            continue
        a, b, quoted = _unquote(m)
        value = line[a:b]
        # a bare word behind a colon or in code is more often a name than a value
        certain = bool(re.search(r"(?i)pass|pwd|kennwort|contrase|clave|secret|senha|密码|口令|パスワード", name))
        if not quoted and not certain and re.fullmatch(r"[A-Za-z_][\w.]*", value) and not re.search(r"[A-Z].*\d|\d.*[A-Z]|\d{3}", value):
            continue
        if re.fullmatch(r"(?i)sha(?:256|384|512|1)[:-].*", value):
            continue
        if literal(value, not (certain or re.search(r"(?i)api_?key|token|_key|key$", name))):
            spans.append((a, b))
    return sorted(set(spans))


def find_secrets(text: str) -> list[tuple[int, int]]:
    """Spans (code points) of all secret values of a text, in order, without overlaps."""
    spans: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        closes = list(_PEM_END.finditer(text))
        starts = [m.start() for m in closes]
        blocks = list(_PEM.finditer(text))
        for m, another in zip(blocks, [*(x.start() for x in blocks[1:]), len(text)]):
            at = bisect.bisect_left(starts, m.end())
            # without an end mark (a cut text), the block runs on over lines of base64 only
            stop = closes[at].end() if at < len(closes) and starts[at] <= another else _block_end(text, m.end())
            if stop - m.end() > 24:
                spans.append((m.start(), stop))
    for begin, end in hit_lines(text):
        spans += [(begin + a, begin + b) for a, b in line_spans(text[begin:end])]
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            if b > out[-1][1] and "PRIVATE KEY" not in text[out[-1][0]:out[-1][0] + 50]:
                out[-1] = (out[-1][0], b)
            continue
        out.append((a, b))
    return out


_B64_LINE = re.compile(r"(?:\\n|\n)[ \t+>|-]*[A-Za-z0-9+/=]{8,}(?=\\n|\n|$|\"|\\\")")


def _block_end(text: str, at: int) -> int:
    while m := _B64_LINE.match(text, at):
        at = m.end()
    return at


_LOWER, _UPPER, _DIGIT = re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]")


def placeholder(value: str) -> str:
    """Same length, same alphabet: lower case to x, upper case to X, digits to 0; marks, escapes and breaks stay."""
    if value.startswith("-----BEGIN"):
        head, _, rest = value.partition("-----\\n" if "-----\\n" in value else "-----\n")
        sep = value[len(head):len(value) - len(rest)]
        tail = rest.rfind("-----END")
        body, foot = (rest, "") if tail < 0 else (rest[:tail], rest[tail:])
        parts = re.split(r"(\\n|\\r)", body)
        return head + sep + "".join(p if p in ("\\n", "\\r") else _mask(p) for p in parts) + foot
    return _mask(value)


def _mask(v: str) -> str:
    return _DIGIT.sub("0", _UPPER.sub("X", _LOWER.sub("x", v)))


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out += [text[at:a], placeholder(text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for tbl, conv, rec, text in zip(b["tbl"], b["conv_id"], b["rec_id"], b["text"]):
            if text:
                seen, line, at = set(), 1, 0
                for a, z in find_secrets(text):
                    line += text.count("\n", at, a)
                    at = a
                    out.append((tbl, conv, rec, line, a, z, line not in seen, verdict_of(text[a:z])))
                    seen.add(line)
        yield pd.DataFrame(out, columns=["tbl", "conv_id", "rec_id", "line_no", "start", "stop", "first_in_line", "verdict"])


def secret_spans(texts: DataFrame) -> DataFrame:
    """Where the secrets are: (tbl, conv_id, rec_id, line_no, start, stop, first_in_line, verdict of ``verdict_of``).

    ``texts``: tbl, conv_id, rec_id, text. Null and empty texts have none; lines count from 1, split at ``\\n``;
    a secret over several lines counts for the line on which it begins.
    """
    return texts.select("tbl", "conv_id", "rec_id", "text").filter("text is not null and text <> ''").mapInPandas(_find, "tbl string, conv_id string, rec_id string, line_no long, start long, stop long, first_in_line boolean, verdict string")


def _redact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        masked, n = [], []
        for text in b["text"]:
            spans = find_secrets(text) if text else []
            masked.append(mask(text, spans) if spans else text)
            n.append(len(spans))
        yield b[["tbl", "conv_id", "rec_id"]].assign(text=masked, n_secrets=n)


def redact(texts: DataFrame) -> DataFrame:
    """Every text with its secrets masked (tbl, conv_id, rec_id, text, n_secrets); lengths stay as they are."""
    return texts.select("tbl", "conv_id", "rec_id", "text").mapInPandas(_redact, "tbl string, conv_id string, rec_id string, text string, n_secrets long")


def recorded_texts(events: DataFrame, oh: DataFrame) -> DataFrame:
    """trace_events.text and oh_rows.content in one shape, repeats merged by key."""
    e = events.select(F.lit("trace_events").alias("tbl"), F.col("session_id").alias("conv_id"), F.col("event_id").alias("rec_id"), "text")
    o = oh.select(F.lit("oh_rows").alias("tbl"), F.col("trajectory_id").alias("conv_id"), F.col("id").alias("rec_id"), F.col("content").alias("text"))
    return e.unionByName(o)
