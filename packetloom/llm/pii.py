"""Personal information in free text: a conditional random field finds it, typed placeholders replace it.

The field is trained on the driver from a small labelled table (see ``pii_table``) with the given and family
names of a list of people as its lexicon, and sent to the workers. Features do not depend on which digits stand
in a line, so equal lines up to digits are decoded once and remembered within a bound. Spans found by the field
are then checked for what an item of their kind must have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from packetloom.llm import pii_table
from packetloom.llm.crf import CRF, Features, spans_in, tokens_of

KINDS = ("email", "phone", "id_number", "address", "name")
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
TRAIN_ROWS = 4_600  #: labelled rows for training
TRAIN_PEOPLE = 2_000  #: names of the list that are used at most
MEMO_LINES = 200_000  #: line patterns a worker remembers
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

#: a sentence ends behind a word of four letters; abbreviations and initials are shorter
_SENTENCE_END = re.compile(r"(?<=[a-zé]{4}[.?!]) +(?=\S)")

_ZEROS = bytes.maketrans(b"123456789", b"0" * 9)


def zeroed(text: str) -> str:
    """The text with every ASCII digit as 0."""
    return text.encode("utf-8", "surrogatepass").translate(_ZEROS).decode("utf-8", "surrogatepass")


def lexicon_of(names: list[tuple[str, str]]) -> dict[str, str]:
    """Lower-case words of given and family names; particles are left out."""
    out: dict[str, str] = {}
    for tag, column in (("family", 1), ("given", 0)):
        for row in names:
            for w in re.findall(r"(?:[^\W\d_][̀-ͯ]*)+", row[column]):
                if len(w) > 3:
                    out[w.lower()] = tag
    return out


def train(names: list[tuple[str, str]], rows: int = TRAIN_ROWS, rounds: int = 70) -> CRF:
    """The field, from ``rows`` labelled lines."""
    lexicon = lexicon_of(names + list(zip(pii_table.GIVEN, pii_table.FAMILY)))
    at = {lab: i for i, lab in enumerate(LABELS)}
    lines = []
    for text, spans in pii_table.filled(names, rows):
        text = zeroed(text)
        kinds, (starts, ends) = tokens_of(text), spans_in(text)
        labels = [0] * len(kinds)
        for a, b, kind in spans:
            first = True
            for i, (s, e) in enumerate(zip(starts, ends)):
                if a <= s and e <= b:
                    labels[i] = at[f"{'B' if first else 'I'}-{kind}"]
                    first = False
        if kinds:
            lines.append((kinds, labels))
    return CRF(LABELS, Features(lexicon)).fit(lines, rounds=rounds)


# --- exact checks of what the field found ------------------------------------------------------------------------
_EMAIL = re.compile(r"[\w.+%-]+\s?(?:@|%40|\[at\]|\(at\)|\bat\b)\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\bdot\b)\s?[\w-]+)+", re.I)
_REMOTE = re.compile(r"^git@|^\w+://|^v?\d+(?:\.\d+)+$", re.I)


def check_email(line: str, a: int, b: int) -> tuple[int, int] | None:
    m = _EMAIL.search(line, max(0, a - 40), min(len(line), b + 40))
    while m and m.end() <= a:
        m = _EMAIL.search(line, m.end(), min(len(line), b + 40))
    if not m or m.start() >= b or _REMOTE.search(m.group()) or line[m.end():m.end() + 1] == ":" and line[m.end() + 1:m.end() + 2].isalpha():
        return None
    start = m.start()
    for lead in ("mailto:",):
        if line[start:m.end()].lower().startswith(lead):
            start += len(lead)
    return start, m.end()


def check_phone(line: str, a: int, b: int) -> tuple[int, int] | None:
    text = line[a:b]
    if re.match(r"\.\d", line[b:b + 2]) or re.search(r"\d\.$", line[max(0, a - 2):a]):  # part of a longer dotted number
        return None
    n = sum(c.isdigit() for c in text)
    if not 7 <= n <= 16 or re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", text) or re.search(r"[A-Za-z]{2,}", re.sub(r"(?i)tel|ext|phone|x", "", text)):
        return None
    return a, b


def check_id(line: str, a: int, b: int) -> tuple[int, int] | None:
    return (a, b) if sum(c.isdigit() for c in line[a:b]) >= 6 else None


def check_address(line: str, a: int, b: int) -> tuple[int, int] | None:
    text = line[a:b]
    return (a, b) if any(c.isdigit() for c in text) and len(re.findall(r"[^\W\d_]{3,}", text)) >= 1 else None


def check_name(line: str, a: int, b: int) -> tuple[int, int] | None:
    words = re.findall(r"[^\W\d_]+", line[a:b])
    if len(words) < 2 or max(map(len, words)) < 3 or any(c.isdigit() or c in "@/<>=_" for c in line[a:b]):
        return None
    return a, b


CHECKS = {"email": check_email, "phone": check_phone, "id_number": check_id, "address": check_address, "name": check_name}
# -----------------------------------------------------------------------------------------------------------------


def spans_of(labels: np.ndarray, starts: list[int], ends: list[int]) -> list[tuple[int, int, str]]:
    out: list = []
    kind = None
    for i, lab in enumerate(labels):
        if lab == 0:
            kind = None
            continue
        k = KINDS[(lab - 1) // 2]
        if lab % 2 == 1 or k != kind:
            out.append([starts[i], ends[i], k])
            kind = k
        else:
            out[-1][1] = ends[i]
    return [tuple(x) for x in out]


class Finder:
    """Spans of all lines of texts, with a memory of line patterns."""

    def __init__(self, field: CRF):
        self.field, self.memo, self.sentences = field, {}, {}

    def patterns(self, lines: set[str]) -> None:
        """Decode the line patterns not yet known, sentence by sentence."""
        new = [x for x in lines if x not in self.memo]
        if len(self.memo) + len(new) > MEMO_LINES:
            self.memo.clear()
            new = list(lines)
        if len(self.sentences) > MEMO_LINES:
            self.sentences.clear()
        cuts = [[0, *(m.end() for m in _SENTENCE_END.finditer(x)), len(x)] for x in new]
        parts = {x[a:b] for x, c in zip(new, cuts) for a, b in zip(c, c[1:])}
        some = [x for x in parts if x not in self.sentences and x.strip()]
        toks = [tokens_of(x) for x in some]
        for x, labels in zip(some, self.field.decode(toks)):
            self.sentences[x] = tuple(spans_of(labels, *spans_in(x))) if labels is not None and labels.any() else ()
        known = self.sentences
        for x, c in zip(new, cuts):
            self.memo[x] = tuple((a + s, a + e, k) for a, b in zip(c, c[1:]) for s, e, k in known.get(x[a:b], ()))

    def texts(self, texts: list[str | None]) -> list[list[tuple[int, int, int, str]]]:
        """For each text its items (line index, begin, end in the line, kind)."""
        split = [zeroed(t).split("\n") if t else [] for t in texts]
        self.patterns({x for s in split for x in s})
        memo, out = self.memo, []
        for t, s in zip(texts, split):
            items: list = []
            raw = None
            for i, x in enumerate(s):
                found = memo[x]
                if found:
                    raw = raw or t.split("\n")
                    taken: list = []
                    for a, b, kind in found:
                        got = CHECKS[kind](raw[i], a, b)
                        if got and not any(got[0] < q and p < got[1] for p, q, _ in taken):
                            taken.append((*got, kind))
                    items += [(i, a, b, kind) for a, b, kind in sorted(taken)]
            out.append(items)
        return out


_finders: dict[int, Finder] = {}


def _finder(broadcast) -> Finder:
    if broadcast.id not in _finders:
        _finders.clear()
        _finders[broadcast.id] = Finder(broadcast.value)
    return _finders[broadcast.id]


class _Sent:
    """A broadcast field and its number."""

    def __init__(self, spark, field: CRF):
        self.b = spark.sparkContext.broadcast(field)
        self.id = id(field)

    @property
    def value(self):
        return self.b.value


_trained: dict[tuple, CRF] = {}


def field_for(people: DataFrame) -> CRF:
    """The field for a list of people (given_name, family_name), trained once a driver."""
    rows = people.select("given_name", "family_name").filter("given_name is not null and family_name is not null").distinct().orderBy("given_name", "family_name").limit(TRAIN_PEOPLE).collect()  # bound of the labelled rows
    names = tuple((r[0].strip(), r[1].strip()) for r in rows)
    if names not in _trained:
        _trained[names] = train(list(names))
    return _trained[names]


def find_items(docs: DataFrame, field: CRF, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, start, stop, pii_kind) of all items; start and stop in code points of the line.

    Lines count from 1, split at ``\\n``. Null and empty texts have no items; equal rows each give theirs.
    """
    sent = _Sent(docs.sparkSession, field)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = _finder(sent)
        for b in batches:
            rows = []
            for k, items in zip(b["k"], f.texts(list(b["t"]))):
                rows += [(k, i + 1, a, z, what) for i, a, z, what in items]
            yield pd.DataFrame(rows, columns=[key, "line_no", "start", "stop", "pii_kind"])

    return docs.selectExpr(f"`{key}` as k", f"`{text}` as t").filter("t is not null and t <> ''").mapInPandas(run, f"`{key}` {kind}, line_no long, start long, stop long, pii_kind string")


_REST_OF_ADDRESS = re.compile(r"^\s*[^\W\d_][\w .'-]{2,30}(?:,)? (?:[A-Z]{2}\d{1,2} \d[A-Z]{2}|ZZ \d{5}|\d{5})")


def masked_text(text: str, items: list[tuple[int, int, int, str]]) -> str:
    lines = text.split("\n")
    for i, a, b, kind in sorted(items, reverse=True):
        if kind == "address" and not lines[i][b:].strip() and i + 1 < len(lines) and (m := _REST_OF_ADDRESS.match(lines[i + 1])):
            lines[i + 1] = PLACEHOLDER[kind] + lines[i + 1][m.end():]  # the second line of an address
        lines[i] = lines[i][:a] + PLACEHOLDER[kind] + lines[i][b:]
    return "\n".join(lines)


def replace_items(docs: DataFrame, field: CRF, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_items): every text with its items replaced by placeholders, all else unchanged."""
    sent = _Sent(docs.sparkSession, field)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = _finder(sent)
        for b in batches:
            found = f.texts(list(b["t"]))
            yield pd.DataFrame({key: b["k"], "text": [masked_text(t, x) if x else t for t, x in zip(b["t"], found)], "n_items": [len(x) for x in found]})

    return docs.selectExpr(f"`{key}` as k", f"`{text}` as t").mapInPandas(run, f"`{key}` {kind}, text string, n_items long")
