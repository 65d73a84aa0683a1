"""Personal data by anchor expansion.

An Aho-Corasick automaton finds cues in one pass over the text: at-signs, plus
signs, digits, URL schemes and identifier words.  From each cue a deterministic
parser expands left and right to the longest span of its kind and validates it.
No parser reads a character more than a fixed number of times, whatever the text,
so time grows in line with its length.

Kinds, in order: ``email``, ``ip``, ``card``, ``phone``; then two that the method
adds: ``url`` (an address that carries a user's name or password) and ``account``
(an identifier that follows a cue word such as iban, passport or token).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]

# The characters of the base kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
DIGITS = frozenset("0123456789")
PHONE = frozenset(" ().0123456789-")
# URL schemes and words that announce an identifier.
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
IDENTIFIERS = (
    "iban", "account", "acct", "passport", "ssn", "token", "secret", "password", "api_key", "apikey", "api key", "customer id", "user id",
)

# Words that may stand between an identifier's cue and its sign.
LINKS = ("number", "no.", "no", "id", "key")

_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{7,}")
_URL_END = re.compile(r"[\x00-\x20<>\"']")
_AUTHORITY_END = re.compile(r"[/?#]")
Span = tuple[int, int, str]


def automaton(identifiers: tuple[str, ...] = IDENTIFIERS) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for cue in ("@", "+"):
        a.add_word(cue, (cue, 1))
    for digit in sorted(DIGITS):
        a.add_word(digit, ("0", 1))
    for scheme in SCHEMES:
        a.add_word(scheme, ("url", len(scheme)))
    for word in identifiers:
        for form in {word, word.upper(), word.capitalize()}:
            a.add_word(form, ("account", len(form)))
    a.make_automaton()
    return a


_cues: dict[tuple[str, ...], ahocorasick.Automaton] = {}


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at`` that begins at ``floor`` or later."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    n, end, labels, i = len(text), 0, 0, at + 1
    while True:
        first = i
        while i < n and text[i] in LABEL:
            i += 1
        if i == first:
            break
        labels, end = labels + 1, i
        if i >= n or text[i] != ".":
            break
        i += 1
    return (start, end) if labels >= 2 else None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def phone_at(text: str, plus: int) -> tuple[int, int] | None:
    """The longest number after the plus sign at ``plus``."""
    n, first = len(text), plus + 2
    if plus + 1 >= n or text[plus + 1] not in DIGITS:
        return None
    i = first
    while i < n and text[i] in PHONE:
        i += 1
    while i > first and text[i - 1] not in DIGITS:
        i -= 1
    return (plus, i) if i - first >= 2 else None


def url_at(text: str, start: int, after: int, end: int) -> tuple[int, int] | None:
    """A URL with user information before its host; ``end`` is where its characters end."""
    stop = _AUTHORITY_END.search(text, after, end)
    user, sign, host = text[after : stop.start() if stop else end].rpartition("@")
    return (start, end) if sign and user and host else None


def account_after(text: str, after: int) -> tuple[int, int] | None:
    """An identifier of eight characters or more, with a digit, that a cue word announces."""
    n, at = len(text), after

    def blanks(at: int) -> int:
        while at < n and text[at].isspace():
            at += 1
        return at

    at = blanks(at)
    for word in LINKS:
        if text.startswith(word, at):
            at = blanks(at + len(word))
            break
    if at >= n or text[at] not in ":=#":
        return None
    at = blanks(at + 1)
    if at < n and text[at] in "\"'":
        at += 1
    token = _TOKEN.match(text, at)
    if not token or not any(c in DIGITS for c in token[0]):
        return None
    return token.span()


def _groups(runs: list[tuple[int, int]], text: str, joins: str):
    """Runs of digits chained by exactly one character of ``joins``."""
    chain: list[tuple[int, int]] = []
    for run in runs:
        if chain and run[0] == chain[-1][1] + 1 and text[chain[-1][1]] in joins:
            chain.append(run)
        else:
            if chain:
                yield chain
            chain = [run]
    if chain:
        yield chain


def find(text: str, identifiers: tuple[str, ...] = IDENTIFIERS) -> list[Span]:
    """(start, end, kind) of every span, by start, then kind as in KINDS."""
    if identifiers not in _cues:
        _cues[identifiers] = automaton(identifiers)
    url_end = 0  # where the characters of the last URL looked at end
    spans: list[Span] = []
    runs: list[tuple[int, int]] = []
    last = {"email": 0, "phone": 0, "url": 0, "account": 0}
    for at, (cue, width) in _cues[identifiers].iter(text):
        start = at - width + 1
        if cue == "0":
            if runs and runs[-1][1] == at:
                runs[-1] = (runs[-1][0], at + 1)
            else:
                runs.append((at, at + 1))
            continue
        if cue == "@":
            kind, found = "email", email_at(text, at, last["email"])
        elif cue == "+":
            kind, found = "phone", phone_at(text, at) if at >= last["phone"] else None
            if found:
                last[kind] = found[1]
                if not 9 <= sum(c in DIGITS for c in text[found[0] : found[1]]) <= 15:
                    found = None
        elif cue == "url":
            kind, found = cue, None
            if start >= last["url"]:
                if start >= url_end:
                    stop = _URL_END.search(text, at + 1)
                    url_end = stop.start() if stop else len(text)
                found = url_at(text, start, at + 1, url_end)
        else:
            kind, found = cue, None
            if start >= last["account"] and not (start and (text[start - 1].isalnum())):
                found = account_after(text, at + 1)
        if found:
            last[kind] = found[1]
            spans.append((*found, kind))
    for chain in _groups(runs, text, "."):
        for i in range(0, len(chain) - 3, 4):
            four = chain[i : i + 4]
            if all(int(text[s:e][-4:]) <= 255 and not text[s : max(s, e - 4)].strip("0") for s, e in four):
                spans.append((four[0][0], four[3][1], "ip"))
    for chain in _groups(runs, text, " -"):
        digits = "".join(text[s:e] for s, e in chain)
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((chain[0][0], chain[-1][1], "card"))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[0], order[s[2]], s[1]))


def told(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """(id, spans): spans are (kind, start, end) in code points, end exclusive.

    ``identifiers`` are the words that announce an account, read as given, in
    capitals and capitalised.

    Null and empty texts have none; an empty table gives no rows; repeated rows
    are read one by one; spans of one start come in the order of KINDS; extra
    columns are not read.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("id", to_arrow_type(source.schema["id"].dataType)), ("spans", pa.list_(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in find(t or "", identifiers)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], schema=schema)

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def base_digest(spans: list[Span]) -> str:
    return hashlib.sha256(told([s for s in spans if s[2] in BASE]).encode()).hexdigest()


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with each span replaced by its kind in angle brackets; spans that
    overlap an earlier one vanish with it.

    A null text stays null and an empty one empty; an empty table gives no rows;
    repeated rows are masked one by one; extra columns are not read, so their names
    cannot clash.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("id", to_arrow_type(source.schema["id"].dataType)), ("text", pa.string())])

    def masked(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for start, end, kind in find(text):
            if start >= at:
                out += [text[at:start], f"<{kind}>"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(masked, batch.column(1).to_pylist()), pa.string())], schema=schema)

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, text string")
