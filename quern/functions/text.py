"""Text functions, and the trigram, label-path and accent helpers built on them."""

from __future__ import annotations

import unicodedata
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as S

from quern.operators.expressions import Call, Expression, Value, wrap


def _plain(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))


#: Letters with marks, and what is left without them, by Unicode's decompositions.
ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x2000)) if len(_plain(c)) == 1 and _plain(c) != c)
PLAIN = "".join(map(_plain, ACCENTED))


def literal(x: Any) -> Expression:
    return x if isinstance(x, Expression) else Value(x)


def Lower(x: Any) -> Expression: return Call("lower", S.lower, x)
def Upper(x: Any) -> Expression: return Call("upper", S.upper, x)
def Trim(x: Any) -> Expression: return Call("trim", S.trim, x)
def LTrim(x: Any) -> Expression: return Call("ltrim", S.ltrim, x)
def RTrim(x: Any) -> Expression: return Call("rtrim", S.rtrim, x)
def Reverse(x: Any) -> Expression: return Call("reverse", S.reverse, x)


def Length(x: Any) -> Expression:
    """Characters of text, bytes of binary, as a long."""
    return Call("length", lambda c: S.length(c).cast("long"), x)


def Left(x: Any, n: Any) -> Expression:
    """The first n characters; a negative n drops that many from the end."""
    def build(c: Column, n: Column) -> Column:
        return S.substring(c, S.lit(1), S.when(n < 0, S.greatest(S.length(c) + n, S.lit(0))).otherwise(n))
    return Call("left", build, x, literal(n))


def Right(x: Any, n: Any) -> Expression:
    """The last n characters; a negative n drops that many from the start."""
    def build(c: Column, n: Column) -> Column:
        size = S.when(n < 0, S.greatest(S.length(c) + n, S.lit(0))).otherwise(S.least(n, S.length(c)))
        return S.substring(c, S.length(c) - size + 1, size)
    return Call("right", build, x, literal(n))


def Substr(x: Any, position: Any, length: Any = None) -> Expression:
    """From a 1-based position; places before the first count as empty."""
    def build(c: Column, p: Column, *n: Column) -> Column:
        first = S.greatest(p, S.lit(1))
        size = (S.greatest(p + n[0] - first, S.lit(0))) if n else S.length(c)
        return S.substring(c, first, size)
    return Call("substr", build, x, literal(position), *([] if length is None else [literal(length)]))


def StrIndex(x: Any, part: Any) -> Expression: return Call("strindex", lambda c, p: S.call_function("instr", c, p).cast("long"), x, literal(part))
def Replace(x: Any, old: Any, new: Any = "") -> Expression: return Call("replace", S.replace, x, literal(old), literal(new))
def Repeat(x: Any, n: Any) -> Expression: return Call("repeat", lambda c, n: S.call_function("repeat", c, n), x, literal(n))
def LPad(x: Any, n: Any, fill: Any = " ") -> Expression: return Call("lpad", lambda c, n, f: S.call_function("lpad", c, n, f), x, literal(n), literal(fill))
def RPad(x: Any, n: Any, fill: Any = " ") -> Expression: return Call("rpad", lambda c, n, f: S.call_function("rpad", c, n, f), x, literal(n), literal(fill))
def Ord(x: Any) -> Expression: return Call("ord", S.ascii, x)


def Chr(x: Any) -> Expression:
    """The character of a code point, also beyond one byte."""
    def build(c: Column) -> Column:
        return S.decode(S.unhex(S.lpad(S.hex(c.cast("long")), 8, "0")), "UTF-32")
    return Call("chr", build, x)


def MD5(x: Any) -> Expression: return Call("md5", S.md5, x)
def SHA1(x: Any) -> Expression: return Call("sha1", S.sha1, x)
def SHA224(x: Any) -> Expression: return Call("sha224", lambda c: S.sha2(c, 224), x)
def SHA256(x: Any) -> Expression: return Call("sha256", lambda c: S.sha2(c, 256), x)
def SHA384(x: Any) -> Expression: return Call("sha384", lambda c: S.sha2(c, 384), x)
def SHA512(x: Any) -> Expression: return Call("sha512", lambda c: S.sha2(c, 512), x)


def Concat(*xs: Any) -> Expression:
    """Texts joined; nulls are skipped."""
    return Call("concat", lambda *c: S.concat_ws("", *[x.cast("string") for x in c]), *xs)


def unaccent(c: Column) -> Column:
    return S.translate(c, ACCENTED, PLAIN)


def trigrams(c: Column) -> Column:
    """The distinct trigrams of each word, padded by two blanks before and one after."""
    words = S.filter(S.split(S.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = S.transform(words, lambda w: S.concat(S.lit("  "), w, S.lit(" ")))
    grams = S.transform(padded, lambda w: S.transform(S.sequence(S.lit(1), S.length(w) - 2), lambda i: S.substring(w, i, S.lit(3))))
    return S.array_distinct(S.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams."""
    ta, tb = trigrams(a), trigrams(b)
    return S.coalesce(S.size(S.array_intersect(ta, tb)) / S.nullif(S.size(S.array_union(ta, tb)), S.lit(0)), S.lit(0.0))


def trigram_word_similarity(word: Column, c: Column) -> Column:
    """The best similarity of the word's trigrams to one word of the text."""
    words = S.filter(S.split(S.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return S.coalesce(S.array_max(S.transform(words, lambda w: trigram_similarity(word, w))), S.lit(0.0))


def TrigramSimilarity(x: Any, other: Any) -> Expression: return Call("trigram_similarity", trigram_similarity, x, literal(other))
def TrigramDistance(x: Any, other: Any) -> Expression: return Call("trigram_distance", lambda a, b: 1 - trigram_similarity(a, b), x, literal(other))
def TrigramWordSimilarity(word: Any, x: Any) -> Expression: return Call("trigram_word_similarity", trigram_word_similarity, literal(word), wrap(x))
def TrigramWordDistance(word: Any, x: Any) -> Expression: return Call("trigram_word_distance", lambda a, b: 1 - trigram_word_similarity(a, b), literal(word), wrap(x))


def trigram_strict_similarity(words: Column, c: Column) -> Column:
    """The best similarity to a run of whole words of the text, at most as many as there are in ``words`` and one more."""
    split = S.filter(S.split(S.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    most = S.size(S.filter(S.split(S.lower(words), r"[^\p{L}\p{N}]+"), lambda w: w != "")) + 1
    runs = S.flatten(S.transform(split, lambda _, i: S.transform(S.sequence(S.lit(1), S.least(most, S.size(split) - i)), lambda n: S.array_join(S.slice(split, i + 1, n), " "))))
    return S.coalesce(S.array_max(S.transform(runs, lambda r: trigram_similarity(words, r))), S.lit(0.0))


def TrigramStrictWordSimilarity(words: Any, x: Any) -> Expression: return Call("trigram_strict_similarity", trigram_strict_similarity, literal(words), wrap(x))
def TrigramStrictWordDistance(words: Any, x: Any) -> Expression: return Call("trigram_strict_distance", lambda a, b: 1 - trigram_strict_similarity(a, b), literal(words), wrap(x))


def RandomUUID() -> Expression: return Call("uuid", S.uuid)


def RandomHex(size: int = 16) -> Expression:
    """Random bytes in hexadecimal."""
    return Call("random_hex", lambda: S.substring(S.lower(S.concat(*[S.lpad(S.hex((S.rand() * 2**32).cast("long")), 8, "0") for _ in range(-(-size // 4))])), 1, 2 * size))


def UuidV7() -> Expression:
    """A uuid that sorts by the time it was made."""
    def build() -> Column:
        time = S.lpad(S.lower(S.hex(S.unix_millis(S.current_timestamp()))), 12, "0")
        tail = S.lower(S.concat(*[S.lpad(S.hex((S.rand() * 2**32).cast("long")), 8, "0") for _ in range(3)]))
        return S.concat_ws("-", S.substring(time, 1, 8), S.substring(time, 9, 4), S.concat(S.lit("7"), S.substring(tail, 1, 3)), S.concat(S.lit("8"), S.substring(tail, 4, 3)), S.substring(tail, 7, 12))
    return Call("uuid7", build)


def is_ancestor(a: Column, b: Column) -> Column:
    """Whether label path a is b or above it."""
    return (a == b) | b.startswith(S.concat(a, S.lit(".")))


def lquery(pattern: str) -> str:
    """A label-path pattern as a regular expression: ``*`` is any labels, ``a|b`` a choice."""
    out = []
    for part in pattern.split("."):
        out.append(r"(?:[^.]+(?:\.|$))*" if part == "*" else rf"(?:{part})(?:\.|$)")
    return "^" + "".join(out) + "$"


def Subpath(x: Any, offset: int, length: int | None = None) -> Expression:
    """Labels of a path from an offset; a negative one counts from the end."""
    def build(c: Column) -> Column:
        labels = S.split(c, r"\.")
        start = S.lit(offset) if offset >= 0 else S.size(labels) + offset
        n = S.size(labels) - start if length is None else S.lit(length) if length >= 0 else S.size(labels) - start + length
        return S.array_join(S.slice(labels, start + 1, S.greatest(n, S.lit(0))), ".")
    return Call("subpath", build, x)
