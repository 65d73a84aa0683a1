"""Full-text search over token arrays: documents, queries, ranks and headlines.

A search vector is an array of (word, label, at): the words of the fields in a row,
each with its field's label A to D and its place.  Ranks weigh labels 1, 0.4, 0.2 and
0.1 unless told.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as S

from quern.operators.expressions import Call, Expression, wrap

# The weights of the labels D, C, B, A, and the limit of the sum of 1 / j**2.
LABELS = ("D", "C", "B", "A")
WEIGHTS = (0.1, 0.2, 0.4, 1.0)
SQUARES = math.pi**2 / 6
# Words that the english configuration drops.
STOPS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")


def tokens(*columns: Column) -> Column:
    """Lower-case words of the texts; null texts are skipped."""
    return S.filter(S.split(S.lower(S.concat_ws(" ", *columns)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stem(word: str) -> str:
    """Plurals fold to their singular."""
    for end, exceptions, cut, put in (("ies", ("eies", "aies"), 3, "y"), ("es", ("aes", "ees", "oes"), 1, ""), ("s", ("us", "ss"), 1, "")):
        if word.endswith(end) and len(word) > len(end) + 1:
            return word if word.endswith(exceptions) else word[: len(word) - cut] + put
    return word


def stemmed(w: Column) -> Column:
    """As ``stem``, for a column."""
    long = S.length(w)
    return (
        S.when(w.endswith("ies") & (long > 4), S.when(w.rlike("[ea]ies$"), w).otherwise(S.concat(S.substring(w, S.lit(1), long - 3), S.lit("y"))))
        .when(w.endswith("es") & (long > 3), S.when(w.rlike("[aeo]es$"), w).otherwise(S.substring(w, S.lit(1), long - 1)))
        .when(w.endswith("s") & (long > 2), S.when(w.rlike("[us]s$"), w).otherwise(S.substring(w, S.lit(1), long - 1)))
        .otherwise(w)
    )


def normal(word: str, config: str) -> str | None:
    """A query's word under a configuration; None if it drops it."""
    return word if config == "simple" else None if word in STOPS else stem(word)


def vector(*columns: Column, label: str = "D", config: str = "simple") -> Column:
    if config not in ("simple", "english"):
        raise ValueError(f"unknown search configuration {config!r}")
    words = S.transform(tokens(*columns), lambda w, i: S.struct(w.alias("word"), S.lit(label).alias("label"), (i + 1).alias("at")))
    if config == "simple":
        return words
    return S.transform(S.filter(words, lambda x: ~x["word"].isin(list(STOPS))), lambda x: x.withField("word", stemmed(x["word"])))


class Lexeme:
    """One word of a raw query: a prefix with ``prefix``, of some labels only with ``weight``."""

    def __init__(self, value: str, invert: bool = False, prefix: bool = False, weight: str | None = None):
        if not value:
            raise ValueError("a lexeme has a word")
        if weight is not None and not set(weight.upper()) <= set(LABELS):
            raise ValueError(f"unknown weight {weight!r}")
        self.value, self.invert, self.prefix, self.weight = value.lower(), invert, prefix, weight.upper() if weight else None

    def query(self) -> SearchQuery:
        out = SearchQuery(self.value, "lexeme", lexeme=self)
        return ~out if self.invert else out

    def __and__(self, o: Any) -> SearchQuery: return self.query() & _query(o)
    def __or__(self, o: Any) -> SearchQuery: return self.query() | _query(o)
    def __invert__(self) -> Lexeme: return Lexeme(self.value, not self.invert, self.prefix, self.weight)


def _query(x: Any) -> SearchQuery: return x.query() if isinstance(x, Lexeme) else x


def parsed(text: str) -> SearchQuery:
    """A raw query: words or quoted words, each with ``:*`` and labels, under ``!``, ``&``, ``|``,
    ``<->`` and brackets."""
    steps = re.findall(r"\s*(<->|[&|!()]|'(?:[^'\\]|''|\\.)*'(?::[*A-Da-d]+)?|[^\s&|!()':<]+(?::[*A-Da-d]+)?)", text)
    if re.sub(r"\s", "", "".join(steps)) != re.sub(r"\s", "", text):
        raise ValueError(f"no raw search query: {text!r}")
    steps.append("")

    def either() -> SearchQuery:
        out = both()
        while steps[0] == "|":
            steps.pop(0)
            out = out | both()
        return out

    def both() -> SearchQuery:
        out = row()
        while steps[0] == "&":
            steps.pop(0)
            out = out & row()
        return out

    def row() -> SearchQuery:
        out = one()
        while steps[0] == "<->":
            steps.pop(0)
            out = SearchQuery(f"{out.text} {one().text}", "phrase")
        return out

    def one() -> SearchQuery:
        step = steps.pop(0)
        if step == "!":
            return ~one()
        if step == "(":
            out = either()
            if steps.pop(0) != ")":
                raise ValueError(f"an open bracket: {text!r}")
            return out
        if step in ("", "&", "|", ")", "<->"):
            raise ValueError(f"a word is missing: {text!r}")
        word, _, marks = step.rpartition(":") if re.search(r":[*A-Da-d]+$", step) else (step, "", "")
        if word.startswith("'"):
            word = re.sub(r"\\(.)", r"\1", word[1:-1].replace("''", "'"))
        return Lexeme(word, prefix="*" in marks, weight=marks.replace("*", "") or None).query()

    out = either()
    if steps != [""]:
        raise ValueError(f"no raw search query: {text!r}")
    return out


class SearchQuery:
    """Words to find: ``plain`` needs all, ``phrase`` needs them in a row, ``websearch``
    reads quotes, ``or`` and ``-``, ``raw`` the operators of ``parsed``.  Queries combine
    by ``&``, ``|`` and ``~``."""

    def __init__(self, text: str = "", kind: str = "plain", parts: tuple = (), op: str = "", lexeme: Lexeme | None = None, config: str = "simple"):
        self.text, self.kind, self.parts, self.op, self.lexeme, self.config = text, kind, parts, op, lexeme, config

    def __and__(self, o: SearchQuery) -> SearchQuery: return SearchQuery(parts=(self, o), op="and")
    def __or__(self, o: SearchQuery) -> SearchQuery: return SearchQuery(parts=(self, o), op="or")
    def __invert__(self) -> SearchQuery: return SearchQuery(parts=(self,), op="not")

    def words(self) -> list[str]:
        if self.parts:
            return [] if self.op == "not" else list(dict.fromkeys(w for p in self.parts for w in p.words()))
        return list(dict.fromkeys(re.findall(r"\w+", self.text.lower())))

    def expanded(self) -> SearchQuery:
        """A raw query or a web search as a tree."""
        if self.kind == "raw":
            return parsed(self.text)
        if self.kind != "websearch":
            return self
        choices = []
        for side in re.split(r"\s+or\s+", self.text, flags=re.I):
            terms = [(m[1], SearchQuery(m[2], "phrase") if m[2] is not None else SearchQuery(m[3])) for m in re.finditer(r'(-?)(?:"([^"]*)"|(\S+))', side)]
            tree = None
            for sign, q in terms:
                q = ~q if sign else q
                tree = q if tree is None else tree & q
            if tree is not None:
                choices.append(tree)
        out = choices[0]
        for c in choices[1:]:
            out = out | c
        return out


def matches(t: Column, query: SearchQuery) -> Column:
    """Whether an array of words fits a query."""
    return fits(S.transform(t, lambda w, i: S.struct(w.alias("word"), S.lit("D").alias("label"), (i + 1).alias("at"))), query)


def fits(v: Column, query: SearchQuery) -> Column:
    """Whether a search vector fits a query."""
    query = _query(query).expanded()
    if query.parts:
        found = [fits(v, p) for p in query.parts]
        return ~found[0] if query.op == "not" else found[0] & found[1] if query.op == "and" else found[0] | found[1]
    if query.lexeme:
        return S.size(hits(v, query.lexeme)) > 0
    words = [normal(w, query.config) for w in re.findall(r"\w+", query.text.lower())]
    if not any(words):
        return S.lit(False)
    mine = S.transform(v, lambda x: x["word"])
    if query.kind == "phrase":
        return S.concat(S.lit(" "), S.array_join(mine, " "), S.lit(" ")).contains(" " + " ".join(w for w in words if w) + " ")
    out = S.lit(True)
    for w in words:
        out = out & S.array_contains(mine, w) if w else out
    return out


def hits(v: Column, lexeme: Lexeme) -> Column:
    """The entries of a vector that a lexeme means."""
    def mean(x: Column) -> Column:
        word = x["word"].startswith(lexeme.value) if lexeme.prefix else x["word"] == lexeme.value
        return word & x["label"].isin(list(lexeme.weight)) if lexeme.weight else word

    return S.filter(v, mean)


def leaves(query: Any) -> list[Lexeme]:
    """The lexemes that a query wants, each once."""
    query = _query(query).expanded()
    if query.parts:
        found = [] if query.op == "not" else [x for p in query.parts for x in leaves(p)]
    elif query.lexeme:
        found = [query.lexeme]
    else:
        found = [Lexeme(w) for x in re.findall(r"\w+", query.text.lower()) if (w := normal(x, query.config))]
    return list({(x.value, x.prefix, x.weight): x for x in found}.values())


def rank(v: Column, query: Any, weights: Sequence[float] = WEIGHTS, normalization: int = 0) -> Column:
    """How well a vector fits: for words that are all wanted, by the nearness of each two of
    them, else by how often each occurs, where the j-th place of a word counts 1 / j**2 of
    its label's weight.  ``normalization`` adds up 1 (logarithm of the length), 2 (length),
    8 (distinct words), 16 (their logarithm) and 32 (r / (r + 1))."""
    wanted, tree = leaves(query), _query(query).expanded()
    if not wanted:
        return S.lit(0.0)
    weight = S.create_map(*[S.lit(x) for pair in zip(LABELS, map(float, weights), strict=True) for x in pair])
    found = [S.transform(hits(v, x), lambda e: S.struct(weight[e["label"]].alias("w"), e["at"].alias("at"))) for x in wanted]
    every = tree.op == "and" if tree.parts else not tree.lexeme
    if every and len(wanted) > 1:
        out = S.lit(1.0)
        for i, a in enumerate(found):
            for b in found[:i]:
                out = out * _apart(a, b)
        out = 1 - out
    else:
        out = S.lit(0.0)
        for a in found:
            best = S.array_max(S.transform(a, lambda x, i: S.struct(x["w"].alias("w"), (-i).alias("i"))))
            all_ = S.aggregate(S.transform(a, lambda x, i: x["w"] / ((i + 1) * (i + 1))), S.lit(0.0), lambda r, x: r + x)
            out = out + S.coalesce(all_ + best["w"] - best["w"] / ((1 - best["i"]) * (1 - best["i"])), S.lit(0.0)) / SQUARES
        out = out / len(wanted)
    length, kinds = S.greatest(S.size(v), S.lit(1)), S.greatest(S.size(S.array_distinct(S.transform(v, lambda x: x["word"]))), S.lit(1))
    for bit, by in ((1, S.log2(length + 1)), (2, length), (8, kinds), (16, S.log2(kinds + 1))):
        out = out / by if normalization & bit else out
    return out / (out + 1) if normalization & 32 else out


def _apart(a: Column, b: Column) -> Column:
    """The product over all places of two words of what their nearness leaves."""
    def one(x: Column) -> Column:
        return S.aggregate(b, S.lit(1.0), lambda r, y: r * (1 - S.sqrt(x["w"] * y["w"] * near(S.abs(x["at"] - y["at"])))))

    return S.aggregate(a, S.lit(1.0), lambda r, x: r * one(x))


def near(distance: Column) -> Column:
    """What two words so far apart count: 1 / (1.005 + 0.05 e**(d / 1.5 - 2)), all but nothing beyond 100 places."""
    return S.when((distance > 100) | (distance == 0), 1e-30).otherwise(1 / (1.005 + 0.05 * S.exp(distance / 1.5 - 2)))


def density(v: Column, query: Any) -> Column:
    """How often the query's words occur for each word of the document."""
    words = [x.value for x in leaves(query)]
    return S.size(S.filter(v, lambda x: x["word"].isin(words))) / S.greatest(S.size(v), S.lit(1))


class SearchVector(Expression):
    """A searchable document of fields; ``+`` joins vectors, places of the second after those of the first."""

    def __init__(self, *fields: Any, weight: str = "D", config: str = "simple"):
        if weight not in LABELS:
            raise ValueError(f"unknown weight {weight!r}")
        self.children, self.weight, self.config = tuple(wrap(f) for f in fields), weight, config

    def column(self, ctx: Any) -> Column:
        return vector(*(c.column(ctx) for c in self.children), label=self.weight, config=self.config)

    def __add__(self, other: Any) -> Expression:
        return Call("search_vectors", joined, self, other)


def joined(a: Column, b: Column) -> Column:
    last = S.coalesce(S.array_max(S.transform(a, lambda x: x["at"])), S.lit(0))
    return S.concat(a, S.transform(b, lambda x: x.withField("at", x["at"] + last)))


def SearchMatch(vector: Any, query: Any) -> Expression: return Call("search_match", lambda v: fits(v, query), vector)
def SearchDensity(vector: Any, query: Any) -> Expression: return Call("search_density", lambda v: density(v, query), vector)
def SearchRank(vector: Any, query: Any, weights: Sequence[float] = WEIGHTS, normalization: int = 0) -> Expression: return Call("search_rank", lambda v: rank(v, query, weights, normalization), vector)


def SearchHeadline(x: Any, query: Any, start: str = "<b>", stop: str = "</b>", max_words: int | None = None, short_word: int = 0) -> Expression:
    """The text with the query's words marked; with ``max_words`` only the first run of so
    many words that holds the most of them, less words of up to ``short_word`` letters at its ends."""
    words = "|".join(re.escape(w.value) + (r"\w*" if w.prefix else "") for w in leaves(query))

    def build(c: Column) -> Column:
        if max_words is not None:
            pieces = S.filter(S.split(c, r"\s+"), lambda w: w != "")
            flags = S.transform(pieces, lambda w: w.rlike(rf"(?i)\b({words})\b").cast("int"))
            starts = S.sequence(S.lit(1), S.greatest(S.size(pieces) - max_words + 1, S.lit(1)))
            best = S.array_max(S.transform(starts, lambda i: S.struct(S.aggregate(S.slice(flags, i, max_words), S.lit(0), lambda a, f: a + f).alias("n"), (-i).alias("i"))))
            c = S.array_join(S.slice(pieces, -best["i"], max_words), " ")
            if short_word:
                c = S.trim(S.regexp_replace(c, rf"^(\S{{1,{short_word}}}\s+)+|(\s+\S{{1,{short_word}}})+$", ""))
        return S.regexp_replace(c, rf"(?i)\b({words})\b", f"{start}$1{stop}") if words else c

    return Call("search_headline", build, x)


def _same(word: str) -> Any:
    return lambda x: x == word


def bm25(df: Any, id_col: str, text_col: str, query: SearchQuery, k1: float = 1.2, b: float = 0.75) -> Any:
    """(id, score) of the documents that have a word of the query.  Document counts and
    mean length come from one aggregate over the corpus."""
    words = [x.value for x in leaves(query)]
    rows = df.select(S.col(id_col).alias("id"), tokens(S.col(text_col)).alias("t")).select(
        "id", S.size("t").alias("n"), *[S.size(S.filter("t", _same(w))).alias(f"f{i}") for i, w in enumerate(words)])
    stats = rows.agg(S.count("*").alias("docs"), S.avg("n").alias("mean"), *[S.sum((S.col(f"f{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(words))])
    score = S.lit(0.0)
    for i in range(len(words)):
        idf = S.ln(1 + (S.col("docs") - S.col(f"d{i}") + 0.5) / (S.col(f"d{i}") + 0.5))
        f = S.col(f"f{i}").cast("double")
        score = score + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * S.col("n") / S.col("mean")))
    return rows.join(S.broadcast(stats)).select("id", score.alias("score")).where("score > 0")  # one row of statistics
