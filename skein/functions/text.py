"""Text functions as column builders: everything runs in generated code or higher-order functions, without Python workers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CJK ideographs as the token estimate counts them.
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{20000}-\x{2a6df}\x{2a700}-\x{2b73f}\x{2b740}-\x{2b81f}\x{2b820}-\x{2ceaf}\x{f900}-\x{faff}]"
_RUNS = r"[a-zA-Z0-9]+|[一-鿿]+"


def let(f, **values: Column) -> Column:
    """f of a struct of values, each computed once: an expression inside a lambda would be computed again for every element."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f)[0]


def plain_tokens(text: Column) -> Column:
    """Lower-cased Latin words and CJK runs, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(_RUNS), F.lit(0))


def _bigrams(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: run.substr(i, F.lit(2)))


def tokens(text: Column) -> Column:
    """plain_tokens with each CJK run of two characters or more followed by its bigrams."""
    wide = lambda t: t.rlike(r"^[一-鿿]{2,}$")
    expanded = F.flatten(F.transform(plain_tokens(text), lambda t: F.when(wide(t), F.concat(F.array(t), _bigrams(t))).otherwise(F.array(t))))
    return F.when(text.rlike(r"[一-鿿]{2}"), expanded).otherwise(plain_tokens(text))


def latin_first_tokens(text: Column) -> Column:
    """All Latin words, then CJK runs with their bigrams."""
    low = F.lower(text)
    latin = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(r"[一-鿿]+"), F.lit(0))
    wide = F.flatten(F.transform(runs, lambda t: F.when(F.length(t) >= 2, F.concat(F.array(t), _bigrams(t))).otherwise(F.array(t))))
    return F.when(text.rlike(r"[一-鿿]"), F.concat(latin, wide)).otherwise(latin)


def is_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def token_estimate(text: Column) -> Column:
    """CJK characters plus white-space separated words; a CJK run counts as a word too."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.regexp_count(text, F.lit(CJK)) + F.regexp_count(text, F.lit(r"\S+")))


def sentences(text: Column) -> Column:
    """Pieces ending in a full stop, question or exclamation mark or semicolon (ASCII or full-width), blank ones dropped."""
    return F.filter(F.split(text, r"(?<=[。！？；.!?;])\s*"), lambda s: F.trim(s) != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def _set_score(q: Column, c: Column, query: Column, content: Column, bonus: float) -> Column:
    extra = F.when(F.contains(F.lower(content), F.lower(query)), bonus).otherwise(0.0)
    share = let(lambda x: F.when((F.size(x["q"]) == 0) | (F.size(x["c"]) == 0), F.lit(None)).otherwise(jaccard(x["q"], x["c"])), q=q, c=c)
    return F.when(share.isNull(), 0.0).otherwise(F.least(F.lit(1.0), share + extra))


def keyword_score(query: Column, content: Column) -> Column:
    """Jaccard of expanded tokens, 0.15 more if the query is a substring, at most 1; 0 if either has no token."""
    return _set_score(F.array_distinct(tokens(query)), F.array_distinct(tokens(content)), query, content, 0.15)


def memory_relevance(query: Column, content: Column) -> Column:
    """Jaccard of plain tokens with a bonus of 0.1 for a substring, at most 1; 0 if either has no token."""
    return _set_score(F.array_distinct(plain_tokens(query)), F.array_distinct(plain_tokens(content)), query, content, 0.1)


def coverage(query: Column, content: Column) -> Column:
    """Share of the query's tokens, repeats included, that the content has."""
    met = let(lambda x: F.when(F.size(x["q"]) == 0, 0.0).otherwise(F.size(F.filter(x["q"], lambda t: F.array_contains(x["c"], t))) / F.size(x["q"])), q=latin_first_tokens(query), c=F.array_distinct(latin_first_tokens(content)))
    return F.coalesce(met, F.lit(0.0))


def hits(text: Column, words: Sequence[str], fold: bool = True) -> Column:
    """How many of the words the text contains; fold: words are lower-cased first (the text is the caller's)."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w.lower() if fold else w)).cast("int")
    return total


def best_class(text: Column, classes: Mapping[str, Sequence[str]], default: str | None) -> Column:
    """The class with the most words contained, the first declared of equal ones; `default` where none is."""
    low = F.lower(text)
    scores = {name: hits(low, words) for name, words in classes.items()}
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.when(top == 0, F.lit(default))
    for name, score in scores.items():
        out = out.when(score == top, F.lit(name))
    return out


#: Space separators of Unicode, which SQL's trim takes.
_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def title(text: Column) -> Column:
    """The first line that isn't blank, without leading # and *, if it has 4 to 99 characters."""
    first = F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_SPACES))), lambda x: x != ""), F.lit(0))  # null if all are blank
    clean = F.regexp_replace(first, r"^[#*]+[ \t\n\f\r]*", "")
    return F.when((F.length(clean) > 3) & (F.length(clean) < 100), clean)


def tags(text: Column, known: Sequence[str]) -> Column:
    """The known tags that the text contains, in the list's order. (Words of the title are part of the text.)"""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(t) for t in known]), lambda t: F.contains(low, F.lower(t)))


def query_tags(query: Column, patterns: Mapping[str, Sequence[str]]) -> Column:
    low = F.lower(query)
    found = [F.when(hits(low, words) > 0, F.lit(tag)) for tag, words in patterns.items()]
    return F.array_compact(F.array(*found))


def clean_query(query: Column, doc_type: Column, classes: Mapping[str, Sequence[str]]) -> Column:
    """The query without its class's words, white space squeezed; the query itself if nothing is left or no class was found."""
    out = query
    for name, words in classes.items():
        cleaned = query
        for w in words:
            cleaned = F.regexp_replace(cleaned, F.lit("(?i)" + "".join("\\" + c if not c.isalnum() else c for c in w)), F.lit(""))
        cleaned = F.trim(F.regexp_replace(cleaned, r"\s+", " "))
        out = F.when(doc_type == name, F.when(cleaned == "", query).otherwise(cleaned)).otherwise(out)
    return out


def list_item(line: Column) -> Column:
    """A line without its marker: digits, Chinese numerals or bullets."""
    return F.trim(F.regexp_replace(F.trim(line), r"^(?:\d+[.、)）:：]|[一二三四五六七八九十]+[、.．]|[-*•·])\s*", ""))


def fingerprint(*parts: Column) -> Column:
    """The first 16 hex digits of the MD5 of the parts joined with |."""
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 16)


def clip(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def distinct_variants(variants: Column) -> Column:
    """Trimmed, without blank ones, first of equal ones kept in order."""
    return F.array_distinct(F.filter(F.transform(variants, lambda x: F.trim(x)), lambda x: x != ""))


def file_keywords(name: Column) -> Column:
    """Up to eight parts of a file name of two characters or more, without the extension."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.slice(F.filter(F.split(stem, r"[-_.\s]+"), lambda x: F.length(x) >= 2), 1, 8)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def by_extension(path: Column, table: Mapping[str, str], default: str = "text") -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), extension(path)), F.lit(default))


def data_uri(content: Column, mime: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def tool_calls(text: Column) -> Column:
    """(name, input) of every [TOOL_CALL:name:input] in a text."""
    names = F.regexp_extract_all(text, F.lit(r"\[TOOL_CALL:([^:\]]+):([^\]]*)\]"), F.lit(1))
    inputs = F.regexp_extract_all(text, F.lit(r"\[TOOL_CALL:([^:\]]+):([^\]]*)\]"), F.lit(2))
    return F.zip_with(names, inputs, lambda n, i: F.struct(F.trim(n).alias("name"), F.trim(i).alias("input")))


def finish_answer(text: Column) -> Column:
    """The answer inside Finish[...], else null."""
    got = F.regexp_extract(text, r"(?s)Finish\[(.*)\]", 1)
    return F.when(text.rlike(r"(?s)Finish\[.*\]"), got)


def first_number(text: Column, low: float, high: float) -> Column:
    """The first number in a text, held between low and high; null where there is none."""
    got = F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1)
    return F.when(got != "", F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), got.cast("double"))))


def unsafe_command(command: Column, allowed: Sequence[str], blocked: Sequence[str]) -> Column:
    """Why a shell command is refused: newline, metacharacter, blocked word, unknown program; null if it is allowed."""
    first = F.element_at(F.split(F.trim(command), r"\s+"), 1)
    low = F.lower(command)
    return (
        F.when(F.coalesce(F.trim(command), F.lit("")) == "", "empty")
        .when(command.rlike(r"[\n\r]"), "newline")
        .when(command.rlike(r"[;&|`$<>(){}]"), "metacharacter")
        .when(F.exists(F.array(*[F.lit(b) for b in blocked]), lambda b: F.contains(low, b)) if blocked else F.lit(False), "blocked")
        .when(~first.isin(*allowed), "unknown program")
    )
