"""Text functions: Column in, Column out, all in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = ("a", "an", "and", "by", "for", "fund", "in", "is", "of", "on", "or", "plan", "scheme", "the", "to", "with")
ABBREVIATIONS = {"eco": "economy", "std": "standard", "prm": "promo", "wdg": "widget", "sm": "small", "lg": "large"}
_SPACES = "\u00a0\u2002\u2003\u2007\u2009\u202f\u3000"
_DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212"


def tokens(c: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Lower-case runs of letters and digits, in order, repeats kept, without one-letter tokens and stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*stopwords))


def expand(c: Column, words: Mapping[str, str] = ABBREVIATIONS) -> Column:
    """Whole tokens replaced by what they stand for, joined with spaces."""
    lookup = F.create_map(*(F.lit(x) for pair in sorted(words.items()) for x in pair))
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_join(F.transform(found, lambda t: F.coalesce(F.try_element_at(lookup, t), t)), " ")


def overlap(a: Column, b: Column) -> Column:
    """Distinct tokens that two token lists share."""
    return F.size(F.array_intersect(a, b))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def norm_ws(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def unicode_norm(c: Column) -> Column:
    """Unusual spaces and dashes as plain ones, lower case."""
    return F.lower(F.translate(c, _SPACES + _DASHES, " " * len(_SPACES) + "-" * len(_DASHES)))


def truncated(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("...[truncated]"))).otherwise(c)


def prefix_before(c: Column, stops: Sequence[str]) -> Column:
    """The text before the first stop word in order of the list that occurs as a whole word; the whole text without one; empty: null."""
    out = F.nullif(F.trim(c), F.lit(""))
    for stop in reversed(stops):
        out = F.when(c.rlike(rf"\b{stop}\b"), F.nullif(F.trim(F.regexp_extract(c, rf"^(.*?)\b{stop}\b", 1)), F.lit(""))).otherwise(out)
    return out


def first_label(c: Column, labels: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first (substring, label) whose substring is in the lower-case text."""
    low, out = F.lower(c), F.lit(default)
    for part, label in reversed(labels):
        out = F.when(low.contains(part), F.lit(label)).otherwise(out)
    return out


def contains_either_way(a: Column, b: Column) -> Column:
    """Trimmed lower-case a is in b or b in a; an empty side never matches."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"-?\d+(?:\.\d+)?", 0), F.lit("")).cast("double")


def marked_call(c: Column) -> tuple[Column, Column]:
    """(name, arguments) of the first <function=NAME {...}</function> mark; null without one."""
    pattern = r"(?s)<function=(\w+)\s*(\{.*?\})\s*</function>"
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")), F.nullif(F.regexp_extract(c, pattern, 2), F.lit(""))


def split_by_band(words: Column, x: Column) -> tuple[Column, Column]:
    """Texts of an array of (text, x0) left of x, and from x on, joined."""
    join = lambda keep: F.array_join(F.transform(F.filter(words, keep), lambda w: w["text"]), " ")
    return join(lambda w: w["x0"] < x), join(lambda w: w["x0"] >= x)


def contains_all(text: Column, parts: Column) -> Column:
    """Every part, normalised, is in the normalised text."""
    low = norm_ws(unicode_norm(text))
    return F.forall(parts, lambda p: low.contains(norm_ws(unicode_norm(p))))
