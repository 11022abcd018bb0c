"""Quality rules: text statistics and a learned decision list over them.

`text_statistics` counts each whole text once, in Python batches. `learn` fits an
ordered list of threshold conjunctions by sequential covering: a rule grows by FOIL
gain on two thirds of the labelled rows, is pruned on the other third and is kept
while it is precise there. `as_column` emits the list as one Spark conditional
expression, so that applying it needs no Python.

Defined cases: a null text counts as an empty one; texts with no word have all counts
zero; a repeated row is judged as often as it comes; an empty table gives an empty
result; columns other than doc_id and text are ignored. Learning reads at most
SAMPLE_ROWS labelled rows; of rows that share a doc_id the one with the least features
takes part; with no label of a class the list is empty and everything
passes it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded_labels, map_texts, table

#: Labelled rows that learning reads at most: statistics of these few columns go to the driver.
SAMPLE_ROWS = 20_000
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct", "n_marks", "n_digits", "top_word")
#: What the rules look at, as ratios of the counts.
FEATURES = ("n_words", "symbols_per_word", "chars_per_word", "dup_line_share", "repeat_share", "upper_share", "distinct_share", "marks_per_word", "digit_share", "top_word_share", "words_per_line")


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window found twice or more; ids: one number a distinct word."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    # Windows as numbers of their own: each doubling of the length ranks pairs of ranks, so equal numbers are equal windows.
    rank, length = ids.astype(np.int64), 1
    while length < window:
        step = min(length, window - length)
        a, b = rank[: len(rank) - step], rank[step:]
        _, rank = np.unique(a * (int(rank.max()) + 1) + b, return_inverse=True)
        length += step
    counts = np.bincount(rank)
    twice = counts[rank] >= 2
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly \x20 and \x09-\x0D
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128).tolist()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return (
        len(words),
        len(text) - sum(count[ord(c)] for c in SPACES),
        sum(count[ord(c)] for c in SYMBOLS),
        dup,
        repeated_words(ids),
        lines,
        sum(count[65:91]),
        len(number),
        sum(count[ord(c)] for c in ".,;:!?"),
        sum(count[48:58]),
        int(np.bincount(ids).max()) if len(ids) else 0,
    )


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of each row."""

    def run(texts: list[str]) -> dict[str, np.ndarray]:
        rows = np.array([counts_of(t) for t in texts], dtype=np.int64).reshape(-1, len(COUNTS))
        return {c: rows[:, i] for i, c in enumerate(COUNTS)}

    return map_texts(docs, ["doc_id"], "text", run, ", ".join(f"{c} long" for c in COUNTS))


def features() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "symbols_per_word": F.col("n_symbols") / words,
        "chars_per_word": F.col("word_chars") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "distinct_share": F.col("n_distinct") / words,
        "marks_per_word": F.col("n_marks") / words,
        "digit_share": F.col("n_digits") / chars,
        "top_word_share": F.col("top_word") / words,
        "words_per_line": F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


@dataclass(frozen=True)
class Rule:
    """All conditions (feature, at_least, threshold) hold: the text is bad."""

    conditions: tuple[tuple[str, bool, float], ...]

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, up, t in self.conditions:
            out &= x[name] >= t if up else x[name] <= t
        return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, alive: np.ndarray, most: int) -> list[tuple[str, bool, float]]:
    got: list[tuple[str, bool, float]] = []
    while len(got) < most and (n := (alive & ~bad).sum()):
        p = (alive & bad).sum()
        if not p:
            break
        base, best = np.log2(p / (p + n)), (0.0, None)
        for name, v in x.items():
            for t in np.unique(np.quantile(v[alive], np.linspace(0, 1, 65))):
                for up in (True, False):
                    hit = alive & (v >= t if up else v <= t)
                    p1, n1 = (hit & bad).sum(), (hit & ~bad).sum()
                    if p1 and (gain := p1 * (np.log2(p1 / (p1 + n1)) - base)) > best[0] + 1e-9:
                        best = (gain, (name, up, float(t)))
        if best[1] is None:
            break
        got.append(best[1])
        alive = alive & Rule((best[1],)).mask(x)
    return got


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """Sequential covering. x: a column for each of FEATURES; bad: what the rules shall match."""
    n = len(bad)
    prune = np.arange(n) % 3 == 2
    left, rules = np.ones(n, bool), []
    while len(rules) < most_rules and (left & bad & ~prune).any():
        conditions = _grow(x, bad, left & ~prune, most_conditions)
        if not conditions:
            break

        def worth(c: list[tuple[str, bool, float]]) -> float:
            hit = Rule(tuple(c)).mask(x) & left & prune
            p, k = (hit & bad).sum(), hit.sum()
            return (p + 1) / (k + 2)

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions = conditions[:-1]
        rule = Rule(tuple(conditions))
        hit = rule.mask(x) & left
        if (hit & bad).sum() < least or (hit & bad).sum() < precision * hit.sum() or (hit & bad & prune).sum() < precision * (hit & prune).sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def as_column(rules: list[Rule]) -> Column:
    """The list in order: the first rule that matches says bad (false), the default says good (true)."""
    of, out = features(), None
    for rule in rules:
        test = F.lit(True)
        for name, up, t in rule.conditions:
            test = test & (of[name] >= F.lit(t) if up else of[name] <= F.lit(t))
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_from(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> list[Rule]:
    """A list from at most `limit` labelled rows (quality 1: good)."""
    few = bounded_labels(labels, "quality", limit)
    stats = text_statistics(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id", "left_semi")).where(~base_failed())
    rows = stats.join(F.broadcast(few), "doc_id").select("doc_id", "label", *(c.alias(k) for k, c in features().items())).toPandas()
    rows = rows.sort_values(["doc_id", *FEATURES], kind="stable").drop_duplicates("doc_id")
    x, bad = {k: rows[k].to_numpy(float) for k in FEATURES}, rows["label"].to_numpy() == 0
    return learn(x, bad) if bad.any() and not bad.all() else []


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts, base_failed and kept of each row."""
    return text_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & as_column(rules))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn_from(docs, table(spark, sf_dir, "labels")))
