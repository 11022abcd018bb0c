"""Sections of laid-out documents as plans over a table of words.

A word is doc_id, page (from 1), ord (place in reading order), x0, top, text, size. Lines are
words of one height; a section is the lines of a band between its anchors. Each function
returns the rows of one section; a document without the section has no row there, and
`errors` says which of the sections that it should have are missing. Words with no text,
page or place are ignored. A document is one unit of work: its words are a few thousand.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.functions import clean
from ledgerlake.operators.relational import between_anchors, take_while

# Bands of the page, labels and marks of the layout that is read.
LEFT, MIDDLE, RIGHT = (15.0, 205.0), (205.0, 392.0), (392.0, 600.0)
RATING, CAPS, STYLE, PERIODIC = (205.0, 305.0), (295.0, 395.0), (395.0, 595.0), (460.0, 600.0)
ONE_YEAR, THREE_YEARS, DRAWDOWN_VALUE = (115.0, 175.0), (175.0, 205.0), (95.0, 150.0)
HEADER_LABELS = ("benchmark", "fund aum", "inception date", "min investment", "expense ratio", "exit load/lock-in", "fees structure", "overview", "age:", "as on:")
RISK_LABELS = {
    "standard deviation": "std_dev",
    "sharpe": "sharpe",
    "r-square": "r_square",
    "r square": "r_square",
    "treynor": "treynor",
    "information ratio": "info_ratio",
    "up capture": "up_capture",
    "down capture": "down_capture",
    "tracking error": "tracking_error",
    "sortino": "sortino",
    "beta": "beta",
}
CHARACTERISTICS = {
    "total securities": "total_securities",
    "avg mkt cap": "avg_mkt_cap_cr",
    "average mkt cap": "avg_mkt_cap_cr",
    "median mkt cap": "median_mkt_cap_cr",
    "median market cap": "median_mkt_cap_cr",
    "p/e ratio": "portfolio_pe",
    "portfolio p/e": "portfolio_pe",
    "p/b ratio": "portfolio_pb",
    "portfolio p/b": "portfolio_pb",
    "dividend yield": "portfolio_div_yield",
    "div yield": "portfolio_div_yield",
    "modified duration": "modified_duration",
    "mod duration": "modified_duration",
    "average maturity": "avg_maturity_years",
    "avg maturity": "avg_maturity_years",
    "yield to maturity": "yield_to_maturity",
    "ytm": "yield_to_maturity",
}
PERIODS = {
    "1 month": "1m",
    "3 months": "3m",
    "6 months": "6m",
    "1 year": "1y",
    "2 years": "2y",
    "3 years": "3y",
    "5 years": "5y",
    "10 years": "10y",
    "since inception": "since_inception",
}
SECTOR_HEADING = ("sector", "wts(%)", "wts", "(%)")
SECTOR_STOPS = ("risk", "equity", "debt", "cash", "derivative", "alternate", "large", "mid", "small", "unrated", "sovereign", "aaa", "aa+", "a1+", "net")
HOLDINGS_STOPS = ("composition", "risk", "rating", "drawdown")
HOLDINGS_COLUMNS = {"security": "security_name", "wts": "weight_pct", "sector": "sector", "market": "market_cap", "instrument": "instrument_type", "risk": "risk_rating", "investment": "investment_style", "held": "held_since"}
HOLDINGS_BANDS = {"security_name": 0.0, "weight_pct": 155.0, "sector": 195.0, "market_cap": 265.0, "instrument_type": 330.0, "risk_rating": 400.0, "investment_style": 455.0, "held_since": 515.0}
HOLDINGS_ENDS = ("sector wts. trend", "sector wts trend", "mkt cap trend", "investment style trend", "aum trend", "attribution analysis", "alpha generators", "disclaimer")
EXPECTED = {
    "equity": ("header", "fund_managers", "trailing_returns", "risk_metrics", "sector_weights", "top_holdings", "composition", "drawdown", "market_caps", "investment_style"),
    "debt": ("header", "fund_managers", "trailing_returns", "risk_metrics", "sector_weights", "top_holdings", "characteristics", "composition", "risk_rating"),
    "hybrid": ("header", "fund_managers", "trailing_returns", "risk_metrics", "sector_weights", "top_holdings", "composition", "drawdown", "market_caps", "investment_style", "risk_rating"),
    "arbitrage": ("header", "fund_managers", "trailing_returns", "risk_metrics", "composition", "drawdown"),
    "multi_asset": ("header", "fund_managers", "trailing_returns", "risk_metrics", "sector_weights", "top_holdings", "composition", "drawdown", "market_caps", "investment_style"),
}
NUMBER = r"^-?\d+(?:\.\d+)?$"
ROLE = r"(?i)^.{0,80}[-–]\s*(equity\s*&\s*debt|equity-debt|foreign\s*inv(?:\.|estments?)?|equity|debt)\s*\.?\s*$"

Test = Callable[[Column], Column]


def _number(t: Column) -> Column:
    return t.rlike(NUMBER)


def _value(t: Column) -> Column:
    return _number(t) | F.upper(t).isin(*clean.MISSING, "0E-9")


def _first(needles: Mapping[str, str], label: Column) -> Column:
    """What the first needle that the label contains stands for; null without one."""
    return F.coalesce(*(F.when(F.contains(label, F.lit(n)), F.lit(v)) for n, v in needles.items()))


def _let(value: Column, use: Test) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _texts(words: Column, *order: str) -> Column:
    """The texts of words, joined in an order."""
    return F.array_join(F.transform(F.sort_array(F.transform(words, lambda w: F.struct(*(w[c].alias(c) for c in order), w["text"].alias("text")))), lambda w: w["text"]), " ")


def sound(words: DataFrame) -> DataFrame:
    return words.where("text IS NOT NULL AND trim(text) <> '' AND page IS NOT NULL AND x0 IS NOT NULL AND top IS NOT NULL")


def page_words(words: DataFrame, page: int) -> DataFrame:
    return sound(words).where(F.col("page") == page)


def first_page_with(words: DataFrame, anchor: str, pages: Sequence[int]) -> DataFrame:
    """The words of the first of the pages on which a word contains the anchor, in any case."""
    some = sound(words).where(F.col("page").isin(*pages))
    hit = F.min(F.when(F.contains(F.lower("text"), F.lit(anchor)), F.col("page"))).over(W.partitionBy("doc_id"))
    return some.withColumn("__p", hit).where("page = __p").drop("__p")


def clusters(words: Column, tolerance: float = 3.5) -> Column:
    """Words (an array of structs with top, in order) as (top, words) of each line: a word joins the first line whose first word is within the tolerance."""

    def add(found: Column, w: Column) -> Column:
        near = F.array_position(F.transform(found["tops"], lambda top: F.abs(top - w["top"]) < tolerance), True)
        new = F.struct(F.concat(found["tops"], F.array(w["top"])).alias("tops"), F.concat(found["at"], F.array((F.size(found["tops"]) + 1).cast("long"))).alias("at"))
        return _let(near, lambda at: F.when(at == 0, new).otherwise(F.struct(found["tops"].alias("tops"), F.concat(found["at"], F.array(at)).alias("at"))))

    def gathered(found: Column) -> Column:
        return F.transform(found["tops"], lambda top, i: F.struct(top.alias("top"), F.filter(words, lambda w, j: F.get(found["at"], j) == i + 1).alias("words")))

    none = F.struct(F.array().cast("array<double>").alias("tops"), F.array().cast("array<bigint>").alias("at"))
    return _let(F.aggregate(words, none, add), gathered)


def lines(words: DataFrame, band: tuple[float, float], tolerance: float = 3.5) -> DataFrame:
    """doc_id, page, y, words (left to right), tokens and label (all in lower case) of each line of a band."""
    some = sound(words).where((F.col("x0") >= band[0]) & (F.col("x0") < band[1]))
    pages = some.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("ord", F.col("x0").cast("double").alias("x0"), F.col("top").cast("double").alias("top"), "text"))).alias("ws"))
    every = pages.select("doc_id", "page", F.explode(clusters(F.col("ws"), tolerance)).alias("r"))
    sideways = F.sort_array(F.transform("r.words", lambda w: F.struct(w["x0"].alias("x0"), w["ord"].alias("ord"), w["top"].alias("top"), w["text"].alias("text"))))
    out = every.select("doc_id", "page", F.array_min(F.transform("r.words", lambda w: w["top"])).alias("y"), sideways.alias("words"))
    out = out.withColumn("tokens", F.transform("words", lambda w: w["text"]))
    return out.withColumn("label", F.lower(F.array_join("tokens", " ")))


def _pairs(rows: DataFrame, fits: Test = _number) -> DataFrame:
    """name and value of lines whose last word is a value."""
    last, name = F.element_at("tokens", -1), F.array_join(F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))), " ")
    return rows.where(fits(last)).select("doc_id", "y", F.trim(name).alias("name"), last.alias("raw"), clean.to_double(F.when(F.upper(last) == "0E-9", F.lit("0")).otherwise(last)).alias("value")).where("name <> ''")


def _after(rows: DataFrame, start: Column, end: Column | None = None) -> DataFrame:
    return between_anchors(rows, ["doc_id"], F.col("y"), start, F.lit(False) if end is None else end)


def _columns(rows: DataFrame, names: Sequence[str], key: str = "name", value: str = "value") -> DataFrame:
    """A row a document: the first value that is not null under each name; documents without any are left out."""
    of = [F.min_by(value, F.when((F.col(key) == n) & F.col(value).isNotNull(), F.col("y"))).alias(n) for n in names]
    hit = F.max(F.col(key).isin(*names)).alias("__hit")
    return rows.groupBy("doc_id").agg(*of, hit).where("__hit").drop("__hit")


def _spans(words: DataFrame) -> DataFrame:
    span = F.struct("ord", F.trim("text").alias("text"), F.col("size").cast("double").alias("size"), F.col("x0").cast("double").alias("x0"), F.col("top").cast("double").alias("top"))
    return page_words(words, 1).groupBy("doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def _heading(spans: Column, place: int, share: float) -> Column:
    """The text of the place-th largest size, of spans in the upper share of the page (the first: the largest size there)."""
    tops = F.transform(spans, lambda s: s["top"])

    def of(upper: Column) -> Column:
        sizes = F.sort_array(F.array_distinct(F.transform(upper if place == 0 else spans, lambda s: s["size"])), asc=False)
        text = _let(F.get(sizes, F.lit(place)), lambda size: _texts(F.filter(upper, lambda s: s["size"] == size), "top", "ord"))
        return _let(F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" -")), lambda t: F.nullif(t, F.lit("")))

    cut = F.array_min(tops) + share * (F.array_max(tops) - F.array_min(tops) + 1e-9)
    return _let(cut, lambda cut: _let(F.filter(spans, lambda s: s["top"] <= cut), of))


def value_for(spans: Column, label: str, x_tolerance: float = 30.0, below: float = 30.0, joined: bool = True) -> Column:
    """The text beside a label: the nearest to its right in its row, else the nearest below it in its column, with what wraps below that."""
    low = lambda s: F.lower(s["text"])

    def of(mark: Column) -> Column:
        value = lambda s: (low(s) != label) & ~(s["text"].startswith("(") & s["text"].endswith(")")) & ~low(s).isin(*HEADER_LABELS)
        right = F.filter(spans, lambda s: (F.abs(s["top"] - mark["top"]) <= 5.0) & (s["x0"] > mark["x0"]) & value(s))
        under = F.filter(spans, lambda s: (s["top"] > mark["top"]) & (s["top"] - mark["top"] <= below) & (F.abs(s["x0"] - mark["x0"]) <= x_tolerance) & value(s))
        by = lambda xs, c: F.array_min(F.transform(xs, lambda s: F.struct(s[c].alias("d"), s["ord"].alias("ord"), s["top"].alias("top"), s["x0"].alias("x0"), s["text"].alias("text"))))
        return _let(F.coalesce(by(right, "x0"), by(under, "top")), whole if joined else lambda found: found["text"])

    def whole(found: Column) -> Column:
        more = F.filter(spans, lambda s: (s["ord"] != found["ord"]) & (F.abs(s["x0"] - found["x0"]) <= 1.5) & (s["top"] > found["top"]) & (s["top"] - found["top"] <= below) & ~low(s).isin(*HEADER_LABELS))
        rest = F.transform(F.sort_array(F.transform(more, lambda s: F.struct(s["top"].alias("top"), s["ord"].alias("ord"), s["text"].alias("text")))), lambda s: s["text"])
        return F.when(found.isNotNull(), F.trim(F.array_join(F.concat(F.array(found["text"]), rest), " ")))

    return _let(F.get(F.filter(spans, lambda s: low(s) == label), F.lit(0)), of)


def required(words: DataFrame) -> DataFrame:
    """doc_id, scheme_name and as_of_date. Documents that lack one have no row: without them nothing of a document can be kept."""
    page = F.array_join(F.transform("spans", lambda s: s["text"]), " ")
    out = _spans(words).select("doc_id", _heading(F.col("spans"), 0, 0.3).alias("scheme_name"), clean.as_of(page).alias("as_of_date"))
    return out.where("scheme_name IS NOT NULL AND as_of_date IS NOT NULL")


def header(words: DataFrame) -> DataFrame:
    """The labelled fields of the first page."""
    s = F.col("spans")
    one = lambda label: value_for(s, label, joined=False)
    stop = lambda t: t.rlike(r"^(?:age:|as on:|fund manager detail|performance|trailing returns)")

    def overview(mark: Column) -> Column:
        under = F.filter(s, lambda x: x["top"] > mark["top"] + 1.0)
        end = F.array_position(F.transform(under, lambda x: stop(F.lower(x["text"]))), True)
        body = F.slice(under, 1, F.when(end > 0, end - 1).otherwise(F.size(under)).cast("int"))
        ordered = F.sort_array(F.transform(F.slice(body, 1, 11), lambda x: F.struct(x["top"].alias("top"), x["ord"].alias("ord"), x["text"].alias("text"))))
        return F.nullif(F.trim(F.regexp_replace(F.array_join(F.transform(ordered, lambda x: x["text"]), " "), r"\s+", " ")), F.lit(""))

    return _spans(words).select(
        "doc_id",
        F.nullif(F.trim(F.regexp_replace(_heading(s, 1, 0.25), r"(?i)^mutual fund\s*[-:]\s*", "")), F.lit("")).alias("sub_category"),
        value_for(s, "benchmark", 5.0, 15.0).alias("benchmark"),
        clean.to_date(one("inception date")).alias("inception_date"),
        one("min investment").alias("min_investment"),
        clean.to_double(one("expense ratio")).alias("expense_ratio"),
        value_for(s, "exit load/lock-in", below=15.0).alias("exit_load"),
        clean.to_double(value_for(s, "fund aum", below=40.0)).alias("fund_aum_cr"),
        clean.age(one("age:")).alias("fund_age"),
        _let(F.get(F.filter(s, lambda x: F.lower(x["text"]) == "overview"), F.lit(0)), overview).alias("overview"),
    )


def role(text: Column) -> Column:
    """Equity, Debt, Equity & Debt or Foreign Investment, from the end of a line; null for other lines."""
    raw = F.lower(F.regexp_extract(text, ROLE, 1))
    return F.when(raw.rlike("^equity.*debt$"), "Equity & Debt").when(raw == "equity", "Equity").when(raw == "debt", "Debt").when(raw.startswith("foreign"), "Foreign Investment")


def qualification(text: Column) -> Column:
    raw = F.regexp_extract(text, r"(?is)qualification\s*[:\-]\s*(.*?)(?:\.\s*)?(?:experience\b|$)", 1)
    return F.rtrim(F.regexp_replace(raw, r"\s+", " "), F.lit(" .,"))


def experience(text: Column) -> Column:
    """Whole years."""
    return F.regexp_extract(text, r"(?i)(\d{1,2}(?:\.\d+)?)\s*\+?\s*years?", 1).try_cast("double").cast("int")


def fund_managers(words: DataFrame) -> DataFrame:
    """doc_id, position, name, role, qualification and experience_years: a line with a role starts a person, whose name stands above it."""
    low = F.lower("text")
    block = between_anchors(page_words(words, 1), ["doc_id"], F.col("top"), low == "fund manager detail", low.startswith("performance") | low.startswith("trailing returns"))
    order = W.partitionBy("doc_id").orderBy("top", "x0", "ord")
    rows = block.select("doc_id", "text", role(F.col("text")).alias("role"), F.row_number().over(order).alias("at"), F.lead(role(F.col("text"))).over(order).alias("next_role"))
    rows = rows.withColumn("person", F.sum(F.col("role").isNotNull().cast("int")).over(W.partitionBy("doc_id").orderBy("at")))
    plain = F.col("role").isNull()
    name = plain & ~F.lower("text").rlike("^(?:qualification|experience)") & (F.length("text") <= 80) & ~F.contains("text", F.lit("."))
    body = F.when(plain & F.col("next_role").isNull(), F.struct("at", "text"))
    people = rows.groupBy("doc_id", "person").agg(F.max("role").alias("role"), F.max_by("text", F.when(name, F.col("at"))).alias("below"), F.array_join(F.transform(F.sort_array(F.collect_list(body)), lambda x: x["text"]), " ").alias("body"))
    by = W.partitionBy("doc_id").orderBy("person")
    named = people.withColumn("name", F.coalesce(F.trim(F.lag("below").over(by)), F.lit(""))).where("person > 0")
    return named.select("doc_id", F.col("person").cast("int").alias("position"), "name", "role", qualification(F.col("body")).alias("qualification"), experience(F.col("body")).alias("experience_years"))


def tables_of(words: DataFrame, anchor: str, columns: Sequence[str], band: tuple[float, float] = (0.0, 600.0), tolerance: float = 3.5) -> DataFrame:
    """doc_id, page, y and cells of the lines from the first one that starts with the anchor on: a cell of each column, by the places of the header's words.

    A header of several words is found by its first one; words left of the second column are the first cell.
    """
    rows = lines(words, band, tolerance)
    head = rows.where(F.startswith("label", F.lit(anchor)))
    key = F.struct("page", "y")
    head = head.groupBy("doc_id").agg(F.min_by("words", key).alias("head"), F.min("page").alias("head_page"), F.min(key).alias("head_key"))
    place = lambda c: F.get(F.filter("head", lambda w: F.lower(w["text"]) == c.split(" ")[0]), F.lit(0))["x0"]
    starts = [F.lit(0.0), *(place(c) for c in columns)]
    joined = rows.join(head, "doc_id").where(F.struct("page", "y") > F.col("head_key"))
    cell = lambda i: F.array_join(F.transform(F.filter("words", lambda w: (w["x0"] >= starts[i] - 1.0) & ((w["x0"] < starts[i + 1] - 1.0) if i + 1 < len(starts) else F.lit(True))), lambda w: w["text"]), " ")
    return joined.select("doc_id", "page", "y", F.array(*(cell(i) for i in range(len(starts)))).alias("cells"))


def trailing_returns(cells: DataFrame) -> DataFrame:
    """Returns of the fund and of its benchmark by period. cells: doc_id, page, table, row, cells of extracted tables; the header's first cell starts with "trailing returns"."""
    norm = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")
    rows = cells.select("doc_id", F.struct("page", "table").alias("t"), "row", "cells", norm(F.get("cells", F.lit(0))).alias("first"))
    head = rows.where(F.startswith("first", F.lit("trailing returns"))).groupBy("doc_id", "t").agg(F.min("row").alias("head_row"), F.min_by("cells", "row").alias("head"))
    below = rows.join(head, ["doc_id", "t"]).where("row > head_row")
    fund = below.where("first = 'fund'").groupBy("doc_id").agg(F.min(F.struct("t", "row")).alias("fund"))
    other = (F.col("first") != "") & (F.col("first") != "fund") & ~F.startswith("first", F.lit("trailing returns")) & ~F.startswith("first", F.lit("performance"))
    placed = below.join(fund, "doc_id").withColumn("at", F.struct("t", "row"))
    bench = placed.where(other & (F.col("at") > F.col("fund"))).groupBy("doc_id").agg(F.min("at").alias("bench"))
    chosen = placed.join(bench, "doc_id", "left").where("at = fund OR at = bench")
    period = F.create_map(*(F.lit(x) for pair in (PERIODS | {v: v for v in PERIODS.values()}).items() for x in pair))
    cell = chosen.select("doc_id", (F.col("at") == F.col("fund")).alias("is_fund"), F.posexplode("head").alias("i", "name"), "cells")
    cell = cell.select("doc_id", "is_fund", F.try_element_at(period, norm(F.col("name"))).alias("period"), clean.to_double(F.get("cells", F.col("i"))).alias("x")).where("period IS NOT NULL")
    of = [F.max(F.when((F.col("period") == p) & (F.col("is_fund") == (side == "")), F.col("x"))).alias(f"return_{p}{side}") for side in ("", "_bm") for p in dict.fromkeys(PERIODS.values())]
    return cell.groupBy("doc_id").agg(*of)


def risk_metrics(words: DataFrame) -> DataFrame:
    """Each metric over one year and three; the first value under a label counts."""
    rows = lines(page_words(words, 2), LEFT)
    tokens = lambda lo, hi: F.transform(F.filter("words", lambda w: (w["x0"] >= lo) & (w["x0"] < hi)), lambda w: w["text"])
    rows = rows.select("doc_id", "y", _first(RISK_LABELS, F.lower(F.array_join(tokens(0.0, ONE_YEAR[0]), " "))).alias("stem"), F.get(tokens(*ONE_YEAR), F.lit(0)).alias("a"), F.get(tokens(*THREE_YEARS), F.lit(0)).alias("b")).where("stem IS NOT NULL AND (a IS NOT NULL OR b IS NOT NULL)")
    cells = rows.select("doc_id", "y", F.inline(F.array(*(F.struct(F.concat("stem", F.lit(end)).alias("name"), clean.to_double(F.col(c)).alias("value")) for c, end in (("a", "_1y"), ("b", "_3y"))))))
    return _columns(cells, [f"{s}_{p}" for s in dict.fromkeys(RISK_LABELS.values()) for p in ("1y", "3y")])


def sector_weights(words: DataFrame) -> DataFrame:
    """doc_id, sector and weight_pct of the lines after the heading and before the next block."""
    rows = lines(page_words(words, 2), MIDDLE)
    after = _after(rows, F.forall("tokens", lambda t: F.lower(t).isin(*SECTOR_HEADING)))
    held = take_while(after, ["doc_id"], [F.col("y")], F.lower(F.get("tokens", F.lit(0))).isin(*SECTOR_STOPS))
    return _pairs(held).select("doc_id", F.col("name").alias("sector"), F.col("value").alias("weight_pct"))


def _nearest(weights: Column, word: Column) -> Column:
    """d, y and anchor of the weight that is nearest to a word, the upper one of two at the same distance; null without weights."""
    return F.array_min(F.transform(weights, lambda a: F.struct(F.abs(a["top"] - word["top"]).alias("d"), a["top"].alias("y"), a["ord"].alias("anchor"))))


def top_holdings(words: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, rank, security_name, weight_pct and as_of_date: names wrap over lines, so each word goes to the nearest weight. A document's words are gathered once, so nothing is joined."""
    span = F.struct("ord", F.trim("text").alias("text"), F.col("size").cast("double").alias("size"), F.col("x0").cast("double").alias("x0"), F.col("top").cast("double").alias("top"))
    word = F.struct("ord", F.col("x0").cast("double").alias("x0"), F.col("top").cast("double").alias("top"), "text")
    both = sound(words).where("page IN (1, 2)").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("page") == 1, span))).alias("spans"), F.sort_array(F.collect_list(F.when(F.col("page") == 2, word))).alias("page"))

    def ranked(band: Column) -> Column:
        stops = F.array_min(F.transform(F.filter(band, lambda w: F.lower(w["text"]).isin(*HOLDINGS_STOPS)), lambda w: w["top"]))
        return _let(stops, lambda cut: _let(F.filter(band, lambda w: cut.isNull() | (w["top"] < cut)), above))

    def above(band: Column) -> Column:
        return _let(F.filter(band, lambda w: _number(w["text"])), lambda weights: named(band, weights))

    def named(band: Column, weights: Column) -> Column:
        parts = F.transform(F.filter(band, lambda w: ~_number(w["text"])), lambda w: F.struct(w["top"].alias("top"), w["ord"].alias("ord"), w["text"].alias("text"), _nearest(weights, w).alias("near")))
        near = F.filter(parts, lambda w: w["near"]["d"] <= 12.0)
        rows = lambda parts: F.transform(weights, lambda n: F.struct(n["top"].alias("top"), n["ord"].alias("ord"), n["text"].alias("raw"), F.filter(parts, lambda w: w["near"]["anchor"] == n["ord"]).alias("parts")))
        first = F.slice(F.sort_array(F.filter(_let(near, rows), lambda r: F.size(r["parts"]) > 0)), 1, most)
        return F.transform(first, lambda r, i: F.struct((i + 1).alias("rank"), _texts(r["parts"], "top", "ord").alias("security_name"), r["raw"].alias("raw")))

    band = F.filter("page", lambda w: (w["x0"] >= RIGHT[0]) & (w["x0"] < RIGHT[1]) & (w["top"] > 55.0))
    own = clean.as_of(clean.after_marker(F.array_join(F.transform("page", lambda w: w["text"]), " "), "top holdings"))
    out = both.select("doc_id", own.alias("own"), _heading(F.col("spans"), 0, 0.3).alias("title"), clean.as_of(F.array_join(F.transform("spans", lambda s: s["text"]), " ")).alias("as_of"), _let(band, ranked).alias("rows"))
    out = out.select("doc_id", F.coalesce("own", F.when(F.col("title").isNotNull(), F.col("as_of"))).alias("as_of_date"), F.inline("rows"))
    return out.select("doc_id", "rank", "security_name", clean.to_double(F.col("raw")).alias("weight_pct"), "as_of_date")


def characteristics(words: DataFrame) -> DataFrame:
    rows = _after(lines(page_words(words, 2), LEFT), F.contains("label", F.lit("portfolio characteristics")), F.contains("label", F.lit("composition")))
    named = _pairs(rows, _value).withColumn("name", _first(CHARACTERISTICS, F.lower("name"))).where("name IS NOT NULL")
    out = _columns(named, list(dict.fromkeys(CHARACTERISTICS.values())))
    return out.withColumn("total_securities", F.col("total_securities").cast("int"))


def _shares(rows: DataFrame, skip: Sequence[str]) -> DataFrame:
    """doc_id, label, value; of lines with one label the last counts."""
    pairs = _pairs(rows).where(~F.lower("name").isin(*skip))
    return pairs.groupBy("doc_id", F.col("name").alias("label")).agg(F.max_by("value", "y").alias("value"))


def composition(words: DataFrame) -> DataFrame:
    return _shares(_after(lines(page_words(words, 2), LEFT), F.contains("label", F.lit("composition")), F.contains("label", F.lit("drawdown"))), ("composition", "wts(%)", "wts", "(%)"))


def drawdown(words: DataFrame) -> DataFrame:
    """The one-year column of the block, which is on page 2 or, where that is full, on page 3."""
    rows = _after(lines(first_page_with(words, "drawdown", (2, 3)), LEFT), F.contains("label", F.lit("drawdown")), F.contains("label", F.lit("increase in exposure")))
    tokens = lambda lo, hi: F.array_join(F.transform(F.filter("words", lambda w: (w["x0"] >= lo) & (w["x0"] < hi)), lambda w: w["text"]), " ")
    cells = rows.select("doc_id", "y", F.lower(tokens(0.0, DRAWDOWN_VALUE[0])).alias("name"), tokens(*DRAWDOWN_VALUE).alias("raw")).where("name <> '' AND raw <> ''")
    has = lambda *needles: reduce(lambda a, b: a & b, (F.contains("name", F.lit(n)) for n in needles))
    last = lambda test, value: F.max_by(value, F.when(test, F.col("y")))
    return cells.groupBy("doc_id").agg(
        last(has("draw down", "%"), clean.to_double(F.col("raw"))).alias("drawdown_pct"),
        last(has("duration", "days"), clean.to_int(F.col("raw"))).alias("drawdown_duration_days"),
        last(has("peak date"), clean.to_date(F.col("raw"))).alias("drawdown_peak_date"),
        last(has("valley date"), clean.to_date(F.col("raw"))).alias("drawdown_valley_date"),
        last(has("recovery date"), clean.to_date(F.col("raw"))).alias("drawdown_recovery_date"),
    )


def risk_rating(words: DataFrame) -> DataFrame:
    after = _after(lines(page_words(words, 2), RATING), F.contains("label", F.lit("risk rating")))
    return _shares(take_while(after, ["doc_id"], [F.col("y")], F.lower(F.get("tokens", F.lit(0))).isin("decrease", "increase")), ("risk rating", "%"))


def market_caps(words: DataFrame) -> DataFrame:
    after = _after(lines(page_words(words, 2), CAPS), F.array_contains(F.split("label", " "), "composition"))
    named = _pairs(after, _value).withColumn("name", F.replace(F.lower("name"), F.lit(" "), F.lit("_")))
    out = _columns(named, ["large_cap", "mid_cap", "small_cap"])
    return out.select("doc_id", *(F.col(c).alias(f"{c}_pct") for c in ("large_cap", "mid_cap", "small_cap")))


def investment_style(words: DataFrame) -> DataFrame:
    """doc_id, cap, style and value of the three by three matrix: a value belongs to the column whose heading is nearest."""
    rows = lines(page_words(words, 2), STYLE)
    styles = ("blend", "growth", "value")
    low = F.transform("tokens", lambda t: F.lower(t))
    is_head = reduce(lambda a, b: a & b, (F.array_contains(low, s) for s in styles))
    head = F.min(F.when(is_head, F.struct("y", "words"))).over(W.partitionBy("doc_id"))
    rows = rows.withColumn("head", head).select("doc_id", "y", "words", "label", F.col("head.y").alias("head_y"), F.col("head.words").alias("head"))
    x = lambda s: F.get(F.filter("head", lambda w: F.lower(w["text"]) == s), F.lit(0))["x0"]
    after = rows.where("y > head_y").withColumn("cap", _first({"large cap": "Large Cap", "mid cap": "Mid Cap", "small cap": "Small Cap"}, F.col("label"))).where("cap IS NOT NULL")
    nearest = lambda w: F.array_min(F.array(*(F.struct(F.abs(x(s) - w["x0"]).alias("d"), F.lit(i).alias("i")) for i, s in enumerate(styles))))["i"]
    cells = F.transform(F.filter("words", lambda w: _value(w["text"])), lambda w: F.struct(nearest(w).alias("i"), w["text"].alias("text")))
    first = after.groupBy("doc_id", "cap").agg(F.min_by(cells, "y").alias("cells"))
    of = lambda i: F.get(F.filter("cells", lambda c: c["i"] == i), F.lit(0))["text"]
    return first.select("doc_id", "cap", F.inline(F.array(*(F.struct(F.lit(s.capitalize()).alias("style"), clean.to_double(of(i)).alias("value")) for i, s in enumerate(styles)))))


def periodic_returns(words: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """doc_id, period_type (monthly, fy or cy), period_label and return_pct; of each type the first page that has rows counts. months: doc_id and report_month, for MTD."""
    rows = lines(sound(words), PERIODIC)
    year = F.contains("label", F.lit("year")) | F.contains("label", F.lit("fund"))
    yearly = (year & (F.contains("label", F.lit("(%)")) | F.contains("label", F.lit("fund")))) | (F.trim("label") == "year")
    monthly = F.contains("label", F.lit("month on")) | F.contains("label", F.lit("month-on")) | (F.contains("label", F.lit("month")) & F.contains("label", F.lit("fund")) & F.contains("label", F.lit("index")))
    value = lambda t: _value(t) & ~t.rlike(r"^(?:(?:19|20)\d{2}|\d{1,3})$")
    values = F.filter("tokens", value)
    end = (F.size(values) == 0) & F.col("label").rlike("risk &|powered by|volatility")
    first, second = F.upper(F.get("tokens", F.lit(0))), F.get("tokens", F.lit(1))
    cut = F.array_position(F.transform("tokens", value), True)
    spelled = F.array_join(F.slice("tokens", 1, F.when(cut > 0, cut - 1).otherwise(0).cast("int")), " ")
    label = {
        "monthly": F.when(F.upper(spelled) == "MTD", F.lit("MTD")).otherwise(clean.month_key(spelled)),
        "fy": F.when(first == "FYTD", first).when((first == "FY") & second.rlike(r"^\d{2,4}$"), F.concat(F.lit("FY "), second)),
        "cy": F.when(first == "YTD", first).when((first == "CY") & second.rlike(r"^\d{2,4}$"), F.concat(F.lit("CY "), second)),
    }
    page = W.partitionBy("doc_id", "page")
    begun = lambda start: F.min(F.when(start, F.col("y"))).over(page)
    rows = rows.select("doc_id", "page", "y", "label", "tokens", values.alias("values"), end.alias("end"), begun(monthly).alias("from_month"), begun(yearly).alias("from_year"))
    so_far = page.orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    ended = lambda start: F.max((F.col("end") & (F.col("y") > F.col(start))).cast("int")).over(so_far)
    rows = rows.withColumn("month_ended", ended("from_month")).withColumn("year_ended", ended("from_year")).where("size(values) > 0")
    within = lambda start, ended: (F.col("y") > F.col(start)) & (F.col(ended) == 0)
    of = {"monthly": within("from_month", "month_ended"), "fy": within("from_year", "year_ended"), "cy": within("from_year", "year_ended")}
    kinds = F.array(*(F.struct(F.lit(k).alias("period_type"), F.when(held, label[k]).alias("period_label")) for k, held in of.items()))
    every = rows.select("doc_id", "page", F.get("values", F.lit(0)).alias("raw"), F.inline(F.filter(kinds, lambda x: x["period_label"].isNotNull())))
    every = every.select("doc_id", "page", "period_type", "period_label", clean.to_double(F.col("raw")).alias("return_pct"))
    best = F.min("page").over(W.partitionBy("doc_id", "period_type"))
    every = every.withColumn("best", best).where("page = best")
    if months is None:
        return every.where("period_label <> 'MTD'").select("doc_id", "period_type", "period_label", "return_pct")
    dated = every.join(months.select("doc_id", "report_month"), "doc_id", "left").withColumn("period_label", F.when(F.col("period_label") == "MTD", F.col("report_month")).otherwise(F.col("period_label")))
    return dated.where("period_label IS NOT NULL").select("doc_id", "period_type", "period_label", "return_pct")


def _cells(rows: Column, anchors: Column) -> Column:
    """y and the texts of the columns of each row: words (with column and near) by their anchor."""

    def row(own: Column) -> Column:
        cell = lambda i: F.trim(_texts(F.filter(own, lambda w: w["column"] == i), "top", "x0", "ord"))
        return F.struct(F.array_min(F.transform(own, lambda w: w["near"]["y"])).alias("y"), *(cell(i + 1).alias(c) for i, c in enumerate(HOLDINGS_BANDS)))

    return F.transform(anchors, lambda a: _let(F.filter(rows, lambda w: w["near"]["anchor"].eqNullSafe(a)), row))


def holdings(words: DataFrame) -> DataFrame:
    """The rows of the detailed table, from its page on until a page that ends it or has none: columns by the places of the header's words, rows by the nearest weight. A page's words are gathered once; what pages tell each other goes by windows over a document's pages, so nothing is joined."""
    word = F.struct("ord", F.col("x0").cast("double").alias("x0"), F.col("top").cast("double").alias("top"), "text")
    pages = sound(words).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(word)).alias("ws"))
    pages = pages.withColumn("t", F.lower(F.array_join(F.transform("ws", lambda w: w["text"]), " ")))
    document = W.partitionBy("doc_id")
    first = F.min(F.when(F.contains("t", F.lit("detailed portfolio")), F.col("page"))).over(document)
    pages = pages.withColumn("first_page", first).where("page >= first_page")

    name = lambda w: F.rtrim(F.lower(w["text"]), F.lit(":"))
    at = {column: heading for heading, column in HOLDINGS_COLUMNS.items()}

    def found(heads: Column) -> Column:
        lows = F.array(*(F.get(F.filter(heads, lambda w: name(w) == at[c]), F.lit(0))["x0"] for c in HOLDINGS_BANDS))
        return _let(lows, lambda x: F.when(F.forall(x, lambda v: v.isNotNull()), F.transform(x, lambda v, i: F.when(i == list(HOLDINGS_BANDS).index("security_name"), F.lit(0.0)).otherwise(v))))

    placed = F.filter("ws", lambda w: w["ord"].isNotNull())
    head_y = F.get(F.filter(placed, lambda w: F.lower(w["text"]) == "security"), F.lit(0))["top"]
    bands = F.when(F.col("page") == F.col("first_page"), _let(head_y, lambda y: _let(F.filter(placed, lambda w: F.abs(w["top"] - y) < 6.0), found)))
    usual = F.array(*(F.lit(x) for x in HOLDINGS_BANDS.values()))
    pages = pages.withColumn("own", bands).withColumn("bands", F.coalesce(F.max("own").over(document), usual))
    weight = list(HOLDINGS_BANDS).index("weight_pct") + 1
    end_words = F.array_compact(F.array(*(F.when(F.contains("t", F.lit(p)), F.lit(p.split(" ")[0])) for p in HOLDINGS_ENDS)))
    pages = pages.withColumn("end_words", end_words)

    def columns(w: Column) -> Column:
        column = F.array_position("bands", F.array_max(F.filter("bands", lambda v: v <= w["x0"])))
        return F.struct(w["ord"].alias("ord"), w["x0"].alias("x0"), w["top"].alias("top"), w["text"].alias("text"), column.alias("column"), ((column == weight) & _number(w["text"])).alias("is_weight"))

    def rows_of(ws: Column) -> Column:
        top = lambda xs: F.array_min(F.transform(xs, lambda w: w["top"]))
        end = top(F.filter(ws, lambda w: F.exists("end_words", lambda e: F.contains(F.lower(w["text"]), e))))
        start = F.when(F.col("page") == F.col("first_page"), top(F.filter(ws, lambda w: w["is_weight"])) - 2.0)
        within = lambda span: F.filter(ws, lambda w: (span["start"].isNull() | (w["top"] >= span["start"])) & (span["end"].isNull() | (w["top"] < span["end"])))
        return _let(F.struct(start.alias("start"), end.alias("end")), lambda span: _let(within(span), anchored))

    def anchored(ws: Column) -> Column:
        near = lambda weights: F.filter(F.transform(ws, lambda w: F.struct(w["ord"].alias("ord"), w["x0"].alias("x0"), w["top"].alias("top"), w["text"].alias("text"), w["column"].alias("column"), _nearest(weights, w).alias("near"))), lambda w: w["near"]["d"] <= 9.0)
        kept = _let(F.filter(ws, lambda w: w["is_weight"]), near)
        return _let(kept, lambda rows: _let(F.array_distinct(F.transform(rows, lambda w: w["near"]["anchor"])), lambda anchors: _cells(rows, anchors)))

    fits = lambda r: r["security_name"].rlike(r"\p{L}") & clean.to_double(r["weight_pct"]).between(-25.0, 105.0)
    pages = pages.select("doc_id", "page", "first_page", "end_words", F.filter(_let(F.transform("ws", columns), rows_of), fits).alias("rows"))
    # Pages go on up to one that ends the table, and up to one without rows.
    last = F.min(F.when(F.size("end_words") > 0, F.col("page"))).over(document)
    gap = F.min(F.when((F.size("rows") == 0) & (F.col("page") > F.col("first_page")), F.col("page"))).over(document)
    pages = pages.withColumn("last_page", last).withColumn("gap", gap).where("(last_page IS NULL OR page <= last_page) AND (gap IS NULL OR page < gap)")
    rows = pages.select("doc_id", "page", F.inline("rows"))
    plain = [clean.na_to_null(F.col(c)).alias(c) for c in ("sector", "market_cap", "instrument_type", "risk_rating", "investment_style")]
    return rows.select("doc_id", "page", "y", "security_name", clean.to_double(F.col("weight_pct")).alias("weight_pct"), *plain, clean.to_date(F.col("held_since")).alias("held_since"))


SECTIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "header": required,
    "fund_managers": fund_managers,
    "risk_metrics": risk_metrics,
    "sector_weights": sector_weights,
    "top_holdings": top_holdings,
    "characteristics": characteristics,
    "composition": composition,
    "drawdown": drawdown,
    "risk_rating": risk_rating,
    "market_caps": market_caps,
    "investment_style": investment_style,
    "periodic_returns": periodic_returns,
    "holdings": holdings,
}


def expected(spark_of: DataFrame) -> DataFrame:
    """The sections that documents of each kind should have, as a table: kind, section."""
    return spark_of.sparkSession.createDataFrame([(k, s) for k, sections in EXPECTED.items() for s in sections], "kind string, section string")


def errors(kinds: DataFrame, found: Mapping[str, DataFrame]) -> DataFrame:
    """doc_id, section and error of each section that a document of its kind should have and that found has no row of. kinds: doc_id, kind."""
    of = F.create_map(*(x for k, sections in EXPECTED.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in sections if s in found)).cast("array<string>"))))
    wanted = kinds.select("doc_id", F.explode(F.try_element_at(of, F.col("kind"))).alias("section"), F.lit(1).alias("wanted"))
    have = (df.select("doc_id", F.lit(name).alias("section")).distinct().withColumn("wanted", F.lit(0)) for name, df in found.items())
    least = F.min("wanted").alias("least")  # 0: the document has the section
    rows = reduce(DataFrame.union, have, wanted).groupBy("doc_id", "section").agg(least, F.sum("wanted").alias("n")).where("least = 1")
    return rows.select("doc_id", "section", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("__i")).select("doc_id", "section", F.concat(F.col("section"), F.lit(" not found")).alias("error"))
