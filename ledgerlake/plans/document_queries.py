"""Queries of the document sections. Their words are laid out from `part`, a document a part, in several spellings and places; the twins compute what the sections must say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import document
from ledgerlake.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_BODY, _NAME, _SUB = 7.5, 16.0, 12.0
#: Documents in a partition.
DOCUMENTS = 2000


def _k() -> Column:
    return F.col("p_partkey")


def _s() -> Column:
    return F.col("p_size")


def _q(sql: str):  # noqa: ANN202
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _day(shift: int = 0) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), (_k() % 400).cast("int") + shift)


def _spelled(day: Column) -> Column:
    k = _k() % 4
    return F.when(k == 0, F.date_format(day, "d MMM yyyy")).when(k == 1, F.date_format(day, "dd-MMM-yy")).when(k == 2, F.date_format(day, "d/MMM/yyyy")).otherwise(F.date_format(day, "d  MMMM yyyy"))


def _when(test: Column, text: Column | str) -> Column:
    return F.when(test, F.lit(text) if isinstance(text, str) else text)


def _join(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _holding(i: int) -> list[tuple]:
    y = 70.0 + 20.0 * i
    return [(2, 400.0, y - 4.0, "Alpha Beta"), (2, 400.0, y + 4.0, _join("Fund N", F.lit(i))), (2, 500.0, y, _join(F.lit(30 - i), ".", _k() % 7))]


def _layout() -> list[tuple]:
    """(page, x0, top, text, size): with a size a span that stays whole, else words; a null text is not there."""
    shaky = (_k() % 3).cast("double")
    late = 2 + (_k() % 2).cast("int")  # the page of the drawdown block
    return [
        (1, 30.0, 20.0, F.col("p_name"), _NAME),
        (1, 30.0, 40.0, _join("Mutual Fund - ", F.col("p_type")), _SUB),
        (1, 30.0, 100.0, "Benchmark", _BODY),
        (1, 120.0, 100.0 + shaky, F.col("p_brand"), _BODY),
        (1, 120.0, 108.0 + shaky, "Index", _BODY),
        (1, 30.0, 130.0, "Inception Date", _BODY),
        (1, 120.0, 130.0, _spelled(_day(-400)), _BODY),
        (1, 30.0, 145.0, "Expense Ratio", _BODY),
        (1, 120.0, 145.0, _join(_s() / 10, "%"), _BODY),
        (1, 300.0, 100.0, "Fund AUM", _BODY),
        (1, 325.0, 101.0, "(cr.)", _BODY),
        (1, 302.0, 115.0, F.format_number(_k() + 0.25, 2), _BODY),
        (1, 300.0, 160.0, "Age:", _BODY),
        (1, 330.0, 160.0, _join(_s(), " Years 9 Months"), _BODY),
        (1, 400.0, 160.0, _when(_k() % 11 != 0, _join("As On: ", _spelled(_day()))), _BODY),
        (1, 30.0, 230.0, "Fund Manager Detail", _BODY),
        (1, 30.0, 240.0, _join("Ann ", F.col("p_brand")), _BODY),
        (1, 30.0, 250.0, "FUND MANAGER - EQUITY", _BODY),
        (1, 30.0, 260.0, _join("Qualification: B.Com, MBA. Experience: over ", _s(), " years"), _BODY),
        (1, 30.0, 280.0, _when(_k() % 2 == 0, "Bob Sample"), _BODY),
        (1, 30.0, 290.0, _when(_k() % 2 == 0, "Senior Manager - Debt"), _BODY),
        (1, 30.0, 300.0, _when(_k() % 2 == 0, "Qualification: CA"), _BODY),
        (1, 30.0, 310.0, "Performance", _BODY),
        (2, 24.0, 40.0, "Standard Deviation"),
        (2, 120.0, 40.0 + shaky, _join(_s(), ".25")),
        (2, 180.0, 40.0, F.when(_k() % 3 == 0, "NA").otherwise(_join(_s(), ".5"))),
        (2, 24.0, 60.0, "Beta"),
        (2, 120.0, 60.0, "0.93"),
        (2, 24.0, 70.0, "Beta once more"),
        (2, 120.0, 70.0, "9.99"),
        (2, 24.0, 100.0, "Portfolio Characteristics"),
        (2, 24.0, 110.0, _join("Total Securities ", _k() % 100 + 1, ".00")),
        (2, 24.0, 120.0, F.when(_k() % 2 == 0, "Modified Duration 0E-9").otherwise("Modified Duration NA")),
        (2, 24.0, 130.0, _join("Portfolio P/E Ratio ", _s(), ".5")),
        (2, 24.0, 150.0, "Composition"),
        (2, 24.0, 160.0, _join("Equity ", 100 - _s(), ".5")),
        (2, 24.0, 170.0, _join("Net Cash -", _s(), ".25")),
        (2, 215.0, 10.0, "above 1.5"),
        (2, 215.0, 20.0, _when(_k() % 5 != 0, "Sector Wts(%)")),
        (2, 215.0, 30.0, _join("Goods of ", F.col("p_type"), " ", _s(), ".5")),
        (2, 215.0, 40.0, "Other Things 10"),
        (2, 215.0, 60.0, "Risk Rating %"),
        (2, 215.0, 70.0, _join("AAA ", _s(), ".5")),
        (2, 215.0, 80.0, "Unrated 4"),
        (2, 215.0, 90.0, "Decrease in Exposure 7"),
        (2, 310.0, 110.0, "Composition"),
        (2, 310.0, 120.0, _join("Large Cap ", _s(), ".5")),
        (2, 310.0, 130.0, "Mid Cap NA"),
        (2, 400.0, 40.0, _when(_k() % 2 == 0, _join("Top Holdings (As On: ", F.date_format(_day(-30), "d MMM yyyy"), ")"))),
        *(row for i in range(12) for row in _holding(i)),
        (2, 400.0, 320.0, "Composition"),
        (2, 420.0, 500.0, "Blend"),
        (2, 470.0, 500.0, "Growth"),
        (2, 520.0, 500.0, "Value"),
        (2, 396.0, 520.0, "Large Cap"),
        (2, 424.0 - shaky, 520.0, _join(_s(), ".5")),
        (2, 518.0 + shaky, 520.0, "NA"),
        (2, 466.0 + shaky, 520.0, "1.25"),
        (late, 24.0, 620.0, "Drawdown Analysis"),
        (late, 24.0, 640.0, "Draw Down (%)"),
        (late, 100.0, 640.0, _join("-", _s(), ".5")),
        (late, 24.0, 660.0, "Duration Days"),
        (late, 100.0, 660.0, _k() % 90),
        (late, 24.0, 680.0, "Peak Date"),
        (late, 100.0, 680.0, F.date_format(_day(), "dd MMM yyyy")),
        (late, 24.0, 700.0, "Recovery Date"),
        (late, 100.0, 700.0, F.when(_k() % 3 == 0, "Not Yet Recovered").otherwise(F.date_format(_day(50), "dd MMM yyyy"))),
        (late, 24.0, 720.0, "Increase in Exposure"),
        (4, 465.0, 20.0, "Month on Month Fund Index"),
        (4, 465.0, 30.0, _join("May 2025 ", _s(), ".28 3.00")),
        (4, 465.0, 40.0, "Jun 2025 NA 1.00"),
        (4, 465.0, 60.0, "Financial Year"),
        (4, 465.0, 70.0, _join("FY 24 ", _s(), ".50 11.00")),
        (4, 465.0, 80.0, "FYTD -1.25"),
        (4, 465.0, 90.0, "Calendar Year"),
        (4, 465.0, 100.0, "CY 23 7.75 6.00"),
        (4, 465.0, 110.0, "Risk & Volatility"),
        (4, 465.0, 120.0, "FY 11 1.10"),
        (5, 20.0, 20.0, _when(_k() % 7 != 0, "Detailed Portfolio")),
        *((5, x + shaky, 40.0, t) for x, t in ((20.0, "Security"), (150.0, "Wts"), (200.0, "Sector"), (270.0, "Market"), (335.0, "Instrument"), (405.0, "Risk"), (460.0, "Investment"), (520.0, "Held"))),
        (5, 20.0, 59.0, "Alpha Bank"),
        (5, 153.0, 60.0, _join(_s(), ".35")),
        (5, 20.0, 64.0, "Limited"),
        (5, 205.0, 60.0, F.col("p_type")),
        (5, 275.0, 60.0, "Na"),
        (5, 338.0, 60.0, "Equity"),
        (5, 525.0, 60.0, F.date_format(_day(), "dd MMM yyyy")),
        (6, 20.0, 30.0, "Alpha Bank"),
        (6, 153.0, 30.0, "-2.5"),
        (6, 338.0, 30.0, "Debt"),
        (6, 20.0, 50.0, "Axis of a chart"),
        (6, 153.0, 50.0, "2024"),
        (6, 20.0, 100.0, _when(_k() % 2 == 0, "Sector Wts. Trend")),
        (7, 20.0, 30.0, "Next Page"),
        (7, 153.0, 30.0, "3.5"),
    ]


def _dealt(part: DataFrame) -> DataFrame:
    """Documents by their key in as many partitions as they need: a row of few bytes becomes some 170 words, so neither the files' sizes nor adaptive execution tell how many. Words stay where their document is."""
    return part.repartition(max(1, -(-part.count() // DOCUMENTS)), "p_partkey")


def words(spark: SparkSession, d: str) -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    cells = F.array(*(F.struct(col(p).cast("int").alias("page"), col(x).cast("double").alias("x0"), col(y).cast("double").alias("top"), col(t).cast("string").alias("text"), F.lit(s[0] if s else None).cast("double").alias("size")) for p, x, y, t, *s in _layout()))
    part = _dealt(tables.read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    spans = part.select(_k().alias("doc_id"), F.posexplode(cells).alias("at", "c")).where("c.text IS NOT NULL")
    pieces = F.when(F.col("c.size").isNotNull(), F.array("c.text")).otherwise(F.split("c.text", " "))
    rows = spans.select("doc_id", "at", "c", F.posexplode(pieces).alias("i", "text"))
    return rows.select("doc_id", F.col("c.page").alias("page"), (F.col("at") * 100 + F.col("i")).alias("ord"), (F.col("c.x0") + 4.0 * F.col("i")).alias("x0"), F.col("c.top").alias("top"), "text", F.coalesce("c.size", F.lit(_BODY)).alias("size"))


def _text(df: DataFrame) -> DataFrame:
    """Dates as ISO texts."""
    return df.select(*(F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes))


_D = "CAST(CAST(DATE '2024-01-01' + CAST(p_partkey % 400 + ({}) AS INTEGER) AS DATE) AS VARCHAR)"


@_q(f"SELECT p_partkey AS doc_id, p_name AS scheme_name, {_D.format(0)} AS as_of_date FROM part WHERE p_partkey % 11 <> 0")
def doc_required(spark: SparkSession, d: str) -> DataFrame:
    return _text(document.required(words(spark, d)))


@_q(f"SELECT p_partkey AS doc_id, p_type AS sub_category, p_brand || ' Index' AS benchmark, {_D.format(-400)} AS inception_date, p_size / 10.0::DOUBLE AS expense_ratio, p_partkey + 0.25::DOUBLE AS fund_aum_cr, p_size || 'Y 9M' AS fund_age FROM part")
def doc_header(spark: SparkSession, d: str) -> DataFrame:
    return _text(document.header(words(spark, d)).select("doc_id", "sub_category", "benchmark", "inception_date", "expense_ratio", "fund_aum_cr", "fund_age"))


@_q("SELECT p_partkey AS doc_id, 1::INTEGER AS position, 'Ann ' || p_brand AS name, 'Equity' AS role, 'B.Com, MBA' AS qualification, p_size::INTEGER AS experience_years FROM part UNION ALL SELECT p_partkey, 2, 'Bob Sample', 'Debt', 'CA', NULL FROM part WHERE p_partkey % 2 = 0")
def doc_fund_managers(spark: SparkSession, d: str) -> DataFrame:
    return document.fund_managers(words(spark, d))


@_q("SELECT p_partkey AS doc_id, p_size + 0.25::DOUBLE AS std_dev_1y, CASE WHEN p_partkey % 3 <> 0 THEN p_size + 0.5::DOUBLE END AS std_dev_3y, 0.93::DOUBLE AS beta_1y, CAST(NULL AS DOUBLE) AS sharpe_1y FROM part")
def doc_risk_metrics(spark: SparkSession, d: str) -> DataFrame:
    return document.risk_metrics(words(spark, d)).select("doc_id", "std_dev_1y", "std_dev_3y", "beta_1y", "sharpe_1y")


@_q("SELECT p_partkey AS doc_id, 'Goods of ' || p_type AS sector, p_size + 0.5::DOUBLE AS weight_pct FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 'Other Things', 10 FROM part WHERE p_partkey % 5 <> 0")
def doc_sector_weights(spark: SparkSession, d: str) -> DataFrame:
    return document.sector_weights(words(spark, d))


@_q(
    f"SELECT p_partkey AS doc_id, (i + 1)::INTEGER AS rank, 'Alpha Beta Fund N' || i AS security_name, 30 - i + (p_partkey % 7) / 10.0::DOUBLE AS weight_pct, CASE WHEN p_partkey % 2 = 0 THEN {_D.format(-30)} WHEN p_partkey % 11 <> 0 THEN {_D.format(0)} END AS as_of_date FROM part, (SELECT unnest(range(10)) AS i)"
)
def doc_top_holdings(spark: SparkSession, d: str) -> DataFrame:
    return _text(document.top_holdings(words(spark, d)))


@_q("SELECT p_partkey AS doc_id, CAST(p_partkey % 100 + 1 AS INTEGER) AS total_securities, CASE WHEN p_partkey % 2 = 0 THEN 0.0::DOUBLE END AS modified_duration, p_size + 0.5::DOUBLE AS portfolio_pe, CAST(NULL AS DOUBLE) AS portfolio_pb FROM part")
def doc_characteristics(spark: SparkSession, d: str) -> DataFrame:
    return document.characteristics(words(spark, d)).select("doc_id", "total_securities", "modified_duration", "portfolio_pe", "portfolio_pb")


@_q("SELECT p_partkey AS doc_id, 'Equity' AS label, 100 - p_size + 0.5::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'Net Cash', -(p_size + 0.25::DOUBLE) FROM part")
def doc_composition(spark: SparkSession, d: str) -> DataFrame:
    return document.composition(words(spark, d))


@_q(f"SELECT p_partkey AS doc_id, -(p_size + 0.5::DOUBLE) AS drawdown_pct, CAST(p_partkey % 90 AS INTEGER) AS drawdown_duration_days, {_D.format(0)} AS drawdown_peak_date, CAST(NULL AS VARCHAR) AS drawdown_valley_date, CASE WHEN p_partkey % 3 <> 0 THEN {_D.format(50)} END AS drawdown_recovery_date FROM part")
def doc_drawdown(spark: SparkSession, d: str) -> DataFrame:
    return _text(document.drawdown(words(spark, d)))


@_q("SELECT p_partkey AS doc_id, 'AAA' AS label, p_size + 0.5::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'Unrated', 4 FROM part")
def doc_risk_rating(spark: SparkSession, d: str) -> DataFrame:
    return document.risk_rating(words(spark, d))


@_q("SELECT p_partkey AS doc_id, p_size + 0.5::DOUBLE AS large_cap_pct, CAST(NULL AS DOUBLE) AS mid_cap_pct, CAST(NULL AS DOUBLE) AS small_cap_pct FROM part")
def doc_market_caps(spark: SparkSession, d: str) -> DataFrame:
    return document.market_caps(words(spark, d))


@_q("SELECT p_partkey AS doc_id, 'Large Cap' AS cap, s.style, CASE s.style WHEN 'Blend' THEN p_size + 0.5::DOUBLE WHEN 'Growth' THEN 1.25 END AS value FROM part, (VALUES ('Blend'), ('Growth'), ('Value')) s(style)")
def doc_investment_style(spark: SparkSession, d: str) -> DataFrame:
    return document.investment_style(words(spark, d))


@_q(
    "SELECT p_partkey AS doc_id, t.kind AS period_type, t.label AS period_label, CASE t.n WHEN 0 THEN p_size + 0.28::DOUBLE WHEN 2 THEN p_size + 0.5::DOUBLE WHEN 3 THEN -1.25 WHEN 4 THEN 7.75 END AS return_pct FROM part, (VALUES (0, 'monthly', '2025-05'), (1, 'monthly', '2025-06'), (2, 'fy', 'FY 24'), (3, 'fy', 'FYTD'), (4, 'cy', 'CY 23')) t(n, kind, label)"
)
def doc_periodic_returns(spark: SparkSession, d: str) -> DataFrame:
    return document.periodic_returns(words(spark, d))


@_q(
    f"WITH h AS (SELECT * FROM part WHERE p_partkey % 7 <> 0) SELECT p_partkey AS doc_id, 'Alpha Bank Limited' AS security_name, p_size + 0.35::DOUBLE AS weight_pct, p_type AS sector, CAST(NULL AS VARCHAR) AS market_cap, 'Equity' AS instrument_type, {_D.format(0)} AS held_since FROM h UNION ALL SELECT p_partkey, 'Alpha Bank', -2.5, NULL, NULL, 'Debt', NULL FROM h UNION ALL SELECT p_partkey, 'Next Page', 3.5, NULL, NULL, NULL, NULL FROM h WHERE p_partkey % 2 = 1"
)
def doc_holdings(spark: SparkSession, d: str) -> DataFrame:
    return _text(document.holdings(words(spark, d)).select("doc_id", "security_name", "weight_pct", "sector", "market_cap", "instrument_type", "held_since"))


@_q("SELECT p_partkey AS doc_id, 1 AS page, count(*) AS n_lines FROM part, (SELECT unnest(range(14)) AS i) WHERE i < 10 OR p_partkey % 2 = 0 AND i < 13 OR i = 13 GROUP BY p_partkey")
def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = document.lines(document.page_words(words(spark, d), 1), document.LEFT)
    return rows.groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"))


@_q("SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END AS page, count(*) AS n_words FROM part, (SELECT unnest(range(1)) AS i) GROUP BY 1, 2")
def doc_anchor_page(spark: SparkSession, d: str) -> DataFrame:
    page = document.first_page_with(words(spark, d), "drawdown", (2, 3)).where("text = 'Drawdown'")
    return page.groupBy("doc_id", "page").agg(F.count("*").alias("n_words"))


@_q("SELECT p_partkey AS doc_id, 'header' AS section, 'header not found' AS error FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT p_partkey, 'sector_weights', 'sector_weights not found' FROM part WHERE p_partkey % 5 = 0 AND p_partkey % 3 = 0")
def doc_errors(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    kinds = tables.read(spark, d, "part").select(_k().alias("doc_id"), F.when(_k() % 3 == 0, "equity").otherwise("arbitrage").alias("kind"))
    return document.errors(kinds, {s: document.SECTIONS[s](w) for s in ("header", "fund_managers", "sector_weights", "drawdown")})


@_q("SELECT s_suppkey AS doc_id, ROUND(s_acctbal, 2) AS return_1m, s_suppkey + 0.5::DOUBLE AS return_1y, ROUND(s_acctbal, 2) - 1 AS return_1m_bm, CAST(NULL AS DOUBLE) AS return_1y_bm FROM supplier")
def doc_trailing_returns(spark: SparkSession, d: str) -> DataFrame:
    s = tables.read(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.round("s_acctbal", 2).alias("x"))
    x = lambda c: c.cast("decimal(20,2)").cast("string")
    row = lambda i, *cells: F.struct(F.lit(1).alias("page"), F.lit(0).alias("table"), F.lit(i).alias("row"), F.array(*(F.lit(c) if isinstance(c, str) else c for c in cells)).alias("cells"))
    cells = s.select("doc_id", F.inline(F.array(row(0, "", "above", ""), row(1, "Trailing  Returns %", "1 Month", " 1  Year "), row(2, "FUND", x(F.col("x")), _join(F.col("doc_id"), ".5%")), row(3, "Some Index", x(F.col("x") - 1), "NA"))))
    return document.trailing_returns(cells).select("doc_id", "return_1m", "return_1y", F.round("return_1m_bm", 2).alias("return_1m_bm"), "return_1y_bm")
