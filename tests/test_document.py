"""Sections of a laid-out document: one of all sections, made by hand, and odd ones."""

import datetime
import json

import pytest

from ledgerlake.operators import document as doc

WORDS = "doc_id string, page int, ord int, x0 double, top double, text string, size double"


def spread(rows):
    """(page, x0, top, text[, size]): words of a text from x0 on, 4 apart; spans (with a size) stay whole."""
    out = []
    for page, x0, top, text, *size in rows:
        if size:
            out.append((page, float(x0), float(top), text, size[0]))
        else:
            out += [(page, x0 + 4.0 * i, float(top), t, 7.5) for i, t in enumerate(text.split())]
    return out


PAGE_1 = [
    (1, 30, 20, "Acme Multi", 16.0),
    (1, 30, 36, "Cap Fund -", 16.0),
    (1, 30, 50, "Mutual Fund - Equity: Multi Cap", 12.0),
    (1, 30, 100, "Benchmark", 7.5),
    (1, 120, 101, "40% Index One", 7.5),
    (1, 120, 109, "+ 60% Index Two", 7.5),
    (1, 30, 125, "Inception Date", 7.5),
    (1, 120, 125, "28-Jul-23", 7.5),
    (1, 30, 140, "Min Investment", 7.5),
    (1, 120, 140, "5,000", 7.5),
    (1, 30, 155, "Expense Ratio", 7.5),
    (1, 120, 155, "1.85%", 7.5),
    (1, 30, 170, "Exit Load/Lock-in", 7.5),
    (1, 120, 170, "Nil", 7.5),
    (1, 300, 100, "Fund AUM", 7.5),
    (1, 330, 100, "(cr.)", 7.5),
    (1, 302, 118, "4,679.32", 7.5),
    (1, 300, 185, "Overview", 7.5),
    (1, 300, 195, "It invests  in", 7.5),
    (1, 300, 205, "many things.", 7.5),
    (1, 300, 215, "Age:", 7.5),
    (1, 330, 215, "2 Years 9 Months", 7.5),
    (1, 400, 215, "As On: 04-May-26", 7.5),
    (1, 30, 230, "Fund Manager Detail", 7.5),
    (1, 30, 240, "Ann Example", 7.5),
    (1, 30, 250, "FUND MANAGER - EQUITY", 7.5),
    (1, 30, 260, "Qualification: B.Com, MBA. Experience: over 17.5 years", 7.5),
    (1, 30, 270, "in the market.", 7.5),
    (1, 30, 280, "Bob Sample", 7.5),
    (1, 30, 290, "Senior Manager – Equity & Debt", 7.5),
    (1, 30, 300, "Qualification: CA", 7.5),
    (1, 30, 310, "Performance", 7.5),
]
PAGE_2 = [
    (2, 24, 20, "Risk Analysis"),
    (2, 24, 40, "Standard Deviation"),
    (2, 120, 41, "17.66"),
    (2, 180, 41, "NA"),
    (2, 24, 60, "Sharpe Ratio"),
    (2, 120, 60, "-0.01"),
    (2, 180, 60, "0.5"),
    (2, 24, 80, "Beta"),
    (2, 120, 80, "0.93"),
    (2, 24, 85, "Sharpe again"),
    (2, 120, 85, "9"),
    (2, 24, 100, "Portfolio Characteristics"),
    (2, 24, 110, "Total Securities 101.00"),
    (2, 24, 120, "Avg Mkt Cap (Cr) 286729.50"),
    (2, 24, 130, "Modified Duration 0E-9"),
    (2, 24, 140, "Portfolio P/E Ratio 28.98"),
    (2, 24, 150, "Composition"),
    (2, 24, 160, "Equity 95.93"),
    (2, 24, 170, "Net Cash -4.07"),
    (2, 215, 10, "4.5 chart 3.2"),
    (2, 215, 20, "Sector Wts(%)"),
    (2, 215, 30, "Financial Services 30.5"),
    (2, 215, 40, "Health 10"),
    (2, 215, 45, "no number"),
    (2, 215, 50, "Risk Rating %"),
    (2, 215, 60, "Equity 95.91"),
    (2, 215, 70, "AAA 4.00"),
    (2, 215, 90, "Decrease in Exposure 5"),
    (2, 310, 100, "Mkt Cap"),
    (2, 310, 110, "Composition"),
    (2, 310, 120, "Large Cap 43.36"),
    (2, 310, 130, "Mid Cap NA"),
    (2, 310, 140, "Small Cap 12.5"),
    (2, 400, 40, "Top Holdings (As On: 31 Mar 2026)"),
    (2, 400, 66, "Acme Money Manager"),
    (2, 500, 70, "11.35"),
    (2, 400, 74, "Fund - Dir"),
    (2, 400, 90, "Other Bank"),
    (2, 500, 90, "5.5"),
    (2, 400, 110, "Composition"),
    (2, 420, 300, "Blend"),
    (2, 470, 300, "Growth"),
    (2, 520, 300, "Value"),
    (2, 400, 320, "Large Cap"),
    (2, 424, 320, "4.52"),
    (2, 522, 320, "NA"),
    (2, 468, 320, "7.1"),
    (2, 400, 340, "Mid Cap"),
    (2, 421, 340, "1.5"),
]
PAGE_3 = [
    (3, 24, 20, "Drawdown Analysis"),
    (3, 24, 40, "Draw Down (%)"),
    (3, 100, 40, "-14.58"),
    (3, 24, 60, "Duration Days"),
    (3, 100, 60, "80"),
    (3, 24, 80, "Peak Date"),
    (3, 100, 80, "02 Jan 2026"),
    (3, 24, 100, "Recovery Date"),
    (3, 100, 100, "Not Yet Recovered"),
    (3, 24, 120, "Increase in Exposure"),
    (3, 24, 130, "Valley Date"),
    (3, 100, 130, "01 Jan 2020"),
]
PAGE_4 = [
    (4, 465, 20, "Month on Month Fund Index"),
    (4, 465, 30, "May 2025 4.28 3.00"),
    (4, 465, 40, "MTD NA 1.00"),
    (4, 465, 60, "Financial Year"),
    (4, 465, 70, "FY 24 12.50 11.00"),
    (4, 465, 80, "FYTD -1.25"),
    (4, 465, 90, "Calendar Year"),
    (4, 465, 100, "CY 23 7.75 6.00"),
    (4, 465, 110, "Risk & Volatility"),
    (4, 465, 120, "FY 11 1.10"),
]
HOLDINGS = [
    (5, 20, 20, "Detailed Portfolio"),
    *((5, x, 40, t) for x, t in ((20, "Security"), (150, "Wts"), (200, "Sector"), (270, "Market"), (335, "Instrument"), (405, "Risk"), (460, "Investment"), (520, "Held"))),
    (5, 20, 59, "HDFC Bank"),
    (5, 150, 60, "9.35"),
    (5, 20, 64, "Limited"),
    (5, 200, 60, "Banks"),
    (5, 270, 60, "Large Cap"),
    (5, 335, 60, "Equity"),
    (5, 405, 60, "Na"),
    (5, 460, 60, "Blend"),
    (5, 520, 60, "31 Jan 2024"),
    (6, 20, 30, "HDFC Bank"),
    (6, 150, 30, "-2.5"),
    (6, 335, 30, "Debt"),
    (6, 20, 50, "Year"),
    (6, 150, 50, "2024"),
    (6, 20, 100, "Sector Wts. Trend"),
    (6, 20, 120, "After the end"),
    (6, 150, 120, "1.0"),
    (7, 20, 30, "Not a holding"),
    (7, 150, 30, "3.0"),
]


@pytest.fixture(scope="module")
def words(spark):
    rows = spread(PAGE_1 + PAGE_2 + PAGE_3 + PAGE_4 + HOLDINGS)
    every = [("a", p, i, x, y, t, s) for i, (p, x, y, t, s) in enumerate(rows)]
    odd = [("none", 1, 0, 30.0, 20.0, "only a title", 16.0), ("none", 2, 1, 30.0, 20.0, "word", 7.5), ("none", 2, None, None, None, None, None), ("nothing", None, None, None, None, None, None)]
    return spark.createDataFrame(every + odd, WORDS).repartition(3).cache()


def rows_of(df, *order):
    rows = df.where("doc_id = 'a'").drop("doc_id")
    return [r.asDict() for r in (rows.orderBy(*order) if order else rows).collect()]


def test_header(words):
    assert rows_of(doc.required(words)) == [{"scheme_name": "Acme Multi Cap Fund", "as_of_date": datetime.date(2026, 5, 4)}]
    assert rows_of(doc.header(words)) == [
        {
            "sub_category": "Equity: Multi Cap",
            "benchmark": "40% Index One + 60% Index Two",
            "inception_date": datetime.date(2023, 7, 28),
            "min_investment": "5,000",
            "expense_ratio": 1.85,
            "exit_load": "Nil",
            "fund_aum_cr": 4679.32,
            "fund_age": "2Y 9M",
            "overview": "It invests in many things.",
        }
    ]
    assert doc.required(words).where("doc_id <> 'a'").collect() == []


def test_fund_managers(words):
    assert rows_of(doc.fund_managers(words), "position") == [
        {"position": 1, "name": "Ann Example", "role": "Equity", "qualification": "B.Com, MBA", "experience_years": 17},
        {"position": 2, "name": "Bob Sample", "role": "Equity & Debt", "qualification": "CA", "experience_years": None},
    ]


def test_risk_and_characteristics(words):
    (risk,) = rows_of(doc.risk_metrics(words))
    assert {k: v for k, v in risk.items() if v is not None} == {"std_dev_1y": 17.66, "sharpe_1y": -0.01, "sharpe_3y": 0.5, "beta_1y": 0.93}
    assert len(risk) == 20
    (found,) = rows_of(doc.characteristics(words))
    assert {k: v for k, v in found.items() if v is not None} == {"total_securities": 101, "avg_mkt_cap_cr": 286729.5, "modified_duration": 0.0, "portfolio_pe": 28.98}


def test_shares(words):
    assert rows_of(doc.sector_weights(words), "sector") == [{"sector": "Financial Services", "weight_pct": 30.5}, {"sector": "Health", "weight_pct": 10.0}]
    assert rows_of(doc.composition(words), "label") == [{"label": "Equity", "value": 95.93}, {"label": "Net Cash", "value": -4.07}]
    assert rows_of(doc.risk_rating(words), "label") == [{"label": "AAA", "value": 4.0}, {"label": "Equity", "value": 95.91}]
    assert rows_of(doc.market_caps(words)) == [{"large_cap_pct": 43.36, "mid_cap_pct": None, "small_cap_pct": 12.5}]


def test_top_holdings(words):
    day = datetime.date(2026, 3, 31)
    assert rows_of(doc.top_holdings(words), "rank") == [
        {"rank": 1, "security_name": "Acme Money Manager Fund - Dir", "weight_pct": 11.35, "as_of_date": day},
        {"rank": 2, "security_name": "Other Bank", "weight_pct": 5.5, "as_of_date": day},
    ]
    assert len(rows_of(doc.top_holdings(words, 1))) == 1


def test_investment_style(words):
    got = {(r["cap"], r["style"]): r["value"] for r in rows_of(doc.investment_style(words))}
    assert got == {("Large Cap", "Blend"): 4.52, ("Large Cap", "Growth"): 7.1, ("Large Cap", "Value"): None, ("Mid Cap", "Blend"): 1.5, ("Mid Cap", "Growth"): None, ("Mid Cap", "Value"): None}


def test_drawdown_on_the_third_page(words):
    assert rows_of(doc.drawdown(words)) == [{"drawdown_pct": -14.58, "drawdown_duration_days": 80, "drawdown_peak_date": datetime.date(2026, 1, 2), "drawdown_valley_date": None, "drawdown_recovery_date": None}]


def test_periodic_returns(spark, words):
    months = spark.createDataFrame([("a", "2026-05")], "doc_id string, report_month string")
    got = {(r["period_type"], r["period_label"]): r["return_pct"] for r in rows_of(doc.periodic_returns(words, months))}
    assert got == {("monthly", "2025-05"): 4.28, ("monthly", "2026-05"): None, ("fy", "FY 24"): 12.5, ("fy", "FYTD"): -1.25, ("cy", "CY 23"): 7.75}
    assert ("monthly", "2026-05") not in {(r["period_type"], r["period_label"]) for r in rows_of(doc.periodic_returns(words))}


def test_holdings_over_pages(words):
    got = rows_of(doc.holdings(words), "page", "y")
    first = {"security_name": "HDFC Bank Limited", "weight_pct": 9.35, "sector": "Banks", "market_cap": "Large Cap", "instrument_type": "Equity", "risk_rating": None, "investment_style": "Blend", "held_since": datetime.date(2024, 1, 31)}
    assert [{k: v for k, v in r.items() if k not in ("page", "y")} for r in got] == [first, dict.fromkeys(first) | {"security_name": "HDFC Bank", "weight_pct": -2.5, "instrument_type": "Debt"}]


def test_trailing_returns(spark):
    cells = [
        ("a", 1, 0, 0, ["something", "else"]),
        ("a", 1, 1, 0, ["Trailing Returns %", "1 Month", " 1  Year", "10 Years", "Since Inception"]),
        ("a", 1, 1, 1, ["", "x", None, None, None]),
        ("a", 1, 1, 2, ["Fund", "1.5", "6.65", "NA", "12.0%"]),
        ("a", 1, 1, 3, ["NIFTY 500", "-0.5", "5.95"]),
        ("a", 1, 1, 4, ["Category", "9", "9", "9", "9"]),
        ("b", 1, 1, 0, ["Trailing Returns %", "1 Month"]),
    ]
    got = doc.trailing_returns(spark.createDataFrame(cells, "doc_id string, page int, `table` int, row int, cells array<string>")).collect()
    assert len(got) == 1
    assert {k: v for k, v in got[0].asDict().items() if v is not None} == {"doc_id": "a", "return_1m": 1.5, "return_1y": 6.65, "return_since_inception": 12.0, "return_1m_bm": -0.5, "return_1y_bm": 5.95}


def test_tables_from_words(spark):
    rows = [("a", 1, i, x, y, t, 7.5) for i, (x, y, t) in enumerate([(20.0, 10.0, "Trailing"), (30.0, 10.0, "Returns"), (100.0, 10.0, "1"), (104.0, 10.0, "Year"), (150.0, 10.0, "3"), (20.0, 20.0, "Fund"), (100.0, 21.0, "6.65"), (150.0, 20.0, "NA")])]
    got = doc.tables_of(spark.createDataFrame(rows, WORDS), "trailing returns", ["1 year", "3 years"]).collect()
    assert [r.cells for r in got] == [["Fund", "6.65", "NA"]]


def test_lines_join_the_first_near_one(spark):
    w = spark.createDataFrame([("a", 1, i, 10.0 * i, y, f"w{i}", 7.5) for i, y in enumerate([0.0, 3.0, 6.0, 3.4, 3.5])], WORDS)
    assert sorted((r.y, r.tokens) for r in doc.lines(w, (0.0, 600.0)).collect()) == [(0.0, ["w0", "w1", "w3"]), (3.5, ["w2", "w4"])]


def test_missing_sections_are_errors(spark, words):
    kinds = spark.createDataFrame([("a", "equity"), ("none", "arbitrage")], "doc_id string, kind string")
    found = {name: section(words) for name, section in doc.SECTIONS.items()}
    got = {(r.doc_id, r.section) for r in doc.errors(kinds, found).collect()}
    assert got == {("none", s) for s in doc.EXPECTED["arbitrage"] if s in found}


def test_no_words(spark, words):
    for section in doc.SECTIONS.values():
        assert section(words.limit(0)).collect() == []


def test_labels():
    assert json.loads(json.dumps(sorted(doc.EXPECTED))) == ["arbitrage", "debt", "equity", "hybrid", "multi_asset"]


def _joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastExchange") + plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin")


def test_top_holdings_gathers_a_document_once(words):
    assert _joins(doc.top_holdings(words)) == 0


def test_documents_are_dealt_before_they_become_words(spark, tmp_path):
    from ledgerlake.plans import document_queries as q

    spark.range(1, 2 * q.DOCUMENTS + 2).selectExpr("id AS p_partkey", "'a b' AS p_name", "'Brand#1' AS p_brand", "'ECONOMY' AS p_type", "5 AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    w = q.words(spark, str(tmp_path))
    assert w.rdd.getNumPartitions() == 3
    plan = doc.top_holdings(w)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_investment_style_reads_the_lines_once(words):
    assert _joins(doc.investment_style(words)) == 0


def test_periodic_returns_read_the_words_once(words):
    plan = doc.periodic_returns(words)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1


def test_holdings_gather_a_page_once(words):
    assert _joins(doc.holdings(words)) == 0


def test_errors_are_told_apart_without_joins(spark):
    kinds = spark.createDataFrame([("a", "debt"), ("b", "debt"), ("c", "none"), ("d", None)], "doc_id string, kind string")
    found = {"header": kinds.where("doc_id = 'a'"), "drawdown": kinds.limit(0)}
    got = doc.errors(kinds, found)
    assert _joins(got) == 0
    assert [tuple(r) for r in got.collect()] == [("b", "header", "header not found")]
