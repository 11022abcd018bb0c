"""Queries of the operators over the tables, each with its DuckDB twin."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.functions import clean, jsonx, text
from ledgerlake.operators import logs, match, relational, snapshot
from ledgerlake.plans import document_queries
from ledgerlake.plans.guard import query
from ledgerlake.plans.sql_queries import SQL
from ledgerlake.sources import tables
from ledgerlake.streaming import revisions as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _q(sql: str | None = None):  # noqa: ANN202
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _passthrough(name: str, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables.register(spark, sf_dir)
        return query(spark, sql, cap=None)

    run.__name__ = name
    return run


for _name, _sql in SQL.items():
    QUERIES[_name] = _passthrough(_name, _sql if isinstance(_sql, str) else _sql[0])
    ORACLE[_name] = _sql if isinstance(_sql, str) else _sql[1]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.read(spark, d, name)


@_q("SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_totalprice, c_name, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) o JOIN customer ON c_custkey = o_custkey WHERE n = 1")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    last = relational.latest(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])
    out = last.join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return out.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").cast("string").alias("o_orderdate"), "o_totalprice", "c_name", "c_mktsegment")


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
_LINE_SQL = ", ".join(_LINE)


@_q(f"SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, {_LINE_SQL}) AS rank FROM lineitem) t WHERE rank <= 10")
def top_holdings(spark: SparkSession, d: str) -> DataFrame:
    out = relational.top_k(_t(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), *map(F.col, _LINE)], 10)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "rank")


@_q(f"SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, {_LINE_SQL}, l_extendedprice) AS rank FROM lineitem) t WHERE rank <= 10")
def first_k(spark: SparkSession, d: str) -> DataFrame:
    out = relational.top_k(_t(spark, d, "lineitem"), ["l_suppkey"], [F.col("l_shipdate"), *map(F.col, _LINE), F.col("l_extendedprice")], 10)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@_q("SELECT l_suppkey, p_type, ROUND(SUM(l_extendedprice) * 100 / SUM(SUM(l_extendedprice)) OVER (PARTITION BY l_suppkey), 4) AS weight_pct FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey, p_type")
def sector_weights(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice").join(_t(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return snapshot.shares(lines, ["l_suppkey"], ["p_type"], "l_extendedprice")


@_q("SELECT * FROM (SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100) t")
def row_cap(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark, d, ["part"])
    return query(spark, "SELECT p_partkey, p_name FROM part ORDER BY p_partkey")


@_q("SELECT c_custkey, ROUND(m - AVG(m) OVER (PARTITION BY c_nationkey), 2) AS alpha FROM (SELECT c_custkey, c_nationkey, AVG(o_totalprice) AS m FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey) t")
def alpha_vs_benchmark(spark: SparkSession, d: str) -> DataFrame:
    means = _t(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    c = _t(spark, d, "customer").join(means, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.round(F.col("m") - F.avg("m").over(W.partitionBy("c_nationkey")), 2).alias("alpha"))


_NAMES = ["Supplier#000000003", "Nobody", "Supplier#000000001"]


@_q("SELECT n.position, n.requested, ROUND(s.s_acctbal, 2) AS s_acctbal, CASE WHEN s.s_name IS NULL THEN 'not found' END AS error FROM (VALUES (0, 'Supplier#000000003'), (1, 'Nobody'), (2, 'Supplier#000000001')) n(position, requested) LEFT JOIN supplier s ON s.s_name = n.requested")
def compare_entities(spark: SparkSession, d: str) -> DataFrame:
    out = snapshot.compared(_NAMES, _t(spark, d, "supplier"), "s_name", ["s_acctbal", "no_such_metric"], ["s_acctbal"])
    return out.withColumn("s_acctbal", F.round("s_acctbal", 2))


def _snapshot(spark: SparkSession, d: str, include: list[str]) -> DataFrame:
    facts = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    entities = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return snapshot.full_snapshot(entities, facts, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_totalprice", "o_orderpriority", 3, include)


@_q("WITH h AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, COUNT(DISTINCT o_orderpriority) AS n_parts, ROUND(list_sum(list_sort(list(o_totalprice), 'DESC')[1:3]), 2) AS top3 FROM orders GROUP BY o_custkey) SELECT c_custkey AS o_custkey, c_name, last_order, COALESCE(n_parts, -1) AS n_parts, top3 FROM customer LEFT JOIN h ON o_custkey = c_custkey")
def full_snapshot(spark: SparkSession, d: str) -> DataFrame:
    s = _snapshot(spark, d, [])
    top3 = F.round(F.aggregate("top", F.lit(0.0), lambda a, x: a + x["o_totalprice"]), 2)
    return s.select("o_custkey", "c_name", F.col("header.o_orderkey").alias("last_order"), F.when(F.col("mix").isNull(), -1).otherwise(F.size("mix")).cast("long").alias("n_parts"), F.when(F.col("top").isNotNull(), top3).alias("top3"))


@_q("SELECT c_custkey AS o_custkey, c_name, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def full_snapshot_include(spark: SparkSession, d: str) -> DataFrame:
    return _snapshot(spark, d, ["header", "unknown"]).select("o_custkey", "c_name", F.col("header.o_orderkey").alias("last_order"))


_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ")"
_SURFACE = "p_name || ' ' || p_brand || ' ' || p_type"


@_q(f"SELECT p_partkey, p_name, match_score FROM (SELECT p_partkey, p_name, len(list_intersect(['red', 'widget', 'economy'], list_filter(regexp_extract_all(lower({_SURFACE}), '[a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN {_STOP_SQL}))) AS match_score FROM part) t WHERE match_score > 0 ORDER BY match_score DESC, p_name, p_partkey LIMIT 10")
def fuzzy_lookup(spark: SparkSession, d: str) -> DataFrame:
    surface = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), "p_type")
    return match.fuzzy(_t(spark, d, "part"), surface, "the red wdg eco", [F.col("p_name"), F.col("p_partkey")]).select("p_partkey", "p_name", "match_score")


@_q(f"SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower({_SURFACE}), '[a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN {_STOP_SQL}), ' ') AS tokens FROM part")
def tokenize_stop(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", F.array_join(text.tokens(F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), "p_type")), " ").alias("tokens"))


@_q("SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower('SM ' || p_name || ' std'), '[a-z0-9]+'), lambda x: CASE x WHEN 'sm' THEN 'small' WHEN 'std' THEN 'standard' ELSE x END), ' ') AS expanded FROM part")
def abbrev_expand(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", text.expand(F.concat(F.lit("SM "), "p_name", F.lit(" std"))).alias("expanded"))


_TOPICS = [(0, "widget"), (1, "red ring"), (2, "ring"), (3, "a small gear in a box")]


@_q("SELECT p_partkey, p_name, MIN(position) AS topic FROM part LEFT JOIN (VALUES (0, 'widget'), (1, 'red ring'), (2, 'ring'), (3, 'a small gear in a box')) t(position, alias) ON contains(lower(trim(p_name)), alias) OR contains(alias, lower(trim(p_name))) GROUP BY p_partkey, p_name")
def faq_match(spark: SparkSession, d: str) -> DataFrame:
    return match.first_topic(_t(spark, d, "part").select("p_partkey", "p_name"), "p_name", _TOPICS, "topic")


_TOPIC_SQL = "(VALUES (0, 'widget'), (1, 'red ring'), (2, 'ring'), (3, 'a small gear in a box')) t(position, alias)"


@_q(
    f"WITH a AS (SELECT p_partkey, MIN(position) AS topic FROM part LEFT JOIN {_TOPIC_SQL} ON contains(lower(trim(p_name)), alias) OR contains(alias, lower(trim(p_name))) GROUP BY p_partkey), v AS (SELECT p_partkey, t.vec_id AS position, list_cosine_similarity(e.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS s FROM a JOIN embeddings e ON e.vec_id = p_partkey, (SELECT * FROM embeddings WHERE vec_id < 4) t WHERE a.topic IS NULL), b AS (SELECT p_partkey, arg_max(position, (s, -position)) AS position, MAX(s) AS s FROM v GROUP BY p_partkey) "
    "SELECT a.p_partkey, CAST(CASE WHEN a.topic IS NOT NULL THEN a.topic WHEN b.s >= 0.5 THEN b.position END AS INTEGER) AS topic, CASE WHEN a.topic IS NOT NULL THEN 'alias' WHEN b.s >= 0.5 THEN 'vector' ELSE 'not found' END AS how, CASE WHEN a.topic IS NULL THEN ROUND(b.s, 4) END AS score FROM a LEFT JOIN b USING (p_partkey)"
)
def topic_search(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    topics = e.where("vec_id < 4").select(F.col("vec_id").cast("int").alias("position"), "vector")
    return match.topic_search(_t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", _TOPICS, e.withColumnRenamed("vec_id", "p_partkey"), topics)


@_q("SELECT p_partkey, CASE WHEN lower(p_name) = 'red widget' THEN 1 WHEN contains(lower(p_name), 'red widget') THEN 2 WHEN contains(lower(p_name), 'red') THEN 3 END AS tier FROM part WHERE contains(lower(p_name), 'red')")
def fallback_match(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", match.fallback(F.col("p_name"), "Red Widget", " widget").alias("tier")).where("tier IS NOT NULL")


_LABELS = [("widget", "tool"), ("ring", "jewel"), ("red", "colour"), ("e", "other")]


@_q("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'widget') THEN 'tool' WHEN contains(lower(p_name), 'ring') THEN 'jewel' WHEN contains(lower(p_name), 'red') THEN 'colour' WHEN contains(lower(p_name), 'e') THEN 'other' END AS stem FROM part")
def label_map(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", text.first_label(F.col("p_name"), _LABELS).alias("stem"))


@_q("SELECT doc_id, CASE WHEN contains(lower(text), 'licensed under') THEN 'licence' WHEN contains(lower(text), 'idiot') THEN 'rude' WHEN contains(lower(text), '***') THEN 'noise' ELSE 'plain' END AS reason FROM documents")
def classify_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", text.first_label(F.col("text"), [("licensed under", "licence"), ("idiot", "rude"), ("***", "noise")], "plain").alias("reason"))


@_q("WITH p AS (SELECT a.vec_id, b.vec_id AS neighbour, ROUND(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT vec_id, arg_max(neighbour, (s, -neighbour)) AS neighbour, ROUND(MAX(s), 4) AS score, CAST(MAX(s) >= 0.5 AS INTEGER) AS matched FROM p GROUP BY vec_id")
def vector_top1(spark: SparkSession, d: str) -> DataFrame:
    return match.vector_top1(_t(spark, d, "embeddings"), "vec_id", "embedding")


@_q("WITH b AS (SELECT event_type, CAST(ts AS DATE) AS day, ROUND(SUM(value), 2) AS close FROM events GROUP BY 1, 2), m AS (SELECT *, " + ", ".join(f"ROUND((close - LAG(close, {n}) OVER w) / NULLIF(LAG(close, {n}) OVER w, 0) * 100, 2) AS change_{n}" for n in (1, 5, 21, 63)) + ", MAX(close) OVER (PARTITION BY event_type) AS high, MIN(close) OVER (PARTITION BY event_type) AS low, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS n FROM b WINDOW w AS (PARTITION BY event_type ORDER BY day)) SELECT event_type, CAST(day AS VARCHAR) AS day, close, change_1, change_5, change_21, change_63, high, low, ROUND((close - high) / NULLIF(high, 0) * 100, 2) AS off_high, ROUND((close - low) / NULLIF(low, 0) * 100, 2) AS off_low FROM m WHERE n = 1")
def market_state(spark: SparkSession, d: str) -> DataFrame:
    bars = _t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 2).alias("close"))
    return snapshot.moves(bars, "event_type", "day", "close", [1, 5, 21, 63]).withColumn("day", F.col("day").cast("string"))


@_q("SELECT event_type, CAST(SUM(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS BIGINT) AS total, COUNT(*) FILTER (WHERE ABS(CAST(json_extract_string(props, '$.k') AS DOUBLE) - 100) > 1.0) AS n_off FROM events GROUP BY event_type")
def composition_sum(spark: SparkSession, d: str) -> DataFrame:
    total = jsonx.map_total(F.from_json("props", "map<string,double>"))
    return _t(spark, d, "events").select("event_type", total.alias("t")).groupBy("event_type").agg(F.sum("t").cast("long").alias("total"), F.sum((F.abs(F.col("t") - 100) > 1.0).cast("long")).alias("n_off"))


@_q("SELECT r_name, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def json_map_build(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation").join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_name", "n_nationkey"))))).alias("nations"))


@_q("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM events")
def json_array_parse(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.lit("no json"))
    return _t(spark, d, "events").select("event_id", F.size(jsonx.json_array(c, "array<struct<k: bigint>>")).alias("n"))


@_q("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE '{\"_raw\":\"' || event_type || ' {\"}' END AS args FROM events")
def json_or_raw(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat("event_type", F.lit(" {")))
    return _t(spark, d, "events").select("event_id", jsonx.json_or_raw(c).alias("args"))


@_q("SELECT p_partkey, CASE WHEN p_size > 25 THEN 1 ELSE 0 END + CASE WHEN p_type = 'ECONOMY' THEN 0 ELSE 1 END + 1 AS n_kept FROM part")
def null_trim_count(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("size"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")), F.lit("type"), F.nullif("p_type", F.lit("ECONOMY")), F.lit("empty"), F.lit(""))
    return _t(spark, d, "part").select("p_partkey", F.size(jsonx.without_nulls(m)).alias("n_kept"))


@_q("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN 0.0 WHEN p_partkey % 7 = 2 THEN p_size / 2.0 ELSE p_partkey + 0.5 END AS x, CAST(CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN 0 WHEN p_partkey % 7 = 2 THEN floor(p_size / 2.0) ELSE p_partkey END AS INTEGER) AS n FROM part")
def clean_numeric(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 7
    dirty = F.when(k == 0, F.lit("N/A")).when(k == 1, F.lit("0E-9")).when(k == 2, F.concat((F.col("p_size") / 2).cast("string"), F.lit("%"))).otherwise(F.concat(F.format_number(F.col("p_partkey") + 0.5, 2), F.lit(" Cr")))
    return _t(spark, d, "part").select("p_partkey", clean.to_double(dirty).alias("x"), clean.to_int(dirty).alias("n"))


@_q("SELECT p_partkey, NULLIF(p_type, 'ECONOMY') AS kind FROM part")
def na_to_null(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", clean.na_to_null(F.when(F.col("p_type") == "ECONOMY", F.lit(" na ")).otherwise(F.concat(F.lit(" "), "p_type"))).alias("kind"))


@_q("SELECT p_partkey, TRY_CAST(NULLIF(regexp_extract(p_brand, '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS x FROM part")
def first_number(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", text.first_number(F.col("p_brand")).alias("x"))


@_q("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders")
def parse_dates(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate")
    dirty = F.when(k == 0, F.date_format(at, "d MMM yyyy")).when(k == 1, F.date_format(at, "dd-MMM-yyyy")).when(k == 2, F.date_format(at, "yyyy-MM-dd")).when(k == 3, F.date_format(at, "d/MMMM/yyyy")).otherwise(F.lit("NA"))
    return _t(spark, d, "orders").select("o_orderkey", clean.to_date(dirty).cast("string").alias("day"))


@_q("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def month_label(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", clean.month_key(F.date_format("o_orderdate", "MMMM yyyy")).alias("month"))


@_q("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'FYTD' WHEN 1 THEN 'FY ' || strftime(o_orderdate, '%y') WHEN 2 THEN 'YTD' ELSE 'CY ' || strftime(o_orderdate, '%y') END AS period FROM orders")
def period_label(spark: SparkSession, d: str) -> DataFrame:
    k, yy = F.col("o_orderkey") % 4, F.date_format("o_orderdate", "yy")
    raw = F.when(k == 0, F.lit("fytd")).when(k == 1, F.concat(F.lit("FY-"), yy)).when(k == 2, F.lit("YTD ")).otherwise(F.concat(F.lit("cy '"), yy))
    return _t(spark, d, "orders").select("o_orderkey", clean.period_label(raw).alias("period"))


@_q("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def extract_as_of(spark: SparkSession, d: str) -> DataFrame:
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate")
    spelled = F.when(k == 0, F.concat(F.lit("As On: "), F.date_format(at, "d MMM yyyy"))).when(k == 1, F.concat(F.lit("as on "), F.date_format(at, "dd-MMM-yy"))).when(k == 2, F.concat(F.lit("AS  ON - "), F.date_format(at, "d/MMM/yyyy"))).when(k == 3, F.concat(F.lit("As On:"), F.date_format(at, "d   MMMM yyyy"))).otherwise(F.concat(F.lit("As On "), F.date_format(at, "dd MMMM yy")))
    return _t(spark, d, "orders").select("o_orderkey", clean.as_of(F.concat(F.lit("Report "), spelled, F.lit(" page 1"))).cast("string").alias("day"))


@_q("SELECT doc_id, substring(text, instr(lower(text), 'the '), 200) AS part FROM documents WHERE instr(lower(text), 'the ') > 0")
def extract_after_marker(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", clean.after_marker(F.col("text"), "the ").alias("part")).where("part IS NOT NULL")


@_q("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'since launch' WHEN p_size % 3 = 1 THEN p_size || 'Y' ELSE p_size || 'Y 9M' END AS age FROM part")
def age_norm(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    raw = F.when(F.col("p_size") % 3 == 0, F.lit("since launch")).when(F.col("p_size") % 3 == 1, F.concat(n, F.lit(" Years"))).otherwise(F.concat(n, F.lit(" years 9 Months")))
    return _t(spark, d, "part").select("p_partkey", clean.age(raw).alias("age"))


@_q("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS labels, CAST(CAST(o_orderkey AS BIGINT) AS VARCHAR) || '.5' AS vals FROM orders")
def label_value_split(spark: SparkSession, d: str) -> DataFrame:
    labels, values = clean.labels_and_values(F.array(F.date_format("o_orderdate", "yyyy"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".5"))))
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(labels, " ").alias("labels"), F.array_join(values, " ").alias("vals"))


@_q("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@_q("SELECT p_partkey, lower(p_name) || ' x' AS name FROM part")
def norm_ws(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", text.norm_ws(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("  \t ")), F.lit("   X "))).alias("name"))


@_q("SELECT p_partkey, lower(p_name) || ' - ' || lower(p_type) AS name FROM part")
def unicode_norm(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", text.unicode_norm(F.concat("p_name", F.lit(" – "), "p_type")).alias("name"))


@_q("SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...[truncated]' ELSE text END) AS h FROM documents")
def truncate_marker(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(text.truncated(F.col("text"), 200)).alias("h"))


@_q("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\\bwidget\\b') THEN NULLIF(trim(regexp_extract(p_name, '^(.*?)\\bwidget\\b', 1)), '') WHEN regexp_matches(p_name, '\\bred\\b') THEN NULLIF(trim(regexp_extract(p_name, '^(.*?)\\bred\\b', 1)), '') ELSE NULLIF(trim(p_name), '') END AS prefix FROM part")
def prefix_before_token(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", text.prefix_before(F.col("p_name"), ["widget", "red"]).alias("prefix"))


@_q("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, TRY_CAST(NULLIF(regexp_extract(url, '/(\\d+)', 1), '') AS BIGINT) AS number FROM pages")
def regex_capture(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.nullif(F.regexp_extract("url", r"/(\d+)", 1), F.lit("")).cast("long").alias("number"))


@_q("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS name, CASE WHEN event_id % 2 = 0 THEN props END AS args FROM events")
def recover_markup(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("text <function="), "event_type", F.lit("\n"), "props", F.lit("</function> more"))).otherwise("none")
    name, args = text.marked_call(c)
    return _t(spark, d, "events").select("event_id", name.alias("name"), args.alias("args"))


@_q("SELECT p_partkey, p_name AS label, p_brand AS vals FROM part")
def split_by_band(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(F.struct(F.col("p_name").alias("text"), F.lit(10.0).alias("x0")), F.struct(F.col("p_brand").alias("text"), F.lit(60.0).alias("x0")))
    a, b = text.split_by_band(words, F.lit(50.0))
    return _t(spark, d, "part").select("p_partkey", a.alias("label"), b.alias("vals"))


_MONTH = "strftime(o_orderdate, '%Y-%m')"


@_q(f"SELECT o_custkey, {_MONTH} AS month, o_orderkey, row_number() OVER (PARTITION BY o_custkey, {_MONTH} ORDER BY o_orderdate, o_orderkey) AS revision FROM orders")
def revision_numbers(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    out = snapshot.revisions(o, ["o_custkey", "month"], [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_orderkey").cast("string"), "o_orderdate")
    return out.select("o_custkey", "month", "o_orderkey", "revision")


@_q("SELECT o_custkey, o_orderkey, CAST(LEAD(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE)::VARCHAR AS superseded_at FROM orders")
def supersede_derive(spark: SparkSession, d: str) -> DataFrame:
    out = snapshot.revisions(_t(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_orderkey").cast("string"), "o_orderdate")
    return out.select("o_custkey", "o_orderkey", F.to_date("superseded_at").cast("string").alias("superseded_at"))


@_q("SELECT user_id, event_id, sha256 FROM (SELECT user_id, event_id, sha256(event_type) AS sha256, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, event_type FROM events) t WHERE b IS DISTINCT FROM event_type")
def sha_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.revisions(_t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type"), "ts").select("user_id", "event_id", "sha256")


@_q("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (1, 2) UNION ALL SELECT n_nationkey, n_name || '*' FROM nation WHERE n_regionkey IN (1, 2)")
def replace_by_key(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation")
    new = n.where("n_regionkey IN (1, 2)").withColumn("n_name", F.concat("n_name", F.lit("*")))
    return snapshot.replaced(n, new, ["n_regionkey"]).select("n_nationkey", "n_name")


@_q("SELECT o_custkey, MIN(o_orderkey) AS first_key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY o_custkey")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    target = _t(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return snapshot.inserted(target, _t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("first_key")), ["o_custkey"])


@_q("SELECT kind, COUNT(*) AS n FROM (SELECT 'entity' AS kind FROM nation UNION ALL SELECT 'child' FROM region) t GROUP BY kind")
def snapshot_fanout(spark: SparkSession, d: str) -> DataFrame:
    folder = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    tables.publish({"entity": _t(spark, d, "nation"), "child": _t(spark, d, "region")}, folder, "b1")
    both = [tables.published(spark, folder, n).select(F.lit(n).alias("kind")) for n in ("entity", "child")]
    return both[0].union(both[1]).groupBy("kind").agg(F.count("*").alias("n"))


@_q("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'a|b' WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS errors FROM events")
def error_merge(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    a = F.when(e % 2 == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array().cast("array<string>"))
    b = F.when((e % 4 == 0) | (e % 2 == 1), F.array(F.lit("b"))).otherwise(F.array(F.lit("a")))
    return _t(spark, d, "events").select("event_id", F.array_join(F.array_union(a, b), "|").alias("errors"))


@_q("SELECT event_id, 1 AS n_checks, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS n_parse FROM events")
def error_split(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array_compact(F.array(F.lit("invariant:range"), F.when(F.col("event_type") == "error", F.lit("header"))))
    is_check = lambda x: x.startswith("invariant:")
    return _t(spark, d, "events").select("event_id", F.size(F.filter(tags, is_check)).alias("n_checks"), F.size(F.filter(tags, lambda x: ~is_check(x))).alias("n_parse"))


@_q("SELECT n_nationkey AS k, n_name AS name, CAST(NULL AS DOUBLE) AS bal FROM nation UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def schema_evolution(spark: SparkSession, d: str) -> DataFrame:
    old = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    new = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return old.unionByName(new, allowMissingColumns=True)


@_q("SELECT o_orderkey, e.event_id FROM (SELECT o_orderkey, o_custkey % 150 AS u, TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS at FROM orders) o JOIN (SELECT event_id, user_id, ts, LEAD(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events) e ON o.u = e.user_id AND o.at >= e.ts AND (e.until IS NULL OR o.at < e.until)")
def interval_join(spark: SparkSession, d: str) -> DataFrame:
    spans = _t(spark, d, "events").select("event_id", "user_id", F.col("ts").alias("since"), F.lead("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("until"))
    facts = _t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), F.expr("TIMESTAMP '2024-01-01 12:00:00' + make_dt_interval(CAST(o_orderkey % 30 AS INT))").alias("at"))
    return relational.valid_at(facts, spans, "user_id", "at", "since", "until").select("o_orderkey", "event_id")


@_q("SELECT e.event_id, s.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, MAX(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) s ON e.user_id = s.user_id AND e.ts >= s.ts")
def nearest_asof(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select("event_id", "user_id", "ts")
    p = _t(spark, d, "events").where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return relational.as_of(e, p, "user_id", "ts", "ts", ["last_purchase"]).select("event_id", "last_purchase")


@_q("SELECT event_id, CASE WHEN abs(value - 5.0) <= abs(value - 20.0) AND abs(value - 5.0) <= abs(value - 50.0) THEN 5.0 WHEN abs(value - 20.0) <= abs(value - 50.0) THEN 20.0 ELSE 50.0 END AS bucket FROM events")
def nearest_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", relational.nearest_value(F.col("value"), [5, 20, 50]).alias("bucket"))


@_q("WITH a AS (SELECT user_id, MIN(event_id) FILTER (WHERE event_type = 'click') AS s FROM events GROUP BY user_id), b AS (SELECT e.user_id, a.s, MIN(e.event_id) FILTER (WHERE e.event_type = 'error' AND e.event_id > a.s) AS t FROM events e JOIN a USING (user_id) GROUP BY e.user_id, a.s) SELECT e.event_id, e.user_id FROM events e JOIN b USING (user_id) WHERE e.event_id > b.s AND (b.t IS NULL OR e.event_id < b.t)")
def between_anchors(spark: SparkSession, d: str) -> DataFrame:
    out = relational.between_anchors(_t(spark, d, "events"), ["user_id"], F.col("event_id"), F.col("event_type") == "click", F.col("event_type") == "error")
    return out.select("event_id", "user_id")


@_q("SELECT event_id, user_id FROM (SELECT *, MAX(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) t WHERE s = 0")
def take_while(spark: SparkSession, d: str) -> DataFrame:
    return relational.take_while(_t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error").select("event_id", "user_id")


@_q("SELECT event_id, user_id FROM (SELECT *, CAST(ts AS DATE) AS day, MIN(CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) OVER (PARTITION BY user_id) AS p FROM events) t WHERE day = p")
def first_anchor_page(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumn("day", F.to_date("ts"))
    return relational.first_page_with(e, "user_id", "day", "event_type", "purchase").select("event_id", "user_id")


_RULES = {"quantity_in_range": "l_quantity BETWEEN 1 AND 40", "discount_in_range": "l_discount BETWEEN 0 AND 0.07", "tax_in_range": "l_tax BETWEEN 0 AND 5"}


@_q(" UNION ALL ".join(f"SELECT '{n}' AS rule, COUNT(*) FILTER (WHERE NOT ({r})) AS violations FROM lineitem" for n, r in _RULES.items()))
def dq_range(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.violations(_t(spark, d, "lineitem"), {n: F.expr(r) for n, r in _RULES.items()})


@_q("SELECT 'price_positive' AS rule, COUNT(*) FILTER (WHERE NOT (o_totalprice > 1000)) AS violations FROM orders UNION ALL SELECT 'known_status', COUNT(*) FILTER (WHERE NOT (o_orderstatus IN ('F', 'O'))) FROM orders")
def dq_report(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.violations(_t(spark, d, "orders"), {"price_positive": F.col("o_totalprice") > 1000, "known_status": F.col("o_orderstatus").isin("F", "O")})


@_q("SELECT n_nationkey AS k, n_name AS name, 'left' AS side, 1 AS n FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT n_nationkey + 100, n_name, 'right', 1 FROM nation WHERE n_nationkey < 3")
def diff_symmetric(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return relational.symmetric_difference(n, n.where("k < 20").union(n.where("k < 3").withColumn("k", F.col("k") + 100)))


@_q("SELECT conv_id, turn, role, substring(text, 1, 2000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) t WHERE n <= 6 AND role IN ('user', 'assistant')")
def conv_window(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.recent_turns(_t(spark, d, "conversations"))


@_q("SELECT conv_id, string_agg('- ' || substring(text, 1, 200), chr(10) ORDER BY turn) AS note FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) t WHERE n > 6 AND role = 'user' AND trim(text) <> '' GROUP BY conv_id")
def conv_compact(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.compacted(_t(spark, d, "conversations"))


_GRADE = "contains(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), 'th') AND contains(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), 'on t')"


@_q(f"SELECT item_id, CAST({_GRADE} AS INTEGER) AS passed FROM benchmark")
def grade_all_contains(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select("item_id", text.contains_all(F.col("text"), F.array(F.lit("TH"), F.lit("on t"))).cast("int").alias("passed"))


@_q("SELECT lang, COUNT(*) AS n, ROUND(AVG(quality), 4) AS pass_rate, CAST(SUM(n_chars) AS BIGINT) AS n_chars FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 4).alias("pass_rate"), F.sum("n_chars").alias("n_chars"))


@_q("SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS query_id, event_id, user_id FROM events")
def audit_log(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return _t(spark, d, "events").select(n.alias("query_id"), "event_id", "user_id")


@_q("SELECT user_id, COUNT(*) AS n, ROUND(GREATEST(SUM(value), MAX(value) * 2), 2) AS latency FROM events GROUP BY user_id")
def audit_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.greatest(F.sum("value"), F.max("value") * 2), 2).alias("latency"))


@_q("SELECT o_orderkey, f.event_type FROM orders LEFT JOIN (SELECT user_id, arg_max(event_type, (ts, event_type)) AS event_type FROM events GROUP BY user_id) f ON f.user_id = o_orderkey")
def feedback_fold(spark: SparkSession, d: str) -> DataFrame:
    log = _t(spark, d, "orders").select("o_orderkey")
    return snapshot.folded(log, _t(spark, d, "events").select(F.col("user_id").alias("o_orderkey"), "ts", "event_type"), "o_orderkey", "ts", "event_type")


@_q("SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders GROUP BY 1")
def status_report(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@_q("SELECT page_id, nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '') AS title, len(string_split(html, '<p>')) - 1 AS n_paragraphs FROM pages")
def doc_sections(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit("")).alias("title"), (F.size(F.split("html", "<p>")) - 1).alias("n_paragraphs"))


def _scratch(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a temporary one only in local tests, as executors of a cluster could not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="ledgerlake-")


@_q("SELECT p_name AS name, p_type AS kind, COUNT(*) AS n FROM part GROUP BY 1, 2")
def scan_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    _t(spark, d, "part").select(F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name"), F.col("p_type").alias("kind")).write.csv(path, header=True)
    return tables.csv_seed(spark, path, "name string, kind string").groupBy("name", "kind").agg(F.count("*").alias("n"))


@_q("SELECT r_regionkey AS topic_id, r_name AS title FROM region")
def faq_load(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    r = _t(spark, d, "region").agg(F.sort_array(F.collect_list(F.struct(F.col("r_regionkey").alias("topic_id"), F.col("r_name").alias("title")))).alias("topics"))
    r.coalesce(1).write.json(path)
    return tables.json_topics(spark, path, "topic_id: int, title: string")


@_q("SELECT 'region' AS key UNION ALL SELECT 'nation'")
def file_metadata_scan(spark: SparkSession, d: str) -> DataFrame:
    return tables.files(spark, d, "{region,nation}.parquet").select("key")


@_q("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, COUNT(*) AS n_events, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1, 2")
def ext_stream_daily(spark: SparkSession, d: str) -> DataFrame:
    return streams.daily(_t(spark, d, "events")).withColumn("day", F.col("day").cast("string"))


@_q("WITH b AS (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM b) SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS started, COUNT(*) AS n_events FROM s GROUP BY user_id, k")
def ext_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(_t(spark, d, "events"))


@_q("SELECT row_number() OVER (ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, ts, event_id) AS query_id, event_id FROM events")
def audit_append(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    e = _t(spark, d, "events").select("event_id", "ts", "event_type")
    logs.append(e.where("event_type <> 'error'"), path, ["ts", "event_id"])
    logs.append(e.where("event_type = 'error'"), path, ["ts", "event_id"])
    return logs.read_log(spark, path, "event_id long").select("query_id", "event_id")


@_q("SELECT event_id, user_id AS query_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def feedback_unknown(spark: SparkSession, d: str) -> DataFrame:
    log = _t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("query_id"))
    return snapshot.unknown(log, _t(spark, d, "events").select("event_id", F.col("user_id").alias("query_id")), "query_id")


@_q("SELECT r_name AS status, COUNT(*) AS n, MIN(n_name) AS first_entity FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def json_report(spark: SparkSession, d: str) -> DataFrame:
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    outcomes = _t(spark, d, "nation").join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("entity"), F.col("r_name").alias("status"), F.col("n_nationkey").alias("k"))
    logs.write_report(outcomes, "entity", "status", path)
    r = spark.read.json(path, schema="totals map<string,long>, outcomes map<string,array<struct<entity:string,k:long>>>, n long")
    return r.select("outcomes", F.explode("totals").alias("status", "n")).select("status", "n", F.array_min(F.transform(F.element_at("outcomes", F.col("status")), lambda x: x["entity"])).alias("first_entity"))


@_q("SELECT table_name AS name, CAST(COUNT(*) AS INTEGER) AS n_columns FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier') GROUP BY table_name")
def catalog_tables(spark: SparkSession, d: str) -> DataFrame:
    tables.register(spark, d)
    return logs.catalog(spark, ["pages"]).where(F.col("name").isin("region", "nation", "customer", "supplier")).select("name", "n_columns")


@_q("WITH q AS (SELECT CASE WHEN item_id % 7 = 0 THEN 0 ELSE item_id END AS id, item_id FROM benchmark) SELECT CAST(id AS VARCHAR) AS id, 'a refusal without a reason' AS fault FROM q WHERE item_id % 10 = 0 UNION ALL SELECT CAST(id AS VARCHAR), 'unknown category' FROM q WHERE item_id % 3 = 2 UNION ALL SELECT CAST(id AS VARCHAR), 'an answer that expects nothing' FROM q WHERE item_id % 5 <> 0 AND item_id % 4 = 1 UNION ALL SELECT '0', 'an id that comes again'")
def question_faults(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    q = _t(spark, d, "benchmark").select(
        F.when(i % 7 == 0, 0).otherwise(i).cast("string").alias("id"),
        F.concat(F.lit("c"), (i % 3).cast("string")).alias("category"),
        F.lit("What is it?").alias("question"),
        F.when(i % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))).alias("expected_answer_contains"),
        (i % 5 == 0).alias("must_refuse"),
        F.when(i % 10 != 0, F.lit("no_data")).alias("expected_refusal_reason"),
    )
    return logs.question_faults(q, ["c0", "c1"])


@_q("SELECT CAST(item_id AS VARCHAR) AS id, t.position FROM benchmark JOIN (VALUES (0, '7'), (1, '3'), (3, '11')) t(position, id) ON CAST(item_id AS VARCHAR) = t.id")
def sample_by_ids(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"))
    return logs.chosen(q, ["7", "3", "none", "11"]).select("id", "position")


@_q(
    "WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus <> 'P') t WHERE n = 1), h AS (SELECT s.o_custkey, LEAST(COUNT(*), 3) AS n_holdings, MAX(l_extendedprice) AS top_weight FROM s JOIN lineitem ON l_orderkey = o_orderkey GROUP BY s.o_custkey), m AS (SELECT s.o_custkey, COUNT(DISTINCT l_returnflag) AS n_sectors FROM s JOIN lineitem ON l_orderkey = o_orderkey GROUP BY s.o_custkey) "
    "SELECT c_custkey AS entity_id, s.o_orderkey IS NOT NULL AS has_snapshot, strftime(o_orderdate, '%Y-%m') AS report_month, CASE WHEN o_orderkey % 2 = 0 THEN 0.7::DOUBLE END AS alpha_1y, CASE WHEN s.o_orderkey IS NOT NULL THEN COALESCE(n_holdings, 0) END AS n_holdings, ROUND(top_weight, 2) AS top_weight, CASE WHEN s.o_orderkey IS NOT NULL THEN COALESCE(n_sectors, 0) END AS n_sectors FROM customer LEFT JOIN s ON s.o_custkey = c_custkey LEFT JOIN h ON h.o_custkey = c_custkey LEFT JOIN m ON m.o_custkey = c_custkey"
)
def entity_pictures(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").where("o_orderstatus <> 'P'")
    odd = F.col("o_orderkey") % 2 == 0
    snaps = o.select(F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("as_of_date"), F.date_format("o_orderdate", "yyyy-MM").alias("report_month"), F.lit(1).alias("revision"), F.lit(None).cast("timestamp").alias("superseded_at"), F.lit(6.65).alias("return_1y"), F.when(odd, F.lit(5.95)).alias("return_1y_bm"))
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    last = snapshot.live(snaps).select("entity_id", "report_month", "snapshot_id")
    held = lines.join(last, F.col("l_orderkey") == F.col("snapshot_id"))
    holdings = held.select("entity_id", "report_month", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("security_name"), F.col("l_extendedprice").alias("weight_pct"))
    sectors = held.groupBy("snapshot_id", F.col("l_returnflag").alias("sector")).agg(F.sum("l_extendedprice").alias("weight_pct"))
    p = snapshot.pictures(_t(spark, d, "customer").select(F.col("c_custkey").alias("entity_id")), snaps, holdings, sectors, k=3)
    return p.select(
        "entity_id",
        "has_snapshot",
        F.get_json_object("snapshot", "$.report_month").alias("report_month"),
        F.get_json_object("benchmark", "$.alpha.1y").cast("double").alias("alpha_1y"),
        F.json_array_length("top_holdings").cast("long").alias("n_holdings"),
        F.round(F.get_json_object("top_holdings", "$[0].weight_pct").cast("double"), 2).alias("top_weight"),
        F.json_array_length("sector_weights").cast("long").alias("n_sectors"),
    )


QUERIES |= document_queries.QUERIES
ORACLE |= document_queries.ORACLE
#: DuckDB ranks and counts in other widths than Spark: columns that its twin casts.
_WIDTHS = {
    "window_rank": {"r": "INTEGER", "dr": "INTEGER", "q": "INTEGER"},
    "top_holdings": {"rank": "INTEGER"},
    "first_k": {"rank": "INTEGER"},
    "fuzzy_lookup": {"match_score": "INTEGER"},
    "revision_numbers": {"revision": "INTEGER"},
    "diff_symmetric": {"n": "BIGINT"},
    "audit_log": {"query_id": "INTEGER"},
    "doc_sections": {"n_paragraphs": "INTEGER"},
}
for _name, _cols in _WIDTHS.items():
    ORACLE[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in _cols.items())}) FROM ({ORACLE[_name]}) t"
