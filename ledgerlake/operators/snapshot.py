"""Revisions, snapshots, comparisons, moves of series, checks and logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlake.functions.clean import percent_change
from ledgerlake.operators.relational import latest, top_k


def revisions(df: DataFrame, key: Sequence[str], order: Sequence[Column], content: Column, at: str) -> DataFrame:
    """Changes of each key only: rows whose content hash equals that of the row before are skipped; revision counts from 1, superseded_at is the time of the next one."""
    w = W.partitionBy(*key).orderBy(*order)
    marked = df.withColumn("sha256", F.sha2(content, 256))
    changed = marked.withColumn("__before", F.lag("sha256").over(w)).where(~F.col("__before").eqNullSafe(F.col("sha256"))).drop("__before")
    return changed.withColumn("revision", F.row_number().over(w)).withColumn("superseded_at", F.lead(at).over(w))


def replaced(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows, and old ones of keys that have no new row."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").select(*old.columns).unionByName(new)


def inserted(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of `new`, one a key, whose key the target lacks. Again: none."""
    return latest(new, key, [F.col(c) for c in new.columns if c not in key] or [F.lit(1)]).join(target.select(*key), list(key), "left_anti").select(*new.columns)


def folded(log: DataFrame, feedback: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The log with the last feedback of each row."""
    last = feedback.groupBy(key).agg(F.max_by(value, F.struct(at, value)).alias(value))
    return log.join(last, key, "left")


def unknown(log: DataFrame, feedback: DataFrame, key: str) -> DataFrame:
    """Feedback on rows that the log does not have."""
    return feedback.join(log.select(key), key, "left_anti")


def shares(df: DataFrame, whole: Sequence[str], part: Sequence[str], value: str) -> DataFrame:
    """Percent of the whole's value that each part has."""
    parts = df.groupBy(*whole, *part).agg(F.sum(value).alias("__v"))
    total = F.sum("__v").over(W.partitionBy(*whole))
    return parts.select(*whole, *part, F.round(F.try_divide(F.col("__v"), total) * 100, 4).alias("weight_pct"))


def compared(names: Sequence[str], found: DataFrame, name: str, metrics: Sequence[str], defaults: Sequence[str]) -> DataFrame:
    """A row a requested name in the order asked, with the allowed metrics; names that are not found keep a row with an error."""
    asked = found.sparkSession.createDataFrame(list(enumerate(names)), "position int, requested string")
    kept = [m for m in metrics if m in found.columns] or list(defaults)
    rows = F.broadcast(asked).join(found, F.col("requested") == F.col(name), "left")
    return rows.select("position", "requested", *kept, F.when(F.col(name).isNull(), "not found").alias("error"))


def moves(bars: DataFrame, series: str, at: str, value: str, offsets: Sequence[int]) -> DataFrame:
    """The last bar of each series: changes against n bars before, extremes and how far off them it is."""
    w = W.partitionBy(series).orderBy(at)
    every = W.partitionBy(series)
    wide = bars.select(series, at, F.col(value).alias("close"), *(percent_change(F.col(value), F.lag(value, n).over(w)).alias(f"change_{n}") for n in offsets), F.max(value).over(every).alias("high"), F.min(value).over(every).alias("low"))
    out = latest(wide, [series], [F.desc(at)])
    return out.withColumn("off_high", percent_change(F.col("close"), F.col("high"))).withColumn("off_low", percent_change(F.col("close"), F.col("low")))


def full_snapshot(entities: DataFrame, facts: DataFrame, key: str, order: Sequence[Column], fact_value: str, part: str, k: int = 3, include: Sequence[str] = ()) -> DataFrame:
    """key, and the sections asked for (all if none or only unknown ones are): header (the latest fact), top (k largest facts), mix (parts by value).

    One exchange of the facts by key serves all sections: ranks are windows over it, and the sums of parts and the lists are made on it.
    """
    wanted = [s for s in ("header", "top", "mix") if s in include] or ["header", "top", "mix"]
    w = W.partitionBy(key)
    ranked = facts.withColumn("__n", F.row_number().over(w.orderBy(*order))).withColumn("__r", F.row_number().over(w.orderBy(F.desc(fact_value), *order)))
    parts = ranked.groupBy(key, part).agg(
        F.sum(fact_value).alias("__v"),
        F.max(F.when(F.col("__n") == 1, F.struct(*(c for c in facts.columns if c != key)))).alias("__header"),
        F.collect_list(F.when(F.col("__r") <= k, F.struct(F.col("__r").alias("rank"), F.col(fact_value)))).alias("__top"),
    )
    whole = parts.groupBy(key).agg(F.max("__header").alias("header"), F.sort_array(F.flatten(F.collect_list("__top"))).alias("top"), F.sum("__v").alias("__total"), F.sort_array(F.collect_list(F.struct(F.col(part), F.col("__v")))).alias("__parts"))
    mix = F.transform("__parts", lambda p: F.struct(p[part].alias(part), F.round(F.try_divide(p["__v"], F.col("__total")) * 100, 4).alias("weight_pct")))
    return entities.join(whole.withColumn("mix", mix).select(key, *wanted), key, "left")


#: What the snapshot section shows, where a snapshot has it.
METRICS = (
    *("as_of_date", "report_month", "expense_ratio", "fund_aum_cr", "inception_date", "fund_age"),
    *(f"return_{p}" for p in ("1m", "3m", "6m", "1y", "2y", "3y", "5y", "10y", "since_inception")),
    *(f"{m}_{p}" for p in ("1y", "3y") for m in ("sharpe", "std_dev", "beta", "r_square", "treynor", "info_ratio", "sortino", "up_capture", "down_capture", "tracking_error")),
    *("large_cap_pct", "mid_cap_pct", "small_cap_pct", "total_securities", "avg_mkt_cap_cr", "median_mkt_cap_cr", "portfolio_pe", "portfolio_pb", "portfolio_div_yield", "modified_duration", "avg_maturity_years", "yield_to_maturity"),
)
SECTIONS = ("snapshot", "benchmark", "top_holdings", "sector_weights", "managers", "drawdown")
_MANAGERS = "array<struct<name: string, role: string, qualification: string, experience_years: int>>"


def live(snapshots: DataFrame) -> DataFrame:
    """The latest snapshot of each entity that no other has superseded."""
    return latest(snapshots.where("superseded_at IS NULL"), ["entity_id"], [F.desc("as_of_date"), F.desc("revision"), F.desc("snapshot_id")])


def pictures(entities: DataFrame, snapshots: DataFrame, holdings: DataFrame, sectors: DataFrame, include: Sequence[str] = (), k: int = 10) -> DataFrame:
    """The columns of entities, has_snapshot and, as JSON without nulls, each section asked for (all if none or only unknown ones are).

    snapshots: entity_id, snapshot_id, as_of_date, report_month, revision, superseded_at and any of METRICS; benchmark, return_*_bm, drawdown_* and fund_managers_json where they are known.
    holdings: entity_id, report_month, security_name, weight_pct, ...; sectors: snapshot_id, sector, weight_pct.
    """
    wanted = [s for s in SECTIONS if s in include] or list(SECTIONS)
    now = live(snapshots)
    have = lambda c: F.col(c) if c in snapshots.columns else F.lit(None)
    json = lambda fields: F.to_json(F.struct(*fields))  # noqa: E731  drops nulls
    if "return_1y" in snapshots.columns and "return_1y_bm" in snapshots.columns:
        periods = [p for p in ("1y", "3y", "5y") if {f"return_{p}", f"return_{p}_bm"} <= set(snapshots.columns)]
        differences = [F.round(F.col(f"return_{p}") - F.col(f"return_{p}_bm"), 2).alias(p) for p in periods]
        alpha = F.when(F.coalesce(*differences).isNotNull(), F.struct(*differences))
    else:
        alpha = F.lit(None).cast("struct<`1y`: double>")
    made = {
        "snapshot": json([F.col(c) for c in METRICS if c in snapshots.columns]),
        "benchmark": json([have("benchmark").cast("string").alias("name"), *(have(f"return_{p}_bm").cast("double").alias(f"return_{p}_bm") for p in ("1y", "3y", "5y")), alpha.alias("alpha")]),
        "drawdown": json([have(f"drawdown_{c}").cast(t).alias(c) for c, t in (("pct", "double"), ("duration_days", "int"), ("peak_date", "date"), ("valley_date", "date"), ("recovery_date", "date"))]),
        "managers": F.to_json(F.coalesce(F.from_json(have("fund_managers_json").cast("string"), _MANAGERS), F.array().cast(_MANAGERS))),
    }
    out = now.select("entity_id", "snapshot_id", "report_month", F.lit(True).alias("has_snapshot"), *(made[s].alias(s) for s in wanted if s in made))
    if "top_holdings" in wanted:
        cells = [c for c in ("security_name", "weight_pct", "sector", "market_cap", "instrument_type") if c in holdings.columns]
        best = top_k(holdings, ["entity_id", "report_month"], [F.desc_nulls_last("weight_pct"), F.col("security_name"), *(F.col(c) for c in cells[2:])], k, "__r")
        listed = best.groupBy("entity_id", "report_month").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("__r", F.struct(*cells).alias("h")))), lambda x: x["h"])).alias("top_holdings"))
        out = out.join(listed, ["entity_id", "report_month"], "left").withColumn("top_holdings", F.coalesce("top_holdings", F.lit("[]")))
    if "sector_weights" in wanted:
        row = F.struct(F.coalesce(-F.col("weight_pct"), F.lit(float("inf"))).alias("less"), F.col("sector").alias("s"), F.struct("sector", "weight_pct").alias("x"))
        mix = sectors.groupBy("snapshot_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["x"])).alias("sector_weights"))
        out = out.join(mix, "snapshot_id", "left").withColumn("sector_weights", F.coalesce("sector_weights", F.lit("[]")))
    shown = entities.join(out, "entity_id", "left").withColumn("has_snapshot", F.coalesce("has_snapshot", F.lit(False)))
    return shown.select(*entities.columns, "has_snapshot", *wanted)


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """How many rows fail each rule, in one pass; a null outcome passes."""
    totals = df.agg(*(F.coalesce(F.sum((~F.coalesce(ok, F.lit(True))).cast("long")), F.lit(0)).alias(n) for n, ok in rules.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules))
    return totals.select(F.inline(pairs))


def recent_turns(turns: DataFrame, most: int = 6, cap: int = 2000) -> DataFrame:
    """The last turns of each conversation, texts cut; then only those of users and assistants."""
    rows = top_k(turns, ["conv_id"], [F.desc("turn")], most, "__n").drop("__n")
    return rows.where(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", F.substring("text", 1, cap).alias("text"))


def compacted(turns: DataFrame, most: int = 6, cap: int = 200) -> DataFrame:
    """A bullet list of the user questions before the last turns of each conversation that has some."""
    old = turns.withColumn("__n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where((F.col("__n") > most) & (F.col("role") == "user") & (F.trim("text") != ""))
    item = F.struct("turn", F.concat(F.lit("- "), F.substring("text", 1, cap)).alias("line"))
    return old.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["line"]), "\n").alias("note"))
