"""The six tools of an assistant and their dispatcher: each takes arguments and gives a dictionary, and none raises."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import match, snapshot
from ledgerlake.plans import guard

MOST_MATCHES = 10
OFFSETS = (1, 5, 21, 63)


@dataclass
class Store:
    """The tables that the tools look at. entities: entity_id, name, family, category; bars: series, day, close; topics: position, topic_id, title, aliases, content; the others as in snapshot.pictures."""

    spark: SparkSession
    entities: DataFrame
    snapshots: DataFrame
    holdings: DataFrame
    sectors: DataFrame
    bars: DataFrame
    topics: DataFrame
    #: Gives the vector of a text; None: only names and aliases are compared. topic_vectors: position, vector.
    embed: Callable[[str], list[float]] | None = None
    topic_vectors: DataFrame | None = field(default=None)


def _bad(what: str) -> dict:
    return {"error": "bad_arguments", "message": what}


def _text(arguments: Mapping, name: str) -> str | None:
    x = arguments.get(name)
    return x.strip() if isinstance(x, str) and x.strip() else None


def _matches(store: Store, hint: str, most: int) -> list[dict]:
    found = match.fuzzy(store.entities, F.concat_ws(" ", "name", "family", "category"), hint, [F.col("name"), F.col("entity_id")], most)
    return [r.asDict() for r in found.select("entity_id", "name", "family", "category", "match_score").collect()]


def query_db(store: Store, arguments: Mapping) -> dict:
    return guard.answer(store.spark, arguments.get("sql"))


def lookup_entity(store: Store, arguments: Mapping) -> dict:
    hint = _text(arguments, "name")
    if not hint:
        return _bad("'name' must be a text that is not empty")
    rows = _matches(store, hint, MOST_MATCHES)
    return {"matched": True, "rows": rows} if rows else {"matched": False, "name": hint, "message": f"nothing matches '{hint}'"}


def compare_entities(store: Store, arguments: Mapping) -> dict:
    """One entry a name, in the order asked."""
    names, metrics = arguments.get("names"), arguments.get("metrics")
    if not (isinstance(names, list) and names and all(isinstance(n, str) and n.strip() for n in names)):
        return _bad("'names' must be a list of texts")
    if metrics is not None and not isinstance(metrics, list):
        return _bad("'metrics' must be a list")
    allowed = [m for m in metrics or () if m in snapshot.METRICS and m in store.snapshots.columns]
    shown = allowed or [m for m in snapshot.METRICS if m in store.snapshots.columns]
    best = [(n, found[0] if (found := _matches(store, n, 1)) else None) for n in names]
    ids = [m["entity_id"] for _, m in best if m]
    rows = {r["entity_id"]: json.loads(r["m"]) for r in snapshot.live(store.snapshots.where(F.col("entity_id").isin(*ids))).select("entity_id", F.to_json(F.struct(*shown)).alias("m")).collect()} if ids else {}
    return {"rows": [{"requested": n, "error": "not found"} if m is None else {"requested": n, "name": m["name"], **(rows.get(m["entity_id"]) or {"error": "no_snapshot"})} for n, m in best]}


def get_full_snapshot(store: Store, arguments: Mapping) -> dict:
    hint, include = _text(arguments, "hint"), arguments.get("include")
    if not hint:
        return _bad("'hint' must be a text that is not empty")
    if include is not None and not isinstance(include, list):
        return _bad("'include' must be a list")
    found = _matches(store, hint, 1)
    if not found:
        return {"matched": False, "hint": hint, "message": f"nothing matches '{hint}'"}
    one = F.col("entity_id") == found[0]["entity_id"]
    row = snapshot.pictures(store.entities.where(one), store.snapshots.where(one), store.holdings.where(one), store.sectors, include or ()).first().asDict()
    out = {"matched": True, "entity": {k: row[k] for k in ("entity_id", "name", "family", "category")}}
    if not row["has_snapshot"]:
        return out | {"snapshot": None, "message": "no snapshot"}
    return out | {s: json.loads(row[s]) for s in snapshot.SECTIONS if s in row}


def get_market_state(store: Store, arguments: Mapping) -> dict:
    series = arguments.get("series")
    if series is not None and not isinstance(series, list):
        return _bad("'series' must be a list")
    bars = store.bars.where(F.col("series").isin(*series)) if series else store.bars
    rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in snapshot.moves(bars, "series", "day", "close", OFFSETS).orderBy("series").collect()]
    return {"rows": rows, "errors": [{"series": s, "error": "unknown series"} for s in series or () if s not in {r["series"] for r in rows}]}


def get_topic(store: Store, arguments: Mapping) -> dict:
    """An entry whose title or alias is in the topic or that it is in, else the one of the nearest vector, else the list of topics."""
    asked = _text(arguments, "topic")
    if not asked:
        return _bad("'topic' must be a text that is not empty")
    topics = [r.asDict() for r in store.topics.orderBy("position").collect()]
    names = [(t["position"], a) for t in topics for a in (t["title"], *(t["aliases"] or ())) if a]
    question = store.spark.createDataFrame([(0, asked)], "id int, topic_asked string")
    embeds = store.embed is not None and store.topic_vectors is not None
    vectors = store.spark.createDataFrame([(0, store.embed(asked.lower()))] if embeds else [], "id int, vector array<double>")
    of = store.topic_vectors if embeds else store.spark.createDataFrame([], "position int, vector array<double>")
    row = match.topic_search(question, "id", "topic_asked", names, vectors, of).first()
    hit = next((t for t in topics if row is not None and t["position"] == row["topic"]), None)
    if hit:
        return {"matched": True, "how": row["how"], **{k: v for k, v in hit.items() if v is not None}}
    return {"matched": False, "topic": asked, "available_topics": [{"topic_id": t["topic_id"], "title": t["title"]} for t in topics]}


_STRING, _STRINGS = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
#: name: (function, what it is for, properties, required ones)
_TOOLS: dict[str, tuple[Callable[[Store, Mapping], dict], str, dict, list[str]]] = {
    "query_db": (query_db, "Rows of a read-only SELECT, 100 at most.", {"sql": _STRING}, ["sql"]),
    "lookup_entity": (lookup_entity, "Entities whose name, family or category shares words with a text, best first, 10 at most.", {"name": _STRING}, ["name"]),
    "compare_entities": (compare_entities, "The latest metrics of several entities side by side, in the order asked.", {"names": _STRINGS, "metrics": _STRINGS}, ["names"]),
    "get_full_snapshot": (get_full_snapshot, f"All that is known of one entity. Sections: {', '.join(snapshot.SECTIONS)}.", {"hint": _STRING, "include": _STRINGS}, ["hint"]),
    "get_market_state": (get_market_state, "Moves of series: changes, extremes and how far off them they are.", {"series": _STRINGS}, []),
    "get_topic": (get_topic, "The entry on a topic, or the topics that there are.", {"topic": _STRING}, ["topic"]),
}
SCHEMAS = [{"type": "function", "function": {"name": n, "description": d, "parameters": {"type": "object", "properties": p, "required": r}}} for n, (_, d, p, r) in _TOOLS.items()]


def dispatch(store: Store, name: str, arguments: object) -> str:
    """The answer of a tool as JSON, dates as ISO texts; errors are answers too."""
    if not isinstance(arguments, Mapping):
        out = _bad("arguments must be a dictionary")
    elif name not in _TOOLS:
        out = {"error": "unknown_tool", "message": f"no tool '{name}'; there are {', '.join(sorted(_TOOLS))}"}
    else:
        try:
            out = _TOOLS[name][0](store, arguments)
        except Exception as e:  # the loop that asks has to go on
            out = {"error": "unexpected", "message": str(e).split("\n")[0]}
    return json.dumps(out, default=str)


#: A client answers messages with a text or with calls: {"text": ...} or {"calls": [(name, arguments), ...]}.
Client = Callable[[list[dict]], Mapping]


def ask(store: Store, question: str, client: Client, history: list[dict] | None = None, most: int = 6) -> dict:
    """The loop between a client and the tools: answer, trace of calls and, where `most` rounds give no answer, a refusal."""
    messages, trace = [*(history or ()), {"role": "user", "text": question}], []
    for _ in range(most):
        said = client(messages)
        if not said.get("calls"):
            return {"answer": said.get("text") or "", "trace": trace, "refusal_reason": None}
        for name, arguments in said["calls"]:
            result = dispatch(store, name, arguments)
            trace.append({"tool": name, "arguments": arguments, "result": result})
            messages.append({"role": "tool", "name": name, "text": result})
    return {"answer": "", "trace": trace, "refusal_reason": "loop_exceeded"}
