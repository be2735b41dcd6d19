"""Optional language-model hooks, off by default: an injected function, guarded on both sides.

Nothing here opens a connection: a transport is a function that takes a request and a time limit and gives the
answer, and is given by whoever has one.
"""

from __future__ import annotations

import json
import math
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval

#: (system, user, most_tokens) -> text or None.
Ask = Callable[[str, str, int], str | None]
#: (request, seconds) -> the decoded answer; raises what it likes.
Transport = Callable[[dict, float], dict]
TELEMETRY = "requested_model string, served_model string, latency_seconds double, prompt_tokens long, completion_tokens long, cost double, outcome string"
PICK = "Copy from catalog_candidates the constraints that the message states, none else. Answer in JSON: {\"constraints\": [...]}."


def _amount(value, default: float = 0.0) -> float:
    """A finite number that may be written as text."""
    try:
        out = default if isinstance(value, bool) or value is None else float(value)
    except (TypeError, ValueError):
        out = default
    return out if math.isfinite(out) else default


class GuardedClient:
    """An Ask over a transport that answers None to anything out of order: a model that is not free, a late or broken answer, one of another
    model, one that has a price. Answers are kept; every request that is sent leaves a record without its texts."""

    def __init__(self, transport: Transport | None, model: str, seconds: float = 3.0, free: str = ":free"):
        self.transport, self.model, self.seconds, self.free = transport, model, seconds, free
        self.kept: dict[str, str] = {}
        self.records: list[dict] = []

    def __call__(self, system: str, user: str, most_tokens: int) -> str | None:
        if self.transport is None or not self.model.endswith(self.free) or not user.strip() or most_tokens <= 0:
            return None
        key = json.dumps([self.model, system, user, most_tokens])
        if key in self.kept:
            return self.kept[key]
        turns = [{"role": r, "content": c} for r, c in (("system", system), ("user", user)) if c.strip()]
        began, reply = time.perf_counter(), None
        try:
            reply = self.transport({"model": self.model, "messages": turns, "max_tokens": most_tokens, "temperature": 0, "stream": False}, self.seconds)
            outcome, said = self.judged(reply)
        except Exception as error:  # whatever a transport raises is an answer that did not come
            outcome, said = type(error).__name__, None
        self._record(outcome, time.perf_counter() - began, reply)
        if said is not None:
            self.kept[key] = said
        return said

    def judged(self, reply: dict) -> tuple[str, str | None]:
        """What is wrong with an answer, or "success" and its text."""
        if not isinstance(reply, dict):
            return "invalid_json_shape", None
        if reply.get("model") != self.model:
            return "model_mismatch", None
        usage = reply.get("usage") if isinstance(reply.get("usage"), dict) else {}
        price = _amount(usage.get("cost"), math.nan)
        if math.isnan(price) or price:
            return "invalid_cost" if math.isnan(price) else "nonzero_cost", None
        try:
            said = reply["choices"][0]["message"]["content"].strip()
        except (KeyError, IndexError, TypeError, AttributeError):
            return "missing_choices", None
        return ("success", said) if said else ("empty_content", None)

    def _record(self, outcome: str, seconds: float, reply) -> None:
        reply = reply if isinstance(reply, dict) else {}
        usage = reply.get("usage") if isinstance(reply.get("usage"), dict) else {}
        served = reply.get("model")
        self.records.append(
            {
                "requested_model": self.model, "served_model": served if isinstance(served, str) else None, "latency_seconds": max(0.0, seconds),
                "prompt_tokens": max(0, int(_amount(usage.get("prompt_tokens")))), "completion_tokens": max(0, int(_amount(usage.get("completion_tokens")))),
                "cost": max(0.0, _amount(usage.get("cost"))), "outcome": outcome,
            }
        )

    def telemetry(self, spark: SparkSession) -> DataFrame:
        """The records, for operators.metrics.telemetry."""
        return spark.createDataFrame(self.records, TELEMETRY)

    def reset(self) -> None:
        self.kept, self.records = {}, []


def normalized(messages: DataFrame, keys: DataFrame, materials: DataFrame, prices: DataFrame, ask: Ask | None = None) -> DataFrame:
    """messages (query_id, message, scenario, turn). Returns (query_id, constraint, source): what rules find in a message; where they find nothing,
    and it is no refusal, those of the catalog's candidates that the model picks and the exact index matches. Without ask, rules alone.

    The model is asked on the executors, once for each message left; it sees the candidates of that message, which are MOST_CANDIDATES at most.
    """
    m = F.coalesce("message", F.lit(""))
    found = messages.select("query_id", F.explode(T.dialog_constraints(m, F.col("scenario"), F.col("turn"))).alias("c"))
    rules = found.select("query_id", T.clean_constraint(F.col("c.text")).alias("constraint"), F.col("c.source").alias("source")).filter("constraint <> ''")
    if ask is None:
        return rules
    refusal = m.rlike(T.STILL_EXPLORING) | m.rlike(T.NO_PREFERENCE) | m.rlike(T.NO_ADDITIONAL)
    left = messages.filter((F.trim(m) != "") & ~refusal).join(rules.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "message")
    first = keys.groupBy("key").agg(F.min("ord").alias("first")).select("key", F.struct("first", "key").alias("key_ord"))
    offered = retrieval.catalog_candidates(left, first)
    listed = offered.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate"))), lambda c: c["candidate"]).alias("candidates"))
    kind = left.schema["query_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            replies = [ask(PICK, json.dumps({"message": t, "catalog_candidates": c}, ensure_ascii=False), 120) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r if isinstance(r, str) else None for r in replies], pa.string())], names=["query_id", "reply"])

    replies = left.join(listed, "query_id").select("query_id", "message", "candidates").mapInArrow(run, f"query_id {kind}, reply string")
    picked = replies.select("query_id", F.explode(T.json_strings(F.col("reply"))).alias("pick")).select("query_id", F.lower(T.clean_constraint(F.col("pick"))).alias("k")).distinct()
    chosen = offered.withColumn("k", F.lower("candidate")).join(picked, ["query_id", "k"])
    each = chosen.select(F.col("candidate").alias("query_id"), F.col("candidate").alias("constraint")).distinct()
    known = retrieval.exact_matches(each, keys, materials, prices).select(F.col("query_id").alias("candidate")).distinct()
    accepted = chosen.join(known, "candidate", "left_semi").select("query_id", F.col("candidate").alias("constraint"), F.lit("model").alias("source"))
    return rules.unionByName(accepted)


def normalized_constraints(message: str, found: list[str], candidates: list[str], is_known: Callable[[str], bool], ask: Ask | None) -> list[str]:
    """The same for one message: what rules found; else those of the catalog's candidates that the model picks, if the exact index knows them."""
    if found or ask is None or not candidates:
        return found
    reply = ask(PICK, json.dumps({"message": message, "catalog_candidates": candidates}), 120)
    return [v for v in parsed_list(reply) if v in candidates and is_known(v)]


def parsed_list(reply: str | None) -> list[str]:
    if not isinstance(reply, str):
        return []
    bare = re.sub(r"(?is)^\s*```(?:json)?\s*(.*?)\s*```\s*$", r"\1", reply)
    try:
        value = json.loads(bare)
    except ValueError:
        return []
    value = value.get("constraints") if isinstance(value, dict) else value
    return [v for v in value if isinstance(v, str)] if isinstance(value, list) else []


def detects_override(message: str, ask: Ask | None) -> bool:
    """By rules; where these see a chance only, by the model's word."""
    if re.search(T.OVERRIDE, message) or re.search(T.WHAT_I_NEED, message):
        return True
    if ask is None or not re.search(T.POSSIBLE_OVERRIDE, message):
        return False
    return (ask("Does the customer take back a preference? true or false.", message, 5) or "").strip().lower() == "true"


def explained(plain: str, ask: Ask | None, most: int = 240) -> str:
    """The plain explanation, or the model's wording of it if that is short enough."""
    reply = ask("Say this in one or two sentences.", plain, 100) if ask else None
    reply = " ".join(reply.split()) if isinstance(reply, str) else ""
    return reply if 0 < len(reply) <= most else plain
