"""One conversation at a time: reset and respond.

A thin face over the same plan that batches use; for single requests, where latency of a plan
is acceptable. State is one dict per session.
"""

from __future__ import annotations

import logging

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fill, fusion, retrieval
from . import dialog
from .evaluate import Catalog, Config, retrieve

log = logging.getLogger(__name__)


class Agent:
    """respond() never fails: where retrieval goes wrong, which is logged, the list is filled from the catalog."""

    def __init__(self, catalog: Catalog, config: Config = Config()):
        self.catalog, self.config = catalog, config
        self.sessions: dict[str, dict] = {}

    def reset(self, session_id: str, profile: dict | None = None) -> None:
        self.sessions[session_id] = {"state": dialog.new_state(), "shown": set(), "opening": None, "seed": dialog.profile_key(profile or {})}

    def respond(self, session_id: str, message: str, turn: int) -> dict:
        session = self.sessions.get(session_id)
        if session is None:
            self.reset(session_id)
            session = self.sessions[session_id]
        spark = self.catalog.products.sparkSession
        state, confidence, found = session["state"], 0.0, []
        try:
            one = spark.createDataFrame([(session_id, message)], "query_id string, message string")
            row = dialog.message_features(one).first().asDict(recursive=True)
            epoch = state["epoch"]
            dialog.step(state, row, turn)
            if state["epoch"] != epoch:
                session["shown"] = set()
            if row["named_category"]:
                session["opening"] = message
            asked = spark.createDataFrame([(session_id, state["category"], dialog.active(state), message, session["opening"])], "query_id string, category string, active array<string>, message string, category_message string")
            turns = asked.withColumn("query", T.compose_query(F.col("category"), F.col("active"), F.col("message")))
            pool = held = retrieve(turns, self.catalog, self.config).cache()
            sure = fusion.confidence(pool).first()
            confidence = sure["confidence"] if sure else 0.0
            if self.config.freshness and session["shown"]:
                pool = fusion.fresh(pool, spark.createDataFrame([(session_id, d) for d in session["shown"]], "query_id string, doc_id string"))
            best = retrieval.top_k(pool.drop("rank"), self.config.top, ["query_id"], [F.desc("score"), F.asc("base_rank")])
            found = [r["doc_id"] for r in best.orderBy("rank").collect()]
            held.unpersist()
        except Exception:  # a broken turn still gets an answer
            log.warning("retrieval failed in turn %s of session %s", turn, session_id, exc_info=True)
            found = []
        shown = session["shown"] if self.config.freshness else set()
        frame = lambda rows, kind: spark.createDataFrame(rows, f"query_id string, {kind}")
        filled = fill.recommendations(
            frame([(session_id, session["seed"], turn)], "key string, turn int"), frame([(session_id, d, i) for i, d in enumerate(found)], "doc_id string, rank int"),
            self.catalog.positions, frame([(session_id, d) for d in sorted(shown)], "doc_id string"), self.config.top,
        )
        items = [r["doc_id"] for r in filled.orderBy("rank").collect()]
        session["shown"] |= set(items)
        ask = dialog.next_ask(state, self.config.policy)
        dialog.record_ask(state, ask)
        return {
            "message": T.QUESTIONS[ask], "ask_attribute": ask, "recommendations": [{"parent_asin": i} for i in items],
            "usage": {"prompt_tokens": 0, "completion_tokens": 0}, "confidence": confidence,
        }
