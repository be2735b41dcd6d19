"""Conversations and events as streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import dialog
from ..plans.dialog import active, new_state, record_ask, step


def conversation_states(messages: DataFrame) -> DataFrame:
    """messages: a stream (session_id, turn, message). Emits each session's state after every new turn.

    The state of a session is its fold so far, kept as JSON in the state store; a micro-batch brings the turns that are new. It is the
    same fold as that of a batch (plans.dialog).
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    ready = dialog.message_features(messages).select("session_id", "turn", *dialog.FEATURES)

    def run(key, frames, state):
        import pandas as pd

        kept = json.loads(state.get[0]) if state.exists else new_state()
        rows = [r for frame in frames for r in frame.to_dict("records")]
        out = []
        for row in sorted(rows, key=lambda r: r["turn"]):
            row = {k: (list(v) if hasattr(v, "tolist") and not isinstance(v, (str, bool, int)) else v) for k, v in row.items()}
            step(kept, row, int(row["turn"]))
            out.append({"session_id": key[0], "turn": int(row["turn"]), "scenario": kept["scenario"], "active": active(kept), "overrides": kept["override_count"]})
            record_ask(kept, "other")
        state.update((json.dumps(kept, default=lambda v: v.item()),))
        yield pd.DataFrame(out)

    kind = ready.schema["session_id"].dataType.simpleString()
    return ready.groupBy("session_id").applyInPandasWithState(
        run, f"session_id {kind}, turn int, scenario string, active array<string>, overrides int", "state string", "append", GroupStateTimeout.NoTimeout
    )


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per tumbling window and type; rows later than the watermark are dropped in a stream."""
    w = F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "events", "total")


def event_sessions(events: DataFrame, gap: str = "6 hours", late: str = "12 hours") -> DataFrame:
    """Sessions of a user's events that follow each other within the gap."""
    s = F.session_window("ts", gap)
    out = events.withWatermark("ts", late).groupBy(s.alias("s"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")
