"""A few simulated sessions turn by turn, for reading and for showing: what was said, understood and shown."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame

from ..functions import text as T
from .evaluate import Catalog, Config, evaluate


def turns_of(samples: DataFrame, catalog: Catalog, config: Config = Config(), most: int = 20) -> dict[str, list[dict]]:
    """Every turn of each session by sample_id: turn, message, what the state made of it (scenario, constraints, epoch, query), ask, question,
    confidence, recommendations (rank, doc_id, title), and in the last one found, the outcome.

    Sessions are replayed together, once; more than most of them fail, as all that they show comes to the driver.
    """
    ids = [r["sample_id"] for r in samples.select("sample_id").limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"more than {most} sessions")
    traces: list[DataFrame] = []
    seen: dict[tuple[int, str], DataFrame] = {}
    outcomes = {r["sample_id"]: r.asDict() for r in evaluate(samples, catalog, config, traces=traces, observe=lambda turn, step, frame: seen.__setitem__((turn, step), frame)).collect()}
    out: dict[str, list[dict]] = {i: [] for i in ids}
    for turn, trace in enumerate(traces, 1):
        titled = seen[turn, "top"].join(catalog.products.select("doc_id", "title"), "doc_id").select("query_id", "rank", "doc_id", "title")
        listed: dict[str, list[tuple]] = {}
        for r in sorted(titled.collect(), key=lambda r: (r["query_id"], r["rank"])):
            listed.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["title"]))
        states = {r["sample_id"]: r for r in seen[turn, "context"].select("sample_id", "state.scenario", "state.epoch", "active").collect()}
        for r in trace.collect():
            i, state = r["sample_id"], states[r["sample_id"]]
            out[i].append(
                {
                    "turn": turn, "message": r["perturbed_message"], "scenario": state["scenario"], "constraints": list(state["active"]), "epoch": state["epoch"], "query": r["query"],
                    "ask": r["ask"], "question": T.QUESTIONS[r["ask"]], "confidence": r["confidence"], "recommendations": listed.get(i, []), "found": None,
                }
            )
    for i in ids:
        out[i][-1]["found"] = outcomes[i]
    return out


def transcripts(samples: DataFrame, catalog: Catalog, config: Config = Config(), most: int = 20) -> dict[str, str]:
    """The same as Markdown."""
    about = {r["sample_id"]: r for r in samples.select("sample_id", "scenario_type", "target").limit(most + 1).collect()}
    out = {}
    for i, turns in turns_of(samples, catalog, config, most).items():
        lines = [f"# {i}: {about[i]['scenario_type']}", "", f"Target: {about[i]['target']}", ""]
        for t in turns:
            lines += [f"## Turn {t['turn']}", "", f"Customer: {t['message']}", "", f"Agent: {t['question']} (confidence {t['confidence']:.3f})", ""]
            lines += [f"{rank}. {doc} {title}" + " (target)" * (doc == about[i]["target"]) for rank, doc, title in t["recommendations"]] + [""]
        found = turns[-1]["found"]
        lines.append(f"Found in turn {found['first_hit_turn']}, rank {found['best_rank']}." if found["hit"] else f"Not found in {config.turns} turns.")
        out[i] = "\n".join(lines) + "\n"
    return out


class Replay:
    """Sessions that are stepped through: what a server of a demo would call. A session is replayed when it is started; a step gives its next turn."""

    def __init__(self, catalog: Catalog, config: Config = Config(), most: int = 100):
        self.catalog, self.settings, self.most = catalog, config, most
        self.open: dict[str, list[dict]] = {}

    def config(self) -> dict:
        return {**asdict(self.settings), "products": self.catalog.products.count()}

    def start(self, sample: DataFrame) -> str:
        """sample: one row as evaluate takes it. Returns the session's key; the oldest session goes where most are open."""
        ((_, turns),) = turns_of(sample, self.catalog, self.settings, 1).items()
        key = uuid.uuid4().hex
        while len(self.open) >= self.most:
            self.open.pop(next(iter(self.open)))
        self.open[key] = turns
        return key

    def step(self, key: str) -> dict | None:
        """The next turn, or None after the last one; KeyError for a session that is not open."""
        turns = self.open[key]
        return turns.pop(0) if turns else None
