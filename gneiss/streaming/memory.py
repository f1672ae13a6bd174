"""The memory of conversations as a stream: what each has mentioned, fading with every message."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gneiss.operators.mentions import DECAY, FORGET, WINDOW

OUT = "conv_id long, turn long, path string, weight double"
STATE = "weights string, recent string, turn long"


def after_message(weights: dict[str, float], mentioned: list[str]) -> dict[str, float]:
    """One message on: every weight fades, what is faint is forgotten, what is mentioned is at 1."""
    faded = {p: w * DECAY for p, w in weights.items()}
    return {p: w for p, w in faded.items() if w >= FORGET} | dict.fromkeys(mentioned, 1.0)


def follow(messages: DataFrame) -> DataFrame:
    """A stream of messages(conv_id, turn, text, mentioned array<string>) -> after each batch the memory of the conversations that spoke.

    State is a map and the last texts of a conversation, bounded by what ``FORGET`` leaves and by ``WINDOW``.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weights, recent, turn = {}, [], -1
        if state.exists:
            w, r, turn = state.get
            weights, recent = json.loads(w), json.loads(r)
        rows = pd.concat(list(batches)).sort_values("turn")
        for t, text, mentioned in zip(rows["turn"], rows["text"], rows["mentioned"], strict=True):
            weights = after_message(weights, list(mentioned) if mentioned is not None else [])
            recent, turn = [*recent[-(WINDOW - 1) :], text], int(t)
        state.update((json.dumps(weights), json.dumps(recent), turn))
        names = sorted(weights)
        yield pd.DataFrame({"conv_id": [key[0]] * len(names), "turn": [turn] * len(names), "path": names, "weight": [round(weights[p], 6) for p in names]})

    return messages.groupBy("conv_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """A stream of events(ts, event_type) -> counts by window, late events dropped after ``late``."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("window"), "event_type").agg(F.count("*").alias("n"))
