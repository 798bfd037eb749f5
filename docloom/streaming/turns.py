"""Turns of sessions as a stream: state per session, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session string, turn long, events long, done boolean"


def turns(events: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """(session, turn, events, done) of a stream (session, ts, kind): a turn is given out once the next prompt starts, or its session is idle in event time; before the first prompt there is no turn. State is two numbers a session."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turn, n = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "turn": [turn], "events": [n], "done": [True]})
            return
        out, last = [], None
        for b in batches:
            for ts, kind in b.sort_values("ts")[["ts", "kind"]].itertuples(index=False):
                if kind == "prompt":
                    if turn:
                        out.append((key[0], turn, n, False))
                    turn, n = turn + 1, 0
                n += 1 if turn else 0
                last = ts if last is None else max(last, ts)
        state.update((turn, n))
        if last is not None:
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + ms)
        yield pd.DataFrame(out, columns=["session", "turn", "events", "done"])

    s = events.withWatermark("ts", "10 minutes").select("session", "ts", "kind")
    return s.groupBy("session").applyInPandasWithState(step, OUT, "turn long, n long", "append", GroupStateTimeout.EventTimeTimeout)
