"""Sessions of requests on a stream, with state and timers: repeated requests, candidates and confirmations, expiry.

State of a key is what its open sessions have received. A request id counts once while its session is open.
An event-time timer stands at the time when the earliest open session ends; when the watermark passes it
the session's result leaves and its state goes, so state is bounded by what arrives within the gap and
the watermark's delay. Events may come in any order within the delay: a session is
decided by its events' times when it ends, not by their arrival, so results are those of
``ledger.session_states`` over the same events, whichever batches they came in. Events later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the state store must be for state with timers.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_HELD = "request long, at timestamp, action string, value string"
_OUT = "key long, start timestamp, end timestamp, requests long, status string, value string"


def decided(events: list[tuple]) -> tuple[str, str | None]:
    """Status and value of a session's (request, at, action, value): the last candidate before the first confirmation stays."""
    order = sorted(events, key=lambda e: (e[1], e[0]))
    first = next((i for i, e in enumerate(order) if e[2] == "confirm"), len(order))
    before = [e for e in order[:first] if e[2] == "candidate"]
    return ("confirmed" if first < len(order) else "candidate"), (before[-1][3] if before else None)


def split(events: list[tuple], gap: pd.Timedelta) -> list[list[tuple]]:
    """Sessions: events with less than ``gap`` between neighbours."""
    found: list[list[tuple]] = []
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        if found and e[1] - found[-1][-1][1] < gap:
            found[-1].append(e)
        else:
            found.append([e])
    return found


class Sessions(StatefulProcessor):
    """Open sessions of a key."""

    def __init__(self, gap: str):
        self.gap = pd.Timedelta(gap)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)

    def _end(self, session: list[tuple]) -> int:
        return int((session[-1][1] + self.gap).timestamp() * 1000)

    def _wait(self, sessions: list[list[tuple]]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if sessions:
            self.handle.registerTimer(min(self._end(s) for s in sessions))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = {e[0]: tuple(e) for e in (self.held.get() if self.held.exists() else [])}
        for frame in rows:
            for request, at, action, value in frame[["request", "at", "action", "value"]].itertuples(index=False):
                new = (int(request), at.to_pydatetime(), action, value)
                # Of equal requests the earliest counts.
                if new[0] not in known or new[1] < known[new[0]][1]:
                    known[new[0]] = new
        self.held.put(list(known.values()))
        self._wait(split(list(known.values()), self.gap))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        sessions = split([tuple(e) for e in (self.held.get() if self.held.exists() else [])], self.gap)
        done, left = [s for s in sessions if self._end(s) <= now], [s for s in sessions if self._end(s) > now]
        if left:
            self.held.put([e for s in left for e in s])
        else:
            self.held.clear()
        self._wait(left)
        rows = [(key[0], s[0][1], s[-1][1] + self.gap, len(s), *decided(s)) for s in done]
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def session_states(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    """key, start, end, requests, status and value of each session of ``stream`` (key, request, at, action, value) that has ended."""
    return stream.withWatermark("at", delay).groupBy("key").transformWithStateInPandas(statefulProcessor=Sessions(gap), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
