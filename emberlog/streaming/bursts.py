"""Bursts of failed logins and the successes after them, exact, over a stream of attempts.

Each key keeps its attempts until the watermark has passed them; then they are worked through in order of time, as if
they had come in order. A burst is given out once, when the watermark says that it can no longer change: no failure can
make it longer, and no success can come that belongs to it. So a key holds its attempts of the last window and of the
time that the watermark lags behind, and a few numbers of its open burst, but none of its past.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from emberlog.operators.bursts import KEYS, keyed
from emberlog.settings import BurstSettings

ALERT = "rule string, key string, failures bigint, first_us bigint, last_us bigint, success_us bigint, severity string"


class _Key:
    """The attempts and bursts of one key, in microseconds."""

    def __init__(self, width: int, after: int, threshold: int, saved: str | None):
        self.width, self.after, self.threshold = width, after, threshold
        held = json.loads(saved) if saved else {}
        self.waiting: list[list[int]] = held.get("waiting", [])  # [time, failures, whether it's a success], not yet in order
        self.recent: list[list[int]] = held.get("recent", [])  # failures of the last window: [time, number, whether a burst has them]
        self.wins: list[int] = held.get("wins", [])  # successes that a burst may still take
        self.bursts: list[list[int]] = held.get("bursts", [])  # [failures, first, last], the last one perhaps open

    def saved(self) -> str:
        return json.dumps({"waiting": self.waiting, "recent": self.recent, "wins": self.wins, "bursts": self.bursts})

    def advance(self, until: int) -> None:
        """Works through the attempts before `until`, of which no more can come."""
        self.waiting.sort()
        ready = [x for x in self.waiting if x[0] < until]
        self.waiting = self.waiting[len(ready) :]
        k = 0
        while k < len(ready):
            at, failures = ready[k][0], 0
            while k < len(ready) and ready[k][0] == at:  # all of one instant at once
                failures += ready[k][1]
                if ready[k][2] and (not self.wins or self.wins[-1] != at):
                    self.wins.append(at)
                k += 1
            if failures:
                self._fail(at, failures)

    def _fail(self, at: int, failures: int) -> None:
        self.recent = [x for x in self.recent if x[0] >= at - self.width]
        self.recent.append([at, failures, 0])
        if sum(x[1] for x in self.recent) < self.threshold:
            return
        if not self.bursts or self.bursts[-1][2] < at - self.width:
            self.bursts.append([0, self.recent[0][0], at])
        burst = self.bursts[-1]
        burst[0] += sum(x[1] for x in self.recent if not x[2])
        burst[2] = at
        for x in self.recent:
            x[2] = 1

    def finished(self, until: int) -> list[tuple[int, int, int, int | None]]:
        """Takes out the bursts that what comes at `until` or later can't change, each with its success."""
        out = []
        while self.bursts and self.bursts[0][2] + self.width < until:
            failures, first, last = self.bursts[0]
            win = next((w for w in self.wins if w >= first), None)
            if win is None and last + self.after >= until:
                break
            out.append((failures, first, last, win if win is not None and win <= last + self.after else None))
            del self.bursts[0]
        self.recent = [x for x in self.recent if x[0] >= until - self.width]
        # an open burst takes the first success from its start on; one that isn't open yet starts with a recent failure
        starts = [b[1] for b in self.bursts]
        oldest = min([until, *(x[0] for x in self.recent)])
        needed = {next((w for w in self.wins if w >= s), None) for s in starts}
        self.wins = [w for w in self.wins if w in needed or w >= oldest]
        return out

    def next_change(self, until: int) -> int | None:
        """The time at which there is something to do if no attempt comes; None if nothing is held."""
        times = [x[0] + 1 for x in self.waiting] + [b[2] + max(self.width, self.after) + 1 for b in self.bursts] + [x[0] + self.width + 1 for x in self.recent] + [w + 1 for w in self.wins]
        return max(min(times), until + 1) if times else None


def stream_bursts(events: DataFrame, settings: BurstSettings = BurstSettings(), late: str = "10 minutes") -> DataFrame:
    """(rule, key, failures, first_us, last_us, success_us, severity): the bursts of a stream of events (ts, user, ip, outcome, n, source), each once.

    late: how far behind the newest attempt one may be to count; those behind it are left out. in any order within
    `late`, these are the rows of detect_bursts, but for bursts that the end of the stream leaves open. Rules that count related values aren't kept on streams and raise ValueError. Write it in append mode.
    """
    if any(r.measure != "failures" for r in settings.all_rules()):
        raise ValueError("streams count failures only")
    width, after = (round(d.total_seconds() * 1_000_000) for d in (settings.window, settings.success_after))
    threshold = settings.threshold

    def work(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = _Key(width, after, threshold, state.get[0] if state.exists else None)
        for b in batches:
            fails = b["outcome"] == "failure"
            own.waiting += [[int(t), int(n) if f else 0, int(not f)] for t, n, f in zip(b["us"], b["n"], fails, strict=True)]
        until = state.getCurrentWatermarkMs() * 1000
        own.advance(until)
        rows = own.finished(until)
        at = own.next_change(until)
        if at is None:
            if state.exists:
                state.remove()
        else:
            state.update((own.saved(),))
            state.setTimeoutTimestamp(at // 1000 + 1)
        if not rows:
            return
        yield pd.DataFrame(
            {"rule": key[0], "key": key[1], "failures": [r[0] for r in rows], "first_us": [r[1] for r in rows], "last_us": [r[2] for r in rows], "success_us": pd.array([r[3] for r in rows], "Int64"), "severity": ["media" if r[3] is None else "alta" for r in rows]}
        )

    marked = events.where(F.col("outcome").isin("failure", "success")).withWatermark("ts", late)
    rows = keyed(marked, settings, "ts").select(*KEYS, "ts", "us", "outcome", "n")
    return rows.groupBy(*KEYS).applyInPandasWithState(work, ALERT, "saved string", "append", GroupStateTimeout.EventTimeTimeout)
