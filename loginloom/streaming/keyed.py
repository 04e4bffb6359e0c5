"""Rules with keyed state whose result doesn't depend on the order of arrival.

Rows wait in the state of their key until the watermark has passed them; an event-time timer then folds them in order of (t,
event_id). A row that comes within the allowed lateness is therefore treated as if it had come in time, and what the window no longer
needs is evicted by the same timers, also for keys that have fallen silent.
"""

from __future__ import annotations

from collections import deque
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400
FANOUT = "event_id long, src long, fanout_accounts long, fanout_novel long, dst_novel int, baseline double, fanout_hop int"


class FanoutState(StatefulProcessor):
    """The fan-out rule of one source host.

    State: waiting rows; hosts reached, for good or for `forget` seconds after the last success; accounts with their last success and
    times of novel moves, both of the open window only; the day's greatest account count and those of the last active days.
    """

    def __init__(self, accounts: int = 8, novel: int = 5, baseline: float = 2.0, window: int = 3_600, days: int = 7, forget: int | None = None):
        self.least_accounts, self.least_novel, self.most_baseline = accounts, novel, baseline
        self.window, self.n_days, self.forget = window, days, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, t long, usr long, dst long, success int")
        self.reached = handle.getMapState("reached", "dst long", "t long")
        self.accounts = handle.getMapState("accounts", "usr long", "t long")
        self.moves = handle.getListState("moves", "t long")
        self.daily = handle.getValueState("daily", "day long, most long, history array<long>")

    def _wake(self, times: list[int]) -> None:
        """One timer for the key, at the least of the times (seconds)."""
        at = min(times, default=None)
        for old in list(self.handle.listTimers()):
            if at is None or old != at * 1000:
                self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at * 1000)

    def handleInputRows(self, key, rows, timerValues):
        came = [(int(r.event_id), int(r.t), int(r.usr), int(r.dst), int(r.success)) for frame in rows for r in frame.itertuples()]
        self.waiting.appendList(came)
        earliest = [x // 1000 for x in self.handle.listTimers()]
        self._wake([*earliest, *(r[1] for r in came)])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        upto = timerValues.getCurrentWatermarkInMs() // 1000
        held = list(self.waiting.get())
        due = sorted((r for r in held if r[1] <= upto), key=lambda r: (r[1], r[0]))
        later = [r for r in held if r[1] > upto]
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        out = self._fold(int(key[0]), due, upto)
        wake = [r[1] for r in later]
        if self.accounts.exists() or self.moves.exists():  # to let go of them when nothing else comes
            wake.append(upto + self.window)
        self._wake(wake)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FANOUT.split(", ")])

    def _fold(self, src: int, rows: list[tuple], upto: int) -> list[tuple]:
        last = {k[0]: v[0] for k, v in self.accounts.iterator()}
        order = deque(sorted((t, usr) for usr, t in last.items()))
        moves = deque(sorted(t for (t,) in self.moves.get()))
        day, most, history = self.daily.get() if self.daily.exists() else (None, 0, [])
        history = list(history or [])
        known: dict[int, int | None] = {}

        def reached(dst: int, t: int) -> bool:
            if dst not in known:
                known[dst] = self.reached.getValue((dst,))[0] if self.reached.containsKey((dst,)) else None
            return known[dst] is not None and (self.forget is None or known[dst] >= t - self.forget)

        def evict(t: int) -> None:
            while order and order[0][0] <= t - self.window:
                at, usr = order.popleft()
                if last.get(usr) == at:
                    del last[usr]
            while moves and moves[0] <= t - self.window:
                moves.popleft()

        out, changed, at = [], set(), 0
        while at < len(rows):
            t, upto_here = rows[at][1], at
            while upto_here < len(rows) and rows[upto_here][1] == t:
                upto_here += 1
            second, at = rows[at:upto_here], upto_here
            evict(t)
            if day != t // DAY:
                history = [*history, most][-self.n_days :] if day is not None else history
                day, most = t // DAY, 0
            most = max(most, len(last))
            usual = float(median(history)) if history else 0.0
            busy = len(last) >= self.least_accounts and len(moves) >= self.least_novel and usual <= self.most_baseline
            for event_id, _, _, dst, success in second:
                new = not reached(dst, t)
                out.append((event_id, src, len(last), len(moves), int(new), usual, int(busy and new and success == 1)))
            for _, _, usr, dst, success in second:
                if success == 1:
                    if not reached(dst, t):
                        moves.append(t)
                    known[dst], last[usr] = t, t
                    changed.add(dst)
                    order.append((t, usr))
        for dst in changed:
            self.reached.updateValue((dst,), (known[dst],))
        if self.forget is not None:
            for k, (t,) in list(self.reached.iterator()):
                if t < upto - self.forget:
                    self.reached.removeKey(k)
        evict(upto)
        self.accounts.clear()
        for usr, t in last.items():
            self.accounts.updateValue((usr,), (t,))
        self.moves.clear()
        if moves:
            self.moves.put([(t,) for t in moves])
        if day is not None:
            self.daily.update((day, most, history))
        return out

    def close(self) -> None:
        pass


def fanout_rule(stream: DataFrame, late: str = "10 minutes", **limits) -> DataFrame:
    """The columns of FANOUT for each event that the watermark has passed; state is keyed by source host.

    A row later than the watermark is dropped, as everywhere in Structured Streaming. limits: those of FanoutState.
    """
    rows = stream.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", late)
    return rows.groupBy("src").transformWithStateInPandas(statefulProcessor=FanoutState(**limits), outputStructType=FANOUT, outputMode="Append", timeMode="EventTime")


def start_fanout_rule(stream: DataFrame, out_dir: str, checkpoint: str, late: str = "10 minutes", **limits):
    return fanout_rule(stream, late, **limits).writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
