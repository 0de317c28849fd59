"""A bounded queue of checks as a stateful stream: tasks are queued, coalesced, dropped, taken, and end in one result each.

Requests(queue, seq, action, memory_id, version) come in any number of micro-batches; within one they are
taken in order of seq.  A queue is one key: it holds at most ``most_pending`` tasks, and remembers the
last ``most_results`` results, so its state is bounded.  Actions:

* ``enqueue``: a task ``semantic:id@version``.  One that has its result gives none again; a newer snapshot of a
  waiting record takes its place, and the older task ends as ``coalesced_by_newer_snapshot``; with the
  queue full, paused, disabled or shut down, the task ends with that as its reason, and drops are counted.
* ``take``: the oldest task ends as ``checked``; nothing is taken while paused, disabled or shut down.
* ``pause``, ``resume``, ``disable`` (what waits ends), ``enable``, ``shutdown`` (what waits ends; for good).

Tasks that have waited for ``most_wait_ms`` (processing time) end as ``timed_out``, by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "queue string, task_id string, status string, reason string, waiting int, processed long, dropped long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CheckQueue(StatefulProcessor):
    def __init__(self, most_pending: int = 100, most_results: int = 1_000, most_wait_ms: int | None = None):
        self.most_pending, self.most_results, self.most_wait_ms = most_pending, most_results, most_wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # runtime: paused, disabled, shut down; processed, dropped; numbers of the next task and result
        self.runtime = handle.getValueState("runtime", "paused boolean, disabled boolean, ended boolean, processed long, dropped long, tasks long, results long")
        self.waiting = handle.getMapState("waiting", "memory_id long", "place long, task_id string, since long")
        self.results = handle.getMapState("results", "task_id string", "place long")
        self.order = handle.getMapState("order", "place long", "task_id string")

    def _load(self) -> None:
        self.now = list(self.runtime.get()) if self.runtime.exists() else [False, False, False, 0, 0, 0, 0]
        self.queue = {k[0]: tuple(v) for k, v in self.waiting.iterator()}
        self.out: list[tuple] = []

    def _end(self, task: str, status: str, reason: str | None) -> None:
        """The one result of a task; the oldest results are forgotten."""
        place = self.now[6]
        self.results.updateValue((task,), (place,))
        self.order.updateValue((place,), (task,))
        self.now[6] += 1
        old = place - self.most_results
        if old >= 0:
            forgotten = self.order.getValue((old,))[0]
            if self.results.getValue((forgotten,))[0] == old:
                self.results.removeKey((forgotten,))
            self.order.removeKey((old,))
        self.out.append((task, status, reason))

    def _drop(self, memory: int, reason: str) -> None:
        task = self.queue.pop(memory)[1]
        self.waiting.removeKey((memory,))
        self._end(task, "incomplete", reason)

    def _enqueue(self, memory: int, version: int, clock: int) -> None:
        paused, disabled, ended = self.now[:3]
        task = f"semantic:{memory}@{version}"
        if self.results.containsKey((task,)) or (memory in self.queue and self.queue[memory][1] == task):
            return
        full = len(self.queue) >= self.most_pending and memory not in self.queue
        reason = "shutdown" if ended else "runtime_disabled" if disabled else "paused" if paused else "queue_full" if full else None
        if reason:
            self.now[4] += reason == "queue_full"
            self._end(task, "incomplete", reason)
            return
        place = self.now[5]
        if memory in self.queue:
            place = self.queue[memory][0]  # the newer snapshot waits where the older one did
            self._drop(memory, "coalesced_by_newer_snapshot")
        else:
            self.now[5] += 1
        self.queue[memory] = (place, task, clock)
        self.waiting.updateValue((memory,), self.queue[memory])
        if self.most_wait_ms is not None:
            self.handle.registerTimer(clock + self.most_wait_ms)

    def _act(self, action: str, memory, version, clock: int) -> None:
        if action == "enqueue":
            self._enqueue(int(memory), int(version), clock)
        elif action == "take" and self.queue and not any(self.now[:3]):
            memory = min(self.queue, key=self.queue.get)
            task = self.queue.pop(memory)[1]
            self.waiting.removeKey((memory,))
            self.now[3] += 1
            self._end(task, "checked", None)
        elif action == "pause":
            self.now[0] = True
        elif action == "resume" and not self.now[1] and not self.now[2]:
            self.now[0] = False
        elif action == "enable" and not self.now[2]:
            self.now[:2] = False, False
        elif action in ("disable", "shutdown"):
            self.now[0] = True
            self.now[1 if action == "disable" else 2] = True
            for memory in sorted(self.queue, key=self.queue.get):
                self._drop(memory, "runtime_disabled" if action == "disable" else "shutdown")

    def _told(self, key) -> pd.DataFrame:
        self.runtime.update(tuple(self.now))
        rows = self.out or [(None, None, None)]
        return pd.DataFrame([(key[0], *r, len(self.queue), self.now[3], self.now[4]) for r in rows], columns=["queue", "task_id", "status", "reason", "waiting", "processed", "dropped"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        clock = timerValues.getCurrentProcessingTimeInMs() if self.most_wait_ms is not None else 0
        given = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for r in given.itertuples(index=False):
            self._act(r.action, r.memory_id, r.version, clock)
        yield self._told(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        due = expiredTimerInfo.getExpiryTimeInMs() - self.most_wait_ms
        for memory in sorted((m for m, (_, _, since) in self.queue.items() if since <= due), key=lambda m: self.queue[m]):
            self._drop(memory, "timed_out")
        if self.out:
            yield self._told(key)


def check_results(requests: DataFrame, **limits) -> DataFrame:
    """One row for each result, with the queue's depth and counts after its micro-batch; a micro-batch without results gives one row of counts.

    The session needs the state store of ``STORE``.
    """
    mode = "none" if limits.get("most_wait_ms") is None else "processingTime"
    return requests.groupBy("queue").transformWithStateInPandas(CheckQueue(**limits), RESULT, "update", mode)
