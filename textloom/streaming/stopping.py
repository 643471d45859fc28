"""Early stop while runs go on: evaluations come in as a stream, perhaps out of order and more than once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "n_steps long, stop_step long, best_step long, best_loss double, held long"
# Steps that wait are kept by the block of so many steps that they are in: a block is read and written in one go.
HELD_BLOCK = 4096
_STATE = "n_steps long, gain long, best double, stop_step long, best_step long, best_loss double, deadline long, held long"


class _EarlyStop(StatefulProcessor):
    """What a run's evaluations so far come to, and those that came before their turn."""

    def __init__(self, patience: int, hold_ms: int | None):
        self.patience, self.hold_ms = patience, hold_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STATE)
        # steps and losses of a block, packed, and which of the losses are null
        self.early = handle.getMapState("early", "block long", "steps binary, losses binary, none binary")

    def _load(self) -> dict:
        names = [part.split()[0] for part in _STATE.split(", ")]
        known = self.state.get()
        return dict(zip(names, known if known is not None else (0, 0, None, None, None, None, None, 0)))

    def _count(self, s: dict, step: int, loss: float | None) -> None:
        """Take in the next evaluation; after the stop only their number goes on."""
        s["n_steps"] = step
        if s["stop_step"] is not None:
            return
        if loss is not None and (s["best"] is None or loss < s["best"]):
            s["best"], s["gain"] = loss, step
            s["best_step"], s["best_loss"] = step, loss
        if step - s["gain"] >= self.patience:
            s["stop_step"] = step

    def _held(self, s: dict) -> dict[int, float | None]:
        """What waits for its turn; only runs with gaps have any."""
        waiting: dict[int, float | None] = {}
        if s["held"]:
            for _, (steps, losses, none) in self.early.iterator():
                found = np.frombuffer(losses, "<f8").astype(object)
                found[np.frombuffer(none, "?")] = None
                waiting.update(zip(np.frombuffer(steps, "<i8").tolist(), found.tolist()))
        return waiting

    def _release(self, s: dict, waiting: dict, before: set[int]) -> None:
        """Count what has its turn, and write back the blocks in which some have come to wait or do so no more."""
        while s["n_steps"] + 1 in waiting:
            step = s["n_steps"] + 1
            self._count(s, step, waiting.pop(step))
        s["held"] = len(waiting)
        changed = {step // HELD_BLOCK for step in before ^ waiting.keys()}
        if not waiting:
            if before:
                self.early.clear()
            return
        blocks: dict[int, list[int]] = {block: [] for block in changed}
        for step in waiting:
            if step // HELD_BLOCK in changed:
                blocks[step // HELD_BLOCK].append(step)
        for block, steps in blocks.items():
            if steps:
                losses = [waiting[step] for step in steps]
                none = np.array([loss is None for loss in losses])
                packed = (np.array(steps, "<i8"), np.array([0.0 if loss is None else loss for loss in losses], "<f8"), none)
                self.early.updateValue((block,), tuple(part.tobytes() for part in packed))
            elif any(step // HELD_BLOCK == block for step in before):
                self.early.removeKey((block,))

    def _finish(self, key: tuple, s: dict, timerValues) -> Iterator[Row]:  # noqa: N803
        if s["deadline"] is not None and not s["held"]:
            self.handle.deleteTimer(s["deadline"])
            s["deadline"] = None
        if s["held"] and s["deadline"] is None and self.hold_ms is not None:
            s["deadline"] = timerValues.getCurrentProcessingTimeInMs() + self.hold_ms
            self.handle.registerTimer(s["deadline"])
        self.state.update(tuple(s.values()))
        yield Row(run=key[0], **{n: s[n] for n in ("n_steps", "stop_step", "best_step", "best_loss", "held")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        s = self._load()
        waiting = self._held(s)
        before = set(waiting)
        for row in rows:
            step, loss = row.step, row.loss
            if step is not None and step > s["n_steps"] and step not in waiting:
                waiting[step] = None if loss is None or math.isnan(loss) else loss
        self._release(s, waiting, before)
        yield from self._finish(key, s, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """The gap was held long enough: go on with the earliest evaluation behind it."""
        s = self._load()
        s["deadline"] = None
        waiting = self._held(s)
        if waiting:
            s["n_steps"] = min(waiting) - 1
            self._release(s, waiting, set(waiting))
        yield from self._finish(key, s, timerValues)

    def close(self) -> None:
        pass


def stream_early_stop(
    evaluations: DataFrame,
    run: str = "run",
    step: str = "step",
    loss: str = "loss",
    patience: int = 3,
    hold_seconds: float | None = None,
) -> DataFrame:
    """``early_stop`` of runs that go on: a row per run whenever evaluations of it came in, to be written by ``write_latest``
    with ``keyed_state=True``.

    ``step`` numbers a run's evaluations from 1. One that comes before its turn is held (``held`` counts them); with
    ``hold_seconds`` the missing ones are given up that long after the first was held, and counting goes on with those
    that are there. A step that was counted already, again or too late, changes nothing; so a batch that is run again
    gives the same rows. Rows without a step are left out; without a run they are a run of their own. A null loss is an
    evaluation that improves nothing.

    State per run is a few numbers and the held evaluations, packed by blocks of steps.
    """
    named = evaluations.select(
        F.col(run).alias("run"), F.col(step).cast("long").alias("step"), F.col(loss).cast("double").alias("loss")
    )
    kind = named.schema["run"].dataType.simpleString()
    schema = f"run {kind}, {OUTPUT}"
    hold_ms = None if hold_seconds is None else int(hold_seconds * 1000)
    stopped = named.groupBy("run").transformWithState(
        statefulProcessor=_EarlyStop(patience, hold_ms),
        outputStructType=schema,
        outputMode="Update",
        timeMode="None" if hold_ms is None else "ProcessingTime",
    )
    return stopped.withColumnRenamed("run", run) if run != "run" else stopped
