"""Persistent errors as a stream: an episode is given when it closes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seriesloom.streaming.series import columns_of


class _Episodes(StatefulProcessor):
    """The open run's errors as a list, and (runs so far, first and last place of the open one)."""

    def __init__(self, names: tuple[str, str, str], kind: str, threshold: float, least: int, idle_ms: int | None):
        self.names, self.kind, self.threshold, self.least, self.idle_ms = names, kind, threshold, least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.errors = handle.getListState("errors", "error double")
        self.about = handle.getValueState("about", f"runs long, first {self.kind}, last {self.kind}")

    def _episode(self, key, about: tuple, errors: list[float]) -> list[tuple]:
        if len(errors) < self.least:
            return []
        up = float(np.mean(np.array(errors) > 0))
        return [(key, about[0], about[1], about[2], len(errors), float(np.median(errors)), max(up, 1 - up))]

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=[self.names[0], "island", "first", "last", "rows", "median_error", "sign_share"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _key, order, error = self.names
        places, errors = columns_of(rows, order, error)
        before = runs, first, last = tuple(self.about.get() or (0, None, None))
        held = [e for (e,) in self.errors.get()] if first is not None else []
        grown, kept, out = len(held), True, []  # kept: what is stored is still the head of the open run
        for place, x in zip(places, errors, strict=True):
            if x is not None and abs(x) > self.threshold:  # not so for NaN
                if first is None:
                    runs, first, held = runs + 1, place, []
                last = place
                held.append(float(x))
            elif first is not None:
                out += self._episode(key[0], (runs, first, last), held)
                first, last, held, kept = None, None, [], False
        if not kept or grown == 0:
            if held:
                self.errors.put([(e,) for e in held])
            elif grown:
                self.errors.clear()
        elif len(held) > grown:
            self.errors.appendList([(e,) for e in held[grown:]])
        if (runs, first, last) != before:
            self.about.update((runs, first, last))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs, first, last = self.about.get()
        if first is not None:
            held = [e for (e,) in self.errors.get()]
            self.errors.clear()
            self.about.update((runs, None, None))
            yield from self._frame(self._episode(key[0], (runs, first, last), held))

    def close(self) -> None:
        pass


def episodes(stream: DataFrame, key: str, order: str, error: str, threshold: float, least: int, idle_ms: int | None = None) -> DataFrame:
    """(key, island, first, last, rows, median_error, sign_share): the rows of the batch form, each when its run has ended.

    A run ends with a row of its key whose error isn't beyond the threshold (or is missing), or, with `idle_ms`, when the key was
    silent so long; what comes then starts a new run. Rows of a key come in order from batch to batch, of equal places in any.
    State is the open run's errors, of which only new ones are written. Needs the RocksDB state store.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = f"{key} {kinds[key]}, island long, first {kinds[order]}, last {kinds[order]}, rows long, median_error double, sign_share double"
    processor = _Episodes((key, order, error), kinds[order], threshold, least, idle_ms)
    rows = stream.select(key, order, error)
    return rows.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if idle_ms else "None")
