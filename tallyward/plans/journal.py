"""What a daily run has done so far, so that a retry goes on where it stopped."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from tallyward.sources.swap import Store

FOLDER = "_journal"
Entry = tuple[str, str, int | None, str]


class Journal:
    """The finished steps of one day's run: a small file below the processed zone, rewritten whole after each step.

    A step is named by itself and its table. ``resume`` takes over the steps of a run of that day that did not end and
    was made with the same settings; any other run of the day starts anew.
    """

    def __init__(self, spark: SparkSession, lake: str, run_date: dt.date, settings: dict[str, str], resume: bool = False):
        self._store = Store(spark, lake)
        self._path = f"{lake}/{FOLDER}/{run_date.isoformat()}.json"
        self._settings, self._ended = settings, False
        self.entries: dict[tuple[str, str], list[Entry]] = {}
        if resume and self._store.exists(self._path):
            kept = json.loads(self._store.read(self._path))
            if not kept["ended"] and kept["settings"] == settings:
                self.entries = {(step, table): [tuple(row) for row in rows] for step, table, rows in kept["entries"]}
        self._save()

    def _save(self) -> None:
        entries = [[step, table, rows] for (step, table), rows in self.entries.items()]
        self._store.write(self._path, json.dumps({"settings": self._settings, "ended": self._ended, "entries": entries}))

    def step(self, step: str, table: str, run: Callable[[], list[Entry]]) -> list[Entry]:
        """The summary rows of a step: from the journal if it is done, else by running it."""
        key = (step, table)
        if key not in self.entries:
            self.entries[key] = run()
            self._save()
        return self.entries[key]

    def done(self, step: str, table: str) -> bool:
        return (step, table) in self.entries

    def end(self) -> None:
        self._ended = True
        self._save()
