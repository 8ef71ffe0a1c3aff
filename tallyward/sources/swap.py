"""Folders that are replaced whole: written beside, then moved into place.

A write goes to ``<root>/_staged/<id>``. Spark's commit marker there says that it is complete, and a file of intents names
where its parts belong. Only then are the old folders moved to ``<root>/_replaced/<id>`` and the new ones into their
places. A write that fails leaves the old folders as they are. A swap that is cut short, between two moves of metadata, is finished by
whoever comes next (``finish_swaps``, which readers call when a folder is missing), for all its parts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

STAGED, REPLACED, INTENT, COMMITTED = "_staged", "_replaced", "_intent.json", "_SUCCESS"


class Store:
    """The file system of a path, as Spark reaches it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._fs = self.place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def place(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self.place(path))

    def names(self, path: str) -> list[str]:
        """Names directly below a folder; none if it is absent."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.place(path))) if self.exists(path) else []

    def entries(self, path: str) -> list[tuple[str, bool]]:
        """Names directly below a folder and whether they are folders; none if it is absent."""
        if not self.exists(path):
            return []
        return sorted((s.getPath().getName(), s.isDirectory()) for s in self._fs.listStatus(self.place(path)))

    def move(self, source: str, target: str) -> None:
        """Nothing happens if somebody else has just made the same move."""
        self._fs.mkdirs(self.place(target).getParent())
        if not self._fs.rename(self.place(source), self.place(target)) and (self.exists(source) or not self.exists(target)):
            raise OSError(f"cannot move {source} to {target}")

    def remove(self, path: str) -> None:
        self._fs.delete(self.place(path), True)

    def write(self, path: str, text: str) -> None:
        """A small file, there whole or not at all: created beside and renamed."""
        beside = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex[:8]}"
        out = self._fs.create(self.place(beside), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.remove(path)
        self.move(beside, path)

    def read(self, path: str) -> str:
        stream = self._fs.open(self.place(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


def _finish(store: Store, root: str, swap: str) -> None:
    """Moves every part of a complete write that is not in its place yet; running it again changes nothing."""
    for place in json.loads(store.read(f"{root}/{STAGED}/{swap}/{INTENT}")):
        new, old, now = f"{root}/{STAGED}/{swap}/{place}", f"{root}/{REPLACED}/{swap}/{place}", f"{root}/{place}"
        if store.exists(new):
            if store.exists(now):
                store.remove(old)
                store.move(now, old)
            store.move(new, now)
    store.remove(f"{root}/{STAGED}/{swap}")
    store.remove(f"{root}/{REPLACED}/{swap}")


def finish_swaps(spark: SparkSession, root: str) -> list[str]:
    """Finish swaps below a root that were cut short; writes that never became complete are left to their writers."""
    store, finished = Store(spark, root), []
    for swap in store.names(f"{root}/{STAGED}"):
        if store.exists(f"{root}/{STAGED}/{swap}/{INTENT}"):
            _finish(store, root, swap)
            finished.append(swap)
    return finished


def replace_folders(spark: SparkSession, root: str, places: list[str], write: Callable[[str], None]) -> None:
    """Replace folders below ``root`` by what ``write`` puts below the folder it is given, at the same relative places.

    Spark's commit marker must be in each place or at the top. A place that was not written is left alone.
    """
    swap = uuid.uuid4().hex[:12]
    staged, store = f"{root}/{STAGED}/{swap}", Store(spark, root)
    try:
        write(staged)
    except BaseException:
        store.remove(staged)
        raise
    there = [place for place in places if store.exists(f"{staged}/{place}")]
    whole = store.exists(f"{staged}/{COMMITTED}")
    if not all(whole or store.exists(f"{staged}/{place}/{COMMITTED}") for place in there):
        store.remove(staged)
        raise OSError(f"incomplete write of {', '.join(there)}")
    store.write(f"{staged}/{INTENT}", json.dumps(there))
    _finish(store, root, swap)
