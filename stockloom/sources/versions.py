"""Numbered versions of a folder, each published whole or not at all.

A version is written to a folder of its own name first and then renamed to ``<name>=<number>``. The rename fails if the number is taken, so
that of two writers that start from the same version only one gets the next number and the other starts again from it. A
published folder never changes: whoever has read its number keeps reading the same files. That rests on the rename being one
step that never replaces a folder, as on HDFS and local file systems; object stores without such a rename need a committer that has it.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import SparkSession

from stockloom.sources import files

#: How often a writer starts again when others were faster, and how long a version that isn't among the newest stays for its readers.
ATTEMPTS, RETAINED = 50, timedelta(days=7)


class Conflict(RuntimeError):
    """Other writers were faster each time."""


class Versions:
    def __init__(self, spark: SparkSession, path: str, name: str = "version", retained: timedelta = RETAINED):
        self.spark, self.path, self.name, self.retained = spark, path, name, retained

    def numbers(self) -> list[int]:
        """The published versions in order."""
        return files.numbered(self.spark, self.path, self.name)

    def newest(self) -> int | None:
        return (self.numbers() or [None])[-1]

    def folder(self, number: int) -> str:
        return f"{self.path}/{self.name}={number}"

    def publish(self, fill: Callable[[str, int | None], object]) -> int:
        """Write the next version with ``fill(folder, newest version)`` and publish it; its number.

        If another writer publishes one meanwhile, ``fill`` is called again with that one as the newest.
        """
        for _ in range(ATTEMPTS):
            newest = self.newest()
            staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
            try:
                fill(staged, newest)
                files.mark_complete(self.spark, staged)
                number = self._named(staged, newest)
            except BaseException:
                files.remove(self.spark, staged)
                raise
            if number is not None:
                return number
            files.remove(self.spark, staged)
        raise Conflict(f"{self.path}: {ATTEMPTS} attempts, other writers were faster each time")

    def add(self, fill: Callable[[str], object]) -> int:
        """Publish a version that doesn't depend on the one before it: written once, under the first number that is free."""
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        try:
            fill(staged)
            files.mark_complete(self.spark, staged)
        except BaseException:
            files.remove(self.spark, staged)
            raise
        while (number := self._named(staged, self.newest())) is None:
            pass
        return number

    def _named(self, staged: str, newest: int | None) -> int | None:
        """The number that the staged folder got, None if a version newer than ``newest`` has come."""
        number = 0 if newest is None else newest + 1
        while not files.rename_new(self.spark, staged, self.folder(number)):
            if files.is_complete(self.spark, self.folder(number)):
                return None
            number += 1  # what somebody left there unfinished counts for nothing
        return number

    def remove_old(self, keep: int) -> None:
        """Remove what is neither among the newest ``keep`` versions nor younger than readers may need."""
        before = time.time() - self.retained.total_seconds()
        for number in self.numbers()[:-keep]:
            if files.changed_at(self.spark, self.folder(number)) <= before:
                files.remove(self.spark, self.folder(number))
