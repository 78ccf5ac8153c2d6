"""Appends of files that a repeated run does not make twice.

A run writes its files below ``_runs/<run id>/files`` of the target, marks them as staged, moves
each to its place and marks the run as done. Repeated under the same id after a failure it goes on
where it stopped: files without the mark are written anew, staged ones that have not moved yet are
moved, and a run that is done changes nothing. Readers pass over ``_runs``. The driver moves the
files, whose number is that of the writing tasks, and never their content. An id belongs to one
run; two runs at the same time need two ids.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import SparkSession

_RUN_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*")


class StagedAppend:
    def __init__(self, spark: SparkSession, folder: str, run_id: str):
        if not _RUN_ID.fullmatch(run_id):
            raise ValueError("run_id may hold letters, digits, '.' and '-'")
        # The folder may be in any store that Spark reaches, so its file system API is used.
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        folder = self._path(folder)
        self._fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._folder = self._fs.makeQualified(folder)
        self._run = self._path(self._folder, f"_runs/{run_id}")
        self._files = self._path(self._run, "files")
        self._run_id = run_id

    def append(self, write: Callable[[str], None]) -> None:
        """Add what ``write`` puts below the folder it is given, unless this run has done so."""
        if not self._marked("done"):
            if not self._marked("staged"):
                self._fs.delete(self._files, True)
                write(self._files.toString())
                self._mark("staged")
            for source, target in self._moves():
                self._move(source, target)
            self._mark("done")
        self._fs.delete(self._files, True)

    def _marked(self, name: str) -> bool:
        return self._fs.exists(self._path(self._run, f"_{name}"))

    def _mark(self, name: str) -> None:
        self._fs.create(self._path(self._run, f"_{name}"), True).close()

    def _moves(self) -> list[tuple]:
        """(staged file, its place) of all that are still staged."""
        if not self._fs.exists(self._files):
            return []
        out, found = [], self._fs.listFiles(self._files, True)
        root = self._files.toString() + "/"
        while found.hasNext():
            source = found.next().getPath()
            *parts, name = source.toString().removeprefix(root).split("/")
            if not name.startswith(("_", ".")):
                place = "/".join([*parts, f"{self._run_id}-{name}"])
                out.append((source, self._path(self._folder, place)))
        return out

    def _move(self, source, target) -> None:
        self._fs.mkdirs(target.getParent())
        # Where a move is a copy, an interrupted one leaves a part of the file, and the staged one.
        self._fs.delete(target, False)
        if not self._fs.rename(source, target):
            raise OSError(f"cannot move {source.toString()} to {target.toString()}")
