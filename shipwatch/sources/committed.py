"""Results that count only once they are whole: commit marks in a shared folder.

A mark is a small JSON file that is written last. Readers look for marks only,
so they never see half a result; a writer that breaks leaves files without a
mark, which nobody reads, and the next one starts afresh beside them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Marks:
    """The commit marks under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        path, fs = self._path("_marks")
        if not fs.exists(path):
            return []
        return sorted(name[:-5] for s in fs.listStatus(path) if (name := s.getPath().getName()).endswith(".json"))

    def read(self, name: str) -> dict | None:
        path, fs = self._path(f"_marks/{name}.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, told: dict) -> None:
        """Written beside, then renamed: a mark is there as a whole or not at all."""
        path, fs = self._path(f"_marks/{name}.json")
        beside, _ = self._path(f"_marks/.{name}-{uuid.uuid4().hex}")
        stream = fs.create(beside, True)
        stream.write(json.dumps(told, default=str, ensure_ascii=False).encode())
        stream.close()
        fs.delete(path, False)
        if not fs.rename(beside, path):
            raise OSError(f"cannot commit {path}")


class Store:
    """Results by key; each is built once, in a folder of its own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def find(self, key: str) -> str | None:
        """The folder of the result; the first by name if several writers built it at once."""
        runs = Marks(self.spark, f"{self.root}/{key}").names()
        return f"{self.root}/{key}/{runs[0]}" if runs else None

    def get(self, key: str, build: Callable[[str], None]) -> str:
        """The folder of ``key``'s result; ``build(folder)`` writes it if it is not there."""
        found = self.find(key)
        if found is None:
            run = f"run-{uuid.uuid4().hex}"
            build(f"{self.root}/{key}/{run}")
            Marks(self.spark, f"{self.root}/{key}").write(run, {"key": key})
            found = self.find(key)
        return found


class Run:
    """A job of named steps that can break anywhere and go on.

    Tables go to ``folder``, apart from those of other runs. A step's mark is
    written after its build, with what the build returned: a later call under
    the same id takes that and goes on at the first step without a mark, which
    writes its tables anew. ``commit`` comes last; ``committed_run`` finds only
    runs that have it. One writer per id at a time. ``inputs`` (plain values)
    are kept with the run: other inputs under its id are an error.
    """

    def __init__(self, spark: SparkSession, root: str, run_id: str, inputs: dict):
        self.root, self.run_id = root.rstrip("/"), run_id
        self.folder = f"{self.root}/run={run_id}"
        self._steps, self._runs = Marks(spark, self.folder), Marks(spark, self.root)
        given = json.loads(json.dumps(inputs, default=str))
        begun = self._steps.read("inputs")
        if begun is None:
            self._steps.write("inputs", given)
        elif begun != given:
            raise ValueError(f"run {run_id} was begun with other inputs: {begun}")

    def step(self, name: str, build: Callable[[], object]):
        """What ``build`` returns (as JSON has it); it is not called if the step is done."""
        done = self._steps.read(f"step-{name}")
        if done is None:
            self._steps.write(f"step-{name}", {"result": build()})
            done = self._steps.read(f"step-{name}")
        return done["result"]

    def commit(self, record: dict) -> dict:
        """Make the run visible; a run that is committed stays as it is."""
        if self._runs.read(self.run_id) is None:
            number = 1 + max((self._runs.read(r)["number"] for r in self._runs.names()), default=0)
            self._runs.write(self.run_id, {"number": number, "record": record})
        return self._runs.read(self.run_id)["record"]


def committed_run(spark: SparkSession, root: str) -> str:
    """The folder of the run that was committed last."""
    marks = Marks(spark, root)
    runs = sorted((marks.read(r)["number"], r) for r in marks.names())
    if not runs:
        raise FileNotFoundError(f"no committed run in {root}")
    return f"{root.rstrip('/')}/run={runs[-1][1]}"


def files_told(spark: SparkSession, path: str) -> list[list]:
    """Name, length and time of change of the files of an input, in order of name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted([f.getPath().getName(), f.getLen(), f.getModificationTime()] for f in fs.listStatus(p))
