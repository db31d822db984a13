"""JSON Lines with commit: a Spark data source to write to, whose records appear all at once or not at all.

``df.write.format("committed_json").option("root", ...).option("run", ...).mode("append").save()`` writes a file for each task and
attempt under ``root``/data/RUN. Only the driver, once every task has ended, puts the list of the files that count into
``root``/commits/RUN.json, in one step; what is not on a list is never read (``read_committed``). A job that fails leaves no
list and removes its files; files of lost or repeated attempts are on no list. A run whose list is there already
is not written again, so a run may be repeated after a failure of which nobody knows how far it came.

As a streaming sink each micro-batch is a run of its own, named by its number, so a batch that Spark repeats counts once.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

NAME = "committed_json"


@dataclass
class Written(WriterCommitMessage):
    file: str
    n: int


def store_of(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def write_task(root: str, run: str, rows: Iterator[Row]) -> Written:
    """A task's rows in a file that no other attempt writes to."""
    store, folder = store_of(root)
    task = TaskContext.get()
    file = f"data/{run}/{task.partitionId():06d}-{uuid.uuid4().hex}.json"
    store.create_dir(f"{folder}/data/{run}")
    n = 0
    with store.open_output_stream(f"{folder}/{file}") as out:
        for row in rows:
            out.write(json.dumps(row.asDict(True), ensure_ascii=False, default=str).encode() + b"\n")
            n += 1
    return Written(file, n)


def lists(root: str) -> dict[str, list[str]]:
    """The files of each committed run."""
    store, folder = store_of(root)
    found = store.get_file_info(fs.FileSelector(f"{folder}/commits", allow_not_found=True))
    out = {}
    for info in found:
        if info.base_name.endswith(".json"):
            with store.open_input_stream(info.path) as f:
                out[info.base_name.removesuffix(".json")] = json.loads(f.read())["files"]
    return out


def remove(root: str, run: str, but: list[str] = ()) -> None:
    store, folder = store_of(root)
    for info in store.get_file_info(fs.FileSelector(f"{folder}/data/{run}", allow_not_found=True)):
        if f"data/{run}/{info.base_name}" not in but:
            store.delete_file(info.path)


def publish(root: str, run: str, written: list[Written | None]) -> bool:
    """Lists the files of a run, unless it has a list; then only those stay. Whether this call made the list."""
    store, folder = store_of(root)
    if run in lists(root):
        remove(root, run, lists(root)[run])
        return False
    files = sorted(w.file for w in written if w is not None and w.n)
    store.create_dir(f"{folder}/commits")
    hidden = f"{folder}/commits/.{run}-{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(json.dumps({"files": files, "n": sum(w.n for w in written if w is not None)}).encode())
    store.move(hidden, f"{folder}/commits/{run}.json")
    remove(root, run, files)
    return True


class Writer(DataSourceWriter):
    def __init__(self, root: str, run: str):
        self.root, self.run = root, run

    def write(self, iterator: Iterator[Row]) -> Written:
        return write_task(self.root, self.run, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        publish(self.root, self.run, messages)

    def abort(self, messages: list[Written | None]) -> None:
        remove(self.root, self.run, lists(self.root).get(self.run, []))


class StreamWriter(DataSourceStreamWriter):
    def __init__(self, root: str, run: str):
        self.root, self.run, self.attempt = root, run, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        return write_task(self.root, f"{self.run}-open", iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        # Tasks do not know their batch: its list names files of the folder that all batches share.
        name = f"{self.run}-{batchId:09d}"
        if name not in lists(self.root):
            publish(self.root, name, messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        store, folder = store_of(self.root)
        for w in messages:
            if w is not None:
                store.delete_file(f"{folder}/{w.file}")


class CommittedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _target(self) -> tuple[str, str]:
        root, run = self.options["root"], self.options.get("run", uuid.uuid4().hex)
        if not re.fullmatch("[A-Za-z0-9_-]+", run):
            raise ValueError("a run is named by letters, digits, - and _")
        return root.rstrip("/"), run

    def writer(self, schema, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("runs are appended; remove the folder to start anew")
        return Writer(*self._target())

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(*self._target())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommittedJson)


def append(df: DataFrame, root: str, run: str) -> None:
    """Appends the rows as one run; nothing happens if the run is there."""
    root = root.rstrip("/")
    if run in lists(root):
        return
    register(df.sparkSession)
    df.write.format(NAME).option("root", root).option("run", run).mode("append").save()


def read_committed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The records of all runs that were committed."""
    root = root.rstrip("/")
    files = [f"{root}/{f}" for names in lists(root).values() for f in names]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
