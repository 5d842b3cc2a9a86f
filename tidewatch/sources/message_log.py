"""A message log on shared storage as a Spark data source, read and written
exactly once.

``spark.dataSource.register(MessageLog)`` makes the format ``message_log``:
rows ``(key STRING, value STRING)``, in a folder that driver and executors
share (any path or URI that :mod:`pyarrow.fs` opens).

Layout: tasks write ``data/<name>.jsonl``; a commit writes
``commits/<number>-<id>.json``, the list of its files with their rows, in one
rename. Only files of a commit exist for readers. A writer's commit has an id;
a second commit under the same id (a micro-batch that is run again) drops its
files, so no message comes twice.

* stream source: the offset is the number of commits read; each file between
  two offsets is a partition of its own, so a batch reads in parallel and a
  restarted query goes on after its last checkpointed offset;
* stream sink: the id is ``<writer>-<batch id>``, ``writer`` an option that
  names the query (default ``stream``);
* batch source and sink: the whole log; option ``commit_id`` makes an append
  idempotent, e.g. inside ``foreachBatch`` (:func:`append_once`).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

FORMAT = "message_log"
SCHEMA = "key string, value string"


class _Folder:
    """The log's files."""

    def __init__(self, path: str):
        self.uri = path

    def _fs(self):
        from pyarrow import fs

        if "://" in self.uri or self.uri.startswith("file:"):
            return fs.FileSystem.from_uri(self.uri)
        return fs.LocalFileSystem(), self.uri

    def commits(self) -> list[str]:
        """Commit files in order."""
        from pyarrow import fs

        system, root = self._fs()
        found = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.endswith(".json"))

    def files(self, commit: str) -> list[dict]:
        system, root = self._fs()
        with system.open_input_stream(f"{root}/commits/{commit}") as f:
            return json.loads(f.read())["files"]

    def put(self, rows: Iterator) -> dict | None:
        """One task's rows as a file nobody sees yet."""
        system, root = self._fs()
        first = next(rows, None)
        if first is None:
            return None
        system.create_dir(f"{root}/data", recursive=True)
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        with system.open_output_stream(f"{root}/data/{name}") as f:
            row = first
            while row is not None:
                f.write((json.dumps([row[0], row[1]]) + "\n").encode())
                n += 1
                row = next(rows, None)
        return {"name": name, "rows": n}

    def drop(self, files: list[dict]) -> None:
        system, root = self._fs()
        for f in files:
            system.delete_file(f"{root}/data/{f['name']}")

    def commit(self, files: list[dict], commit_id: str) -> None:
        done = self.commits()
        if any(c.partition("-")[2] == f"{commit_id}.json" for c in done):
            self.drop(files)
            return
        system, root = self._fs()
        system.create_dir(f"{root}/commits", recursive=True)
        draft = f"{root}/commits/{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(draft) as f:
            f.write(json.dumps({"files": files}).encode())
        system.move(draft, f"{root}/commits/{len(done):012d}-{commit_id}.json")

    def read(self, name: str) -> Iterator[tuple]:
        system, root = self._fs()
        with system.open_input_stream(f"{root}/data/{name}") as f:
            left = b""
            while block := f.read(1 << 20):
                *lines, left = (left + block).split(b"\n")
                for line in lines:
                    yield tuple(json.loads(line))


@dataclass
class _File(InputPartition):
    name: str


@dataclass
class _Written(WriterCommitMessage):
    file: dict | None


def _written(messages: list) -> list[dict]:
    return [m.file for m in messages if m is not None and m.file is not None]


class MessageLog(DataSource):
    """See the module's head. Option ``path``: the log's folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> _Folder:
        if not self.options.get("path"):
            raise ValueError("a message log needs a path")
        return _Folder(self.options["path"].rstrip("/"))

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self._folder())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStreamReader(self._folder(), self.options.get("startingoffsets", "earliest"))

    def writer(self, schema, overwrite) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a message log is only appended to")
        return LogWriter(self._folder(), self.options.get("commit_id") or f"batch-{uuid.uuid4().hex}")

    def streamWriter(self, schema, overwrite) -> DataSourceStreamWriter:
        return LogStreamWriter(self._folder(), self.options.get("writer", "stream"))


class LogReader(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> list[_File]:
        return [_File(f["name"]) for c in self.folder.commits() for f in self.folder.files(c)]

    def read(self, partition: _File | None) -> Iterator[tuple]:
        return iter(()) if partition is None else self.folder.read(partition.name)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, folder: _Folder, starting: str):
        if starting not in ("earliest", "latest"):
            raise ValueError("startingOffsets is earliest or latest")
        self.folder, self.starting = folder, starting

    def initialOffset(self) -> dict:
        return {"commits": len(self.folder.commits()) if self.starting == "latest" else 0}

    def latestOffset(self) -> dict:
        return {"commits": len(self.folder.commits())}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        wanted = self.folder.commits()[start["commits"] : end["commits"]]
        return [_File(f["name"]) for c in wanted for f in self.folder.files(c)]

    def read(self, partition: _File) -> Iterator[tuple]:
        return self.folder.read(partition.name)

    def commit(self, end: dict) -> None:
        """Read messages stay in the log: other readers have offsets of their own."""


class LogWriter(DataSourceWriter):
    def __init__(self, folder: _Folder, commit_id: str):
        self.folder, self.commit_id = folder, commit_id

    def write(self, iterator: Iterator) -> _Written:
        return _Written(self.folder.put(iter(iterator)))

    def commit(self, messages: list) -> None:
        self.folder.commit(_written(messages), self.commit_id)

    def abort(self, messages: list) -> None:
        self.folder.drop(_written(messages))


class LogStreamWriter(DataSourceStreamWriter):
    def __init__(self, folder: _Folder, writer: str):
        self.folder, self.writer = folder, writer

    def write(self, iterator: Iterator) -> _Written:
        return _Written(self.folder.put(iter(iterator)))

    def commit(self, messages: list, batchId: int) -> None:
        self.folder.commit(_written(messages), f"{self.writer}-{batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        self.folder.drop(_written(messages))


def append_once(messages: DataFrame, path: str, commit_id: str) -> None:
    """Append ``(key, value)`` rows under an id; a second append under it adds nothing."""
    messages.sparkSession.dataSource.register(MessageLog)
    messages.select("key", "value").write.format(FORMAT).mode("append").option("commit_id", commit_id).save(path)
