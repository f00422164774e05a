"""Commands in files by topic, as a data source: batch and stream writers that commit, and a reader.

``format("commands")`` writes rows (``topic``, ``value`` and whatever else) below a ``path``: a task's rows of a topic are one file, named by
the topic. A file counts only once a commit names it: one small file for each batch, moved into place in one step. So a task or a
job that is stopped leaves nothing that is read, and a stream's batch that is written again after its commit is passed over. The
reader plans a partition for each committed file; ``topic`` chooses some by their names alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "commands"
SCHEMA = "node_id string, rule_id string, t_ns long, step int, topic string, value string"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    system, base = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, unquote(base)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


@dataclass
class File(InputPartition):
    name: str


def _write(path: str, rows: Iterator) -> Written:
    """Writes a task's rows, a file for each run of a topic; what a failing task has begun goes."""
    system, base = _system(path)
    files: list[str] = []
    out, topic = None, None
    try:
        for row in rows:
            own = row.asDict(recursive=True)
            if out is None or own["topic"] != topic:
                if out:
                    out.close()
                topic = own["topic"]
                folder = f"topic={quote(topic or '', safe='')}"
                system.create_dir(f"{base}/{folder}", recursive=True)
                files.append(f"{folder}/{uuid.uuid4().hex}.json")
                out = system.open_output_stream(f"{base}/{files[-1]}")
            out.write((json.dumps(own, ensure_ascii=False) + "\n").encode())
        if out:
            out.close()
    except BaseException:
        if out:
            out.close()
        _drop(path, [Written(files)])
        raise
    return Written(files)


def _drop(path: str, messages: list[Written | None]) -> None:
    system, base = _system(path)
    for m in messages:
        for f in m.files if m else []:
            if system.get_file_info(f"{base}/{f}").type != fs.FileType.NotFound:
                system.delete_file(f"{base}/{f}")


def _commit(path: str, name: str, messages: list[Written | None]) -> None:
    """Makes the files count. A commit of the same name stands, and the files of the later one go."""
    system, base = _system(path)
    system.create_dir(f"{base}/_commits", recursive=True)
    if system.get_file_info(f"{base}/_commits/{name}.json").type != fs.FileType.NotFound:
        _drop(path, messages)
        return
    passing = f"{base}/_commits/{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(passing) as out:
        out.write(json.dumps([f for m in messages for f in (m.files if m else [])]).encode())
    system.move(passing, f"{base}/_commits/{name}.json")


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.name = path, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        return _write(self.path, iterator)

    def commit(self, messages: list) -> None:
        _commit(self.path, self.name, messages)

    def abort(self, messages: list) -> None:
        _drop(self.path, messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        return _write(self.path, iterator)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        _commit(self.path, f"batch-{batchId:020d}", messages)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        _drop(self.path, messages)


class _Reader(DataSourceReader):
    def __init__(self, path: str, topic: str | None, fields: list[str]):
        self.path, self.topic, self.fields = path, topic, fields

    def partitions(self) -> list[File]:
        system, base = _system(self.path)
        found = system.get_file_info(fs.FileSelector(f"{base}/_commits", allow_not_found=True))
        names = [f for c in sorted(x.path for x in found if x.path.endswith(".json")) for f in json.loads(system.open_input_stream(c).read())]
        wanted = None if self.topic is None else f"topic={quote(self.topic, safe='')}/"
        return [File(f) for f in names if wanted is None or f.startswith(wanted)] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        if not partition.name:
            return
        system, base = _system(self.path)
        with system.open_input_stream(f"{base}/{partition.name}") as data:
            for line in data.read().decode().split("\n"):
                if line:
                    own = json.loads(line)
                    yield tuple(own.get(f) for f in self.fields)


class Commands(DataSource):
    """The data source; ``register`` makes it known to a session."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("commands are only appended")
        return _Writer(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> _StreamWriter:  # noqa: N802
        return _StreamWriter(self.options["path"])

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("topic"), schema.fieldNames())


def register(spark) -> None:
    spark.dataSource.register(Commands)


def by_topic(commands: DataFrame) -> DataFrame:
    """Commands without errors, so dealt that few files are made."""
    own = commands.where("error is null") if "error" in commands.columns else commands
    return own.select("node_id", "rule_id", "t_ns", "step", "topic", "value").repartition("topic").sortWithinPartitions("topic", "t_ns", "step")


def write(commands: DataFrame, path: str) -> None:
    """Appends commands in one commit."""
    register(commands.sparkSession)
    by_topic(commands).write.format(NAME).mode("append").save(path)


def write_stream(commands: DataFrame, path: str, checkpoint: str):
    """A stream of commands, one commit for each batch; to be started."""
    register(commands.sparkSession)
    own = commands.where("error is null") if "error" in commands.columns else commands
    return own.select("node_id", "rule_id", "t_ns", "step", "topic", "value").writeStream.format(NAME).option("path", path).option("checkpointLocation", checkpoint)


def read(spark, path: str, topic: str | None = None) -> DataFrame:
    """The committed commands, of one ``topic`` or of all."""
    register(spark)
    rows = spark.read.format(NAME).option("path", path)
    return (rows if topic is None else rows.option("topic", topic)).load()
