"""Single files written by many tasks.

Tasks write files of their own into a folder beside the target, in order of their partitions; ``commit`` joins these by copying
streams a block at a time, and the target appears by one rename. ``abort``, like a failed commit, leaves nothing behind."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

BLOCK = 1 << 20


def open_store(uri: str):
    """A store that Arrow knows, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z0-9]+:/", uri) else (fs.LocalFileSystem(), uri)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its files' stem, its first feature and how many, and counts of parts and rings."""

    stem: str
    first: int
    n: int
    parts: int = 0
    rings: int = 0
    cells: list = field(default_factory=list)


class JoiningWriter(DataSourceWriter):
    """Tasks write sections below a folder beside the target; commit joins them."""

    def __init__(self, options, overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite
        self.folder = f"{self.uri.rstrip('/')}.writing-{uuid.uuid4().hex[:12]}"

    def _open(self, stem: str, section: str):
        store, path = open_store(self.folder)
        store.create_dir(path, recursive=True)
        return store.open_output_stream(f"{path}/{stem}.{section}")

    def _stem(self) -> str:
        context = TaskContext.get()
        return f"{context.partitionId():06d}-{context.taskAttemptId()}"

    def _copy(self, out, stem: str, section: str, change=None) -> None:
        store, path = open_store(self.folder)
        with store.open_input_stream(f"{path}/{stem}.{section}") as f:
            while data := f.read(BLOCK):
                out.write(change(data) if change else data)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, path = open_store(self.uri)
        try:
            if not self.overwrite and store.get_file_info(path).type != fs.FileType.NotFound:
                raise ValueError(f"{self.uri} is there already")
            own = sorted((m for m in messages if m is not None and m.n), key=lambda m: m.first)
            target = f"{open_store(self.folder)[1]}/whole"
            store.create_dir(open_store(self.folder)[1], recursive=True)
            with store.open_output_stream(target) as out:
                self.join(out, own)
            if store.get_file_info(path).type == fs.FileType.File:
                store.delete_file(path)
            store.move(target, path)
        finally:
            self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow import fs

        store, path = open_store(self.folder)
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


class TextWriter(JoiningWriter):
    """Rows of one text column, head before, tail after, sep between and end after each."""

    def __init__(self, options, overwrite: bool):
        super().__init__(options, overwrite)
        self.head, self.sep, self.end, self.tail = (options.get(k, "").encode() for k in ("head", "sep", "end", "tail"))

    def write(self, rows):
        stem, n, file, held = self._stem(), 0, None, bytearray()
        try:
            for row in rows:
                held += (self.sep if n else b"") + row[0].encode() + self.end
                n += 1
                if len(held) > BLOCK:
                    file = file or self._open(stem, "text")
                    file.write(bytes(held))
                    held.clear()
            if n:
                file = file or self._open(stem, "text")
                file.write(bytes(held))
        finally:
            if file is not None:
                file.close()
        return Written(stem, TaskContext.get().partitionId(), n)

    def join(self, out, own: list[Written]) -> None:
        out.write(self.head)
        for i, m in enumerate(own):
            if i:
                out.write(self.sep)
            self._copy(out, m.stem, "text")
        out.write(self.tail)


class TextSource(DataSource):
    """Options: path, head, sep, end, tail."""

    @classmethod
    def name(cls):
        return "onetext"

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        return TextWriter(self.options, overwrite)


def write_text(lines: DataFrame, path: str, head: str = "", sep: str = "", end: str = "", tail: str = "") -> None:
    """Writes the rows of a text column, in order of partitions and of rows in them, as one file."""
    lines.sparkSession.dataSource.register(TextSource)
    lines.write.format("onetext").mode("overwrite").options(head=head, sep=sep, end=end, tail=tail).save(path)
