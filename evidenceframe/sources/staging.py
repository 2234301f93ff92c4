"""Files that tasks write under names of their own choice, all of them or none.

A task writes to a folder of its own below ``_temporary`` and the names of its files to a list beside it; the driver reads the lists of the tasks that count,
name by name, moves the files to their places and then deletes the folder. Of millions of files it holds eight bytes each. A task that fails or is run twice leaves nothing. Paths are local, in a folder that all
executors share, or on a store that pyarrow opens.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def store(path: str) -> tuple[FileSystem, str]:
    """The file system of a path, and the path there."""
    if "://" in path:
        return FileSystem.from_uri(path)
    return LocalFileSystem(), path.removeprefix("file:")


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files below a path with a suffix, by path."""
    fs, root = store(path)
    found = fs.get_file_info(FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == FileType.File and f.path.endswith(suffix) and "/_temporary/" not in f.path)


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: the name of its folder, beside which its files are listed, and counts to be summed."""

    attempt: str
    counts: dict[str, int] = field(default_factory=dict)


def _code(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


class StagedWriter(DataSourceArrowWriter):
    """Base of writers: ``begin`` and ``end`` enclose a task's work, ``stage`` opens a file in it, ``finish`` runs on the driver when all files are in their places."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def begin(self) -> Staged:
        done, self.made = Staged(uuid.uuid4().hex), set()
        fs, root = store(self.path)
        fs.create_dir(f"{root}/_temporary/{self.job}", recursive=True)
        self.list = fs.open_output_stream(f"{root}/_temporary/{self.job}/{done.attempt}.names", compression=None)
        return done

    def stage(self, name: str, done: Staged):
        fs, root = store(self.path)
        staged = f"{root}/_temporary/{self.job}/{done.attempt}/{name}"
        if (parent := staged.rsplit("/", 1)[0]) not in self.made:
            fs.create_dir(parent, recursive=True)
            self.made.add(parent)
        self.list.write(json.dumps(name).encode() + b"\n")
        return fs.open_output_stream(staged, compression=None)

    def end(self, done: Staged) -> Staged:
        self.list.close()
        return done

    def names(self, fs: FileSystem, root: str, messages: list[Staged | None]) -> Iterator[tuple[str, str]]:
        """(task's folder, name) of the files, from the lists."""
        for m in messages:
            if m:
                folder = f"{root}/_temporary/{self.job}/{m.attempt}"
                with fs.open_input_stream(f"{folder}.names", compression=None, buffer_size=1 << 16) as f:
                    rest = b""
                    while part := f.read(1 << 16):
                        *lines, rest = (rest + part).split(b"\n")
                        yield from ((folder, json.loads(line)) for line in lines)

    def finish(self, fs: FileSystem, root: str, counts: dict[str, int]) -> None:
        """Files that say the rest is whole."""

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = store(self.path)
        counts: dict[str, int] = {}
        for m in messages:
            for k, n in m.counts.items() if m else ():
                counts[k] = counts.get(k, 0) + n
        codes = np.sort(np.fromiter((_code(name) for _, name in self.names(fs, root, messages)), np.uint64))
        if twice := set(codes[1:][codes[1:] == codes[:-1]].tolist()):
            same = [name for _, name in self.names(fs, root, messages) if _code(name) in twice]
            if len(set(same)) < len(same):
                raise ValueError(f"{len(same) - len(set(same))} files have the name of another")
        held = [info for info in fs.get_file_info(FileSelector(root, allow_not_found=True)) if info.base_name != "_temporary"]
        if self.overwrite:
            for info in held:
                (fs.delete_dir if info.type == FileType.Directory else fs.delete_file)(info.path)
        elif held:
            found, n, least = self.names(fs, root, messages), 0, None
            while some := [f"{root}/{name}" for _, name in islice(found, 10_000)]:
                there = [info.path.removeprefix(f"{root}/") for info in fs.get_file_info(some) if info.type == FileType.File]
                n, least = n + len(there), min([*there, *([least] if least else [])], default=None)
            if n:
                raise FileExistsError(f"{n} files are there, such as {least}")
        made = set()
        for folder, name in self.names(fs, root, messages):
            if "/" in name and (parent := name.rsplit("/", 1)[0]) not in made:
                fs.create_dir(f"{root}/{parent}", recursive=True)
                made.add(parent)
            fs.move(f"{folder}/{name}", f"{root}/{name}")
        self.finish(fs, root, counts)
        self.clear(fs, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self.clear(*store(self.path))

    def clear(self, fs: FileSystem, root: str) -> None:
        """Delete what tasks of this job have left, and the folder if no other job is at work."""
        if fs.get_file_info(f"{root}/_temporary/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{root}/_temporary/{self.job}")
        if not fs.get_file_info(FileSelector(f"{root}/_temporary", allow_not_found=True)) and fs.get_file_info(f"{root}/_temporary").type == FileType.Directory:
            fs.delete_dir(f"{root}/_temporary")


class NamedFilesWriter(StagedWriter):
    def write(self, batches) -> Staged:
        done = self.begin()
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").cast(pa.binary())):
                with self.stage(name, done) as f:
                    f.write(content.as_py() or b"")
        return self.end(done)


class NamedFiles(DataSource):
    """Writes a file for each row (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return NamedFilesWriter(self.options["path"], overwrite)


def write_named(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """A file for each row of files(name, content), content text or bytes; all or none. A name that is there already is an error."""
    files.sparkSession.dataSource.register(NamedFiles)
    rows = files.select("name", files["content"].cast("binary").alias("content"))
    rows.write.format("named_files").mode("overwrite" if overwrite else "append").save(path)
