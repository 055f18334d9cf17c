"""Files of any store that Arrow can name, and a writer that shows a job's files all at once or not at all."""

from __future__ import annotations

import fnmatch
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; a path without a scheme is local."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files of a folder that match, or of those that a pattern in the last part names."""
    files, root = store(path)
    info = files.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    if info.type == fs.FileType.NotFound:
        root, _, pattern = root.rpartition("/")
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))


@dataclass
class Staged(WriterCommitMessage):
    """What one task wrote: (staged path, final name)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class StagedWriter(DataSourceArrowWriter):
    """Tasks write below a folder of the job; commit moves what successful tasks report, abort deletes all.

    A failed or repeated attempt leaves nothing. An existing file, or one name from two tasks, fails the job before any
    file moves, unless it may overwrite.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = f"_staged-{uuid.uuid4().hex}"

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes | Iterator[bytes]]]:
        """Names and contents of a task's files."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, root = store(self.path)
        folder = f"{root}/{self.job}/{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        out = Staged()
        for n, (name, content) in enumerate(self.parts(iterator)):
            staged = f"{folder}/{n}"
            with files.open_output_stream(staged) as f:
                for piece in [content] if isinstance(content, bytes) else content:
                    f.write(piece)
            out.files.append((staged, name))
        return out

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = store(self.path)
        moves = [(a, f"{root}/{name}") for m in messages if m for a, name in m.files]
        finals = [b for _, b in moves]
        try:
            if len(set(finals)) < len(finals):
                raise ValueError("two tasks wrote one file: rows of a file must share a partition")
            if not self.overwrite:
                there = [i.path for i in (files.get_file_info(finals) if finals else []) if i.type != fs.FileType.NotFound]
                if there:
                    raise FileExistsError(there[0])
            for a, b in moves:
                files.move(a, b)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        files, root = store(self.path)
        if files.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.job}")
