"""Binary files as a sink and a source: figures of pages, layouts, any column of bytes, one file a row.

Each attempt of a task writes into a folder of its own. A write counts when its manifest, which names the folders of the
attempts that ended well, appears by one rename; readers go by manifests only. So a lost executor, a retried or a
speculative task leaves nothing half-written that a reader could see, and the driver moves one small file, however many
files were written. Files are spread over one folder a task, so no folder lists them all.

Input columns: ``folder`` and ``file_name`` (plain names without separators; equal pairs must not occur), ``content``. A null
content is an empty file; the reader passes over empty files; a null name is refused. Folders may be local paths or any URI that pyarrow's file systems know.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MANIFEST = "_manifest-"
#: Bytes of files that a reading task holds, and one file more.
READ_BYTES = 8 << 20


def place_of(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _listed(files: fs.FileSystem, folder: str, prefix: str) -> list[str]:
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(x.base_name for x in found if x.base_name.startswith(prefix))


@dataclass
class Written(WriterCommitMessage):
    part: str
    files: int


class FileTreeWriter(DataSourceArrowWriter):
    """Two-phase writer: attempts fill folders of their own, and the commit names those that count."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.write_id = path, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = place_of(self.path)
        task = TaskContext.get()
        part, made, n = f"part-{self.write_id}-{task.partitionId():05d}-{task.taskAttemptId()}", set(), 0
        for b in batches:
            for folder, name, content in zip(b.column("folder").to_pylist(), b.column("file_name").to_pylist(), b.column("content")):
                if not folder or not name or "/" in folder + name:
                    raise ValueError(f"not a plain name: {folder!r}, {name!r}")
                target = f"{root}/{part}/{folder}"
                if target not in made:
                    files.create_dir(target, recursive=True)
                    made.add(target)
                with files.open_output_stream(f"{target}/{name}") as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
                n += 1
        return Written(part, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = place_of(self.path)
        files.create_dir(root, recursive=True)
        parts = sorted(m.part for m in messages if m and m.files)
        before = [m for m in _listed(files, root, MANIFEST)] if self.overwrite else []
        told = f"{root}/_new-{self.write_id}"
        with files.open_output_stream(told) as out:
            out.write(json.dumps(parts).encode())
        files.move(told, f"{root}/{MANIFEST}{self.write_id}")
        # from here on the write counts; what follows only tidies
        self._drop(files, root, f"part-{self.write_id}-", set(parts))
        for m in before:
            files.delete_file(f"{root}/{m}")
            self._drop(files, root, f"part-{m.removeprefix(MANIFEST)}-", set())

    def abort(self, messages: list[Written | None]) -> None:
        files, root = place_of(self.path)
        self._drop(files, root, f"part-{self.write_id}-", set())

    @staticmethod
    def _drop(files: fs.FileSystem, root: str, prefix: str, but: set[str]) -> None:
        for part in _listed(files, root, prefix):
            if part not in but:
                files.delete_dir(f"{root}/{part}")


class FileTree(DataSource):
    """``df.write.format("file_tree").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "folder string, file_name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileTreeWriter:
        return FileTreeWriter(self.options["path"], overwrite)


def raster_name(page_no: Column) -> Column:
    """File name of a page's raster."""
    return F.concat(F.lit("raster_page_"), F.lpad(page_no.cast("string"), F.greatest(F.lit(4), F.length(page_no.cast("string"))), F.lit("0")), F.lit(".png"))


def write_files(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Writes rows (folder, file_name, content) as files; all files of a folder go to one task."""
    df.sparkSession.dataSource.register(FileTree)
    rows = df.select("folder", "file_name", F.col("content").cast("binary").alias("content"))
    rows.repartition("folder").write.format("file_tree").mode("overwrite" if overwrite else "append").save(path)


def parts_of(path: str) -> list[str]:
    """Folders of the attempts that count."""
    files, root = place_of(path)
    out = []
    for m in _listed(files, root, MANIFEST):
        with files.open_input_stream(f"{root}/{m}") as told:
            out += json.loads(told.read())
    return [f"{path.rstrip('/')}/{p}" for p in out]


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(folder, file_name, content, n_bytes) of the files under ``path`` that were committed and fit ``pattern``."""
    parts = parts_of(path)
    schema = "folder string, file_name string, content binary, n_bytes long"
    if not parts:
        return spark.createDataFrame([], schema)
    told = spark.createDataFrame([(p,) for p in parts], "part string").repartition(len(parts))
    return told.mapInArrow(partial(_read, pattern=pattern), schema)


def _read(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[pa.RecordBatch]:
    """The files of parts, which tasks list: the driver gets the names of parts only, however many files there are."""
    for part in (p for b in batches for p in b.column("part").to_pylist()):
        files, root = place_of(part)
        held, size = [], 0
        for x in files.get_file_info(fs.FileSelector(root, recursive=True)):
            if not x.is_file or not x.size or not fnmatchcase(x.base_name, pattern):
                continue
            with files.open_input_stream(x.path) as source:
                held.append((x.path.split("/")[-2], x.base_name, source.read(), x.size))
            size += x.size
            if size >= READ_BYTES:
                yield _files(held)
                held, size = [], 0
        if held:
            yield _files(held)


def _files(held: list[tuple[str, str, bytes, int]]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=["folder", "file_name", "content", "n_bytes"])
