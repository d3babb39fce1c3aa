"""A directory tree of files, listed and read by tasks.

Spark's own file sources leave out every name that starts with an underscore,
and with it ``__init__.py``; they list on the driver and read a file's content before a filter on
its path can be applied.  Here directories are rows.  A task lists the directories it is given and those it finds below
them, up to a number; what is left are the rows of the next round, dealt to all tasks again.  Names of files are
written by the task that meets them, so the driver holds none, and pruned directories are not entered.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusqa.sources.tables import written

LISTED = "path string, rel_path string, length bigint, is_directory boolean"
READ = "path string, rel_path string, length bigint, content binary"
#: Directories that a task lists for one row, and those it has found and not listed, at most.
DEEP, OPEN = 1000, 10_000


def _open(path: str):
    """File system and path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), posixpath.abspath(path)


def _entries(filesystem, folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, length, is a directory) of what is in a folder; links to directories are left out, as they may lead
    back to where they are."""
    from pyarrow import fs

    if isinstance(filesystem, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                if x.is_dir(follow_symlinks=False):
                    yield x.path, 0, True
                elif x.is_file():
                    yield x.path, x.stat().st_size, False
        return
    for info in filesystem.get_file_info(fs.FileSelector(folder)):
        if info.type in (fs.FileType.Directory, fs.FileType.File):
            yield info.path, info.size or 0, info.type == fs.FileType.Directory


def _lister(root: str, wanted: Callable[[str], bool], ignored: frozenset[str], deep: int, most: int):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("rel_path", pa.string()), ("length", pa.int64()), ("is_directory", pa.bool_())])
        filesystem, top = _open(root)
        top = top.rstrip("/")
        rows: list[tuple] = []

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows.clear()
            return out

        def row(path: str, length: int, folder: bool) -> None:
            rows.append((path, path[len(top) + 1:], length, folder))

        for some in batches:
            for folder in some.column(0).to_pylist():
                todo, listed = [top if folder is None else folder], 0
                while todo and listed < deep:
                    listed += 1
                    for path, length, is_folder in _entries(filesystem, todo.pop()):
                        name = posixpath.basename(path)
                        if name.startswith("."):
                            continue
                        if not is_folder:
                            if wanted(name):
                                row(path, length, False)
                        elif name not in ignored:
                            if len(todo) < most:
                                todo.append(path)
                            else:
                                row(path, 0, True)
                        if len(rows) >= 1000:
                            yield batch()
                for path in todo:
                    row(path, 0, True)
        if rows:
            yield batch()

    return run


def _wanted(extensions: Sequence[str] | None, names: Sequence[str]) -> Callable[[str], bool]:
    known, whole = None if extensions is None else frozenset(extensions), frozenset(names)
    return lambda name: known is None or name in whole or posixpath.splitext(name)[1].lower() in known


def list_files(spark: SparkSession, root: str, extensions: Sequence[str] | None = None, names: Sequence[str] = (),
               ignored: Sequence[str] = (), deep: int = DEEP, most: int = OPEN) -> DataFrame:
    """path, rel_path and length of the files below ``root``, as tables in the scratch folder.

    Names that start with a dot are left out, and so is what is below ``ignored`` directories.  Of a round's directories each
    is a row of its own, so a chain of directories takes a round for ``deep`` of them.
    """
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lister = _lister(root, _wanted(extensions, names), frozenset(ignored), deep, most)
    folders = spark.range(1).select(F.lit(None).cast("string").alias("path"))  # the root
    rounds = []
    while True:
        listed = written(folders.mapInArrow(lister, LISTED), "listed")
        rounds.append(listed.filter(~F.col("is_directory")).drop("is_directory"))
        folders = listed.filter("is_directory").select("path")
        if folders.isEmpty():
            break
        folders = folders.repartition(parts, "path")
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionAll(more)
    return out


def read_files(files: DataFrame, root: str, split_bytes: int = 64 << 20, max_bytes: int | None = None) -> DataFrame:
    """Adds the content of listed files, dealt to tasks by their number and size; it is null above ``max_bytes``."""
    total = files.agg(F.sum(F.col("length") + 4096)).first()[0] or 0

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("rel_path", pa.string()),
                            ("length", pa.int64()), ("content", pa.binary())])
        filesystem, _ = _open(root)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, rel, size in zip(*(c.to_pylist() for c in batch.columns)):
                content = None
                if max_bytes is None or size <= max_bytes:
                    with filesystem.open_input_stream(path, compression=None) as f:
                        content = f.read()
                rows.append((path, rel, size, content))
                held += len(content or b"")
                if held >= 16 << 20 or len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    dealt = files.select("path", "rel_path", "length").repartition(max(1, -(-total // split_bytes)))
    return dealt.mapInArrow(run, READ)
