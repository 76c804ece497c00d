"""A file tree as a Spark data source: listed in parts, pruned before anything is opened, with unreadable files as rows of their own.

The driver lists only as many directories as give the tasks their share; a task walks its directories and reads the files it finds one by one. Skipped and dot directories are never entered; files of other extensions, of too many bytes, ignored,
sensitive or ruled out by a pushed filter are never opened. A directory or file that can't be read gives a row with the error and null content; the rest of the tree is complete.
Any store that pyarrow knows by the root's address can be read (file, hdfs, s3, gs); a plain path is a local or mounted folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from lodestone.functions import rules

SCHEMA = "path string, ext string, size_bytes long, modified timestamp, content string, error string"


def _store(root: str):
    """The file system of a root, and the root's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))


def extension_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1] if "." in name else ""


def ignored_by(path: str, patterns: list[str]) -> bool:
    """See tree.ignored, whose patterns these are."""
    import re

    def one(p: str) -> bool:
        if p.endswith("/"):
            return path.startswith(p)
        if p.startswith("*"):
            return path.endswith(p[1:])
        if "*" in p:
            return re.search("^" + ".*".join(map(re.escape, p.split("*"))) + "$", path) is not None
        return path == p or path.startswith(p + "/")

    return any(map(one, patterns))


class Share(InputPartition):
    """Directories of one task: those to be walked, and those of which only the files are meant."""

    def __init__(self, deep: list[str], flat: list[str]):
        super().__init__(0)
        self.deep, self.flat = deep, flat


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.most_bytes = int(options.get("mostBytes", rules.MOST_FILE_BYTES))
        self.tasks = int(options.get("tasks", 64))
        self.ignore = json.loads(options.get("ignore", "[]"))
        self.extensions: set[str] = set(rules.EXTENSION_LANGUAGE)
        self.prefixes: list[str] = []
        self.suffixes: list[str] = []
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on path and ext; Spark applies all others."""
        for f in filters:
            column = getattr(f, "attribute", None)
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == ("ext",) and values is not None:
                self.extensions &= values
            elif column == ("path",) and values is not None:
                self.paths = values if self.paths is None else self.paths & values
            elif column == ("path",) and isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
            elif column == ("path",) and isinstance(f, StringEndsWith):
                self.suffixes.append(f.value)
            else:
                yield f

    def wanted_dir(self, path: str) -> bool:
        """Whether a directory below the root (its relative path) may hold what is asked for."""
        name = path.rsplit("/", 1)[-1]
        if name in rules.SKIP_DIRS or name.startswith(".") or ignored_by(path + "/", [p for p in self.ignore if p.endswith("/")]):
            return False
        inside = lambda asked: asked.startswith(path + "/") or (path + "/").startswith(asked)
        return all(map(inside, self.prefixes)) and (self.paths is None or any(p.startswith(path + "/") for p in self.paths))

    def wanted_file(self, path: str, size: int | None) -> bool:
        if extension_of(path) not in self.extensions or (size is not None and size > self.most_bytes) or ignored_by(path, self.ignore):
            return False
        return all(map(path.startswith, self.prefixes)) and all(map(path.endswith, self.suffixes)) and (self.paths is None or path in self.paths)

    def _listed(self, store, base: str, folder: str) -> tuple[list[str], list, str | None]:
        """(directories to be entered, files, error) of a directory given by its relative path."""
        from pyarrow import fs

        try:
            found = sorted(store.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base)), key=lambda i: i.path)
        except OSError as e:
            return [], [], f"{type(e).__name__}: {e}"
        place = lambda i: f"{folder}/{i.base_name}" if folder else i.base_name
        return [place(i) for i in found if i.type == fs.FileType.Directory and self.wanted_dir(place(i))], [(place(i), i) for i in found if i.type != fs.FileType.Directory], None

    def partitions(self) -> list[Share]:
        store, base = _store(self.root)
        open_, flat = [""], []
        # Level by level, until there are enough directories for the tasks.
        while open_ and len(open_) < self.tasks:
            below = [d for folder in open_ for d in self._listed(store, base, folder)[0]]
            flat += open_
            open_ = below
        shares = max(1, min(self.tasks, len(open_) + len(flat)))
        return [Share(open_[k::shares], flat[k::shares]) for k in range(shares)]

    def read(self, share: Share) -> Iterator[tuple]:
        store, base = _store(self.root)
        waiting = [(d, True) for d in share.deep] + [(d, False) for d in share.flat]
        while waiting:
            folder, enter = waiting.pop()
            below, files, error = self._listed(store, base, folder)
            if error is not None:
                yield folder, "", None, None, None, error
            if enter:
                waiting += [(d, True) for d in below]
            for path, info in files:
                if self.wanted_file(path, info.size):
                    yield self._row(store, path, info)

    def _row(self, store, path: str, info) -> tuple:
        head = (path, extension_of(path), info.size, info.mtime)
        try:
            with store.open_input_stream(info.path) as stream:
                return *head, bytes(stream.read()).decode("utf-8", "replace"), None
        except OSError as e:
            return *head, None, f"{type(e).__name__}: {e}"


class TreeSource(DataSource):
    """format("tree"): options path, ignore (a JSON list of patterns), mostBytes and tasks."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, most_bytes: int = rules.MOST_FILE_BYTES, tasks: int | None = None) -> DataFrame:
    """(path, ext, size_bytes, modified, content, error) of a tree's source files. error is null where content was read; filters on path and ext reach the listing."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("tree").option("ignore", json.dumps(ignore or [])).option("mostBytes", str(most_bytes))
    return reader.option("tasks", str(tasks or max(64, spark.sparkContext.defaultParallelism))).load(root)
