"""A live listing of a tree of files, as a Python data source whose tasks walk directories."""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

# Folders of these names, and paths that begin so, are not listed.
IGNORED_SEGMENTS = (".atlas", ".git", ".next", ".turbo", ".cache", "build", "coverage", "dist", "node_modules", "out")
IGNORED_PREFIXES = ("data/", "relay/data/", "app/.next/", "app/out/", "app-solid/dist/", "terminal/dist/")


class _Part(InputPartition):
    """Files to report, directories whose own files to report, and directories to walk."""

    def __init__(self, files: list[str], listed: list[str], walked: list[str]):
        super().__init__(None)
        self.files, self.listed, self.walked = files, listed, walked


class _Tree(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.abspath(options["path"])
        self.segments, self.prefixes = set(json.loads(options["segments"])), tuple(json.loads(options["prefixes"]))
        self.filters, self.slices = json.loads(options["filters"]), int(options["slices"])

    def _ignored(self, path: str) -> bool:
        return not self.segments.isdisjoint(path.split("/")) or f"{path}/".startswith(self.prefixes)

    def _under(self, path: str) -> Iterator[tuple[str, bool]]:
        """(path, is a directory) of what a directory holds; links, what is ignored and unreadable directories give nothing."""
        try:
            with os.scandir(os.path.join(self.root, path)) as entries:
                for e in entries:
                    child = f"{path}/{e.name}" if path else e.name
                    if not e.is_symlink() and not self._ignored(child) and (e.is_dir() or e.is_file()):
                        yield child, e.is_dir()
        except OSError:
            return

    def _starts(self) -> Iterator[str]:
        """The filters that lie within the root and below no other one."""
        clean = {os.path.normpath(f) if f else "." for f in self.filters or [""]}
        clean = {"" if f == "." else f for f in clean if not f.startswith(("/", "../")) and f != ".."}
        for f in clean:
            parts = f.split("/")
            above = {""} | {"/".join(parts[:i]) for i in range(1, len(parts))}
            if f and (above & clean or self._ignored(f)):
                continue
            yield f

    def partitions(self) -> list[_Part]:
        """Directories are opened here only until there are enough to share out; tasks walk what lies below."""
        files, opened, waiting = [], [], deque()
        for start in self._starts():
            full = os.path.join(self.root, start)
            if not os.path.islink(full):
                (waiting if os.path.isdir(full) else files if os.path.isfile(full) else []).append(start)
        while waiting and len(waiting) < self.slices and len(opened) < self.slices:
            opened.append(waiting.popleft())
            waiting.extend(child for child, folder in self._under(opened[-1]) if folder)
        walked = [p for p in (list(waiting)[i :: self.slices] for i in range(self.slices)) if p]
        return [_Part(files, opened, []), *(_Part([], [], w) for w in walked)]

    def read(self, part: _Part) -> Iterator[tuple]:
        for path in part.files:
            yield from self._row(path)
        for path in part.listed:
            for child, folder in self._under(path):
                if not folder:
                    yield from self._row(child)
        stack = list(part.walked)
        while stack:
            for child, folder in self._under(stack.pop()):
                if folder:
                    stack.append(child)
                else:
                    yield from self._row(child)

    def _row(self, path: str) -> Iterator[tuple]:
        try:
            found = os.lstat(os.path.join(self.root, path))
        except OSError:  # gone since it was listed
            return
        yield path, found.st_size, datetime.fromtimestamp(found.st_mtime, timezone.utc)


class LiveTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_tree"

    def schema(self) -> str:
        return "file_path string, bytes long, modified_at timestamp"

    def reader(self, schema) -> _Tree:
        return _Tree(self.options)


def live_files(
    spark: SparkSession, root: str, *, filters: Sequence[str] = (), limit: int | None = None, segments: Sequence[str] = IGNORED_SEGMENTS, prefixes: Sequence[str] = IGNORED_PREFIXES, slices: int = 64
) -> DataFrame:
    """(file_path, bytes, modified_at[, truncated]) of the files that are below ``root`` now, each once.

    ``filters`` are files or directories relative to the root (all of it without any); those that are ignored, missing, links,
    or outside the root give nothing. Links are never followed. With a ``limit`` the first so many by path are
    given, and ``truncated`` says whether there are more. The root must be a folder that every executor sees.
    """
    if "://" in root.removeprefix("file://"):
        raise ValueError(f"not a folder of a mounted file system: {root}")
    folder = "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else os.path.abspath(root)
    spark.dataSource.register(LiveTree)
    options = {"segments": json.dumps(list(segments)), "prefixes": json.dumps(list(prefixes)), "filters": json.dumps(list(filters)), "slices": str(slices)}
    found = spark.read.format("live_tree").options(**options).load(folder)
    if limit is None:
        return found
    first = found.orderBy("file_path").limit(limit + 1)  # so the windows below hold no more
    w = Window.orderBy("file_path")
    counted = first.withColumns({"n": F.row_number().over(w), "truncated": F.count("*").over(Window.partitionBy()) > limit})
    return counted.where(F.col("n") <= limit).drop("n")
