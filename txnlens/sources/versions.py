"""Folders whose tables are replaced all at once.

Tables are written beside the ones in use, in folders of their own; then one small file, the next
version, names the folders that count. A job that dies before leaves everything as it was, and a
reader sees the tables of one version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

_VERSIONS = "_versions"


@dataclass(frozen=True)
class Version:
    """``parts`` names the folders of each table, relative to the root; ``info`` what a writer noted."""

    number: int = 0
    parts: dict[str, list[str]] = field(default_factory=dict)
    info: dict = field(default_factory=dict)

    def paths(self, root: str, name: str) -> list[str]:
        return [f"{root.rstrip('/')}/{part}" for part in self.parts.get(name, [])]


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))


def _numbers(spark: SparkSession, root: str) -> list[int]:
    files, folder = _files(spark, root), _path(spark, root, _VERSIONS)
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def _read(spark: SparkSession, root: str, number: int) -> Version:
    stream = _files(spark, root).open(_path(spark, root, _VERSIONS, f"{number:012d}.json"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(number, **json.loads(text))


def current(spark: SparkSession, root: str) -> Version:
    """The latest version; number 0, without tables, where there is none."""
    numbers = _numbers(spark, root)
    return _read(spark, root, numbers[-1]) if numbers else Version()


def new_part(name: str) -> str:
    """A folder for a new part of a table."""
    return f"{name}/{uuid.uuid4().hex}"


def switch(spark: SparkSession, root: str, base: Version, parts: dict[str, list[str]], info: dict | None = None) -> Version:
    """Make ``parts`` the tables they name; others stay as they are in ``base``.

    Raises ``RuntimeError`` if another writer has made a version since ``base`` was read.
    """
    files = _files(spark, root)
    new = Version(base.number + 1, {**base.parts, **parts}, {**base.info, **(info or {})})
    final = _path(spark, root, _VERSIONS, f"{new.number:012d}.json")
    waiting = _path(spark, root, _VERSIONS, f"_{uuid.uuid4().hex}")
    out = files.create(waiting, False)
    out.write(json.dumps({"parts": new.parts, "info": new.info}).encode())
    out.close()
    if current(spark, root).number != base.number or files.exists(final) or not files.rename(waiting, final):
        files.delete(waiting, False)
        raise RuntimeError(f"another writer has changed {root}")
    return new


def drop_unused(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete folders that none of the latest ``keep`` versions names, and older versions.

    Not while a writer is at work: its folders are not named yet. Returns how many were deleted.
    """
    files, numbers = _files(spark, root), _numbers(spark, root)
    known = {n: _read(spark, root, n) for n in numbers}
    named = {part for n in numbers[-keep:] for parts in known[n].parts.values() for part in parts}
    above = {part.rsplit("/", i)[0] for part in named for i in range(1, part.count("/") + 1)}

    def clean(folder: str) -> int:
        deleted = 0
        for status in files.listStatus(_path(spark, root, folder)):
            name = f"{folder}/{status.getPath().getName()}"
            if name in above:
                deleted += clean(name)
            elif name not in named and status.isDirectory():
                deleted += bool(files.delete(status.getPath(), True))
        return deleted

    deleted = sum(clean(top) for top in sorted({part.split("/")[0] for v in known.values() for parts in v.parts.values() for part in parts}))
    for n in numbers[:-keep]:
        files.delete(_path(spark, root, _VERSIONS, f"{n:012d}.json"), False)
    return deleted
