"""Files as the binary readers and writers of this folder see them: any store that Arrow can open."""

from __future__ import annotations

import os

from pyarrow import fs
from pyspark.sql import SparkSession


def share_package(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies; a cluster gets it with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def listed(path: str, suffix: str) -> list[str]:
    """The file itself, or the files of a folder that end in ``suffix``, in order of name."""
    store, inner = located(path)
    prefix = path[: -len(inner)] if path.endswith(inner) else ""
    found = store.get_file_info(inner)
    if found.type == fs.FileType.Directory:
        inside = store.get_file_info(fs.FileSelector(inner))
        names = sorted(f.path for f in inside if f.is_file and f.path.lower().endswith(suffix))
        if not names:
            raise FileNotFoundError(f"no {suffix} file in {path}")
        return [prefix + n for n in names]
    if found.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return [path]


class Input:
    """Random access to one file."""

    def __init__(self, path: str) -> None:
        store, inner = located(path)
        self.file = store.open_input_file(inner)
        self.size = self.file.size()

    def __enter__(self) -> Input:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def at(self, offset: int, size: int) -> bytes:
        """Exactly ``size`` bytes, or an error that names the place."""
        self.file.seek(offset)
        out = self.file.read(size)
        if len(out) != size:
            raise ValueError(f"the file ends at {self.size}, inside the {size} bytes at {offset}")
        return out


class Parts:
    """Files that one task writes under private names; the commit gives them their own.

    A task that runs twice writes two sets; only the committed one is renamed, so readers never see the other.
    """

    def __init__(self, folder: str) -> None:
        self.store, self.folder = located(folder)

    def create(self) -> None:
        self.store.create_dir(self.folder, recursive=True)

    def empty(self) -> bool:
        if self.store.get_file_info(self.folder).type == fs.FileType.NotFound:
            return True
        return not self.store.get_file_info(fs.FileSelector(self.folder))

    def clear(self) -> None:
        if not self.empty():
            self.store.delete_dir_contents(self.folder)

    def write(self, name: str, content: bytes) -> str:
        with self.store.open_output_stream(f"{self.folder}/{name}.pending") as out:
            out.write(content)
        return name

    def commit(self, names: list[str]) -> None:
        for name in names:
            self.store.move(f"{self.folder}/{name}.pending", f"{self.folder}/{name}")

    def abort(self, names: list[str]) -> None:
        for name in names:
            pending = f"{self.folder}/{name}.pending"
            if self.store.get_file_info(pending).type == fs.FileType.File:
                self.store.delete_file(pending)
