"""One file per row, as a data source with a commit.

A task writes its files below ``_temporary/<run>/<attempt>`` of the target and moves them to their places when all of them are there; what a task
attempt that fails or is lost has written is never seen. The list of what it moved goes to ``_written/<run>`` beside the files, so the
driver hears of attempts, not of files. If the job fails, files that finished tasks moved are removed again by these lists; a mark beside them
tells tasks that are still at it to stop and to take back theirs. Places are
paths of any file system that ``pyarrow.fs`` opens by its address: local or shared folders, HDFS, object stores.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def opened(target: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it; an address without a scheme is a local path."""
    return fs.FileSystem.from_uri(target if "://" in target or target.startswith("file:") else f"file://{target}")


@dataclass
class Attempt(WriterCommitMessage):
    """A task attempt that moved its files."""

    name: str


class FilesWriter(DataSourceWriter):
    def __init__(self, target: str, run: str):
        self.target, self.run = target.rstrip("/"), run

    def write(self, rows: Iterator[Row]) -> Attempt:
        store, root = opened(self.target)
        name = uuid.uuid4().hex
        temporary, written, made = f"{root}/_temporary/{self.run}/{name}", {}, set()

        def folder_of(path: str) -> None:
            folder = path.rsplit("/", 1)[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)

        moved = []
        try:
            for path, body in rows:
                data = (body or "").encode("utf-8")
                self._go_on(store, root)
                folder_of(f"{temporary}/{path}")
                with store.open_output_stream(f"{temporary}/{path}") as out:
                    out.write(data)
                written[path] = len(data)
            self._list(store, f"{root}/_written/{self.run}/{name}.json", written, folder_of)
            for path in written:
                self._go_on(store, root)
                folder_of(f"{root}/{path}")
                store.move(f"{temporary}/{path}", f"{root}/{path}")
                moved.append(path)
            self._go_on(store, root)
        except Exception:
            # The mark comes before the lists are read: what was moved before it is removed by them, what was moved after it here.
            if self._aborted(store, root):
                store.delete_dir_contents(temporary, missing_dir_ok=True)
                for path in [*moved, f"_written/{self.run}/{name}.json"]:
                    if store.get_file_info(f"{root}/{path}").is_file:
                        store.delete_file(f"{root}/{path}")
            raise
        return Attempt(name)

    def _aborted(self, store, root: str) -> bool:
        return store.get_file_info(f"{root}/_written/{self.run}/_aborted").is_file

    def _go_on(self, store, root: str) -> None:
        if self._aborted(store, root):
            raise RuntimeError(f"the job has failed: {self.run}")

    def _list(self, store, path: str, written: dict[str, int], folder_of) -> None:
        """Before the files are moved, so that none is in place that no list names."""
        folder_of(path)
        with store.open_output_stream(path) as out:
            for name, size in written.items():
                out.write((json.dumps({"path": name, "n_bytes": size}) + "\n").encode())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.target)
        done = {m.name for m in messages if m is not None}
        store.create_dir(f"{root}/_written/{self.run}", recursive=True)
        for entry in self._lists(store, root):
            if entry.base_name.removesuffix(".json") not in done:  # an attempt that another one replaced
                store.delete_file(entry.path)
        self._clean(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.target)
        store.create_dir(f"{root}/_written/{self.run}", recursive=True)
        store.open_output_stream(f"{root}/_written/{self.run}/_aborted").close()
        for entry in self._lists(store, root):
            with store.open_input_stream(entry.path) as lines:
                for line in lines.read().decode().splitlines():
                    path = f"{root}/{json.loads(line)['path']}"
                    if store.get_file_info(path).is_file:
                        store.delete_file(path)
            store.delete_file(entry.path)
        self._clean(store, root)

    def _lists(self, store, root: str) -> list[fs.FileInfo]:
        return [e for e in store.get_file_info(fs.FileSelector(f"{root}/_written/{self.run}", allow_not_found=True)) if e.is_file and e.extension == "json"]

    def _clean(self, store, root: str) -> None:
        store.delete_dir_contents(f"{root}/_temporary/{self.run}", missing_dir_ok=True)


class Files(DataSource):
    """Sink for rows (path, body); the option ``run`` names the lists of one write."""

    @classmethod
    def name(cls) -> str:
        return "pagemill_files"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], self.options["run"])
