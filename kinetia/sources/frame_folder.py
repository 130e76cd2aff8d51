"""A sink for labelled frames: images and label files in folders by split, visible all at once or not at all.

Tasks write below a hidden staging folder beside the target, each file under a name of its own attempt that is then renamed, so that a repeated or speculative task leaves the same files.
The driver's commit renames that one folder; abort removes it. Nothing but numbers by split comes back to the driver.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

COLUMNS = ("split", "name", "image", "label")


@dataclass
class Written(WriterCommitMessage):
    counts: dict[str, int]


class FolderWriter(DataSourceWriter):
    def __init__(self, path: str, suffix: str, classes: list[str], run: str):
        parent, _, name = path.rstrip("/").rpartition("/")
        self.path, self.suffix, self.classes = path.rstrip("/"), suffix, classes
        self.staging, self.scratch = f"{parent}/.{name}-{run}", f"{parent}/.{name}-{run}-open"

    def at(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def put(self, place: str, data: bytes, folders: set[str]) -> None:
        system, target = self.at(f"{self.staging}/{place}")
        folder, (_, draft) = target.rpartition("/")[0], self.at(f"{self.scratch}/{uuid.uuid4().hex}")
        for needed in {folder, draft.rpartition("/")[0]} - folders:
            system.create_dir(needed, recursive=True)
            folders.add(needed)
        with system.open_output_stream(draft) as out:
            out.write(data)
        system.move(draft, target)

    def write(self, iterator: Iterator[Row]) -> Written:
        counts, folders = Counter(), set()
        for row in iterator:
            split, name, image, label = (row[c] for c in COLUMNS)
            for part in (split, name):
                if not part or "/" in part or part.startswith("."):
                    raise ValueError(f"not a file's or folder's name: {part!r}")
            if image is not None:
                self.put(f"images/{split}/{name}{self.suffix}", bytes(image), folders)
            self.put(f"labels/{split}/{name}.txt", (label or "").encode(), folders)
            counts[split] += 1
        return Written(dict(counts))

    def commit(self, messages: list[Written | None]) -> None:
        total = Counter()
        for m in messages:
            total.update(m.counts if m else {})
        system, staging = self.at(self.staging)
        system.create_dir(staging, recursive=True)
        lines = [f"path: {self.path}", *(f"{split}: images/{split}  # {n}" for split, n in sorted(total.items())), f"nc: {len(self.classes)}", "names:", *(f"  {i}: {c}" for i, c in enumerate(self.classes))]
        with system.open_output_stream(f"{staging}/data.yaml") as out:
            out.write(("\n".join(lines) + "\n").encode())
        target = self.at(self.path)[1]
        if system.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        system.move(staging, target)
        self.clear(self.scratch)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(self.staging)
        self.clear(self.scratch)

    def clear(self, folder: str) -> None:
        system, place = self.at(folder)
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


class FrameFolder(DataSource):
    """Options: path, suffix (.jpg), classes (comma-joined, plate)."""

    @classmethod
    def name(cls) -> str:
        return "frame_folder"

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        if overwrite:
            raise ValueError("frame folders are written anew, never over another")
        missing = set(COLUMNS) - set(schema.fieldNames())
        if missing:
            raise ValueError(f"columns missing: {sorted(missing)}")
        return FolderWriter(self.options["path"], self.options.get("suffix", ".jpg"), self.options.get("classes", "plate").split(","), uuid.uuid4().hex)


def write(frames: DataFrame, path: str, classes: tuple[str, ...] = ("plate",), suffix: str = ".jpg") -> None:
    """frames: (split, name, image: encoded bytes, null for none, label: the label file's text, null for an empty one) and any other columns, which aren't written. Names are
    unique within a split; of rows with the same name and split one's files stay. An existing path is refused; no rows give a folder with data.yaml alone. A table from which a
    report by video is wanted gives it by a plain groupBy."""
    spark: SparkSession = frames.sparkSession
    spark.dataSource.register(FrameFolder)
    frames.select(*COLUMNS).write.format("frame_folder").mode("append").option("suffix", suffix).option("classes", ",".join(classes)).save(path)
