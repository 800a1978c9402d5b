"""Files of any format as a Spark sink: tasks write, and only a job that ended well is seen.

``root`` is a folder that the driver and all executors mount.  Tasks write parts
below a folder of the job; once all have ended, parts are put together in order
and renamed.  A job that fails leaves nothing, and what a lost or repeated task
left is not read.
"""

from __future__ import annotations

import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType


@dataclass
class Written(WriterCommitMessage):
    """(path below the root, number of the part, the file that holds it) of a task's parts."""

    parts: list[tuple[str, int, str]] = field(default_factory=list)


class FolderWriter(DataSourceWriter):
    def __init__(self, root: str, job: str):
        self.root, self.work = root, f"{root}/.job-{job}"

    def write(self, iterator: Iterator[Row]) -> Written:
        work, out = Path(self.work), Written()  # there until the job ends: tasks that outlive it cannot write
        for row in iterator:
            part = work / uuid.uuid4().hex
            part.write_bytes(row.content)
            out.parts.append((row.path, row.part, str(part)))
        return out

    def commit(self, messages: list[Written | None]) -> None:
        of: dict[str, list[tuple[int, str]]] = {}
        for name, part, held in (p for m in messages if m for p in m.parts):
            of.setdefault(name, []).append((part, held))
        for name, parts in of.items():
            whole, *rest = [Path(held) for _, held in sorted(parts)]
            if rest:
                with whole.open("ab") as out:
                    for held in rest:
                        with held.open("rb") as more:
                            shutil.copyfileobj(more, out)
            to = Path(self.root) / name
            to.parent.mkdir(parents=True, exist_ok=True)
            whole.replace(to)
        shutil.rmtree(self.work, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        gone = f"{self.work}-gone"
        Path(self.work).rename(gone)
        shutil.rmtree(gone, ignore_errors=True)


def write_files(rows: DataFrame, root: str) -> None:
    """Writes (path, part, content): the parts of a path, in order, are one file below ``root``.

    Files of these names are replaced, others stay.
    """
    job = uuid.uuid4().hex

    class Folder(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"folder-{job}"

        def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
            return FolderWriter(root, job)

    Path(FolderWriter(root, job).work).mkdir(parents=True)
    rows.sparkSession.dataSource.register(Folder)
    rows.select("path", rows["part"].cast("long").alias("part"), "content").write.format(f"folder-{job}").mode("append").save()
