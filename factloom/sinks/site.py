"""Pages as files of their own, one for each row, by a writer with two phases.

Tasks write each page below a folder of their attempt, beside the site. Only when all tasks have ended does the driver
move the files of the attempts that count to their places; attempts that failed, or ran twice, are deleted with that
folder. So a site has each page once, whole, or none of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: The folder beside the pages in which they are written first.
BESIDE = "_beside"


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task attempt that has ended, and its number of files."""

    folder: str
    files: int


class SiteWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        files, base = _file_system(self.path)
        folder, count = f"{BESIDE}/{self.job}/{uuid.uuid4().hex}", 0
        files.create_dir(f"{base}/{folder}", recursive=True)
        for row in iterator:
            if not row.file_name or "/" in row.file_name or row.file_name.startswith(("_", ".")):
                raise ValueError(f"no name of a page: {row.file_name!r}")
            with files.open_output_stream(f"{base}/{folder}/{row.file_name}") as out:
                out.write((row.html or "").encode())
            count += 1
        return Written(folder, count)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileSelector, FileType

        files, base = _file_system(self.path)
        moves = [(x.path, f"{base}/{x.base_name}") for m in messages if m for x in files.get_file_info(FileSelector(f"{base}/{m.folder}"))]
        if len({to for _, to in moves}) < sum(m.files for m in messages if m):
            self.abort(messages)
            raise ValueError("two pages have one name")
        if not self.overwrite and any(x.type != FileType.NotFound for x in files.get_file_info([to for _, to in moves])):
            self.abort(messages)
            raise FileExistsError("a page is there already; write in mode overwrite to replace pages")
        for source, to in moves:
            files.move(source, to)
        files.delete_dir(f"{base}/{BESIDE}/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        files, base = _file_system(self.path)
        own = f"{base}/{BESIDE}/{self.job}"
        if files.get_file_info(own).type != FileType.NotFound:
            files.delete_dir(own)


class SiteDataSource(DataSource):
    """The format site: rows of file_name and html, each of which becomes a file below path."""

    @classmethod
    def name(cls) -> str:
        return "site"

    def writer(self, schema: StructType, overwrite: bool) -> SiteWriter:
        if not {"file_name", "html"} <= set(schema.names):
            raise ValueError("a site is written from file_name and html")
        return SiteWriter(self.options["path"], overwrite)


def write_site(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Writes each row's html to path/file_name. path is a folder that the driver and all executors can write to.

    append writes new pages and fails, with no page written, if one is there already; overwrite replaces pages of the
    same names and leaves others. Two rows of one name fail. A null html is an empty page, an empty table writes nothing.
    """
    pages.sparkSession.dataSource.register(SiteDataSource)
    named = pages.select(F.col("file_name").cast("string").alias("file_name"), F.col("html").cast("string").alias("html"))
    named.write.format("site").mode(mode).option("path", path).save()
