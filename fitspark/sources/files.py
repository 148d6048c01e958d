"""A sink that makes one text or DOCX file of each row."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from fitspark.cluster import ship

#: Characters that XML does not allow, and what stands for them.
NOT_XML = {i: "�" for i in [*range(9), 11, 12, *range(14, 32), 0xFFFE, 0xFFFF]}
PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}


def docx_bytes(text: str) -> bytes:
    """A DOCX with a paragraph for each line; equal texts give equal bytes."""
    lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line.translate(NOT_XML))}</w:t></w:r></w:p>' for line in text.split("\n"))
    body = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{lines}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in {**PARTS, "word/document.xml": body}.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + part)
    return out.getvalue()


RENDERED = {"txt": lambda text: text.encode(), "docx": docx_bytes}


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task has written: its folder and the names in it."""

    folder: str
    names: list[str]


class FileWriter(DataSourceWriter):
    """Tasks write to folders of their own; only a commit moves files to where readers look."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.stage = path, overwrite, f"_writing-{uuid.uuid4().hex}"

    def place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, root = self.place()
        folder = f"{root}/{self.stage}/{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        names = []
        for row in iterator:
            kind = row["kind"] if row["kind"] in RENDERED else None
            name = row["name"]
            if kind is None or not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"a row needs a plain name and one of the kinds {', '.join(RENDERED)}: {name!r}, {row['kind']!r}")
            names.append(f"{name}.{kind}")
            with files.open_output_stream(f"{folder}/{names[-1]}") as out:
                out.write(RENDERED[kind](row["text"] or ""))
        return Written(folder, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, root = self.place()
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        there = {f.base_name for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File}
        twice = {n for n in names if names.count(n) > 1} if len(set(names)) < len(names) else set()
        clash = twice or (set() if self.overwrite else there & set(names))
        if clash:
            files.delete_dir(f"{root}/{self.stage}")
            raise ValueError(f"files of one name: {', '.join(sorted(clash)[:5])}")
        for m in done:
            for n in m.names:
                files.move(f"{m.folder}/{n}", f"{root}/{n}")
        if self.overwrite:
            for n in there - set(names):
                files.delete_file(f"{root}/{n}")
        files.delete_dir(f"{root}/{self.stage}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, root = self.place()
        if files.get_file_info(f"{root}/{self.stage}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.stage}")


class FileSource(DataSource):
    """Rows (name, kind, text) as files <name>.<kind> in the folder `path`, an address that the driver and all tasks reach."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, kind string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Write each row (name, kind: txt or docx, text) as a file of its own, all or none.

    Null text is an empty file. Two rows of one name and kind, a name that is no plain file name,
    and, unless `overwrite`, a file that is there already are errors, after which the
    folder is as before. With `overwrite` files that are not written again go. Files are
    moved one by one on commit, so a reader at that moment may see some of them.
    """
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(FileSource)
    address = path if "://" in path else f"file://{path}"
    rows.select("name", "kind", "text").write.format("text_files").mode("overwrite" if overwrite else "append").option("path", address).save()
