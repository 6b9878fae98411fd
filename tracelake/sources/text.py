"""Text of plain and Office files, and the member lists of archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import paths

# The XML members that hold text, with the elements read from them, in reading order.
OFFICE_MEMBERS = [
    (".docx", r"word/document\.xml", ["t"]),
    (".docx", r"word/footnotes\.xml", ["t"]),
    (".docx", r"word/endnotes\.xml", ["t"]),
    (".xlsx", r"xl/sharedStrings\.xml", ["t"]),
    (".xlsx", r"(?i)xl/worksheets/sheet.*\.xml", ["v", "t"]),
    (".pptx", r"(?i)ppt/slides/slide.*\.xml", ["t"]),
]

# The part with a file's properties, and the elements read from it.
CORE, PROPERTIES = "docProps/core.xml", ["creator", "lastModifiedBy", "created"]
#: Bytes unpacked at a time, characters in a row, and unpacked bytes of a member that is read.
CHUNK, PIECE, MOST_BYTES = 1 << 16, 1 << 20, 1 << 30
COLUMNS = pa.schema([("path", pa.string()), ("position", pa.int32()), ("member", pa.string()), ("place", pa.int32()), ("piece", pa.int32()),
                     ("element", pa.string()), ("text", pa.string()), ("error", pa.string())])
#: Entries that leave a task together.
ENTRIES = 10_000
LISTING = pa.schema([("archive", pa.string()), ("position", pa.int32()), ("entry_name", pa.string()), ("size_bytes", pa.int64()),
                     ("error", pa.string())])


def plain_files(files: DataFrame) -> DataFrame:
    """SRC-4 over (path, content): supported types that are not Office files. Other columns are kept."""
    text = paths.is_text("path") & ~paths.extension("path").isin(".docx", ".xlsx", ".pptx")
    return files.filter(text).withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).drop("content")


def opened(content) -> zipfile.ZipFile:
    """A zip from its bytes or a path."""
    return zipfile.ZipFile(content if isinstance(content, str) else io.BytesIO(content or b""))


def reason(problem: Exception) -> str:
    return f"{type(problem).__name__}: {problem}"[:500]


class Texts:
    """Reads an XML member as it is unpacked: the text of the wanted elements, in document order."""

    def __init__(self, wanted: set[str]):
        self.wanted, self.found, self.depth, self.name = wanted, [], 0, ""
        self.parts: list[str] = []
        self.parser = expat.ParserCreate()
        self.parser.StartElementHandler, self.parser.EndElementHandler = self.start, self.end
        self.parser.CharacterDataHandler, self.parser.EntityDeclHandler = self.data, self.entity

    def start(self, name: str, _) -> None:
        if self.depth:
            self.depth += 1
        elif (local := name.rpartition(":")[2]) in self.wanted:
            self.depth, self.name, self.parts = 1, local, []

    def end(self, _) -> None:
        if self.depth:
            self.depth -= 1
            if not self.depth:
                self.found.append((self.name, "".join(self.parts)))

    def data(self, text: str) -> None:
        if self.depth:
            self.parts.append(text)

    def entity(self, *_) -> None:
        raise ValueError("entity declarations are not read")


def element_texts(archive: zipfile.ZipFile, info: zipfile.ZipInfo, wanted: set[str], most: int) -> Iterator[tuple[str, str]]:
    """(element, text) of a member, unpacked CHUNK bytes at a time; over `most` unpacked bytes it is given up."""
    texts, size = Texts(wanted), 0
    with archive.open(info) as stream:
        while chunk := stream.read(CHUNK):
            size += len(chunk)
            if size > most:
                raise ValueError(f"more than {most} bytes unpacked")
            texts.parser.Parse(chunk, False)
            yield from texts.found
            texts.found.clear()
        texts.parser.Parse(b"", True)


def member_elements(extension: str, name: str) -> tuple[int | None, set[str]] | None:
    """The reading order and the elements of a member that holds text (order null: properties), else nothing."""
    for order, (kind, pattern, elements) in enumerate(OFFICE_MEMBERS):
        if kind == extension and re.fullmatch(pattern, name):
            return order, set(elements)
    return (None, set(PROPERTIES)) if name == CORE else None


def read_members(most: int):
    """A function from (path, content) to rows of COLUMNS: the text of a file's members in pieces of about PIECE characters,
    each property of its core part, and every problem. A file that is no zip and a member that is damaged, encrypted, not
    well-formed or larger than `most` bytes give a row with the error; a member's pieces may come before its error."""

    def run(batches):
        rows: list[tuple] = []

        def flushed(least: int = 0):
            if rows and sum(len(r[6] or "") for r in rows) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), COLUMNS)], schema=COLUMNS)
                rows.clear()

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    archive = opened(content.as_py())
                    members = list(enumerate(archive.infolist()))
                except Exception as problem:  # whatever is wrong with one file must not end the job
                    rows.append((path, -1, None, None, 0, None, None, reason(problem)))
                    continue
                extension = "." + path.rpartition(".")[2].lower()
                for i, info in members:
                    rule = member_elements(extension, info.filename)
                    if rule is None:
                        continue
                    place, number, size, held = rule[0], 0, 0, []
                    error = None
                    try:
                        for name, text in element_texts(archive, info, rule[1], most):
                            if place is None:
                                rows.append((path, i, info.filename, None, number, name, text, None))
                                number += 1
                            elif text.strip(" "):
                                held.append(text)
                                size += len(text)
                                if size >= PIECE:
                                    rows.append((path, i, info.filename, place, number, None, " ".join(held), None))
                                    number, size, held = number + 1, 0, []
                                    yield from flushed(4 * PIECE)
                    except Exception as problem:
                        error = reason(problem)
                    if held:
                        rows.append((path, i, info.filename, place, number, None, " ".join(held), None))
                    if error:
                        rows.append((path, i, info.filename, place, number + 1, None, None, error))
                yield from flushed(4 * PIECE)
        yield from flushed()

    return run


def list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) to rows of LISTING: the central directory only. Content is the bytes of the archive, or its path, of
    which only the end is then read."""
    def listed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), LISTING)], schema=LISTING)

    for batch in batches:
        rows: list[tuple] = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            try:
                rows += [(path, i, info.filename, info.file_size, None) for i, info in enumerate(opened(content.as_py()).infolist())]
            except Exception as problem:
                rows.append((path, -1, None, None, reason(problem)))
            if len(rows) >= ENTRIES:
                yield listed(rows)
                rows = []
        if rows:
            yield listed(rows)


def office_members(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Text and properties of Office files, in pieces (see `read_members`): path, position, member, place, piece, element,
    text, error. Memory is bounded by a piece, whatever a member unpacks to; members over `most` bytes are reported."""
    office = files.filter(paths.extension("path").isin(".docx", ".xlsx", ".pptx"))
    return office.select("path", "content").mapInArrow(
        read_members(most), "path string, position int, member string, place int, piece int, element string, text string, error string")


def reading_errors(members: DataFrame) -> DataFrame:
    """(path, member, error) of everything that could not be read."""
    return members.filter("error IS NOT NULL").select("path", "member", "error")


def archive_entries(files: DataFrame) -> DataFrame:
    """ARC-1: one row per archive entry, nothing is extracted; an unreadable archive is one row with an error.

    With a column `content` the archives' bytes are searched. Without it the paths are opened where the task runs
    (a mounted file system) and only the directory at the end is read, whatever the archive's size.
    """
    archives = files.filter(paths.is_openable_archive("path"))
    content = "content" if "content" in files.columns else F.col("path").alias("content")
    return archives.select("path", content).mapInArrow(
        list_members, "archive string, position int, entry_name string, size_bytes long, error string")


def office_text(members: DataFrame) -> DataFrame:
    """SRC-5: text elements joined by spaces, members in reading order. Members that could not be read to their end are
    left out (see `reading_errors`)."""
    rows = members.filter("place IS NOT NULL")
    pieces = F.array_sort(F.collect_list(F.struct("place", "position", "piece", "text")))
    bad = F.collect_set(F.when(F.col("error").isNotNull(), F.col("position")))
    whole = F.filter("pieces", lambda p: p["text"].isNotNull() & ~F.array_contains("bad", p["position"]))
    return (rows.groupBy("path").agg(pieces.alias("pieces"), bad.alias("bad"))
            .select("path", F.array_join(F.transform(whole, lambda p: p["text"]), " ").alias("text")).filter("text <> ''"))
