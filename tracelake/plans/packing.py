"""Office files and archives made from the given texts, as input for the readers that open them."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import cache
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters XML 1.0 cannot carry.
FORBIDDEN = {i: None for i in range(32) if i not in (9, 10, 13)}


def paragraphs(text: str, element: str) -> str:
    lines = "".join(f"<w:p><w:{element}>{escape(line.translate(FORBIDDEN))}</w:{element}></w:p>" for line in text.split("\n"))
    return f'<w:document xmlns:w="urn:w">{lines}</w:document>'


@cache
def opening(damage: str) -> bytes:
    """A zip with the entries that do not depend on the text."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", compression(damage), compresslevel=1) as out:
        out.writestr("docs/passport_scan.jpg", b"x" * 10)
        out.writestr("word/footnotes.xml", paragraphs("note " * 400_000 if damage == "vast" else "note", "t")[: -5 if damage == "malformed" else None])
    return buffer.getvalue()


def compression(damage: str) -> int:
    return zipfile.ZIP_STORED if damage == "torn" else zipfile.ZIP_DEFLATED


#: The part that holds the text, by kind of file.
PARTS = {"docx": "word/document.xml", "xlsx": "xl/sharedStrings.xml", "pptx": "ppt/slides/slide1.xml", "zip": "word/document.xml"}
#: Bytes of files that leave a task together.
OUT_BYTES = 1 << 22


def zipped(text: str, author: str, part: str, damage: str) -> bytes:
    """A zip with the text, a core-properties part and some entries. Damage: `malformed` footnotes, a `marked`
    (byte-order mark) text, a `torn` text whose data no longer match their checksum, `vast` footnotes that unpack to two megabytes, or `none`
    of a zip at all."""
    if damage == "none":
        return text.encode()[:50]
    buffer = io.BytesIO(opening(damage))
    with zipfile.ZipFile(buffer, "a", compression(damage), compresslevel=1) as out:
        body = paragraphs(text, "t")
        out.writestr(part, body.encode("utf-8-sig") if damage == "marked" else body)
        core = f"<c:p xmlns:c='urn:c'><c:creator> {escape(author)} </c:creator><c:created>2020-01-01</c:created></c:p>"
        out.writestr("docProps/core.xml", core)
        out.writestr("README.md", text)
    raw = bytearray(buffer.getvalue())
    if damage == "torn":
        raw[raw.index(b"urn:w", raw.index(part.encode())) + 4] += 1
    return bytes(raw)


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, text, author, damage) to (path, content), some OUT_BYTES of content at a time."""
    for batch in batches:
        paths, contents, size = [], [], 0
        for row in zip(*(batch.column(n) for n in ("path", "text", "author", "damage"))):
            path, text, author, damage = (value.as_py() for value in row)
            paths.append(path)
            contents.append(zipped(text, author, PARTS[path.rpartition(".")[2]], damage))
            size += len(contents[-1])
            if size >= OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                paths, contents, size = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])


def pack(texts: DataFrame) -> DataFrame:
    """Files from texts (path, text, author and perhaps damage)."""
    damage = "damage" if "damage" in texts.columns else F.lit("").alias("damage")
    return texts.select("path", "text", "author", damage).mapInArrow(packed, "path string, content binary")
