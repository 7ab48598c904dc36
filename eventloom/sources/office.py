"""Office files, which are zipped XML, as Markdown."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

OFFICE_SUFFIXES = ("docx", "pptx", "xlsx")
#: Bytes of a file's parts, unpacked, beyond which it is refused.
MOST_BYTES = 1 << 30


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attribute(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _name(k) == name), None)


def _table(rows: list[list[str]]) -> str:
    """A Markdown table; its first row is the head, short rows are filled up."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    lines = ["| " + " | ".join(re.sub(r"\s*\n\s*", " ", c).replace("|", "\\|") for c in [*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


class _Package:
    """The parts of a file."""

    def __init__(self, content: bytes, most: int):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        if sum(i.file_size for i in self.zip.infolist()) > most:
            raise ValueError("too large when unpacked")

    def xml(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def has(self, name: str) -> bool:
        return name in self.zip.NameToInfo

    def targets(self, name: str) -> dict[str, str]:
        """The parts that a part refers to, by id."""
        folder, file = posixpath.split(name)
        rels = f"{folder}/_rels/{file}.rels"
        if not self.has(rels):
            return {}
        return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in self.xml(rels)}


def _runs(paragraph) -> str:
    """Text of a paragraph in Word's or PowerPoint's markup."""
    out = []
    for e in paragraph.iter():
        kind = _name(e.tag)
        out.append(e.text or "" if kind == "t" else "\t" if kind == "tab" and len(e.attrib) == 0 else "\n" if kind in ("br", "cr") else "")
    return "".join(out).strip()


def _docx(package: _Package) -> Iterator[str]:
    def block(e) -> str:
        if _name(e.tag) == "tbl":
            rows = [[" ".join(filter(None, map(_runs, (p for p in cell.iter() if _name(p.tag) == "p")))) for cell in row if _name(cell.tag) == "tc"] for row in e if _name(row.tag) == "tr"]
            return _table(rows)
        text = _runs(e)
        style = next((_attribute(s, "val") or "" for s in e.iter() if _name(s.tag) == "pStyle"), "")
        if text and (level := re.fullmatch(r"[Hh]eading ?([1-6])", style)):
            return "#" * int(level[1]) + " " + text
        if text and style == "Title":
            return "# " + text
        return "- " + text if text and any(_name(s.tag) == "numPr" for s in e.iter()) else text

    def blocks(parent) -> Iterator[str]:
        for e in parent:
            if _name(e.tag) in ("p", "tbl"):
                yield block(e)
            elif _name(e.tag) in ("sdt", "sdtContent"):
                yield from blocks(e)

    for body in package.xml("word/document.xml"):
        yield from blocks(body)


def _pptx(package: _Package) -> Iterator[str]:
    main = "ppt/presentation.xml"
    targets = package.targets(main)
    slides = [targets[_attribute(e, "id") if not e.get("id") else next(v for k, v in e.attrib.items() if k.endswith("}id"))] for e in package.xml(main).iter() if _name(e.tag) == "sldId"]
    for number, slide in enumerate(slides, 1):
        yield f"<!-- Slide {number} -->"
        for shape in package.xml(slide).iter():
            kind = _name(shape.tag)
            if kind == "tbl":
                yield _table([["\n".join(filter(None, (_runs(p) for p in cell.iter() if _name(p.tag) == "p"))) for cell in row if _name(cell.tag) == "tc"] for row in shape if _name(row.tag) == "tr"])
            elif kind == "sp":
                title = any(_name(e.tag) == "ph" and e.get("type") in ("title", "ctrTitle") for e in shape.iter())
                texts = [t for t in (_runs(p) for p in shape.iter() if _name(p.tag) == "p") if t]
                if texts:
                    yield "# " + " ".join(texts) if title else "\n".join(texts)


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _xlsx(package: _Package) -> Iterator[str]:
    main = "xl/workbook.xml"
    shared = []
    if package.has("xl/sharedStrings.xml"):
        shared = ["".join(t.text or "" for t in si.iter() if _name(t.tag) == "t") for si in package.xml("xl/sharedStrings.xml") if _name(si.tag) == "si"]
    targets = package.targets(main)
    for sheet in (e for e in package.xml(main).iter() if _name(e.tag) == "sheet"):
        rows = []
        for row in (e for e in package.xml(targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]).iter() if _name(e.tag) == "row"):
            cells: dict[int, str] = {}
            for at, c in enumerate(e for e in row if _name(e.tag) == "c"):
                value = "".join(x.text or "" for x in c.iter() if _name(x.tag) in ("v", "t"))
                kind = c.get("t")
                cells[_column(c.get("r")) if c.get("r") else at] = shared[int(value)] if kind == "s" else ("FALSE", "TRUE")[int(value)] if kind == "b" else value
            rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
        yield f"## {sheet.get('name')}"
        yield _table([r for r in rows if any(r)])


_READERS = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}


def markdown(content: bytes, suffix: str, most: int = MOST_BYTES) -> str:
    """A file's text; raises for a damaged one. Headings, lists and tables are kept, pictures and notes aren't."""
    return "\n\n".join(filter(None, _READERS[suffix](_Package(content, most))))


def decode(files: DataFrame, content: str = "content", suffix: str = "suffix", most: int = MOST_BYTES) -> DataFrame:
    """files less content, with text and error. A damaged or refused file and one of another format have a null text
    and the reason as error; a null content is a damaged file. Repeated rows are read alike and all stay."""
    own = [c for c in files.columns if c not in (content, "text", "error")]
    kept = own.index(suffix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a file at a time
                part = batch.slice(k, 1)
                text = error = None
                try:
                    text = markdown(part.column(len(own))[0].as_py() or b"", part.column(kept)[0].as_py(), most)
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, StopIteration, RuntimeError, NotImplementedError, EOFError, OSError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], pa.array([text], pa.string()), pa.array([error], pa.string())], [*own, "text", "error"])

    schema = StructType([files.schema[c] for c in own]).add("text", StringType()).add("error", StringType())
    return files.select(*own, F.col(content)).mapInArrow(run, schema)
