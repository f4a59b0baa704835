"""A corpus folder made from documents: files of several kinds with known units."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from docloom.stages import shared_folder

_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_LINK = '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>'


def _zipped(parts: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for name, body in parts.items():
            archive.writestr(name, body)
    return buffer.getvalue()


def _word(heading: str, said: str, rows: list[list[str]]) -> bytes:
    line = lambda t, style="": f'<w:p>{style}<w:r><w:t xml:space="preserve">{t}</w:t></w:r></w:p>'
    table = "".join("<w:tr>" + "".join(f"<w:tc>{line(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows)
    title = line(heading, '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>')
    return _zipped({"word/document.xml": f"<w:document {_WORD}><w:body>{title}{line(said)}<w:tbl>{table}</w:tbl></w:body></w:document>"})


def _workbook(rows: list[list[str]]) -> bytes:
    cell = lambda c, at: f'<c r="{at}" t="inlineStr"><is><t>{c}</t></is></c>'
    body = "".join(f'<row r="{n}">' + "".join(cell(c, f"{'ABCDEF'[j]}{n}") for j, c in enumerate(row)) + "</row>" for n, row in enumerate(rows, 1))
    book = f'<workbook {_SHEET}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>'
    return _zipped({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": _LINK, "xl/worksheets/sheet1.xml": f"<worksheet {_SHEET}><sheetData>{body}</sheetData></worksheet>"})


def file_of(doc_id: int, text: str | None, lang: str, source: str) -> tuple[str, bytes]:
    """A document as a file: its text, a table, a Word file, a workbook, or a file of no known kind."""
    rows = [["id", "lang", "source"], [str(doc_id), lang, source]]
    return [
        ("txt", (text or "").encode()),
        ("csv", "\n".join(map(",".join, rows)).encode()),
        ("docx", _word(f"Document {doc_id}", f"{lang} from {source}", rows)),
        ("xlsx", _workbook(rows)),
        ("bin", b"?"),
    ][doc_id % 5]


def written(docs: DataFrame) -> str:
    """The folder that now holds a file for each of the documents (doc_id, text, lang, source).

    Like every corpus folder it is a path that all executors see as files.
    """
    root = f"{shared_folder(docs.sparkSession).removeprefix('file://')}/docloom/corpus-{uuid.uuid4().hex}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(root, exist_ok=True)
        for frame in frames:
            for doc_id, text, lang, source in frame.itertuples(index=False):
                end, data = file_of(doc_id, text, lang, source)
                with open(f"{root}/{doc_id:09}.{end}", "wb") as file:
                    file.write(data)
            yield pd.DataFrame({"n": [len(frame)]})

    docs.select("doc_id", "text", "lang", "source").mapInPandas(run, "n long").count()
    return root
