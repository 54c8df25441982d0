"""Word packages as block rows, and back, with the standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trestle.functions.text import base_name, report_id

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = (
    "report_id string, file_name string, extension string, block_pos long, source_id string, text string, kind string, table_index int, row_index int, "
    "page int, cells array<string>, error string"
)


ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[t]) for n, t in (c.split() for c in BLOCKS.split(", "))])
FILES = pa.schema([("file_name", pa.string()), ("content", pa.binary())])
#: Rows of a batch that Python holds as objects, and bytes of texts and files that it hands on together.
SLICE, PIECE = 16, 1 << 20


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE).to_pylist()


def _bounded(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded size; one row at least."""
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 100 + sum(len(x) for x in row if isinstance(x, str | bytes))
        if size > PIECE:
            yield made()
            held, size = [], 0
    if held:
        yield made()


#: Fill of a header cell.
SHADE = "E8EEF5"


def _text(node) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag == f"{W}tab":
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def _clean(text: str) -> str:
    """:func:`trestle.functions.text.normalize_text` where there is no column yet."""
    text = re.sub(r"[ \t\r\f\v]+", " ", text.replace("\xa0", " "))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _rows(table) -> Iterator[list[str]]:
    """Cells of each row; a cell that spans columns repeats, one that continues a merged cell shows the cell above."""
    above: list[str] = []
    for row in table.findall(f"{W}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{W}tc"):
            prop = cell.find(f"{W}tcPr")
            span = prop.find(f"{W}gridSpan") if prop is not None else None
            merge = prop.find(f"{W}vMerge") if prop is not None else None
            goes_on = merge is not None and merge.get(f"{W}val", "continue") == "continue"
            value = above[len(cells)] if goes_on and len(cells) < len(above) else _clean("\n".join(_text(p) for p in cell.findall(f"{W}p")))
            cells += [value] * int(span.get(f"{W}val", "1") if span is not None else 1)
        above = cells
        yield cells


def parse(data: bytes) -> list[tuple]:
    """(source_id, text, kind, table_index, row_index, cells) in document order; counters also count what is empty."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{W}body")
    out, n_par, n_tab = [], 0, 0
    for item in body:
        if item.tag == f"{W}p":
            text = _clean(_text(item))
            if text:
                out.append((f"paragraph:{n_par}", text, "paragraph", None, None, None))
            n_par += 1
        elif item.tag == f"{W}tbl":
            for k, cells in enumerate(_rows(item)):
                if any(cells):
                    out.append((f"table:{n_tab}:{k}", " | ".join(cells), "table", n_tab, k, cells))
            n_tab += 1
    return out


def blocks(files: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Blocks of Word files (``path``, ``content``). A file that can't be read is one row with its ``error``; with
    ``fail_fast`` it ends the job."""

    def rows_of(rid, name, ext, data):
        try:
            if ext != ".docx":
                raise ValueError("no converter for this format" if ext == ".doc" else f"unsupported format {ext or 'none'}")
            return [(rid, name, ext, k, s, t, kind, ti, ri, None, cells, None) for k, (s, t, kind, ti, ri, cells) in enumerate(parse(bytes(data)))]
        except Exception as e:
            if fail_fast:
                raise ValueError(f"{name}: {type(e).__name__}: {e}") from e
            return [(rid, name, ext, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]

    def each(batches):
        for given in _slices(batches):
            yield from _bounded((row for x in given for row in rows_of(x["report_id"], x["file_name"], x["ext"], x["content"])), ARROW)

    ext = F.regexp_extract(F.lower(base_name(F.col("path"))), r"(\.[^.]*)$", 1)
    named = files.select(report_id(F.col("content")).alias("report_id"), base_name(F.col("path")).alias("file_name"), ext.alias("ext"), "content")
    return named.mapInArrow(each, BLOCKS)


def _paragraph(text: str, style: str = "", centre: bool = False) -> str:
    placed = '<w:pPr><w:jc w:val="center"/></w:pPr>' if centre else ""
    return f'<w:p>{placed}<w:r>{style and f"<w:rPr>{style}</w:rPr>"}<w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def _table(rows: list[list[str]], widths: list[float] | None) -> str:
    """A table; with ``widths`` (inches) it has a grid, a shaded bold first row, and cells aligned."""
    if widths is None:
        return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    edges = "".join(f'<w:{e} w:val="single" w:sz="4" w:space="0" w:color="auto"/>' for e in ("top", "left", "bottom", "right", "insideH", "insideV"))
    inches = [round(1440 * w) for w in widths]
    out = [f'<w:tbl><w:tblPr><w:tblBorders>{edges}</w:tblBorders><w:tblLayout w:type="fixed"/></w:tblPr><w:tblGrid>' + "".join(f'<w:gridCol w:w="{w}"/>' for w in inches) + "</w:tblGrid>"]
    for k, row in enumerate(rows):
        look = f'<w:shd w:val="clear" w:fill="{SHADE}"/><w:vAlign w:val="center"/>' if k == 0 else '<w:vAlign w:val="top"/>'
        out.append("<w:tr>" + "".join(f'<w:tc><w:tcPr><w:tcW w:w="{w}" w:type="dxa"/>{look}</w:tcPr>{_paragraph(c, "<w:b/>" if k == 0 else "")}</w:tc>' for c, w in zip(row, inches, strict=True)) + "</w:tr>")
    return "".join(out) + "</w:tbl>"


def document(items: list) -> bytes:
    """A Word package: strings are paragraphs, lists of rows are plain tables, a pair (rows, widths) is a styled table,
    and {"title": text} a centred bold heading."""

    def part(i) -> str:
        if isinstance(i, dict):
            return _paragraph(i["title"], '<w:b/><w:sz w:val="32"/>', centre=True)
        return _paragraph(i) if isinstance(i, str) else _table(*i) if isinstance(i, tuple) else _table(i, None)

    body = "".join(map(part, items))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def render(reports: DataFrame) -> DataFrame:
    """``file_name``, ``content``: a Word file per report from its ``title`` and tables (arrays of arrays of strings)."""

    def each(batches):
        for given in _slices(batches):
            yield from _bounded(((row["file_name"], document(_items(row))) for row in given), FILES)

    return reports.mapInArrow(each, "file_name string, content binary")


def _items(row: dict) -> list:
    tables = (row.get(name) for name in ("summary", "recommendations", "diseases"))
    return [row["title"], *[[[c or "" for c in r] for r in t] for t in tables if t is not None]]
