"""Small writers of office files, for exports and for what is read back: Word, PowerPoint, Excel and RTF as bytes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from xml.sax.saxutils import escape, quoteattr

from postloom.sources import formats

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _space(name: str) -> str:
    return getattr(formats, name).strip("{}")


def _zipped(parts: dict[str, str], main: str, kind: str) -> bytes:
    types = "".join(f'<Override PartName="/{n}" ContentType="application/xml"/>' for n in parts if not n.endswith(".rels"))
    every = {
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>',
        "_rels/.rels": _relations([(f"{_OFFICE}/{kind}", main)]),
        **parts,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in every.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), _HEAD + text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _relations(targets: Sequence[tuple[str, str]]) -> str:
    rows = "".join(f'<Relationship Id="rId{k}" Type="{t}" Target="{n}"/>' for k, (t, n) in enumerate(targets, 1))
    return f'<Relationships xmlns="{_PACKAGE}/relationships">{rows}</Relationships>'


def _runs(text: str, ns: str) -> str:
    return f'<{ns}:r><{ns}:t xml:space="preserve">{escape(text)}</{ns}:t></{ns}:r>' if ns == "w" else f"<a:r><a:t>{escape(text)}</a:t></a:r>"


def docx_bytes(paragraphs: Sequence[str], table: Sequence[Sequence[str]] = ()) -> bytes:
    p = lambda t: f"<w:p>{_runs(t, 'w')}</w:p>"
    rows = "".join(f"<w:tr>{''.join(f'<w:tc>{p(c)}</w:tc>' for c in row)}</w:tr>" for row in table)
    body = "".join(map(p, paragraphs)) + (f"<w:tbl>{rows}</w:tbl>" if table else "")
    return _zipped({"word/document.xml": f'<w:document xmlns:w="{_space("_W")}"><w:body>{body}</w:body></w:document>'}, "word/document.xml", "officeDocument")


def pptx_bytes(slides: Sequence[Sequence[str]]) -> bytes:
    """Slides of shapes; the lines of a shape's text are its paragraphs."""
    spaces = f'xmlns:p="{_space("_P")}" xmlns:a="{_space("_A")}" xmlns:r="{_OFFICE}"'
    shape = lambda t: f"<p:sp><p:txBody>{''.join(f'<a:p>{_runs(line, chr(97))}</a:p>' for line in t.split(chr(10)))}</p:txBody></p:sp>"
    parts = {f"ppt/slides/slide{k}.xml": f"<p:sld {spaces}><p:cSld><p:spTree>{''.join(map(shape, s))}</p:spTree></p:cSld></p:sld>" for k, s in enumerate(slides, 1)}
    ids = "".join(f'<p:sldId id="{255 + k}" r:id="rId{k}"/>' for k in range(1, len(slides) + 1))
    parts |= {"ppt/presentation.xml": f"<p:presentation {spaces}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": _relations([(f"{_OFFICE}/slide", f"slides/slide{k}.xml") for k in range(1, len(slides) + 1)])}
    return _zipped(parts, "ppt/presentation.xml", "officeDocument")


def xlsx_bytes(sheets: dict[str, Sequence[Sequence[str]]]) -> bytes:
    """Sheets of rows of texts, which are shared strings; empty cells are left out."""
    strings: dict[str, int] = {}
    parts = {}
    for k, rows in enumerate(sheets.values(), 1):
        cells = "".join(f'<row r="{i}">' + "".join(f'<c r="{_letters(j)}{i}" t="s"><v>{strings.setdefault(v, len(strings))}</v></c>' for j, v in enumerate(row) if v) + "</row>" for i, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{_space("_S")}"><sheetData>{cells}</sheetData></worksheet>'
    named = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_space("_S")}" xmlns:r="{_OFFICE}"><sheets>{named}</sheets></workbook>'
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{_space("_S")}">' + "".join(f'<si><t xml:space="preserve">{escape(t)}</t></si>' for t in strings) + "</sst>"
    parts["xl/_rels/workbook.xml.rels"] = _relations([(f"{_OFFICE}/worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1)])
    return _zipped(parts, "xl/workbook.xml", "officeDocument")


def _letters(column: int) -> str:
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def rtf_bytes(text: str) -> bytes:
    out = []
    for c in text:
        if c in "\\{}":
            out.append(f"\\{c}")
        elif c == "\n":
            out.append("\\par\n")
        elif ord(c) < 128:
            out.append(c)
        else:
            units = c.encode("utf-16-le")
            out += [f"\\u{int.from_bytes(units[i : i + 2], 'little', signed=True)}?" for i in range(0, len(units), 2)]
    return ("{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0 Serif;}}\\f0 " + "".join(out) + "}").encode("ascii")
