"""Texts of office files, read in tasks with the standard library: Word, PowerPoint and Excel by their ZIP parts and XML, RTF by
its control words, Outlook messages by the sectors of their compound file. Every reader takes bytes and gives text; what it
cannot read raises, and texts() turns that into the next reader's turn."""

from __future__ import annotations

import csv
import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from xml.etree import ElementTree as ET

PART_MOST = 1 << 29  # bytes that a part of a ZIP file may unpack to

# ---- fixed values: XML names, RTF words and the property tags of messages, as their formats have them ----
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_RTF_SKIPPED = "fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr listtable listoverridetable revtbl rsidtbl generator themedata colorschememapping latentstyles datastore xmlnstbl".split()
_RTF_TEXT = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "|", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}
_TAGS = {"from": 0x0C1A, "address": 0x5D01, "to": 0x0E04, "cc": 0x0E03, "bcc": 0x0E02, "subject": 0x0037, "body": 0x1000, "html": 0x1013}
_SENT = 0x00390040
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
# ---- end of fixed values ----


def _part(z: zipfile.ZipFile, name: str):
    if z.getinfo(name).file_size > PART_MOST:
        raise ValueError(f"{name} is too large")
    return z.open(name)


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """The parts that a part names, by relation id."""
    folder, _, name = part.rpartition("/")
    root = ET.parse(_part(z, f"{folder}/_rels/{name}.rels")).getroot()
    return {r.get("Id"): r.get("Target").lstrip("/") if r.get("Target").startswith("/") else f"{folder}/{r.get('Target')}" for r in root}


def _paragraph(p: ET.Element, ns: str) -> str:
    out = []
    for x in p.iter():
        if x.tag == f"{ns}t":
            out.append(x.text or "")
        elif x.tag == f"{ns}tab" and ns == _W:
            out.append("\t")
        elif x.tag in (f"{ns}br", f"{ns}cr"):
            out.append("\n")
    return "".join(out)


def docx(content: bytes) -> str:
    """Paragraphs of the body, then the cells of its tables; blank ones are left out. The body is streamed."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        paragraphs, cells, depth = [], [], []
        with _part(z, "word/document.xml") as f:
            for event, x in ET.iterparse(f, ("start", "end")):
                if event == "start":
                    depth.append(x.tag)
                    continue
                depth.pop()
                if x.tag == f"{_W}p" and depth[-1:] == [f"{_W}body"]:
                    paragraphs.append(_paragraph(x, _W))
                    x.clear()
                elif x.tag == f"{_W}tc" and f"{_W}tc" not in depth:
                    cells.append("\n".join(_paragraph(p, _W) for p in x.iterfind(f"{_W}p")))
                    x.clear()
    return "\n".join(t for t in [*paragraphs, *cells] if t.strip())


def pptx(content: bytes) -> str:
    """The shapes' texts, slide by slide in the show's order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = _relations(z, "ppt/presentation.xml")
        slides = ET.parse(_part(z, "ppt/presentation.xml")).getroot().iterfind(f"{_P}sldIdLst/{_P}sldId")
        out = []
        for slide in [names[s.get(f"{_R}id")] for s in slides]:
            for shape in ET.parse(_part(z, slide)).getroot().iterfind(f"{_P}cSld/{_P}spTree/{_P}sp"):
                out.append("\n".join(_paragraph(p, _A) for p in shape.iterfind(f"{_P}txBody/{_A}p")))
    return "\n".join(t.strip() for t in out if t.strip())


def xlsx(content: bytes) -> str:
    """Each sheet whole as CSV under its name. The first row names the columns; a name that is missing is told by its number."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, shared = _relations(z, "xl/workbook.xml"), []
        if "xl/sharedStrings.xml" in z.namelist():
            with _part(z, "xl/sharedStrings.xml") as f:
                for _, x in ET.iterparse(f):
                    if x.tag == f"{_S}si":
                        shared.append("".join(t.text or "" for t in x.iter(f"{_S}t")))
                        x.clear()
        out = []
        for sheet in ET.parse(_part(z, "xl/workbook.xml")).getroot().iterfind(f"{_S}sheets/{_S}sheet"):
            text, rows = io.StringIO(), list(_sheet_rows(z, names[sheet.get(f"{_R}id")], shared))
            width = max(map(len, rows), default=0)
            writer = csv.writer(text, lineterminator="\n")
            for k, row in enumerate(rows):
                row = row + [""] * (width - len(row))
                writer.writerow([v or f"Unnamed: {i}" for i, v in enumerate(row)] if k == 0 else row)
            out.append(f"[Sheet: {sheet.get('name')}]\n{text.getvalue()}")
    return "\n".join(out)


def _sheet_rows(z: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[list[str]]:
    with _part(z, part) as f:
        for _, x in ET.iterparse(f):
            if x.tag != f"{_S}row":
                continue
            row: list[str] = []
            for c in x.iterfind(f"{_S}c"):
                letters = re.match("[A-Z]*", c.get("r", ""))[0]
                at = 0
                for letter in letters:
                    at = at * 26 + ord(letter) - 64
                row += [""] * (at - 1 - len(row))
                value, kind = c.findtext(f"{_S}v"), c.get("t")
                if kind == "s":
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                elif kind == "b":
                    value = "True" if value == "1" else "False"
                row.append(value or "")
            yield row
            x.clear()


_RTF_TOKEN = re.compile(r"\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def rtf(content: bytes) -> str:
    """The text of RTF: groups nest, some control words are text, and destinations that are not text are skipped."""
    source = content.decode("latin-1")
    if not source.startswith("{\\rtf"):
        raise ValueError("no RTF")
    page = (re.search(r"\\ansicpg(\d+)", source) or ["", "1252"])[1]
    out: list[str] = []
    held: list[tuple[bool, int]] = []
    skipped, width, pending, starred, raw = False, 1, 0, False, bytearray()

    def flush() -> None:
        if raw:
            out.append(bytes(raw).decode(f"cp{page}", "replace"))
            raw.clear()

    for m in _RTF_TOKEN.finditer(source):
        word, number, byte, symbol, brace, text = m.groups()
        if byte is not None:
            if pending:
                pending -= 1
            elif not skipped:
                raw.append(int(byte, 16))
            continue
        flush()
        if brace == "{":
            held.append((skipped, width))
        elif brace == "}":
            skipped, width = held.pop() if held else (False, 1)
            pending = 0
        elif symbol is not None:
            starred = symbol == "*"
            if starred:
                skipped = True
            elif not skipped:
                out.append({"~": "\u00a0", "_": "-", "-": "", "\n": "\n", "\r": "\n"}.get(symbol, symbol))
        elif word is not None:
            if word in _RTF_SKIPPED:
                skipped = True
            elif word == "uc":
                width = int(number or 1)
            elif word == "u" and number:
                if not skipped:
                    out.append(chr(int(number) % 65536))
                pending = width
            elif word in _RTF_TEXT and not skipped:
                out.append(_RTF_TEXT[word])
        elif text and not skipped:
            out.append(text[pending:])
            pending = max(0, pending - len(text))
    flush()
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class CompoundFile:
    """The streams of a compound file by path: chains of sectors, short streams in a chain of their own."""

    def __init__(self, content: bytes):
        if content[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
            raise ValueError("no compound file")
        self.content, self.size, self.short = content, 1 << struct.unpack_from("<H", content, 30)[0], 1 << struct.unpack_from("<H", content, 32)[0]
        first_dir, cutoff, first_short = struct.unpack_from("<I", content, 48)[0], *struct.unpack_from("<II", content, 56)
        extra = struct.unpack_from("<I", content, 68)[0]
        tables = [s for s in struct.unpack_from("<109I", content, 76) if s < 0xFFFFFFFA]
        seen: set[int] = set()
        while extra < 0xFFFFFFFA and extra not in seen:
            seen.add(extra)
            block = struct.unpack(f"<{self.size // 4}I", self._sector(extra))
            tables += [s for s in block[:-1] if s < 0xFFFFFFFA]
            extra = block[-1]
        self.next = [n for s in tables for n in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        entries = self._chain(first_dir)
        rows = [entries[i : i + 128] for i in range(0, len(entries) - 127, 128)]
        root_start, root_size = struct.unpack_from("<I", rows[0], 116)[0], struct.unpack_from("<Q", rows[0], 120)[0]
        packed = self._chain(root_start)[:root_size]
        table = self._chain(first_short) if first_short < 0xFFFFFFFA else b""
        follow = struct.unpack(f"<{len(table) // 4}I", table)
        self.streams: dict[str, bytes] = {}
        todo, met = [(struct.unpack_from("<I", rows[0], 76)[0], "")], set()
        while todo:
            at, path = todo.pop()
            if at >= len(rows) or at in met:
                continue
            met.add(at)
            row = rows[at]
            name = row[: max(0, struct.unpack_from("<H", row, 64)[0] - 2)].decode("utf-16-le", "replace")
            left, right, child = struct.unpack_from("<III", row, 68)
            todo += [(left, path), (right, path)]
            if row[66] == 1:
                todo.append((child, f"{path}{name}/"))
            elif row[66] == 2:
                start, size = struct.unpack_from("<I", row, 116)[0], struct.unpack_from("<Q", row, 120)[0]
                if size >= cutoff:
                    data = self._chain(start)
                else:
                    data = b"".join(packed[s * self.short : (s + 1) * self.short] for s in self._follow(start, follow))
                self.streams[path + name] = data[:size]

    def _sector(self, n: int) -> bytes:
        return self.content[(n + 1) * self.size : (n + 2) * self.size].ljust(self.size, b"\0")

    @staticmethod
    def _follow(start: int, table) -> Iterator[int]:
        met: set[int] = set()
        while start < len(table) and start not in met:
            met.add(start)
            yield start
            start = table[start]

    def _chain(self, start: int) -> bytes:
        return b"".join(self._sector(s) for s in self._follow(start, self.next))


def msg(content: bytes) -> str:
    """Headers and body of an Outlook message; HTML is taken before plain text."""
    found = CompoundFile(content).streams

    def value(name: str) -> str:
        stem = f"__substg1.0_{_TAGS[name]:04X}"
        if f"{stem}001F" in found:
            return found[f"{stem}001F"].decode("utf-16-le", "replace").rstrip("\0")
        return found.get(f"{stem}001E", found.get(f"{stem}0102", b"")).decode("utf-8", "replace").rstrip("\0")

    sender, address = value("from"), value("address")
    heads = {"From": f"{sender} <{address}>" if sender and address else sender or address, **{k.capitalize(): value(k) for k in ("to", "cc", "bcc", "subject")}}
    fixed = found.get("__properties_version1.0", b"")
    for at in range(32, len(fixed) - 15, 16):
        if struct.unpack_from("<I", fixed, at)[0] == _SENT:
            ticks = struct.unpack_from("<Q", fixed, at + 8)[0]
            heads["Date"] = (datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=ticks // 10)).isoformat()
    body = plain_html(value("html")) or value("body")
    return "\n".join([*(f"{k}: {v}" for k, v in heads.items() if v), "", body])


def plain_html(text: str) -> str:
    """As functions.text.html_to_text, for texts inside tasks."""
    text = re.sub(r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ", text)
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text)).strip()


def eml(content: bytes) -> str | None:
    from email import policy
    from email.parser import BytesParser

    body = BytesParser(policy=policy.default).parsebytes(content).get_body(("plain", "html"))
    return body.get_content() if body is not None else None


Reader = Callable[[bytes], str | None]
#: Readers by suffix, in their order; one marked True runs even where one before it has found text.
READERS: dict[str, list[tuple[Reader, bool]]] = {
    "eml": [(eml, False)],
    "msg": [(msg, False)],
    "docx": [(docx, True)],
    "pptx": [(pptx, True)],
    "xlsx": [(xlsx, True)],
    "rtf": [(rtf, True)],
    "doc": [(rtf, False), (docx, False)],  # by what they are, whatever they are called
    "xls": [(xlsx, False)],
}


def texts(content: bytes, readers: list[tuple[Reader, bool]]) -> str | None:
    """The texts that the readers find, without control characters and each once, two line ends between them; null where
    none finds any. A reader that fails finds none."""
    segments: dict[str, None] = {}
    for reader, always in readers:
        if segments and not always:
            continue
        try:
            text = reader(content)
        except Exception:  # noqa: BLE001  a broken file may fail in any way; the next reader has its turn
            continue
        text = _CONTROL.sub("", text or "").strip()
        if text:
            segments.setdefault(text)
    return "\n\n".join(segments) or None
