"""Office formats: what was put in comes out, broken files fall through, and the folders' data source."""

import os
import struct
import time

from postloom.plans import catalog
from postloom.sources import folders, formats, listing, office


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors: streams from 4096 bytes in sectors, shorter ones in the short stream."""
    size, short, end, free = 512, 64, 0xFFFFFFFE, 0xFFFFFFFF
    sectors, follow, packed, short_follow, rows = [], [], b"", [], []

    def put(data):
        start = len(sectors)
        parts = [data[i : i + size].ljust(size, b"\0") for i in range(0, len(data), size)]
        for k, p in enumerate(parts):
            sectors.append(p)
            follow.append(start + k + 1 if k + 1 < len(parts) else end)
        return start if parts else end

    for name, data in streams.items():
        if len(data) >= 4096:
            rows.append((name, 2, put(data), len(data)))
        else:
            start = len(packed) // short if data else end
            n = -(-len(data) // short)
            short_follow += [start + k + 1 if k + 1 < n else end for k in range(n)]
            packed += data.ljust(n * short, b"\0")
            rows.append((name, 2, start, len(data)))
    root = put(packed)
    table = put(struct.pack(f"<{len(short_follow)}I", *short_follow).ljust(-(-len(short_follow) * 4 // size) * size, b"\xff"))

    def row(name, kind, start, length, right=free, child=free):
        text = name.encode("utf-16-le") + b"\0\0"
        return text.ljust(64, b"\0") + struct.pack("<HBBIII", len(text), kind, 1, free, right, child) + bytes(36) + struct.pack("<IQ", start, length)

    entries = row("Root Entry", 5, root, len(packed), child=1 if rows else free)
    entries += b"".join(row(*r, right=k + 2 if k + 1 < len(rows) else free) for k, r in enumerate(rows))
    first = put(entries.ljust(-(-len(entries) // size) * size, b"\0"))
    n = 1
    while n * 128 < len(sectors) + n:
        n += 1
    fat = [*follow, *[0xFFFFFFFD] * n]
    fat += [free] * (n * 128 - len(fat))
    heads = list(range(len(sectors), len(sectors) + n)) + [free] * (109 - n)
    header = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6)
    header += struct.pack("<9I", 0, n, first, 0, 4096, table if short_follow else end, 1, end, 0)
    return header + struct.pack("<109I", *heads) + b"".join(sectors) + struct.pack(f"<{n * 128}I", *fat)


def message(**values) -> bytes:
    tags = formats._TAGS
    streams = {f"__substg1.0_{tags[k]:04X}{'0102' if isinstance(v, bytes) else '001F'}": v if isinstance(v, bytes) else v.encode("utf-16-le") for k, v in values.items()}
    streams["__properties_version1.0"] = bytes(32) + struct.pack("<IIQ", formats._SENT, 6, 133_497_504_000_000_000)
    return compound(streams)


def test_word_powerpoint_excel_rtf():
    assert formats.docx(office.docx_bytes(["Héllo <&>", " ", "two\u00a0"], [["a", ""], ["b\u2028", "c"]])) == "Héllo <&>\ntwo\u00a0\na\nb\u2028\nc"
    slides = [[f"slide {k}\nline", "  "] for k in range(12)] + [["last"]]
    assert formats.pptx(office.pptx_bytes(slides)) == "\n".join([f"slide {k}\nline" for k in range(12)] + ["last"])
    wide = [["h"] + [""] * 27 + ["AC"], ["1", 'q"x', "", "a,b"]]
    assert formats.xlsx(office.xlsx_bytes({"One & two": wide, "Empty": []})) == "[Sheet: One & two]\n" + ",".join(["h", *[f"Unnamed: {i}" for i in range(1, 28)], "AC"]) + '\n1,"q""x",,"a,b"' + "," * 25 + "\n\n[Sheet: Empty]\n"
    text = "plain \\ {braces}\nüber 漢字 😀 end"
    assert formats.rtf(office.rtf_bytes(text)) == text
    odd = rb"{\rtf1\ansi\ansicpg1251{\fonttbl{\f0 X;}}{\*\generator Y;}{\info{\title no}}\uc2\u1046 ab\'c6\'e8 x\tab y\line\b z\~{\pict 00ff}{\b w}\emdash}"
    assert formats.rtf(odd) == "Ж" + "Жи x\ty\nz\u00a0w—"


def test_messages_by_sector_chains():
    body = "line\r\n" * 3000
    text = formats.msg(message(**{"from": "Ann", "address": "ann@x.org", "to": "Bob", "subject": "Grüße", "body": body}))
    assert text == "From: Ann <ann@x.org>\nTo: Bob\nSubject: Grüße\nDate: 2024-01-15T00:00:00+00:00\n\n" + body
    assert formats.msg(message(to="x", html=b"<p>Hi<style>q</style> <b>you</b>")).endswith("\n\nHi you")
    files = formats.CompoundFile(compound({"a": b"", "b": b"x" * 63, "c": b"y" * 4096, "d": b"z" * 200_000})).streams
    assert {k: len(v) for k, v in files.items()} == {"a": 0, "b": 63, "c": 4096, "d": 200_000} and files["d"] == b"z" * 200_000


def test_order_of_readers_and_segments_once():
    calls = []

    def reader(name, text):
        def read(_):
            calls.append(name)
            if text is None:
                raise ValueError
            return text

        return read

    got = formats.texts(b"", [(reader("a", None), False), (reader("b", "one\x01 "), False), (reader("c", "never"), False), (reader("d", " one"), True), (reader("e", "two"), True)])
    assert got == "one\n\ntwo" and calls == ["a", "b", "d", "e"]
    assert formats.texts(b"junk", formats.READERS["docx"]) is None and formats.texts(b"", formats.READERS["msg"]) is None
    cut = office.docx_bytes(["x" * 1000])
    assert all(formats.texts(cut[:n], formats.READERS["docx"]) is None for n in range(0, len(cut) - 30, 37))
    m = message(body="b" * 9000)
    for n in range(0, len(m), 211):
        formats.texts(m[:n], formats.READERS["msg"])
    assert formats.texts(office.rtf_bytes("named doc"), formats.READERS["doc"]) == "named doc"


def test_extracted_by_spark(spark):
    rows = [("a.docx", office.docx_bytes(["one", "two"])), ("b.RTF", office.rtf_bytes("three")), ("c.docx", b"broken"), ("d.bin", b"x"), ("e.txt", b"four"), ("f.msg", message(body="five"))]
    got = {r["name"]: r["text"] for r in folders.extracted_text(spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "name string, content binary")).collect()}
    assert got["a.docx"] == "one\ntwo" and got["b.RTF"] == "three" and got["c.docx"] is None and got["d.bin"] is None and got["e.txt"] == "four" and got["f.msg"].endswith("five")


def _put(path, age):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(path.name)
    when = time.time() - age
    os.utime(path, (when, when))


def test_folder_source_as_batch_and_stream(spark, tmp_path):
    listing.register(spark)
    root = tmp_path / "in"
    for k in range(7):
        _put(root / f"f{k}" / "Conversation.txt", 100 - k)
        _put(root / f"f{k}" / "attachments" / "x.txt", 100 - k)
    batch = spark.read.format("mail_folders").option("prefixes", 2).load(str(root))
    assert batch.rdd.getNumPartitions() == 4
    assert sorted((r["folder"], r["inner"]) for r in batch.collect()) == sorted((f"f{k}", n) for k in range(7) for n in ("Conversation.txt", "attachments/x.txt"))
    seen = []

    def run():
        stream = spark.readStream.format("mail_folders").option("lag", 30).load(str(root))
        stream.select("folder", "inner").writeStream.foreachBatch(lambda df, _: seen.extend((r["folder"], r["inner"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start().awaitTermination()

    _put(root / "f8" / "new.txt", 1)  # within the lag: its time is not over yet
    run()
    assert len(seen) == len(set(seen)) == 14
    late = root / "f9" / "late.txt"
    _put(late, 10)  # shows up ten seconds after its time
    for p in (late, root / "f8" / "new.txt"):
        when = p.stat().st_mtime
        os.utime(p, (when, when))
    run()
    assert len(seen) == 14
    time.sleep(31)
    run()
    assert sorted(seen[14:]) == [("f8", "new.txt"), ("f9", "late.txt")]
    run()
    assert len(seen) == 16


def test_queries_are_registered():
    assert {"s15_office_texts", "s01_listed_files"} <= set(catalog.QUERIES)
