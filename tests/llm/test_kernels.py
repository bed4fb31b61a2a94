import re

import numpy as np
import pyarrow as pa

from postloom.llm import kernels as K

TEXTS = ["", "one", "  Two\twords\x0b here ", "é ü ñ", "\x1f a\xa0b", "x" * 50 + " y"]


def _buffers(texts):
    data, offsets, _ = K.binary(pa.array(texts, pa.string()))
    return data, offsets


def test_words_are_what_the_pattern_finds():
    data, offsets = _buffers(TEXTS)
    starts, ends, first = K.words(data, offsets)
    for i, text in enumerate(TEXTS):
        own = [data[s:e].tobytes().decode() for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
        assert own == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_equal_words_have_equal_hashes_and_long_rows_are_the_same_in_pieces(monkeypatch):
    text = " ".join(f"Word{i % 97}" for i in range(3000))
    data, offsets = _buffers([text, "tail word"])
    whole, first = K.word_hashes(data, offsets, fold=True)
    monkeypatch.setattr(K, "SLICE_BYTES", 500)
    pieces, again = K.word_hashes(data, offsets, fold=True)
    assert (whole == pieces).all() and (first == again).all()
    assert len(set(whole[:3000].tolist())) == 97
    lower, _ = K.word_hashes(*_buffers([text.lower(), "tail word"]), fold=False)
    assert (whole == lower).all()


def test_code_points_and_folding():
    data, offsets = _buffers(["Éa", "", "ß Z"])
    cp, first = K.code_points(data, offsets)
    assert first.tolist() == [0, 2, 2, 5]
    assert "".join(map(chr, K.folded(cp))) == "éaß z"


def test_bitmaps_hold_what_was_set():
    hashes = K.mix(np.arange(100, dtype=np.uint64))
    bitmap = np.zeros(1 << 4, np.uint64)
    slot = hashes >> np.uint64(54)
    np.bitwise_or.at(bitmap, (slot >> np.uint64(6)).astype(int), np.uint64(1) << (slot & np.uint64(63)))
    assert K.in_bitmap(bitmap, hashes).all()
