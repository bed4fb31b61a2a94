"""Chunking of texts into token windows, by a mapping over Arrow batches: a document's chunks depend on one another, its
neighbours' do not, so that nothing is shuffled."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.sources.tables import small_batches

MAX_TOKENS, MIN_TOKENS, OVERLAP, SNAP = 1600, 25, 200, 100
QUOTED_LEAST = 0.5
#: Where a sentence and a paragraph end, and what starts a quoted part.
SENTENCE_END = re.compile(r"[.!?]+(?:\s+|$)|[。！？]+")
PARAGRAPH_END = re.compile(r"\n\s*\n")
QUOTED = re.compile(r"^(?:>.*|On .* wrote:|--\s*|-----Original Message-----|From: .*@.*|Sent: .*|To: .*@.*|Subject: .*)$", re.MULTILINE | re.IGNORECASE)
SCALES = [(50, 1.0), (150, 1.5), (500, 2.0)]
SCALE_BEYOND = 3.0


def token_count(text: Column) -> Column:
    """Characters over four, at least one; none for the empty text."""
    n = F.length(text)
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).otherwise(0)


def estimated_chunks(tokens: Column, size: int = MAX_TOKENS, overlap: int = OVERLAP) -> Column:
    step = max(1, size - overlap)
    return F.when(tokens <= 0, 0).when(tokens <= size, 1).otherwise(F.ceil((tokens - overlap) / step).cast("int"))


def scaled(tokens: int, size: int, overlap: int) -> tuple[int, int]:
    """Chunk size and overlap for a text of so many tokens: larger where it would make many chunks."""
    chunks = tokens / max(1, size - overlap)
    factor = next((f for most, f in SCALES if chunks <= most), SCALE_BEYOND)
    return int(size * factor), int(overlap * factor)


def scaled_sizes(tokens: Column, size: int, overlap: int) -> Column:
    """scaled() as an expression: a struct of size and overlap."""
    chunks = tokens / max(1, size - overlap)
    factor = F.lit(SCALE_BEYOND)
    for most, f in reversed(SCALES):
        factor = F.when(chunks <= most, f).otherwise(factor)
    return F.struct((factor * size).cast("int").alias("size"), (factor * overlap).cast("int").alias("overlap"))


def boundary(text: str, at: int, reach: int = SNAP) -> int:
    """The sentence or paragraph end nearest to a place, within reach; the place itself where there is none."""
    low, high = max(0, at - reach), min(len(text), at + reach)
    best, far = at, reach + 1
    for pattern in (SENTENCE_END, PARAGRAPH_END):
        for m in pattern.finditer(text, low, high):
            if abs(m.end() - at) < far:
                best, far = m.end(), abs(m.end() - at)
    return best


def windows(text: str, size: int = MAX_TOKENS, least: int = MIN_TOKENS, overlap: int = OVERLAP, per_token: int = 4) -> list[tuple[int, int]]:
    """(start, end) of a text's chunks in characters. Ends snap back to a boundary; a tail of too few tokens joins the
    chunk before it if that keeps to the size, and every chunk starts after the one before."""
    overlap = min(overlap, size // 2)
    n, step, out, at = len(text), size * per_token, [], 0
    while at < n:
        end = min(n, at + step)
        if end < n:
            snapped = boundary(text, end)
            if at < snapped <= end:
                end = snapped
        if out and end == n and (end - at) < least * per_token and end - out[-1][0] <= step:
            out[-1] = (out[-1][0], n)
            break
        out.append((at, end))
        if end == n:
            break
        at = max(end - overlap * per_token, at + 1)
    return out


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Quoted lines, separators and signatures; spans with only white space between are one, and take what follows."""
    out: list[list[int]] = []
    for m in QUOTED.finditer(text):
        if out and not text[out[-1][1] : m.start()].strip():
            out[-1][1] = max(out[-1][1], m.end())
        else:
            out.append([m.start(), m.end()])
    spans = []
    for s, e in out:
        while e < len(text) and text[e].isspace():
            e += 1
        spans.append((s, e))
    return spans


def chunk_kind(start: int, end: int, spans: list[tuple[int, int]], hint: str | None = None) -> str:
    """A given kind, or quoted_history where a quoted span covers enough of a chunk."""
    if hint:
        return hint
    share = max((max(0, min(e, end) - max(s, start)) / max(1, end - start) for s, e in spans), default=0.0)
    return "quoted_history" if share >= QUOTED_LEAST else "message_body"


def chunked(docs: DataFrame, id_col: str, text_col: str, size: int = MAX_TOKENS, least: int = MIN_TOKENS, overlap: int = OVERLAP, scale: bool = False) -> DataFrame:
    """Rows (id, position, char_start, char_end, kind, text) of the texts that are neither null nor blank."""
    rows = small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and trim(text) <> ''"))

    def cut(batches):
        for pdf in batches:
            out = []
            ids = pdf["id"].tolist() if pdf["id"].dtype != object else pdf["id"]
            for i, text in zip(ids, pdf["text"], strict=True):
                own = scaled(max(1, len(text) // 4), size, overlap) if scale else (size, overlap)
                spans = quoted_spans(text)
                out += [(i, k, s, e, chunk_kind(s, e, spans), text[s:e]) for k, (s, e) in enumerate(windows(text, own[0], least, own[1]))]
            yield pd.DataFrame(out, columns=["id", "position", "char_start", "char_end", "kind", "text"])

    return rows.mapInPandas(cut, f"id {rows.schema['id'].dataType.simpleString()}, position int, char_start int, char_end int, kind string, text string")


def token_starts(text: Column) -> Column:
    """Where each token of a text begins, and where the last one ends: its characters dealt evenly, the first tokens one
    more where they do not go up. The text is measured once, not for each token: within a lambda its length would be."""
    n, size = token_count(text), F.length(text)
    each, more = F.floor(size / F.greatest(n, F.lit(1))), size % F.greatest(n, F.lit(1))
    measured = F.array(F.struct(n.alias("n"), each.alias("each"), more.alias("more")))
    starts = lambda m: F.transform(F.sequence(F.lit(0), m["n"]), lambda i: (i * m["each"] + F.least(i, m["more"])).cast("int"))
    return F.get(F.transform(measured, starts), 0)


def chunked_sections(docs: DataFrame, id_col: str, sections_col: str, size: int = MAX_TOKENS, least: int = MIN_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Rows (id, section, section_path, position, char_start, char_end, kind, text) of documents with sections
    (array<struct<path, text>>): each is chunked by itself, and chunks never cross one."""
    one = docs.select(F.col(id_col).alias("doc"), F.posexplode(sections_col).alias("section", "s"))
    own = F.struct("doc", "section", F.col("s.path").alias("path"))
    out = chunked(one.select(own.alias("id"), F.col("s.text").alias("text")), "id", "text", size, least, overlap)
    return out.select(F.col("id.doc").alias("id"), "id.section", F.col("id.path").alias("section_path"), "position", "char_start", "char_end", "kind", "text")


def fixed_stride(docs: DataFrame, id_col: str, text_col: str, chars: int, stride: int) -> DataFrame:
    """The variant without boundaries, all native: rows (id, position, char_start, char_end, text)."""
    n = F.length(text_col)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride))
    out = docs.where(n > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("_t"), F.posexplode(starts).alias("position", "char_start"))
    return out.select("id", "position", "char_start", F.least(F.col("char_start") + chars, F.length("_t")).alias("char_end"), F.substring("_t", F.col("char_start") + 1, F.lit(chars)).alias("text"))


def oversized(chunks: DataFrame, tokens: int) -> DataFrame:
    """Chunks over a token limit: by their offsets first, then by a count."""
    near = chunks.where(F.col("char_end") - F.col("char_start") >= tokens * 4)
    return near.where(token_count(F.col("text")) > tokens)


def rechunked(chunks: DataFrame, flagged: Column, size: int, least: int = MIN_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """chunks (chunk_id, char_start, char_end, text) with the flagged ones cut anew, offsets counted in the whole text and
    rechunked_from naming the chunk that they come from."""
    old = chunks.where(~flagged).select("chunk_id", "char_start", "char_end", "text", F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("rechunked_from"))
    again = chunked(chunks.where(flagged), "chunk_id", "text", size, least, overlap)
    base = chunks.select(F.col("chunk_id").alias("id"), F.col("char_start").alias("shift"))
    new = again.join(base, "id").select(
        F.col("id").alias("chunk_id"), (F.col("char_start") + F.col("shift")).alias("char_start"), (F.col("char_end") + F.col("shift")).alias("char_end"), "text", F.col("id").alias("rechunked_from")
    )
    return old.unionByName(new)
