"""Substring dedup: removes word passages that an earlier document already has, by an FM-index for each shard.

A window is 13 consecutive words ([^\\x20\\x09-\\x0D]+, unchanged) of one document. Every word is removed that is covered
by a window whose word sequence also starts in a document with a smaller doc_id; windows are judged on the input.

1. Anchors. The smallest 5-gram hash of a window depends on its words alone, so that equal windows have equal anchors.
   Runs of windows with one anchor make a segment. Anchors of one document only need no further look; a bitmap of
   fixed size passes the others (and few more) in the second pass over the texts.
2. Segments go to shards of whole anchors, of bounded size, once. There equal ones are counted once, with the smallest
   doc_id that has them, and those of anchors of one document are left out.
3. Each shard gets a compressed FM-index. The segments are streamed through it:
   backward search over its wavelet tree finds each window's interval, and the interval's smallest doc_id follows.
   Segments of anchors with more than a shard holds are counted once before, by an aggregate, and cut at each change of a
   second anchor (the smallest 5-gram hash of a window that is not the first), and the pieces go to shards by both. Pieces that share both and are still
   more than a shard holds (windows that repeat few words) are counted by window, by an aggregate, which is exact too.
4. The intervals are joined back to the segments' places, and the words they cover are removed.

Edge cases: a null text has no words; a document under 13 words loses none. Rows with a null doc_id lose none and take
none from others. Rows with the same doc_id do not remove each other's words. Extra columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import kernels as K
from postloom.llm.common import bitmap_of, id_hash, small_batches, stored
from postloom.llm.fm_index import FmIndex

WINDOW = 13
GRAM = 5
SHARD = 16384  # segments of a shard, about: some 0.3 million words, whose index takes some 100 MB in a task
RUN = 32  # windows of a segment at most
BITMAP = 27


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("body"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )


def _spread(grams: np.ndarray) -> np.ndarray:
    """Anchors of smallest hashes: these lie low, and would share the low bits of a bitmap by its top bits."""
    return K.mix(grams, 9)


def window_anchors(hashes: np.ndarray, without: np.ndarray | None = None) -> np.ndarray:
    """The anchor of every window that starts at each word but the last 12 (also of windows across rows). without: for each
    word an anchor (as _spread() gives it) whose gram does not count where it begins there."""
    grams = K.mix(K.ngrams(hashes, GRAM), 5)
    if without is not None:
        grams[_spread(grams) == without[: len(grams)]] = np.iinfo(np.uint64).max
    low, width = grams, 1
    span = WINDOW - GRAM + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def _segments(data: np.ndarray, offsets: np.ndarray):
    """Anchors, rows, first words and window counts of the segments of rows; also the words' byte ranges."""
    starts, ends, first = K.words(data, offsets)
    none = np.zeros(0, np.int64)
    if len(starts) < WINDOW:
        return np.zeros(0, np.uint64), none, none, none, starts, ends
    anchors = window_anchors(K.span_hashes(data, starts, ends))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    inside = row[: len(anchors)] == row[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    a, r = anchors[at], row[at]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    if len(size) and size.max() > RUN:  # long runs of one anchor are cut
        pieces = -(-size // RUN)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, size = np.repeat(begin, pieces) + nth * RUN, np.minimum(np.repeat(size, pieces) - nth * RUN, RUN)
    return _spread(a[begin]), r[begin], at[begin], size, starts, ends


def _pieces(batch: pa.RecordBatch, column: int):
    """The batch's texts as pieces of bounded size: first row, bytes, offsets, and the words before the piece (a text
    of more than a piece goes on in pieces that overlap by a window less one word)."""
    data, offsets, _ = K.binary(batch.column(column))
    for i, j in K.row_slices(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 4 * K.SLICE_BYTES:
            yield i, data[a:b], offsets[i : j + 1] - a, 0
            continue
        done, carry = 0, a
        while carry < b:
            c = min(carry + 2 * K.SLICE_BYTES, b)
            while True:
                part = data[carry:c]
                starts, ends, _ = K.words(part, np.array([0, len(part)]))
                if c == b or len(starts) > 2 * WINDOW:
                    break
                c = min(b, c + 2 * K.SLICE_BYTES)
            if c == b:
                yield i, part, np.array([0, len(part)]), done
                break
            keep = len(starts) - 1  # the last word may go on after the piece
            part = part[: ends[keep - 1]]
            yield i, part, np.array([0, len(part)]), done
            done += keep - WINDOW + 1
            carry += int(starts[keep - WINDOW + 1])


def _anchors(texts: DataFrame) -> DataFrame:
    """Distinct anchors of each document, with its doc_id."""

    def anchors(batches):
        for batch in batches:
            for i, data, offsets, _ in _pieces(batch, 2):
                a, r, *_ = _segments(data, offsets)
                order = np.lexsort((a, r))
                a, r = a[order], r[order]
                keep = np.ones(len(a), bool)
                keep[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), batch.column(0).take(pa.array(r[keep] + i))], ["anchor", "doc_id"])

    return texts.where("doc_id is not null").mapInArrow(anchors, "anchor long, doc_id long")


def _occurrences(texts: DataFrame, bitmap) -> DataFrame:
    """The segments whose anchor is in the bitmap: anchor, doc_id, body, first word, windows, words."""

    def occurrences(batches):
        for batch in batches:
            for i, data, offsets, done in _pieces(batch, 2):
                a, r, first, size, starts, ends = _segments(data, offsets)
                keep = K.in_bitmap(bitmap.value, a)
                a, r, first, size = a[keep], r[keep], first[keep], size[keep]
                rows = pa.array(r + i)
                begin, end = starts[first] if len(first) else first, ends[first + size + WINDOW - 2] if len(first) else first
                words = [data[s:e].tobytes() for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
                # the place among the words of the row
                before = np.searchsorted(starts, offsets)[r] if len(r) else r
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first - before + done), pa.array(words, pa.binary())],
                    ["anchor", "doc_id", "body", "start", "words"],
                )

    return texts.where("doc_id is not null").mapInArrow(occurrences, "anchor long, doc_id long, body long, start long, words binary")


def shard_minima(words: list[bytes], doc_ids: np.ndarray) -> list[np.ndarray]:
    """For each segment its windows' smallest doc_id over all segments of the shard, by FM-index."""
    if not words:
        return []
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    hashes, first = K.word_hashes(np.frombuffer(b"".join(words), np.uint8), offsets, fold=False)
    counts = np.diff(first)
    _, ranks = np.unique(hashes, return_inverse=True)
    ends = np.cumsum(counts + 1)  # place of each segment's separator
    text = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = ranks + 1
    index = FmIndex(text)
    windows = counts - WINDOW + 1
    segment = np.repeat(np.arange(len(words)), windows)
    nth = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = (ends - 1 - counts)[segment] + nth
    low, high = index.windows(text, begin + WINDOW, WINDOW)
    best = doc_ids[segment].copy()
    many = high - low > 1
    lows, back = np.unique(low[many], return_inverse=True)
    if len(lows):
        highs = np.empty(len(lows), np.int64)
        highs[back] = high[many]
        owner = np.repeat(np.arange(len(words)), counts + 1)
        docs = doc_ids[owner[index.order]]
        bounds = np.stack([lows, highs], 1).ravel()
        least = np.minimum.reduceat(np.append(docs, np.iinfo(np.int64).max), bounds)[::2]
        best[many] = np.minimum(best[many], least[back])
    return np.split(best, np.cumsum(windows)[:-1])


def _second_pieces(segments: DataFrame) -> DataFrame:
    """The segments (anchor, part, words, first) cut where the second anchor of their windows changes: rows (anchor,
    second, part, at, words, first), at being the number of windows before the piece."""

    def cut(batches):
        for batch in batches:
            data, offsets, _ = K.binary(batch.column(2))
            for i, j in K.row_slices(offsets):
                own = offsets[i : j + 1] - offsets[i]
                text = data[offsets[i] : offsets[j]]
                starts, ends, first = K.words(text, own)
                if len(starts) < WINDOW:
                    continue
                row = np.repeat(np.arange(j - i), np.diff(first))
                anchor = np.asarray(batch.column(0))[i:j].view(np.uint64)
                second = window_anchors(K.span_hashes(text, starts, ends), anchor[row])
                at = np.flatnonzero(row[: len(second)] == row[WINDOW - 1 :])
                new = np.ones(len(at), bool)
                new[1:] = (second[at][1:] != second[at][:-1]) | (row[at][1:] != row[at][:-1])
                begin = np.flatnonzero(new)
                size = np.diff(np.append(begin, len(at)))
                place = at[begin]
                rows = pa.array(row[place] + i)
                words = [text[s:e].tobytes() for s, e in zip(starts[place].tolist(), ends[place + size + WINDOW - 2].tolist(), strict=True)]
                columns = [batch.column(0).take(rows), pa.array(second[place].view(np.int64)), batch.column(1).take(rows), pa.array(place - first[row[place]]), pa.array(words, pa.binary()), batch.column(3).take(rows)]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "second", "part", "at", "words", "first"])

    return segments.select("anchor", "part", "words", "first").mapInArrow(cut, "anchor long, second long, part long, at long, words binary, first long")


def _once(places: pd.DataFrame) -> pd.DataFrame:
    """Each segment (anchor, part) once, with its first and last doc_id, of those anchors that several documents have."""
    several = places.groupby("anchor")["first"].agg(["min", "max"]).query("min < max").index
    one = places[places["anchor"].isin(several)].groupby(["anchor", "part"], sort=False)
    return one.agg(words=("words", "first"), last=("first", "max"), first=("first", "min")).reset_index()


def _by_shards(segments: DataFrame, keys: list[str], count: int, of_places: bool = False) -> DataFrame:
    """Rows (keys, part, minima) for distinct segments (keys, part, words, first), each group of keys in one shard. count:
    how many segments there are. of_places: the segments repeat, first is a document of each, and those of which no document
    may lose a word have no row."""
    shards = max(1, -(-count // SHARD))
    names = [*keys, "part", "minima"]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        if of_places:
            pdf = _once(pdf)
        found = shard_minima(pdf["words"].tolist(), pdf["first"].to_numpy())
        out = pd.DataFrame({**{k: pdf[k] for k in keys}, "part": pdf["part"], "minima": pd.Series(found, index=pdf.index, dtype=object)})
        if of_places:
            out = out[[m.min() < last for m, last in zip(found, pdf["last"], strict=True)]] if len(out) else out
        return out[names]

    schema = ", ".join(f"{k} long" for k in keys) + ", part long, minima array<long>"
    return segments.select(*keys, "part", "words", "first").withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards))).groupBy("shard").applyInPandas(search, schema)


def _hot_minima(segments: DataFrame) -> DataFrame:
    """_minima() of segments whose anchors have more than a shard holds."""
    pieces = stored(_second_pieces(segments).withColumn("piece", F.xxhash64("words")))
    once = stored(pieces.groupBy("anchor", "second", "piece").agg(F.min("first").alias("first"), F.first("words").alias("words")))
    large = stored(once.groupBy("anchor", "second").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).select("anchor", "second"))
    none = large.isEmpty()
    fits = once if none else once.join(large, ["anchor", "second"], "left_anti")
    found = _by_shards(fits.withColumnRenamed("piece", "part"), ["anchor", "second"], fits.count())
    met = pieces.select("anchor", "second", "part", "at", "piece").join(found.withColumnRenamed("part", "piece"), ["anchor", "second", "piece"]).select("anchor", "part", "at", "minima")
    return met if none else met.unionByName(_by_window(pieces.join(large, ["anchor", "second"], "left_semi")))


def _by_window(pieces: DataFrame) -> DataFrame:
    """Rows (anchor, part, at, minima), a window each, of pieces (anchor, part, at, words, first) by an aggregate."""

    def windows(batches):
        for batch in batches:
            at, rows, texts = [], [], []
            for i, (words, base) in enumerate(zip(batch.column(3), batch.column(2).to_pylist(), strict=True)):
                data = np.frombuffer(words.as_py(), np.uint8)
                starts, ends, _ = K.words(data, np.array([0, len(data)]))
                for j in range(len(starts) - WINDOW + 1):
                    at.append(base + j)
                    rows.append(i)
                    texts.append(b" ".join(data[starts[k] : ends[k]].tobytes() for k in range(j, j + WINDOW)))
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int64()), pa.array(texts, pa.binary()), batch.column(4).take(rows)], ["anchor", "part", "at", "window", "first"])

    each = pieces.select("anchor", "part", "at", "words", "first").mapInArrow(windows, "anchor long, part long, at long, window binary, first long")
    least = each.groupBy("window").agg(F.min("first").alias("least"))
    return each.join(least, "window").select("anchor", "part", "at", F.array("least").alias("minima"))


def _minima(places: DataFrame) -> DataFrame:
    """Rows (anchor, part, at, minima) for the segments of places (anchor, part, words, doc_id) that have windows to remove."""
    segments = places.select("anchor", "part", "words", F.col("doc_id").alias("first"))
    hot = stored(places.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > SHARD))
    n, repeats = hot.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = F.broadcast(hot.select("anchor"))  # at most one for each SHARD rows of places
    usual = segments.join(few, "anchor", "left_anti") if n else segments
    found = _by_shards(usual, ["anchor"], places.count() - repeats, of_places=True).select("anchor", "part", F.lit(0).cast("long").alias("at"), "minima")
    if not n:
        return found
    distinct = segments.join(few, "anchor", "left_semi").groupBy("anchor", "part").agg(F.min("first").alias("first"), F.first("words").alias("words"))
    return found.unionByName(_hot_minima(stored(distinct)))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept (the words left, joined by one space)."""
    small_batches(docs.sparkSession)
    texts = _texts(docs)
    sc = docs.sparkSession.sparkContext
    shared = _anchors(texts).groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    bitmap = sc.broadcast(bitmap_of(shared, "anchor", BITMAP))
    places = stored(_occurrences(texts, bitmap).withColumn("part", F.xxhash64("words")))
    minima = stored(_minima(places))
    hits = (
        places.select("anchor", "part", "doc_id", "body", "start")
        .join(minima, ["anchor", "part"])
        .select("doc_id", "body", F.expr("transform(filter(sequence(0, size(minima) - 1), i -> minima[i] < doc_id), i -> start + at + i)").alias("gone"))
        .where("size(gone) > 0")
    )
    gone = stored(hits.groupBy("doc_id", "body").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(id_hash(np.asarray(batch.column(0))).view(np.int64))], ["h"])

    touched = sc.broadcast(bitmap_of(gone.select("doc_id").distinct().mapInArrow(hashed, "h long"), "h", BITMAP))

    def split(want: bool):
        def part(batches):
            for batch in batches:
                known = np.asarray(batch.column(0).is_valid())
                hit = K.in_bitmap(touched.value, id_hash(np.asarray(batch.column(0).fill_null(0)))) & known
                yield batch.filter(pa.array(hit == want))

        return part

    def cut(batches):
        for batch in batches:
            n, removed, kept = [], [], []
            gone = batch.column(3) if batch.num_columns > 3 else None
            for i, text in enumerate(batch.column(2)):
                data = text.as_py()
                words = data.translate(_SPACES).split(b" ") if data else []
                words = [w for w in words if w]
                windows = gone[i].values if gone is not None and gone[i].is_valid else None
                if windows is not None and len(windows):
                    at = windows.to_numpy()
                    cover = np.zeros(len(words) + 1, np.int64)
                    cover[at] += 1
                    np.subtract.at(cover, np.minimum(at + WINDOW, len(words)), 1)
                    left = np.flatnonzero(cover[:-1].cumsum() == 0)
                    removed.append(len(words) - len(left))
                    kept.append(b" ".join(words[k] for k in left.tolist()))
                else:
                    removed.append(0)
                    kept.append(b" ".join(words))
                n.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    schema, out = "doc_id long, body long, text binary", "doc_id long, n_words long, n_removed long, kept binary"
    whole = texts.mapInArrow(split(False), schema).mapInArrow(cut, out)
    changed = texts.mapInArrow(split(True), schema).join(gone, ["doc_id", "body"], "left").select("doc_id", "body", "text", "gone").mapInArrow(cut, out)
    return whole.unionByName(changed).withColumn("kept", F.col("kept").cast("string"))


_SPACES = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def digest(removed: DataFrame) -> DataFrame:
    """The result of remove_repeats() with the kept text's digest in its place."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
