"""Personal data in texts: spans of e-mail addresses, IP addresses, card and phone numbers.

Base spans come from fixed patterns, leftmost and non-overlapping per kind; what fails a kind's test is dropped. A
character-level BiLSTM-CRF adds spans that are written in other ways ("ann (at) host (dot) org", "(414) 555-7134" without a
plus, 13-digit cards, addresses with spaced or bracketed dots). It is trained in numpy from labelled spans: contexts drawn
from a bounded sample of documents hold the base spans' labels, and half of the windows have a form of pii_forms written
into them, labelled where it is personal data and unlabelled where it is a date, a version, an amount and so on.

Reading: overlapping windows lie around every digit, @ sign and bracketed "at", as each kind has one. Where windows
overlap, a character's label is taken from the window in whose middle it stands; spans are then read from the whole
text's labels. A span that touches a base span, of which the model is not sure, or that fails its kind's test (an
address's form, octets up to 255, 13 to 19 digits passing Luhn, 10 to 15 digits) is dropped.

The sample: documents whose hash of doc_id and text falls under SAMPLE_DOCS / rows, and of their contexts MOST_CONTEXTS.
One task trains on it. A model learned from a corpus is one for its kind of text around the forms.

Edge cases: a null text is empty; texts of any length are read whole, in linear time. Rows that repeat are each reported.
A null doc_id is kept. With no text in the sample nothing is added. Extra columns are ignored (redact() keeps them);
an empty table gives an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import kernels as K
from postloom.llm.char_tagger import PAD, WINDOW, Tagger, classes
from postloom.llm.common import small_batches
from postloom.llm.pii_forms import Forms, plain_email, plain_ip

KINDS = ("email", "ip", "card", "phone")
STRIDE = WINDOW // 2
SAMPLE_DOCS = 20_000
MOST_CONTEXTS = 3000
CONTEXT = 2 * WINDOW
STEPS, BATCH, RATE = 600, 96, 0.015
SURE = 0.5  # least marginal probability of every label of an added span

#: The fixed patterns of the base spans. Anchored so that each is linear in the text: an address is found from its @
#: sign backwards, and a number starts at its first digit.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER = re.compile(r"[0-9](?:[\x20()./_-]*[0-9])+|\([0-9](?:[\x20()./_-]*[0-9])+")
_TRIGGER, _OPEN, _A, _T = (np.zeros(256, bool) for _ in range(4))
_TRIGGER[[*range(48, 58), 64]] = True
for _table, _signs in ((_OPEN, b"([{"), (_A, b"aA"), (_T, b"tT")):
    _table[list(_signs)] = True


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base spans by start, then kind as listed."""
    out, last = [], 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append(("email", start, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x) <= 255 for x in (y.lstrip("0") or "0" for y in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def label_of(kind: str, inside: bool) -> int:
    return 1 + 2 * KINDS.index(kind) + inside


def triggers(c: np.ndarray) -> np.ndarray:
    """Places of digits, @ signs and brackets before "at", in classes of characters or in bytes."""
    hit = _TRIGGER[c]
    if len(c) > 2:
        hit[:-2] |= _OPEN[c[:-2]] & _A[c[1:-1]] & _T[c[2:]]
    return np.flatnonzero(hit)


def window_starts(at: np.ndarray) -> np.ndarray:
    """Starts of the windows of a text in whose middle half a trigger stands; middles are laid end to end."""
    return np.unique((at + STRIDE // 2) // STRIDE) * STRIDE - STRIDE


def spans_of(labels: np.ndarray, sure: np.ndarray) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, least probability) of the runs of labels."""
    out = []
    for s in np.flatnonzero(labels):
        kind, inside = KINDS[(labels[s] - 1) // 2], (labels[s] - 1) % 2 == 1
        if inside and out and out[-1][2] == s and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1], int(s) + 1, min(out[-1][3], float(sure[s])))
        else:
            out.append((kind, int(s), int(s) + 1, float(sure[s])))
    return out


@dataclass
class Reader:
    """Finds the spans of texts by the patterns and, where there is one, the tagger."""

    tagger: Tagger | None

    def spans(self, texts: list[str]) -> list[tuple[list, list]]:
        """For each text its base spans and the added ones."""
        base = [base_spans(t) for t in texts]
        if self.tagger is None:
            return [(b, []) for b in base]
        coded = [classes(t) for t in texts]
        starts = [window_starts(triggers(c)) for c in coded]
        row = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        begin = np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64)
        labels = [np.zeros(len(c), np.int8) for c in coded]
        sure = [np.zeros(len(c), np.float32) for c in coded]
        for at in range(0, len(row), 512):
            x = np.full((len(row[at : at + 512]), WINDOW), PAD, np.int64)
            for k, (r, b) in enumerate(zip(row[at : at + 512].tolist(), begin[at : at + 512].tolist(), strict=True)):
                part = coded[r][max(0, b) : b + WINDOW]
                x[k, max(0, -b) : max(0, -b) + len(part)] = part
            path, p = self.tagger.decode(x)
            for k, (r, b) in enumerate(zip(row[at : at + 512].tolist(), begin[at : at + 512].tolist(), strict=True)):
                # a window's edges count where no other window has them in its middle
                low, high = max(0, b), min(len(coded[r]), b + WINDOW)
                middle = slice(max(0, b + STRIDE // 2), max(0, min(high, b + STRIDE // 2 + STRIDE)))
                open_ = sure[r][low:high] == 0
                open_[middle.start - low : middle.stop - low] = True
                labels[r][low:high][open_] = path[k, low - b : high - b][open_]
                sure[r][low:high][open_] = p[k, low - b : high - b][open_]
        return [(b, self._added(t, b, spans_of(la, su))) for t, b, la, su in zip(texts, base, labels, sure, strict=True)]

    @staticmethod
    def _added(text: str, base: list, found: list) -> list:
        out = []
        for kind, s, e, p in found:
            while e > s and text[e - 1] in " .,;-":
                e -= 1
            while s < e and (text[s] in " .,;-" or (text[s] == "(" and ")" not in text[s:e])):
                s += 1
            if p >= SURE and e > s and all(e <= x or s >= y for _, x, y in base) and passes(kind, text[s:e]) and whole(text, s, e):
                out.append((kind, s, e))
        return out


def passes(kind: str, part: str) -> bool:
    """Whether a span that the tagger marked is what its kind must be."""
    if kind == "email":
        return _EMAIL.fullmatch(plain_email(part)) is not None
    digits = "".join(c for c in part if c in "0123456789")
    if kind == "ip":
        octets = plain_ip(part).split(".")
        return len(octets) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in octets)
    if _NUMBER.fullmatch(part) is None:
        return False
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and len(part) > len(digits)


def whole(text: str, start: int, end: int) -> bool:
    """Whether a span does not begin or end inside a run of letters and digits."""
    cut = lambda a, b: a.isalnum() and b.isalnum()
    return not (start and cut(text[start - 1], text[start])) and not (end < len(text) and cut(text[end - 1], text[end]))


def _with_triggers(column: pa.Array) -> np.ndarray:
    """Which texts hold a trigger: no other text has a span."""
    data, offsets, _ = K.binary(column)
    out = np.zeros(len(column), bool)
    for i, j in K.row_slices(offsets):
        a, b = int(offsets[i]), min(int(offsets[j]) + 2, len(data))
        at = triggers(data[a:b]) + a
        out[np.searchsorted(offsets, at[at < offsets[j]], "right") - 1] = True
    return out


def _contexts(batches):
    """Contexts of CONTEXT characters around trigger runs and at some other places of texts, with the labels of base spans;
    a number of a card's shape has a card's label whether it passes Luhn or not, as that test comes after the tagger."""
    for batch in batches:
        rows = []
        for place, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = value.as_py()
            c, labels = classes(text), np.zeros(len(text), np.uint8)
            shaped = [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= sum(map(str.isdigit, m.group())) <= 19]
            for kind, s, e in shaped + base_spans(text):
                labels[s:e] = label_of(kind, True)
                labels[s] = label_of(kind, False)
            starts = window_starts(triggers(c)).tolist()[:64]
            spread = np.random.default_rng(place % (1 << 32)).integers(0, max(1, len(c) - CONTEXT // 2), 2) if len(c) else []
            for b in [b - (CONTEXT - WINDOW) // 2 for b in starts] + [int(b) for b in spread]:
                held = np.zeros((2, CONTEXT), np.uint8)
                low, high = max(0, b), min(len(c), b + CONTEXT)
                held[0, low - b : high - b], held[1, low - b : high - b] = c[low:high], labels[low:high]
                rows.append((place, b, held.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["place", "start", "held"])


def _drawn(contexts: np.ndarray, rng: np.random.Generator, forms: Forms):
    """A batch of windows cut from contexts; digits and letters are drawn anew in half of them, and half of them have a form
    written into them."""
    pick = contexts[rng.integers(0, len(contexts), BATCH)]
    shift = rng.integers(0, CONTEXT - WINDOW + 1, BATCH)
    at = shift[:, None] + np.arange(WINDOW)
    x, y = (np.take_along_axis(pick[:, k], at, 1).astype(np.int64) for k in (0, 1))
    anew = rng.random((BATCH, 1)) < 0.5
    digit, small = (x >= 48) & (x < 58), (x >= 97) & (x < 123)
    x = np.where(anew & digit, 48 + rng.integers(0, 10, x.shape), x)
    x = np.where(anew & small & (rng.random(x.shape) < 0.3), 97 + rng.integers(0, 26, x.shape), x)
    for k in np.flatnonzero(rng.random(BATCH) < 0.6).tolist():
        kind, text = forms.span() if rng.random() < 0.7 else (None, forms.other())
        text, s, e = forms.written(kind, text)
        c = classes(text).astype(np.int64)
        begin = int(rng.integers(-len(c) // 3, WINDOW - len(c) // 2))  # it may be cut by the window
        labels = np.zeros(len(c), np.int64)
        if kind:
            labels[s:e] = label_of(kind, True)
            labels[s] = label_of(kind, False)
        low, high = max(0, begin), min(WINDOW, begin + len(c))
        x[k, low:high], y[k, low:high] = c[low - begin : high - begin], labels[low - begin : high - begin]
        for edge in (low - 1, high):  # a word stands apart from the form; spans that it cuts are none any more
            if 0 <= edge < WINDOW:
                x[k, edge], y[k, edge] = 32, 0
        y[k, : max(0, low - 1)] = _uncut(y[k, : max(0, low - 1)], True)
        y[k, high + 1 :] = _uncut(y[k, high + 1 :], False)
    return x, y


def _uncut(labels: np.ndarray, at_end: bool) -> np.ndarray:
    """labels without the span that a form cut off at the end or the beginning."""
    out = labels.copy()
    if not len(out):
        return out
    if at_end:
        k = len(out) - 1
        while k >= 0 and out[k]:
            first = (out[k] - 1) % 2 == 0
            out[k] = 0
            k -= 1
            if first:
                break
    else:
        k = 0
        while k < len(out) and out[k] and (out[k] - 1) % 2 == 1:
            out[k] = 0
            k += 1
    return out


def train(docs: DataFrame) -> Tagger | None:
    """A tagger from a bounded sample of docs (doc_id, text), trained by one task."""
    small_batches(docs.sparkSession)
    part = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    texts = docs.select(F.xxhash64("doc_id", "text").alias("place"), F.col("text").cast("string").alias("text")).where("text <> ''")
    near = texts.where(F.pmod("place", F.lit(1 << 30)) < int(part * (1 << 30)))
    found = near.mapInArrow(_contexts, "place long, start long, held binary").distinct()
    sample = found.orderBy(F.xxhash64("place", "start"), "place", "start").limit(MOST_CONTEXTS)

    def fitted(batches):
        held = [h for batch in batches for h in batch.column(0).to_pylist()]
        if held:
            contexts = np.frombuffer(b"".join(held), np.uint8).reshape(-1, 2, CONTEXT)
            rng, forms, tagger = np.random.default_rng(3), Forms(4), Tagger(1 + 2 * len(KINDS))
            tagger.fit(lambda _: _drawn(contexts, rng, forms), STEPS, RATE)
            names = list(tagger.p)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([list(tagger.p[n].shape) for n in names], pa.list_(pa.int64())), pa.array([tagger.p[n].astype(np.float32).tobytes() for n in names])], ["name", "shape", "held"])

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("place", "start"), "place", "start")
    rows = ordered.select("held").mapInArrow(fitted, "name string, shape array<long>, held binary").toArrow().to_pylist()
    if not rows:
        return None
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.p = {r["name"]: np.frombuffer(r["held"], np.float32).reshape(r["shape"]) for r in rows}
    return tagger


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_spans(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base, spans (both as
    kind:start:end by start, then kind, joined by commas)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Reader(tagger))

    def found(batches):
        for batch in batches:
            n = len(batch)
            counts, base, spans = np.zeros((n, len(KINDS)), np.int64), [""] * n, [""] * n
            rows = np.flatnonzero(_with_triggers(batch.column(1))).tolist()
            for at in range(0, len(rows), 64):
                part = rows[at : at + 64]
                for r, (own, more) in zip(part, shared.value.spans([batch.column(1)[r].as_py() for r in part]), strict=True):
                    for kind, _, _ in own:
                        counts[r, KINDS.index(kind)] += 1
                    base[r] = written(own)
                    spans[r] = written(sorted(own + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(base), pa.array(spans)], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("string").alias("text"))
    return texts.mapInArrow(found, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, counts of base spans, base_sha256, spans."""
    return find_spans(docs, train(docs)).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, tagger: Tagger | None, text_col: str = "text") -> DataFrame:
    """docs, all rows and columns, with every span of text_col replaced by its kind in brackets."""
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(Reader(tagger)), docs.columns.index(text_col)

    def redacted(batches):
        for batch in batches:
            column = batch.column(at)
            rows = np.flatnonzero(_with_triggers(column)).tolist()
            changed = {}
            for first in range(0, len(rows), 64):
                part = rows[first : first + 64]
                texts = [column[r].as_py() for r in part]
                for r, text, (own, more) in zip(part, texts, shared.value.spans(texts), strict=True):
                    if own or more:
                        changed[r] = replaced(text, own + more)
            if changed:
                new = pa.array([changed[r] if r in changed else x.as_py() for r, x in enumerate(column)], column.type)
                batch = batch.set_column(at, batch.schema.field(at), new)
            yield batch

    return docs.mapInArrow(redacted, docs.schema)


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with the spans replaced; of spans that overlap, what the first leaves of the next goes with it."""
    out, last = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[last:s], f"[{kind.upper()}]"]
        last = max(last, e)
    return "".join([*out, text[last:]])
