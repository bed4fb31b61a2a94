"""N-gram Jaccard join: exact links between documents whose word-shingle sets overlap, by signature trees.

A document's set is its distinct 5-word shingles (A-Z lower-cased, words [^\\x20\\x09-\\x0D]+). Two documents link
when 100 * intersection >= 80 * union. The join returns one row per document with its component.

1. Documents of the same set are one class from then on, known by a number and by its smallest doc_id.
2. Routing. Two linked sets share one of the first n - ceil(0.8 n) + 1 entries of each in any order that is the same
   for all; the order here puts shingles that a sample shows to be common last. Classes that share no such entry with
   another need no further look.
3. Leaders. The smallest shingle of each sixteenth of the hash range (one-permutation min-hashes) draws near copies to
   a leader, the smallest of those that share it; classes that share at least LIKELY of them with a leader are compared
   with it. Found links join classes to groups, so that a large group of near copies needs one comparison each, not
   all pairs. What this step overlooks is left to the next.
4. Signature trees. Classes of different groups that share a routing entry go to a tree for that entry; its nodes
   hold the OR of their members' token bitmaps and their size range. A dual traversal drops node pairs whose largest
   possible overlap is too small; the pairs that are left are checked on the whole sets (64 bits a shingle), which only
   the classes of such pairs hand over. In a first pass each tree hands on a spanning forest of its likeliest pairs, which
   joins most of what belongs together by some pairs a member; in the last pass every pair of groups still apart is
   checked, handed on by the tree of the first entry that it shares. An entry with very many members is dealt out in blocks, and only those outside its largest group meet the
   others, so that what it costs follows the strays.
5. All links found, and the classes that a repeated doc_id has in common, give the components.

Edge cases: a null or empty text, or one without words, has an empty set and links with nothing; with one to four words
the whole sequence is the only shingle. Rows with a null doc_id get n_shingles and a null component, and link with
nothing. Rows with the same doc_id are one document: its texts are in one component, and each row has its own
n_shingles. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm import kernels as K
from postloom.llm.common import bitmap_of, bits_for, components, hashed_ids, id_hash, small_batches, stored, union

SHINGLE = 5
BINS = 16
LIKELY = 8
SIGNATURE_WORDS = 16  # 64-bit words of a token bitmap in a tree
WIDEST = 1 << 22  # bits of a large set's own bitmap at most
FANOUT = 8
BLOCK = 2048  # members of a tree; larger groups are dealt out in pairs of blocks
FRONTIER = 1 << 16  # node pairs of a traversal looked at together
SAMPLED = 16  # one in so many documents is looked at for common shingles
COMMON_SEEN = 8  # a shingle seen so often in the sample counts as common
COMMON_MAX = 1 << 18  # bound of the list of common shingles (2 MB)
LEADER_ROUNDS, LEADERS = 1, 4
LEADING = 8  # first routing entries of a set that go along into its trees
FOREST_ROUNDS = 1
FLUSH = 1 << 16  # tree rows looked at together

_BIN_STARTS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)

_FEATURES = "doc_id long, n long, d1 long, d2 long, mins array<long>, prefix array<long>, leading binary, bits binary, wide binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    hashes, first = K.word_hashes(data, offsets, fold=True)
    grams = K.ngrams(hashes, SHINGLE)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1])
        elif b > a:
            yield K.ngrams(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets, _ = K.binary(batch.column(1))
    for i, j in K.row_slices(offsets):
        base = offsets[i]
        yield from enumerate(shingle_sets(data[base : offsets[j]], offsets[i : j + 1] - base), i)


def _lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(v) for v in values]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64)))


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits by which equal sets are known, together with their size."""
    return int(s.sum()), int(np.bitwise_xor.reduce(K.mix(s, 2))) if len(s) else 0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Common shingles, most common last. They only order the sets, so that a sample does."""

    def sets(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_lists([s for _, s in _rows(batch)])], ["h"])

    rows = (
        texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
        .mapInArrow(sets, "h array<long>")
        .select(F.explode("h").alias("h"))
        .groupBy("h")
        .count()
        .where(F.col("count") >= COMMON_SEEN)
        .orderBy(F.desc("count"), "h")
        .limit(COMMON_MAX)
        .toArrow()
    )
    return rows["h"].to_numpy().astype(np.int64)[::-1].copy().view(np.uint64)


def _features(texts: DataFrame, common: np.ndarray) -> DataFrame:
    order = np.argsort(common, kind="stable")
    shared = texts.sparkSession.sparkContext.broadcast((common[order], order.astype(np.uint64)))

    def features(batches):
        common, rank = shared.value
        for batch in batches:
            n, d1, d2, mins, prefix, leading, bits, wide = [], [], [], [], [], [], [], []
            for _, s in _rows(batch):
                n.append(len(s))
                for held, d in zip((d1, d2), _digest(s), strict=True):
                    held.append(d)
                at = np.searchsorted(s, _BIN_STARTS)
                first = at[at < np.append(at[1:], len(s))]  # of the bins that hold any
                mins.append(s[first])
                key = K.mix(s, 1) >> np.uint64(1)
                if len(common) and len(s):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    hit = common[at] == s
                    key[hit] = np.uint64(1 << 63) + rank[at[hit]]
                keep = len(s) - (4 * len(s) + 4) // 5 + 1 if len(s) else 0
                at = np.argpartition(key, keep - 1)[:keep] if keep < len(s) else np.arange(len(s))
                prefix.append(s[at[np.lexsort((s[at], key[at]))]])
                leading.append(np.resize(prefix[-1], max(LEADING, len(prefix[-1])))[:LEADING].tobytes())  # a short set's repeat
                packed = np.zeros(min(WIDEST, max(SIGNATURE_WORDS * 64, 1 << (2 * len(s)).bit_length())), np.uint8)
                packed[(s & np.uint64(len(packed) - 1)).astype(np.int64)] = 1
                packed = np.packbits(packed)
                wide.append(packed.tobytes() if len(packed) > SIGNATURE_WORDS * 8 else b"")
                bits.append(np.bitwise_or.reduce(packed.reshape(-1, SIGNATURE_WORDS * 8)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), _longs(d1), _longs(d2), _lists(mins), _lists(prefix), pa.array(leading, pa.binary()), pa.array(bits, pa.binary()), pa.array(wide, pa.binary())],
                ["doc_id", "n", "d1", "d2", "mins", "prefix", "leading", "bits", "wide"],
            )

    return texts.mapInArrow(features, _FEATURES)


def _sets(texts: DataFrame, ids: DataFrame, number: int) -> DataFrame:
    """The whole sets (d1, d2, s) of the documents in ids (doc_id), so many of them, by another pass over the texts: a
    bitmap passes few others, which the join with pairs drops. s holds the sorted 64-bit hashes."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap_of(hashed_ids(ids), "h", bits_for(number)))

    def sets(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            keep = K.in_bitmap(shared.value, id_hash(np.asarray(batch.column(0).fill_null(0)))) & known
            d1, d2, held = [], [], []
            for _, s in _rows(batch.filter(pa.array(keep))):
                key = _digest(s)
                if len(s) and key not in seen:  # a class that repeats in a task is handed over once
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(key)
                    d1.append(key[0])
                    d2.append(key[1])
                    held.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([_longs(d1), _longs(d2), pa.array(held, pa.binary())], ["d1", "d2", "s"])

    out = texts.mapInArrow(sets, "d1 long, d2 long, s binary").groupBy("d1", "d2").agg(F.first("s").alias("s"))
    return out


def _wide_enough(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs without those of large sets whose own bitmaps, some two bits an entry, show that they cannot link."""
    wide = nodes.where("octet_length(wide) > 0").select("node", "n", "wide")
    one = pairs.join(wide.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa")), "a", "left")
    two = one.join(wide.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb")), "b", "left")

    def check(batches):
        for batch in batches:
            keep = np.ones(len(batch), bool)
            x, y = np.asarray(batch.column(2).fill_null(0)), np.asarray(batch.column(3).fill_null(0))
            for k in np.flatnonzero((x > 0) & (y > 0)).tolist():
                u, v = (np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in (4, 5))
                m = min(len(u), len(v))  # the wider one folds to the other's width
                u, v = (np.bitwise_or.reduce(w.reshape(-1, m)) for w in (u, v))
                keep[k] = may_link(x[k : k + 1], y[k : k + 1], u[None], v[None])[0]
            yield batch.select([0, 1]).filter(pa.array(keep))

    return two.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(check, "a long, b long")


_LINK = "a long, b long, first_a long, first_b long, group_a long, group_b long"


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link, with both ends' smallest doc_id and group; stored."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("first").alias(f"first_{k}"), F.col("comp").alias(f"group_{k}"), F.col("d1").alias(f"{k}1"), F.col("d2").alias(f"{k}2"))
    ends = stored(pairs.join(side("a"), "a").join(side("b"), "b"))
    ids = ends.select(F.explode(F.array("first_a", "first_b"))).distinct()
    number = ids.count()
    if not number:
        return ends.select(*(c.split()[0] for c in _LINK.split(", ")))
    sets = _sets(texts, ids, number)
    part = lambda k: sets.select(F.col("d1").alias(f"{k}1"), F.col("d2").alias(f"{k}2"), F.col("s").alias(f"s{k}"))

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(6), batch.column(7), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(9 * both >= 4 * (len(x) + len(y)))
            yield batch.select(list(range(6))).filter(pa.array(keep, pa.bool_()))

    joined = ends.join(part("b"), ["b1", "b2"]).join(part("a"), ["a1", "a2"])
    return stored(joined.select("a", "b", "first_a", "first_b", "group_a", "group_b", "sa", "sb").mapInArrow(check, _LINK))


def _merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with the groups that links join made one, known by the smallest of them."""
    if not links.take(1):
        return nodes
    found = components(links.select(F.col("group_a").alias("a"), F.col("group_b").alias("b")))
    named = nodes.join(found.withColumnRenamed("node", "comp"), "comp", "left")
    return stored(named.withColumn("comp", F.coalesce("component", "comp")).drop("component"))


def _leader_pairs(nodes: DataFrame) -> DataFrame:
    """Each class with the LEADERS leaders of other groups with which it shares the most minima, if they are likely to
    link. A class has BINS minima, so that its list is bounded."""
    minima = nodes.select("node", "comp", F.size("mins").alias("held"), F.explode("mins").alias("low"))
    leads = minima.groupBy("low").agg(F.min(F.struct("comp", "node")).alias("lead"), F.max("comp").alias("last")).where("lead.comp <> last")
    shared = minima.join(leads, "low").where("comp <> lead.comp").groupBy(F.col("node").alias("a"), F.col("lead.node").alias("b")).agg(F.count("*").alias("n"), F.max("held").alias("held"))
    likely = shared.where(F.col("n") * BINS >= F.col("held") * LIKELY)
    best = likely.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", (-F.col("b")).alias("b"))), asc=False), 1, LEADERS).alias("best"))
    return best.select("a", F.explode("best.b").alias("b")).select("a", (-F.col("b")).alias("b"))


def may_link(size_x: np.ndarray, size_y: np.ndarray, bits_x: np.ndarray, bits_y: np.ndarray) -> np.ndarray:
    """Whether pairs of sets of these sizes and token bitmaps can overlap enough: an entry whose bit the other set does
    not have is not shared."""
    common = bits_x & bits_y
    most = np.minimum(size_x - np.bitwise_count(bits_x ^ common).sum(1), size_y - np.bitwise_count(bits_y ^ common).sum(1))
    return 9 * most >= 4 * (size_x + size_y)


def _small_groups(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within each of the groups that fit one node: the tree of such a group is a root over its members."""
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for apart in range(1, FANOUT):
        some = count > apart
        n = count[some] - apart
        at = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        x.append(at)
        y.append(at + apart)
    return np.concatenate(x), np.concatenate(y)


def overlap(size_x: np.ndarray, size_y: np.ndarray, bits_x: np.ndarray, bits_y: np.ndarray) -> np.ndarray:
    """What may_link() takes for the overlap of pairs, as a part of their union."""
    common = bits_x & bits_y
    most = np.minimum(size_x - np.bitwise_count(bits_x ^ common).sum(1), size_y - np.bitwise_count(bits_y ^ common).sum(1))
    return most / np.maximum(1, size_x + size_y - most)


def forest(x: np.ndarray, y: np.ndarray, likely: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Places of pairs that join the groups (comp of members x and y) as all pairs do: a spanning forest of the likeliest
    (Boruvka's steps: each group takes its likeliest pair, the groups that these join become one)."""
    label = np.unique(comp, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(-likely, kind="stable")
    taken = np.zeros(len(x), bool)
    while True:
        u, v = label[x[order]], label[y[order]]
        order, u, v = order[u != v], u[u != v], v[u != v]
        if not len(order):
            return np.flatnonzero(taken)
        ends, first = np.unique(np.stack([u, v], 1).ravel(), return_index=True)  # the first place is the likeliest pair
        pick = np.unique(first // 2)
        taken[order[pick]] = True
        root = {int(e): int(e) for e in ends}

        def top(a, root=root):
            while root[a] != a:
                root[a] = a = root[root[a]]
            return a

        for a, b in zip(u[pick].tolist(), v[pick].tolist(), strict=True):
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
        table = np.arange(int(label.max()) + 1)
        for e in root:
            table[e] = top(e)
        label = table[label]


def roomy(size_x: np.ndarray, size_y: np.ndarray, room_x: np.ndarray, room_y: np.ndarray) -> np.ndarray:
    """Whether pairs of sets can overlap enough if they share none of the entries before one that they share. room: how
    many entries of a set are not before it."""
    return 9 * np.minimum(room_x, room_y) >= 4 * (size_x + size_y)


def first_met(x: np.ndarray, y: np.ndarray, leading: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index pairs (x, y) of members that share none of their leading entries before an entry, which has the place at
    in them."""
    keep = np.ones(len(x), bool)
    for k in range(0, len(x), FRONTIER):
        u, v = x[k : k + FRONTIER], y[k : k + FRONTIER]
        shared = (leading[u][:, :, None] == leading[v][:, None, :]).any(2)
        keep[k : k + FRONTIER] = ~(shared & (np.arange(leading.shape[1]) < at[u][:, None])).any(1)
    return x[keep], y[keep]


def tree_pairs(size: np.ndarray, bits: np.ndarray, comp: np.ndarray, side: np.ndarray, both_sides: bool, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of members that may link, by dual traversal of a signature tree over them. bits: their token bitmaps
    as rows of 64-bit words; with both_sides only pairs of different side count; pairs of one comp never do. With room only
    those that are roomy()."""
    room = size if room is None else room
    order = np.lexsort((size, side))
    size, bits, comp, side, room = size[order], bits[order], comp[order], side[order], room[order]
    spare = size - np.bitwise_count(bits).sum(1)  # entries beyond one a bit
    levels = [(bits, size, room, spare)]
    while len(levels[-1][0]) > 1:
        b, low, high, extra = levels[-1]
        cuts = np.arange(0, len(b), FANOUT)
        levels.append((np.bitwise_or.reduceat(b, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(extra, cuts)))
    top, grid = len(levels) - 1, np.arange(FANOUT)
    waiting, found = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))], []
    while waiting:
        depth, x, y = waiting.pop()
        if len(x) > FRONTIER:
            waiting += [(depth, x[k : k + FRONTIER], y[k : k + FRONTIER]) for k in range(0, len(x), FRONTIER)]
            continue
        b, low, high, extra = levels[depth]
        most = np.minimum(np.minimum(high[x], high[y]), np.bitwise_count(b[x] & b[y]).sum(1) + np.minimum(extra[x], extra[y]))
        may = 9 * most >= 4 * (low[x] + low[y])
        x, y = x[may], y[may]
        if depth:
            n = len(levels[depth - 1][0])
            x, y = np.broadcast_arrays(x[:, None, None] * FANOUT + grid[:, None], y[:, None, None] * FANOUT + grid)
            x, y = x.ravel(), y.ravel()
            ok = (x < n) & (y < n) & (x <= y)
            waiting.append((depth - 1, x[ok], y[ok]))
            continue
        ok = (x < y) & (comp[x] != comp[y])
        if both_sides:
            ok &= side[x] != side[y]
        x, y = x[ok], y[ok]
        may = may_link(size[x], size[y], bits[x], bits[y])
        found.append((order[x[may]], order[y[may]]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def _tree_candidates(entries: DataFrame, nodes: DataFrame, every: bool) -> DataFrame:
    """Pairs (a, b) of classes of different groups that share a routing entry and pass that entry's tree: every one, or for
    each tree a spanning forest of the likeliest, so that a large group of near copies gives some pairs a member. Every pair
    is handed on by the tree of the first entry that it shares, and by later ones only where they do not see that: the sets
    must be roomy() there, and share none of their leading entries before it."""
    known = entries.join(nodes.select("node", "comp"), "node")
    groups = known.groupBy("h", "comp").agg(F.count("*").alias("size"))
    held = groups.groupBy("h").agg(F.sum("size").alias("members"), F.max("size").alias("most"), F.max_by("comp", F.struct("size", "comp")).alias("main"))
    # a small group hands on few pairs as it is: it waits for the last pass
    member = known.join(held.where(F.col("members") > F.greatest("most", F.lit(0 if every else FANOUT))), "h")
    # strays (those outside the largest group) come in blocks 0, 1, ...; the largest group's members in those after
    large = F.col("members") > BLOCK
    strays = F.when(large, F.ceil((F.col("members") - F.col("most")) / BLOCK)).otherwise(1).cast("int")
    others = F.when(large, F.ceil(F.col("most") / BLOCK)).otherwise(0).cast("int")
    stray = ~large | (F.col("comp") != F.col("main"))
    deal = F.xxhash64("node")
    own = F.when(stray, F.pmod(deal, strays)).otherwise(strays + F.pmod(deal, F.greatest(others, F.lit(1)))).cast("int")
    met = F.when(stray, strays + others).otherwise(strays)  # blocks that a member's block is held against
    dealt = member.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    dealt = dealt.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", F.col("node"), "comp", "at")
    of = nodes.select("node", "n", "bits", "leading") if every else nodes.select("node", "n", "bits", F.lit(None).cast("binary").alias("leading"))
    dealt = dealt.join(of, "node").select("h", "i", "j", "own", F.col("node").alias("doc_id"), "comp", "n", "bits", "at", "leading")

    def trees(batches):
        kept: list[pa.RecordBatch] = []
        seen: set[tuple[int, int]] = set()

        def flush(table: pa.Table):
            ids, comp, size, side = (table[c].to_numpy() for c in ("doc_id", "comp", "n", "own"))
            bits = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(len(ids), -1)
            at, room, leading = table["at"].to_numpy().astype(np.int64), size, None
            if every:
                room = size - at
                leading = np.frombuffer(b"".join(table["leading"].to_pylist()), np.int64).reshape(len(ids), -1)
            key = np.stack([table["h"].to_numpy(), table["i"].to_numpy().astype(np.int64), table["j"].to_numpy().astype(np.int64)])
            cuts = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0), [True]]))
            first, count = cuts[:-1], np.diff(cuts)
            x, y = _small_groups(first[count <= FANOUT], count[count <= FANOUT])
            ok = (comp[x] != comp[y]) & ((key[1, x] == key[2, x]) | (side[x] != side[y]))
            x, y = x[ok], y[ok]
            if every:
                ok = roomy(size[x], size[y], room[x], room[y])
                x, y = x[ok], y[ok]
                x, y = first_met(x, y, leading, at)
            a, b = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
            order = np.lexsort((b, a))  # each pair once, however many entries it shares
            fresh = np.ones(len(order), bool)
            fresh[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
            x, y = x[order[fresh]], y[order[fresh]]
            may = may_link(size[x], size[y], bits[x], bits[y])
            pairs = set(zip(np.minimum(ids[x], ids[y])[may].tolist(), np.maximum(ids[x], ids[y])[may].tolist(), strict=True))
            for s, e in zip(first[count > FANOUT].tolist(), (first + count)[count > FANOUT].tolist(), strict=True):
                x, y = tree_pairs(size[s:e], bits[s:e], comp[s:e], side[s:e], bool(key[1, s] != key[2, s]), room[s:e])
                if every:
                    x, y = first_met(x, y, leading[s:e], at[s:e])
                if not every and len(x):
                    likely = np.concatenate([overlap(size[s + x[k]], size[s + y[k]], bits[s + x[k]], bits[s + y[k]]) for k in (slice(at, at + FRONTIER) for at in range(0, len(x), FRONTIER))])
                    kept = forest(x, y, likely, comp[s:e])
                    x, y = x[kept], y[kept]
                pairs.update((min(p), max(p)) for p in zip(ids[s + x].tolist(), ids[s + y].tolist(), strict=True))
            pairs -= seen
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(pairs)
            out = np.array(sorted(pairs), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

        rows = 0
        for batch in batches:
            # the last group of a batch may go on in the next one; groups have at most some 2 * BLOCK members
            kept.append(batch)
            rows += len(batch)
            if rows < FLUSH:
                continue
            table = pa.Table.from_batches(kept)
            key = [table[c].to_numpy() for c in ("h", "i", "j")]
            same = (key[0] == key[0][-1]) & (key[1] == key[1][-1]) & (key[2] == key[2][-1])
            cut = len(table) - int(same.sum())
            if cut:
                yield flush(table.slice(0, cut))
            kept = table.slice(cut).combine_chunks().to_batches()
            rows = len(table) - cut
        if rows:
            yield flush(pa.Table.from_batches(kept))

    return dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(trees, "a long, b long").distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id."""
    small_batches(docs.sparkSession)
    texts = _texts(docs)
    features = stored(_features(texts, common_shingles(texts)))
    linkable = features.where("n > 0 and doc_id is not null")
    classes = linkable.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("first"), F.first(F.struct("mins", "prefix", "leading", "bits", "wide")).alias("of"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "n", "first", "of.*"))
    entries = classes.select("node", F.posexplode("prefix").alias("at", "h"))
    live = entries.groupBy("h").agg(F.count("*").alias("members")).where("members > 1").select("h")
    entries = stored(entries.join(live, "h", "left_semi"))
    near = classes.join(entries.select("node").distinct(), "node", "left_semi")
    nodes = stored(near.select("node", F.col("node").alias("comp"), "d1", "d2", "n", "first", "mins", "leading", "bits", "wide"))
    links = []
    for _ in range(LEADER_ROUNDS):
        links.append(_verified(_leader_pairs(nodes), nodes, texts))
        nodes = _merged(nodes, links[-1])
    for _ in range(FOREST_ROUNDS):
        links.append(_verified(_wide_enough(_tree_candidates(entries, nodes, False), nodes), nodes, texts))
        nodes = _merged(nodes, links[-1])
    links.append(_verified(_wide_enough(_tree_candidates(entries, nodes, True), nodes), nodes, texts))
    # the classes of a doc_id that has several texts, one without words among them
    several = features.where("doc_id is not null").groupBy("doc_id").agg(F.min("d1").alias("a"), F.max("d1").alias("b"), F.min("d2").alias("c"), F.max("d2").alias("d")).where("a <> b or c <> d").select("doc_id")
    several = linkable.select("doc_id", "d1", "d2", "n").join(several, "doc_id", "left_semi").distinct().join(classes.select("d1", "d2", "n", "first"), ["d1", "d2", "n"])
    edges = union([x.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")) for x in links] + [several.select(F.col("doc_id").alias("a"), F.col("first").alias("b"))])
    found = components(edges)
    named = classes.select("d1", "d2", "n", "first").join(found.withColumnRenamed("node", "first"), "first", "left")
    named = named.select("d1", "d2", "n", F.coalesce("component", "first").alias("component_id"))
    out = ("doc_id", F.col("n").alias("n_shingles"))
    words = linkable.select("doc_id", "n", "d1", "d2").join(named, ["d1", "d2", "n"]).select(*out, "component_id")
    blank = features.where("n = 0 and doc_id is not null").select("doc_id", "n").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    unnamed = features.where("doc_id is null").select(*out, F.col("doc_id").alias("component_id"))
    return union([words, blank.select(*out, F.coalesce("component", "doc_id").alias("component_id")), unnamed])
