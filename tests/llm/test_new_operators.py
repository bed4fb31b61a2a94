"""Phrases, spelling variants and mixing against brute force, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import mixing, phrases, spelling, suffix_counts

from .helpers import SCHEMA, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PIECE = re.compile("[.,;:!?\n-\r]")


# ---- suffix arrays ----


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_common_prefixes(seed):
    r = np.random.default_rng(seed)
    ids = r.integers(0, 3, 200)
    tails = [tuple(ids[i:]) for i in range(200)]
    assert suffix_counts.suffix_array(ids).tolist() == sorted(range(200), key=lambda i: tails[i])
    for depth in (1, 2, 3, 4, 7):
        order = suffix_counts.suffix_array(ids, depth).tolist()
        heads = [tails[i][:depth] for i in order]
        assert heads == sorted(heads)
        shared = suffix_counts.common_prefixes(ids, np.array(order), depth)
        for k in range(1, 200):
            a, b = heads[k - 1], heads[k]
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert shared[k] == n


# ---- phrases ----


def _words(text):
    return [[w for w in re.split("[ \t]+", p) if w] for p in PIECE.split((text or "").translate(LOWER))]


def _collocations(rows, least, keep, inside):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in _words(text):
            total[lang or "und"] += len(piece)
            for n in range(1, 5):
                for i in range(len(piece) - n + 1):
                    counts[lang or "und"][tuple(piece[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        outer = Counter()
        for p, a in frequent.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    outer[p[i : i + n]] = max(outer[p[i : i + n]], a)
        best = []
        for p, a in frequent.items():
            score, _, left, rest = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * outer[p] < inside * a:
                best.append((-score, -a, " ".join(p).encode(), left, rest))
        for rank, (score, a, p, left, rest) in enumerate(sorted(best)[:keep], 1):
            out.append((lang, rank, p.decode(), -a, left, rest, total[lang], -score))
    return sorted(out)


def _phrase_docs():
    r = random.Random(3)
    vocabulary = ["the", "Of", "and", "New", "york", "city", "über", "a", "x y"] + [f"w{i}" for i in range(30)]
    rows = []
    for k in range(60):
        parts = r.choices(vocabulary, weights=[9, 8, 7, 6, 6, 5, 3, 4, 2] + [1] * 30, k=r.randint(0, 80))
        rows.append((r.choice(["en", "de", None, "und"]), "".join(w + r.choice([" ", " ", "  ", "\t", ", ", ". ", "\n"]) for w in parts)))
    return rows + [("en", None), ("en", ""), (None, "..."), ("en", "the " * 400), *[("de", "new york city of the and")] * 25]


@pytest.mark.parametrize("shard", [1 << 24, 700, 60])
def test_collocations_equal_brute_force(spark, shard):
    rows = _phrase_docs()
    docs = spark.createDataFrame([(i, lang, t, 5, "c", 1.0) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, n long, phrase string, score double").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=5, keep=40, shard_bytes=shard).collect())
    assert got == _collocations(rows, 5, 40, 80)
    assert len(got) > 40


def test_collocations_of_nothing(spark):
    assert phrases.collocations(documents(spark, [None, "", "one two"])).collect() == []
    empty = phrases.collocations(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and empty.collect() == []


# ---- spelling ----


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(rows, every):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    v = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [x for x in v if x != w and _near(w, x)] for w in v}
    form = {w: b for w in v if near[w] for b in [min(near[w], key=lambda x: (-v[x], x))] if v[b] >= 5 * v[w]}
    out = []
    for w in v:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, v[w], len(near[w]), v[form[w]] if w in form else None))
    return sorted(out)


def test_variants_equal_brute_force(spark):
    r = random.Random(8)
    stems = ["receive", "Separate", "définition", "aaaaaaa", "abababab", "straße×x", "connect"]
    forms = {}
    for s in stems:
        for k in range(12):
            w, i = s, r.randrange(len(s))
            for _ in range(k % 3):
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("aeé") + w[i:], w[:i] + r.choice("stx") + w[i + 1 :]])
            forms[w] = r.choice([5, 6, 7, 30, 200])
    tokens = [w for w, n in forms.items() for _ in range(n)]
    r.shuffle(tokens)
    rows = [(i, " ".join(tokens[i * 40 : i * 40 + 40]) + r.choice([" 7", "\n", "—"])) for i in range(len(tokens) // 40 + 1)]
    rows += [(None, "separate " * 9), (3, "connect"), (3, "connect"), (4, None), (5, ""), (6, "12 --")] + [(9, "y" * 200)] * 6 + [(11, "y" * 201)] * 40
    docs = spark.createDataFrame([(i, t, "q", 3, "f") for i, t in rows], "doc_id long, text string, word string, n int, form string").repartition(3)
    got = sorted((tuple(x) for x in spelling.variants(docs).collect()), key=lambda x: x[0])
    assert got == _variants(rows, 199)
    assert sum(x[1] is not None for x in got) > 5 and any(x[1] and x[2] != x[1] for x in got)


def test_deletions_and_long_texts(spark, monkeypatch):
    rows = [(i, ("Abcdefgh ijklmnop " * 30) + "é" * 70) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _variants(rows, 3)
    counts = {r["word"]: r["n"] for r in spelling.vocabulary(docs, every=3).collect()}
    assert counts == {w[0]: w[3] for w in want} and len(counts) > 10
    long = " ".join(["abcdefgh"] * 400_000)
    assert [tuple(r) for r in spelling.vocabulary(spark.createDataFrame([(2, long), (2, None)], "doc_id long, text string")).collect()] == [("abcdefgh", 400_000)]


def test_variants_of_nothing(spark):
    assert spelling.variants(documents(spark, [None, "", "short words"])).collect() == []
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).columns == ["word", "form", "root", "n", "n_near", "form_n"]


# ---- mixing ----


def _levels(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        goal = {s: Fraction(left * weight[s], sum(weight[x] for x in free)) for s in free} | {s: Fraction(most * sizes[s]) for s in capped}
        above = {s for s in free if goal[s] > most * sizes[s]}
        if not above:
            return goal
        capped |= above


def test_mix_meets_its_targets(spark):
    r = random.Random(5)
    rows, sizes = [], Counter()
    for i in range(3000):
        source = r.choices(["a", "b", "c", "é", "Z", "tiny", "blank", None], weights=[40, 9, 9, 9, 9, 1, 1, 9])[0]
        n = 0 if source == "blank" else r.choice([0, 1, 3, 8, 20, 60])
        rows.append((r.choice([None, i, i, i, 7]), source, r.choice([" ", "\n", "  "])[:1] + " \t".join(["wörd"] * n) if n else r.choice([None, "", " \n"])))
    docs = spark.createDataFrame([(*x, 1, 2.0, "x") for x in rows], "doc_id long, source string, text string, size int, target double, rows string")
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    for _, source, text in rows:
        sizes[source] += count(text)
    goal = _levels(dict(sizes))
    got = mixing.mixed(docs.repartition(7)).collect()
    assert Counter((x["doc_id"], x["size"]) for x in got) == Counter((i, count(t)) for i, _, t in rows)
    by_size = {v: k for k, v in sizes.items()}
    assert len(by_size) == len(sizes)
    taken = Counter()
    for x in got:
        source = by_size[x["source_size"]]
        assert x["target"] == pytest.approx(float(goal[source]))
        assert 0 <= x["taken"] <= 3 * x["size"] and (x["size"] == 0 or x["taken"] % x["size"] == 0)
        taken[source] += x["taken"]
    assert all(abs(taken[s] - goal[s]) <= 60 for s in sizes)  # one document of the largest size
    again = mixing.mixed(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_of_repeated_rows_and_of_nothing(spark):
    docs = spark.range(25_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("x y").alias("text"))
    docs = docs.union(spark.createDataFrame([(2, "b", "z " * 50_000)], docs.schema))
    got = mixing.mixed(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    got = {r["doc_id"]: r for r in got}
    assert got[1]["n"] == 25_000 and abs(got[1]["taken"] - got[1]["target"]) <= 2 and got[2]["n"] == 1
    empty = mixing.mixed(spark.createDataFrame([], SCHEMA))
    assert empty.columns == ["doc_id", "size", "source_size", "target", "taken"] and empty.collect() == []
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mixed(documents(spark, [None, " "], [1, None])).collect()} == {(0, 0.0, 0)}


def test_mixing_runs_no_python(spark):
    docs = documents(spark, ["a b", "c"])
    plan = mixing.mixed(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
