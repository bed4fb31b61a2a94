import random
import re

import numpy as np

from postloom.llm import ngram_join as N

from .helpers import documents, rows


def brute(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(r.choices(words, k=30))
    out = [None, "", "  \n", "one two", "ONE two", "one two three four five"]
    for _ in range(25):
        base = r.choices(words, k=r.choice([6, 40, 90, 200]))
        out.append(" ".join(base))
        for _ in range(r.choice([0, 1, 3])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy) if r.random() < 0.7 else " ".join(copy) + " " + shared)
    drift = r.choices(words, k=120)  # a chain whose ends do not link
    for k in range(12):
        drift = list(drift)
        for _ in range(2):
            drift[(7 * k + r.randrange(7)) % 120] = r.choice(words)
        out.append(" ".join(drift))
    r.shuffle(out)
    return out


def test_components_are_those_of_all_pairs(spark):
    texts = corpus(4)
    found = rows(N.jaccard_components(documents(spark, texts)), "doc_id", "n_shingles", "component_id")
    assert found == brute(texts)


def test_without_leaders_the_trees_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(N, "LEADER_ROUNDS", 0)
    monkeypatch.setattr(N, "FOREST_ROUNDS", 0)
    monkeypatch.setattr(N, "BLOCK", 4)
    texts = corpus(5) + ["a b c d e f g h i j"] * 3
    texts += [f"{' '.join(f'q{i}' for i in range(60))} z{k}" for k in range(20)]
    found = rows(N.jaccard_components(documents(spark, texts)), "doc_id", "n_shingles", "component_id")
    assert found == brute(texts)


def test_edges(spark):
    assert N.jaccard_components(documents(spark, [])).count() == 0
    got = rows(N.jaccard_components(documents(spark, ["a b c d e", "a b c d e", "a b c d e", None], [None, 5, 5, 9])), "doc_id", "n_shingles", "component_id")
    assert got == [(None, 1, None), (5, 1, 5), (5, 1, 5), (9, 0, 9)]


def test_an_id_with_several_texts_joins_what_they_link_to(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    ids, texts = zip((1, a), (5, a + " x"), (5, b + " y"), (5, None), (7, a), (7, a), (9, b), (10, None), strict=True)
    got = rows(N.jaccard_components(documents(spark, texts, ids)), "doc_id", "n_shingles", "component_id")
    assert got == [(1, 56, 1), (5, 0, 1), (5, 57, 1), (5, 57, 1), (7, 56, 1), (7, 56, 1), (9, 56, 1), (10, 0, 10)]


def test_a_text_beyond_a_slice_links_with_its_near_copy(spark):
    long = " ".join(f"w{i}" for i in range(200_000))  # over 1 MB
    other = " ".join(f"v{i}" for i in range(200_000))
    got = rows(N.jaccard_components(documents(spark, [other, long, long.upper().replace("W7 ", "x7 "), "short"])), "doc_id", "n_shingles", "component_id")
    assert got == [(0, 199_996, 0), (1, 199_996, 1), (2, 199_996, 1), (3, 1, 3)]


def test_a_large_group_is_dealt_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 3)
    monkeypatch.setattr(N, "LEADER_ROUNDS", 1)
    r = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for k in range(40):
        copy = list(base)
        for _ in range(k % 4):
            copy[r.randrange(80)] = f"x{k}"
        texts.append(" ".join(copy))
    assert rows(N.jaccard_components(documents(spark, texts)), "doc_id", "n_shingles", "component_id") == brute(texts)


def test_tree_pairs_lose_no_pair_that_links():
    rng = np.random.default_rng(1)
    sets = [set(rng.integers(0, 60, rng.integers(5, 40)).tolist()) for _ in range(70)]
    bits = np.zeros((70, 1), np.uint64)
    for i, s in enumerate(sets):
        for v in s:
            bits[i, 0] |= np.uint64(1) << np.uint64(v % 64)
    size = np.array([len(s) for s in sets])
    x, y = N.tree_pairs(size, bits, np.arange(70), np.zeros(70, int), False)
    found = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist(), strict=True)}
    for i in range(70):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                assert (j, i) in found


def test_forests_join_what_all_pairs_join():
    rng = np.random.default_rng(2)
    for n, pairs in ((5, 4), (60, 40), (300, 3000)):
        x, y = rng.integers(0, n, pairs), rng.integers(0, n, pairs)
        x, y = x[x != y], y[x != y]
        comp = rng.integers(0, max(2, n // 2), n)
        likely = rng.random(len(x)).round(1)

        def joined(places, x=x, y=y, comp=comp, n=n):
            label = comp.copy()
            for _ in range(n):
                before = label.copy()
                for k in places:
                    m = min(label[x[k]], label[y[k]])
                    for v in (label[x[k]], label[y[k]]):
                        label[label == v] = m
                if (before == label).all():
                    break
            return label.tolist()

        kept = N.forest(x, y, likely, comp)
        assert joined(kept) == joined(range(len(x))) and len(kept) < n
