"""Merges of near-equal names against a brute-force fold over all pairs."""

import difflib
import random

from postloom.operators import graph


def brute(nodes, least=0.92):
    out = []
    for kind in ("PERSON", "ORGANIZATION"):
        kept = []
        for i, name, _, _ in sorted((n for n in nodes if n[2] == kind and n[1] is not None), key=lambda n: (-len(n[1]), n[0])):
            low = name.lower()
            hit = next((k for k, other in kept if difflib.SequenceMatcher(None, other, low).ratio() > least), None)
            if hit is None:
                kept.append((i, low))
            else:
                out.append((i, hit))
    return sorted(out)


def _edited(rng, name):
    for _ in range(rng.randint(0, max(1, len(name) // 12))):
        at = rng.randrange(len(name) + 1)
        name = name[:at] + rng.choice(["", rng.choice("abj. ")]) + name[at + rng.randint(0, 1) :]
    return name


def test_names_merge_like_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    names = ["Jon Smith", "John Smith", "J. Fitzgerald", "J Fitzgerald", "Alexander Hahn", "Alexander Hahns", "lAexander Hahns", "", "", "x", None]
    names += [f"Customer#{k:09d}" for k in range(1, 120)]
    for length in (9, 15, 23, 34, 47, 70):
        for _ in range(3):
            base = "".join(rng.choice("abcdefghij klmno") for _ in range(length))
            names += [_edited(rng, base) for _ in range(8)]
    nodes = [(i, n, ("PERSON", "ORGANIZATION")[i % 7 == 0], None) for i, n in enumerate(names)]
    rng.shuffle(nodes)
    table = spark.createDataFrame(nodes, "node_id long, name string, kind string, email string")
    expected = brute(nodes)
    assert len(expected) > 100
    assert sorted(tuple(r) for r in graph.resolve_people(table).collect()) == expected
    monkeypatch.setattr(graph, "FOLD_AT_ONCE", 7)
    assert sorted(tuple(r) for r in graph.resolve_people(table).collect()) == expected


def test_pairs_over_the_ratio_share_a_key():
    rng = random.Random(9)
    for least in (0.8, 0.92):
        for _ in range(300):
            a = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 40)))
            b = _edited(rng, a)
            a, b = sorted((a, b), key=len, reverse=True)
            if a != b and difflib.SequenceMatcher(None, a, b).ratio() > least:
                x, y = (graph._name_keys(n, sorted({len(a), len(b)}), least) for n in (a, b))
                assert {k for side, k in x if side} & {k for side, k in y if not side}
