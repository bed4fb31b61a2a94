"""A proximity graph over the vectors of one shard: built and searched in numpy inside a task.

Nodes are distinct vectors at length 1. Each has links to near nodes, of which none is nearer to another linked node than
to the node itself, and links back, DEGREE at most. A search starts at the best of the upper layer (every UPPER-th node),
keeps the `ef` best nodes seen and follows the links of the best ones not yet followed, WIDTH at a time for each query of a
block, until none of the beam is left. On the way nodes are compared by sign codes of CODE_WORDS * 64 random hyperplanes;
only the nodes of the last beam are compared by their vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEGREE, UPPER, WIDTH, CODE_WORDS, SEED = 24, 16, 8, 4, 11
_FAR = np.int32(1 << 20)


def units(m: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; rows of zeros stay."""
    m = m.astype(float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def codes(m: np.ndarray) -> np.ndarray:
    """The side of each hyperplane that a row is on, as 64-bit words."""
    planes = np.random.default_rng(SEED).normal(size=(m.shape[1], 64 * CODE_WORDS))
    bits = np.packbits(m @ planes > 0, axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).reshape(len(m), CODE_WORDS)


@dataclass
class Graph:
    vectors: np.ndarray  # float32, distinct, one row a node
    codes: np.ndarray
    links: np.ndarray  # node by DEGREE, -1 where there is none

    @classmethod
    def of(cls, vectors: np.ndarray) -> Graph:
        m = units(vectors).astype(np.float32)
        return cls(vectors, codes(m), _links(m))


def _links(m: np.ndarray, block: int = 512) -> np.ndarray:
    n, half = len(m), DEGREE // 2
    near = min(2 * DEGREE, n - 1)
    chosen = np.full((n, half), -1, np.int32)
    if near < 1:
        return np.full((n, DEGREE), -1, np.int32)
    for a in range(0, n, block):
        own = np.arange(a, min(n, a + block))
        s = m[own] @ m.T
        s[np.arange(len(own)), own] = -np.inf
        c = np.argpartition(-s, near - 1, axis=1)[:, :near]
        v = np.take_along_axis(s, c, 1)
        order = np.argsort(-v, axis=1, kind="stable")
        chosen[own] = _spread(m, np.take_along_axis(c, order, 1), np.take_along_axis(v, order, 1), half)
    return _both_ways(chosen, m)


def _spread(m: np.ndarray, c: np.ndarray, v: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, nearest first, those that are not nearer to one already taken than to the node; then the
    nearest of the rest, until there are `most`."""
    between = np.einsum("bid,bjd->bij", m[c], m[c], optimize=True)
    taken = np.zeros(c.shape, bool)
    for k in range(c.shape[1]):
        hidden = (taken & (between[:, k, :] > v[:, k, None])).any(1)
        taken[:, k] = ~hidden & (taken.sum(1) < most)
    first = np.argsort(~taken, axis=1, kind="stable")[:, :most]
    out = np.full((len(c), most), -1, np.int32)
    out[:, : first.shape[1]] = np.take_along_axis(c, first, 1)
    return out


def _both_ways(chosen: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chosen links and, up to DEGREE, those back to the nodes that chose one, nearest first."""
    n, half = chosen.shape
    a, b = np.repeat(np.arange(n), half), chosen.ravel()
    a, b = a[b >= 0], b[b >= 0]
    known = np.isin(b.astype(np.int64) * n + a, a.astype(np.int64) * n + b)  # both chose each other
    a, b = a[~known], b[~known]
    order = np.lexsort((-np.einsum("ij,ij->i", m[a], m[b]), b))
    a, b = a[order], b[order]
    nth = np.arange(len(b)) - np.searchsorted(b, b)
    out = np.full((n, DEGREE), -1, np.int32)
    out[:, :half] = chosen
    fits = nth < DEGREE - half
    out[b[fits], half + nth[fits]] = a[fits]
    return out


def search(graph: Graph, queries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For a block of queries (units): the beam's nodes (-1 where it has fewer than ef) with their cosines, and how many
    codes were compared."""
    n, q = len(graph.codes), len(queries)
    asked = codes(queries)
    seen = np.zeros((q, n), bool)
    stamp = np.zeros(q * n, np.int32)
    row = np.arange(q)[:, None]

    def distances(nodes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(graph.codes[nodes] ^ asked[:, None, :]).sum(2, dtype=np.int32)

    upper = np.broadcast_to(np.arange(0, n, UPPER), (q, -(-n // UPPER)))
    beam, far = upper.copy(), distances(upper)
    compared = beam.size
    seen[:, ::UPPER] = True
    order = np.argsort(far, axis=1, kind="stable")[:, :ef]
    beam, far = np.take_along_axis(beam, order, 1), np.take_along_axis(far, order, 1)
    if beam.shape[1] < ef:
        beam = np.pad(beam, ((0, 0), (0, ef - beam.shape[1])), constant_values=-1)
        far = np.pad(far, ((0, 0), (0, ef - far.shape[1])), constant_values=_FAR)
    done = beam < 0
    while not done.all():
        width = min(WIDTH, ef)
        nxt = np.argsort(np.where(done, _FAR, far), axis=1, kind="stable")[:, :width]
        open_ = ~np.take_along_axis(done, nxt, 1)
        np.put_along_axis(done, nxt, True, 1)
        nodes = np.take_along_axis(beam, nxt, 1)
        linked = np.where(open_[:, :, None], graph.links[nodes], -1).reshape(q, -1)
        flat = (row * n + linked).ravel()
        fresh = (linked >= 0).ravel()
        fresh[fresh] = ~seen.ravel()[flat[fresh]]
        places = np.flatnonzero(fresh)
        stamp[flat[places]] = places
        fresh[places] = stamp[flat[places]] == places  # a node that two links lead to counts once
        seen.ravel()[flat[fresh]] = True
        compared += int(fresh.sum())
        fresh = fresh.reshape(linked.shape)
        new = np.where(fresh, distances(np.maximum(linked, 0)), _FAR)
        beam, far = np.hstack([beam, np.where(fresh, linked, -1)]), np.hstack([far, new])
        done = np.hstack([done, ~fresh])
        order = np.argsort(far, axis=1, kind="stable")[:, :ef]
        beam, far, done = (np.take_along_axis(x, order, 1) for x in (beam, far, done))
    near = np.einsum("qed,qd->qe", units(graph.vectors[np.maximum(beam, 0)].reshape(-1, queries.shape[1])).reshape(q, ef, -1), queries)
    return beam, np.where(beam >= 0, near, -np.inf), compared
