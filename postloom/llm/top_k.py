"""Exact top-k by inner product: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz pruning.

Vectors are integers floor(scale * x). Candidates are range-partitioned by descending length into parts of bounded size;
queries are packed into blocks, and a block goes only to the parts whose longest vector may still give one of its queries
a score among its k highest, as the longest vectors of all (a bounded head) already gave it k of them. In a task:

1. Candidates come in blocks of descending length. A block's length bounds its scores: a query whose k-th score so far is
   higher than |q| * max|c| skips it and all that follow, before anything of them is rotated.
2. Within a block, both sides are rotated by the singular vectors of the whole table (from its Gram matrix, summed over
   all rows). The first few rotated components give a partial sum, and |rest of q| * |rest of c| bounds what is missing.
3. What may still reach the k-th score gets its exact integer inner product: in doubles where |q| * |c| is so small that
   every sum is a whole number that a double holds, by Python's integers elsewhere.

The rotation and bounds only prune, with a margin for rounding; the scores are exact integers. No query or candidate
comes to the driver, but for the head.

Edge cases: vectors that are null or hold null or non-finite components (also such as scaling makes infinite), and rows
with a null id, take no part. A query
meets only candidates with as many components; its own row is every row with its id. Equal scores go to the smaller id.
Rows that repeat an id and a vector count once, as queries and as candidates; an id with several vectors has each
candidate's score with each of them. Scores beyond a long are given as its least or greatest value. Extra columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import stored

BLOCK = 1024  # candidates of a block, at most
QUERIES = 512  # queries of a block, at most
BLOCK_BYTES = 4 << 20  # of a block of either
PART_BYTES = 64 << 20  # of a part's candidates, about: each query block may be sent to every part
HEAD, HEAD_BYTES = 2048, 32 << 20  # longest vectors, which give the first thresholds
GRAM_ROWS = 64  # of the Gram matrix that are summed together
PARTIAL = 16  # rotated components of the partial sum
WHOLE = float(1 << 26)  # lengths under it: inner products, and all their partial sums, are whole numbers in doubles
_PACKED = "part int, kind int, at double, dim int, n int, ids binary, vectors binary, need binary"
_LONG = (-(1 << 63), (1 << 63) - 1)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Rows (id, vector array<double> of whole numbers, dim, norm) of the vectors that take part."""
    scaled = F.transform(F.col(vector_col), lambda v: _floored(v.cast("double") * scale))
    sound = F.forall(vector_col, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double") * scale) < float("inf")))
    usable = rows.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(F.coalesce(sound, F.lit(False)))
    out = usable.select(F.col(id_col).cast("long").alias("id"), scaled.alias("vector")).dropDuplicates(["id", "vector"])
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v))
    return out.withColumn("dim", F.size("vector")).withColumn("norm", norm)


def _floored(v):
    """Floor of a double as a double: beyond 2**52 doubles are whole already (and a long may not hold them)."""
    return F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = np.asarray(batch.column("dim"))
    for d in np.unique(dims).tolist():
        yield d, batch.filter(pa.array(dims == d))


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension, the singular vectors of the vectors, strongest first; from Gram matrices, which tasks sum in
    blocks of rows, so that the driver gets one matrix a dimension."""

    def grams(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, part in _by_dim(batch):
                m = _matrix(part.column("vector"), d)
                sums[d] = sums.get(d, 0) + m.T @ m
        for d, g in sums.items():
            for s in range(0, d, GRAM_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([s], pa.int32()), pa.array([g[s : s + GRAM_ROWS].tobytes()], pa.binary())], ["dim", "at", "gram"])

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(g.as_buffer(), float) for g in table["gram"])
        return pa.table({"dim": table["dim"][:1], "at": table["at"][:1], "gram": pa.array([total.tobytes()], pa.binary())})

    schema = "dim int, at int, gram binary"
    parts = vectors.where(F.col("norm") < WHOLE).select("vector", "dim").mapInArrow(grams, schema)
    blocks: dict[int, list[tuple[int, np.ndarray]]] = {}
    for row in parts.groupBy("dim", "at").applyInArrow(summed, schema).toLocalIterator():
        blocks.setdefault(row["dim"], []).append((row["at"], np.frombuffer(row["gram"], float).reshape(-1, row["dim"])))
    return {d: np.linalg.eigh(np.concatenate([g for _, g in sorted(own, key=lambda x: x[0])]))[1][:, ::-1].copy() for d, own in blocks.items()}


def block_rows(dim: int, most: int) -> int:
    """How many vectors a block may hold."""
    return max(1, min(most, BLOCK_BYTES // (8 * max(1, dim))))


def big_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of all rows of q and c by Python's integers, as longs."""
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    exact = whole(q) @ whole(c).T if q.shape[1] else np.zeros((len(q), len(c)), object)
    return np.array([[min(max(int(v), _LONG[0]), _LONG[1]) for v in row] for row in exact], np.int64).reshape(len(q), len(c))


def lengths(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((m * m).sum(1))


class Side:
    """Vectors of one dimension; rotated when that is first asked for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray | None):
        self.ids, self.vectors, self.rotation = ids, vectors, rotation
        self.norms = lengths(vectors)
        self.longest = float(self.norms.max(initial=0))
        self.small = self.norms < WHOLE
        self._rotated: tuple[np.ndarray, np.ndarray] | None = None

    def rotated(self) -> tuple[np.ndarray, np.ndarray]:
        """First components of the rotated vectors, and the length of what is left."""
        if self._rotated is None:
            m = np.where(self.small[:, None], self.vectors, 0.0)
            turned = m @ self.rotation if self.rotation is not None else m
            self._rotated = turned[:, :PARTIAL], lengths(turned[:, PARTIAL:])
        return self._rotated


def reaching(q: Side, c: Side, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query place, candidate id and score of the pairs that reach threshold (each query's k-th score so far)."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = q.norms * c.longest
    live = np.flatnonzero(~(bound * (1 + 1e-9) + 1e-6 < threshold))
    found = [(np.zeros(0, np.int64),) * 3]
    rows, columns = live[q.small[live]], np.flatnonzero(c.small)
    if len(rows) and len(columns):
        (qh, qr), (ch, cr) = q.rotated(), c.rotated()
        slack = 1e-9 * (1 + float(c.norms[columns].max()) * q.norms[rows])
        most = qh[rows] @ ch[columns].T + qr[rows][:, None] * cr[columns]
        may = most >= (threshold[rows] - slack)[:, None]
        rows, columns, may = rows[may.any(1)], columns[may.any(0)], may[np.ix_(may.any(1), may.any(0))]
        if len(rows) and len(columns):
            score = q.vectors[rows] @ c.vectors[columns].T  # whole numbers under 2**52, so exact in any order
            may &= (score >= threshold[rows][:, None]) & (q.ids[rows][:, None] != c.ids[columns])
            i, j = np.nonzero(may)
            found.append((rows[i], c.ids[columns[j]], score[i, j].astype(np.int64)))
    for rows, columns in ((live[~q.small[live]], np.arange(len(c.ids))), (live[q.small[live]], np.flatnonzero(~c.small))):
        if len(rows) and len(columns):
            score = big_scores(q.vectors[rows], c.vectors[columns])
            i, j = np.nonzero((score >= threshold[rows][:, None]) & (q.ids[rows][:, None] != c.ids[columns]))
            found.append((rows[i], c.ids[columns[j]], score[i, j]))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, ~score, query))  # ~score falls as score rises, at every long
    q = query[order]
    first = np.ones(len(q), bool)
    first[1:] = q[1:] != q[:-1]
    nth = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else order
    return order[nth < k]


def scan(q: Side, blocks: list[Side], threshold: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query place, candidate id and score of each query's k highest scores that reach threshold, over blocks by
    descending length."""
    limit, held = threshold.astype(float), tuple(np.zeros(0, np.int64) for _ in range(3))
    for c in blocks:
        if not len(limit) or (q.norms * c.longest * (1 + 1e-9) + 1e-6 < limit).all():
            break  # all that follow are shorter
        held = tuple(np.concatenate(x) for x in zip(held, reaching(q, c, limit), strict=True))
        keep = best(*held, k)
        held = tuple(x[keep] for x in held)
        counts = np.bincount(held[0], minlength=len(limit))
        lowest = np.full(len(limit), np.inf)
        np.minimum.at(lowest, held[0], held[2].astype(float))
        full = counts >= k
        # a long that a double does not hold is rounded: a little lower is safe
        limit[full] = np.maximum(limit[full], lowest[full] - np.where(np.abs(lowest[full]) < 2**52, 0, np.abs(lowest[full]) * 1e-12))
    return held


def _packed(part: int, kind: int, at: float, ids: np.ndarray, vectors: np.ndarray, need: np.ndarray | None = None) -> tuple:
    return part, kind, at, vectors.shape[1], len(ids), ids.astype(np.int64).tobytes(), vectors.tobytes(), (need if need is not None else np.zeros(0)).tobytes()


def _rows(packed: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = ["part", "kind", "at", "dim", "n", "ids", "vectors", "need"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in packed], kind) for k, kind in enumerate(kinds)], names)


def top_k(queries: DataFrame, candidates: DataFrame, id_col: str, vector_col: str, k: int = 5, scale: int = 256) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query its k highest scores among the candidates."""
    pool = stored(integer_vectors(candidates, id_col, vector_col, scale))
    asked = stored(integer_vectors(queries, id_col, vector_col, scale))
    total, size, wide = pool.agg(F.count("*"), F.sum(F.col("dim").cast("long") * 8), F.max("dim")).first()
    sc = pool.sparkSession.sparkContext
    turn = sc.broadcast(rotations(pool))
    head: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in pool.orderBy(F.desc("norm"), "id").limit(min(HEAD, max(1, HEAD_BYTES // (8 * max(1, wide or 1))))).toArrow().combine_chunks().to_batches():
        for d, part in _by_dim(batch):
            head[d] = (np.asarray(part.column("id")), _matrix(part.column("vector"), d))
    leading = sc.broadcast(head)
    # few parts save copies of queries; small tables are still dealt over the cores there are
    parts = max(1, -(-(size or 0) // PART_BYTES), min(sc.defaultParallelism, -(-total // (8 * BLOCK))))
    ranged = pool.repartitionByRange(parts, F.desc("norm"), "id") if parts > 1 else pool.coalesce(1)
    ranged = stored(ranged.sortWithinPartitions(F.desc("norm"), "id").withColumn("part", F.spark_partition_id()))
    longest = {r["part"]: r["longest"] for r in ranged.groupBy("part").agg(F.max("norm").alias("longest")).collect()}  # one number a part

    def candidate_blocks(batches):
        for batch in batches:
            for d, rows in _by_dim(batch):
                ids, vectors, at, part = np.asarray(rows.column("id")), _matrix(rows.column("vector"), d), np.asarray(rows.column("norm")), np.asarray(rows.column("part"))
                out = []
                for p in np.unique(part).tolist():
                    own = np.flatnonzero(part == p)
                    step = block_rows(d, BLOCK)
                    for s in range(0, len(own), step):
                        place = own[s : s + step]
                        out.append(_packed(p, 0, -float(at[place].max()), ids[place], vectors[place]))
                yield _rows(out)

    def query_blocks(batches):
        for batch in batches:
            for d, rows in _by_dim(batch):
                ids, vectors = np.asarray(rows.column("id")), _matrix(rows.column("vector"), d)
                step = 8 * block_rows(d, QUERIES)
                for s in range(0, len(ids), step):
                    for row in _query_blocks(ids[s : s + step], vectors[s : s + step], leading.value.get(d), longest, k):
                        yield _rows([row])

    both = ranged.mapInArrow(candidate_blocks, _PACKED).unionByName(asked.mapInArrow(query_blocks, _PACKED))
    dealt = both.repartitionById(parts, "part") if parts > 1 else both.repartition(1)  # a part a task
    together = dealt.sortWithinPartitions("part", "kind", "at")

    def matched(batches):
        part, blocks = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, blocks = row["part"], {}
                ids = np.frombuffer(row["ids"], np.int64)
                own = Side(ids, np.frombuffer(row["vectors"], float).reshape(row["n"], row["dim"]), turn.value.get(row["dim"]))
                if row["kind"] == 0:
                    blocks.setdefault(row["dim"], []).append(own)
                    continue
                q, c, score = scan(own, blocks.get(row["dim"], []), np.frombuffer(row["need"], float), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(c), pa.array(score)], ["query_id", "vec_id", "score"])

    found = together.mapInArrow(matched, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _query_blocks(ids: np.ndarray, vectors: np.ndarray, head: tuple[np.ndarray, np.ndarray] | None, longest: dict[int, float], k: int) -> Iterator[tuple]:
    """The queries packed in blocks, once for every part that a block may have to see."""
    threshold, norms = np.full(len(ids), -np.inf), lengths(vectors)
    if head is not None and len(head[0]) > k:
        with np.errstate(over="ignore", invalid="ignore"):
            score = vectors @ head[1].T
            score -= 1e-9 * norms[:, None] * lengths(head[1])  # rounding of sums beyond a double's whole numbers
        score = np.where(np.isfinite(score), score, -np.inf)
        score[ids[:, None] == head[0]] = -np.inf
        threshold = np.floor(np.partition(score, len(head[0]) - k, 1)[:, len(head[0]) - k])
        threshold[np.abs(threshold) >= 2.0**62] = -np.inf
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(threshold <= 0, 0.0, threshold / norms)  # how long a candidate has to be
    order = np.argsort(need, kind="stable")
    step = block_rows(vectors.shape[1], QUERIES)
    for s in range(0, len(ids), step):
        own = order[s : s + step]
        least = float(need[own].min()) * (1 - 1e-9) - 1e-6
        for p, most in longest.items():
            if most >= least:
                yield _packed(p, 1, 0.0, ids[own], vectors[own], threshold[own])
