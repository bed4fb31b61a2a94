"""Nearest neighbours by cosine: exact scans whose top-k is taken by task before it is merged, and an index of proximity
graphs that is built once, kept as Parquet and searched later."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.vectors import cosine, unit_score, usable
from postloom.operators import proximity

LIMIT_MOST = 500


def nearest(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (id, similarity, score) of the k most similar usable vectors, ties by id. Filters run before the scan."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    near = rows.where(usable(F.col(vector_col), len(query))).select(id_col, F.round(cosine(F.col(vector_col), q), 6).alias("similarity"))
    top = near.orderBy(F.desc("similarity"), id_col).limit(min(k, LIMIT_MOST))
    return top.withColumn("score", F.round(unit_score(F.col("similarity")), 4))


LISTS_MOST, SAMPLED, STEPS = 4096, 1 << 15, 8
SHARD, SHARD_BYTES, PROBED, EF, BLOCK = 4096, 32 << 20, 32, 160, 256


def shard_rows(dim: int) -> int:
    """How many vectors a shard may hold: SHARD, and no more than SHARD_BYTES."""
    return max(1, min(SHARD, SHARD_BYTES // (4 * dim)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(len(column), dim)


def _pool(rows: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    return rows.where(usable(F.col(vector_col), dim)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))


def centroids(vectors: DataFrame, dim: int, lists: int) -> np.ndarray:
    """Centres by spherical k-means on a bounded sample (SAMPLED vectors and SHARD_BYTES * 4 at most, by a hash of the id)."""
    most = min(SAMPLED, SHARD_BYTES // dim)
    share = min(1.0, 2 * most / max(1, vectors.count()))
    near = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = near.orderBy(F.xxhash64("id"), "id").limit(most).select("vector").toArrow().combine_chunks()
    m = proximity.units(_matrix(rows["vector"].combine_chunks(), dim)) if len(rows) else np.zeros((0, dim))
    c = np.unique(m, axis=0) if len(m) else m
    c = c[np.random.default_rng(0).permutation(len(c))[:lists]]
    for _ in range(STEPS if len(c) > 1 else 0):
        own = (m @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, m)
        c = proximity.units(np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, sums, c))
    return c.astype(np.float32)


def build_index(vectors: DataFrame, path: str, dim: int, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
    """Writes an index of all usable vectors below path: `centres`, and `shards` with a proximity graph in each row.

    Vectors are dealt into lists by the nearest of some centres, and lists into shards of bounded size, so that a list of
    any share takes many tasks; a shard's graph is built in a task. Equal vectors of a shard are one node with all ids."""
    pool = _pool(vectors, id_col, vector_col, dim)
    n, most = pool.count(), shard_rows(dim)
    c = centroids(pool, dim, min(LISTS_MOST, -(-2 * n // most)) if n > most else 1)
    spark = pool.sparkSession
    rows = [(k, v.tolist()) for k, v in enumerate(c)]
    spark.createDataFrame(rows, "list int, vector array<float>").write.parquet(f"{path}/centres")
    shared = spark.sparkContext.broadcast(c)  # LISTS_MOST vectors at most

    def assigned(batches):
        for batch in batches:
            own = (proximity.units(_matrix(batch.column(1), dim)) @ shared.value.T).argmax(1) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *batch.columns], ["list", "id", "vector"])

    held = pool.mapInArrow(assigned, "list int, id long, vector array<float>")
    parts = F.broadcast(held.groupBy("list").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")))  # a row a list
    held = held.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    def built(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        m, ids = _matrix(table["vector"].combine_chunks(), dim), np.asarray(table["id"])
        _, first, node = np.unique(proximity.units(m).astype(np.float32), axis=0, return_index=True, return_inverse=True)
        order = np.argsort(node, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(node))).astype(np.int32)
        g = proximity.Graph.of(m[first])
        packed = [a.tobytes() for a in (ids[order].astype(np.int64), ends, g.vectors.astype(np.float32), g.codes, g.links)]
        columns = {"list": table["list"][:1], "part": table["part"][:1], "n": pa.array([len(ids)], pa.int32()), **{c: pa.array([p], pa.binary()) for c, p in zip(_PACKED, packed, strict=True)}}
        return pa.table(columns)

    schema = "list int, part int, n int, " + ", ".join(f"{c} binary" for c in _PACKED)
    held.groupBy("list", "part").applyInArrow(built, schema).write.parquet(f"{path}/shards")


_PACKED = ["ids", "ends", "vectors", "codes", "links"]


def _top(query_ids, nodes_of, near, k: int):
    """Rows of the k best of each query: nodes_of(q, place) gives the ids of a place in ascending order."""
    for q, own in enumerate(query_ids.tolist()):
        order = np.argsort(-near[q], kind="stable")
        found: list[tuple[float, int]] = []
        for place in order.tolist():
            value = near[q, place]
            if value == -np.inf or len(found) >= k and value < found[k - 1][0]:
                break
            found += [(value, i) for i in nodes_of(q, place)[: k + 1].tolist() if i != own]
            found.sort(key=lambda x: (-x[0], x[1]))
        yield own, found[:k]


def _answers(rows: list, counts: np.ndarray) -> pa.RecordBatch:
    flat = [(q, i, v) for q, found in rows for v, i in found]
    q, i, v = zip(*flat, strict=True) if flat else ((), (), ())
    rest = [q for q, _ in rows]  # one more row for each query: how many vectors it was held against
    return pa.RecordBatch.from_arrays(
        [pa.array([*q, *rest], pa.int64()), pa.array([*i, *[None] * len(rest)], pa.int64()), pa.array([*v, *[None] * len(rest)], pa.float64()), pa.array([*[0] * len(flat), *counts.tolist()], pa.int64())],
        ["query_id", "id", "similarity", "held"],
    )


def _streamed(both: DataFrame, load: Callable, answer: Callable) -> DataFrame:
    """Rows of answer(shard, ids, vectors) for the queries (kind 1) of each (list, part), in blocks that follow the rows
    of the shard itself (kind 0), of which load makes the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, raw, shard = None, [], None
        for batch in batches:
            lists, parts, kinds = (np.asarray(batch.column(c)) for c in range(3))
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(lists) != 0) | (np.diff(parts) != 0) | (np.diff(kinds) != 0), [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if (lists[a], parts[a]) != key:
                    key, raw, shard = (lists[a], parts[a]), [], None
                if kinds[a] == 0:
                    raw.append(batch.slice(a, b - a))
                elif raw:
                    shard = load(raw) if shard is None else shard
                    for s in range(a, b, BLOCK):
                        block = batch.slice(s, min(BLOCK, b - s))
                        yield answer(shard, np.asarray(block.column(3)), block.column(4))

    rows = both.repartition("list", "part").sortWithinPartitions("list", "part", "kind")
    found = rows.mapInArrow(run, "query_id long, id long, similarity double, held long")
    return found


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, similarity, held): the k best over all shards, and how many vectors were compared in all."""
    held = F.sum("held").over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("id").isNull(), F.desc("similarity"), "id"))
    return found.select("*", held.alias("all_held"), place.alias("rank")).where((F.col("rank") <= k) & F.col("id").isNotNull()).select("query_id", "rank", "id", "similarity", F.col("all_held").alias("held"))


def search_index(queries: DataFrame, path: str, k: int, dim: int, id_col: str = "vec_id", vector_col: str = "embedding", ef: int = EF, probed: int = PROBED) -> DataFrame:
    """Rows (query_id, rank, id, similarity, held): each query's k nearest by cosine that the index below path finds, ties
    by the smaller id, its own id left out; held: how many whole vectors it was compared with.

    A query goes to the `probed` lists whose centres are nearest to it, so that its cost does not grow with the index; in
    each shard of those a beam of `ef` nodes is kept. Recall is a matter of the data: where vectors have no structure, as
    uniformly drawn ones, it falls with the share of lists that is left out."""
    spark = queries.sparkSession
    rows = spark.read.parquet(f"{path}/centres").orderBy("list").toArrow().combine_chunks()  # LISTS_MOST at most
    centres = spark.sparkContext.broadcast(_matrix(rows["vector"].combine_chunks(), dim) if len(rows) else np.zeros((0, dim), np.float32))
    lists, ef = len(rows), max(ef, k)
    width = max(1, min(lists, probed))

    def probing(batches):
        for batch in batches:
            if not lists:
                continue
            m = proximity.units(_matrix(batch.column(1), dim))
            near = np.argpartition(-(m @ centres.value.T), width - 1, 1)[:, :width].astype(np.int32)
            row = pa.array(np.repeat(np.arange(len(batch)), width))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), batch.column(0).take(row), batch.column(1).take(row)], ["list", "id", "vector"])

    shards = spark.read.parquet(f"{path}/shards")
    parts = F.broadcast(shards.groupBy("list").agg(F.collect_list("part").alias("parts")))  # an int a shard
    seeking = _pool(queries, id_col, vector_col, dim).mapInArrow(probing, "list int, id long, vector array<float>")
    seeking = seeking.join(parts, "list").select("list", F.explode("parts").alias("part"), F.lit(1).alias("kind"), "id", "vector")
    held = shards.select("list", "part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<float>").alias("vector"), *_PACKED)
    both = held.unionByName(seeking, allowMissingColumns=True)

    def load(raw):
        b = raw[0]
        ids, ends, m, code, links = (np.frombuffer(b.column(5 + i)[0].as_py(), t) for i, t in enumerate((np.int64, np.int32, np.float32, np.uint64, np.int32)))
        return ids, ends, proximity.Graph(m.reshape(-1, dim), code.reshape(-1, proximity.CODE_WORDS), links.reshape(-1, proximity.DEGREE))

    def answer(shard, query_ids, column):
        ids, ends, graph = shard
        beam, near, _ = proximity.search(graph, proximity.units(_matrix(column, dim)), ef)
        rows = list(_top(query_ids, lambda q, place: ids[ends[beam[q, place]] : ends[beam[q, place] + 1]], near, k))
        return _answers(rows, (beam >= 0).sum(1))

    return _merged(_streamed(both, load, answer), k)


def exact(queries: DataFrame, vectors: DataFrame, k: int, dim: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """As search_index(), with every usable vector held against every query, in double precision. Vectors are dealt into
    parts of bounded size; a task holds one part and streams the queries, so that no pair is written."""
    pool, asked = _pool(vectors, id_col, vector_col, dim), _pool(queries, id_col, vector_col, dim)
    parts = max(1, -(-pool.count() // (4 * shard_rows(dim))))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    held = pool.select(F.lit(0).alias("list"), part.alias("part"), F.lit(0).alias("kind"), "id", "vector")
    seeking = asked.select(F.lit(0).alias("list"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "id", "vector")

    def load(raw):
        ids = np.concatenate([np.asarray(b.column(3)) for b in raw])
        order = np.argsort(ids, kind="stable")
        return ids[order], proximity.units(np.concatenate([_matrix(b.column(4), dim) for b in raw])[order])

    def answer(shard, query_ids, column):
        ids, m = shard
        near = proximity.units(_matrix(column, dim)) @ m.T
        near[query_ids[:, None] == ids] = -np.inf
        places = np.argsort(-near, axis=1, kind="stable")[:, :k]  # ids ascend, so that ties go to the smaller
        rows = [(q, [(near[i, j], int(ids[j])) for j in places[i].tolist() if near[i, j] > -np.inf]) for i, q in enumerate(query_ids.tolist())]
        return _answers(rows, (near > -np.inf).sum(1))

    return _merged(_streamed(held.unionByName(seeking), load, answer), k)
