"""Entity graphs as two tables: nodes (node_id, name, kind, pagerank) and edges (source_id, target_id, relation, weight)."""

from __future__ import annotations

import math
import uuid
from functools import reduce
from itertools import combinations, pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.privacy import sanitize_retrieved
from postloom.sources.tables import spare, stored

# ---- fixed values: the relations of the ontology, and spellings that stand for one of them ----
RELATIONS = (
    "SENT_EMAIL_TO CC_TO FORWARDED_TO WORKS_FOR LOCATED_IN DEPARTMENT_OF OWNS_POLICY ISSUED_BY COVERED_BY CLAIMS_ON HAS_VALUE "
    "OWES PAID_BY DUE_ON VALID_UNTIL EFFECTIVE_FROM CURRENT_STATUS CHANGED_TO ASSIGNED_TO REQUESTED_BY APPROVED_BY "
    "ATTACHED_TO REFERENCES AMENDS RELATED_TO"
).split()
SAME_RELATION = {
    "MENTIONS": "REFERENCES",
    "DISCUSSES": "REFERENCES",
    "SENT_TO": "SENT_EMAIL_TO",
    "HAS_DEADLINE": "DUE_ON",
    "REQUIRES_ACTION_FROM": "ASSIGNED_TO",
    "AMOUNT_OF": "HAS_VALUE",
    "HAS_STATUS": "CURRENT_STATUS",
    "ATTACHES": "ATTACHED_TO",
}
# ---- end of fixed values ----
TRIGRAM_LEAST, HOP_MOST, DAMPING, FACTS_MOST = 0.3, 100, 0.85, 100
#: Bounds of a task's work, not of results: keys of a name for one length, names and links folded at once, and pairs of a round.
KEYS_MOST, FOLD_AT_ONCE, FOLD_LINKS, PAIRS_AT_ONCE = 500, 4096, 1_000_000, 1 << 23
#: Rows of a task that sorts or sums a table's edges, about.
TASK_ROWS = 500_000


def relation(name: Column) -> Column:
    """A relation of the ontology, RELATED_TO for what is none."""
    snake = F.translate(F.upper(F.trim(name)), " -", "__")
    known = F.create_map(*(F.lit(x) for kv in SAME_RELATION.items() for x in kv))
    mapped = F.coalesce(F.try_element_at(known, snake), snake)
    return F.when(mapped.isin(RELATIONS), mapped).otherwise("RELATED_TO")


def named(nodes: DataFrame, names: list[str]) -> DataFrame:
    """All nodes whose name holds one of the names, but for case."""
    low = F.lower("name")
    return nodes.where(reduce(lambda a, b: a | b, (F.contains(low, F.lit(n.lower())) for n in names), F.lit(False)))


def find_entities(nodes: DataFrame, names: list[str], limit: int = 10) -> DataFrame:
    """Nodes whose name holds one of the names, but for case, by pagerank."""
    return named(nodes, names).orderBy(F.desc("pagerank"), "node_id").limit(limit).withColumn("similarity", F.lit(1.0))


def trigrams(text: Column) -> Column:
    """The distinct three-letter pieces of each word, with two spaces before and one after it."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def similar_entities(nodes: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Nodes whose trigrams overlap the name's enough, most similar first."""
    mine, theirs = trigrams(F.lit(name)), trigrams(F.col("name"))
    sim = F.round(F.size(F.array_intersect(mine, theirs)) / F.greatest(F.size(F.array_union(mine, theirs)), F.lit(1)), 6)
    return nodes.withColumn("similarity", sim).where(F.col("similarity") > TRIGRAM_LEAST).orderBy(F.desc("similarity"), F.desc("pagerank"), "node_id").limit(limit)


def rendered_facts(nodes: DataFrame, edges: DataFrame, most: int = FACTS_MOST) -> DataFrame:
    """Rows (at, line), from 1: entities (node_id, name, kind, description) by id, then facts (edge_id, source, relation,
    target, description) by id, `most` lines in all. A missing name is Unknown, a missing relation `related to`; lines
    that look like instructions are emptied."""
    name = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("Unknown"))
    said = lambda before: F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(before), "description")).otherwise("")
    kind = F.coalesce(F.nullif("kind", F.lit("")), F.lit("UNKNOWN"))
    relation = F.lower(F.replace(F.coalesce(F.nullif("relation", F.lit("")), F.lit("related_to")), F.lit("_"), F.lit(" ")))
    entity = nodes.select(F.lit(0).alias("part"), F.col("node_id").alias("id"), F.concat(F.lit("Entity: "), name("name"), F.lit(" ("), kind, F.lit(")"), said(" - ")).alias("line"))
    fact = edges.select(F.lit(1).alias("part"), F.col("edge_id").alias("id"), F.concat(name("source"), F.lit(" "), relation, F.lit(" "), name("target"), F.lit("."), said(" ")).alias("line"))
    first = entity.unionByName(fact).orderBy("part", "id", "line").limit(most)  # so few rows that one task may number them
    return first.select(F.row_number().over(Window.orderBy("part", "id", "line")).alias("at"), sanitize_retrieved(F.trim("line")).alias("line"))


def sampled_names(nodes: DataFrame, kind: str, name: str, key: str, most: int) -> DataFrame:
    """Rows (kind, place, name): for each kind the names of the `most` smallest hashes, a sample that is the same however
    the rows are dealt. Spark keeps the first `most` of each task before rows are shuffled, so that one kind may hold any
    share; these are merged by buckets and then by kind."""
    digest = F.md5(F.col(name))
    by = [digest, F.col(key)]
    some = nodes.withColumn("bucket", F.pmod(F.xxhash64(name, key), F.lit(32)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy(kind, "bucket").orderBy(*by))).where(F.col("place") <= most)
    return some.withColumn("place", F.row_number().over(Window.partitionBy(kind).orderBy(*by))).where(F.col("place") <= most).select(kind, "place", name)


def expand(edges: DataFrame, start: DataFrame, hops: int, most: int = HOP_MOST) -> DataFrame:
    """Edges within some hops of the nodes in start (node_id), with their hop: out and in edges apart, the heaviest of
    each hop and direction, each edge once. The frontier of a hop is bounded by that limit and is broadcast. What a hop
    finds is stored, as the next one asks for it several times: edges are read twice a hop."""
    if not 1 <= hops <= 3:
        raise ValueError("hops are 1 to 3")
    nxt = spare("_next", edges)
    frontier, seen, out = start.select("node_id").distinct(), start.select("node_id").distinct(), None
    for hop in range(1, hops + 1):
        parts = []
        for here, there in (("source_id", "target_id"), ("target_id", "source_id")):
            found = edges.join(F.broadcast(frontier.withColumnRenamed("node_id", here)), here, "left_semi")
            if out is not None:
                found = found.join(F.broadcast(out.select("edge_id")), "edge_id", "left_anti")
            parts.append(found.orderBy(F.desc("weight"), "edge_id").limit(most).select(*edges.columns, F.col(there).alias(nxt)))
        both = stored(parts[0].unionByName(parts[1]))
        step = both.drop(nxt).dropDuplicates(["edge_id"]).withColumn("hop", F.lit(hop))
        frontier = both.select(F.col(nxt).alias("node_id")).distinct().join(F.broadcast(seen), "node_id", "left_anti")
        seen = seen.unionByName(frontier)
        out = step if out is None else out.unionByName(step)
    return out


def conversations_of(edges: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """Conversations by how many of their edges touch the entities (node_id)."""
    ids = entities.select("node_id").distinct()
    touching = edges
    for end in ("source_id", "target_id"):
        touching = touching.join(ids.select(F.col("node_id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    one = touching.where("(_source_id or _target_id) and conversation_id is not null")
    return one.groupBy("conversation_id").count().orderBy(F.desc("count"), "conversation_id").limit(limit)


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys into tasks of TASK_ROWS for so many rows, a number that Spark does not lower again, so that what a
    task sorts or holds does not grow with the table; a small one is left alone."""
    return df if rows <= TASK_ROWS else df.repartition(-(-rows // TASK_ROWS), *keys)


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int, damping: float = DAMPING) -> DataFrame:
    """Rows (node_id, rank): power iteration over all edges, the weight of nodes without out-edges shared by all. Every few
    rounds the ranks are written to the shared folder, so that plans stay short and lost executors cost little."""
    out_degree = edges.groupBy("source_id").agg(F.sum("weight").alias("total"))
    sums = stored(dealt(edges.select("source_id", "target_id", "weight"), edges.count(), "source_id", "target_id").groupBy("source_id", "target_id").agg(F.sum("weight").alias("weight")))
    size = sums.count()
    links = stored(dealt(sums, size, "source_id").join(dealt(out_degree, size, "source_id"), "source_id").select("source_id", "target_id", (F.col("weight") / F.col("total")).alias("share")))
    n = nodes.count()
    base = stored(nodes.select("node_id").join(out_degree.select(F.col("source_id").alias("node_id"), F.lit(False).alias("sink")), "node_id", "left").select("node_id", F.coalesce("sink", F.lit(True)).alias("sink")))
    ranks = base.withColumn("rank", F.lit(1.0 / max(1, n)))
    for k in range(rounds):
        lost = ranks.where("sink").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        here = ranks.select(F.col("node_id").alias("source_id"), "rank")
        got = dealt(links, size, "source_id").join(dealt(here, size, "source_id"), "source_id").groupBy(F.col("target_id").alias("node_id")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = base.join(got, "node_id", "left").crossJoin(F.broadcast(lost))  # one row
        ranks = new.select("node_id", "sink", (F.lit((1 - damping) / max(1, n)) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / max(1, n))).alias("rank"))
        if k % 4 == 3:
            ranks = stored(ranks)
    return ranks.select("node_id", F.round("rank", 9).alias("rank"))


def canonical_names(nodes: DataFrame) -> DataFrame:
    """Rows (name, canonical): the longest name (then the first) of those that are equal but for case and outer space."""
    key = F.lower(F.trim("name"))
    by = Window.partitionBy(key).orderBy(F.desc(F.length("name")), "name")
    return nodes.select("name", F.first("name").over(by).alias("canonical")).distinct()


def merge_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose ends are moved by ids (old_id, new_id), loops dropped, equal ones made one with their weights summed."""
    moved = edges
    for end in ("source_id", "target_id"):
        moved = moved.join(ids.select(F.col("old_id").alias(end), F.col("new_id")), end, "left").withColumn(end, F.coalesce("new_id", end)).drop("new_id")
    return moved.where("source_id <> target_id").groupBy("source_id", "target_id", "relation").agg(F.round(F.sum("weight"), 6).alias("weight"))


def _shared_keys(n: int, m: int, least: float) -> tuple[int, int] | None:
    """How many characters a name of n and one of m (n >= m) may have unmatched at a ratio over `least`; none where no
    two such names reach it."""
    matched = next((k for k in range(m + 1) if 2.0 * k / (n + m) > least), None) if n + m else None
    return None if matched is None else (n - matched, m - matched)


def _name_keys(name: str, lengths: list[int], least: float) -> set[tuple[bool, str]]:
    """(as the longer name, key) of a name: any two names, of the lengths given, whose ratio is over `least` share a key,
    one as the longer and one as the shorter (names of one length either way). Matched characters are a common
    subsequence, so that both names have it among what is left when they lose their unmatched characters; where those
    are too many, one of the shorter name's pieces (one more than characters unmatched) is in the other whole, moved by
    no more than those."""
    out = set()
    for other in lengths:
        for longer in (True, False):
            n, m = (len(name), other) if longer else (other, len(name))
            if n < m or (lost := _shared_keys(n, m, least)) is None:
                continue
            if math.comb(n, lost[0]) <= KEYS_MOST and math.comb(m, lost[1]) <= KEYS_MOST:
                kept = len(name) - lost[not longer]
                out |= {(longer, f"{n}:{m}:{''.join(x)}") for x in combinations(name, kept)}
                continue
            pieces = sum(lost) + 1
            cuts = [m * k // pieces for k in range(pieces + 1)]
            for k, (start, end) in enumerate(pairwise(cuts)):
                moves = range(-lost[1], lost[0] + 1) if longer else (0,)
                out |= {(longer, f"{n}:{m}:{k}:{name[start + x : end + x]}") for x in moves if start + x >= 0 and end + x <= len(name)}
    return out


def _keyed(names: DataFrame, least: float) -> DataFrame:
    """Rows (place, n, longer, key) of names (place, kind, low): the keys of each, stored."""
    import pandas as pd

    lengths = sorted(r[0] for r in names.select(F.length("low")).distinct().collect())  # few

    def keyed(batches):
        for pdf in batches:
            rows = [(place, kind, len(low), longer, key) for place, kind, low in pdf.itertuples(index=False) for longer, key in _name_keys(low, lengths, least)]
            yield pd.DataFrame(rows, columns=["place", "kind", "n", "longer", "key"])

    dealt = names.select("place", "kind", "low").repartition(_tasks(names.count(), 2000), "place")
    keys = dealt.mapInPandas(keyed, "place long, kind string, n int, longer boolean, key string")
    return stored(keys.withColumn("key", F.xxhash64("kind", "key")).drop("kind"))


def _tasks(rows: int, each: int) -> int:
    return max(1, min(2048, -(-rows // each)))


def _met(first: DataFrame, then: DataFrame) -> DataFrame:
    """Pairs (a, b) of names of first and later ones of then (both as _keyed() gives them) that share a key; stored."""
    a, b = (keys.select("key", "longer", F.col("n").alias(f"{end}_n"), F.col("place").alias(end)) for end, keys in (("a", first), ("b", then)))
    one = a.where("longer").drop("longer").join(b.where("not longer").drop("longer"), "key").where("a < b")
    two = a.where("not longer").drop("longer").join(b.where("longer").drop("longer"), "key").where("a < b and a_n <> b_n")
    return stored(one.union(two).select("a", "b").distinct())


def _similar(pairs: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of names (place, kind, low) of one kind whose ratio is over `least`; stored."""
    import difflib

    def similar(batches):
        matcher = difflib.SequenceMatcher()
        for pdf in batches:
            keep, held = [], None
            for a, b in zip(pdf["a_low"], pdf["b_low"], strict=True):
                if b != held:  # what is known of the second name is kept for the next pair
                    matcher.set_seq2(held := b)
                matcher.set_seq1(a)
                keep.append(matcher.quick_ratio() > least and matcher.ratio() > least)
            yield pdf.loc[keep, ["a", "b"]]

    tasks = _tasks(pairs.count(), 10_000)
    for end in ("a", "b"):
        pairs = pairs.join(names.select(F.col("place").alias(end), F.col("low").alias(f"{end}_low"), F.col("kind").alias(f"{end}_kind")), end)
    pairs = pairs.where("a_kind = b_kind").select("a", "b", "a_low", "b_low").repartition(tasks, "b").sortWithinPartitions("b")
    return stored(pairs.mapInPandas(similar, "a long, b long"))


def _folded(links: DataFrame) -> DataFrame:
    """Rows (b, a) of places to merge for links (a, b), a before b: in order, a name that no kept one before it links
    to is kept, and another goes to the first kept one that does. Up to FOLD_LINKS links are passed in order at once; of
    more, in each round the names without an undecided link to one before them are kept, and of the first FOLD_AT_ONCE
    undecided ones those that a pass in order keeps."""
    import pandas as pd

    def leading(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["b", "a"])
        lost: set[int] = set()
        for a, b in zip(pdf["a"], pdf["b"], strict=True):  # a comes before b, so that it is decided
            if a not in lost:
                lost.add(b)
        return pd.DataFrame({"id": pd.Series(sorted(lost), dtype="int64")})

    undecided, gone = links, []
    while (number := undecided.count()) > FOLD_LINKS:
        ends = undecided.select(F.col("a").alias("id")).union(undecided.select("b")).distinct()
        ids = stored(ends.orderBy("id").limit(FOLD_AT_ONCE))
        inner = undecided.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
        lost = inner.groupBy().applyInPandas(leading, "id long")
        free = ends.join(undecided.select(F.col("b").alias("id")), "id", "left_anti")
        kept = stored(ids.join(lost, "id", "left_anti").union(free).distinct())
        merged = stored(undecided.join(kept.withColumnRenamed("id", "a"), "a", "left_semi").select("b").distinct())
        gone.append(merged)
        decided = kept.union(merged).withColumnRenamed("id", "a")
        undecided = stored(undecided.join(decided, "a", "left_anti").join(merged, "b", "left_anti"))
    if number:
        gone.append(undecided.groupBy().applyInPandas(leading, "id long").withColumnRenamed("id", "b"))
    if not gone:
        return links.select("b", "a")
    lost = stored(reduce(DataFrame.union, gone))
    return links.join(lost.withColumnRenamed("b", "a"), "a", "left_anti").groupBy("b").agg(F.min("a").alias("a"))


def _merged_names(names: DataFrame, least: float) -> DataFrame:
    """Rows (b, a) of the names (place, kind, low; each once in a kind) to merge. The first undecided names, some
    FOLD_AT_ONCE and twice as many each round, are folded among themselves, and all later ones are then held against
    those that stay: a name meets kept ones until one is like it, rather than all that are like it."""
    keys, size, into = _keyed(names, least), FOLD_AT_ONCE, []
    while left := (rest := keys.select("place").distinct()).count():
        while True:
            most = None if left <= size else int(rest.stat.approxQuantile("place", [size / left], size / left / 8)[0])
            block = keys if most is None else keys.where(F.col("place") <= most)
            pairs = _met(block, block)
            if size <= FOLD_AT_ONCE or pairs.count() <= PAIRS_AT_ONCE:
                break
            size = max(FOLD_AT_ONCE, size // 4)
        lost = stored(_folded(_similar(pairs, names, least)))
        into.append(lost)
        if most is None:
            break
        stay = block.join(lost.select(F.col("b").alias("place")), "place", "left_anti")
        later = keys.where(F.col("place") > most)
        hits = stored(_similar(_met(stay, later), names, least).groupBy("b").agg(F.min("a").alias("a")))
        into.append(hits)
        keys, size = stored(later.join(hits.select(F.col("b").alias("place")), "place", "left_anti")), size * 2
    return reduce(DataFrame.union, into) if into else names.select(F.col("place").alias("b"), F.col("place").alias("a"))


def resolve_people(nodes: DataFrame, least: float = 0.92) -> DataFrame:
    """Rows (old_id, new_id) of nodes to merge: people with one e-mail address, then names of a kind whose similarity
    ratio is over `least`, longest name first (then the smallest id). Equal names are one; the others are compared where
    they share a key that all pairs over the ratio share. Null names are like none."""
    key = F.lower(F.trim("email"))
    by = Window.partitionBy(key).orderBy(F.desc(F.length("name")), "node_id")
    first = nodes.where((F.col("kind") == "PERSON") & (F.coalesce(key, F.lit("")) != "")).select(F.col("node_id").alias("old_id"), F.first("node_id").over(by).alias("new_id"))
    by_mail = first.where("old_id <> new_id")

    rest = nodes.join(by_mail.select(F.col("old_id").alias("node_id")), "node_id", "left_anti").where(F.col("kind").isin("PERSON", "ORGANIZATION") & F.col("name").isNotNull())
    rest = stored(rest.select(F.col("node_id").cast("long").alias("node_id"), "kind", F.lower("name").alias("low"), F.length("name").alias("size")))
    names = rest.groupBy("kind", "low").agg(F.min(F.struct((-F.col("size")).alias("size"), F.col("node_id").alias("id"))).alias("m"))
    names = stored(stored(names.select("kind", "low", "m.*")).orderBy("size", "id", "kind").withColumn("place", F.monotonically_increasing_id()))  # longest first
    into = _merged_names(names, least)
    into = into.join(names.select(F.col("place").alias("a"), F.col("id").alias("into")), "a").select(F.col("b").alias("place"), "into")
    found = rest.join(names.select("kind", "low", "id", "place"), ["kind", "low"]).join(into, "place", "left")
    by_name = found.select(F.col("node_id").alias("old_id"), F.coalesce("into", "id").alias("new_id")).where("old_id <> new_id")
    return by_mail.unionByName(by_name)


def graph_namespace() -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_DNS, "graph")
