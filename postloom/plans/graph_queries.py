"""Queries of the graph operators (G): customers, suppliers and parts as nodes; orders and lineitems as edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.operators import graph
from postloom.plans.registry import query, table
from postloom.sources.tables import stored


def _nodes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 4).alias("node_id"), F.col("c_name").alias("name"), F.lit("PERSON").alias("kind"), F.col("c_acctbal").alias("pagerank"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 4 + 1).alias("node_id"), F.col("s_name").alias("name"), F.lit("ORGANIZATION").alias("kind"), F.col("s_acctbal").alias("pagerank"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") * 4 + 2).alias("node_id"), F.col("p_name").alias("name"), F.lit("DOCUMENT").alias("kind"), F.col("p_retailprice").alias("pagerank"))
    return c.unionByName(s).unionByName(p)


def _edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem")
    rows = li.count()
    if rows > graph.TASK_ROWS * spark.sparkContext.defaultParallelism:  # so that a task's sort does not grow with the tables
        li, o = graph.dealt(li, rows, "l_orderkey"), graph.dealt(o, rows, "o_orderkey")
    li = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("edge_id"),
        (F.col("o_custkey") * 4).alias("source_id"),
        (F.col("l_suppkey") * 4 + 1).alias("target_id"),
        F.col("l_returnflag").alias("relation"),
        F.col("l_quantity").alias("weight"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_orderkey")).alias("conversation_id"),
    )


_NODES = """nodes AS (SELECT c_custkey * 4 AS node_id, c_name AS name, 'PERSON' AS kind, c_acctbal AS pagerank FROM customer
  UNION ALL SELECT s_suppkey * 4 + 1, s_name, 'ORGANIZATION', s_acctbal FROM supplier UNION ALL SELECT p_partkey * 4 + 2, p_name, 'DOCUMENT', p_retailprice FROM part)"""
_EDGES = """edges AS (SELECT l_orderkey * 16 + l_linenumber AS edge_id, o_custkey * 4 AS source_id, l_suppkey * 4 + 1 AS target_id, l_returnflag AS relation, l_quantity AS weight,
  CASE WHEN l_orderkey % 7 <> 0 THEN l_orderkey END AS conversation_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"WITH {_NODES} SELECT node_id, name, CAST(1.0 AS DOUBLE) AS similarity FROM nodes WHERE contains(lower(name), 'customer#00000001') OR contains(lower(name), 'supplier#00000002') ORDER BY pagerank DESC, node_id LIMIT 10")
def g01_find_entities(spark, sf_dir):
    return graph.find_entities(_nodes(spark, sf_dir), ["Customer#00000001", "Supplier#00000002"]).select("node_id", "name", "similarity")


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(
    f"""WITH {_NODES}, t AS (SELECT node_id, name, pagerank, {_TRI.format("name")} AS a, {_TRI.format("'suplier 000000012'")} AS b FROM nodes),
s AS (SELECT node_id, name, pagerank, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS similarity FROM t)
SELECT node_id, name, similarity FROM s WHERE similarity > 0.3 ORDER BY similarity DESC, pagerank DESC, node_id LIMIT 10"""
)
def g02_similar_entities(spark, sf_dir):
    return graph.similar_entities(_nodes(spark, sf_dir), "suplier 000000012").select("node_id", "name", "similarity")


def _hop(n: int, frontier: str, before: str) -> str:
    known = f"AND edge_id NOT IN ({before})" if before else ""
    return f"""o{n} AS (SELECT edge_id, target_id AS nxt FROM edges WHERE source_id IN ({frontier}) {known} ORDER BY weight DESC, edge_id LIMIT 100),
i{n} AS (SELECT edge_id, source_id AS nxt FROM edges WHERE target_id IN ({frontier}) {known} ORDER BY weight DESC, edge_id LIMIT 100),
h{n} AS (SELECT * FROM o{n} UNION ALL SELECT * FROM i{n})"""


@query(
    f"""WITH {_EDGES}, {_hop(1, "SELECT 40 UNION SELECT 9", "")}, {_hop(2, "SELECT nxt FROM h1 WHERE nxt NOT IN (40, 9)", "SELECT edge_id FROM h1")}
SELECT DISTINCT edge_id, 1 AS hop FROM h1 UNION ALL SELECT DISTINCT edge_id, 2 FROM h2"""
)
def g03_expand(spark, sf_dir):
    start = spark.createDataFrame([(40,), (9,)], "node_id long")
    edges = stored(_edges(spark, sf_dir).select("edge_id", "source_id", "target_id", "weight"))  # each hop reads them twice
    return graph.expand(edges, start, 2).select("edge_id", "hop")


@query(f"WITH {_EDGES} SELECT conversation_id, count(*) AS n FROM edges WHERE (source_id IN (40, 80) OR target_id IN (9, 13)) AND conversation_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def g04_conversations(spark, sf_dir):
    ids = spark.createDataFrame([(40,), (80,), (9,), (13,)], "node_id long")
    return graph.conversations_of(_edges(spark, sf_dir), ids, 50).withColumnRenamed("count", "n")


@query(
    f"""WITH {_EDGES}, e AS (SELECT conversation_id, source_id AS id FROM edges UNION ALL SELECT conversation_id, target_id FROM edges)
SELECT conversation_id, count(DISTINCT id) AS n_entities, array_to_string(list_sort(list(DISTINCT id)), ',') AS entities FROM e WHERE conversation_id IS NOT NULL GROUP BY 1"""
)
def g05_entity_sets(spark, sf_dir):
    e = _edges(spark, sf_dir).where("conversation_id is not null")
    ends = e.select("conversation_id", F.explode(F.array("source_id", "target_id")).alias("id"))
    out = ends.groupBy("conversation_id").agg(F.array_sort(F.collect_set("id")).alias("s"))
    return out.select("conversation_id", F.size("s").cast("long").alias("n_entities"), F.array_join("s", ",").alias("entities"))


@query(
    f"""WITH {_NODES}, {_EDGES} SELECT e.edge_id, s.name AS source, t.name AS target, s.name || ' ' || replace(lower(e.relation), '_', ' ') || ' ' || t.name AS fact
FROM edges e JOIN nodes s ON s.node_id = e.source_id JOIN nodes t ON t.node_id = e.target_id WHERE t.name = 'Supplier#000000003' ORDER BY e.edge_id LIMIT 100"""
)
def g07_facts(spark, sf_dir):
    n = _nodes(spark, sf_dir).select("node_id", "name")
    e = _edges(spark, sf_dir)
    target = n.where("name = 'Supplier#000000003'").select(F.col("node_id").alias("target_id"), F.col("name").alias("target"))
    both = e.join(F.broadcast(target), "target_id").join(n.select(F.col("node_id").alias("source_id"), F.col("name").alias("source")), "source_id")  # one named node
    fact = F.concat("source", F.lit(" "), F.replace(F.lower("relation"), F.lit("_"), F.lit(" ")), F.lit(" "), "target")
    return both.orderBy("edge_id").limit(100).select("edge_id", "source", "target", fact.alias("fact"))


_REL = "replace(replace(upper(trim(r)), ' ', '_'), '-', '_')"
_MAP = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in graph.SAME_RELATION.items())
_KNOWN = ", ".join(f"'{r}'" for r in graph.RELATIONS)


@query(
    f"""WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' sent to' WHEN 1 THEN 'works-for' WHEN 2 THEN 'Mentions' WHEN 3 THEN event_type ELSE 'paid by ' END AS r FROM events),
m AS (SELECT event_id, CASE {_REL} {_MAP} ELSE {_REL} END AS r FROM x)
SELECT event_id, CASE WHEN r IN ({_KNOWN}) THEN r ELSE 'RELATED_TO' END AS relation FROM m"""
)
def g09_relation(spark, sf_dir):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, " sent to").when(k == 1, "works-for").when(k == 2, "Mentions").when(k == 3, F.col("event_type")).otherwise("paid by ")
    return table(spark, sf_dir, "events").select("event_id", graph.relation(raw).alias("relation"))


@query(
    """WITH n AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name || repeat(' ', CAST(c_custkey % 2 AS INTEGER)) END AS name FROM customer UNION ALL SELECT c_name FROM customer)
SELECT DISTINCT name, first_value(name) OVER (PARTITION BY lower(trim(name)) ORDER BY length(name) DESC, name) AS canonical FROM n"""
)
def g11_canonical_names(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).otherwise(F.concat("c_name", F.repeat(F.lit(" "), (F.col("c_custkey") % 2).cast("int"))))
    return graph.canonical_names(c.select(name.alias("name")).unionByName(c.select(F.col("c_name").alias("name"))))


def _rank_rounds(rounds: int) -> str:
    sql = [
        f"{_EDGES}, n AS (SELECT source_id AS node_id FROM edges UNION SELECT target_id FROM edges), m AS (SELECT count(*) AS n FROM n)",
        "t AS (SELECT source_id, sum(weight) AS total FROM edges GROUP BY 1), l AS (SELECT e.source_id, e.target_id, sum(e.weight / t.total) AS share FROM edges e JOIN t USING (source_id) GROUP BY 1, 2)",
        "r0 AS (SELECT node_id, 1.0 / m.n AS rank FROM n, m)",
    ]
    for k in range(rounds):
        sql.append(
            f"""r{k + 1} AS (SELECT n.node_id, 0.15 / m.n + 0.85 * (coalesce(g.got, 0) + z.lost / m.n) AS rank FROM n CROSS JOIN m
  CROSS JOIN (SELECT coalesce(sum(rank), 0) AS lost FROM r{k} WHERE node_id NOT IN (SELECT source_id FROM t)) z
  LEFT JOIN (SELECT l.target_id AS node_id, sum(l.share * r.rank) AS got FROM l JOIN r{k} r ON r.node_id = l.source_id GROUP BY 1) g ON g.node_id = n.node_id)"""
        )
    return f"WITH {', '.join(sql)} SELECT node_id, round(rank, 6) AS rank FROM r{rounds}"


@query(_rank_rounds(6))
def g12_pagerank(spark, sf_dir):
    e = stored(_edges(spark, sf_dir).select("source_id", "target_id", "weight"))
    n = stored(e.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct())
    return graph.pagerank(n, e, 6).select("node_id", F.round("rank", 6).alias("rank"))


@query()
def g13_resolve_people(spark, sf_dir):
    """Merges of near-equal names; no SQL, as a greedy fold over similarity ratios has no relational form."""
    people = _nodes(spark, sf_dir).where("kind <> 'DOCUMENT'").withColumn("email", F.when(F.col("node_id") % 100 == 0, F.concat(F.lit("A@X.org"), (F.col("node_id") % 400).cast("string"))))
    return graph.resolve_people(people)


@query(
    f"""WITH {_EDGES}, m AS (SELECT edge_id, CASE WHEN source_id % 40 = 20 THEN source_id - 20 ELSE source_id END AS source_id, CASE WHEN target_id % 20 = 9 THEN target_id - 8 ELSE target_id END AS target_id, relation, weight FROM edges)
SELECT source_id, target_id, relation, round(sum(weight), 6) AS weight FROM m WHERE source_id <> target_id GROUP BY 1, 2, 3"""
)
def g14_merge_edges(spark, sf_dir):
    e = _edges(spark, sf_dir)
    c = e.select(F.col("source_id").alias("old_id")).distinct().where("old_id % 40 = 20").withColumn("new_id", F.col("old_id") - 20)
    s = e.select(F.col("target_id").alias("old_id")).distinct().where("old_id % 20 = 9").withColumn("new_id", F.col("old_id") - 8)
    return graph.merge_edges(e, c.unionByName(s))


@query(f"WITH {_EDGES} SELECT relation, count(*) AS n FROM edges GROUP BY relation ORDER BY n DESC, relation LIMIT 20")
def g15_schema_counts(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(20)


@query("SELECT doc_id, left(text, 4000) AS text FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS n FROM documents) WHERE n BETWEEN 21 AND 40")
def g16_contiguous_sample(spark, sf_dir):
    """Twenty documents in order after the first twenty: the sampling operator's offset and limit."""
    return table(spark, sf_dir, "documents").orderBy("doc_id").offset(20).limit(20).select("doc_id", F.left("text", F.lit(4000)).alias("text"))


@query(f"WITH {_EDGES} SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT conversation_id FROM edges WHERE conversation_id IS NOT NULL)")
def g17_without_edges(spark, sf_dir):
    e = _edges(spark, sf_dir).select(F.col("conversation_id").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(e, "o_orderkey", "left_anti")
