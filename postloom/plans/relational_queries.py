"""Queries of the plain relational operators: aggregates (A), joins (J), orders (O), sets (U) and reads of threads (Q)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom.plans.registry import query, table
from postloom.sources.tables import small_batches

_SHARES, _TASKS = 32, 256  # of a nation's customers, and of a join of many pairs
SHARE_ROWS = 1 << 16  # of a table that pairs with itself
PAIRS = 1 << 16  # of a batch


@query("SELECT lang, count(*) AS n, count(text) AS n_text, count(DISTINCT source) AS n_sources FROM documents GROUP BY lang")
def a01_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count("text").alias("n_text"), F.countDistinct("source").alias("n_sources"))


@query(
    """SELECT source, count(*) AS n, count(*) FILTER (WHERE length(text) > 500) AS n_long, sum(CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END)::BIGINT AS n_the,
    round(100.0 * count(*) FILTER (WHERE contains(text, '@')) / count(*), 4) AS share_at FROM documents GROUP BY source"""
)
def a02_conditional(spark, sf_dir):
    long_, the, at = F.length("text") > 500, F.contains(F.lower("text"), F.lit("the")), F.contains("text", F.lit("@"))
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg(F.count("*").alias("n"), F.count_if(long_).alias("n_long"), F.count_if(the).alias("n_the"), F.round(F.lit(100.0) * F.count_if(at) / F.count("*"), 4).alias("share_at"))
    )


@query(
    """SELECT lang, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 4) AS mean, percentile_cont(0.5) WITHIN GROUP (ORDER BY length(text)) AS median
FROM documents GROUP BY lang"""
)
def a03_length_stats(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), F.round(F.avg(n), 4).alias("mean"), F.median(n).alias("median"))


_BOUNDS = [("under_50", 0, 49), ("to_100", 50, 100), ("to_500", 100, 500), ("to_1000", 500, 1000)]


@query(
    "SELECT "
    + ", ".join(f"count(*) FILTER (WHERE length(text) BETWEEN {a} AND {b}) AS {n}" for n, a, b in _BOUNDS)
    + ", count(*) FILTER (WHERE length(text) > 1000) AS over_1000 FROM documents"
)
def a04_length_histogram(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").agg(*(F.count_if(n.between(a, b)).alias(name) for name, a, b in _BOUNDS), F.count_if(n > 1000).alias("over_1000"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def a05_top_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT conv_id, bool_or(role = 'system') AS has_system, bool_and(length(text) > 20) AS all_long FROM conversations GROUP BY conv_id")
def a06_bool_or(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("has_system"), F.bool_and(F.length("text") > 20).alias("all_long"))


@query("SELECT DISTINCT lang, source FROM documents")
def a07_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("SELECT conv_id, array_to_string(list(turn || ':' || role ORDER BY turn, role), ',') AS turns FROM conversations GROUP BY conv_id")
def a08_grouped_lists(spark, sf_dir):
    item = F.struct("turn", "role")
    turns = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"]))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(turns, ",").alias("turns"))


@query("SELECT o_orderkey, l_linenumber, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND l_quantity > 45")
def j01_inner(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp'1997-01-01'").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_linenumber", "l_extendedprice")


@query(
    """SELECT c.c_custkey, cn.n_name AS customer_nation, s.s_suppkey, sn.n_name AS supplier_nation FROM customer c JOIN supplier s ON s.s_nationkey = c.c_nationkey
JOIN nation cn ON cn.n_nationkey = c.c_nationkey JOIN nation sn ON sn.n_nationkey = s.s_nationkey WHERE c.c_acctbal > 9000 AND s.s_acctbal > 5000"""
)
def j02_aliased_double_join(spark, sf_dir):
    """All pairs of a nation: its customers are dealt into shares, each of which meets all its suppliers, so that neither
    a nation nor a small file is one task's work. Shares and tasks are fixed in number, as few bytes make many pairs."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000")
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    c = c.select("c_custkey", F.col("c_nationkey").alias("nation"), F.pmod(F.xxhash64("c_custkey"), F.lit(_SHARES)).alias("share"))
    s = s.select("s_suppkey", F.col("s_nationkey").alias("nation"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SHARES - 1).cast("long"))).alias("share"))
    c = c.join(n.select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("customer_nation")), "nation")
    s = s.join(n.select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("supplier_nation")), "nation")
    both = c.repartition(_TASKS, "nation", "share").join(s.repartition(_TASKS, "nation", "share"), ["nation", "share"])
    return both.select("c_custkey", "customer_nation", "s_suppkey", "supplier_nation")


@query("SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
def j03_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def j05_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def j07_correlated_count(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query(
    """SELECT s.p_partkey AS short_id, l.p_partkey AS long_id FROM part s JOIN part l ON s.p_partkey <> l.p_partkey AND length(s.p_name) <= length(l.p_name)
AND contains(' ' || lower(l.p_name) || ' ', ' ' || lower(s.p_name) || ' ')"""
)
def j08_whole_word_join(spark, sf_dir):
    """Names that hold another name as whole words: joined on the longer one's runs of words, a bounded number for a name,
    so that only pairs of the result meet. Rows are dealt into shares of SHARE_ROWS, and a name's rows of a share are one
    list; lists meet, and those that met are dealt to tasks anew, so that neither a name nor a small file is one task's
    work."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    words = F.split("name", " ")
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(words, i, j - i + 1), " "))))
    shares = max(1, -(-p.count() // SHARE_ROWS))

    def listed(rows, side):
        share = F.pmod(F.xxhash64("p_partkey"), F.lit(shares)).alias(f"{side}_share")
        return rows.groupBy("name", share).agg(F.collect_list("p_partkey").alias(f"{side}_ids"))  # at most a share

    long_ = p.select("p_partkey", F.explode(F.array_distinct(runs)).alias("name"))
    lists = listed(p, "short").join(listed(long_, "long"), "name").repartition(_TASKS, "name", "short_share", "long_share")
    kind = p.schema["p_partkey"].dataType.simpleString()
    return small_batches(lists).select("short_ids", "long_ids").mapInArrow(_paired, f"short_id {kind}, long_id {kind}")


def _paired(batches):
    """All pairs of two lists' unequal ids, some PAIRS a batch, however long the lists are."""
    import numpy as np
    import pyarrow as pa

    def pairs():
        for batch in batches:
            for short, long_ in zip(*batch.columns, strict=True):
                short, long_ = short.values.to_numpy(zero_copy_only=False), long_.values.to_numpy(zero_copy_only=False)
                for i in range(0, len(short), PAIRS):
                    some = short[i : i + PAIRS]
                    step = PAIRS // len(some)
                    for j in range(0, len(long_), step):
                        a, b = np.tile(some, len(long_[j : j + step])), np.repeat(long_[j : j + step], len(some))
                        kept = a != b
                        yield (a, b) if kept.all() else (a[kept], b[kept])

    held, size = [], 0
    for pair in pairs():
        held.append(pair)
        size += len(pair[0])
        if size >= PAIRS // 2:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["short_id", "long_id"])
            held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["short_id", "long_id"])


@query(
    """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.quality IS NOT DISTINCT FROM b.toxic AS same FROM (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0) a
FULL JOIN (SELECT doc_id, toxic FROM labels WHERE doc_id % 2 = 0) b USING (doc_id)"""
)
def j10_full_outer(spark, sf_dir):
    t = table(spark, sf_dir, "labels")
    a, b = t.where("doc_id % 3 <> 0").select("doc_id", "quality"), t.where("doc_id % 2 = 0").select("doc_id", "toxic")
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.col("quality").eqNullSafe(F.col("toxic")).alias("same"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def o01_top_k(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query(
    """WITH t AS (SELECT conv_id, max(CASE WHEN role = 'system' THEN turn END) AS last_system, count(*) OVER () AS total FROM conversations GROUP BY conv_id)
SELECT conv_id, last_system, total > 20 + 10 AS has_more FROM t ORDER BY last_system DESC NULLS LAST, conv_id LIMIT 10 OFFSET 20"""
)
def o02_page(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "system", F.col("turn"))).alias("last_system"))
    total = t.agg((F.count("*") > 30).alias("has_more"))  # one row
    return t.orderBy(F.desc_nulls_last("last_system"), "conv_id").offset(20).limit(10).crossJoin(F.broadcast(total))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u01_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT doc_id FROM labels INTERSECT SELECT vec_id FROM embeddings")
def u02_intersect(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id").intersect(table(spark, sf_dir, "embeddings").select("vec_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u03_except(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query(
    """WITH t AS (SELECT source, lang, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE contains(lower(source), '1') OR contains(lower(lang), 'e') GROUP BY source, lang)
SELECT source, lang, first_id, n FROM t ORDER BY n DESC, first_id LIMIT 20"""
)
def q01_thread_list(spark, sf_dir):
    hit = F.contains(F.lower("source"), F.lit("1")) | F.contains(F.lower("lang"), F.lit("e"))
    t = table(spark, sf_dir, "documents").where(hit).groupBy("source", "lang").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "first_id").limit(20).select("source", "lang", "first_id", "n")


@query(
    """SELECT conv_id, array_to_string(list_distinct(list(role ORDER BY turn)), ',') IS NOT NULL AS has_people, count(*) AS n_messages,
coalesce(max_by(text, turn), '(no messages)') AS last_text FROM conversations GROUP BY conv_id"""
)
def q02_thread(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id")
    return t.agg((F.size(F.collect_set("role")) > 0).alias("has_people"), F.count("*").alias("n_messages"), F.coalesce(F.max_by("text", "turn"), F.lit("(no messages)")).alias("last_text"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY (role = 'system'), turn) AS context FROM conversations GROUP BY conv_id")
def q03_context(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct((F.col("role") == "system").alias("late"), "turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("context"))


@query("SELECT event_type, ts, value, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running FROM events")
def n01_running_sum(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_type", "ts", "value", F.round(F.sum("value").over(by), 4).alias("running"))


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100")
def o03_random_sample(spark, sf_dir):
    """A random sample of fixed size that comes out the same each time: the order is a digest of a seed and the id."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(100)
