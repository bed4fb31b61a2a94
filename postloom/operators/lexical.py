"""Lexical retrieval: a token table with stems and weights, boolean matching, cover-density ranks and snippets."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postloom.sources.tables import small_batches

# ---- fixed values: the words that an English text search leaves out, and the field weights ----
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being have "
    "has had having do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will "
    "just don should now"
).split()
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
# ---- end of fixed values ----
SNIPPET_WORDS, SNIPPET_FRAGMENTS = 15, 2


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def match_count(text: Column, terms: list[str]) -> Column:
    """How many of the terms a text holds."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.size(F.array_intersect(words, F.array(*map(F.lit, terms))))


def stem(word: str) -> str:
    """A light English stem: plural, -ed, -ing and -ly endings off, where a vowel is left."""
    for ending, least in (("sses", 2), ("ies", 2), ("ing", 3), ("ed", 3), ("ly", 3), ("s", 3)):
        if word.endswith(ending) and len(word) - len(ending) >= least and not word.endswith("ss") and re.search("[aeiouy]", word[: -len(ending)]):
            base = word[: -len(ending)]
            if ending == "sses":
                return base + "ss"
            if ending == "ies":
                return base + "i"
            if ending in ("ed", "ing") and len(base) > 2 and base[-1] == base[-2] and base[-1] not in "lsz":
                base = base[:-1]
            return base
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    held: dict[str, str] = {}

    def of(w: str) -> str:
        if w not in held:
            held[w] = stem(w)
        return held[w]

    return words.map(lambda ws: None if ws is None else [of(w) for w in ws])


def token_table(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Rows (key, lexeme, at, weight) of the fields (name to weight letter), stop words left out, places counted over all
    words of the fields laid end to end."""
    parts, before = [], F.lit(0)
    kept = rows
    for name in fields:
        kept = kept.withColumn(f"_{name}", tokens(F.coalesce(F.col(name), F.lit(""))))
    for name, weight in fields.items():
        parts.append(kept.select(key, F.posexplode(stems(F.col(f"_{name}"))).alias("at", "lexeme"), before.alias("shift"), F.lit(WEIGHTS[weight]).alias("weight")))
        before = before + F.size(f"_{name}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(key, "lexeme", (F.col("at") + F.col("shift")).alias("at"), "weight").where(~F.col("lexeme").isin(STOP_WORDS))


def postings(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Rows (key, lexeme, gaps, weights, n, top): what token_table() gives for a row and a lexeme as one posting, with the
    gaps between its places. They are gathered where the row is, so that no word is shuffled; rows that share a key have
    postings of their own."""
    small_batches(rows)
    kind = rows.schema[key].dataType.simpleString()
    kept = rows.select(F.col(key).alias("key"), *(tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"t{k}") for k, f in enumerate(fields)))
    letters = [WEIGHTS[w] for w in fields.values()]
    stop = set(STOP_WORDS)

    def gathered(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            ids: dict[str, int] = {}
            shift, parts = np.zeros(len(batch), np.int64), []
            for k, weight in enumerate(letters):
                words = batch.column(k + 1)
                size = np.asarray(pc.list_value_length(words)).astype(np.int64)
                row = np.repeat(np.arange(len(batch)), size)
                flat = words.flatten().dictionary_encode()
                stemmed_ = [stem(w) for w in flat.dictionary.to_pylist()]
                codes = np.array([-1 if w in stop else ids.setdefault(w, len(ids)) for w in stemmed_], np.int64)
                code = codes[np.asarray(flat.indices)] if len(row) else row
                parts.append((row, code, np.arange(len(row)) - (np.cumsum(size) - size)[row] + shift[row], np.full(len(row), weight)))
                shift += size
            row, code, at, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
            some = np.flatnonzero(code >= 0)
            some = some[np.lexsort((at[some], code[some], row[some]))]
            row, code, at, weight = row[some], code[some], at[some], weight[some]
            new = np.ones(len(some), bool)
            new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
            first = np.flatnonzero(new)
            ends = np.append(first, len(some))
            gaps = np.where(new, at, at - np.concatenate([[0], at[:-1]])) if len(at) else at
            top = np.maximum.reduceat(weight, first) if len(first) else weight
            lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x)
            columns = [batch.column(0).take(pa.array(row[first])), pa.array(list(ids), pa.string()).take(pa.array(code[first])), lists(pa.array(gaps, pa.int32())), lists(pa.array(weight)), pa.array(np.diff(ends), pa.int32()), pa.array(top)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "lexeme", "gaps", "weights", "n", "top"])

    return kept.mapInArrow(gathered, f"key {kind}, lexeme string, gaps array<int>, weights array<double>, n int, top double")


def matching(lexemes: Column, groups: list[list[str]]) -> Column:
    """Whether a list of lexemes has one of every group."""
    out = F.lit(True)
    for g in groups:
        out = out & F.arrays_overlap(lexemes, F.array(*map(F.lit, g)))
    return out


def expanded(query: str, synonyms: dict[str, list[str]], most: int = 2) -> list[list[str]]:
    """A query's words, each with some synonyms: all groups must match, any word of a group does."""
    out = []
    for w in re.findall(r"\w+", query.lower()):
        more = [s for s in synonyms.get(w, []) if s != w][:most] if len(w) > 2 else []
        out.append([w, *more])
    return out


def expanded_queries(queries: DataFrame, synonyms: DataFrame, most: int = 2) -> DataFrame:
    """Rows (query_id, expanded) of queries (query_id, query): all words, lower-cased and joined by &, each of more than two
    letters with up to `most` of its synonyms (word, synonym, place) in order of place, as (a | b | c). A blank query is
    given back as it is."""
    words = F.regexp_extract_all(F.lower(F.coalesce("query", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    each = queries.select("query_id", F.posexplode(words).alias("at", "word"))
    usable_ = synonyms.where((F.length("word") > 2) & (F.length("synonym") > 2) & (F.col("synonym") != F.col("word")) & ~F.contains("synonym", F.lit(" ")))
    listed = usable_.groupBy("word").agg(F.slice(F.transform(F.array_sort(F.collect_set(F.struct("place", "synonym"))), lambda x: x["synonym"]), 1, most).alias("more"))
    joined = each.join(listed, "word", "left")
    term = F.when(F.size("more") > 0, F.concat(F.lit("("), F.array_join(F.concat(F.array("word"), "more"), " | "), F.lit(")"))).otherwise(F.col("word"))
    texts = joined.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", term.alias("t")))).alias("l"))
    out = queries.join(texts, "query_id", "left")
    return out.select("query_id", F.coalesce(F.array_join(F.transform("l", lambda x: x["t"]), " & "), "query").alias("expanded"))


def density_of(hits: Iterable[tuple[int, int, float]], groups: int) -> float:
    """The rank of one text from its hits (place, group, weight) in order of place."""
    last: dict[int, tuple[int, float]] = {}
    total, ended = 0.0, -1
    for at, group, weight in hits:
        last[group] = (at, weight)
        if len(last) == groups:
            start = min(p for p, _ in last.values())
            if start > ended:  # a cover that starts after the one before it started
                ended = start
                mean = len(last) / sum(1 / w for _, w in last.values())
                total += mean / max(1.0, at - start + 1 - len(last) + 1)
    return total / (total + 1)


def cover_density(hits: DataFrame, key: str, groups: list[list[str]]) -> DataFrame:
    """Rows (key, rank) for token rows (key, lexeme, at, weight): the sum over minimal covers (the shortest stretches that
    hold a word of every group) of their mean weight over their excess length, as rank / (rank + 1). Only the query's
    words leave the token table."""
    group_of = {w: k for k, g in enumerate(groups) for w in g}
    wanted = hits.where(F.col("lexeme").isin(list(group_of)))
    listed = wanted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "lexeme", "weight"))).alias("w"))

    @F.pandas_udf("double")
    def density(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: density_of(((x["at"], group_of[x["lexeme"]], x["weight"]) for x in row), len(groups)))

    return listed.select(key, F.round(density("w"), 9).alias("rank")).where("rank > 0")


def stemmed(groups: list[list[str]]) -> list[list[str]]:
    """The groups' stems without stop words, which no token table holds; groups that are equal then are one, and those of stop
    words alone ask nothing."""
    stop = set(STOP_WORDS)
    return [list(g) for g in dict.fromkeys(tuple(sorted({stem(w) for w in g} - stop)) for g in groups) if g]


def _may_hold(text: Column, groups: list[list[str]]) -> Column:
    """Whether a text holds the beginning of a word of every group: no other text can match. A word begins with its stem,
    but for the stem's last letter."""
    out, low = F.lit(True), F.lower(text)
    for g in groups:
        out = out & reduce(lambda a, b: a | b, (F.contains(low, F.lit(s[:-1] if len(s) > 1 else s)) for s in g))
    return out


def ranked_search(rows: DataFrame, key: str, fields: dict[str, str], groups: list[list[str]], limit: int) -> DataFrame:
    """Rows (key, rank) of the best matches by cover density; groups of words, any of a group and all groups. Only texts
    that may match are cut into words."""
    wanted = stemmed(groups)
    if not wanted:
        return rows.select(key, F.lit(0.0).alias("rank")).where("false")
    joined = F.concat_ws(" ", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))
    near = rows.where(_may_hold(joined, wanted))
    return cover_density(token_table(near, key, fields), key, wanted).orderBy(F.desc("rank"), key).limit(limit)


def escaped_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def conversation_search(conversations: DataFrame, query: str, synonyms: dict[str, list[str]] | None = None, limit: int = 50) -> DataFrame:
    """Rows (conversation_id, subject, score, snippet) of the conversations whose subject and summary match best; the
    snippet is escaped for HTML. A blank query finds nothing."""
    groups = expanded(query, synonyms or {})
    rows = conversations.select("conversation_id", "subject", "summary")
    best = ranked_search(rows, "conversation_id", {"subject": "A", "summary": "B"}, groups, limit)
    text = F.concat(F.coalesce("subject", F.lit("")), F.lit(" | "), F.coalesce("summary", F.lit("")))
    shown = rows.join(F.broadcast(best), "conversation_id")  # at most limit rows
    return shown.select("conversation_id", F.coalesce("subject", F.lit("")).alias("subject"), F.col("rank").alias("score"), escaped_html(snippet(text, [w for g in groups for w in g])).alias("snippet"))


def snippet(text: Column, words: list[str]) -> Column:
    """Up to two fragments of some words around hits, hits in double brackets."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        wanted = {stem(w.lower()) for w in words}

        def of(t):
            if t is None:
                return None
            ws = t.split()
            hit = [stem(re.sub(r"\W", "", w.lower())) in wanted for w in ws]
            out, at = [], 0
            while at < len(ws) and len(out) < SNIPPET_FRAGMENTS:
                if hit[at]:
                    low = max(0, at - SNIPPET_WORDS // 3)
                    high = min(len(ws), low + SNIPPET_WORDS)
                    out.append(" ".join(f"[[{w}]]" if h else w for w, h in zip(ws[low:high], hit[low:high], strict=True)))
                    at = high
                else:
                    at += 1
            return " ... ".join(out)

        return texts.map(of)

    return cut(text)


def window_around(text: Column, word: Column, reach: int = 1000) -> Column:
    """The text within reach of a word's first place, or its beginning where the word is not there."""
    at = F.greatest(F.position(word, text), F.lit(1))
    return F.substring(text, F.greatest(at - reach, F.lit(1)), F.lit(2 * reach))
