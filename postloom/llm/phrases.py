"""Phrase collocations: word-id suffix arrays by shard, n-gram counts from their LCP intervals, merged by key.

Texts are lower-cased (A-Z) and split at [.,;:!?\\x0A-\\x0D] into pieces and those into words [^\\x20\\x09]+. Each task cuts
its texts into shards of some SHARD_BYTES by language, codes words as ids, sorts the places by prefix doubling and reads
the counts of n-grams off the LCP intervals (suffix_counts.py). Counts are summed over shards by (lang, phrase), the
phrase as text, so that they are exact.

Three passes keep the shuffles small: words; pairs of words that are frequent; n-grams of three and four whose pairs are
frequent. An n-gram is never more frequent than its parts, so that nothing is lost. Frequent words and pairs reach the
shards as bitmaps, which are only filters: one that fills up (beyond some 10^7 keys) lets more rows into the sums.

Edge cases: a null or empty text has no words; a null lang is `und`, together with texts of that lang. Equal rows count
each. Texts longer than a shard are cut between words, with the three next words seen by the slice before. Extra columns
are ignored, doc_id is not looked at, and an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm import kernels as K
from postloom.llm.common import bitmap_of, bits_for, small_batches, stored, union
from postloom.llm.suffix_counts import Shard, ngram_counts, run_lengths, text_shards

SHARD_BYTES = 6 << 20
WORDS = 4
LEAST = 30
KEEP = 2000
BUCKETS = 32
_COUNTED = "lang string, phrase string, n long"


def _keys(lang: str, phrases: pa.Array) -> np.ndarray:
    """64-bit hashes by which bitmaps know the phrases of a language."""
    data, offsets, _ = K.binary(phrases)
    name = np.frombuffer(lang.encode(), np.uint8)
    seed = K.span_hashes(name, np.array([0]), np.array([len(name)]))[0]
    return K.mix(K.span_hashes(data, offsets[:-1], offsets[1:]) ^ seed, 11)


def _bitmap(counted: DataFrame) -> np.ndarray:
    """A bitmap of the rows' (lang, phrase)."""

    def hashed(batches):
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            codes = np.asarray(langs.indices)
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.column(1).filter(pa.array(codes == k))
                yield pa.RecordBatch.from_arrays([pa.array(_keys(lang, own).view(np.int64))], ["h"])

    return bitmap_of(counted.select("lang", "phrase").mapInArrow(hashed, "h long"), "h", bits_for(counted.count()))


def _rows(lang: str, phrases: pa.Array, counts: np.ndarray, most: int = 1 << 16):
    for at in range(0, len(phrases), most):
        part = phrases.slice(at, most)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, pa.array(counts[at : at + most])], ["lang", "phrase", "n"])


def _word_counts(texts: DataFrame, shard_bytes: int) -> DataFrame:
    """Each language's words with their number in each shard; the words of a shard together have a null phrase."""

    def counted(batches):
        for lang, shard in text_shards(batches, shard_bytes, 0):
            counts = shard.word_counts()
            yield from _rows(lang, shard.words, counts)
            yield from _rows(lang, pa.array([None], pa.string()), np.array([counts.sum()]))

    return texts.mapInArrow(counted, _COUNTED)


def _gram_counts(texts: DataFrame, words: np.ndarray, pairs: np.ndarray | None, most: int, shard_bytes: int) -> DataFrame:
    """The n-grams of each shard with their number: pairs of words that the bitmap words has, or, with the bitmap pairs,
    n-grams of 3 to most words all of whose pairs it has."""
    shared = texts.sparkSession.sparkContext.broadcast((words, pairs))

    def known(bitmap: np.ndarray, lang: str, phrases: pa.Array) -> np.ndarray:
        return K.in_bitmap(bitmap, _keys(lang, phrases)) if len(phrases) else np.zeros(0, bool)

    def counted(batches):
        words, pairs = shared.value
        for lang, shard in text_shards(batches, shard_bytes, most - 1):
            shard.keep_words(known(words, lang, shard.words))
            lengths, low, high = run_lengths(shard.ids > 0, 2), 2, 2
            if pairs is not None:
                lengths, low, high = run_lengths(_frequent_pairs(shard, lengths, lambda phrases, lang=lang: known(pairs, lang, phrases)), most - 1) + 1, 3, most
            for n, places, counts in ngram_counts(shard, low, high, lengths):
                yield from _rows(lang, shard.texts(places, n), counts)

    return texts.mapInArrow(counted, _COUNTED)


def _frequent_pairs(shard: Shard, lengths: np.ndarray, known) -> np.ndarray:
    """Whether each place begins a pair of words that is known."""
    places = np.flatnonzero(lengths >= 2)
    key = shard.ids[places] * (len(shard.words) + 1) + shard.ids[places + 1]
    _, first, pair = np.unique(key, return_index=True, return_inverse=True)
    out = np.zeros(len(shard.ids), bool)
    out[places] = known(shard.texts(places[first], 2))[pair]
    return out


def phrase_counts(docs: DataFrame, most: int = WORDS, least: int = LEAST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows (lang, phrase, n): every phrase of 1 to most words with at least `least` occurrences in its language; a null
    phrase stands for all words of the language. Stored."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text"))
    frequent = (F.col("n") >= least) | F.col("phrase").isNull()

    def merged(counted: DataFrame) -> DataFrame:
        return stored(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(frequent))

    found = [merged(_word_counts(texts, shard_bytes))]
    words = _bitmap(found[0].where("phrase IS NOT NULL"))
    if most > 1:
        found.append(merged(_gram_counts(texts, words, None, most, shard_bytes)))
    if most > 2:
        found.append(merged(_gram_counts(texts, words, _bitmap(found[1]), most, shard_bytes)))
    return union(found)


def collocations(docs: DataFrame, most: int = WORDS, least: int = LEAST, keep: int = KEEP, inside: int = 80, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each language's `keep` best phrases of 2 to most words: (lang, rank, phrase, a, l, r, n, score).

    Cutting a phrase of a occurrences after its first k words gives parts of l and r occurrences, and the score
    floor(2000000 * a / (l + r)); the cut of lowest score counts, then the smallest k. Phrases that lie inside a longer one
    with at least `inside` per cent of their occurrences are left out."""
    counts = phrase_counts(docs, most, least, shard_bytes)
    known = counts.where("phrase IS NOT NULL")
    parts = F.split("phrase", " ")
    found = known.select("lang", "phrase", F.col("n").alias("a"), parts.alias("w")).where(F.size("w") > 1)

    def joined(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    part = known.select(F.col("lang").alias("in_lang"), F.col("phrase").alias("part"), F.col("n").alias("f"))
    cuts = cuts.join(part.withColumnRenamed("f", "l"), (F.col("lang") == F.col("in_lang")) & (F.col("first") == F.col("part"))).drop("in_lang", "part")
    cuts = cuts.join(part.withColumnRenamed("f", "r"), (F.col("lang") == F.col("in_lang")) & (F.col("rest") == F.col("part"))).drop("in_lang", "part")
    score = F.expr("cast(a AS decimal(20,0)) * 2000000BD div (cast(l AS decimal(20,0)) + r)")  # exact beyond 64 bits
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda at: F.array_join(F.slice("w", at, n), " "))))
    longest = found.where(F.size("w") > 2).select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("outer")).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    mostly_inside = F.expr(f"coalesce(cast(outer AS decimal(20,0)) * 100 >= cast(a AS decimal(20,0)) * {int(inside)}, false)")
    left = scored.join(longest, ["lang", "phrase"], "left").where(~mostly_inside)
    left = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))

    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS)))  # so that no task ranks a language alone
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*best))).where(F.col("rank") <= keep)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= keep)
    return left.join(counts.where("phrase IS NULL").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
