"""Benchmark decontamination by spaced seeds. DataFrame functions only.

Words are the lower-cased runs of letters and digits. A seed is a fixed mask over some words in a row; the words at its
set positions are hashed, so that substitutions at the others do not matter. The masks are complete: every stretch with
``LEAST_WORDS`` equal words and ``LEAST_SHARE`` of its words equal holds one of them with equal words at all its set
positions, however long it is (tests/llm/test_decontam.py proves it). Test and training hashes are joined; along each
diagonal with a hit the document is laid beside the benchmark item, and any stretch of the two with ``LEAST_WORDS``
equal words and ``LEAST_SHARE`` of its words equal is a leak. Reported is the one with the most equal words, of these
the shortest, of these the first.

Hashes come from chunks of ``CHUNK`` words, so a very long text costs its length and no more. What meets is slim:
(document, text hash, item, diagonal); only texts with a hit are read again to be laid beside items.

Items with fewer than ``LEAST_WORDS`` words are sought as a whole, word for word, however short they are.

Defined cases: null or empty texts and items leak nothing; items with equal words each count; repeated rows of a
document give one row for it; a null doc_id is a document of its own; no benchmark or no documents: no rows; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_small, materialise

#: Fixed masks of 5 words each; together they hit every stretch that meets the rule below.
MASKS = ("111011", "1100001011", "1000001000111")
LEAST_WORDS, LEAST_SHARE = 10, 0.75
#: Words whose seeds are hashed next to one another.
CHUNK = 256


def words(text: Column) -> Column:
    """The words, and one "" at the end if something else stands there."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+")


def _seed(w: Column, at: Column, mask: str, no: int) -> Column:
    return F.xxhash64(F.lit(no), *[F.get(w, at + k) for k, bit in enumerate(mask) if bit == "1"])


def benchmark_seeds(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(seed, item_id, at, size) of each item and mask; for short items the whole."""
    n = F.size("words")
    out = []
    for k, m in enumerate(MASKS):
        long = items.filter((n >= LEAST_WORDS) & (n >= len(m))).select("item_id", "words", F.explode(F.sequence(F.lit(0), n - len(m))).alias("at"))
        out.append(long.select(_seed(F.col("words"), F.col("at"), m, k).alias("seed"), "item_id", "at", n.alias("size")))
    for size in lengths:
        short = items.filter(n == size).withColumn("at", F.lit(0))
        out.append(short.select(_seed(F.col("words"), F.col("at"), "1" * size, 100 + size).alias("seed"), "item_id", "at", n.alias("size")))
    return reduce(DataFrame.unionByName, out).distinct()


def _hits(docs: DataFrame, seeds: DataFrame, shapes: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, h, item_id, diagonal, size): where a document's seeds meet an item's; item word p stands beside document
    word diagonal + p."""
    first, longest = min(len(m) for m, _ in shapes), max(len(m) for m, _ in shapes)
    n = F.size("w")
    text = docs.select(F.col("doc_id").alias("doc_id"), _hash().alias("h"), words(F.col("text")).alias("w")).filter(n >= first)
    chunks = text.select("doc_id", "h", "w", F.explode(F.sequence(F.lit(0), n - first, F.lit(CHUNK))).alias("c"))
    chunks = chunks.select("doc_id", "h", "c", F.slice("w", F.col("c") + 1, F.lit(CHUNK + longest - 1)).alias("part"))
    spots = chunks.select("doc_id", "h", "c", "part", F.explode(F.sequence(F.lit(0), F.least(F.size("part") - first, F.lit(CHUNK - 1)))).alias("k"))
    hashes = [F.when(F.col("k") + len(m) <= F.size("part"), _seed(F.col("part"), F.col("k"), m, no)) for m, no in shapes]
    spots = spots.select("doc_id", "h", (F.col("c") + F.col("k")).alias("i"), F.explode(F.array(*hashes)).alias("seed"))
    met = spots.join(checked_small(seeds), "seed")
    return met.select("doc_id", "h", "item_id", (F.col("i") - F.col("at")).alias("diagonal"), "size").distinct()


def _hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id, item_id, start (word of the document where the
    best stretch begins), matched and length (words of that stretch)."""
    clean = F.filter(words(F.col("text")), lambda w: w != "")
    items = materialise(benchmark.select(F.col("item_id").alias("item_id"), clean.alias("words")).filter(F.size("words") > 0), "items")
    lengths = sorted(r[0] for r in items.filter(F.size("words") < LEAST_WORDS).select(F.size("words")).distinct().collect())  # 1 to 9
    seeds = materialise(benchmark_seeds(items, lengths), "seeds")
    hits = materialise(_hits(docs, seeds, [(m, k) for k, m in enumerate(MASKS)] + [("1" * s, 100 + s) for s in lengths]), "hits")
    spots = checked_small(hits.select(F.col("doc_id").alias("d_id"), F.col("h").alias("d_h"), "item_id", "diagonal", "size"))
    texts = docs.select(F.col("doc_id").alias("doc_id"), _hash().alias("h"), F.col("text").alias("text"))
    met = texts.join(spots, (F.col("h") == F.col("d_h")) & F.col("doc_id").eqNullSafe(F.col("d_id")))
    start, skip = F.greatest("diagonal", F.lit(0)), F.greatest(-F.col("diagonal"), F.lit(0))
    met = met.select("doc_id", "item_id", "size", start.alias("from"), skip.alias("skip"), words(F.col("text")).alias("w"))
    met = met.select("doc_id", "item_id", "size", "from", "skip", F.slice("w", F.col("from") + 1, F.col("size") - F.col("skip")).alias("part"))
    met = met.join(checked_small(items), "item_id")
    beside = F.slice("words", F.col("skip") + 1, F.size("part"))
    met = met.withColumn("best", _stretch(F.arrays_zip(F.col("part").alias("a"), beside.alias("b"))))
    whole = F.col("best.all") == F.col("size")  # word for word, so a short item too
    best = F.when(whole, F.struct(F.col("size").alias("m"), F.col("size").alias("n"), F.lit(0).alias("at"))).otherwise(F.col("best.s"))
    found = met.withColumn("best", best).filter("best is not null").select("doc_id", "item_id", F.struct(F.col("best.m").alias("matched"), (-F.col("best.n")).alias("n"), (-(F.col("from") + F.col("best.at"))).alias("start")).alias("b"))
    found = found.groupBy("doc_id", "item_id").agg(F.max("b").alias("b"))
    return found.select("doc_id", "item_id", (-F.col("b.start")).alias("start"), F.col("b.matched").alias("matched"), (-F.col("b.n")).alias("length"))


def _stretch(pairs: Column) -> Column:
    """Of the stretches of word pairs that meet the rule, the one with the most equal words: m equal words of n, from word
    ``at``; null if there is none. ``all`` are the equal words of all pairs."""
    spots = F.filter(F.transform(pairs, lambda p, i: F.when(p["a"] == p["b"], i)), lambda i: i.isNotNull())
    nothing = F.lit(None).cast("struct<m:int,n:int,at:int>")

    def shortest(e: Column, c: Column) -> Column:
        """The shortest stretch with c equal words, if its share is enough."""
        ends = F.zip_with(F.slice(e, F.lit(1), F.size(e) - c + 1), F.slice(e, c, F.size(e) - c + 1), lambda x, y: F.struct((y - x + 1).alias("n"), x.alias("at")))
        best = F.array_min(ends)
        return F.when(c >= LEAST_SHARE * best["n"], F.struct(c.alias("m"), best["n"].alias("n"), best["at"].alias("at")))

    def longest(e: Column) -> Column:
        # a stretch with twice the least equal words can be cut in two of which one meets the rule, so these counts decide
        some = F.exists(F.sequence(F.lit(LEAST_WORDS), F.least(F.size(e), F.lit(2 * LEAST_WORDS - 1))), lambda c: shortest(e, c).isNotNull())
        best = F.aggregate(F.sequence(F.size(e), F.lit(LEAST_WORDS), F.lit(-1)), nothing, lambda acc, c: F.when(acc.isNotNull(), acc).otherwise(shortest(e, c)))
        return F.when((F.size(e) >= LEAST_WORDS) & some, best)

    def of(e: Column) -> Column:
        return F.struct(F.size(e).alias("all"), F.when(F.size(e) >= LEAST_WORDS, longest(e)).otherwise(nothing).alias("s"))

    # bound once: the equal words are the only element of an array
    return F.element_at(F.transform(F.array(spots), of), 1)
