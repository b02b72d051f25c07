"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one codeword from each of ``BOOKS`` full-dimensional codebooks, fitted level by level to the
residuals of a bounded sample; codes are found by beam search. A search scores all codes by adding one table look-up
for each codebook, scaled by the stored ratio of the vector's norm to its reconstruction's, and reranks the best of
each block exactly, in double precision, on the original vectors.

Equal vectors are indexed once and expanded afterwards: a vector that a third of all rows share costs one code, and
its rows come back in the order of their ids. Queries go in chunks of a bounded number, each broadcast to the blocks of
the index (a chunk of 8192 queries of 64 doubles is 4 MB); the index is neither shuffled nor gathered.

Defined cases: null and zero vectors, vectors with null or non-finite components, and those whose length is not the
most common one take no part; rows that repeat both id and vector count once; fewer candidates than k: all of
them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BOOKS, WORDS, BEAM = 16, 256, 4
#: Vectors of the sample that the codebooks are fitted to.
SAMPLE = 8192
BLOCK = 8192
#: Reranked exactly in each block, for each query.
RERANK = 512
CHUNK = 8192
_SALTS = 12


@dataclass
class Codebooks:
    words: np.ndarray  # books x words x dimensions
    cross: np.ndarray  # inner products of all words, (books*words) x (books*words)

    @property
    def books(self) -> int:
        return self.words.shape[0]

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x books) and squared norms of the reconstructions. At each level the best ``beam`` partial sums
        of each vector stay."""
        m, k, d = self.words.shape
        n = len(x)
        dots = (x @ self.words.reshape(m * k, d).T).reshape(n, m, k)
        own = np.einsum("mkd,mkd->mk", self.words, self.words)
        cross = self.cross.reshape(m, k, m, k)
        codes = np.zeros((n, 1, 0), dtype=np.int64)
        error = np.zeros((n, 1), dtype=np.float32)  # |x - sum|^2 without |x|^2
        for level in range(m):
            step = own[level] - 2 * dots[:, None, level, :]
            for j in range(level):
                step = step + 2 * cross[j, codes[:, :, j], level]
            total = (error[:, :, None] + step).reshape(n, -1)
            b = min(beam, total.shape[1])
            best = np.argpartition(total, b - 1, axis=1)[:, :b] if b < total.shape[1] else np.tile(np.arange(b), (n, 1))
            error = np.take_along_axis(total, best, axis=1)
            codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], axis=1), (best % k)[:, :, None]], axis=2)
        first = np.argmin(error, axis=1)
        codes = codes[np.arange(n), first]
        sums = np.zeros((n, d), dtype=np.float32)
        for level in range(m):
            sums += self.words[level, codes[:, level]]
        return codes.astype(np.uint8), np.einsum("nd,nd->n", sums, sums)


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 5) -> Codebooks:
    """Residual k-means, one codebook after another; seeds are fixed rows of the sample."""
    x = np.ascontiguousarray(sample, dtype=np.float32)
    k = max(1, min(words, len(x)))
    rng = np.random.default_rng(7)
    out = np.zeros((books, k, x.shape[1]), dtype=np.float32)
    rest = x.copy()
    for level in range(books):
        c = rest[rng.permutation(len(rest))[:k]].copy()
        for _ in range(rounds):
            to = np.argmin(np.einsum("kd,kd->k", c, c) - 2 * rest @ c.T, axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, to, rest)
            n = np.bincount(to, minlength=k)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        to = np.argmin(np.einsum("kd,kd->k", c, c) - 2 * rest @ c.T, axis=1)
        out[level] = c
        rest -= c[to]
    flat = out.reshape(books * k, -1)
    return Codebooks(out, flat @ flat.T)


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _distinct(vectors: DataFrame, most: int) -> DataFrame:
    """(rep, vector, ids): each distinct vector once, with its least ids in order (``most`` at most: a search for
    fewer neighbours can't use more) and the first of them as its name. Dealt by salt first, for hot vectors."""
    rows = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit("salt")), F.lit(_SALTS)))
    for keys in (["vector", "salt"], ["vector"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
        rows = rows.withColumn("r", rank).filter(F.col("r") <= most).drop("r")
    ids = F.array_sort(F.collect_list("vec_id"))
    return rows.groupBy("vector").agg(ids.alias("ids")).select(F.col("ids")[0].alias("rep"), "vector", "ids")


class Index:
    """A table of blocks: reps, codes, scales and original vectors of at most ``BLOCK`` distinct vectors each."""

    def __init__(self, table: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"):
        spark = table.sparkSession
        vectors = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
        vectors = vectors.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull()).distinct()
        sizes = vectors.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        self.k, self.spark, self.dimensions = k, spark, sizes["d"] if sizes else 0
        self.vectors = vectors.filter(F.size("vector") == self.dimensions)
        # k + 1: a query's own row is among the ids of its vector
        self.distinct = materialise(_distinct(self.vectors, k + 1), "vectors")
        self.n = self.distinct.count()
        if not self.n:
            return
        share = min(1.0, SAMPLE / self.n)
        picked = self.distinct.filter(F.shiftrightunsigned(F.xxhash64("rep", F.lit("fit")), 32) <= int(share * (1 << 32)))
        sample = sorted((r["rep"], r["vector"]) for r in picked.select("rep", "vector").collect())
        self.books = fit(np.array([v for _, v in sample] or [self.distinct.first()["vector"]]))
        self.blocks = materialise(self._blocks(), "index")

    def _blocks(self) -> DataFrame:
        books = self.spark.sparkContext.broadcast(self.books)

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 512):
                    part = batch.iloc[at : at + 512]
                    x = np.stack(part["vector"].to_numpy()).astype(np.float64)
                    codes, norms = books.value.encode(x.astype(np.float32))
                    scale = np.sqrt(np.einsum("nd,nd->n", x, x) / np.maximum(norms, 1e-30)).astype(np.float32)
                    yield pd.DataFrame({"reps": [part["rep"].to_numpy(np.int64).tobytes()], "codes": [codes.tobytes()], "scales": [scale.tobytes()], "vectors": [x.tobytes()]})

        parts = max(1, -(-self.n // BLOCK))
        slim = self.distinct.select("rep", "vector").repartition(parts, "rep")
        return slim.mapInPandas(encode, "reps binary, codes binary, scales binary, vectors binary")

    def search(self, queries: Column) -> DataFrame:
        """(query_id, rank, vec_id, score): the k best found for each indexed row that the condition picks."""
        if not self.n:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        asked = materialise(self.vectors.filter(queries), "queries")
        chunks = max(1, -(-asked.count() // CHUNK))
        found = None
        for c in range(chunks):  # one pass over the index for each bounded chunk of queries
            mine = asked.filter(F.pmod(F.xxhash64("vec_id", F.lit("chunk")), F.lit(chunks)) == c).orderBy("vec_id").collect()
            part = materialise(self._scan(mine), "found")
            found = part if found is None else found.unionByName(part)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
        reps = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= self.k + 1).drop("r")
        rows = reps.join(self.distinct.select("rep", "ids"), "rep").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return rows.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")

    def _scan(self, queries: list) -> DataFrame:
        books, most, d = self.books, self.k + 1, self.dimensions
        given = self.spark.sparkContext.broadcast((np.array([r["vec_id"] for r in queries], dtype=np.int64), np.array([r["vector"] for r in queries], dtype=np.float64).reshape(len(queries), d), books.words))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, words = given.value
            m, k, _ = words.shape
            reps, scores = np.zeros((len(q), 0), dtype=np.int64), np.zeros((len(q), 0))

            def block(rows: list) -> None:
                nonlocal reps, scores
                names = np.concatenate([np.frombuffer(r.reps, dtype=np.int64) for r in rows])
                n = len(names)
                codes = np.concatenate([np.frombuffer(r.codes, dtype=np.uint8).reshape(-1, m) for r in rows]).T.astype(np.int64)
                scale = np.concatenate([np.frombuffer(r.scales, dtype=np.float32) for r in rows])
                x = np.concatenate([np.frombuffer(r.vectors, dtype=np.float64).reshape(-1, d) for r in rows])
                take, top = min(RERANK, n), min(most, n)
                got, exact = np.zeros((len(q), top), dtype=np.int64), np.zeros((len(q), top))
                flat = words.reshape(m * k, d)
                for at in range(0, len(q), 256):
                    tables = (q[at : at + 256].astype(np.float32) @ flat.T).reshape(-1, m, k)
                    for i in range(len(tables)):
                        s = tables[i, 0].take(codes[0])
                        for level in range(1, m):
                            s += tables[i, level].take(codes[level])
                        s *= scale
                        near = np.argpartition(-s, take - 1)[:take] if take < n else np.arange(n)
                        e = np.einsum("nd,d->n", x[near], q[at + i])
                        order = np.lexsort((names[near], -e))[:top]
                        got[at + i], exact[at + i] = names[near][order], e[order]
                reps, scores = np.concatenate([reps, got], axis=1), np.concatenate([scores, exact], axis=1)
                if reps.shape[1] > most:
                    for i in range(len(q)):
                        order = np.lexsort((reps[i], -scores[i]))[:most]
                        reps[i, :most], scores[i, :most] = reps[i, order], scores[i, order]
                    reps, scores = reps[:, :most].copy(), scores[:, :most].copy()

            held, size = [], 0
            for batch in batches:
                for row in batch.itertuples(index=False):
                    held.append(row)
                    size += len(row.reps) // 8
                    if size >= BLOCK:
                        block(held)
                        held, size = [], 0
            if held:
                block(held)
            for at in range(0, len(q), 2048):
                r, s = reps[at : at + 2048], scores[at : at + 2048]
                yield pd.DataFrame({"query_id": np.repeat(ids[at : at + 2048], r.shape[1]), "rep": r.ravel(), "score": s.ravel()})

        return self.blocks.mapInPandas(scan, "query_id long, rep long, score double")
