"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is its distinct five-word shingles. Signatures of 128 minima are cut into 32 bands of 4; a pair at
the similarity limit shares no band with probability 5e-6. Candidates come from the bands, are compared batch by
batch on signature bytes and dropped once the posterior probability that they reach the limit is below ``MISS``;
the survivors are verified on the full sets.

A bucket is never expanded into its pairs. Equal word sequences are one node. In each bucket every member meets a hub
(chosen anew in each band), and what is unlike it a second one; members that hang together by such pairs are one cluster.
Where a bucket still holds several clusters, their sketches are compared in blocks, and of the pairs that the signatures
don't rule out only those that join two clusters come out. So the clusters are those of all pairs of the buckets. Each
node's most similar partner is verified first, and the components of the verified links are contracted. Members of one
cluster that are still in different components are compared exactly, in blocks: those outside the largest component
against all, and only links come out. So a candidate pair is verified, or lies inside a component already, and a large group of copies costs a few links a member.

Defined cases: null or empty texts have no shingles and no links; a text of fewer than five words has its whole
sequence as one shingle; rows that share a doc_id are one node, whose links are those of the least of its texts (each row
still states the size of its own set); rows without a doc_id are never linked, have a null component and are kept; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_small, hand_back, materialise, nullable, release_heaps, solid, text_batches, worker_cache, words_of
from .graph import components

SHINGLE = 5
#: The limit as a fraction: 100 * intersection >= 75 * union.
LIMIT = (75, 100)
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
#: Probability of dropping, before the exact look, a pair that reaches the limit.
MISS = 1e-6
BATCH = 16
#: Hubs that a bucket's members meet one after another.
HUBS = 2
#: A side's rows in a block where sketches, and where texts are compared; a block of texts has about ``BLOCK_BYTES`` at most.
BLOCK, TEXT_BLOCK, BLOCK_BYTES = 512, 128, 4 << 20

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_seeds = np.random.default_rng(20240229)
_XOR = _seeds.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_MUL = _seeds.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_POWERS = _seeds.integers(0, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _seeds.integers(0, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def shingles(words: list[bytes]) -> np.ndarray:
    """The set as ascending 64-bit hashes."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    known = worker_cache("shingles", _Words)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h)
    if n < SHINGLE:
        return _mix(np.array([np.sum(h * _POWERS[:n], dtype=np.uint64) + np.uint64(n)], dtype=np.uint64))
    s = h[: n - SHINGLE + 1] * _POWERS[0]
    for k in range(1, SHINGLE):
        s = s + h[k : n - SHINGLE + 1 + k] * _POWERS[k]
    return np.unique(_mix(s))


def signature(of: np.ndarray) -> np.ndarray:
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    x = (of >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, ((x[at : at + 512, None] ^ _XOR) * _MUL).min(axis=0), out=low)
    return low


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), digest of the words, band keys and the signature's bytes."""
    text_batches(docs.sparkSession)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        shift = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            rows = []
            for doc, none, text in zip(batch["doc_id"].tolist(), batch["no_id"].tolist(), batch["text"], strict=True):
                words = words_of(text if isinstance(text, str) else None)
                s = shingles(words)
                if not len(s):
                    rows.append((doc, none, 0, None, None, None))
                    continue
                sig = signature(s)
                keys = _mix((sig.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64) + shift)
                mixed = (sig * np.uint32(0x9E3779B1)) >> np.uint32(24)
                rows.append((doc, none, len(s), xxhash.xxh3_128_digest(b" ".join(words)), keys.view(np.int64), mixed.astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "no_id", "n", "digest", "bands", "sketch"])
        hand_back()

    slim = docs.select(*solid(F.col("doc_id")), F.col("text").alias("text"))
    return nullable(slim.mapInPandas(of, "doc_id long, no_id boolean, n long, digest binary, bands array<long>, sketch binary"))


def least_matches(limit: float = LIMIT[0] / LIMIT[1], miss: float = MISS) -> list[int]:
    """After each batch, the fewest equal bytes with which a pair may still reach the limit: with fewer, the posterior
    probability of a similarity of at least the limit (uniform prior; unequal minima agree in a byte with
    probability 1/256) is below ``miss``."""
    s = (np.arange(4000) + 0.5) / 4000
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[s >= limit].sum() / w.sum() >= miss:
                out.append(m)
                break
    return out


def bayes():
    """A column function: two sketches to the number of equal bytes; -1 once a pair is pruned."""
    least = least_matches()

    @F.pandas_udf("int")
    def matches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            x = np.frombuffer(b"".join(a), dtype=np.uint8).reshape(-1, PERMUTATIONS)
            y = np.frombuffer(b"".join(b), dtype=np.uint8).reshape(-1, PERMUTATIONS)
            out = np.full(len(x), -1, dtype=np.int32)
            alive, total = np.arange(len(x)), np.zeros(len(x), dtype=np.int32)
            for k, need in enumerate(least):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                total = total + (x[alive, cut] == y[alive, cut]).sum(axis=1, dtype=np.int32)
                still = total >= need
                alive, total = alive[still], total[still]
            out[alive] = total
            yield pd.Series(out)
        hand_back()

    return matches


def survivors(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, m) of the candidate pairs that the signatures don't rule out."""
    sketches = nodes.select("doc_id", "sketch")
    both = pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x")), "a")
    both = both.join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", bayes()("x", "y").alias("m")).filter("m >= 0")


def verified(pairs: DataFrame, docs: DataFrame, limit: tuple[int, int] = LIMIT) -> DataFrame:
    """Those of the (materialised) pairs (a, b) whose full sets reach the limit. The documents are read once, next to
    the pairs' ids; each pair then meets by its own key, so a hub's partners are spread over all tasks."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").alias("text"))
    one = F.col("doc") == F.col("a")
    met = texts.join(checked_small(ends), "doc").groupBy("a", "b").agg(F.min(F.when(one, F.col("text"))).alias("x"), F.min(F.when(~one, F.col("text"))).alias("y"))
    text_batches(docs.sparkSession)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                s, t = shingles(words_of(x)), shingles(words_of(y))
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(common * limit[1] >= limit[0] * (len(s) + len(t) - common) and common > 0)
            yield batch.loc[keep, ["a", "b"]]
        hand_back()

    return met.mapInPandas(check, "a long, b long")


def candidates(nodes: DataFrame) -> DataFrame:
    """(a, b, m): pairs that the signatures don't rule out, whose components are those of all such pairs within a bucket.

    Each bucket's members meet a hub; those unlike it meet a second one. What lies in different clusters then, and shares
    a bucket, is compared in blocks, see ``_between``. The parts are written tables; a pair may stand in several."""
    rows = nodes.select(F.explode("bands").alias("key"), "doc_id")
    near = members = None
    for turn in range(HUBS):
        release_heaps(nodes.sparkSession)
        ordered = F.struct(F.xxhash64("doc_id", "key", F.lit(turn)).alias("o"), F.col("doc_id"))
        buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(ordered).alias("hub")).filter("size > 1")
        # written first: the join then has shuffles of its own, which Spark can split at a hot key, or none
        buckets = materialise(buckets.select("key", "size", F.col("hub.doc_id").alias("hub")), "hubs")
        shared = rows.join(checked_small(buckets.select("key", "hub")), "key").filter("doc_id <> hub")
        shared = materialise(shared.select("key", "doc_id", F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")), "buckets")
        if members is None:  # a bucket of two is done once they met
            wide = buckets.filter("size > 2")
            members = shared.select("key", "doc_id").join(checked_small(wide.select("key")), "key", "left_semi").unionByName(wide.select("key", F.col("hub").alias("doc_id")))
        found = materialise(survivors(shared.select("a", "b").distinct(), nodes), "near")
        near = found if near is None else near.unionByName(found)
        rows = materialise(shared.join(found, ["a", "b"], "left_anti").select("key", "doc_id").distinct(), "unlike")
        if rows.isEmpty():
            break
    return near.unionByName(_between(members, near, nodes))


def _between(members: DataFrame, near: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, m) that join clusters of near pairs: members (key, doc_id) of a bucket that lie in different clusters are
    compared by their sketches, those outside a bucket's largest cluster against all its members, in blocks. A block gives
    one pair at most for each two clusters that it joins."""
    labelled = _labelled(members, components(near), "doc_id", "c")
    parts = labelled.groupBy("key", "c").agg(F.count(F.lit(1)).alias("size"))
    mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("size", "c")).alias("top")).filter("kinds > 1")
    mixed = materialise(mixed.select("key", F.col("top.c").alias("top")), "mixed")
    tagged = materialise(labelled.join(checked_small(mixed), "key").select("key", "doc_id", "c", "top"), "tagged")
    rows = tagged.join(nodes.select("doc_id", "sketch"), "doc_id").select("key", "doc_id", "c", "top", "sketch")
    least = least_matches()
    release_heaps(nodes.sparkSession)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        names, place = np.unique(pdf["c"].to_numpy(), return_inverse=True)
        root = np.arange(len(names))
        mine, other = place[(pdf["side"] == 0).to_numpy()], place[(pdf["side"] == 1).to_numpy()]
        ids, its = x["doc_id"].to_numpy(), y["doc_id"].to_numpy()
        p = np.frombuffer(b"".join(x["sketch"]), dtype=np.uint8).reshape(-1, PERMUTATIONS)
        q = np.frombuffer(b"".join(y["sketch"]), dtype=np.uint8).reshape(-1, PERMUTATIONS)
        out = []
        for i in range(len(ids)):
            alive = np.flatnonzero(root[other] != root[mine[i]])
            total = np.zeros(len(alive), dtype=np.int32)
            for k, need in enumerate(least):
                cut = slice(k * BATCH, (k + 1) * BATCH)
                total = total + (q[alive, cut] == p[i, cut]).sum(axis=1, dtype=np.int32)
                still = total >= need
                alive, total = alive[still], total[still]
                if not len(alive):
                    break
            for j, m in zip(alive.tolist(), total.tolist(), strict=True):
                a, b = root[mine[i]], root[other[j]]
                if a != b:
                    root[root == b] = a
                    out.append((min(ids[i], its[j]), max(ids[i], its[j]), m))
        return pd.DataFrame(out, columns=["a", "b", "m"]).astype({"a": "int64", "b": "int64", "m": "int32"})

    blocks = _blocks(rows.filter("c <> top"), rows, "key", ["doc_id", "c", "sketch"], F.ceil(F.count(F.lit(1)) / BLOCK))
    return materialise(blocks.groupBy("key", "lb", "rb").applyInPandas(compare, "a long, b long, m int").distinct(), "between")


def _blocks(left: DataFrame, right: DataFrame, key: str, columns: list[str], number: Column) -> DataFrame:
    """Rows of two sides that meet by a key, in pairs of blocks: key, lb, rb, side and the columns. ``number`` is the
    number of blocks of a side's group, an aggregate. A side's row stands once for each block of the other side."""
    sizes = [rows.groupBy(key).agg(number.cast("int").alias(name)) for rows, name in ((left, "ln"), (right, "rn"))]
    sizes = materialise(sizes[0].join(sizes[1], key), "blocks")

    def side(rows: DataFrame, own: str, other: str, mine: str, theirs: str, no: int) -> DataFrame:
        rows = rows.join(checked_small(sizes), key).withColumn(mine, F.pmod(F.xxhash64("doc_id"), F.col(own)).cast("int"))
        rows = rows.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return rows.select(key, "lb", "rb", F.lit(no).alias("side"), *columns)

    return side(left, "ln", "rn", "lb", "rb", 0).unionByName(side(right, "rn", "ln", "rb", "lb", 1))


def _across(clusters: DataFrame, labels: DataFrame, docs: DataFrame, limit: tuple[int, int] = LIMIT) -> DataFrame:
    """Links between different components of one cluster of near candidates, exactly: the members outside a cluster's
    largest component against all of its members, in blocks. A member's first link to each component is enough."""
    members = _labelled(clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), labels)
    parts = members.groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("size"))
    mixed = parts.groupBy("cluster").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("size", "c")).alias("top")).filter("kinds > 1")
    tagged = materialise(members.join(mixed.select("cluster", F.col("top.c").alias("top")), "cluster").select("cluster", "doc_id", "c", "top"), "mixed")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("text"))
    whole = texts.join(checked_small(tagged), F.col("_id") == F.col("doc_id")).groupBy("cluster", "doc_id", "c", "top").agg(F.min("text").alias("text"))
    whole = materialise(whole, "texts")
    release_heaps(docs.sparkSession)

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        sets = [shingles(words_of(t)) for t in y["text"]]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        owners = np.repeat(np.arange(len(sets)), sizes)
        every = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        order = np.argsort(every, kind="stable")
        every, owners = every[order], owners[order]
        ids, comps = y["doc_id"].to_numpy(), y["c"].to_numpy()
        out = []
        for doc, comp, text in zip(x["doc_id"], x["c"], x["text"], strict=True):
            s = shingles(words_of(text))
            lo, hi = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(s) else np.empty(0, dtype=np.int64)
            common = np.bincount(owners[at], minlength=len(sets))
            good = (common * limit[1] >= limit[0] * (len(s) + sizes - common)) & (comps != comp) & (common > 0)
            _, first = np.unique(comps[good], return_index=True)
            out += [(min(doc, o), max(doc, o)) for o in ids[good][first]]
        return pd.DataFrame(out, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})

    number = F.greatest(F.ceil(F.count(F.lit(1)) / TEXT_BLOCK), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES))
    blocks = _blocks(whole.filter("c <> top"), whole, "cluster", ["doc_id", "c", "text"], number)
    return blocks.groupBy("cluster", "lb", "rb").applyInPandas(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    feats = materialise(features(docs), "features")
    named = feats.filter("doc_id is not null and n > 0")
    several = named.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b")
    if not several.isEmpty():
        return _repeated_ids(docs, feats)
    return _linked(docs, feats)


def _repeated_ids(docs: DataFrame, feats: DataFrame) -> DataFrame:
    """The same where a doc_id stands for several texts: the least of them stands for all."""
    one = materialise(docs.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("text").alias("text")), "least")
    of = _linked(one, materialise(features(one), "features")).select(F.col("doc_id").alias("_id"), "component_id", "kept")
    rows = feats.select("doc_id", F.col("n").alias("n_shingles")).join(of, F.col("doc_id") == F.col("_id"), "left")
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce("kept", F.lit(True)).alias("kept"))


def _linked(docs: DataFrame, feats: DataFrame) -> DataFrame:
    named = feats.filter("doc_id is not null and n > 0")
    first = materialise(named.groupBy("digest").agg(F.min("doc_id").alias("rep")), "first")
    joined = named.join(first, "digest").filter("doc_id = rep").select("doc_id", "bands", "sketch")
    nodes = materialise(joined, "nodes")
    near = candidates(nodes)
    release_heaps(docs.sparkSession)
    # each node's most similar partner first, then the hubs' other pairs where they still join two components
    ends = near.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("o"), "m"), F.struct(F.col("b").alias("n"), F.col("a").alias("o"), "m"))).alias("e"))
    best = ends.groupBy("e.n").agg(F.max(F.struct("e.m", "e.o")).alias("best"))
    best = materialise(best.select(F.least("n", "best.o").alias("a"), F.greatest("n", "best.o").alias("b")).distinct(), "best")
    links = materialise(verified(best, docs), "links")
    labels = components(links)
    release_heaps(docs.sparkSession)
    rest = materialise(_apart(near.select("a", "b").join(best, ["a", "b"], "left_anti"), labels).distinct(), "rest")
    more = materialise(verified(rest, docs), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    release_heaps(docs.sparkSession)
    more = materialise(_across(components(near), labels, docs), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    members = feats.select("doc_id", "n", "digest").join(first, "digest", "left")
    rep = F.when(F.col("n") > 0, F.col("rep"))
    whole = members.select("doc_id", "n", rep.alias("node")).join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", out: str = "c") -> DataFrame:
    """The rows with the component of ``id_col``, itself if it has none."""
    table = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return rows.join(table, F.col(id_col) == F.col("_n"), "left").withColumn(out, F.coalesce("_c", id_col)).drop("_n", "_c")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    return _labelled(_labelled(pairs, labels, "a", "ca"), labels, "b", "cb").filter("ca <> cb").select("a", "b")
