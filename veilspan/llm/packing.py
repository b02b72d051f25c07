"""Best-fit packing by bin completion.

Only the *histogram* of piece lengths decides a packing: pieces of one length are interchangeable. The branch and
bound therefore works on at most ``capacity`` counts, whatever the corpus holds, and yields *patterns* (a multiset
of lengths that fills a sequence) with a multiplicity. Pieces then find their place by a join on (length, rank
among the pieces of that length). Ranks are dealt over hashed buckets, so one very common length is no hot task.

Defined cases: a null or empty text is the single end id; a null doc_id stays a document; repeated rows are
packed as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import hand_back, materialise, nullable, solid, text_batches

CAPACITY = 4096
#: Branch-and-bound nodes after the first dive; a fixed number, so that a packing never depends on the machine.
NODES = 6_000
#: Nodes of the path that keep their further fillings, and fillings that a node holds to test others for dominance.
LEVELS, HELD = 48, 32
#: Rank buckets for each length: N / 2000, at most this many (one bucket of a third of 3e10 rows: 1.2 million).
MOST_BUCKETS = 8192

Pattern = tuple[tuple[int, int], ...]


# ---------------------------------------------------------------- packing of a histogram


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: equal bins are handled as one class with a count."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []
    done: list[tuple[Pattern, int]] = []

    def put(room: int, held: dict[int, int], n: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((held, n))

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            k = bisect_right(rooms, length - 1)
            if k == len(rooms):
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    put(capacity - per * length, {length: per}, full)
                if rest:
                    put(capacity - rest * length, {length: rest}, 1)
                left = 0
                continue
            room = rooms[k]
            held, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            per = room // length
            full = min(n, left // per)
            if full:
                put(room - per * length, {**held, length: per}, full)
                left -= full * per
                n -= full
            if n and left:
                put(room - left * length, {**held, length: left}, 1)
                n, left = n - 1, 0
            if n:
                put(room, held, n)
    for classes in open_.values():
        done += [(tuple(sorted(held.items(), reverse=True)), n) for held, n in classes]
    return done


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: for a limit k, large pieces need bins of their own and the rest must fit."""
    lengths = np.array(sorted(hist), dtype=np.int64)
    if not len(lengths):
        return 0
    counts = np.array([hist[int(x)] for x in lengths], dtype=np.int64)
    number, weight = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = -(-int(weight[-1]) // capacity)
    half = np.searchsorted(lengths, capacity // 2, side="right")
    for k in [0, *(int(x) for x in lengths if x <= capacity // 2)]:
        big = np.searchsorted(lengths, capacity - k, side="right")
        small = np.searchsorted(lengths, k, side="left")
        n1, n2 = int(number[-1] - number[big]), int(number[big] - number[half])
        w2, w3 = int(weight[big] - weight[half]), int(weight[half] - weight[small])
        best = max(best, n1 + n2 + max(0, -(-(w3 - (n2 * capacity - w2)) // capacity)))
    return best


def dominated(a: Sequence[int], b: Sequence[int]) -> bool:
    """Whether filling a can be had from filling b by replacing pieces of b by groups of a that fit in them."""
    if sum(a) > sum(b):
        return False
    rooms = sorted(b, reverse=True)
    for x in sorted(a, reverse=True):
        k = next((i for i in range(len(rooms) - 1, -1, -1) if rooms[i] >= x), None)
        if k is None:
            return False
        rooms[k] -= x
        rooms.sort(reverse=True)
    return True


def fillings(lengths: list[int], counts: list[int], room: int, most: int, waste: int) -> Iterator[list[tuple[int, int]]]:
    """Every filling of a room whose waste is at most ``waste``, least waste first, each as (place, number) pairs in
    descending order of length. Lengths ascend, ``counts`` are those left, and places under ``most`` can be used.

    Sums that can be reached with the shortest k lengths are the bits of a number, so a filling is read off backwards
    and no step of it leads nowhere. A filling that is one piece of the whole room dominates all others."""
    most = min(most, bisect_right(lengths, room))
    places = [i for i in range(most) if counts[i]]
    if places and lengths[places[-1]] == room:
        yield [(places[-1], 1)]
        return
    mask, reach = (1 << (room + 1)) - 1, [1]
    for i in places:
        length, left, sums, step = lengths[i], min(counts[i], room // lengths[i]), reach[-1], 1
        while left:  # multiples of a length, doubled until all of its pieces are in
            n = min(step, left)
            sums |= (sums << (n * length)) & mask
            left, step = left - n, 2 * step
        reach.append(sums)

    def read(k: int, rest: int) -> Iterator[list[tuple[int, int]]]:
        if not rest:
            yield []
            return
        while k and not reach[k] >> rest & 1:  # never at the first call
            return
        # the longest length that has to or can be in it, with each number of it
        while k and lengths[places[k - 1]] > rest:
            k -= 1
        for j in range(k, 0, -1):
            if not reach[j] >> rest & 1:
                return
            i = places[j - 1]
            for n in range(min(counts[i], rest // lengths[i]), 0, -1):
                left = rest - n * lengths[i]
                if reach[j - 1] >> left & 1:
                    for more in read(j - 1, left):
                        yield [(i, n), *more]

    for total in range(room, max(-1, room - waste - 1), -1):
        if reach[-1] >> total & 1:
            yield from read(len(places), total)


def bin_completion(hist: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[tuple[Pattern, int]], int]:
    """Patterns with multiplicities, and the lower bound. The best-fit packing is the first incumbent; depth-first
    bin completion replaces it while it finds better, until the bound is met, everything is tried or ``nodes`` are spent.

    A node takes the largest piece left and completes its bin in every undominated way, least waste first; the waste that
    a better packing than the incumbent can still afford bounds the fillings. A completion is used as often as the
    counts allow at first, then once only, which makes the search complete. The fillings of a node are a generator, and only
    the last ``LEVELS`` nodes of the path keep theirs: the driver holds one set of counts and so many generators, whatever
    the depth. A path of up to ``LEVELS`` bins is searched to the end if the nodes suffice; of a longer one the first bins
    stay as the first dive laid them (least waste around the largest piece)."""
    hist = {int(k): int(v) for k, v in hist.items() if v}
    if any(not 0 < k <= capacity for k in hist):
        raise ValueError("piece lengths must be between 1 and the capacity")
    bound = lower_bound(hist, capacity)
    best = best_fit(hist, capacity)
    bins = sum(n for _, n in best)
    if bins == bound:
        return best, bound
    lengths = sorted(hist)
    counts = [hist[x] for x in lengths]
    half = bisect_right(lengths, capacity // 2)
    total, large = sum(n * x for x, n in hist.items()), sum(counts[half:])
    path: list[tuple[list[tuple[int, int]], int]] = []
    used = spent = 0

    def take(need: list[tuple[int, int]], m: int) -> None:
        nonlocal total, large, used
        for i, n in need:
            counts[i] -= n * m
            total -= n * m * lengths[i]
            large -= n * m if i >= half else 0
        used += m

    def options() -> Iterator[tuple[list[tuple[int, int]], int]]:
        top = len(counts) - 1
        while not counts[top]:
            top -= 1
        waste = (bins - 1 - used) * capacity - total
        held: list[list[int]] = []
        counts[top] -= 1
        ways = fillings(lengths, counts, capacity - lengths[top], top + 1, waste)
        while True:
            f = next(ways, None)
            if f is None:
                counts[top] += 1
                return
            flat = [lengths[i] for i, n in f for _ in range(n)]
            if any(dominated(flat, g) for g in held):
                continue
            if len(held) < HELD:
                held.append(flat)
            need: dict[int, int] = {top: 1}
            for i, n in f:
                need[i] = need.get(i, 0) + n
            counts[top] += 1
            m = min(counts[i] // n for i, n in need.items())
            for times in {m: 0, 1: 0}:
                yield list(need.items()), times
            counts[top] -= 1

    stack: deque[Iterator] = deque([options()])
    while stack and spent < nodes + len(lengths) and bins > bound:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if stack:
                need, m = path.pop()
                take(need, -m)
            continue
        spent += 1
        need, m = step
        take(need, m)
        if used + max(-(-total // capacity), large) >= bins:
            take(need, -m)
            continue
        path.append((need, m))
        if not total:
            best = [(tuple(sorted(((lengths[i], n) for i, n in p), reverse=True)), k) for p, k in path]
            bins = used
            path.pop()
            take(need, -m)
            continue
        stack.append(options())
        if len(stack) > LEVELS:
            stack.popleft().close()
    return best, bound


# ---------------------------------------------------------------- pieces


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids
    (binary, little-endian unsigned 32 bits). Only documents longer than ``capacity`` are cut."""
    path = path or tokens.default_path()
    text_batches(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokens.encoder(path)
        end = int(tokens.END_ID).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc, none, text in zip(batch["doc_id"].tolist(), batch["no_id"].tolist(), batch["text"], strict=True):
                ids = enc.ids(text if isinstance(text, str) else "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, none, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "no_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
        hand_back()

    schema = "doc_id long, no_id boolean, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return nullable(docs.select(*solid(F.col(id_col)), F.col(text_col).alias("text")).mapInPandas(cut, schema))


def pack_pieces(table: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """The (materialised) pieces with sequence_id and offset added.

    The driver receives the histogram: at most ``capacity`` rows. The table of places that is broadcast holds a
    row for each pattern and distinct length in it: patterns exhaust a length or a class each, so it is bounded by
    the capacity too, not by the corpus."""
    spark = table.sparkSession
    hist = {int(r["length"]): int(r["n"]) for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns, _ = bin_completion(hist, capacity, nodes)
    taken: dict[int, int] = {}
    places, base = [], 0
    for pattern, m in patterns:
        at = 0
        for length, n in pattern:
            a = taken.get(length, 0)
            places.append((length, a, a + n * m, n, base, at))
            taken[length] = a + n * m
            at += n * length
        base += m
    spots = spark.createDataFrame(places or [(0, 0, 0, 1, 0, 0)], "p_length long, p_from long, p_to long, p_each long, p_base long, p_at long")
    total = sum(hist.values())
    buckets = max(1, min(MOST_BUCKETS, -(-total // 2000)))
    slot = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).alias("bucket")
    dealt = table.withColumn("bucket", slot)
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("length"), F.col("bucket"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["length", "bucket"])
    rank = (F.col("r") + F.col("before")).alias("rank")
    ranked = ranked.select(*[c for c in table.columns], rank)
    placed = ranked.join(F.broadcast(spots), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to")))
    turn = F.col("rank") - F.col("p_from")
    return placed.select(
        *table.columns,
        (F.col("p_base") + F.floor(turn / F.col("p_each"))).cast("long").alias("sequence_id"),
        (F.col("p_at") + F.pmod(turn, F.col("p_each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with the sequence and the place there."""
    return pack_pieces(materialise(pieces(docs, path, capacity, with_ids), "pieces"), capacity)


def assemble(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids (binary). A group holds ``capacity`` ids at most."""
    row = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), row.alias("parts")).select(
        "sequence_id", "length", F.expr("aggregate(parts, cast('' as binary), (a, p) -> a || p.ids)").alias("ids"))
