import itertools
import random
import zlib
from collections import Counter

import pytest

from veilspan.llm import packing, tokens


def capacity_used(patterns):
    return [sum(length * n for length, n in p) for p, _ in patterns]


@pytest.mark.parametrize("seed", range(8))
def test_bin_completion_uses_every_piece_and_never_overfills(seed):
    r = random.Random(seed)
    hist = Counter(r.choice([r.randint(1, 100), r.randint(30, 55), r.randint(45, 52)]) for _ in range(r.choice([5, 60, 900])))
    patterns, bound = packing.bin_completion(hist, 100)
    got = Counter()
    for p, m in patterns:
        for length, n in p:
            got[length] += n * m
    assert got == hist
    assert max(capacity_used(patterns)) <= 100
    assert bound <= sum(m for _, m in patterns) <= sum(m for _, m in packing.best_fit(hist, 100))


def exact(items, capacity):
    """Fewest bins, by trying them all."""
    items, best = sorted(items, reverse=True), len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_finds_the_optimum_of_small_cases(seed):
    r = random.Random(100 + seed)
    items = [r.randint(10, 60) for _ in range(11)]
    patterns, _ = packing.bin_completion(Counter(items), 100)
    assert sum(m for _, m in patterns) == exact(items, 100)


def test_branching_beats_best_fit():
    items = [44, 26, 30, 44, 26, 30, 6, 50, 44, 6, 50, 44]
    hist = Counter(items)
    patterns, _ = packing.bin_completion(hist, 100)
    assert sum(m for _, m in patterns) == exact(items, 100)


def test_dominance():
    assert packing.dominated((3, 2), (5,))
    assert not packing.dominated((5,), (3, 2))


def test_word_encoder_is_the_tokenizer():
    enc = tokens.encoder(tokens.default_path())
    for t in ["It's <|endoftext|> a", "x'S  y", "don't''s \"'s' 12½³ Ǆ İstanbul", "naïve—dash…", "a\x00b", "ﬁ", "é", "_a_b 'LL ''d", "", " ", "a\n\tb" * 50, "日本語 text"]:
        assert enc.ids(t) == enc._whole(t), t


def test_pack_places_everything(spark):
    texts = [(1, "the quick brown fox"), (2, None), (3, ""), (4, "word " * 9000), (5, "the quick brown fox"), (5, "the quick brown fox"), (None, "lone"), (7, "abc " * 4095)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumnRenamed("text", "text").selectExpr("doc_id", "text", "'x' as length", "1 as rank", "2 as bucket")
    rows = packing.pack(docs, with_ids=True).collect()
    enc = tokens.encoder(tokens.default_path())
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for doc, text in texts:
        whole = enc.ids(text) + (1).to_bytes(4, "little")
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        if doc != 5:
            assert b"".join(bytes(r.ids) for r in pieces) == whole
            assert [r.start for r in pieces] == [4096 * i for i in range(len(pieces))]
    assert len(by_doc[5]) == 2
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    whole = packing.assemble(packing.pack(docs, with_ids=True)).collect()
    assert sum(r.length for r in whole) == sum(r.length for r in rows) and all(len(r.ids) == 4 * r.length for r in whole)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("low", "high", "n"), [(1200, 1500, 3000), (700, 1600, 4000), (1024, 1700, 900)])
def test_search_beats_best_fit_where_that_misses_the_bound(low, high, n):
    r = random.Random(n)
    hist = Counter(r.randint(low, high) for _ in range(n))
    patterns, bound = packing.bin_completion(hist, 4096, 400)
    got = Counter()
    for p, m in patterns:
        for length, k in p:
            got[length] += k * m
    assert got == hist and max(capacity_used(patterns)) <= 4096
    assert bound <= sum(m for _, m in patterns) < sum(m for _, m in packing.best_fit(hist, 4096))


def test_fillings_are_all_of_them():
    lengths, counts = [3, 5, 7, 11], [4, 2, 3, 1]
    for room, waste in ((23, 0), (23, 3), (10, 10), (2, 2)):
        every = set()
        for k in itertools.product(*(range(c + 1) for c in counts)):
            total = sum(a * b for a, b in zip(k, lengths, strict=True))
            if room - waste <= total <= room:
                every.add(k)
        found = [tuple(dict(f).get(i, 0) for i in range(4)) for f in packing.fillings(lengths, counts, room, 4, waste)]
        sums = [sum(a * b for a, b in zip(k, lengths, strict=True)) for k in found]
        assert len(found) == len(set(found)) and set(found) == every and sums == sorted(sums, reverse=True)


def test_large_ids_beside_nulls(spark):
    big = 1152921504606846977
    docs = spark.createDataFrame([(None, "a"), (big, "b"), (big + 2, None)], "doc_id long, text string")
    assert {r.doc_id for r in packing.pack(docs).collect()} == {None, big, big + 2}
