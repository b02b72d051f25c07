import random
from collections import Counter, defaultdict

import numpy as np

from veilspan.llm import common, graph, neardup
from veilspan.llm.common import words_of


def brute(rows):
    sets = {}
    for doc, text in rows:
        w = words_of(text)
        sets[doc] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for d in sorted(sets):
        for x in sets[d]:
            where[x].append(d)
    for d, s in sets.items():
        for o, n in Counter(o for x in s for o in where[x] if o < d).items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed, families=25, size=12):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randint(0, 4000)
    rows, doc = [], 0
    for _ in range(families):
        base = [word() for _ in range(r.choice([4, 5, 8, 60, 150]))]
        for _ in range(r.randint(1, size)):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 5, 8])):
                copy[r.randrange(len(copy))] = word()
            rows.append((doc, " ".join(copy)))
            doc += r.randint(1, 3)
    r.shuffle(rows)
    return rows


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as n", "1 as component", "2 as digest")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}


def test_against_brute_force(spark):
    rows = corpus(1)
    assert got(spark, rows) == brute(rows)


def test_one_large_group_of_near_copies(spark):
    """Many copies of one base with few and with many edits: chains of links, and texts just under the limit."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for d in range(220):
        copy = list(base)
        for _ in range(r.choice([1, 2, 4, 5, 6])):
            copy[r.randrange(150)] = f"e{r.randint(0, 10**6)}"
        rows.append((d, " ".join(copy)))
    assert got(spark, rows) == brute(rows)


def test_cases(spark):
    five = "One two three four five"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "A  B"), (6, five), (7, "one TWO three\nfour five"), (8, "x " * 5000), (9, "x " * 5000), (10, "a b c"), (11, "Ä b"), (12, "ä b")]
    found = got(spark, rows)
    assert found == brute(rows)
    assert found[1] == (0, 1) and found[5] == (1, 4) and found[7] == (1, 6) and found[8] == (1, 8) and found[12][1] == 12
    same = spark.createDataFrame([(1, five), (1, five), (None, five), (2, five)], "doc_id long, text string")
    out = neardup.near_duplicates(same).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_leftovers_are_compared_in_blocks(spark, monkeypatch):
    """With one hub a bucket, what is unlike it goes to the blocks; the result is the same."""
    monkeypatch.setattr(neardup, "HUBS", 1)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "TEXT_BLOCK", 2)
    rows = corpus(2, 12, 9)
    assert got(spark, rows) == brute(rows)


def test_posterior_bounds():
    least = neardup.least_matches()
    assert len(least) == neardup.PERMUTATIONS // neardup.BATCH
    assert all(0 <= a < neardup.BATCH * (i + 1) for i, a in enumerate(least)) and least == sorted(least)
    assert 50 < least[-1] < 96


def test_no_link_is_lost_between_clusters(spark):
    """A bucket of strangers and two pairs, where the weaker link (1, 3) alone joins the pairs."""
    r = np.random.default_rng(1)
    base = r.integers(0, 256, neardup.PERMUTATIONS, dtype=np.uint8)

    def changed(sketch, at):
        out = sketch.copy()
        out[list(at)] += 101
        return out

    nodes = {1: base, 2: changed(base, range(4)), 3: changed(base, range(100, 118)), 4: changed(changed(base, range(100, 118)), range(50, 70))}
    nodes |= {100 + i: r.integers(0, 256, neardup.PERMUTATIONS, dtype=np.uint8) for i in range(60)}
    table = spark.createDataFrame([(i, [7], v.tobytes()) for i, v in nodes.items()], "doc_id long, bands array<long>, sketch binary")
    found = neardup.candidates(table).collect()
    assert all(x.m == int((nodes[x.a] == nodes[x.b]).sum()) for x in found)
    label = {i: i for i in nodes}
    for x in found:
        low, high = sorted((label[x.a], label[x.b]))
        label = {i: low if v == high else v for i, v in label.items()}
    assert {i for i, v in label.items() if v == 1} == {1, 2, 3, 4} and len(set(label.values())) == 61


def test_large_ids_beside_nulls_and_repeated_ids(spark):
    big = 1152921504606846977
    rows = [(None, "a b c d e f"), (big, "a b c d e f"), (big - 1, "u v w x y z"), (big + 5, "u v w x y z"), (None, None)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in out} == {(None, None), (big, big), (big - 1, big - 1), (big + 5, big - 1)}
    twice = [(1, "a b c d e f"), (1, "k l m n o p"), (2, "k l m n o p"), (3, "a b c d e f"), (4, "q r s t u v w"), (None, "a b c d e f")]
    out = neardup.near_duplicates(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out) == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 2, 2), (3, 2, 1), (4, 3, 4)]


def test_tables_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rows = corpus(3, 12, 9)
    assert got(spark, rows) == brute(rows)


def test_few_edges_take_one_table_and_many_give_the_same(spark, monkeypatch):
    r = random.Random(6)
    edges = [(r.randint(0, 400) - 9, r.randint(0, 400) - 9) for _ in range(330)] + [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5), (10**17 + 1, 10**17)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x, y in edges:
        if x != y:
            a, b = find(x), find(y)
            parent[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "a long, b long")
    written = []
    monkeypatch.setattr(graph, "materialise", lambda df, tag: written.append(tag) or common.materialise(df, tag))
    few = {x.node: x.component for x in graph.components(table).collect()}
    assert written == ["components"] and few == {x: find(x) for x in parent}
    monkeypatch.setattr(graph, "FEW", 0)
    assert {x.node: x.component for x in graph.components(table).collect()} == few and len(written) > 3
    assert graph.components(table.limit(0)).count() == 0


def test_round_by_round_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    rows = corpus(4, 12, 9)
    assert got(spark, rows) == brute(rows)
