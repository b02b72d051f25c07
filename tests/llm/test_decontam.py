import random

from veilspan.llm import common, decontam

WORDS = [f"word{i}" for i in range(3000)]


def brute(docs, items):
    """Every diagonal of every pair, without seeds."""
    out = set()
    split = lambda t: [w for w in "".join(c.lower() if c.isalnum() else " " for c in t or "").split()]
    for d, text in docs:
        a = split(text)
        for k, item in items:
            b = split(item)
            if not b:
                continue
            for shift in range(-len(b) + 1, len(a)):
                same = [a[shift + p] == b[p] for p in range(len(b)) if 0 <= shift + p < len(a)]
                s = m = n = 0
                best = (0, 0, 0)
                for x in same:
                    if s <= 0:
                        s = m = n = 0
                    s, m, n = s + (1 if x else -1), m + x, n + 1
                    best = max(best, (s, m, n), key=lambda t: t[0])
                if (best[1] >= decontam.LEAST_WORDS and best[1] >= decontam.LEAST_SHARE * best[2]) or best[1] == len(b):
                    out.add((d, k))
    return out


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as words", "3 as seed")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    return {(r.doc_id, r.item_id): r for r in decontam.leaks(d, b).collect()}


def test_against_brute_force(spark):
    r = random.Random(3)
    text = lambda n: [r.choice(WORDS) for _ in range(n)]
    items = [(i, " ".join(text(r.choice([1, 2, 4, 6, 9, 15, 30, 50])))) for i in range(25)]
    docs = []
    for d in range(80):
        body = text(r.randint(0, 120))
        if d % 2:
            part = r.choice(items)[1].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                part[r.randrange(len(part))] = "changed"
            at = r.randint(0, len(body))
            body[at:at] = part
        docs.append((d, r.choice([" ", ", ", "\n"]).join(body).title()))
    found, want = set(leaks(spark, docs, items)), brute(docs, items)
    assert found <= want
    assert len(want) > 25 and found == want
    exact = {(d, k) for d, t in docs for k, i in items if " ".join(i.split()) in " ".join("".join(c.lower() if c.isalnum() else " " for c in t).split())}
    assert exact <= found


def test_cases(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    docs = [(1, item), (1, item), (2, None), (3, ""), (4, item.replace("eta ", "ETA, ").upper()), (None, "x " * 30 + item), (5, "alpha beta gamma delta epsilon"), (6, "one two three four five six seven"), (7, item * 40)]
    items = [(10, item), (11, item), (12, "three four five six seven"), (13, "a b"), (14, None), (15, "")]
    found = leaks(spark, docs, items)
    assert set(found) == {(d, k) for d in (1, 4, None, 7) for k in (10, 11)} | {(6, 12)}
    assert found[(None, 10)].start == 30 and found[(1, 10)].matched == 15 and found[(6, 12)].start == 2
    assert not leaks(spark, docs, []) and not leaks(spark, [], items)
    # items of one to four words, separators before the first word, the end of an item at the start of a text
    docs = [(1, "... (Lone) word"), (2, "lonely words"), (3, "--- a b, c d."), (4, "b c d a"), (5, " ".join(item.split()[-6:]))]
    found = leaks(spark, docs, [(1, "lone"), (2, "a b c d"), (3, "c d"), (4, item)])
    assert {k: (r.start, r.matched, r.length) for k, r in found.items()} == {(1, 1): (0, 1, 1), (3, 2): (0, 4, 4), (3, 3): (2, 2, 2), (4, 3): (1, 2, 2)}


def test_chunks_and_shuffled_joins_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontam, "CHUNK", 7)
    test_against_brute_force(spark)
    test_any_stretch_that_meets_the_rule(spark)


def test_substitutions(spark):
    item = [f"k{i}" for i in range(20)]
    docs = []
    for i in range(20):
        for j in range(20):
            w = list(item)
            w[i] = w[j] = "other"
            docs.append((20 * i + j, " ".join(w)))
    found = leaks(spark, docs, [(1, " ".join(item))])
    assert len(found) == len(docs)


def missed(masks, most=400):
    """A pattern (1: equal) that meets the rule and holds none of the masks; None if there is no such pattern of any
    length. The best score (1 for an equal word, -3 for another; the rule is: not negative) of each state, a state being
    the last words and the equal words up to the least; a stretch whose beginning scores under -40 may as well begin later."""
    span, masks = max(map(len, masks)), [(len(m), int(m, 2)) for m in masks]
    now, seen = {(0, 0, 0): (0, "")}, {}
    for _ in range(most):
        after = {}
        for (bits, n, equal), (score, way) in now.items():
            for x in (0, 1):
                b, k, e, s = (bits << 1 | x) & ((1 << span) - 1), min(span, n + 1), min(decontam.LEAST_WORDS, equal + x), score + (1 if x else -3)
                if s < -40 or any(k >= size and b & m == m for size, m in masks):
                    continue
                if e >= decontam.LEAST_WORDS and s >= 0:
                    return way + str(x)
                if after.get((b, k, e), (-99,))[0] < s:
                    after[b, k, e] = (s, way + str(x))
        now = {k: v for k, v in after.items() if seen.get(k, -99) < v[0]}
        seen |= {k: v[0] for k, v in now.items()}
        if not now:
            return None
    raise AssertionError("not decided")


def test_masks_hit_every_stretch_that_meets_the_rule():
    assert (decontam.LEAST_WORDS, decontam.LEAST_SHARE) == (10, 0.75)
    assert missed(["110110110101", "101011011011"]) is not None
    assert missed(decontam.MASKS) is None


def test_recall_is_whole_at_any_rate_of_substitutions(spark):
    r = random.Random(8)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(n))) for i, n in enumerate([10, 11, 12, 16, 20, 30, 60] * 3)]
    docs = []
    for rate in (0.1, 0.15, 0.2, 0.25):
        for _, item in items:
            docs.append((len(docs), "before it " + " ".join("other" if r.random() < rate else w for w in item.split()) + " and after"))
    for every in (4, 5):
        docs.append((len(docs), " ".join("other" if k % every == 0 else w for k, w in enumerate(items[6][1].split()))))
    found, want = set(leaks(spark, docs, items)), brute(docs, items)
    assert len(want) > 50 and {(len(docs) - 2, 6), (len(docs) - 1, 6)} <= want
    assert want <= found


def every_stretch(docs, items):
    """All stretches of every diagonal of every pair, by prefix sums."""
    out = set()
    for d, text in docs:
        a = text.split()
        for k, item in items:
            b = item.split()
            for shift in range(-len(b) + 1, len(a)):
                sums = [0]
                for p in range(len(b)):
                    if 0 <= shift + p < len(a):
                        sums.append(sums[-1] + (a[shift + p] == b[p]))
                ends = [(i, j) for i in range(len(sums)) for j in range(i + decontam.LEAST_WORDS, len(sums))]
                if any(sums[j] - sums[i] >= max(decontam.LEAST_WORDS, decontam.LEAST_SHARE * (j - i)) for i, j in ends):
                    out.add((d, k))
    return out


def test_any_stretch_that_meets_the_rule(spark):
    r = random.Random(5)
    item = [f"k{i}" for i in range(71)]
    docs = [(0, " ".join(item[:24] + ["other"] * 23 + item[47:])), (1, " ".join(item[:12] + ["other"] * 11 + item[23:35])), (2, " ".join(item[:9] + ["other"] * 11 + item[20:29]))]
    for rate in (0.2, 0.25, 0.3, 0.4):
        docs += [(len(docs) + i, " ".join("other" if r.random() < rate else w for w in item[: r.choice([20, 40, 71])])) for i in range(12)]
    found, want = leaks(spark, docs, [(1, " ".join(item))]), every_stretch(docs, [(1, " ".join(item))])
    assert {(0, 1), (1, 1)} <= want and (2, 1) not in want and 20 < len(want) < len(docs)
    assert set(found) == want
    assert (found[0, 1].start, found[0, 1].matched, found[0, 1].length) == (0, 24, 24)
    assert all(x.matched >= 10 and x.matched >= 0.75 * x.length for x in found.values())
