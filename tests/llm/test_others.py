import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.llm import ann, common, html_extract, langid, queries, shards, tokencounts, tokens, urlfilter

# ---------------------------------------------------------------- shards


def test_shards_are_contiguous_and_even(spark):
    rows = [(i * 7 % 1000, "é" * (i % 50)) for i in range(1000)] + [(5, None), (5, None), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as part", "3 as shard")
    out = shards.shard_by_bytes(docs).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"bytes"}
    ordered = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id or -1 for r in ordered] == sorted(r.doc_id or -1 for r in ordered)
    sums = {}
    for r in ordered:
        assert r.grown_shard is None
        sums.setdefault(r.shard, []).append(r)
    total = sum(r.size for r in out)
    for s, part in sums.items():
        assert [r.slot for r in part] == list(range(len(part)))
        assert abs(sum(r.size for r in part) - total / 16) <= 2 * max(r.size for r in out)
    assert set(sums) == set(range(16))
    assert sorted((r.size, r.text_crc32) for r in out) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)


def test_shards_of_nothing_and_of_one(spark):
    assert shards.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = shards.shard_by_bytes(spark.createDataFrame([(1, "a" * 100)], "doc_id long, text string")).collect()
    assert len(one) == 1 and 0 <= one[0].shard < 16 and one[0].slot == 0


# ---------------------------------------------------------------- languages

LANGS = {"en": "the of and to in is that it for was with as on be at by this have from", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein", "fr": "de la le et les des en un du une que est pour qui dans a par plus"}


def docs_of(n=240):
    rng = np.random.default_rng(1)
    names = sorted(LANGS)
    return [(i, " ".join(rng.choice(LANGS[names[i % 3]].split(), 40)), names[i % 3]) for i in range(n)]


def test_language_id_on_held_out(spark):
    rows = docs_of() + [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (1003, "the of and " * 400_000, None), (None, "der die das", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as lang_pred", "3 as h")
    out = {r.doc_id: r.language for r in langid.identify(docs).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows[:240] if zlib.crc32(str(i).encode()) % 3 == 1)
    for i in (1000, 1001, 1002):
        assert (out[i].lang_pred, out[i].score, out[i].rejected) == ("und", 0.0, True)
    assert out[1003].lang_pred == "en" and out[None].lang_pred == "de"
    assert all(0 <= v.score <= 1 for v in out.values()) and not any(out[i].rejected for i in range(240))


def test_blocks_do_not_change_trigrams(monkeypatch):
    text = "Ab, cd  éf-gh " * 50 + "x\U0001f600y"
    whole = langid.trigrams(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    parts = langid.trigrams(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_rejection_by_distance():
    rows = [("en", *langid.trigrams(LANGS["en"])), ("en", *langid.trigrams(LANGS["en"][::-1])), ("de", *langid.trigrams(LANGS["de"]))]
    model = langid.fit_vectors(rows)
    assert not model.predict(LANGS["de"])[2] and model.predict("бвгджз клмнп")[2]
    assert not model.predict(" ".join(LANGS["de"].split()[:2]))[2]  # a short text, however far from a whole one
    assert langid.fit_vectors([]).predict("text") == ("und", 0.0, True)


def test_sample_is_bounded_and_needs_no_ids(spark, monkeypatch):
    """Rows without a doc_id, one doc_id for many rows, and one text for a third of all rows."""
    monkeypatch.setattr(langid, "SAMPLE", 60)
    rng = np.random.default_rng(3)
    names = sorted(LANGS)
    texts = [(" ".join(rng.choice(LANGS[names[i % 3]].split(), 12)), names[i % 3]) for i in range(900)] + [(LANGS["de"], "de")] * 450
    seen = []
    fit_vectors = langid.fit_vectors
    monkeypatch.setattr(langid, "fit_vectors", lambda rows, *a: seen.append(len(rows)) or fit_vectors(rows, *a))
    for own in (None, 7):
        docs = spark.createDataFrame([(own, t, lang) for t, lang in texts], "doc_id long, text string, lang string")
        out = [(r.lang, r.language.lang_pred) for r in langid.identify(docs).collect()]
        assert len(out) == 1350 and sum(a == b for a, b in out) > 1300
    assert seen == [60, 60]


def test_no_documents_and_no_labels(spark):
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    out = langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert out.language.lang_pred == "und"


# ---------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/x">Home</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies and a long text about them so that it looks like an article.</p></div>
<article><header><h1>The &amp; title</h1></header><p>First <b>bold</b>&nbsp;word and enough text to make it a paragraph of its own.</p><!-- c --><p>Short.</p>
<div class="ad">Buy now, a long advert with many words in it, longer than some paragraphs are.</div><p>Last one<br>with a break &#233;<p>Unclosed</article>
<aside>Related things that are long enough to be taken for text.</aside><section id="comments"><p>First! A comment that is as long as a paragraph would be.</p></section>
<form><label>Search the site for words</label></form><footer>&copy; x</footer></body></html>"""


def test_main_text():
    want = "The & title\n\nFirst bold word and enough text to make it a paragraph of its own.\n\nShort.\n\nLast one with a break é\n\nUnclosed"
    assert html_extract.main_text(PAGE) == want


@pytest.mark.parametrize("page", [None, "", "<div", "<p></p>", "<script>x", "<nav>only a menu</nav>", "<!-- x"])
def test_pages_without_text(page):
    assert html_extract.main_text(page) == ""


def test_plain_and_cut_off_pages(spark):
    assert html_extract.main_text("just text &lt;b&gt; &am") == "just text <b> &am"
    assert html_extract.main_text("<article><p>" + "word " * 300_000) == ("word " * 300_000).strip()
    assert html_extract.main_text("<body><p>one</p><div>two <em>three") == "one\n\ntwo three"
    rows = html_extract.extract(spark.createDataFrame([(1, None, "t"), (1, PAGE, None)], "page_id long, html string, text string")).collect()
    assert sorted(len(r.main_text) > 0 for r in rows) == [False, True]


S1 = "The first paragraph of the article is long enough to be told from a menu, and it goes on for a while so that it counts."
S2 = "A second paragraph follows it, with some words in its middle, and says some more about the same thing as before."
S3 = "The third one closes the piece with a remark that nobody asked for, but that fills the line as it should."
BODY = f"<p>{S1}</p><p>{S2}</p><p>{S3}</p>"
WHOLE = f"{S1}\n\n{S2}\n\n{S3}"


@pytest.mark.parametrize(("page", "want"), [
    (BODY, WHOLE),
    (f"<div><a href=/>Home</a> | <a href=/a>About us</a></div><div><h1>Title here</h1>{BODY}</div><div>Copyright 2024 nobody</div>", f"Title here\n\n{WHOLE}"),
    (f"<div>Home</div><div>About us</div><div>Privacy policy</div><div>{BODY}</div><div>Imprint</div><div>Terms</div>", WHOLE),
    (f"<body><div>Home</div><div>About us</div>{BODY}</body>", WHOLE),
    (f"<body><div>Buy one, get one free: only this week!</div><div>{BODY}</div></body>", WHOLE),
    (f"<body><div>{BODY}</div><div><span>Offers</span><p>Cheap shoes.</p><p>Cheap hats.</p></div></body>", WHOLE),
    (f"<body><div>{BODY}</div><div><h3>Comments</h3><div><b>Ann</b><p>Great post!</p></div><div><b>Bob</b><p>Thanks, I learned a lot.</p></div></div></body>", WHOLE),
    (f"<body><div>{BODY}</div><div id='comments'>{f'<p>{S1}</p>' * 9}</div></body>", WHOLE),
    (f"<body><div class='legal'>{BODY}</div></body>", WHOLE),
    (f"<body><div class='search-results'>{BODY}</div></body>", WHOLE),
    (f"<body><div class='post side-by-side'>{BODY}</div></body>", WHOLE),
    (f"<body><div class='notice'>{BODY}</div><div>Imprint</div></body>", WHOLE),
    (f"<body><div><div>{S1}</div><div>{S2}</div><div>{S3}</div></div><div>Imprint</div></body>", WHOLE),
    (f"<body><div><div><h2>One</h2><p>{S1}</p></div><div><h2>Two</h2><p>{S2}</p></div></div></body>", f"One\n\n{S1}\n\nTwo\n\n{S2}"),
    (f"<article><p>{S1}</p><div class='ad'>Buy now, a long advert with many words in it.</div><p>{S2}</p><aside>{S1}</aside><p>{S3}</p></article>", WHOLE),
    (f"<body><div class='cookie-banner'><p>We use cookies to make this site work better for you.</p><button>OK</button></div><main>{BODY}</main></body>", WHOLE),
    ("<body><article><h1>Yes</h1><p>No.</p></article><div>An advert that is longer than all else here, by far.</div></body>", "Yes\n\nNo."),
    (f"<p>See <a title=\"x>link</a> for it. {S1}</p><p class=\"y\">{S3}</p><p title=don't>{S2}</p><p title='a<b>c'>x.</p>", f"See link for it. {S1}\n\n{S3}\n\n{S2}\n\nx."),
    (f"<div>{BODY}" + "</b></x>" * 20_000 + "<div>" * 20_000, WHOLE),
])
def test_blocks_decide(page, want):
    assert html_extract.main_text(page) == want


# ---------------------------------------------------------------- urls


def test_hosts_paths_and_rules(spark):
    urls = [
        (1, "https://www.Example.COM/en/7/a?x#y"), (2, "http://a.com/en/8"), (3, "ftp://b.net/de/8"), (4, "http://x.example.net/de/81"), (5, "http://example.org/es/"), (6, None), (7, "no scheme/en/"),
        (8, "http://com/en/1"), (9, "http://notcom/en/1"), (10, "http://a.com?q=/en/"), (11, "x://y://z.com/en/"), (1, "https://www.Example.COM/en/7/a?x#y"),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "3 as template")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert out[1] == ("www.example.com", "/en/7/a", "example.com/en/7", "allow") and out[2][2:] == ("com/en/", "block")
    assert out[3][2:] == ("net/de/", "allow") and out[4][2:] == ("example.net/de/8", "block") and out[5][2:] == ("org/es/", "block")
    assert out[6] == ("", "", None, "allow") and out[7] == ("", "", None, "allow")
    assert out[8][2] == "com/en/" and out[9] == ("notcom", "/en/1", None, "allow") and out[10][:3] == ("a.com", "", None) and out[11][0] == "y:"
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_learn_from_labels(spark):
    rows = [(i, f"http://h.x/spam/{i}") for i in range(40)] + [(100 + i, f"http://h.x/ham/{i}") for i in range(40)] + [(200 + i, f"http://h.x/user/name{i:c>3}/post") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i in range(20)] + [(100 + i, 0) for i in range(20)], "page_id long, bad int")
    out = {r.page_id: r for r in urlfilter.judge(pages, rules=(), labels=labels).collect()}
    assert {out[i].verdict for i in range(40)} == {"block"} and {out[100 + i].verdict for i in range(40)} == {"allow"}
    assert {out[i].template for i in range(40)} == {"/spam/*"} and {out[200 + i].template for i in range(40)} == {"/user/*/post"}
    assert {out[200 + i].verdict for i in range(40)} == {"allow"}


def test_tree_merges_at_every_level_and_backs_off(spark):
    rows = [(i, f"http://h.x/blog/{'abc'[i % 3]}/{i}") for i in range(60)] + [(100 + i, f"http://h.x/blog/good/{i}/x") for i in range(30)]
    rows += [(200, "http://h.x/blog/new/1"), (201, "http://h.x/"), (202, "http://other.y/blog/a/1"), (203, "http://h.x/blog/a/1/2/3/4/5/6/7/8/9/end")]
    rows += [(300 + i, f"http://www.bad.zz/p/{i}") for i in range(30)] + [(400, "http://new.bad.zz/q"), (401, "http://else.zz/q")]
    labels = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(30)] + [(300 + i, 1) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "1 as n", "2 as own")
    out = {r.page_id: r for r in urlfilter.judge(pages, rules=(), labels=spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert len(out) == len(rows) and {out[i].template for i in range(60)} == {"/blog/a|b|c/*"}
    assert {out[i].verdict for i in range(60)} == {"block"} and {out[100 + i].verdict for i in range(30)} == {"allow"}
    assert out[200].template == "/blog/new/*" and out[202].verdict == "allow" and out[203].template == "/blog/a|b|c/*/*/*/*/*/*/*/*/*/end"
    assert out[200].purity == pytest.approx(out[201].purity, abs=0.1)  # no labels of its own: that of the node above
    assert out[203].verdict == "block" and out[400].verdict == "block" and out[401].verdict == "block" and out[202].purity == pytest.approx(0.2)


def test_tree_by_hand(spark):
    """Purities of a small tree, worked out from the definition."""
    rows = [(1, "http://a.t/x/1"), (2, "http://a.t/x/2"), (3, "http://a.t/y/3"), (4, "http://b.t/x/4")]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "page_id long, bad int")
    out = {r.page_id: r.purity for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=(), labels=labels).collect()}
    smooth = lambda bad, n, above: (bad + 5 * above) / (n + 5)
    t = smooth(2, 3, 0.2)
    a, b = smooth(2, 3, t), smooth(0, 0, t)
    merged = smooth(2, 3, a)  # shares of 1 in 2 and 0 in 1 are less than 1.96 deviations apart
    assert out == pytest.approx({1: smooth(2, 3, merged), 2: smooth(2, 3, merged), 3: smooth(2, 3, merged), 4: b})


# ---------------------------------------------------------------- token counts


def test_rollup_follows_deltas_and_repeats_nothing(spark):
    docs = spark.createDataFrame([(1, "one two", "en", "a"), (2, None, None, None), (3, "three", "en", "a"), (3, "three", "en", "a")], "doc_id long, text string, lang string, source string")
    rollup = tokencounts.Rollup(spark)
    before = tokencounts.counted(docs)
    assert rollup.commit("b1", tokencounts.inserts(before)) and not rollup.commit("b1", tokencounts.inserts(before))
    enc = tokens.encoder(tokens.default_path())
    n = lambda t: len(enc.ids(t)) // 4
    key = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens, r.n_bytes) for r in rollup.totals().collect()}
    assert key() == {("a", "en"): (3, n("one two") + 2 * n("three"), 17), (None, None): (1, 0, 0)}
    after = tokencounts.counted(spark.createDataFrame([(1, "one two four", "en", "b"), (2, None, None, None), (3, "three", "en", "a")], "doc_id long, text string, lang string, source string"))
    rollup.commit("b2", tokencounts.changes(before, after))
    assert key() == {("a", "en"): (1, n("three"), 5), ("b", "en"): (1, n("one two four"), 12), (None, None): (1, 0, 0)}
    rollup.commit("b3", tokencounts.deletes(after))
    rollup.commit("b4", tokencounts.inserts(after.limit(0)))
    assert key() == {} and rollup.batches() == ["b1", "b2", "b3", "b4"]


def test_totals_are_maintained_and_survive_a_crash(spark):
    rows = [("s", "en", "v1", 5, 9), ("s", "de", "v1", 2, 3)]
    counted = spark.createDataFrame(rows, "source string, lang string, tokenizer_version string, n_tokens long, n_bytes long")
    rollup = tokencounts.Rollup(spark)
    for k in range(5):
        assert rollup.commit(f"day/{k}", tokencounts.inserts(counted))
    assert {(r.lang, r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == {("en", 5, 25), ("de", 5, 10)}
    state, fs = rollup._fs("state")
    assert fs.exists(state) and len(fs.listStatus(state)) <= 2  # superseded totals go
    # written, but not marked: as if the driver had died before the marker
    tokencounts.inserts(counted).write.parquet(rollup._state(6))
    again = tokencounts.Rollup(spark, rollup.path)
    assert {(r.lang, r.n_docs) for r in again.totals().collect()} == {("en", 5), ("de", 5)}
    assert again.commit("day/5", tokencounts.deletes(counted)) and not again.commit("day/5", tokencounts.deletes(counted))
    assert {(r.lang, r.n_docs, r.n_tokens) for r in again.totals().collect()} == {("en", 4, 20), ("de", 4, 8)}


def test_revision_moves_between_groups(spark):
    old = spark.createDataFrame([("s", "en", "v1", 5, 9)], "source string, lang string, tokenizer_version string, n_tokens long, n_bytes long")
    rollup = tokencounts.Rollup(spark)
    rollup.commit("a", tokencounts.inserts(old))
    rollup.commit("b", tokencounts.revisions(old, old.withColumn("tokenizer_version", F.lit("v2")).withColumn("n_tokens", F.lit(4).cast("long"))))
    assert [(r.tokenizer_version, r.n_docs, r.n_tokens) for r in rollup.totals().collect()] == [("v2", 1, 4)]


def shuffled(spark) -> int:
    """Bytes written to shuffles since the session began."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.mark.parametrize("most, share", [(common.BROADCAST_BYTES, 0.1), (0, 1.3)])
def test_texts_are_shuffled_once_at_most(spark, tmp_path, monkeypatch, most, share):
    """Marks that are broadcast move no text; marks that are not move each text once, for its revision."""
    r = random.Random(3)
    docs = [(d, "a  b\n" + "".join(r.choices("0123456789abcdef", k=4000)), r.choice(["en", None]), r.choice(["x", "y", None])) for d in range(200)]
    docs += [docs[7], docs[9], (None, "no  id", "en", "x"), (None, "no  id", "en", "x"), (300, None, "en", "x"), (301, "", "en", "x"), (302, "\t both ", "en", "x")]
    labels = [(d, r.choice([0, 1, None]), r.choice([0, 1, None])) for d in range(0, 150, 2)] + [(7, 0, 0), (7, 1, 0), (9, 0, 0), (9, 0, 1), (None, 0, 1), (300, 0, 0), (301, 0, None), (302, 0, 1), (999, 0, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(common, "BROADCAST_BYTES", most)
    threshold, texts = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), sum(p.stat().st_size for p in (tmp_path / "documents.parquet").glob("*.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        rows = queries.op3_token_counts(spark, str(tmp_path)).collect()
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert moved < share * texts
    enc, want = tokens.encoder(tokens.default_path()), {}
    toxic, low = {d for d, _, t in labels if t == 1 and d is not None}, {d for d, q, _ in labels if q == 0 and d is not None}
    for doc, text, lang, source in docs:
        if doc in toxic:
            continue
        if doc in low:
            text, source = text and re.sub(r"\s+", " ", text), source and f"low:{source}"
        sums = want.setdefault((source, lang), [0, 0, 0])
        for k, n in enumerate((1, len(enc.ids(text)) // 4, len((text or "").encode()))):
            sums[k] += n
    assert {(x.source, x.lang): [x.n_docs, x.n_tokens, x.n_bytes] for x in rows} == want and len(rows) == len(want)


# ---------------------------------------------------------------- nearest neighbours


def brute(rows, k, queries):
    good = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None and len(v) == 16:
            good[(i, tuple(v))] = np.array(v, dtype=float)
    ids = np.array([i for i, _ in good])
    x = np.array(list(good.values()))
    out = {}
    for q, v in zip(ids, x, strict=True):
        if queries(q):
            s = x @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
            out[int(q)] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_neighbours_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=16)]) for i in range(1200)]
    rows += [(2000 + i, rows[20][1]) for i in range(80)]  # one vector many rows share
    rows += [(20, rows[20][1]), (3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [float("inf")] + [1.0] * 15), (3080, [None] + [1.0] * 15), (3100, [1.0] * 4), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rep", "2 as score", "3 as vector")
    found = {}
    for r in ann.Index(table).search(F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, 20, lambda q: q % 20 == 0)
    assert set(found) == set(want)
    hits = 0
    for q, w in want.items():
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 21)) and q not in [v for _, v, _ in got]
        hits += len({v for _, v, _ in got} & {v for v, _ in w})
        exact = dict(w)
        assert all(abs(s - exact[v]) < 1e-9 for _, v, s in got if v in exact)
    assert hits >= 0.95 * 20 * len(want)


def test_recall_of_the_codes():
    """Codes alone, before reranking: the twenty nearest are among the best 512 of 4000."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = ann.fit(x[:3000])
    codes, norms = books.encode(x.astype(np.float32))
    s = np.zeros((20, 4000))
    for level in range(books.books):
        s += (x[:20] @ books.words[level].T)[:, codes[:, level]]
    s /= np.sqrt(norms)
    hits = sum(len(set(np.argsort(-(x @ x[i]))[:21]) & set(np.argsort(-s[i])[:512])) for i in range(20))
    assert hits >= 0.95 * 20 * 21
    one, two = (x - sum(b.words[level][c[:, level]] for level in range(b.books)) for b, c in ((books, codes), (books, books.encode(x.astype(np.float32), beam=1)[0])))
    assert (one**2).sum() < (two**2).sum()  # a wider beam finds better codes


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    out = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.Index(few).search(F.col("vec_id") % 20 == 0).collect())
    assert out == [(0, 1, 20, 1.0), (0, 2, 1, 0.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0)]
    assert ann.Index(few.limit(0)).search(F.lit(True)).count() == 0
