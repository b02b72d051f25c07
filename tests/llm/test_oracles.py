"""The queries of this subpackage over whole test tables: against their SQL, or against brute force."""

import html
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from veilspan.llm import decontam, packing, queries, tokens, urlfilter

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rel = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    want = sorted((dict(zip(columns, r, strict=True)) for r in rel.fetchall()), key=lambda r: r["doc_id"])
    assert sorted((r.asDict() for r in df.collect()), key=lambda r: r["doc_id"]) == want


def test_packing_of_all_documents(spark, duck):
    rows = queries.op1_best_fit_packing(spark, SF).collect()
    enc = tokens.encoder(tokens.default_path())
    seqs, hist = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        hist[r.length] = hist.get(r.length, 0) + 1
    for places in seqs.values():
        ends = [0, *(o + n for o, n in sorted(places))]
        assert [o for o, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096
    assert len(seqs) == packing.lower_bound(hist, 4096)
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    want = {}
    for doc, text in duck.execute("select doc_id, text from documents").fetchall():
        ids = enc._whole(text) + (1).to_bytes(4, "little")
        for k, at in enumerate(range(0, len(ids), 4 * 4096)):
            part = ids[at : at + 4 * 4096]
            want[(doc, k)] = (at // 4, len(part) // 4, zlib.crc32(part))
    assert got == want


def test_held_out_accuracy(spark, duck):
    lang = dict(duck.execute("select doc_id, lang from documents").fetchall())
    out = queries.op5_language_id(spark, SF).collect()
    held = [r for r in out if r.held_out]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_neighbours_of_all_embeddings(spark, duck):
    """Against brute force in double precision: scores are exact, ranks follow them, and recall is 0.9 at least."""
    table = duck.execute("select vec_id, embedding from embeddings order by vec_id").fetchall()
    ids, x = np.array([i for i, _ in table]), np.array([v for _, v in table], dtype=np.float64)
    got = {}
    for r in rows_of(queries.op2_nearest_neighbours(spark, SF)):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [i for i in ids.tolist() if i % 20 == 0]
    hits = 0
    for q, found in got.items():
        scores = x @ x[ids == q][0]
        best = [int(ids[k]) for k in np.lexsort((ids, -scores)) if ids[k] != q][:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(abs(s - scores[ids == v][0]) < 1e-9 for _, v, s in found)
        hits += len(set(best) & {v for _, v, _ in found})
    assert hits >= 0.9 * 20 * len(got)


def test_token_counts_of_every_group(spark, duck):
    enc = tokens.encoder(tokens.default_path())
    marks = {d: (t, q) for d, t, q in duck.execute("select doc_id, max(toxic), min(quality) from labels group by 1").fetchall()}
    want = {}
    for doc, text, lang, source in duck.execute("select doc_id, text, lang, source from documents").fetchall():
        toxic, quality = marks.get(doc, (None, None))
        if toxic == 1:
            continue
        if quality == 0:
            text, source = re.sub(r"[ \t\n\x0b\f\r]+", " ", text), f"low:{source}"
        sums = want.setdefault((source, lang), [0, 0, 0])
        for k, n in enumerate((1, len(enc.ids(text)) // 4, len(text.encode()))):
            sums[k] += n
    rows = rows_of(queries.op3_token_counts(spark, SF))
    assert {(r["source"], r["lang"]): [r["n_docs"], r["n_tokens"], r["n_bytes"]] for r in rows} == want
    assert any((s or "").startswith("low:") for s, _ in want) and len(rows) == len(want)


def test_text_of_all_pages(spark, duck):
    """The articles of these pages, by hand: what stands in <article>, cut at its block mark-up."""
    def article(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)
        parts = re.split(r"</?(?:h1|p|li|ul|div)[^>]*>", inner[1]) if inner else []
        plain = [" ".join(html.unescape(re.sub(r"<[a-zA-Z/][^>]*>", "", re.sub(r"<br[^>]*>", " ", p))).split()) for p in parts]
        return "\n\n".join(p for p in plain if p)

    pages = dict(duck.execute("select page_id, html from pages").fetchall())
    for r in rows_of(queries.op4_html_extraction(spark, SF)):
        assert r["text"] == article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_leaks_of_all_documents(spark, duck):
    """Every diagonal of every document and item, without seeds."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    number = {}
    code = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], dtype=np.int64)
    items = [(i, code(split(t))) for i, t in duck.execute("select item_id, text from benchmark").fetchall()]
    want = set()
    for doc, text in duck.execute("select doc_id, text from documents").fetchall():
        a = code(split(text))
        for item, b in items:
            n = len(b)
            if not np.isin(b, a).sum() >= decontam.LEAST_WORDS:
                continue
            padded = np.concatenate([np.full(n, -1), a, np.full(n, -1)])
            same = np.lib.stride_tricks.sliding_window_view(padded, n) == b
            for row in same[same.sum(axis=1) >= decontam.LEAST_WORDS]:
                sums = np.concatenate([[0], np.cumsum(row)])
                least = [max(decontam.LEAST_WORDS, decontam.LEAST_SHARE * k) for k in range(n + 1)]
                if any(sums[j] - sums[i] >= least[j - i] for i in range(n) for j in range(i + decontam.LEAST_WORDS, n + 1)):
                    want.add((doc, item))
                    break
    assert {(r["doc_id"], r["item_id"]) for r in rows_of(queries.op6_benchmark_decontamination(spark, SF))} == want and want


def test_rules_of_all_pages(spark, duck):
    urls = dict(duck.execute("select page_id, url from pages").fetchall())
    kinds = set()
    for r in rows_of(queries.op9_url_filters(spark, SF)):
        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r["page_id"]]).groups()
        host = host.lower()
        fits = [u for u in urlfilter.RULES if (host == u.host or host.endswith(f".{u.host}")) and path.startswith(u.path)]
        best = max(fits, key=lambda u: len(u.rule), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best.rule if best else None)
        assert r["verdict"] == (best.verdict if best else ("block" if r["purity"] >= urlfilter.REJECT else "allow"))
        kinds.add((best is not None, r["verdict"]))
    assert (False, "block") in kinds and (False, "allow") in kinds


def test_every_query_returns_all_its_rows(spark, duck):
    n = {t: duck.execute(f"select count(*) from {t}").fetchone()[0] for t in ("documents", "pages", "embeddings")}
    assert queries.op4_html_extraction(spark, SF).count() == queries.op9_url_filters(spark, SF).count() == n["pages"]
    assert queries.op2_nearest_neighbours(spark, SF).count() == 20 * -(-n["embeddings"] // 20)
