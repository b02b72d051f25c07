import random

import corpus_pipeline
import pytest
from veilspan.llm import langid

WORDS = [a + b for a in ("th", "an", "re", "in", "on", "er", "st") for b in ("the", "and", "ing", "est", "ion", "ent", "ara", "ise")]


def test_stages_keep_and_drop_what_they_say(spark, tmp_path):
    r = random.Random(2)
    text = lambda n: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    rows = [(i, text(r.randint(20, 90))) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(10)]
    rows += [(300 + i, text(20) + " " + items[i % 5][1] + " " + text(20)) for i in range(10)]
    rows += [(400, text(30) + " token = abcdef0123456789abcdef012345"), (500, "12345 !!!"), (501, None), (502, ""), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y", "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, of long, blob string, language string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = kept.collect()
    ids = {n: sorted(r.doc_id for r in v) for n, v in seen.items()}
    assert not {500, 501, 502} & set(ids["language_id"]) and len(ids["language_id"]) == len(rows) - 3
    assert ids["near_dedup"] == sorted(set(range(120)) | {300 + i for i in range(10)} | {400})
    assert ids["decontamination"] == sorted(set(range(120)) | {400})
    secret = next(r for r in seen["secret_scans"] if r.doc_id == 400)
    assert secret.text.endswith(" [SECRET]") and secret.n_chars == len(secret.text) and ids["secret_scans"] == ids["decontamination"]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in packed}) == ids["secret_scans"]


def test_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_five_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scans", "packing"]
    assert langid.UND == "und" and corpus_pipeline.ORACLE_SQL is None


def test_a_leak_without_doc_id_takes_no_other_document(spark, tmp_path):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    item = text(30)
    rows = [(None, text(40)), (None, f"{text(9)} {item}"), (None, text(40)), (None, None), (None, ""), (7, item), (7, text(40)), (8, text(40))]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [x for x in rows if item not in (x[1] or "")]))


def test_every_later_stage_first_releases_the_heaps(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    old = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    before = old()
    corpus_pipeline.release_heaps(spark)
    assert old() > before

    class Released(Exception):
        pass

    def release(session):
        raise Released

    monkeypatch.setattr(corpus_pipeline, "release_heaps", release)
    for _, stage in corpus_pipeline.STAGES[1:]:
        with pytest.raises(Released):
            stage(spark, None, "")
