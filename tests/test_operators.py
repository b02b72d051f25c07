import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspan.operators import known, layout, pixels, resolve
from veilspan.sources import sinks, template
from veilspan.sources.records import words_of_lines
from veilspan.sources.registry import Registry
from veilspan.streaming import jobs, requests

WORD = "conv_id long, block int, line_no int, word_no int, word string, x0 double, x1 double, y0 double, y1 double"
RECT = "conv_id long, block int, rect int, line_no int, x0 double, y0 double, x1 double, y1 double"


def page(spark, *lines):
    rows = [(1, 0, i, text) for i, text in enumerate(lines)]
    return words_of_lines(spark.createDataFrame(rows, "conv_id long, block int, line_no int, line string"))


def rect(spark, *boxes):
    return spark.createDataFrame([(1, 0, i, *b) for i, b in enumerate(boxes)], RECT)


def test_rows_take_overlapping_words_and_keep_columns_apart(spark):
    w = [(1, 0, 0, 0, "Name", 0.0, 20.0, 0.0, 10.0), (1, 0, 1, 0, "value", 40.0, 60.0, 3.0, 13.0), (1, 0, 2, 0, "next", 0.0, 20.0, 20.0, 30.0), (1, 0, 3, 0, "tall", 70.0, 80.0, 1.0, 12.0)]
    rows = layout.rows_of(spark.createDataFrame(w, WORD)).orderBy("row").collect()
    assert [[x.word for x in r.words] for r in rows] == [["Name", "value", "tall"], ["next"]]
    assert (rows[0].y0, rows[0].y1) == (0.0, 13.0)


def test_clip_leaves_neighbour_lines_alone(spark):
    words = page(spark, "one two", "three four")
    out = layout.clip_to_line(rect(spark, (0, 0.0, -4.0, 15.0, 14.0)), words).first()
    assert (out.y0, out.y1) == (-4.0, 12.0)
    swallowed = layout.clip_to_line(rect(spark, (0, 0.0, 12.5, 15.0, 21.0)), words).first()
    assert (swallowed.y0, swallowed.y1) == (12.5, 21.0)  # no word of its own line: as it was


def test_bridge_joins_over_punctuation_only(spark):
    words = page(spark, "98 / 99 and 97")
    boxes = rect(spark, (0, 0.0, 0.0, 10.0, 10.0), (0, 25.0, 0.0, 35.0, 10.0), (0, 60.0, 0.0, 70.0, 10.0))
    out = sorted((r.x0, r.x1) for r in layout.bridge(boxes.drop("line_no"), words).collect())
    assert out == [(0.0, 35.0), (60.0, 70.0)]


def test_contained_rects_go(spark):
    boxes = rect(spark, (0, 0.0, 0.0, 30.0, 10.0), (0, 5.0, 0.0, 30.0, 10.0), (0, 0.0, 0.0, 30.0, 10.0), (0, 40.0, 0.0, 50.0, 10.0))
    assert sorted(r.rect for r in layout.without_contained(boxes.drop("line_no")).collect()) == [0, 3]


def test_label_walk(spark):
    words = page(spark, "Nationality: Indian Phone number: 98123", "please contact me at 98123", "Email id of the 98123 (Mobile) x")
    at = [("98123", 0), ("98123", 1), ("98123", 2)]
    found = {r.line_no: r for r in words.filter("word = '98123'").collect()}
    boxes = rect(spark, *[(n, found[n].x0, found[n].y0, found[n].x1, found[n].y1) for _, n in at])
    left = {r.rect: r.edge for r in layout.walk_labels(boxes, words, False).collect()}
    assert left[0] == 5.0 * len("Nationality: Indian ") and 1 not in left and 2 not in left
    right = {r.rect: r.edge for r in layout.walk_labels(boxes, words, True).collect()}
    assert right == {}  # stopped by prose


def test_label_above_and_marks_and_glued_parts(spark):
    words = page(spark, "Mobile:", "98123x")
    boxes = rect(spark, (1, 0.0, 12.0, 30.0, 22.0)).drop("line_no")
    grown = layout.label_above(boxes, words).first()
    assert (grown.y0, grown.x1) == (0.0, 35.0)
    assert layout.label_above(boxes, page(spark, "DETAILS", "98123x")).count() == 0
    marks = spark.createDataFrame([(1, 0, 25.0, 12.0, 33.0, 22.0), (1, 0, 29.0, 12.0, 60.0, 22.0)], "conv_id long, block int, x0 double, y0 double, x1 double, y1 double")
    assert layout.absorb_marks(boxes, marks.withColumn("x0", F.col("x0") - 2)).first().x1 == 33.0
    glued = page(spark, "Email:-jo@x.com.")
    inner = rect(spark, (0, 35.0, 0.0, 75.0, 10.0)).drop("line_no")
    out = layout.glued(inner, glued).first()
    assert (out.x0, out.x1) == (0.0, 80.0)


LABELS = {"Phone:": True, "E-mail": True, "(M)": True, "Mobile No.": True, ":-": True, "Father's": True, "e:": True, "Smith": False, "phones": False, "2019": False, "Alternate Mobile No. :": True, "of": False}


def test_labels(spark):
    rows = spark.createDataFrame([(w,) for w in LABELS], "w string").select("w", layout.is_label(F.col("w")).alias("x"), layout.is_connector(F.col("w")).alias("c")).collect()
    assert {r.w: r.x for r in rows} == LABELS and [r.w for r in rows if r.c and not r.x] == ["of"]


def test_ocr_passes_merge_to_the_surer_reading(spark):
    kind = "conv_id long, block int, pass int, word_no int, word string, x0 double, y0 double, x1 double, y1 double, conf double"
    rows = [(1, 0, 0, 0, "a", 0.0, 0.0, 10.0, 10.0, 50.0), (1, 0, 0, 1, "b", 20.0, 0.0, 30.0, 10.0, 90.0), (1, 0, 1, 0, "A", 1.0, 0.0, 11.0, 10.0, 80.0), (1, 0, 1, 1, "B", 20.0, 0.0, 30.0, 10.0, 70.0), (1, 0, 1, 2, "c", 50.0, 0.0, 60.0, 10.0, 30.0)]
    assert sorted(r.word for r in layout.merge_passes(spark.createDataFrame(rows, kind)).collect()) == ["A", "b", "c"]


def test_corner_images(spark):
    images = rect(spark, (0, 500.0, 10.0, 560.0, 60.0), (0, 10.0, 10.0, 60.0, 60.0), (0, 400.0, 100.0, 450.0, 110.0)).drop("line_no")
    words = spark.createDataFrame([(1, 0, 0, 0, "over", 400.0, 420.0, 100.0, 110.0)], WORD)
    assert [r.rect for r in layout.corner_images(images, words, 600.0, 800.0).collect()] == [0]


def test_placing_known_numbers(spark):
    words = page(spark, "Phone: +91 98123 45670 home", "Order Reference 4319812345670", "45670 98123")
    targets = spark.createDataFrame([(1, "+919812345670"), (1, "123")], "conv_id long, target string")
    out = known.place_phones(words, targets, ["conv_id", "block", "line_no"], ["conv_id"]).collect()
    assert sorted((r.line_no, r.i, r.j) for r in out) == [(0, 1, 3), (0, 2, 3)]


def test_snapping(spark):
    words = page(spark, "mail jo.doe@exarnple .com now", "jo@x.com")
    emails = spark.createDataFrame([(1, "jo.doe@example.com"), (1, "jo@x.com")], "conv_id long, email string")
    out = known.snap_emails(words, emails, ["conv_id", "block", "line_no"], ["conv_id"]).collect()
    assert [(r.email, r.i, r.j, r.conf) for r in out] == [("jo.doe@example.com", 1, 2, 100.0)]
    rows = spark.createDataFrame([("1981234567077", "9812345670"), ("98123456719", "9812345670"), ("123", "9812345670")], "s string, p string")
    assert [r.x for r in rows.select(known.snap_phones(F.col("s"), F.col("p")).alias("x")).collect()] == [[], [0], []]


def test_registry_table(spark, tmp_path):
    reg = Registry(spark, str(tmp_path))
    reg.create()
    row = lambda k, v: (k, v, "s", "t", "u")
    kind = "client_key string, client_id string, encrypted_client_secret string, token_url string, instance_url string"
    at = lambda d: F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp")
    reg.upsert(spark.createDataFrame([row("a", "1"), row("b", "2")], kind), at(1))
    reg.upsert(spark.createDataFrame([row("b", "3"), row("c", "4")], kind), at(2))
    rows = {r.client_key: (r.client_id, r.created_at.day, r.updated_at.day) for r in reg.read().collect()}
    assert rows == {"a": ("1", 1, 1), "b": ("3", 1, 2), "c": ("4", 2, 2)}
    had = {r.client_key: r.existed for r in reg.delete(spark.createDataFrame([("a",), ("z",)], "client_key string")).collect()}
    assert had == {"a": True, "z": False} and reg.read().count() == 2
    parsed = resolve.parse_registry(spark.createDataFrame([('{"k":{"client_id":"i","client_secret":"s","token_url":"t","instance_url":"u"},"l":{"client_id":"i"}}',), ("[]",)], "json string"))
    assert {(r.client_key, r.error) for r in parsed.collect()} == {("k", None), ("l", "missing client_secret,token_url,instance_url"), (None, "not an object")}


def test_queue_to_results(spark, tmp_path):
    rows = [("j1", 1, "call 98123 45670", None), ("j1", 2, None, None), ("j2", 3, "ref 4319812345670", ["9812345670"]), ("j2", 4, "", None)]
    items = spark.createDataFrame([(j, i, t, m, "", "w", None) for j, i, t, m in rows], jobs.ITEM)
    jobs.submit(items, f"{tmp_path}/q")
    jobs.run(jobs.queue(spark, f"{tmp_path}/q"), f"{tmp_path}/r", f"{tmp_path}/c").awaitTermination()
    jobs.run(jobs.queue(spark, f"{tmp_path}/q"), f"{tmp_path}/r", f"{tmp_path}/c").awaitTermination()  # nothing new: nothing changes
    out = {r.item_id: (r.status, r.masked) for r in jobs.results(spark, f"{tmp_path}/r").collect()}
    assert out == {1: ("ok", "call "), 2: ("error", None), 3: ("ok", "ref 4319812345670"), 4: ("error", None)} or out[3] == ("ok", "ref ")
    totals = spark.createDataFrame([("j1", 2), ("j2", 3), ("j3", 1)], "job_id string, total long")
    state = {r.job_id: (r.succeeded, r.failed, r.pending, r.state) for r in jobs.progress(jobs.results(spark, f"{tmp_path}/r"), totals).collect()}
    assert state == {"j1": (1, 1, 0, "done"), "j2": (1, 1, 1, "running"), "j3": (0, 0, 1, "queued")}


def test_live_progress(spark, tmp_path):
    spark.createDataFrame([("j", "ok"), ("j", "error"), ("k", "ok")], "job_id string, status string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("job_id string, status string").parquet(f"{tmp_path}/in")
    q = jobs.live_progress(stream).writeStream.format("memory").queryName("live").outputMode("update").trigger(once=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert {(r.job_id, r.succeeded, r.failed) for r in spark.table("live").collect()} == {("j", 1, 1), ("k", 1, 0)}


def test_admission_and_retries(spark):
    leases = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 00:20:00",)], "t string").select(F.col("t").cast("timestamp").alias("started_at"))
    waiting = spark.createDataFrame([(3,), (1,), (2,)], "seq long")
    now = F.lit("2024-01-01 00:21:00").cast("timestamp")
    assert [r.seq for r in jobs.admitted(leases, waiting, now, width=3).collect()] == [1, 2]
    slept, calls = [], []

    def call(fresh):
        calls.append(fresh)
        if len(calls) < 4:
            raise ValueError("expired" if len(calls) == 1 else "busy")
        return "ok"

    assert jobs.retried(call, sleep=slept.append, transient=lambda e: "busy" in str(e), expired=lambda e: "expired" in str(e)) == "ok"
    assert calls == [False, True, True, True] and slept == [1.5, 3.0]
    with pytest.raises(ValueError):
        jobs.retried(lambda fresh: (_ for _ in ()).throw(ValueError("bad")))


def test_sinks_and_template(spark):
    uploads = spark.createDataFrame([("a", bytearray(b"\x89PNG\r\n\x1a\n")), ("b", bytearray(b"")), ("c", bytearray(b"text"))], "name string, body binary")
    good, bad = sinks.accepted_watermarks(uploads)
    assert [r.name for r in good.collect()] == ["a"] and {(r.name, r.error) for r in bad.collect()} == {("b", "empty"), ("c", "not a PNG or JPEG")}
    files = spark.createDataFrame([("x", bytearray("é".encode())), ("y", bytearray(b"\xff\xfe"))], "path string, content binary")
    assert {(r.path, r.text) for r in sinks.documents_of(files).collect()} == {("x", "é"), ("y", None)}
    kind = "contact_id int, designation string, company string, experience string, skills string, other_skills string, qualification string, born string, languages string"
    out = {r.contact_id: r.document for r in template.render(spark.createDataFrame([(1, "Dev", "Acme", "1", "a;b", "B,c", None, "2001-06-07", None), (2, *[None] * 8)], kind)).collect()}
    assert out[2] is None and out[1].startswith("Summary\nDev with 1 year of experience, currently working at Acme. Core skills include a, b.")
    assert "Other skills\nc" in out[1] and "Details\nDate of birth: 07 June 2001" in out[1]


def test_pixels():
    out = pixels.fade(np.array([[255, 255, 250], [100, 0, 200]], dtype=np.uint8), 0.5)
    assert out.tolist() == [[0, 0, 0, 0], [50, 0, 100, 128]]


def test_requests_and_answers(spark):
    item = '{"job_applicant_id":"a","mask_strings":["x"]}'
    many = "[" + ",".join([item] * 501) + "]"
    rows = [("1", f'{{"items":[{item},{{"job_applicant_id":"b","watermark_base64":"aGk="}}],"watermark_base64":"!!","watermark_text":"t"}}'), ("2", "no json"), ("3", '{"items":[]}'), ("4", f'{{"items":{many}}}')]
    items, bad = requests.parse(spark.createDataFrame(rows, "job_id string, json string"))
    out = [(r.idx, r.id, r.mask_strings, r.watermark, r.image) for r in items.orderBy("idx").collect()]
    assert out == [(0, "a", ["x"], "!!", None), (1, "b", [], "aGk=", bytearray(b"hi"))]
    assert {r.job_id: r.error for r in bad.collect()} == {"2": "not a batch request", "3": "no items", "4": "more than 500 items"}
    done = spark.createDataFrame([("1", 1, "b", "error", None, "x" * 400), ("1", 0, "a", "ok", 2, None)], "job_id string, idx int, id string, status string, regions int, detail string")
    row = requests.answer(done).first()
    assert (row.succeeded, row.failed) == (1, 1) and row.json.index('"a"') < row.json.index('"b"') and "x" * 301 not in row.json


def test_every_place_of_a_value(spark):
    rows = [("a@b.co, x a@b.co\n(a@b.co)", "a@b.co"), ("a+b@c.io a.b@c.io", "a.b@c.io"), ("none", "a@b.co"), (None, "a@b.co")]
    got = spark.createDataFrame(rows, "t string, v string").select(known.literal_places(F.col("t"), F.col("v"))).collect()
    assert [r[0] for r in got] == [[0, 10, 18], [9], [], []]


def test_emails_are_placed_wherever_they_stand(spark, tmp_path):
    from veilspan.plans.known import k08_place_emails

    spark.createDataFrame([(1, "Ann@b.com and ann@b.com")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = k08_place_emails(spark, str(tmp_path)).collect()
    assert sorted((r.email, r.start, r.end) for r in found) == [("Ann@b.com", 0, 9), ("Ann@b.com", 14, 23), ("ann@b.com", 0, 9), ("ann@b.com", 14, 23)]


def test_metadata_is_scrubbed_over_the_whole_text(spark, tmp_path):
    from veilspan.plans.detection import r16_scrubbed_metadata

    rows = [(1, "en", "web", "word " * 60 + "write to ann@corp.com"), (2, "en", "web", "word " * 60), (3, "en", "web", None)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.title for r in r16_scrubbed_metadata(spark, str(tmp_path)).collect()} == {1: "", 2: "word " * 60, 3: None}


def test_absorb_meets_its_page_once_and_joins_nothing(spark):
    words = page(spark, "Phone number: 98123456", "Mail:a@b.co, (official)", "Email id:", "x@y.co none")
    boxes = spark.createDataFrame([(1, 0, 0, 0, 70.0, 0.0, 110.0, 10.0), (1, 0, 1, 1, 25.0, 12.0, 55.0, 22.0), (1, 0, 2, 3, 0.0, 36.0, 30.0, 46.0), (2, 0, 0, 0, 5.0, 0.0, 9.0, 10.0)], RECT)
    marks = spark.createDataFrame([(1, 0, 101.0, 2.0, 113.0, 10.0), (1, 0, 300.0, 2.0, 313.0, 10.0), (2, 0, 0.0, 40.0, 9.0, 50.0)], "conv_id long, block int, x0 double, y0 double, x1 double, y1 double")
    out = layout.absorb(boxes, words, marks)
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, 0, 0, 0.0, 0.0, 113.0, 10.0), (1, 0, 1, 0.0, 12.0, 115.0, 22.0), (1, 0, 2, 0.0, 24.0, 45.0, 46.0), (2, 0, 0, 5.0, 0.0, 9.0, 10.0),
    ]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.count("HashAggregate(keys=[conv_id") <= 2


def test_edits_are_counted_in_bytes(spark):
    pairs = spark.createDataFrame([("éç@b.co", "x@b.co"), ("né@b.co", "ne@b.co"), ("a@b.co", "xa@b.co")], "a string, b string")
    assert [tuple(r) for r in pairs.select(known.edits(F.col("a"), F.col("b")), known.edits(F.col("a"), F.col("b"), 2), known.capped_distance(F.col("a"), F.col("b"))).collect()] == [(4, -1, 4), (2, 2, 2), (1, 1, 1)]
    mails = spark.createDataFrame([(1, "xksnh@b.co")], "conv_id long, email string")
    found = known.snap_emails(page(spark, "éç ksnh@b.co les"), mails, ["conv_id", "block", "line_no"], ["conv_id"]).collect()
    assert [(r.i, r.j) for r in found] == [(1, 1)]


@pytest.mark.parametrize("rows_at_once", ["1", "3", "1000"])
def test_pages_are_folded_in_a_stream(spark, rows_at_once):
    kind = "conv_id long, block int, pass int, word_no int, word string, x0 double, y0 double, x1 double, y1 double, conf double"
    one = [(0, 0, "A", 0.0, 0.0, 10.0, 10.0, 60.0), (0, 1, "b", 20.0, 0.0, 30.0, 10.0, 60.0), (1, 0, "B", 21.0, 0.0, 30.0, 10.0, 80.0), (1, 1, "a", 1.0, 0.0, 10.0, 10.0, 60.0), (1, 2, "n", 50.0, 0.0, 60.0, 10.0, None)]
    pages = [(7, 0), (7, 1), (None, 0), (8, None), (9, 0)]
    ocr = spark.createDataFrame([(*p, *w) for p in pages for w in one], kind)
    boxes = [(0, 0.0, 0.0, 10.0, 10.0), (1, 15.0, 1.0, 30.0, 12.0), (2, 40.0, 11.0, 50.0, 20.0), (3, 90.0, 11.0, 95.0, 20.0)]
    rects = spark.createDataFrame([(*p, *r) for p in pages for r in boxes], "conv_id long, block int, rect int, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([(9, 0, "solid", 31.0, 39.0, 0.0, 10.0), (9, 0, "--", 11.0, 14.0, 0.0, 10.0), (10, 0, "alone", 0.0, 9.0, 0.0, 9.0)], "conv_id long, block int, word string, x0 double, x1 double, y0 double, y1 double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_at_once)
    try:
        merged, bridged = layout.merge_passes(ocr), layout.bridge(rects, words)
        assert sorted(((r.conv_id, r.block, r.word) for r in merged.collect()), key=repr) == sorted(((*p, w) for p in pages for w in "ABn"), key=repr)
        far = (3, 90.0, 11.0, 95.0, 20.0)
        whole = [[(0, 0.0, 0.0, 50.0, 20.0), far], [(0, 0.0, 0.0, 30.0, 12.0), (2, 40.0, 11.0, 50.0, 20.0), far]]
        assert sorted((tuple(r) for r in bridged.collect()), key=repr) == sorted(((*p, *r) for p in pages for r in whole[p == (9, 0)]), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for out in (merged, bridged):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "MapInArrow" in plan and "InPandas" not in plan  # no call for each page


def test_the_best_file_never_depends_on_the_order_of_rows(spark):
    rows = [(1, 5, "2001-08-28", "file", "applicant", f"resume_{n}.PDF") for n in (5150, 3862, 7000)]
    kind = "applicant_id long, file_no int, created_at string, storage string, parent string, name string"
    for some in (rows, rows[::-1]):
        assert [r.name for r in resolve.best_file(spark.createDataFrame(some, kind)).collect()] == ["resume_3862.PDF"]
