import pytest
from pyspark.sql import functions as F

from veilspan.functions import emails, phones, scalars, spans
from veilspan.operators import detect


def each(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def cut(text, found):
    return [(text[s.start : s.end], s.kind) for s in found]


FIRST_PASS = {
    "9812345670": ["9812345670"], "98123 45670": ["98123 45670"], "+91-98123-45670": ["+91-98123-45670"], "0091 98123 45670": [], "(415) 555-0199 x": ["(415) 555-0199"],
    "Mobile: 4455667": ["4455667"], "Phone No. - 022 23456789": ["022 23456789"], "Alt 9812345670 / 9898989898, 7012345678": ["9812345670", "9898989898", "7012345678"],
    "2017 - 2021": [], "06-2016 - 05-2019": [], "4821-9930-1177": [], "1234 5678 9012": [], "Employee Code 9812345670": [], "Order Number: 9812345670": [], "Contact Number: 9812345670": ["9812345670"],
    "ISBN 978-3-16-148410-0": [], "Processed 1500000000 rows": [], "version 2.7.1": [], "Salary 9812345670": [], "98123\n45670": [], "555-123-4567": ["555-123-4567"], "0755-123456": ["0755-123456"], "": [],
}


@pytest.mark.parametrize("fold", [0])
def test_first_pass_numbers(spark, fold):
    assert each(spark, list(FIRST_PASS), phones.find_phones) == list(FIRST_PASS.values())


SECOND_PASS = {
    "91 9812345670": ["91 9812345670"], "09812345670": ["09812345670"], "9812345670 9898989898": ["9812345670", "9898989898"], "+91 98123 45670": ["+91 98123 45670"],
    "Mobile9812345670": ["9812345670"], "HDFC0001234567": [], "Revenue was 9500000000 rupees": [], "Mobile: 9500000000": ["9500000000"], "12-04-2019": [], "8.94/10.0": [],
    "Credential ID 4821 9812345670": [], "9876543 B2": [], "00 49 30 1234567": ["00 49 30 1234567"], "91 22 2345 6789": ["91 22 2345 6789"], "0120-2345678": ["0120-2345678"],
    "2017 - 2021": [], "1234 5678 9012": [], "123456789012": [], "1700000000": [], "call 9812345670\nPAN: 9898989898": ["9812345670"], "011-23456789": ["011-23456789"],
}


def test_second_pass_numbers(spark):
    for text, found in zip(SECOND_PASS, each(spark, list(SECOND_PASS), phones.scan_phones), strict=True):
        assert [text[s.start : s.end] for s in found] == SECOND_PASS[text], text


MAILS = {
    "write to a.b+c@x-y.co.in.": ["a.b+c@x-y.co.in"], "A.B@EXAMPLE.COM, c@d.org": ["A.B@EXAMPLE.COM", "c@d.org"], "jo . doe@x.com": ["jo . doe@x.com"], "jo.doe@ x.com": ["jo.doe@ x.com"],
    "jo (at) x (dot) com": ["jo (at) x (dot) com"], "jo[at]x[dot]org": ["jo[at]x[dot]org"], "jo@x.com. Then we": ["jo@x.com"], "logo@2x.png": [], "react@18.2.0": [], "bootstrap@5.min.css": [], "@handle": [], "a@b": [],
    "mailto:jo@x.com": ["jo@x.com"], "9812345670@example.com": ["9812345670@example.com"], "jo@acme. Then we shipped": [], "(jo@x.com)": ["jo@x.com"],
}


def test_second_pass_addresses(spark):
    for text, found in zip(MAILS, each(spark, list(MAILS), emails.scan_emails), strict=True):
        assert [text[s.start : s.end] for s in found] == MAILS[text], text


def test_addresses_win_over_numbers(spark):
    text = "9812345670@example.com 9812345670"
    assert cut(text, each(spark, [text], emails.scan_residual)[0]) == [("9812345670@example.com", "email"), ("9812345670", "phone")]


def test_long_lines_are_scanned_in_reasonable_time(spark):
    text = "lorem ipsum 12 dolor 2019 sit amet 3.5 " * 300
    assert each(spark, [text] * 40, emails.scan_residual)[0] == []


def test_numbering_plan(spark):
    plan = {"9812345670": "9812345670", "919812345670": "9812345670", "09812345670": "9812345670", "00919812345670": "9812345670", "0919812345670": "9812345670", "12345": None, "929812345670": None, "2223456789": "2223456789"}
    assert each(spark, list(plan), phones.national_number) == list(plan.values())
    assert each(spark, list(plan), phones.is_mobile) == [True] * 5 + [False] * 3


LISTS = {
    "9812345670    9898989898": ["9812345670", "9898989898"], "999999 9999999999": ["9999999999"], "9812345670 (A)": ["9812345670"], "Mary  Smith": ["Mary  Smith"], "98123 45670": ["98123 45670"],
    "+91 98123 45670,+1 415 555 0199": ["+91 98123 45670", "+1 415 555 0199"], "9812345670 +919898989898": ["9812345670", "+919898989898"], "9812345670/9898989898": ["9812345670", "9898989898"],
}


def test_number_lists(spark):
    assert each(spark, list(LISTS), phones.split_phone_list) == list(LISTS.values())
    values = [None, " ", "a@x.com", "9812345670/9898989898", "9898989898", "a@x.com"]
    assert each(spark, [values], phones.expand, "array<string>") == [["a@x.com", "9812345670", "9898989898"]]


def test_kinds(spark):
    kinds = {"a@x.com": "email", " +91 98123 45670 ": "phone", "12345": "name", "Mary": "name", "a@x.com b": "name", "1234567890123456": "name"}
    assert each(spark, list(kinds), phones.classify) == list(kinds.values())


def test_equivalence(spark):
    cases = [("9812345670", "919812345670", True), ("4319812345670", "9812345670", True), ("12345678", "1112345678", False), ("02345678", "2345678", True), ("9812345670", "9812345671", False), ("123456", "123456", False), ("9812345670", "12349812345670", False)]
    rows = spark.createDataFrame(cases, "a string, b string, want boolean")
    for r in rows.select("a", "b", "want", phones.equivalent(F.col("a"), F.col("b")).alias("x"), phones.equivalent(F.col("b"), F.col("a")).alias("y")).collect():
        assert r.x == r.want and r.y == r.want, r


def test_spans_are_code_points(spark):
    text = "\U0001f600é 12 x 345"
    assert [(s.start, s.end, s.value) for s in each(spark, [text], lambda c: spans.spans(c, r"\p{Nd}+"))[0]] == [(3, 5, "12"), (8, 11, "345")]


def test_masking_and_scores(spark):
    docs = spark.createDataFrame([(1, "Call 98123 45670 or a@x.com today", "g"), (2, "nothing here", "g"), (3, None, "g"), (4, "alt 09812345670", "g")], "doc_id long, text string, grp string")
    out = {r.doc_id: (r.masked, r.regions) for r in detect.mask(docs.select("doc_id", "text")).collect()}
    assert out == {1: ("Call  or  today", 2), 2: ("nothing here", 0), 3: (None, 0), 4: ("alt ", 1)}
    known = docs.filter("doc_id = 2").withColumn("text", F.lit("tel (022) 23456789, JO@X.COM")).withColumn("k", F.array(F.lit("+912223456789"), F.lit("jo@x.com")))
    assert detect.mask(known, "k", "#").first().masked == "tel #, #"
    truth = {1: (["98123 45670", "a@x.com"], ["Call", "today"]), 2: ([], ["nothing here"]), 3: ([], []), 4: (["09812345670"], ["alt"])}
    given = spark.createDataFrame([(*r, *truth[r.doc_id]) for r in docs.collect()], "doc_id long, text string, grp string, must_mask array<string>, must_survive array<string>")
    score = detect.score(given).first()
    assert (score.leaks, score.over_masked, score.positives, score.negatives) == (0, 0, 3, 4) and score.accuracy == 1.0


def test_links_and_metadata(spark):
    assert each(spark, ["mailto:x", "TEL:1", "https://a.b/c", "https://a.b/?m=jo@x.com", "sms:1", None], detect.is_contact_link) == [True, True, False, True, True, False]
    row = detect.scrub_metadata(spark.createDataFrame([("Jo Doe", "jo@x.com", None)], "author string, title string, subject string"), ["author", "title", "subject"]).first()
    assert (row.author, row.title, row.subject) == ("Jo Doe", "", None)


def test_scalars(spark):
    assert each(spark, ["4", "1", "2.5", "four", "1.0", ""], scalars.years) == ["4 years", "1 year", "2.5 years", "four", "1 year", ""]
    assert each(spark, ["2001-06-07", "2001-06-07T10:00", "June", "2001-13-40", None], scalars.long_date) == ["07 June 2001", "07 June 2001", "June", "2001-13-40", None]
    assert each(spark, ["a; B,a|b\n c •A", None, ""], scalars.split_list) == [["a", "B", "c"], [], []]
    assert each(spark, ["code: 503 x", "invalid_grant: server is busy", "bad id", None], scalars.is_transient) == [True, False, False, False]
    assert each(spark, ["masked_x.pdf", "MASKED_", "resume.PDF", "noext"], scalars.is_masked_output) == [True, True, False, False]
    assert each(spark, ["a.b.PDF", "noext", "x."], scalars.extension) == ["pdf", "", ""]
    assert each(spark, ["a1B2c3D4e5F6g7H", "short", "a" * 19, "a" * 18, "a b"], scalars.is_safe_id) == [True, False, False, True, False]
    assert each(spark, ["AéĀ\U0001f600"], scalars.latin1) == ["Aé??"]
    assert each(spark, [f"{'a' * 15}, {'b' * 18};{'a' * 15} {'c' * 16}"], scalars.harvest_ids) == [f"{'a' * 15};{'b' * 18}"]
    assert each(spark, [bytearray(b"\x89PNG\r\n\x1a\nx"), bytearray(b"\xff\xd8\xff\xe0"), bytearray(b"GIF8"), None], scalars.image_kind, "binary") == ["png", "jpeg", None, None]


def test_score_counts_the_whole_text_and_each_pass(spark):
    many = " ".join(f"word{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(60))
    schema = "doc_id long, text string, grp string, must_mask array<string>, must_survive array<string>"
    docs = spark.createDataFrame([
        (1, f"{many} ñandú, été (zu)", "a", [], [*many.split(), "ñandú", "été", "zu"]), (None, "mail jane@corp.io please", "b", ["jane@corp.io"], ["mail", "please"]),
    ], schema)
    rows = {(r.grp, r.passes): r for r in detect.score(docs).collect()}
    assert set(rows) == {(g, p) for g in "ab" for p in ("both", "first")}
    assert rows["a", "both"].negatives == 63 and rows["a", "both"].over_masked == 0
    assert rows["b", "first"].positives == 1 and rows["b", "both"].leaks == 0 and rows["b", "both"].negatives == 2
    lost = spark.createDataFrame([(1, f"{many} jane (at) corp (dot) com", "a", ["jane (at) corp (dot) com"], [*many.split(), "jane"])], schema)
    rows = {r.passes: r for r in detect.score(lost).collect()}
    assert rows["both"].leaks == 0 and rows["first"].leaks == 1
    assert rows["both"].over_masked == 1 and rows["first"].over_masked == 0
