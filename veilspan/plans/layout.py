"""Layout queries over the page words that conversations give. Rects are the boxes of capitalised words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import layout
from ..sources.records import CARDS_SQL, WORDS_SQL, cards, reading_order, words
from .registry import Catalog, quoted

CATALOG = Catalog()
query = CATALOG.query

#: A rect for every capitalised word; a mark, 12 points wide, behind each; images around every tenth word.
RECTS_SQL = f"""{WORDS_SQL}, rects AS (SELECT conv_id, block, line_no, line_no * 10000 + word_no AS rect, x0, y0 - 4 AS y0, x1, y1 + 4 AS y1, word FROM words WHERE regexp_matches(word, '^[A-Z]')),
marks AS (SELECT conv_id, block, x1 - 9 AS x0, y0 + 2 AS y0, x1 + 3 AS x1, y1 AS y1, rect FROM rects)"""


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = words(spark, sf_dir).filter(F.col("word").rlike("^[A-Z]"))
    return caps.select("conv_id", "block", "line_no", (F.col("line_no") * 10000 + F.col("word_no")).alias("rect"), "x0", (F.col("y0") - 4).alias("y0"), "x1", (F.col("y1") + 4).alias("y1"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rects(spark, sf_dir).select("conv_id", "block", "rect", (F.col("x1") - 9).alias("x0"), (F.col("y0") + 2).alias("y0"), (F.col("x1") + 3).alias("x1"), "y1")


@query(f"WITH {WORDS_SQL} SELECT conv_id, block, line_no, word_no, word, x0, y0, x1, y1 FROM words")
def s02_w04_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("conv_id", "block", "line_no", "word_no", "word", "x0", "y0", "x1", "y1")


@query(f"WITH {RECTS_SQL} SELECT conv_id, block, rect FROM marks WHERE (x1 - x0) * (y1 - y0) < 0.25 * 600")
def s03_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_marks(marks(spark, sf_dir), 600.0).select("conv_id", "block", "rect")


@query(f"WITH {WORDS_SQL} SELECT conv_id, block, line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM words GROUP BY 1, 2, 3")
def a04_bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return words(spark, sf_dir).groupBy("conv_id", "block", "line_no").agg(*edges, F.count(F.lit(1)).alias("n"))


@query(f"WITH {WORDS_SQL} SELECT conv_id, block, line_no, word_no, CAST(sum(length(word) + 1) OVER (PARTITION BY conv_id, block, line_no ORDER BY x0) - length(word) - 1 AS BIGINT) AS offset_chars FROM words")
def w05_running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    upto = F.sum(F.length("word") + 1).over(reading_order()) - F.length("word") - 1
    return words(spark, sf_dir).select("conv_id", "block", "line_no", "word_no", upto.cast("long").alias("offset_chars"))




@query(f"WITH {WORDS_SQL}, g AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY conv_id, block, line_no ORDER BY x0) > 0.5 * (y1 - y0) - 0.5 THEN 1 ELSE 0 END AS new FROM words) SELECT conv_id, block, line_no, word_no, CAST(sum(new) OVER (PARTITION BY conv_id, block, line_no ORDER BY x0) AS INTEGER) AS piece FROM g")
def w06_gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps over 0.45 of the height here: words of this pitch are one blank apart, so that each starts a piece."""
    return layout.gap_split(words(spark, sf_dir), 0.45).select("conv_id", "block", "line_no", "word_no", "piece")


@query(f"WITH {WORDS_SQL} SELECT conv_id, block, line_no, word_no, string_agg(word, ' ') OVER (PARTITION BY conv_id, block, line_no ORDER BY x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM words")
def w08_words_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.collect_list("word").over(reading_order().rowsBetween(Window.unboundedPreceding, -1))
    return words(spark, sf_dir).select("conv_id", "block", "line_no", "word_no", F.when(F.size(held) > 0, F.array_join(held, " ")).alias("before"))


@query(f"WITH {RECTS_SQL} SELECT r.conv_id, r.block, r.rect, count(*) AS n_words FROM rects r JOIN words w ON w.conv_id = r.conv_id AND w.block = r.block AND w.x1 > r.x0 AND w.x0 < r.x1 AND w.y1 > r.y0 AND w.y0 < r.y1 GROUP BY 1, 2, 3")
def j09_words_on_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = layout.touched(words(spark, sf_dir), rects(spark, sf_dir).drop("line_no"))
    return met.groupBy("conv_id", "block", F.col("r_rect").alias("rect")).agg(F.count(F.lit(1)).alias("n_words"))


@query(
    f"""WITH {RECTS_SQL}, many AS (SELECT conv_id, block, rect, x0, y0, x1, y1 FROM rects UNION ALL SELECT conv_id, block, rect + 5000000, x0 + 5, y0, x1, y1 FROM rects WHERE x1 - x0 > 20 UNION ALL SELECT conv_id, block, rect + 9000000, x0, y0, x1, y1 FROM rects WHERE rect % 2 = 0)
SELECT conv_id, block, rect FROM many a WHERE NOT EXISTS (SELECT 1 FROM many o WHERE o.conv_id = a.conv_id AND o.block = a.block AND o.x0 <= a.x0 AND o.y0 <= a.y0 AND o.x1 >= a.x1 AND o.y1 >= a.y1
  AND ((o.x1 - o.x0) * (o.y1 - o.y0) > (a.x1 - a.x0) * (a.y1 - a.y0) OR ((o.x1 - o.x0) * (o.y1 - o.y0) = (a.x1 - a.x0) * (a.y1 - a.y0) AND o.rect < a.rect)))"""
)
def j10_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = rects(spark, sf_dir).drop("line_no")
    inner = base.filter("x1 - x0 > 20").withColumn("rect", F.col("rect") + 5000000).withColumn("x0", F.col("x0") + 5)
    twins = base.filter("rect % 2 = 0").withColumn("rect", F.col("rect") + 9000000)
    return layout.without_contained(base.unionByName(inner).unionByName(twins)).select("conv_id", "block", "rect")


@query(
    f"""WITH {RECTS_SQL} SELECT w.conv_id, w.block, w.line_no, w.word_no FROM words w WHERE NOT EXISTS (SELECT 1 FROM rects r WHERE r.conv_id = w.conv_id AND r.block = w.block
AND greatest(0, least(w.x1, r.x1) - greatest(w.x0, r.x0)) * greatest(0, least(w.y1, r.y1) - greatest(w.y0, r.y0)) > 0.3 * least((w.x1 - w.x0) * (w.y1 - w.y0), (r.x1 - r.x0) * (r.y1 - r.y0)))"""
)
def j11_ocr_without_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.without_native(words(spark, sf_dir), rects(spark, sf_dir)).select("conv_id", "block", "line_no", "word_no")


@query(f"WITH {WORDS_SQL} SELECT conv_id, block, CAST(dense_rank() OVER (PARTITION BY conv_id, block ORDER BY y0) - 1 AS INTEGER) AS \"row\", y0, y1, CAST(count(*) AS INTEGER) AS n_words FROM words GROUP BY conv_id, block, y0, y1")
def g01_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.rows_of(words(spark, sf_dir)).select("conv_id", "block", "row", "y0", "y1", F.size("words").alias("n_words"))


@query(f"WITH {WORDS_SQL} SELECT conv_id, block, CAST(dense_rank() OVER (PARTITION BY conv_id, block ORDER BY line_no) - 1 AS INTEGER) AS \"row\", line_no, word_no FROM words")
def g02_ocr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In this pitch every line is a row of its own, which is what the oracle says."""
    return layout.grouped_by_centre(words(spark, sf_dir)).select("conv_id", "block", "row", "line_no", "word_no")


@query(
    f"""WITH {RECTS_SQL}, s AS (SELECT r.conv_id, r.block, r.rect, r.y0, r.y1, min(w.y0) FILTER (WHERE w.line_no <> r.line_no AND (w.y0 + w.y1) / 2 >= (r.y0 + r.y1) / 2) AS bottom,
  max(w.y1) FILTER (WHERE w.line_no <> r.line_no AND (w.y0 + w.y1) / 2 < (r.y0 + r.y1) / 2) AS top
FROM rects r LEFT JOIN words w ON w.conv_id = r.conv_id AND w.block = r.block AND w.x1 > r.x0 AND w.x0 < r.x1 AND w.y1 > r.y0 AND w.y0 < r.y1 GROUP BY ALL)
SELECT conv_id, block, rect, greatest(y0, coalesce(top, y0)) AS y0, least(y1, coalesce(bottom, y1)) AS y1 FROM s"""
)
def g03_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.clip_to_line(rects(spark, sf_dir), words(spark, sf_dir)).select("conv_id", "block", "rect", "y0", "y1")


@query(
    f"""WITH RECURSIVE {RECTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY round(y0, 1), x0, rect) AS k FROM rects),
walk AS (SELECT conv_id, block, k, rect, x0, y0, x1, y1, k AS chain FROM o WHERE k = 1
  UNION ALL SELECT n.conv_id, n.block, n.k, CASE WHEN c.joins THEN least(w.rect, n.rect) ELSE n.rect END, CASE WHEN c.joins THEN w.x0 ELSE n.x0 END, CASE WHEN c.joins THEN least(w.y0, n.y0) ELSE n.y0 END, n.x1,
    CASE WHEN c.joins THEN greatest(w.y1, n.y1) ELSE n.y1 END, CASE WHEN c.joins THEN w.chain ELSE n.k END
  FROM walk w JOIN o n ON n.conv_id = w.conv_id AND n.block = w.block AND n.k = w.k + 1,
  LATERAL (SELECT w.y1 > n.y0 AND n.y1 > w.y0 AND n.x0 - w.x1 BETWEEN 0 AND {fixed.BRIDGE_MAX_GAP} AND NOT EXISTS (SELECT 1 FROM words t WHERE t.conv_id = n.conv_id AND t.block = n.block AND regexp_matches(t.word, '[\\p{{L}}\\p{{N}}]')
    AND t.x0 >= w.x1 - 0.5 AND t.x1 <= n.x0 + 0.5 AND t.y1 > least(w.y0, n.y0) AND t.y0 < greatest(w.y1, n.y1)) AS joins) c)
SELECT conv_id, block, rect, x0, y0, x1, y1 FROM walk w WHERE k = (SELECT max(k) FROM walk v WHERE v.conv_id = w.conv_id AND v.block = w.block AND v.chain = w.chain)"""
)
def g04_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.bridge(rects(spark, sf_dir).drop("line_no"), words(spark, sf_dir))


@query(
    f"""WITH {RECTS_SQL}, short AS (SELECT conv_id, block, rect, x0, y0, x1 - 5 AS x1, y1 FROM rects),
met AS (SELECT s.*, w.x0 AS wx0, w.x1 AS wx1, w.x0 < s.x0 - 0.5 AND s.x0 < w.x1 AND regexp_matches(w.word, {quoted(fixed.GLUED_LABEL)}) AS starts,
  w.x0 + 0.5 < s.x1 AND s.x1 < w.x1 - 0.5 AND w.x1 - s.x1 <= (w.x1 - w.x0) / greatest(length(w.word), 1) * length(regexp_extract(w.word, {quoted(fixed.GLUED_TAIL)})) + 1 AND length(regexp_extract(w.word, {quoted(fixed.GLUED_TAIL)})) > 0 AS ends
  FROM short s LEFT JOIN words w ON w.conv_id = s.conv_id AND w.block = s.block AND w.y1 > s.y0 AND w.y0 < s.y1)
SELECT conv_id, block, rect, coalesce(min(wx0) FILTER (WHERE starts), x0) AS x0, y0, coalesce(max(wx1) FILTER (WHERE ends), x1) AS x1, y1 FROM met GROUP BY conv_id, block, rect, x0, y0, x1, y1"""
)
def g05_g06_glued(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = rects(spark, sf_dir).withColumn("x1", F.col("x1") - 5)
    return layout.glued(short.drop("line_no"), words(spark, sf_dir))


@query(f"WITH {WORDS_SQL} SELECT word, regexp_matches(trim(word), {quoted(fixed.CONTACT_LABEL)}) AS label, regexp_matches(trim(word), {quoted(fixed.LABEL_CONNECTOR)}) AS connector, count(*) AS n FROM words GROUP BY 1, 2, 3")
def g07_g08_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = words(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("word", layout.is_label(F.col("word")).alias("label"), layout.is_connector(F.col("word")).alias("connector"), "n")


def values_of_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rect on the number and on each address of a card."""
    held = cards(spark, sf_dir).filter(F.col("word").rlike("[0-9]"))
    return held.select("conv_id", "block", "line_no", (F.col("line_no") * 10000 + F.col("word_no")).alias("rect"), "x0", "y0", "x1", "y1")


@query(
    f"""WITH {CARDS_SQL} SELECT conv_id, CAST(0 AS INTEGER) AS block, CAST(4 AS INTEGER) AS rect, CAST(5.0 * (strpos(l0, 'Phone') - 1) AS DOUBLE) AS edge, 'left' AS side FROM cards
UNION ALL SELECT conv_id, 0, 10003, 5.0 * length(l1), 'right' FROM cards"""
)
def g09_label_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels before the number and behind the first address; the prose before that one lets nothing grow."""
    values, on = values_of_cards(spark, sf_dir), cards(spark, sf_dir)
    left = layout.walk_labels(values, on, False).withColumn("side", F.lit("left"))
    return left.unionByName(layout.walk_labels(values, on, True).withColumn("side", F.lit("right")))


@query(
    f"""WITH {RECTS_SQL} SELECT r.conv_id, r.block, r.rect, least(r.x0, coalesce(min(m.x0) FILTER (WHERE ok), r.x0)) AS x0, greatest(r.x1, coalesce(max(m.x1) FILTER (WHERE ok), r.x1)) AS x1 FROM
(SELECT r.*, m.x0 AS mx0, m.x1 AS mx1, m.x0 >= r.x0 - 24 AND m.x1 <= r.x1 + 24 AND least(greatest(0, least(m.x1, r.x1) - greatest(m.x0, r.x0)) / (m.x1 - m.x0), greatest(0, least(m.y1, r.y1) - greatest(m.y0, r.y0)) / (m.y1 - m.y0)) >= 0.7 AS ok
  FROM rects r LEFT JOIN marks m ON m.conv_id = r.conv_id AND m.block = r.block) r, (SELECT 1) one, LATERAL (SELECT r.mx0 AS x0, r.mx1 AS x1) m GROUP BY r.conv_id, r.block, r.rect, r.x0, r.x1"""
)
def g10_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.absorb_marks(rects(spark, sf_dir).drop("line_no"), marks(spark, sf_dir).drop("rect")).select("conv_id", "block", "rect", "x0", "x1")


@query(f"WITH {CARDS_SQL} SELECT conv_id, CAST(0 AS INTEGER) AS block, CAST(30000 AS INTEGER) AS rect, CAST(0 AS DOUBLE) AS x0, CAST(24 AS DOUBLE) AS y0, CAST(5.0 * greatest(length(l2), length(l3)) AS DOUBLE) AS x1, CAST(46 AS DOUBLE) AS y1 FROM cards")
def g11_label_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.label_above(values_of_cards(spark, sf_dir).drop("line_no"), cards(spark, sf_dir))


@query(
    f"""WITH {CARDS_SQL} SELECT conv_id, CAST(0 AS INTEGER) AS block, CAST(4 AS INTEGER) AS rect, CAST(5.0 * (strpos(l0, 'Phone') - 1) AS DOUBLE) AS x0, CAST(0 AS DOUBLE) AS y0, CAST(5.0 * length(l0) + 3 AS DOUBLE) AS x1, CAST(10 AS DOUBLE) AS y1 FROM cards
UNION ALL SELECT conv_id, 0, 10003, 60.0, 12.0, 5.0 * length(l1), 22.0 FROM cards
UNION ALL SELECT conv_id, 0, 30000, 0.0, 24.0, 5.0 * greatest(length(l2), length(l3)) + 3, 46.0 FROM cards"""
)
def g12_absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rects grown over their labels, then over a mark at the end of each value (the first address has grown past its own)."""
    values = values_of_cards(spark, sf_dir)
    drawn = values.select("conv_id", "block", (F.col("x1") - 9).alias("x0"), (F.col("y0") + 2).alias("y0"), (F.col("x1") + 3).alias("x1"), "y1")
    return layout.absorb(values, cards(spark, sf_dir), drawn)


@query(
    f"""WITH {RECTS_SQL}, images AS (SELECT * FROM rects WHERE x0 >= 0.6 * 600 AND y1 <= 0.3 * 800 AND (x1 - x0) * (y1 - y0) <= 0.2 * 480000)
SELECT conv_id, block, rect FROM images i WHERE NOT EXISTS (SELECT 1 FROM words w WHERE w.conv_id = i.conv_id AND w.block = i.block
AND greatest(0, least(w.x1, i.x1) - greatest(w.x0, i.x0)) * greatest(0, least(w.y1, i.y1) - greatest(w.y0, i.y0)) > 0.5 * (w.x1 - w.x0) * (w.y1 - w.y0))"""
)
def g13_corner_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.corner_images(rects(spark, sf_dir).drop("line_no"), words(spark, sf_dir), 600.0, 800.0).select("conv_id", "block", "rect")


@query(f"WITH {RECTS_SQL} SELECT conv_id, block, line_no, word_no, word FROM words w WHERE NOT EXISTS (SELECT 1 FROM rects r WHERE r.conv_id = w.conv_id AND r.block = w.block AND w.x1 > r.x0 AND w.x0 < r.x1 AND w.y1 > r.y0 AND w.y0 < r.y1)")
def g14_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.redacted_words(words(spark, sf_dir), rects(spark, sf_dir)).select("conv_id", "block", "line_no", "word_no", "word")


@query(
    f"""WITH {WORDS_SQL} SELECT conv_id, block, CAST(1 - word_no % 2 AS INTEGER) AS "pass", word_no, word, CASE WHEN word_no % 2 = 0 THEN x0 + 1 ELSE x0 END AS x0, y0, x1, y1,
  CAST(CASE WHEN word_no % 2 = 0 THEN 80 ELSE 60 END AS DOUBLE) AS conf FROM words"""
)
def g15_merge_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    one = w.withColumn("pass", F.lit(0)).withColumn("conf", F.lit(60.0))
    two = w.withColumn("pass", F.lit(1)).withColumn("x0", F.col("x0") + 1).withColumn("conf", F.when(F.col("word_no") % 2 == 0, 80.0).otherwise(40.0))
    return layout.merge_passes(one.unionByName(two))


@query(
    f"""WITH {RECTS_SQL}, r AS (SELECT conv_id, block, line_no, min(y0) AS y0, max(y1) AS y1, CAST(dense_rank() OVER (PARTITION BY conv_id, block ORDER BY line_no) - 1 AS INTEGER) AS no FROM words GROUP BY 1, 2, 3),
o AS (SELECT q.conv_id, q.block, q.rect, r.no, least(q.y1, r.y1) - greatest(q.y0, r.y0) AS overlap FROM rects q JOIN r ON r.conv_id = q.conv_id AND r.block = q.block)
SELECT conv_id, block, rect, no AS "row", overlap FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, block, rect ORDER BY overlap DESC, no) AS k FROM o WHERE overlap > 0) WHERE k = 1"""
)
def w07_best_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.row_for(rects(spark, sf_dir).drop("line_no"), layout.rows_of(words(spark, sf_dir)))
