"""Page layout: rows, lines, clipping, labels, marks, images, OCR words.

Every operator meets only what stands on one page: pages are the equi key of all joins, vertical spans the range
condition beside it. Order-dependent folds run over the sorted words of one page, inside a row, as higher-order functions;
a page's words are bounded, so no group grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import fixed
from ..functions.spans import bind

PAGE = ["conv_id", "block"]
#: Boxes that merge_passes compares at once.
MERGE_CELLS = 1_000_000
WORD = "struct<y0:double,x0:double,word_no:int,line_no:int,word:string,x1:double,y1:double>"


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def common(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area that two boxes share."""
    return area(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in ("x0", "y0", "x1", "y1")}


def named(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keys])


def rows_of(words: DataFrame) -> DataFrame:
    """Rows of a page: words from the top, each into the latest of the last three rows that its centre lies in, or whose
    middle lies in it; rows grow with their words. page, row, y0, y1 and the row's words from left to right."""
    word = F.struct("y0", "x0", "word_no", "line_no", "word", "x1", "y1")
    row = f"array<struct<no:int,y0:double,y1:double,words:array<{WORD}>>>"

    def step(rows: Column, w: Column) -> Column:
        cy = (w["y0"] + w["y1"]) / 2
        n = F.size(rows)

        def fits(r: Column) -> Column:
            mid = (r["y0"] + r["y1"]) / 2
            recent = r["no"] >= n - fixed.OPEN_ROWS
            return recent & (((r["y0"] < cy) & (cy < r["y1"])) | ((w["y0"] < mid) & (mid < w["y1"])))

        at = F.array_max(F.transform(F.filter(rows, fits), lambda r: r["no"]))
        new = F.concat(rows, F.array(F.struct(n.alias("no"), w["y0"].alias("y0"), w["y1"].alias("y1"), F.array(w).alias("words"))))
        grown = F.transform(rows, lambda r: F.when(r["no"] == at, F.struct(r["no"].alias("no"), F.least(r["y0"], w["y0"]).alias("y0"), F.greatest(r["y1"], w["y1"]).alias("y1"), F.concat(r["words"], F.array(w)).alias("words"))).otherwise(r))
        return F.when(at.isNull(), new).otherwise(grown)

    pages = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(word)).alias("words"))
    folded = pages.select(*PAGE, F.explode(F.aggregate(F.col("words").cast(f"array<{WORD}>"), F.array().cast(row), step)).alias("r"))
    by_x = F.array_sort("r.words", lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).otherwise(0))
    return folded.select(*PAGE, F.col("r.no").alias("row"), "r.y0", "r.y1", by_x.alias("words"))


def gap_split(words: DataFrame, times: float = 3.0) -> DataFrame:
    """Lines with a column break where the gap to the word before is over ``times`` the line's height: piece counts up."""
    line = Window.partitionBy(*PAGE, "line_no").orderBy("x0")
    wide = F.col("x0") - F.lag("x1").over(line) > times * (F.col("y1") - F.col("y0"))
    rows = words.withColumn("_new", F.coalesce(wide.cast("int"), F.lit(0)))
    return rows.withColumn("piece", F.sum("_new").over(line).cast("int")).drop("_new")


def grouped_by_centre(words: DataFrame) -> DataFrame:
    """OCR rows: by vertical centre, each word into the first row whose centre is within half the larger height."""
    word = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.col("x0"), F.col("word_no"), F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")).alias("h"), F.col("line_no"))
    kind = "array<struct<no:int,cy:double,h:double,words:array<struct<line_no:int,word_no:int>>>>"

    def step(rows: Column, w: Column) -> Column:
        at = F.array_min(F.transform(F.filter(rows, lambda r: F.abs(r["cy"] - w["cy"]) < 0.5 * F.greatest(w["h"], r["h"])), lambda r: r["no"]))
        key = F.struct(w["line_no"].alias("line_no"), w["word_no"].alias("word_no"))
        new = F.concat(rows, F.array(F.struct(F.size(rows).alias("no"), w["cy"].alias("cy"), w["h"].alias("h"), F.array(key).alias("words"))))
        grown = F.transform(rows, lambda r: F.when(r["no"] == at, F.struct(r["no"].alias("no"), r["cy"].alias("cy"), r["h"].alias("h"), F.concat(r["words"], F.array(key)).alias("words"))).otherwise(r))
        return F.when(at.isNull(), new).otherwise(grown)

    pages = words.groupBy(*PAGE).agg(F.array_sort(F.collect_list(word)).alias("words"))
    return pages.select(*PAGE, F.explode(F.aggregate("words", F.array().cast(kind), step)).alias("r")).select(*PAGE, F.col("r.no").alias("row"), F.explode("r.words").alias("w")).select(*PAGE, "row", "w.*")


def touched(words: DataFrame, rects: DataFrame, share: float = 0.0) -> DataFrame:
    """(page, rect, word) where they share more than ``share`` of the word: an equi-join on the page, then spans."""
    met = words.join(named(rects, "r_", PAGE), PAGE).filter((F.col("y1") > F.col("r_y0")) & (F.col("y0") < F.col("r_y1")))
    return met.filter(common(box(), box("r_")) > share * area(**box()))


def row_for(rects: DataFrame, rows: DataFrame) -> DataFrame:
    """The row that each rect's vertical span overlaps most; rects that overlap none are left out."""
    met = rects.join(named(rows.select(*PAGE, "row", "y0", "y1"), "w_", PAGE), PAGE)
    overlap = F.least("y1", "w_y1") - F.greatest("y0", "w_y0")
    met = met.withColumn("_o", overlap).filter("_o > 0")
    best = met.groupBy(*PAGE, "rect").agg(F.max(F.struct(F.col("_o"), (-F.col("w_row")).alias("r"))).alias("b"))
    return best.select(*PAGE, "rect", (-F.col("b.r")).alias("row"), F.col("b._o").alias("overlap"))


def without_contained(rects: DataFrame) -> DataFrame:
    """Rects that no larger one (of equal ones: no earlier one) contains."""
    other = named(rects, "o_", PAGE)
    inside = (F.col("o_x0") <= F.col("x0")) & (F.col("o_y0") <= F.col("y0")) & (F.col("o_x1") >= F.col("x1")) & (F.col("o_y1") >= F.col("y1"))
    own, its = area(**box()), area(**box("o_"))
    cond = [rects[k] == other[k] for k in PAGE] + [inside, (its > own) | ((its == own) & (F.col("o_rect") < F.col("rect")))]
    whole = cond[0]
    for c in cond[1:]:
        whole = whole & c
    return rects.join(other, whole, "left_anti")


def clip_to_line(rects: DataFrame, words: DataFrame) -> DataFrame:
    """Rects (with the line they belong to) pulled back from words of other lines; left as they are where that leaves less
    than a point, or would lose one of their own words."""
    met = rects.join(named(words, "w_", PAGE), PAGE, "left").withColumn("_own", F.col("w_line_no") == F.col("line_no"))
    over = (common(box(), box("w_")) > 0) & ~F.col("_own")
    below = (F.col("w_y0") + F.col("w_y1")) / 2 >= (F.col("y0") + F.col("y1")) / 2
    own = F.col("_own") & (common(box(), box("w_")) > 0)
    keys = [*PAGE, "rect", "line_no", "x0", "y0", "x1", "y1"]
    sums = met.groupBy(*keys).agg(
        F.min(F.when(over & below, F.col("w_y0"))).alias("bottom"), F.max(F.when(over & ~below, F.col("w_y1"))).alias("top"),
        F.max(F.when(own, F.col("w_y0"))).alias("own_top"), F.min(F.when(own, F.col("w_y1"))).alias("own_bottom"),
    )
    top, bottom = F.greatest("y0", F.coalesce("top", "y0")), F.least("y1", F.coalesce("bottom", "y1"))
    lost = (F.col("own_top") >= bottom) | (F.col("own_bottom") <= top)
    keep = F.col("own_top").isNull() | (bottom - top < 1) | lost
    return sums.select(*PAGE, "rect", "line_no", "x0", F.when(keep, F.col("y0")).otherwise(top).alias("y0"), "x1", F.when(keep, F.col("y1")).otherwise(bottom).alias("y1"))


def by_page(rows: DataFrame, order: list[Column], of_page: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType) -> DataFrame:
    """``of_page`` of each page's rows in the given order. Pages are small and many, so they don't come one call each:
    sorted rows stream through, and every batch is cut where the page changes; its last page waits for the next batch."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def of_rows(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            cuts = [0, *new_pages(rows), rows.num_rows]
            made = [of_page(rows.slice(a, b - a)) for a, b in pairwise(cuts)]
            if made:
                yield pa.concat_batches(made)

        def new_pages(rows: pa.RecordBatch) -> list[int]:
            changes = np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
            for k in PAGE:
                column = rows.column(k)
                a, b = column.slice(0, len(changes)), column.slice(1)
                unlike = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
                changes |= unlike | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
            return (np.flatnonzero(changes) + 1).tolist()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([waiting[-1].slice(waiting[-1].num_rows - 1), batch]) if waiting else batch
            cuts = new_pages(rows)
            if waiting and not cuts:
                waiting.append(batch)
                continue
            held = 1 if waiting else 0  # the waiting page's last row stands before the batch
            last = cuts[-1] - held if cuts else 0
            whole = [*waiting, batch.slice(0, last)]
            waiting = [batch.slice(last)]
            if cuts:
                yield from of_rows(pa.concat_batches(whole))
        if waiting:
            yield from of_rows(pa.concat_batches(waiting))

    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE, *order).mapInArrow(pages, schema)


def numbers(rows: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [pc.cast(rows.column(n), pa.float64()).to_numpy(zero_copy_only=False) for n in names]


def bridge(rects: DataFrame, words: DataFrame) -> DataFrame:
    """Neighbours that share height become one where only punctuation stands between them, 24 points apart at most, again and
    again until no two do: a merged rect is as high as both, so it may meet its own neighbour. A page's rects, by number, and
    words come together once, and are a bounded group."""
    edges = ["x0", "y0", "x1", "y1"]

    def of_page(page: pa.RecordBatch) -> pa.RecordBatch:
        n = int(pc.sum(page.column("_rect")).as_py())
        x0, y0, x1, y1 = numbers(page, *edges)
        wx0, wy0, wx1, wy1 = x0[n:], y0[n:], x1[n:], y1[n:]
        kept: list[tuple] = []

        def joins(a: tuple, b: tuple) -> bool:
            if a[4] <= b[2] or b[4] <= a[2] or not 0 <= b[1] - a[3] <= fixed.BRIDGE_MAX_GAP:
                return False
            return not ((wx0 >= a[3] - 0.5) & (wx1 <= b[1] + 0.5) & (wy1 > min(a[2], b[2])) & (wy0 < max(a[4], b[4]))).any()

        order = np.lexsort((x0[:n], np.round(y0[:n], 1))).tolist()  # rects come by number, so ties stay so
        boxes = list(zip(range(n), x0[:n].tolist(), y0[:n].tolist(), x1[:n].tolist(), y1[:n].tolist(), strict=True))
        for k in order:
            kept.append(boxes[k])
            while len(kept) > 1 and joins(kept[-2], kept[-1]):
                b, a = kept.pop(), kept.pop()
                kept.append((min(a[0], b[0]), a[1], min(a[2], b[2]), b[3], max(a[4], b[4])))
        at = pa.array([k[0] for k in kept], pa.int64())
        out = [page.column(c).take(at) for c in (*PAGE, "rect")]
        out += [pc.cast(pa.array([k[i] for k in kept], pa.float64()), page.schema.field(c).type) for i, c in enumerate(edges, 1)]
        return pa.RecordBatch.from_arrays(out, names=columns)

    columns = [*PAGE, "rect", *edges]
    own = rects.select(*columns, F.lit(1).alias("_rect"))
    solid = words.filter(F.col("word").rlike(r"[\p{L}\p{N}]")).select(*PAGE, *edges, F.lit(0).alias("_rect"))
    return by_page(own.unionByName(solid, True), [F.desc("_rect"), F.col("rect")], of_page, rects.select(*columns).schema)


def is_label(word: Column) -> Column:
    return F.trim(word).rlike(fixed.CONTACT_LABEL)


def is_connector(word: Column) -> Column:
    return F.trim(word).rlike(fixed.LABEL_CONNECTOR)


def glue(rect: Column | dict[str, Column], word: Column | dict[str, Column]) -> tuple[Column, Column]:
    """Whether a rect starts inside a word, behind a label in it, and whether it ends inside one, before punctuation. The word
    is marked()."""
    starts = (word["x0"] < rect["x0"] - 0.5) & (rect["x0"] < word["x1"]) & word["stuck"]
    ends = (word["x0"] + 0.5 < rect["x1"]) & (rect["x1"] < word["x1"] - 0.5) & (word["tail"] > 0)
    per = (word["x1"] - word["x0"]) / F.greatest(word["size"], F.lit(1))
    return starts, ends & (word["x1"] - rect["x1"] <= per * word["tail"] + 1.0)


def marked(words: DataFrame) -> DataFrame:
    """Words beside what their text says of them: worked out once, before words meet rects."""
    text, word = F.trim("word"), F.col("word")
    return words.withColumns({
        "label": is_label(word), "link": is_connector(word), "prose": text.rlike(r"^\p{Ll}") & ~text.rlike(r"\p{Nd}"), "separates": text.rlike(r"[^\p{L}\p{N}]\z"),
        "stuck": word.rlike(fixed.GLUED_LABEL), "tail": F.length(F.regexp_extract(word, fixed.GLUED_TAIL, 0)), "size": F.length(word),
    })


def glued(rects: DataFrame, words: DataFrame) -> DataFrame:
    """Rects that start or end inside a word, grown over a label before, or punctuation after, in that same word."""
    met = rects.join(named(marked(words), "w_", PAGE), PAGE, "left").filter("w_x0 is null or (w_y1 > y0 and w_y0 < y1)")
    starts, ends = glue(box(), {k: F.col(f"w_{k}") for k in ("x0", "x1", "stuck", "tail", "size")})
    keys = [*PAGE, "rect", "x0", "y0", "x1", "y1"]
    sums = met.groupBy(*keys).agg(F.min(F.when(starts, F.col("w_x0"))).alias("a"), F.max(F.when(ends, F.col("w_x1"))).alias("b"))
    grown = sums.select(*PAGE, "rect", F.coalesce("a", "x0").alias("x0"), "y0", F.coalesce("b", "x1").alias("x1"), "y1")
    rest = rects.select(*keys).join(grown.select(*PAGE, "rect"), [*PAGE, "rect"], "left_anti")
    return grown.unionByName(rest.select(*grown.columns))


def outward(start: Column, near: Column, forward: bool) -> Column:
    """How far a rect that ends at ``start`` may grow over the nearest words (far, a, b and what marked() says), or null."""
    nothing = F.lit(None).cast("double")
    zero = F.struct(start.cast("double").alias("edge"), F.lit(True).alias("on"), F.lit(False).alias("prose"), F.lit(False).alias("any"), nothing.alias("out"))

    def step(s: Column, w: Column) -> Column:
        gap = w["a"] - s["edge"] if forward else s["edge"] - w["b"]
        outer = w["b"] if forward else w["a"]
        ok = s["on"] & (gap <= fixed.LABEL_MAX_GAP)
        label = ok & w["label"]
        link = ok & ~w["label"] & s["any"] & w["link"]
        prose = ok & ~label & ~link & w["prose"]
        return F.struct(
            F.when(label | link, outer).otherwise(s["edge"]).alias("edge"), (label | link).alias("on"), (s["prose"] | prose).alias("prose"),
            (s["any"] | label).alias("any"), F.when(label, outer).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(F.slice(F.array_sort(near), 1, fixed.LABEL_MAX_WORDS), zero, step, lambda s: F.when(~s["prose"], s["out"]))


def nearness(word: Column | dict[str, Column], forward: bool) -> Column:
    far = word["x0"] if forward else -word["x1"]
    return F.struct(far.alias("far"), word["x0"].alias("a"), word["x1"].alias("b"), word["word"].alias("word"), *[word[k].alias(k) for k in ("label", "link", "prose")])


def walk_labels(rects: DataFrame, words: DataFrame, forward: bool) -> DataFrame:
    """(page, rect, edge): how far a rect may grow along its line over labels: the six nearest words outward, within 200
    points of each other, up to what is no label. Lower-case prose right there means no growth at all, and a label does
    not end on a connector."""
    met = named(marked(words), "w_", PAGE).join(rects, PAGE).filter("w_y1 > y0 and w_y0 < y1 and w_line_no = line_no")
    met = met.filter("w_x0 >= x1 - 1.0" if forward else "w_x1 <= x0 + 1.0")
    word = nearness({k: F.col(f"w_{k}") for k in ("x0", "x1", "word", "label", "link", "prose")}, forward)
    near = met.groupBy(*PAGE, "rect", "x0", "x1").agg(F.collect_list(word).alias("near"))
    return near.select(*PAGE, "rect", outward(F.col("x1" if forward else "x0"), F.col("near"), forward).alias("edge")).filter("edge is not null")


def overhead(rect: Column | dict[str, Column], line: Column) -> Column:
    """The rect's new x0, y0 and x1 from the line above it (array of a, b, top, word, label, separates), or null."""

    def ends(run: Column) -> Column:
        first, last = F.get(run, F.lit(0)), F.try_element_at(run, F.lit(-1))
        fits = last["separates"] & (last["b"] >= rect["x0"] - 1.0) & (first["a"] <= rect["x1"] + 1.0)
        grown = F.struct(F.least(rect["x0"], first["a"]).alias("x0"), F.array_min(F.transform(run, lambda w: w["top"])).alias("y0"), F.greatest(rect["x1"], last["b"]).alias("x1"))
        return F.when((F.size(run) > 0) & fits, grown)

    def leading(words: Column) -> Column:
        bad = F.array_position(F.transform(words, lambda w: w["label"]), F.lit(False))
        return F.when(bad > 0, F.slice(words, F.lit(1), (bad - 1).cast("int"))).otherwise(words)

    return bind(F.array_sort(line), lambda words: bind(leading(words), ends))


def stands_over(rect: Column | dict[str, Column], word: Column | dict[str, Column]) -> Column:
    high = F.greatest(F.lit(1.0), rect["y1"] - rect["y0"])
    return (word["y1"] <= rect["y0"] + 0.5) & (rect["y0"] - word["y1"] < high * fixed.LABEL_ABOVE_LINES)


def of_line(word: Column | dict[str, Column]) -> Column:
    return F.struct(word["x0"].alias("a"), word["x1"].alias("b"), word["y0"].alias("top"), *[word[k].alias(k) for k in ("word", "label", "separates")])


def label_above(rects: DataFrame, words: DataFrame) -> DataFrame:
    """Rects grown over a label on the line above, in the same block: its leading run of label words ends in a separator
    and stands over the value."""
    word = {k: F.col(f"w_{k}") for k in ("x0", "y0", "x1", "y1", "word", "label", "separates")}
    met = named(marked(words), "w_", PAGE).join(rects, PAGE).filter(stands_over(box(), word))
    keys = [*PAGE, "rect", "x0", "y0", "x1", "y1"]
    met = met.withColumn("_base", F.max("w_y1").over(Window.partitionBy(*PAGE, "rect"))).filter("w_y1 > _base - 2.0")
    line = met.groupBy(*keys).agg(F.collect_list(of_line(word)).alias("line"))
    grown = line.select(*PAGE, "rect", "y1", overhead(box(), F.col("line")).alias("g")).filter("g is not null")
    return grown.select(*PAGE, "rect", "g.x0", "g.y0", "g.x1", "y1")


def takes(rect: Column | dict[str, Column], mark: Column | dict[str, Column]) -> Column:
    """Whether the rect covers a drawn mark to 70 % on the worse axis and it reaches 24 points out at most."""
    def part(m0: Column, m1: Column, r0: Column, r1: Column) -> Column:
        thin = m1 - m0 <= 0.01
        return F.when(thin, F.when((r0 - 0.5 <= m0) & (m0 <= r1 + 0.5), 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(m1, r1) - F.greatest(m0, r0)) / (m1 - m0))

    covered = F.least(part(mark["x0"], mark["x1"], rect["x0"], rect["x1"]), part(mark["y0"], mark["y1"], rect["y0"], rect["y1"])) >= fixed.MARK_COVERAGE
    return covered & (mark["x0"] >= rect["x0"] - fixed.MARK_OVERHANG) & (mark["x1"] <= rect["x1"] + fixed.MARK_OVERHANG)


def absorb_marks(rects: DataFrame, marks: DataFrame) -> DataFrame:
    """Rects widened over the marks that they take."""
    met = rects.join(named(marks, "m_", PAGE), PAGE, "left")
    take = takes(box(), box("m_"))
    keys = [*PAGE, "rect", "x0", "y0", "x1", "y1"]
    sums = met.groupBy(*keys).agg(F.min(F.when(take, F.col("m_x0"))).alias("a"), F.max(F.when(take, F.col("m_x1"))).alias("b"))
    return sums.select(*PAGE, "rect", F.least("x0", F.coalesce("a", "x0")).alias("x0"), "y0", F.greatest("x1", F.coalesce("b", "x1")).alias("x1"), "y1")


def absorb(rects: DataFrame, words: DataFrame, marks: DataFrame) -> DataFrame:
    """A value's rect grown over what labels it: glued parts, labels on both sides, else a label above; then marks. A page's
    rects, words and marks come together once, in one shuffle; all steps are folds inside the rect's row, so no step joins,
    and nothing is broadcast."""
    kinds = {"r": (rects, ["rect", "line_no", "x0", "y0", "x1", "y1"]), "w": (marked(words), None), "m": (marks, ["x0", "y0", "x1", "y1"])}
    packed = {k: df.select(*PAGE, F.struct(*(names or [c for c in df.columns if c not in PAGE])).alias(k)) for k, (df, names) in kinds.items()}
    both = packed["r"].unionByName(packed["w"], True).unionByName(packed["m"], True)
    pages = both.groupBy(*PAGE).agg(*[F.collect_list(k).alias(k) for k in kinds])
    rows = pages.select(*PAGE, F.explode("r").alias("r"), "w", "m")

    def put(r: Column, **new: Column) -> Column:
        return F.struct(*[new.get(k, r[k]).alias(k) for k in ("line_no", "x0", "y0", "x1", "y1")])

    def beside(r: Column, w: Column) -> Column:
        return (w["y1"] > r["y0"]) & (w["y0"] < r["y1"])

    def stuck(r: Column) -> Column:
        on = F.filter("w", lambda w: beside(r, w))
        a = F.array_min(F.transform(on, lambda w: F.when(glue(r, w)[0], w["x0"])))
        b = F.array_max(F.transform(on, lambda w: F.when(glue(r, w)[1], w["x1"])))
        return put(r, x0=F.coalesce(a, r["x0"]), x1=F.coalesce(b, r["x1"]))

    def walked(r: Column, forward: bool) -> Column:
        edge = "x1" if forward else "x0"
        out = lambda w: w["x0"] >= r["x1"] - 1.0 if forward else w["x1"] <= r["x0"] + 1.0
        near = F.transform(F.filter("w", lambda w: beside(r, w) & (w["line_no"] == r["line_no"]) & out(w)), lambda w: nearness(w, forward))
        return put(r, **{edge: F.coalesce(outward(r[edge], near, forward), r[edge])})

    def topped(r: Column) -> Column:
        over = F.filter("w", lambda w: stands_over(r, w))
        line = bind(over, lambda ws: bind(F.array_max(F.transform(ws, lambda w: w["y1"])), lambda base: F.filter(ws, lambda w: w["y1"] > base - 2.0)))
        still = (r["x0"] == F.col("r.x0")) & (r["x1"] == F.col("r.x1"))
        grown = F.when(still, overhead(r, F.transform(line, of_line)))
        return bind(grown, lambda g: put(r, x0=F.coalesce(g["x0"], r["x0"]), y0=F.coalesce(g["y0"], r["y0"]), x1=F.coalesce(g["x1"], r["x1"])))

    def widened(r: Column) -> Column:
        a, b = (agg(F.transform(F.filter("m", lambda m: takes(r, m)), lambda m: m[k])) for agg, k in ((F.array_min, "x0"), (F.array_max, "x1")))
        return put(r, x0=F.least(r["x0"], F.coalesce(a, r["x0"])), x1=F.greatest(r["x1"], F.coalesce(b, r["x1"])))

    grown = F.col("r")
    for step in (stuck, lambda r: walked(r, False), lambda r: walked(r, True), topped, widened):
        grown = bind(grown, step)
    return rows.select(*PAGE, F.col("r.rect").alias("rect"), grown.alias("g")).select(*PAGE, "rect", "g.x0", "g.y0", "g.x1", "g.y1")


def corner_images(images: DataFrame, words: DataFrame, width: float, height: float) -> DataFrame:
    """Images in the top right corner, small, with no word lying half on them."""
    spot = images.filter((F.col("x0") >= fixed.CORNER_LEFT * width) & (F.col("y1") <= fixed.CORNER_BOTTOM * height) & (area(**box()) <= fixed.CORNER_MAX_AREA * width * height) & (area(**box()) > 0))
    over = touched(words, spot, fixed.WORD_ON_IMAGE).select(*PAGE, F.col("r_rect").alias("rect")).distinct()
    return spot.join(over, [*PAGE, "rect"], "left_anti")


def page_marks(marks: DataFrame, page_area: float) -> DataFrame:
    return marks.filter(area(**box()) < fixed.PAGE_MARK_RATIO * page_area)


def without_native(ocr: DataFrame, native: DataFrame) -> DataFrame:
    """OCR words that share no more than 30 % of the smaller box with any native word."""
    other = named(native, "n_", PAGE)
    cond = (ocr["conv_id"] == other["conv_id"]) & (ocr["block"] == other["block"]) & (ocr["y1"] > other["n_y0"]) & (ocr["y0"] < other["n_y1"])
    a, b = {k: ocr[k] for k in ("x0", "y0", "x1", "y1")}, {k: other[f"n_{k}"] for k in ("x0", "y0", "x1", "y1")}
    return ocr.join(other, cond & (common(a, b) > 0.3 * F.least(area(**a), area(**b))), "left_anti")


def merge_passes(ocr: DataFrame) -> DataFrame:
    """Words of all passes, in order: a later word goes in where it clashes with none, or is surer than all it clashes with,
    which then go. The order matters, so a page, a bounded group, is folded word by word; clashes are sought for as many words
    at once as keep a block of boxes small."""
    columns = ["pass", "word_no", "word", "x0", "y0", "x1", "y1", "conf"]
    kinds = ["int", "int", "string", "double", "double", "double", "double", "double"]

    def of_page(page: pa.RecordBatch) -> pa.RecordBatch:
        x0, y0, x1, y1, sure = numbers(page, "x0", "y0", "x1", "y1", "conf")
        size, conf = np.maximum(x1 - x0, 0) * np.maximum(y1 - y0, 0), sure.tolist()
        n = page.num_rows
        kept = [True] * n
        step = max(1, MERGE_CELLS // max(n, 1))
        for at in range(0, n, step):
            end = min(at + step, n)
            new, old = (slice(at, end), None), (None, slice(0, end))
            common = np.minimum(x1[old], x1[new]) - np.maximum(x0[old], x0[new])
            np.maximum(common, 0, out=common)
            common *= np.maximum(np.minimum(y1[old], y1[new]) - np.maximum(y0[old], y0[new]), 0)
            small = np.minimum(size[old], size[new])
            ks, others = np.nonzero(common / np.where(small > 0, small, 1.0) > 0.5)
            earlier = others < ks + at
            met: dict[int, list[int]] = {}
            for k, other in zip((ks[earlier] + at).tolist(), others[earlier].tolist(), strict=True):
                met.setdefault(k, []).append(other)
            for k, some in met.items():
                some = [o for o in some if kept[o]]
                if all(conf[k] > conf[o] for o in some):
                    for o in some:
                        kept[o] = False
                else:
                    kept[k] = False
        return page.filter(pa.array(kept, pa.bool_()))

    rows = ocr.select(*PAGE, *[F.col(c).cast(kind).alias(c) for c, kind in zip(columns, kinds, strict=True)])
    return by_page(rows, [F.asc_nulls_last(c) for c in columns], of_page, rows.schema)


def redacted_words(words: DataFrame, rects: DataFrame) -> DataFrame:
    """Words that no rect touches: what is left of a page."""
    other = named(rects, "r_", PAGE)
    meets = (words["x1"] > other["r_x0"]) & (words["x0"] < other["r_x1"]) & (words["y1"] > other["r_y0"]) & (words["y0"] < other["r_y1"])
    return words.join(other, (words["conv_id"] == other["conv_id"]) & (words["block"] == other["block"]) & meets, "left_anti")


def ocr_words(tsv: DataFrame) -> DataFrame:
    """Words from an OCR engine's tab-separated output (doc_id, tsv): word level, twelve columns, confidence of 20 and up."""
    line = tsv.select("doc_id", F.posexplode(F.split("tsv", "\n")).alias("n", "line")).filter("n > 0")
    f = F.split("line", "\t", 12)
    rows = line.select("doc_id", "n", f.alias("f")).filter((F.size("f") >= 12) & (F.get("f", F.lit(0)) == "5"))
    at = lambda i: F.get("f", F.lit(i)).try_cast("double")
    rows = rows.select("doc_id", F.trim(F.get("f", F.lit(11))).alias("word"), at(6).alias("x0"), at(7).alias("y0"), (at(6) + at(8)).alias("x1"), (at(7) + at(9)).alias("y1"), at(10).alias("conf"))
    return rows.filter((F.col("conf") >= fixed.OCR_MIN_CONFIDENCE) & (F.col("word") != ""))
