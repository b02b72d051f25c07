"""URL verdicts by a path-template tree. DataFrame functions only.

A host's paths form a tree of segments. Segments that are ids (digits, long hexadecimal, uuids) become wildcards at
once; a node with many children becomes one wildcard child for those that are not frequent under it. Level by level, from
the host downwards, sibling branches whose labelled shares of bad urls do not differ significantly are merged into one, and
so are their subtrees with them. Every node has a purity: its labelled share of bad urls, smoothed towards the purity of the
node above it. Above a host's root stand the suffixes of its name, and above them ``PRIOR``. So a node without labels
has the purity of its nearest ancestor with some, and a template at or over ``REJECT`` is blocked.

Labels are given, or are the explicit rules' own verdicts. A rule fits its host and all subdomains, and paths that
start with its path; the longest rule that fits wins over the tree.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged like any other (its host has no
suffix but the empty one); repeated rows are judged alike and count as often; paths of any depth are read whole, one level a
step; no labels at all: everything is allowed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_small, materialise

#: A node with more distinct literal children than this generalises those with less than ``FREQUENT`` of its urls.
BRANCHES, FREQUENT = 12, 0.05
PRIOR, WEIGHT, REJECT = 0.2, 5.0, 0.7
Z = 1.96
#: Rules are a chain of conditions in the plan.
MOST_RULES = 500


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    rule: str

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1] if "/" in self.rule else ""


RULES = (
    UrlRule("block", "com/en/"),
    UrlRule("allow", "example.com/en/7"),
    UrlRule("allow", "net/de/"),
    UrlRule("block", "example.net/de/8"),
    UrlRule("block", "org/es/"),
)


def host_of(url: Column) -> Column:
    at = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(at, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def shape_of(path: Column) -> Column:
    """The path with id-like segments as ``*`` (a suffix such as .html stays)."""
    one = r"(?<=/)(?:[0-9]+|[0-9a-fA-F]{12,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})(?=/|\.[A-Za-z0-9]{1,5}(?:/|$)|$)"
    return F.regexp_replace(path, one, "*")


def _purity(bad: Column, labelled: Column, above: Column) -> Column:
    return (bad + above * WEIGHT) / (labelled + WEIGHT)


def _host_purity(shapes: DataFrame) -> DataFrame:
    """(t_host, purity): the purity of each host's root, smoothed along the suffixes of its name."""
    hosts = shapes.groupBy("host").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    each = materialise(hosts.select("host", "bad", "labelled", F.posexplode(ends).alias("level", "suffix")), "suffixes")
    sums = each.groupBy("suffix").agg(F.sum("bad").alias("s_bad"), F.sum("labelled").alias("s_labelled"))
    # a host has as many suffixes as its name has labels
    chain = each.select("host", "level", "suffix").join(sums, "suffix").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("level", "s_bad", "s_labelled"))).alias("chain"))
    fold = F.aggregate("chain", F.lit(PRIOR).cast("double"), lambda p, x: _purity(x["s_bad"], x["s_labelled"], p))
    return chain.select(F.col("host").alias("t_host"), fold.alias("purity"))


def templates(urls: DataFrame) -> DataFrame:
    """(host, shape, template, purity, blocked) from the rows (host, shape, bad), where bad is 1, 0 or null."""
    shapes = urls.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("bad", F.lit(0))).alias("bad"), F.count("bad").alias("labelled"))
    shapes = materialise(shapes, "shapes")
    roots = checked_small(materialise(_host_purity(shapes), "roots"))
    rows = shapes.join(roots, F.col("host") == F.col("t_host")).withColumn("segments", F.split("shape", "/")).withColumn("template", F.lit(""))
    rows = materialise(rows.drop("t_host"), "tree")
    done, level = [], 1
    while True:
        done.append(rows.filter(F.size("segments") <= level))
        rows = rows.filter(F.size("segments") > level)
        if rows.isEmpty():
            break
        rows = materialise(_level(rows, level), "tree")
        level += 1
    return reduce(DataFrame.unionByName, done).select("host", "shape", "template", "purity", (F.col("purity") >= REJECT).alias("blocked"))


def _level(rows: DataFrame, level: int) -> DataFrame:
    """The rows one segment further down: template grows by the branch of that segment, purity is that branch's."""
    node = ["host", "template"]
    rows = rows.withColumn("own", F.get("segments", F.lit(level)))
    children = rows.groupBy(*node, "own").agg(F.sum("n").alias("n"))
    parents = children.groupBy(*node).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).filter(F.col("kinds") > BRANCHES)
    rare = children.join(parents, node).filter((F.col("n") < FREQUENT * F.col("all")) & ~F.col("own").startswith("*")).select(*node, "own", F.lit(True).alias("rare"))
    rows = rows.join(checked_small(materialise(rare, "rare")), [*node, "own"], "left").withColumn("own", F.when(F.col("rare"), "*").otherwise(F.col("own"))).drop("rare")
    # what is left under a node is few: the frequent ones, at most 1 / FREQUENT, and wildcards
    branches = rows.groupBy(*node, "own").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), F.first("purity").alias("above"))
    branches = branches.withColumn("known", F.col("labelled") > 0).withColumn("share", F.when(F.col("known"), F.col("bad") / F.col("labelled")))
    order = Window.partitionBy(*node, "known").orderBy("share", "own")
    p, pn = F.lag("share").over(order), F.lag("labelled").over(order)
    pooled = (F.col("bad") + p * pn) / (F.col("labelled") + pn)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labelled") + 1 / pn))
    apart = ~F.col("known") | p.isNull() | (F.abs(F.col("share") - p) > Z * spread)
    branches = branches.withColumn("first", apart.cast("int"))
    branches = branches.withColumn("branch", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*node, "known", "branch")
    names = F.array_join(F.array_sort(F.collect_set("own").over(whole)), "|")
    branches = branches.select(
        *[F.col(c).alias(f"b_{c}") for c in [*node, "own"]], F.concat("template", F.lit("/"), names).alias("to"),
        _purity(F.sum("bad").over(whole), F.sum("labelled").over(whole), F.col("above")).alias("b_purity"),
    )
    same = [F.col(c) == F.col(f"b_{c}") for c in [*node, "own"]]
    rows = rows.join(checked_small(materialise(branches, "branches")), reduce(Column.__and__, same))
    return rows.select("host", "shape", "n", "bad", "labelled", "segments", F.col("to").alias("template"), F.col("b_purity").alias("purity"))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every row. ``labels`` (page_id, bad; one row for a page_id)
    replaces the rules' verdicts as what the tree learns from."""
    url = F.col("url")
    rows = pages.select(F.col("page_id").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", shape_of(F.col("path")))
    if labels is None:
        known = rows.select("host", "shape", F.when(F.col("r").isNotNull(), (F.col("r.verdict") == "block").cast("int")).alias("bad"))
    else:
        given = labels.select(F.col("page_id").alias("l_id"), F.col("bad").cast("int").alias("bad"))
        known = rows.join(given, F.col("page_id") == F.col("l_id"), "left").select("host", "shape", "bad")
    tree = materialise(templates(known), "templates")
    found = checked_small(tree.select(F.col("host").alias("t_host"), F.col("shape").alias("t_shape"), "template", "purity", "blocked"))
    whole = rows.join(found, (F.col("host") == F.col("t_host")) & (F.col("shape") == F.col("t_shape")), "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return whole.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
