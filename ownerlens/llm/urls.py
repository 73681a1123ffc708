"""URL filter by a tree of path templates, in DataFrame functions only.

Explicit rules come first. For the rest, each host has a tree of path templates:
variable segments become wildcards, sibling branches whose share of bad labels
does not differ from their siblings' are merged, and a template is refused when
the smoothed purity of its labelled pages is too low.

Rows are reduced to one row per (host, template) before any tree work, so a hot
host costs partial counts, not rows.

Defined cases: a null url, or one without ``://``, has an empty host and path and
takes no rule; a template without labels takes its host's and then the overall
rate; repeated rows are judged each; an empty table gives an empty result; extra
columns are ignored.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ownerlens.session import materialise

#: (host, path prefix, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Segments of the tree; what lies deeper is folded into the last one.
LEVELS = 4
#: More distinct constants than this below one node are a variable segment.
FANOUT = 32
#: Branches within so many standard errors of their siblings are merged.
Z = 2.0
#: Weight of the parent's purity in a template's.
PRIOR = 10.0
MIN_PURITY = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or end, A-Z lower-cased; else empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits the host or a parent domain, and the path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """LEVELS segments: constants, or ``*`` where a segment is a number, a long code or carries digits; absent ones are empty."""
    seg = F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/+", -1)
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda i: F.coalesce(F.regexp_replace(
        F.when(i < LEVELS - 1, F.get(seg, i)).otherwise(F.array_join(F.slice(seg, LEVELS, F.greatest(F.size(seg), F.lit(1))), "/")),
        r"[^/]*\d[^/.]*|[^/.]{25,}", "*"), F.lit("")))


def generalise(paths: DataFrame) -> DataFrame:
    """From (host, g, bad): one row per host and path ``g`` with its template ``t`` and label counts n, b.

    Level by level, the constants below a node with more than FANOUT of them become
    a wildcard. Counts are partial aggregates and go back by a join with one row per node.
    """
    t = paths.groupBy("host", "g").agg(F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0)).cast("bigint")).alias("b"))
    t = t.withColumn("t", F.lit(""))
    for level in range(LEVELS):
        t = t.withColumn("seg", F.get("g", F.lit(level)))
        many = t.filter("seg <> ''").groupBy(F.col("host").alias("_h"), F.col("t").alias("_t")).agg(F.count_distinct("seg").alias("_k")).filter(F.col("_k") > FANOUT)
        t = t.join(many, (F.col("host") == F.col("_h")) & (F.col("t") == F.col("_t")), "left")
        seg = F.when(F.col("_k").isNotNull() & (F.col("seg") != ""), F.lit("*")).otherwise(F.col("seg"))
        t = t.select("host", "g", "n", "b", F.concat("t", F.lit("/"), seg).alias("t"))
    return t


def branches(tree: DataFrame) -> DataFrame:
    """One row per host and template ``t``: its branch and the label counts of branch and host.

    After ``generalise`` a host has at most (FANOUT + 1)^LEVELS templates, so windows per host are bounded.
    """
    t = tree.groupBy("host", "t").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).withColumn("group", F.lit(""))
    for level in range(LEVELS):
        t = t.withColumn("seg", F.get(F.split("t", "/", LEVELS + 1), F.lit(level + 1)))
        branch, parent = Window.partitionBy("host", "group", "seg"), Window.partitionBy("host", "group")
        t = t.withColumn("bn", F.sum("n").over(branch)).withColumn("bb", F.sum("b").over(branch))
        t = t.withColumn("pn", F.sum("n").over(parent)).withColumn("pb", F.sum("b").over(parent))
        # The branch against its siblings, with half a case added on either side.
        rest_n, rest_b = F.col("pn") - F.col("bn"), F.col("pb") - F.col("bb")
        pooled = (F.col("pb") + 0.5) / (F.col("pn") + 1)
        gap = (F.col("bb") + 0.5) / (F.col("bn") + 1) - (rest_b + 0.5) / (rest_n + 1)
        same = gap * gap <= Z * Z * pooled * (1 - pooled) * (1 / (F.col("bn") + 1) + 1 / (rest_n + 1))
        t = t.withColumn("group", F.concat("group", F.lit("/"), F.when(same, F.lit("~")).otherwise(F.col("seg"))))
    host, whole = Window.partitionBy("host"), Window.partitionBy("host", "group")
    return t.select(
        "host", "t", F.col("group").alias("branch"), F.sum("n").over(whole).alias("gn"), F.sum("b").over(whole).alias("gb"),
        F.sum("n").over(host).alias("hn"), F.sum("b").over(host).alias("hb"))


def judge(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row per page: host, path, rule, verdict, template, branch and the branch's purity.

    ``labelled`` has page_id and bad (0 or 1), one row per labelled page.
    """
    u = F.col("url")
    p = pages.select("page_id", host_of(u).alias("host"), path_of(u).alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"))
    p = p.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled"), segments(F.col("path")).alias("g"))
    tags = labelled.groupBy(F.col("page_id").alias("_id")).agg(F.max("bad").alias("bad"))
    tree = materialise(generalise(p.join(tags, p["page_id"] == tags["_id"], "left").select("host", "g", "bad")), "url-tree")
    total = tags.agg(F.coalesce(F.avg("bad"), F.lit(0.0)).alias("r")).first()["r"]
    host_purity = 1 - (F.col("hb") + PRIOR * total) / (F.col("hn") + PRIOR)
    purity = (F.col("gn") - F.col("gb") + PRIOR * host_purity) / (F.col("gn") + PRIOR)
    tree = tree.select("host", "g", "t").join(branches(tree).withColumn("purity", F.round(purity, 6)), ["host", "t"])
    tree = tree.select(F.col("host").alias("_h"), F.col("g").alias("_g"), F.col("t").alias("template"), "branch", "purity")
    out = p.join(tree, (F.col("host") == F.col("_h")) & (F.col("g") == F.col("_g")), "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") < MIN_PURITY, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "branch", "purity")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) for pages whose last path segment is the number of a labelled document."""
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:\.\w+)?/?$", 1)
    n = pages.select("page_id", F.when(number != "", number).cast("bigint").alias("_n"))
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    m = labels.groupBy(F.col("doc_id").alias("_d")).agg(F.max(bad).alias("bad"))
    return n.filter("_n IS NOT NULL").join(m, F.col("_n") == F.col("_d")).filter("bad IS NOT NULL").select("page_id", "bad")
