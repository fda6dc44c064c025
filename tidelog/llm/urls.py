"""URL filter by path templates.

The distinct (host, path) pairs form a tree per host. It is walked level by level to the deepest path, each level a few
aggregations over all hosts: among the children of a node, segments of the same shape (number, number with a suffix,
word, mixed) are one branch set. A set of two or more becomes the wildcard ``{shape}``, without those children that
labels tell apart: a child with ``MIN_LABELLED`` labels stays a branch of its own if its share of good pages differs from
the middle one of such children (chi-square at 5 % over all that are tested). How many children there are does not matter. A template's
purity is its labelled share of good pages, smoothed towards the overall share by ``PRIOR`` pages; templates under
``LEAST`` times the overall share are blocked.

Fixed rules (host suffix and path prefix) come first; the longest one that fits wins.

Edge cases: a null url or one without ``://`` has an empty host and path and no rule; it is one template of its own.
Repeated urls and page_ids each get a row. Unlabelled templates have the overall share and are
allowed; with no labels at all that is 1/2. An empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import materialize, salted_join, table

#: (verdict, host suffix, path prefix)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MIN_LABELLED = 20
PRIOR, LEAST = 10.0, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits. Longest first: by host and path together."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _shape(seg: Column) -> Column:
    return (
        F.when(seg.rlike(r"^[0-9]+$"), "number")
        .when(seg.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("number"), F.regexp_extract(seg, r"(\.[A-Za-z0-9]+)$", 1)))
        .when(seg.rlike(r"^[A-Za-z_-]+$"), "word")
        .otherwise("mixed")
    )


def templates(paths: DataFrame) -> DataFrame:
    """paths: distinct host, path with n, n_labelled, n_good. Adds template (the last level's wildcards and literals)."""
    segs = F.filter(F.split(F.col("path"), "/"), lambda s: s != "")
    at, done = paths.withColumn("__segs", segs).withColumn("template", F.lit("")), []
    deepest = paths.select(F.max(F.size(segs))).first()[0] or 0
    for depth in range(deepest):
        seg = F.get("__segs", F.lit(depth))
        # Paths that end here take no part in deeper levels.
        done.append(at.where(F.size("__segs") <= depth).drop("__segs"))
        rows = at.where(F.size("__segs") > depth).withColumn("__seg", seg).withColumn("__shape", _shape(seg))
        per = materialize(rows.groupBy("host", "template", "__shape", "__seg").agg(F.sum("n_labelled").alias("l"), F.sum("n_good").alias("g")), "children")
        told = F.col("l") >= MIN_LABELLED
        sets = per.groupBy("host", "template", "__shape").agg(
            F.count("*").alias("__n"), F.count(F.when(told, 1)).alias("__told"), F.percentile_approx(F.when(told, F.col("g") / F.col("l")), 0.5, 10000).alias("__mid")
        )
        wild = materialize(sets.where("__n > 1"), "wildcards")
        judged = salted_join(per, wild, ["host", "template", "__shape"], "inner", 8)
        # A child differs by a chi-square of one degree of freedom against the middle share; exp(-c / 2) bounds the chance of one over c.
        p = (F.col("__mid") * F.col("l") + 0.5) / (F.col("l") + 1)
        chi2 = F.pow(F.col("g") - F.col("l") * p, 2) / (F.col("l") * p * (1 - p))
        apart = judged.where(told & (chi2 > 2 * F.log(F.col("__told") * 20.0))).select("host", "template", "__shape", "__seg", F.lit(True).alias("__apart"))
        joined = salted_join(rows, wild.select("host", "template", "__shape", F.lit(True).alias("__wild")), ["host", "template", "__shape"], "left")
        joined = salted_join(joined, materialize(apart, "apart"), ["host", "template", "__shape", "__seg"], "left")
        step = F.when(F.col("__wild") & F.col("__apart").isNull(), F.concat(F.lit("/{"), F.col("__shape"), F.lit("}"))).otherwise(F.concat(F.lit("/"), F.col("__seg")))
        at = materialize(joined.withColumn("template", F.concat("template", step)).drop("__seg", "__shape", "__wild", "__apart"), "level")
    out = at.drop("__segs")
    for part in done:
        out = out.unionByName(part)
    return out


def judge_urls(pages: DataFrame, good: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Adds host, path, rule, verdict, template and purity to ``pages`` (page_id, url).

    ``good``: (host, path, n_labelled, n_good), labels summed by host and path; None if there are none.
    """
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    distinct = out.groupBy("host", "path").agg(F.count("*").alias("n"))
    if good is None:
        distinct = distinct.withColumn("n_labelled", F.lit(0).cast("long")).withColumn("n_good", F.lit(0).cast("long"))
    else:
        distinct = distinct.join(good.select("host", "path", "n_labelled", "n_good"), ["host", "path"], "left").fillna(0, ["n_labelled", "n_good"])
    tree = templates(materialize(distinct, "paths"))
    total = tree.agg(F.sum("n_good"), F.sum("n_labelled")).first()
    share = total[0] / total[1] if total[1] else 0.5
    per = tree.groupBy("host", "template").agg(((F.sum("n_good") + PRIOR * share) / (F.sum("n_labelled") + PRIOR)).alias("purity"))
    purity = materialize(per, "purity")
    known = materialize(salted_join(tree.select("host", "path", "template"), purity, ["host", "template"], "left"), "known")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("purity") < LEAST * share, "block").otherwise("allow")
    return salted_join(out, known, ["host", "path"], "left").withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, by_method))


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels by host and path: a page shows the document whose id is the last all-digit path segment of its url."""
    shown = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    shown = shown.withColumn("doc_id", F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1).try_cast("long")).where("doc_id IS NOT NULL")
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("l"), F.sum("quality").alias("g"))
    return shown.join(known, "doc_id").groupBy("host", "path").agg(F.sum("l").alias("n_labelled"), F.sum("g").alias("n_good"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, page_labels(pages, table(spark, sf_dir, "labels")))
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")
