"""URL verdicts from path templates learned per host.

The paths of a host form a tree.  Level by level, a segment stays as it is if a good share of its
parent's URLs have it; rarer ones are generalised, first their digits, then the whole segment.
Branches of one parent that go on alike and whose labels do not differ significantly are merged.
A template is rejected if the odds of a bad URL among its labelled ones are surely higher than
among all: its share is smoothed towards that of all, and its lower bound counts.

Only DataFrame functions.  The tree is a table with one row per node; counts are added up before
they are shuffled, and nodes of many URLs, such as a host with a third of all, are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohort.operators.skew import join_groups
from cohort.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a parent's URLs and number of URLs that keep a segment from being generalised.
SHARE, COUNT = 0.05, 3
#: Largest z of two bad shares that still merges branches.
SIMILAR = 1.0
#: Smoothing weight; odds of a rejected template against those of all; z of its lower bound.
WEIGHT, LIFT, SURE = 2.0, 2.0, 2.33


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #; A-Z in lower case."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? or #."""
    return F.regexp_extract(F.regexp_replace(_after_scheme(url), r"^[^/?#]+", ""), r"^[^?#]*", 0)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; rules are (verdict, host, path)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(domain + prefix).alias("rule"),
                                      F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def path_templates(urls: DataFrame, share: float = SHARE, count: int = COUNT) -> DataFrame:
    """Add ``template``, an array of generalised segments, to rows with host and path.

    A node of fewer than ``count`` URLs cannot keep a segment: what follows it is one tail of
    wildcards.  All other nodes are split as deep as their paths go.
    """
    node = ["host", "template"]
    rows = written(urls.withColumns({
        "segments": F.split(F.regexp_replace("path", "^/", ""), "/"),
        "template": F.array().cast("array<string>")}), "url-segments")
    names, done, depth = [*urls.columns, "template"], [], 0
    while not rows.isEmpty():
        segment = F.get("segments", F.lit(depth))
        shape = F.regexp_replace("segment", "[0-9]+", "#")
        rows = rows.withColumn("segment", segment).withColumn("shape", shape)
        counts = rows.groupBy(*node, "segment", "shape").agg(F.count("*").alias("n"))
        shapes = counts.groupBy(*node, "shape").agg(F.sum("n").alias("n_shape"), F.collect_list(
            F.when(F.col("n") >= count, F.struct("n", "segment"))).alias("kept"))
        nodes = shapes.groupBy(*node).agg(
            F.sum("n_shape").alias("total"), F.collect_list(F.when(F.col("n_shape") >= count, F.struct(
                "n_shape", "shape", "kept"))).alias("shapes"))
        # at most 1 / share of each stay
        least = F.greatest(F.lit(count), F.col("total") * share)
        nodes = nodes.select(
            *node, "total", F.flatten(F.transform("shapes", lambda s: F.transform(F.filter(
                s["kept"], lambda k: k["n"] >= least), lambda k: k["segment"]))).alias("kept"),
            F.transform(F.filter("shapes", lambda s: s["n_shape"] >= least),
                        lambda s: s["shape"]).alias("shapes"))
        left = F.size("segments") - depth
        part = (F.when(F.col("total") < count, F.array_join(F.array_repeat(F.lit("*"), left), "/"))
                .when(F.array_contains("kept", F.col("segment")), F.col("segment"))
                .when(F.array_contains("shapes", F.col("shape")), F.col("shape")).otherwise("*"))
        level = written(join_groups(rows, written(nodes, "url-nodes"), node, "total").select(
            *urls.columns, "segments", F.concat("template", F.array(part)).alias("template"),
            ((left == 1) | (F.col("total") < count)).alias("done")), "url-level")
        done.append(level.where("done").select(*names))
        rows, depth = level.where("not done").drop("done"), depth + 1
    out = rows.select(*names)
    for level in done:
        out = out.unionByName(level)
    return out


def merged_templates(templates: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(host, template, branch) with the branch that each template is merged into.

    ``templates`` has host, template, n_bad and n_known.  From the deepest level up, siblings with
    equal continuation are put in the order of their bad share; a branch begins where the share
    differs significantly from the one before.  A parent has few siblings to compare, since each
    but the generalised ones holds a fixed share of its URLs.
    """
    rows = written(templates.withColumn("branch", F.col("template")), "templates")
    depth = rows.agg(F.max(F.size("template"))).head()[0] or 0
    for d in reversed(range(depth)):
        part = F.get("branch", F.lit(d))
        key = ["host", "parent", "rest"]
        level = rows.where(part.isNotNull()).groupBy(
            "host", F.slice("branch", 1, d).alias("parent"),
            F.slice("branch", d + 2, F.greatest(F.size("branch") - (d + 1), F.lit(0)))
            .alias("rest"), part.alias("part")).agg(
                F.sum("n_bad").alias("bad"), F.sum("n_known").alias("known"))
        level = level.withColumn("p", (F.col("bad") + 1) / (F.col("known") + 2))
        w = Window.partitionBy(*key).orderBy("p", "part")
        before, known = F.lag("p").over(w), F.lag("known").over(w)
        spread = F.sqrt(F.col("p") * (1 - F.col("p")) / (F.col("known") + 2)
                        + before * (1 - before) / (known + 2))
        new = F.when((F.col("p") - before) / spread > similar, 1).otherwise(0)
        level = level.withColumn("new", new).withColumn("group", F.sum("new").over(w))
        names = F.array_sort(F.collect_set("part").over(Window.partitionBy(*key, "group")))
        level = level.select(*key, "part", F.when(F.size(names) > 1, F.concat(
            F.lit("{"), F.array_join(names, "|"), F.lit("}"))).otherwise(F.col("part"))
            .alias("name"))
        at = rows.withColumns({
            "parent": F.slice("branch", 1, d), "part": part,
            "rest": F.slice("branch", d + 2, F.greatest(F.size("branch") - (d + 1), F.lit(0)))})
        rows = written(at.join(level, [*key, "part"], "left").withColumn(
            "branch", F.when(F.col("name").isNull(), F.col("branch")).otherwise(
                F.concat("parent", F.array("name"), "rest"))).drop(*key[1:], "part", "name"),
            "branches")
    return rows.select("host", "template", "branch", "n_bad", "n_known")


def url_verdicts(urls: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]],
                 key: str = "page_id", url: str = "url", weight: float = WEIGHT,
                 lift: float = LIFT, sure: float = SURE, **tree) -> DataFrame:
    """(key, host, path, rule, verdict, template, bad_share) for every row of ``urls``.

    ``labels`` has ``key`` and ``bad`` (0 or 1) for some rows; of several labels of a key the
    worse counts, null labels and null keys are not used.  A rule decides where one fits, else the
    template: block if it has a bad URL and the lower bound of its smoothed bad share has ``lift``
    times the odds of all labelled URLs or more, and allow otherwise, also where nothing is
    labelled.  Null urls and urls without :// have empty host and path, and one template.  Rows
    that repeat a key count each.  Other columns are ignored.
    """
    known = labels.where(F.col("bad").isin(0, 1)).groupBy(F.col(key).alias("k2")).agg(
        F.max("bad").alias("bad"))
    rows = urls.select(F.col(key).alias("key"), url_host(F.col(url)).alias("host"),
                       F.coalesce(url_path(F.col(url)), F.lit("")).alias("path"))
    rows = rows.withColumn("host", F.coalesce("host", F.lit("")))
    rows = rows.join(known, F.col("key") == F.col("k2"), "left").drop("k2")
    rows = path_templates(rows, **tree)
    counts = written(rows.groupBy("host", "template").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"),
        F.count("bad").alias("n_known")), "template-counts")
    branches = merged_templates(counts)
    total = branches.agg(F.sum("n_bad"), F.sum("n_known")).head()
    prior = (total[0] or 0) / max(total[1] or 0, 1)
    decided = branches.groupBy("host", "branch").agg(
        F.sum("n_bad").alias("bad"), ((F.sum("n_bad") + weight * prior)
                                      / (F.sum("n_known") + weight)).alias("bad_share"),
        (F.sum("n_known") + weight).alias("seen"))
    lower = F.col("bad_share") - sure * F.sqrt(
        F.col("bad_share") * (1 - F.col("bad_share")) / F.col("seen"))
    limit = lift * prior / (1 + (lift - 1) * prior)
    decided = decided.withColumn("rejected", (F.col("bad") > 0) & (lower >= limit - 1e-12))
    decided = counts.select("host", "template", "n").join(
        branches.select("host", "template", "branch"), ["host", "template"]).join(
        decided.drop("bad", "seen"), ["host", "branch"])
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    return join_groups(rows, written(decided, "template-verdicts"), ["host", "template"]).withColumn(
        "r", rule).select(
        F.col("key").alias(key), "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("rejected"), "block").otherwise("allow"))
        .alias("verdict"),
        F.concat(F.lit("/"), F.array_join("branch", "/")).alias("template"), "bad_share")
