"""URL filter: rules, then a tree of path templates per host.

Rules: a rule (host, path) fits its host and all subdomains if the url's path
starts with the rule's; of those that fit the longest decides.  The other urls
are judged by the template that their path belongs to:

1. Paths are cut at ``/``.  Runs of digits become ``0`` and long hex ids
   ``<id>`` (variable by their form).  What lies below ``max_depth`` segments is
   one last segment, whole.
2. From the root down, a node with more than ``max_children`` different
   segments keeps those with at least ``min_share`` of its urls; the others
   become the wildcard ``*``.
3. From the root down, sibling branches that are statistically alike are merged
   into one (``+``, ``+2``, ...).  A branch's share of bad labels, drawn to its
   node's share with the weight of ``prior`` labels, has an error by its number of
   labels; it is worse or better than its node if it differs by more than
   ``merge_rate`` and by more than that error, else alike.  Siblings merge with one
   another - leaves too - if they are on the same side, their intervals overlap,
   and what lies below them is distributed alike (Jensen-Shannon divergence from
   the siblings with the same most frequent remainder).  So bad branches with few
   labels each are pooled, apart from the good ones.
4. A template is judged by its own labelled urls if it has ``min_labels`` of them,
   else by its nearest ancestor in the tree that has (the host at last).  It is
   rejected if the smoothed share of bad labels there exceeds ``max_bad``: drawn
   to its host's share, and that to the share of all urls, with the weight of
   ``prior`` labels.  A host without so many labels is allowed.

Counts are pre-aggregated to distinct paths before anything is shuffled twice.
Only DataFrame operations.  Defined results: a null url, or one without
``://``, has empty host and path; a null label is no label; repeated rows count
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

# Fixed rules of the registered query: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
URL = r"://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Limits:
    max_depth: int = 8
    max_children: int = 64
    min_share: float = 0.02
    merge_divergence: float = 0.05
    merge_rate: float = 0.1
    merge_errors: float = 1.0
    min_labels: int = 5
    max_bad: float = 0.5
    prior: float = 4.0


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?`` or ``#``, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), CAPITALS, CAPITALS.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null."""
    fits = []
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        fits.append(F.when(fit, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    none = F.lit(None).cast("struct<rule: string, verdict: string>")
    return F.coalesce(*fits, none)


def typed_segments(path: Column, max_depth: int) -> Column:
    """The path's segments with variable forms generalised."""
    typed = F.regexp_replace(F.regexp_replace(path, r"(?<![0-9A-Za-z])(?=[a-fA-F-]*[0-9])[0-9a-fA-F-]{16,}(?![0-9A-Za-z])", "<id>"), "[0-9]+", "0")
    parts = F.filter(F.split(typed, "/"), lambda s: s != "")
    rest = F.array_join(F.slice(parts, max_depth + 1, F.greatest(F.size(parts) - max_depth, F.lit(1))), "/")
    return F.when(F.size(parts) > max_depth, F.concat(F.slice(parts, 1, max_depth), F.array(rest))).otherwise(parts)


def generalised(paths: DataFrame, limits: Limits) -> DataFrame:
    """``paths`` (``host, raw, parts, n, labelled, bad``) with ``parts``
    generalised level by level: rare children of wide nodes become ``*``."""
    depth = paths.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(depth):
        at = paths.withColumn("above", F.array_join(F.slice("parts", 1, level), "/")).withColumn("child", F.get("parts", F.lit(level)))
        each = at.where(F.col("child").isNotNull()).groupBy("host", "above", "child").agg(F.sum("n").alias("n"))
        node = each.groupBy("host", "above").agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("all")).where(
            F.col("children") > limits.max_children)
        rare = table(each.join(node, ["host", "above"]).where(F.col("n") < F.lit(limits.min_share) * F.col("all")).select(
            "host", "above", "child", F.lit(True).alias("rare")), f"rare-{level}")
        if rare.isEmpty():
            continue
        new = F.concat(F.slice("parts", 1, level), F.array(F.lit("*")), F.slice("parts", level + 2, limits.max_depth + 1))
        paths = table(at.join(rare, ["host", "above", "child"], "left").withColumn("parts", F.when(F.col("rare"), new).otherwise(F.col("parts")))
                      .select(*paths.columns), f"paths-{level}")
    return paths


def summed(rows: DataFrame, keys: list[str], **sums: str) -> DataFrame:
    """``rows`` with sums over the rows that agree in ``keys``."""
    return rows.join(rows.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()]), keys)


def alike(branches: DataFrame, limits: Limits) -> DataFrame:
    """``host, above, child, name``: the merged branch that each child of a node
    belongs to.  ``branches``: ``host, above, child, below, n, labelled, bad``, at
    most ``max(max_children, 1 / min_share)`` children and the wildcard a node."""
    node, own = ["host", "above"], ["host", "above", "child"]
    each = branches.groupBy(*own).agg(F.sum("n").alias("branch"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"),
                                      F.max_by("below", F.struct("n", "below")).alias("mode"))
    whole = each.groupBy(*node).agg(F.count(F.lit(1)).alias("children"), F.sum("labelled").alias("all"), F.sum("bad").alias("all_bad"))
    each = each.join(whole.where("children > 1"), node)
    rate = (F.col("all_bad") + 1) / (F.col("all") + 2)
    weight = F.col("labelled") + F.lit(limits.prior)
    each = each.withColumn("rate", rate).withColumn("share", (F.col("bad") + F.lit(limits.prior) * rate) / weight)
    error = F.lit(limits.merge_errors) * F.sqrt(F.col("share") * (1 - F.col("share")) / weight)
    apart = F.greatest(F.lit(limits.merge_rate), error)
    each = each.withColumn("low", F.col("share") - error).withColumn("high", F.col("share") + error).withColumn(
        "side", F.when(F.col("share") - F.col("rate") > apart, 1).when(F.col("rate") - F.col("share") > apart, -1).otherwise(0))
    # the distribution of what lies below, against that of the siblings on its side
    # with the same most frequent remainder; what a branch lacks counts half a bit each
    pool = ["host", "above", "side", "mode"]
    rows = branches.join(each.select(*own, "branch", "side", "mode"), own)
    rows = summed(summed(rows, [*pool, "below"], n_below="n"), pool, n_pool="n")
    p, q = F.col("n") / F.col("branch"), F.col("n_below") / F.col("n_pool")
    near = rows.groupBy(*own).agg((F.sum(p * F.log2(2 * p / (p + q)) + q * F.log2(2 * q / (p + q))) / 2 + (1 - F.sum(q)) / 2).alias("divergence"))
    like = each.join(near, own).where(F.col("divergence") <= limits.merge_divergence)
    # intervals that overlap, one after the other
    line = Window.partitionBy(*pool).orderBy("low", "child")
    reach = F.max("high").over(line.rowsBetween(Window.unboundedPreceding, -1))
    like = like.withColumn("new", F.when(F.col("low") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(line))
    like = like.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy(*pool, "run"))).where("members > 1")
    number = F.dense_rank().over(Window.partitionBy(*node).orderBy("side", "mode", "run"))
    return like.select(*own, F.concat(F.lit("+"), F.when(number > 1, number.cast("string")).otherwise("")).alias("name"))


def merged(paths: DataFrame, limits: Limits) -> DataFrame:
    """``paths`` with similar sibling branches merged, from the root down."""
    depth = paths.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(depth):
        placed = paths.withColumn("above", F.array_join(F.slice("parts", 1, level), "/")).withColumn("child", F.get("parts", F.lit(level)))
        below = F.array_join(F.slice("parts", level + 2, limits.max_depth + 1), "/")
        rows = placed.where("child is not null").groupBy("host", "above", "child", below.alias("below")).agg(
            *[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
        join = table(alike(table(rows, f"branches-{level}"), limits), f"alike-{level}")
        if join.isEmpty():
            continue
        new = F.concat(F.slice("parts", 1, level), F.array("name"), F.slice("parts", level + 2, limits.max_depth + 1))
        paths = table(placed.join(join, ["host", "above", "child"], "left").withColumn(
            "parts", F.when(F.col("name").isNotNull(), new).otherwise(F.col("parts"))).select(*paths.columns), f"merged-{level}")
    return paths


def templates(urls: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``host, raw, template, judged_by, labelled, rate, reject`` per distinct path
    (with variable forms generalised, ``raw``) of ``host, parts, raw, label`` (label
    1: good, 0: bad, null: none)."""
    paths = table(urls.groupBy("host", "raw").agg(
        F.first("parts").alias("parts"), F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"),
        F.coalesce(F.sum(F.when(F.col("label") == 0, 1)), F.lit(0)).alias("bad")), "paths")
    paths = table(merged(generalised(paths, limits), limits).select("host", "raw", "parts", "labelled", "bad"), "templates")
    all_bad, all_labelled = paths.agg(F.sum("bad"), F.sum("labelled")).first()
    base = ((all_bad or 0) + 1) / ((all_labelled or 0) + 2)
    # labels of every node of the tree: a template's are those of its own urls, an
    # ancestor's those of all urls below it
    own = paths.groupBy("host", "parts").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    at = own.select("host", "parts", "l", "b", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"))
    nodes = at.groupBy("host", F.slice("parts", F.lit(1), F.col("depth")).alias("node")).agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    above = at.select("host", "parts", F.slice("parts", F.lit(1), F.col("depth")).alias("node")).join(nodes, ["host", "node"])
    exact = own.select("host", "parts", F.col("parts").alias("node"), "l", "b")
    steps = exact.withColumn("exact", F.lit(1)).unionByName(above.select("host", "parts", "node", "l", "b", F.lit(0).alias("exact")))
    nearest = steps.where(F.col("l") >= limits.min_labels).groupBy("host", "parts").agg(
        F.max_by(F.struct("node", "l", "b"), F.struct(F.size("node"), "exact")).alias("j"))
    hosts = own.groupBy("host").agg(F.sum("l").alias("lh"), F.sum("b").alias("bh"))
    host_rate = (F.col("bh") + F.lit(limits.prior * base)) / (F.col("lh") + limits.prior)
    rate = F.when(F.col("j").isNull(), host_rate).otherwise((F.col("j.b") + F.lit(limits.prior) * host_rate) / (F.col("j.l") + limits.prior))
    name = lambda parts: F.concat(F.lit("/"), F.array_join(parts, "/"))
    whole = own.join(hosts, "host").join(nearest, ["host", "parts"], "left").select(
        "host", "parts", F.col("l").alias("own_labels"), name(F.col("j.node")).alias("judged_by"), rate.alias("rate"),
        (F.col("j").isNotNull() & (rate > limits.max_bad)).alias("reject"))
    return paths.select("host", "raw", "parts").join(whole, ["host", "parts"]).select(
        "host", "raw", name(F.col("parts")).alias("template"), "judged_by", F.col("own_labels").alias("labelled"), "rate", "reject")


def judge(pages: DataFrame, *, rules=RULES, limits: Limits = Limits()) -> DataFrame:
    """One row per row of ``page_id, url, label``: ``page_id, host, path, rule,
    verdict, template, judged_by, rate``."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), "label")
    urls = urls.withColumn("parts", typed_segments(F.col("path"), limits.max_depth)).withColumn("raw", F.array_join("parts", "/"))
    known = table(templates(urls, limits), "url-templates")
    # both sides come to the join straight from a shuffle, so adaptive execution
    # splits the urls of a path that very many pages share
    found = urls.join(known, ["host", "raw"]).withColumn("fit", matched_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("fit.verdict", F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "template", "judged_by", "rate")
