"""URL filters: rules first, then a tree of path templates for each host, in DataFrame operations alone.

Segment by segment to the end of the path, the values under a template of a host become one wildcard where they vary
(numbers, or many values for few urls). Urls that rules decide label the templates they fall under. Sibling templates
whose share of blocked labels does not differ significantly from their siblings' are merged, and a template is rejected
when its share, smoothed towards the share of all labels, is high enough. A template without labels takes the smoothed
share of its merged siblings, else of its host, else that of all labels; each speaks for others only where two labelled
templates make it up, since one says nothing of how much they differ. With less than that there is no share, and the
template is allowed.

A url that is null or has no "://" has an empty host and path, and no rule. Repeated rows and ids are judged each. All
steps are aggregations and joins on (host, template) with partial sums first, so a hot host is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: Least distinct values and their share of urls for a wildcard; how far from its siblings' share (in standard errors) a template may be to be merged with them; weight of the prior; labelled templates that may speak for others; share to reject from.
MANY, VARIES, SIMILAR, PRIOR_WEIGHT, SPEAK, REJECT = 3, 0.5, 1.64, 4.0, 2, 0.8
#: Segments after which lineage is cut: each refers to the rows twice, so the plan doubles with each.
STEPS = 2


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>, or null. A rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = F.concat(F.lit("."), host).endswith(f".{h}") & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def templates(urls: DataFrame) -> DataFrame:
    """urls (with host and path) and template: the path with its variable segments as wildcards."""
    rows = urls.withColumns({"template": F.lit(""), "segments": F.filter(F.split("path", "/"), lambda s: s != "")})
    depth = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    for k in range(depth):
        rows = rows.withColumn("segment", F.coalesce(F.get("segments", F.lit(k)), F.lit("")))
        number = F.col("segment").rlike(r"^[0-9]+(\.\w+)?$")
        values = rows.where(F.col("segment") != "").groupBy("host", "template", "segment").agg(F.count("*").alias("n"))
        varied = values.groupBy("host", "template").agg(F.count("*").alias("values"), F.sum("n").alias("urls"))
        varied = varied.where((F.col("values") >= MANY) & (F.col("values") > VARIES * F.col("urls"))).select("host", "template", F.lit(True).alias("wild"))
        rows = rows.join(varied, ["host", "template"], "left")
        step = F.when(F.col("segment") == "", "").when(F.col("wild") | number, "/*").otherwise(F.concat(F.lit("/"), "segment"))
        rows = rows.withColumn("template", F.concat("template", step)).drop("wild", "segment")
        if k % STEPS == STEPS - 1 or k == depth - 1:
            rows = cut(rows)
    return rows.drop("segments")


def purity(rows: DataFrame) -> DataFrame:
    """host, template, purity: the smoothed share of blocked labels, from above where a template has none. rows: host, template, label (1, 0 or null)."""
    every = rows.groupBy("host", "template").agg(F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    every = every.withColumn("parent", F.regexp_replace("template", r"/[^/*]+", "/{}"))
    some = F.col("n") > 0
    sums = F.sum("n").alias("pool_n"), F.sum("bad").alias("pool_bad"), F.count_if(some).alias("pool_count")
    pool = every.groupBy("host", "parent").agg(*sums)
    whole = pool.groupBy("host").agg(F.sum("pool_n").alias("host_n"), F.sum("pool_bad").alias("host_bad"), F.sum("pool_count").alias("host_count"))
    prior = whole.agg(F.try_divide(F.sum("host_bad"), F.sum("host_n")).alias("prior"), F.sum("host_count").alias("count"))
    every = every.join(pool, ["host", "parent"])
    p = F.try_divide("pool_bad", "pool_n")
    own = F.try_divide("bad", "n")
    alike = F.abs(own - p) <= SIMILAR * F.sqrt(F.try_divide(p * (1 - p), F.col("n")))
    every = every.select("host", "template", "parent", "n", "bad", F.coalesce(alike, F.lit(False)).alias("alike"))
    merged = every.where("alike").groupBy("host", "parent").agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.count("*").alias("all_count"))
    branch = pool.join(merged, ["host", "parent"], "left").join(whole, "host").crossJoin(F.broadcast(prior))  # one row
    smooth = lambda n, bad: (bad + PRIOR_WEIGHT * F.col("prior")) / (n + PRIOR_WEIGHT)
    above = F.when(F.col("all_count") >= SPEAK, smooth(F.col("all_n"), F.col("all_bad"))).when(F.col("host_count") >= SPEAK, smooth(F.col("host_n"), F.col("host_bad"))).when(F.col("count") >= SPEAK, F.col("prior"))
    branch = branch.select("host", "parent", "all_n", "all_bad", "prior", above.alias("above"))
    n, bad = (F.when(F.col("alike"), F.col(f"all_{c}")).otherwise(F.col(c)) for c in ("n", "bad"))
    return every.join(branch, ["host", "parent"]).select("host", "template", F.when(some, smooth(n, bad)).otherwise(F.col("above")).alias("purity"))


def judge(pages: DataFrame, rules: list[Rule], reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row. Urls that a rule decides are the labels."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    rows = templates(rows).withColumn("label", (F.col("found.verdict") == "block").cast("int"))
    rows = rows.join(purity(rows), ["host", "template"], "left")
    own = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "template", "purity")
