"""URL verdicts: given rules first, then a path-template tree.

Per host the path segments form a tree, as deep as the paths go.  Segments of a
variable kind (numbers, long hex) become wildcards.  Labelled pages (those that
a rule decides) are counted at every node; siblings, however many, whose blocked
share does not differ significantly from their parent's are merged into one
branch.
A page without a rule is blocked when the smoothed blocked share of its
template exceeds THRESHOLD.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import lower_ascii, stage

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Deviations that make a branch its own, pages of prior weight.
DEVIATIONS, WEIGHT, THRESHOLD = 2.0, 4.0, 0.5
NUMBER, HEX = r"^[0-9]+(\.[a-z]+)?$", r"^[0-9a-f-]{8,}$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null or a url without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return (lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null without one."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def _segments(path: Column) -> Column:
    """All segments, variable kinds as wildcards."""
    kind = lambda s: F.when(s.rlike(NUMBER), "{n}").when(s.rlike(HEX), "{x}").otherwise(s)
    return F.transform(F.split(F.substr(path, F.lit(2)), "/", -1), kind)


def template_purity(pages: DataFrame) -> DataFrame:
    """``pages`` (host, segs, blocked: true, false or null) to one row per
    (host, segs): its template and the template's smoothed blocked share.

    A node whose labelled pages are all alike, or with no path that goes on,
    is a template: no branch below it can differ.  Others are split by their
    next segment, '' after a path's end, until no node is left.
    """
    paths = pages.groupBy("host", "segs").agg(F.count("blocked").alias("n"), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0)).alias("b"))
    paths, at, level, done = stage(paths.withColumn("template", F.lit(""))), ["host", "template"], 0, []
    while not done or not paths.isEmpty():
        nodes = paths.groupBy(*at).agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"), F.max(F.size("segs")).alias("deep"))
        paths = stage(paths.join(nodes, at))
        goes_on = F.col("deep") > level
        splits = goes_on & (F.col("pb") > 0) & (F.col("pb") < F.col("pn"))
        ended = paths.where(~splits)
        if not done or not ended.isEmpty():
            done.append(ended.select("host", "segs", "n", "b", F.concat("template", F.when(goes_on, "/*").otherwise("")).alias("template")))
        paths = paths.where(splits).withColumn("seg", F.coalesce(F.get("segs", F.lit(level)), F.lit("")))
        share = F.col("pb") / F.col("pn")
        far = (F.abs(F.col("cb") - F.col("cn") * share) > DEVIATIONS * F.sqrt(F.col("cn") * share * (1 - share) + 0.25))
        branch = (paths.groupBy(*at, "seg", "pn", "pb").agg(F.sum("n").alias("cn"), F.sum("b").alias("cb"))
                  .select(*at, "seg", F.when(far, F.col("seg")).otherwise("*").alias("branch")))
        paths = stage(paths.join(branch, [*at, "seg"])
                      .select("host", "segs", "n", "b", F.concat("template", F.lit("/"), "branch").alias("template")))
        level += 1
    paths = reduce(DataFrame.union, done)
    stats = paths.groupBy("host", "template").agg(F.sum("n").alias("tn"), F.sum("b").alias("tb"))
    stats = stage(stats)
    b, n = stats.agg(F.sum("tb"), F.sum("tn")).first()
    prior = min((b or 0) / max(n or 0, 1), THRESHOLD)  # a template without labelled pages is not blocked
    stats = stats.select("host", "template", ((F.col("tb") + WEIGHT * prior) / (F.col("tn") + WEIGHT)).alias("purity"))
    return paths.select("host", "segs", "template").join(stats, ["host", "template"])


def url_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), template and
    purity (its blocked share) of every row of ``pages``.  Repeated rows are
    kept; an empty host is a host like any other."""
    host, path = host_and_path(F.col("url"))
    sheet = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    sheet = sheet.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"), _segments(F.col("path")).alias("segs"))
    purity = template_purity(sheet.select("host", "segs", (F.col("given") == "block").alias("blocked")))
    return (sheet.join(purity, ["host", "segs"])
            .select("page_id", "host", "path", "rule",
                    F.coalesce("given", F.when(F.col("purity") > THRESHOLD, "block").otherwise("allow")).alias("verdict"),
                    "template", F.round("purity", 6).alias("purity")))
