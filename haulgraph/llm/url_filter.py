"""URL filter by a path-template tree, in DataFrame operations.

Each host's paths form a tree of segments. Segments of digits, hexadecimal digests or long mixed runs are generalised by
shape; then, level by level, a node's children become one wildcard if they are many for its rows, and children whose share
of bad pages does not differ significantly (|z| < ``similar``) from that of their node are merged into one branch, which
leaves apart those that differ. What stays is a template; its purity is the share of bad among its labelled pages,
smoothed towards its host's, which is smoothed towards that of all. Templates of ``reject`` or more are blocked. Explicit
rules come first: of the rules that fit a page's host or a parent domain and begin its path, the longest decides.

The tree is grown over distinct (host, shape) counts, not pages; only blocked shapes join back to the pages.

What all paths of a branch share is taken at once, so the tree has as many rounds as a path has partings.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; paths may be
of any length and depth; page ids may be null (then unlabelled) and repeat, each row being judged by its own url; several
labels of a page count as bad if any is; without labels every page that no rule fits is allowed; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url):
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url):
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _shape(segment):
    """A segment by its shape: digits and digests vary, an extension stays."""
    stem, ending = F.regexp_extract(segment, "(?s)^(.*?)(\\.[A-Za-z]{1,5})?$", 1), F.regexp_extract(segment, "(?s)^(.*?)(\\.[A-Za-z]{1,5})?$", 2)
    kind = F.when(stem.rlike("^[0-9]+$"), F.lit("<n>")).when(stem.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("<x>")).when((F.length(stem) > 24) & stem.rlike("[0-9]"), F.lit("<m>")).otherwise(stem)
    return F.concat(kind, ending)


def _fits(rule: tuple[str, str, str]):
    _, domain, begin = rule
    return ((F.col("host") == domain) | F.endswith(F.col("host"), F.lit(f".{domain}"))) & F.startswith(F.col("path"), F.lit(begin))


def grow(shapes: DataFrame, scratch: Scratch, many: int = 20, varied: float = 0.5, similar: float = 1.96) -> DataFrame:
    """(host, shape, template, pages, labelled, bad): the template of every shape, level by level."""
    mark, done = scratch.mark(), []
    names = ["host", "shape", "template", "pages", "labelled", "bad"]
    tree = scratch.cut(shapes.withColumn("template", F.lit("")).withColumn("level", F.lit(0)))
    alike_to = F.aggregate(F.sequence(F.lit(0), F.least(F.size("low"), F.size("high"))), F.lit(0), lambda a, i: F.when((a == i) & (F.get("low", i) == F.get("high", i)), i + 1).otherwise(a))
    rest = F.slice("shape", F.col("level") + 1, F.greatest(F.size("shape") - F.col("level"), F.lit(0)))
    while True:
        # what all of a node's paths share is taken at once; what is alone in its node, or at its end, has its template
        common = tree.groupBy("host", "template").agg(F.min(rest).alias("low"), F.max(rest).alias("high")).select("host", "template", alike_to.alias("more"))
        along = F.slice("shape", F.col("level") + 1, F.col("more"))
        ending = F.when(F.col("more") > 0, F.concat("template", F.lit("/"), F.array_join(along, "/"))).otherwise(F.col("template"))
        known = scratch.cut(tree.join(common, ["host", "template"]).select("host", "shape", ending.alias("template"), "pages", "labelled", "bad", (F.col("level") + F.col("more")).alias("level")))
        ends = F.size("shape") <= F.col("level")
        done.append(known.filter(ends).select(names))
        tree = known.filter(~ends)
        if tree.isEmpty():
            break
        segment = F.get("shape", F.col("level"))
        child = tree.groupBy("host", "template", segment.alias("segment")).agg(F.sum("pages").alias("pages"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        child = scratch.cut(child)
        node = child.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("pages").alias("all_pages"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        share = F.col("all_bad") / F.greatest(F.col("all_labelled"), F.lit(1))
        spread = F.sqrt(F.greatest(share * (1 - share) * F.col("labelled"), F.lit(1e-9)))
        z = (F.col("bad") - share * F.col("labelled")) / spread
        wild = (F.col("children") >= many) & (F.col("children") >= varied * F.col("all_pages"))
        alike = (F.col("children") > 1) & (F.abs(z) < similar) & (F.col("all_labelled") > 0)
        name = F.when(wild | alike, F.lit("*")).otherwise(F.col("segment"))
        step = scratch.cut(child.join(node, ["host", "template"]).select("host", "template", "segment", F.concat("template", F.lit("/"), name).alias("next")))
        tree = scratch.cut(tree.withColumn("segment", segment).join(step, ["host", "template", "segment"]).select("host", "shape", F.col("next").alias("template"), "pages", "labelled", "bad", (F.col("level") + 1).alias("level")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = scratch.cut(out)
    scratch.only(mark, out)
    return out


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], reject: float = 0.5, mass: float = 4.0, scratch: Scratch | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every row of ``pages`` (page_id, url).

    ``labels``: (page_id, bad 0 or 1). ``rules``: (block or allow, domain, beginning of the path).
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"rules: {MAX_RULES} at most")
    scratch = scratch or Scratch(pages.sparkSession)
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    segments = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    shape = F.transform(segments, _shape)
    rows = scratch.cut(parts.withColumn("shape", shape))
    known = labels.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    shapes = rows.filter("host <> ''").join(known, "page_id", "left").groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = grow(shapes, scratch)
    everything = tree.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("k")).first()
    overall = (everything["k"] or 0) / max(1, everything["n"] or 0)
    hosts = tree.groupBy("host").agg(((F.sum("bad") + mass * overall) / (F.sum("labelled") + mass)).alias("host_share"))
    templates = tree.groupBy("host", "template").agg(F.sum("labelled").alias("n"), F.sum("bad").alias("k")).join(hosts, "host").withColumn("purity", (F.col("k") + mass * F.col("host_share")) / (F.col("n") + mass))
    rejected = templates.filter((F.col("purity") >= reject) & (F.col("n") > 0)).select("host", "template", "purity")
    blocked = scratch.cut(tree.select("host", "shape", "template").join(rejected, ["host", "template"]))
    judged = rows.join(blocked, ["host", "shape"], "left")
    # the longest rule first; equal lengths in order of their text
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule, action = F.lit(None).cast("string"), F.when(F.col("purity").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    for r in reversed(ordered):
        rule, action = F.when(_fits(r), F.lit(r[1] + r[2])).otherwise(rule), F.when(_fits(r), F.lit(r[0])).otherwise(action)
    return judged.select("page_id", "host", "path", rule.alias("rule"), action.alias("verdict"), "template")
