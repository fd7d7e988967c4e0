"""URL rules: every URL is expanded into host-suffix and path-prefix expressions that meet the rules by hash.

Only DataFrame functions run. A rule (host, path, verdict) fits its host and all its subdomains where the URL's path starts with
the rule's path. Of the rules that fit, the longest host + path wins; among equally long ones the longer host, then `block`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orecart.llm.common import ascii_lower

#: Rules up to this many rows and characters are broadcast; larger sets are joined by shuffle.
BROADCAST_ROWS, BROADCAST_CHARS = 50_000, 4_000_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict added; its other columns of those names are replaced.

    * null URL, or one without `://`: host and path empty, rule null, verdict `default`.
    * rules with null or empty host fit nothing; a null path counts as empty and fits every path.
    * repeated rows and repeated URLs stay; an empty table gives an empty result; no rules give `default` throughout.
    * of equal rules with different verdicts `block` wins.

    Distinct URLs are expanded only into the shapes (labels, path length) that rules have, so very long hosts and paths cost no
    more than short ones. The join is on 32 bits of SHA-256; the whole digest confirms. The number of distinct shapes is bounded by
    label counts and path lengths that occur in rules, not by the number of rules.
    """
    known = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")).filter("r_host <> ''")
    known = known.withColumns({"labels": F.size(F.split("r_host", r"\.")), "path_len": F.length("r_path")})
    size = known.agg(F.count(F.lit(1)), F.sum(F.length("r_host") + F.length("r_path"))).first()
    shapes = [(r[0], r[1]) for r in known.select("labels", "path_len").distinct().collect()]
    listed = known.withColumn("digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("prefix", F.substring("digest", 1, 8)).drop("labels", "path_len")
    if size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_CHARS:
        listed = F.broadcast(listed)

    parsed = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).drop("rule", "verdict")
    shape = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("path_len")) for a, b in sorted(shapes)]) if shapes else F.array().cast("array<struct<labels:int,path_len:int>>")
    seen = pages.select(F.col(url).alias("_url")).filter(F.col("_url").isNotNull()).distinct()
    seen = seen.withColumns({"u_host": url_host(F.col("_url")), "u_path": url_path(F.col("_url"))}).filter("u_host <> ''")
    expanded = seen.withColumn("shape", F.explode(shape)).filter(
        (F.size(F.split("u_host", r"\.")) >= F.col("shape.labels")) & (F.length("u_path") >= F.col("shape.path_len"))
    )
    suffix, start = F.substring_index("u_host", ".", -1), F.expr("left(u_path, shape.path_len)")
    suffix = F.expr("array_join(slice(split(u_host, '[.]'), -shape.labels, shape.labels), '.')")
    expanded = expanded.select("_url", _digest(suffix, start).alias("u_digest"))
    hits = expanded.withColumn("prefix", F.substring("u_digest", 1, 8)).join(listed, "prefix").filter("u_digest = digest")
    order = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("a"), F.length("r_host").alias("b"), (F.col("r_verdict") == "block").cast("int").alias("c")
    )
    best = hits.groupBy("_url").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("_best"))
    # rows without a url or host have no hit; they stay out of the join, where they would all meet in one task
    has = F.col(url).isNotNull() & (F.col("host") != "")
    met = parsed.filter(has).join(best, parsed[url] == best["_url"], "left")
    none = parsed.filter(~has).withColumns({"_url": F.lit(None).cast("string"), "_best": F.lit(None).cast(best.schema["_best"].dataType)})
    joined = met.unionByName(none)
    return joined.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))}).drop("_url", "_best")
