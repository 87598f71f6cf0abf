"""URL filters by a sort-merge range join; DataFrame functions only.

A rule is a host and a path prefix. The canonical key of a host is its labels in reverse, each
closed by a low character, then a separator and the path, so the keys a rule covers are an
interval that begins with the rule's own key, and intervals nest or are apart. A page has a key
for its host and one for each domain above it. Rules and keys are sorted together; the sweep
carries the stack of rules nested at the last rule passed, and a key pops what doesn't cover it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.staging import stage

RULES = "host string, path string, verdict string"
#: Verdict of a page that no rule fits.
DEFAULT = "allow"

_LABEL_END, _HOST_END = "\x01", "\x02"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end.

    Both empty for a null url or one without ://.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _key(labels: Column, path: Column) -> Column:
    """labels: in reverse."""
    ended = F.transform(labels, lambda x: F.concat(x, F.lit(_LABEL_END)))
    return F.concat(F.concat_ws("", ended), F.lit(_HOST_END), path)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): each rule's key with the rules that cover it, from the widest to itself.

    A rule covers another of the same host whose path begins with its own, so its ancestors
    are found by an equal join on all beginnings of the other's key. Of rules with the same host
    and path, the least verdict counts; rules with a null part are left out.
    """
    rules = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict"
    ).where("host is not null and path is not null and verdict is not null")
    keyed = rules.withColumn("key", _key(_labels(F.col("host")), F.col("path")))
    own = F.struct(
        (F.length("host") + F.length("path")).alias("length"),
        F.length("host").alias("host_length"),
        "key",
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    keyed = keyed.groupBy("key").agg(F.min(own).alias("own"))
    host_end = F.instr("key", _HOST_END)
    beginnings = F.transform(F.sequence(host_end, F.length("key")), lambda n: F.substring("key", 1, n))
    begun = keyed.select(F.col("key").alias("inner"), F.explode(beginnings).alias("key"))
    stacks = begun.join(keyed, "key").groupBy("inner").agg(F.array_sort(F.collect_list("own")).alias("stack"))
    return stacks.withColumnRenamed("inner", "key")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict, a row per page.

    A rule fits its host and all hosts below it if the page's path begins with the rule's. The
    longest rule (host and path together, then the host alone) wins; without one, rule is null
    and the verdict the default. Null and unreadable urls have an empty host and path, repeated
    rows and ids are kept, other columns are not looked at, an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = stage(
        pages.select("page_id", host.alias("host"), path.alias("path")).withColumn(
            "uid", F.monotonically_increasing_id()
        )
    )
    labels = _labels(F.col("host"))
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.slice(labels, F.lit(1), n))
    points = rows.select("uid", F.explode(above).alias("labels"), "path")
    points = points.select(
        _key(F.col("labels"), F.col("path")).alias("key"),
        F.lit(1).alias("kind"),
        F.xxhash64("uid").alias("salt"),
        "uid",
        F.lit(None).cast(rule_stacks(rules).schema["stack"].dataType).alias("stack"),
    )
    opened = rule_stacks(rules).select(
        "key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("salt"), F.lit(None).cast("long").alias("uid"), "stack"
    )
    # ranges of about equal size: keys of one url, however frequent, are told apart by their salt
    dealt = opened.union(points).repartitionByRange("key", "kind", "salt")
    swept = stage(dealt.withColumn("part", F.spark_partition_id()))
    in_order = Window.partitionBy("part").orderBy("key", "kind", "salt").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("stack", ignorenulls=True)
    # what is open where a range begins: the last rule of the ranges before (a row per range)
    ends = swept.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("end"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("part", F.last("end", ignorenulls=True).over(before).alias("carried"))
    seen = swept.withColumn("open", last.over(in_order)).where("kind = 1")
    seen = seen.join(F.broadcast(carried), "part")
    covering = F.filter(F.coalesce("open", "carried"), lambda r: F.col("key").startswith(r["key"]))
    hits = seen.withColumn("top", F.try_element_at(covering, F.lit(-1))).where("top is not null")
    best = hits.groupBy("uid").agg(F.max(F.struct("top.length", "top.host_length", "top.rule", "top.verdict")).alias("best"))
    return rows.join(best, "uid", "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
