"""URL filters (5): longest-prefix rules by a sort-merge range join; DataFrame operations only.

A url's host, its labels reversed, and its path make a canonical key, so that a rule (host, path) covers an
interval of keys: those that start with its own. Hosts nest by labels: a url is looked up under each suffix
of its host that has as many labels as some rule's host. Keys of urls and bounds of rules are partitioned by
range, equal keys being told apart by row, so that neither a hot host nor a hot url makes a large range. A
range begins with the rules that are open at its start, the outermost first; there are no more of them than
rules nest. It is swept once in order, with a stack of the active rules: the stack's height is the running
number of bounds opened less closed, and what lies on top at a height is the rule that was last opened to
that height.

A null url, or one without ://: empty host and path, no rule. Of rules of equal length (host and path
together) that fit, the greater in code point order wins. Rules that differ in nothing but their action: block
wins. Rules with null host or path are left out. Empty tables: no rows, or no rules. Repeated rows are judged
each. Other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: In order at one key: a rule opens, a url stands, a rule closes.
_OPEN, _URL_KIND, _CLOSE = 0, 1, 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, _URL, k), F.lit(""))
    return ascii_lower(part(1)), part(2)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    """Reversed labels and path; # stands in no host, so no host's key starts with another's."""
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("#"), path), "UTF-8")


def _clean(rules: DataFrame) -> DataFrame:
    """start (the key where a rule opens), depth (labels of its host) and own (length, rule, action), once for each rule."""
    once = rules.filter("host is not null and path is not null").withColumn("host", ascii_lower(F.col("host"))).groupBy("host", "path").agg(F.max(F.lower("action")).alias("action"))
    own = F.struct(F.length(F.concat("host", "path")).alias("length"), F.concat("host", "path").alias("rule"), "action")
    return once.select(_key(_labels(F.col("host")), F.col("path")).alias("start"), F.size(_labels(F.col("host"))).alias("depth"), own.alias("own"))


def _events(pages: DataFrame, rules: DataFrame, id_col: str, url_col: str, depths: list[int]) -> DataFrame:
    """key, kind, row and page of urls (page once for each row); key, kind, start and own of the rules' bounds."""
    host, path = host_and_path(F.col(url_col))
    urls = (
        pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("labels", _labels(F.col("host")))
        .withColumn("depth", F.explode(F.filter(F.array(*[F.lit(d) for d in sorted({1, *depths})]), lambda d: d <= F.size("labels"))))
        .select(
            _key(F.slice("labels", F.lit(1), F.col("depth")), F.col("path")).alias("key"), F.lit(_URL_KIND).alias("kind"), "row",
            F.when(F.col("depth") == 1, F.struct("page_id", "host", "path")).alias("page")
        )
    )
    opens = rules.select(F.col("start").alias("key"), F.lit(_OPEN).alias("kind"), "start", "own")
    closes = rules.select(F.concat("start", F.lit(bytearray(b"\xff"))).alias("key"), F.lit(_CLOSE).alias("kind"), "start", "own")
    return urls.unionByName(opens.union(closes), allowMissingColumns=True)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", lots: int | None = None) -> DataFrame:
    """page_id, host, path, rule (host and path of the longest that fits, or null) and verdict, for each row of pages. lots: ranges of keys."""
    lots = lots or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clean = _clean(rules)
    depths = [r[0] for r in clean.select("depth").distinct().collect()]  # a host has at most 127 labels
    ranged = materialize(_events(pages, clean, id_col, url_col, depths).repartitionByRange(lots, "key", "kind", F.xxhash64("row")).withColumn("lot", F.spark_partition_id()))
    spans = ranged.filter(F.col("kind") != _URL_KIND).groupBy("start").agg(F.min("lot").alias("first"), F.max("lot").alias("last"), F.max("own").alias("own")).filter("first < last")
    carried = spans.select(F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("lot"), F.col("start").alias("key"), F.lit(_OPEN).alias("kind"), "own", F.lit(True).alias("carried"))
    events = ranged.select("lot", "key", "kind", "row", "page", F.when(F.col("kind") == _OPEN, F.col("own")).alias("own"), F.lit(False).alias("carried")).unionByName(carried, allowMissingColumns=True)
    order = [F.col("carried").desc(), "key", "kind", "row"]
    so_far = lambda *by: Window.partitionBy("lot", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == _OPEN, 1).when(F.col("kind") == _CLOSE, -1).otherwise(0)
    swept = events.withColumn("height", F.sum(step).over(so_far())).withColumn("top", F.last("own", ignorenulls=True).over(so_far("height")))
    active = F.when(F.col("height") > 0, F.col("top"))
    return (
        swept.filter(F.col("kind") == _URL_KIND)
        .groupBy("row").agg(F.max(active).alias("best"), F.first("page", ignorenulls=True).alias("page"))
        .select("page.page_id", "page.host", "page.path", "best.rule", F.coalesce("best.action", F.lit(default)).alias("verdict"))
    )
