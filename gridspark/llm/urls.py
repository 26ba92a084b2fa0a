"""URL filters by a sort-merge range join. DataFrame operations only.

A rule (host, path) becomes the interval of all keys that start with its canonical key: the labels of its
host in reverse order, a slash, its path. Such intervals nest or lie apart, so a sweep over the sorted keys
needs a stack only: the rule on top is the innermost, which is the longest, that holds a key.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from gridspark.functions.sizing import stored

#: Keys that one range of the sweep holds, about.
RANGE_ROWS = 500_000
OPEN, POINT, CLOSE = 0, 1, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty
    where the url is null or has no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    """Canonical key, as bytes. A host holds no slash, so the first one ends it."""
    return F.concat(F.make_valid_utf8(F.concat(F.array_join(labels, "."), F.lit("/"), path))).cast("binary")


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """(host, path, verdict) rows from such tuples."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _clean(rules: DataFrame) -> DataFrame:
    """One row a rule. Of several verdicts for one rule block holds."""
    known = F.col("verdict").isin("allow", "block")
    verdict = F.when(known, F.col("verdict")).otherwise(F.raise_error(F.lit("a verdict is allow or block")).cast("string"))
    host = F.translate("host", UPPER, LOWER)
    return (rules.filter(F.coalesce(F.col("host"), F.lit("")) != "")
            .select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), verdict.alias("verdict"))
            .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))


def sweep(points: DataFrame, intervals: DataFrame, ranges: int) -> DataFrame:
    """Each row of ``points`` (key and other columns) with ``top``, the struct ``item`` of the shortest
    interval that holds its key; null outside all. ``intervals`` (key, item) holds one row for each
    distinct key: all keys that start with it.

    Keys and both ends of all intervals are sorted into ranges, equal keys split by a hash. An
    interval that goes on in later ranges is opened again at the start of each; only nested ones
    reach over a border, so a range gets as many as they nest deep. In a range the height of the
    stack after each step is a running sum of openings less closings, and the item on top is the
    last one opened at that height.
    """
    names = [c for c in points.columns if c != "key"]
    row = F.struct(*names)
    none = F.lit(None).cast(intervals.schema["item"].dataType)
    steps = points.select("key", F.lit(POINT).alias("kind"), F.xxhash64("key", *names).alias("tie"), row.alias("row"), none.alias("item"))
    empty = F.lit(None).cast(steps.schema["row"].dataType)
    # No byte of a text is FF, so the key with it follows all that start with the key.
    for kind, end in ((OPEN, F.col("key")), (CLOSE, F.concat("key", F.unhex(F.lit("FF"))))):
        steps = steps.unionByName(intervals.select(end.alias("key"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("tie"), empty.alias("row"), "item"))
    dealt = steps.repartitionByRange(ranges, "key", "kind", "tie").withColumn("part", F.spark_partition_id())
    dealt = stored(dealt, "url-steps")
    ends = dealt.filter(F.col("kind") != POINT).groupBy("item").agg(
        F.min("part").alias("a"), F.max("part").alias("z"), F.min_by("key", "kind").alias("key")).filter("z > a")
    again = ends.select("key", F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("tie"), empty.alias("row"), "item",
                        F.explode(F.sequence(F.col("a") + 1, F.col("z"))).alias("part"))
    order = [(F.col("kind") >= 0), "key", "kind", "tie"]
    all_steps = dealt.unionByName(again)
    height = F.sum(F.when(F.col("kind") <= OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0))
    all_steps = all_steps.withColumn("height", height.over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    opened = F.last(F.when(F.col("kind") <= OPEN, F.col("item")), ignorenulls=True)
    top = opened.over(W.partitionBy("part", "height").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    all_steps = all_steps.withColumn("top", F.when(F.col("height") > 0, top)).filter(F.col("kind") == POINT)
    return all_steps.select("key", *[F.col(f"row.{c}").alias(c) for c in names], "top")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    ``rules`` has the columns host, path and verdict (allow or block). A rule fits urls of its host and all
    subdomains whose path starts with the rule's, letter for letter; of those that fit the one longest
    as host and path together decides, of equally long ones that with the longer host. ``rule`` is its
    host and path, null where none fits; there ``default`` is the verdict. Distinct pairs of host and
    path are judged, once for each length in labels that a rule's host has, and meet the pages again
    by a join, in which adaptive execution splits a pair with many rows.

    A null url or one without ``://`` has an empty host and path and fits no rule. Null or repeated
    page_ids are rows like all others; other columns of ``pages``, whatever their names, are not
    read. Rules without a host are ignored, a null path is an empty one, and repeated rules
    are one, a block where they differ. Without rules all get the default, an empty table gives
    none. Texts of any length are keys whole.
    """
    if default not in ("allow", "block"):
        raise ValueError("the default is allow or block")
    spark = pages.sparkSession
    rules = stored(_clean(rules), "url-rules")
    # A host has 127 labels at most by its standard; rules differ in a handful.
    levels = sorted(r[0] for r in rules.select(F.size(_labels(F.col("host")))).distinct().collect())
    found = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not levels:
        return found.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    points = found.filter("host <> ''").select("host", "path").distinct().withColumn("labels", _labels(F.col("host")))
    level = F.explode(F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n <= F.size("labels")))
    points = points.select("host", "path", "labels", level.alias("level"))
    points = points.select("host", "path", _key(F.slice("labels", F.lit(1), F.col("level")), F.col("path")).alias("key"))
    intervals = rules.select(_key(_labels(F.col("host")), F.col("path")).alias("key"), F.struct(
        (F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"),
        F.concat("host", "path").alias("rule"), "verdict").alias("item"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() * len(levels) // RANGE_ROWS))
    best = sweep(points, intervals, ranges).groupBy("host", "path").agg(F.max("top").alias("top"))
    judged = found.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

SQL = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT row_number() OVER () AS no, page_id,
             coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
fit AS (SELECT no, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY no ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
        FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (no)
"""
