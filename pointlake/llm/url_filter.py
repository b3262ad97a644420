"""Allow and block rules for URLs by a sort-merge range join over canonical keys.

The canonical key of a host is its labels in reverse, each with a dot behind it (``www.example.org`` -> ``org.example.www.``),
so a host and all its subdomains are one interval of keys; a path prefix is an interval of paths. Intervals of rules
nest or are disjoint. Every rule sends two bounds into the sweep, its start and its end, and each bound carries the
stack of rules that are active behind it; sorted together with the URLs, the last bound before a URL tells its rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pointlake.llm.common import ascii_lower, partitions, session, staged


def url_host(url: Column) -> Column:
    """What stands behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def _end_of_host(key: Column) -> Column:
    """The smallest key behind all that begin with ``key``; the slash follows the dot."""
    return F.concat(F.substring(key, F.lit(1), F.length(key) - 1), F.lit("/"))


def _end_of_path(path: Column) -> Column:
    """Behind every path that begins with ``path``: no text holds the byte 255."""
    return F.concat(path.cast("binary"), F.lit(bytearray(b"\xff")))


def _host_bounds(rules: DataFrame) -> DataFrame:
    """(grp, key, active): host keys of the rules that are active from ``key`` on, outermost first."""
    hosts = rules.select("host_key").distinct()
    labels = F.split(F.expr("substring(host_key, 1, length(host_key) - 1)"), "\\.")
    above = hosts.select(
        "host_key",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))).alias("outer"),
    ).join(hosts.select(F.col("host_key").alias("outer")), "outer")
    stacks = above.groupBy("host_key").agg(F.array_sort(F.collect_list("outer")).alias("stack"))
    start = stacks.select(F.lit("").alias("grp"), F.col("host_key").cast("binary").alias("key"), F.col("stack").alias("active"))
    end = stacks.select(
        F.lit("").alias("grp"), _end_of_host(F.col("host_key")).cast("binary").alias("key"),
        F.slice("stack", F.lit(1), F.size("stack") - 1).alias("active"),
    )
    return start.unionByName(end)


def _path_bounds(rules: DataFrame) -> DataFrame:
    """(grp, key, active): the innermost rule of host ``grp`` from path ``key`` on; a struct of nulls outside all."""
    rule = F.struct("rule", "verdict", F.length("host").alias("host_length"))
    paths = rules.select("host_key", "path", rule.alias("active"))
    shorter = paths.where("path != ''").select(
        "host_key", "path",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n - 1))).alias("outer"),
    )
    parents = (
        shorter.join(paths.select("host_key", F.col("path").alias("outer"), F.col("active").alias("above")), ["host_key", "outer"])
        .groupBy("host_key", "path").agg(F.max_by("above", F.length("outer")).alias("above"))
    )
    nothing = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("host_length"))
    start = paths.select(F.col("host_key").alias("grp"), F.col("path").cast("binary").alias("key"), "active")
    end = paths.join(parents, ["host_key", "path"], "left").select(
        F.col("host_key").alias("grp"), _end_of_path(F.col("path")).alias("key"), F.coalesce("above", nothing).alias("active")
    )
    return start.unionByName(end)


def sweep(probes: DataFrame, bounds: DataFrame) -> DataFrame:
    """probes (row, grp, key, ...) with ``active`` of the last bound of their group at or before their key, else null.

    Bounds and probes are dealt by range, so a hot host or URL is split among tasks; each range is swept in order, and
    what was active at its start comes from the last bound of the ranges before it, one row per range.
    """
    kept = [c for c in probes.columns if c not in ("row", "grp", "key")]
    kind = bounds.schema["active"].dataType
    events = probes.select("row", "grp", "key", *kept, F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("active")).unionByName(
        bounds.select(F.lit(None).cast("long").alias("row"), "grp", "key", F.lit(0).alias("kind"), "active"), allowMissingColumns=True
    )
    dealt = events.repartitionByRange(partitions(probes), "grp", "key", "kind", "row").withColumn("rng", F.spark_partition_id())
    dealt = staged(dealt)
    bound = F.when(F.col("kind") == 0, F.struct("grp", "active"))
    ends = dealt.where("kind = 0").groupBy("rng").agg(F.max_by(F.struct("grp", "active"), F.struct("grp", "key")).alias("at_end"))
    ranges = dealt.select("rng").distinct().join(ends, "rng", "left")
    carried = ranges.select("rng", F.last("at_end", True).over(W.orderBy("rng").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    order = W.partitionBy("rng").orderBy("grp", "key", "kind").rowsBetween(W.unboundedPreceding, 0)
    swept = dealt.select("rng", "row", "grp", *kept, "kind", F.last(bound, True).over(order).alias("last")).where("kind = 1")
    found = F.coalesce("last", "carried")
    return swept.join(carried, "rng", "left").select(
        "row", "grp", *kept, F.when(found["grp"] == F.col("grp"), found["active"]).alias("active")
    )


def filter_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``df``.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains if the URL's path
    starts with the rule's; the longest rule string wins, of equally long ones that with the longer host. A rule given
    twice with both verdicts blocks; rules with a null are ignored. Where no rule fits, ``rule`` is null and the verdict
    is ``default``, as for a null URL or one without ``://``. Repeated rows each give a row, a null id stays null, an
    empty table gives none, without rules everything gets ``default``; other columns are never read.
    """
    session(df)
    url = F.col(url_col)
    pages = staged(df.select(
        F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), F.monotonically_increasing_id().alias("row")
    ))
    rules = (
        rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").dropna()
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select("host", "path", "verdict", F.concat("host", "path").alias("rule"), host_key(F.col("host")).alias("host_key"))
    )
    by_host = pages.select("row", F.lit("").alias("grp"), host_key(F.col("host")).cast("binary").alias("key"), "path")
    hosts = sweep(by_host, _host_bounds(rules)).select("row", F.explode("active").alias("grp"), F.col("path").cast("binary").alias("key"))
    fits = sweep(hosts, _path_bounds(rules)).where("active.rule IS NOT NULL")
    best = fits.groupBy("row").agg(
        F.max_by("active", F.struct(F.length("active.rule"), F.col("active.host_length"))).alias("best")
    )
    return pages.join(best, "row", "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
