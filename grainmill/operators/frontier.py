"""The frontier in batches: dedup on entry, polite leases by policy, reports, pacing.

`urls`: job, hash, url, host, depth, score, discovered, status (waiting, done, abandoned), ready_at, attempts.
`hosts`: host, next_at, delay (seconds). Time is always an argument. A lease of n URLs at one instant equals n
successive leases: a free host with a pause gives its best URL alone, one without a pause all it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_ATTEMPTS = 3


def order(policy: str) -> list[Column]:
    c = F.col
    orders = {
        "priority": [c("score").desc(), c("discovered").asc(), c("hash").asc()],
        "breadth": [c("depth").asc(), c("discovered").asc(), c("hash").asc()],
        "depth": [c("depth").desc(), c("discovered").desc(), c("hash").desc()],
        "random": [F.xxhash64("hash", F.lit(42)).asc()],
    }
    if policy not in orders:
        raise ValueError(f"no policy {policy!r}; there are {', '.join(sorted(orders))}")
    return orders[policy]


def first_of(rows: DataFrame, keys: list[str], *by: Column) -> DataFrame:
    """The first row of each key in this order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("__n = 1").drop("__n")


def add(known: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("job", "hash")) -> DataFrame:
    """What of `found` is new, each URL as it was first seen."""
    return first_of(found, list(keys), F.col("discovered"), F.col("seq")).join(known.select(*keys), list(keys), "left_anti")


def ready(urls: DataFrame, hosts: DataFrame, now: Column) -> DataFrame:
    """Waiting URLs whose time has come, of hosts that are not cooling."""
    out = urls.where((F.col("status") == "waiting") & (F.coalesce(F.col("ready_at"), now) <= now)).join(hosts.select("host", "next_at", "delay"), "host", "left")
    return out.where(F.col("next_at").isNull() | (F.col("next_at") <= now))


def lease(urls: DataFrame, hosts: DataFrame, now: Column, n: int, policy: str = "priority", rate: float = 0.0) -> DataFrame:
    """The next n requests; rate: least seconds between two requests to a host."""
    by = order(policy)
    wait = F.greatest(F.lit(float(rate)), F.coalesce(F.col("delay"), F.lit(0.0)))
    rows = ready(urls, hosts, now).withColumn("wait", wait).withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy(*by)))
    return rows.where((F.col("nth") == 1) | (F.col("wait") <= 0)).orderBy(*by).limit(n).drop("nth")


def cooled(leased: DataFrame, now: Column) -> DataFrame:
    """Hosts once these leases are out: host, next_at, delay; those without a pause stay as they are."""
    cool = leased.where("wait > 0").groupBy("host").agg(F.max("wait").alias("w"), F.max("delay").alias("delay"))
    return cool.select("host", later(now, F.col("w")).alias("next_at"), F.coalesce("delay", F.lit(0.0)).alias("delay"))


def after_lease(urls: DataFrame, hosts: DataFrame, leased: DataFrame, now: Column, hold: float) -> tuple[DataFrame, DataFrame]:
    """Both tables once these leases are out: URLs held for `hold` seconds with one attempt more, their hosts cooling."""
    out = urls.join(leased.select("job", "hash", F.lit(True).alias("out")), ["job", "hash"], "left")
    out = out.withColumn("ready_at", F.when(F.col("out"), later(now, F.lit(hold))).otherwise(F.col("ready_at"))).withColumn("attempts", F.col("attempts") + F.when(F.col("out"), 1).otherwise(0)).drop("out")
    joined = hosts.join(cooled(leased, now).select("host", F.col("next_at").alias("then")), "host", "full")
    return out, joined.select("host", F.coalesce("then", "next_at").alias("next_at"), F.coalesce("delay", F.lit(0.0)).alias("delay"))


def next_due(urls: DataFrame, hosts: DataFrame, now: Column) -> float | None:
    """When the next waiting URL can be leased, in seconds since the epoch; None if none ever can."""
    waiting = urls.where("status = 'waiting'").join(hosts.select("host", "next_at"), "host", "left")
    due = waiting.agg(F.min(F.greatest(F.coalesce("ready_at", now), F.coalesce("next_at", now))).alias("at")).select(F.unix_micros("at").alias("at")).first()["at"]
    return None if due is None else due / 1e6


def later(at: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + (seconds * 1_000_000).cast("long"))


def report(urls: DataFrame, reports: DataFrame) -> DataFrame:
    """Applies reports (job, hash, attempt, ok); one for another attempt than the current is stale and ignored; the third failure abandons."""
    current = reports.groupBy("job", "hash", F.col("attempt").alias("attempts")).agg(F.max(F.col("ok").cast("int")).alias("ok"))
    out = urls.join(current, ["job", "hash", "attempts"], "left")
    failed = F.col("ok") == 0
    status = F.when(F.col("status") != "waiting", F.col("status")).when(F.col("ok") == 1, "done").when(failed & (F.col("attempts") >= MAX_ATTEMPTS), "abandoned").otherwise(F.col("status"))
    return out.withColumn("status", status).withColumn("ready_at", F.when(failed, F.lit(None).cast("timestamp")).otherwise(F.col("ready_at"))).drop("ok").select(*urls.columns)


def pace(hosts: DataFrame, delays: DataFrame, now: Column) -> DataFrame:
    """Sets hosts' delays (seconds; below zero is zero); a host cools at least that long from now."""
    new = delays.groupBy("host").agg(F.max(F.greatest("delay", F.lit(0.0))).alias("new"))
    joined = hosts.join(new, "host", "full")
    return joined.select("host", F.when(F.col("new").isNull(), F.col("next_at")).otherwise(F.greatest(F.coalesce("next_at", now), later(now, F.col("new")))).alias("next_at"), F.coalesce("new", "delay").alias("delay"))


def census(urls: DataFrame) -> DataFrame:
    """Waiting URLs and their hosts."""
    return urls.where("status = 'waiting'").agg(F.count("*").alias("waiting"), F.countDistinct("host").alias("hosts"))
