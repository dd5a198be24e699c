"""robots.txt as tables: parsed rules, the agent's group, and a gate for requests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls

MAX_SIZE = 500 * 1024


def rules(files: DataFrame) -> DataFrame:
    """origin, body -> origin, agent, allow, pattern, delay: a row for each agent and line of its groups. Groups of one agent are one."""
    text = F.regexp_replace(F.substring(F.coalesce("body", F.lit("")), 1, MAX_SIZE), "^﻿", "")
    line = lambda x: F.struct(F.lower(T.trimmed(F.regexp_extract(x, "^([^:]*):", 1))).alias("key"), T.trimmed(F.regexp_extract(F.regexp_replace(x, "#.*$", ""), "^[^:]*:(.*)$", 1)).alias("value"))
    known = lambda x: x["key"].isin("user-agent", "allow", "disallow", "crawl-delay")
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: line(x)), known)
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("open"), F.array().cast("array<struct<agent:string,key:string,value:string>>").alias("out"))
    emit = lambda agents, x: F.transform(agents, lambda a: F.struct(a.alias("agent"), x["key"].alias("key"), x["value"].alias("value")))

    def step(acc: Column, x: Column) -> Column:
        agent = F.array(F.lower(F.when(x["value"] == "*", "*").otherwise(F.regexp_extract(x["value"], "^([A-Za-z_-]*)", 1))))
        named = F.when(acc["open"], F.concat(acc["agents"], agent)).otherwise(agent)
        is_agent = x["key"] == "user-agent"
        marker = F.transform(agent, lambda a: F.struct(a.alias("agent"), F.lit("group").alias("key"), F.lit("").alias("value")))
        return F.struct(F.when(is_agent, named).otherwise(acc["agents"]).alias("agents"), is_agent.alias("open"), F.concat(acc["out"], F.when(is_agent, marker).otherwise(emit(acc["agents"], x))).alias("out"))

    found = files.select("origin", F.explode(F.aggregate(lines, start, step)["out"]).alias("r"))
    rule = F.col("r.key").isin("allow", "disallow") & (F.col("r.value") != "")
    return found.select("origin", F.col("r.agent").alias("agent"), F.when(rule, F.col("r.key") == "allow").alias("allow"), F.when(rule, F.col("r.value")).alias("pattern"), F.when(F.col("r.key") == "crawl-delay", F.col("r.value").try_cast("double")).alias("delay"))


def group(parsed: DataFrame, agent: str) -> DataFrame:
    """The rules of each origin that hold for the agent: those under its name, else under the longest beginning of it, else under *."""
    a = token(agent)
    fit = F.when(F.col("agent") == a, 1_000_000).when(F.col("agent") == "*", 0).when(F.lit(a).startswith(F.col("agent")) & (F.col("agent") != ""), F.length("agent"))
    ranked = parsed.withColumn("fit", fit).where("fit is not null")
    best = ranked.groupBy(F.col("origin").alias("o")).agg(F.max("fit").alias("best"))
    return ranked.join(best, (F.col("origin") == F.col("o")) & (F.col("fit") == F.col("best"))).select("origin", "allow", "pattern", "delay")


def pattern_regex(pattern: Column) -> Column:
    """* is anything, a last $ the end; all else as it stands, from the beginning."""
    quoted = F.regexp_replace(F.regexp_replace(urls.encode_path(pattern), r"[\\^$.|?+()\[\]{}]", r"\\$0"), r"\*", ".*")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(quoted, r"\\\$$", r"\$"))


def token(agent: str) -> str:
    """The product token of a user agent, as robots files name it."""
    found = re.match(r"[A-Za-z_-]+", agent.strip())
    if not found:
        raise ValueError(f"no product token in {agent!r}")
    return found[0].lower()


def prepared(files: DataFrame, agent: str) -> DataFrame:
    """origin, status, rules, delay: what each origin says to the agent. files: origin, status, body; of 2xx the body is parsed."""
    held = group(rules(files.where("status between 200 and 299")), agent)
    rule = F.struct(F.length("pattern").alias("n"), F.col("allow").cast("int").alias("allow"), pattern_regex(F.col("pattern")).alias("regex"))
    said = held.groupBy("origin").agg(F.collect_list(F.when(F.col("pattern").isNotNull(), rule)).alias("rules"), F.max("delay").alias("delay"))  # of one file, 500 KiB at most
    return files.select("origin", "status").join(said, "origin", "left")


def delays(ready: DataFrame, requests: DataFrame) -> DataFrame:
    """host, delay: what the hosts of these requests ask for between two requests."""
    asked = requests.select("host", F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1).alias("o")).distinct()
    return asked.join(ready.where("delay is not null"), F.col("o") == F.col("origin")).select("host", "delay")


def gate(requests: DataFrame, files: DataFrame, agent: str) -> DataFrame:
    """Adds `robots`: allowed, denied, or unreadable (dropped too). files: origin, status, body, or what `prepared` makes of them; 2xx is parsed, 4xx allows all, anything else is unreadable. The longest pattern decides, allow on ties."""
    ready = (files if "rules" in files.columns else prepared(files, agent)).select(F.col("origin").alias("__o"), F.col("status").alias("__status"), F.col("rules").alias("__rules"))
    rows = requests.withColumn("__origin", F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)).withColumn("__path", F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^#]*)", 1), "^$", "/"))
    out = rows.join(ready, F.col("__origin") == F.col("__o"), "left")
    best = F.array_max(F.expr("transform(filter(__rules, r -> __path rlike r.regex), r -> struct(r.n, r.allow))"))
    readable = F.col("__status").between(200, 299) | F.col("__status").between(400, 499)
    word = F.when(~F.coalesce(readable, F.lit(False)), "unreadable").when(F.coalesce(best["allow"], F.lit(1)) == 1, "allowed").otherwise("denied")
    return out.withColumn("robots", word).select(*requests.columns, "robots")
