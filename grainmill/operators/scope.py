"""Which URLs a crawl may take: domains, included and excluded patterns, depth, verdicts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls


@dataclass(frozen=True)
class Scope:
    """Excluded wins, then domains, then included; an empty scope allows all."""

    domains: tuple[str, ...] = ()
    included: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()

    def __post_init__(self):
        for p in (*self.included, *self.excluded):
            if "[" in p or "]" in p:
                raise ValueError(f"scope pattern {p!r}: brackets are not part of patterns; use * and ?")


def matches(pattern: str, url: Column, host: Column) -> Column:
    """A pattern with * (any characters, slashes too) or ? (one) matches the whole URL or host; one without is a URL's beginning or a host."""
    if "*" in pattern or "?" in pattern:
        regex = "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"
        return url.rlike(regex) | host.rlike(regex)
    return url.startswith(pattern) | (host == pattern)


def in_domain(domain: str, host: Column) -> Column:
    d = domain.lower().removeprefix("*.")
    return (host == d) | host.endswith("." + d)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def allows(scope: Scope, url: Column) -> Column:
    host = urls.without_port(urls.host(url))
    out = ~_any([matches(p, url, host) for p in scope.excluded])
    if scope.domains:
        out = out & _any([in_domain(d, host) for d in scope.domains])
    if scope.included:
        out = out & _any([matches(p, url, host) for p in scope.included])
    return F.coalesce(out, F.lit(False))


def verdicts(requests: DataFrame, scope: Scope, max_depth: int = 5, options: urls.UrlOptions = urls.UrlOptions()) -> DataFrame:
    """Adds `canonical` and `verdict`: ok, or why a request is dropped."""
    canonical = urls.normalise(F.col("url"), options)
    reason = F.when(F.col("canonical").isNull(), "unfetchable").when(F.col("depth") > (max_depth or 5), "too deep").when(~allows(scope, F.col("canonical")), "out of scope").otherwise("ok")
    return requests.withColumn("canonical", canonical).withColumn("verdict", reason)
