"""Scalar text functions: white space, tokens, evidence, dates, names, identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import trimmed


def collapse(text: Column) -> Column:
    """Runs of white space (any Unicode) as one space, none at the ends."""
    return trimmed(F.regexp_replace(text, r"(?U)\s+", " "))


def blank(text: Column) -> Column:
    return F.coalesce(trimmed(text), F.lit("")) == ""


_TOKEN = r"[\p{L}\p{Nd}]{2,}"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, those of one character dropped."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), 0)


def has_tokens(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(_TOKEN)


def counted(tokens: Column) -> Column:
    """Distinct tokens with their counts (term, n), in order, within the row; a list bound by a lambda is computed once."""

    def ends(ordered: Column) -> Column:
        last = lambda x, i: F.when(~F.get(ordered, i + 1).eqNullSafe(x), F.struct(x.alias("term"), (i + 1).cast("long").alias("to")))
        return F.filter(F.transform(ordered, last), lambda x: x.isNotNull())

    def runs(found: Column) -> Column:
        return F.transform(found, lambda x, i: F.struct(x["term"].alias("term"), (x["to"] - F.coalesce(F.get(found, i - 1)["to"], F.lit(0))).alias("n")))

    return F.transform(F.transform(F.array(F.sort_array(tokens)), ends), runs)[0]


def saturate(n: Column) -> Column:
    """1 - e^-n; nothing for none: repeats add less and less."""
    return F.when(n > 0, 1 - F.exp(-n.cast("double"))).otherwise(0.0)


def clamp(x: Column) -> Column:
    return F.least(F.greatest(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def is_number(text: Column) -> Column:
    """Whether text is a decimal number as written by people and machines (no type suffixes, no hex)."""
    return text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf(inity)?|nan)$")


def number(text: Column) -> Column:
    return F.when(is_number(text), text.try_cast("double"))


_NO_ZONE = r"^\d{4}-\d\d-\d\d"


def parse_date(text: Column) -> Column:
    """A date in any of the usual shapes as RFC 3339 in UTC; what can't be read stays as it is. Day before month where both are possible."""
    v = trimmed(text)
    bare = F.regexp_replace(v, r"(?<=:\d\d)[.,]\d+", "")
    undated = F.regexp_replace(bare, r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), ", "")
    zoned = F.regexp_replace(undated, r" (?!UTC|GMT)([A-Z]{3,4})$", " UTC")
    shapes = [  # what a text must look like, the text to read, the pattern to read it by
        (_NO_ZONE + r"T\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$", bare, "yyyy-MM-dd'T'HH:mm:ssXXX"),
        (_NO_ZONE + r"T\d\d:\d\d:\d\d$", bare, "yyyy-MM-dd'T'HH:mm:ss"),
        (_NO_ZONE + r" \d\d:\d\d:\d\d$", bare, "yyyy-MM-dd HH:mm:ss"),
        (_NO_ZONE + r"T\d\d:\d\d$", bare, "yyyy-MM-dd'T'HH:mm"),
        (_NO_ZONE + "$", bare, "yyyy-MM-dd"),
        (r"^\d{4}/\d\d/\d\d$", bare, "yyyy/MM/dd"),
        (r"^\d\d/\d\d/\d{4}$", bare, "dd/MM/yyyy"),
        (r"^\d\d/\d\d/\d{4}$", bare, "MM/dd/yyyy"),
        (r"^\d\d [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d [+-]\d{4}$", undated, "dd MMM yyyy HH:mm:ss xx"),
        (r"^\d\d [A-Za-z]{3} \d{4} \d\d:\d\d:\d\d [A-Z]{3,4}$", zoned, "dd MMM yyyy HH:mm:ss zzz"),
        (r"^\d\d [A-Za-z]{3} \d\d \d\d:\d\d [+-]\d{4}$", bare, "dd MMM yy HH:mm xx"),
        (r"^\d\d [A-Za-z]{3} \d\d \d\d:\d\d [A-Z]{3,4}$", zoned, "dd MMM yy HH:mm zzz"),
        (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", bare, "d MMMM yyyy"),
        (r"^\d{1,2} [A-Za-z]{3} \d{4}$", bare, "d MMM yyyy"),
        (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", bare, "MMMM d, yyyy"),
        (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", bare, "MMM d, yyyy"),
        (r"^\d{8}$", bare, "yyyyMMdd"),
    ]
    found = F.coalesce(*[F.when(bare.rlike(s) | x.rlike(s), F.try_to_timestamp(x, F.lit(p))) for s, x, p in shapes])
    seconds = F.when(v.rlike(r"^\d{9,10}$"), v.try_cast("long"))
    found = F.coalesce(found, F.when((seconds > 631152000) & (seconds < 4102444800), F.timestamp_seconds(seconds)))
    return F.coalesce(rfc3339(found), text)


def rfc3339(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


TRANSFORMS = {"text": collapse, "normalise_space": collapse, "trim": trimmed, "lower": F.lower, "upper": F.upper, "datetime": parse_date}



def _short_hash(parts: list[Column], size: int) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", *parts).cast("binary"), 256), 1, size)


def entity_id(kind: Column, name: Column) -> Column:
    """A node's identity: its kind and its name, whatever their case and spacing."""
    return _short_hash([F.lower(trimmed(kind)), F.lower(collapse(name))], 24)


def relation_id(source: Column, target: Column, kind: Column, topic: Column) -> Column:
    return _short_hash([source, target, kind, topic], 24)


def event_id(name: Column, tags: Column, at: Column) -> Column:
    """An event's identity: its name, its tags by key, and its time in nanoseconds."""
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    nanos = (F.unix_micros(at) * 1000).cast("string")
    return F.substring(F.sha2(F.array_join(F.concat(F.array(name), pairs, F.array(nanos)), "\0").cast("binary"), 256), 1, 24)


def record_key(item: Column, url: Column, values: Column) -> Column:
    """A record's identity in a table: item, URL and every name and value by name."""
    pairs = F.flatten(F.transform(F.array_sort(F.map_entries(values)), lambda e: F.array(e["key"], e["value"])))
    return F.substring(F.sha2(F.array_join(F.concat(F.array(item, url), pairs), "\0").cast("binary"), 256), 1, 32)


def parse_name(name: Column) -> Column:
    """surname, letter and initial (whether the first name is a letter) of a name of two words or more; null for others."""
    words = F.split(F.lower(collapse(name)), " ")
    first = F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")
    return F.when((F.size(words) >= 2) & (first != ""), F.struct(F.element_at(words, -1).alias("surname"), F.substring(first, 1, 1).alias("letter"), (F.char_length(first) == 1).alias("initial")))


def subject_token(text: Column) -> Column:
    """Text as one token of a subject: separators, wildcards, white space and control characters become underscores."""
    return F.regexp_replace(text, r"[.*>\s\p{Cntrl}]", "_")
