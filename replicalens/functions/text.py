"""Column functions over names, tag strings, units and config maps."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from replicalens.schemas import OFFSETS_TOPIC

# Fixed config key names of the brokers' replication throttles.
LEADERS_KEY = "leader.replication.throttled.replicas"
FOLLOWERS_KEY = "follower.replication.throttled.replicas"
LEADER_RATE_KEY = "leader.replication.throttled.rate"
FOLLOWER_RATE_KEY = "follower.replication.throttled.rate"

_PLAIN_NAME = re.compile(r"[A-Za-z0-9_-]+")
_NAME_LIKE = re.compile(r"[A-Za-z0-9_\\-]+")


def name_matches(name: Column, patterns: Iterable[str]) -> Column:
    """True if any entry matches. Plain names compare by equality, so they reach the scan as an IN
    filter; name-like entries with a backslash are anchored; anything else is searched unanchored."""
    plain: list[str] = []
    tests: list[Column] = []
    for p in patterns:
        if _PLAIN_NAME.fullmatch(p):
            plain.append(p)
        elif _NAME_LIKE.fullmatch(p):
            tests.append(name.rlike(f"^{p}$"))
        else:
            tests.append(name.rlike(p))
    if plain:
        tests.insert(0, name.isin(plain))
    out = F.lit(False)
    for i, t in enumerate(tests):
        out = t if i == 0 else out | t
    return out


def tag_value(scope: Column, key: str) -> Column:
    """Value of the first ``key:value`` entry of a comma list, text between first and second colon; '' if absent."""
    entry = F.filter(F.split(scope, ","), lambda x: x.startswith(f"{key}:"))
    return F.coalesce(F.split(F.get(entry, F.lit(0)), ":")[1], F.lit(""))


def parse_tags(entries: Column) -> Column:
    """List of ``key:value`` to a map, the last duplicate winning; null if any entry has not exactly two parts."""
    pairs = F.transform(entries, lambda x: F.split(x, ":"))
    last = F.filter(pairs, lambda p, i: ~F.exists(
        F.slice(pairs, i + 2, F.size(pairs)), lambda q: q[0] == p[0]))
    ok = ~F.exists(pairs, lambda p: F.size(p) != 2)
    return F.when(ok, F.map_from_entries(F.transform(last, lambda p: F.struct(p[0], p[1]))))


def format_tags(tags: Column) -> Column:
    """Map to a sorted list of ``key:value``."""
    return F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat_ws(":", e["key"], e["value"])))


def tags_equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_entries(a)) == F.array_sort(F.map_entries(b))


def merge_tags(base: Column, winning: Column) -> Column:
    """Union of two maps; ``winning`` overrides shared keys."""
    return F.map_zip_with(base, winning, lambda _k, a, b: F.coalesce(b, a))


def tags_match(tags: Column, wanted: dict[str, str]) -> Column:
    """Every wanted key has the wanted value; a missing key counts as ''."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & (F.coalesce(F.element_at(tags, k), F.lit("")) == v)
    return out


def without_keys(tags: Column, keys: Iterable[str]) -> Column:
    keys = list(keys)
    return F.map_filter(tags, lambda k, _v: ~k.isin(keys))


def only_keys(tags: Column, keys: Iterable[str]) -> Column:
    keys = list(keys)
    return F.map_filter(tags, lambda k, _v: k.isin(keys))


def throttled_entry(partition_id: Column, broker_id: Column) -> Column:
    return F.concat_ws(":", partition_id.cast("string"), broker_id.cast("string"))


def offsets_topic(topic: Column) -> Column:
    """Metric stores drop a leading underscore of the offsets topic; restore it."""
    return F.when(topic == OFFSETS_TOPIC[1:], OFFSETS_TOPIC).otherwise(topic)


def bytes_to_mib(c: Column) -> Column:
    return c / (1 << 20)


def bytes_to_gib(c: Column) -> Column:
    return c / (1 << 30)


def mib_to_bytes(c: Column) -> Column:
    return (c * (1 << 20)).cast("bigint")


def mb_rate_to_bytes(c: Column) -> Column:
    return F.round(c * 1000000).cast("bigint")


def with_topic_throttle(config: Column) -> Column:
    """Throttle every replica of a topic."""
    add = F.create_map(F.lit(LEADERS_KEY), F.lit("*"), F.lit(FOLLOWERS_KEY), F.lit("*"))
    return merge_tags(config, add)


def with_broker_throttle(config: Column, outbound: Column, inbound: Column) -> Column:
    """Set the rates of a broker; a zero rate means unset and adds no key."""
    add = F.map_filter(
        F.create_map(F.lit(LEADER_RATE_KEY), F.coalesce(outbound, F.lit(0)).cast("string"),
                     F.lit(FOLLOWER_RATE_KEY), F.coalesce(inbound, F.lit(0)).cast("string")),
        lambda _k, v: v != "0")
    return merge_tags(F.coalesce(config, F.create_map().cast("map<string,string>")), add)


def has_any_key(config: Column, keys: Iterable[str]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.map_contains_key(config, k)
    return out
