"""What Spark sizes as before an explode must not be broadcast."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from replicalens.llm import simhash


def below(text: str, node: str) -> list[list[str]]:
    """The subtrees under every ``node`` of a plan's text."""
    lines = [(len(re.match(r"[\s:+*()\d-]*", x)[0]), x) for x in text.splitlines()]
    found = []
    for i, (depth, line) in enumerate(lines):
        if node in line:
            end = next((j for j in range(i + 1, len(lines)) if lines[j][0] <= depth), len(lines))
            found.append([x for _, x in lines[i + 1:end]])
    return found


def test_simhash_probes_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "fps")
    ids = spark.range(600).select(F.when(F.col("id") < 200, F.col("id") * 4294967296 + 7).otherwise(F.xxhash64("id")).alias("fp"))
    ids.write.parquet(path)
    links = simhash.links(spark.read.parquet(path), hot=64, block=50)
    text = links._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in text and "BroadcastExchange" in text
    for subtree in below(text, "BroadcastExchange"):
        assert not any("Generate" in line for line in subtree), "\n".join(subtree)
    rows = [r["fp"] & (1 << 64) - 1 for r in ids.collect()]
    near = [(a, b) for a in rows for b in rows if a < b and (a ^ b).bit_count() <= 2]
    least = {x: x for x in rows}
    for _ in rows:
        before = dict(least)
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    parts = {}
    for x in rows:
        parts.setdefault(least[x], set()).add(x)
    found = {}
    for node, label in simhash.components(links).collect():
        found.setdefault(label, set()).add(node & (1 << 64) - 1)
    assert sorted(map(sorted, found.values())) == sorted(sorted(p) for p in parts.values() if len(p) > 1)
