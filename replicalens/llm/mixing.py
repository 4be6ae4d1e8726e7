"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replicalens.llm.common import numbered, word_count
from replicalens.operators.windows import ranked
from replicalens.session import materialize


def cycle_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``sources`` with a weight each: ``weights`` in turn over the sources by code point, null last."""
    one = sources.withColumns({"__all": F.lit(0), "__null": F.col("source").isNull()})
    order = ranked(one, ["__all"], [F.col("__null"), F.col("source")], "__rank")
    values = F.array(*[F.lit(float(w)) for w in weights])
    return order.withColumn("weight", F.get(values, ((F.col("__rank") - 1) % len(weights)).cast("int"))).drop("__all", "__null", "__rank")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target`` words each.

    Shares of ``budget`` are proportional to weight. Sources above ``max_epochs`` times their size are clamped there and their
    excess is shared again by weight among the rest, until none is above. Each turn is one aggregate over the source
    table, and at least one source is clamped in it. If all are clamped, the budget can't be met and targets are the caps. Sources of
    size or weight 0 get 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    table = materialize(sources.withColumn("__cap", cap), "sources")
    level, before = 0.0, None  # words per unit of weight; it only rises
    while True:
        over = F.col("weight") * F.lit(level) > F.col("__cap")
        clamped, weight, n = table.agg(F.sum(F.when(over, F.col("__cap"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if not weight:
            break
        new = max(0.0, budget - (clamped or 0.0)) / weight
        if n == before:
            break
        level, before = new, n
    target = F.when(F.col("weight") * F.lit(level) > F.col("__cap"), F.col("__cap")).otherwise(F.col("weight") * F.lit(level))
    return table.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0)).drop("__cap")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0,
        seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source", size: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row.

    A source's target is a number of epochs over it. Each of its documents is taken as often as there are whole epochs; for the rest the documents
    are put in the order of md5(seed:doc_id), and those whose middle word lies within the rest are taken once more, so a source's taken
    words differ from its target by half a document at most. Running sums go over 4096 hash ranges per source, so a hot source is spread.
    Sizes are words unless ``size`` is given. Null text has size 0 and is never taken; a null source is one source; null
    ids order by an empty id; repeated rows are documents of their own. An empty table gives no rows.
    """
    count = word_count(F.col(text)) if size is None else size
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), count.cast("bigint").alias("size"), order.alias("__h"))
    rows = materialize(rows.withColumns({"__b": F.substring("__h", 1, 3), "__s": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))}), "mix-rows")
    sources = rows.groupBy("__s", "source").agg(F.sum("size").alias("source_size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    plan = materialize(water_fill(cycle_weights(sources, weights), total * share, max_epochs), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.select("__s", "source_size", "target", F.floor(epochs).alias("__whole"))
    summed = numbered(rows, ["__s"], "__b", [F.col("__h"), F.col("size")], {"__before": "size"})
    rest = F.col("target") - F.col("__whole") * F.col("source_size")
    more = (F.col("size") > 0) & (F.col("__before") + F.col("size") / 2 <= rest)
    out = summed.join(plan, "__s").withColumn("copies", F.when(F.col("size") > 0, F.col("__whole") + more.cast("int")).otherwise(0).cast("bigint"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``mix`` takes its document.

    Rows of one doc_id share that id's copies: with ids repeated, their sum is spread as evenly as whole numbers allow. Columns may have any names.
    """
    taken = mix(docs, doc_id=doc_id, text=text, **options)
    per_id = taken.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("origin"), F.col("size").alias("words")).agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    words = word_count(F.col(text)) if options.get("size") is None else options["size"].cast("bigint")
    marked = docs.select(F.col(doc_id).alias("own"), F.col(options.get("source", "source")).alias("from"), words.alias("size"), F.xxhash64(text).alias("h"),
                         F.struct(*docs.columns).alias("row"))
    found = marked.join(per_id, F.col("own").eqNullSafe(F.col("id")) & F.col("from").eqNullSafe(F.col("origin")) & (F.col("size") == F.col("words")))
    several = Window.partitionBy("id", "origin", "words").orderBy("h")
    number = F.when(F.col("rows") > 1, F.row_number().over(several)).otherwise(1)
    each = F.floor(F.col("copies") / F.col("rows")) + (number <= F.col("copies") % F.col("rows")).cast("int")
    times = found.withColumn("times", each.cast("int")).filter("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
