"""Repair placement: good replicas stay in their position, open slots are filled under the constraints.

One pass, no rounds: every partition takes racks next to an evenly spread starting point on its cluster's
rack line, skipping racks it already uses, so all its open slots get different racks at once. Inside a
rack, slots are laid on a line of the brokers' remaining capacity. Brokers without rack, and rack reuse,
go through a ring of brokers: among as many neighbours as the set has members plus one, one is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from replicalens.functions.arrays import to_partition_map
from replicalens.operators.windows import top_k
from replicalens.plans.lines import hash_bucket, locate, prefix_sums
from replicalens.schemas import PARTITION_KEY
from replicalens.session import materialize

_NO_BROKER = "No additional brokers that meet constraints"


def _pools(state: DataFrame, strategy: str, open_slots: DataFrame) -> DataFrame:
    """Candidate brokers with their weight: free storage, or how far they are below the mean use after repair."""
    live = state.filter("not is_replace and not is_missing").withColumn("rack", F.coalesce("rack", F.lit("")))
    if strategy == "storage":
        room = live.join(open_slots, "cluster_id").filter(F.col("storage_free") >= F.col("least"))
        return room.select("cluster_id", "broker_id", "rack", F.col("storage_free").cast("bigint").alias("w"))
    mean = live.groupBy("cluster_id").agg(F.sum("used").alias("u"), F.count(F.lit(1)).alias("b")).join(
        open_slots, "cluster_id", "left").select(
        "cluster_id", F.ceil((F.col("u") + F.coalesce("slots", F.lit(0))) / F.col("b")).alias("level"))
    return live.join(mean, "cluster_id").select(
        "cluster_id", "broker_id", "rack",
        (F.greatest(F.col("level") - F.col("used"), F.lit(0)) * 1000 + 1).cast("bigint").alias("w"))


def _rank_pool(df: DataFrame, group: list[str], member: str, sums: dict) -> DataFrame:
    h = F.md5(F.col(member).cast("string"))
    fixed = materialize(df.withColumn("mh", h).withColumn("mb", hash_bucket(h, 2)), "repair-pool")
    return prefix_sums(fixed, group, ["mb"], ["mh", member], sums)


def repair(partition_map: DataFrame, state: DataFrame, *, strategy: str = "count", sizes: DataFrame | None = None,
           size_factor: float = 1.0, min_racks: int = 0) -> tuple[DataFrame, DataFrame]:
    """(replica rows of the repaired map, error rows per slot that cannot be filled).

    Open slots are null ids, and brokers that are replaced, missing or unknown to ``state``. Storage mode
    lays slots out by size and keeps, per broker, only what fits its free storage; slots turned away are
    laid out again over what is left, until a pass places none of them. The rest goes through ``fill``, so an
    error means that no allowed broker holds the slot.
    """
    if strategy not in ("count", "storage"):
        raise ValueError(f"unknown repair strategy: {strategy}")
    if strategy == "count":
        kept, new, errors, _away = _pass(partition_map, state, strategy, None, size_factor, min_racks)
        return kept.unionByName(new), errors
    if sizes is None:
        raise ValueError("storage placement needs partition sizes")
    kept, new, errors, away = _pass(partition_map, state, strategy, sizes, size_factor, min_racks)
    done = kept.unionByName(new)
    while not away.isEmpty():
        # Only the partitions with turned-away slots go round again, against the storage still free.
        z = sizes.select(*PARTITION_KEY, F.ceil(F.col("size_bytes") * F.lit(size_factor)).cast("bigint").alias("z"))
        spent = new.join(z, PARTITION_KEY).groupBy("cluster_id", "broker_id").agg(F.sum("z").alias("spent"))
        state = materialize(state.join(spent, ["cluster_id", "broker_id"], "left").withColumn(
            "storage_free", F.col("storage_free") - F.coalesce("spent", F.lit(0))).drop("spent"), "repair-state")
        again = done.unionByName(errors.select(*PARTITION_KEY, "idx", F.lit(None).cast("bigint").alias("broker_id"))).join(
            errors.select(*PARTITION_KEY).distinct(), PARTITION_KEY, "left_semi")
        _kept, new, errors, away = _pass(to_partition_map(again), state, strategy, sizes, size_factor, min_racks)
        if new.isEmpty():
            break
        done = done.unionByName(new)
    # What the passes could not lay out is dealt to brokers that can hold it, so that no error is left where one could.
    unsized = errors.filter(F.col("error") != _NO_BROKER)
    z = sizes.select(*PARTITION_KEY, F.greatest(F.ceil(F.col("size_bytes") * F.lit(size_factor)), F.lit(1)).cast("bigint").alias("z"))
    h = F.md5(F.concat_ws(":", "topic", F.col("partition_id").cast("string")))
    left = errors.filter(F.col("error") == _NO_BROKER).join(z, PARTITION_KEY).select(
        *PARTITION_KEY, "idx", "z", h.alias("h")).withColumn("hb", hash_bucket(F.col("h")))
    spent = new.join(z, PARTITION_KEY).groupBy("cluster_id", "broker_id").agg(F.sum("z").alias("spent"))
    room = state.filter("not is_replace and not is_missing").join(spent, ["cluster_id", "broker_id"], "left").select(
        "cluster_id", "broker_id", "rack", (F.col("storage_free") - F.coalesce("spent", F.lit(0))).cast("bigint").alias("free"))
    more, still = fill(done, left, room, min_racks)
    return done.unionByName(more), still.select(*PARTITION_KEY, "idx", F.lit(_NO_BROKER).alias("error")).unionByName(unsized)


def within_room(placed: DataFrame, room: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``placed`` (.., idx, broker_id, z, h, hb) into rows that fit their broker's ``free`` storage together, in md5 order, and the rest.

    Only the rows of brokers that cannot hold all of theirs are put in order. ``placed`` is read several times, so pass a materialized table.
    """
    key = ["cluster_id", "broker_id"]
    room = room.select(*key, "free")
    one = room.groupBy(*key).agg(F.min("free").alias("free"), F.count(F.lit(1)).alias("n"))
    tight = placed.groupBy(*key).agg(F.sum("z").alias("load")).join(one, key, "left").filter("free is null or n > 1 or load > free")
    tight = materialize(tight.select(*key), "room-tight")
    ample = placed.filter("cluster_id is not null and broker_id is not null")
    if tight.isEmpty():
        return ample, ample.limit(0)
    laid = prefix_sums(placed.join(tight, key, "left_semi"), key, ["hb"], ["h", "topic", "partition_id", "idx"], {"before": F.col("z")}).join(room, key, "left")
    laid = laid.select(*placed.columns, F.coalesce(F.col("before") + F.col("z") <= F.col("free"), F.lit(False)).alias("fits"))
    laid = materialize(laid.unionByName(ample.join(tight, key, "left_anti").withColumn("fits", F.lit(True))), "within-room")
    return laid.filter("fits").select(*placed.columns), laid.filter("not fits").select(*placed.columns)


def _size_class(c: str) -> Column:
    """Quarters of the doublings of a positive size, rising with it."""
    return F.expr(f"cast(4 * length(bin({c})) + (shiftright({c}, greatest(length(bin({c})) - 3, 0)) & 3) as int)")


def _seats(room: DataFrame, min_racks: int, scales: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """Where ``fill`` draws from: (numbered brokers, one row per cluster and kind with the numbers' limits and the freest groups).

    On scale s a group shows its 16^s freest brokers, so the first scale shows one broker of every group and the last one shows all. Brokers
    are numbered from 0 per scale by falling size class, and ``limits[s][c]`` is the count of those of class c or more.
    """
    own = F.concat(F.lit("#"), F.col("broker_id").cast("string"))
    usable = room.filter("free > 0")
    pool = usable.withColumns({"kind": F.lit("apart"), "grp": F.when(F.col("rack") == "", own).otherwise(F.col("rack"))})
    if min_racks > 0:
        pool = pool.unionByName(usable.withColumns({"kind": F.lit("any"), "grp": own}))
    mixed = F.lpad(F.pmod(F.xxhash64("broker_id"), F.lit(100)).cast("string"), 2, "0")
    pool = materialize(pool.withColumn("class", _size_class("free")).withColumn(
        "late", F.concat(F.lpad((255 - F.col("class")).cast("string"), 3, "0"), mixed)), "fill-pool")
    line, group = ["cluster_id", "kind"], ["cluster_id", "kind", "grp"]
    inside = prefix_sums(pool, group, ["late"], ["broker_id"], {"place": F.lit(1)})
    shown = materialize(inside.withColumn("scale", F.explode(F.expr(
        f"sequence(least({scales}, cast(ceil(log(16, place + 1)) as int)), {scales})"))).drop("place"), "fill-shown")
    seats = prefix_sums(shown, [*line, "scale"], ["late"], ["broker_id"], {"number": F.lit(1)}).drop("late", "class")
    counts = shown.groupBy(*line, "scale", "class").agg(F.count(F.lit(1)).alias("n"))
    limits = counts.groupBy(*line, "scale").agg(F.collect_list(F.struct("class", "n")).alias("c")).groupBy(*line).agg(F.map_from_entries(F.collect_list(
        F.struct("scale", F.expr("transform(sequence(0, 255), i -> aggregate(filter(c, x -> x.class >= i), 0L, (a, x) -> a + x.n))")))).alias("limits"))
    freest = pool.groupBy(*group).agg(F.max(F.struct("free", "broker_id", "rack")).alias("b")).select(*group, "b.*")
    top = top_k(freest, line, [F.col("free").desc(), F.col("grp")], reach, "place")
    offers = top.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct("place", "grp", "free", "broker_id", "rack"))).alias("offers"))
    return seats, materialize(limits.join(offers, line), "fill-limits")


def fill(held: DataFrame, left: DataFrame, room: DataFrame, min_racks: int = 0) -> tuple[DataFrame, DataFrame]:
    """Place open slots ``left`` (.., idx, z, h, hb) on brokers with ``free`` storage of at least z until no slot has such a broker.

    Returns (new replica rows, slots still open). ``held`` are the replica rows there are. A round takes one slot of each partition, which asks
    a broker of an allowed group: a rack the list does not use, a broker without rack, or any broker once ``min_racks`` racks are present. It
    draws some among all brokers of its size or more, and takes the first allowed one. If none is, it asks one of the freest groups: a list
    rules out no more groups than it is long, so that many groups and one, with the freest brokers first, always hold an allowed one. Each broker
    accepts what fits together, the largest first, one slot at least. Storage only shrinks and lists only grow, so a slot that finds no
    broker is not asked for again. As brokers of all groups are asked in each round, the rounds do not grow with their number.
    """
    own = F.concat(F.lit("#"), F.col("broker_id").cast("string"))
    none = F.array().cast("array<string>")
    room = materialize(room.withColumn("rack", F.coalesce("rack", F.lit(""))), "fill-room")
    left = materialize(left, "fill-left")
    racks = room.select("cluster_id", "broker_id", "rack")
    sets = held.select(*PARTITION_KEY, "broker_id").filter("broker_id is not null").join(
        left.select(*PARTITION_KEY).distinct(), PARTITION_KEY, "left_semi").join(racks, ["cluster_id", "broker_id"], "left").groupBy(*PARTITION_KEY).agg(
        F.collect_set(own).alias("ids"), F.collect_set(F.when(F.col("rack") != "", F.col("rack"))).alias("racks"))
    work = left.groupBy(*PARTITION_KEY, "idx").agg(F.min("z").alias("z")).groupBy(*PARTITION_KEY).agg(
        F.array_sort(F.collect_list(F.struct("idx", "z"))).alias("open")).join(sets, PARTITION_KEY, "left")
    work = materialize(work.withColumns({"ids": F.coalesce("ids", none), "racks": F.coalesce("racks", none)}), "fill-work")
    new = left.select(*PARTITION_KEY, "idx", F.lit(None).cast("bigint").alias("broker_id")).limit(0)
    reach = work.agg(F.max(F.size("ids") + F.size("open"))).first()[0]
    if reach is None:
        return new, left
    most = room.filter("rack <> ''").groupBy("cluster_id", "rack").count().agg(F.max("count")).first()[0] or 1
    scales = next(s for s in range(17) if 16 ** s >= most)
    turn, asking = 0, True
    while asking:
        seats, limits = _seats(room, min_racks, scales, reach)
        kind = F.when((F.lit(min_racks) > 0) & (F.size("racks") >= min_racks), "any").otherwise("apart")
        asks = work.withColumn("kind", kind).withColumns({
            "idx": F.expr("open[0].idx"), "z": F.expr("open[0].z"), "used": F.array_union("ids", F.when(F.col("kind") == "any", none).otherwise(F.col("racks")))})
        asks = asks.withColumn("class", _size_class("z")).join(limits, ["cluster_id", "kind"])
        asks = asks.withColumn("offers", F.expr("filter(offers, x -> x.free >= z and not array_contains(used, x.grp))")).filter("size(offers) > 0")
        hashed = lambda what: F.xxhash64(*PARTITION_KEY, "idx", F.lit(f"{what}{turn}"))  # noqa: E731  (text is no part of generated code, which rounds share)
        # Two draws among all brokers, two on any scale, for lists whose groups have most of the brokers.
        scale = [F.lit(scales), F.lit(scales), *[F.pmod(hashed(f"scale{i}:"), F.lit(scales + 1)).cast("int") for i in range(2)]]
        draws = F.array(*[F.struct(F.lit(i).alias("draw"), s.alias("scale"), F.pmod(hashed(f"draw{i}:"), F.col("limits")[s][F.col("class")]).alias("number"))
                          for i, s in enumerate(scale)])
        drawn = asks.select(*PARTITION_KEY, "kind", "z", "used", F.explode(draws).alias("d")).select("*", "d.*").drop("d").join(
            seats, ["cluster_id", "kind", "scale", "number"]).filter("free >= z and not array_contains(used, grp)")
        drawn = drawn.groupBy(*PARTITION_KEY).agg(F.min(F.struct("draw", "broker_id", "rack")).alias("pick"))
        offer = F.col("offers")[F.pmod(hashed("offer:"), F.size("offers")).cast("int")]
        pick = lambda c: F.coalesce(F.col(f"pick.{c}"), offer[c]).alias(c)
        h = F.hex(hashed("order:"))
        chosen = asks.join(drawn, PARTITION_KEY, "left").select(
            *PARTITION_KEY, "open", "ids", "racks", "idx", "z", pick("broker_id"), pick("rack"), h.alias("h"),
            F.concat(F.lpad((255 - F.col("class")).cast("string"), 3, "0"), hash_bucket(h, 2)).alias("hb"))
        chosen = materialize(chosen, "fill-chosen")
        asking = not chosen.isEmpty()
        if asking:
            fits, away = within_room(chosen, room)
            new = new.unionByName(fits.select(*PARTITION_KEY, "idx", "broker_id"))
            grown = fits.withColumns({"open": F.expr("slice(open, 2, size(open))"), "ids": F.array_union("ids", F.array(own)),
                                      "racks": F.when(F.col("rack") == "", F.col("racks")).otherwise(F.array_union("racks", F.array("rack")))})
            work = grown.filter("size(open) > 0").unionByName(away).select(*PARTITION_KEY, "open", "ids", "racks")
            spent = fits.groupBy("cluster_id", "broker_id").agg(F.sum("z").alias("spent"))
            room = materialize(room.join(spent, ["cluster_id", "broker_id"], "left").select(
                "cluster_id", "broker_id", "rack", (F.col("free") - F.coalesce("spent", F.lit(0))).alias("free")), "fill-room")
            turn += 1
    return new, left.join(new, [*PARTITION_KEY, "idx"], "left_anti")


def _pass(partition_map: DataFrame, state: DataFrame, strategy: str, sizes: DataFrame | None, size_factor: float,
          min_racks: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """One placement of all open slots: (kept rows, new rows, slots left open, slots turned away for storage)."""
    good = state.filter("not is_replace and not is_missing").select(
        "cluster_id", F.col("broker_id").alias("b"), F.coalesce("rack", F.lit("")).alias("brack"), F.lit(True).alias("keep"))
    slots = partition_map.select(*PARTITION_KEY, F.posexplode("replicas").alias("idx", "b")).join(
        good, ["cluster_id", "b"], "left")
    slots = materialize(slots.withColumn("keep", F.coalesce("keep", F.lit(False))), "repair-slots")
    kept = slots.filter("keep").select(*PARTITION_KEY, "idx", F.col("b").alias("broker_id"))

    # One row per partition with open slots; lists are bounded by the replication factor.
    h = F.md5(F.concat_ws(":", "topic", F.col("partition_id").cast("string")))
    work = slots.groupBy(*PARTITION_KEY).agg(F.collect_list(F.struct("idx", "b", "brack", "keep")).alias("s")).filter("exists(s, x -> not x.keep)").select(
        *PARTITION_KEY, F.expr("array_sort(transform(filter(s, x -> not x.keep), x -> x.idx))").alias("open"),
        F.expr("transform(filter(s, x -> x.keep), x -> x.b)").alias("ids"),
        F.expr("array_distinct(transform(filter(s, x -> x.keep and x.brack <> ''), x -> x.brack))").alias("racks"),
        F.expr("cast(size(filter(s, x -> x.keep and x.brack = '')) as bigint)").alias("unracked"))
    if strategy == "storage":
        z = F.greatest(F.ceil(F.col("size_bytes") * F.lit(size_factor)), F.lit(1)).cast("bigint")
        work = work.join(sizes.select(*PARTITION_KEY, "size_bytes"), PARTITION_KEY, "left").withColumn(
            "z", F.when(F.col("size_bytes").isNotNull(), z)).drop("size_bytes")
    else:
        work = work.withColumn("z", F.lit(1).cast("bigint"))
    work = materialize(work.withColumn("h", h).withColumn("hb", hash_bucket(h)), "repair-work")
    unsized = work.filter("z is null").select(
        *PARTITION_KEY, F.explode("open").alias("idx"), F.lit("partition size not found").alias("error"))
    work = work.filter("z is not null")
    totals = work.groupBy("cluster_id").agg(
        F.sum(F.size("open")).alias("slots"), F.count(F.lit(1)).alias("n"), F.min("z").alias("least"))
    pool = materialize(_pools(state, strategy, totals.select("cluster_id", "slots", "least")), "repair-brokers")

    # Rack ring: rank and weight segment of every rack, the unracked brokers being one entry ''.
    racks = _rank_pool(pool.groupBy("cluster_id", "rack").agg(F.sum("w").alias("rw"), F.count(F.lit(1)).alias("members")),
                       ["cluster_id"], "rack", {"rank": F.lit(1), "cum": F.col("rw")})
    ring = racks.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_racks"), F.sum("rw").alias("w_total"))
    scale = totals.join(ring, "cluster_id").select(
        "cluster_id", "n", "n_racks", "w_total", F.expr("greatest(1, w_total div greatest(1, n div 2000))").alias("width"))
    spread = prefix_sums(work, ["cluster_id"], ["hb"], ["h", "topic", "partition_id"], {"ordinal": F.lit(1)})
    at = F.expr("(cast(2 * ordinal + 1 as decimal(38,0)) * w_total) div (2 * n)").alias("pos")
    points = spread.join(scale, "cluster_id").select(
        *PARTITION_KEY, "open", "ids", "racks", "unracked", "z", "h", "hb", "n_racks", "width", at)
    segs = racks.join(scale.select("cluster_id", "width"), "cluster_id").withColumn("seg_end", F.col("cum") + F.col("rw"))
    start = locate(points, segs, ["cluster_id"], "pos", "cum", "seg_end", "width", ["rank"])

    # Enough neighbours to skip every used rack and a full unracked pool.
    reach = F.least(F.col("n_racks"), F.size("racks") + F.size("open") + 1)
    near = start.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), reach.cast("bigint") - 1)).alias("step")).withColumn(
        "rank", (F.col("rank") + F.col("step")) % F.col("n_racks"))
    near = near.join(racks.select("cluster_id", "rank", "rack", "members"), ["cluster_id", "rank"]).filter(
        "case when rack = '' then members > unracked else not array_contains(racks, rack) end")
    w = Window.partitionBy(*PARTITION_KEY).orderBy("step")
    chosen = (near.withColumn("j", F.row_number().over(w)).filter(F.col("j") <= F.size("open"))
              .select(*PARTITION_KEY, (F.col("j") - 1).alias("j"), "rack"))
    want = work.select(*PARTITION_KEY, "ids", "racks", "z", "h", "hb", F.posexplode("open").alias("j", "idx"))
    asked = materialize(want.join(chosen, [*PARTITION_KEY, "j"], "left"), "repair-asked")

    # Inside a rack: slots by size on a line of the rack's broker weights.
    inside = ["cluster_id", "rack"]
    fixed = asked.filter("rack <> ''")
    members = _rank_pool(pool.filter("rack <> ''"), inside, "broker_id", {"cum": F.col("w")})
    dims = fixed.groupBy(*inside).agg(F.sum("z").alias("zr"), F.count(F.lit(1)).alias("nr")).join(
        pool.groupBy(*inside).agg(F.sum("w").alias("wr")), inside).withColumn(
        "width", F.expr("greatest(1, wr div greatest(1, nr div 2000))"))
    laid = prefix_sums(fixed, inside, ["hb"], ["h", "topic", "partition_id", "idx"], {"at": F.col("z")}).join(dims, inside)
    laid = laid.withColumn("pos", F.expr("(cast(2 * at + z as decimal(38,0)) * wr) div (2 * zr)"))
    inner = locate(laid.select(*inside, "topic", "partition_id", "idx", "z", "h", "hb", "pos", "width"),
                   members.join(dims.select(*inside, "width"), inside).withColumn("seg_end", F.col("cum") + F.col("w")),
                   inside, "pos", "cum", "seg_end", "width", ["broker_id"])
    placed = materialize(inner.select(*PARTITION_KEY, "idx", "broker_id", "rack", "z", "h", "hb"), "repair-inner")

    # Rings: unracked brokers for rackless choices; with rack reuse, any broker once enough racks are present.
    rest = asked.filter("rack is null or rack = ''")
    got = placed.groupBy(*PARTITION_KEY).agg(F.collect_list("broker_id").alias("new_ids"), F.collect_set("rack").alias("new_racks"))
    rest = rest.join(got, PARTITION_KEY, "left")
    none_b, none_s = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    n_racks = F.size(F.array_union("racks", F.coalesce("new_racks", none_s)))
    reuse = (n_racks >= min_racks) if min_racks > 0 else F.lit(False)
    rest = rest.withColumn("ring", F.when(F.col("rack").isNull() & reuse, "any").otherwise("")).withColumn(
        "taken", F.concat("ids", F.coalesce("new_ids", none_b)))
    rest = rest.groupBy(*PARTITION_KEY).agg(
        F.max("ring").alias("ring"), F.first("taken").alias("taken"), F.first("z").alias("z"), F.first("h").alias("h"),
        F.first("hb").alias("hb"), F.array_sort(F.collect_list("idx")).alias("open"))
    rest = materialize(rest, "repair-ring")
    rings = pool.filter("rack = ''").withColumn("ring", F.lit(""))
    if min_racks > 0:
        rings = rings.unionByName(pool.withColumn("ring", F.lit("any")))
    rings = _rank_pool(rings, ["cluster_id", "ring"], "broker_id", {"rank": F.lit(1)})
    length = rings.groupBy("cluster_id", "ring").agg(F.count(F.lit(1)).alias("len"))
    first = F.pmod(F.xxhash64("topic", "partition_id"), F.col("len"))
    reach = F.least(F.col("len"), (F.size("taken") + F.size("open")).cast("bigint"))
    probe = rest.join(length, ["cluster_id", "ring"]).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), reach - 1)).alias("step")).withColumn("rank", (first + F.col("step")) % F.col("len"))
    probe = probe.join(rings.select("cluster_id", "ring", "rank", "broker_id", F.col("rack").alias("r_rack")), ["cluster_id", "ring", "rank"]).filter(
        ~F.array_contains("taken", F.col("broker_id")))
    rung = (probe.withColumn("j", F.row_number().over(w)).filter(F.col("j") <= F.size("open"))
            .select(*PARTITION_KEY, F.element_at("open", F.col("j")).alias("idx"), "broker_id", F.col("r_rack").alias("rack"), "z", "h", "hb"))
    placed = placed.unionByName(rung)

    away = None
    if strategy == "storage":
        placed = materialize(placed, "repair-placed")
        fits = prefix_sums(placed, ["cluster_id", "broker_id"], ["hb"], ["h", "topic", "partition_id", "idx"], {"before": F.col("z")}).join(
            pool.select("cluster_id", "broker_id", F.col("w").alias("room")), ["cluster_id", "broker_id"])
        away = fits.filter(F.col("before") + F.col("z") > F.col("room")).select(*PARTITION_KEY, "idx")
        placed = fits.filter(F.col("before") + F.col("z") <= F.col("room"))
    new = materialize(placed.select(*PARTITION_KEY, "idx", "broker_id"), "repair-new")
    errors = want.select(*PARTITION_KEY, "idx").join(new, [*PARTITION_KEY, "idx"], "left_anti").withColumn("error", F.lit(_NO_BROKER)).unionByName(unsized)
    return kept, new, materialize(errors, "repair-errors"), away
