"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded block selection.

Targets: sources share ``budget`` (a multiple of all words) by weight; none exceeds ``epochs`` times its own size, and what it
can't take is shared again by weight. Blocks of ``block`` words are apportioned to sources by highest quotients
target / (2 k + 1), and each source's blocks to the shards of its documents in the same way by the shards' sizes, so every
(source, shard) has an integer quota. In a shard the documents of a source lie in a seeded order; whole passes over them come
first, and the rest of the quota is a run of consecutive blocks from a seeded start, around the end. A document's ``taken``
words are its words in those passes and blocks.

The quotients are not enumerated from the first block: rounding target / block gives all but a few seats, and only the
difference to the house size is awarded (or taken back) quotient by quotient. All steps are DataFrame expressions; the only
values that reach the driver are sums over sources. A hot source is dealt over all shards; sources, shards and quotients are
ordered by a range sort, and no window holds more than the documents of one source in one shard.

Defined results. Null or empty text: size 0, takes nothing. Null source: the last in the order of sources. Repeated rows: each
is laid out and returned by itself; rows alike in doc_id and size are interchangeable. Null doc_id: takes part. Empty table:
empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._shared import shielded, stage, text_key, unshielded

WEIGHTS = (5, 2, 1)


def word_count(text: Column | str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(df: DataFrame, group: list[str], by: list[Column | str], out: str, name: str) -> DataFrame:
    """A staged copy of ``df`` with each row's place (from 0) in its group, in the order ``by``; no task holds a whole group.

    Rows are dealt by ranges of (group, by), so a large group lies in many parts; a row's place is its place in its part plus
    the rows of the parts before, less the place of its group's first row.
    """
    keys = [k for g in group for k in (F.col(g).isNull(), F.col(g))]
    order = [*keys, *by]
    parts = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = parts.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a part
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = parts.join(F.broadcast(before), part == before["_part"]).withColumn("_place", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")
    if not group:
        return placed.withColumnRenamed("_place", out)
    firsts = placed.groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group))).agg(F.min("_place").alias("_first"))
    on = F.lit(True)
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(firsts, on).withColumn(out, F.col("_place") - F.col("_first")).drop("_place", "_first", *(f"_g{i}" for i in range(len(group))))


def _ordered_sources(sized: DataFrame) -> DataFrame:
    """One row a source: ``source``, ``source_size``, ``rank`` by code point from 0, null last."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return ranked(sums, [], [F.col("source").isNull(), F.encode("source", "utf-8")], "rank", "sources")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, epochs: int = 2) -> DataFrame:
    """``source``, ``source_size``, ``weight`` and ``target`` (double) of every source.

    Each turn shares what the capped sources leave; the level only rises, so it ends when no further source is capped.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stage(_ordered_sources(sized).withColumn("weight", weight), "weighted")
    cap = (epochs * F.col("source_size")).cast("double")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, n_capped = None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * level > cap
        row = sources.agg(F.sum(F.when(capped, cap).otherwise(0.0)).alias("given"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weight"), F.sum(capped.cast("long")).alias("n")).first()
        if not row["weight"] or row["n"] == n_capped:
            break
        level, n_capped = (budget * total - row["given"]) / row["weight"], row["n"]
    return sources.select("source", "source_size", "weight", F.least(cap, F.col("weight") * (level or 0.0)).alias("target"))


def apportion(parties: DataFrame, claim: str, house: Column, group: list[str], out: str) -> DataFrame:
    """Sainte-Lague seats of parties with real claims, in houses by ``group`` (no group: one house).

    ``house`` is the number of seats, the same in all rows of a group. Rounded shares come first; the difference is awarded
    to the highest quotients share / (2 seats + 1), or taken from the lowest share / (2 seats - 1). Equal quotients go by the
    parties' columns in their order. Sums are partial aggregates joined back, and places come from ``ranked``: a house of any
    number of parties is dealt over all tasks.
    """
    names = parties.columns
    base = stage(parties.withColumn("_house", house), "parties")

    def beside(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
        if not group:
            row = df.agg(*(c.alias(n) for n, c in sums.items())).first()
            return df.withColumns({n: F.lit(row[n]) for n in sums})
        found = df.groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group))).agg(*(c.alias(n) for n, c in sums.items()))
        on = F.lit(True)
        for i, g in enumerate(group):
            on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
        return df.join(found, on).drop(*(f"_g{i}" for i in range(len(group))))

    shared = beside(base, {"_all": F.sum(claim), "_claims": F.sum((F.col(claim) > 0).cast("long"))})
    shared = shared.withColumn("_share", F.when(F.col("_all") > 0, F.col(claim) * F.col("_house") / F.col("_all")).otherwise(0.0)).withColumn("_seats", F.floor(F.col("_share") + 0.5))
    seated = beside(stage(shared, "shares"), {"_rounded": F.sum("_seats")})
    seated = seated.withColumn("_gap", F.when(F.col("_all") > 0, F.col("_house") - F.col("_rounded")).otherwise(F.lit(0)))
    # each rounding is off by half a seat at most, so shares scaled by 1 + n / (2 house) round to the house or more, those scaled
    # by 1 - n / (2 house) to the house or less: a party wins or loses at most share * n / (2 house), rounded up
    most = F.least(F.abs("_gap"), F.ceil(F.col("_claims") * F.col("_share") / (2 * F.greatest("_house", F.lit(1)))) + 1).cast("int")
    seated = stage(seated.withColumn("_party", F.monotonically_increasing_id()), "seats")
    offers = seated.where((F.col("_gap") != 0) & (F.col("_all") > 0)).withColumn("_most", most).withColumn("_k", F.explode(F.sequence(F.lit(0), "_most"))).where(F.col("_k") < F.col("_most"))
    up = F.col("_share") / (2 * (F.col("_seats") + F.col("_k")) + 1)
    down = F.col("_share") / (2 * (F.col("_seats") - F.col("_k")) - 1)
    offers = offers.where((F.col("_gap") > 0) | (F.col("_seats") - F.col("_k") >= 1)).withColumn("_q", F.when(F.col("_gap") > 0, -up).otherwise(down))
    placed = ranked(offers.select(*names, "_party", "_gap", "_k", "_q"), group, ["_q", *names, "_k"], "_r", "offers")
    won = placed.where(F.col("_r") < F.abs("_gap")).groupBy("_party").agg(F.sum(F.signum(F.col("_gap").cast("double"))).cast("long").alias("_moved"))
    return seated.join(won, "_party", "left").select(*names, (F.col("_seats") + F.coalesce("_moved", F.lit(0))).cast("long").alias(out))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, epochs: int = 2, block: int = 8, shard_words: int = 250_000, seed: int = 17) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` of every document, and ``_key`` of its text.

    ``shard_words`` is what a shard holds on average; the number of shards follows the corpus' size.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), text_key(text_col).alias("_key"))
    sized = stage(narrow, "sizes")
    targets = stage(source_targets(sized, weights, budget, epochs), "targets")
    total = sized.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    order = F.xxhash64(F.lit(seed), "doc_id", "_key")
    dealt = sized.withColumn("order", order).withColumn("shard", F.pmod(F.xxhash64("order", F.lit(1)), F.lit(shards)).cast("long"))
    # blocks to sources, then each source's blocks to its shards
    words = targets.agg(F.sum("target")).first()[0] or 0.0
    houses = apportion(targets, "target", F.lit(round(words / block)).cast("long"), [], "blocks")
    part = dealt.groupBy("source", "shard").agg(F.sum("size").alias("part_size"))
    part = part.join(houses.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    quotas = stage(apportion(part, "part_size", F.col("blocks"), ["source"], "quota"), "quotas")
    # the quota in words: whole passes over the part, then consecutive blocks from a seeded start
    q = quotas.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "source_size", "target", "part_size", F.least(F.col("quota") * block, epochs * F.col("part_size")).alias("quota_words"))
    joined = dealt.join(q, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    w = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = joined.withColumn("end", F.sum("size").over(w)).withColumn("begin", F.col("end") - F.col("size"))
    size = F.greatest("part_size", F.lit(1))
    passes = F.floor(F.col("quota_words") / size)
    rest = F.col("quota_words") - passes * F.col("part_size")
    at = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.greatest(F.floor(F.col("part_size") / block), F.lit(1))) * block

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.least("end", b) - F.greatest("begin", a), F.lit(0))

    chosen = overlap(at, at + rest) + overlap(at - F.col("part_size"), at + rest - F.col("part_size"))
    return laid.select("doc_id", "size", "source_size", "target", (passes * F.col("size") + chosen).cast("long").alias("taken"), "_key")


def apply_mix(docs: DataFrame, **settings) -> DataFrame:
    """``documents`` as the mix has them: each row as often as its taken words, rounded to whole documents, hold its text."""
    mixed = mix_sources(docs, **settings)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    # rows alike in id and text share one entry, with a number of copies for each row
    plan = stage(mixed.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).agg(F.sum(copies).alias("_copies"), F.count(F.lit(1)).alias("_rows")).where(F.col("_copies") > 0), "plan")
    flat, names = shielded(docs)
    keyed = flat.withColumn("_key", text_key(names["text"]))
    joined = keyed.join(plan, F.col(names["doc_id"]).cast("long").eqNullSafe(plan["_id"]) & keyed["_key"].eqNullSafe(plan["_k"]))
    if not plan.where(F.col("_rows") > 1).isEmpty():
        joined = joined.dropDuplicates([names["doc_id"], "_key"])
    return unshielded(joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))), names)
