"""Mixing sources to target weights: a low-discrepancy schedule of slots joined with shuffled equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.llm.common import count_words, saved, without, words

#: Weights of the sources in order of name, repeating; null comes last.
WEIGHTS = (3, 1, 2)
#: The sources together take so many times their size; none takes more than MAX_EPOCHS times its own.
SHARE = 1.5
MAX_EPOCHS = 2
BLOCK_WORDS = 256
#: Cells of the unit interval, the key by which points meet the intervals of sources.
CELLS = 4096
POINT_BITS = 48


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: source, source_size, n_entries, target and the number `src` of the source.

    Sources in ascending order of ratio cap / weight: those whose cap is below what the rest's common rate would give
    them get the cap, all later ones the rate times their weight, which is where resharing the excess ends.
    One row for each distinct source goes through a single task here, never the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("entry_size").alias("source_size"), F.count(F.lit(1)).alias("n_entries"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("src", F.row_number().over(by_name) - 1)
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumns({"weight": F.get(cycle, F.col("src") % len(weights)), "cap": max_epochs * F.col("source_size").cast("double")})
    order = W.orderBy(F.col("cap") / F.col("weight"), "src")
    whole = W.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    rate = (share * F.sum("source_size").over(whole) - before) / weight_left
    rated = per.withColumns({"rate": rate, "place": F.row_number().over(order)})
    rated = rated.withColumn("capped", F.col("cap") <= F.col("rate") * F.col("weight"))
    common = F.min_by("rate", F.when(~F.col("capped"), F.col("place"))).over(whole)
    return rated.select("source", "src", "source_size", "n_entries", F.when(F.col("capped"), F.col("cap")).otherwise(common * F.col("weight")).alias("target"))


def _blocks(targets: DataFrame, block_words: int) -> DataFrame:
    """Adds how each source is cut into n_blocks blocks, n_long of them with base + 1 words and the rest with base,
    and n_slots, the blocks that it takes until the rounded target is reached."""
    size, t = F.col("source_size"), F.col("goal")
    rest = t % size
    long_words = F.col("n_long") * (F.col("base") + 1)
    cut = F.when(rest <= long_words, F.ceil(rest / (F.col("base") + 1))).otherwise(F.col("n_long") + F.ceil((rest - long_words) / F.col("base")))
    return (
        targets.where(size > 0)
        .withColumns({"goal": F.round("target").cast("long"), "n_blocks": F.ceil(size / block_words)})
        .withColumns({"base": F.expr("source_size div n_blocks"), "n_long": size % F.col("n_blocks")})
        .withColumn("n_slots", (F.expr("goal div source_size") * F.col("n_blocks") + cut).cast("long"))
    )


def _start(k: Column) -> Column:
    """The word at which block k of a source starts."""
    return k * F.col("base") + F.least(k, F.col("n_long"))


def _block_of(word: Column) -> Column:
    long_words = F.col("n_long") * (F.col("base") + 1)
    return F.when(word < long_words, F.floor(word / (F.col("base") + 1))).otherwise(F.col("n_long") + F.floor((word - long_words) / F.col("base")))


def schedule(blocks: DataFrame) -> DataFrame:
    """The slots (slot, src, rank): slot i goes to the source whose share of the unit interval holds point i of the
    van der Corput sequence, and is the rank-th of that source. Each source has n_slots slots: the few that the points
    give it beyond that are left out, the few that they lack follow at the end.

    Ranks are counts in chunks of about the square root of all slots, plus a running count in the chunk, so no source
    meets in one task.
    """
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("n_slots")).first()[0] or 0
    chunk = max(1, int(total**0.5))
    upto = F.sum("n_slots").over(W.orderBy("src"))
    shares = blocks.select("src", "n_slots", ((upto - F.col("n_slots")) / F.lit(max(total, 1))).alias("lo"), (upto / F.lit(max(total, 1))).alias("hi"))
    cells = shares.where("n_slots > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS)))))
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), POINT_BITS, "0")), 2, 10).cast("double") / F.lit(2.0**POINT_BITS)
    points = spark.range(total).select(F.col("id").alias("slot"), point.alias("u"))
    dealt = (
        points.withColumn("cell", F.floor(F.col("u") * CELLS))
        .join(cells, "cell")
        .where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
        .select("slot", "src", F.floor(F.col("slot") / chunk).alias("chunk"))
    )
    counts = saved(dealt.groupBy("src", "chunk").agg(F.count(F.lit(1)).alias("n")))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("src").orderBy("chunk")) - F.col("n")).drop("n")
    ranked = dealt.withColumn("place", F.row_number().over(W.partitionBy("src", "chunk").orderBy("slot"))).join(before, ["src", "chunk"])
    got = counts.groupBy("src").agg(F.sum("n").alias("got"))
    late = (
        blocks.select("src", "n_slots").join(got, "src", "left").fillna(0, ["got"]).where("got < n_slots")
        .select((F.lit(total) + F.col("got")).alias("slot"), "src", F.explode(F.sequence("got", F.col("n_slots") - 1)).alias("rank"))
    )
    on_time = ranked.select("slot", "src", (F.col("before") + F.col("place") - 1).alias("rank")).join(blocks.select("src", "n_slots"), "src")
    return on_time.where("rank < n_slots").select("slot", "src", "rank").unionByName(late)


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, share: float = SHARE,
             max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken, first_slot.

    size is the number of words, 0 for null and empty texts, which are never taken. A null source is a source, the
    last one. Documents of a source are shuffled by a hash of key and seed, laid end to end and cut into blocks of
    equal size; slot by slot the schedule takes the next block, from the first again once all are taken. taken sums
    the words of a document in those blocks, first_slot is the first slot that reads it (null if none does). The
    result depends on the rows and parameters alone. Rows that agree in key, source and size stand side by side and
    share what is taken from them evenly. An empty table gives an empty result; other columns are not looked at.
    """
    return _plan(docs, text, source, key, weights, share, max_epochs, block_words, seed).drop("epoch_slots")


def _plan(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, share: float = SHARE,
          max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """As mix_plan, with epoch_slots: the first slot that reads the row each time that its source comes round."""
    spark_docs = docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), count_words(F.col(text)).alias("size"))
    entries = saved(
        spark_docs.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("entry_size", F.col("size") * F.col("copies"))
    )
    targets = saved(source_targets(entries, weights, share, max_epochs))
    blocks = saved(_blocks(targets, block_words).drop("source"))
    hashed = (
        entries.alias("e").join(targets.alias("s"), F.col("e.source").eqNullSafe(F.col("s.source")))
        .select("e.*", "src", "source_size", "target", F.ceil(F.sqrt("n_entries")).alias("n_buckets"), F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("h"))
        .withColumn("bucket", F.least(F.col("n_buckets") - 1, F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n_buckets"))))
    )
    in_bucket = hashed.groupBy("src", "bucket").agg(F.sum("entry_size").alias("n"))
    before = in_bucket.withColumn("before", F.sum("n").over(W.partitionBy("src").orderBy("bucket")) - F.col("n")).drop("n")
    running = F.sum("entry_size").over(W.partitionBy("src", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    laid = hashed.withColumn("end", running).join(before, ["src", "bucket"]).withColumn("end", F.col("end") + F.col("before"))
    laid = laid.withColumn("start", F.col("end") - F.col("entry_size")).join(blocks.drop("source_size", "target", "n_entries", "n_slots"), "src", "left")
    pieces = laid.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(_block_of(F.col("start")), _block_of(F.col("end") - 1)))))
    rank = schedule(blocks).join(blocks, "src")
    epoch, k = F.expr("rank div n_blocks"), F.col("rank") % F.col("n_blocks")
    slots = rank.select("src", "slot", epoch.alias("epoch"), k.alias("block"), F.least(_start(k + 1), F.col("goal") - epoch * F.col("source_size")).alias("upto"))
    first = F.greatest(F.col("start"), _start(F.col("block")))
    last = F.least(F.col("end"), _start(F.col("block") + 1), F.col("upto"))
    read = pieces.join(slots, ["src", "block"], "left").withColumn("n", F.when(F.col("slot").isNotNull(), F.greatest(F.lit(0), last - first)).otherwise(0))
    return (
        read.groupBy("doc_id", "source", "size", "copies", "source_size", "target")
        .agg(
            F.sum("n").alias("n"), F.min(F.when(F.col("n") > 0, F.col("slot"))).alias("first_slot"),
            F.array(*[F.min(F.when((F.col("n") > 0) & (F.col("epoch") == e), F.col("slot"))) for e in range(math.ceil(max_epochs))]).alias("epoch_slots"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("doc_id", "source", "size", "source_size", "target", F.expr("n div copies").alias("taken"), "first_slot", "epoch_slots")
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document of docs (doc_id, text, source, n_chars and any others) as often as mix_plan takes it
    whole, and its first words where the mix ends inside it. Columns as in docs; rows of one key are taken alike.

    Each partition is in the order of the schedule: a document stands where the first slot that reads it does, each time
    anew. Partitions of a large table are dealt by a hash of the document, so each is a small mix of its own.
    """
    plan = _plan(docs, **options).groupBy("doc_id", "source", "size").agg(F.min("taken").alias("m_taken"), F.first("epoch_slots").alias("m_slots"))
    plan = plan.select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "m_taken", "m_slots").where("m_taken > 0")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("m_row")
    sized = docs.select(F.col("doc_id").alias("m_key"), F.col("source").alias("m_from"), F.col("text").alias("m_text"), count_words(F.col("text")).alias("m_words"), rest)
    met = sized.join(plan, F.col("m_key").eqNullSafe(F.col("m_id")) & F.col("m_from").eqNullSafe(F.col("m_source")) & (F.col("m_words") == F.col("m_size")))
    each = met.withColumn("m_copy", F.explode(F.sequence(F.lit(1), F.expr("(m_taken + m_size - 1) div m_size").cast("int"))))
    left = F.least(F.col("m_size"), F.col("m_taken") - (F.col("m_copy") - 1) * F.col("m_size"))
    cut = F.when(left < F.col("m_size"), F.array_join(F.slice(words(F.col("m_text")), 1, left.cast("int")), " ")).otherwise(F.col("m_text"))
    each = each.withColumn("m_text", cut).sortWithinPartitions(F.get("m_slots", F.col("m_copy") - 1), "m_id")
    new = {"text": F.col("m_text"), "n_chars": F.length("m_text").cast("long")}
    return each.select(*[new[c].alias(c) if c in new else F.col(f"m_row.`{c}`").alias(c) for c in docs.columns])
