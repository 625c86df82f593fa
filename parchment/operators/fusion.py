"""Fusion of overlapping predictions of several recognisers, in long form.

A prediction is a row (image_id, ord, model, text, confidence, box) with ord the order within its image, and language
where weights depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.functions.geometry import group_of, iou
from parchment.functions.lookups import MODEL_ORDER, MODEL_WEIGHTS, UNKNOWN_WEIGHT

MIN_IOU, MIN_CONFIDENCE = 0.5, 0.55


def overlapping_pairs(predictions: DataFrame, threshold: float = MIN_IOU) -> DataFrame:
    """(image_id, a, b, iou) of the pairs of one image that overlap by at least the threshold."""
    a = predictions.select("image_id", F.col("ord").alias("a"), F.col("box").alias("box_a"))
    b = predictions.select("image_id", F.col("ord").alias("b"), F.col("box").alias("box_b"))
    met = a.join(b, "image_id").where("a < b").withColumn("iou", iou(F.col("box_a"), F.col("box_b")))
    return met.where(F.col("iou") >= threshold).select("image_id", "a", "b", "iou")


def group_regions(predictions: DataFrame, threshold: float = MIN_IOU) -> DataFrame:
    """predictions with group, the ord of the region that leads it. A region joins the first leader it overlaps; an
    image's regions, which are few, meet in one row."""
    fields = [c for c in predictions.columns if c not in ("image_id", "ord")]
    whole = predictions.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ord", *fields))).alias("r"))
    whole = whole.withColumn("g", group_of(F.transform("r", lambda x: x["box"]), threshold))
    placed = whole.select("image_id", "r", F.posexplode(F.arrays_zip("r", "g")).alias("i", "x"))
    return placed.select("image_id", "x.r.*", F.get("r", F.col("x.g"))["ord"].alias("group"))


def model_weight(model: Column, language: Column | None = None) -> Column:
    """The weight of a recogniser, a fifth more if it is a language's first and a tenth more if its second choice."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in MODEL_WEIGHTS.items() for x in kv])[model], F.lit(UNKNOWN_WEIGHT))
    if language is None:
        return weight
    boost = F.lit(1.0)
    for code, (first, second) in MODEL_ORDER.items():
        boost = F.when((language == code) & (model == first), 1.2).when((language == code) & (model == second), 1.1).otherwise(boost)
    return weight * boost


def _with_sizes(grouped: DataFrame) -> DataFrame:
    return grouped.withColumns({"filled": F.trim(F.coalesce("text", F.lit(""))) != "", "language": F.col("language") if "language" in grouped.columns else F.lit(None).cast("string")})


def _by_text(grouped: DataFrame) -> DataFrame:
    """One row for each text of a group: its score, number, mean confidence and first place; and what the group has."""
    rows = _with_sizes(grouped)
    return rows.groupBy("image_id", "group", F.when(F.col("filled"), F.col("text")).alias("text")).agg(
        F.sum(F.col("confidence") * model_weight(F.col("model"), F.col("language"))).alias("score"), F.count(F.lit(1)).alias("n"),
        F.avg("confidence").alias("mean"), F.min("ord").alias("first"),
        F.max_by(F.struct(F.col("text").alias("best_text"), F.col("confidence").alias("best")), F.struct(F.col("confidence"), -F.col("ord"))).alias("top"),
        F.min("box.x1").alias("x1"), F.min("box.y1").alias("y1"), F.max("box.x2").alias("x2"), F.max("box.y2").alias("y2"),
    )


def _vote(grouped: DataFrame, order: Column, confidence: Column) -> DataFrame:
    texts = _by_text(grouped).withColumns({"order": order, "filled": F.col("text").isNotNull()})
    best = F.max_by(F.struct("text", "score", "n", "mean"), F.when(F.col("filled"), F.col("order")))
    groups = texts.groupBy("image_id", "group").agg(
        F.sum("n").alias("size"), best.alias("won"), F.max_by("top", F.struct(F.col("top.best"), -F.col("first"))).alias("top"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    )
    alone = (F.col("size") == 1) | F.col("won").isNull()
    return groups.select(
        "image_id", "group", "size", F.when(alone, F.col("top.best_text")).otherwise(F.col("won.text")).alias("text"),
        F.when(alone, F.col("top.best")).otherwise(confidence).alias("confidence"), F.struct("x1", "y1", "x2", "y2").alias("box"),
    )


def vote_weighted(grouped: DataFrame) -> DataFrame:
    """One region a group: the text with the largest sum of confidence times weight, the first one among equals (to nine
    places, so that the order of summation decides nothing); its confidence is that sum over the weights of all known models, 1 at most. Groups of one keep their confidence, and
    groups without any text their surest region's."""
    total = sum(MODEL_WEIGHTS.values())
    return _vote(grouped, F.struct(F.round("score", 9), -F.col("first")), F.least(F.lit(1.0), F.col("won.score") / total))


def vote_majority(grouped: DataFrame) -> DataFrame:
    """One region a group: the most frequent text, the first one among equals, at its share of the group times its mean
    confidence."""
    return _vote(grouped, F.struct(F.col("n"), -F.col("first")), F.col("won.n") / F.col("size") * F.col("won.mean"))


def vote_best_single(grouped: DataFrame) -> DataFrame:
    """One region a group: the language's first model's, else its second's, else the surest; for languages without an
    order the one of the largest confidence times weight. Earlier ones win ties."""
    rows = _with_sizes(grouped)
    rank = F.lit(0)
    ordered = F.col("language").isin(*MODEL_ORDER)
    for code, (first, second) in MODEL_ORDER.items():
        here = F.col("language") == code
        rank = F.when(here & (F.col("model") == first), 2).when(here & (F.col("model") == second), 1).otherwise(rank)
    # among several regions of a language's own model the earlier one is taken, whatever its confidence
    value = F.when(rank > 0, 0.0).when(ordered, F.col("confidence")).otherwise(F.col("confidence") * model_weight(F.col("model")))
    return rows.groupBy("image_id", "group").agg(F.max_by(F.struct("text", "confidence", "model", "box"), F.struct(rank, value, -F.col("ord"))).alias("x")).select("image_id", "group", "x.*")


def fuse(predictions: DataFrame, strategy: str = "confidence_weighted", threshold: float = MIN_IOU, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Grouped, voted and filtered regions of each image with seq, their place by (y1, x1)."""
    vote = {"confidence_weighted": vote_weighted, "weighted_average": vote_weighted, "majority_vote": vote_majority, "best_single": vote_best_single}[strategy]
    kept = vote(group_regions(predictions, threshold)).where(F.round("confidence", 9) >= min_confidence)
    return kept.withColumn("seq", F.row_number().over(W.partitionBy("image_id").orderBy("box.y1", "box.x1", "group")))
