"""Queries on predictions: grouping, voting and their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions import geometry as G
from parchment.functions.lookups import MODEL_WEIGHTS
from parchment.operators import fusion
from parchment.plans.common import table
from parchment.plans.registry_plans import _BOX
from parchment.plans.relational_plans import predictions

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_R = f"""r as (select l_orderkey as image_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as ord,
  ['paddle_ocr', 'trocr', 'tesseract', 'easyocr'][l_linenumber % 4 + 1] as model, l_returnflag as text, 1 - l_discount as confidence, {_BOX} from lineitem)"""
_WEIGHT = "case model when 'paddle_ocr' then 1.0 when 'trocr' then 0.9 when 'easyocr' then 0.8 when 'tesseract' then 0.7 else 0.5 end"
#: Greedy groups: regions enter in order; the first leader that overlaps takes a region, else it leads.
_GROUPS = f"""{_R}, pairs as (select a.image_id, a.ord, b.ord as other, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as met,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as areas from r a join r b on b.image_id = a.image_id and b.ord < a.ord),
near as (select image_id, ord, list(other) as earlier from pairs where met > 0 and met / (areas - met) >= 0.3 group by 1, 2),
e as (select image_id, ord, earlier from r left join near using (image_id, ord)),
steps as (
  select image_id, ord, [ord] as leads, ord as grp from r where ord = 1
  union all
  select image_id, ord, case when lead is null then list_append(leads, ord) else leads end, coalesce(lead, ord)
  from (select e.image_id, e.ord, s.leads, list_min(list_intersect(e.earlier, s.leads)) as lead from steps s join e on e.image_id = s.image_id and e.ord = s.ord + 1)),
grouped as (select r.*, s.grp from r join steps s using (image_id, ord))"""


def grouped(spark, d):
    """Groups by the text's parity of place, a grouping that SQL expresses: the voting is what is compared."""
    return predictions(spark, d).withColumns({"group": F.col("ord") % 2, "language": F.lit("en")})


@query(f"""with {_R} select image_id, ord, round(greatest(0, least(x2, 30) - greatest(x1, 10)) * greatest(0, least(y2, 12) - greatest(y1, 2)) /
((x2 - x1) * (y2 - y1) + 200 - greatest(0, least(x2, 30) - greatest(x1, 10)) * greatest(0, least(y2, 12) - greatest(y1, 2))), 6) as iou from r""")
def ens_iou(spark, d):
    fixed = G.box(F.lit(10), F.lit(2), F.lit(30), F.lit(12))
    return predictions(spark, d).select("image_id", "ord", F.round(G.iou(F.col("box"), fixed), 6).alias("iou"))


@query(f"with recursive {_GROUPS} select image_id, ord, grp from grouped")
def ens_group(spark, d):
    return fusion.group_regions(predictions(spark, d), 0.3).select("image_id", "ord", F.col("group").alias("grp"))


_TOTAL = sum(MODEL_WEIGHTS.values())
_TEXTS = f"""t as (select image_id, ord % 2 as grp, text, sum(confidence * {_WEIGHT} * case model when 'trocr' then 1.2 when 'paddle_ocr' then 1.1 else 1 end) as score, count(*) as n, avg(confidence) as mean, min(ord) as first, max(confidence) as top from r group by 1, 2, 3),
g as (select image_id, grp, sum(n) as size, max(top) as top from t group by 1, 2)"""


def fused(first: str, second: str, least: float) -> str:
    """SQL: regions voted by weight within their greedy groups, for a language's first and second model, at least so sure."""
    return f"""with recursive {_GROUPS}, t as (select image_id, grp, text, sum(confidence * {_WEIGHT} * case model when '{first}' then 1.2 when '{second}' then 1.1 else 1 end) as score,
count(*) as n, min(ord) as first, max(confidence) as top, min(x1) as x1, min(y1) as y1 from grouped group by 1, 2, 3),
g as (select image_id, grp, sum(n)::bigint as size, max(top) as top, min(x1) as x1, min(y1) as y1 from t group by 1, 2),
w as (select image_id, grp, text, score from t qualify row_number() over (partition by image_id, grp order by round(score, 9) desc, first) = 1),
voted as (select image_id, grp, size, text, case when size = 1 then g.top else least(1, score / {_TOTAL}) end as confidence, x1, y1 from w join g using (image_id, grp)),
kept as (select *, row_number() over (partition by image_id order by y1, x1, grp) as seq from voted where round(confidence, 9) >= {least})"""


@query(f"""with {_R}, {_TEXTS}, w as (select *, row_number() over (partition by image_id, grp order by round(score, 9) desc, first) as k from t)
select image_id, grp, size::bigint as size, text, round(case when size = 1 then g.top else least(1, score / {_TOTAL}) end, 6) as confidence from w join g using (image_id, grp) where k = 1""")
def ens_weighted(spark, d):
    got = fusion.vote_weighted(grouped(spark, d).withColumn("confidence", F.round("confidence", 2)))
    return got.select("image_id", F.col("group").alias("grp"), "size", "text", F.round("confidence", 6).alias("confidence"))


@query(f"""{fused("trocr", "paddle_ocr", 0.55)} select image_id, grp as "group", text, round(confidence, 6) as confidence from kept""")
def ens_weighted_avg(spark, d):
    return fusion.fuse(predictions(spark, d).withColumn("language", F.lit("en")), "weighted_average", 0.3).select("image_id", "group", "text", F.round("confidence", 6).alias("confidence"))


@query(f"""with {_R}, {_TEXTS}, w as (select *, row_number() over (partition by image_id, grp order by n desc, first) as k from t)
select image_id, grp, size::bigint as size, text, round(case when size = 1 then g.top else n / size * mean end, 6) as confidence from w join g using (image_id, grp) where k = 1""")
def ens_majority(spark, d):
    got = fusion.vote_majority(grouped(spark, d))
    return got.select("image_id", F.col("group").alias("grp"), "size", "text", F.round("confidence", 6).alias("confidence"))


@query(f"""with {_R}, w as (select *, ord % 2 as grp, row_number() over (partition by image_id, ord % 2 order by case model when 'trocr' then 2 when 'paddle_ocr' then 1 else 0 end desc,
case when model in ('trocr', 'paddle_ocr') then 0 else confidence end desc, ord) as k from r) select image_id, grp, text, model, round(confidence, 6) as confidence from w where k = 1""")
def ens_best_single(spark, d):
    got = fusion.vote_best_single(grouped(spark, d))
    return got.select("image_id", F.col("group").alias("grp"), "text", "model", F.round("confidence", 6).alias("confidence"))


@query(f"with {_R} select image_id, ord % 2 as grp, any_value(text) as text, round(any_value(confidence), 6) as confidence from r group by 1, 2 having count(*) = 1")
def ens_singletons(spark, d):
    got = fusion.vote_weighted(grouped(spark, d)).where("size = 1")
    return got.select("image_id", F.col("group").alias("grp"), "text", F.round("confidence", 6).alias("confidence"))


@query(f"""{fused("paddle_ocr", "trocr", 0.3)} select image_id, seq, grp as "group", size, text, round(confidence, 6) as confidence from kept""")
def ens_vote(spark, d):
    got = fusion.fuse(predictions(spark, d).withColumn("language", F.lit("hi")), "confidence_weighted", 0.3, 0.3)
    return got.select("image_id", "seq", "group", "size", "text", F.round("confidence", 6).alias("confidence"))


@query(f"with {_R} select image_id, ord % 2 as grp, '' as text, round(max(confidence), 6) as confidence from r group by 1, 2")
def ens_empty_text(spark, d):
    got = fusion.vote_majority(grouped(spark, d).withColumn("text", F.lit("")))
    return got.select("image_id", F.col("group").alias("grp"), "text", F.round("confidence", 6).alias("confidence"))


@query(f"""with {_R} select model, text, round({_WEIGHT} * case model when 'paddle_ocr' then 1.2 when 'trocr' then 1.1 else 1 end, 6)::double as weight, count(*) as n, round(avg(confidence), 6) as confidence from r group by all""")
def ens_routing(spark, d):
    """What each model's predictions weigh for Hindi, how many there are and how sure they are."""
    weighed = predictions(spark, d).withColumn("weight", F.round(fusion.model_weight(F.col("model"), F.lit("hi")), 6))
    return weighed.groupBy("model", "text", "weight").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


# crops, detections and the plug-in surface of recognisers


@query(f"with {_R} select image_id, ord, greatest(0, x1 - 5) as x1, round(greatest(0, y1 - 5), 6) as y1, round(least(55, x2 + 5), 6) as x2, round(least(20, y2 + 5), 6) as y2 from r")
def img_crop(spark, d):
    b = G.clamp(F.col("box"), F.lit(55), F.lit(20), 5)
    rows = predictions(spark, d).withColumn("c", b)
    return rows.select("image_id", "ord", *[F.round(F.col("c")[n], 6).alias(n) for n in ("x1", "y1", "x2", "y2")])


@query("""with i as (select p_partkey, p_size * 100 as w, round(p_retailprice)::int as h from part), m as (select *, case when greatest(w, h) > 3200 then 3200.0 / greatest(w, h) else 1 end as down from i),
f as (select *, floor(w * down + 1e-9)::int as dw, floor(h * down + 1e-9)::int as dh from m),
u as (select *, case when least(dw, dh) < 640 then least(640.0 / least(dw, dh), 3200.0 / greatest(dw, dh)) else 1 end as up from f)
select p_partkey, floor(dw * greatest(up, 1) + 1e-9)::int as width, floor(dh * greatest(up, 1) + 1e-9)::int as height from u""")
def img_resize(spark, d):
    size = G.resized((F.col("p_size") * 100).cast("int"), F.round("p_retailprice").cast("int"))
    return table(spark, d, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


@query("select doc_id, round(least(0.95, 0.5 + 0.01 * n_chars), 6) as confidence from documents")
def rec_crop_ocr(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(F.least(F.lit(0.95), 0.5 + 0.01 * F.col("n_chars")), 6).alias("confidence"))


@query(f"with {_R} select image_id, ord, x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2, 0.9 as confidence from r")
def det_boxes(spark, d):
    polygon = F.array(F.col("box.x1"), F.col("box.y1"), F.col("box.x2"), F.col("box.y1"), F.col("box.x2"), F.col("box.y2"), F.col("box.x1"), F.col("box.y2"))
    rows = predictions(spark, d).withColumn("c", G.box_from_numbers(polygon))
    return rows.select("image_id", "ord", *[F.round(F.col("c")[n], 6).alias(n) for n in ("x1", "y1", "x2", "y2")], F.lit(0.9).alias("confidence"))
