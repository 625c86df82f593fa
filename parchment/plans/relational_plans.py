"""Registry queries: joins, aggregates, order and sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.operators import batch, quality, registry
from parchment.plans.common import STATUS, table
from parchment.plans.registry_plans import _BOX, regions, status

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# joins


@query("select s_suppkey, case when exists (select 1 from customer where lower(replace(c_name, 'Customer', 'Supplier')) = lower(s_name)) then 'Flagged' else 'Verified' end as status from supplier")
def jn_dup_exists(spark, d):
    existing = table(spark, d, "customer").select(F.replace("c_name", F.lit("Customer"), F.lit("SUPPLIER")).alias("s_name"))
    return registry.flag_duplicates(table(spark, d, "supplier").select("s_suppkey", "s_name"), existing, "s_name").select("s_suppkey", "status")


@query("""select p.p_partkey, f.p_partkey as first_p_partkey, f.p_brand as first_p_brand from part p
join (select lower(p_name) k, arg_min(p_partkey, p_partkey) p_partkey, arg_min(p_brand, p_partkey) p_brand from part group by 1) f on lower(p.p_name) = k""")
def jn_dup_first(spark, d):
    parts = table(spark, d, "part")
    return registry.first_match(parts.select("p_name", F.col("p_partkey")), parts, "p_name", "p_partkey", ["p_partkey", "p_brand"]).select("p_partkey", "first_p_partkey", "first_p_brand")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def jn_resume_anti(spark, d):
    done = table(spark, d, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit("_result")).alias("doc_id"))
    return registry.resume(table(spark, d, "documents"), done, "doc_id").select("doc_id", "lang")


@query(f"""with r as (select l_orderkey as image_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as ord, {_BOX} from lineitem),
p as (select a.image_id, a.ord as a, b.ord as b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) as i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as areas from r a join r b on a.image_id = b.image_id and a.ord < b.ord)
select image_id, a, b, round(i / (areas - i), 6) as iou from p where i > 0 and i / (areas - i) >= 0.3""")
def jn_iou_pairs(spark, d):
    from parchment.operators.fusion import overlapping_pairs

    return overlapping_pairs(predictions(spark, d), 0.3).select("image_id", "a", "b", F.round("iou", 6).alias("iou"))


def predictions(spark, d):
    """Line items as predictions: four models, three texts."""
    place = F.row_number().over(W.partitionBy("image_id").orderBy("line", "l_partkey", "l_suppkey"))
    models = F.array(*[F.lit(m) for m in ("paddle_ocr", "trocr", "tesseract", "easyocr")])
    return regions(spark, d).select("image_id", place.alias("ord"), F.get(models, F.col("line") % 4).alias("model"), "text", "confidence", "box")


@query("select lower(a.text) as reference, lower(b.text) as hypothesis, a.item_id as id from benchmark a join benchmark b on b.item_id = a.item_id + 1")
def jn_positional_zip(spark, d):
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lower("text").alias("reference"))
    b = table(spark, d, "benchmark").select((F.col("item_id") - 1).alias("id"), F.lower("text").alias("hypothesis"))
    return a.join(b, "id").select("reference", "hypothesis", "id")


@query("""with t as (select doc_id as doc, 'quality' as field, cast(quality as varchar) as value from labels union all select doc_id, 'toxic', cast(toxic as varchar) from labels),
p as (select doc_id as doc, 'quality' as field, cast(n_chars % 2 as varchar) as value from documents union all select doc_id, 'lang', lang from documents)
select coalesce(t.doc, p.doc) as doc, coalesce(t.field, p.field) as field, coalesce(t.value, '') as reference, coalesce(p.value, '') as hypothesis from t full join p on t.doc = p.doc and t.field = p.field""")
def jn_fields_outer(spark, d):
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents")
    truth = labels.unpivot("doc_id", ["quality", "toxic"], "field", "value").select(F.col("doc_id").alias("doc"), "field", F.col("value").cast("string").alias("value"))
    found = docs.select(F.col("doc_id").alias("doc"), F.explode(F.array(F.struct(F.lit("quality").alias("field"), (F.col("n_chars") % 2).cast("string").alias("value")), F.struct(F.lit("lang").alias("field"), F.col("lang").alias("value")))).alias("x"))
    return quality.field_pairs(truth, found.select("doc", "x.*"))


@query(f"""with alerts as (select o_orderkey as alert_id, o_custkey as alert_key from orders where o_orderstatus = 'P'), approved as (select alert_id from alerts where alert_id % 7 = 0),
firsts as (select o_custkey, min(o_orderkey) as k from orders where o_custkey in (select alert_key from alerts join approved using (alert_id)) group by 1)
select o_orderkey, case when o_orderkey in (select k from firsts) then 'Verified' else {STATUS} end as status, o_orderkey in (select alert_id from alerts where alert_id % 7 <> 0) as alert_left from orders""")
def jn_dispute_apply(spark, d):
    orders = table(spark, d, "orders").withColumn("status", status())
    alerts = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("alert_id"), F.col("o_custkey").alias("alert_key"))
    left, records = registry.resolve_alerts(orders, alerts, alerts.where("alert_id % 7 = 0").select("alert_id"), "o_custkey", "o_orderkey")
    met = records.join(left.select(F.col("alert_id").alias("o_orderkey"), F.lit(True).alias("alert_left")), "o_orderkey", "left")
    return met.select("o_orderkey", "status", F.coalesce("alert_left", F.lit(False)).alias("alert_left"))


@query("select n_name, count(distinct c_custkey) as customers, count(o_orderkey) as orders from nation join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by n_name")
def jn_xdoc_record(spark, d):
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    met = table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return met.groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))


@query("select doc_id, first_doc_id from (select doc_id, min(doc_id) over (partition by lower(text)) as first_doc_id from documents) where doc_id > first_doc_id")
def dup_exact(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    return registry.repeats(docs, F.col("t"), "doc_id").select("doc_id", "first_doc_id")


@query("""with s as (select lower(p_name || ' ' || p_brand) as k, min(p_partkey) as first from part group by 1),
g as (select k, first, unnest(list_distinct(list_transform(range(1, length(k) - 1), lambda i: substr(k, i, 3)))) as gram from s), z as (select k, count(*) as n from g group by 1),
b as (select x.k as key, y.k as other_key, min(x.first) as first, min(y.first) as other, count(*) as met from g x join g y on x.gram = y.gram and x.k < y.k group by 1, 2)
select first, other, key, other_key, round(met / (z.n + w.n - met), 6) as similarity from b join z on z.k = key join z w on w.k = other_key where met / (z.n + w.n - met) >= 0.75""")
def dup_near(spark, d):
    found = registry.near_repeats(table(spark, d, "part"), F.concat_ws(" ", "p_name", "p_brand"), "p_partkey")
    return found.withColumn("similarity", F.round("similarity", 6))


# aggregates


@query(f"""select count(*) as total, sum(({STATUS} = 'Verified')::int)::bigint as verified, sum(({STATUS} = 'Pending')::int)::bigint as pending, (select count(*) from events where event_type = 'error') as alerts,
round(sum(o_totalprice), 2) as amount from orders""")
def agg_kpi(spark, d):
    orders = table(spark, d, "orders").withColumn("status", status())
    price = T_prefix(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    got = registry.kpis(orders, table(spark, d, "events").where("event_type = 'error'"), "status", price)
    return got.select("total", "verified", "pending", "alerts", F.round("amount", 2).alias("amount"))


def T_prefix(text):
    from parchment.functions.text import number_prefix

    return number_prefix(text, 0)


@query("select conv_id, round(avg(length(text)), 6) as mean, string_agg(role, chr(10) order by turn) as texts from conversations group by conv_id")
def agg_conf_mean(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.coalesce(F.avg(F.length("text")), F.lit(0.0)).alias("mean"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return rows.select("conv_id", F.round("mean", 6).alias("mean"), F.array_join(F.transform("r", lambda x: x["role"]), "\n").alias("texts"))


@query("select l_orderkey, round(avg(l_quantity) / 100, 6) as confidence, string_agg(l_returnflag, ' ' order by l_linenumber, l_partkey, l_suppkey) as texts from lineitem group by 1")
def agg_tess_conf(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.avg("l_quantity").alias("m"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("r"))
    return rows.select("l_orderkey", F.round(F.col("m") / 100, 6).alias("confidence"), F.array_join(F.transform("r", lambda x: x["l_returnflag"]), " ").alias("texts"))


@query("select o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as best from orders group by 1")
def agg_best_by_conf(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@query("select lang, count(*) as n from documents group by lang")
def agg_lang_dist(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("""with x as (select lang, quality is not null as ok, n_chars from documents left join labels using (doc_id))
select count(*) as total, sum(ok::int)::bigint as success, sum((not ok)::int)::bigint as failed, round(avg(case when ok then n_chars end), 6) as mean_seconds,
(select string_agg(lang || ':' || n, ',' order by lang) from (select lang, count(*) n from x group by 1)) as languages from x""")
def agg_batch_summary(spark, d):
    met = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    got = registry.batch_summary(met, F.col("quality").isNotNull(), F.col("n_chars"), "lang")
    return got.withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("""with e as (select min(n_chars) lo, max(n_chars) hi from documents)
select least(19, floor((n_chars - lo) / ((hi - lo) / 20)))::int as bin, count(*) as n from documents, e group by 1""")
def agg_hist(spark, d):
    return quality.histogram(table(spark, d, "documents"), "n_chars").select("bin", "n")


@query("select l_returnflag, round(avg(1 - l_discount), 6) as mean, round(stddev_pop(1 - l_discount), 6) as std, count(*) as n from lineitem group by 1")
def agg_field_accuracy(spark, d):
    got = quality.field_accuracy(table(spark, d, "lineitem").withColumn("a", 1 - F.col("l_discount")), "l_returnflag", "a")
    return got.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n").orderBy(F.desc("mean"))


@query("select l_orderkey, round(avg(1 - l_discount), 6) as confidence, count(*) as n from lineitem group by 1")
def agg_record_conf(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg(1 - F.col("l_discount")), 6).alias("confidence"), F.count(F.lit(1)).alias("n"))


@query(f"select l_orderkey as image_id, min(x1) as x1, round(min(y1), 6) as y1, round(max(x2), 6) as x2, round(max(y2), 6) as y2 from (select *, {_BOX} from lineitem) group by 1")
def agg_bbox_union(spark, d):
    return regions(spark, d).groupBy("image_id").agg(F.min("x1").alias("x1"), F.round(F.min("y1"), 6).alias("y1"), F.round(F.max("x2"), 6).alias("x2"), F.round(F.max("y2"), 6).alias("y2"))


@query("""select user_id, round(sum(case when event_type = 'view' then value else 0 end), 2) as detection, round(sum(case when event_type = 'click' then value else 0 end), 2) as recognition from events group by 1""")
def agg_stage_times(spark, d):
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    m = F.map_from_entries(F.collect_list(F.struct("event_type", "v")))
    times = per.groupBy("user_id").agg(m.alias("m"))
    return times.select("user_id", *[F.round(F.coalesce(F.col("m")[k], F.lit(0.0)), 2).alias(n) for k, n in (("view", "detection"), ("click", "recognition"))])


# order


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1")
def topk_latest_per_key(spark, d):
    return registry.latest_per_key(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("select o_orderkey, o_custkey from orders order by o_orderkey limit 4")
def topk_recent(spark, d):
    return table(spark, d, "orders").orderBy("o_orderkey").limit(4).select("o_orderkey", "o_custkey")


@query(f"select l_orderkey as image_id, list(l_partkey order by y1, x1, l_linenumber, l_partkey)[1] as first_part, count(*) as n from (select *, {_BOX} from lineitem) group by 1")
def srt_regions(spark, d):
    whole = regions(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y1", "x1", "line", "l_partkey"))).alias("r"))
    return whole.select("image_id", F.get("r", F.lit(0))["l_partkey"].alias("first_part"), F.size("r").cast("long").alias("n"))


@query(f"""with recursive d as (select l_orderkey as image_id, l_partkey, x1, y1, row_number() over (partition by l_orderkey order by y1, x1, l_linenumber, l_partkey) as i from (select *, {_BOX} from lineitem)),
steps as (select image_id, i, 0 as line, y1 as total, 1 as n from d where i = 1
union all select image_id, i, line + apart::int, case when apart then y1 else total + y1 end, case when apart then 1 else n + 1 end
from (select d.image_id, d.i, d.y1, line, total, n, abs(d.y1 - total / n) >= 3 as apart from steps s join d on d.image_id = s.image_id and d.i = s.i + 1))
select image_id, row_number() over (partition by image_id order by line, x1, i) as place, l_partkey from steps join d using (image_id, i)""")
def srt_reading_order(spark, d):
    from parchment.functions.geometry import reading_order

    whole = regions(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y1", "x1", "line", "l_partkey"))).alias("r"))
    read = whole.select("image_id", F.posexplode(reading_order(F.col("r"), 3.0)).alias("i", "x"))
    return read.select("image_id", (F.col("i") + 1).alias("place"), "x.l_partkey")


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, row_number() over (order by ts desc, event_id desc) as place from events")
def srt_newest_first(spark, d):
    placed = registry.newest_places(table(spark, d, "events"), "ts", "event_id")
    return placed.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "place")


@query("select l_returnflag, round(avg(1 - l_discount), 6) as accuracy, row_number() over (order by round(avg(1 - l_discount), 6) desc, l_returnflag) as place from lineitem group by 1")
def srt_accuracy_desc(spark, d):
    means = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(1 - F.col("l_discount")), 6).alias("accuracy"))
    return means.withColumn("place", F.row_number().over(W.orderBy(F.desc("accuracy"), "l_returnflag")).cast("long"))


@query("select o_orderkey from orders order by o_orderkey limit 50")
def lim_n(spark, d):
    return table(spark, d, "orders").orderBy("o_orderkey").limit(50).select("o_orderkey")


@query("select o_orderkey, (row_number() over (order by o_orderkey) - 1)::bigint as seq, ((row_number() over (order by o_orderkey) - 1) // 10)::bigint as chunk from orders")
def win_chunk(spark, d):
    return registry.chunk_of(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 10)


@query("select o_custkey, arg_min(o_orderkey, o_orderkey) as first_key, max(o_orderkey) as last_key from orders group by 1")
def rank_match_index(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


# sets


@query("select s_nationkey as nation from supplier union select c_nationkey from customer")
def set_field_union(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")).distinct()
    return a.union(table(spark, d, "customer").select("c_nationkey").distinct()).distinct()


@query("""with a as (select s_nationkey k, count(*) n from supplier group by 1), b as (select c_nationkey k, count(*) n from customer group by 1)
select k as nation, least(a.n, b.n) as n from a join b using (k)""")
def set_multiset_intersect(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    both = a.intersectAll(table(spark, d, "customer").select("c_nationkey"))
    return both.groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, event_type from events where event_type = 'error' and event_id % 3 <> 0")
def set_dedupe_alerts(spark, d):
    alerts = table(spark, d, "events").where("event_type = 'error'").select("event_id", "event_type")
    return alerts.exceptAll(alerts.where("event_id % 3 = 0"))


@query("select 'n' as origin, n_name as name from nation union all select 'r', r_name from region")
def set_concat_sources(spark, d):
    return table(spark, d, "nation").select(F.lit("n").alias("origin"), F.col("n_name").alias("name")).unionByName(table(spark, d, "region").select(F.lit("r").alias("origin"), F.col("r_name").alias("name")))


# validation, audit and batches


@query("""select s_suppkey, array_to_string(list_filter([case when s_acctbal < 1000 then 'owner_name' end, case when s_suppkey % 10 = 3 then 'village' end], lambda x: x is not null), ',') as missing from supplier""")
def chk_required(spark, d):
    gaps = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") < 1000, "").otherwise(F.col("s_name")).alias("owner_name"), F.when(F.col("s_suppkey") % 10 != 3, "v").alias("village"))
    return gaps.select("s_suppkey", F.array_join(registry.missing_fields(["owner_name", "village"]), ",").alias("missing"))


@query("""select c_custkey, array_to_string(list_filter([case when c_acctbal < 0 then 'missing' end, case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'role' end,
case when c_custkey % 5 = 0 and c_acctbal >= 0 then 'exists' end], lambda x: x is not null), ',') as errors from customer""")
def chk_registration(spark, d):
    roles = F.expr("case c_mktsegment when 'AUTOMOBILE' then 'citizen' when 'FURNITURE' then 'patwari' when 'HOUSEHOLD' then 'admin' else c_mktsegment end")
    email = F.when(F.col("c_acctbal") >= 0, F.concat("c_name", F.lit("@x")))
    people = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), email.alias("email"), F.lit("secret").alias("password"), roles.alias("role"))
    got = registry.registration_errors(people, people.where("c_custkey % 5 = 0").select("email"))
    return got.select("c_custkey", F.array_join("errors", ",").alias("errors"))


@query("""with o as (select *, count(*) over (partition by o_custkey, o_orderdate) as n from orders left join customer on c_custkey = o_custkey),
c as (select *, case id when 1 then n = 1 when 2 then c_name <> '' when 3 then o_totalprice between 5000 and 400000 when 4 then o_orderdate < timestamp '2001-01-01' else o_orderstatus <> 'P' end as kept
  from o, (values (1, 'unique parcel'), (2, 'owner known'), (3, 'area in bounds'), (4, 'deed registered'), (5, 'no open dispute')) t(id, rule))
select id, rule, count(*) filter (kept) as passing, count(*) filter (kept is not true) as failing from c group by all""")
def chk_checklist(spark, d):
    orders = table(spark, d, "orders")
    parcels = orders.groupBy("o_custkey", "o_orderdate").agg(F.count(F.lit(1)).alias("n"))
    met = orders.join(parcels, ["o_custkey", "o_orderdate"]).join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return registry.checklist(met, {
        "unique parcel": F.col("n") == 1, "owner known": F.col("c_name") != "", "area in bounds": F.col("o_totalprice").between(5000, 400000),
        "deed registered": F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp"), "no open dispute": F.col("o_orderstatus") != "P",
    })


@query("""with r as (select p_partkey, lower(p_name) as k, p_size, case when p_size % 9 = 0 then '' else p_brand end as brand from part),
f as (select p_partkey, list_filter([case when p_partkey > min(p_partkey) over (partition by k) then 'duplicate' end, case when p_size not between 3 and 40 then 'area' end,
  case when brand = '' then 'missing:brand' end], lambda x: x is not null) as issues from r)
select p_partkey, array_to_string(issues, ',') as issues from f where len(issues) > 0""")
def chk_audit_scan(spark, d):
    brand = F.when(F.col("p_size") % 9 == 0, "").otherwise(F.col("p_brand"))
    records = table(spark, d, "part").select("p_partkey", "p_name", "p_size", brand.alias("brand"))
    found = registry.audit_scan(records, F.col("p_name"), "p_partkey", F.col("p_size"), 3, 40, ["brand"])
    return found.select("p_partkey", F.array_join("issues", ",").alias("issues"))


@query("""select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, event_type as action from events
union all select -1 - event_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), 'AUDIT ' || event_type from events where event_type = 'error'""")
def ops_audit_append(spark, d):
    log = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("event_type").alias("action"))
    new = log.where("action = 'error'").select((-1 - F.col("event_id")).alias("event_id"), "at", F.concat(F.lit("AUDIT "), F.col("action")).alias("action"))
    return log.unionByName(new)


@query("select o_orderkey, case when o_orderkey % 11 = 0 then 'bad key' end as error, case when o_orderkey % 11 <> 0 then o_custkey end as result from orders")
def ops_batch(spark, d):
    return batch.attempt(table(spark, d, "orders"), F.col("o_custkey"), F.when(F.col("o_orderkey") % 11 == 0, "bad key")).select("o_orderkey", "error", "result")


@query("""select doc_id, case when doc_id % 20 < 14 then 'train' when doc_id % 20 < 17 then 'validation' else 'test' end as part from documents""")
def ds_split(spark, d):
    return batch.split(table(spark, d, "documents").select("doc_id"), F.pmod(F.col("doc_id"), F.lit(20)), (14, 3, 3)).select("doc_id", "part")


@query("""select lang, c_custkey as i, lang || '-' || lpad(cast(c_custkey as varchar), 9, '0') as record_id, 100 + (c_custkey * 37 + case lang when 'hi' then 1 when 'bn' then 2 else 3 end) % 900 as survey
from (values ('hi'), ('bn'), ('en')) l(lang), customer""")
def ds_generate(spark, d):
    return batch.generate(table(spark, d, "customer"), "c_custkey", ["hi", "bn", "en"])


@query("""select c_custkey, regexp_extract('Owner Name: ' || c_name, '^([^:]*): ', 1) as raw, 'owner_name' as key, c_name as value from customer""")
def ds_gt_from_text(spark, d):
    lines = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("Owner Name: "), F.col("c_name")).alias("line"))
    pairs = batch.truth_from_text(lines, "line").select("c_custkey", F.explode("truth").alias("key", "value"), F.regexp_extract("line", "^([^:]*): ", 1).alias("raw"))
    return pairs.select("c_custkey", "raw", "key", "value")


@query("select item_id, (row_number() over (order by item_id) - 1)::bigint as id, 'img_' || item_id || '.png' as file_name, length(text) as n from benchmark")
def ds_annotations(spark, d):
    named = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("img_"), F.col("item_id"), F.lit(".png")).alias("file_name"), F.length("text").cast("long").alias("n"))
    return registry.chunk_of(named, "item_id", 1).select("item_id", F.col("seq").alias("id"), "file_name", "n")
