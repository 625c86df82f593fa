"""Registry queries: reads, projections, filters, joins, aggregates, order and sets over the star tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parchment.functions import geometry as G
from parchment.functions import text as T
from parchment.operators import quality, registry
from parchment.plans.common import STATUS, shared_folder, table
from parchment.sources import files

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def status():
    return F.expr(STATUS)


def fresh(spark):
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def csv_lines(rows):
    """The lines of the CSV files that rows are written to, without headers; the first column as a number beside them."""
    path = fresh(rows.sparkSession)
    files.write_csv_quoted(rows, path)
    lines = rows.sparkSession.read.text(path).where(F.col("value") != ",".join(f'"{c}"' for c in rows.columns))
    return lines.select(F.regexp_extract("value", '^"(-?[0-9]+)"', 1).cast("long").alias(rows.columns[0]), F.col("value").alias("line"))


# sources


@query("""select o_orderkey, o_custkey, o_orderstatus, o_totalprice as total, strftime(o_orderdate, '%Y-%m-%d') as order_date, coalesce(o_orderpriority, '') as priority from orders""")
def src_full_scan(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").alias("total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), F.coalesce("o_orderpriority", F.lit("")).alias("priority"))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders where o_orderkey = 7")
def src_pk_lookup(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("select c_custkey, c_name from customer where c_name = 'Customer#000000042' order by c_custkey limit 1")
def src_key_first(spark, d):
    return table(spark, d, "customer").where("c_name = 'Customer#000000042'").orderBy("c_custkey").limit(1).select("c_custkey", "c_name")


@query("select doc_id % 16 as folder, 1 as files, sum(strlen(coalesce(text, '')) + 1)::bigint as bytes from documents group by all")
def src_image_files(spark, d):
    """Files that a listing finds below a folder of sixteen, to which the texts of all documents were written, and their bytes."""
    path = fresh(spark)
    texts = table(spark, d, "documents").select((F.col("doc_id") % 16).alias("folder"), F.coalesce("text", F.lit("")).alias("value"))
    texts.repartition("folder").write.partitionBy("folder").text(path)
    found = files.list_files(spark, path, ("txt",), recursive=True)
    return found.groupBy(F.regexp_extract("path", "folder=([0-9]+)/", 1).cast("long").alias("folder")).agg(F.count_if(F.length("stem") > 0).cast("int").alias("files"), F.sum("length").alias("bytes"))


@query("select c_custkey, base64(encode(c_name)) as encoded, c_name as decoded from customer")
def src_base64(spark, d):
    encoded = table(spark, d, "customer").select("c_custkey", F.base64(F.encode("c_name", "UTF-8")).alias("encoded"))
    return encoded.withColumn("decoded", F.decode(F.unbase64("encoded"), "UTF-8"))


@query("""select doc_id, lang, length(d.text) as n, coalesce(b.item_id, -1) as item_id, quality
from documents d join labels l using (doc_id) left join benchmark b on b.item_id = d.doc_id""")
def src_sidecar_gt(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    extra = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("item_id"))
    return docs.join(labels, "doc_id").join(extra, "doc_id", "left").select("doc_id", "lang", F.length("text").cast("long").alias("n"), F.coalesce("item_id", F.lit(-1)).alias("item_id"), "quality")


@query("select item_id as id, 'coco' as origin, length(text) as n from benchmark union all select conv_id, 'lines', length(text) from conversations")
def src_annotations(spark, d):
    coco, lines = fresh(spark), fresh(spark)
    items = table(spark, d, "benchmark").select(F.floor(F.col("item_id") / 1000).alias("file"), F.struct(F.col("item_id").alias("id"), "text").alias("a"))
    files.write_documents(items.groupBy("file").agg(F.collect_list("a").alias("annotations")), "file", coco)
    files.write_json_rows(table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "text"), lines)
    of = lambda origin, got: got.select("id", F.lit(origin).alias("origin"), F.length("text").cast("long").alias("n"))
    return of("coco", files.read_annotations(spark, coco=coco)).unionByName(of("lines", files.read_annotations(spark, lines=lines)))


@query("select p_type as field, p_brand as language_group, count(*) as n, max(p_size) as most from part group by all")
def src_yaml_schema(spark, d):
    """A schema of fields made from the parts' types and brands, written as one JSON document and read back."""
    path = fresh(spark)
    groups = table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("most"))
    fields = groups.groupBy("p_type").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", F.struct("n", "most")))).alias("patterns"))
    fields.select(F.to_json(F.create_map("p_type", "patterns")).alias("value")).write.text(path)
    schema = "map<string,map<string,struct<n:bigint,most:int>>>"
    read = spark.read.text(path).select(F.explode(F.from_json("value", schema)).alias("field", "patterns"))
    return read.select("field", F.explode("patterns").alias("language_group", "x")).select("field", "language_group", "x.n", "x.most")


@query("""select doc_id, case when doc_id % 2 = 0 then coalesce(lang, '') else '' end as language, n_chars::double as seconds, '' as model, 0 as regions from documents""")
def src_json_result(spark, d):
    path = fresh(spark)
    some = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))  # a null isn't written
    files.write_json_rows(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("image_path"), some.alias("detected_language"), F.col("n_chars").cast("double").alias("processing_time")), path)
    got = files.read_results(spark, path)
    return got.select(F.col("image_path").cast("long").alias("doc_id"), F.col("detected_language").alias("language"), F.col("processing_time").alias("seconds"), F.col("model_used").alias("model"), F.size("regions").alias("regions"))


@query("select 'state' as origin, s_suppkey as key, s_name as name from supplier union all select 'seed', r_regionkey, r_name from region")
def src_local_state(spark, d):
    """A state that was written wins over its seed; where none was written, the seed is the state."""
    path = fresh(spark)
    seed = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"))
    table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_name").alias("name")).write.json(path)
    of = lambda origin, got: got.select(F.lit(origin).alias("origin"), "key", "name")
    return of("state", files.read_or_seed(spark, path, seed)).unionByName(of("seed", files.read_or_seed(spark, f"{path}-none", seed)))


# sinks: what is read back of what was written


@query("""select o_orderkey, '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_custkey":' || o_custkey || '}' as line from orders""")
def snk_json_row(spark, d):
    path = fresh(spark)
    files.write_json_rows(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"), F.col("value").alias("line"))


@query("""select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' as line from nation union all select '{"n_nationkey":' || r_regionkey || ',"n_name":"' || r_name || '"}' from region""")
def snk_jsonl_append(spark, d):
    path = fresh(spark)
    files.write_json_rows(table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    more = table(spark, d, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    files.write_json_rows(more, path, "append")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("""select doc_id, d.lang, l.quality as field_quality, l.toxic as field_toxic, d.n_chars from documents d left join labels l using (doc_id)""")
def snk_csv_flat(spark, d):
    docs, labels, path = table(spark, d, "documents"), table(spark, d, "labels"), fresh(spark)
    met = docs.join(labels, "doc_id", "left")
    field = lambda c: F.struct(F.col(c).cast("string").alias("value"), F.lit(1.0).alias("confidence"))
    fields = F.map_from_arrays(F.array(F.lit("quality"), F.lit("toxic")), F.array(field("quality"), field("toxic")))
    results = met.select(
        F.col("doc_id").alias("image_path"), F.col("lang").alias("detected_language"), F.lit(1.0).alias("language_confidence"), F.array().alias("regions"),
        F.col("n_chars").alias("processing_time"), F.lit("").alias("full_text"), fields.alias("structured_data"),
    )
    files.write_csv_quoted(files.flatten_results(results, ["quality", "toxic"]), path)
    flat = spark.read.csv(path, header=True, escape='"')
    own = [F.col(f"field_{f}").try_cast(labels.schema[f].dataType).alias(f"field_{f}") for f in ("quality", "toxic")]
    return flat.select(F.col("image_path").cast("long").alias("doc_id"), F.col("detected_language").alias("lang"), *own, F.col("processing_time").cast("long").alias("n_chars"))


@query("""select unnest(string_split(text, chr(10))) as value from benchmark""")
def snk_txt(spark, d):
    path = fresh(spark)
    files.write_text(table(spark, d, "benchmark"), "text", path)
    return spark.read.text(path, lineSep="\n")


@query("""select c_custkey, '"' || c_custkey || '","' || replace(c_name, '"', '""') || '","' || c_mktsegment || '"' as line from customer""")
def snk_csv_records(spark, d):
    return csv_lines(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"))


@query("""select event_id, '"' || event_id || '","' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","' || event_type || '","' || user_id || '"' as line from events""")
def snk_csv_audit(spark, d):
    return csv_lines(table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type", "user_id"))


@query("""select lang, printf('%.4f', avg(n_chars)) as mean, printf('%.4f', stddev_pop(n_chars)) as std, count(*) as n from documents group by lang""")
def snk_metrics_json(spark, d):
    path = fresh(spark)
    four = lambda c: F.printf(F.lit("%.4f"), c)
    made = table(spark, d, "documents").groupBy("lang").agg(four(F.avg("n_chars")).alias("mean"), four(F.stddev_pop("n_chars")).alias("std"), F.count(F.lit(1)).alias("n"))
    files.write_json_rows(made, path)
    return spark.read.schema(made.schema).json(path)


@query("""select c_custkey as id, c_name as owner_name, 'Pending' as status from customer where c_acctbal > 0
union all select s_suppkey + 1000000, s_name, case when s_acctbal > 5000 then 'Verified' else 'Pending' end from supplier where s_name <> ''""")
def snk_insert_row(spark, d):
    old = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("owner_name"), F.lit("Pending").alias("status"))
    new = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.col("s_name").alias("owner_name"), F.when(F.col("s_acctbal") > 5000, "Verified").alias("status"))
    checked = new.where(F.size(registry.missing_fields(["owner_name"])) == 0).fillna("Pending", ["status"])
    return old.unionByName(checked)


_DOC_NAME = "p_type || '.' || case p_partkey % 5 when 0 then 'PDF' when 1 then 'png' when 2 then 'exe' when 3 then 'jpeg' else 'txt' end"


@query(f"select p_partkey, {_DOC_NAME} as filename, p_retailprice as size, 'Uploaded' as status from part where p_partkey % 5 in (0, 1, 3) and p_retailprice <= 1000")
def snk_insert_doc(spark, d):
    docs = table(spark, d, "part").withColumn("filename", F.expr(_DOC_NAME.replace("||", "||")))
    extension = F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1))
    kept = docs.where(extension.isin("png", "jpg", "jpeg", "pdf") & (F.col("p_retailprice") <= 1000))
    return kept.select("p_partkey", "filename", F.col("p_retailprice").alias("size"), F.lit("Uploaded").alias("status"))


@query("""select user_id, arg_max(case event_type when 'error' then 'OCR Failed' when 'purchase' then 'OCR Completed' when 'signup' then 'Uploaded' else 'Processing' end, event_id) as status
from events group by user_id""")
def snk_status_update(spark, d):
    state = F.expr("case event_type when 'error' then 'OCR Failed' when 'purchase' then 'OCR Completed' when 'signup' then 'Uploaded' else 'Processing' end")
    return registry.latest_per_key(table(spark, d, "events").select("user_id", "event_id", state.alias("status")), "user_id", "event_id").select("user_id", "status")


@query("""select lang as language, count(*) as total, count(quality) as success, count(*) - count(quality) as failed, sum(n_chars)::bigint as time from documents left join labels using (doc_id) group by lang""")
def snk_response(spark, d):
    met = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return met.groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("total"), F.count("quality").alias("success"), (F.count(F.lit(1)) - F.count("quality")).alias("failed"), F.sum("n_chars").alias("time"))


# projections


@query("select o_orderkey, o_totalprice as amount, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as at, cast(cast(o_totalprice as decimal(12,2)) as varchar) as shown from orders")
def prj_record(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("shown"))


_BOX = "l_quantity as x1, l_discount * 100 as y1, l_quantity + 5 + l_tax * 100 as x2, l_discount * 100 + 4 + l_linenumber as y2"


def regions(spark, d):
    """Boxes of line items: an order is an image, a line a region."""
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey as image_id", "l_linenumber as line", "l_partkey", "l_suppkey", "l_returnflag as text", "1 - l_discount as confidence", *_BOX.split(", "))
    return rows.withColumn("box", F.struct("x1", "y1", "x2", "y2"))


@query(f"select l_orderkey as image_id, l_linenumber as line, l_partkey, l_returnflag as text, x1, y1, x2, y2 from (select *, {_BOX} from lineitem)")
def prj_region_flat(spark, d):
    nested = regions(spark, d).select("image_id", F.array(F.struct("line", "l_partkey", "text", F.array("x1", "y1", "x2", "y2").alias("bbox"))).alias("regions"))
    return nested.select("image_id", F.explode("regions").alias("r")).select("image_id", "r.line", "r.l_partkey", "r.text", *[F.get("r.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query(f"select l_orderkey as image_id, l_linenumber as line, l_partkey, round(x2 - x1, 6) as width, round(y2 - y1, 6) as height, round((x1 + x2) / 2, 6) as cx, round((y1 + y2) / 2, 6) as cy from (select *, {_BOX} from lineitem)")
def prj_bbox_geom(spark, d):
    corners = F.array("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")
    boxed = regions(spark, d).withColumn("b", G.box_from_numbers(corners))
    c = G.center(F.col("b"))
    return boxed.select("image_id", "line", "l_partkey", F.round(G.width(F.col("b")), 6).alias("width"), F.round(G.height(F.col("b")), 6).alias("height"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query(f"select o_orderkey, {STATUS} as status, case {STATUS} when 'Verified' then 'success' when 'Pending' then 'warning' else 'danger' end as badge from orders")
def prj_status_badge(spark, d):
    s = status()
    return table(spark, d, "orders").select("o_orderkey", s.alias("status"), F.when(s == "Verified", "success").when(s == "Pending", "warning").otherwise("danger").alias("badge"))


@query("select c_custkey, case when c_acctbal < 0 then 'KH-001' else c_name end as khatauni from customer")
def prj_default_fill(spark, d):
    gap = F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(registry.empty_to_null(gap), F.lit("KH-001")).alias("khatauni"))


@query("select event_id, case event_type when 'error' then 'Super Admin' when 'purchase' then 'Patwari' else 'Citizen' end as role from events")
def prj_role_label(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "Super Admin").when(F.col("event_type") == "purchase", "Patwari").otherwise("Citizen").alias("role"))


@query("select l_orderkey, cast(round(avg(cast(l_discount * 100 as bigint)) * 100) as bigint) as pct from lineitem group by l_orderkey")
def prj_conf_pct(spark, d):
    whole = F.round(F.avg((F.col("l_discount") * 100).cast("decimal(6,0)").cast("long")) * 100).cast("long")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(whole.alias("pct"))


@query("""select doc_id, case when n_chars < 1024 then n_chars || ' B' when n_chars < 1048576 then printf('%.1f KB', round(n_chars / 1024, 1)) else printf('%.2f MB', round(n_chars / 1048576, 2)) end as shown from documents""")
def prj_file_size(spark, d):
    n = F.col("n_chars")
    shown = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.printf(F.lit("%.1f KB"), n / 1024)).otherwise(F.printf(F.lit("%.2f MB"), n / 1048576))
    return table(spark, d, "documents").select("doc_id", shown.alias("shown"))


@query("""select o_orderkey, c_name, n_name, r_name, o_totalprice, strftime(o_orderdate, '%d-%m-%Y') as on_date from orders join customer on c_custkey = o_custkey
join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey where o_orderkey = 11""")
def prj_deed_view(spark, d):
    one = table(spark, d, "orders").where("o_orderkey = 11")
    met = one.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    met = met.join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return met.select("o_orderkey", "c_name", "n_name", "r_name", "o_totalprice", F.date_format("o_orderdate", "dd-MM-yyyy").alias("on_date"))


@query(f"select p_partkey, case when lower({_DOC_NAME}) like '%.pdf' then 'PDF' else 'IMG' end as kind from part")
def prj_doc_type(spark, d):
    named = table(spark, d, "part").withColumn("f", F.expr(_DOC_NAME))
    return named.select("p_partkey", F.when(F.lower("f").endswith(".pdf"), "PDF").otherwise("IMG").alias("kind"))


@query("""select c_custkey, 'LR-2024-' || lpad(cast(n as varchar), greatest(3, length(cast(n as varchar)))::int, '0') as seq_id, 'LOG-' || (1000 + n) as log_id
from (select c_custkey, row_number() over (order by c_custkey) n from customer)""")
def prj_seq_id(spark, d):
    both = registry.sequence_ids(table(spark, d, "customer").select("c_custkey"), "c_custkey", "LR-2024-")
    logs = registry.sequence_ids(table(spark, d, "customer").select("c_custkey"), "c_custkey", "LOG-", 1001).withColumnRenamed("seq_id", "log_id")
    return both.join(logs, "c_custkey")


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at from events")
def prj_timestamp_fmt(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("select doc_id, case lang when 'en' then '0,255,0' when 'fr' then '255,0,0' when 'de' then '0,0,255' else '255,255,255' end as colour from documents")
def prj_color_map(spark, d):
    colours = F.create_map(*[F.lit(x) for x in ("en", "0,255,0", "fr", "255,0,0", "de", "0,0,255")])
    return table(spark, d, "documents").select("doc_id", F.coalesce(colours[F.col("lang")], F.lit("255,255,255")).alias("colour"))


# filters


@query("""select c_custkey, c_name, n_name from customer join nation on n_nationkey = c_nationkey where lower(c_name) like '%#00000001%' and c_mktsegment = 'BUILDING'""")
def flt_record_search(spark, d):
    met = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return registry.search(met, {"c_name": "  #00000001 ", "n_name": ""}, {"c_mktsegment": "BUILDING", "n_name": "ALL"}).select("c_custkey", "c_name", "n_name")


@query("select event_id, event_type from events where (lower(event_type) like '%er%' or lower(cast(user_id as varchar)) like '%er%') and event_type like '%err%'")
def flt_audit_search(spark, d):
    return registry.audit_search(table(spark, d, "events"), "ER", "err", ["event_type", "user_id"], "event_type").select("event_id", "event_type")


@query("select event_id, event_type from events where event_type in ('error', 'purchase')")
def flt_role(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("error", "purchase")).select("event_id", "event_type")


@query(f"select p_partkey, {_DOC_NAME} as f from part where p_partkey % 5 in (0, 1, 3)")
def flt_allowed_ext(spark, d):
    named = table(spark, d, "part").withColumn("f", F.expr(_DOC_NAME))
    return named.where(F.lower(F.regexp_extract("f", r"\.([^.]*)$", 1)).isin("png", "jpg", "jpeg", "pdf")).select("p_partkey", "f")


@query("select p_partkey from part where p_type like 'EC%'")
def flt_image_mime(spark, d):
    return table(spark, d, "part").where(F.col("p_type").startswith("EC")).select("p_partkey")


@query("select l_orderkey as image_id, list_sort(list(l_linenumber))[1]::int as first_line, count(*) as n from lineitem where 1 - l_discount >= 0.95 group by 1")
def flt_conf_threshold(spark, d):
    return regions(spark, d).where("confidence >= 0.95").groupBy("image_id").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n"))


@query("select conv_id, string_agg(role, ' ' order by turn) as texts from conversations where role = 'user' group by conv_id")
def flt_region_lang(spark, d):
    whole = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    joined = whole.select("conv_id", F.filter("r", lambda x: x["role"] == "user").alias("r")).where(F.size("r") > 0)
    return joined.select("conv_id", F.array_join(F.transform("r", lambda x: x["role"]), " ").alias("texts"))


@query(f"""select l_orderkey as image_id, l_linenumber as line, l_partkey from (select *, {_BOX} from lineitem)
where x1 >= 0 and y1 >= 0 and x2 <= 50 and y2 <= 50 and x2 - x1 >= 8 and y2 - y1 >= 8 and 1 - l_discount >= 0.93""")
def flt_boxes(spark, d):
    b = F.col("box")
    inside = (b["x1"] >= 0) & (b["y1"] >= 0) & (b["x2"] <= 50) & (b["y2"] <= 50)
    return regions(spark, d).where(inside & (G.width(b) >= 8) & (G.height(b) >= 8) & (F.col("confidence") >= 0.93)).select("image_id", "line", "l_partkey")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where 1 - l_discount >= 0.92")
def flt_min_vote_conf(spark, d):
    return table(spark, d, "lineitem").where(1 - F.col("l_discount") >= 0.92).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select conv_id, turn, trim(text, ' ' || chr(10)) as text from conversations where trim(text, ' ' || chr(10)) <> ''")
def flt_nonblank(spark, d):
    return table(spark, d, "conversations").withColumn("text", F.btrim("text", F.lit(" \n"))).where("text <> ''").select("conv_id", "turn", "text")


@query(f"select o_orderkey from orders where {STATUS} = 'Flagged'")
def flt_status(spark, d):
    return table(spark, d, "orders").where(status() == "Flagged").select("o_orderkey")
