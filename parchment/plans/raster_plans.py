"""Queries on grids made of boxes, and on plug-ins by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.operators import plugins, raster
from parchment.plans.common import table
from parchment.plans.registry_plans import _BOX, regions
from parchment.plans.relational_plans import predictions

QUERIES, ORACLE_SQL = {}, {}

WIDTH, HEIGHT, CELL = 32, 12, 2.0


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"""with b as (select l_returnflag as flag, least(31, floor(x1 / 2))::int as a, least(11, floor(y1 / 2))::int as b, least(31, floor(x2 / 2))::int as c, least(11, floor(y2 / 2))::int as d
  from (select l_returnflag, {_BOX} from lineitem) where x1 < 64 and y1 < 24),
n as (select flag, x, unnest(range(b, d + 1)) as y from (select flag, b, d, unnest(range(a, c + 1)) as x from b)),
c as (select flag, x, y, count(*) as n from n group by all)
select f.flag, y.y::int as y, x.x::int as x, coalesce(n, 0) as n from (select distinct l_returnflag as flag from lineitem) f, range(12) y(y), range(32) x(x) left join c on c.flag = f.flag and c.x = x.x and c.y = y.y""")
def img_heatmap(spark, d):
    """How many boxes of each kind of region cover each cell."""
    grids = raster.density(regions(spark, d).withColumnRenamed("text", "flag"), "flag", WIDTH, HEIGHT, CELL)
    rows = grids.select("flag", F.posexplode("grid").alias("y", "row"))
    return rows.select("flag", "y", F.posexplode("row").alias("x", "n"))


def grey(spark, d):
    """(image_id, grid): images of the boxes of an order, darker where more boxes lie on each other."""
    return raster.density(regions(spark, d), "image_id", WIDTH, HEIGHT, CELL).select("image_id", raster.shaded(F.col("grid")).alias("grid"))


@query(None)
def img_binarize(spark, d):
    """Otsu's level, and how many cells are ink by it and by Sauvola's."""
    return grey(spark, d).select("image_id", raster.binarized(F.col("grid"), WIDTH, HEIGHT).alias("b")).select("image_id", "b.*")


@query("""with r as (select l_orderkey as image_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as k, l_quantity::int % 9 as q from lineitem)
select image_id * 1000 + k // 32 as image_id, (k // 8 % 4 * 16 + q)::bigint as x1, (k % 8 * 3)::bigint as y1, (k // 8 % 4 * 16 + q + k % 5)::bigint as x2, (k % 8 * 3 + 1)::bigint as y2 from r""")
def det_regions(spark, d):
    """Boxes found in images in which up to 32 boxes each were drawn that don't touch."""
    k, q = F.col("ord") - 1, F.col("box.x1").cast("int") % 9
    across = F.floor(k / 8) % 4 * 16 + q
    image = (F.col("image_id") * 1000 + F.floor(k / 32)).alias("image_id")
    drawn = predictions(spark, d).select(image, across.alias("x1"), (k % 8 * 3).alias("y1"), (across + k % 5).alias("x2"), (k % 8 * 3 + 1).alias("y2"))
    found = raster.density(drawn, "image_id", 64, 24).select("image_id", F.inline(raster.ink_boxes(F.col("grid"))))
    return found.select("image_id", *[F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("select distinct l_orderkey as image_id, (l_orderkey % 21 - 10)::double as angle from lineitem")
def img_deskew(spark, d):
    """The turn of images whose lines were turned by known angles."""
    turned = F.radians((F.col("image_id") % 21 - 10).cast("double"))
    places = F.explode(F.array(*[F.lit(40.0 * i) for i in range(5)]))
    flat = regions(spark, d).select("image_id", (F.col("line") * 20.0).alias("v"), places.alias("u"))
    points = flat.select("image_id", (F.col("u") * F.cos(turned) - F.col("v") * F.sin(turned)).alias("x"), (F.col("u") * F.sin(turned) + F.col("v") * F.cos(turned)).alias("y"))
    return raster.skew(points, "image_id", [float(a) for a in range(-15, 16)])


@query("""with t as (select conv_id, turn, trim(l, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) as text, i from (select conv_id, turn, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i
  from conversations where conv_id % 2 = 0))
select 'lines' as plugin, conv_id as image_id, (row_number() over (partition by conv_id order by turn, i) - 1)::int as seq, text, round(least(0.95, 0.5 + 0.01 * length(text)), 6) as confidence from t where text <> ''
union all
select 'whole', conv_id, turn::int, trim(text, ' ' || chr(10)), round(least(0.95, 0.5 + 0.01 * length(trim(text, ' ' || chr(10)))), 6) from conversations where conv_id % 2 <> 0 and trim(text, ' ' || chr(10)) <> ''""")
def rec_by_name(spark, d):
    """Conversations as images of turns, read by the recogniser that each names."""
    c = table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("image_id"), F.col("turn").alias("place"), "text", F.when(F.col("conv_id") % 2 == 0, "Lines").otherwise("WHOLE").alias("by"))
    return plugins.apply_by_name(rows, "recognizer", "by", ["lines", "whole"]).withColumn("confidence", F.round("confidence", 6))
