"""Readers of the file layouts that recognition runs leave, and writers of theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_TYPES = ("jpg", "jpeg", "png", "tiff", "bmp", "webp")
BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x1", "y1", "x2", "y2")])
REGION = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("language", T.StringType()), T.StructField("script", T.StringType()), T.StructField("model_source", T.StringType()),
    T.StructField("polygon", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
RESULT = T.StructType([
    T.StructField("image_path", T.StringType()), T.StructField("regions", T.ArrayType(REGION)), T.StructField("full_text", T.StringType()),
    T.StructField("detected_language", T.StringType()), T.StructField("language_confidence", T.DoubleType()),
    T.StructField("processing_time", T.DoubleType()), T.StructField("model_used", T.StringType()),
    T.StructField("structured_data", T.MapType(T.StringType(), T.StructType([T.StructField("value", T.StringType()), T.StructField("confidence", T.DoubleType())]))),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("timestamp", T.StringType()),
])
SIDECAR = T.StructType([
    T.StructField("full_text", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StructType([T.StructField("value", T.StringType()), T.StructField("confidence", T.DoubleType())]))),
])
ANNOTATION = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("file_name", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("language", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType())),
])


def stem(path):
    """The file name without its last extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def list_files(spark: SparkSession, folder: str, types=IMAGE_TYPES, recursive: bool = False) -> DataFrame:
    """(path, name, stem, length) of the files of these types, upper or lower case; contents are not read."""
    either = ",".join(t for x in types for t in dict.fromkeys((x, x.upper())))
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{either}}}").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), stem(F.col("path")).alias("stem"), "length")


def read_contents(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(folder, stem, text) of each file that fits the pattern, whole."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    path = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(path, r"^(.*)/", 1).alias("folder"), stem(path).alias("stem"), F.col("value").alias("text"))


def read_test_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Images with their reference text: X.txt is needed, X.lang gives the language (else the folder's name if it has two
    letters, else hi), X.json the fields; JSON that can't be read counts as absent."""
    images = list_files(spark, folder, recursive=True).select("path", F.regexp_extract("path", r"^(.*)/", 1).alias("folder"), "stem")
    images = images.withColumn("folder", F.regexp_replace("folder", "^file:/+", "/"))

    def side(suffix: str, name: str) -> DataFrame:
        got = read_contents(spark, folder, f"*.{suffix}").withColumn("folder", F.regexp_replace("folder", "^file:/+", "/"))
        return got.withColumnRenamed("text", name)

    met = images.join(side("txt", "reference"), ["folder", "stem"]).join(side("lang", "_lang"), ["folder", "stem"], "left").join(side("json", "_json"), ["folder", "stem"], "left")
    parent = F.element_at(F.split("folder", "/"), -1)
    return met.select(
        "path", "stem", F.trim("reference").alias("reference"),
        F.coalesce(F.nullif(F.trim("_lang"), F.lit("")), F.when(F.length(parent) == 2, parent), F.lit("hi")).alias("lang"), F.from_json("_json", SIDECAR)["fields"].alias("fields"),
    )


def read_annotations(spark: SparkSession, coco: str | None = None, lines: str | None = None) -> DataFrame:
    """Annotations of a COCO-style file, of JSON lines, or of both one after the other."""
    parts = []
    if coco:
        whole = spark.read.schema(T.StructType([T.StructField("annotations", T.ArrayType(ANNOTATION))])).json(coco, multiLine=True)
        parts.append(whole.select(F.inline("annotations")))
    if lines:
        parts.append(spark.read.schema(ANNOTATION).json(lines))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results as JSON, one a file or one a line, with defaults for what is missing."""
    got = spark.read.schema(RESULT).json(path, multiLine=False)
    defaults = {"full_text": "", "detected_language": "", "language_confidence": 0.0, "processing_time": 0.0, "model_used": ""}
    return got.fillna(defaults).withColumn("regions", F.coalesce("regions", F.expr(f"cast(array() as {REGION.simpleString().join(['array<', '>'])})")))


def load_schema(path: str) -> dict:
    """Fields of a schema file in JSON or YAML; none where it is neither. A missing file, or YAML without a reader for it
    installed, is an error."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        whole = json.loads(text)
    except ValueError:
        import yaml

        try:
            whole = yaml.safe_load(text)
        except yaml.YAMLError:
            return {}
    fields = whole.get("fields") if isinstance(whole, dict) else None
    return fields if isinstance(fields, dict) else {}


def read_or_seed(spark: SparkSession, path: str, seed: DataFrame) -> DataFrame:
    """JSON lines at a path, or the seed where there is nothing."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    found = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    return spark.read.schema(seed.schema).json(path) if found else seed


def write_json_rows(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a line; mode append adds files to those there."""
    df.write.mode(mode).json(path)


def write_documents(df: DataFrame, key: str, path: str) -> None:
    """One JSON file for each row, in a folder named by its key, as COCO-style files are one object each."""
    df.write.partitionBy(key).json(path)


def write_csv_quoted(df: DataFrame, path: str) -> None:
    """CSV with a header and every value in quotes, quotes inside doubled."""
    df.write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.text(path)


def csv_line(*columns):
    """A CSV line with every value in quotes, as a column."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return F.concat_ws(",", *quoted)


def flatten_results(results: DataFrame, fields: list[str]) -> DataFrame:
    """Results with field_<f> and field_<f>_conf for a fixed list of fields, the same columns for every row."""
    base = ["image_path", "detected_language", "language_confidence", F.size("regions").alias("num_regions"), "processing_time", "full_text"]
    own = [c for f in fields for c in (F.col("structured_data")[f]["value"].alias(f"field_{f}"), F.col("structured_data")[f]["confidence"].alias(f"field_{f}_conf"))]
    return results.select(*base, *own)
