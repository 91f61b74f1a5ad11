"""Annotation files to one typed table.

Every reader accepts a file, a folder of files or a glob. A JSON document is parsed by one task, as
the format demands; sharded copies (one document per file, or one per line with
``multi_line=False``) are read in parallel, and ``land`` writes the result to Parquet once so that
later scans split freely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaspark.functions.paths import join_path, zero_fill
from qaspark.operators.labels import first_answers
from qaspark.operators.lookups import attach_images

SAMPLES = T.StructType([
    T.StructField("row_idx", T.LongType()),
    T.StructField("question_id", T.StringType()),
    T.StructField("image_id", T.StringType()),
    T.StructField("img_path", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("answers", T.ArrayType(T.StringType())),
    T.StructField("explanations", T.ArrayType(T.StringType())),
])

CSV_COLUMNS = ("question", "answer", "img_id")

MAP_SCHEMA = (
    "images map<string, string>,"
    "annotations map<string, struct<image_id: string, question: string, answer: string>>"
)
LIST_SCHEMA = (
    "question string, image_id string, image_name string, explanation array<string>,"
    "answer string, question_id string"
)
TABLES_SCHEMA = (
    "images array<struct<id: string, filename: string>>,"
    "annotations array<struct<id: string, image_id: string, question: string, {answer}>>"
)


def _samples(df: DataFrame) -> DataFrame:
    """Bring a reader's rows to the common columns, in order, with nulls for what a layout lacks."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in SAMPLES
    ])


def _numbered(df: DataFrame) -> DataFrame:
    """Number rows in file order: dense within one document, unique across many."""
    return df.withColumn("row_idx", F.monotonically_increasing_id())


def _document(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    """Documents of a path: one per file, or one per line for sharded copies of a layout."""
    read = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    if "images" not in read.columns:
        return read
    other = F.raise_error(F.lit(f"neither images nor annotations in a document of {path}")).cast("boolean")
    return read.filter(F.when(F.col("images").isNotNull() | F.col("annotations").isNotNull(), F.lit(True)).otherwise(other))


def read_qa_csv(spark: SparkSession, path: str, img_dir: str = "", multi_line: bool = True) -> DataFrame:
    """Columns ``question, answer, img_id`` by name; the image file is the zero-filled id.

    Records with line breaks inside quotes make a file one task; ``multi_line=False`` splits files whose records
    are one line each. A malformed record fails the read.
    """
    raw = (
        spark.read.option("header", True).option("multiLine", multi_line).option("mode", "FAILFAST")
        .option("quote", '"').option("escape", '"').csv(path)
    )
    missing = [c for c in CSV_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    number = F.trim("img_id").try_cast("bigint").cast("string")
    image = F.coalesce(number, F.trim("img_id"))
    return _samples(
        _numbered(raw)
        .withColumn("image_id", image)
        .withColumn("img_path", join_path(F.lit(img_dir), F.concat(zero_fill(image), F.lit(".jpg"))))
    )


def read_qa_json_map(
    spark: SparkSession, path: str, img_dir: str = "", on_missing: str = "error", multi_line: bool = True
) -> DataFrame:
    """``{"images": {id: file}, "annotations": {id: {...}}}``; every image must be listed."""
    document = _document(spark, path, MAP_SCHEMA, multi_line)
    images = document.select("*", F.input_file_name().alias("_file")).select(
        "_file", F.posexplode("images").alias("_pos", "image_id", "filename")
    ).select(F.struct("_file", "_pos").alias("pos"), "image_id", "filename")
    rows = _numbered(document.select(F.explode("annotations").alias("question_id", "a")))
    rows = rows.select("row_idx", "question_id", "a.*")
    return _samples(_with_path(attach_images(rows, images, on_missing), img_dir))


def read_qa_json_list(
    spark: SparkSession, path: str, img_dir: str = "", multi_line: bool = True
) -> DataFrame:
    """A top-level array of records that name their image file."""
    rows = _numbered(_document(spark, path, LIST_SCHEMA, multi_line))
    return _samples(
        rows.withColumn("img_path", join_path(F.lit(img_dir), F.col("image_name")))
        .withColumnRenamed("explanation", "explanations")
    )


def explanation_text(explanations: Column) -> Column:
    return F.array_join(explanations, " | ")


def _read_tables(spark: SparkSession, path: str, answer: str, multi_line: bool) -> tuple[DataFrame, DataFrame]:
    document = _document(spark, path, TABLES_SCHEMA.format(answer=answer), multi_line)
    images = document.select("*", F.input_file_name().alias("_file")).select(
        "_file", F.posexplode("images").alias("_pos", "image")
    ).select(F.struct("_file", "_pos").alias("pos"), F.col("image.id").alias("image_id"), "image.filename")
    rows = _numbered(document.select(F.explode("annotations").alias("a")))
    return rows.select("row_idx", F.col("a.id").alias("question_id"), "a.*").drop("id"), images


def _with_path(df: DataFrame, img_dir: str) -> DataFrame:
    return df.withColumn("img_path", join_path(F.lit(img_dir), F.col("filename")))


def read_qa_json_tables(
    spark: SparkSession, path: str, img_dir: str = "", multi_line: bool = True
) -> DataFrame:
    """Image and annotation arrays, several answers each: the first counts, rows without any are left out.

    The filter works on whole rows, so questions and answers stay aligned.
    """
    rows, images = _read_tables(spark, path, "answers: array<string>", multi_line)
    return _samples(_with_path(attach_images(first_answers(rows), images), img_dir))


def read_qa_json_tables_single(
    spark: SparkSession, path: str, img_dir: str = "", multi_line: bool = True
) -> DataFrame:
    """As ``read_qa_json_tables`` with one ``answer`` per annotation and no row left out."""
    rows, images = _read_tables(spark, path, "answer: string", multi_line)
    return _samples(_with_path(attach_images(rows, images), img_dir))


def read_qa(spark: SparkSession, path: str, img_dir: str = "") -> DataFrame:
    """The default layouts by file extension."""
    if path.endswith(".csv"):
        return read_qa_csv(spark, path, img_dir)
    if path.endswith(".json"):
        return read_qa_json_map(spark, path, img_dir)
    raise ValueError(f"unsupported annotation file: {path}")


def land(samples: DataFrame, path: str) -> DataFrame:
    """Write samples as Parquet by data set and split, and read them back."""
    samples.write.partitionBy("dataset", "split").parquet(path)
    return samples.sparkSession.read.parquet(path)
