"""Corpus preparation: stages that each apply one training-data operator to what the one before kept.

Quality classifier, line dedup, SimHash near-dedup, suffix-array dedup, best-fit packing. Every stage but the last
returns the columns of ``documents``. Rows are matched by id and text hash, so rows with a null or repeated id go through
like others; a text that a stage changes gets its new ``n_chars``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.llm import line_dedup, packing, quality_classifier, simhash, suffix_dedup
from qaspark.llm.common import flat_map_rows, pick
from qaspark.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _documents(docs: DataFrame) -> DataFrame:
    return pick(docs, **{name: name for name in COLUMNS}).select(
        *(F.col(name).cast(kind) for name, kind in zip(COLUMNS, ("bigint", "string", "string", "string", "bigint"))))


def _keyed(docs: DataFrame, **more: str) -> DataFrame:
    """Documents with the keys that the operators name rows by."""
    return _documents(docs).withColumns({name: F.expr(sql) for name, sql in more.items()})


def _matched(docs: DataFrame, found: DataFrame, hash_name: str, how: str) -> DataFrame:
    own, other = docs.alias("d"), found.withColumnsRenamed({"doc_id": "f_id", hash_name: "f_hash"})
    return own.join(other, F.col("d.doc_id").eqNullSafe(F.col("f_id")) & (F.col(f"d.{hash_name}") == F.col("f_hash")), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more.

    It is trained on the labelled documents of the whole table, not on what is left of them, outside the held-out fold.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    own = _documents(docs)

    def judge(doc_id: int | None, text: str | None, *rest) -> list[tuple]:
        good = model.score(quality_classifier.features((text or "").encode())) >= 0.5
        return [(doc_id, text, *rest)] if good else []

    return flat_map_rows(own, judge, SCHEMA)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first of them only; a document without any line left goes."""
    bitmaps = line_dedup.keep_bitmaps(docs, min_docs=10, keep="first", min_chars=1)
    found = _matched(_keyed(docs, text_hash="xxhash64(coalesce(text, ''))"), bitmaps, "text_hash", "left")

    def cut(doc_id: int | None, text: str | None, lang: str | None, source: str | None, n_chars: int | None, keep: bytes | None) -> list[tuple]:
        if keep is None:
            return [(doc_id, text, lang, source, n_chars)]
        kept = line_dedup.kept_text((text or "").encode(), keep)[0].decode()
        return [(doc_id, kept, lang, source, len(kept))] if kept.strip() else []

    return flat_map_rows(found.select(*COLUMNS, "keep"), cut, SCHEMA)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id (then text hash).

    Near copies differ in two bits of the fingerprint or share 80 % of their five-word shingles.
    """
    first = simhash.near_groups(docs, similar=80, similar_size=5).filter("first").select("doc_id", "text_hash")
    own = _keyed(docs, text_hash="xxhash64(coalesce(text, ''))")
    kept = _matched(own, first.distinct(), "text_hash", "left_semi")
    return kept.dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that are also elsewhere; whole code points stay."""
    found = suffix_dedup.spans(docs, length=200).groupBy("doc_id", "text_hash").agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    own = _matched(_keyed(docs, text_hash=suffix_dedup.TEXT_HASH), found, "text_hash", "left")

    def cut(doc_id: int | None, text: str | None, lang: str | None, source: str | None, n_chars: int | None,
            starts: list[int] | None, stops: list[int] | None) -> list[tuple]:
        if not starts:
            return [(doc_id, text, lang, source, n_chars)]
        whole = (text or "").encode()
        removed = suffix_dedup.merge_spans(starts, stops, len(whole))
        # Bytes of a cut code point go with the passage.
        kept = suffix_dedup.remaining(whole, removed).decode("utf-8", "ignore")
        return [(doc_id, kept, lang, source, len(kept))] if kept.strip() else []

    return flat_map_rows(own.select(*COLUMNS, "starts", "stops"), cut, SCHEMA)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining texts with their sequences of 2048."""
    return packing.pack_documents(docs, capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", passages),
    ("best_fit_packing", pack),
]

#: Learned scores and tokenizers are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
