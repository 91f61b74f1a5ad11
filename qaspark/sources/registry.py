"""Data sets by name."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.operators import labels
from qaspark.sources import annotations as readers

READERS = {
    "csv": readers.read_qa_csv,
    "map": readers.read_qa_json_map,
    "list": readers.read_qa_json_list,
    "tables": readers.read_qa_json_tables,
    "tables_single": readers.read_qa_json_tables_single,
}


@dataclass(frozen=True)
class Split:
    annotations: str
    images: str


@dataclass(frozen=True)
class Dataset:
    """Layout and files of one data set, relative to a root folder."""

    name: str
    layout: str
    splits: dict[str, Split]
    clean_answers: bool = False
    all_splits_needed: bool = False


# Name, layout, then per split its annotation file and image folder.
DATASETS = {
    d.name: d
    for d in (
        Dataset("vivqa", "csv", {
            "train": Split("data/vivqa/train.csv", "data/vivqa/images"),
            "val": Split("data/vivqa/test.csv", "data/vivqa/images"),
        }, all_splits_needed=True),
        Dataset("vivqa-addon", "csv", {
            "train": Split("data/vivqa/train_addon.csv", "data/vivqa/addon_images"),
            "val": Split("data/vivqa/test.csv", "data/vivqa/addon_images"),
        }, all_splits_needed=True),
        Dataset("openvivqa", "map", {
            "train": Split("data/openvivqa/vlsp2023_train_data.json", "data/openvivqa/training-images"),
            "val": Split("data/openvivqa/vlsp2023_dev_data.json", "data/openvivqa/dev-images"),
        }, clean_answers=True, all_splits_needed=True),
        Dataset("vitextvqa", "tables", {
            "train": Split("data/vitextvqa/ViTextVQA_train.json", "data/vitextvqa/images"),
            "val": Split("data/vitextvqa/ViTextVQA_dev.json", "data/vitextvqa/images"),
            "test": Split("data/vitextvqa/ViTextVQA_test.json", "data/vitextvqa/images"),
        }),
        Dataset("evjvqa", "tables_single", {
            "train": Split("data/evjvqa/evjvqa_train.json", "data/evjvqa/images"),
            "val": Split("data/evjvqa/evjvqa_val.json", "data/evjvqa/images"),
            "test": Split("data/evjvqa/evjvqa_test.json", "data/evjvqa/images"),
        }),
        Dataset("vivqax", "list", {
            "train": Split("data/vivqax/ViVQA-X_train.json", "data/MSCOCO/train2014"),
            "val": Split("data/vivqax/ViVQA-X_val.json", "data/MSCOCO/val2014"),
            "test": Split("data/vivqax/ViVQA-X_test.json", "data/MSCOCO/val2014"),
        }),
        Dataset("vivqax-addon", "list", {
            "train": Split("data/vivqax/ViVQA-X_train_addon.json", "data/MSCOCO/train2014"),
            "val": Split("data/vivqax/ViVQA-X_val.json", "data/MSCOCO/val2014"),
            "test": Split("data/vivqax/ViVQA-X_test.json", "data/MSCOCO/val2014"),
        }),
        Dataset("viocrvqa", "tables", {
            "train": Split("data/viocrvqa/train.json", "data/viocrvqa/images"),
            "val": Split("data/viocrvqa/dev.json", "data/viocrvqa/images"),
            "test": Split("data/viocrvqa/test.json", "data/viocrvqa/images"),
        }),
    )
}


def register_dataset(dataset: Dataset) -> None:
    if dataset.layout not in READERS:
        raise ValueError(f"unknown layout {dataset.layout}; known: {', '.join(READERS)}")
    DATASETS[dataset.name] = dataset


def dataset(name: str) -> Dataset:
    if name not in DATASETS:
        raise ValueError(f"unknown data set {name}; known: {', '.join(DATASETS)}")
    return DATASETS[name]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything on its file system."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    matches = system.globStatus(hadoop_path)
    return bool(matches)


def read_split(spark: SparkSession, name: str, split: str, root: str = ".") -> DataFrame:
    """One split with ``dataset`` and ``split`` columns."""
    source = dataset(name)
    if split not in source.splits:
        raise ValueError(f"{name} has no split {split}")
    where = source.splits[split]
    rows = READERS[source.layout](spark, f"{root}/{where.annotations}", f"{root}/{where.images}")
    if source.clean_answers:
        rows = labels.clean_answers(rows)
    return rows.select(F.lit(name).alias("dataset"), F.lit(split).alias("split"), *rows.columns)


def read_dataset(spark: SparkSession, name: str, root: str = ".") -> DataFrame:
    """All splits whose files exist; a data set that needs all of them fails on a missing one."""
    source = dataset(name)
    present = [
        s for s in source.splits
        if source.all_splits_needed or path_exists(spark, f"{root}/{source.splits[s].annotations}")
    ]
    if not present:
        raise FileNotFoundError(f"no split of {name} under {root}")
    rows = reduce(DataFrame.unionByName, [read_split(spark, name, s, root) for s in present])
    # Numbered after the union: no two splits share an id.
    return rows.withColumn("row_idx", F.monotonically_increasing_id())


def fit_dataset_encoder(spark: SparkSession, name: str, root: str = ".") -> DataFrame:
    """The answer encoder over all present splits."""
    return labels.fit_encoder(read_dataset(spark, name, root).filter(F.col("answer").isNotNull()))
