"""Plans keep what large inputs need: narrow work, pruned scans, no Python, no one-task windows."""

import pytest
from pyspark.sql import functions as F

from qaspark.operators import lookups
from qaspark.plans import load_catalog
from qaspark.plans.views import view
from qaspark.session import materialize, scratch_root

SF_DIR = "/root/testdata/sf0.001"
QUERIES, _ = load_catalog()
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "MapInArrow")
PYTHON_QUERIES = {"failed_rows", "chat_replies", "masked_rasters", "region_file_round_trip", "fusion_classifier", "applied_difficulty", "augmented_epochs",
                  "blurred_rasters"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {name: plan(q(spark, SF_DIR)) for name, q in QUERIES.items() if not name.startswith("stream_")}


def test_no_cartesian_product_and_no_single_task_window(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        for line in text.splitlines():
            if " Window [" in line or "+- Window" in line:
                assert "], [" in line, f"{name}: {line}"  # a partition list follows the expressions


def test_python_only_where_needed(plans):
    for name, text in plans.items():
        if name not in PYTHON_QUERIES:
            assert not any(node in text for node in PYTHON_NODES), name


def test_narrow_operators_do_not_shuffle_rows(plans):
    for name in ("schedule_linear", "mask_ratios", "kept_boxes", "best_classes", "predictions", "trimmed_text", "image_paths"):
        moved = [line for line in plans[name].splitlines() if "Exchange" in line and "RoundRobin" not in line]
        assert not moved, name


def test_scans_read_only_needed_columns(plans):
    scan = next(line for line in plans["missing_work"].splitlines() if "ReadSchema" in line)
    assert "o_totalprice" not in scan.split("ReadSchema")[1]
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plans["missing_work"]


def test_top_k_is_distributed(plans):
    assert "TakeOrderedAndProject" in plans["hard_samples"]


def test_samples_are_filters(plans):
    for name in ("sampled_rows", "sampled_large"):
        assert "TakeOrdered" not in plans[name] and "Sort" not in plans[name], name


def test_rasters_are_read_once(plans):
    assert plans["masked_rasters"].count("Scan parquet") == 1


def test_rasters_are_not_broadcast(plans):
    assert "Broadcast" not in plans["blurred_rasters"]


def test_sentences_are_dealt_out(plans):
    for name in ("tagged_tokens", "synonym_usage", "paraphrase_synonym", "paraphrase_candidates", "paraphrase_views", "expanded_views",
                 "augmented_epochs"):
        assert "RoundRobinPartitioning" in plans[name], name


def test_encoders_are_joined(plans):
    for name in ("wrong_records", "top5_predictions", "observations"):
        assert "map_from_entries" not in plans[name], name


def test_results_do_not_depend_on_shuffle_partitions(spark):
    names = ("template_stats", "label_encoder", "group_split", "early_stops", "paraphrase_views")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for partitions in ("1", "5"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            results.append([sorted(map(str, QUERIES[n](spark, SF_DIR).collect())) for n in names])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_hot_keys_are_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    key = F.when(F.col("id") % 3 != 0, F.lit(0)).otherwise(F.col("id") % 1000).alias("image_id")
    rows = spark.range(0, 200_000, 1, 8).select(key, F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    answers = rows.select(F.col("image_id").cast("string").alias("answer"), "pad")
    images = rows.select("image_id", F.lit("f").alias("filename"), F.lit(0).alias("pos"))
    encoder = answers.select("answer").distinct().withColumn("label", F.xxhash64("answer"))
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        for joined in (lookups.attach_images(rows, images), lookups.encode_answers(answers, encoder)):
            assert len(joined.collect()) == 200_000
            assert "skew=true" in plan(joined)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class _Session:
    """A session without the checkpoint setting."""

    def __init__(self, spark, master):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        context = type("Context", (), {})()
        context.master, context.folder = master, None
        context.getCheckpointDir = lambda: context.folder
        context.setCheckpointDir = lambda folder: setattr(context, "folder", folder)
        self.sparkContext = context


def test_scratch_follows_the_session_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    stored = materialize(view(spark, SF_DIR, "qa_echo"), "echo")
    assert stored.count() > 0
    if configured:
        assert all(configured.removeprefix("file:") in f for f in stored.inputFiles())
    local = _Session(spark, "local[2]")
    assert scratch_root(local) == scratch_root(local) == local.sparkContext.folder
    with pytest.raises(ValueError):
        scratch_root(_Session(spark, "spark://host:7077"))
