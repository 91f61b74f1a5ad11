"""Schedules, regions, vectors, evaluation, chat and streams on small fixtures."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from qaspark.functions import boxes as B
from qaspark.functions import curriculum as C
from qaspark.functions import paths
from qaspark.operators import chat, evaluate, labels, lookups, regions, scan, schedules, vectors
from qaspark.sinks import reports
from qaspark.streaming import metrics as streams


def formula(strategy, e, total, gamma=0.1, power=2.0):
    last = max(total - 1, 1)
    return {
        "linear": e / last, "cosine": (1 - math.cos(math.pi * e / last)) / 2,
        "exponential": 1 - gamma ** ((total - e) / total), "step": min(e // (total // 3) * gamma, 1.0),
        "polynomial": (e / last) ** power,
    }[strategy]


@pytest.mark.parametrize("total", [3, 30])
def test_schedules(spark, total):
    table = schedules.schedule_table(spark, [C.Schedule(total, s) for s in C.STRATEGIES])
    for r in table.collect():
        assert r.difficulty == pytest.approx(formula(r.strategy, r.epoch, total), abs=1e-12)
    assert C.Schedule(30).key_epochs == [0, 7, 15, 22, 29]


def test_schedule_checks(spark):
    for bad in ({"strategy": "x"}, {"min_difficulty": 0.9, "max_difficulty": 0.1}, {"warmup_epochs": 30}, {"strategy": "step", "step_size": 0}):
        with pytest.raises(ValueError):
            C.Schedule(30, **bad)
    with pytest.raises(ValueError):
        C.Schedule(2, "step")
    falling = [r.difficulty for r in schedules.schedule_table(spark, [C.Schedule(10, "exponential")]).orderBy("epoch").collect()]
    rising = [r.difficulty for r in schedules.schedule_table(spark, [C.Schedule(10, "exponential", reverse=True)]).orderBy("epoch").collect()]
    assert falling == sorted(falling, reverse=True) and rising == sorted(rising) and falling[0] == pytest.approx(0.9)


def fold(values, threshold=0.01):
    last, out = None, []
    for v in values:
        if last is None or abs(v - last) > threshold:
            last = v
        out.append(last)
    return out


def log_of(spark, runs):
    return spark.createDataFrame([(r, e, v) for r, vs in runs.items() for e, v in enumerate(vs)], "run_id string, epoch bigint, difficulty double")


def test_applied_difficulty(spark):
    random.seed(1)
    runs = {f"r{i}": [random.random() * 0.05 for _ in range(50)] for i in range(4)}
    got = schedules.applied_difficulty(log_of(spark, runs).repartition(3)).collect()
    assert len(got) == 200
    assert all(r.applied == fold(runs[r.run_id])[r.epoch] for r in got)


def test_paths(spark):
    names = ["a/COCO_val2014_000000123456.jpg", "x.tar.gz", ".hidden", "plain", "d/.b.txt"]
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    got = rows.select(paths.stem(F.col("p")), paths.bare_id(F.col("p")), paths.first_dot_id(F.col("p"))).collect()
    import os
    assert [r[0] for r in got] == [os.path.splitext(os.path.basename(n))[0] for n in names]
    assert got[0][1] == "000000123456" and got[1][2] == "x"


def test_strict_lookups(spark):
    encoder = spark.createDataFrame([("a", 0), ("b", 1)], "answer string, label bigint")
    rows = spark.createDataFrame([("a",), ("c",), (None,)], "answer string")
    with pytest.raises(Exception, match="no label for answer"):
        lookups.encode_answers(rows, encoder).collect()
    assert lookups.encode_answers(rows, encoder, "drop").count() == 1
    assert lookups.encode_answers(rows, encoder, "keep").count() == 3
    with pytest.raises(ValueError):
        lookups.encode_answers(rows, encoder, "ignore")


def iou(a, b):
    w = max(0, min(a[2], b[2]) - max(a[0], b[0]) + 1)
    h = max(0, min(a[3], b[3]) - max(a[1], b[1]) + 1)
    area = lambda r: (r[2] - r[0] + 1) * (r[3] - r[1] + 1)
    return w * h / (area(a) + area(b) - w * h)


def test_suppression_matches_brute_force(spark):
    random.seed(2)
    data, best = [], {}
    for img in range(6):
        for cls in range(3):
            found = []
            for box in range(12):
                x, y = random.randint(0, 40), random.randint(0, 40)
                found.append((random.randint(1, 9) / 10, box, (float(x), float(y), float(x + 20), float(y + 20))))
                data.append((img, box, cls, found[-1][0], *found[-1][2]))
            kept = []
            for score, box, place in sorted(found, key=lambda f: (-f[0], f[1])):
                if cls >= 1 and all(iou(place, k[2]) <= B.NMS_OVERLAP for k in kept):
                    kept.append((score, box, place))
            for score, box, _ in kept:
                best[img, box] = max(best.get((img, box), 0.0), score)
    shape = "img_id int, box_idx int, class_id int, score double, x1 double, y1 double, x2 double, y2 double"
    got = regions.max_confidence(spark.createDataFrame(data, shape).repartition(5)).collect()
    assert {(r.img_id, r.box_idx): r.max_conf for r in got} == {(i, b): best.get((i, b), 0.0) for i in range(6) for b in range(12)}


@pytest.mark.parametrize("confs, kept", [
    ([0.1, 0.15, 0.05], [1, 0]), ([0.9, 0.1, 0.3, 0.2], [0, 2, 3]), ([0.5, 0.6, 0.7, 0.8, 0.9], [4, 3, 2, 1]), ([0.3, 0.3, 0.1], [0, 1]),
])
def test_box_limits(spark, confs, kept):
    df = spark.createDataFrame([(1, confs)], "img_id int, confs array<double>")
    assert [r.box_idx for r in regions.select_boxes(df, 0.2, 2, 4).collect()] == kept


def test_class_search(spark):
    objects = spark.createDataFrame([(0, "Red Car"), (1, "cart"), (2, "dog")], "id bigint, name string")
    seen = spark.createDataFrame([(i, i % 3) for i in range(60)], "row_idx bigint, object_id bigint")
    found = regions.search_class(seen, objects, "CAR")
    assert found.count() == 40
    line = regions.search_report(found, "CAR").first().report
    assert line.startswith("Found 40 images with 'CAR'. Indices: 0, 1, 3, 4") and line.endswith("...")
    assert regions.search_class(seen, objects, "").count() == 0
    none = regions.search_report(regions.search_class(seen, objects, "zebra"), "zebra").first().report
    assert none == "No images found containing 'zebra'"


def test_row_lookup(spark):
    df = spark.range(5).select(F.col("id").alias("row_idx"))
    assert regions.row_at(df, 3).count() == 1 and regions.row_at(df, 5).count() == 0 and regions.row_at(df, -1).count() == 0


def test_pooling_checks(spark):
    df = spark.createDataFrame([(1, i, [1.0, float(i)]) for i in range(11)], "item int, view_idx int, vector array<double>")
    with pytest.raises(ValueError, match="mean"):
        vectors.pool_views(df, "median", 2)
    with pytest.raises(Exception, match="not 3 elements"):
        vectors.pool_views(df, "mean", 3).collect()
    uneven = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [1.0, 2.0]), (2, 0, None)], df.schema)
    with pytest.raises(Exception, match="differ in size"):
        vectors.pool_views(uneven, "sum").collect()
    assert vectors.pool_views(uneven.filter("item = 2"), "sum").first().pooled == []
    with pytest.raises(Exception, match="more than 10 views"):
        vectors.pool_weighted(df, 2).collect()
    assert vectors.pool_weighted(df.filter("view_idx < 10"), 2).first().pooled == pytest.approx([1.0, 4.5])


def test_top_predictions_and_unknown_labels(spark):
    encoder = spark.createDataFrame([(0, "x"), (1, "y")], "label int, answer string")
    shape = "row_idx bigint, epoch int, logits array<double>, ground_truth int, question string, img_path string"
    rows = spark.createDataFrame([(0, 1, [0.5, 0.5, 0.9], 0, "q", "p"), (1, 1, [0.9, 0.5, 0.5], 0, "q", "p")], shape)
    wrong = evaluate.wrong_records(evaluate.with_prediction(rows), encoder).collect()
    assert [(t.rank, t.answer, t.label) for t in wrong[0].top5_predictions] == [(1, "unknown_2", 2), (2, "x", 0), (3, "y", 1)]
    assert len(wrong) == 1 and wrong[0].model_prediction == "unknown_2" and wrong[0].ground_truth == "x"
    text = "\n".join(r.text for r in reports.wrong_summary(evaluate.wrong_records(evaluate.with_prediction(rows), encoder)).orderBy("block").collect())
    assert "Total wrong predictions: 1" in text and "\n[1] Sample Index: 0\n" in text and "  1. unknown_2 (score: 0.9000)" in text


def test_failures_are_set_aside(spark):
    tried = evaluate.try_rows(spark.range(5), lambda r: 10 // (r["id"] - 2), "bigint")
    good, bad = evaluate.split_failures(tried)
    assert good.count() == 4 and bad.first().error.startswith("ZeroDivisionError")


def test_failures_leave_rows_alone(spark):
    large = 9007199254740993
    rows = spark.createDataFrame([(large, 1.5), (None, float("nan")), (2, None)], "id bigint, v double")
    tried = evaluate.try_rows(rows, lambda r: type(r["id"]).__name__, "string").collect()
    assert [(r.id, r.result) for r in tried] == [(large, "int"), (None, "NoneType"), (2, "int")]
    assert str(tried[1].v) == "nan" and tried[2].v is None


def test_conversations_stay_whole(spark):
    turns = spark.range(2500).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'tool') as role", "cast(id as string) as text")
    whole = chat.payloads(turns.repartition(4)).collect()
    assert len(whole) == 1 and [m["content"] for m in whole[0].messages] == [str(i) for i in range(2500)]
    assert {m["role"] for m in whole[0].messages} == {"user", "tool"} and chat.messages(turns).count() == 2500
    replies = chat.enrich(chat.payloads(turns), lambda messages, model: f"{model}:{len(messages)}").first()
    assert replies.reply == "default:2500" and replies.error is None


def test_missing_keys_fail_whatever_is_asked(spark):
    from qaspark.operators import lookups

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "row_idx int, answer string")
    encoder = spark.createDataFrame([("a", 0)], "answer string, label int")
    for ask in (lambda df: df.count(), lambda df: df.select("row_idx").collect()):
        with pytest.raises(Exception, match="no label for answer b"):
            ask(lookups.encode_answers(rows, encoder))


def test_null_runs_are_kept(spark):
    log = spark.createDataFrame([(None, e, 1.0) for e in range(5)] + [("r", e, 1.0) for e in range(5)], "run_id string, epoch bigint, eval_loss double")
    stops = {r.run_id: r.stop_epoch for r in evaluate.early_stops(log, 2).collect()}
    assert stops == {None: 2, "r": 2}


def test_augmentation_follows_the_trainer(spark):
    from qaspark.functions import curriculum

    rows = spark.createDataFrame(
        [(k, s, "người xem phim này rất nhìn") for k, s in enumerate(("train", "val", "test", None))], "row_idx int, split string, question string")
    every = schedules.augmented_epochs(rows, curriculum.Schedule(30, "linear"))
    alone = every.filter("not (split <=> 'train')")
    assert alone.filter("image_action <> 'none' or size(views) <> 1").count() == 0
    easy = {tuple(r.views) for r in every.filter("split = 'train' and epoch < 9").collect()}
    assert len(easy) > 1  # a fresh draw per epoch
    tagged = rows.withColumn("tagged", F.array(F.struct(F.lit("x").alias("word"), F.lit("X").alias("pos"))))
    plain = schedules.augmented_epochs(tagged, curriculum.Schedule(3, "linear")).filter("split = 'train' and epoch = 0").first()
    assert plain.views == ["người xem phim này rất nhìn"] * 3


def waves(spark, df, folder, count):
    """Write the rows in ``count`` waves of rising epochs and stream them one file at a time."""
    top = df.agg(F.max("epoch")).first()[0] + 1
    for i in range(count):
        part = df.filter((F.col("epoch") >= top * i // count) & (F.col("epoch") < top * (i + 1) // count))
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("count", [1, 2, 5])
def test_streams_equal_batch(spark, tmp_path, count):
    random.seed(4)
    data = [(f"r{i}", e, random.random(), random.random(), random.random() * 0.04) for i in range(5) for e in range(40)]
    df = spark.createDataFrame(data, "run_id string, epoch bigint, eval_accuracy double, eval_loss double, difficulty double")
    stream = waves(spark, df, str(tmp_path / "in"), count)

    def drained(s, name):
        return streams.drain_to_files(s, str(tmp_path / f"state-{name}"), str(tmp_path / name))

    best = streams.latest_best(drained(streams.best_metric_stream(stream), "best"))
    assert set(best.collect()) == set(evaluate.best_accuracy(df).collect())
    applied = drained(streams.applied_difficulty_stream(stream), "applied")
    assert applied.filter("late").count() == 0
    assert set(applied.drop("late").collect()) == set(schedules.applied_difficulty(df.select("run_id", "epoch", "difficulty")).collect())
    stops = drained(streams.early_stop_stream(stream, 5), "stops")
    assert set(stops.select("run_id", "stop_epoch").collect()) == set(evaluate.early_stops(df, 5).filter("stop_epoch is not null").collect())
    done = spark.createDataFrame([("r0",)], "run_id string")


@pytest.mark.parametrize("count", [1, 3])
def test_streams_treat_nulls_as_batch_does(spark, tmp_path, count):
    """Metrics that are null or NaN, at a run's beginning, too; a run without a name."""
    nan = float("nan")
    values = [None, nan, 0.3, None, 0.305, 0.32, nan, 0.1, None, 0.1, 0.5, 0.2]
    data = [(run, e, v, v, v) for run, own in (("a", values), (None, values[::-1]), ("n", [None, nan, None])) for e, v in enumerate(own)]
    df = spark.createDataFrame(data, "run_id string, epoch bigint, eval_accuracy double, eval_loss double, difficulty double")
    stream = waves(spark, df, str(tmp_path / "in"), count)

    def drained(s, name):
        return streams.drain_to_files(s, str(tmp_path / f"state-{name}"), str(tmp_path / name))

    assert set(streams.latest_best(drained(streams.best_metric_stream(stream), "best")).collect()) == set(evaluate.best_accuracy(df).collect())
    applied = drained(streams.applied_difficulty_stream(stream), "applied").drop("late")
    assert set(applied.collect()) == set(schedules.applied_difficulty(df.select("run_id", "epoch", "difficulty")).collect())
    stops = drained(streams.early_stop_stream(stream, 3), "stops").select("run_id", "stop_epoch")
    assert set(stops.collect()) == set(evaluate.early_stops(df, 3).filter("stop_epoch is not null").collect())
    assert {r.run_id: r.stop_epoch for r in stops.collect()}["n"] == 2


def test_restarted_streams_go_on(spark, tmp_path):
    """Each wave is its own run of the query, from the checkpoint of the one before."""
    random.seed(5)
    shape = "run_id string, epoch bigint, eval_accuracy double, eval_loss double, difficulty double"
    data = [(f"r{i}", e, random.random(), random.random(), random.random() * 0.04) for i in range(3) for e in range(30)]
    df, folder = spark.createDataFrame(data, shape), str(tmp_path / "in")
    made = {}
    for low in range(0, 30, 10):
        df.filter((F.col("epoch") >= low) & (F.col("epoch") < low + 10)).write.mode("append").parquet(folder)
        for name, build in (("best", streams.best_metric_stream), ("applied", streams.applied_difficulty_stream),
                            ("stops", lambda log: streams.early_stop_stream(log, 4))):
            stream = spark.readStream.schema(shape).parquet(folder)
            made[name] = streams.drain_to_files(build(stream), str(tmp_path / f"state-{name}"), str(tmp_path / name))
    assert set(streams.latest_best(made["best"]).collect()) == set(evaluate.best_accuracy(df).collect())
    assert set(made["applied"].drop("late").collect()) == set(schedules.applied_difficulty(df.select("run_id", "epoch", "difficulty")).collect())
    assert set(made["stops"].select("run_id", "stop_epoch").collect()) == set(evaluate.early_stops(df, 4).filter("stop_epoch is not null").collect())


def test_ended_runs_free_their_state(spark, tmp_path):
    """A run that is idle has ended: the early-stop stream says so, and no state of it is left."""
    shape = "run_id string, epoch bigint, eval_loss double, time timestamp"
    folder, state, out = (str(tmp_path / name) for name in ("in", "state", "out"))
    for k, run in enumerate(("first", "second", "third")):
        at = datetime.datetime(2024, 1, 1, 0, k)
        rows = [(run, e, 1.0 - e / 2, at + datetime.timedelta(seconds=e)) for e in range(2)]
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(shape).parquet(folder)
        found = streams.drain_to_files(streams.early_stop_stream(stream, 5, idle=30), state, out)
    assert sorted(r.run_id for r in found.filter("ended").collect()) == ["first", "second"]
    kept = spark.read.format("statestore").option("stateVarName", "kept").load(state)
    assert [r.key.run_id for r in kept.collect()] == ["third"]


def test_late_rows_are_reported(spark, tmp_path):
    """Waves out of order: the second brings epochs that the first has passed."""
    shape = "run_id string, epoch bigint, eval_loss double, difficulty double"
    folder = str(tmp_path / "in")
    for epochs in ((0, 1, 4), (2, 3, 5)):
        rows = [("r", e, float(e == 2), 0.1 * e) for e in epochs]
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(folder)
    applied = streams.drain_to_files(streams.applied_difficulty_stream(stream), str(tmp_path / "s1"), str(tmp_path / "o1"))
    assert sorted((r.epoch, r.late, r.applied is None) for r in applied.collect()) == [
        (0, False, False), (1, False, False), (2, True, True), (3, True, True), (4, False, False), (5, False, False)]
    stops = streams.drain_to_files(streams.early_stop_stream(stream, 3), str(tmp_path / "s2"), str(tmp_path / "o2")).collect()
    assert sorted(r.late_epoch for r in stops if r.late_epoch is not None) == [2, 3]
    assert [r.stop_epoch for r in stops if r.stop_epoch is not None] == [5]


def test_difficulty_in_force_over_chunks(spark):
    """Runs of many chunks and levels, gaps, repeated epochs, nulls and a run without a name equal the plain fold."""
    pick = random.Random(12)
    rows = []
    for run, count, step in (("long", 700, 0.004), ("still", 90, 0.0), (None, 333, 0.02), ("noisy", 200, 0.5), ("none", 5, None)):
        value = 0.1
        for e in range(count):
            value = None if step is None else value + pick.uniform(-step, step)
            rows.append((run, -20 + 2 * e, None if step is None or pick.random() < 0.1 else pick.choice([value, float("nan"), value, value])))
    rows += [("long", 44, 0.9), ("long", 44, 0.2), ("long", None, 0.5)]
    expected, null_first = {}, lambda v: (v is not None, v if v is not None else 0)
    for run in {r for r, _, _ in rows}:
        own = [(e, None if v is None or math.isnan(v) else v) for r, e, v in rows if r == run]
        force = None
        for e, v in sorted(own, key=lambda row: (null_first(row[0]), null_first(row[1]))):
            force = v if v is not None and (force is None or abs(v - force) > C.UPDATE_ABOVE) else force
            expected.setdefault(run, []).append((e, v, force))
    log = spark.createDataFrame(rows, "run_id string, epoch bigint, difficulty double").repartition(5)
    for chunk, fan in ((4096, 256), (64, 256), (7, 3), (1, 2)):
        found = {}
        for r in schedules.applied_difficulty(log, chunk=chunk, fan=fan).collect():
            found.setdefault(r.run_id, []).append((r.epoch, r.difficulty, r.applied))
        assert {run: sorted(own, key=str) for run, own in found.items()} == {run: sorted(own, key=str) for run, own in expected.items()}
    assert schedules.applied_difficulty(log.limit(0)).count() == 0


def test_long_run_is_many_tasks(spark):
    """A run of 10^5 epochs: no task of the fold has more than a chunk of it."""
    log = spark.range(100_000).select(F.lit("r").alias("run_id"), F.col("id").alias("epoch"), (F.rand(3) * 0.05).alias("difficulty"))
    made = schedules.applied_difficulty(log)
    plan = made._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "hashpartitioning(run_id" in plan and "block" in plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("chunk", [4096, 5, 2])
def test_running_values_over_levels(spark, chunk):
    """Totals of a group are cut again until a window has a chunk of them; every depth gives the same values."""
    pick = random.Random(chunk)
    rows = [(g, p, pick.choice([None, pick.randint(-9, 9)])) for g in ("a", None) for p in pick.sample(range(150), 100)]
    df = spark.createDataFrame(rows, "g string, p bigint, v bigint").repartition(3)
    found = scan.running(df, "g", "p", chunk, low=scan.Running(F.col("v"), "min", include_current=False), total=scan.Running(F.col("v"), "sum"),
                         number=scan.row_number())
    for g in ("a", None):
        own = sorted((p, v) for h, p, v in rows if h == g)
        for r in (r for r in found.collect() if r.g == g):
            before, upto = [v for p, v in own if p < r.p and v is not None], [v for p, v in own if p <= r.p and v is not None]
            assert (r.low, r.total, r.number) == (min(before, default=None), sum(upto), sum(p <= r.p for p, _ in own))


def test_repeated_row_numbers_are_refused(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "row_idx bigint, question string")
    vocabulary = labels.fit_token_vocabulary(rows)
    assert {r.row_idx: r.attention_mask for r in labels.encode_questions(rows, vocabulary, 3).collect()} == {1: [1, 1, 0], 2: [0, 0, 0], 3: [0, 0, 0]}
    for twice in (1, 2):
        with pytest.raises(Exception, match="row_idx is repeated"):
            labels.encode_questions(rows.unionByName(rows.filter(F.col("row_idx") == twice)), vocabulary, 3).collect()


def test_landed_replies_are_not_asked_again(spark, tmp_path):
    """Equal payloads once, failures again, a broken run from where it landed."""
    rows = [(k, [{"role": "user", "content": f"q{k % 7}"}], None if k % 2 else "small") for k in range(20)]
    chats = spark.createDataFrame(rows, "conv_id bigint, messages array<struct<role:string,content:string>>, model string")
    path, calls = str(tmp_path / "replies"), spark.sparkContext.accumulator(0)

    def answer(bad):
        def call(messages, model):
            calls.add(1)
            if messages[0]["content"] in bad:
                raise ValueError("busy")
            return f"{model}:{messages[0]['content']}"
        return call

    first = chat.enrich_landed(chats, answer({"q3", "q5"}), path, parts=3)
    assert calls.value == 14 and first.filter("error = 'ValueError: busy' and reply is null").count() == 6
    second = chat.enrich_landed(chats, answer({"q5"}), path, parts=3)
    assert calls.value == 14 + 4 and second.filter("error is not null").count() == 3
    last = chat.enrich_landed(chats, answer(set()), path)
    assert calls.value == 14 + 4 + 2 and last.columns == [*chats.columns, "reply", "error"]
    assert {(r.conv_id, r.reply, r.error) for r in last.collect()} == {(k, f"{m or 'default'}:q{k % 7}", None) for k, _, m in rows}
    assert chat.enrich_landed(chats, answer({"q0"}), path).filter("error is not null").count() == 0 and calls.value == 20


def test_best_values_take_the_earliest_epoch(spark):
    nan = float("nan")
    rows = [("a", 3, 0.5, 0.2), ("a", 1, 0.5, nan), ("a", 2, nan, 0.2), ("b", 0, 0.0, None), ("b", 1, None, None), (None, 4, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "run_id string, epoch bigint, eval_accuracy double, eval_loss double")
    assert {tuple(r) for r in evaluate.best_accuracy(df).collect()} == {("a", 0.5, 1), ("b", 0.0, 0), (None, 0.1, 4)}
    assert {tuple(r) for r in evaluate.best_checkpoint(df).collect()} == {("a", 2, 0.2), ("b", None, None), (None, 4, 0.1)}


def arrive(spark, folder, low, high):
    rows = spark.range(low, high).select(F.col("id").cast("string").alias("img_id"))
    rows.unionByName(rows.limit(2)).unionByName(spark.createDataFrame([(None,)], "img_id string")).write.mode("append").parquet(folder)
    return spark.readStream.schema("img_id string").option("maxFilesPerTrigger", 2).parquet(folder)


def test_new_work_is_done_once(spark, tmp_path):
    """Images that are done, repeated in a batch, landed before or without an id; results of the work land with their key."""
    done = spark.range(3).select(F.col("id").cast("string").alias("img_id"))
    folder, state, out = (str(tmp_path / name) for name in ("in", "state", "out"))
    for low, high, expected in ((0, 10, 7), (5, 15, 12), (15, 15, 12)):
        landed = streams.land_new_work(arrive(spark, folder, low, high), done, state, out,
                                       work=lambda fresh: fresh.withColumn("size", F.length("img_id")))
        assert landed.columns == ["img_id", "size"]
        assert landed.count() == expected and landed.select("img_id").distinct().count() == expected
    assert landed.filter("img_id is null or size <> length(img_id)").count() == 0


def test_new_work_survives_a_crash_between_landing_and_commit(spark, tmp_path):
    """The batch that landed without a commit runs again and lands in the same place: each image once."""
    done = spark.createDataFrame([], "img_id string")
    folder, state, out = (str(tmp_path / name) for name in ("in", "state", "out"))
    tried = []

    def crash(number):
        tried.append(number)
        if tried.count(number) == 1:
            raise RuntimeError("killed before the commit")

    for low, high in ((0, 20), (10, 30)):
        stream = arrive(spark, folder, low, high)
        for _ in range(40):
            try:
                landed = streams.land_new_work(stream, done, state, out, after_landing=crash)
                break
            except Exception as failure:
                assert "killed before the commit" in str(failure)
        assert sorted(int(r.img_id) for r in landed.collect()) == list(range(high))
    assert max(tried) > 0 and all(tried.count(number) == 2 for number in set(tried))


def test_tasks_of_encoded_questions_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(labels, "QUESTIONS_A_TASK", 2)
    rows = spark.createDataFrame([(k, f"what is {k} and {k % 3} ?") for k in range(60)], "row_idx int, question string")
    encoded = labels.encode_questions(rows, labels.fit_token_vocabulary(rows), 5)
    assert encoded.rdd.getNumPartitions() == 30
    assert encoded.filter("size(input_ids) <> 5 or exists(input_ids, i -> i < 2)").count() == 0 and encoded.count() == 60


def test_stated_difficulty_is_rounded_and_the_applied_one_is_not(spark):
    from qaspark.functions import curriculum

    rows = spark.createDataFrame([(1, "người xem phim này rất nhìn")], "row_idx int, question string")
    schedule = curriculum.Schedule(120, "linear")
    exact, rounded = (schedules.augmented_epochs(rows, schedule, digits=d).orderBy("epoch").collect() for d in (None, 1))
    assert [round(r.difficulty, 1) for r in exact] == [r.difficulty for r in rounded]
    assert [(r.phase, r.views, r.image_action) for r in exact] == [(r.phase, r.views, r.image_action) for r in rounded]
