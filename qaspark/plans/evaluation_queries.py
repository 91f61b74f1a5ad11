"""Predictions, metrics, reports, chat payloads and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaspark.operators import chat, evaluate, lookups
from qaspark.plans.catalog import query
from qaspark.plans.curriculum_queries import noisy_difficulty
from qaspark.plans.views import cte, table, view
from qaspark.session import scratch_path
from qaspark.sinks import reports, writers
from qaspark.streaming import metrics as streams

# Logits are all elements of a vector; answers are named after the label.
_PREDS_SQL = """with recursive preds as (
select vec_id as row_idx, vec_id % 5 as epoch, list_transform(embedding, lambda x: x::double) as logits, label as ground_truth,
       concat('q', vec_id) as question, concat('img/', vec_id, '.jpg') as img_path from embeddings),
predicted as (select *, list_position(logits, list_max(logits)) - 1 as prediction from preds),
encoder as (select label, concat('answer ', label) as answer from (select distinct label from embeddings where label < 8))
"""


def _preds(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_idx"), (F.col("vec_id") % 5).alias("epoch"),
        F.col("embedding").cast("array<double>").alias("logits"), F.col("label").alias("ground_truth"),
        F.concat(F.lit("q"), F.col("vec_id")).alias("question"),
        F.concat(F.lit("img/"), F.col("vec_id"), F.lit(".jpg")).alias("img_path"),
    )
    return evaluate.with_prediction(rows)


def _encoder(spark, sf_dir):
    seen = table(spark, sf_dir, "embeddings").select("label").filter("label < 8").distinct()
    return seen.select("label", F.concat(F.lit("answer "), F.col("label")).alias("answer"))


@query("predictions", _PREDS_SQL + "select row_idx, prediction, ground_truth from predicted")
def predictions(spark, sf_dir):
    return _preds(spark, sf_dir).select("row_idx", "prediction", "ground_truth")


@query("accuracy", _PREDS_SQL + "select round(avg((prediction = ground_truth)::int), 6) as accuracy from predicted")
def accuracy(spark, sf_dir):
    return evaluate.accuracy(_preds(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"))


@query("wrong_predictions", _PREDS_SQL + "select row_idx, prediction, ground_truth from predicted where prediction <> ground_truth")
def wrong_predictions(spark, sf_dir):
    return evaluate.wrong_predictions(_preds(spark, sf_dir)).select("row_idx", "prediction", "ground_truth")


@query("error_rates", _PREDS_SQL + """
select epoch, count(*) filter (prediction <> ground_truth) as num_wrong, count(*) as total,
       round(count(*) filter (prediction <> ground_truth) / count(*), 6) as error_rate from predicted group by epoch""")
def error_rates(spark, sf_dir):
    return evaluate.error_rates(_preds(spark, sf_dir)).withColumn("error_rate", F.round("error_rate", 6))


_TOP_SQL = """, cells as (select p.*, unnest(logits) as score, generate_subscripts(logits, 1) - 1 as label from predicted p where prediction <> ground_truth),
ranked as (select *, row_number() over (partition by row_idx order by score desc, label) as rank from cells),
top5 as (select r.*, coalesce(e.answer, concat('unknown_', r.label)) as answer from ranked r left join encoder e on e.label = r.label where rank <= 5)
"""


@query("top5_predictions", _PREDS_SQL + _TOP_SQL + "select row_idx as sample_idx, rank, answer, label, round(score, 6) as score from top5")
def top5_predictions(spark, sf_dir):
    wrong = evaluate.wrong_records(_preds(spark, sf_dir), _encoder(spark, sf_dir))
    best = wrong.select("sample_idx", F.explode_outer("top5_predictions").alias("t")).select("sample_idx", "t.*")
    return best.withColumn("score", F.round("score", 6))


_WRONG_SQL = """, wrong as (select p.epoch, p.row_idx as sample_idx, img_path as image_path, question, coalesce(a.answer, concat('unknown_', prediction)) as model_prediction,
 coalesce(b.answer, concat('unknown_', ground_truth)) as ground_truth, prediction as prediction_label, ground_truth as ground_truth_label
 from predicted p left join encoder a on a.label = prediction left join encoder b on b.label = ground_truth where prediction <> p.ground_truth)
"""


@query("wrong_records", _PREDS_SQL + _WRONG_SQL + "select * from wrong")
def wrong_records(spark, sf_dir):
    return evaluate.wrong_records(_preds(spark, sf_dir), _encoder(spark, sf_dir)).drop("top5_predictions")


_WRITTEN = "epoch bigint, sample_idx bigint, image_path string, question string, model_prediction string, ground_truth string, prediction_label bigint, ground_truth_label bigint"


@query("written_wrong_records", _PREDS_SQL + _WRONG_SQL + """
select *, count(*) over (partition by epoch) as num_wrong_predictions from wrong""")
def written_wrong_records(spark, sf_dir):
    """Written epoch after epoch, one of them twice."""
    root = writers.run_folder(scratch_path(spark, "wrong"), "orders", "run", 71)
    rows = evaluate.wrong_records(_preds(spark, sf_dir), _encoder(spark, sf_dir))
    for epochs in ("epoch < 3", "epoch >= 3", "epoch = 2"):
        writers.write_wrong_predictions(rows.filter(epochs), root)
    samples = spark.read.schema(_WRITTEN).json(f"{root}/wrong_samples")
    return samples.join(spark.read.schema("epoch bigint, num_wrong_predictions bigint").json(f"{root}/counts"), "epoch")


@query("wrong_report", _PREDS_SQL + _WRONG_SQL + _TOP_SQL + """, lines as (select row_idx, string_agg(concat('  ', rank, '. ', answer, ' (score: ', printf('%.4f', score), ')'), chr(10) order by rank) as t from top5 group by row_idx),
numbered as (select *, row_number() over (partition by epoch order by sample_idx) as block from wrong)
select epoch, 0 as block, concat('Epoch ', epoch, ' - Wrong Predictions Summary', chr(10), repeat('=', 80), chr(10), chr(10), 'Total wrong predictions: ', count(*), chr(10), chr(10), repeat('-', 80)) as text
from wrong group by epoch
union all
select epoch, block, concat(chr(10), '[', block, '] Sample Index: ', sample_idx, chr(10), 'Image: ', image_path, chr(10), 'Question: ', question, chr(10),
  'Ground Truth: ', ground_truth, chr(10), 'Prediction: ', model_prediction, chr(10), 'Top-5 Predictions:', chr(10), t, chr(10), repeat('-', 80))
from numbered join lines on row_idx = sample_idx""")
def wrong_report(spark, sf_dir):
    return reports.wrong_summary(evaluate.wrong_records(_preds(spark, sf_dir), _encoder(spark, sf_dir)))


@query("written_report", _PREDS_SQL + _WRONG_SQL + """, numbered as (select *, row_number() over (partition by epoch order by sample_idx) as block from wrong),
blocks as (
select concat('Epoch ', epoch, ' - Wrong Predictions Summary', chr(10), repeat('=', 80), chr(10), chr(10), 'Total wrong predictions: ', count(*), chr(10), chr(10), repeat('-', 80)) as text
from wrong group by epoch
union all
select concat(chr(10), '[', block, '] Sample Index: ', sample_idx, chr(10), 'Image: ', image_path, chr(10), 'Question: ', question, chr(10),
  'Ground Truth: ', ground_truth, chr(10), 'Prediction: ', model_prediction, chr(10), repeat('-', 80)) from numbered)
select line, count(*) as n from (select unnest(string_split(text, chr(10))) as line from blocks) group by line""")
def written_report(spark, sf_dir):
    """Lines of a report without the best answers, as written."""
    path = scratch_path(spark, "report")
    records = evaluate.wrong_records(_preds(spark, sf_dir).drop("logits"), _encoder(spark, sf_dir))
    writers.write_report(reports.wrong_summary(records), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


# Observed samples: text views for two of three rows, image action for one of two.
_OBSERVED_SQL = """, observed as (
select epoch, row_idx as sample_id, question, coalesce(a.answer, concat('unknown_', prediction)) as p, coalesce(b.answer, concat('unknown_', ground_truth)) as g,
       prediction = ground_truth as is_correct, row_idx % 2 = 0 as has_image_augmentation, row_idx % 3 = 1 as has_text_augmentation
from predicted left join encoder a on a.label = prediction left join encoder b on b.label = ground_truth)
"""


def _observed(spark, sf_dir):
    key = F.col("row_idx")
    views = F.when(key % 3 == 0, F.array("question")).when(key % 3 == 1, F.array("question", F.concat("question", F.lit("?"))))
    samples = _preds(spark, sf_dir).withColumn("sample_id", key).withColumn("views", views).withColumn(
        "image_action", F.when(key % 2 == 0, "mask")
    )
    return evaluate.observations(samples, _encoder(spark, sf_dir))


@query("observations", _PREDS_SQL + _OBSERVED_SQL + """
select epoch, sample_id, p as model_prediction, g as ground_truth, is_correct, has_image_augmentation, has_text_augmentation from observed""")
def observations(spark, sf_dir):
    return _observed(spark, sf_dir).select(
        "epoch", "sample_id", "model_prediction", "ground_truth", "is_correct", "has_image_augmentation", "has_text_augmentation"
    )


@query("sample_accuracy", _PREDS_SQL + """
select epoch, count(*) as samples, count(*) filter (prediction = ground_truth) as correct, round(avg((prediction = ground_truth)::int), 6) as accuracy
from predicted group by epoch""")
def sample_accuracy(spark, sf_dir):
    return evaluate.sample_accuracy(_observed(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query("written_observations", _PREDS_SQL + _OBSERVED_SQL + """
select epoch, sample_id, p as model_prediction, g as ground_truth, is_correct,
       count(*) over (partition by epoch) as num_samples, count(*) filter (is_correct) over (partition by epoch) as num_correct from observed""")
def written_observations(spark, sf_dir):
    """Written epoch after epoch, one of them twice."""
    root = writers.run_folder(scratch_path(spark, "observed"), "orders", "run", 71)
    rows = _observed(spark, sf_dir)
    for epochs in ("epoch < 2", "epoch >= 2", "epoch = 1"):
        writers.write_observations(rows.filter(epochs), root)
    samples = spark.read.schema("epoch bigint, sample_id bigint, model_prediction string, ground_truth string, is_correct boolean").json(f"{root}/samples")
    counts = spark.read.schema("epoch bigint, num_samples bigint, num_correct bigint").json(f"{root}/epochs")
    return samples.join(counts, "epoch")


@query("sample_report", _PREDS_SQL + _OBSERVED_SQL + """
select epoch, sample_id, concat('Sample Summary', chr(10), repeat('=', 50), chr(10), chr(10), 'Original Question:', chr(10), '  ', question, chr(10), chr(10),
  case when has_text_augmentation then concat('Augmented Question:', chr(10), '  ', question, ' | ', question, '?', chr(10), chr(10)) else '' end,
  'Ground Truth Answer:', chr(10), '  ', g, chr(10), chr(10), 'Model Prediction:', chr(10), '  ', p, chr(10), chr(10),
  'Prediction Status: ', case when is_correct then 'CORRECT ✓' else 'INCORRECT ✗' end, chr(10), chr(10), 'Augmentation Applied:', chr(10),
  '  - Image: ', case when has_image_augmentation then 'Yes' else 'No' end, chr(10), '  - Text: ', case when has_text_augmentation then 'Yes' else 'No' end) as summary
from observed""")
def sample_report(spark, sf_dir):
    return reports.sample_summary(_observed(spark, sf_dir))


@query("epoch_report", _PREDS_SQL + _OBSERVED_SQL + """
select epoch, 0 as block, concat('Epoch ', epoch, ' Sample Summary', chr(10), repeat('=', 50), chr(10), chr(10), 'Total samples: ', count(*), chr(10),
  'Correct predictions: ', count(*) filter (is_correct), '/', count(*), ' (', printf('%.2f', avg(is_correct::int) * 100), '%)', chr(10)) as text from observed group by epoch
union all
select epoch, sample_id + 1, concat('Sample ', sample_id, ':', chr(10), '  Question (original): ', question, chr(10),
  case when has_text_augmentation then concat('  Question (augmented): ', question, ' | ', question, '?', chr(10)) else '' end,
  '  Ground truth: ', g, chr(10), '  Prediction: ', p, chr(10), '  Correct: ', case when is_correct then '✓' else '✗' end, chr(10),
  '  Image augmented: ', case when has_image_augmentation then 'Yes' else 'No' end, chr(10)) from observed""")
def epoch_report(spark, sf_dir):
    return reports.epoch_summary(_observed(spark, sf_dir))


# --- metric logs ------------------------------------------------------------------------------

_RUNS = cte("long_runs") + ", metrics as (select * from long_runs)\n"
_BEST_SQL = """select run_id, coalesce(max(eval_accuracy) filter (eval_accuracy > 0), 0) as best_accuracy,
 coalesce(arg_max(epoch, (eval_accuracy, -epoch)) filter (eval_accuracy > 0), 0) as best_epoch from metrics group by run_id"""


@query("best_accuracy", _RUNS + _BEST_SQL)
def best_accuracy(spark, sf_dir):
    return evaluate.best_accuracy(view(spark, sf_dir, "long_runs"))


@query("best_checkpoint", _RUNS + """
select run_id, arg_min(epoch, (eval_loss, epoch)) as best_epoch, min(eval_loss) as best_loss from metrics group by run_id""")
def best_checkpoint(spark, sf_dir):
    return evaluate.best_checkpoint(view(spark, sf_dir, "long_runs"))


_STOP_SQL = """, step as (select *, min(eval_loss) over (partition by run_id order by epoch rows between unbounded preceding and 1 preceding) as low,
  row_number() over (partition by run_id order by epoch) as k from metrics),
marked as (select *, max(case when low is null or eval_loss < low then k end) over (partition by run_id order by epoch) as last from step)
"""


@query("patience_counters", _RUNS + _STOP_SQL + "select run_id, epoch, k - last as counter from marked")
def patience_counters(spark, sf_dir):
    return evaluate.patience_counters(view(spark, sf_dir, "long_runs"))


@query("early_stops", _RUNS + _STOP_SQL + "select run_id, min(epoch) filter (k - last >= 10) as stop_epoch from marked group by run_id")
def early_stops(spark, sf_dir):
    return evaluate.early_stops(view(spark, sf_dir, "long_runs"), 10)


# Ids above 2^53, nulls and NaN pass through untouched.
_LARGE = 9007199254740993


@query("failed_rows", f"""
select event_id, case when event_id % 5 = 0 then null else event_id + {_LARGE} end as large,
       case when event_id % 7 = 0 then 'NaN'::double else value end as value,
       case when event_id % 97 = 0 then null else event_id * 2 end as result,
       case when event_id % 97 = 0 then concat('ValueError: event ', event_id) end as error from events""")
def failed_rows(spark, sf_dir):
    def double(record):
        if not isinstance(record["event_id"], int):
            raise TypeError("an id is a whole number")
        if record["event_id"] % 97 == 0:
            raise ValueError(f"event {record['event_id']}")
        return record["event_id"] * 2

    key = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(key % 5 != 0, key + F.lit(_LARGE)).alias("large"),
        F.when(key % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return evaluate.try_rows(rows, double, "bigint").select("event_id", "large", "value", "result", "error")


# --- streams: a file source over the events table, state equal to the batch form ---------------

def _stream(spark, sf_dir):
    """Events arriving in three waves, each with the next third of every run's evaluations."""
    events = table(spark, sf_dir, "events")
    arrivals = scratch_path(spark, "arrivals")
    for low, high in ((0, 34), (34, 67), (67, 100)):
        wave = events.filter((F.col("event_id") % 100 >= low) & (F.col("event_id") % 100 < high))
        wave.repartition(F.floor(F.col("event_id") / 100)).write.mode("append").parquet(arrivals)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(arrivals)


def _in_two_runs(spark, rows, build):
    """What a stream makes of metric rows that arrive in two waves of rising epochs; it is stopped and restarted between."""
    arrivals, state, out = (scratch_path(spark, label) for label in ("arrivals", "state", "streamed"))
    half = rows.agg(F.floor(F.max("epoch") / 2)).first()[0]
    for wave in (F.col("epoch") <= half, F.col("epoch") > half):
        rows.filter(wave).write.mode("append").parquet(arrivals)
        streams.drain_to_files(build(spark.readStream.schema(rows.schema).parquet(arrivals)), state, out)
    return spark.read.parquet(out)


@query("stream_best_metric", _RUNS + _BEST_SQL)
def stream_best_metric(spark, sf_dir):
    return streams.latest_best(_in_two_runs(spark, view(spark, sf_dir, "long_runs"), streams.best_metric_stream))


@query("stream_applied_difficulty", _RUNS + """, d as (select run_id, epoch, round((epoch * 7 % 13)::double / 13 * 0.05 + epoch::double / 99 * 0.9, 6) as difficulty from metrics),
fold as (
  select run_id, epoch, difficulty, difficulty as applied from (select *, row_number() over (partition by run_id order by epoch) as rn from d) where rn = 1
  union all
  select n.run_id, n.epoch, n.difficulty, case when abs(n.difficulty - f.applied) > 0.01 then n.difficulty else f.applied end
  from fold f join d n on n.run_id = f.run_id and n.epoch = f.epoch + 1)
select run_id, epoch, round(difficulty, 6) as difficulty, round(applied, 6) as applied from fold""")
def stream_applied_difficulty(spark, sf_dir):
    rows = _in_two_runs(spark, noisy_difficulty(view(spark, sf_dir, "long_runs")), streams.applied_difficulty_stream)
    return rows.select("run_id", "epoch", F.round("difficulty", 6).alias("difficulty"), F.round("applied", 6).alias("applied"))


@query("stream_early_stops", _RUNS + _STOP_SQL + """
select run_id, min(epoch) as stop_epoch from marked where k - last >= 10 group by run_id""")
def stream_early_stops(spark, sf_dir):
    rows = _in_two_runs(spark, view(spark, sf_dir, "long_runs"), lambda log: streams.early_stop_stream(log, 10))
    return rows.filter("stop_epoch is not null").select("run_id", "stop_epoch")


@query("stream_wrong_predictions", """
select event_id, event_id % 7 as prediction, user_id % 7 as ground_truth from events where event_id % 7 <> user_id % 7""")
def stream_wrong_predictions(spark, sf_dir):
    arrivals = _stream(spark, sf_dir).select(
        "event_id", (F.col("event_id") % 7).alias("prediction"), (F.col("user_id") % 7).alias("ground_truth")
    )
    wrong = streams.wrong_prediction_stream(arrivals)
    return streams.drain_to_files(wrong, scratch_path(spark, "state"), scratch_path(spark, "wrong"))


@query("stream_new_work", """
select distinct user_id as img_id from events where user_id not in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def stream_new_work(spark, sf_dir):
    arrivals = _stream(spark, sf_dir).select(F.col("user_id").alias("img_id"))
    done = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("img_id"))
    return streams.land_new_work(arrivals, done, scratch_path(spark, "state"), scratch_path(spark, "fresh"))


# --- chat -------------------------------------------------------------------------------------

# Every seventh turn has a role of its own.
_TURNS_SQL = "with turns as (select conv_id, turn, case when turn % 7 = 5 then 'tool' else role end as role, text from conversations)\n"


def _turns(spark, sf_dir):
    role = F.when(F.col("turn") % 7 == 5, "tool").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").withColumn("role", role)


@query("chat_payloads", _TURNS_SQL + """
select conv_id, string_agg(concat(role, ': ', text), chr(10) order by turn, role, text) as messages from turns group by conv_id""")
def chat_payloads(spark, sf_dir):
    made = chat.payloads(_turns(spark, sf_dir))
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return made.select("conv_id", F.array_join(lines, "\n").alias("messages"))


@query("chat_messages", _TURNS_SQL + "select conv_id, turn, role, text as content from turns")
def chat_messages(spark, sf_dir):
    return chat.messages(_turns(spark, sf_dir))


@query("chat_replies", _TURNS_SQL + """
, sized as (select conv_id, count(*) as n, arg_max(role, turn) as last from turns group by conv_id)
select conv_id, case when n <= 3 then concat(case when conv_id % 2 = 0 then 'small' else 'default' end, ':', n, ':', last) end as reply,
       case when n > 3 then concat('ValueError: ', n, ' turns') end as error
from sized""")
def chat_replies(spark, sf_dir):
    def answer(messages, model):
        if len(messages) > 3:
            raise ValueError(f"{len(messages)} turns")
        return f"{model}:{len(messages)}:{messages[-1]['role']}"

    chats = chat.payloads(_turns(spark, sf_dir))
    named = chats.withColumn("model", F.when(F.col("conv_id") % 2 == 0, "small"))
    return chat.enrich(named, answer).select("conv_id", "reply", "error")
