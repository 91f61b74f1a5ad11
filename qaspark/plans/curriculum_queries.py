"""Difficulty schedules over metric logs and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaspark.functions import curriculum as C
from qaspark.operators import lookups, schedules
from qaspark.plans.catalog import query
from qaspark.plans.views import cte, view

_METRICS = cte("metrics")
_ORDERS = cte("qa_orders")
EPOCHS = 100

_LINEAR = "epoch::double / 99"
_FORMULAS = {
    "linear": _LINEAR,
    "cosine": "(1 - cos(pi() * epoch::double / 99)) / 2",
    "exponential": "1 - pow(0.1::double, (100.0::double - epoch) / 100)",
    "step": "least(floor(epoch::double / 33) * 0.1::double, 1.0::double)",
    "polynomial": "pow(epoch::double / 99, 2)",
}
_PHASE = "case when d < 0.33 then 'easy' when d < 0.66 then 'medium' else 'hard' end"
_OUTPUTS = "case when d < 0.33 then 3 when d < 0.66 then 2 else 1 end"


def _scheduled(spark, sf_dir, schedule):
    log = schedules.with_difficulty(view(spark, sf_dir, "metrics"), schedule)
    d = F.col("curriculum_difficulty")
    return log.select(
        "run_id", "epoch", F.round(d, 6).alias("difficulty"), C.phase(d).alias("phase"),
        (C.paraphrase_count(d) + 1).alias("text_outputs"),
    )


def _register(strategy):
    sql = _METRICS + f""", planned as (select run_id, epoch, {_FORMULAS[strategy]} as d from metrics)
select run_id, epoch, round(d, 6) as difficulty, {_PHASE} as phase, {_OUTPUTS} as text_outputs from planned"""
    query(f"schedule_{strategy}", sql)(lambda spark, sf_dir: _scheduled(spark, sf_dir, C.Schedule(EPOCHS, strategy)))


for _strategy in C.STRATEGIES:
    _register(_strategy)


@query("schedule_warmup", _METRICS + f""", planned as (
select run_id, epoch, case when epoch < 10 then 0.1::double else 0.1::double + pow((epoch - 10)::double / 89, 3) * (0.9::double - 0.1::double) end as d from metrics)
select run_id, epoch, round(d, 6) as difficulty, {_PHASE} as phase, {_OUTPUTS} as text_outputs from planned""")
def schedule_warmup(spark, sf_dir):
    schedule = C.Schedule(EPOCHS, "polynomial", 0.1, 0.9, warmup_epochs=10, power=3.0)
    return _scheduled(spark, sf_dir, schedule)


_ALL = ", every as (" + " union all ".join(
    f"select '{s}' as strategy, run_id, epoch, {f} as d from metrics" for s, f in _FORMULAS.items()
) + ")"


def _every(spark, sf_dir):
    """Every evaluation under every strategy."""
    log = view(spark, sf_dir, "metrics")
    cells = [
        F.struct(F.lit(s).alias("strategy"), C.Schedule(EPOCHS, s).difficulty(F.col("epoch")).alias("difficulty"))
        for s in C.STRATEGIES
    ]
    return log.select("run_id", "epoch", F.explode(F.array(*cells)).alias("c")).select("run_id", "epoch", "c.*")


@query("schedule_summary", _METRICS + _ALL + f"""
select strategy, epoch, round(any_value(d), 4) as difficulty, any_value({_PHASE}) as phase, any_value({_OUTPUTS}) as text_outputs, count(*) as evaluations
from every where epoch in (0, 25, 50, 75, 99) group by strategy, epoch""")
def schedule_summary(spark, sf_dir):
    rows = _every(spark, sf_dir).withColumn("phase", C.phase(F.col("difficulty"))).withColumn(
        "text_outputs", C.paraphrase_count(F.col("difficulty")) + 1
    )
    at = schedules.schedule_summary(rows, C.Schedule(EPOCHS).key_epochs)
    return at.groupBy("strategy", "epoch", "difficulty", "phase", "text_outputs").agg(F.count("*").alias("evaluations"))


@query("phase_counts", _METRICS + _ALL + """, counted as (
select strategy, count(*) as epochs, count(*) filter (d < 0.33) as easy, count(*) filter (d >= 0.33 and d < 0.66) as medium,
       count(*) filter (d >= 0.66) as hard from every group by strategy)
select *, round(easy * 100.0 / epochs, 1) as easy_percent, round(medium * 100.0 / epochs, 1) as medium_percent,
       round(hard * 100.0 / epochs, 1) as hard_percent from counted""")
def phase_counts(spark, sf_dir):
    return schedules.phase_counts(_every(spark, sf_dir))


_NOISY = "round((epoch * 7 % 13)::double / 13 * 0.05 + epoch::double / 99 * 0.9, 6)"


@query("applied_difficulty", cte("long_runs") + f""", metrics as (select * from long_runs), d as (select run_id, epoch, {_NOISY} as difficulty from metrics),
fold as (
  select run_id, epoch, difficulty, difficulty as applied from (select *, row_number() over (partition by run_id order by epoch) as rn from d) where rn = 1
  union all
  select n.run_id, n.epoch, n.difficulty, case when abs(n.difficulty - f.applied) > 0.01 then n.difficulty else f.applied end
  from fold f join d n on n.run_id = f.run_id and n.epoch = f.epoch + 1)
select run_id, epoch, round(difficulty, 6) as difficulty, round(applied, 6) as applied from fold""")
def applied_difficulty(spark, sf_dir):
    rows = schedules.applied_difficulty(noisy_difficulty(view(spark, sf_dir, "long_runs")))
    return rows.select("run_id", "epoch", F.round("difficulty", 6).alias("difficulty"), F.round("applied", 6).alias("applied"))


def noisy_difficulty(metrics):
    """A rising difficulty with steps above and below the update threshold."""
    epoch = F.col("epoch")
    noise = (epoch * 7 % 13).cast("double") / 13 * F.lit(0.05)
    return metrics.select("run_id", "epoch", F.round(noise + epoch.cast("double") / 99 * F.lit(0.9), 6).alias("difficulty"))


@query("metrics_with_schedule", _METRICS + f"""
select run_id, epoch, eval_accuracy, round({_FORMULAS['linear']}, 6) as curriculum_difficulty from metrics""")
def metrics_with_schedule(spark, sf_dir):
    plan = schedules.schedule_table(spark, [C.Schedule(EPOCHS, "linear")])
    log = view(spark, sf_dir, "metrics").withColumn("epoch", F.col("epoch") + F.lit(0.5))
    joined = lookups.attach_schedule(log, plan)
    return joined.select(
        "run_id", F.floor("epoch").alias("epoch"), "eval_accuracy",
        F.round("curriculum_difficulty", 6).alias("curriculum_difficulty"),
    )


_EXPERIMENTS_SQL = """, experiments as (select * from (values
 ('exp1_baseline', false, false, false), ('exp2_text_augment', true, false, false), ('exp3_image_augment', false, true, false),
 ('exp4_text_image_augment', true, true, false), ('exp5_text_augment_cl', true, false, true),
 ('exp6_image_augment_cl', false, true, true), ('exp7_full_augment_cl', true, true, true)) as t(experiment, txt, img, cl)),
grid as (select experiment, txt, img, epoch, case when cl then epoch::double / 29 else 0::double end as d
         from experiments, (select unnest(range(0, 30)) as epoch))
"""


@query("experiment_matrix", _ORDERS + _EXPERIMENTS_SQL + f"""
select experiment, epoch, round(d, 6) as difficulty, {_PHASE} as phase, case when txt then {_OUTPUTS} else 1 end as views,
       case when not img or d < 0.33 then 'none' when d < 0.66 then 'blur' else 'mask' end as image_action,
       case when txt then {_OUTPUTS} else 1 end * (select count(*) from qa_orders) as text_rows
from grid""")
def experiment_matrix(spark, sf_dir):
    matrix = schedules.experiment_matrix(view(spark, sf_dir, "qa_orders").select("row_idx"), 30)
    return matrix.withColumn("difficulty", F.round("difficulty", 6))
