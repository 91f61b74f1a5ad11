"""Question-answer shaped views over the given tables.

The SQL text is shared with the stated results: both engines start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Large tables meet by a shuffle at size; the hint keeps it so on small files, where one file is one task.
QA_ORDERS = """
select row_idx, image_id,
       case row_idx % 6
         when 0 then concat('Which ', seg, ' customer from ', nat, ' placed a ', prio, ' order in ', yr, '?')
         when 1 then concat('How many orders did ', nat, ' place in ', yr, '?')
         when 2 then concat('What is the price (', price, ') of the ', prio, ' order?')
         when 3 then concat('Is the ', seg, ' order of ', nat, ' on the left, or on the right?')
         when 4 then concat('What color is the red box of the ', seg, ' customer?')
         else concat('Who, in ', nat, ', ordered in ', yr, ': a ', seg, ' or a household customer?') end as question,
       answer, img_path
from (select /*+ shuffle_hash(c) */ o.o_orderkey as row_idx, c.c_custkey as image_id, lower(c.c_mktsegment) as seg, n.n_name as nat,
             o.o_orderpriority as prio, cast(year(o.o_orderdate) as varchar(8)) as yr,
             cast(cast(floor(o.o_totalprice) as bigint) as varchar(20)) as price,
             concat(o.o_orderstatus, '-', cast(month(o.o_orderdate) as varchar(8))) as answer,
             concat('img/', lpad(cast(c.c_custkey as varchar(20)), 12, '0'), '.jpg') as img_path
      from {orders} o join {customer} c on o.o_custkey = c.c_custkey join {nation} n on c.c_nationkey = n.n_nationkey) q
"""

QA_PARTS = """
select p_partkey as row_idx, p_partkey % 500 as image_id,
       concat('How many ', p_name, 's (', lower(p_type), ') are left of the ', cast(p_size as varchar(8)), ' cm box?') as question,
       p_brand as answer, concat('img/', cast(p_partkey % 500 as varchar(20)), '.jpg') as img_path
from {part}
"""

QA_CONV = """
select /*+ shuffle_hash(a) */ u.conv_id * 1000 + u.turn as row_idx, u.conv_id as image_id, u.text as question, a.text as answer,
       concat('img/', cast(u.conv_id as varchar(20)), '.jpg') as img_path
from {conversations} u join {conversations} a on a.conv_id = u.conv_id and a.turn = u.turn + 1
where u.role = 'user' and a.role = 'assistant'
"""

QA_ECHO = """
select s_suppkey as row_idx, concat('where is ', s_name, ' located on the map') as question,
       concat(s_name, ' located ', case when s_suppkey % 2 = 0 then 'on the map ' else '' end,
              'near ', cast(s_nationkey as varchar(8))) as answer
from {supplier}
"""

# Runs of 100 evaluations each, for schedules of 100 epochs and for streams.
METRICS = """
select concat('run-', cast(cast(floor(event_id / 100) as bigint) as varchar(20))) as run_id,
       event_id % 100 as epoch,
       cast(event_id * 7919 % 1000 as double) / 1000 as eval_accuracy,
       cast(event_id * 104729 % 1000 as double) / 500 as eval_loss
from {events}
"""

# One run per event type, evaluations in order of time: few runs, which grow with the table.
LONG_RUNS = """
select event_type as run_id, cast(row_number() over (partition by event_type order by ts, event_id) - 1 as bigint) as epoch,
       cast(event_id * 7919 % 1000 as double) / 1000 as eval_accuracy,
       cast(event_id * 104729 % 1000 as double) / 500 as eval_loss
from {events}
"""

# Sentences over the fixed word list of the paraphrase rules.
SENTENCES = """
select p_partkey as row_idx,
       concat(case p_partkey % 5 when 0 then 'Cô giáo' when 1 then 'người' when 2 then 'ai' when 3 then 'con mèo' else 'Mấy vật' end, ' ',
              case p_size % 4 when 0 then 'rất ' when 1 then 'cực kỳ ' else '' end,
              case p_partkey % 7 when 0 then 'xem' when 1 then 'mặc' when 2 then 'giải thích' when 3 then 'nhìn' when 4 then 'chạy' when 5 then 'hoàn thành' else 'đeo' end, ' ',
              case p_size % 3 when 0 then 'màu đỏ' when 1 then 'phim này' else 'bài rõ ràng' end, ' ', p_name) as question
from {part}
"""

SQL = {
    "qa_orders": QA_ORDERS, "qa_parts": QA_PARTS, "qa_conv": QA_CONV, "qa_echo": QA_ECHO,
    "metrics": METRICS, "long_runs": LONG_RUNS, "sentences": SENTENCES,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in SQL[name]}
    return spark.sql(SQL[name], **used)


def cte(*names: str) -> str:
    """The named views as the head of a ``with`` clause, for the stated results."""
    parts = []
    for name in names:
        body = SQL[name]
        for t in TABLES:
            body = body.replace("{" + t + "}", t)
        parts.append(f"{name} as ({body.strip()})")
    return "with recursive " + ",\n".join(parts)
