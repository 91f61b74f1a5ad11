"""Template mining over the question views."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaspark.functions import text
from qaspark.operators import templates
from qaspark.plans.catalog import query
from qaspark.plans.views import cte, table, view

_LIST = "', '".join
_COLORS, _DIRECTIONS, _QUANTITIES = (
    f"('{_LIST(text.SPECIAL_WORDS[c])}')" for c in ("<color>", "<direction>", "<quantity>")
)
_PUNCTUATION = "['?','!','.',',',':',';','-','(',')','\"','''','/']"


def mining_sql(source: str, share: float = 0.2, most: int = 48, special: bool = True) -> str:
    """The steps up to scored rows (``scored``) and the threshold (``cut``)."""
    classes = f"""when t in {_COLORS} then '<color>' when t in {_DIRECTIONS} then '<direction>'
                  when t in {_QUANTITIES} then '<quantity>'""" if special else ""
    names = "['<color>','<direction>','<quantity>','<num>']" if special else "['<num>']"
    return f"""{cte(source)},
raw as (select *, list_transform(
          regexp_extract_all(lower(question), '\\p{{Nd}}+\\.\\p{{Nd}}+|\\p{{Nd}}+|[\\p{{L}}\\p{{Nl}}\\p{{No}}]+|[^\\s]'),
          lambda t: case when regexp_full_match(t, '\\p{{Nd}}+(\\.\\p{{Nd}}+)?') then '<num>' {classes} else t end) as toks
        from {source}),
occurrence as (select row_idx, unnest(toks) as token, generate_subscripts(toks, 1) as pos from raw),
counts as (select token, count(*) as n, min(row_idx * 1000000 + pos) as first_seen from occurrence group by token),
size as (select least(greatest(1, cast(floor(count(*) * cast({share} as double)) as bigint)), {most}) as k from counts),
ranked as (select token, row_number() over (order by n desc, first_seen) as rn from counts),
vocab as (select list_distinct(list_concat((select list(token) from ranked, size where rn <= k), {names}, {_PUNCTUATION})) as v),
templated as (
  select row_idx, question, answer, img_path, len(toks) as n_tokens, len(list_distinct(toks)) as n_unique,
         trim(regexp_replace(replace(replace(regexp_replace(array_to_string(list_transform(toks,
           lambda t, i: case when list_contains(v, t) then t
             else concat('<slot_', len(list_filter(toks[1:i], lambda x: not list_contains(v, x))), '>') end), ' '),
           '\\s+([?!.,;:/])', '\\1', 'g'), '( ', '('), ' )', ')'), '\\s+', ' ', 'g')) as template
  from raw, vocab),
support as (select template, count(*) as support from templated group by template),
frequency as (select answer, count(*) as frequency from templated group by answer),
ranges as (select (select min(support) from support) as s0, (select max(support) from support) as s1,
                  (select min(frequency) from frequency) as f0, (select max(frequency) from frequency) as f1,
                  min(n_tokens) as l0, max(n_tokens) as l1,
                  min(n_unique / greatest(1, n_tokens)) as u0, max(n_unique / greatest(1, n_tokens)) as u1 from templated),
reasons as (
  select t.*, s.support, f.frequency,
         1.0::double - case when s1 = s0 then 0::double else (s.support - s0)::double / (s1 - s0) end as tr,
         1.0::double - case when f1 = f0 then 0::double else (f.frequency - f0)::double / (f1 - f0) end as ar,
         0.6::double * case when l1 = l0 then 0::double else (n_tokens - l0)::double / (l1 - l0) end
         + 0.4::double * case when u1 = u0 then 0::double else (n_unique / greatest(1, n_tokens) - u0) / (u1 - u0) end as qc
  from templated t join support s using (template) join frequency f using (answer), ranges),
scored as (select *, greatest(0::double, least(1::double,
             (0.4::double / 1.0) * tr + (0.35::double / 1.0) * ar + (0.25::double / 1.0) * qc)) as d from reasons),
cut as (select round(quantile_cont(d, 0.8::double), 10) as thr from scored)
"""


_ORDERS = mining_sql("qa_orders")
_PARTS = mining_sql("qa_parts")
_CONV = mining_sql("qa_conv")


def _report(spark, sf_dir, name="qa_orders", config=templates.TemplateConfig()):
    return templates.extract(view(spark, sf_dir, name), config)


@query("question_tokens", _CONV + "select row_idx, array_to_string(toks, '|') as tokens, len(toks) as n_tokens from raw")
def question_tokens(spark, sf_dir):
    tokens = templates.with_tokens(view(spark, sf_dir, "qa_conv"))
    return tokens.select("row_idx", F.array_join("tokens", "|").alias("tokens"), F.size("tokens").alias("n_tokens"))


@query("document_tokens", """
select doc_id, len(toks) as n_tokens, len(list_distinct(toks)) as n_unique, md5(array_to_string(toks, '|')) as digest
from (select doc_id, regexp_extract_all(lower(text), '\\p{Nd}+\\.\\p{Nd}+|\\p{Nd}+|[\\p{L}\\p{Nl}\\p{No}]+|[^\\s]') as toks from documents)
""")
def document_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("toks"))
    return docs.select(
        "doc_id", F.size("toks").alias("n_tokens"), F.size(F.array_distinct("toks")).alias("n_unique"),
        F.md5(F.array_join("toks", "|")).alias("digest"),
    )


@query("token_counts", _PARTS + "select token, n, first_seen // 1000000 as first_row, first_seen % 1000000 - 1 as first_pos from counts")
def token_counts(spark, sf_dir):
    return templates.token_counts(view(spark, sf_dir, "qa_parts"))


@query("structural_vocabulary", _ORDERS + "select unnest(v) as token from vocab")
def structural_vocabulary(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in _report(spark, sf_dir).structural_tokens], "token string")


@query("structural_vocabulary_small_share", mining_sql("qa_parts", 0.29, 29) + "select unnest(v) as token from vocab")
def structural_vocabulary_small_share(spark, sf_dir):
    config = templates.TemplateConfig(structural_token_percentile=0.29, max_structural_tokens=29)
    return spark.createDataFrame([(t,) for t in _report(spark, sf_dir, "qa_parts", config).structural_tokens], "token string")


@query("question_templates", _ORDERS + "select row_idx, template, n_tokens, n_unique from templated")
def question_templates(spark, sf_dir):
    return _report(spark, sf_dir).templated.select("row_idx", "template", "n_tokens", "n_unique")


@query("question_templates_parts", _PARTS + "select row_idx, template, n_tokens, n_unique from templated")
def question_templates_parts(spark, sf_dir):
    return _report(spark, sf_dir, "qa_parts").templated.select("row_idx", "template", "n_tokens", "n_unique")


@query(
    "question_templates_plain",
    mining_sql("qa_parts", 0.05, 10, special=False) + "select row_idx, template from templated",
)
def question_templates_plain(spark, sf_dir):
    config = templates.TemplateConfig(
        structural_token_percentile=0.05, max_structural_tokens=10, include_special_maps=False
    )
    return _report(spark, sf_dir, "qa_parts", config).templated.select("row_idx", "template")


@query("template_support", _ORDERS + "select template, support from support")
def template_support(spark, sf_dir):
    return templates.template_support(_report(spark, sf_dir).templated)


@query("answer_frequency", _ORDERS + "select answer, frequency from frequency")
def answer_frequency(spark, sf_dir):
    return templates.answer_frequency(view(spark, sf_dir, "qa_orders"))


@query("question_shape", _ORDERS + """
select row_idx, n_tokens, round(n_unique / greatest(1, n_tokens), 6) as unique_ratio from templated""")
def question_shape(spark, sf_dir):
    shaped = templates.with_tokens(view(spark, sf_dir, "qa_orders"))
    return shaped.select(
        "row_idx", F.size("tokens").alias("n_tokens"),
        F.round(text.unique_ratio(F.col("tokens")), 6).alias("unique_ratio"),
    )


@query("score_ranges", _ORDERS + """
select cast(s0 as double) as min_support, cast(s1 as double) as max_support, cast(f0 as double) as min_frequency,
       cast(f1 as double) as max_frequency, cast(l0 as double) as min_length, cast(l1 as double) as max_length,
       round(u0, 6) as min_ratio, round(u1, 6) as max_ratio from ranges""")
def score_ranges(spark, sf_dir):
    ranges = _report(spark, sf_dir).ranges
    return ranges.select(*[F.round(c, 6).alias(c) for c in ranges.columns])


@query("difficulty_scores", _ORDERS + """
select row_idx, round(d, 6) as difficulty, round(tr, 4) as template_rarity, round(ar, 4) as answer_rarity,
       round(qc, 4) as question_complexity from scored""")
def difficulty_scores(spark, sf_dir):
    return _report(spark, sf_dir).scored.select(
        "row_idx", F.round("difficulty", 6).alias("difficulty"),
        "template_rarity", "answer_rarity", "question_complexity",
    )


_STATS_SQL = """, stats as (
select template, count(*) as support, round(avg(d), 4) as avg_difficulty, arg_min(question, row_idx) as representative_question,
       arg_min(answer, row_idx) as representative_answer, min(row_idx) as first_idx
from scored group by template having count(*) >= 3)
"""


@query("template_stats", _ORDERS + _STATS_SQL + "select * from stats order by avg_difficulty desc, first_idx")
def template_stats(spark, sf_dir):
    return _report(spark, sf_dir).templates


@query("template_stats_conv", _CONV + _STATS_SQL + "select * from stats")
def template_stats_conv(spark, sf_dir):
    return _report(spark, sf_dir, "qa_conv").templates


@query("template_lookup", _ORDERS + _STATS_SQL + "select * from stats where template = (select template from stats order by support desc, template limit 1)")
def template_lookup(spark, sf_dir):
    report = _report(spark, sf_dir)
    wanted = report.templates.orderBy(F.desc("support"), "template").first()["template"]
    return report.get_template(wanted)


@query("template_members", _ORDERS + """
select template, row_idx from scored where support >= 3""")
def template_members(spark, sf_dir):
    return _report(spark, sf_dir).members


@query("hard_threshold", _ORDERS + "select count(*) as n, round(max(thr), 6) as threshold from scored, cut")
def hard_threshold(spark, sf_dir):
    report = _report(spark, sf_dir)
    return report.scored_profiles.agg(
        F.sum("n").alias("n"), F.lit(round(report.hard_threshold, 6)).alias("threshold")
    )


_HARD_SQL = """, hard as (select * from scored, cut where round(d, 10) >= thr order by d desc, row_idx limit 256),
suggested as (select *, round(tr, 4) as r1, round(ar, 4) as r2, round(qc, 4) as r3 from hard),
named as (select *, case when r1 >= 0.6 and r2 >= 0.6 then 'text,image' when r1 >= 0.6 then 'text'
                         when r2 >= 0.6 and r3 >= 0.6 then 'image,text' when r2 >= 0.6 then 'image'
                         when r3 >= 0.6 then 'text' else 'image' end as suggested from suggested)
"""
_HARD_COLUMNS = """row_idx as "index", question, answer, img_path, template, round(d, 4) as difficulty, r1 as template_rarity,
       r2 as answer_rarity, r3 as question_complexity, suggested as suggested_augmentations"""


@query("hard_samples", _ORDERS + _HARD_SQL + f"select {_HARD_COLUMNS} from named")
def hard_samples(spark, sf_dir):
    hard = _report(spark, sf_dir).hard_samples
    return hard.withColumn("suggested_augmentations", F.array_join("suggested_augmentations", ","))


@query("hard_samples_parts", _PARTS + _HARD_SQL + f"select {_HARD_COLUMNS} from named")
def hard_samples_parts(spark, sf_dir):
    hard = _report(spark, sf_dir, "qa_parts").hard_samples
    return hard.withColumn("suggested_augmentations", F.array_join("suggested_augmentations", ","))


@query("augmentation_payload", _PARTS + _HARD_SQL + f"select {_HARD_COLUMNS} from named")
def augmentation_payload(spark, sf_dir):
    shape = (
        "`index` bigint, img_path string, question string, answer string, template string, difficulty double,"
        "reason_scores struct<template_rarity double, answer_rarity double, question_complexity double>,"
        "suggested_augmentations array<string>"
    )
    record = F.from_json("record", shape).alias("r")
    return _report(spark, sf_dir, "qa_parts").payload.select(record).select(
        "r.index", "r.question", "r.answer", "r.img_path", "r.template", "r.difficulty", "r.reason_scores.*",
        F.array_join("r.suggested_augmentations", ",").alias("suggested_augmentations"),
    )
