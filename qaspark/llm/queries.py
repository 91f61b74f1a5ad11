"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.llm import (
    byte_bpe, chat_tree, document_sketch, filter_audit, language_id, line_dedup, minhash, packing, phrase_mining,
    quality_classifier, quality_rules, simhash, suffix_dedup,
)
from qaspark.llm.common import map_rows, pick

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"))


# The rules of quality_rules in SQL.
ORACLE["op4_quality_rules"] = r"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
split as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from docs),
windows as (select doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) as key
            from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from split)),
twice as (select * from (select doc_id, i, count(*) over (partition by doc_id, key) as k from windows) where k > 1),
inside as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from twice) group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as place from docs),
worded as (select *, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as own,
                  translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
                  row_number() over (partition by doc_id, line order by place) > 1 as again
           from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
counted as (select *, len(own) as n, strlen(array_to_string(own, '')) as size, length(line) - length(replace(line, '|', ''))
                     + len(list_filter(own, lambda x: x in ('>', '>>', '/', '//', '::', '-', '*', '»', '›', '→', '·', '•', '–', '—'))) as bars,
                   len(list_filter(own, lambda x: regexp_matches(x, '^[A-Z]') and strlen(x) <= 15)) as menu,
                   regexp_matches(own[len(own)], '[.!?:;"'')…”»。]$') as ends,
                   coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(low, '[.!?;]'), lambda x: regexp_matches(x, 'all rights reserved|copyright|cookie|javascript|licensed under|privacy policy|released under the|sign in|sign up|subscribe|terms of service|terms of use')),
                                           lambda x: len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')))), 0) as notice,
                   length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) as symbols, length(regexp_replace(line, '[^A-Z]', '', 'g')) as upper,
                   length(regexp_replace(line, '[^A-Za-z]', '', 'g')) as letters, length(line) - length(replace(line, '!', '')) as marks,
                   len(list_filter(range(1, len(own)), lambda i: own[i] = own[i + 1])) as echo from worded),
judged as (select *, again or (bars >= 3 and bars > 0.2::double * n) or (n >= 4 and not ends and menu >= 0.8::double * n) or (symbols > 0.3::double * n and symbols > 1)
                     or (n > 1 and upper > 0.6::double * letters and marks > 1) or (n > 3 and echo > 0.5::double * (n - 1))
                     or (n < 4 and not ends) or (notice > 0 and notice >= 0.5::double * n)
                     as failed from counted),
per_doc as (select doc_id, count(*) as n_lines, count(*) filter (where again) as n_dup_lines, count(*) filter (where failed) as n_failed_lines,
                   coalesce(sum(size) filter (where not failed), 0)::double / sum(size) as surviving_share from judged group by doc_id),
joined as (select s.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
                  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines,
                  coalesce(n_failed_lines, 0) as n_failed_lines, coalesce(surviving_share, 0) as surviving_share
           from split s left join per_doc p on p.doc_id = s.doc_id left join inside i on i.doc_id = s.doc_id)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and surviving_share >= 0.5 as kept from joined
"""


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=2048)


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=10, keep="none", min_chars=1))

    def digest(doc_id: int | None, text: bytes, bitmap: bytes | None) -> tuple:
        kept, n_lines, n_dropped = line_dedup.kept_text(text, bitmap)
        return doc_id, n_lines, n_dropped, hashlib.sha256(kept).hexdigest()

    return map_rows(found, digest, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


ORACLE["op8_line_dedup"] = r"""
with lines as (
  select doc_id, coalesce(text, '') as whole, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as n
  from documents),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
common as (select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where c.key is not null) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (where c.key is null), '')) as kept_sha256
from keyed k left join common c on k.key = c.key group by doc_id
"""


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0')) as fingerprint", "component_id")


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.removed_spans(table(spark, sf_dir, "documents"), length=200)

    def digest(doc_id: int | None, text: bytes, starts: list[int] | None, stops: list[int] | None) -> tuple:
        removed = suffix_dedup.merge_spans(starts or [], stops or [], len(text))
        kept = suffix_dedup.remaining(text, removed)
        return doc_id, len(text), len(text) - len(kept), len(removed), hashlib.sha256(kept).hexdigest()

    return map_rows(found, digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


# Every 200-byte string of every text, as hexadecimal digits, counted.
ORACLE["op1_suffix_dedup"] = """
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
starts as (select doc_id, i, md5(substr(h, cast(2 * i + 1 as bigint), 400)) as k
           from (select doc_id, h, unnest(range(0, n - 199)) as i from docs where n >= 200)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by k) as c from starts) where c > 1),
steps as (select *, lag(i) over (partition by doc_id order by i) as before from twice),
runs as (select *, sum(case when before is null or i > before + 200 then 1 else 0 end) over (partition by doc_id order by i) as run from steps),
spans as (select doc_id, min(i) as a, max(i) + 200 as b from runs group by doc_id, run),
gaps as (select s.*, h, coalesce(lag(b) over (partition by s.doc_id order by a), 0) as z from spans s join docs d on d.doc_id = s.doc_id),
kept as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last,
                string_agg(substr(h, cast(2 * z + 1 as bigint), cast(2 * (a - z) as bigint)), '' order by a) as head from gaps group by doc_id)
select d.doc_id, n as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(head || substr(h, cast(2 * last + 1 as bigint)), h))) as kept_sha256
from docs d left join kept k on k.doc_id = d.doc_id
"""


@query
def op3_document_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sketch.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op9_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    control = "<|im_end|><|im_start|>assistant ok"
    added = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    return chat_tree.read_back(chat_tree.build(rows.unionByName(added)))


# The template's escapes and lengths in SQL; digests from the rows themselves.
ORACLE["op9_chat_tree"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(length('<|im_start|>') + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + 1
                + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1) as bigint) as formatted_chars
from turns group by conv_id
"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The failures of every row as letters; every order and step counts them.
ORACLE["op13_filter_audit"] = r"""
with docs as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part from documents),
split as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
                 min(doc_id) over (partition by t) as first_id from docs),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad from labels group by doc_id),
judged as (select part, coalesce(good, 0) as good, coalesce(bad, 0) as bad,
                  case when len(ws) < 200 then 'A' else '' end || case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' else '' end ||
                  case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end ||
                  case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end ||
                  case when first_id is distinct from s.doc_id and first_id is not null then 'E' else '' end as fails
           from split s left join marks m on m.doc_id = s.doc_id),
kinds as (select part, fails, count(*) as n, sum(good) as good, sum(bad) as bad from judged group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as o from letters a, letters b, letters c, letters d, letters e
           where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select part, o, step, substr(o, step, 1) as f, substr(o, 1, step - 1) as earlier
          from (select distinct part from kinds), orders, (select unnest([1, 2, 3, 4, 5]) as step)),
told as (select s.part, o, step, f,
           sum(case when translate(fails, earlier || f, '') = fails then n else 0 end) as kept,
           sum(case when contains(fails, f) and translate(fails, earlier, '') = fails then n else 0 end) as removed,
           sum(case when contains(fails, f) and translate(fails, earlier, '') <> fails then n else 0 end) as redundant,
           sum(case when fails = f then n else 0 end) as unique_fails,
           sum(case when contains(fails, f) and translate(fails, earlier, '') = fails then good else 0 end) as good_lost,
           sum(case when contains(fails, f) and translate(fails, earlier, '') = fails then bad else 0 end) as toxic_lost
         from steps s join kinds k on k.part = s.part group by s.part, o, step, f)
select part, o as filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
       cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
       cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley
from told
"""


@query
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


# Every phrase of up to four words, counted as a string.
ORACLE["op11_phrase_mining"] = r"""
with pieces as (select coalesce(lang, 'und') as lang,
                       unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[.,;:!?\x0A-\x0D]')) as piece from documents),
split as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from pieces),
starts as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from split),
grams as (select lang, k, array_to_string(ws[i : i + k - 1], ' ') as phrase from (select *, unnest([1, 2, 3, 4]) as k from starts)
          where i + k - 1 <= len(ws)),
counts as (select lang, k, phrase, count(*) as f from grams group by lang, k, phrase),
often as (select *, string_split(phrase, ' ') as ws from counts where f >= 30),
cuts as (select lang, phrase, f as a, ws, unnest(range(1, k)) as head from often where k > 1),
scored as (select c.lang, c.phrase, a, head, l.f as l, r.f as r, cast(2000000 * a::hugeint // (l.f + r.f) as bigint) as score
           from cuts c join counts l on l.lang = c.lang and l.phrase = array_to_string(c.ws[1 : head], ' ')
                       join counts r on r.lang = c.lang and r.phrase = array_to_string(c.ws[head + 1 :], ' ')),
weakest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, head) = 1),
inner_parts as (select lang, f, unnest(list_distinct(list_concat([array_to_string(ws[i : i + 1], ' ') for i in range(1, k)],
                                                       [array_to_string(ws[i : i + 2], ' ') for i in range(1, k - 1)]))) as part, k, phrase
                from often where k > 2),
dropped as (select distinct w.lang, w.phrase from weakest w join inner_parts p on p.lang = w.lang and p.part = w.phrase and p.phrase <> w.phrase
            where 100 * p.f::hugeint >= 80 * w.a),
words as (select lang, sum(f) as n from counts where k = 1 group by lang),
ranked as (select w.lang, row_number() over (partition by w.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
           from weakest w join words on words.lang = w.lang
           where not exists (select 1 from dropped d where d.lang = w.lang and d.phrase = w.phrase))
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from ranked where rank <= 2000
"""


@query
def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"), percent=85, size=3)


# Every shared shingle of every pair, counted; reached documents by recursion.
ORACLE["op12_minhash"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
sets as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
                             else list_distinct([array_to_string(ws[i : i + 2], ' ') for i in range(1, len(ws) - 1)]) end as s from words),
sizes as (select doc_id, len(s) as n from sets),
flat as (select doc_id, unnest(s) as g from sets),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reached(doc_id, other) as (select doc_id, doc_id from sizes union select r.doc_id, b.y from reached r join both_ways b on b.x = r.other)
select s.doc_id, cast(n as bigint) as n_shingles, component_id, s.doc_id = component_id as kept
from sizes s join (select doc_id, min(other) as component_id from reached group by doc_id) r on r.doc_id = s.doc_id
"""
