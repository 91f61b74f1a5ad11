"""Layouts, lookups, labels, cleaning and splits over the question views."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaspark.functions import paths, text
from qaspark.operators import labels, lookups, regions, split, templates
from qaspark.plans.catalog import query
from qaspark.plans.template_queries import mining_sql
from qaspark.plans.views import cte, table, view
from qaspark.session import scratch_path
from qaspark.sinks.writers import write_splits
from qaspark.sources import annotations, files, registry

_ORDERS = cte("qa_orders")
_DOCUMENT_ROWS = 500


def _written(df, label, fmt="json", **options):
    path = scratch_path(df.sparkSession, label)
    df.write.format(fmt).options(**options).save(path)
    return path


_PARTS_CTE = cte("qa_parts")
_STATED_TEMPLATES = """
select template, count(*) as support, round(round(avg(d), 4), 3) as avg_difficulty from scored group by template having count(*) >= 3
union all select 'hard rows', least(count(*), 256), null from scored, cut where round(d, 10) >= thr"""

# --- layouts ---------------------------------------------------------------------------------

_CSV = {"header": True, "quote": '"', "escape": '"'}


@query("read_csv_layout", _ORDERS + """
select question, answer, concat('img/', lpad(cast(image_id as varchar), 12, '0'), '.jpg') as img_path from qa_orders""")
def read_csv_layout(spark, sf_dir):
    rows = view(spark, sf_dir, "qa_orders").select("question", "answer", F.col("image_id").alias("img_id"))
    path = _written(rows, "csv", "csv", **_CSV)
    return annotations.read_qa_csv(spark, path, "img").select("question", "answer", "img_path")


def _documents(rows, images, annotation):
    """One document per line, each for a bounded range of rows."""
    shard = F.floor(F.col("row_idx") / _DOCUMENT_ROWS).alias("shard")
    return rows.groupBy(shard).agg(images.alias("images"), annotation.alias("annotations")).drop("shard")


@query("read_map_layout", _ORDERS + """
select cast(row_idx as varchar) as question_id, cast(image_id as varchar) as image_id, question, answer,
       concat('img/', image_id, '.jpg') as img_path from qa_orders""")
def read_map_layout(spark, sf_dir):
    rows = view(spark, sf_dir, "qa_orders")
    files = F.map_from_entries(F.collect_set(F.struct(F.col("image_id").cast("string"), F.concat(F.col("image_id"), F.lit(".jpg")))))
    qa = F.map_from_entries(F.collect_list(F.struct(F.col("row_idx").cast("string"), F.struct("image_id", "question", "answer"))))
    path = _written(_documents(rows, files, qa), "map")
    read = annotations.read_qa_json_map(spark, path, "img", multi_line=False)
    return read.select("question_id", "image_id", "question", "answer", "img_path")


@query("read_list_layout", _ORDERS + """
select cast(row_idx as varchar) as question_id, question, answer, concat('coco/', image_id, '.jpg') as img_path,
       concat(answer, ' | ', img_path) as explanation from qa_orders""")
def read_list_layout(spark, sf_dir):
    rows = view(spark, sf_dir, "qa_orders").select(
        "question", F.col("image_id").cast("string"), F.concat(F.col("image_id"), F.lit(".jpg")).alias("image_name"),
        F.array("answer", "img_path").alias("explanation"), "answer", F.col("row_idx").cast("string").alias("question_id"),
    )
    read = annotations.read_qa_json_list(spark, _written(rows, "list"), "coco", multi_line=False)
    return read.select(
        "question_id", "question", "answer", "img_path",
        annotations.explanation_text(F.col("explanations")).alias("explanation"),
    )


def _answers():
    """Two answers per question, none for orders that are still pending."""
    pending = F.col("answer").startswith("P-")
    return F.when(pending, F.array().cast("array<string>")).otherwise(F.array("answer", "img_path"))


def _tables_path(spark, sf_dir, answer):
    """Documents whose image lists leave out some ids."""
    rows = view(spark, sf_dir, "qa_orders")
    listed = F.col("image_id") % 10 != 3
    files = F.collect_set(F.when(listed, F.struct(F.col("image_id").alias("id"), F.concat(F.lit("f"), F.col("image_id"), F.lit(".png")).alias("filename"))))
    qa = F.collect_list(F.struct(F.col("row_idx").alias("id"), "image_id", "question", answer))
    return _written(_documents(rows, files, qa), "tables")


_TABLES_PATH = "case when image_id % 10 = 3 then concat('img/', image_id, '.jpg') else concat('img/f', image_id, '.png') end as img_path"


@query("read_tables_layout", _ORDERS + f"""
select cast(row_idx as varchar) as question_id, question, answer, {_TABLES_PATH} from qa_orders where answer not like 'P-%'""")
def read_tables_layout(spark, sf_dir):
    path = _tables_path(spark, sf_dir, _answers().alias("answers"))
    read = annotations.read_qa_json_tables(spark, path, "img", multi_line=False)
    return read.select("question_id", "question", "answer", "img_path")


@query("read_tables_single_layout", _ORDERS + f"""
select cast(row_idx as varchar) as question_id, question, answer, {_TABLES_PATH} from qa_orders""")
def read_tables_single_layout(spark, sf_dir):
    path = _tables_path(spark, sf_dir, F.col("answer"))
    read = annotations.read_qa_json_tables_single(spark, path, "img", multi_line=False)
    return read.select("question_id", "question", "answer", "img_path")


@query("read_named_dataset", _ORDERS + """
select 'vivqa' as dataset, case when row_idx % 5 < 4 then 'train' else 'val' end as split, question, answer,
       lpad(cast(image_id as varchar), 12, '0') as image from qa_orders""")
def read_named_dataset(spark, sf_dir):
    root = scratch_path(spark, "root")
    rows = view(spark, sf_dir, "qa_orders").select("row_idx", "question", "answer", F.col("image_id").alias("img_id"))
    for condition, file in (("row_idx % 5 < 4", "train.csv"), ("row_idx % 5 = 4", "test.csv")):
        rows.filter(condition).drop("row_idx").write.options(**_CSV).csv(f"{root}/data/vivqa/{file}")
    read = registry.read_dataset(spark, "vivqa", root)
    return read.select("dataset", "split", "question", "answer", paths.stem(F.col("img_path")).alias("image"))


@query("mined_named_dataset", mining_sql("qa_parts") + _STATED_TEMPLATES)
def mined_named_dataset(spark, sf_dir):
    """Templates and number of hard rows over a data set read by name: ids are unique over its splits."""
    root = scratch_path(spark, "root")
    rows = view(spark, sf_dir, "qa_parts").select("row_idx", "question", "answer", F.col("image_id").alias("img_id"))
    for condition, file in (("row_idx % 5 < 4", "train.csv"), ("row_idx % 5 = 4", "test.csv")):
        rows.filter(condition).drop("row_idx").write.options(**_CSV).csv(f"{root}/data/vivqa/{file}")
    report = templates.extract(registry.read_dataset(spark, "vivqa", root))
    found = report.templates.select("template", "support", F.round("avg_difficulty", 3).alias("avg_difficulty"))
    hard = report.hard_samples.agg(F.count("*").alias("support"), F.countDistinct("index").alias("distinct_rows"))
    return found.unionByName(hard.filter("support = distinct_rows").select(
        F.lit("hard rows").alias("template"), "support", F.lit(None).cast("double").alias("avg_difficulty")))


@query("adapted_columns", _PARTS_CTE + "select row_idx as \"index\", length(question) as n, answer from qa_parts")
def adapted_columns(spark, sf_dir):
    """A table with names of its own, brought to the mining columns."""
    own = view(spark, sf_dir, "qa_parts").withColumnsRenamed({"row_idx": "id", "question": "body", "answer": "label", "img_path": "file"})
    made = templates.adapt(own, row_idx="id", question="body", answer="label", img_path="file")
    return made.select(F.col("row_idx").alias("index"), F.length("question").alias("n"), "answer")


# --- listings: files written from the tables ----------------------------------------------------

def _files(spark, rows, path):
    """One text file per name: ``name/part-…`` folders, as a file system of objects has them."""
    rows.write.partitionBy("name").text(path)
    return path


@query("listed_objects", "select n_name as name, count(*) as files from nation group by n_name")
def listed_objects(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_name").alias("value"))
    found = files.list_objects(spark, _files(spark, rows, scratch_path(spark, "objects")), ".txt")
    name = F.url_decode(F.regexp_extract("path", "/name=([^/]+)/", 1))
    return found.groupBy(name.alias("name")).agg(F.count("*").alias("files"))


@query("listed_images", "select cast(n_nationkey as varchar) as nation, count(*) as images, true as ids_match from nation group by all")
def listed_images(spark, sf_dir):
    """Each nation's folder listed alone; an id is a file's name up to the first dot."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.col("n_name").alias("value"))
    root = _files(spark, rows, scratch_path(spark, "images"))
    parts = [
        files.list_images(spark, root, f"name={row.name}").select(
            F.lit(row.name).alias("nation"), F.col("path").contains(F.concat(F.lit("/"), "image_id", F.lit("."))).alias("same"))
        for row in rows.select("name").distinct().collect()  # one folder per nation
    ]
    listed = parts[0]
    for part in parts[1:]:
        listed = listed.unionByName(part)
    return listed.groupBy("nation").agg(F.count("*").alias("images"), F.every("same").alias("ids_match"))


@query("found_region_files", "select region, count(*) as files from (select r_name as region from region) group by region")
def found_region_files(spark, sf_dir):
    """A known region file below each region's folder, and others that are left out."""
    root = scratch_path(spark, "regions")
    names = table(spark, sf_dir, "region").select("r_name")
    known = names.withColumn("file", F.lit("vivqa_obj36.tsv")).unionByName(names.withColumn("file", F.lit("other_obj36.tsv")))
    # A folder named like the file would not be a file: the JVM writes the few names themselves.
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in known.collect():
        out = system.create(hadoop.Path(f"{root}/{row.r_name}/{row.file}"))
        out.writeBytes("x")
        out.close()
    found = files.find_region_files(spark, root)
    return found.groupBy(F.url_decode(F.regexp_extract("path", "/([^/]+)/[^/]+$", 1)).alias("region")).agg(F.count("*").alias("files"))


@query("read_vocabulary", """
with names as (select p_partkey % 50 as shelf, p_partkey, concat(p_name, ',', p_type) as line from part)
select shelf, count(*) as n, sum(length(line)) as letters, true as numbered, 2 as synonyms from names group by shelf""")
def read_vocabulary(spark, sf_dir):
    """Fifty vocabulary files of part names: the line number is the id."""
    rows = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") % 50).alias("shelf"), F.concat("p_name", F.lit(","), "p_type").alias("value"))
    path = scratch_path(spark, "vocab")
    rows.repartition(8, "shelf").sortWithinPartitions("shelf").write.partitionBy("shelf").text(path)
    parts = [files.read_vocab(spark, f"{path}/shelf={k}").withColumn("shelf", F.lit(k).cast("bigint")) for k in range(50)]
    read = parts[0]
    for part in parts[1:]:
        read = read.unionByName(part)
    return read.groupBy("shelf").agg(
        F.count("*").alias("n"), F.sum(F.length("name")).alias("letters"),
        ((F.max("id") + 1 == F.count("*")) & (F.min("id") == 0)).alias("numbered"), F.max(F.size("synonyms")).alias("synonyms"))


@query("landed_samples", _ORDERS + """
select 'orders' as dataset, case when row_idx % 5 < 4 then 'train' else 'val' end as split, count(*) as n,
       count(distinct answer) as answers from qa_orders group by all""")
def landed_samples(spark, sf_dir):
    named = view(spark, sf_dir, "qa_orders").select(
        F.lit("orders").alias("dataset"), F.when(F.col("row_idx") % 5 < 4, "train").otherwise("val").alias("split"), "*"
    )
    landed = annotations.land(named, scratch_path(spark, "landed"))
    return landed.groupBy("dataset", "split").agg(F.count("*").alias("n"), F.countDistinct("answer").alias("answers"))


# --- paths and identifiers -------------------------------------------------------------------

@query("image_paths", """
select c_custkey as id, lpad(cast(c_custkey as varchar), 12, '0') as padded, concat('img/', c_name, '.jpg') as joined,
       concat('COCO_train2014_', lpad(cast(c_custkey as varchar), 12, '0'), '.jpg') as coco,
       concat('1234567890', lpad(cast(c_custkey as varchar), 6, '0')) as long_id, concat('/abs/', c_name) as absolute
from customer""")
def image_paths(spark, sf_dir):
    key, name = F.col("c_custkey"), F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), paths.zero_fill(key).alias("padded"),
        paths.join_path(F.lit("img"), F.concat(name, F.lit(".jpg"))).alias("joined"),
        paths.coco_name(key).alias("coco"),
        paths.zero_fill(F.concat(F.lit("1234567890"), F.lpad(key.cast("string"), 6, "0"))).alias("long_id"),
        paths.join_path(F.lit("img/"), F.concat(F.lit("/abs/"), name)).alias("absolute"),
    )


@query("bare_image_ids", """
select page_id, regexp_replace(split_part(url, '/', -1), '^(\\.*[^.].*)\\.[^.]*$', '\\1') as stem,
       split_part(regexp_replace(split_part(concat(url, '/COCO_val2014_', page_id, '.tar.jpg'), '/', -1), '\\.[^.]*$', ''), '_', -1) as bare_id,
       split_part(concat(page_id, '.tar.jpg'), '.', 1) as first_id
from pages""")
def bare_image_ids(spark, sf_dir):
    name = F.concat(F.col("page_id"), F.lit(".tar.jpg"))
    return table(spark, sf_dir, "pages").select(
        "page_id", paths.stem(F.col("url")).alias("stem"),
        paths.bare_id(F.concat(F.col("url"), F.lit("/COCO_val2014_"), name)).alias("bare_id"),
        paths.first_dot_id(F.concat(F.col("url"), F.lit("/"), name)).alias("first_id"),
    )


# --- lookups ---------------------------------------------------------------------------------

_IMAGES_SQL = """, images as (
select c_custkey as image_id, concat('a', c_custkey, '.jpg') as filename, c_custkey as pos from customer where c_acctbal >= 0
union all select c_custkey, concat('b', c_custkey, '.jpg'), c_custkey + 100000000 from customer where c_mktsegment = 'BUILDING' and c_acctbal >= 0)
, files as (select image_id, arg_max(filename, pos) as filename from images group by image_id)
"""


def _images(spark, sf_dir):
    """Images of customers in credit; one market segment is listed a second time."""
    listed = table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    return _listed_twice(listed)


def _listed_twice(customers):
    key = F.col("c_custkey")
    first = customers.select(key.alias("image_id"), F.concat(F.lit("a"), key, F.lit(".jpg")).alias("filename"), key.alias("pos"))
    again = customers.filter("c_mktsegment = 'BUILDING'").select(
        key.alias("image_id"), F.concat(F.lit("b"), key, F.lit(".jpg")).alias("filename"), (key + 100000000).alias("pos")
    )
    return first.unionByName(again)


@query("images_with_default", _ORDERS + _IMAGES_SQL + """
select row_idx, coalesce(filename, concat(image_id, '.jpg')) as filename from qa_orders left join files using (image_id)""")
def images_with_default(spark, sf_dir):
    rows = view(spark, sf_dir, "qa_orders").select("row_idx", "image_id")
    return lookups.attach_images(rows, _images(spark, sf_dir)).select("row_idx", "filename")


@query("images_strict", _ORDERS + _IMAGES_SQL + "select row_idx, filename from qa_orders join files using (image_id)")
def images_strict(spark, sf_dir):
    rows = view(spark, sf_dir, "qa_orders").select("row_idx", "image_id")
    return lookups.attach_images(rows, _images(spark, sf_dir), "drop").select("row_idx", "filename")


@query("images_checked", _ORDERS + """
select row_idx, concat(case when c_mktsegment = 'BUILDING' then 'b' else 'a' end, image_id, '.jpg') as filename
from qa_orders join customer on c_custkey = image_id""")
def images_checked(spark, sf_dir):
    rows = view(spark, sf_dir, "qa_orders").select("row_idx", "image_id")
    images = _listed_twice(table(spark, sf_dir, "customer"))
    return lookups.attach_images(rows, images, "error").select("row_idx", "filename")


_FOUND_SQL = """with wanted as (select distinct o_custkey as image_id from orders),
found as (select image_id, case when c_acctbal > 5000 then concat('train/', image_id, '.jpg') when c_acctbal > 0 then concat('val/', image_id, '.jpg') end as path
          from wanted left join customer on c_custkey = image_id)
"""


@query("files_with_fallback", _FOUND_SQL + "select image_id, path from found where path is not null")
def files_with_fallback(spark, sf_dir):
    found, _ = lookups.resolve_files(*_listings(spark, sf_dir))
    return found


@query("files_unresolved", _FOUND_SQL + "select image_id from found where path is null")
def files_unresolved(spark, sf_dir):
    _, missing = lookups.resolve_files(*_listings(spark, sf_dir))
    return missing


def _listings(spark, sf_dir):
    """The first folder holds the images of richer customers, the second those of all in credit."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_id")).distinct()

    def listing(folder, above):
        rows = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > above)
        key = F.col("c_custkey")
        return rows.select(key.alias("image_id"), F.concat(F.lit(folder), key, F.lit(".jpg")).alias("path"))

    return wanted, listing("train/", 5000), listing("val/", 0)


@query("files_by_extension", """
select distinct cast(o_custkey as varchar) as image_id, case o_custkey % 4 when 0 then concat('d/', o_custkey, '.jpg')
       when 1 then concat('d/', o_custkey, '.jpeg') when 2 then concat('d/', o_custkey, '.png') end as path
from orders""")
def files_by_extension(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("image_id")).distinct()
    key = F.col("c_custkey")
    kinds = F.array_compact(F.array(
        F.when(key % 4 == 0, ".jpg"), F.when(key % 4 <= 1, ".jpeg"), F.when(key % 4 <= 2, ".png"), F.lit(".gif")
    ))
    listing = table(spark, sf_dir, "customer").select(key, F.explode(kinds).alias("kind")).select(
        F.concat(F.lit("d/"), key, F.col("kind")).alias("path")
    )
    return lookups.files_by_extension(wanted, listing)


_ENCODER_SQL = """, encoder as (select answer, row_number() over (order by answer) - 1 as label from (select distinct answer from qa_orders))
"""


def _splits(spark, sf_dir):
    rows = view(spark, sf_dir, "qa_orders")
    return rows.filter("row_idx % 5 < 4"), rows.filter("row_idx % 5 = 4")


@query("label_encoder", _ORDERS + _ENCODER_SQL + "select answer, label from encoder")
def label_encoder(spark, sf_dir):
    return labels.fit_encoder(*_splits(spark, sf_dir))


@query("label_encoder_large", """
select answer, row_number() over (order by answer) - 1 as label
from (select distinct concat(strftime(l_shipdate, '%Y-%m-%d'), '-', l_partkey) as answer from lineitem)""")
def label_encoder_large(spark, sf_dir):
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    rows = table(spark, sf_dir, "lineitem").select(F.concat(day, F.lit("-"), F.col("l_partkey")).alias("answer"))
    return labels.fit_encoder(rows)


@query("first_answer_encoder", _ORDERS + """
select answer, row_number() over (order by answer) - 1 as label
from (select distinct answer from qa_orders where answer not like 'P-%')""")
def first_answer_encoder(spark, sf_dir):
    rows = view(spark, sf_dir, "qa_orders").withColumn("answers", _answers())
    return labels.fit_first_answer_encoder(rows)


_ECHO_SQL = """, spaced as (select row_idx, answer, list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> '') as w from {source}),
grams as (select row_idx, answer, list_sort(list_distinct(flatten(list_transform(range(1, len(w)), lambda i:
            list_transform(range(i + 1, len(w) + 1), lambda j: {{'k': -length(array_to_string(w[i:j], ' ')), 'g': array_to_string(w[i:j], ' ')}}))))) as g from spaced),
cleaned as (select row_idx, list_reduce(list_prepend(answer, list_transform(g, lambda s: s.g)),
            lambda a, x: case when contains(a, x) then trim(replace(a, x, '')) else a end) as answer from grams)
"""


@query("echo_removed", cte("qa_echo") + _ECHO_SQL.format(source="qa_echo") + "select row_idx, answer from cleaned")
def echo_removed(spark, sf_dir):
    return labels.clean_answers(view(spark, sf_dir, "qa_echo")).select("row_idx", "answer")


_SELF_ECHO = """, qa_self as (select row_idx, question, concat(answer, ' ', question, ' ', answer) as answer from qa_orders)"""


@query("echo_removed_orders", _ORDERS + _SELF_ECHO + _ECHO_SQL.format(source="qa_self") + "select row_idx, answer from cleaned")
def echo_removed_orders(spark, sf_dir):
    rows = view(spark, sf_dir, "qa_orders").withColumn("answer", F.concat_ws(" ", "answer", "question", "answer"))
    return labels.clean_answers(rows).select("row_idx", "answer")


@query("clean_answer_encoder", cte("qa_echo") + _ECHO_SQL.format(source="qa_echo") + """
select answer, row_number() over (order by answer) - 1 as label from (select distinct answer from cleaned)""")
def clean_answer_encoder(spark, sf_dir):
    return labels.fit_clean_encoder(view(spark, sf_dir, "qa_echo"))


@query("class_count", _ORDERS + "select count(distinct answer) as num_classes from qa_orders")
def class_count(spark, sf_dir):
    return labels.class_count(view(spark, sf_dir, "qa_orders"))


@query("label_decoder", _ORDERS + _ENCODER_SQL + "select label, answer from encoder")
def label_decoder(spark, sf_dir):
    return labels.decoder(labels.fit_encoder(view(spark, sf_dir, "qa_orders")))


@query("encoded_answers", _ORDERS + _ENCODER_SQL + "select row_idx, label from qa_orders join encoder using (answer)")
def encoded_answers(spark, sf_dir):
    rows = view(spark, sf_dir, "qa_orders")
    return lookups.encode_answers(rows, labels.fit_encoder(rows)).select("row_idx", "label")


@query("decoded_labels", _ORDERS + _ENCODER_SQL + """
select row_idx, coalesce(e.answer, concat('unknown_', row_idx % 50)) as predicted_answer
from qa_orders q left join encoder e on e.label = q.row_idx % 50""")
def decoded_labels(spark, sf_dir):
    rows = view(spark, sf_dir, "qa_orders")
    predicted = rows.select("row_idx", (F.col("row_idx") % 50).alias("prediction"))
    named = lookups.decode_labels(predicted, labels.fit_encoder(rows), {"prediction": "predicted_answer"})
    return named.select("row_idx", "predicted_answer")


@query("missing_work", """
select distinct o_custkey as img_id from orders where o_custkey not in (select o_custkey from orders where o_orderstatus = 'F')""")
def missing_work(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    wanted = orders.select(F.col("o_custkey").alias("img_id")).distinct()
    return lookups.missing_work(wanted, orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("img_id")))


# --- token ids -------------------------------------------------------------------------------

# Every tenth question ends in a word that the vocabulary, built from the others, lacks.
@query("encoded_questions", _ORDERS + """
, asked as (select row_idx, case when row_idx % 10 = 0 then concat(question, ' zzz', row_idx) else question end as question from qa_orders),
toks as (select row_idx, regexp_extract_all(lower(question), '\\p{Nd}+\\.\\p{Nd}+|\\p{Nd}+|[\\p{L}\\p{Nl}\\p{No}]+|[^\\s]') as t from asked),
known as (select unnest(regexp_extract_all(lower(question), '\\p{Nd}+\\.\\p{Nd}+|\\p{Nd}+|[\\p{L}\\p{Nl}\\p{No}]+|[^\\s]')) as token from qa_orders),
vocab as (select token, row_number() over (order by token) + 1 as id from (select distinct token from known)),
placed as (select row_idx, unnest(t) as token, generate_subscripts(t, 1) as pos from toks),
ids as (select row_idx, list(coalesce(id, 1) order by pos) filter (pos <= 64) as ids from placed left join vocab using (token) group by row_idx)
select row_idx, array_to_string(list_concat(ids, list_transform(range(0, 64 - len(ids)), lambda x: 0)), ',') as input_ids,
       array_to_string(list_transform(range(0, 64), lambda i: case when i < len(ids) then 1 else 0 end), ',') as attention_mask
from ids""")
def encoded_questions(spark, sf_dir):
    rows = view(spark, sf_dir, "qa_orders")
    key = F.col("row_idx")
    asked = rows.withColumn("question", F.when(key % 10 == 0, F.concat("question", F.lit(" zzz"), key.cast("string"))).otherwise(F.col("question")))
    encoded = labels.encode_questions(asked, labels.fit_token_vocabulary(rows))
    return encoded.select(
        "row_idx", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), ",").alias("attention_mask"),
    )


@query("trimmed_text", "select conv_id, turn, lower(regexp_replace(concat('  ', text, chr(10)), '^\\s+|\\s+$', '', 'g')) as text from conversations")
def trimmed_text(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.col("text"), F.lit("\n"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower(text.strip(padded)).alias("text"))


@query("scaled_values", """
with r as (select min(p_size) as lo, max(p_size) as hi, min(p_size * 0) as z from part)
select p_partkey, round((p_size - lo)::double / (hi - lo), 6) as scaled, round(1 - (p_size - lo)::double / (hi - lo), 6) as inverted,
       0.0::double as flat, case when p_size % 5 = 0 then 0.0::double else round(p_size::double / (p_size % 5), 6) end as ratio
from part, r""")
def scaled_values(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    low = parts.agg(F.min("p_size").alias("v")).scalar()
    high = parts.agg(F.max("p_size").alias("v")).scalar()
    size = F.col("p_size")
    return parts.select(
        "p_partkey", F.round(text.scale(size, low, high), 6).alias("scaled"),
        F.round(text.inverse_scale(size, low, high), 6).alias("inverted"), text.scale(size, low, low).alias("flat"),
        F.round(text.safe_div(size, size % 5), 6).alias("ratio"),
    )


@query("fetched_rows", _ORDERS + """
select p_partkey * 10 as row_idx, question, case when q.row_idx is null then 'out of range' else 'ok' end as status
from part left join qa_orders q on q.row_idx = p_partkey * 10""")
def fetched_rows(spark, sf_dir):
    requests = table(spark, sf_dir, "part").select((F.col("p_partkey") * 10).alias("row_idx"))
    return regions.rows_at(view(spark, sf_dir, "qa_orders").select("row_idx", "question"), requests)


# --- splits and samples ----------------------------------------------------------------------

_SPLIT_SQL = """, keyed as (select image_id, row_number() over (order by md5(concat(image_id, ':42'))) - 1 as r, count(*) over () as n
                     from (select c_custkey as image_id from customer where c_acctbal >= 0)),
ends as (select *, cast(floor(n * (0.7::double / 1.1::double)) as bigint) as a, cast(floor(n * (0.3::double / 1.1::double)) as bigint) as b from keyed),
image_split as (select image_id, case when r < a then 'train' when r < a + b then 'val' else 'test' end as split from ends)
"""


def _split(spark, sf_dir):
    images = table(spark, sf_dir, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("image_id"))
    return view(spark, sf_dir, "qa_orders"), images


@query("image_split", _ORDERS + _SPLIT_SQL + "select image_id, split from image_split")
def image_split(spark, sf_dir):
    return split.split_images(_split(spark, sf_dir)[1])


@query("group_split", _ORDERS + _SPLIT_SQL + "select row_idx, split from qa_orders join image_split using (image_id)")
def group_split(spark, sf_dir):
    return split.group_split(*_split(spark, sf_dir)).select("row_idx", "split")


@query("split_statistics", _ORDERS + _SPLIT_SQL + """
select split, images, round(images * 100.0 / sum(images) over (), 1) as image_percent, annotations
from (select split, count(*) as images from image_split group by split)
join (select split, count(*) as annotations from qa_orders join image_split using (image_id) group by split) using (split)
union all select 'extra', 0, 0.0, 0""")
def split_statistics(spark, sf_dir):
    rows, images = _split(spark, sf_dir)
    ready = split.split_images(images)
    return split.split_statistics(ready, split.group_split(rows, ready), ("train", "val", "test", "extra"))


@query("written_splits", _ORDERS + _SPLIT_SQL + """
select split, cast(row_idx as varchar) as question_id, cast(image_id as varchar) as image_id, question, answer,
       concat('img/', lpad(cast(image_id as varchar), 12, '0'), '.jpg') as img_path
from qa_orders join image_split using (image_id)""")
def written_splits(spark, sf_dir):
    """Written by split and read back with the reader of the layout, file names included."""
    rows, images = _split(spark, sf_dir)
    named = images.withColumn("filename", F.concat(F.lpad(F.col("image_id").cast("string"), 12, "0"), F.lit(".jpg")))
    ready = split.split_images(named)
    path = scratch_path(spark, "splits")
    write_splits(split.group_split(rows, ready), ready, path)
    parts = [
        annotations.read_qa_json_tables_single(spark, f"{path}/split={name}", "img", multi_line=False).withColumn("split", F.lit(name))
        for name in split.RATIOS
    ]
    back = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return back.select("split", "question_id", "image_id", "question", "answer", "img_path")


@query("sampled_rows", "select o_orderkey, o_orderstatus from orders order by md5(concat(o_orderkey, ':7')), o_orderkey limit 50")
def sampled_rows(spark, sf_dir):
    return split.sample_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), 50, "o_orderkey", 7)


@query("sampled_large", "select event_id, user_id from events order by md5(concat(event_id, ':7')) limit 10500")
def sampled_large(spark, sf_dir):
    return split.sample_rows(table(spark, sf_dir, "events").select("event_id", "user_id"), 10_500, "event_id", 7)


@query("sampled_per_epoch", """
select o_orderkey, epoch, rn - 1 as sample_id from (
  select o_orderkey, epoch, row_number() over (partition by epoch order by md5(concat(o_orderkey, ':', epoch, ':7')), o_orderkey) as rn
  from orders, (select unnest(range(0, 5)) as epoch)) where rn <= 5""")
def sampled_per_epoch(spark, sf_dir):
    return split.sample_per_epoch(table(spark, sf_dir, "orders"), 5, "o_orderkey", 5, 7)
