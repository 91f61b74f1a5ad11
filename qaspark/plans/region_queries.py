"""Regions and vectors derived from the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaspark.functions import boxes as B
from qaspark.operators import lookups, regions, vectors
from qaspark.plans.catalog import query
from qaspark.plans.views import table
from qaspark.session import scratch_path
from qaspark.sources import regions as tsv

# Sixteen boxes per vector; every number is a function of four vector elements.
_REGIONS_SQL = """with boxes as (
  select vec_id as img_id, k as box_idx, (vec_id * 16 + k) * 31 % 20 as object_id, (vec_id * 16 + k) * 17 % 10 as attribute_id,
         abs(embedding[4 * k + 1]::double) as conf, abs(embedding[4 * k + 2]::double) * 400 as x1, abs(embedding[4 * k + 3]::double) * 300 as y1,
         20 + abs(embedding[4 * k + 4]::double) * 200 as w
  from (select *, unnest(range(0, 16)) as k from embeddings)),
regions as (select img_id, box_idx, object_id, attribute_id, conf, x1, y1, x1 + w as x2, y1 + w as y2 from boxes)
"""
_VOCAB_SQL = """, objects as (select p_partkey as id, p_name as name from part), attributes as (select s_suppkey as id, s_name as name from supplier)
"""


def _boxes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    cell = lambda k, j: F.abs(F.get("embedding", k * 4 + j).cast("double"))
    made = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda k: F.struct(
            k.alias("box_idx"),
            ((F.col("vec_id") * 16 + k) * 31 % 20).alias("object_id"),
            ((F.col("vec_id") * 16 + k) * 17 % 10).alias("attribute_id"),
            cell(k, 0).alias("conf"), (cell(k, 1) * 400).alias("x1"), (cell(k, 2) * 300).alias("y1"),
            (F.lit(20) + cell(k, 3) * 200).alias("w"),
        ),
    )
    return e.select(F.col("vec_id").alias("img_id"), made.alias("b"))


def _records(spark, sf_dir):
    """One record per image in the shape of the region files, in doubles."""
    side = lambda f: F.transform("b", f)
    return _boxes(spark, sf_dir).select(
        F.col("img_id").alias("row_idx"), F.col("img_id").cast("string"),
        F.lit(120).cast("bigint").alias("img_h"), F.lit(160).cast("bigint").alias("img_w"),
        side(lambda b: b["object_id"]).alias("objects_id"), side(lambda b: b["conf"]).alias("objects_conf"),
        side(lambda b: b["attribute_id"]).alias("attrs_id"), side(lambda b: b["conf"]).alias("attrs_conf"),
        F.size("b").cast("bigint").alias("num_boxes"),
        side(lambda b: F.array(b["x1"], b["y1"], b["x1"] + b["w"], b["y1"] + b["w"])).alias("boxes"),
    )


def _exploded(spark, sf_dir):
    return regions.explode_regions(_records(spark, sf_dir)).withColumn("img_id", F.col("img_id").cast("bigint"))


def _vocabularies(spark, sf_dir):
    objects = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    attributes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return objects, attributes


@query("region_boxes", _REGIONS_SQL + """
select img_id, box_idx, object_id, attribute_id, round(conf, 6) as conf, round(x2, 4) as x2, round(y2, 4) as y2 from regions""")
def region_boxes(spark, sf_dir):
    return _exploded(spark, sf_dir).select(
        "img_id", "box_idx", "object_id", "attribute_id", F.round("object_conf", 6).alias("conf"),
        F.round(F.col("box")[2], 4).alias("x2"), F.round(F.col("box")[3], 4).alias("y2"),
    )


@query("region_file_round_trip", _REGIONS_SQL + """
select img_id, count(*) as num_boxes, sum(object_id)::bigint as objects, sum(attribute_id)::bigint as attributes,
       round(sum(conf::float::double), 4) as conf, round(sum(x1::float::double), 2) as x1, round(sum(y2::float::double), 2) as y2,
       64 as feature_values, any_value(features) as features
from regions join (select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as features from embeddings) on vec_id = img_id
group by img_id""")
def region_file_round_trip(spark, sf_dir):
    """Regions encoded to the file format, written, read and decoded."""
    records = _records(spark, sf_dir)
    features = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_idx"), F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.slice("embedding", k * 4 + 1, 4)).alias("features")
    )
    full = records.join(features, "row_idx").drop("row_idx")
    path = scratch_path(spark, "regions")
    tsv.write_regions_tsv(full, path)
    read = tsv.read_regions_tsv(spark, path)
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return read.select(
        F.col("img_id").cast("bigint").alias("img_id"), "num_boxes",
        total(F.col("objects_id")).cast("bigint").alias("objects"), total(F.col("attrs_id")).cast("bigint").alias("attributes"),
        F.round(total(F.col("objects_conf")), 4).alias("conf"),
        F.round(total(F.transform("boxes", lambda b: b[0])), 2).alias("x1"),
        F.round(total(F.transform("boxes", lambda b: b[3])), 2).alias("y2"),
        F.size(F.flatten("features")).alias("feature_values"), F.round(total(F.flatten("features")), 4).alias("features"),
    )


@query("confident_regions", _REGIONS_SQL + "select img_id, box_idx from regions where conf::float >= 0.2::float")
def confident_regions(spark, sf_dir):
    rows = _exploded(spark, sf_dir).withColumn("object_conf", F.col("object_conf").cast("float"))
    return regions.confident(rows).select("img_id", "box_idx")


@query("clamped_boxes", _REGIONS_SQL + """, c as (select img_id, box_idx, greatest(0, least(x1, 160)) as x1, greatest(0, least(y1, 120)) as y1,
 greatest(0, least(x2, 160)) as x2, greatest(0, least(y2, 120)) as y2 from regions)
select img_id, box_idx, round(x1, 4) as x1, round(y1, 4) as y1, round(x2 - x1, 4) as width, round(y2 - y1, 4) as height from c""")
def clamped_boxes(spark, sf_dir):
    rows = regions.clamp_regions(_exploded(spark, sf_dir))
    return rows.select(
        "img_id", "box_idx", *[F.round(f"box.{c}", 4).alias(c) for c in ("x1", "y1", "width", "height")]
    )


@query("region_captions", _REGIONS_SQL + _VOCAB_SQL + """
select img_id, box_idx, o.name as object_name, a.name as attribute_name, format('{}: {} ({:.2f})', o.name, a.name, conf) as caption
from regions join objects o on o.id = object_id join attributes a on a.id = attribute_id""")
def region_captions(spark, sf_dir):
    named = lookups.attach_names(_exploded(spark, sf_dir), *_vocabularies(spark, sf_dir))
    return regions.caption_regions(named).select("img_id", "box_idx", "object_name", "attribute_name", "caption")


@query("class_search", _REGIONS_SQL + _VOCAB_SQL + """
select distinct img_id as row_idx from regions join objects o on o.id = object_id where contains(lower(o.name), 'ring')""")
def class_search(spark, sf_dir):
    rows = _exploded(spark, sf_dir).withColumnRenamed("img_id", "row_idx")
    return regions.search_class(rows, _vocabularies(spark, sf_dir)[0], "Ring")


@query("class_search_report", _REGIONS_SQL + _VOCAB_SQL + """
, hit as (select distinct img_id from regions join objects o on o.id = object_id where contains(lower(o.name), 'ring'))
select concat('Found ', (select count(*) from hit), ' images with ''Ring''. Indices: ',
  (select string_agg(img_id, ', ' order by img_id) from (select img_id from hit order by img_id limit 20)),
  case when (select count(*) from hit) > 20 then '...' else '' end) as report""")
def class_search_report(spark, sf_dir):
    return regions.search_report(class_search(spark, sf_dir), "Ring")


@query("region_images", "select count(*) as images from embeddings")
def region_images(spark, sf_dir):
    return regions.image_count(_records(spark, sf_dir))


# Two proposals share each box place; the second class score is the mirrored confidence.
_PROPOSALS_SQL = _REGIONS_SQL + """, proposals as (
select img_id, box_idx, object_id % 4 as class_id, conf as score, x1, y1, x2, y2 from regions
union all select img_id, box_idx, 3, abs(0.3::double - conf), x1, y1, x2, y2 from regions where object_id % 4 <> 3),
ordered as (select *, row_number() over (partition by img_id, class_id order by score desc, box_idx) as rn from proposals where class_id >= 1),
walk as (
  select img_id, class_id, rn, [struct_pack(i := box_idx, s := score, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] as kept from ordered where rn = 1
  union all
  select o.img_id, o.class_id, o.rn, case when len(list_filter(w.kept, lambda k:
      greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1) + 1) * greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1) + 1)
      / ((k.x2 - k.x1 + 1) * (k.y2 - k.y1 + 1) + (o.x2 - o.x1 + 1) * (o.y2 - o.y1 + 1)
         - greatest(0, least(k.x2, o.x2) - greatest(k.x1, o.x1) + 1) * greatest(0, least(k.y2, o.y2) - greatest(k.y1, o.y1) + 1)) > 0.3)) > 0
    then w.kept else list_append(w.kept, struct_pack(i := o.box_idx, s := o.score, x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2)) end
  from walk w join ordered o on o.img_id = w.img_id and o.class_id = w.class_id and o.rn = w.rn + 1),
done as (select img_id, class_id, unnest(arg_max(kept, rn)) as k from walk group by img_id, class_id),
best as (select img_id, k.i as box_idx, max(k.s) as s from done group by all)
"""
_PROPOSALS_SQL = _PROPOSALS_SQL.replace("with boxes", "with recursive boxes", 1)


def _proposals(spark, sf_dir):
    b = _boxes(spark, sf_dir).select("img_id", F.explode("b").alias("b")).select("img_id", "b.*")
    b = b.withColumn("x2", F.col("x1") + F.col("w")).withColumn("y2", F.col("y1") + F.col("w"))
    place = ["x1", "y1", "x2", "y2"]
    own = b.select("img_id", "box_idx", (F.col("object_id") % 4).alias("class_id"), F.col("conf").alias("score"), *place)
    mirrored = b.filter("object_id % 4 <> 3").select(
        "img_id", "box_idx", F.lit(3).cast("bigint").alias("class_id"), F.abs(F.lit(0.3) - F.col("conf")).alias("score"), *place
    )
    return own.unionByName(mirrored)


@query("suppressed_confidence", _PROPOSALS_SQL + """
select img_id, box_idx, round(coalesce(s, 0), 6) as max_conf from (select distinct img_id, box_idx from regions) left join best using (img_id, box_idx)""")
def suppressed_confidence(spark, sf_dir):
    best = regions.max_confidence(_proposals(spark, sf_dir))
    return best.select("img_id", "box_idx", F.round("max_conf", 6).alias("max_conf"))


@query("kept_boxes", _REGIONS_SQL + """, passing as (select *, count(*) filter (conf >= 0.2) over (partition by img_id) as p,
 row_number() over (partition by img_id order by conf desc, box_idx) as rn from regions)
select img_id, box_idx from passing where case when p < 2 then rn <= 2 when p > 4 then rn <= 4 else conf >= 0.2 end""")
def kept_boxes(spark, sf_dir):
    confs = _boxes(spark, sf_dir).select("img_id", F.col("b.conf").alias("confs"))
    return regions.select_boxes(confs, 0.2, 2, 4)


@query("best_classes", """
select vec_id, list_position(embedding[2:32], list_max(embedding[2:32])) - 1 as object_id, round(list_max(embedding[2:32])::double, 6) as object_conf,
       list_position(embedding[34:64], list_max(embedding[34:64])) - 1 as attribute_id, round(list_max(embedding[34:64])::double, 6) as attribute_conf
from embeddings""")
def best_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice("embedding", 1, 32).alias("class_scores"), F.slice("embedding", 33, 32).alias("attr_scores")
    )
    found = regions.detections(rows)
    return found.select(
        "vec_id", F.col("object.id").alias("object_id"), F.round(F.col("object.conf").cast("double"), 6).alias("object_conf"),
        F.col("attribute.id").alias("attribute_id"), F.round(F.col("attribute.conf").cast("double"), 6).alias("attribute_conf"),
    )


@query("canonical_names", """
with vocab as (select n_nationkey as id, concat(n_name, ', ', lower(n_name), ',the ', n_name) as line from nation),
spelled as (select trim(unnest(string_split(line, ','))) as synonym, id from vocab),
first as (select synonym, min(id) as id from spelled group by synonym)
select c_custkey, first.id from customer join nation n on n.n_nationkey = c_nationkey
left join first on synonym = case c_custkey % 4 when 0 then n_name when 1 then lower(n_name) when 2 then concat('the ', n_name) else 'none' end""")
def canonical_names(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    name = F.col("n_name")
    line = F.concat(name, F.lit(", "), F.lower(name), F.lit(",the "), name)
    vocab = nation.select(F.col("n_nationkey").alias("id"), F.transform(F.split(line, ","), lambda s: F.trim(s)).alias("synonyms"))
    key = F.col("c_custkey") % 4
    spoken = F.when(key == 0, name).when(key == 1, F.lower(name)).when(key == 2, F.concat(F.lit("the "), name)).otherwise("none")
    names = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", spoken.alias("name"))
    return regions.canonicalize(names, vocab).select("c_custkey", "id")


# --- vectors: five views of 64 dimensions per item -------------------------------------------

_VIEWS_SQL = """with views as (select vec_id % 100 as item, vec_id // 100 as view_idx, embedding, label from embeddings),
cells as (select item, view_idx, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as dim from views)
"""


def _views(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 100).alias("item"), F.floor(F.col("vec_id") / 100).alias("view_idx"),
        F.col("embedding").alias("vector"), "label",
    )


def _cells(pooled):
    return pooled.select("item", F.posexplode("pooled").alias("dim", "v")).select("item", "dim", F.round("v", 6).alias("value"))


def _pool(method, sql):
    query(f"pooled_{method}", _VIEWS_SQL + f"select item, dim, round({sql}, 6) as value from cells group by item, dim")(
        lambda spark, sf_dir: _cells(vectors.pool_views(_views(spark, sf_dir), method, 64))
    )


for _method, _sql in (("mean", "avg(v)"), ("sum", "sum(v)"), ("max", "max(v)"), ("first", "arg_min(v, view_idx)")):
    _pool(_method, _sql)


@query("pooled_weighted", _VIEWS_SQL + """, w as (select item, view_idx, exp(view_idx / 400.0::double) as e from views)
select item, dim, round(sum(v * e) / sum(e), 6) as value from cells join w using (item, view_idx) group by item, dim""")
def pooled_weighted(spark, sf_dir):
    views = _views(spark, sf_dir)
    most = views.agg(F.max("view_idx")).first()[0]
    return _cells(vectors.pool_weighted(views, 64, [i / 400.0 for i in range(int(most) + 1)]))


@query("pooled_gated", _VIEWS_SQL + """
select item, dim, round(sum(v * exp(label / 3.0::double)) / sum(exp(label / 3.0::double)), 6) as value from cells group by item, dim""")
def pooled_gated(spark, sf_dir):
    return _cells(vectors.pool_gated(_views(spark, sf_dir).withColumn("score", F.col("label") / F.lit(3.0)), 64))


@query("pooled_custom", _VIEWS_SQL + "select item, dim, round(max(v) - min(v), 6) as value from cells group by item, dim")
def pooled_custom(spark, sf_dir):
    return _cells(vectors.pool_custom(_views(spark, sf_dir), lambda v: F.max(v) - F.min(v), 64))


@query("fusion_classifier", """
select vec_id, label::double as label, true as in_range, true as beats_largest_class from embeddings""")
def fusion_classifier(spark, sf_dir):
    """A small late-fusion model on the two halves of each vector: labels, and facts that hold for its predictions.

    Predictions are classes, and more of them are right than if every row got the largest class.
    """
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice("embedding", 1, 32).alias("image_vector"), F.slice("embedding", 33, 32).alias("text_vector"),
        F.col("label").cast("double").alias("label"),
    )
    model = vectors.fit_fusion(rows, 32, 32, 10, hidden=16, iterations=20)
    found = model.transform(vectors.fusion_features(rows)).select("vec_id", "label", "prediction")
    right = found.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]
    largest = rows.groupBy("label").count().agg(F.max("count") / F.sum("count")).first()[0]
    return found.select(
        "vec_id", "label", F.col("prediction").isin(*[float(k) for k in range(10)]).alias("in_range"),
        F.lit(right > largest).alias("beats_largest_class"))
