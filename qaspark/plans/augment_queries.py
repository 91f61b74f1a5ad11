"""Paraphrases and patch plans over sentences and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from qaspark.functions import curriculum as C
from qaspark.functions import paraphrase, patches
from qaspark.operators import augment, schedules
from qaspark.plans.catalog import query
from qaspark.plans.views import SQL, cte, table, view

_SENTENCES = cte("sentences")

_SYNONYMS = "(values " + ", ".join(f"('{p}', '{w}', '{s}')" for p, w, s in paraphrase.synonym_rows()) + ") as t(pos, word, synonym)"

# Joins the two words of a compound headword, then tags by the word list.
_TAG_SQL = f""", syn as (select * from {_SYNONYMS}),
heads as (select distinct pos, word from syn),
compounds as (select list(struct_pack(w := word, u := replace(word, ' ', '_')) order by word) as c from heads where contains(word, ' ')),
seg as (select row_idx, question, regexp_split_to_array(trim(list_reduce(list_prepend(concat(' ', question, ' '), list_transform(c, lambda x: x.w)),
          lambda a, x: replace(a, concat(' ', x, ' '), concat(' ', replace(x, ' ', '_'), ' ')))), '\\s+') as w from sentences, compounds),
tok as (select row_idx, question, w, unnest(w) as word, generate_subscripts(w, 1) as i from seg),
tagged as (select row_idx, question, w, tok.word, i, coalesce(pos, 'X') as pos from tok left join heads on heads.word = replace(tok.word, '_', ' ')),
r1 as (select row_idx, 'synonym' as rule, array_to_string(list_concat(list_concat(w[1:i-1], [synonym]), w[i+1:]), ' ') as candidate
       from tagged join syn on syn.pos = tagged.pos and syn.word = replace(tagged.word, '_', ' ')),
adv as (select row_idx, w, min(i) as i from tagged where pos = 'R' and i > 1 group by row_idx, w),
rest as (select row_idx, w[i] as a, list_concat(w[1:i-1], w[i+1:]) as r from adv),
r2 as (select row_idx, 'adverb' as rule, concat(upper(left(a, 1)), lower(substr(a, 2)), ', ',
       case when left(r[1], 1) = lower(left(r[1], 1)) and left(r[1], 1) <> upper(left(r[1], 1))
            then concat(lower(r[1]), ' ', array_to_string(r[2:], ' ')) else array_to_string(r, ' ') end) as candidate from rest),
verb as (select row_idx, w, min(i) as i from tagged where pos = 'V' group by row_idx, w),
moved as (select row_idx, array_to_string(list_concat(list_concat(w[i+1:], ['được']), list_concat(w[1:i-1], [w[i]])), ' ') as m
          from verb where i > 1 and i < len(w)),
r3 as (select row_idx, 'passive' as rule, concat(upper(left(m, 1)), substr(m, 2)) as candidate from moved),
made as (select * from r1 union all select * from r2 union all select * from r3),
cand as (select distinct row_idx, candidate from made join sentences using (row_idx) where candidate <> question),
ranked as (select row_idx, candidate, row_number() over (partition by row_idx order by md5(concat(candidate, ':0')), candidate) as rn from cand)
"""


def _sentences(spark, sf_dir):
    """The sentences dealt out: a file of many short rows is few tasks, and a row is worked on for long."""
    parts = table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(SQL["sentences"], part=parts)


@query("tagged_tokens", _SENTENCES + _TAG_SQL + "select row_idx, i - 1 as pos_idx, word, pos from tagged")
def tagged_tokens(spark, sf_dir):
    tagged = augment.tag_questions(_sentences(spark, sf_dir))
    return tagged.select("row_idx", F.posexplode("tagged").alias("pos_idx", "t")).select("row_idx", "pos_idx", "t.word", "t.pos")


def _rule(name):
    def run(spark, sf_dir):
        made = augment.paraphrases(_sentences(spark, sf_dir), [name])
        return made.filter(F.col("rule") == name).select("row_idx", "candidate")

    query(f"paraphrase_{name}", _SENTENCES + _TAG_SQL + f"select row_idx, candidate from made where rule = '{name}'")(run)


for _name in ("synonym", "adverb", "passive"):
    _rule(_name)


@query("synonym_usage", _SENTENCES + _TAG_SQL + """
select tagged.pos, replace(tagged.word, '_', ' ') as word, synonym, count(*) as uses
from tagged join syn on syn.pos = tagged.pos and syn.word = replace(tagged.word, '_', ' ') group by all""")
def synonym_usage(spark, sf_dir):
    tagged = augment.tag_questions(_sentences(spark, sf_dir))
    tokens = tagged.select(F.explode("tagged").alias("t")).select(
        F.col("t.pos").alias("pos"), paraphrase.plain(F.col("t.word")).alias("word")
    )
    used = tokens.groupBy("pos", "word").agg(F.count("*").alias("uses"))
    return augment.synonym_table(spark).join(used, ["pos", "word"]).select("pos", "word", "synonym", "uses")


@query("paraphrase_candidates", _SENTENCES + _TAG_SQL + "select row_idx, candidate from cand")
def paraphrase_candidates(spark, sf_dir):
    made = augment.paraphrase_candidates(_sentences(spark, sf_dir))
    return made.select("row_idx", F.explode_outer("candidates").alias("candidate")).filter("candidate is not null")


_VIEWS_SQL = """, leveled as (select row_idx, question, least(1, greatest(0, (row_idx % 12) / 10.0::double - 0.05)) as d from sentences),
wanted as (select *, case when d < 0.33 then 2 when d < 0.66 then 1 else 0 end as n from leveled),
picked as (select w.row_idx, question, d, n, list(candidate order by rn) filter (rn <= n) as p
           from wanted w left join ranked r on r.row_idx = w.row_idx group by w.row_idx, question, d, n),
viewed as (select row_idx, d, n, list_concat(list_prepend(question, coalesce(p, [])),
             list_transform(range(0, n - len(coalesce(p, []))), lambda x: question)) as views from picked)
"""


def _leveled(spark, sf_dir):
    rows = _sentences(spark, sf_dir)
    return augment.paraphrase_views(rows, (F.col("row_idx") % 12) / F.lit(10.0) - F.lit(0.05))


@query("paraphrase_views", _SENTENCES + _TAG_SQL + _VIEWS_SQL + "select row_idx, len(views) as n_views, array_to_string(views, ' | ') as views from viewed")
def paraphrase_views(spark, sf_dir):
    return _leveled(spark, sf_dir).select("row_idx", F.size("views").alias("n_views"), F.array_join("views", " | ").alias("views"))


@query("expanded_views", _SENTENCES + _TAG_SQL + _VIEWS_SQL + """
select row_idx, unnest(views) as text, generate_subscripts(views, 1) - 1 as view_idx from viewed""")
def expanded_views(spark, sf_dir):
    return augment.expand_views(_leveled(spark, sf_dir)).select("row_idx", "view_idx", "text")


@query("no_augmentation", _SENTENCES + "select row_idx, question from sentences")
def no_augmentation(spark, sf_dir):
    return augment.augment(view(spark, sf_dir, "sentences"), augment.create(augment.TEXT, "none", patch_size=16))


@query("clamped_difficulty", "select event_id, greatest(0, least(1, value / 10 - 1)) as difficulty from events")
def clamped_difficulty(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.clamp(F.col("value") / 10 - 1).alias("difficulty"))


@query("user_augmentation", _SENTENCES + "select row_idx, concat(upper(question), '?') as question from sentences")
def user_augmentation(spark, sf_dir):
    augment.register(augment.TEXT, "shout", lambda **_: lambda df: augment.augment_column(df, lambda q: F.concat(F.upper(q), F.lit("?"))))
    return augment.augment(view(spark, sf_dir, "sentences"), augment.create(augment.TEXT, "SHOUT"))


# 120 epochs: steps below the update threshold leave the difficulty of the epoch before in force.
@query("augmented_epochs", _SENTENCES + _TAG_SQL + """, plan as (select unnest(range(0, 120)) as epoch),
fold as (select 0::bigint as epoch, 0::double as d union all
         select epoch + 1, case when abs((epoch + 1)::double / 119 - d) > 0.01 then (epoch + 1)::double / 119 else d end from fold where epoch < 119),
every as (select row_idx, question, case row_idx % 5 when 0 then 'val' when 1 then 'test' else 'train' end as split, epoch, d from sentences, fold),
asked as (select *, case when d < 0.33 then 2 when d < 0.66 then 1 else 0 end as n from every),
drawn as (select row_idx, epoch, candidate, row_number() over (partition by row_idx, epoch order by md5(concat(candidate, ':0:', epoch)), candidate) as rn
          from cand, plan where row_idx % 5 > 1),
taken as (select a.row_idx, a.epoch, string_agg(candidate, ' | ' order by rn) as picked
          from asked a join drawn r on r.row_idx = a.row_idx and r.epoch = a.epoch and rn <= n group by a.row_idx, a.epoch)
select a.row_idx, split, a.epoch, round(d, 6) as difficulty, case when d < 0.33 then 'easy' when d < 0.66 then 'medium' else 'hard' end as phase,
       case when split <> 'train' then 1 else n + 1 end as n_views, coalesce(picked, '') as picked,
       case when split <> 'train' or d < 0.33 then 'none' when d < 0.66 then 'blur' else 'mask' end as image_action
from asked a left join taken h on h.row_idx = a.row_idx and h.epoch = a.epoch""")
def augmented_epochs(spark, sf_dir):
    part = F.col("row_idx") % 5
    rows = _sentences(spark, sf_dir).withColumn("split", F.when(part == 0, "val").when(part == 1, "test").otherwise("train"))
    every = schedules.augmented_epochs(rows, C.Schedule(120, "linear"), digits=6)
    others = F.filter(F.col("views"), lambda v: v != F.col("question"))
    return every.select(
        "row_idx", "split", "epoch", "difficulty", "phase",
        F.size("views").alias("n_views"), F.array_join(others, " | ").alias("picked"), "image_action",
    )


# --- patches: one image per part, sizes from its columns --------------------------------------

_IMAGES_SQL = """with images as (select p_partkey as image_id, 40 + p_size as height, 64 + p_partkey % 17 as width, p_size % 11 / 10.0::double as d from part),
sized as (select *, (height // 16) * (width // 16) as total, 0.15::double + d * (0.5::double - 0.15::double) as ratio from images),
counted as (select *, cast(floor(total * ratio) as int) as n from sized),
hashed as (select image_id, height, width, d, n, i, row_number() over (partition by image_id order by md5(concat(image_id, ':', i, ':0')), i) as rn
           from (select *, unnest(range(0, total)) as i from counted)),
chosen as (select * from hashed where rn <= n)
"""


def _images(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("image_id"), (F.col("p_size") + 40).alias("height"),
        (F.col("p_partkey") % 17 + 64).cast("int").alias("width"), (F.col("p_size") % 11 / F.lit(10.0)).alias("d"),
    )


def _selected(spark, sf_dir):
    rows = _images(spark, sf_dir)
    picked = patches.select_patches(F.col("image_id"), F.col("height"), F.col("width"), patches.mask_ratio(F.col("d")))
    return rows.withColumn("patches", picked)


@query("mask_ratios", _IMAGES_SQL + "select image_id, total, round(ratio, 6) as ratio, n from counted")
def mask_ratios(spark, sf_dir):
    total = patches.patch_total(F.col("height"), F.col("width"))
    ratio = patches.mask_ratio(F.col("d"))
    return _selected(spark, sf_dir).select(
        "image_id", total.alias("total"), F.round(ratio, 6).alias("ratio"), F.size("patches").alias("n")
    )


@query("selected_patches", _IMAGES_SQL + "select image_id, i as patch from chosen")
def selected_patches(spark, sf_dir):
    return _selected(spark, sf_dir).select("image_id", F.explode("patches").alias("patch"))


@query("patch_boxes", _IMAGES_SQL + """
select image_id, i as patch, (i // (width // 16)) * 16 as y_start, least((i // (width // 16)) * 16 + 16, height) as y_end,
       (i % (width // 16)) * 16 as x_start, least((i % (width // 16)) * 16 + 16, width) as x_end from chosen""")
def patch_boxes(spark, sf_dir):
    rows = _selected(spark, sf_dir).select("image_id", "height", "width", F.explode("patches").alias("patch"))
    box = patches.patch_box(F.col("patch"), F.col("height"), F.col("width"))
    return rows.select("image_id", "patch", box.alias("b")).select("image_id", "patch", "b.*")


@query("patch_plans", _IMAGES_SQL + """
select image_id, case when d < 0.33 then 'none' when d < 0.66 then 'blur' else 'mask' end as action,
       case when d < 0.33 then 'none' when d < 0.66 then 'blur' else 'none' end as action_unmasked,
       case when d < 0.33 then 0 else n end as patches from counted""")
def patch_plans(spark, sf_dir):
    plan = patches.patch_plan(F.col("image_id"), F.col("height"), F.col("width"), F.col("d"))
    rows = _images(spark, sf_dir).withColumn("plan", plan)
    return rows.select(
        "image_id", "plan.action", patches.patch_action(F.col("d"), False).alias("action_unmasked"),
        F.size("plan.patches").alias("patches"),
    )


@query("masked_rasters", _IMAGES_SQL + """
select image_id, case when d < 0.33 then 'none' when d < 0.66 then 'blur' else 'mask' end as action,
       case when d < 0.33 or d >= 0.66 then height * width * 3 - (case when d >= 0.66 then n * 768 else 0 end) else height * width * 3 end as untouched
from counted""")
def masked_rasters(spark, sf_dir):
    """Flat rasters (all bytes 7) with their plan applied: bytes that keep their value."""
    from qaspark.operators.pixels import apply_patches

    raster = F.unhex(F.expr("repeat('07', height * width * 3)"))
    # A raster is made from a few numbers, which are dealt out before they grow.
    rows = _images(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism, "image_id").select(
        F.col("image_id").cast("string"), "height", "width", F.lit(3).alias("channels"), raster.alias("data"), "d"
    )
    altered = apply_patches(rows, F.col("d"))
    kept = F.length(F.replace(F.hex("data"), F.lit("80"), F.lit(""))) / 2
    return altered.select(F.col("image_id").cast("bigint").alias("image_id"), "action", kept.cast("bigint").alias("untouched"))


@query("blurred_rasters", _IMAGES_SQL + """, plans as (select image_id, case when d < 0.33 then 'none' when d < 0.66 then 'blur' else 'mask' end as action,
  height * width * 3 as bytes, case when d < 0.33 then 0 else n end as n from counted)
select image_id, action, bytes, true as outside_exact, true as inside_smooth, action = 'none' or n = 0 as unchanged from plans""")
def blurred_rasters(spark, sf_dir):
    """Striped rasters (rows of 40 and 200 in turn): pixels outside the plan are exact, blurred patches lie between."""
    from qaspark.operators.pixels import apply_patches

    def stripes(height, width):
        return F.unhex(F.expr(f"substr(repeat(concat(repeat('28', {width} * 3), repeat('C8', {width} * 3)), {height}), 1, {height} * {width} * 6)"))

    # Images meet their originals as a few numbers, by a join that broadcasts nothing; rasters are made from these and never move.
    images = _images(spark, sf_dir).withColumn("image_id", F.col("image_id").cast("string")).repartition(
        spark.sparkContext.defaultParallelism, "image_id")
    originals = images.select("image_id", F.col("height").alias("o_height"), F.col("width").alias("o_width"), F.col("d").alias("o_d"))
    rows = images.join(originals.hint("merge"), "image_id").select(
        "image_id", "height", "width", F.lit(3).alias("channels"), stripes("height", "width").alias("data"), "d",
        stripes("o_height", "o_width").alias("original"), patches.patch_plan(
            F.col("image_id"), F.col("o_height"), F.col("o_width"), F.col("o_d"))["patches"].alias("chosen"))
    both = apply_patches(rows, F.col("d"), keep=("original", "chosen"))
    return both.mapInArrow(_compare_rasters, "image_id bigint, action string, bytes bigint, outside_exact boolean, inside_smooth boolean, unchanged boolean")


def _compare_rasters(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        out = []
        for r in (row for start in range(0, len(batch), 256) for row in batch.slice(start, 256).to_pylist()):
            shape = (r["height"], r["width"], 3)
            before, after = (np.frombuffer(r[name], "u1").reshape(shape) for name in ("original", "data"))
            inside = np.zeros(shape[:2], dtype=bool)
            for p in r["chosen"] or []:
                y, x = p // (shape[1] // 16) * 16, p % (shape[1] // 16) * 16
                inside[y:y + 16, x:x + 16] = True
            chosen = after[inside] if r["action"] != "none" else after[:0]
            smooth = bool((chosen == 128).all()) if r["action"] == "mask" else bool(((chosen > 40) & (chosen < 200)).all())
            exact = bool((before[~inside] == after[~inside]).all())
            out.append((int(r["image_id"]), r["action"], len(r["data"]), exact, smooth, bool((before == after).all())))
        columns = list(zip(*out)) if out else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         names=["image_id", "action", "bytes", "outside_exact", "inside_smooth", "unchanged"])
