"""Threshold-scaled document sketches: every shingle hash below a fixed fraction of the hash range.

A hash is kept or dropped by its own value, so the sketch of a union is the union of sketches, and the share of one
sketch found in another estimates how much of one document the other contains, however unequal their lengths. Shingles
are five words; everything is built from DataFrame functions.

A fingerprint string holds the number of words, a hash of the whole word sequence and the kept hashes in order, so equal
texts have equal fingerprints and fingerprints can be parsed, merged and compared (``parse``, ``merge``, ``containment``).

Defined results: a null text is empty; texts of fewer than five words are one shingle, texts without words have none;
the likeness of two sketches is the share of the first found in the second, 1 for equal fingerprints and 0 where the
first keeps no hash. Rows with equal ids follow each other by text hash, then text; null ids come first; the only row of a table is its
own next.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qaspark.functions.let import let
from qaspark.llm.common import pick
from qaspark.session import materialize

SIZE = 5
FRACTION = 1 / 8
#: Documents that follow each other by id meet in groups of about this many, or in so many groups; sampled rows for each.
GROUP, MAX_RANGES, SAMPLED = 256, 8192, 8


def with_sketch(df: DataFrame, text: str, prefix: str = "", size: int = SIZE, fraction: float = FRACTION) -> DataFrame:
    """Adds ``{prefix}words`` (their number), ``{prefix}whole`` (hash of their sequence) and ``{prefix}sketch``
    (sorted array<bigint>) of a text column; ``fingerprint`` writes the three as one string."""
    if not 0 < fraction <= 0.5:
        raise ValueError("the fraction is above 0 and at most a half")
    hashes = f"{prefix}hashes"
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     "), " "), "")
    hashed = df.withColumn(hashes, F.transform(words, lambda word: F.xxhash64(word)))
    own = F.col(hashes)
    shingles = F.transform(own, lambda first, i: F.xxhash64(first, *(F.get(own, i + k) for k in range(1, size))))
    whole = F.slice(shingles, 1, F.greatest(F.size(own) - (size - 1), F.lit(1)))
    kept = F.filter(whole, lambda h: (h >= 0) & (h < int(fraction * 2**64)))
    return hashed.withColumns({
        f"{prefix}sketch": F.array_sort(F.array_distinct(kept)), f"{prefix}words": F.size(own), f"{prefix}whole": F.xxhash64(own),
    }).drop(hashes)


def fingerprint(prefix: str = "") -> Column:
    """The fingerprint string of the columns that ``with_sketch`` adds."""
    return F.concat_ws(
        ":", F.col(f"{prefix}words").cast("string"), F.lower(F.hex(f"{prefix}whole")),
        F.array_join(F.transform(f"{prefix}sketch", lambda h: F.lower(F.hex(h))), ","))


def parse(fingerprint: Column | str) -> Column:
    """The sketch that a fingerprint string holds."""
    column = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    kept = F.array_remove(F.split(F.element_at(F.split(column, ":"), -1), ","), "")
    return F.transform(kept, lambda h: F.conv(h, 16, 10).cast("bigint"))


def merge(a: Column | str, b: Column | str) -> Column:
    """The sketch of both texts together."""
    return F.array_sort(F.array_union(a, b))


def containment(a: Column | str, b: Column | str) -> Column:
    """Share of sketch ``a`` found in sketch ``b``; 0 where ``a`` is empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))


PARTS = ("words", "whole", "sketch")


def _likeness(prefix: str) -> Column:
    """Likeness of a row's fingerprint to the one under a prefix."""
    same = (F.col("words") == F.col(f"{prefix}words")) & (F.col("whole") == F.col(f"{prefix}whole")) & (F.col("sketch") == F.col(f"{prefix}sketch"))
    return F.when(same, F.lit(1.0)).otherwise(containment("sketch", f"{prefix}sketch"))


def _edited(rows: DataFrame) -> DataFrame:
    """Rows with text and next_text get their edited text's digest and sketch, and both likenesses."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = rows.withColumn("edited", F.concat(
        F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)))
    marked = with_sketch(edited, "edited", "edited_").withColumn("edited_sha256", F.unhex(F.sha2("edited", 256)))
    return marked.withColumns({"near_edited": _likeness("edited_"), "near_next": _likeness("next_")})


KEPT = ("doc_id", "n_chars", "edited_sha256", *PARTS, *(f"edited_{part}" for part in PARTS), "near_edited", "near_next")


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), fingerprint().alias("fingerprint"),
        fingerprint("edited_").alias("edited_fingerprint"), "near_edited", "near_next")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the next document's beginning.

    Texts move once, to groups that follow each other by id and text hash (repeated and null ids are many groups, too). Only the first and last rows of the groups are then
    matched across groups, from a written table.
    """
    texts = pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "coalesce(text, '') text")
    rows = with_sketch(texts.withColumns({"n_chars": F.char_length("text").cast("bigint"), "g": _group(texts)}), "text")
    by_id = Window.partitionBy("g").orderBy("doc_id", F.xxhash64("text"), "text")
    paired = rows.withColumns({
        **{f"next_{name}": F.lead(name).over(by_id) for name in ("text", *PARTS)}, "place": F.row_number().over(by_id)})
    last, first = F.col("next_text").isNull(), F.col("place") == 1
    landed = materialize(_edited(paired).select(
        "g", *KEPT, last.alias("last"), first.alias("first"), F.when(last | first, F.col("text")).alias("text")), "sketches")

    heads = landed.filter("first").select(F.col("g").alias("head"), *(F.col(name).alias(f"next_{name}") for name in ("text", *PARTS)))
    tails = landed.filter("last").select("g", "doc_id", "n_chars", "text", *PARTS)
    follow = next_groups(landed.filter("first").select("g"))
    across = _edited(tails.join(follow, "g").join(heads, "head")).select(*KEPT)
    return _result(landed.filter("not last").select(*KEPT).unionByName(across))


def _group(texts: DataFrame) -> Column:
    """The number of a row's range of (id, text hash): ranges of about equal numbers of rows, in that order.

    Their bounds are quantiles of a sample, found by every row in a binary search. They only deal rows out: whatever
    they are, results are the same.
    """
    rows = texts.count()
    ranges = min(max(rows // GROUP, 1), MAX_RANGES)
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("id"), F.xxhash64("text").alias("h"))
    sample = sorted(map(tuple, texts.sample(min(1.0, SAMPLED * ranges / rows), 11).select(key.alias("k")).select("k.*").collect())) if ranges > 1 else []
    places = range(1, ranges) if sample else ()
    cuts = sorted({sample[len(sample) * place // ranges] for place in places})
    if not cuts:
        return F.lit(0).cast("bigint")
    bounds = F.from_json(
        F.lit(json.dumps([dict(zip(("some", "id", "h"), cut)) for cut in cuts])), "array<struct<some:boolean,id:bigint,h:bigint>>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))

    def place(own: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.try_element_at(bounds, at + step) <= own, at + step).otherwise(at))

    return let(key, place).cast("bigint")


def next_groups(groups: DataFrame, block: int = 65_536) -> DataFrame:
    """(g, head): the group after each, the first after the last. Only the first group of each block meets in one task."""
    blocks = groups.withColumn("block", F.floor(F.col("g") / block))
    inside = blocks.withColumn("after", F.lead("g").over(Window.partitionBy("block").orderBy("g")))
    firsts = blocks.groupBy("block").agg(F.min("g").alias("opening"))
    across = firsts.withColumn("across", F.coalesce(
        F.lead("opening").over(Window.orderBy("block")),
        F.first("opening").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return inside.join(across, "block").select("g", F.coalesce("after", "across").alias("head"))
