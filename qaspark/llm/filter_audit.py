"""How filters interact: what each removes after any others, told by joins of failing-id relations.

Every filter stores one table with the rows that fail it. What is left after a set of filters are the rows without a match
in their tables (anti-join); what the next filter removes are its failing rows without a match in the tables before it, and
what it would have removed are those with one (semi-join). All orders are read off these: a step depends on which filters
came before it, not on their order, so the ``2 ** k`` sets of filters cover all ``k!`` orders.

Rows are named by a 256-bit hash of id and text. Equal rows of one part are one row with a number, so that each relation
holds a name once and no key is hot. All joins are on the name, and sets of filters are numbers (bit i: filter i), so a
row meets its own few failures only: 2 ** k rows of a task's own rows, never pairs of rows.

Defined results: a null text is empty; a null part is the empty string; a text that only null ids have is nobody's copy, and
a null id counts as larger than any other; repeated rows count as often as they come, and neither is a copy of the other;
a label counts if any row of its id has it; an empty table has no parts and no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaspark.llm.common import pick
from qaspark.operators.lookups import null_safe_join
from qaspark.session import materialize

COUNTS = ("n", "good", "toxic")
COPY = "copy"


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda word: word != "")


def text_filters() -> dict[str, Column | str]:
    """The failure conditions of five filters by letter, on columns ``text``, ``n_words`` and ``n_distinct``."""
    text = F.col("text")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
        "E": COPY,
    }


def failing_tables(docs: DataFrame, filters: Mapping[str, Column | str], id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(rows, failures): ``part, name, doc_id, n`` of all rows, and ``name, filter`` of what fails each filter.

    A filter is a condition on ``text``, ``n_words`` and ``n_distinct``, or ``COPY``: a smaller id has the same text.
    """
    own = pick(docs, doc_id=id_col, text=text_col, part=part_col).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("part", F.lit("")).alias("part"))
    measured = own.withColumn("w", words(F.col("text"))).select(
        "doc_id", "text", "part", F.size("w").cast("bigint").alias("n_words"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"))
    plain = {letter: condition for letter, condition in filters.items() if not isinstance(condition, str)}
    digest = F.unhex(F.sha2("text", 256))
    judged = measured.select(
        "doc_id", "part", digest.alias("digest"),
        *(F.coalesce(condition, F.lit(False)).alias(f"fails_{place}") for place, condition in enumerate(plain.values())))
    flags = [f"fails_{place}" for place in range(len(plain))]
    named = judged.withColumn("name", F.unhex(F.sha2(F.concat(
        F.col("digest"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 256)))
    rows = materialize(named.groupBy("part", "name", "doc_id", "digest", *flags).agg(F.count("*").alias("n")), "audit-rows")
    failures = []
    for letter, condition in filters.items():
        if isinstance(condition, str):
            # The first of each text is matched by id and text, so a text that many rows share is no hot key.
            first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
            failing = null_safe_join(rows.select("name", "doc_id", "digest"), first, ["doc_id", "digest"], "left_anti")
        else:
            failing = rows.filter(flags[list(plain).index(letter)])
        # One row a name: the same id and text may lie in several parts.
        failures.append(materialize(failing.select("name").distinct(), f"fails-{letter}").withColumn("filter", F.lit(list(filters).index(letter))))
    stacked = failures[0]
    for table in failures[1:]:
        stacked = stacked.unionByName(table)
    return rows.select("part", "name", "doc_id", "n"), stacked


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with ``good`` and ``toxic``: their number if a label of their id says so, else 0."""
    own = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").filter("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("t"))
    met = null_safe_join(rows, own, ["doc_id"], "left")
    return met.select("part", "name", "n", *((F.col("n") * F.coalesce(mark, F.lit(0))).alias(name) for mark, name in (("q", "good"), ("t", "toxic"))))


def _set_has(column: str, place: str) -> Column:
    return F.expr(f"({column} & shiftleft(1, {place})) <> 0")


def step_counts(rows: DataFrame, failures: DataFrame, k: int) -> DataFrame:
    """part, before (set of filters), filter, kind and counts, of every set and every filter outside of it.

    Kinds: ``left`` (rows without a failure in the set; filter -1), ``removed`` (failing rows without a failure in the
    set), ``again`` (failing rows with one).
    """
    own = failures.select(F.col("name").alias("f_name"), F.col("filter").alias("f_filter"))
    tables = (F.col("name") == F.col("f_name")) & _set_has("before", "f_filter")
    sets = F.expr(f"sequence(0, {(1 << k) - 1})")

    def counted(relation: DataFrame, kind: str, place: Column) -> DataFrame:
        return relation.groupBy("part", "before", place.alias("filter")).agg(*(F.sum(c).alias(c) for c in COUNTS)).withColumn("kind", F.lit(kind))

    # Dealt out by name once; every set of a row then stays in its task.
    left = rows.repartition("name").withColumn("before", F.explode(sets)).join(own, tables, "left_anti")
    failing = rows.join(failures.withColumnsRenamed({"name": "of_name"}), F.col("name") == F.col("of_name")).drop("of_name")
    outside = failing.withColumn("before", F.explode(sets)).filter(~_set_has("before", "filter"))
    removed = outside.join(own, tables, "left_anti")
    again = outside.join(own, tables, "left_semi")
    return counted(left, "left", F.lit(-1)).unionByName(counted(removed, "removed", F.col("filter"))).unionByName(
        counted(again, "again", F.col("filter")))


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column | str] | None = None, id_col: str = "doc_id",
          text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.
    """
    filters = filters or text_filters()
    letters, k = list(filters), len(filters)
    rows, failures = failing_tables(docs, filters, id_col, text_col, part_col)
    counts = materialize(step_counts(with_labels(rows, labels), failures, k), "audit-counts")
    orders = [("".join(letters[place] for place in order), order) for order in permutations(range(k))]
    steps = [(name, step + 1, place, sum(1 << earlier for earlier in order[:step]), (1 << k) - 1 - (1 << place))
             for name, order in orders for step, place in enumerate(order)]
    plan = F.explode(F.from_json(F.lit(str([list(step) for step in steps]).replace("'", '"')), "array<array<string>>")).alias("p")
    parts = counts.filter("kind = 'left' and before = 0").select("part").distinct()
    own = parts.select("part", plan).select(
        "part", F.col("p")[0].alias("filter_order"), F.col("p")[1].cast("int").alias("step"), F.col("p")[2].cast("int").alias("filter"),
        F.col("p")[3].cast("int").alias("before"), F.col("p")[4].cast("int").alias("others")).withColumn(
        "after", F.expr("before | shiftleft(1, filter)"))

    def attach(frame: DataFrame, kind: str, at: str, names: Mapping[str, str], filter_col: str | None = "filter") -> DataFrame:
        table = counts.filter(F.col("kind") == kind).select(
            F.col("part").alias("c_part"), F.col("before").alias("c_before"), F.col("filter").alias("c_filter"),
            *(F.col(old).alias(new) for old, new in names.items()))
        on = (F.col("part") == F.col("c_part")) & (F.col(at) == F.col("c_before"))
        if filter_col:
            on &= F.col(filter_col) == F.col("c_filter")
        return frame.join(table, on, "left").drop("c_part", "c_before", "c_filter").fillna(0, list(names.values()))

    own = attach(own, "left", "after", {"n": "kept"}, None)
    own = attach(own, "removed", "before", {"n": "removed", "good": "good_lost", "toxic": "toxic_lost"})
    own = attach(own, "again", "before", {"n": "redundant"})
    own = attach(own, "removed", "others", {"n": "unique_fails"})
    shares = own.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    own = own.join(shares.withColumnsRenamed({"part": "s_part", "filter": "s_filter"}),
                   (F.col("part") == F.col("s_part")) & (F.col("filter") == F.col("s_filter")))
    return own.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
