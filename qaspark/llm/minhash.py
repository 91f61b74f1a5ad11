"""MinHash near-duplicates by an inverted join of signature coordinates; links are confirmed on the full shingle sets.

A set's signature has the least hash of its shingles under each of ``COORDINATES`` functions. Two sets of a Jaccard
similarity ``s`` agree in each coordinate with probability ``s``, independently; a pair is a candidate if it agrees in
``match_threshold`` coordinates or more. That threshold lies so far below the mean that a link of exactly the asked
similarity is missed with a probability of ``LOSS`` at most (a more similar one with far less).

1. Each distinct set posts itself under each of its coordinate-value pairs. Lists of one set are skipped: nothing meets
   there. So is a set with fewer lists left than the threshold.
2. Prefix: of the ``c`` lists left to a set, the ``c - threshold + 1`` shortest. Two sets that share ``threshold`` lists
   share one of these, because lists have one order for all. The long lists that many sets share are thus skipped.
3. In each list of the prefixes, collisions of the whole signatures are counted (on a byte of each value: that can only
   count more). Pairs over the threshold make loose groups.
4. In each loose group, pairs over the threshold are compared on their full sets, by whole numbers. Only now do texts move,
   one of each set that is in a group.

Steps 3 and 4 deal a group out in blocks (``linked``): every set meets its own block and the group's hub; where that left a
group in several components, the sets outside of the largest one meet all blocks. So every pair of a group is compared or
already connected, a group of copies costs its size and not its square, and no task holds more than two blocks. Only
links to the first node of a component are emitted.

Defined results: a text without words (null, empty, blank) has an empty set, links with nothing and is its own component; a
text of fewer words than a shingle has one; equal rows share a component; a null id never names a component unless all its
ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from qaspark.llm.common import map_rows, pick
from qaspark.llm.components import components
from qaspark.llm.shingles import text_set
from qaspark.operators.lookups import null_safe_join
from qaspark.session import materialize, release

COORDINATES = 48
#: The greatest probability of a link being no candidate.
LOSS = 1e-10
#: Sets, and shingles of sets, that a block holds on average.
BLOCK_SETS, BLOCK_SHINGLES = 256, 400_000
#: Names a task remembers so as not to write a set twice; rows of a stream taken at a time; shingles hashed at a time.
SEEN, STREAM_ROWS, PART = 100_000, 50_000, 4096
#: So many comparisons a set are made pair by pair before all sets of a run are multiplied, so many shingles at a time.
PAIRWISE, WIDTH = 8, 4096
NAMES = ("name_1", "name_2")
SET = "n bigint, name_1 bigint, name_2 bigint, signature binary, short binary, text binary"
LINKS = "a bigint, b bigint"


def match_threshold(share: float, coordinates: int = COORDINATES, loss: float = LOSS) -> int:
    """The most agreeing coordinates that a pair of similarity ``share`` falls short of with a probability up to ``loss``."""
    short_of = 0.0
    for matches in range(coordinates):
        short_of += comb(coordinates, matches) * share ** matches * (1 - share) ** (coordinates - matches)
        if short_of > loss:
            return max(matches, 1)
    return coordinates


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    mask, odd = (np.array([xxhash.xxh64_intdigest(kind, k) for k in range(COORDINATES)], dtype=np.uint64) for kind in (b"mask", b"odd"))
    return mask, odd | np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's function over a set's hashes."""
    mask, odd = _functions()
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(hashes), PART):
        np.minimum(least, ((hashes[start:start + PART, None] ^ mask) * odd).min(axis=0), out=least)
    return least


def reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether sorted sets share that part of their union."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def set_columns() -> Callable[[np.ndarray, bytes | None], tuple]:
    """A function of a sorted set and its text that gives the columns ``SET``.

    Signature and text are null where this function has given them for an equal set before: copies are told by name.
    """
    seen: set[bytes] = set()

    def columns(hashes: np.ndarray, text: bytes | None) -> tuple:
        if not len(hashes):
            return (0, None, None, None, None, None)
        name = xxhash.xxh3_128_digest(hashes.tobytes())
        own = (len(hashes), *np.frombuffer(name, dtype="<i8").tolist())
        if name in seen:
            return (*own, None, None, None)
        if len(seen) >= SEEN:
            seen.clear()
        seen.add(name)
        least = signature(hashes)
        return (*own, least.tobytes(), least.astype(np.uint8).tobytes(), text)

    return columns


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = _functions()[0]
    for batch in batches:
        for start in range(0, len(batch), 2000):
            part = batch.slice(start, 2000)
            node = part.column(0).to_numpy()
            values = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint64).reshape(-1, COORDINATES)
            # Coordinate and value in one number: the same value of two coordinates differs.
            yield pa.RecordBatch.from_arrays(
                [pa.array((values ^ mask).view(np.int64).ravel()), pa.array(np.repeat(node, COORDINATES))], names=["token", "node"])


def prefixes(sets: DataFrame, matches: int) -> DataFrame:
    """token, node, short, size and hub: the lists in which the sets (node, signature, short) can meet."""
    postings = sets.select("node", "signature").mapInArrow(_post, StructType.fromDDL("token bigint, node bigint"))
    lists = postings.groupBy("token").agg(F.count("*").alias("size"), F.min("node").alias("hub")).filter("size > 1")
    shared = null_safe_join(postings, lists, ["token"])
    own = Window.partitionBy("node")
    ranked = shared.withColumn("left", F.count("*").over(own)).filter(F.col("left") >= matches).withColumn(
        "place", F.row_number().over(own.orderBy("size", "token"))).filter(F.col("place") <= F.col("left") - matches + 1)
    short = sets.select(F.col("node").alias("s_node"), "short")
    return ranked.join(short, F.col("node") == F.col("s_node")).select("token", "node", "short", "size", "hub")


def _roots(count: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first place of each place's component; ``near`` picks those of some places that are linked to one."""
    left, root = np.arange(count), np.arange(count)
    while len(left):
        first, left = int(left[0]), left[1:]
        frontier = [first]
        while frontier and len(left):
            found = near(frontier.pop(), left)
            root[found] = first
            frontier.extend(found.tolist())
            left = np.setdiff1d(left, found, assume_unique=True)
    return root


def _across(side: np.ndarray, root: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Links between the marked places and all others of another root; what a link connects is not compared again."""
    root, a, b = root.copy(), [], []
    for here in np.flatnonzero(side).tolist():
        found = near(here, np.flatnonzero(root != root[here]))
        # One link to each root connects it.
        found = found[np.unique(root[found], return_index=True)[1]]
        a.extend([here] * len(found))
        b.extend(found.tolist())
        root[np.isin(root, root[found])] = root[here]
    return a, b


class _Signatures:
    """Collisions of short signatures."""

    columns = ("short",)
    #: Runs of two are compared all at once.
    together = True

    def __init__(self, matches: int):
        self.matches = matches

    def load(self, rows: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column("short").to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES)

    def near(self, shorts: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
        return lambda here, others: others[(shorts[others] == shorts[here]).sum(axis=1) >= self.matches]


class _Sets(_Signatures):
    """Full sets, of pairs whose signatures collide often enough."""

    columns = ("short", "shingles")
    together = False

    def __init__(self, matches: int, percent: int):
        super().__init__(matches)
        self.percent = percent

    def load(self, rows: pa.Table) -> tuple:
        return super().load(rows), [np.frombuffer(cell.as_buffer(), dtype="<u8") for cell in rows.column("shingles")]

    def near(self, loaded: tuple) -> Callable[[int, np.ndarray], np.ndarray]:
        shorts, sets = loaded
        collide, sizes = super().near(shorts), np.array([len(own) for own in sets])
        compared, common = 0, None

        def pick_near(here: int, others: np.ndarray) -> np.ndarray:
            nonlocal compared, common
            others = collide(here, others)
            compared += len(others)
            if common is None and compared <= PAIRWISE * len(sets):
                return others[[reaches(sets[here], sets[k], self.percent) for k in others.tolist()]] if len(others) else others
            if common is None:  # a run of many components: all its sets at once
                common = common_shingles(sets)
            both = common[here, others]
            return others[100 * both >= self.percent * (sizes[here] + sizes[others] - both)]

        return pick_near


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of some sets, as products of incidence matrices of ``WIDTH`` shingles at a time."""
    rows = np.repeat(np.arange(len(sets)), [len(own) for own in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1  # a shingle of one set is common with none
    number = np.cumsum(times > 1) - 1
    rows, column = rows[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        low, high = np.searchsorted(column, [start, start + WIDTH])
        part = np.zeros((len(sets), WIDTH), dtype=np.float32)
        part[rows[low:high], column[low:high] - start] = 1
        total += (part @ part.T).astype(np.int64)
    return total


def _runs(batches: Iterator[pa.RecordBatch], rows_at_once: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of the leading key columns (those named ``k_``) with the run of every row."""
    def number(rows: pa.Table) -> np.ndarray:
        keys = [rows.column(name).to_numpy() for name in rows.column_names if name.startswith("k_")]
        return np.cumsum(np.r_[0, np.any([key[1:] != key[:-1] for key in keys], axis=0)]) if len(rows) else np.zeros(0, dtype=np.int64)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for start in range(0, len(batch), rows_at_once):
            held.append(batch.slice(start, rows_at_once))
            if sum(map(len, held)) < rows_at_once:
                continue
            rows = pa.Table.from_batches(held)
            run = number(rows)
            cut = int(np.searchsorted(run, run[-1]))  # the last run may go on
            if cut:
                yield rows.slice(0, cut), run[:cut]
            held = rows.slice(cut).to_batches()
    if sum(map(len, held)):
        rows = pa.Table.from_batches(held)
        yield rows, number(rows)


def _to_links(node: np.ndarray, a: list, b: list) -> pa.RecordBatch:
    left, right = (node[np.asarray(side, dtype=np.int64)] for side in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(left, right)), pa.array(np.minimum(left, right))], names=["a", "b"])


def _within(likeness: _Signatures, rows_at_once: int):
    """Of every run (sorted by node) the nodes with the first node of their component, if that is another one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, number in _runs(batches, rows_at_once):
            node, group = rows.column("node").to_numpy(), rows.column("k_group").to_numpy()
            starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            sizes = np.diff(np.r_[starts, len(number)])
            a, b = [], []
            pairs = starts[sizes == 2]
            if likeness.together and len(pairs):  # most lists are of two
                marks = likeness.load(rows.take(np.r_[pairs, pairs + 1]))
                same = (marks[:len(pairs)] == marks[len(pairs):]).sum(axis=1) >= likeness.matches
                a.append(pairs[same] + 1)
                b.append(pairs[same])
            for start, size in zip(starts.tolist(), sizes.tolist()):
                if size > (2 if likeness.together else 1):
                    root = _roots(size, likeness.near(likeness.load(rows.slice(start, size))))
                    other = np.flatnonzero(root != np.arange(size))
                    a.append(other + start)
                    b.append(root[other] + start)
            at, to = (np.concatenate([np.zeros(0, dtype=np.int64), *side]) for side in (a, b))
            at, to = at[node[at] != node[to]], to[node[at] != node[to]]
            yield pa.RecordBatch.from_arrays([pa.array(group[at]), pa.array(node[at]), pa.array(node[to])], names=["group", "a", "b"])

    return run


def _between(likeness: _Signatures, rows_at_once: int):
    """Links of every run between its marked rows and all of another root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, number in _runs(batches, rows_at_once):
            starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            for start, size in zip(starts.tolist(), np.diff(np.r_[starts, len(number)]).tolist()):
                own = rows.slice(start, size)
                side, (_, root) = own.column("side").to_numpy(), np.unique(own.column("root").to_numpy(), return_inverse=True)
                left, right = _across(side, root, likeness.near(likeness.load(own)))
                yield _to_links(own.column("node").to_numpy(), left, right)

    return run


def linked(members: DataFrame, likeness: _Signatures, rows_at_once: int = STREAM_ROWS) -> DataFrame:
    """Links (a, b) that connect what is alike in the groups of ``members``, and nothing else.

    ``members`` has group, node, blocks (how many the group is dealt into), hub (its first node) and the payload.
    """
    own_block = F.expr("pmod(xxhash64(node), blocks)")
    payload = likeness.columns
    everywhere = F.expr("sequence(0L, blocks - 1)")
    dealt = members.select("group", "node", *payload, F.explode(
        F.when(F.col("node") == F.col("hub"), everywhere).otherwise(F.array(own_block))).alias("block"))
    keyed = dealt.withColumnsRenamed({"group": "k_group", "block": "k_block"}).repartition("k_group", "k_block")
    found = materialize(keyed.sortWithinPartitions("k_group", "k_block", "node").mapInArrow(
        _within(likeness, rows_at_once), StructType.fromDDL(f"group bigint, {LINKS}")), "near")
    links = found.select("a", "b")
    large = members.filter("blocks > 1")
    if large.isEmpty():  # every group was one block
        return links
    # The hub is the first node of all its blocks, so what is connected to it has it as root.
    roots = found.select("group", F.col("a").alias("node"), F.col("b").alias("root"))
    rooted = materialize(null_safe_join(large, roots, ["group", "node"], "left").select(
        "group", "node", "blocks", F.coalesce("root", "node").alias("root"), *payload), "several-blocks")
    counts = rooted.groupBy("group", "root").agg(F.count("*").alias("c"))
    most = counts.groupBy("group").agg(F.max(F.struct("c", "root")).alias("m"), F.sum("c").alias("s")).filter("s > m.c").select(
        "group", F.col("m.root").alias("main"), (F.col("s") - F.col("m.c")).alias("rest"), "s")
    open_ = null_safe_join(rooted, most, ["group"]).withColumn("parts", F.expr("cast(ceil(blocks * rest / s) as bigint)"))
    own_part = F.expr("pmod(xxhash64(node, 1), parts)")
    columns = ("group", "node", "root", *payload)
    whole = open_.select(*columns, F.lit(False).alias("side"), own_block.alias("block"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    rest = open_.filter("root <> main").select(*columns, F.lit(True).alias("side"), F.explode(everywhere).alias("block"), own_part.alias("part"))
    keyed = whole.unionByName(rest).withColumnsRenamed({"group": "k_group", "block": "k_block", "part": "k_part"}).repartition("k_group", "k_block", "k_part")
    more = keyed.sortWithinPartitions("k_group", "k_block", "k_part", "node").mapInArrow(_between(likeness, rows_at_once), StructType.fromDDL(LINKS))
    return links.unionByName(materialize(more, "near-across"))


def _with_sets(size: int):
    """The last column, a text, as its set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                *others, texts = batch.slice(start, 500).columns
                made = pa.array([text_set(text.as_py(), size).tobytes() for text in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*others, made], names=[*batch.schema.names[:-1], "shingles"])

    return run


def set_links(marked: DataFrame, percent: int, size: int, low: str) -> tuple[DataFrame, DataFrame]:
    """(sets, links) of rows with the columns ``SET``, which share ``percent`` of their union.

    ``sets`` has node, name_1, name_2 and the least ``low`` of each distinct set; links connect nodes.
    """
    if not 0 < percent <= 100:
        raise ValueError("a share is above 0 and at most 100 per cent")
    matches = match_threshold(percent / 100)
    # One row a set: copies are combined before they move. Of the tasks that wrote its text the first will do.
    classes = marked.filter("n > 0").groupBy(*NAMES).agg(
        F.min(low).alias("low"), F.max("n").alias("n"), F.min(F.when(F.col("text").isNotNull(), F.col("task"))).alias("task"),
        F.max("signature").alias("signature"), F.max("short").alias("short"))
    sets = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "sets")

    lists = materialize(prefixes(sets, matches), "prefixes")
    blocks = F.expr(f"cast(ceil(size / {BLOCK_SETS}) as bigint)")
    loose = components(linked(lists.select(F.col("token").alias("group"), "node", blocks.alias("blocks"), "hub", "short"), _Signatures(matches)))
    release(lists)

    both = loose.unionByName(loose.select(F.col("root").alias("node"), "root").distinct())
    weighed = null_safe_join(both, sets.select("node", "n", "short", "task", *NAMES), ["node"])
    groups = weighed.groupBy("root").agg(F.expr(
        f"cast(ceil(greatest(count(*) / {BLOCK_SETS}, sum(n) / {BLOCK_SHINGLES})) as bigint)").alias("blocks"), F.min("node").alias("hub"))
    wanted = materialize(null_safe_join(weighed, groups, ["root"]).select(
        F.col("root").alias("group"), "node", "blocks", "hub", "short", "task", *NAMES), "wanted")
    texts = marked.filter("text is not null").select(*(F.col(name).alias(f"t_{name}") for name in ("task", *NAMES)), "text")
    met = wanted.join(texts, [F.col(name) == F.col(f"t_{name}") for name in ("task", *NAMES)]).select(
        "group", "node", "blocks", "hub", "short", "text")
    members = materialize(met.mapInArrow(_with_sets(size), StructType([*met.schema.fields[:-1], *StructType.fromDDL("shingles binary").fields])), "loose-groups")
    return sets, linked(members, _Sets(matches, percent), rows_at_once=2 * BLOCK_SETS)


def near_groups(docs: DataFrame, percent: int = 85, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the row has the component's smallest id) of every row.

    Sets of ``size``-word shingles are linked if ``percent`` of their union is common.
    """
    texts = pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as binary) text")
    columns = set_columns()
    rows = map_rows(texts, lambda doc_id, text: (doc_id, *columns(text_set(text, size), text)), f"doc_id bigint, {SET}")
    marked = materialize(rows.withColumn("task", F.spark_partition_id()), "shingle-sets")
    sets, links = set_links(marked, percent, size, "doc_id")
    roots = components(links)

    own = null_safe_join(sets.select("node", "low", *NAMES), roots, ["node"], "left").select(F.coalesce("root", "node").alias("root"), "low", *NAMES)
    lowest = own.groupBy("root").agg(F.min("low").alias("component_id"))
    named = null_safe_join(own.select("root", *NAMES), lowest, ["root"])
    found = null_safe_join(marked.select("doc_id", F.col("n").alias("n_shingles"), *NAMES), named, NAMES, "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
