"""Phrase mining, MinHash near-duplicates and the filter audit against brute force, on odd rows and empty tables."""

import pathlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from qaspark.llm import filter_audit, minhash, phrase_mining, queries
from qaspark.llm.common import sorted_lists
from qaspark.llm.components import components
from qaspark.llm.shingles import text_set

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- phrase mining

def mined(rows, least, best):
    """The contract in plain Python: (lang, text) -> result rows."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, 5):
                for k in range(len(words) - size + 1):
                    counts[lang][tuple(words[k:k + size])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for phrase, a in candidates.items():
            inside = any(len(q) > len(phrase) and 100 * b >= 80 * a and any(q[k:k + len(phrase)] == phrase for k in range(len(q)))
                         for q, b in candidates.items())
            if inside:
                continue
            score, k = min((2000000 * a // (f[phrase[:k]] + f[phrase[k:]]), k) for k in range(1, len(phrase)))
            found.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("partitions,best", [(1, 2000), (5, 2000), (3, 4)])
def test_phrases_equal_brute_force(spark, partitions, best):
    pick = random.Random(partitions)
    vocabulary = ["New", "york", "city", "the", "the", "the", "a", "of", "été", "x y", "\x1f", "-"]
    rows = [(pick.choice(["en", "de", None, "und"]), "".join(pick.choice(vocabulary) + pick.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "\r"])
                                                             for _ in range(pick.randint(0, 60)))) for _ in range(120)]
    rows += [("en", "the New York city of the new york") for _ in range(8)] + [("en", None), (None, None), ("fr", ""), ("fr", " . , \n")]
    docs = spark.createDataFrame([(k, *row, "x", 1) for k, row in enumerate(rows)], "doc_id int, lang string, text string, TEXT string, rank int")
    found = phrase_mining.collocations(docs.repartition(partitions), least=6, best=best).collect()
    assert sorted(map(tuple, found)) == mined(rows, 6, best)
    assert phrase_mining.collocations(docs.limit(0), least=6).count() == 0


def test_shards_are_bounded_and_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(phrase_mining, "HELD", 50)
    monkeypatch.setattr(phrase_mining, "RUN_BYTES", 40)
    long = ". ".join(f"a{k % 3} b c{k % 5}" for k in range(100)).encode()
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en"], "text": [long, b"a b", b"no end " * 30]})
    made = pa.Table.from_batches(list(phrase_mining._pack(iter([batch])))).to_pylist()
    assert len(made) > 5 and sum(row["n"] for row in made) == 300 + 2 + 60
    counts = Counter()
    for row in made:
        index = phrase_mining.Index(row["lang"], row["words"], row["bwt"])
        low, count = index.extended(*index.extended(*index.word_intervals()))
        for (*ids, c) in zip(*index.word_ids(low, 3), count.tolist()):
            counts[row["lang"], b" ".join(index.words[k] for k in ids)] += c
    expected = Counter(("en", f"a{k % 3} b c{k % 5}".encode()) for k in range(100))
    expected.update({("en", b"no end no"): 29, ("en", b"end no end"): 29})
    assert counts == expected


def test_extension_counts_every_phrase():
    pick = random.Random(2)
    for _ in range(100):
        ids = np.array([pick.choice([0, 1, 1, 2, 2, 3]) for _ in range(pick.randint(0, 50))] + [0], dtype=np.int32)
        assert sorted(phrase_mining.suffix_ranks(ids)) == list(range(len(ids)))
        index = phrase_mining.Index("x", b". a b c", phrase_mining.transform(ids).tobytes())
        low, count = index.word_intervals()
        for length in range(1, 6):
            if length > 1:
                low, count = index.extended(low, count)
            grams = Counter(tuple(ids[k:k + length].tolist()) for k in range(len(ids) - length + 1))
            found = dict(zip(zip(*(w.tolist() for w in index.word_ids(low, length))), count.tolist()))
            assert found == {g: c for g, c in grams.items() if 0 not in g}


def test_a_phrase_is_spelled_by_one_of_its_shards(spark):
    docs = spark.createDataFrame([(k, "a b c d", "x") for k in range(64)], "doc_id int, text string, lang string").repartition(8)
    stored = phrase_mining.shards(docs)
    assert stored.count() > 1
    found = phrase_mining.intervals(stored, 2, None, 30)
    assert found.count() == 3 * stored.count()  # every shard goes on from its own intervals
    assert [r.f for r in found.filter("f is not null").collect()] == [64] * 3
    counts = {r.phrase: r.f for r in phrase_mining.phrase_counts(stored, 4, 30).collect()}
    assert counts == dict.fromkeys(["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d", "a b c d"], 64)


def test_phrases_of_one_hash_are_told_apart(spark):
    """Hash 7 has two phrases (second hashes 1 and 2), -9 one with a second hash of the upper half, 8 is rare."""
    rows = [(7, 1, 3, 20, 0), (7, 2, 4, 15, 1), (-9, 2**32 - 1, 5, 20, 0), (-9, 2**32 - 1, 6, 15, 1 << 33), (8, 1, 7, 29, 0)]
    stated = spark.createDataFrame([(h, (g - (g >> 31 << 32)) << 32 | low, shard, c) for h, g, low, c, shard in rows], phrase_mining.INTERVALS)
    found = {(r.shard, r.low, r.c): r.f for r in phrase_mining.often(stated, 30).collect()}
    assert {k: f for k, f in found.items() if k[1] < 5} == {(0, 3, 20): 20, (1, 4, 15): 15}
    assert sorted((f or 0 for k, f in found.items() if k[1] > 4)) == [0, 35] and len(found) == 4


def test_one_shard_is_held_at_a_time():
    """300,000 words of a shard, 60,000 of them different: what a worker allocates over two of them."""
    ids = (np.arange(300_000, dtype=np.int64) ** 2 % 60_013 % 60_000 + 1).astype(np.int32)
    ids[9::10] = 0
    words = b" ".join([b"."] + [b"w%d" % k for k in range(60_000)])
    bwt = phrase_mining.transform(ids).tobytes()
    batches = [pa.RecordBatch.from_pydict({"shard": [k], "lang": ["x"], "words": [words], "bwt": [bwt]}) for k in range(2)]
    tracemalloc.start()
    try:
        made = sum(len(batch) for batch in phrase_mining._state(2)(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made > 100_000 and peak < 50 * len(ids)


def test_shards_are_stored_few_to_a_row_group(spark):
    docs = spark.createDataFrame([(f"l{k}", "a b") for k in range(10)], "lang string, text string").coalesce(1)
    files = pathlib.Path(phrase_mining.shards(docs).scratch_path.removeprefix("file:")).glob("*.parquet")
    sizes = [data.row_group(k).num_rows for data in map(pq.read_metadata, files) for k in range(data.num_row_groups)]
    assert sum(sizes) == 10 and max(sizes) <= phrase_mining.SHARDS_STORED


def test_lists_of_intervals_are_made_by_sorting(spark):
    """As many lists on the heap as a task has shards would grow with the input."""
    lists = spark.range(10).groupBy("id").agg(F.collect_list("id").alias("l"))
    before = spark.conf.get("spark.sql.execution.useObjectHashAggregateExec")
    with sorted_lists(spark):
        plan = lists.select("*")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "ObjectHash" not in plan
    assert spark.conf.get("spark.sql.execution.useObjectHashAggregateExec") == before


# --- MinHash

def groups_by_pairs(rows, percent):
    sets = [set(text_set((text or "").encode(), 3).tolist()) for _, text in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    lows = {}
    for k, (doc_id, _) in enumerate(rows):
        ids = lows.setdefault(find(k), [])
        if doc_id is not None:
            ids.append(doc_id)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        low = min(lows[find(k)], default=None) if sets[k] else doc_id
        out.append((doc_id, len(sets[k]), low, doc_id == low))
    return sorted(out, key=repr)


def near_copies(pick, words, base, changes, count):
    own = [pick.choice(words) for _ in range(base)]
    for _ in range(count):
        copy = list(own)
        for _ in range(pick.randint(0, changes)):
            copy[pick.randrange(base)] = pick.choice(words)
        yield " ".join(copy)


@pytest.mark.parametrize("block", [256, 4])
@pytest.mark.parametrize("percent", [85, 60])
def test_minhash_groups_are_those_of_all_pairs(spark, monkeypatch, block, percent):
    """Groups around the limit, chains, templates that do not link, copies; small blocks meet as one large one does."""
    monkeypatch.setattr(minhash, "BLOCK_SETS", block)
    pick = random.Random(percent)
    words = [f"w{k}" for k in range(400)]
    texts = [t for _ in range(6) for t in near_copies(pick, words, 60, 6, 12)]
    texts += list(near_copies(pick, words, 40, 1, 30)) + ["a b c", "a  B\tc", "a b", "A b", "", None, " \n", "a b c d"]
    rows = [(100 + k if k % 9 else None, t) for k, t in enumerate(texts)] + [(100, texts[0]), (100, "other words here"), (1, texts[5]), (1, texts[5])]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, TEXT string, kept int").repartition(3)
    found = minhash.near_groups(docs, percent=percent).collect()
    assert sorted(map(tuple, found), key=repr) == groups_by_pairs(rows, percent)
    assert minhash.near_groups(docs.limit(0)).count() == 0


def test_large_group_makes_spanning_links_only(spark, monkeypatch):
    """A group of many blocks costs its size: links are fewer than two a member and list."""
    pick = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    texts = list(near_copies(pick, words, 200, 2, 600))
    monkeypatch.setattr(minhash, "BLOCK_SETS", 16)
    made = {}
    plain = minhash.linked
    monkeypatch.setattr(minhash, "linked", lambda members, likeness, **more: made.setdefault(type(likeness).__name__, plain(members, likeness, **more)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = minhash.near_groups(docs)
    assert found.filter("component_id = 0").count() == 600 and found.filter("kept").count() == 1
    assert made["_Sets"].count() < 2 * 600


def test_common_shingles_are_counted(monkeypatch):
    monkeypatch.setattr(minhash, "WIDTH", 7)
    pick = np.random.default_rng(5)
    sets = [np.unique(pick.integers(0, 40, pick.integers(0, 30)).astype("<u8")) for _ in range(12)]
    found = minhash.common_shingles(sets)
    assert all(found[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(12) for j in range(12) if i != j)


def test_match_threshold_bounds_the_loss():
    from math import comb
    for share in (0.5, 0.8, 0.85, 0.99):
        m = minhash.match_threshold(share)
        below = sum(comb(48, k) * share ** k * (1 - share) ** (48 - k) for k in range(m))
        assert below <= minhash.LOSS < below + comb(48, m) * share ** m * (1 - share) ** (48 - m)
    assert minhash.match_threshold(1.0) == 48


def test_signature_agrees_as_often_as_sets_do():
    pick = np.random.default_rng(3)
    agreed = 0
    for _ in range(200):
        shared, a, b = (pick.integers(0, 1 << 63, size, dtype=np.uint64) for size in (60, 20, 20))
        agreed += int((minhash.signature(np.r_[shared, a]) == minhash.signature(np.r_[shared, b])).sum())
    assert abs(agreed / (200 * 48) - 0.6) < 0.02


# --- filter audit

def audited(rows, labels):
    """(doc_id, text, lang) and (doc_id, quality, toxic) -> result rows, order by order."""
    smallest = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            smallest[text or ""] = min(doc_id, smallest.get(text or "", doc_id))
    judged = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = WORDS.findall(text)
        first = smallest.get(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": first is not None and (doc_id is None or first < doc_id)}
        judged.append((lang or "", {x for x, bad in fails.items() if bad}, any(d == doc_id and q == 1 for d, q, _ in labels if d is not None),
                       any(d == doc_id and t == 1 for d, _, t in labels if d is not None)))
    out, shares = [], Counter()
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                removed = [j for j in left if letter in j[1]]
                left = [j for j in left if letter not in j[1]]
                shares[part, letter] += len(removed)
                out.append([part, "".join(order), step, len(left), len(removed), sum(letter in j[1] for j in own) - len(removed),
                            sum(j[1] == {letter} for j in own), sum(j[2] for j in removed), sum(j[3] for j in removed)])
    return sorted((*row, shares[row[0], row[1][row[2] - 1]]) for row in out)


def test_audit_equals_all_orders_one_by_one(spark):
    pick = random.Random(4)
    texts = ["", None, "Tab\tHere 5%", "x", " \n ", "a " * 250, " ".join(f"w{k}" for k in range(220)), "W " + " ".join(f"w{k}" for k in range(220)),
             " ".join(f"W{k}" for k in range(220)), "q & r"]
    rows = [(pick.choice([None, *range(30)]), pick.choice(texts), pick.choice(["en", "de", None, ""])) for _ in range(150)]
    rows += rows[:5]
    labels = [(pick.choice([None, *range(30)]), pick.choice([0, 1, None]), pick.choice([0, 1, None])) for _ in range(40)]
    docs = spark.createDataFrame([(*row, "x", 1) for row in rows], "doc_id bigint, text string, lang string, TEXT string, n int").repartition(4)
    marks = spark.createDataFrame([(*row, "y") for row in labels], "doc_id bigint, quality int, toxic int, text string")
    found = filter_audit.audit(docs, marks)
    assert sorted(map(tuple, found.collect())) == audited(rows, labels)
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert sorted(map(tuple, filter_audit.audit(docs, marks.limit(0)).collect())) == audited(rows, [])


def test_audit_takes_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x"), (3, "c", "x")], "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([(2, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = filter_audit.audit(docs, marks, {"S": F.col("n_words") < 2, "T": filter_audit.COPY}).orderBy("filter_order", "step")
    assert [tuple(r)[1:] for r in found.collect()] == [
        ("ST", 1, 2, 1, 0, 1, 0, 0, 2), ("ST", 2, 1, 1, 0, 1, 1, 0, 2), ("TS", 1, 2, 1, 0, 1, 1, 0, 2), ("TS", 2, 1, 1, 0, 1, 0, 0, 2)]


# --- whole queries

@pytest.mark.parametrize("name", ["op11_phrase_mining", "op12_minhash", "op13_filter_audit"])
def test_queries_equal_their_sql(spark, name):
    from compare import connect, difference
    folder = "/root/testdata/sf0.001"
    assert difference(queries.QUERIES[name](spark, folder), connect(folder), queries.ORACLE[name]) is None


def test_components_helper_is_shared(spark):
    found = components(spark.createDataFrame([(1, 2), (3, 2)], "a bigint, b bigint"))
    assert sorted(map(tuple, found.collect())) == [(2, 1), (3, 1)]
