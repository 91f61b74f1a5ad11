"""Every stage on its own input against brute force, the whole run on a small table, and odd rows."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_corpus_operators import plain_components, plain_fingerprint, repeated

import corpus_pipeline
from qaspark.llm import word_ids
from qaspark.session import materialize

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def kept(spark):
    """The input and the result of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], SF), name))
    return tables


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_are_in_order_and_keep_the_columns(kept):
    assert list(STAGES) == ["quality_classifier", "line_dedup", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    for table in kept[1:-1]:
        assert table.columns == list(corpus_pipeline.COLUMNS)
        assert table.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_quality_keeps_clean_documents(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = texts(kept[0]), texts(kept[1])
    assert all(before[k] == t for k, t in after.items())
    good = [k for k, q in labels.items() if q == 1]
    assert sum(k in after for k in good) >= 0.97 * len(good)
    bad = [k for k, q in labels.items() if q == 0]
    assert sum(k in after for k in bad) <= 0.1 * len(bad)


def test_lines_stay_in_their_first_document(kept):
    before, after = texts(kept[1]), texts(kept[2])
    where = defaultdict(set)
    for doc_id, text in before.items():
        for line in text.split("\n"):
            where[line.encode().strip().lower()].add(doc_id)
    expected = {}
    for doc_id, text in before.items():
        lines = text.split("\n")
        stay = [line for line in lines if not (key := line.encode().strip().lower()) or len(where[key]) < 10 or min(where[key]) == doc_id]
        if stay == lines or "\n".join(stay).strip():
            expected[doc_id] = "\n".join(stay)
    assert after == expected


def shingles(text):
    """The set of five-word shingles; fewer words are one, none is none."""
    words = text.encode().lower().split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_one_document_of_each_group_stays(kept):
    """Exactly the smallest id of each component of links: two bits or less, or 80 % of the shingles."""
    before, after = texts(kept[2]), texts(kept[3])
    sets = {k: shingles(t) for k, t in before.items()}
    lowest = plain_components({k: plain_fingerprint(t) for k, t in before.items()})
    similar = [(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(similar) > 3
    for _ in range(len(before)):
        for a, b in similar:
            low = min(lowest[a], lowest[b])
            if lowest[a] != lowest[b]:
                high = max(lowest[a], lowest[b])
                lowest = {k: low if v == high else v for k, v in lowest.items()}
    assert after == {k: t for k, t in before.items() if lowest[k] == k}


def test_repeated_passages_go(kept):
    before, after = texts(kept[3]), texts(kept[4])
    ids = sorted(before)
    expected = {}
    for doc_id, flags in zip(ids, repeated([before[k].encode() for k in ids], 200)):
        left = bytes(np.frombuffer(before[doc_id].encode(), "u1")[~flags]).decode("utf-8", "ignore")
        if left.strip() or not flags.any():
            expected[doc_id] = left
    assert after == expected


def test_packing_holds_every_remaining_document(kept):
    remaining, rows = texts(kept[4]), kept[5].collect()
    length = Counter()
    for row in rows:
        length[row.doc_id] += row.length
    assert length == Counter({k: len(word_ids.word_tokens(t.encode())) // 4 + 1 for k, t in remaining.items()})
    fill = Counter()
    for row in rows:
        fill[row.sequence_id] += row.length
    assert max(fill.values()) <= 2048


def test_run_is_all_stages(spark, kept):
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    whole = Counter(map(tuple, corpus_pipeline.run(spark, SF).select(*columns).collect()))
    assert whole == Counter(map(tuple, kept[5].select(*columns).collect()))


def odd(spark, tmp_path):
    long = " ".join(xxhash.xxh64_hexdigest(str(k).encode()) for k in range(60))
    rows = [(1, long), (1, long), (2, long + "!"), (None, long), (None, None), (3, ""), (4, "é" * 150), (5, "é" * 150 + "x"), (6, "one line\n" * 3)]
    rows += [(10 + k, f"common line\nown line {k}") for k in range(12)]
    data = [(d, t, None, None, len(t or ""), "extra", 1) for d, t in rows]
    return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string, keep int")


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_rows(spark, tmp_path, name):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd(spark, tmp_path)
    docs.select(F.col("doc_id"), *(F.col(c) for c in ("lang", "source", "n_chars"))).withColumn("text", F.lit("a b c")).write.parquet(str(tmp_path / "documents.parquet"))
    for table in (docs, docs.limit(0)):
        found = STAGES[name](spark, table, str(tmp_path)).collect()
        assert bool(found) <= bool(table.count())
    if name == "simhash_near_dedup":
        kept = Counter((r.doc_id, r.text) for r in STAGES[name](spark, docs, str(tmp_path)).collect())
        assert max(kept.values()) == 1 and kept[1, docs.first().text] == 1
    if name == "line_dedup":
        kept = {r.doc_id: r.text for r in STAGES[name](spark, docs.filter("doc_id >= 10"), str(tmp_path)).collect()}
        assert kept == {10 + k: ("common line\n" if k == 0 else "") + f"own line {k}" for k in range(12)}
    if name == "suffix_array_dedup":
        kept = {r.doc_id: r.text for r in STAGES[name](spark, docs.filter("doc_id in (4, 5)"), str(tmp_path)).collect()}
        assert kept == {5: "x"}
