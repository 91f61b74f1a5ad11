"""Operators across documents against brute force, on whole small tables and on odd rows."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from compare import connect, difference

from qaspark.llm import chat_tree, document_sketch, line_dedup, minhash, queries, simhash, suffix_dedup
from qaspark.llm.common import pick
from qaspark.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall())


def table(spark, rows):
    """Documents with extra columns that clash in case and with outputs."""
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, TEXT string, h int")


# --- suffix-array dedup

def repeated(texts, length):
    """Removed bytes of each text as flags."""
    counts = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        flags = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - length + 1):
            if counts[t[k:k + length]] > 1:
                flags[k:k + length] = True
        out.append(flags)
    return out


def kept_and_spans(text, flags):
    kept = bytes(np.frombuffer(text, "u1")[~flags])
    return kept, int((np.diff(np.r_[0, flags.astype(int)]) == 1).sum())


def test_deep_shallow_sort():
    pick_ = random.Random(3)
    for _ in range(300):
        strings = ["".join(pick_.choice("ab") for _ in range(pick_.randrange(12))).encode() for _ in range(pick_.randrange(1, 30))]
        strings = [b"q" * pick_.choice([0, 18]) + s for s in strings]
        order, prefixes = suffix_dedup.deep_shallow_sort(strings, pick_.choice([0, 2, 16]))
        assert [strings[k] for k in order] == sorted(strings)
        assert prefixes == [0] + [suffix_dedup.common(strings[a], strings[b]) for a, b in zip(order, order[1:])]


def test_reaches_against_all_pairs():
    pick_ = random.Random(4)
    for _ in range(200):
        n = pick_.randrange(2, 9)
        lefts = ["".join(pick_.choice("ab") for _ in range(6)).encode() for _ in range(n)]
        rights = ["".join(pick_.choice("ab") for _ in range(6)).encode() for _ in range(n)]
        expected = []
        for k in range(n):
            shared = [(suffix_dedup.common(lefts[k], lefts[j]), suffix_dedup.common(rights[k], rights[j])) for j in range(n) if j != k]
            shared = [s for s in shared if sum(s) >= 5]
            expected.append((max(s[0] for s in shared), max(s[1] for s in shared)) if shared else (0, 0))
        assert suffix_dedup.reaches(lefts, rights, 5) == expected


def test_op1_whole_table(spark, docs):
    ids = sorted(docs)
    texts = [docs[k].encode() for k in ids]
    found = {r.doc_id: r for r in queries.op1_suffix_dedup(spark, SF).collect()}
    assert len(found) == len(ids)
    for doc_id, text, flags in zip(ids, texts, repeated(texts, 200)):
        kept, n_spans = kept_and_spans(text, flags)
        row = found[doc_id]
        assert (row.n_bytes, row.n_removed, row.n_spans) == (len(text), int(flags.sum()), n_spans)
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("bucket", [20_000, 2])
def test_suffix_dedup_odd_rows(spark, bucket):
    """Periodic texts, overlaps, repeated rows, null ids and texts; small buckets split as large ones do."""
    pick_ = random.Random(5)
    passage = "".join(pick_.choice("abcde") for _ in range(60))
    rows = [(1, passage + "x"), (2, "y" + passage), (3, passage[:25] + "zzz" + passage[20:]), (4, "ab" * 40), (5, "ab" * 15), (None, passage[10:40]),
            (6, None), (7, ""), (8, "short"), (9, "é" * 30), (9, "é" * 30), (10, "é" * 29), (11, passage), (12, "q" + passage[1:30])]
    rows += [(20 + k, f"{k:02d}" * 3 + passage[5:35] + f"{k:03d}" * 2) for k in range(12)]
    texts = [(t or "").encode() for _, t in rows]
    found = suffix_dedup.removed_spans(table(spark, rows), length=20, gram=6, bucket=bucket).collect()
    actual = Counter((r.doc_id, bytes(r.text), tuple(suffix_dedup.merge_spans(r.starts or [], r.stops or [], len(r.text)))) for r in found)
    expected = Counter()
    for (doc_id, _), text, flags in zip(rows, texts, repeated(texts, 20)):
        edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(int), 0])).reshape(-1, 2)
        expected[doc_id, text, tuple(map(tuple, edges.tolist()))] += 1
    assert actual == expected
    assert suffix_dedup.removed_spans(table(spark, rows).limit(0)).count() == 0


def test_rows_of_one_id_whose_texts_collide_in_32_bits(spark):
    """Rows without an id are told apart by their texts: these begin with strings of one 32-bit hash."""
    pick_ = random.Random(8)
    tail = "".join(pick_.choices("abcdefgh", k=300))
    rows = [(None, "qq198959" + tail), (None, "qq364022" + tail), (7, "qq198959" + tail)]
    found = {bytes(r.text): suffix_dedup.merge_spans(r.starts, r.stops, len(r.text))
             for r in suffix_dedup.removed_spans(table(spark, rows), length=200).collect()}
    assert found == {rows[0][1].encode(): [(0, 308)], rows[1][1].encode(): [(8, 308)]}


def test_anchors_of_long_texts_meet(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 10)
    suffix_dedup._POWERS.clear()
    pick_ = random.Random(6)
    shared = bytes(pick_.choices(range(97, 123), k=900))
    text = bytes(pick_.choices(range(97, 123), k=777)) + shared
    sets = []
    for t in (text, shared):
        own = set()
        for offset, part in suffix_dedup._parts(t, 50):
            _, place, h = suffix_dedup.anchors([part], 50, 10)
            own |= {(offset + p - (len(t) - 900), x) for p, x in zip(place.tolist(), h.tolist())}
        sets.append(own)
    suffix_dedup._POWERS.clear()
    assert {a for a in sets[0] if 50 <= a[0] < 850} == {a for a in sets[1] if 50 <= a[0] < 850}


def test_long_unique_texts_lose_nothing(spark):
    """Anchors at the cuts of a long text are found by two parts; equal rows still repeat each other."""
    pick_ = random.Random(8)
    rows = [(k, "".join(pick_.choices("abcdefghijklmnopqrstuvwxyz", k=3 * suffix_dedup.BLOCK + 1000 * k))) for k in range(3)]
    assert suffix_dedup.spans(table(spark, rows)).count() == 0
    found = suffix_dedup.removed_spans(table(spark, rows + rows[:1]), length=200).collect()
    removed = Counter((r.doc_id, *suffix_dedup.merge_spans(r.starts or [], r.stops or [], len(r.text))) for r in found)
    assert removed == {(0, (0, len(rows[0][1]))): 2, (1,): 1, (2,): 1}


# --- SimHash

def plain_fingerprint(text, size=3):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """doc ids by brute force; fps: id -> fingerprint."""
    ids, parent = sorted(fps), {k: k for k in fps}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in ids}


def test_op2_whole_table(spark, docs):
    fps = {k: plain_fingerprint(t) for k, t in docs.items()}
    named = plain_components(fps)
    found = queries.op2_simhash(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {k: (f"{fps[k]:016x}", named[k]) for k in docs}
    assert len(found) == len(docs)


def test_anchors_lose_no_link():
    numbers = np.random.default_rng(1)
    base = numbers.integers(0, 2**64, 1500, dtype=np.uint64)
    flipped = base.copy()
    for k in range(len(flipped)):
        for bit in numbers.choice(64, numbers.integers(0, 4), replace=False):
            flipped[k] ^= np.uint64(1) << np.uint64(bit)
    fps = np.unique(np.r_[base, flipped])
    keys, rows = simhash.anchor_rows(fps)
    order = np.argsort(keys.view(np.int64), kind="stable")
    a, b = simhash.links_of_runs(keys[order], rows[order])
    found = {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    expected = {(int(f), int(g)) for k, f in enumerate(fps) for g in fps[k + 1:][np.bitwise_count(fps[k + 1:] ^ f) <= 2]}
    assert found == expected


def test_dense_run_gives_a_forest():
    fps = np.array([0] + [1 << k for k in range(40)], dtype=np.uint64)
    a, b = simhash.links_of_runs(np.zeros(len(fps), np.uint64), fps)
    assert len(a) == len(fps) - 1


def test_components_of_paths_and_stars(spark):
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200), (200, 300), (-5, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    expected = {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 160)} | {300: -5, 200: -5}
    assert found == expected
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_similar_groups_are_those_of_all_pairs(spark, monkeypatch):
    """Groups at 80 % against all pairs: pairs about the limit, chains, a template, equal fingerprints; large blocks and small."""
    pick_ = random.Random(10)
    word = lambda: "".join(pick_.choices("abcdefgh", k=6))
    texts = []
    template = [word() for _ in range(70)]
    for _ in range(60):
        words = [word() for _ in range(pick_.choice([1, 5, 45, 60, 150]))]
        for _ in range(4):  # each copy edits the one before
            texts.append(words)
            words = list(words)
            for _ in range(pick_.randrange(1, 2 + len(words) // 60)):
                words[pick_.randrange(len(words))] = word()
        texts.append(template + [word() for _ in range(pick_.choice([6, 10, 18]))])
    texts.append(texts[0][:1] * 9)
    texts.append(texts[0][:1] * 12)
    rows = [(k, " ".join(words)) for k, words in enumerate(texts)]
    sets = {k: shingles(t) for k, t in rows}
    fps = {k: plain_fingerprint(t) for k, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and (
        len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 or (fps[a] ^ fps[b]).bit_count() <= 2)]
    assert len(linked) > 80
    expected = {k: k for k in sets}
    for _ in range(len(texts)):
        for a, b in linked:
            expected[a] = expected[b] = min(expected[a], expected[b])
    for block in (256, 8):
        monkeypatch.setattr(minhash, "BLOCK_SETS", block)
        found = {r.doc_id: r.component_id for r in simhash.near_groups(table(spark, rows), similar=80).collect()}
        assert found == expected


def test_texts_below_the_share_stay_apart(spark):
    """Texts on one template that share 60 to 79 % of their shingles: none is linked."""
    pick_ = random.Random(11)
    word = lambda: "".join(pick_.choices("abcdefgh", k=6))
    template = [word() for _ in range(200)]
    rows = [(k, " ".join(template + [word() for _ in range(25 + k % 30)])) for k in range(150)]
    sets = {k: shingles(t) for k, t in rows}
    shares = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b]
    assert 0.6 < min(shares) and max(shares) < 0.8
    found = {r.doc_id: r.component_id for r in simhash.near_groups(table(spark, rows), similar=80).collect()}
    fps = {k: plain_fingerprint(t) for k, t in rows}
    assert found == plain_components(fps)


def test_similar_texts_are_grouped(spark):
    """Edited copies from 70 to 100 % shared shingles, and texts that share a third."""
    pick_ = random.Random(9)
    word = lambda: "".join(pick_.choices("abcdefgh", k=6))
    rows, pairs = [], []
    for base in range(60):
        words = [word() for _ in range(pick_.choice([60, 300, 1200]))]
        rows.append((100 * base, words))
        for copy in range(1, 5):
            edited = list(words)
            for place in pick_.sample(range(len(words)), int(len(words) * pick_.choice([0.005, 0.01, 0.02, 0.03]))):
                edited[place] = word()
            rows.append((100 * base + copy, edited))
        rows.append((100 * base + 50, words[:len(words) // 2] + [word() for _ in range(len(words) // 2)]))
    table_ = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in simhash.near_groups(table_, similar=80).collect()}
    sets = {k: shingles(" ".join(w)) for k, w in rows}
    for a in sets:
        for b in sets:
            if a < b and a // 100 == b // 100:
                pairs.append((len(sets[a] & sets[b]) / len(sets[a] | sets[b]), found[a] == found[b]))
    high = [same for share, same in pairs if share >= 0.8]
    assert len(high) > 100 and sum(high) >= 0.95 * len(high)
    assert not any(found[k] // 100 != k // 100 for k in sets)
    assert not any(found[k] != k for k in sets if k % 100 == 50)


def test_simhash_odd_rows(spark):
    rows = [(5, None), (6, " \n"), (None, "a b c d"), (None, "a b c d"), (3, "A B\tc d"), (9, "x"), (9, "x"), (4, "unlike others here")]
    found = Counter((r.doc_id, r.component_id, r.first) for r in simhash.near_groups(table(spark, rows)).collect())
    assert found == Counter({(5, 5, True): 1, (6, 5, False): 1, (None, 3, False): 2, (3, 3, True): 1, (9, 9, True): 2, (4, 4, True): 1})
    assert found == Counter((r.doc_id, r.component_id, r.first) for r in simhash.near_groups(table(spark, rows), similar=80).collect())
    assert simhash.near_groups(table(spark, rows).limit(0), similar=80).count() == 0


# --- document sketches

def shingles(text):
    words = text.split()
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_op3_whole_table(spark, docs):
    ids = sorted(docs)
    found = {r.doc_id: r for r in queries.op3_document_sketch(spark, SF).collect()}
    assert sorted(found) == ids
    misses = []
    for k, doc_id in enumerate(ids):
        text, following = docs[doc_id], docs[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        row = found[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
        if len(shingles(text)) > 400:
            misses.append(abs(row.near_edited - len(shingles(text) & shingles(edited)) / len(shingles(text))))
    assert np.mean(misses) < 0.1
    same = defaultdict(set)
    for doc_id, text in docs.items():
        same[text].add(found[doc_id].fingerprint)
    assert all(len(prints) == 1 for prints in same.values())


def test_sketches_merge_and_contain(spark):
    a, b = (" ".join(f"w{k}" for k in span) for span in (range(0, 3000), range(2500, 2900)))
    rows = document_sketch.with_sketch(spark.createDataFrame([(a, b, f"{a} {b}")], "a string, b string, c string"), "a", "a_")
    rows = document_sketch.with_sketch(document_sketch.with_sketch(rows, "b", "b_"), "c", "c_")
    row = rows.select(
        document_sketch.containment("b_sketch", "a_sketch").alias("b_in_a"), document_sketch.containment("a_sketch", "b_sketch").alias("a_in_b"),
        document_sketch.merge("a_sketch", "b_sketch").alias("merged"), "c_sketch", "a_sketch", document_sketch.parse(document_sketch.fingerprint("a_")).alias("parsed")).first()
    assert row.b_in_a == 1.0 and row.a_in_b == pytest.approx(396 / 2996, abs=0.05)
    assert set(row.merged) <= set(row.c_sketch) and row.parsed == row.a_sketch


def test_sketch_odd_rows(spark):
    rows = [(None, "null id"), (2, None), (2, "same id"), (5, ""), (10**12, "far " * 40), (-10**12, "é" * 9), (7, "a\tb")]
    found = document_sketch.compare_with_next(table(spark, rows)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[10**12].edited_sha256 == hashlib.sha256(("far " * 20 + "null id").encode()).hexdigest()
    assert by_id[None].edited_sha256 == hashlib.sha256(("null" + "é" * 3).encode()).hexdigest()
    assert by_id[5].edited_sha256 == hashlib.sha256(b"").hexdigest() and by_id[5].near_edited == 1.0
    only = document_sketch.compare_with_next(table(spark, [(1, "one two")])).collect()
    assert len(only) == 1 and only[0].near_next == 1.0
    assert document_sketch.compare_with_next(table(spark, rows).limit(0)).count() == 0


def test_sketch_ranges_are_even_for_sparse_and_null_ids(spark, monkeypatch):
    """One id far off and a third of the rows without an id: ranges stay even, and rows are those of one range."""
    monkeypatch.setattr(document_sketch, "GROUP", 50)
    rows = [(k if k % 3 else None, f"text number {k} of the table") for k in range(2999)] + [(10**15, "far off")]
    docs = table(spark, rows).repartition(4)
    texts = pick(docs, doc_id="doc_id", text="text")
    sizes = [r["count"] for r in texts.groupBy(document_sketch._group(texts).alias("g")).count().collect()]
    assert len(sizes) > 40 and max(sizes) < 300
    found = sorted(map(tuple, document_sketch.compare_with_next(docs).collect()), key=str)
    monkeypatch.setattr(document_sketch, "GROUP", 10**9)
    assert found == sorted(map(tuple, document_sketch.compare_with_next(docs).collect()), key=str)


def test_sketch_plan_is_native(spark):
    plan = queries.op3_document_sketch(spark, SF)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


# --- line dedup

def test_op8_states_its_rows(spark):
    for sf in ("sf0.001", "sf0.01"):
        sf_dir = f"/root/testdata/{sf}"
        assert difference(queries.op8_line_dedup(spark, sf_dir), connect(sf_dir), queries.ORACLE["op8_line_dedup"]) is None


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("partitions", ["3", "200"])
def test_line_dedup_odd_rows(spark, keep, partitions):
    """A hot line over many partitions, so that runs are cut."""
    rows = [(k, f"Hot line \nown {k}\n\nhot line") for k in range(300)] + [(1000, "rare\nhot LINE\t"), (1001, "rare"), (None, "hot line"), (None, None), (1002, ""), (1003, "rare\nrare")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = table(spark, rows)
        found = line_dedup.with_bitmaps(data, line_dedup.keep_bitmaps(data, min_docs=4, keep=keep)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    documents = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            documents[line.strip().lower()].add((doc_id is not None, doc_id or 0, text))
    expected = Counter()
    for doc_id, text in rows:
        kept = []
        for line in (text or "").split("\n"):
            key = line.strip().lower()
            common = bool(key) and len(documents[key]) >= 4
            if not common or (keep == "first" and min(documents[key]) == (doc_id is not None, doc_id or 0, text)):
                kept.append(line)
        expected[doc_id, "\n".join(kept)] += 1
    assert Counter((r.doc_id, line_dedup.kept_text(bytes(r.text), r.keep)[0].decode()) for r in found) == expected
    assert line_dedup.keep_bitmaps(data.limit(0)).count() == 0


# --- chat trees

def test_op9_states_its_rows(spark):
    for sf in ("sf0.001", "sf0.01"):
        sf_dir = f"/root/testdata/{sf}"
        assert difference(queries.op9_chat_tree(spark, sf_dir), connect(sf_dir), queries.ORACLE["op9_chat_tree"]) is None


def test_escapes_are_exact():
    pick_ = random.Random(7)
    for _ in range(3000):
        text = "".join(pick_.choice(["<", "\\", "|", "\n", "a", "<|im_end|>"]) for _ in range(pick_.randrange(12)))
        assert chat_tree.unescape(chat_tree.escape(text)) == text
        assert "<|" not in chat_tree.escape(text)
        assert chat_tree.read_segment(chat_tree.segment(text, text)[0]) == (text, text)


def conversations(spark):
    shared = [("system", "s"), ("user", "hello")]
    chats = {
        1: [*shared, ("assistant", "a")], 2: [*shared, ("assistant", "a"), ("user", "more")], 3: [*shared, ("assistant", "b")],
        4: [*shared, ("assistant", "b"), ("user", "x"), ("assistant", "<|im_end|>")], 5: [("user", "alone")], 6: [*shared, ("assistant", "a")],
        7: shared, None: [("user", "no id")], 8: [(None, None)], 9: [*shared, ("assistant", "b"), ("user", "y")],
    }
    rows = [(c, t, role, text, "x") for c, turns in chats.items() for t, (role, text) in enumerate(turns)]
    random.Random(8).shuffle(rows)
    return chats, spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, NODE string")


def test_tree_emits_shared_turns_once(spark):
    chats, data = conversations(spark)
    tree = chat_tree.build(data)
    nodes = {bytes(r.node): r for r in tree.nodes.collect()}
    prefixes = {tuple(turns[:k + 1]) for turns in chats.values() for k in range(len(turns))}
    assert len(nodes) == len(prefixes)
    streams = defaultdict(dict)
    for row in nodes.values():
        for k, c in enumerate(row.segment):
            assert row.start + k not in streams[bytes(row.tree)]
            streams[bytes(row.tree)][row.start + k] = c
    for stream in streams.values():
        assert sorted(stream) == list(range(len(stream)))
    # A node's ancestors, read through its intervals, are the conversation before it; positions follow.
    for row in nodes.values():
        before = "".join(streams[bytes(row.tree)][k] for a, b in row.attends for k in range(a, b))
        chain, at = [], row
        while at.parent is not None:
            at = nodes[bytes(at.parent)]
            chain.append(at.segment)
        assert before == "".join(reversed(chain)) and row.position == len(before)
        if row.parent is not None:
            parent = nodes[bytes(row.parent)]
            assert row.start >= parent.start + parent.length
    assert max(len(r.attends) for r in nodes.values()) <= 5
    digests = {r.conv_id: r for r in chat_tree.read_back(tree).collect()}
    assert set(digests) == set(chats)
    for conv_id, turns in chats.items():
        text = "".join(f"{role or ''}\n{text or ''}\n" for role, text in turns)
        assert digests[conv_id].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    masked = {bytes(r.tree) for r in chat_tree.token_rows(tree).collect() if r.loss}
    assert masked
    assert chat_tree.read_back(chat_tree.build(data.limit(0))).count() == 0


def test_tree_with_token_lengths(spark):
    _, data = conversations(spark)
    encode = lambda text: list(text.encode())[::2]
    for row in chat_tree.token_rows(chat_tree.build(data, encode), encode).collect():
        assert len(row.ids) > 0


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op4_quality_rules"])
def test_queries_state_their_rows(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE[name]) is None


def test_pick_takes_exact_names(spark):
    data = spark.createDataFrame([(1, "a", "b", "c")], ["id", "text", "Text", "a.b"])
    assert pick(data, x="Text", y="a.b").first().asDict() == {"x": "b", "y": "c"}
    with pytest.raises(ValueError):
        pick(data, x="TEXT")
