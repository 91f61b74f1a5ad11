"""Row-wise operators against plain definitions, other libraries and held-out rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from qaspark.llm import byte_bpe, language_id, packing, quality_classifier, quality_rules, queries, word_ids
from qaspark.llm.common import pick

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "\n\n", "a", "a\x00b", "ΟΔΟΣ. İ!", "é́ ñ", "日本語 テスト", "x" * 5000, "<|endoftext|> <|im_end|>", "a\x1cb c​d"]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def clashing(spark, texts):
    """Extra columns whose names clash in case or with outputs, null ids, repeated rows."""
    data = [(k if k % 3 else None, t, "x", 1) for k, t in enumerate([*texts, *texts[:2]])]
    return spark.createDataFrame(data, "doc_id bigint, text string, TEXT string, score int").withColumn("kept", F.lit(True))


# --- byte-level BPE

@pytest.fixture(scope="module")
def library():
    coder = byte_bpe.load(public_tokenizers.path(byte_bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_byte_bpe_equals_the_library(library):
    coder = byte_bpe.load(public_tokenizers.path(byte_bpe.RANKS))
    pick = random.Random(1)
    alphabet = ["a", "e", "th", "  ", " ", "\n", "\x1c", " ", "é", "1", "'s", "日本", "!!", "😀", "\r\n", "tion", " the", "ab" * 200]
    texts = ODD + ["".join(pick.choices(alphabet, k=pick.randrange(30))) for _ in range(2000)]
    for text in texts:
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_byte_bpe_long_piece_is_linear(library):
    text = "abcabcab" * 4000
    assert byte_bpe.load(public_tokenizers.path(byte_bpe.RANKS)).encode(text) == library.encode_ordinary(text)


def test_op7_whole_table(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op7_byte_bpe(spark, SF).collect()
    assert len(found) == len(docs)
    for row in found:
        ids = library.encode_ordinary(docs[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()


def test_byte_bpe_round_trip_of_rows(spark):
    data = clashing(spark, [None, *ODD])
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(data)).collect()
    assert sorted(r.text for r in back) == sorted((r.text or "") for r in pick(data, text="text").collect())


# --- word ids and packing

def test_word_ids_equal_the_library():
    encoder = Tokenizer.from_file(public_tokenizers.path(word_ids.VOCABULARY))
    pick = random.Random(2)
    alphabet = ["a", "Σ", "ΟΔΟΣ.", "É", "  ", "\n", " ", "́", "1", "23", "'s", "'S", "日本", "...", ".", "The", ", ", "İ", "​", "<|endoftext|>"]
    for text in ODD + ["".join(pick.choices(alphabet, k=pick.randrange(12))) for _ in range(3000)]:
        expected = encoder.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(word_ids.word_tokens(text.encode()), "<u4").tolist() == expected


def test_best_fit_takes_the_tightest_bin():
    bins = packing.BestFit(10, 100)
    assert [bins.put(n) for n in (6, 7, 3, 4, 10, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]


def test_fullest_bin_closes_first():
    bins = packing.BestFit(10, 2)
    bins.put(8), bins.put(6)
    bins.put(5)  # three open: the bin with 8 closes
    assert bins.put(2)[0] == 1


def check_packing(rows, capacity):
    sequences = {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_op6_whole_table(spark):
    encoder = Tokenizer.from_file(public_tokenizers.path(word_ids.VOCABULARY))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op6_best_fit_packing(spark, SF).collect()
    sequences = check_packing(found, 2048)
    total = 0
    by_doc = {}
    for row in found:
        by_doc.setdefault(row.doc_id, []).append(row)
    for doc_id, text in docs.items():
        ids = np.array([*encoder.encode(text, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // 2048)))
        for r in pieces:
            own = ids[r.piece * 2048:(r.piece + 1) * 2048]
            assert (r.start, r.length, r.ids_crc32) == (r.piece * 2048, len(own), zlib.crc32(own.tobytes()))
    assert len(sequences) <= 1.02 * -(-total // 2048) + 1


def test_packing_odd_rows(spark):
    found = packing.pack_documents(clashing(spark, [None, *ODD, "word " * 5000])).collect()
    check_packing(found, 2048)
    assert sum(r.piece == 0 for r in found) == len(ODD) + 4
    assert packing.pack_documents(rows(spark, [])).count() == 0


# --- quality rules

def plain_base(text):
    words = text.encode().split()
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    counts = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    return (
        len(words), len(b"".join(words).decode()), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_op4_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = queries.op4_quality_rules(spark, SF).collect()
    assert len(found) == len(docs)
    for row in found:
        expected = plain_base(docs[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected
        assert row.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        if labels.get(row.doc_id) is not None and row.n_words >= 50:
            assert row.kept == (labels[row.doc_id] == 1)


def test_quality_rules_odd_rows(spark):
    texts = [None, *ODD, "one two three " * 4, "a b c\na b c\nd"]
    found = quality_rules.assess(clashing(spark, texts)).collect()
    assert len(found) == len(texts) + 2
    for row, text in zip(sorted(quality_rules.assess(rows(spark, texts)).collect(), key=lambda r: r.doc_id), texts):
        assert row[1:6] == plain_base(text or "")
        assert not row.kept
    assert quality_rules.assess(rows(spark, [])).count() == 0
    good = " ".join(f"word{k}" for k in range(60)) + "."
    assert quality_rules.judge(1, good.encode())[7]
    assert quality_rules.clean_lines(f"{good}\na | b | c | d\n{good}".encode()).decode() == good


# --- language identification

def test_forward_sums_all_segmentations():
    model = language_id.Model(("x",), {"▁": (0.1,), "▁a": (0.2,), "a": (0.3,), "b": (0.05,), "ab": (0.4,)})
    # ▁|a|b, ▁a|b, ▁|ab
    expected = 0.1 * 0.3 * 0.05 + 0.2 * 0.05 + 0.1 * 0.4
    assert np.exp(model.log_word("ab")[0]) == pytest.approx(expected)
    assert model.log_words(["ab"])["ab"][0] == pytest.approx(np.log(expected))
    long = "ab" * 40
    assert model.log_words([long])[long] == model.log_word(long)


def test_op5_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = queries.op5_language_id(spark, sf).collect()
    assert len(found) == len(langs)
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2) for row in found)
    held = [row for row in found if row.held_out]
    assert sum(row.lang_pred == langs[row.doc_id] for row in held) >= 0.98 * len(held)
    assert all(0 <= row.score <= 1 for row in found)


def test_language_odd_rows(spark):
    texts = [None, "", "123 !?", "Das ist gut und schön", "this is the end of the thing", "x" * 5000]
    train = spark.createDataFrame(
        [(1, "this is the end of the day", "en"), (3, "das ist gut und das ist schön", "de"), (None, "x", "en"), (4, None, "en"), (6, "abc", None)],
        "doc_id bigint, text string, lang string")
    model = language_id.train(train, held_out="false")
    assert model.languages == ("de", "en")
    found = {r.doc_id: r for r in language_id.predict(rows(spark, texts), model).collect()}
    assert [found[k].lang_pred for k in range(5)] == ["und", "und", "und", "de", "en"]
    assert language_id.predict(clashing(spark, texts), model).count() == len(texts) + 2
    empty = language_id.train(train.limit(0))
    assert {r.lang_pred for r in language_id.predict(rows(spark, texts), empty).collect()} == {"und"}


# --- quality classifier

def test_bradley_terry_orders_pairs():
    random_rows = np.random.default_rng(0)
    labels = random_rows.integers(0, 2, 400)
    values = random_rows.normal(size=(400, len(quality_classifier.FEATURES)))
    values[:, 2] += 3 * labels
    model = quality_classifier.fit(values, labels)
    scores = np.array([model.score(row) for row in values])
    assert (scores[labels == 1][:, None] > scores[labels == 0]).mean() > 0.95
    # The cut is the quantile of label 0's share.
    assert (scores < 0.5).sum() == (labels == 0).sum()


def test_op10_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = queries.op10_quality_classifier(spark, sf).collect()
    assert len(found) == 1000
    assert all(row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1) for row in found)
    held = [row for row in found if row.held_out and row.doc_id in labels]
    assert sum(row.predicted == labels[row.doc_id] for row in held) >= 0.97 * len(held)
    assert all(row.predicted == int(row.score >= 0.5) for row in found)


def test_classifier_odd_rows(spark):
    texts = [None, *ODD]
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (3, 7), (None, 1)], "doc_id bigint, quality int")
    model = quality_classifier.train(rows(spark, texts), labels, held_out="false")
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(clashing(spark, texts), model).collect())
    empty = quality_classifier.train(rows(spark, texts), labels.limit(0))
    assert {r.score for r in quality_classifier.score(rows(spark, texts), empty).collect()} == {0.5}


# --- rules on every line, bounded training

def test_line_rules_judge_lines_of_any_length():
    fails = lambda line: quality_rules.line_fails(line.encode(), line.encode().split(), quality_rules.Rules())
    assert fails("Home About Products Services Contact Login Blog") == "navigation"
    assert fails("Home » Products » Garden » Chairs of wood") == "navigation"
    assert fails("one | two | three | four") == "navigation"
    assert fails("The old house at the end of the road was sold in May") is None
    assert fails("Anna Berta Carl Dora went home.") is None
    prose = " ".join(["the quiet river runs along the old road to town"] * 5)
    notice = "All rights reserved, and no part of these pages may be stored, copied or sent on " + "in any form by any means " * 8
    assert len(notice.split()) > 40 and fails(notice) == "boilerplate"
    assert fails(f"{prose}. They ate a cookie. {prose}.") is None
    assert fails("Sign in. Subscribe. Read on.") == "boilerplate"
    assert fails("short end") == "punctuation" and fails("short end.") is None


def segmentations(word, known):
    if not word:
        yield ()
    for end in range(1, len(word) + 1):
        if word[:end] in known or end == 1:
            for rest in segmentations(word[end:], known):
                yield (word[:end], *rest)


def plain_training(rows, known, rounds=2, smoothing=0.1):
    """Expectation and maximisation over listed segmentations: language -> piece -> probability."""
    words = {lang: Counter() for lang, _ in rows}
    for lang, text in rows:
        words[lang].update(language_id.WORDS((text or "").lower()))
    model = None
    for _ in range(rounds):
        following = {}
        for lang, counts in words.items():
            expected = Counter()
            for word, n in counts.items():
                ways = list(segmentations("▁" + word, known))
                weights = [np.prod([(model[lang][p] if model else 1e-3) if p in known else 1e-9 for p in way]) for way in ways]
                for way, weight in zip(ways, weights):
                    for piece in way:
                        if piece in known:
                            expected[piece] += n * weight / sum(weights)
            total = sum(round(v, 3) for v in expected.values()) + smoothing * len(known)
            following[lang] = {piece: (round(expected[piece], 3) + smoothing) / total for piece in known}
        model = following
    return model


def test_op5_by_listed_segmentations(spark, tmp_path):
    """The whole query on a small table: folds, training, scores and languages from all segmentations one by one."""
    pick_ = random.Random(6)
    vocabulary = {"en": ["the", "cat", "and", "house", "was"], "de": ["der", "hund", "und", "haus", "war"]}
    docs = [(k, " ".join(pick_.choices(vocabulary[lang], k=6)) + pick_.choice(["", ".", " 12 é"]), lang, "s", 1)
            for k, lang in enumerate(["en", "de"] * 20)]
    docs += [(100, "the hund", None, "s", 1), (101, None, "en", "s", 1), (102, "12 .", "de", "s", 1)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in queries.op5_language_id(spark, str(tmp_path)).collect()}
    known = language_id.pieces(public_tokenizers.path(language_id.VOCABULARY))
    out = {doc_id: zlib.crc32(str(doc_id).encode()) % 4 == 2 for doc_id, *_ in docs}
    model = plain_training([(lang, text) for doc_id, text, lang, *_ in docs if lang and not out[doc_id]], known)
    languages = sorted(model)
    for doc_id, text, *_ in docs:
        words = language_id.WORDS((text or "").lower())
        assert found[doc_id].held_out == out[doc_id]
        if not words:
            assert (found[doc_id].lang_pred, found[doc_id].score) == ("und", 0.0)
            continue
        logs = np.array([sum(np.log(sum(np.prod([model[lang].get(p, 1e-9) for p in way]) for way in segmentations("▁" + word, known)))
                             for word in words) for lang in languages])
        assert found[doc_id].lang_pred == languages[int(logs.argmax())]
        assert abs(found[doc_id].score - 1 / np.exp(logs - logs.max()).sum()) < 1e-6


def test_language_without_spaces_is_learned(spark):
    kana = "".join(chr(0x3042 + 2 * k) for k in range(20)) * 4
    rows_ = [(k, kana[k:] + kana[:k], "ja") for k in range(20)] + [(100 + k, "this is a house and that is the garden", "en") for k in range(20)]
    model = language_id.train(spark.createDataFrame(rows_, "doc_id bigint, text string, lang string"), held_out="false")
    assert model.languages == ("en", "ja")
    assert [lang for lang, _ in language_id.identify([kana, "the garden"], model)] == ["ja", "en"]


def test_training_is_bounded_per_language_and_by_rows(spark):
    """A rare language beside a common one, and one id that half of the rows share."""
    rows_ = [(k, "many words here", "en") for k in range(300)] + [(7, f"again {k}", "en") for k in range(300)] + [(1000, "seltene worte", "de")]
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string, lang string")
    words = language_id.training_words(docs, 20, "doc_id", "text", "lang", "false").collect()
    assert {w.lang for w in words} == {"en", "de"}
    assert sum(w.n for w in words if w.lang == "en" and w.word in ("many", "again")) == 20
    labels = spark.createDataFrame([(7, 1), (3, 0), (5, 1)], "doc_id bigint, quality int")
    marked = quality_classifier.training_rows(docs, labels, 50, held_out="false")
    assert marked.count() == 50 and quality_classifier.training_rows(docs, labels, 1000, held_out="false").count() == 303
