"""Text expressions against brute force and hand-worked examples."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from qaspark.functions import paraphrase, text
from qaspark.operators import augment, labels, templates

SAMPLES = [
    "What color is the red box, left of 3.5 cups?", "", "   ", "một hai  ba", "(a) b/c: d; e! 'f' \"g\"-h_i",
    "été ½ ² ٣٤ 12.5.7", "tab\tand\nline nbsp", "HOW MANY several FEW", "\u0001\u0001 x \u0001", "a.b .5 5.",
]


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column.alias("x")).first()["x"]


def python_tokens(sentence):
    pattern = r"\d+\.\d+|\d+|[^\W\d_]+|\S"
    out = []
    for token in re.findall(pattern, sentence.lower()):
        name = next((k for k, v in text.SPECIAL_WORDS.items() if token in v), token)
        out.append("<num>" if re.fullmatch(r"\d+(\.\d+)?", token) else name)
    return out


def python_template(tokens, kept):
    counter = itertools.count(1)
    filled = " ".join(t if t in kept or t in text.PUNCTUATION else f"<slot_{next(counter)}>" for t in tokens)
    filled = re.sub(r"\s+([?!.,;:/])", r"\1", filled)
    return filled.replace("( ", "(").replace(" )", ")").strip()


def test_tokens_and_templates_match_plain_python(spark):
    kept = ["<num>", "<color>", "the", "of", "\u0001"]
    rows = spark.createDataFrame(list(enumerate(SAMPLES)), "i int, q string")
    tokens = text.normalize_tokens(text.tokens(F.col("q")))
    got = {r.i: r for r in rows.select("i", tokens.alias("t"), text.build_template(tokens, kept).alias("x")).collect()}
    for i, sample in enumerate(SAMPLES):
        expected = python_tokens(sample)
        assert got[i].t == expected, sample
        assert got[i].x == python_template(expected, kept), sample


def python_echo(question, answer):
    words = question.split()
    runs = {" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 2, len(words) + 1)}
    for run in sorted(runs, key=lambda r: (-len(r), r)):
        if run in answer:
            answer = answer.replace(run, "").strip()
    return answer


@pytest.mark.parametrize("question, answer", [
    ("what color is the shirt of the girl wearing glasses?", "the girl wearing glasses wears a red shirt"),
    ("a b c", "a b c"), ("a b c", "aa b b"), ("one", "one two"), ("", "x y"), ("a b", ""), ("a a a a", "a a a"),
    ("x  y\tz", "x y z x y"), ("đây là phòng nào", "đây là phòng khách"), ("a b a b", "a b a b a b c"),
])
def test_echo_removal_matches_brute_force(spark, question, answer):
    got = one(spark, text.strip_question_echo(F.col("q"), F.col("a")), q=question, a=answer)
    assert got == python_echo(question, answer)


def test_known_echo(spark):
    rows = spark.createDataFrame(
        [("what color is the shirt of the girl wearing glasses?", "the girl wearing glasses wears a red shirt")],
        "question string, answer string",
    )
    assert labels.clean_answers(rows).first().answer == "glasses wears a red shirt"


def test_padding(spark):
    for ids in ([], [5, 6], [1, 2, 3, 4, 5]):
        got = one(spark, F.struct(text.pad_ids(F.col("x"), 4), text.attention_mask(F.col("x"), 4)), x=ids or None) if ids else None
        if ids:
            assert list(got[0]) == (ids + [0] * 4)[:4]
            assert list(got[1]) == ([1] * len(ids) + [0] * 4)[:4]


SENTENCE = "Cô giáo giải thích bài rất rõ ràng"


def test_paraphrases_of_the_example(spark):
    rows = spark.createDataFrame([(0, SENTENCE)], "row_idx bigint, question string")
    made = {(r.rule, r.candidate) for r in augment.paraphrases(rows).collect()}
    assert ("synonym", "Cô giáo trình bày bài rất rõ_ràng") in made
    assert ("synonym", "Cô giáo giải_thích bài cực kỳ rõ_ràng") in made
    assert ("adverb", "Rất, Cô giáo giải_thích bài rõ_ràng") in made
    assert ("passive", "Bài rất rõ_ràng được Cô giáo giải_thích") in made
    assert len([m for m in made if m[0] == "synonym"]) == 6


@pytest.mark.parametrize("difficulty, outputs", [(0.0, 3), (0.3, 3), (0.5, 2), (0.65, 2), (1.0, 1)])
def test_view_counts(spark, difficulty, outputs):
    rows = spark.createDataFrame([(0, SENTENCE), (1, "xyz")], "row_idx bigint, question string")
    views = {r.row_idx: r.views for r in augment.paraphrase_views(rows, difficulty).collect()}
    assert len(views[0]) == outputs and views[0][0] == SENTENCE and len(set(views[0])) == outputs
    assert views[1] == ["xyz"] * outputs


def test_given_tags_win(spark):
    rows = spark.createDataFrame([(0, "we run fast", [("we", "P"), ("run", "V_x"), ("fast", "R")])],
                                 "row_idx bigint, question string, tagged array<struct<word string, pos string>>")
    made = {(r.rule, r.candidate) for r in augment.paraphrases(rows).collect()}
    assert made == {("adverb", "Fast, we run"), ("passive", "Fast được we run")}


def test_synonym_table_size():
    assert len(paraphrase.SYNONYMS) == 57
    assert {p for p, _, _ in paraphrase.SYNONYMS} == set("VANPRL")


def test_registry_of_augmentations(spark):
    with pytest.raises(ValueError, match="rule-based"):
        augment.create(augment.TEXT, "mae")
    with pytest.raises(ValueError):
        augment.register(augment.TEXT, "x", "not callable")
    rows = spark.createDataFrame([(0, "q")], "row_idx bigint, question string")
    assert augment.augment(rows, None) is rows


def test_mining_inputs_are_checked(spark):
    with pytest.raises(TypeError):
        templates.adapt({"questions": []})
    with pytest.raises(ValueError, match="img_path"):
        templates.adapt(spark.range(1).selectExpr("id as row_idx", "'q' as question", "'a' as answer"))
    for bad in ({"hardness_percentile": 1.5}, {"max_hard_samples": 0}, {"structural_token_percentile": -1}):
        with pytest.raises(ValueError):
            templates.TemplateConfig(**bad)


def test_mining_keeps_null_answers_and_empty_tables(spark):
    shape = "row_idx bigint, question string, answer string, img_path string"
    rows = spark.createDataFrame([(i, "how many cups?", None if i % 2 else "two", "p") for i in range(6)], shape)
    report = templates.extract(rows)
    assert report.templates.first().support == 6
    assert report.scored.count() == 6
    assert report.members.count() == 6
    empty = templates.extract(spark.createDataFrame([], shape))
    assert set(empty.structural_tokens) == set(text.PUNCTUATION)
    assert empty.hard_threshold == 0.0 and empty.hard_samples.count() == 0


def test_mining_does_not_depend_on_partitioning(spark):
    shape = "row_idx bigint, question string, answer string, img_path string"
    rows = spark.createDataFrame(
        [(i, f"is the {['red', 'blue', 'tall'][i % 3]} box {i % 7} {'left' * (i % 2)}?", f"a{i % 5}", "p") for i in range(300)], shape
    )
    def result(df):
        report = templates.extract(df)
        return report.structural_tokens, report.templates.collect(), report.hard_samples.collect()
    assert result(rows.repartition(1)) == result(rows.repartition(7))


def test_longest_echo_is_found_without_all_runs(spark):
    def longest(question, answer):
        return one(spark, text._longest_echo(text.words(F.col("q")), F.col("a")), q=question, a=answer)

    assert longest("a b c d", "x a b c y") == "a b c"
    assert longest("a b c d", "c d and a b") == "a b"  # the first by text among equals
    assert longest("a b c d", "so a b c d it is") == "a b c d"
    assert longest("a b", "b a") is None
    assert one(spark, text.strip_question_echo(F.col("q"), F.col("a")), q="a b X Y c", a="a bX Y c b") == "b"  # a run that a removal makes
