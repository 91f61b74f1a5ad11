"""Rule-based Vietnamese paraphrases as array expressions: one row in, one row out, no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaspark.functions import text
from qaspark.functions.curriculum import paraphrase_count
from qaspark.functions.let import let

# Word class, headword and its synonyms.
SYNONYMS = (
    ("V", "giải thích", ("trình bày", "diễn giải",)),
    ("V", "hoàn thành", ("kết thúc", "làm xong",)),
    ("V", "xem", ("nhìn", "quan sát",)),
    ("V", "làm", ("thực hiện", "tiến hành",)),
    ("V", "thực hiện", ("làm", "tiến hành",)),
    ("V", "tiến hành", ("làm", "thực hiện",)),
    ("V", "đứng", ("dựng", "đứng lên",)),
    ("V", "ngồi", ("ngồi xuống",)),
    ("V", "nhìn", ("nhìn thấy", "trông thấy", "quan sát",)),
    ("V", "nhìn thấy", ("nhìn", "trông thấy",)),
    ("V", "trông thấy", ("nhìn", "nhìn thấy",)),
    ("V", "quan sát", ("nhìn", "xem",)),
    ("V", "mặc", ("mang", "đeo",)),
    ("V", "mang", ("mặc", "đeo",)),
    ("V", "đeo", ("mang", "mặc",)),
    ("A", "đẹp", ("xinh", "xinh đẹp",)),
    ("A", "rõ ràng", ("minh bạch", "dễ hiểu",)),
    ("A", "lớn", ("to", "rộng",)),
    ("A", "to", ("lớn", "rộng",)),
    ("A", "rộng", ("lớn", "to",)),
    ("A", "nhỏ", ("bé", "tí",)),
    ("A", "bé", ("nhỏ", "tí",)),
    ("A", "tí", ("nhỏ", "bé",)),
    ("A", "cao", ("cao lớn",)),
    ("A", "thấp", ("lùn",)),
    ("A", "xinh", ("đẹp", "đẹp đẽ",)),
    ("A", "xấu", ("xấu xí",)),
    ("A", "đỏ", ("đỏ thẫm",)),
    ("A", "xanh", ("xanh lam", "xanh dương",)),
    ("A", "vàng", ("vàng óng",)),
    ("A", "trắng", ("trắng tinh",)),
    ("A", "đen", ("đen tuyền",)),
    ("N", "ngôi nhà", ("căn nhà", "ngôi biệt thự",)),
    ("N", "phim", ("bộ phim", "tác phẩm điện ảnh",)),
    ("N", "màu", ("màu sắc", "sắc",)),
    ("N", "màu sắc", ("màu", "sắc",)),
    ("N", "người", ("con người", "cá nhân",)),
    ("N", "vật", ("đồ vật", "vật thể",)),
    ("N", "nơi", ("chỗ", "địa điểm",)),
    ("N", "chỗ", ("nơi", "địa điểm",)),
    ("P", "gì", ("cái gì", "thứ gì",)),
    ("P", "cái gì", ("gì", "thứ gì",)),
    ("P", "thứ gì", ("gì", "cái gì",)),
    ("P", "đâu", ("nơi nào", "chỗ nào",)),
    ("P", "nơi nào", ("đâu", "chỗ nào",)),
    ("P", "chỗ nào", ("đâu", "nơi nào",)),
    ("P", "ai", ("người nào",)),
    ("P", "người nào", ("ai",)),
    ("P", "bao nhiêu", ("mấy",)),
    ("P", "mấy", ("bao nhiêu",)),
    ("R", "rất", ("cực kỳ", "vô cùng",)),
    ("R", "cực kỳ", ("rất", "vô cùng",)),
    ("R", "vô cùng", ("rất", "cực kỳ",)),
    ("L", "này", ("đây", "nầy",)),
    ("L", "đây", ("này", "nầy",)),
    ("L", "kia", ("đó", "ấy",)),
    ("L", "đó", ("kia", "ấy",)),
)
PASSIVE_MARK = "được"


def synonym_rows() -> list[tuple[str, str, str]]:
    """``(pos, word, synonym)`` rows of the table."""
    return [(pos, word, synonym) for pos, word, synonyms in SYNONYMS for synonym in synonyms]


def _compound_gap() -> str:
    """Pattern of the space inside a headword of two words that stand alone in the text; words are tried at spaces only."""
    pairs = [head.split(" ") for _, head, _ in SYNONYMS if " " in head]
    return " (?:" + "|".join(
        rf"(?={re.escape(second)}(?:\s|$))(?<=(?:^|\s){re.escape(first)} )" for first, second in pairs
    ) + ")"


def segment(sentence: Column) -> Column:
    """Words, with headwords of two words joined by an underscore."""
    return text.words(F.regexp_replace(sentence, _compound_gap(), "_"))


def plain(word: Column) -> Column:
    return F.translate(word, "_", " ")


def lexicon_tag(token_array: Column) -> Column:
    """``array<struct<word, pos>>`` by the word list; other words get ``X``."""
    classes: dict[str, list[str]] = {}
    for pos, head, _ in SYNONYMS:
        classes.setdefault(pos, []).append(head)

    def pos_of(word: Column) -> Column:
        pos = F.lit("X")
        for name, heads in classes.items():
            pos = F.when(word.isin(*heads), F.lit(name)).otherwise(pos)
        # Most words are no headword, which one look-up tells.
        return F.when(word.isin(*[head for _, head, _ in SYNONYMS]), pos).otherwise("X")

    return F.transform(
        token_array, lambda word: F.struct(word.alias("word"), let(plain(word), pos_of).alias("pos"))
    )


def _synonym_map() -> Column:
    cells = []
    for pos, head, synonyms in SYNONYMS:
        cells += [F.lit(f"{pos}|{head}"), F.array(*[F.lit(s) for s in synonyms])]
    return F.create_map(*cells)


def synonym_variants(tagged: Column) -> Column:
    """One sentence per token position and synonym of the same word class."""
    def at(token: Column, i: Column, word_array: Column) -> Column:
        main = F.substring_index(token["pos"], "_", 1)
        options = F.try_element_at(_synonym_map(), F.concat(main, F.lit("|"), plain(token["word"])))
        return F.coalesce(
            F.transform(
                options,
                lambda synonym: F.array_join(
                    F.concat(
                        F.slice(word_array, 1, i), F.array(synonym), F.slice(word_array, i + 2, F.size(word_array))
                    ),
                    " ",
                ),
            ),
            F.array().cast("array<string>"),
        )

    return let(tagged["word"], lambda word_array: F.flatten(F.transform(tagged, lambda token, i: at(token, i, word_array))))


def _first_index(tagged: Column, prefix: str, after: int) -> Column:
    """0-based index of the first token of a class at or after ``after``; null when there is none."""
    places = F.transform(
        tagged, lambda t, i: F.when(t["pos"].startswith(prefix) & (i >= after), i)
    )
    return F.array_min(places)


def fronted_adverb(tagged: Column) -> Column:
    """The first adverb that does not already lead, moved to the front; null when there is none."""
    def build(word_array: Column, i: Column, rest: Column) -> Column:
        head, tail = rest[0], F.slice(rest, 2, F.size(rest))
        letter = F.substring(head, 1, 1)
        lower = (letter == F.lower(letter)) & (letter != F.upper(letter))
        moved = F.when(lower, F.concat(F.lower(head), F.lit(" "), F.array_join(tail, " "))).otherwise(
            F.array_join(rest, " ")
        )
        return F.concat(text.capitalize(word_array[i]), F.lit(", "), moved)

    def moved_or_none(given: Column) -> Column:
        w, i = given["w"], given["i"]
        rest = F.concat(F.slice(w, 1, i), F.slice(w, i + 2, F.size(w)))
        return F.when(i.isNotNull(), let(rest, lambda rest: build(w, i, rest)))

    return let(F.struct(tagged["word"].alias("w"), _first_index(tagged, "R", 1).alias("i")), moved_or_none)


def passive(tagged: Column) -> Column:
    """Object, passive mark, subject, verb, for a first verb strictly inside; else null."""
    def moved_or_none(given: Column) -> Column:
        w, i = given["w"], given["i"]
        n = F.size(w)
        moved = F.array_join(
            F.concat(F.slice(w, i + 2, n), F.array(F.lit(PASSIVE_MARK)), F.slice(w, 1, i), F.slice(w, i + 1, 1)), " ")
        return F.when(i.isNotNull() & (i > 0) & (i < n - 1), let(moved, text.upper_first))

    return let(F.struct(tagged["word"].alias("w"), _first_index(tagged, "V", 0).alias("i")), moved_or_none)


def candidates(question: Column, tagged: Column) -> Column:
    """Distinct sentences of all rules, without the question itself and without nulls."""

    def distinct(t: Column) -> Column:
        every = F.concat(synonym_variants(t), F.array(fronted_adverb(t), passive(t)))
        return F.array_distinct(F.filter(every, lambda c: c.isNotNull() & (c != question)))

    return let(tagged, distinct)


def pick_views(question: Column, options: Column, difficulty: Column, seed: Column | int = 0) -> Column:
    """The question and its paraphrases for the difficulty, filled up with the question.

    The pick is the head of a hash order: the same on every run and every partitioning.
    """
    wanted = paraphrase_count(difficulty)
    mark = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    marked = F.transform(options, lambda c: F.struct(F.md5(F.concat(c, F.lit(":"), mark)).alias("k"), c.alias("c")))
    # Only what is asked for is hashed, and only two are sorted.
    picks = F.when(wanted == 0, F.slice(options, 1, 0)).when(
        wanted == 1, F.filter(F.array(F.array_min(marked)["c"]), lambda c: c.isNotNull())).otherwise(F.slice(F.sort_array(marked), 1, wanted)["c"])
    return let(
        picks,
        lambda picked: F.concat(F.array(question), picked, F.array_repeat(question, wanted - F.size(picked))),
    )
