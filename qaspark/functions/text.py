"""Text expressions: tokens, templates, echo removal, padding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from qaspark.functions.let import let

# White space as Python's str methods see it, and the token and number patterns.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
TOKEN_PATTERN = r"\p{Nd}+\.\p{Nd}+|\p{Nd}+|[\p{L}\p{Nl}\p{No}]+|[^\p{IsWhite_Space}\x1c-\x1f]"
NUMBER_PATTERN = r"^\p{Nd}+(?:\.\p{Nd}+)?$"
PUNCTUATION = ("?", "!", ".", ",", ":", ";", "-", "(", ")", '"', "'", "/")
NUMBER = "<num>"
SPECIAL_WORDS = {
    "<color>": (
        "red", "blue", "green", "yellow", "black", "white",
        "orange", "purple", "pink", "brown", "gray",
    ),
    "<direction>": ("left", "right", "top", "bottom", "front", "back"),
    "<quantity>": ("many", "several", "few"),
}

# Two control characters in a row cannot come out of the tokenizer, which yields them one by one.
_HOLE = "\u0001\u0001"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def tokens(question: Column) -> Column:
    """Lower-cased decimals, integers, letter runs and single symbols."""
    return F.regexp_extract_all(F.lower(question), F.lit(TOKEN_PATTERN), F.lit(0))


def normalize_tokens(
    token_array: Column, special_words: Mapping[str, Sequence[str]] | None = SPECIAL_WORDS
) -> Column:
    """Numbers become ``<num>``; words of a special class become the name of the class."""

    def one(token: Column) -> Column:
        out = F.when(token.rlike(NUMBER_PATTERN), F.lit(NUMBER))
        for name, members in (special_words or {}).items():
            out = out.when(token.isin(*members), F.lit(name))
        return out.otherwise(token)

    return F.transform(token_array, one)


def build_template(token_array: Column, structural: Sequence[str]) -> Column:
    """Keep structural tokens and punctuation; number every other token as a slot.

    Slots are numbered without a fold: holes are cut out of the joined text and the pieces between
    them carry the running number as their index, so the work is linear in the question.
    """
    kept = sorted(set(structural) | set(PUNCTUATION))
    marked = F.array_join(
        F.transform(token_array, lambda t: F.when(t.isin(*kept), t).otherwise(F.lit(_HOLE))), " "
    )
    pieces = F.split(marked, _HOLE, -1)
    filled = F.array_join(
        F.transform(
            pieces,
            lambda piece, i: F.when(
                i == 0, piece
            ).otherwise(F.concat(F.lit("<slot_"), i.cast("string"), F.lit(">"), piece)),
        ),
        "",
    )
    # Tokens hold no white space, so single blanks are the only gaps there are.
    tight = F.regexp_replace(filled, " ([?!.,;:/])", "$1")
    return F.replace(F.replace(tight, F.lit("( "), F.lit("(")), F.lit(" )"), F.lit(")"))


def unique_ratio(token_array: Column) -> Column:
    return F.size(F.array_distinct(token_array)) / F.greatest(F.lit(1), F.size(token_array))


def _longest_echo(w: Column, said: Column) -> Column:
    """The longest run of two or more words that the text holds, the first by text among equals; null if there is none.

    Two pointers: a run that is held is tried one word longer, else the next start is taken, so twice as many runs as
    words are tried.
    """
    n = F.size(w)

    def step(state: Column, _: Column) -> Column:
        i, j, best = state["i"], state["j"], state["best"]

        def tried(run: Column) -> Column:
            longer = F.length(run) > F.length(best)
            better = best.isNull() | longer | ((F.length(run) == F.length(best)) & (run < best))
            return F.when(F.contains(said, run), F.struct(
                i.alias("i"), (j + 1).alias("j"), F.when(better, run).otherwise(best).alias("best"),
            )).otherwise(F.struct((i + 1).alias("i"), F.greatest(j, i + 2).alias("j"), best.alias("best")))

        return F.when(j > n, state).otherwise(let(F.array_join(F.slice(w, i, j - i + 1), " "), tried))

    start = F.struct(F.lit(1).alias("i"), F.lit(2).alias("j"), F.lit(None).cast("string").alias("best"))
    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), 2 * n)), start, step)["best"]
    return let(F.array_join(w, " "), lambda whole: F.when(F.contains(said, whole), whole).otherwise(walked))


def strip_question_echo(question: Column, answer: Column) -> Column:
    """Remove every run of two or more question words from the answer, longest run first.

    Runs of equal length are taken in text order. A run longer than the answer can never match, and the answer only
    shrinks: m words have at least 2m - 1 characters, so the answer bounds the words of the runs that are built.
    Every run holds a pair of neighbours: once no pair is left in the answer, no run is. That is tested first, and
    again without the longest run that the answer holds (the first of all to be removed); only an answer that still
    holds a pair then takes all runs one by one.
    """
    def removed(given: Column) -> Column:
        w, said = given["w"], given["said"]
        most = F.floor((F.length(said) + 1) / 2).cast("int")
        runs = F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 1)),
                lambda i: F.transform(
                    F.sequence(i + 1, F.greatest(i + 1, F.least(F.size(w), i + most - 1))),
                    lambda j: F.array_join(F.slice(w, i, j - i + 1), " "),
                ),
            )
        )
        fitting = F.filter(F.array_distinct(runs), lambda g: F.length(g) <= F.length(said))
        ordered = F.sort_array(
            F.transform(fitting, lambda g: F.struct((-F.length(g)).alias("k"), g.alias("g")))
        )
        one_by_one = F.aggregate(
            ordered,
            said,
            lambda acc, s: F.when(
                F.contains(acc, s["g"]), strip(F.replace(acc, s["g"], F.lit("")))
            ).otherwise(acc),
        )
        pairs = F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 1)), lambda i: F.array_join(F.slice(w, i, 2), " ")
        )

        def from_pairs(pairs: Column) -> Column:
            shorter = strip(F.replace(said, _longest_echo(w, said), F.lit("")))
            return F.when(
                (F.size(w) >= 2) & F.exists(pairs, lambda g: F.contains(said, g)),
                let(shorter, lambda rest: F.when(F.exists(pairs, lambda g: F.contains(rest, g)), one_by_one).otherwise(rest)),
            ).otherwise(said)

        return let(pairs, from_pairs)

    return let(F.struct(words(question).alias("w"), answer.alias("said")), removed)


def pad_ids(ids: Column, length: int, pad_id: int = 0) -> Column:
    """Cut or fill an id array to a fixed length."""
    return F.concat(
        F.slice(ids, 1, length),
        F.array_repeat(F.lit(pad_id).cast("int"), F.greatest(F.lit(0), F.lit(length) - F.size(ids))),
    )


def attention_mask(ids: Column, length: int) -> Column:
    """One for each real position, zero for padding."""
    real = F.least(F.size(ids), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(length) - real))


def capitalize(text: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(_tail(text)))


def upper_first(text: Column) -> Column:
    """First character upper, the rest untouched."""
    return F.concat(F.upper(F.substring(text, 1, 1)), _tail(text))


def _tail(text: Column) -> Column:
    return F.substr(text, F.lit(2))


def scale(value: Column, low: Column, high: Column) -> Column:
    """Min-max scale; a constant range gives 0."""
    return F.when(high == low, F.lit(0.0)).otherwise((value - low) / (high - low))


def inverse_scale(value: Column, low: Column, high: Column) -> Column:
    return F.lit(1.0) - scale(value, low, high)


def safe_div(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)
