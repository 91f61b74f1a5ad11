"""Line-first cleaning: rules reject single lines, then a document that loses too much of its text goes.

Each line with a word is judged by the rules of ``line_fails``; failing lines are removed, and a document is kept when
the share of its words' bytes in surviving lines is at least ``min_share``. Document-wide base rules (number of words,
share of repeated windows) come on top. One pass over each row, no shuffle.

Navigation is told by its shape: words between separators, or a row of short capitalised words that ends no sentence.
Boilerplate is told by the sentences of a line: it fails if those with a notice hold half of its words, so that a line
which is one notice fails at any length, and one remark in a long paragraph does no harm. An open end fails only lines of
few words, because lines of prose may be wrapped anywhere. All thresholds are in ``Rules``.

Defined results: a null text has no words and is rejected; a document without a word is rejected; lines without a
word neither pass nor fail; repeated rows are judged alone, each with the same verdict.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

from pyspark.sql import DataFrame

from qaspark.llm.common import map_rows, pick

# Characters that count as symbols, ends of a sentence, openings of notices that are no prose.
SYMBOLS = b"#*$%&|<>"
SENTENCE_ENDS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", "…".encode(), "”".encode(), "»".encode(), "。".encode())
BOILERPLATE = (
    b"all rights reserved", b"copyright", b"cookie", b"javascript", b"licensed under", b"privacy policy",
    b"released under the", b"sign in", b"sign up", b"subscribe", b"terms of service", b"terms of use",
)
SEPARATORS = frozenset((b">", b">>", b"/", b"//", b"::", b"-", b"*", *(mark.encode() for mark in ("»", "›", "→", "·", "•", "–", "—"))))

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_lines bigint, n_failed_lines bigint, surviving_share double"
)
SENTENCE_MARKS = re.compile(rb"[.!?;]")
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))


@dataclass(frozen=True)
class Rules:
    """Thresholds of the rules; a share is a part of a line's words unless it says otherwise."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_share: float = 0.5
    max_symbol_share: float = 0.3
    min_bars: int = 3
    max_bar_share: float = 0.2
    max_upper_share: float = 0.6
    max_echo_share: float = 0.5
    open_line_words: int = 4
    min_menu_words: int = 4
    max_menu_word: int = 15  # bytes of a word
    min_menu_share: float = 0.8
    min_notice_share: float = 0.5


def line_fails(line: bytes, words: list[bytes], rules: Rules) -> str | None:
    """The first rule that a line with words fails, or None."""
    n = len(words)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    bars = line.count(b"|") + sum(map(SEPARATORS.__contains__, words))
    if bars >= rules.min_bars and bars > rules.max_bar_share * n:
        return "navigation"
    ends = line.rstrip().endswith(SENTENCE_ENDS)
    if n >= rules.min_menu_words and not ends and sum(
            65 <= word[0] <= 90 and len(word) <= rules.max_menu_word for word in words) >= rules.min_menu_share * n:
        return "navigation"
    if symbols > rules.max_symbol_share * n and symbols > 1:
        return "symbols"
    if n > 1:
        upper = len(line) - len(line.translate(None, UPPER))
        letters = len(line) - len(line.translate(None, LETTERS))
        if upper > rules.max_upper_share * letters and line.count(b"!") > 1:
            return "shouting"
        if sum(map(eq, words, words[1:])) > rules.max_echo_share * (n - 1) and n > 3:
            return "echo"
    if n < rules.open_line_words and not ends:
        return "punctuation"
    low = line.lower()
    if any(phrase in low for phrase in BOILERPLATE):
        notices = (part for part in SENTENCE_MARKS.split(low) if any(phrase in part for phrase in BOILERPLATE))
        if sum(len(part.split()) for part in notices) >= rules.min_notice_share * n:
            return "boilerplate"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = reach = 0
    for start, window in enumerate(windows):
        if counts[window] > 1:
            covered += start + 3 - max(start, reach)
            reach = start + 3
    return covered


def judge(doc_id: int | None, text: bytes | None, rules: Rules = Rules()) -> tuple:
    text = text or b""
    words = text.split()  # bytes split at ASCII white space only
    # Code points are the bytes that do not continue another.
    joined = b"".join(words)
    word_chars = len(joined.decode("utf-8", "replace"))
    repeats = repeated_words(words)
    seen: set[bytes] = set()
    n_lines = duplicates = failed = surviving = total = 0
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            continue
        n_lines += 1
        size = sum(map(len, own))
        total += size
        repeated = line in seen
        duplicates += repeated
        seen.add(line)
        if repeated or line_fails(line, own, rules):
            failed += 1
        else:
            surviving += size
    share = surviving / total if total else 0.0
    n = len(words)
    base_failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
    return (
        doc_id, n, word_chars, len(text) - len(text.translate(None, SYMBOLS)), duplicates, repeats, base_failed,
        not base_failed and share >= rules.min_share, n_lines, failed, share,
    )


def assess(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, lines lost and verdict of every row."""
    plain = pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as binary) text")
    return map_rows(plain, lambda doc_id, text: judge(doc_id, text, rules), SCHEMA)


def clean_lines(text: bytes, rules: Rules = Rules()) -> bytes:
    """The text without its failing and repeated lines."""
    seen: set[bytes] = set()
    kept = []
    for line in text.split(b"\n"):
        own = line.split()
        if not own or (line not in seen and not line_fails(line, own, rules)):
            kept.append(line)
        seen.add(line)
    return b"\n".join(kept)
