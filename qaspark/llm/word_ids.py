"""Token ids of the public word vocabulary, looked up word by word.

The vocabulary's own splitter never joins what white space parts, so the ids of a text are those of its
space-delimited words in order. A word is encoded once per worker and remembered; a stop after a letter is a word of
its own, as the splitter has it.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import count

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from qaspark.llm.common import Memo

VOCABULARY = "word_bpe_49k.json"
REMEMBERED = 300_000
#: A stop between an ASCII letter and white space or the end.
STOP = re.compile(rb"(?<=[a-z])[.,](?=[ \n]|$)")
#: Letters that the vocabulary's normaliser leaves as they are and its splitter keeps together.
LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch


def _byte_characters() -> dict[int, str]:
    """Bytes as the characters that stand for them in byte-level vocabularies."""
    others = count(256)
    return {b: chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(next(others)) for b in range(256)}


@cache
def _words(path: str) -> Memo:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder = Tokenizer.from_file(path)
    merge, normal = encoder.model.tokenize, encoder.normalizer.normalize_str
    characters = _byte_characters()

    def encode(word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if not word.isascii():
            text = normal(text)
        if LETTERS(text):
            if not word.isascii():
                text = text.encode().decode("latin-1").translate(characters)
            ids = [token.id for token in merge(text)]
        else:
            ids = encoder.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    return Memo(encode, REMEMBERED)


def word_tokens(text: bytes, path: str | None = None) -> bytes:
    """The ids of a UTF-8 text as little-endian unsigned 32-bit numbers."""
    memo = _words(path or public_tokenizers.path(VOCABULARY))
    return b"".join(map(memo.__getitem__, STOP.sub(rb" \g<0>", text.lower()).split()))
