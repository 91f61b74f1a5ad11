"""Byte-level BPE in linear time: longest matches, backtracking, remembered compatibility of neighbours.

A token sequence is what the merges give exactly if every token merges back to itself and every two neighbours,
merged alone, stay two tokens. So a piece of text is covered from the left with the longest token that fits its left
neighbour; where none fits, the last token gives way to its next shorter prefix, and a place that led nowhere is never
tried again. Matches come from an Aho-Corasick automaton over the tokens with each byte written as one Latin-1
character; merges themselves run only on pairs of tokens, once per pair.

Encoding equals that of the rank file's own library: each match of the splitting pattern is encoded separately, and a
match that is itself a token stays whole.

Defined results: a null text is empty; empty text has no tokens; any bytes of valid UTF-8 round-trip exactly.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable
from functools import cache
from itertools import chain

import ahocorasick
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from qaspark.llm.common import Memo, map_rows, pick

RANKS = "byte_bpe_multi_50k.tiktoken"
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
REMEMBERED = 250_000
#: Pieces above this many characters are encoded anew each time.
LONG = 256
NEVER = 1 << 60
#: A single space between two other characters always starts a new match of the pattern.
PLAIN_SPACE = re.compile(r" (?<=\S )(?=\S)")


class ByteBpe:
    """Encoder and decoder over one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.bytes_of}
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
                                  .replace(r"(?!\S)", r"(?!\P{White_Space})")).findall
        self.together = Memo(lambda pair: self.merge(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == list(pair), 500_000)
        self.pieces = Memo(self.encode_piece, REMEMBERED)
        # By the text between two plain spaces, without the space before it.
        self.later = Memo(lambda chunk: self._encode_chunk(" " + chunk), REMEMBERED)
        self.automaton = ahocorasick.Automaton()
        #: Tokens that merge back to themselves, by their bytes as Latin-1.
        self.tokens = {
            token.decode("latin-1"): (len(token), rank)
            for token, rank in ranks.items() if len(token) == 1 or self.merge(token) == [rank]
        }
        #: The longest token by its first two bytes.
        self.reach: dict[str, int] = {}
        for token in self.tokens:
            self.reach[token[:2]] = max(len(token), self.reach.get(token[:2], 0))
        for token, match in self.tokens.items():
            self.automaton.add_word(token, match)
        self.automaton.make_automaton()
        self.shorter = Memo(self._shorter, 1 << 20)

    def _shorter(self, rank: int) -> tuple[int, int] | tuple[()]:
        """The longest token that is a proper prefix of one, with its length."""
        token = self.bytes_of[rank].decode("latin-1")
        return next((self.tokens[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.tokens), ())

    def merge(self, data: bytes) -> list[int]:
        """Merges in rank order, leftmost first: meant for a few bytes at a time."""
        parts, rank_of = [data[i:i + 1] for i in range(len(data))], self.ranks.get
        ranks = [rank_of(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1], NEVER)
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at], NEVER)
        return [self.ranks[part] for part in parts]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        return self.cover(data) if data else ()

    def cover(self, data: bytes) -> tuple[int, ...]:
        """The one sequence whose neighbours all agree, by backtracking from the longest matches."""
        text, together, shorter = data.decode("latin-1"), self.together, self.shorter
        chain_at = {}
        at = 0
        for _, match in self.automaton.iter_long(text):
            chain_at[at] = match
            at += match[0]
        ids = [rank for _, rank in chain_at.values()]
        for k, pair in enumerate(zip(ids, ids[1:])):
            if not together[pair]:
                break
        else:
            return tuple(ids)
        n, tokens = len(data), self.tokens

        def best(at: int) -> tuple[int, int]:
            found = chain_at.get(at)
            if not found:
                end = min(n, at + self.reach.get(text[at:at + 2], 1))
                while not (found := tokens.get(text[at:end])):
                    end -= 1
            return found

        dead: set[int] = set()
        del ids[k + 1:]
        lengths = [length for length, _ in chain_at.values()][:k + 1]
        at = sum(lengths)
        option = best(at)
        while True:
            while option and (at + option[0] in dead or (ids and not together[ids[-1], option[1]])):
                option = shorter[option[1]]
            if option:
                ids.append(option[1])
                lengths.append(option[0])
                at += option[0]
                if at == n:
                    return tuple(ids)
                option = best(at)
            elif ids:
                dead.add(at)
                at -= lengths.pop()
                option = shorter[ids.pop()]
            else:
                raise ValueError("the ranks do not cover every byte")

    def _encode_chunk(self, chunk: str) -> tuple[int, ...]:
        found = self.find(chunk)
        if len(found) == 1:
            return self.encode_piece(chunk)
        return tuple(chain.from_iterable(map(self._piece, found)))

    def _piece(self, piece: str) -> tuple[int, ...]:
        """A match that is part of a chunk; one that begins with a space is known as a chunk of its own."""
        if len(piece) > LONG:
            return self.encode_piece(piece)
        return self.later[piece[1:]] if piece[0] == " " and len(piece) > 1 else self.pieces[piece]

    def chunks(self, text: str) -> list[tuple[int, ...]]:
        """Ids of the text between plain spaces, in order."""
        first, *later = PLAIN_SPACE.split(text)
        known = self.later
        parts = [self._encode_chunk(first)]
        if len(max(later, key=len, default="")) > LONG:
            parts.extend(known[chunk] if len(chunk) <= LONG else self._encode_chunk(" " + chunk) for chunk in later)
        else:
            parts.extend(map(known.__getitem__, later))
        return parts

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.chunks(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def load(path: str) -> ByteBpe:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return ByteBpe(ranks, public_tokenizers.PATTERN)


def digest(doc_id: int | None, text: str | None, path: str) -> tuple:
    coder = load(path)
    ids = coder.encode(text or "")
    return (
        doc_id, len(ids), hashlib.sha256(",".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest(),
        hashlib.sha256(coder.decode(ids)).hexdigest(),
    )


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row."""
    where = path or public_tokenizers.path(RANKS)
    plain = pick(docs, doc_id=id_col, text=text_col)
    return map_rows(plain, lambda doc_id, text: (doc_id, load(where).encode(text or "")), "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of ``encode_documents``."""
    where = path or public_tokenizers.path(RANKS)
    plain = pick(encoded, doc_id="doc_id", ids="ids")
    return map_rows(plain, lambda doc_id, ids: (doc_id, load(where).decode(ids or []).decode("utf-8", "replace")), "doc_id bigint, text string")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and digest of the ids of every row, and the digest of what they decode to."""
    where = path or public_tokenizers.path(RANKS)
    plain = pick(docs, doc_id=id_col, text=text_col)
    return map_rows(plain, lambda doc_id, text: digest(doc_id, text, where), SCHEMA)
