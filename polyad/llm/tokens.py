"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one valid encoding, so it has exactly one valid last token.
Storing that token per prefix gives the encoding of each prefix by walking back, lets a text be
appended to without redoing what precedes, and limits the work after an edit to its surroundings.

A sequence of tokens is what the merges produce if and only if every two neighbours are: the merges of
two neighbours' bytes must end in these two tokens. ``BytePairVocabulary.fits`` decides this from the
times at which the tokens on both sides of the border exist.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges of the rank files of public_tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The longest look of the pattern beyond the end of a piece, in characters (of ``'ll`` after ``'``).
LOOK = 2
#: Folder of the vocabulary files.
TOKENIZERS = os.environ.get("POLYAD_TOKENIZERS", "/opt/tokenizers")
#: Pieces kept by a worker; a full cache is emptied.
CACHE_PIECES = 200_000
#: Longer pieces are not kept.
CACHE_CHARS = 48


def read_ranks(name: str, folder: str | None = None) -> dict[bytes, int]:
    """Token bytes to rank, of ``<folder>/<name>.tiktoken``."""
    with open(os.path.join(folder or TOKENIZERS, f"{name}.tiktoken"), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class BytePairVocabulary:
    """Tables for prefix dynamic programming over a rank file. Immutable but for its memory of border decisions."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        #: Every ending of a token, to the token that it is, or -1 where it is none: the scan for
        #: tokens that end at a position stops at the first unknown ending.
        self.endings: dict[bytes, int] = {}
        for token in ranks:
            for k in range(len(token)):
                self.endings.setdefault(token[k:], -1)
        self.endings.update(ranks)
        #: Two bytes side by side in some token, at ``a << 8 | b``: elsewhere every encoding has a border.
        self.joined = bytearray(1 << 16)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                self.joined[a << 8 | b] = 1
        self._segments: dict[bytes, list[int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self._border: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (split := self._split(token, rank)):
                self.parts[rank] = split
                self.merged[split] = rank
        # (token, rank at which its successor on the border's side forms), inner tokens last
        never = 1 << 60
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        for rank in self.bytes_of:
            for side, chains in ((1, self._right), (0, self._left)):
                chain, now, until = [], rank, never
                while True:
                    chain.append((now, until))
                    if now not in self.parts:
                        break
                    now, until = self.parts[now][side], now
                chains[rank] = chain

    def _split(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``."""
        found = []
        for k in range(1, len(token)):
            a, b = self.ranks.get(token[:k], rank), self.ranks.get(token[k:], rank)
            if a < rank and b < rank:
                found.append((a, b))
        if len(found) == 1:
            return found[0]
        parts = [self.ranks[token[k : k + 1]] for k in range(len(token))]
        while len(parts) > 2:  # merge in the order of ranks, below this token's own
            best = min(((self.ranks.get(self.bytes_of[a] + self.bytes_of[b], rank), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(rank, 0))
            if best[0] >= rank:
                return None
            parts[best[1] : best[1] + 2] = [best[0]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def formed(self, token: int) -> int:
        """The rank at which a token comes to exist; single bytes exist from the start."""
        return token if token in self.parts else -1

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` together ends in exactly these two tokens.

        It doesn't if some merge across the border comes first: two tokens next to the border, both
        there at that rank, of which neither has been taken by its own side. At equal rank the left
        merge comes first.
        """
        key = a << 32 | b
        if (known := self._border.get(key)) is not None:
            return known
        good = True
        for x, x_until in self._right[a]:
            x_formed = self.formed(x)
            for y, y_until in self._left[b]:
                m = self.merged.get((x, y))
                if m is not None and x_formed < m and self.formed(y) < m and m < x_until and m <= y_until:
                    good = False
                    break
            if not good:
                break
        if len(self._border) > 2_000_000:
            self._border.clear()
        self._border[key] = good
        return good

    def extend(self, data: bytes, last: list[int]) -> None:
        """Continue ``last`` (of a prefix of ``data``) to all of ``data``; ``last[i]`` ends the encoding of ``data[:i + 1]``."""
        endings, fits, border = self.endings, self.fits, self._border
        for end in range(len(last) + 1, len(data) + 1):
            found = []
            start = end - 1
            while start >= 0:
                token = endings.get(data[start:end])
                if token is None:
                    break
                if token >= 0:
                    found.append((start, token))
                start -= 1
            for start, token in reversed(found):
                if start == 0:
                    last.append(token)
                    break
                before = last[start - 1]
                known = border.get(before << 32 | token)
                if known or known is None and fits(before, token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte of the text")

    def back(self, last: list[int]) -> list[int]:
        """The token ids of the whole, from the last tokens of its prefixes."""
        ids, end, length = [], len(last), self.bytes_of
        while end:
            token = last[end - 1]
            ids.append(token)
            end -= len(length[token])
        ids.reverse()
        return ids

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of a piece. Where no token can cross, it falls into segments with tables of their own."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        joined, kept, ids, start, before = self.joined, self._segments, [], 0, piece[0]
        for k in range(1, len(piece) + 1):
            if k == len(piece) or not joined[before << 8 | piece[k]]:
                segment = piece[start:k]
                found = kept.get(segment)
                if found is None:
                    last: list[int] = []
                    self.extend(segment, last)
                    found = self.back(last)
                    if k - start <= CACHE_CHARS:
                        if len(kept) >= CACHE_PIECES:
                            kept.clear()
                        kept[segment] = found
                ids += found
                start = k
            if k < len(piece):
                before = piece[k]
        return ids


class Encoder:
    """Whole texts: pieces by the pattern, each by prefix dynamic programming."""

    def __init__(self, vocabulary: BytePairVocabulary, pattern: str = PATTERN):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern)
        self.kept: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, empty for an empty or missing one. Strings like special tokens are ordinary text."""
        ids: list[int] = []
        if not text:
            return ids
        kept, extend = self.kept, ids.extend
        for piece in self.pieces.findall(text):
            found = kept.get(piece)
            extend(self._new(piece) if found is None else found)
        return ids

    def count(self, text: str | None) -> int:
        """Number of tokens of a text."""
        if not text:
            return 0
        kept, n = self.kept, 0
        for piece in self.pieces.findall(text):
            found = kept.get(piece)
            n += len(self._new(piece) if found is None else found)
        return n

    def _new(self, piece: str) -> list[int]:
        ids = self.vocabulary.encode_piece(piece.encode())
        if len(piece) <= CACHE_CHARS:
            if len(self.kept) >= CACHE_PIECES:
                self.kept.clear()
            self.kept[piece] = ids
        return ids


class TokenizedText:
    """A text with the prefix tables of its pieces, for exact appends and edits that redo only what they touch."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.starts: list[int] = []
        self.tables: list[tuple[bytes, list[int]]] = []
        self.redone = 0
        self.edit(0, 0, text)

    def ids(self) -> list[int]:
        back = self.encoder.vocabulary.back
        return [x for _, last in self.tables for x in back(last)]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace ``text[start:end]`` by ``new``. ``redone`` counts the bytes whose prefixes were worked out anew.

        Pieces that end more than ``LOOK`` characters before the change stay. After it, a piece that
        begins where an old one began leaves all later ones as they were, for the pattern never looks back.
        """
        if not 0 <= start <= end <= len(self.text):
            raise ValueError("the edited range lies outside the text")
        old_text, old_starts, old_tables = self.text, self.starts, self.tables
        ends = [*old_starts[1:], len(old_text)] if old_starts else []
        keep = 0
        while keep < len(ends) and ends[keep] + LOOK < start:
            keep += 1
        self.text = old_text[:start] + new + old_text[end:]
        shift = len(new) - (end - start)
        later = {s + shift: k for k, s in enumerate(old_starts) if s >= end}
        starts, tables = old_starts[:keep], old_tables[:keep]
        self.redone = 0
        at = old_starts[keep] if keep < len(old_starts) else (len(old_text) if keep else 0)
        at = min(at, start)
        first = True
        while at < len(self.text):
            if at >= start + len(new) and at in later:
                k = later[at]
                starts += [s + shift for s in old_starts[k:]]
                tables += old_tables[k:]
                break
            piece = self.encoder.pieces.match(self.text, at)
            data = piece.group().encode()
            last: list[int] = []
            if first and keep < len(old_tables):  # the same bytes before the change keep their last tokens
                before, known = old_tables[keep]
                common = len(os.path.commonprefix([before, data]))
                last = known[:common]
            first = False
            self.redone += len(data) - len(last)
            self.encoder.vocabulary.extend(data, last)
            starts.append(at)
            tables.append((data, last))
            at = piece.end()
        self.starts, self.tables = starts, tables


_ready: dict[str, Encoder] = {}


def encoder(name: str, folder: str | None = None) -> Encoder:
    """The encoder of a vocabulary file, made once in a process."""
    key = f"{folder or TOKENIZERS}/{name}"
    if key not in _ready:
        _ready[key] = Encoder(BytePairVocabulary(read_ranks(name, folder)))
    return _ready[key]


def encode_corpus(documents: DataFrame, tokenizer: str = "byte_bpe_50k", *, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None) -> DataFrame:
    """``id_column`` and ``ids`` (ARRAY<INT>) of every document, without special tokens.

    A row stays a row: repeated rows give repeated results, a null id stays null, null and empty texts
    give an empty list. White space, controls and strings that look like special tokens are ordinary
    text. Other columns are dropped, whatever their names. No shuffle: one pass over the two columns.
    The vocabulary file must be readable on every executor under ``folder``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, folder).encode
        for batch in batches:
            keys, offsets, values, room = batch.column(0), [0], [], 0
            start = 0
            for k, text in enumerate(batch.column(1)):
                ids = encode(text.as_py())
                values.append(np.array(ids, dtype=np.int32))
                room += len(ids)
                offsets.append(room)
                if room >= 2_000_000 or k + 1 == len(batch):  # batches of bounded size, whatever the texts
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values), pa.int32()))
                    yield pa.RecordBatch.from_arrays([keys.slice(start, k + 1 - start), lists], names=["key", "ids"])
                    start, offsets, values, room = k + 1, [0], [], 0

    source = documents.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(id_column), "ids")


def count_corpus(documents: DataFrame, tokenizer: str = "byte_bpe_50k", *, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None) -> DataFrame:
    """``id_column`` and ``n_tokens`` (BIGINT, 0 for null and empty texts) of every document; otherwise as ``encode_corpus``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer, folder).count
        for batch in batches:
            sizes = pa.array([count(text.as_py()) for text in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=["key", "n_tokens"])

    source = documents.select(F.col(id_column).alias("key"), F.col(text_column).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, n_tokens bigint").select(F.col("key").alias(id_column), "n_tokens")
