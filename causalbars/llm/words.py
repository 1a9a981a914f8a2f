"""Texts cut where neither tokenizer joins characters, so that each different part is tokenized once.

A text is cut before a space or line break that follows a character which is no white space.  A byte-level BPE with the usual
split pattern always ends a token there, and a piece model does so if its pieces hold marks of spaces only in front and no
line breaks (``PieceIds`` checks that).  The parts of a batch are cut and counted in columns; a part met before is a look-up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space before a space or line break: such texts are cut one by one.
_RUN = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}][ \n]"
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Words, numbers and signs, each with the space before it.  Fixed value: the usual pattern of byte-level BPE.
_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of letters and signs that every version of Unicode classifies alike.
_LATIN = re.compile(r"[ \n]?[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+").fullmatch
_OTHER = "\0 "


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.size = np.zeros(1024, kind), 0

    def extend(self, values: np.ndarray | list[int]) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            self.data = np.resize(self.data, max(end, 2 * len(self.data)))
        self.data[self.size : end] = values
        self.size = end

    def view(self) -> np.ndarray:
        return self.data[: self.size]


def flatten(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All lists in one, and the length of each."""
    length = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(length.sum())), length


class Ragged:
    """Lists of numbers under the codes 0, 1, 2, ..."""

    def __init__(self, kind: type):
        self.flat, self.start, self.length = Grown(kind), Grown(np.int64), Grown(np.int64)

    def append(self, lists: list[list[int]]) -> None:
        self.extend(*flatten(lists))

    def extend(self, flat: np.ndarray, length: np.ndarray) -> None:
        """Lists that stand one after the other in ``flat``."""
        self.start.extend(self.flat.size + np.cumsum(length) - length)
        self.length.extend(length)
        self.flat.extend(flat)

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of all codes, one after the other, and the length of each."""
        length = self.length.view()[codes]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start.view()[codes] - (ends - length), length) + np.arange(total)
        return self.flat.view()[at], length


class PartTable:
    """Codes for the parts of texts; ``learn`` is told of each new part, in the order of the codes.

    ``lead`` is what stands before every text: a space, or nothing.  The memory holds at most ``limit`` parts and those
    of one batch: beyond that it starts anew (``forget``).

    A part is known by the word behind its space, a part that begins with a line break by itself, and any
    other by a mark that no such word holds.
    """

    def __init__(self, lead: str = "", limit: int = 600_000):
        self.lead, self.limit = lead, limit
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}

    def learn(self, parts: list[str]) -> None:
        raise NotImplementedError

    def _codes(self, keys: list[str]) -> np.ndarray:
        found = list(map(self.known.get, keys))
        if None in found:
            new = list(dict.fromkeys(k for k, code in zip(keys, found, strict=True) if code is None))
            self.learn([k if k[:1] == "\n" else k[2:] if k[:2] == _OTHER else f" {k}" for k in new])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            found = list(map(self.known.__getitem__, keys))
        return np.array(found, np.int64)

    def split(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all parts of all texts, and the number of parts of each text."""
        if len(self.known) > self.limit:
            self.forget()
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, _RUN).to_numpy(zero_copy_only=False)
        if self.lead:
            odd = odd | pc.match_substring_regex(column, r"^[ \n]").to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._even(column)
        rows = np.flatnonzero(~odd)
        codes, sizes = self._even(column.take(pa.array(rows)))
        pieces: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        for row, piece in zip(rows, np.split(codes, np.cumsum(sizes)[:-1]), strict=True) if len(rows) else ():
            pieces[row] = piece
        for row in np.flatnonzero(odd):
            pieces[row] = self._codes([_key(p) for p in _CUT.split(self.lead + texts[row])])
        return np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)

    def _even(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts without runs of white space: every space and line break begins a part."""
        if not len(column):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        offsets = words.offsets.to_numpy()
        values = words.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        encoded = values.dictionary_encode()
        at, keys = encoded.indices.to_numpy(), encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.lead:
            return self._codes(keys)[at], np.diff(offsets)
        # The first part has no space before it; the others only need codes if they stand elsewhere too.
        rest = np.ones(len(at), bool)
        rest[offsets[:-1]] = False
        used = np.unique(at[rest])
        code = np.zeros(len(keys), np.int64)
        code[used] = self._codes([keys[i] for i in used.tolist()])
        codes = code[at]
        codes[offsets[:-1]] = self._codes([_OTHER + keys[i] for i in at[offsets[:-1]].tolist()])
        return codes, np.diff(offsets)


def _key(part: str) -> str:
    if part[:1] == "\n":
        return part
    return part[1:] if part[:1] == " " and part[1:2] != "\n" else _OTHER + part


def slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive rows of together about ``most``."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        total += int(size)
        if total >= most:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


class ByteIds:
    """Ids of a byte-level BPE file; ``plain`` takes the special tokens' strings in a text as plain text.

    Latin words, nearly all of most texts, go through a quicker implementation of the same merges, the others through
    the tokenizer itself.  The quicker one takes an entry's id as its rank, so it is used only where
    the merges of the file stand in the order of the ids.
    """

    def __init__(self, path: str, plain: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.quick = self._quick()
        self.line = self.whole("\n")

    def _quick(self):
        import tiktoken

        form = json.loads(self.tokenizer.to_str())
        model, before = form["model"], form["pre_tokenizer"] or {}
        merged = [model["vocab"]["".join(m)] for m in model["merges"]]
        if form["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or merged != sorted(merged):
            return None
        special = {t["id"] for t in form["added_tokens"]}
        ranks = {b: i for i, b in enumerate(self.bytes_of()) if i not in special}
        return tiktoken.Encoding("words", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def added(self) -> list[str]:
        return [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts (see ``PartTable``)."""
        if self.quick is None:
            return [self.whole(p) for p in parts]
        quick = self.quick.encode_ordinary
        return [
            self.whole(p) if not _LATIN(p) else [*self.line, *quick(p[1:])] if p[0] == "\n" else quick(p) for p in parts
        ]

    def bytes_of(self) -> list[bytes]:
        """Bytes of every id: each has one character in a byte-level entry."""
        byte = {chr(c): b for b, c in _byte_characters()}
        entries = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        return [bytes(byte.get(c, 63) for c in t) for t in entries]


def _byte_characters() -> Iterator[tuple[int, int]]:
    """(byte, code point) of byte-level entries: printable bytes stand for themselves, the others follow from 256 on."""
    spare = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            yield b, b
        else:
            yield b, spare
            spare += 1


class PieceIds:
    """Ids of a piece model for parts that begin with white space."""

    mark = "▁"

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(self.mark in p.lstrip(self.mark) or "\n" in p for p in self.pieces):
            raise ValueError("pieces with inner spaces or line breaks: texts cannot be cut at spaces")
        self.space = self.model.piece_to_id(self.mark)

    def encode(self, parts: list[str]) -> list[list[int]]:
        """The model adds a space, so a leading one is left out; before a line break it is a piece of its own, and dropped."""
        found = self.model.encode([p[1:] if p[:1] == " " else p for p in parts], num_threads=1)
        return [(ids or [self.space]) if p[:1] == " " else ids[1:] for p, ids in zip(parts, found, strict=True)]

    def bytes_of(self) -> list[bytes]:
        byte = self.model.is_byte
        return [bytes([int(p[1:-1], 16)]) if byte(i) else p.replace(self.mark, " ").encode() for i, p in enumerate(self.pieces)]
