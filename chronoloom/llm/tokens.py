"""Token ids of whole texts by a tokenizers file, with the pieces of words remembered.

A text is cut where no token can reach across: before a single space or line break
between two other characters. Each piece's ids are kept in a dictionary, so that the
tokenizer sees a piece once. Pieces of plain letters, digits and signs are cut further,
as the file's own pre-tokenizer would cut them. Where the file is byte-level, the new plain
pieces of many texts are merged together, in arrays.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import re
from array import array

import numpy as np
import regex

_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85᠎​﻿])(?=[ \n][^\s\x1c-\x1f\x85᠎​﻿])")
_PLAIN = re.compile(r"[ \n]?[!-~¡-ÿ]+")
#: Pre-tokenizer patterns of the two files (fixed values).
_BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_END = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _shown_bytes() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next from U+0100."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_SHOWN = _shown_bytes()
#: The same for whole characters of plain pieces.
_SHOWN_CHARACTER = {chr(c): chr(c).encode().decode("latin-1").translate(_SHOWN) for c in range(256)}
#: Of each Latin-1 character: 0 a space or line break, 1 a letter, 2 a number, 3 anything else.
_KIND = np.array([0 if chr(c) in " \n" else 1 if regex.match(r"\p{L}", chr(c)) else 2 if regex.match(r"\p{N}", chr(c)) else 3 for c in range(256)], np.uint8)
#: Pieces that `_Merges` takes: plain, short, without an apostrophe, which may begin a contraction.
_SHORT = re.compile(r"\n?[!-&(-~¡-ÿ]{1,64}")
#: Characters whose pieces are looked up together.
_AT_ONCE = 1 << 20
_NO_RANK = 1 << 30
_BLANK_ENDS = "\u180e\u200b\ufeff"


def _blank(character: str) -> bool:
    return character.isspace() or character in _BLANK_ENDS


class _Merges:
    """The merges of a byte-level vocabulary, done on many units at once: in each round every unit does its first-ranked one, the leftmost of equals."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.byte = np.array([vocab[_SHOWN.get(b, chr(b))] for b in range(256)], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.bits = max(8, len(keys).bit_length() + 3)
        self.key, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NO_RANK, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            open_ = self.key[at] < 0
            self.key[at[open_]] = keys[left[open_]]
            here = self.key[at] == keys[left]
            self.rank[at[here]] = left[here]
            left, at = left[~here], (at[~here] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = self._slot(keys)
        got = self.key[at]
        out = np.where(got == keys, self.rank[at], _NO_RANK)
        look = np.flatnonzero((got != keys) & (got >= 0))
        while len(look):
            at[look] = (at[look] + 1) & ((1 << self.bits) - 1)
            got = self.key[at[look]]
            out[look] = np.where(got == keys[look], self.rank[at[look]], _NO_RANK)
            look = look[(got != keys[look]) & (got >= 0)]
        return out

    def ids(self, raw: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, place of each unit's first id, with the end of the last); ``first``: where units begin in the bytes ``raw``."""
        size = np.diff(first, append=len(raw))
        s, unit, ended = self.byte[raw], np.arange(len(first)), []
        rank = np.full(len(s), _NO_RANK, np.int64)
        rank[:-1] = self._ranks(s[:-1], s[1:])
        rank[first + size - 1] = _NO_RANK
        counts = np.zeros(len(first), np.int64)
        while len(unit):
            best = np.minimum.reduceat(rank << 32 | np.arange(len(s)), first)
            at, best = best & 0xFFFFFFFF, best >> 32
            live = best < _NO_RANK
            if not live.all():
                counts[unit[~live]] = size[~live]
                ended.append((unit[~live], size[~live], s[np.repeat(~live, size)]))
            keep = np.repeat(live, size)
            at, best = at[live], best[live]
            s[at] = self.made[best]
            keep[at + 1] = False
            place = at - first[live]
            unit, size = unit[live], size[live] - 1
            s, rank = s[keep], rank[keep]
            first = np.cumsum(size) - size
            at = first + place
            last = place == size - 1
            rank[at[last]] = _NO_RANK
            right, left = at[~last], at[place > 0]
            rank[right] = self._ranks(s[right], s[right + 1])
            rank[left - 1] = self._ranks(s[left - 1], s[left])
        start = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros(start[-1], np.uint32)
        for u, n, ids in ended:
            out[np.repeat(start[u] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, start


class _Cache(dict):
    """Ids of strings as little-endian unsigned 32-bit bytes: the last ``most`` and, of those before, what is asked for again."""

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        out = self.older[key] if key in self.older else self.make(key)
        self[key] = out
        return out

    def empty(self) -> None:
        self.older = {}
        self.clear()


class Encoder:
    """``encode(text)`` gives the ids of the text as bytes, equal to ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    A text that may hold the string of a special token goes to the tokenizer whole, which gives that token's id.
    """

    def __init__(self, path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: How the strings of special tokens begin; a text without it holds none.
        self.mark = os.path.commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.word_end = '"type": "Replace"' in (self.tokenizer.normalizer and str(self.tokenizer.to_str(pretty=False).replace('":"', '": "'))[:4000] or "")
        self.tokenize = self.tokenizer.model.tokenize
        self.units = _Cache(self._unit, most)
        self.first = _Cache(self._piece, most // 4)
        self.spaced = _Cache(self._spaced, most)
        self.merges = None if self.word_end else self._merges()

    def _merges(self) -> _Merges | None:
        """None where the file is not the plain byte-level kind."""
        file = json.loads(self.tokenizer.to_str())
        model, cut = file["model"], file["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        whole = all(_SHOWN.get(b, chr(b)) in model["vocab"] for b in range(256)) and not file["normalizer"]
        return _Merges(model) if plain and whole and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") else None

    def _whole(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _unit(self, unit: str) -> bytes:
        shown = "".join([_SHOWN_CHARACTER[c] for c in unit])
        return array("I", [t.id for t in self.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not _PLAIN.fullmatch(piece):
            return self._whole(piece)
        units = self.units
        if self.word_end:
            found = _WORD_END.findall(piece.lower())
        else:
            found = _BYTE_LEVEL.findall(piece)
        return units[found[0]] if len(found) == 1 else b"".join([units[x] for x in found])

    def _spaced(self, piece: str) -> bytes | None:
        """Ids of a piece after a space (or with its line break); None where it has white space at an end."""
        bare = piece[1:] if piece[:1] == "\n" else piece
        if not bare or _blank(bare[0]) or _blank(bare[-1]):
            return None
        return self._piece(piece if piece[:1] == "\n" else " " + piece)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.mark in text:
            return self._whole(text)
        return self._joined(text, text.replace("\n", " \n").split(" "))

    def _joined(self, text: str, pieces: list[str]) -> bytes:
        head = pieces[0]
        if head and not _blank(head[-1]):
            found = [*map(self.spaced.__getitem__, pieces)]
            found[0] = self.first[head]
            try:
                return b"".join(found)
            except TypeError:  # a None: runs of white space
                pass
        first = self.first
        return b"".join([first[x] for x in _CUT.split(text)])

    def _learn(self, pieces: set[str]) -> None:
        """Remember the ids of those pieces after a space that are new and short."""
        spaced = self.spaced
        if len(spaced) >= spaced.most:  # learnt together, they cost less than moves from an older half
            spaced.empty()
        new = [x for x in pieces if x not in spaced and _SHORT.fullmatch(x)]
        if not new:
            return
        joined = "".join([x if x[0] == "\n" else " " + x for x in new])
        c = np.frombuffer(joined.encode("latin-1"), np.uint8)
        kind = _KIND[c]
        begin = kind == 0  # of pieces; of units: as the pre-tokenizer cuts, a space goes with what follows
        cut = begin.copy()
        cut[1:] |= (kind[1:] != kind[:-1]) & (c[:-1] != 32)
        place = np.cumsum(1 + (c > 127)) - 1 - (c > 127)
        ids, start = self.merges.ids(np.frombuffer(joined.encode(), np.uint8), place[cut])
        ends = [*(4 * start[:-1][begin[cut]]).tolist(), 4 * len(ids)]
        raw = ids.tobytes()
        spaced.update(zip(new, [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], strict=True))

    def encode_all(self, texts: list[str]):
        """``encode`` of each of the texts, in order."""
        if self.merges is None:
            yield from map(self.encode, texts)
            return
        at = 0
        while at < len(texts):
            some, held = [], 0
            while at < len(texts) and held < _AT_ONCE:
                some.append(texts[at])
                held += len(texts[at])
                at += 1
            pieces = [None if not t or self.mark in t else t.replace("\n", " \n").split(" ") for t in some]
            self._learn(set().union(*filter(None, pieces)))
            for t, p in zip(some, pieces, strict=True):
                yield self._joined(t, p) if p else self.encode(t)

    def forget(self) -> None:
        """Drop the remembered ids, which else stay in a worker between tasks, and give the memory back."""
        for cache in (self.units, self.first, self.spaced):
            cache.empty()
        with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
