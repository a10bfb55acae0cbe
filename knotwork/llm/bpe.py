"""Byte-level BPE by backtracking (problem 7).

Instead of replaying merges, the encoder lays tokens from left to right: at
each position it tries the longest vocabulary match first.  A token may follow
another only if BPE would not have merged across their border; that is a
property of the pair alone, looked up in a compatibility table that fills as
pairs are met.  Where no match fits, the last token is withdrawn and a shorter
one tried; a position that failed once is never tried again, so the work is
linear in the text.

All matches of a piece come from one Aho-Corasick pass.  Bytes are handled as
the characters U+0000..U+00FF.  Ids must be in the order of the merges, as in
all public byte-level vocabularies.
"""

from __future__ import annotations

import json
from pathlib import Path

import ahocorasick
import numpy as np
import regex

#: pieces up to this many bytes are remembered, and at most this many of them
MEMO_BYTES, MEMO_ENTRIES = 48, 400_000


def _byte_names() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character -> byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """One vocabulary: ``encode`` a text, ``decode`` ids."""

    def __init__(self, path: str, pattern: str):
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        names = _byte_names()
        latin = lambda token: "".join(chr(names[c]) for c in token)
        special = {t["content"] for t in json.loads(Path(path).read_text(encoding="utf-8")).get("added_tokens", []) if t.get("special")}
        ids = {latin(t): i for t, i in model["vocab"].items() if t not in special}
        self.size = max(ids.values()) + 1
        self._piece = regex.compile(pattern)
        self._id = ids
        text = [""] * self.size
        for t, i in ids.items():
            text[i] = t
        self._len = [len(t) for t in text]
        # how each token was made, and which pairs make a token
        self._halves: list[tuple[int, int]] = [(i, i) for i in range(self.size)]
        self._made: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = latin(a), latin(b)
            whole = ids[a + b]
            self._halves[whole] = (ids[a], ids[b])
            self._made[ids[a], ids[b]] = whole
        # next shorter token that begins a token
        self._shorter = [-1] * self.size
        for t, i in ids.items():
            for n in range(len(t) - 1, 0, -1):
                if t[:n] in ids:
                    self._shorter[i] = ids[t[:n]]
                    break
        self._find = ahocorasick.Automaton()
        for t, i in ids.items():
            self._find.add_word(t, i)
        self._find.make_automaton()
        self._fits: dict[int, bool] = {}
        self._memo: dict[str, tuple[int, ...]] = {}
        # offset table for decoding: all tokens in one buffer
        self._buffer = np.frombuffer("".join(text).encode("latin-1"), dtype=np.uint8)
        self._start = np.concatenate([[0], np.cumsum(self._len)]).astype(np.int64)

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between two tokens unmerged."""
        key = left * self.size + right
        known = self._fits.get(key)
        if known is None:
            known = self._fits[key] = self._border(left, right)
        return known

    def _border(self, left: int, right: int) -> bool:
        # Undo the merges of both sides, the latest first.  If at some moment the two
        # tokens at the border make a token that is earlier than the merge undone last,
        # BPE would have taken it.
        bound = self.size
        while True:
            if self._made.get((left, right), bound) < bound:
                return False
            a, b = self._halves[left], self._halves[right]
            whole_left, whole_right = a[0] == a[1] == left, b[0] == b[1] == right
            if whole_left and whole_right:
                return True
            if not whole_left and (whole_right or left > right):
                bound, left = left, a[1]
            else:
                # a merge at the border wins a tie, as it lies further left
                bound, right = right + 1, b[0]

    def piece(self, word: str) -> list[int]:
        """Ids of one piece, given as characters U+0000..U+00FF."""
        whole = self._id.get(word)
        n = len(word)
        if n == 1 and whole is not None:
            return [whole]
        longest, size = [-1] * n, self._len
        for end, token in self._find.iter(word):
            at = end - size[token] + 1
            if longest[at] < 0 or size[longest[at]] < size[token]:
                longest[at] = token
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        shorter, fits = self._shorter, self.fits
        while at < n:
            while token >= 0 and not (open_[at + size[token]] and (not out or fits(out[-1], token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                open_[at] = 0
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                token = out.pop()
                at -= size[token]
                token = shorter[token]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty one."""
        if not text:
            return []
        out: list[int] = []
        memo = self._memo
        for word in self._piece.findall(text):
            ids = memo.get(word)
            if ids is None:
                raw = word.encode("utf-8", "replace").decode("latin-1")
                ids = self.piece(raw)
                if len(raw) <= MEMO_BYTES:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[word] = tuple(ids)
            out.extend(ids)
        return out

    def decode(self, ids) -> str:
        """The text of a list of ids, by the offset table."""
        ids = np.asarray(ids, dtype=np.int64)
        if not len(ids):
            return ""
        first, length = self._start[ids], self._start[ids + 1] - self._start[ids]
        ends = np.cumsum(length)
        index = np.arange(ends[-1]) + np.repeat(first - (ends - length), length)
        return self._buffer[index].tobytes().decode("utf-8", "replace")


_LOADED: dict[tuple[str, str], Bpe] = {}


def load(path: str, pattern: str) -> Bpe:
    """One encoder per process and vocabulary."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(path, pattern)
    return _LOADED[path, pattern]
