"""Whole texts to token ids with the tokenizers library, with a cache of words.

A byte-pair tokenizer first cuts a text into pieces and then merges inside each
piece, so a piece has the same ids wherever it stands. ``Encoder`` cuts texts only
at spaces and line ends, where the tokenizer's own rule cuts too, sends each new word's
pieces through the library's merges once, and gathers cached ids with numpy. Words are
found in the cache by a hash and then compared byte by byte, so two words of one hash
are told apart. A text with other white space or a special token goes to the library
whole, so ids equal those of ``encode``.
"""

from __future__ import annotations

import gc
import json
import os
import re
from itertools import chain

import numpy as np
import pandas as pd

#: Words that the cache may hold before it starts anew; more than SLICE bytes can have.
#: New words come about as fast as they do in all texts read so far, so a small cache learns the same ones again and again.
CACHE = 1_500_000
#: Bytes of words, and half as many ids, that the cache may hold before it starts anew, so a few million long words don't fill the memory.
HELD = 32_000_000
#: Pieces without letters, and words that only the library can cut, that are remembered.
PIECES = 50_000
#: Bytes that are cut into words at a time.
SLICE = 1_200_000
#: Latin letters, all of class L, stable under NFC and with one lower-case letter each.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: ASCII signs that neither start a contraction nor a special token.
_SIGNS = r"!-&(-/:;=?-@\[-`{}~"
#: A line of letters with one sign at most, of characters whose classes cut it, or of others.
_LINE = re.compile(rf"^(?:([{_LETTERS}]+)([{_SIGNS}]?)|([{_LETTERS}0-9{_SIGNS}]+)|(.+))$", re.M)
#: Pieces of such a word; a word tokenizer takes digits one by one.
_CUT = {"word": re.compile(rf"[{_LETTERS}]+|[0-9]|[{_SIGNS}]+"), "byte": re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+")}
#: Bytes that white space other than spaces and line ends, or a zero byte, begins with.
_SUSPECT = re.compile(rb"[\x00\x09\x0b-\x0d\x1c-\x1f\xc2\xe1-\xe3]")
_ODD = re.compile(r"[^\S \n]|\x00")
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Marks of what stands before a word: 0 the text's start, 1 a space, 2 a line end; 3: the word is a run of white space.
_RUN = 3
#: The first bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _eights(a: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a number; the last seven bytes have none."""
    return np.ndarray((len(a) - 7,), "<u8", a, strides=(1,))


def _spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at, at + 1, ... for the n places of each range."""
    stop = np.cumsum(n)
    return np.repeat(at - stop + n, n) + np.arange(stop[-1] if len(stop) else 0)


class Encoder:
    """Token ids of texts. ``path`` is a tokenizers JSON file; null and empty texts have no ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        self.kind = _kind(conf)
        self.special = [a["content"].encode() for a in conf.get("added_tokens", [])]
        self.merge = self.tok.model.tokenize
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        #: the printable letter that stands for each byte in byte-level vocabularies
        self.letters = str.maketrans({b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)})
        self._restart()

    def _restart(self) -> None:
        #: the hashes of the cached words in order and the slot of each, apart for the latest ones; and how many words there are
        self.known, self.words = [(np.zeros(0, np.uint64), np.zeros(0, np.uint32))] * 2, 0
        self.flat, self.end = np.zeros(1 << 20, np.uint32), 0
        # numbers of 32 bits: places stay below HELD and a slice
        self.at, self.size = np.zeros(CACHE + 1, np.uint32), np.zeros(CACHE + 1, np.uint32)
        #: the bytes of the cached words, and what stands before each
        self.held, self.stop = np.zeros(1 << 22, np.uint8), 0
        self.first, self.length, self.mark = np.zeros(CACHE + 1, np.uint32), np.zeros(CACHE + 1, np.uint32), np.zeros(CACHE + 1, np.uint8)
        self.pieces: dict[str, list[int]] = {}

    def library(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _whole(self, t: bytes) -> bool:
        """Whether only the library's own rules can cut a text."""
        if self.kind == "whole" and t or len(t) > SLICE - 2:
            return True
        return self.kind == "byte" and (any(s in t for s in self.special) or bool(_SUSPECT.search(t)) and bool(_ODD.search(t.decode("utf-8", "replace"))))

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, one after the other; the number of ids of each text) of UTF-8 texts."""
        collects = gc.isenabled()
        gc.disable()  # many small lists are made here, none of them in a cycle
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        own: dict[int, list[int]] = {}
        plain: list[bytes] = []
        for i, t in enumerate(texts):
            t = t or b""
            if self._whole(t):
                own[i] = self.library(t.decode("utf-8", "replace"))
                t = b""
            plain.append(t)
        ids, counts, first = [], [], 0
        while first < len(plain):
            last, n = first, 0
            while last < len(plain) and n + len(plain[last]) + 1 <= SLICE:
                n += len(plain[last]) + 1
                last += 1
            a, c = self._some(plain[first:last])
            ids.append(a)
            counts.append(c)
            first = last
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        if own:
            cut = np.cumsum(count)[:-1] if len(count) else []
            parts = np.split(flat, cut)
            for i, x in own.items():
                parts[i] = np.array(x, np.uint32)
                count[i] = len(x)
            flat = np.concatenate(parts)
        return flat, count

    def _words(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, byte after the last, what stands before) of each word; texts end with a zero or a line end."""
        byte = self.kind == "byte"
        ends = np.flatnonzero((a == 32) | (a == 10) | (a == 0) if byte else (a == 32) | (a == 10))
        starts = np.empty_like(ends)
        starts[0], starts[1:] = 0, ends[:-1] + 1
        mark = np.zeros(len(starts), np.uint8)
        keep = ends > starts
        if byte:
            before = a[starts[1:] - 1]
            mark[1:] = (before == 32) + 2 * (before == 10)
            # white space that no word follows at once is one piece with what stands next to it
            run = np.flatnonzero(~keep & (mark > 0))
            if len(run):
                head = np.append(True, np.diff(run) != 1)
                tail = np.append(head[1:], True)
                ends[run[head]] = starts[run[tail]]
                starts[run[head]] -= 1
                mark[run[head]] = _RUN
                keep[run[head]] = True
        return starts[keep], ends[keep], mark[keep]

    def _some(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = (b"\0" if self.kind == "byte" else b"\n").join([*texts, b""])
        starts, ends, mark = self._words(np.frombuffer(raw, np.uint8))
        raw += bytes(8)
        a = np.frombuffer(raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
        length = ends - starts
        code, unique = pd.factorize(_hashes(a, starts, length, mark))
        slots = self._slots(unique)
        new = np.flatnonzero(slots < 0)
        if len(new) and (self.words + len(new) > CACHE or self.stop + len(raw) > HELD or self.end > HELD // 2):
            self._restart()
            new = np.arange(len(unique))
        if len(new):
            where = np.empty(len(unique), np.int64)
            where[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            where = where[new]
            slots[new] = self._remember(raw, starts[where], ends[where], mark[where], unique[new])
        slot = slots[code]
        n, at = self.size[slot].astype(np.int64), self.at[slot].astype(np.int64)
        other = self._unlike(a, slot, starts, length, mark)
        if not len(other):
            ids = self.flat[_spread(at, n)]
        else:
            more, n[other] = self._learn([raw[s:e] for s, e in zip(starts[other].tolist(), ends[other].tolist())], mark[other])
            at[other] = self.end + np.cumsum(n[other]) - n[other]
            ids = np.concatenate([self.flat[: self.end], more])[_spread(at, n)]
        return ids, np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slots of words by their hashes, or -1."""
        slots, order = np.full(len(keys), -1), np.argsort(keys)
        keys = keys[order]  # the cache is walked in order
        for known, slot in self.known:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                found = known[at] == keys
                slots[order[found]] = slot[at[found]]
        return slots

    def _unlike(self, a: np.ndarray, slot: np.ndarray, starts: np.ndarray, length: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The words that aren't those of their slots, though their hashes are."""
        same = (self.length[slot] == length) & (self.mark[slot] == mark)
        here, there, first = _eights(a), _eights(self.held), self.first[slot]
        rest, k = np.flatnonzero(same), 0
        while len(rest):
            part = _FIRST[np.minimum(length[rest] - k, 8)]
            same[rest[(here[starts[rest] + k] ^ there[first[rest] + k]) & part != 0]] = False
            k += 8
            rest = rest[length[rest] > k]
        return np.flatnonzero(~same)

    def _remember(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, mark: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Slots of new words."""
        words = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        ids, n = self._learn(words, mark)
        at = slice(self.words, self.words + len(keys))
        old, late = self.known
        order = np.argsort(keys)
        late = _inserted(late, keys[order], at.start + order)
        self.known = [_inserted(old, *late), (late[0][:0], late[1][:0])] if 8 * len(late[0]) > len(old[0]) else [old, late]
        self.words = at.stop
        self.size[at], self.at[at] = n, self.end + np.cumsum(n) - n
        self.flat, self.end = _extended(self.flat, self.end, ids)
        length = ends - starts
        self.length[at], self.first[at], self.mark[at] = length, self.stop + np.cumsum(length) - length, mark
        self.held, self.stop = _extended(self.held, self.stop, np.frombuffer(b"".join(words), np.uint8))
        return np.arange(at.start, at.stop)

    def _learn(self, words: list[bytes], marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words with the white space before them, which belongs to a byte-level piece."""
        cut, merged, rest, byte = _CUT[self.kind], self._merged, self._rest, self.kind == "byte"
        found: list[list[int]] = []
        last: list[int] = []
        marks = marks.tolist()
        lines = iter(_LINE.findall(b"\n".join([w for w, m in zip(words, marks) if m != _RUN] if byte else words).decode("utf-8", "replace")))
        for w, m in zip(words, marks):
            if m == _RUN:
                found.append(rest(w.decode()))
                last.append(len(found))
                continue
            letters, sign, mixed, other = next(lines)
            if byte:
                if m == 2:
                    found.append(rest("\n"))
                lead = " " if m == 1 else ""
            else:
                letters, mixed, lead = letters.lower(), mixed.lower(), ""
            if letters:
                found.append(merged(lead + letters))
                if sign:
                    found.append(rest(sign))
            elif mixed:
                for p in cut.findall(lead + mixed):
                    found.append(merged(p) if p[-1].isalpha() else rest(p))
            else:
                found.append(self._other(lead + other))
            last.append(len(found))
        n = np.zeros(len(found) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, found), np.int64, len(found)), out=n[1:])
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n[-1])), np.diff(n[last], prepend=0)

    def _merged(self, piece: str) -> list[int]:
        """Ids of one piece by the library's merges alone."""
        raw = piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.merge(raw)]

    def _rest(self, piece: str) -> list[int]:
        """Ids of a piece without letters; such pieces are often seen."""
        return self._kept(piece, self._merged)

    def _other(self, word: str) -> list[int]:
        """Ids of a word that only the library's own rules can cut."""
        return self._kept("\0" + word, lambda w: self.library(w[1:]))

    def _kept(self, piece: str, make) -> list[int]:
        out = self.pieces.get(piece)
        if out is None:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            out = self.pieces[piece] = make(piece)
        return out


def _hashes(a: np.ndarray, starts: np.ndarray, length: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """A hash of each word with its mark, eight bytes at a time."""
    eights = _eights(a)
    h = length.astype(np.uint64) * np.uint64(4) + mark
    rest, k = np.arange(len(starts)), 0
    while len(rest):
        x = (h[rest] + (eights[starts[rest] + k] & _FIRST[np.minimum(length[rest] - k, 8)])) * _MIX
        h[rest] = x ^ (x >> np.uint64(29))
        k += 8
        rest = rest[length[rest] > k]
    return h


def _inserted(held: tuple[np.ndarray, np.ndarray], keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ordered keys and their values with more of them."""
    place = np.searchsorted(held[0], keys)
    return np.insert(held[0], place, keys), np.insert(held[1], place, values)


def _extended(held: np.ndarray, end: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """An array that holds ``more`` from ``end`` on, and the new end."""
    if end + len(more) > len(held):
        held = np.concatenate([held, np.zeros(max(len(held) // 4, len(more)), held.dtype)])
    held[end : end + len(more)] = more
    return held, end + len(more)


def _kind(conf: dict) -> str:
    """word: white space is dropped between words; byte: byte-level with its own pattern; whole: neither."""
    pre = conf.get("pre_tokenizer") or {}
    norm = conf.get("normalizer")
    plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"]) and not set(a["content"]) & {" ", "\n"} and a["content"].startswith("<") for a in conf.get("added_tokens", []))
    if not plain:
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    steps = pre.get("pretokenizers", [])
    fits = len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    if fits and steps[0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        return "word"
    return "whole"


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python process for a file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and the number of ids of each text, with ``end`` after each text."""
    n = counts + 1
    stop = np.cumsum(n)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint32)
    last = np.zeros(len(out), bool)
    last[stop - 1] = True
    out[last] = end
    out[~last] = ids
    return out, n
