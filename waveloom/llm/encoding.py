"""Exact encoding of whole texts with a tokenizers file, each distinct piece of text only once.

A byte-level BPE tokenizer first cuts a text by a fixed pattern and never merges over those cuts. Where
such a cut is certain from the neighbouring bytes alone (a single space, a single line feed or a mark
of punctuation after a letter), the text is cut here as well, the pieces are hashed as whole arrays,
and only pieces not met before go to the library. The ids are those of encode() on the whole text.
Other kinds of tokenizer get whole texts.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from .textbytes import span_hashes, text_bytes

_B = np.arange(256)
_NEXT_SURE = ((_B >= 0x21) & (_B <= 0x7E)) | ((_B >= 0xC3) & (_B <= 0xDF))
_ASCII_SURE = (_B >= 0x21) & (_B <= 0x7E)
_CONT = (_B >= 0x80) & (_B < 0xC0)
_LEAD2 = (_B >= 0xC3) & (_B <= 0xDF)
_LETTER = ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122))
#: Pieces handled at once, and the most places and ids a worker's cache grows to (16 and 4 bytes each).
PIECES, CACHE_PLACES, CACHE_IDS = 1 << 17, 1 << 20, 1 << 21
_MARK = _ASCII_SURE & ~_LETTER & ~((_B >= 48) & (_B <= 57)) & (_B != 39)


def _byte_length(token: str, added: bool) -> int:
    return len(token.encode()) if added else len(token)  # a byte-level token has one character for each byte


class Encoder:
    """ids of texts, and the bytes that each id stands for. One per Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.pieces = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.added = [t.encode() for t in added]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_vocabulary = max(vocabulary.values()) + 1
        self.token_bytes = np.zeros(self.n_vocabulary, np.int64)
        for t, i in vocabulary.items():
            self.token_bytes[i] = _byte_length(t, t in added)
        self._forget()

    def _forget(self) -> None:
        """An empty cache: an open-addressed table whose free places have hash 0, and a pool of ids. Both grow up to
        CACHE_PLACES and CACHE_IDS and are then forgotten as a whole, so a worker never holds more than some 30 MB of them."""
        self.n_known = self.n_pool = 0
        self.pool = np.zeros(1 << 18, np.int32)
        self._room(1 << 17)

    def _room(self, size: int) -> None:
        self.known, self.at, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.zeros(size, np.int32)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether it is known there."""
        last = np.uint64(len(self.known) - 1)
        place = (h & last).astype(np.int64)
        there = self.known[place]
        hit = there == h
        open_ = np.flatnonzero(~hit & (there != 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & int(last)
            there = self.known[place[open_]]
            hit[open_] = there == h[open_]
            open_ = open_[~hit[open_] & (there != 0)]
        return place, hit

    def _put(self, h: np.ndarray, at: np.ndarray, length: np.ndarray) -> None:
        """Add hashes that are not yet known, each once; two that want one place take turns."""
        need = 2 * (self.n_known + len(h))
        if need > len(self.known):
            full = self.known != 0
            old = self.known[full], self.at[full], self.length[full]
            self._room(1 << int(need).bit_length())
            self.n_known = 0
            self._put(*old)
        self.n_known += len(h)
        while len(h):
            place, _ = self._find(h)
            self.known[place] = h
            won = self.known[place] == h
            self.at[place[won]], self.length[place[won]] = at[won], length[won]
            h, at, length = h[~won], at[~won], length[~won]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each has. A null has none."""
        buf, off = text_bytes(col)
        n = len(off) - 1
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        whole = buf.tobytes()
        if not self.pieces:
            got = self._plain([whole[off[i] : off[i + 1]].decode() for i in range(n)])
            return np.concatenate(got), np.array([len(g) for g in got], np.int64)
        special = [i for i in range(n) if any(a in whole[off[i] : off[i + 1]] for a in self.added)] if any(a in whole for a in self.added) else []
        s = self._all_cuts(buf, off, special)
        parts = [self._ids(buf, s[i : i + PIECES + 1], len(buf)) for i in range(0, len(s), PIECES)]
        ids, lengths = (np.concatenate([p[k] for p in parts]) if len(parts) > 1 else parts[0][k] for k in (0, 1))
        before = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(before[np.searchsorted(s, off)])  # a text begins with a piece, or is empty

    def _ids(self, buf: np.ndarray, s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that begin at s, at most PIECES (one more start ends the last), and how many each has."""
        if len(s) > PIECES:
            s, n = s[:-1], int(s[-1])
        low = int(s[0])
        part, s = buf[low:n], s - low
        e = np.append(s[1:], len(part))
        h = span_hashes(part, s, e)
        h[h == 0] = 1
        if self.n_pool > CACHE_IDS or 2 * (self.n_known + len(s)) > CACHE_PLACES:
            self._forget()
        place, hit = self._find(h)
        if not hit.all():
            miss = np.flatnonzero(~hit)
            u, first = np.unique(h[miss], return_index=True)
            self._learn(part.tobytes(), u, s[miss[first]], e[miss[first]])
            place, _ = self._find(h)
        lengths = self.length[place].astype(np.int64)
        ends = np.cumsum(lengths)
        return self.pool[np.arange(ends[-1]) + np.repeat(self.at[place] - (ends - lengths), lengths)], lengths

    @classmethod
    def _all_cuts(cls, buf: np.ndarray, off: np.ndarray, special: list[int], run: int = 4_000_000) -> np.ndarray:
        """_cuts over runs of bytes, each with some more on both sides, so a very long text takes no more room."""
        if len(buf) <= run:
            return cls._cuts(buf, off, special)
        out = []
        for a in range(0, len(buf), run):
            b, lo, hi = min(a + run, len(buf)), max(0, a - 4), min(len(buf), a + run + 4)
            i, j = np.searchsorted(off, lo, side="right") - 1, np.searchsorted(off, hi)
            near = np.clip(off[i : j + 1], lo, hi) - lo
            cut = cls._cuts(buf[lo:hi], near, [k - i for k in special if i <= k < j]) + lo
            out.append(cut[(cut >= a) & (cut < b) & ((cut > lo) | (lo == 0))])
        return np.concatenate(out)

    @staticmethod
    def _cuts(buf: np.ndarray, off: np.ndarray, special: list[int]) -> np.ndarray:
        n = len(buf)
        before = np.zeros(n, bool)  # the character that ends just before this byte is surely not white space
        before[1:] = _ASCII_SURE[buf[:-1]]
        before[2:] |= _CONT[buf[1:-1]] & _LEAD2[buf[:-2]]
        after = np.zeros(n, bool)  # so is the one that begins just after it
        after[:-1] = _NEXT_SURE[buf[1:]]
        starts = off[:-1][off[:-1] < off[1:]]
        before[starts] = False
        after[starts[1:] - 1] = False
        alone = before & after
        cut = alone & ((buf == 32) | (buf == 10))
        cut[1:] |= (alone & (buf == 10))[:-1]
        mark = np.zeros(n, bool)
        mark[1:] = _LETTER[buf[:-1]] & _MARK[buf[1:]]
        cut |= mark & before
        for i in special:  # an added token may hold such places: such a text stays whole
            cut[off[i] : off[i + 1]] = False
        cut[starts] = True
        return np.flatnonzero(cut)

    def _learn(self, whole: bytes, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        """Encode new pieces. Those that begin with a space go to the library in runs, since no token
        crosses such a beginning; the bytes of the ids tell the pieces apart again."""
        pieces = [whole[a:b] for a, b in zip(s.tolist(), e.tolist())]
        run = np.array([p[:1] == b" " and p[1:2] != b" " and p[-1:] > b" " for p in pieces], bool)
        texts, members = [], []
        for i in range(0, int(run.sum()), 96):
            part = np.flatnonzero(run)[i : i + 96]
            texts.append(b"".join(pieces[j] for j in part).decode())
            members.append(part)
        lone = np.flatnonzero(~run)
        texts += [pieces[j].decode() for j in lone]
        members += [lone[i : i + 1] for i in range(len(lone))]
        got = self._plain(texts)
        ids = np.concatenate(got)
        order = np.concatenate(members)
        ends = np.cumsum(self.token_bytes[ids])
        want = np.cumsum((e - s)[order])
        last = np.searchsorted(ends, want)
        if not (np.array_equal(ends[np.minimum(last, len(ends) - 1)], want)):
            raise ValueError("token bytes do not add up to the text's bytes")
        stop = last + 1
        start = np.concatenate([[0], stop[:-1]])
        self._put(h[order], (start + self.n_pool).astype(np.int32), (stop - start).astype(np.int32))
        if self.n_pool + len(ids) > len(self.pool):
            more = np.zeros(max(2 * len(self.pool), self.n_pool + len(ids)), np.int32)
            more[: self.n_pool] = self.pool[: self.n_pool]
            self.pool = more
        self.pool[self.n_pool : self.n_pool + len(ids)] = ids
        self.n_pool += len(ids)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
