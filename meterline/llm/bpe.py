"""Byte-pair encodings of many words at once by dynamic programming over their prefixes.

A sequence of tokens is an encoding exactly if each neighbouring pair encodes to itself, so every prefix of a word has
one last token that fits the encoding before it. All words of a batch advance together: step i settles the prefixes of
length i. Candidates come from substring hashes looked up among the sorted hashes of the pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from meterline.llm.common import Rolling, mix64, ragged

TABLE_BITS = 22  # slots of the table of known pairs; a pair that loses its slot is looked up again
SIEVE_BITS = 22
KNOWN_PAIRS = 1 << 19  # entries of the exact store behind it, emptied when full


def symbol_values(symbols: np.ndarray) -> np.ndarray:
    return mix64(symbols.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x632BE59BD9B4E019))


class PieceSet:
    """Pieces as strings of symbols; rank(left, right) is the priority of a merge, None where there is none.

    A symbol that is no piece stands for itself, with the id len(pieces) + symbol.
    """

    def __init__(self, pieces: list[str | None], rank: Callable[[str, str], float | None]) -> None:
        self.pieces, self.rank = pieces, rank
        texts = [(i, p) for i, p in enumerate(pieces) if p]
        flat = np.array([ord(c) for _, p in texts for c in p], np.int64)
        lengths = np.array([len(p) for _, p in texts], np.int64)
        ends = np.cumsum(lengths)
        rolling = Rolling(symbol_values(flat))
        keys = rolling.of(ends - lengths, ends)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array([i for i, _ in texts], np.int64)[order]
        self.maybe_piece = self._sieve(self.keys)
        self.maybe_prefix = self._sieve(rolling.of(np.repeat(ends - lengths, lengths), np.arange(1, len(flat) + 1)))
        self.longest = int(lengths.max())
        self.slot_key = np.zeros(1 << TABLE_BITS, np.uint64)
        self.slot_ok = np.zeros(1 << TABLE_BITS, bool)
        self.known: dict[int, bool] = {}

    @staticmethod
    def _sieve(keys: np.ndarray) -> np.ndarray:
        """By the upper bits of a hash: False where no such key exists."""
        out = np.zeros(1 << SIEVE_BITS, bool)
        out[keys >> np.uint64(64 - SIEVE_BITS)] = True
        return out

    def find(self, h: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes belong to pieces (their places), and the pieces; sieve: upper bits of the hashes."""
        at = np.flatnonzero(self.maybe_piece[sieve])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        return at[hit], self.ids[k[hit]]

    def text(self, token: int) -> str:
        return self.pieces[token] if token < len(self.pieces) else chr(token - len(self.pieces))

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens is the encoding of its text."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = (mix64(key) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = self.slot_ok[slot]
        miss = np.flatnonzero(self.slot_key[slot] != key + np.uint64(1))
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            ok = np.array([self._fits(int(k)) for k in new], bool)
            at = (mix64(new) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
            self.slot_key[at], self.slot_ok[at] = new + np.uint64(1), ok
            out[miss] = ok[back]
        return out

    def _fits(self, key: int) -> bool:
        ok = self.known.get(key)
        if ok is None:
            a, b = self.text(key >> 32), self.text(key & 0xFFFFFFFF)
            ok = self.rank(a, b) is None and self.encode(a + b) == [a, b]
            if len(self.known) >= KNOWN_PAIRS:
                self.known.clear()
            self.known[key] = ok
        return ok

    def encode(self, word: str) -> list[str]:
        """Plain merging, for pairs of tokens."""
        parts = list(word)
        ranks = [self.rank(a, b) for a, b in zip(parts, parts[1:])]
        while True:
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                return parts
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = self.rank(parts[i], parts[i + 1])
            if i:
                ranks[i - 1] = self.rank(parts[i - 1], parts[i])


class Prefixes:
    """For every word, slots for its prefixes 0..length: token count and last token of the prefix's encoding."""

    def __init__(self, pieces: PieceSet, symbols: np.ndarray, rolling: Rolling, starts: np.ndarray, ends: np.ndarray) -> None:
        lengths = ends - starts
        self.slot = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        self.lengths = lengths
        size = int((lengths + 1).sum())
        self.count = np.zeros(size, np.int64)
        self.last = np.full(size, -1, np.int64)
        self.back = np.zeros(size, np.int64)
        at = ragged(starts, lengths)  # every place of every word
        slot = ragged(self.slot, lengths)
        left = np.repeat(ends, lengths) - at
        offset = slot - np.repeat(self.slot, lengths)
        found: list[tuple[np.ndarray, ...]] = []
        for n in range(1, pieces.longest + 1):
            live = left >= n
            at, slot, left, offset = at[live], slot[live], left[live], offset[live]
            if not len(at):
                break
            h = rolling.of(at, at + n)
            top = (h >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)
            hit, token = pieces.find(h, top)
            if n == 1:
                own = len(pieces.pieces) + symbols[at].astype(np.int64)
                own[hit] = token
                found.append((offset + 1, slot, np.ones(len(at), np.int64), own))
            else:
                found.append((offset[hit] + n, slot[hit], np.full(len(hit), n), token))
            go = pieces.maybe_prefix[top]
            at, slot, left, offset = at[go], slot[go], left[go], offset[go]
        if not found:
            return
        end, slot, n, token = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(end, kind="stable")
        end, slot, n, token = end[order], slot[order], n[order], token[order]
        steps = np.searchsorted(end, np.arange(1, int(end[-1]) + 2))
        for lo, hi in zip(steps, steps[1:]):
            s, step, t = slot[lo:hi], n[lo:hi], token[lo:hi]
            before = self.last[s]
            first = self.back[s] == 0  # nothing before: the start of a word
            ok = first.copy()
            rest = np.flatnonzero(~first)
            ok[rest] = pieces.fits(before[rest], t[rest])
            s, step, t = s[ok], step[ok], t[ok]
            to = s + step
            self.last[to], self.back[to], self.count[to] = t, step, self.count[s] + 1

    def totals(self) -> np.ndarray:
        return self.count[self.slot + self.lengths]

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """All words' tokens end to end, and how many each word has; follows the stored steps back from the ends."""
        totals = self.totals()
        base = np.concatenate([[0], np.cumsum(totals)])[:-1]
        out = np.zeros(int(totals.sum()), np.int64)
        at, base = (self.slot + self.lengths)[totals > 0], base[totals > 0]
        while len(at):
            out[base + self.count[at] - 1] = self.last[at]
            at = at - self.back[at]
            more = self.count[at] > 0
            at, base = at[more], base[more]
        return out, totals


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of one row of each key, and for each row the number of its key."""
    order = np.argsort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts end to end, the place of each one's first byte, and the texts' bounds in code points."""
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    return cps, np.flatnonzero(lead), np.concatenate([[0], np.cumsum(lead)])[off]
