"""Which of many windows of words are like a sentence: the four ratios of ``fuzzy.best_score`` against a threshold, a start a lane.

A bit-parallel common subsequence takes one character of every lane a step. The
state after a step has the common subsequences with all prefixes of the
pattern, so a run from a window's start serves every length, and runs from both
sides serve the windows over the edges.
"""

from __future__ import annotations

import numpy as np

#: Starts that a table has, entries of a step's states, and pairs of windows compared at once.
_STARTS, _ENTRIES, _PAIRS = 256, 1 << 21, 4096
#: Windows whose words are compared at once, and tables that are kept.
_AT_ONCE, _TABLES = 512, 4
#: Characters that a sentence and a window may have, so that a table is some 70 MB at most.
_SENTENCE, _WINDOW = 512, 4096
_ONE = np.uint64(1)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Pattern:
    """A string's characters as bits of 64-bit words."""

    def __init__(self, text: str):
        self.n = len(text)
        self.words = (self.n + 63) // 64
        points = _points(text)
        self.keys = np.unique(points)
        bits = np.zeros((len(self.keys) + 1, self.words * 64), bool)  # the last row is for characters that the pattern lacks
        bits[np.searchsorted(self.keys, points), np.arange(self.n)] = True
        self.bits = bits
        self.masks = self._packed(bits)
        self.full = self._packed((np.arange(self.words * 64) < self.n)[None])[:, 0]

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        """(words, rows) from rows of bits, the lowest first."""
        return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").view("<u8").T)

    def codes(self, text: str) -> np.ndarray:
        """Rows of the masks for a text's characters."""
        points = _points(text)
        at = np.minimum(np.searchsorted(self.keys, points), len(self.keys) - 1)
        return np.where(self.keys[at] == points, at, len(self.keys))

    def shifted(self, least: int) -> np.ndarray:
        """(place, rows, words): masks of the pattern without its first characters, for the first places."""
        wide = np.pad(self.bits, ((0, 0), (0, least)))
        return np.stack([self._packed(np.ascontiguousarray(wide[:, p : p + self.words * 64])).T for p in range(least)])

    def of(self, codes: np.ndarray) -> np.ndarray:
        """(steps, words, lanes) masks of (steps, lanes) rows."""
        return np.stack([m[codes] for m in self.masks], axis=1)


def _run(masks: np.ndarray, row: np.ndarray, keep: bool = False) -> np.ndarray:
    """State behind the last of the steps' (words, lanes) masks, or behind each: bits of pattern characters that add nothing."""
    steps, words, lanes = masks.shape
    kept = np.empty(masks.shape, np.uint64) if keep else None
    hit, total, over, more = np.empty_like(row), np.empty_like(row), np.empty(row.shape, bool), np.empty(lanes, bool)
    for j in range(steps):
        np.bitwise_and(row, masks[j], out=hit)
        np.add(row, hit, out=total)
        if words > 1:
            np.less(total, hit, out=over)
            for k in range(1, words):
                total[k] += over[k - 1]
                if k < words - 1:  # a carry that meets a full word goes on
                    np.less(total[k], over[k - 1], out=more)
                    np.logical_or(over[k], more, out=over[k])
        np.bitwise_xor(row, hit, out=hit)
        row = np.bitwise_or(hit, total, out=row if kept is None else kept[j])
    return row if kept is None else kept


def _runs(lanes: list[tuple[_Pattern, np.ndarray]], keep: bool = False) -> list[np.ndarray]:
    """States of lanes of several patterns that take their steps together; steps without masks change nothing."""
    ends = np.cumsum([0, *(m.shape[2] for _, m in lanes)]).tolist()
    masks = np.zeros((max(m.shape[0] for _, m in lanes), max(p.words for p, _ in lanes), ends[-1]), np.uint64)
    row = np.zeros(masks.shape[1:], np.uint64)
    for (p, m), a, b in zip(lanes, ends, ends[1:]):
        masks[: len(m), : p.words, a:b] = m
        row[: p.words, a:b] = p.full[:, None]
    out = _run(masks, row, keep)
    return [out[: len(m), : p.words, a:b] if keep else out[: p.words, a:b] for (p, m), a, b in zip(lanes, ends, ends[1:])]


def _common(states: np.ndarray, full: np.ndarray, n: int) -> np.ndarray:
    """Lengths of common subsequences from states whose second last axis is the words."""
    return n - np.bitwise_count(states & full[:, None]).sum(axis=-2, dtype=np.int32)


class _Table:
    """A pattern against the windows that begin at the words of a stretch; windows count as like it by ratio or partial ratio."""

    def __init__(self, pattern: str, texts: list[str], sep: str, starts: int, longest: int, enough: int):
        self.a, self.back, self.t, self.starts = _Pattern(pattern), _Pattern(pattern[::-1]), enough, starts
        text = sep.join(texts)
        sizes = np.array([len(x) for x in texts])
        self.total = len(text)
        self.ends = np.cumsum(sizes + len(sep)) - len(sep)
        self.begins = self.ends - sizes
        p, n = self.a, self.a.n
        here = self.begins[:starts]
        last = self.ends[np.minimum(np.arange(starts) + longest, len(texts)) - 1]
        self.steps = max(n, int((last - here).max()))
        self.codes = np.concatenate([p.codes(text), np.full(max(n, int(here[-1]) + self.steps - len(text)), len(p.keys))])

    def edges(self) -> list[tuple[_Pattern, np.ndarray]]:
        """Lanes from every start on, to the longest window's end, and from every end back, as far as the pattern is long."""
        n = self.a.n
        before = np.concatenate([np.full(n, len(self.a.keys)), self.codes])
        return [(self.a, self.a.of(self.codes[np.arange(self.steps)[:, None] + self.begins[: self.starts]])), (self.back, self.back.of(before[np.arange(n - 1, -1, -1)[:, None] + self.ends]))]

    def whole(self) -> tuple[_Pattern, np.ndarray]:
        """Lanes of windows of the pattern's length at every character."""
        lanes = max(0, self.total - self.a.n + 1)
        mine = np.ascontiguousarray(self.a.masks[:, self.codes[: lanes + self.a.n - 1]])
        return self.a, np.lib.stride_tricks.sliding_window_view(mine, lanes, axis=1).swapaxes(0, 1)[: self.a.n]

    def settle(self, fore: np.ndarray, aft: np.ndarray, whole: np.ndarray) -> None:
        """Takes the states of the lanes."""
        n, t = self.a.n, self.t
        self.fore, self.aft = fore, aft
        self.common = np.vstack([np.zeros((1, self.starts), np.int32), _common(fore, self.a.full, n)])
        sums = n + 1 + np.arange(n)[:, None]
        self.first = (200 * self.common[1 : n + 1] >= t * sums).any(axis=0)
        self.final = (200 * _common(aft, self.back.full, n) >= t * sums).any(axis=0)
        inside = np.zeros(self.total + 2, np.int64)
        inside[1 : whole.shape[1] + 1] = 200 * _common(whole, self.a.full, n) >= t * 2 * n
        self.inside = np.cumsum(inside)

    def like(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Of windows of so many words from so many starts on."""
        n, t, j = self.a.n, self.t, i + k - 1
        begin, end = self.begins[i], self.ends[j]
        m = end - begin
        common = self.common[m, i]
        out = 200 * common >= t * (n + m)
        wide = ~out & (m >= n) & (200 * np.minimum(common, n) >= t * n)
        w = np.flatnonzero(wide)
        if len(w):
            out[w] = self.first[i[w]] | self.final[j[w]] | (self.inside[end[w] - n + 1] > self.inside[begin[w]])
        small = np.flatnonzero(~out & (m < n) & (200 * common >= t * (m + common)) & (common > 0))
        for at in range(0, len(small), _AT_ONCE * 2):
            s = small[at : at + _AT_ONCE * 2]
            out[s] = self._short(i[s], j[s], m[s])
        return out

    def _short(self, i: np.ndarray, j: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Windows shorter than the pattern: against its windows, those over its edges included."""
        n, t = self.a.n, self.t
        zeros = []
        for states, lane in ((self.fore, i), (self.aft, j)):
            bits = np.unpackbits(np.ascontiguousarray(states[m - 1, :, lane]).astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")[:, :n]
            zeros.append(np.cumsum(1 - bits.astype(np.int16), axis=1, dtype=np.int16))  # common with each prefix, or suffix
        size = np.arange(1, n + 1)
        fits = size <= m[:, None]
        need = t * (m[:, None] + size)
        out = ((200 * zeros[0].astype(np.int32) >= need) & fits).any(axis=1) | ((200 * zeros[1].astype(np.int32) >= need) & fits).any(axis=1)
        # a window of the pattern has no more in common than the pattern up to its end, or from its begin on
        place = np.arange(n)
        upto = np.take_along_axis(zeros[0], np.minimum(place + m[:, None] - 1, n - 1), axis=1)
        bound = np.minimum(upto, zeros[1][:, ::-1]).astype(np.int32)
        row, p = np.nonzero((200 * bound >= t * 2 * m[:, None]) & (place <= n - m[:, None]) & ~out[:, None])
        if not len(row):
            return out
        lanes, which = np.unique(p * self.starts + i[row], return_inverse=True)
        most = int(m[row].max())
        masks = self.a.shifted(int(p.max()) + 1)
        step = max(1, min(_PAIRS, _ENTRIES // (most * self.a.words)))
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(0, len(lanes) + step, step))
        for b, (x, y) in enumerate(zip(cuts, cuts[1:])):
            mine = lanes[b * step : (b + 1) * step]
            if not len(mine):
                continue
            shift, begin = mine // self.starts, self.begins[mine % self.starts]
            states = _runs([(self.a, masks[shift, self.codes[np.arange(most)[:, None] + begin]].swapaxes(1, 2))], True)[0]
            pairs = order[x:y]
            size = m[row[pairs]]
            got = states[size - 1, :, which[pairs] - b * step]
            low = np.clip(size[:, None] - 64 * np.arange(self.a.words), 0, 64)
            got &= np.where(low == 64, ~np.uint64(0), (_ONE << np.minimum(low, 63).astype(np.uint64)) - _ONE)
            found = size - np.bitwise_count(got).sum(axis=1, dtype=np.int64)
            out[row[pairs[200 * found >= t * 2 * size]]] = True
        return out


class Windows:
    """Windows of words against a sentence; ``text`` and ``bare`` are the words as they are and compact, ``base`` where the windows begin, mostly."""

    def __init__(self, norm: str, compact: str, text: list[str], bare: list[str], enough: int, longest: int, base: int = 0):
        self.norm, self.compact, self.text, self.bare, self.enough, self.longest, self.base = norm, compact, text, bare, enough, longest, base
        self.tokens = norm.split()
        self.sorted = _Pattern(" ".join(sorted(self.tokens)))
        once = sorted(set(self.tokens))
        self.once = _Pattern(" ".join(once))
        self.places, at = {}, 0
        for w in once:
            self.places[w] = at
            at += len(w) + 1
        self._tables: dict[int, list[_Table]] = {}

    @staticmethod
    def fit(norm: str, compact: str, longest: int, widest: int) -> bool:
        """Whether tables are small enough for a sentence and windows of so many words of so many characters; there has to be something to compare."""
        return bool(compact) and len(norm) <= _SENTENCE and longest * (widest + 1) <= _WINDOW

    def _like(self, i: np.ndarray, k: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        stretch = (i - self.base) // _STARTS
        for c in np.unique(stretch).tolist():
            mine = np.flatnonzero(stretch == c)
            lo = max(0, self.base + c * _STARTS)
            if c not in self._tables:
                starts = min(self.base + (c + 1) * _STARTS, len(self.text)) - lo
                hi = lo + starts + self.longest
                if len(self._tables) == _TABLES:
                    self._tables.pop(next(iter(self._tables)))
                tables = [_Table(a, w[lo:hi], sep, starts, self.longest, self.enough) for a, w, sep in ((self.norm, self.text, " "), (self.compact, self.bare, ""))]
                edges, whole = _runs([lane for x in tables for lane in x.edges()], True), _runs([x.whole() for x in tables])
                for n, x in enumerate(tables):
                    x.settle(*edges[2 * n : 2 * n + 2], whole[n])
                self._tables[c] = tables
            for table in self._tables[c]:
                rest = mine[~out[mine]]
                if len(rest):
                    out[rest] |= table.like(i[rest] - lo, k[rest])
        return out

    def _by_words(self, windows: list[tuple[int, int]]) -> np.ndarray:
        """Which are like the sentence by their sorted words, or by the words that both have and those that one has."""
        t, a = self.enough, set(self.tokens)
        out = np.zeros(len(windows), bool)
        whole, parts, sizes, keeps = [], [], [], []
        mine: list[int] = []
        for n, (i, k) in enumerate(windows):
            w = sorted(" ".join(self.text[i : i + k]).split())
            whole.append(" ".join(w))
            b = set(w)
            if not b:
                continue
            both, only_a, only_b = a & b, a - b, b - a
            if both and (not only_a or not only_b):
                out[n] = True
                continue
            same = sum(map(len, both)) + len(both)  # with a space behind each
            left, right = sum(map(len, only_a)) + len(only_a) - 1, sum(map(len, only_b)) + len(only_b) - 1
            if both and 200 * (same - 1) >= t * (2 * same - 1 + min(left, right)):
                out[n] = True
            elif 200 * (same + min(left, right)) >= t * (size := 2 * same + left + right):
                mine.append(n)
                parts.append(" ".join(sorted(only_b)))
                sizes.append((same, size))
                keeps.append(only_a)
        kept = np.zeros((len(mine), self.once.words * 64), bool)
        for r, only in enumerate(keeps):
            first = min(self.places[w] for w in only)
            for w in only:
                at = self.places[w]
                kept[r, at - (at > first) : at + len(w)] = True
        lanes = [(self.sorted, self._against(self.sorted, whole))]
        if mine:
            lanes.append((self.once, self._against(self.once, parts) & _Pattern._packed(kept)))
        states = _runs(lanes)
        out |= 200 * _common(states[0], self.sorted.full, self.sorted.n) >= t * (self.sorted.n + np.array([len(y) for y in whole]))
        if mine:
            same, size = np.array(sizes).T
            out[mine] |= 200 * (same + _common(states[1], self.once.full, self.once.n)) >= t * size
        return out

    @staticmethod
    def _against(p: _Pattern, others: list[str]) -> np.ndarray:
        """A lane for each of the others."""
        sizes = np.array([len(y) for y in others])
        codes = np.full((len(others), int(sizes.max())), len(p.keys))
        codes[np.arange(codes.shape[1]) < sizes[:, None]] = p.codes("".join(others))
        return p.of(codes.T)

    def first(self, windows: list[tuple[int, int]]) -> int:
        """How many windows, of (start, words), come before the first that is like the sentence."""
        i, k = np.array(windows).T
        like = self._like(i, k)
        upto = int(like.argmax()) if like.any() else len(windows)
        for at in range(0, upto, _AT_ONCE):
            words = self._by_words(windows[at : min(upto, at + _AT_ONCE)])
            if words.any():
                return at + int(words.argmax())
        return upto
