"""Monotonic fuzzy alignment of sentences to timed words, one document at a time."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice, repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import best_score
from ..functions.sequences import _words, transliterate, weighted_durations
from ..functions.windows import Windows

#: Windows of a sentence that are scored one by one before many are at once, and how many are then, the first time and later.
_SINGLY, _TOGETHER = 8, (256, 2048)
_ODD = str.maketrans("", "", "".join(c for c in map(chr, range(128)) if not c.isalnum()))


def _compact(text: str) -> str:
    return transliterate(text).lower().translate(_ODD).replace(" ", "")


@lru_cache(maxsize=1 << 14)
def _spelt(word: str) -> tuple[str, str]:
    """A word as it is compared, and compact."""
    text = " ".join(_words(word))
    return text, _compact(text)


@dataclass
class Options:
    """Scores that are enough, the shortest match, and bounds of the search."""

    least_score: int = 75
    aggressive_score: int = 62
    least_ms: int = 200
    extra_words: int = 6
    checks: int = 4000
    checks_per_word: int = 20


@dataclass
class Aligner:
    """Walks through the words once: each sentence takes the first window that scores enough, from the cursor on.

    Words may come later. What a sentence that waits for them has been compared with is kept, so that
    a window is scored once however often the sentence is looked for. The first
    windows are scored one by one, as most sentences are among them; the others
    are compared with the threshold many at once.
    """

    words: list[tuple[str, float, float]]
    options: Options = field(default_factory=Options)
    cursor: int = 0
    last_end: int = -1

    def __post_init__(self) -> None:
        self.text: list[str] = []
        self.bare: list[str] = []
        self.places: dict[str, list[int]] = {}
        self._widest = 0
        self._prepare()
        self._forget()

    def _prepare(self) -> None:
        for i in range(len(self.text), len(self.words)):
            text, bare = _spelt(self.words[i][0])
            self.text.append(text)
            self._widest = max(self._widest, len(text))
            self.bare.append(bare)
            self.places.setdefault(bare, []).append(i)

    def _forget(self) -> None:
        #: what is being looked for; by length, how many windows scored too little; scores by place and length
        self._waiting: tuple[str, bool] | None = None
        self._failed: dict[int, int] = {}
        self._scored: dict[tuple[int, int], int] = {}
        self._base = self.cursor  # where the first window begins that may not have been scored

    def extend(self, words: list[tuple[str, float, float]]) -> None:
        self.words += words
        self._prepare()

    def skip(self, cursor: int) -> None:
        """The cursor moves without a match."""
        self.cursor = cursor
        self._forget()

    def _lengths(self, n: int, aggressive: bool) -> list[list[int]]:
        """Window lengths to try, a list for each widening."""
        o = self.options
        most = n + max(o.extra_words, int(n * (0.6 if aggressive else 0.2)))
        out = []
        for wide in (0.6, 0.8, 1.0, 1.3, 1.6, 2.0, 2.5) if aggressive else (1.0, 1.3, 1.6, 2.0):
            each = [max(1, int(k * wide)) for k in (n, max(1, int(n * 0.8)), max(1, int(n * 1.2)))]
            out.append([k for k in dict.fromkeys(each) if k <= min(most, len(self.words) - self.cursor)])
        return out

    def _score(self, norm: str, bare: str, at: int, k: int, enough: int, stop: int = 101, worth: int = 0) -> int:
        score = best_score(norm, " ".join(self.text[at : at + k]), stop, enough, worth)
        if score < enough and bare and (other := "".join(self.bare[at : at + k])):
            score = max(score, best_score(bare, other, stop, enough, worth))
        return score

    def _end(self, tokens: list[str], at: int, k: int) -> int:
        """End of the window after its last word that the sentence has, two or three joined on either side if need be."""
        mine, theirs = [_spelt(t)[1] for t in tokens], self.bare[at : at + k]
        i = j = 0
        last = None
        while i < len(mine) and j < len(theirs):
            step = next(
                (
                    (a, b)
                    for a, b in ((1, 1), (2, 1), (3, 1), (1, 2), (1, 3))
                    if i + a <= len(mine) and j + b <= len(theirs) and mine[i] and "".join(mine[i : i + a]) == "".join(theirs[j : j + b])
                ),
                None,
            )
            if step:
                i, j = i + step[0], j + step[1]
                last = j
            else:
                j += 1
        return at + (k if last is None else last)

    def match(self, text: str, aggressive: bool = False) -> tuple[int, int] | None:
        """Start and end in milliseconds, later than all before; the cursor moves behind the match."""
        o = self.options
        norm = " ".join(transliterate(text).lower().split())
        tokens, bare = _words(text), _compact(text)
        enough = o.aggressive_score if aggressive else o.least_score
        left = max(o.checks, o.checks_per_word * max(0, len(self.words) - self.cursor), 200_000 if aggressive else 0)
        last = _compact(tokens[-1]) if tokens else ""
        if self._waiting != (text, aggressive):
            self._forget()
            self._waiting = (text, aggressive)
        ends = self.places.get(last, []) if len(tokens) >= 8 and len(last) >= 3 else []
        first = bisect_left(ends, self.cursor)
        widths = self._lengths(max(1, len(tokens)), aggressive)
        longest = max((k for lengths in widths for k in lengths), default=0)
        stride = 10 if aggressive else 6
        singly = _SINGLY if norm and Windows.fit(norm, bare, longest, self._widest) else None
        low: set[tuple[int, int]] = set()  # windows that score too little, beside those in _scored
        ahead: Iterator[list[tuple[int, int]]] | None = None

        def in_order() -> Iterator[tuple[int, int]]:
            """Windows in the order in which they are looked at, but for those that ended the same way before."""
            for lengths in widths:
                yield from ((tail - k + 1, k) for tail in islice(ends, first, None) for k in lengths if tail - k + 1 >= self.cursor)
                for k in lengths:
                    each = range(self.cursor, len(self.words) - k + 1, max(1, k // stride))
                    yield from zip(each[self._failed.get(k, 0) :], repeat(k))

        def many() -> Iterator[list[tuple[int, int]]]:
            """Windows that come before the first that scores enough, stretch by stretch."""
            windows = Windows(norm, bare, self.text, self.bare, enough, longest, max(self.cursor, self._base))
            todo = (w for w in in_order() if w not in self._scored and w not in low)
            size = _TOGETHER[0]
            while some := list(dict.fromkeys(islice(todo, size))):
                yield some[: (failed := windows.first(some))]
                if failed < len(some):
                    return
                size = _TOGETHER[1]

        def fails(window: tuple[int, int]) -> bool:
            """Whether the window is known to score too little, once those that are scored singly are used up."""
            nonlocal singly, ahead
            if window in low:
                return True
            if singly is None:
                return False
            singly -= 1
            if singly >= 0:
                return False
            ahead = ahead or many()
            low.update(next(ahead, ()))
            return window in low

        for lengths in widths:
            for tail in islice(ends, first, None):  # windows that end with the sentence's last word: the best of the lengths
                starts = [(tail - k + 1, k) for k in lengths if tail - k + 1 >= self.cursor][: max(0, left)]
                left -= len(starts)
                best, place = enough - 1, None
                for i, k in starts:
                    if (i, k) not in self._scored:
                        found = 0 if fails((i, k)) else self._score(norm, bare, i, k, enough, worth=best + 1)
                        if found < enough:  # else the window is taken, or a better one of the same place
                            self._scored[i, k] = found
                    else:
                        found = self._scored[i, k]
                    if found > best:
                        best, place = found, (i, k)
                    if best >= 100:
                        break
                if place:
                    return self._take(tokens, *place)
            for k in lengths:
                each = range(self.cursor, len(self.words) - k + 1, max(1, k // stride))
                known = min(self._failed.get(k, 0), len(each))
                if known > left + 1:
                    return None
                left -= known
                for n in range(known, len(each)):
                    if left < 0:
                        self._failed[k] = n
                        return None
                    left -= 1
                    i = each[n]
                    if (i, k) in self._scored or fails((i, k)):
                        continue
                    if self._score(norm, bare, i, k, enough, enough) >= enough:
                        return self._take(tokens, i, k)
                    low.add((i, k))
                self._failed[k] = len(each)
        self._base = max(self.cursor, len(self.words) - longest)
        return None

    def _take(self, tokens: list[str], at: int, k: int) -> tuple[int, int]:
        end = self._end(tokens, at, k)
        start = max(round(self.words[at][1] * 1000), self.last_end + 1)
        stop = max(round(self.words[end - 1][2] * 1000), start)
        if stop - start < self.options.least_ms:
            stop = start + self.options.least_ms
        self.skip(end)
        self.last_end = stop
        return start, stop


def align(sentences: list[str | None], words: list[tuple[str, float, float]], options: Options | None = None, recover: int = 0) -> list[tuple[int | None, int | None]]:
    """Times of the sentences in order; null for placeholders (null texts) and from the first that nothing matches.

    With ``recover`` > 0 such a sentence is looked for among the next ones
    with the lower score; the gap up to the one found is filled by weight.
    """
    a = Aligner(words, options or Options())
    out: list[tuple[int | None, int | None]] = []
    i = 0
    while i < len(sentences):
        text = sentences[i]
        if text is None:
            out.append((None, None))
            i += 1
            continue
        found = a.match(text)
        if found:
            out.append(found)
            i += 1
            continue
        before = a.last_end
        for k in range(i + 1, min(len(sentences), i + 1 + recover)):
            if sentences[k] is not None and (found := a.match(sentences[k], aggressive=True)):
                out += spread(sentences[i:k], before + 1, found[0], a.options.least_ms)
                out.append(found)
                i = k + 1
                break
        else:
            return out + [(None, None)] * (len(sentences) - i)
    return out


def spread(texts: list[str | None], start: int, end: int, least_ms: int = 200) -> list[tuple[int, int]]:
    """Times by weight of characters for texts between two instants; the last one ends at the end."""
    out, at = [], min(start, end)
    for ms in weighted_durations(max(0, end - at), [max(1, len((t or "").strip())) for t in texts], least_ms):
        out.append((at, at + ms))
        at += ms
    if out:
        out[-1] = (out[-1][0], max(end, out[-1][0]))
    return out


def dealt(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Groups dealt to four tasks a core: they are few bytes and much work, and would be put together in a few tasks otherwise."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def align_words(sentences: DataFrame, words: DataFrame, *, recover: int = 0) -> DataFrame:
    """(doc_id, idx, start_ms, end_ms) from sentences (doc_id, idx, text) and words (doc_id, pos, text, start_s, end_s).

    Documents are aligned in parallel; the words of one document have to fit
    in a task, as its alignment is a walk through them.
    """

    def run(s: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        s, w = s.sort_values("idx"), w.sort_values("pos")
        found = align([None if pd.isna(t) else t for t in s.text], list(zip(w.text, w.start_s, w.end_s, strict=True)), recover=recover)
        return pd.DataFrame({"doc_id": s.doc_id.to_numpy(), "idx": s.idx.to_numpy(), "start_ms": pd.array([a for a, _ in found], "Int64"), "end_ms": pd.array([b for _, b in found], "Int64")})

    return dealt(sentences).groupBy("doc_id").cogroup(dealt(words).groupBy("doc_id")).applyInPandas(run, "doc_id long, idx int, start_ms long, end_ms long")


def timed_words(docs: DataFrame, *, most: int | None = None) -> DataFrame:
    """Words of a text with made-up times of 0.4 s each, to try alignment on: (doc_id, pos, text, start_s, end_s)."""
    each = docs.select("doc_id", F.posexplode(F.filter(F.split("text", r"\s+", -1), lambda x: x != "")).alias("pos", "text"))
    each = each if most is None else each.where(F.col("pos") < most)
    return each.select("doc_id", "pos", "text", (F.col("pos") * 0.4).alias("start_s"), (F.col("pos") * 0.4 + 0.35).alias("end_s"))


def map_orders(sentences: list[list[str]], parts: list[tuple[object, list[str]]], most_seek: int = 5000) -> list[object]:
    """The order of the parts that each sentence's words lie in, by exact match of the words from a cursor on.

    Among several orders the commonest, the first seen on a tie; null where
    the words are not found within ``most_seek`` places.
    """
    words = [(w, order) for order, ws in parts for w in ws]
    at, out = 0, []
    for s in sentences:
        stop = min(len(words) - len(s), at + most_seek)
        hit = next((i for i in range(at, stop + 1) if s and all(words[i + k][0] == w for k, w in enumerate(s))), None)
        if hit is None:
            out.append(None)
            continue
        orders = [o for _, o in words[hit : hit + len(s)] if o is not None]
        out.append(max(dict.fromkeys(orders), key=orders.count) if orders else None)
        at = hit + len(s)
    return out
