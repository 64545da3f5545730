"""Alignment of a document's sentences to words that come file by file, with recovery behind what nothing matches.

A file is aligned with the words that files before it left unread. Where a
file has a known end among the sentences (its chunk), a sentence that nothing
matches does not stop it: an anchor is looked for among the next sentences
with the lower score, the sentences before it share the gap by their
characters, and without an anchor the rest of the chunk shares the time up to
the file's end.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import Aligner, Options, dealt, spread

#: Sentences among which an anchor is looked for.
LOOKAHEAD = 8
ALIGNED = "doc_id long, idx int, start_ms long, end_ms long, source string, how string"
#: What a file of words is: its place among the document's files, the delivery (a later one replaces an earlier one), and its words.
DELIVERY = "doc_id long, number int, version int, source string, start_ms long, end_ms long, chunk_end int, texts array<string>, starts array<double>, ends array<double>"


@dataclass
class FileOfWords:
    number: int
    version: int
    source: str | None
    start_ms: int | None
    end_ms: int | None
    chunk_end: int | None
    words: list[tuple[str, float, float]]

    @classmethod
    def of(cls, row) -> FileOfWords:
        whole = lambda v: None if pd.isna(v) else int(v)
        given = [list(x) if x is not None else [] for x in (row.texts, row.starts, row.ends)]
        words = list(zip(*given, strict=True))
        start = whole(row.start_ms)
        end = whole(row.end_ms)
        return cls(int(row.number), 0 if pd.isna(row.version) else int(row.version), row.source if isinstance(row.source, str) else None, start, end, whole(row.chunk_end), words)


class Walk:
    """Where the alignment of a document stands: the next sentence, the end of the last one, and the words not read yet."""

    def __init__(self, sentences: list[str | None], next: int = 0, last_end: int = -1, unread: list[tuple[str, float, float]] | None = None, options: Options | None = None, lookahead: int = LOOKAHEAD):
        self.sentences, self.next, self.lookahead = sentences, next, lookahead
        self.options = options or Options()
        self._aligner = Aligner(list(unread or []), self.options, 0, last_end)

    @property
    def last_end(self) -> int:
        return self._aligner.last_end

    @property
    def left(self) -> int:
        """How many words are not read yet."""
        return len(self._aligner.words) - self._aligner.cursor

    @property
    def unread(self) -> list[tuple[str, float, float]]:
        return self._aligner.words[self._aligner.cursor :]

    def feed(self, f: FileOfWords) -> list[tuple[int, int | None, int | None, str]]:
        """(sentence, start, end, how) of what the file settles, in order: match, placeholder, gap, anchor or rest."""
        a = self._aligner
        a.extend(f.words)
        words, left = a.words, self.left
        stop = len(self.sentences) if f.chunk_end is None else min(len(self.sentences), f.chunk_end)
        first = f.start_ms if f.start_ms is not None else round(words[a.cursor][1] * 1000) if left else 0
        end = f.end_ms if f.end_ms is not None else max(first, round(words[-1][2] * 1000) if left else first)
        out: list[tuple[int, int | None, int | None, str]] = []
        while True:
            while self.next < stop:
                text = self.sentences[self.next]
                found = (None, None) if text is None else a.match(text)
                if found is None:
                    break
                out.append((self.next, *found, "placeholder" if text is None else "match"))
                self.next += 1
            if f.chunk_end is None or self.next >= stop:
                break
            out += self._anchored(a, stop, first, end) or self._rest(a, stop, first, end)
        return out

    def _shares(self, until: int, start: int, end: int, how: str) -> list[tuple[int, int | None, int | None, str]]:
        """Times by weight for the sentences up to one; placeholders get none."""
        spoken = [k for k in range(self.next, until) if self.sentences[k] is not None]
        times = dict(zip(spoken, spread([self.sentences[k] for k in spoken], start, end, self.options.least_ms), strict=True))
        return [(k, *times.get(k, (None, None)), how if k in times else "placeholder") for k in range(self.next, until)]

    def _anchored(self, a: Aligner, stop: int, first: int, end: int) -> list[tuple[int, int | None, int | None, str]]:
        base = min(end, max(first, a.last_end + 1))
        for k in range(self.next + 1, min(stop, self.next + 1 + self.lookahead)):
            before = a.last_end
            text = self.sentences[k]
            found = text is not None and a.match(text, aggressive=True)
            if not found:
                continue
            least = self.options.least_ms
            spoken = sum(self.sentences[i] is not None for i in range(self.next, k))
            # the sentences of the gap need their room, also where the anchor was heard too early
            start = min(max(found[0], base + spoken * least, before + 1), max(base, end))
            stop_at = max(min(max(found[1], start + least), end), start)
            out = [*self._shares(k, base, start, "gap"), (k, start, stop_at, "anchor")]
            self.next, a.last_end = k + 1, stop_at
            return out
        return []

    def _rest(self, a: Aligner, stop: int, first: int, end: int) -> list[tuple[int, int | None, int | None, str]]:
        base = min(end, max(first, a.last_end + 1))
        out = self._shares(stop, base, end, "rest")
        self.next, a.last_end = stop, max(a.last_end, end)
        a.skip(next((i for i in range(a.cursor, len(a.words)) if round(a.words[i][1] * 1000) > a.last_end), len(a.words)))
        return out


def align_files(sentences: DataFrame, files: DataFrame, *, lookahead: int = LOOKAHEAD) -> DataFrame:
    """(doc_id, idx, start_ms, end_ms, source, how) of the sentences that the files of words settle, file by file.

    ``sentences`` are (doc_id, idx, text), null texts placeholders; ``files``
    are rows as in ``DELIVERY``. Of several deliveries of a file's number the
    one of the highest version counts. Without ``chunk_end`` a file stops at
    the first sentence that nothing matches, which waits for the next file.
    Sentences that nothing settles have no row. Documents are aligned in
    parallel; the words of one have to fit in a task.
    """

    def run(key: tuple[Any, ...], s: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        walk = Walk([None if pd.isna(t) else t for t in s.sort_values("idx").text], lookahead=lookahead)
        rows = []
        for r in w.sort_values("number").itertuples(index=False):
            f = FileOfWords.of(r)
            rows += [(key[0], i, a, b, f.source, how) for i, a, b, how in walk.feed(f)]
        return frame(rows, ["doc_id", "idx", "start_ms", "end_ms", "source", "how"])

    last = files.groupBy("doc_id", "number").agg(F.max_by(F.struct(*[c for c in files.columns if c not in ("doc_id", "number")]), "version").alias("f")).select("doc_id", "number", "f.*")
    return dealt(sentences).groupBy("doc_id").cogroup(dealt(last).groupBy("doc_id")).applyInPandas(run, ALIGNED)


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({c: "Int64" for c in ("start_ms", "end_ms", "idx") if c in names})
