"""Alignment as a stream: files of words come one after the other, each row goes out once, and a file can be replaced.

The state of a document is its sentences, where its alignment stands, and its
files of words with the standing before each. A file that comes again with a
higher version, or out of turn, takes the document back to the standing before
it; the files from there on are aligned again and their rows go out with the
next revision, so the rows of the latest revision are those of a run that saw
the last versions only, in order.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.files_alignment import LOOKAHEAD, FileOfWords, Walk, frame

ALIGNED = "doc_id long, idx int, start_ms long, end_ms long, source string, how string, revision int"
_NAMES = ["doc_id", "idx", "start_ms", "end_ms", "source", "how", "revision"]
_FILE = "version int, source string, start_ms long, end_ms long, chunk_end int, texts array<string>, starts array<double>, ends array<double>, next int, last_end long, words_before int, read int"


class AlignmentState(StatefulProcessor):
    """Sentences, standing, and files of words by number, of each document."""

    def __init__(self, keep: int | None = None, lookahead: int = LOOKAHEAD):
        self.keep, self.lookahead = keep, lookahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sentences = handle.getListState("sentences", "idx int, text string")
        #: next sentence, last end, words read of all, revision, highest number that was let go, words up to it
        self.standing = handle.getValueState("standing", "next int, last_end long, read int, revision int, gone int, gone_words int")
        self.files = handle.getMapState("files", "number int", _FILE)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803  names of the interface
        rows = initialState.sort_values("idx")
        self.sentences.appendList([(int(i), None if pd.isna(t) else t) for i, t in zip(rows.idx, rows.text, strict=True)])  # one message for all

    def _stored(self) -> list[int]:
        return sorted(k[0] for k in self.files.keys()) if self.files.exists() else []  # noqa: SIM118  no mapping

    def _file(self, number: int) -> tuple[FileOfWords, tuple[int, int, int, int]]:
        v = self.files.getValue((number,))
        texts, starts, ends = (list(x) if x is not None else [] for x in (v[5], v[6], v[7]))
        return FileOfWords(number, v[0], v[1], v[2], v[3], v[4], list(zip(texts, starts, ends, strict=True))), (v[8], v[9], v[10], v[11])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        if (s := self.standing.get()) is None:
            s = (0, -1, 0, 0, -1, 0)
        upto, last_end, read, revision, gone, gone_words = s
        sentences = [t for _, t in sorted((tuple(x) for x in self.sentences.get()), key=lambda x: x[0])] if self.sentences.exists() else []
        new = pd.concat(list(rows), ignore_index=True)
        out: list[tuple] = []
        stored = self._stored()
        held: dict[int, tuple[FileOfWords, tuple[int, int, int, int]]] = {}  # files read or written in this call
        walk, fed = None, None  # the walk behind the file of the number ``fed``

        def file(number: int) -> tuple[FileOfWords, tuple[int, int, int, int]]:
            if number not in held:
                held[number] = self._file(number)
            return held[number]

        for r in new.sort_values(["version", "number"], kind="stable").itertuples(index=False):
            f = FileOfWords.of(r)
            if f.number <= gone:
                out.append((key[0], None, None, None, f.source, "late", revision))
                continue
            known = bisect_left(stored, f.number)
            there = known < len(stored) and stored[known] == f.number
            if there and file(f.number)[0].version >= f.version:
                continue  # it was delivered before
            again = stored[known:]
            settled = upto
            if again:
                revision += 1
                upto, last_end, _, read = file(again[0])[1]
                walk = None
            todo = [f, *(file(n)[0] for n in again if n != f.number)]
            if not there:
                stored.insert(known, f.number)
            for place, g in enumerate(todo, known):
                before = stored[place - 1] if place else None
                total = gone_words
                if before is not None:
                    h, (_, _, at, _) = file(before)
                    total = at + len(h.words)
                if walk is None or fed != before:
                    # words that earlier files left unread, the last file's first
                    unread: list[list] = []
                    for n in reversed(stored[:place]):
                        h, (_, _, at, _) = file(n)
                        unread.append(h.words[max(0, read - at) :])
                        if at <= read:
                            break
                    walk = Walk(sentences, upto, last_end, [w for ws in reversed(unread) for w in ws], lookahead=self.lookahead)
                value = (g.version, g.source, g.start_ms, g.end_ms, g.chunk_end, *([w[k] for w in g.words] for k in range(3)), upto, last_end, total, read)
                self.files.updateValue((g.number,), value)
                held[g.number] = (g, (upto, last_end, total, read))
                out += [(key[0], i, a, b, g.source, how, revision) for i, a, b, how in walk.feed(g)]
                upto, last_end, fed = walk.next, walk.last_end, g.number
                read = total + len(g.words) - walk.left
            # what was settled before and is not any more
            out += [(key[0], i, None, None, None, "withdrawn", revision) for i in range(upto, settled)]
            while self.keep is not None and len(stored) > self.keep and file(stored[1])[1][3] >= file(stored[1])[1][2]:
                gone = stored.pop(0)
                gone_words = file(stored[0])[1][2]
                self.files.removeKey((gone,))
        self.standing.update((upto, last_end, read, revision, gone, gone_words))
        yield frame(out, _NAMES).astype({"revision": "int32"})

    def close(self) -> None:
        pass


def align_stream(deliveries: DataFrame, sentences: DataFrame, *, keep: int | None = None, lookahead: int = LOOKAHEAD) -> DataFrame:
    """A stream of (doc_id, idx, start_ms, end_ms, source, how, revision): the sentences that each batch's files settle.

    ``deliveries`` is a stream of rows as in ``DELIVERY`` of the files'
    alignment; ``sentences`` (doc_id, idx, text) are taken when the stream
    starts for the first time. A row goes out once; only a file that replaces
    one, or comes behind a later one, sends rows again, with a higher
    ``revision``, and ``withdrawn`` for those that have no time any more.
    What comes with a version that is not higher is passed over, so batches
    may come twice. With ``keep``, of each document at most about so many of
    the last files can be replaced; older ones whose words are all read leave
    the state, and a delivery of one gives a row ``late``. Documents without
    sentences settle nothing.
    """
    state = AlignmentState(keep, lookahead)
    return deliveries.groupBy("doc_id").transformWithStateInPandas(state, outputStructType=ALIGNED, outputMode="Append", timeMode="None", initialState=sentences.select("doc_id", "idx", "text").groupBy("doc_id"))


def latest_revision(rows: DataFrame) -> DataFrame:
    """What the stream has settled: the row of the highest revision of each sentence; withdrawn ones and late deliveries are left out."""
    w = Window.partitionBy("doc_id", "idx").orderBy(F.desc("revision"), F.col("how") == "withdrawn")
    last = rows.where("idx is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1 and how <> 'withdrawn'")
    return last.drop("_n", "revision")
