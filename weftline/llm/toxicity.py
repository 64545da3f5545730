"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are rates over the whole text: densities of a lexicon (fixed
words, and words and word beginnings learned from the labels), how near its
words stand to the second person, capitals, punctuation, and obfuscated
spellings. Each distinct token is analysed once per worker and coded as a
small integer; a text's features are sums over its tokens' codes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out
from .minhash import _WordHash, shingle_hashes

#: Bounds of the sample of labelled rows that the model is fitted on.
ROWS_TOXIC, ROWS_CLEAN = 2_000, 3_000

# Common words of abuse in four languages, and forms of the second person.
LEXICON = frozenset(
    "idiot idiots moron morons stupid dumb dumbass loser losers pathetic worthless trash garbage scum clown clowns disgusting fool imbecile jerk bastard bitch crap damn asshole shit fuck fucking "
    "freak hate kill ugly vermin filth filthy pig retard cretin coward degenerate "
    "idiota imbécil estúpido estúpida basura asqueroso asquerosa inútil payaso escoria mierda puta cabrón "
    "idiote imbécile stupide ordure déchet dégoûtant dégueulasse connard connasse merde salaud crétin pourriture "
    "dummkopf blöd blödmann abschaum arschloch scheiße widerlich wertlos trottel versager müll depp".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur ya tu te ti toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes vosotros tus".split())
_LEET = str.maketrans("013457@$!|", "oleastasil")

_SEED, _LEARNED, _PREFIX, _SECOND, _CAPS, _ODD, _HIDDEN, _LONG_RUN = (1 << k for k in range(8))
_EDGE = re.compile(r"^\W+|\W+$|_+")
_RUN = re.compile(r"(.)\1\1")
NAMES = (
    "log_words", "seed_rate", "seed_log", "learned_rate", "learned_log", "prefix_rate", "prefix_log", "hidden_rate", "hidden_log", "second_rate", "near_second_rate",
    "capital_rate", "caps_word_rate", "punctuation_rate", "exclamation_rate", "odd_spelling_rate", "long_run_rate", "any_log",
)
_SHORTEST, _LONGEST = 4, 6


def _core(token: str) -> str:
    return _EDGE.sub("", token.lower())


class Features:
    """Dense features of texts under a learned lexicon of words and word beginnings."""

    def __init__(self, learned: frozenset[str], prefixes: frozenset[str], near: int = 5):
        self.learned, self.prefixes, self.near = learned, prefixes, near
        self.heads = frozenset(p[:_SHORTEST] for p in prefixes)
        self.cache: dict[str, tuple[int, int]] = {}

    def code(self, token: str) -> int:
        """Flags in the low byte; then letters, capitals, punctuation and exclamation marks, 12 bits each (long tokens count as 4095)."""
        if token.isalpha():  # most are plain words
            word, flags, letters, marks = token.lower(), 0, len(token), 0
        else:
            word, flags = _core(token), 0
            letters = sum(map(str.isalpha, token))
            marks = len(token) - sum(map(str.isalnum, token))
        capitals = 0 if token.islower() else sum(map(str.isupper, token))
        if word in LEXICON:
            flags |= _SEED
        if word in self.learned:
            flags |= _LEARNED
        if len(word) >= _SHORTEST and word[:_SHORTEST] in self.heads and any(word[:k] in self.prefixes for k in range(_SHORTEST, min(_LONGEST, len(word)) + 1)):
            flags |= _PREFIX
        if word in SECOND_PERSON:
            flags |= _SECOND
        if capitals > 1 and capitals == letters:
            flags |= _CAPS
        if letters and word and not word.isalpha():
            flags |= _ODD
            plain = word.translate(_LEET)
            if any(x != word and (x in LEXICON or x in self.learned) for x in (plain, re.sub(r"\W|_|\d", "", plain), re.sub(r"\W|_", "", word))):
                flags |= _HIDDEN
        if _RUN.search(word):
            flags |= _LONG_RUN
            short = re.sub(r"(.)\1+", r"\1", word)
            if short in LEXICON or short in self.learned:
                flags |= _HIDDEN
        counts = (letters, capitals, marks, token.count("!"))
        return flags | sum(min(n, 4095) << (8 + 12 * k) for k, n in enumerate(counts))

    def codes(self, tokens: list[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > 1_000_000:
            cache.clear()
        try:
            return np.fromiter(map(cache.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            for t in set(tokens):
                if t not in cache:
                    cache[t] = self.code(t)
            return np.fromiter(map(cache.__getitem__, tokens), np.int64, len(tokens))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(NAMES)))
        for row, text in zip(out, texts, strict=True):
            tokens = (text or "").split()
            if not tokens:
                continue
            c, n = self.codes(tokens), len(tokens)
            per = Counter()
            flags = c & 255
            hit = flags & (_SEED | _LEARNED | _PREFIX | _HIDDEN) != 0
            for f in (_SEED, _LEARNED, _PREFIX, _SECOND, _CAPS, _ODD, _HIDDEN, _LONG_RUN):
                per[f] = int(np.count_nonzero(flags & f))
            near = 0
            if per[_SECOND] and hit.any():
                at, second = np.flatnonzero(hit), np.flatnonzero(flags & _SECOND)
                k = np.searchsorted(second, at)
                gap = np.minimum(np.abs(at - second[np.minimum(k, len(second) - 1)]), np.abs(at - second[np.maximum(k - 1, 0)]))
                near = int((gap <= self.near).sum())
            letters, capitals, marks, bangs = (int(((c >> (8 + 12 * k)) & 4095).sum()) for k in range(4))
            chars = max(1, letters + marks)
            row[:] = (
                math.log1p(n), per[_SEED] / n, math.log1p(per[_SEED]), per[_LEARNED] / n, math.log1p(per[_LEARNED]), per[_PREFIX] / n, math.log1p(per[_PREFIX]), per[_HIDDEN] / n, math.log1p(per[_HIDDEN]),
                per[_SECOND] / n, near / n, capitals / max(1, letters), per[_CAPS] / n, marks / chars, bangs / n, per[_ODD] / n, per[_LONG_RUN] / n, math.log1p(int(hit.sum())),
            )
        return out


def learn_lexicon(texts: list[str], labels: np.ndarray, least: int = 4, ratio: float = 8.0) -> tuple[frozenset[str], frozenset[str]]:
    """Words and word beginnings far commoner, by texts that hold them, in toxic texts than in others."""
    words: tuple[Counter, Counter] = (Counter(), Counter())
    heads: tuple[Counter, Counter] = (Counter(), Counter())
    n = [max(1, int((labels == k).sum())) for k in (0, 1)]
    parts: dict[str, tuple[str, ...]] = {}
    for text, y in zip(texts, labels, strict=True):
        own = set()
        for t in set(text.split()):
            if t not in parts:
                w = _core(t)
                parts[t] = tuple(w[:k] for k in range(_SHORTEST, min(_LONGEST, len(w)) + 1)) + (w,)
            own.add(parts[t])
        words[int(y)].update({p[-1] for p in own if p[-1]})
        heads[int(y)].update({x for p in own for x in p[:-1]})

    def telling(c: tuple[Counter, Counter], least: int) -> frozenset[str]:
        return frozenset(w for w, k in c[1].items() if k >= least and (k + 0.5) / n[1] > ratio * (c[0][w] + 0.5) / n[0])

    least = max(least, n[1] // 300)
    return telling(words, least), telling(heads, 3 * least)


class Boosted:
    """Depth-limited regression trees on binned features, fitted to the logistic loss."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 4.0, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base, self.model = math.log(p / (1 - p)), []
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-raw))
            tree = self._grow(b, y - q, q * (1 - q) + 1e-9)
            self.model.append(tree)
            raw += self._apply(tree, b)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> dict[int, tuple]:
        """Nodes by number (children 2k + 1 and 2k + 2): (feature, last bin to the left), or (value,)."""
        tree: dict[int, tuple] = {}
        todo = [(0, np.arange(len(g)), 0)]
        while todo:
            k, rows, depth = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if depth < self.depth:
                for j in range(b.shape[1]):
                    size = len(self.edges[j]) + 1
                    gl, hl = np.bincount(b[rows, j], g[rows], size).cumsum()[:-1], np.bincount(b[rows, j], h[rows], size).cumsum()[:-1]
                    gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                    gain[(hl < self.least / 16) | (hs - hl < self.least / 16)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), (j, int(gain.argmax())))
            if best[1] is None:
                tree[k] = (self.rate * gs / (hs + self.l2),)
                continue
            j, at = tree[k] = best[1]
            left = b[rows, j] <= at
            todo += [(2 * k + 1, rows[left], depth + 1), (2 * k + 2, rows[~left], depth + 1)]
        return tree

    @staticmethod
    def _apply(tree: dict[int, tuple], b: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(b)), [(0, np.arange(len(b)))]
        while todo:
            k, rows = todo.pop()
            node = tree[k]
            if len(node) == 1:
                out[rows] = node[0]
            elif len(rows):
                left = b[rows, node[0]] <= node[1]
                todo += [(2 * k + 1, rows[left]), (2 * k + 2, rows[~left])]
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out = np.full(len(x), self.base)
        for tree in self.model:
            out += self._apply(tree, b)
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit (pool adjacent violators)."""
    order = np.lexsort((y, x))
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([float(b), 1.0, float(a), float(a)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, hi = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, hi
    return np.array([v for b in blocks for v in (b[2], b[3])]), np.array([b[0] for b in blocks for _ in (0, 1)])


class ToxicityModel:
    """Lexicon, trees and calibration. Without two kinds of labels it gives the share of toxic ones (0 without labels)."""

    def __init__(self, texts: list[str | None], labels: list[int]):
        y = np.array(labels, float)
        texts = [t or "" for t in texts]
        self.const = float(y.mean()) if len(y) else 0.0
        self.trees = None
        self.learned = self.prefixes = frozenset()
        if len(set(labels)) < 2:
            return
        # near copies teach one time, else all the words of a copied text would seem telling
        cache, seen, keep = _WordHash(), set(), []
        for i, t in enumerate(texts):
            x = shingle_hashes(t, 5, cache)
            if not len(x) or (x[0], y[i]) not in seen:
                keep.append(i)
            if len(x):
                seen.add((x[0], y[i]))
        texts, y = [texts[i] for i in keep], y[keep]
        fold = np.arange(len(y)) % 3
        first = fold != 0  # the rest calibrates
        self.learned, self.prefixes = learn_lexicon([t for t, f in zip(texts, first, strict=True) if f], y[first])
        # trees must see lexicon hits as new texts have them: each half under the other half's lexicon
        x = np.zeros((len(y), len(NAMES)))
        for k in (1, 2):
            other = learn_lexicon([t for t, f in zip(texts, fold, strict=True) if f not in (0, k)], y[(fold != 0) & (fold != k)])
            x[fold == k] = Features(*other)([t for t, f in zip(texts, fold, strict=True) if f == k])
        x[fold == 0] = Features(self.learned, self.prefixes)([t for t, f in zip(texts, fold, strict=True) if f == 0])
        self.trees = Boosted().fit(x[first], y[first])
        self.knots = isotonic(self.trees.raw(x[~first]), y[~first])

    def scorer(self):
        features = Features(self.learned, self.prefixes)

        def score(texts: list[str | None]) -> np.ndarray:
            if self.trees is None or not texts:
                return np.full(len(texts), self.const)
            return np.clip(np.interp(self.trees.raw(features(texts)), *self.knots), 0.0, 1.0)

        return score


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_toxic: int = ROWS_TOXIC, rows_clean: int = ROWS_CLEAN) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows that are not held out.

    About ``rows_toxic`` and ``rows_clean`` labelled rows, those of the lowest
    hashes, have their texts looked up and come to the driver. Rows with a
    null label or id are not labelled.
    """
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id")))
    counts = {r[0]: r[1] for r in y.groupBy("y").count().collect()}
    u = F.xxhash64(F.col("id"), F.lit("label sample")).bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") / F.lit(2.0**32)
    share = F.when(F.col("y") == 1, rows_toxic / max(1, counts.get(1, 0))).otherwise(rows_clean / max(1, counts.get(0, 0)))
    sample = y.where(u < share).dropDuplicates(["id"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id").collect()
    rows = sorted({(r.id, r.y, r.text or "") for r in rows})
    return ToxicityModel([r[2] for r in rows], [r[1] for r in rows])


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The columns of ``docs`` with ``score`` and ``predicted`` (1 from the threshold on) put last.

    Null, empty and blank texts are scored like a text without tokens. Very
    long texts are scored whole. Equal texts have equal scores. Columns of
    ``docs`` that are already called score or predicted are replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                s = score(part.column(part.schema.get_field_index(text_col)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    src = docs.select(*kept).withColumn(text_col, F.col(text_col).cast("string"))
    schema = T.StructType([*src.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return src.mapInArrow(run, schema)
