"""Fill-in-middle: a text is cut at two places between code points and its parts are put in another order.

Offsets of code points come from the split pre-tokenizer of the tokenizers
library, whose matches each stand alone; nothing is trained. They are kept in
two levels: matches of up to ``BLOCK`` code points cover the whole text from
left to right, and a block's own offsets, one for each code point, are taken
where a rank falls into it and at the text's end. The number of offsets of
both levels gives n, and the offset of a rank gives a cut. A list with an
entry for each code point of a text is never held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names

#: Code points of a block.
BLOCK = 512
SENTINELS = ("<P>", "<S>", "<M>")
_CUT = "n bigint, prefix string, middle string, suffix string"


class Offsets:
    """Code-point offsets of texts by rank."""

    def __init__(self, block: int = BLOCK):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        # in this dialect the flag m lets a dot match line breaks too
        self.block, self.one, self.many = block, Split(Regex("(?m:.)"), "isolated"), Split(Regex(f"(?m:.{{1,{block}}})"), "isolated")

    def blocks(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.many.pre_tokenize_str(text) if text else []

    def count(self, blocks: list) -> int:
        return (len(blocks) - 1) * self.block + len(self.one.pre_tokenize_str(blocks[-1][0])) if blocks else 0

    def of(self, blocks: list, rank: int) -> int:
        """Where the first ``rank`` units end."""
        at, more = divmod(rank, self.block)
        if not more:
            return blocks[at - 1][1][1] if at else 0
        part, (start, _) = blocks[at]
        return start + self.one.pre_tokenize_str(part)[more - 1][1][1]


def _cut(texts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    offsets = Offsets()
    for batch in texts:
        n, parts = [], ([], [], [])
        for text, x, y in zip(*(c.to_pylist() for c in batch), strict=True):
            blocks = offsets.blocks(text)
            n.append(offsets.count(blocks))
            if x is None:
                a = b = None
            else:
                a, b = (offsets.of(blocks, r) for r in sorted((x % (n[-1] + 1), y % (n[-1] + 1))))
            for out, part in zip(parts, (None, None, None) if a is None else (text[:a], text[a:b], text[b:]), strict=True):
                out.append(part)
        yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), *(pa.array(p, pa.string()) for p in parts)], names=["n", "prefix", "middle", "suffix"])


def _check(sentinels: tuple[str, str, str]) -> None:
    for a in sentinels:
        for b in sentinels:
            if not a or (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError("a sentinel must not be empty, hold another one, or end as one begins: parts could not be told apart")
    if len(set(sentinels)) < 3:
        raise ValueError("three different sentinels are needed")


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", whole_from: int = 90, spm_below: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows of ``docs`` with n, form, prefix_chars, middle_chars and output put last.

    The text is cut at two places drawn from the hex SHA-256 of
    ``seed:id``; of 100 draws those from ``whole_from`` leave it as it is
    (form plain), as do empty texts and those that hold a sentinel.
    Of the others the share ``spm_below`` has its suffix first (spm), the rest
    its prefix (psm). ``n`` counts code points, as do prefix_chars and
    middle_chars, which are null for plain.

    Null texts count as empty; a null id is drawn for as the empty string.
    Rows that repeat an id and text get equal results; an empty table gives no
    rows. Very long texts are cut whole. Columns of ``docs`` with the names
    added are replaced; no other name matters.
    """
    _check(sentinels)
    kept = [c for c in docs.columns if c not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    sha_, form_, cut_, out_ = free_names(docs, "sha", "form", "cut", "out")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    draw = lambda k: F.conv(F.substring(F.col(sha_), 1 + 8 * k, 8), 16, 10).cast("bigint")
    plain = (text == "") | (draw(2) % 100 >= whole_from)
    for s in sentinels:
        plain = plain | F.contains(text, F.lit(s))
    rows = docs.select(*kept, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256).alias(sha_))
    rows = rows.withColumn(form_, F.when(plain, "plain").when(draw(3) % 100 < spm_below, "spm").otherwise("psm"))
    cut = F.arrow_udf(_cut, _CUT)
    whole = F.col(form_) == "plain"
    rows = rows.withColumn(cut_, cut(text, F.when(~whole, draw(0)), F.when(~whole, draw(1))))
    p, s, m = (F.lit(x) for x in sentinels)
    prefix, middle, suffix = (F.col(f"{cut_}.{x}") for x in ("prefix", "middle", "suffix"))
    rows = rows.withColumn(out_, F.when(whole, text).when(F.col(form_) == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle)))
    return rows.select(
        *kept, F.col(f"{cut_}.n").alias("n"), F.col(form_).alias("form"), F.length(prefix).cast("long").alias("prefix_chars"), F.length(middle).cast("long").alias("middle_chars"), F.col(out_).alias("output")
    )


def restore(output, form, sentinels: tuple[str, str, str] = SENTINELS):
    """The text that a form's output was made of."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), -1)
    prefix, suffix = (F.when(form == "spm", F.get(parts, F.lit(a))).otherwise(F.get(parts, F.lit(b))) for a, b in ((2, 1), (1, 2)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(parts, F.lit(3)), suffix))


#: DuckDB's form of the query over ``documents``.
SQL = """
WITH s AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (
  SELECT doc_id, t, length(t) AS n, list_transform([0, 1, 2, 3], lambda k: list_reduce(list_transform(range(1, 9), lambda j: CAST(position(s[8 * k + j] IN '0123456789abcdef') - 1 AS BIGINT)), lambda x, y: 16 * x + y)) AS h FROM s),
f AS (
  SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:a] || '<S>' || t[b + 1:] || '<M>' || t[a + 1:b] ELSE '<S>' || t[b + 1:] || '<P>' || t[1:a] || '<M>' || t[a + 1:b] END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM f
"""
