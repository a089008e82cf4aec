"""Substring dedup by relative Lempel-Ziv parsing over words.

The reference is the corpus itself, dealt to blocks by content-defined anchors: all pieces of text
around equal anchors lie in one block, so a block can be indexed and parsed against by itself, and no
document needs to meet a block that cannot hold its words. A block's index has the places of every seed
of ``LENGTH`` words, the shortest factor that counts. Every piece is parsed greedily against its block,
left to right: the seed at the present word is looked up; where the block has it elsewhere, the two places
are compared word by word as far as they agree, and that is a factor. The parse goes on with the first
seed that reaches over the factor's end, so that seeds over a boundary are checked as well and two factors
that meet leave no repeated run unseen. Where there is no factor, it goes on by one word. Words of
factors are duplicate spans. Equal pieces are put together first, being one factor from end to end.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.llm.anchored import gram_hashes
from meibo.llm.common import table
from meibo.llm.repeats import Kind, covered, marked, removed_spans

#: Words of the shortest factor, and of an anchor's gram.
LENGTH, GRAM = 35, 8


def words(text: str | bytes) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).split()


def word_hashes(text: str | bytes) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(w) for w in words(text)], dtype=np.uint64)


def cutter(text: str):
    own = words(text)
    return lambda a, b: b" ".join(own[a:b])


class BlockIndex:
    """The seeds of a reference block: for every place in it, the block's first other place of the same seed."""

    def __init__(self, pieces: list[np.ndarray]) -> None:
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        self.ends = np.cumsum(size)
        self.words = np.concatenate([*pieces, np.zeros(0, dtype=np.uint64)])
        self.end_of = np.repeat(self.ends, size)
        seeds = gram_hashes(self.words, LENGTH)
        at = np.arange(len(seeds))
        at = at[at + LENGTH <= self.end_of[: len(seeds)]]  # a seed does not reach into the next piece
        order = at[np.argsort(seeds[at], kind="stable")]
        new = np.concatenate(([True], seeds[order[1:]] != seeds[order[:-1]])) if len(order) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(order)))
        group = np.cumsum(new) - 1
        self.other = np.full(len(self.words), -1, dtype=np.int64)
        if len(order):
            lead, second = order[first], order[np.minimum(first + 1, len(order) - 1)]
            found = np.where(order == lead[group], second[group], lead[group])
            self.other[order] = np.where(count[group] > 1, found, -1)

    def factor(self, at: int) -> int:
        """How many words from ``at`` on the block has at the other place of its seed too; 0 if there is none."""
        there = int(self.other[at])
        if there < 0:
            return 0
        most = int(min(self.end_of[at] - at, self.end_of[there] - there))
        differ = np.flatnonzero(self.words[at : at + most] != self.words[there : there + most])
        return int(differ[0]) if len(differ) else most


def parse(pieces: list[np.ndarray], copies: np.ndarray) -> list[np.ndarray]:
    """For every piece, which of its runs of ``LENGTH`` words lie in a factor; a piece with copies is one factor."""
    block = BlockIndex(pieces)
    hits = np.flatnonzero(block.other >= 0)
    out, a = [], 0
    for piece, n, b in zip(pieces, copies.tolist(), block.ends.tolist(), strict=True):
        flags = np.zeros(max(0, len(piece) - LENGTH + 1), dtype=bool)
        if n > 1:
            flags[:] = True
        at = a
        while n == 1:
            k = int(np.searchsorted(hits, at))
            if k == len(hits) or hits[k] >= b:
                break
            at = int(hits[k])
            size = block.factor(at)
            if size >= LENGTH:
                flags[at - a : at - a + size - LENGTH + 1] = True
            at += max(1, size - LENGTH + 1)
        out.append(flags)
        a = b
    return out


WORDS = Kind(LENGTH, GRAM, cutter, word_hashes, parse)


def remove_repeats(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``n_removed``, ``spans`` and ``kept_text``, replacing columns so named.

    ``spans`` are runs of removed words (first, count). ``kept_text`` has the other words joined by
    one space. Every run is judged on the input. Null and empty texts have no words; repeated rows
    are copies of each other, so all their runs of ``LENGTH`` words go. An empty table gives an empty one;
    texts of any length are taken whole.
    """
    names = ("n_words", "n_removed", "spans", "kept_text")

    def one(text: str, runs: np.ndarray) -> tuple:
        w = words(text)
        gone = covered(runs, len(w), LENGTH)
        kept = [w[i] for i in np.flatnonzero(~gone).tolist()] if len(runs) else w
        return len(w), len(w) - len(kept), removed_spans(gone), b" ".join(kept).decode("utf-8", "surrogatepass")

    made = "n_words long, n_removed long, spans array<struct<first:int,count:int>>, kept_text string"
    return marked(df, WORDS, key, text_col, [c for c in df.columns if c not in names], made, one)


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without words that stand in a repeated run of 35."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


QUERIES = {"op1_substring": op1_substring}

SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM t),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS g FROM w WHERE i + 34 <= len(ws)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM d),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM t),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM e ANTI JOIN p USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""
ORACLES = {"op1_substring": SQL}
