"""Suffix-array dedup: Burrows-Wheeler transforms of shards, merged by refining their interleave.

Content-defined anchors bring together what can repeat at all: the pieces of text around one anchor.
Each piece is a shard with a suffix order and a Burrows-Wheeler transform of its own, over an alphabet of
runs of ``STEP`` bytes: the symbol before each suffix in order, and where in the order the suffix
stands that begins with it. Shards are merged as follows: at first all suffixes are one interval, shard
after shard, each in its order. A round reads the transforms' symbols in the present interleave and deals
the suffixes before them out by symbol, keeping the order within a symbol; so suffixes stand in order of
one symbol more, without being sorted anew. Where symbol or former interval changes, a new interval
begins; suffixes that go on sharing one have a common prefix of one symbol more. An interval of one suffix is
settled, and so are all longer suffixes it leads to; they are left out of later rounds. After
``LENGTH / STEP`` rounds, what still shares an interval is a repeat of ``LENGTH`` bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from meibo.llm.anchored import gram_hashes
from meibo.llm.common import table
from meibo.llm.repeats import Kind, covered, marked, removed_spans

#: Bytes of a repeat, of an anchor's gram, and of a symbol.
LENGTH, GRAM, STEP = 400, 128, 50


def text_bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, dtype=np.uint8)


def cutter(text: str):
    own = text.encode("utf-8", "surrogatepass")
    return lambda a, b: own[a:b]


@dataclass
class Transforms:
    """The transforms of all shards, shard after shard.

    ``order`` has the shards' suffixes, by place in the joined bytes; ``symbol`` the symbol before each, -1 if
    its shard has none there; ``before`` where in ``order`` the suffix beginning with that symbol stands.
    """

    order: np.ndarray
    symbol: np.ndarray
    before: np.ndarray
    last: np.ndarray


def shard_orders(sym: np.ndarray, shard: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The suffixes ``at`` ordered shard by shard, each by its symbols; -1 stands for no symbol."""
    order = at[np.lexsort((sym[at], shard[at]))]
    same = (sym[order[1:]] == sym[order[:-1]]) & (shard[order[1:]] == shard[order[:-1]])
    tied = np.zeros(len(order), dtype=bool)
    tied[1:] |= same
    tied[:-1] |= same
    if tied.any():
        few = order[tied]
        keys = [sym[few]]
        for k in range(STEP, LENGTH, STEP):
            on = np.minimum(few + k, len(sym) - 1)
            keys.append(np.where(shard[on] == shard[few], sym[on], -1))
        order[tied] = few[np.lexsort((*reversed(keys), shard[few]))]
    return order


def transforms(shards: list[np.ndarray]) -> Transforms:
    """The transforms of shards of bytes."""
    size = np.array([len(p) for p in shards])
    base = np.concatenate(([0], np.cumsum(size)))
    joined = np.concatenate(shards)
    shard = np.repeat(np.arange(len(shards)), size)
    place = np.arange(len(joined)) - base[shard]
    sym = np.full(len(joined), -1, dtype=np.int64)
    g = gram_hashes(joined, STEP)
    inside = np.flatnonzero((place + STEP <= size[shard])[: len(g)])  # a symbol does not reach into the next shard
    sym[inside] = np.unique(g[inside], return_inverse=True)[1]
    order = shard_orders(sym, shard, np.arange(len(joined)))
    stands = np.empty(len(order), dtype=np.int64)
    stands[order] = np.arange(len(order))
    has = place[order] >= STEP
    symbol, before = np.full(len(order), -1, dtype=np.int64), np.zeros(len(order), dtype=np.int64)
    symbol[has], before[has] = sym[order[has] - STEP], stands[order[has] - STEP]
    # the suffix of one symbol that ends its shard stands before the empty suffix
    last = base[1:][size >= STEP] - STEP
    return Transforms(order, symbol, before, np.stack([stands[last], sym[last]]))


def common_prefixes(t: Transforms, rounds: int) -> np.ndarray:
    """For every suffix in ``t.order``, how many symbols it shares with another suffix of any shard, up to ``rounds``."""
    prefix = np.zeros(len(t.order), dtype=np.int16)
    at, interval = np.arange(len(t.order)), np.zeros(len(t.order), dtype=np.int64)
    for number in range(1, rounds + 1):
        symbol, before, old = t.symbol[at], t.before[at], interval
        if number == 1:  # the empty suffixes open the interleave
            symbol, before = np.concatenate((t.last[1], symbol)), np.concatenate((t.last[0], before))
            old = np.concatenate((np.zeros(t.last.shape[1], dtype=np.int64), old))
        real = symbol >= 0
        symbol, before, old = symbol[real], before[real], old[real]
        if not len(before):
            break
        dealt = np.argsort(symbol, kind="stable")
        symbol, before, old = symbol[dealt], before[dealt], old[dealt]
        new = np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])))
        interval = np.cumsum(new) - 1
        shared = np.bincount(interval)[interval] > 1
        at, interval = before[shared], interval[shared]
        prefix[at] = number
    return prefix


def merge(pieces: list[np.ndarray], copies: np.ndarray) -> list[np.ndarray]:
    """For every piece, which of its window starts begin ``LENGTH`` bytes that the pieces hold twice."""
    t = transforms(pieces)
    repeated = np.zeros(len(t.order), dtype=bool)
    repeated[t.order] = common_prefixes(t, LENGTH // STEP) == LENGTH // STEP
    ends = np.cumsum([len(p) for p in pieces]).tolist()
    return [repeated[b - len(p) : max(b - len(p), b - LENGTH + 1)] for p, b in zip(pieces, ends, strict=True)]


BYTES = Kind(LENGTH, GRAM, cutter, text_bytes, merge)


def remove_repeats(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans``, replacing columns so named.

    ``spans`` are the maximal runs of removed bytes (first, count); the other bytes need not be valid
    UTF-8 by themselves, so their digest is returned. Every byte is judged on the input. A null text
    counts as empty; repeated rows are copies of each other. An empty table gives an empty one; texts of
    any length are taken whole.
    """
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")

    def one(text: str, runs: np.ndarray) -> tuple:
        data = text_bytes(text.encode("utf-8", "surrogatepass"))
        gone = covered(runs, len(data), LENGTH)
        spans, kept = removed_spans(gone), data[~gone] if len(runs) else data
        return len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept.tobytes()).hexdigest(), spans

    made = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:int,count:int>>"
    return marked(df, BYTES, key, text_col, [c for c in df.columns if c not in names], made, one)


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes that stand in a repeated string of 400."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op10_suffixes": op10_suffixes}

SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 398)) AS i FROM t WHERE length(h) >= 800),
g AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 800)) AS g FROM w),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1),
b AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true) AS opens FROM d),
n AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM n GROUP BY doc_id, run),
k AS (SELECT doc_id, h, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS from_, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last FROM s JOIN t USING (doc_id)),
m AS (SELECT doc_id, string_agg(substr(h, 2 * from_ - 1, 2 * (a - from_)) || CASE WHEN last THEN substr(h, 2 * z - 1) ELSE '' END, '' ORDER BY a) AS kept, count(*) AS spans, sum(z - a) AS gone FROM k GROUP BY doc_id)
SELECT t.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM t LEFT JOIN m USING (doc_id)
"""
ORACLES = {"op10_suffixes": SQL}
