"""Alignment of two tokenizers: which ids of one stand for the same bytes as which ids of the other.

Equal texts are put together first (one shuffle by the full text); each distinct text is tokenised and
aligned once, with the number of its copies as its weight. A task works on blocks of texts
(``BLOCK_BYTES``). Both tokenizers cut before every space that follows another character, so a text is a
row of *stretches*, each encoded by itself; a block encodes each of its distinct stretches once.

A block's row keeps its texts' stretches as numbers and the weighted links of its id pairs. Those rows
are written down (``cut``), so that a block stays what it is when executors are lost. The pairs of all
blocks are summed in Spark, and each block gets the sums of its own pairs back; the measures of its texts
follow from them and are joined to the documents by the digest of the text.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.llm.bpe import _packed, _unpacked, default_tokenizer, pieces
from meibo.llm.common import cut, table, text_of, tidy, unused, without

#: Bytes of text in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 6 << 20
#: Stretches that are encoded together, whose tokens are Python lists for that long.
SOME = 1 << 14
#: White space outside ASCII, and the stand-in for a space, as UTF-8 bytes read as one number: no stretch begins after these.
_NO_CUT = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x2581)])
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def default_pieces() -> str:
    """The place of the sentencepiece model that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def _byte_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.encode_special_tokens = True  # their strings are plain text
    return t


@lru_cache(maxsize=2)
def _piece_tokenizer(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a sentencepiece model: U+2581 is a space, ``<0xHH>`` the byte HH."""
    model = _piece_tokenizer(path)
    names = [model.id_to_piece(i) for i in range(len(model))]
    return [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]


def encode_stretches(stretches: pa.Array, path_a: str, path_b: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids end to end, how many each stretch has) by both tokenizers, as if each stretch (which begins with a space) stood inside a longer text."""
    model, parts = _piece_tokenizer(path_b), ([], [])
    before = len(model.encode("x"))  # a word before it, or a stretch of spaces alone would have no tokens
    for low in range(0, len(stretches), SOME):
        some = stretches.slice(low, SOME).to_pylist()
        a = [e.ids for e in _byte_tokenizer(path_a).encode_batch_fast(some, add_special_tokens=False)]
        b = [ids[before:] for ids in model.encode([f"x{s}" for s in some], num_threads=1)]
        for part, lists in zip(parts, (a, b), strict=True):
            count = np.fromiter(map(len, lists), np.int64, len(lists))
            part.append((np.fromiter(chain.from_iterable(lists), np.int64, int(count.sum())), count))
    none = (np.zeros(0, dtype=np.int64),) * 2
    return [tuple(map(np.concatenate, zip(*part, strict=True))) if part else none for part in parts]


def cuts(data: np.ndarray) -> np.ndarray:
    """Where stretches begin: at spaces whose character before is neither white space nor the stand-in for a space."""
    at = np.flatnonzero(data == 0x20)
    wide = np.concatenate([np.full(3, 0x20, np.uint8), data]).astype(np.int64)
    one, two, three = (wide[at + 3 - k] for k in (1, 2, 3))
    pair = (two << 8) | one
    return at[(one > 0x20) & ~np.isin(pair, _NO_CUT) & ~np.isin((three << 16) | pair, _NO_CUT)]


@lru_cache(maxsize=2)
def _tables(path_a: str, path_b: str) -> tuple[list[pa.Array], list[np.ndarray], pa.Array]:
    """The pieces of both tokenizers, their sizes, and every id of A and B as text: A before a comma or a bar, B before a comma or a semicolon."""
    every = [pieces(path_a), piece_bytes(path_b)]
    shown = [f"{i}{mark}".encode() for ids, marks in zip(every, (",|", ",;"), strict=True) for mark in marks for i in range(len(ids))]
    return [pa.array(p, pa.large_binary()) for p in every], [np.array([len(x) for x in p]) for p in every], pa.array(shown, pa.large_binary())


def _bytes_of(values: pa.Array) -> np.ndarray:
    """The bytes of a large binary or string array, end to end."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers, kind="stable")  # a merge, the parts being in order already
    return numbers[np.append(True, numbers[1:] != numbers[:-1])[: len(numbers)]]


def align_stretches(stretches: pa.LargeStringArray, path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """For distinct stretches: whether both tokenizers keep the bytes; (stretch, A id, B id) of each link; n_a, n_b and n_groups; n_links; the groups as text, each ended by a semicolon.

    Tokens are laid end to end with the places where they end. Places where a token of either ends cut
    the bytes into parts, each the overlap of one A and one B token; places where both end are groups.
    """
    (piece_a, piece_b), sizes, shown = _tables(path_a, path_b)
    n = len(stretches)
    length = np.diff(np.frombuffer(stretches.buffers()[1], np.int64)[stretches.offset : stretches.offset + n + 1])
    ids, own = [], []
    for flat, count in encode_stretches(stretches, path_a, path_b):
        ids.append(flat)
        own.append(np.repeat(np.arange(n), count))
    ok = np.ones(n, dtype=bool)
    for k in range(2):
        ok &= np.bincount(own[k], weights=sizes[k][ids[k]], minlength=n).astype(np.int64) == length
    data, where = _bytes_of(stretches), np.repeat(np.arange(n), length)
    for k, piece in enumerate((piece_a, piece_b)):  # of those with as many bytes, which have others
        differs = _bytes_of(piece.take(pa.array(ids[k][ok[own[k]]]))) != data[ok[where]]
        ok[where[ok[where]][differs]] = False
    for k in range(2):
        kept = ok[own[k]]
        ids[k], own[k] = ids[k][kept], own[k][kept]
    ends = [np.cumsum(sizes[k][ids[k]]) for k in range(2)]
    part = _distinct(np.concatenate(ends))
    at = [np.searchsorted(e, part) for e in ends]
    both = (ends[0][at[0]] == part) & (ends[1][at[1]] == part) if len(part) else np.zeros(0, dtype=bool)
    links = np.stack([own[0][at[0]], ids[0][at[0]], ids[1][at[1]]]) if len(part) else np.zeros((3, 0), dtype=np.int64)
    counts = np.stack([np.bincount(x, minlength=n) for x in (own[0], own[1], links[0][both])])
    group = [2 * np.searchsorted(part[both], e) + k for k, e in enumerate(ends)]
    order = np.argsort(np.concatenate(group), kind="stable")
    side = np.concatenate(group)[order]
    last = np.append(side[1:] != side[:-1], True)[: len(side)]
    a, b = len(piece_a), len(piece_b)
    item = np.concatenate(ids)[order] + np.where(side % 2 == 0, np.where(last, a, 0), 2 * a + np.where(last, b, 0))
    text = shown.take(pa.array(item))
    written = np.bincount(np.concatenate(own)[order], weights=np.diff(np.frombuffer(text.buffers()[1], np.int64)[: len(item) + 1]) if len(item) else None, minlength=n)
    to, buffer = np.cumsum(written).astype(np.int64), _bytes_of(text).tobytes() if len(item) else b""
    return ok, links, counts, np.bincount(links[0], minlength=n), [buffer[x:y] for x, y in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]


def _block(texts: list[str], keys: list[bytes], copies: np.ndarray, path_a: str, path_b: str) -> pa.RecordBatch:
    """The row of a block: its texts' own measures and stretches, and the weighted links of its pairs."""
    parts = [b" " + t.encode() for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    data = b"".join(parts)
    at = _distinct(np.concatenate([[0], ends, cuts(np.frombuffer(data, np.uint8))]))
    coded = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
    code, starts = coded.indices.to_numpy(), np.concatenate([[0], np.searchsorted(at, ends)])
    ok, links, counts, n_links, groups = align_stretches(coded.dictionary, path_a, path_b)
    del parts, data, at, coded

    def per_text(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values[code])])
        return total[starts[1:]] - total[starts[:-1]]

    good = per_text(~ok) == 0
    weight = np.bincount(code, weights=np.repeat(np.where(good, copies, 0), np.diff(starts)), minlength=len(ok)).astype(np.int64)
    pair = pa.array((links[1] << 32) | links[2]).dictionary_encode()
    number = pair.indices.to_numpy()
    total = np.bincount(number, weights=weight[links[0]], minlength=len(pair.dictionary)).astype(np.int64)
    measures = [np.where(good, per_text(v), 0) for v in (*counts, n_links)]
    shown = []
    for a, b, whole in zip(starts[:-1].tolist(), starts[1:].tolist(), good.tolist(), strict=True):
        shown.append(hashlib.sha256(b"".join([groups[k] for k in code[a:b].tolist()])[:-1]).hexdigest() if whole else " " * 64)
    name = xxhash.xxh3_64(b"".join(keys)).intdigest() >> 1
    offsets = pa.array([0, len(total)], pa.int32())
    columns = {
        "block": pa.array([name]), "keys": pa.array([b"".join(keys)], pa.binary()), "shown": pa.array(["".join(shown)]),
        "own": pa.array([_packed(np.concatenate([np.diff(starts), good, *measures]).astype(np.int64))], pa.binary()),
        "code": pa.array([_packed(code.astype(np.int64))], pa.binary()), "links": pa.array([_packed(np.concatenate([n_links, number]))], pa.binary()),
        "stretches": pa.array([len(ok)], pa.int64()), "pairs": pa.ListArray.from_arrays(offsets, pair.dictionary), "totals": pa.ListArray.from_arrays(offsets, pa.array(total)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def aligned_blocks(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each block of ``texts`` (key, text, copies), whose texts are distinct and not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            keys, own, copies = zip(*held, strict=True)
            return _block(list(own), list(keys), np.array(copies, dtype=np.int64), path_a, path_b)

        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                key, text, copies = (v.as_py() for v in row)
                held.append((key, text, copies))
                size += len(text)
                if size > BLOCK_BYTES:
                    yield block()
                    held, size = [], 0
        if held:
            yield block()

    schema = "block long, keys binary, shown string, own binary, code binary, links binary, stretches long, pairs array<long>, totals array<long>"
    return texts.select("key", "text", "copies").mapInArrow(tidy(run), schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, count, best): the links of every id pair, and whether no other A id has more with its B id."""
    each = blocks.select(F.inline(F.arrays_zip("pairs", "totals"))).where("totals > 0")
    counts = each.groupBy("pairs").agg(F.sum("totals").alias("count"))
    counts = counts.select(F.shiftright("pairs", 32).cast("int").alias("a"), F.col("pairs").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "count")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def text_measures(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, n_a, ..., count_sum, groups_sha256) of every text: each block takes the counts of its own pairs."""
    each = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("number", "pair"))
    each = each.withColumns({"a": F.shiftright("pair", 32).cast("int"), "b": F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int")})
    counted = each.join(counts, ["a", "b"]).select("of", "number", "count", "best")

    def join(own: pa.Table, found: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table([pa.nulls(0, f.type) for f in out], schema=out)
        row = {c: own.column(c)[0].as_py() for c in ("keys", "shown", "own", "code", "links", "stretches")}
        n = len(row["keys"]) // 32
        links, size = _unpacked(row["links"]), row["stretches"]
        n_links, number = links[:size], links[size:]
        count, best = (np.zeros(int(number.max(initial=-1)) + 1, dtype=np.int64) for _ in range(2))
        place = found.column("number").to_numpy()
        count[place], best[place] = found.column("count").to_numpy(), found.column("best").to_numpy()
        kept = _unpacked(row["own"]).reshape(-1, n)
        sizes, good, measures = kept[0], kept[1].astype(bool), kept[2:]
        code, starts = _unpacked(row["code"]), np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(n_links)
        more = []
        for values in (best, count):
            total = np.concatenate([[0], np.cumsum(values[number])])
            total = np.concatenate([[0], np.cumsum((total[ends] - total[ends - n_links])[code])])
            more.append(np.where(good, total[starts[1:]] - total[starts[:-1]], 0))
        keys = [row["keys"][32 * k : 32 * k + 32] for k in range(n)]
        shown = [row["shown"][64 * k : 64 * k + 64].strip() for k in range(n)]
        return pa.table([pa.array(keys, pa.binary()), *(pa.array(m, pa.int64()) for m in (*measures, *more)), pa.array(shown, pa.string())], schema=out)

    out = pa.schema([("key", pa.binary()), *((m, pa.int64()) for m in MEASURES), ("groups_sha256", pa.string())])
    schema = ", ".join(["key binary", *(f"{m} long" for m in MEASURES), "groups_sha256 string"])
    whole = blocks.drop("pairs", "totals")
    return whole.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(join, schema)


def align(df: DataFrame, path_a: str | None = None, path_b: str | None = None, text_col: str = "text") -> DataFrame:
    """``df`` without its text, with the measures of its alignment; columns of their names are replaced.

    A null or empty text, and one whose tokens' bytes are not those of a space and the text (as with
    U+2581 in it), has zeros and an empty ``groups_sha256``. Repeated rows get equal measures, and each
    counts in the weights of the pairs; of equal counts all are best. An empty table gives an empty one;
    texts of any length are taken whole, and one longer than ``BLOCK_BYTES`` is held alone.
    """
    path_a, path_b = path_a or default_tokenizer(), path_b or default_pieces()
    text = F.col(f"`{text_col}`")
    key = F.unhex(F.sha2(text, 256))
    there = text.isNotNull() & (text != "")
    distinct = df.where(there).groupBy(text.alias("text")).agg(F.count("*").alias("copies"))
    blocks = cut(aligned_blocks(distinct.select(F.unhex(F.sha2("text", 256)).alias("key"), "text", "copies"), path_a, path_b))
    kept = without(df.columns, (*MEASURES, "groups_sha256", text_col))
    name = unused(df.columns, "_key")
    measures = text_measures(blocks, pair_counts(blocks)).withColumnRenamed("key", name)
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.when(there, key).alias(name))
    zero = {m: F.coalesce(m, F.lit(0)) for m in MEASURES} | {"groups_sha256": F.coalesce("groups_sha256", F.lit(""))}
    return rows.join(measures, name, "left").drop(name).withColumns(zero)


def alignment_table(df: DataFrame, path_a: str | None = None, path_b: str | None = None, text_col: str = "text") -> DataFrame:
    """(a, b, count, best) of a table's texts: how often each pair of ids is linked, copies counted."""
    path_a, path_b = path_a or default_tokenizer(), path_b or default_pieces()
    texts = df.where(text_of(text_col) != "").groupBy(F.col(text_col).alias("text")).agg(F.count("*").alias("copies"))
    return pair_counts(cut(aligned_blocks(texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "text", "copies"), path_a, path_b)))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures of the alignment of the two tokenizers of the contract."""
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op13_alignment": op13_alignment}
