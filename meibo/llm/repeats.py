"""Windows that a corpus holds more than once, found by way of anchored pieces.

The parts that do not depend on the kind of symbol; see ``substring`` for words and ``suffixes`` for
bytes. A row's identity is a 96-bit hash of its key and text, so a null or repeated key does no
harm, and repeated rows are copies of each other like any other two rows. Pieces are equal if the 64-bit
hashes of their anchors and of their contents are: two of n different pieces are mixed up with odds of
n^2 / 2^129.

What is shuffled: a (anchor, content, copies) row for each different piece, twice; a row for each piece,
once; the documents, once; the text of pieces that share their anchor with a different piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from meibo.llm.anchored import batched, gram_hashes, mix
from meibo.llm.common import cut, tidy

#: Pieces of an anchor from which on its windows are looked up by key, dealt evenly, not in one task.
HOT = 1024
#: Bytes of pieces that a task compares at once, and texts that it cuts pieces from at once.
BLOCK, TEXTS = 1 << 20, 256
#: A span is start << 32 | times << 9 | n: ``times`` pieces of ``n`` window starts each, one after the other.
_N, _TIMES = (1 << 9) - 1, (1 << 23) - 1
_SPAN = "r1 long, r2 int, span long"


@dataclass(frozen=True)
class Kind:
    """Symbols of texts (uint8 or uint64), windows of ``length`` of them, anchors of ``gram``.

    ``cutter(text)`` gives (first, last + 1) -> bytes of these symbols, and ``symbols`` makes an array of
    such bytes, or of a whole text's. ``repeated(pieces, copies)`` flags every window start of the given
    pieces that the pieces hold twice or more, counting copies.
    """

    length: int
    gram: int
    cutter: Callable[[str], Callable[[int, int], bytes]]
    symbols: Callable[[bytes], np.ndarray]
    repeated: Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]]


def identified(df: DataFrame, key: str, text_col: str, own: list[str]) -> DataFrame:
    """(r1, r2, text, c0, c1, ...): identity, text and the columns ``own`` of every row; a null text counts as empty."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    name = F.col(f"`{key}`").cast("string")
    return df.select(
        F.xxhash64(F.lit(0), name, text).alias("r1"),
        F.hash(F.lit(1), text, name).alias("r2"),
        F.col(f"`{text_col}`").alias("text"),
        *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)),
    )


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The elements of all lists end to end, and where each list begins and ends; a null list is empty."""
    sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], dtype=np.int64)
    return column.flatten(), np.concatenate(([0], np.cumsum(sizes)))


def joined_runs(doc: np.ndarray, anchor: np.ndarray, content: np.ndarray, start: np.ndarray, n: np.ndarray):
    """Pieces of equal content that follow each other in a text put together: (which are first, spans)."""
    if not len(doc):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    same = (doc[1:] == doc[:-1]) & (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
    same &= (n[1:] == n[:-1]) & (start[1:] == start[:-1] + n[:-1])
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    times = np.diff(np.append(first, len(doc)))
    while (times > _TIMES).any():  # runs too long for a span are cut in two
        long = np.flatnonzero(times > _TIMES)
        first = np.insert(first, long + 1, first[long] + _TIMES)
        times = np.diff(np.append(first, len(doc)))
    return first, (start[first] << 32) | (times << 9) | n[first]


def all_pieces(docs: DataFrame, kind: Kind) -> DataFrame:
    """(anchor, content, r1, r2, span) of every piece; ``content`` is the hash of its symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, more = xxhash.xxh3_64_intdigest, kind.length - 1
        for batch in batches:
            r1, r2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for low in range(0, batch.num_rows, TEXTS):
                texts = batch.column(2).slice(low, TEXTS).to_pylist()
                parts = [kind.symbols((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                size = parts[0].itemsize
                data = [memoryview(p).cast("B") if len(p) else b"" for p in parts]
                for doc, anchor, _, start, n in batched(parts, kind.length, kind.gram):
                    spans = zip(doc.tolist(), (start * size).tolist(), ((start + n + more) * size).tolist(), strict=True)
                    content = np.array([digest(data[d][a:b]) for d, a, b in spans], dtype=np.uint64).view(np.int64)
                    first, span = joined_runs(doc, anchor, content, start, n)
                    own = doc[first] + low
                    yield _batch({"anchor": anchor[first], "content": content[first], "r1": r1[own], "r2": r2[own], "span": span})

    # no column is ever null, so all joins of the pieces read one shuffle: none has a filter of its own
    types = {"r2": IntegerType()}
    schema = StructType([StructField(c, types.get(c, LongType()), False) for c in ("anchor", "content", "r1", "r2", "span")])
    return docs.select("r1", "r2", "text").mapInArrow(tidy(run), schema)


def window_keys(piece: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window of a piece."""
    s = piece.astype(np.uint64)
    other = mix(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7))
    return gram_hashes(s, length).view(np.int64), gram_hashes(other, length).view(np.int64)


def repeated_runs(docs: DataFrame, kind: Kind) -> DataFrame:
    """(r1, r2, runs): for each identity, the spans of window starts whose window starts anywhere else too.

    A piece that occurs twice is a repeat as a whole. Other pieces are compared with those of the same
    anchor only: by ``kind.repeated`` in a task, or, where an anchor has over ``HOT`` different ones, by
    window keys that are dealt over all tasks.
    """
    pieces = all_pieces(docs, kind)
    times = F.shiftright("span", 9).bitwiseAND(_TIMES)
    seen = pieces.groupBy("anchor", "content").agg(F.sum(times).alias("copies"))
    # an anchor that holds one piece once is done with: nothing in it is repeated
    groups = seen.groupBy("anchor").agg(F.count("*").alias("m"), F.sum("copies").alias("all")).where("all > 1")
    wanted = cut(seen.join(groups.select("anchor", "m"), "anchor").where("m > 1 OR copies > 1"))

    hits = pieces.join(wanted, ["anchor", "content"])
    whole = hits.where("copies > 1").select("r1", "r2", "span")
    # keyed by complements, so that copies are added up before they are dealt anew, however the join was dealt
    one = hits.where("m > 1").groupBy(F.bitwise_not("anchor").alias("na"), F.bitwise_not("content").alias("nc"))
    one = one.agg(F.min(F.struct("r1", "r2", "span")).alias("at"), F.max("copies").alias("copies"), F.max("m").alias("m"))
    salt = F.when(F.col("m") > HOT, F.col("nc").bitwiseOR(1)).otherwise(0)
    piece = F.struct("at.span", F.bitwise_not("na").alias("anchor"), salt.alias("salt"), "copies")
    fetch = one.groupBy("at.r1", "at.r2").agg(F.collect_list(piece).alias("wanted"))

    cut_out = docs.join(fetch, ["r1", "r2"]).mapInArrow(tidy(_cut_out(kind)), f"anchor long, salt long, copies long, {_SPAN}, symbols binary")
    # pieces of hot anchors are dealt one by one, all others anchor by anchor
    # a number of its own, since these rows take more time than their size tells
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut_out = cut_out.repartition(tasks, "anchor", "salt").sortWithinPartitions("anchor", "salt")
    compared = cut_out.mapInArrow(tidy(_compare(kind)), _SPAN)
    many = cut_out.mapInArrow(tidy(_window_rows(kind)), f"k1 long, k2 long, copies long, {_SPAN}")
    twice = many.groupBy("k1", "k2").agg(F.sum("copies").alias("all")).where("all > 1").select("k1", "k2")
    keyed = many.where("copies = 1").join(twice, ["k1", "k2"]).select("r1", "r2", "span")

    runs = whole.unionByName(compared).unionByName(keyed)
    return runs.groupBy("r1", "r2").agg(F.collect_set("span").alias("runs"))


def _cut_out(kind: Kind):
    """Documents with their wanted pieces -> the pieces themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(low, TEXTS)
                flat, ends = lists(batch.column("wanted"))
                span = flat.field("span").to_numpy()
                start, stop = span >> 32, (span >> 32) + (span & _N) + kind.length - 1
                made: list[bytes] = []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    own = slice(ends[k], ends[k + 1])
                    piece = kind.cutter(text)
                    made += [piece(a, b) for a, b in zip(start[own].tolist(), stop[own].tolist(), strict=True)]
                doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                r1, r2 = (batch.column(c).to_numpy()[doc] for c in ("r1", "r2"))
                cols = [flat.field(c) for c in ("anchor", "salt", "copies")] + [pa.array(r1), pa.array(r2), flat.field("span"), pa.array(made, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "salt", "copies", "r1", "r2", "span", "symbols"])

    return run


def _window_rows(kind: Kind):
    """Pieces of hot anchors -> a row for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            hot = whole.filter(pa.array(whole.column("salt").to_numpy() != 0))
            for low in range(0, hot.num_rows, TEXTS):
                batch = hot.slice(low, TEXTS)
                k1, k2 = zip(*(window_keys(kind.symbols(x), kind.length) for x in batch.column("symbols").to_pylist()), strict=True)
                span = batch.column("span").to_numpy()
                n = np.array([len(k) for k in k1])
                row = np.repeat(np.arange(len(n)), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (span >> 32)[row]
                rest = {c: batch.column(c).to_numpy()[row] for c in ("copies", "r1", "r2")}
                yield _batch({"k1": np.concatenate(k1), "k2": np.concatenate(k2), **rest, "span": (at << 32) | (1 << 9) | 1})

    return run


def _compare(kind: Kind):
    """Rows sorted by anchor -> spans of repeated starts of pieces that have no copy; whole anchors at once."""

    def out(rows: pa.Table) -> pa.RecordBatch:
        pieces = [kind.symbols(x) for x in rows.column("symbols").to_pylist()]
        copies = rows.column("copies").to_numpy()
        r1, r2, span = (rows.column(c).to_numpy() for c in ("r1", "r2", "span"))
        row, at, size = [], [], []
        for k, flags in enumerate(kind.repeated(pieces, copies)):
            if copies[k] > 1 or not flags.any():
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
            row.append(np.full(len(edge) // 2, k))
            at.append(edge[::2] + (span[k] >> 32))
            size.append(edge[1::2] - edge[::2])
        row, at, size = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64) for x in (row, at, size))
        return _batch({"r1": r1[row], "r2": r2[row], "span": (at << 32) | (1 << 9) | size})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for whole in batches:
            batch = whole.filter(pa.array(whole.column("salt").to_numpy() == 0))
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            taken = pc.binary_length(batch.column("symbols")).to_numpy()
            ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor)).tolist()
            low = 0
            for end in ends:
                if anchor[low] != last and size > BLOCK:
                    yield out(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(batch.slice(low, end - low))
                size += int(taken[low:end].sum())
                last, low = anchor[low], end
        if held:
            yield out(pa.Table.from_batches(held))

    return run


def covered(runs: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of ``n`` symbols lie in a window that starts in one of the spans."""
    if not len(runs):
        return np.zeros(n, dtype=bool)
    start = runs >> 32
    stop = start + (runs & _N) * ((runs >> 9) & _TIMES) + length - 1
    edge = np.bincount(start, minlength=n + 1) - np.bincount(np.minimum(stop, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def marked(df: DataFrame, kind: Kind, key: str, text_col: str, own: list[str], made: str, one: Callable) -> DataFrame:
    """``own`` and the columns of the schema ``made``, by ``one(text, spans) -> values`` for each row."""
    rest = [c for c in own if c != text_col]
    place = {c: "text" if c == text_col else f"c{rest.index(c)}" for c in own}
    docs = identified(df, key, text_col, rest)
    joined = docs.join(repeated_runs(docs, kind), ["r1", "r2"], "left")
    fields = [df.schema[c] for c in own]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), made])
    new = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(low, TEXTS)
                flat, ends = lists(batch.column("runs"))
                spans = flat.to_numpy(zero_copy_only=False)
                rows = [one(t or "", spans[ends[k] : ends[k + 1]]) for k, t in enumerate(batch.column("text").to_pylist())]
                cols = [pa.array(list(x), t) for x, (_, t) in zip(zip(*rows, strict=True), new, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(place[c]) for c in own), *cols], [*own, *(n for n, _ in new)])

    return joined.select("text", "runs", *(f"c{k}" for k in range(len(rest)))).mapInArrow(tidy(run), schema)


def removed_spans(gone: np.ndarray) -> list[dict]:
    """Maximal runs of removed symbols."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).tolist()
    return [{"first": a, "count": b - a} for a, b in zip(edge[::2], edge[1::2], strict=True)]
