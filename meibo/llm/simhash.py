"""SimHash near-duplicates, found by covering the fingerprints with anchor points.

A view is a choice of fingerprint bits. The 64 bits are cut into blocks so that two fingerprints that
differ in at most ``BITS`` bits differ in at most one bit of some view. In a view, 15 bits are covered
by the code words of the perfect [15, 11] Hamming code (covering radius 1) and each pattern of the
remaining bits is a point of its own; an anchor is a pair of both. A fingerprint's home is the nearest
anchor; a fingerprint one bit away from it lies within covering radius plus one of the same anchor. So
every fingerprint is copied to all anchors within that distance, and compared per anchor.

Equal fingerprints are one before anything is compared. A task links the fingerprints of an anchor to
the smallest one they reach there, so it emits a row for each at most, not all pairs. An anchor that
is home to very many fingerprints is dealt to several tasks, each comparing a part of the homes
with everything copied there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.llm.common import cut, table, tidy
from meibo.llm.components import components

SHINGLE, SEED, BITS = 4, 42, 4
#: Homes of an anchor above which it is dealt to several tasks.
HOT = 4096
#: Distinct fingerprints from which on finer anchors are used.
MANY = 1 << 24


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's word shingles as a signed long; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1 :] or ends[-1:]
    h = np.array([xxh64_intdigest(data[a:b], SEED) for a, b in zip(starts[:n], last, strict=True)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        counts += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``fp`` (long) in place of the text column and of any column of that name."""
    kept = [f for f in df.schema.fields if f.name not in ("fp", text_col)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t) for t in batch.column(text_col).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], [*batch.schema.names[:-1], "fp"])

    return df.select(*[f.name for f in kept], text_col).mapInArrow(tidy(run), schema)


def views(n: int) -> list[list[int]]:
    """Bit positions of each view. Four differing bits leave one of 3 blocks, or two of 5, with one at most."""
    cut_at = lambda m: [list(range(64 * k // m, 64 * (k + 1) // m)) for k in range(m)]
    return cut_at(3) if n < MANY else [a + b for a, b in combinations(cut_at(5), 2)]


def _hamming() -> tuple[np.ndarray, np.ndarray]:
    """For every 15-bit word: its code word, and the code words within distance 2 (itself repeated to fill up)."""
    x = np.arange(1 << 15)
    syndrome = np.zeros_like(x)
    for k in range(15):
        syndrome ^= np.where(x >> k & 1, k + 1, 0)
    home = np.where(syndrome > 0, x ^ (1 << np.maximum(syndrome - 1, 0)), x)
    near = [home]
    for i in range(15):
        j = syndrome ^ (i + 1)  # flipping bits i and j - 1 gives a code word
        pair = (syndrome > 0) & (j > i + 1)
        near.append(np.where(pair, x ^ (1 << i) ^ (1 << np.maximum(j - 1, 0)), home))
    return home, np.stack(near, axis=1)


def anchors_of(fp: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Anchor numbers of fingerprints in a view: (homes, all within reach), the latter with repeats."""
    home, near = _hamming()
    u = fp.view(np.uint64)
    value = np.zeros(len(u), dtype=np.int64)
    for k, bit in enumerate(bits):
        value |= ((u >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    word, raw = value & 0x7FFF, value >> 15 << 15
    first = home[word] | raw
    flips = np.stack([first ^ (1 << k) for k in range(15, len(bits))], axis=1)
    return first, np.concatenate([near[word] | raw[:, None], flips], axis=1)


def _copies(fps: DataFrame, kinds: list[list[int]]) -> DataFrame:
    """(view, anchor, fp, home) for every anchor within a fingerprint's reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for k, bits in enumerate(kinds):
                home, reach = anchors_of(fp, bits)
                reach = np.sort(reach, axis=1)
                fresh = np.ones(reach.shape, dtype=bool)
                fresh[:, 1:] = reach[:, 1:] != reach[:, :-1]
                row, col = np.nonzero(fresh)
                anchor = reach[row, col]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), k, np.int32)), pa.array(anchor), pa.array(fp[row]), pa.array(anchor == home[row])],
                    ["view", "anchor", "fp", "home"],
                )

    return fps.select("fp").mapInArrow(tidy(run), "view int, anchor long, fp long, home boolean")


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= BITS


def local_links(group: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows sorted by ``group``: each fingerprint to the smallest that it reaches in its group."""
    n, u = len(fp), fp.view(np.uint64)
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(start, n))
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    small = np.repeat(size <= 64, size)
    for d in range(1, 64):
        left = np.flatnonzero(small[: n - d] & (group[: n - d] == group[d:]))
        if not len(left):
            break
        left = left[(home[left] | home[left + d]) & _near(u[left], u[left + d])]
        ends.append((left, left + d))
    label = np.arange(n)

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            low = np.minimum(label[a], label[b])
            if (low == label[a]).all() and (low == label[b]).all():
                return
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label[:] = label[label]

    if ends:
        settle(np.concatenate([a for a, _ in ends]), np.concatenate([b for _, b in ends]))
    for s, k in zip(start[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        for h in range(s, s + k, 512):
            own = np.flatnonzero(home[h : min(h + 512, s + k)]) + h
            for m in range(s, s + k, 4096):
                i, j = np.nonzero(_near(u[own][:, None], u[m : min(m + 4096, s + k)][None, :]))
                settle(own[i], j + m)
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def links(fps: DataFrame, n: int) -> DataFrame:
    """(a, b): links enough to join all of the distinct fingerprints ``fp`` that differ in ``BITS`` bits or fewer."""
    copies = _copies(fps, views(n))
    hot = copies.where("home").groupBy("view", "anchor").count().where(F.col("count") > HOT)
    hot = cut(hot.select("view", "anchor", F.ceil(F.col("count") / HOT).cast("int").alias("parts")))
    if not hot.isEmpty():
        copies = copies.join(hot, ["view", "anchor"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        copies = copies.select("view", "anchor", "fp", "home", "parts", part)
        copies = copies.withColumn("home", F.col("home") & (F.pmod(F.xxhash64("fp"), "parts") == F.col("part")))
    else:
        copies = copies.withColumn("part", F.lit(0))
    key = ("view", "anchor", "part")
    dealt = copies.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def out(rows: pd.DataFrame) -> pd.DataFrame:
            group = rows.groupby(list(key), sort=False).ngroup().to_numpy()
            a, b = local_links(group, rows["fp"].to_numpy(), rows["home"].to_numpy())
            return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = rows.iloc[-1]
            same = ((rows["view"] == last["view"]) & (rows["anchor"] == last["anchor"]) & (rows["part"] == last["part"])).to_numpy()
            first = int(np.argmax(same))  # rows from here on may go on in the next batch
            held = rows.iloc[first:]
            if first:
                yield out(rows.iloc[:first])
        if held is not None:
            yield out(held)

    return dealt.mapInPandas(run, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, fp, component): ``component`` is the smallest key reachable over linked fingerprints.

    Null and wordless texts have fingerprint 0 and are linked like any other. Repeated rows stay.
    An empty table gives an empty one. Null keys are kept but never a component's name while the
    component has another key.
    """
    docs = cut(with_fingerprint(df.select(F.col(key).alias("id"), F.col(text_col).alias("text"))))
    classes = cut(docs.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(classes, classes.count()).distinct())
    joined = classes.join(found, classes["fp"] == found["node"])
    names = joined.groupBy("component").agg(F.min("least").alias("name"))
    named = joined.select("fp", "component").join(names, "component").select("fp", "name")
    final = classes.join(named, "fp", "left").select("fp", F.coalesce("name", "least").alias("component"))
    return docs.join(cut(final), "fp").select("id", "fp", "component").withColumnRenamed("id", key)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op5_simhash": op5_simhash}
