"""Document fingerprints by winnowing, with built-in functions only.

Every run of ``K`` words has a hash; of every ``W`` neighbouring hashes the smallest is kept, the
rightmost of equal ones, with its position. Two texts that share ``K + W - 1`` words in a row share a
fingerprint hash at least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meibo.llm.common import cut, let, table, text_of, words_of

#: Words of a gram, and grams of a window.
K, W = 5, 16
#: Rows in a group of neighbours, about, for finding the next document.
NEIGHBOURS = 256


def gram_hashes(words: Column, k: int = K) -> Column:
    """The hash of every run of ``k`` words; shorter texts have one gram, empty ones none."""

    def of(h: Column) -> Column:
        n = F.greatest(F.size(h) - (k - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(h, i, k)))

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), of)
    return F.when(F.size(words) > 0, hashed).otherwise(F.array().cast("array<bigint>"))


def selected(hashes: Column, w: int = W) -> Column:
    """struct<pos, hash>: two arrays, of every window's smallest hash, rightmost on ties, each position once.

    Fewer than ``w`` hashes make one window. Positions count grams from 0.
    """

    def of(h: Column) -> Column:
        last = F.greatest(F.size(h) - w, F.lit(0))

        def pick(i: Column) -> Column:
            # reversed, so the first position of the smallest is the rightmost one
            right = lambda r: F.size(r) - F.array_position(r, F.array_min(r)).cast("int")
            return i + let(F.reverse(F.slice(h, i + 1, w)), right)

        picked = F.array_distinct(F.transform(F.sequence(F.lit(0), last), pick))
        return let(picked, lambda p: F.struct(p.alias("pos"), F.transform(p, lambda i: F.get(h, i)).alias("hash")))

    none = F.struct(F.array().cast("array<int>").alias("pos"), F.array().cast("array<bigint>").alias("hash"))
    return let(hashes, lambda h: F.when(F.size(h) > 0, of(h)).otherwise(none))


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """struct<pos, hash> of a text, two arrays; empty ones for a text without words."""
    return let(words_of(text), lambda x: selected(gram_hashes(x, k), w))


def shown(marks: Column) -> Column:
    """A fingerprint as text: position and hash in hex, joined by commas."""
    return F.array_join(F.zip_with(marks["pos"], marks["hash"], lambda p, h: F.concat(p.cast("string"), F.lit(":"), F.hex(h))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of two arrays without repeats over all their hashes; 1 if both are empty."""
    same = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - same
    return F.when(every == 0, F.lit(1.0)).otherwise(same / every)


def with_neighbours(df: DataFrame, key: str, order_by: str) -> DataFrame:
    """``df`` with ``_g`` and ``_extra``: groups of neighbouring keys, each with a copy of the row that opens the next.

    The last group gets the very first row, so within a group every row that is not extra is followed
    by its next row. A group is a stretch of keys that holds about ``NEIGHBOURS`` rows if keys are spread evenly,
    dense or sparse; null keys, which come first, are dealt by the hash of ``order_by``, the order among them.
    No window holds all groups.
    """
    found = df.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("n"), F.count("*").alias("rows")).first()
    step = max(1, -(-((found["high"] or 0) - (found["low"] or 0) + 1) // max(1, found["n"] // NEIGHBOURS)))
    parts = max(1, (found["rows"] - found["n"]) // NEIGHBOURS)
    place = F.col(key).cast("decimal(20, 0)") - F.lit(found["low"] or 0).cast("decimal(20, 0)")
    spread = F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * parts) - F.lit(parts + 1)
    group = F.when(F.col(key).isNull(), spread).otherwise(F.floor(place / F.lit(step).cast("decimal(20, 0)"))).cast("long")
    rows = df.withColumn("_h", F.xxhash64(order_by)).withColumns({"_g": group, "_extra": F.lit(0)})
    opening = F.min_by(F.struct(*df.columns, "_h"), F.struct(F.coalesce(key, F.lit(-(1 << 63))), "_h", order_by)).alias("row")
    heads = cut(rows.groupBy("_g").agg(opening))
    ids = heads.select("_g", F.floor(F.col("_g") / 4096).alias("_t"))
    lowest = ids.agg(F.min("_g")).first()[0]
    tops = ids.groupBy("_t").agg(F.min("_g").alias("_head"))
    tops = tops.withColumn("_after", F.lead("_head").over(Window.orderBy("_t"))).drop("_head")
    following = F.lead("_g").over(Window.partitionBy("_t").orderBy("_g"))
    follow = ids.withColumn("_next", following).join(tops, "_t")
    follow = follow.select("_g", F.coalesce("_next", "_after", F.lit(lowest)).alias("_next"))
    extra = follow.join(heads.select(F.col("_g").alias("_next"), "row"), "_next")
    return rows.unionByName(extra.select("row.*", "_g", F.lit(1).alias("_extra")))


def compared_with_next(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, which ends with the start of the next text.

    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. The
    next row is the one of the next higher key; the last row's is the first. A null text is empty, a
    null key comes before all, and rows of equal keys follow each other by the hash of their text. A single row is its
    own next. Empty fingerprints are alike. Repeated rows count each for itself, texts of any length are
    taken whole, an empty table gives an empty one, and other columns are left out.
    """
    docs = df.select(F.col(key).alias("id"), text_of(text_col).alias("text"))
    # dealt before they are marked, so that texts alone are shuffled
    marked = with_neighbours(docs, "id", "text").repartition("_g").withColumn("marks", fingerprint(F.col("text")))
    order = Window.partitionBy("_g").orderBy("_extra", F.col("id").asc_nulls_first(), "_h", "text")
    following = F.struct("text", F.col("marks")["hash"].alias("hash"))
    paired = marked.withColumn("next", F.lead(following).over(order)).where("_extra = 0")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    out = paired.withColumns({"edited": edited, "n_chars": n.cast("long")}).withColumns(
        {"edited_sha256": F.sha2("edited", 256), "edited_marks": fingerprint(F.col("edited"))}
    )
    hashes = lambda c: F.array_distinct(F.col(c))
    return out.select(
        F.col("id").alias(key),
        "n_chars",
        "edited_sha256",
        shown(F.col("marks")).alias("fingerprint"),
        shown(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(hashes("marks.hash"), hashes("edited_marks.hash")).alias("near_edited"),
        likeness(hashes("marks.hash"), hashes("next.hash")).alias("near_next"),
    )


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return compared_with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op3_winnowing": op3_winnowing}
