"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are dealt by hash to blocks of bounded size, and the blocks of a source
have a random order. A source's target says how often all its blocks are taken and how many more
words are drawn from the front of that order: its quota of block draws. The quotas of all sources are
then split among output shards by a binary tree: at each node the draws of the left half are a
multivariate-hypergeometric sample without replacement, so all shards are alike and the quotas are met
exactly. A shard walks from the root to its leaf alone, its random numbers coming from the node's
number, and so finds which draws of each source are its own. What a document gives to the mix is the sum
over the shards' draws of its block. Within a shard, rows are shuffled locally.

What reaches the driver is one row for each source, at most ``MAX_SOURCES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meibo.llm.common import cut, row_values, table, text_of

#: Weights by a source's place, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix as a share of all words, and the most that a source is repeated.
SHARE, MOST = 1.5, 2.0
#: Documents in a block, on average, and the most blocks, beyond which blocks grow (random draws take up to 10^9).
BLOCK_DOCS, MOST_BLOCKS = 64, 1 << 26
#: Words in an output shard, about.
SHARD_WORDS = 1 << 22
MAX_SOURCES = 100_000
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Target words of sources in their order: ``share`` of all words by weight.

    A target stops at ``most`` times its source; what is over is shared by weight among the others,
    until none is above.
    """
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        unit = left / sum(w[k] for k in sorted(free))
        full = [k for k in sorted(free) if w[k] * unit >= most * sizes[k]]
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
        free -= set(full)
        if not full:
            for k in free:
                out[k] = w[k] * unit
            break
    return out


def tree_shares(quotas: list[int], shards: int, shard: int, seed: int = SEED) -> list[tuple[int, int]]:
    """(first draw, draws) of each source for one of ``shards`` shards."""
    import numpy as np

    have, first, low, high, node = np.array(quotas, dtype=np.int64), np.zeros(len(quotas), dtype=np.int64), 0, shards, 1
    while high - low > 1:
        mid = (low + high) // 2
        n = int(have.sum()) * (mid - low) // (high - low)
        left = np.random.default_rng([seed, node]).multivariate_hypergeometric(have, n, method="marginals")
        if shard < mid:
            have, high, node = left, mid, 2 * node
        else:
            have, first, low, node = have - left, first + left, mid, 2 * node + 1
    return list(zip(first.tolist(), have.tolist(), strict=True))


class Mix:
    """The mix of ``df``: ``taken`` has a row for each input row, ``rows`` one for each copy taken.

    ``key`` and ``source_col`` name the columns of identity and source; a null source is a source of
    its own, the last. A null or empty text has size 0 and is taken in no word. Repeated rows count
    each for itself, and rows that differ in what is null are different ones. An empty table gives an empty
    mix; of texts of any length only sizes and hashes are carried, until ``rows`` writes them.
    """

    def __init__(self, df: DataFrame, key: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED):
        self.spark, self.df, self.key, self.source_col, self.text_col, self.seed = df.sparkSession, df, key, source_col, text_col, seed
        source = F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
        size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
        own = row_values(df.columns)
        self.identity = (F.xxhash64(F.lit(seed), *own).alias("h"), F.hash(F.lit(seed), *own).alias("h2"))
        self.sized = cut(df.select(F.col(key).alias("id"), source.alias("src"), size.alias("size"), *self.identity))
        self._plan()

    def _plan(self) -> None:
        totals = self.sized.groupBy("src").agg(F.sum("size").alias("words"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
        if len(totals) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        totals = sorted(totals, key=lambda r: (r["src"] == "", r["src"]))
        goal = targets([r["words"] for r in totals])
        block_docs = max(BLOCK_DOCS, -(-sum(r["docs"] for r in totals) // MOST_BLOCKS))
        plan = []
        for r, t in zip(totals, goal, strict=True):
            quota = round(t)
            whole, rest = divmod(quota, r["words"]) if r["words"] else (0, 0)
            blocks = -(-r["docs"] // block_docs)
            plan.append((r["src"], r["words"], float(t), whole, rest, blocks, max(1, round(blocks**0.5))))
        schema = "src string, source_size long, target double, whole long, rest long, n_blocks long, n_groups long"
        self.sources = F.broadcast(self.spark.createDataFrame(plan, schema))
        self.dealt = self.sized.join(self.sources, "src").withColumn("block", F.pmod("h", "n_blocks"))
        self.blocks = cut(self._ordered_blocks())
        self._share_out([p[0] for p in plan], [p[3] for p in plan])

    def _ordered_blocks(self) -> DataFrame:
        """Blocks with their place in the random order and the words before them.

        Sums run over groups of neighbouring blocks first, then within a group, so that no task sees
        all blocks of a source.
        """
        u = F.xxhash64(F.lit(self.seed + 1), F.col("src"), F.col("block"))
        blocks = (
            self.dealt.groupBy("src", "block", "whole", "rest", "n_groups")
            .agg(F.sum("size").alias("words"))
            .withColumn("u", u)
            .withColumn("g", F.floor((F.col("u") / F.lit(2.0**64) + 0.5) * F.col("n_groups")))
        )
        over = Window.partitionBy("src").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
        groups = blocks.groupBy("src", "g").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
        before = lambda c: F.coalesce(F.sum(c).over(over), F.lit(0))
        groups = groups.select("src", "g", before("w").alias("w0"), before("n").alias("n0"))
        within = Window.partitionBy("src", "g").orderBy("u", "block").rowsBetween(Window.unboundedPreceding, -1)
        inside = lambda c: F.coalesce(F.sum(c).over(within), F.lit(0))
        return blocks.join(groups, ["src", "g"]).select(
            "src",
            "block",
            "whole",
            "words",
            (F.col("n0") + inside(F.lit(1))).alias("place"),
            # words of the block that the last, partial pass takes
            F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("w0") - inside("words"))).alias("part"),
        )

    def _share_out(self, sources: list[str], whole: list[int]) -> None:
        """``draws``: (src, block, pass, shard) of every draw of a block."""
        found = self.blocks.groupBy("src").agg(F.count("*").alias("n"), F.count_if(F.col("part") > 0).alias("k")).collect()
        n = {r["src"]: (r["n"], r["k"]) for r in found}
        quotas = [w * n[s][0] + n[s][1] for s, w in zip(sources, whole, strict=True)]
        words = self.sized.agg(F.sum("size")).first()[0] or 0
        shards, seed = max(1, -(-int(SHARE * words) // SHARD_WORDS)), self.seed

        def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for shard in batch["id"]:
                    own = tree_shares(quotas, shards, int(shard), seed)
                    yield pd.DataFrame(
                        [(int(shard), sources[k], a, a + c - 1) for k, (a, c) in enumerate(own) if c],
                        columns=["shard", "src", "a", "b"],
                    )

        runs = self.spark.range(shards).mapInPandas(leaves, "shard int, src string, a long, b long")
        owned = runs.select("shard", "src", F.explode(F.sequence("a", "b")).alias("draw"))
        size = self.blocks.groupBy("src").agg(F.count("*").alias("n"))
        last = F.when(F.col("part") > 0, F.col("whole")).otherwise(F.col("whole") - 1)
        draws = (
            self.blocks.join(F.broadcast(size), "src")
            .where(last >= 0)
            .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .withColumn("draw", F.col("pass") * F.col("n") + F.col("place"))
        )
        words = F.when(F.col("pass") == F.col("whole"), F.col("part")).otherwise(F.col("words"))
        self.draws = draws.join(owned, ["src", "draw"]).select("src", "block", "pass", "shard", words.alias("drawn"), "words")

    def taken(self) -> DataFrame:
        """(id, src, block, h, h2, size, source_size, target, taken, shards) of every input row.

        ``shards`` are those that draw its block; ``taken`` sums what it gives to them: all its words to a
        draw of the whole block, and to a draw of a part those that come first in the block's order.
        """
        partial = F.col("drawn") < F.col("words")
        drawn = self.draws.groupBy("src", "block").agg(
            F.count_if(~partial).alias("times"),
            F.coalesce(F.max(F.when(partial, F.col("drawn"))), F.lit(0)).alias("part"),
            F.array_sort(F.collect_list(F.struct("pass", "shard")))["shard"].alias("shards"),
        )
        docs = self.dealt.join(drawn, ["src", "block"], "left")
        order = Window.partitionBy("src", "block").orderBy("h", "h2").rowsBetween(Window.unboundedPreceding, -1)
        some = docs.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
        part = F.greatest(F.lit(0), F.least("size", F.coalesce("part", F.lit(0)) - F.col("before")))
        taken = F.coalesce("times", F.lit(0)) * F.col("size") + part
        return some.select("id", "src", "block", "h", "h2", "size", "source_size", "target", taken.alias("taken"), "shards")

    def rows(self) -> DataFrame:
        """The mix itself: the columns of the input, one row for each copy, by shard and shuffled in it.

        Whole documents are written: one that is taken in part is written if half of it is taken.
        """
        copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
        mine = self.taken().where("size > 0").withColumn("copies", copies).where("copies > 0")
        mine = mine.select(F.col("h").alias("m"), F.col("h2").alias("m2"), F.posexplode(F.slice("shards", 1, "copies")).alias("pass", "shard"))
        own = self.df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(self.df.columns)), *self.identity)
        own = own.where(F.regexp_like(text_of(f"c{self.df.columns.index(self.text_col)}"), F.lit(r"[^\x20\x09-\x0D]")))
        # rows of one identity are equal, so one of them stands for all that is drawn
        each = own.dropDuplicates(["h", "h2"]).join(mine, (F.col("h") == F.col("m")) & (F.col("h2") == F.col("m2")))
        mixed = each.repartition("shard").sortWithinPartitions("shard", F.xxhash64(F.lit(self.seed), "h", "pass"), "pass")
        return mixed.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(self.df.columns)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix of all documents takes."""
    mix = Mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix.taken().select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "shards")


QUERIES = {"op7_mixing": op7_mixing}
