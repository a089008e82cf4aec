"""Divergence of the sources of each language: how far apart two sources' words are, and which words tell a source.

Equal texts of a language are put together first, with the number of copies in each source: once within
each batch of a task, then by one shuffle of the texts that are left. Each distinct text is cut into terms
once, and its counts are weighted by the copies. What follows works on terms that a language keeps.

A pair of sources is evaluated on the terms that either has, by counts rather than term by term: terms
with the same two counts add the same, so they are counted first; a term that only one has adds what
depends on its count and on the other source's share of a missing term; all other terms add the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meibo.llm.common import cut, table, tidy

#: Documents of a language that a term must occur in to be kept, and how many terms are reported for a source.
LEAST_DOCS, TERMS = 10, 10
#: Shares are whole numbers of this.
UNIT = 1_000_000_000
#: Bytes of text that are cut into terms together, about; a longer text is taken alone.
SLICE_BYTES = 8 << 20
#: Bytes by what they stand for: 0 between terms, else the byte in lower case (A to Z only).
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal rows of some columns together, and where each run of them begins."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(new)


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def collapsed(df: DataFrame) -> DataFrame:
    """(lang, text, sources): each text of a language once, with ``sources`` (source, n) that hold it, of ``df`` (lang, source, text).

    The copies of a batch are counted before the shuffle, so a text that fills a third of all rows is
    sent once for each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (lang, _), (source, sources), (text, _) = (_codes(batch.column(c)) for c in ("lang", "source", "text"))
            order, new = _runs(lang, text, source)
            n = np.diff(np.append(new, len(order)))
            first = order[new]
            texts, starts = _runs(lang[first], text[first])  # already in order
            held = pa.StructArray.from_arrays([sources.take(pa.array(source[first])), pa.array(n)], ["source", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(texts)), pa.int32()), held)
            rows = pa.array(first[starts])
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(rows), batch.column("text").take(rows), lists], ["lang", "text", "sources"])

    held = df.select("lang", "source", "text").mapInArrow(tidy(run), "lang string, text string, sources array<struct<source:string,n:long>>")
    each = held.repartition("lang", "text").select("lang", "text", F.inline("sources"))
    once = each.groupBy("lang", "text", "source").agg(F.sum("n").alias("n"))  # both by the shuffle above
    return once.groupBy("lang", "text").agg(F.collect_list(F.struct("source", "n")).alias("sources"))


def _terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number of each distinct term of a text, its code, how often) over some texts, and the terms by code."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    lower = _LOWER[data]
    inside = lower != 0
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    code, terms = _codes(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(lower[inside].tobytes())]))
    text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
    return text, code, terms


def term_counts(texts: DataFrame) -> DataFrame:
    """(lang, term, docs, total, held): how many of a language's documents have a term and how often, and ``held`` (source, n), of ``collapsed`` texts.

    A slice of texts sends a term once, with the counts in all sources that have it there, so no term is
    sent more often than there are slices; one shuffle by language and term serves both sums.
    """
    names = ("source", "n", "docs")

    def counted(rows: list[tuple[str, bytes, list[dict]]]) -> pa.RecordBatch:
        text, code, terms = _terms([r[1] for r in rows])
        order, new = _runs(text, code)
        often, own, term = np.diff(np.append(new, len(order))), text[order[new]], code[order[new]]
        # each source that holds a text, after one another
        lang, langs = _codes(pa.array([r[0] for r in rows]))
        width = np.array([len(r[2]) for r in rows])
        source, sources = _codes(pa.array([s["source"] for r in rows for s in r[2]], pa.string()))
        copies = np.array([s["n"] for r in rows for s in r[2]], dtype=np.int64)
        size = width[own]
        at = np.repeat((np.cumsum(width) - width)[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        lang, source, term = np.repeat(lang[own], size), source[at], np.repeat(term, size)
        order, new = _runs(lang, term, source)
        sums = [np.add.reduceat(v[order], new) if len(new) else v for v in (np.repeat(often, size) * copies[at], copies[at])]
        lang, source, term = (v[order[new]] for v in (lang, source, term))  # in order of language and term
        _, starts = _runs(lang, term)
        held = pa.StructArray.from_arrays([sources.take(pa.array(source)), *(pa.array(s, pa.int64()) for s in sums)], list(names))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(term)), pa.int32()), held)
        words = terms.take(pa.array(term[starts])).cast(pa.large_string()).cast(pa.string())
        return pa.RecordBatch.from_arrays([langs.take(pa.array(lang[starts])), words, lists], ["lang", "term", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                lang, text, sources = row
                rows.append((lang.as_py(), text.as_py().encode(), sources.as_py()))
                size += len(rows[-1][1])
                if size > SLICE_BYTES:
                    yield counted(rows)
                    rows, size = [], 0
        if rows:
            yield counted(rows)

    each = texts.select("lang", "text", "sources").mapInArrow(tidy(run), "lang string, term string, held array<struct<source:string,n:long,docs:long>>")
    each = each.repartition("lang", "term").select("lang", "term", F.inline("held")).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("held"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """A term's smoothed share of a group's words, in whole units, exact for counts of any size; 1 if the group's language keeps no term."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.coalesce(1 + F.call_function("div", top, F.nullif(total + 2 * terms, F.lit(0)).cast("decimal(20,0)")), F.lit(1))


def apart(p: Column, q: Column) -> Column:
    """What a term with two shares adds to a divergence, rounded down."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(df: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): the audit of the sources of each language.

    Rows of part ``pair`` give each other source of the language and how far its words are from the
    source's; rows of part ``term`` the terms that the source uses most beyond its language's share. Ranks
    go by value, then by the item's bytes. Null texts, languages and sources count as empty ones.
    Repeated rows are documents of their own. A source without terms, or a language that keeps none, has
    pairs too (of value 0 in the latter); a language's only source has no pair. An empty table gives no
    rows; texts of any length are taken whole; other columns are not looked at.
    """
    named = {"lang": lang_col, "source": source_col, "text": text_col}
    docs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in named.items()])
    by_term = cut(term_counts(collapsed(docs)).where(F.col("docs") >= least_docs))
    langs = by_term.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_total"))
    each = by_term.select("lang", "term", F.col("total").alias("lang_n"), F.inline("held"))
    own = each.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count("*").alias("kept"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = cut(groups.na.fill(0, ["words", "kept", "v", "lang_total"]).withColumn("none", share(F.lit(0), F.col("words"), F.col("v"))))

    p, q = share(F.col("n"), F.col("words"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    scored = each.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    told = scored.select("lang", "source", F.lit("term").alias("part"), "item", apart(F.col("p"), F.col("q")).alias("value")).withColumn("rank", place).where(F.col("rank") <= terms)

    def side(name: str) -> DataFrame:
        return groups.select("lang", *[F.col(c).alias(f"{c}_{name}") for c in ("source", "words", "kept", "v", "none")])

    def of(n: str, name: str) -> Column:
        return share(F.col(n), F.col(f"words_{name}"), F.col(f"v_{name}"))

    # terms that both have, by their counts; the share of a missing term is taken back, being counted for both below
    two = by_term.select("lang", F.inline("held").alias("source_a", "n_a"), "held").select("lang", "source_a", "n_a", F.inline("held").alias("source_b", "n_b"))
    two = two.where("source_a < source_b").groupBy("lang", "source_a", "source_b", "n_a", "n_b").agg(F.count("*").alias("m"))
    two = two.join(side("a"), ["lang", "source_a"]).join(side("b"), ["lang", "source_b"])
    p_a, p_b, none_a, none_b = of("n_a", "a"), of("n_b", "b"), F.col("none_a"), F.col("none_b")
    extra = apart(p_a, p_b) - apart(p_a, none_b) - apart(none_a, p_b) + apart(none_a, none_b)
    shared = two.select("lang", "source_a", "source_b", (F.col("m") * extra).alias("value"))
    # terms that the first has, as if the second had none
    first = each.groupBy("lang", F.col("source").alias("source_a"), F.col("n").alias("n_a")).agg(F.count("*").alias("m"))
    first = first.join(side("a"), ["lang", "source_a"]).join(side("b"), "lang").where("source_a <> source_b")
    either = first.select("lang", F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b"), (F.col("m") * apart(p_a, none_b)).alias("value"))
    # and the rest
    rest = side("a").join(side("b"), "lang").where("source_a < source_b")
    rest = rest.select("lang", "source_a", "source_b", ((F.col("v_a") - F.col("kept_a") - F.col("kept_b")) * apart(none_a, none_b)).alias("value"))
    pairs = shared.unionByName(either).unionByName(rest).groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    ways = F.inline(F.array(*[F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item")) for x, y in ("ab", "ba")]))
    pairs = pairs.select("lang", "value", ways).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", place)
    return pairs.unionByName(told)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return divergence(table(spark, sf_dir, "documents"))


#: Terms by regular expressions, shares and divergences term by term over every pair of sources.
_SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT lang, source, r, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS lang_n FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
    SELECT *, 1 + {UNIT} * (n + 2) // (sum(n) OVER s + 2 * count(*) OVER s) AS p, 1 + {UNIT} * (lang_n + 2) // (sum(lang_n) OVER s + 2 * count(*) OVER s) AS q
    FROM every WINDOW s AS (PARTITION BY lang, source)
),
pair AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    GROUP BY ALL
),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL
SELECT * FROM (
    SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term
) WHERE rank <= {TERMS}
"""

QUERIES = {"op12_divergence": op12_divergence}
ORACLES = {"op12_divergence": _SQL}
