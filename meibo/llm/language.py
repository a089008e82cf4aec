"""Language identification by compression with a dictionary per language.

A raw-content zstandard dictionary is filled with sample texts of each language. A text is cut into
blocks, every block is compressed once with each dictionary, and the language with the smallest sum
wins. The score is how much smaller it is than the runner-up; narrow margins are rejected. Only
letters count: case is folded, and whatever stands between words becomes one space.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.llm.common import table, tidy

#: Bytes of sample text in each language's dictionary.
DICT_BYTES = 1 << 17
#: Labelled rows drawn for each language (on average); the fit is bounded by this and by ``DICT_BYTES``.
SAMPLE_ROWS = 400
#: Bytes compressed at once: short enough for the dictionary to count, in long texts too.
BLOCK = 2048
#: zstandard's level: high enough that the sizes of short texts, which differ by few bytes, tell languages apart.
LEVEL = 7
#: Languages that are learned at most; a text is compressed once for each.
MOST_LANGUAGES = 256
#: Below this share of the runner-up's size, a margin is narrow.
MARGIN = 0.01
#: The code for texts that have no language.
NONE = "und"
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}]+")


def letters(text: str) -> bytes:
    """The letters of a text in lower case, one space for each run of anything else."""
    return _OTHER.sub(" ", text).lower().encode("utf-8", "replace")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key: str = "doc_id") -> dict[str, bytes]:
    """A dictionary for each language of the rows that have one.

    About ``SAMPLE_ROWS`` rows of each language are read: those whose key's hash lies in the share of
    the hash range that gives so many, so reruns agree and no language is sorted or gathered whole.
    A sample text counts with a sixteenth of ``DICT_BYTES`` at most. Rows without a text or a language teach
    nothing, an empty table gives an empty model, and over ``MOST_LANGUAGES`` languages are an error.
    """
    rows = labelled.select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("h")
    ).where("lang IS NOT NULL AND length(text) > 0")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, SAMPLE_ROWS / n))])
    drawn = rows.where(F.pmod("h", F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)
    out: dict[str, list] = {lang: [] for lang in sorted(counts)}
    for r in drawn.select("lang", "h", F.substring("text", 1, DICT_BYTES // 16).alias("text")).collect():
        out[r["lang"]].append((r["h"], r["text"]))
    order = sorted(out, key=lambda x: (-counts[x], x))
    return {lang: letters(" ".join(t for _, t in sorted(out[lang])))[:DICT_BYTES] for lang in order}


def classify(df: DataFrame, model: dict[str, bytes], text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``, replacing columns so named.

    A null text or one without a letter is ``und`` with score 0 and is rejected. So is, with its best
    guess kept, a text whose margin is under ``margin``. Case is ignored. Texts of any length are read whole;
    repeated rows get equal answers, and an empty table gives an empty one. Ties go to the language that
    comes first in ``model``, which is the one with the most labelled rows.
    """
    names = ("lang_pred", "score", "rejected")
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    model_b = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as z

        def coder(data: bytes):
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            params = z.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False)
            return z.ZstdCompressor(dict_data=d, compression_params=params).compress

        langs = list(model_b.value)
        coders = [coder(model_b.value[x]) for x in langs]

        def one(text: str | None) -> tuple[str, float, bool]:
            if not langs or text is None or not _LETTER.search(text):
                return NONE, 0.0, True
            data = letters(text)
            # blocks of equal length, the last one not a stump
            n = max(1, round(len(data) / BLOCK))
            cuts = [len(data) * k // n for k in range(n + 1)]
            blocks = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            sizes = sorted((sum([len(c(b)) for b in blocks]), k) for k, c in enumerate(coders))
            best, least = sizes[0][1], sizes[0][0]
            gap = 1 - least / sizes[1][0] if len(sizes) > 1 else 1.0
            return langs[best], gap, gap < margin

        for batch in batches:
            out = [one(t) for t in batch.column(text_col).to_pylist()]
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])

    return df.select(*[f.name for f in kept]).mapInArrow(tidy(run), f"{schema}, lang_pred string, score double, rejected boolean")


def held_out(key: str = "doc_id"):
    """True for the third of the documents that nothing may be learned from; false for a null key."""
    crc = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(crc % 3 == 1, F.lit(False))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    out = classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op9_language": op9_language}
