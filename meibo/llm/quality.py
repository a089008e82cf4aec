"""Quality rules: a table of thresholds compiled into one projection of text measures."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.llm.common import let, table, text_of, words_of

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the and of to in is for that it with as was on by at from or an "
    "le la les de des et un une dans que qui pour sur en du "
    "der die das und von mit den dem ein eine für im nicht auf zu "
    "el los las y con por una del se lo"
).split()
SYMBOLS = "[#*$%&|<>]"
#: The rest of a word from its first Latin letter on.
LATIN_WORD = r"[A-Za-zÀ-ÖØ-öø-ɏ][^\x20\x09-\x0D]*"


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [``least``, ``most``]; a bound of None does not hold anything back."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The verdict's thresholds, after the published rules for the MassiveText corpus but for wider word lengths. Each ratio is 0
#: where its divisor is 0. One repeated line is let pass, so that texts of two or three lines are not judged by chance;
#: stop words are looked for among the words of Latin letters, texts without any not being judged by them.
RULES = (
    Rule("n_words", least=50),
    Rule("mean_word_chars", least=2.0, most=15.0),
    Rule("symbol_word_ratio", most=0.1),
    Rule("stop_word_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.3),
    Rule("repeat_word_ratio", most=0.5),
)


def _repeats(words: Column) -> Column:
    """How many words lie in a window of three words that the text holds twice or more.

    Windows are sorted with their positions, so equal ones become neighbours; the positions of those
    are sorted again, and each adds the words that the window before it has not covered.
    """

    def starts(w: Column) -> Column:
        grams = F.array_sort(
            F.transform(
                F.sequence(F.lit(1), F.size(w) - 2),
                lambda i: F.struct(
                    F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("g"),
                    i.alias("i"),
                ),
            )
        )
        return let(grams, twice)

    def twice(s: Column) -> Column:
        equal = lambda a, b: F.get(s, a)["g"] == F.get(s, b)["g"]
        hits = F.filter(s, lambda x, k: F.coalesce(equal(k, k - 1), F.lit(False)) | F.coalesce(equal(k, k + 1), F.lit(False)))
        return F.array_sort(F.transform(hits, lambda x: x["i"]))

    covered = lambda p: F.aggregate(
        p,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(words) >= 4, let(words, lambda w: let(starts(w), covered))).otherwise(0)


def _sum_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the base measures and the ratios that rules can name.

    A null or empty text has no words and all measures 0. Columns of ``df`` that bear a measure's
    name are replaced. Nothing is shuffled and no row is dropped.
    """
    text = text_of(text_col)
    own = "_" * (1 + max([len(c) - len(c.lstrip("_")) for c in df.columns], default=0))  # no column of ``df`` begins so
    t, w, lines = names = f"{own}text", f"{own}words", f"{own}lines"
    staged = df.withColumns({t: text, w: words_of(text), lines: F.split(text, "\n")})
    full = F.filter(F.col(lines), lambda line: F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]+", "")) > 0)
    base = {
        "n_words": F.size(w).cast("long"),
        "word_chars": _sum_chars(F.col(t)).cast("long"),
        "n_symbols": F.regexp_count(F.col(t), F.lit(SYMBOLS)).cast("long"),
        "n_lines": F.size(full).cast("long"),
        "n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
        "n_repeat_words": _repeats(F.col(w)).cast("long"),
        "n_stop_words": F.size(F.filter(F.col(w), lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
        "n_latin_words": F.regexp_count(F.col(t), F.lit(LATIN_WORD)).cast("long"),
    }
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    ratios = {
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_word_ratio": ratio("n_symbols", "n_words"),
        "stop_word_ratio": F.when(F.col("n_latin_words") > 0, F.col("n_stop_words") / F.col("n_latin_words")).otherwise(F.lit(1.0)),
        "dup_line_ratio": F.when(F.col("n_dup_lines") > 1, (F.col("n_dup_lines") - 1) / F.col("n_lines")).otherwise(F.lit(0.0)),
        "repeat_word_ratio": ratio("n_repeat_words", "n_words"),
    }
    return staged.withColumns(base).drop(*names).withColumns(ratios)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: all of ``rules`` hold."""
    tests = []
    for rule in rules:
        if rule.least is not None:
            tests.append(F.col(rule.measure) >= F.lit(rule.least))
        if rule.most is not None:
            tests.append(F.col(rule.measure) <= F.lit(rule.most))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def quality_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with measures, ``base_failed`` and ``kept``.

    ``base_failed``: under 50 words, or over half of them in repeated windows. ``kept`` is false
    then, and else says whether all ``rules`` hold. Rows are independent: repeated rows get equal
    answers, an empty table gives an empty one, and texts of any length are measured whole.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(df, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules applied to every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    tests = " AND ".join(
        t
        for r in RULES
        for t in ([f"{r.measure} >= {r.least}"] if r.least is not None else [])
        + ([f"{r.measure} <= {r.most}"] if r.most is not None else [])
    )
    return f"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, ws, text, lines,
         list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS grams
  FROM t),
e AS (SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM g),
r AS (SELECT doc_id, i FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
p AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM r),
n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
m AS (
  SELECT g.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(ws, lambda w: lower(w) IN ({stop}))) AS n_stop_words,
         len(list_filter(ws, lambda w: regexp_matches(w, '[A-Za-zÀ-ÖØ-öø-ɏ]'))) AS n_latin_words
  FROM g LEFT JOIN n USING (doc_id)),
q AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_word_ratio,
         CASE WHEN n_latin_words > 0 THEN n_stop_words / n_latin_words ELSE 1 END AS stop_word_ratio,
         CASE WHEN n_dup_lines > 1 THEN (n_dup_lines - 1) / n_lines ELSE 0 END AS dup_line_ratio,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_word_ratio,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND ({tests}) AS kept
FROM q
"""


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES = {"op4_quality_rules": _sql()}
