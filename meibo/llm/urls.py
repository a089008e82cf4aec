r"""URL filters: pattern rules that block or allow addresses, with built-in functions only.

Every rule is indexed under one word of its pattern that no matching address can lack: of those, the one
that the table's addresses hold least often. An address's words fetch the rules that are indexed under
them, and only those run their regular expressions.

A pattern is matched against ``//host/path?query`` (the host in lower case, no fragment):

- ``||host/path`` fits the host and its subdomains, if the path starts with the pattern's; case counts.
- Any other pattern fits anywhere, capitals A to Z or not. ``*`` is any run of characters, ``^`` one
  character that is no ASCII letter or digit, or the end.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meibo.llm.common import table, unused, without

#: (pattern, verdict) of hosts and paths with a verdict of their own; they come before all other patterns.
CONTRACT_RULES = (("||net/", "block"), ("||example.net/en/", "allow"), ("||example.com/de/", "block"), ("||org/fr/", "allow"))
#: (pattern, verdict) of addresses whose pages are no good training data: betting, pills, adult matter, loans, shops' and logins' forms, feeds.
DEFAULT_RULES = tuple((p, "block") for p in (
    "^casino^", "^casinos^", "^bet^", "^bets^", "^betting^", "^poker^", "^slots^", "^jackpot^", "^pills^", "^pharmacy^", "^viagra^", "^cialis^", "^porn^", "^xxx^", "^sex^",
    "^escort^", "^payday^loan*", "^quick^loans^", "^replica^watches^", "^torrent^", "^warez^", "^adserver^", "/ads/*", "/wp-login.php^", "/xmlrpc.php^", "/cart/*", "/checkout/*",
    "^action=login^", "^sessionid=*", "^phpsessid=*", "/feed/^", "^replytocom=*",
)) + (("^wiki/casino^", "allow"),)
#: The verdict where no rule fits.
OTHERWISE = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query with its mark) of an address; empty where it is null or has no ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    cut = lambda group: F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)(\?[^#]*)?", group)
    return lower_ascii(cut(1)), cut(2), cut(3)


def words_of(subject: Column) -> Column:
    """The distinct words of an address (runs of ASCII letters and digits, in lower case), and the empty one, which every address has."""
    return F.array_distinct(F.concat(F.split(lower_ascii(subject), "[^a-z0-9]+"), F.array(F.lit(""))))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str]], level: int = 0) -> DataFrame:
    """(pattern, verdict, level) of a list of rules."""
    rows = json.dumps([{"pattern": p, "verdict": v, "level": level} for p, v in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<pattern:string,verdict:string,level:int>>")))


def compiled(rules: DataFrame) -> DataFrame:
    """``rules`` with ``regex`` and ``words``: the words of the pattern that stand by themselves in every matching address."""
    pattern = F.col("pattern")
    anchored, rest = pattern.startswith("||"), F.regexp_replace("pattern", r"^\|\|", "")
    quoted = lambda c, kept: F.regexp_replace(c, rf"([^A-Za-z0-9/{kept}\x{{80}}-\x{{10FFFF}}])", r"\\$1")
    free = F.replace(F.replace(quoted(pattern, "*^"), F.lit("*"), F.lit(".*")), F.lit("^"), F.lit("(?:[^A-Za-z0-9]|$)"))
    regex = F.when(anchored, F.concat(F.lit("^//(?:[^/?#]*\\.)?"), quoted(rest, ""))).otherwise(F.concat(F.lit("(?is)"), free))
    edged = F.when(anchored, F.concat(F.lit("/"), rest)).otherwise(pattern)
    # a * in an anchored pattern is a character like any other, but a word beside it is left alone all the same
    words = F.regexp_extract_all(lower_ascii(edged), F.lit("(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), F.lit(1))
    return rules.withColumns({"regex": regex, "words": F.when(F.size(words) > 0, F.array_distinct(words)).otherwise(F.array(F.lit("")))})


def indexed(rules: DataFrame, subjects: DataFrame) -> DataFrame:
    """``compiled`` rules with ``word``: that of their words which fewest ``subjects`` hold, longer ones first on ties."""
    each = rules.select("pattern", "verdict", "level", "regex", F.explode("words").alias("word")).distinct()
    held = subjects.select(F.explode(words_of(F.col("subject"))).alias("word")).join(each.select("word").distinct(), "word", "left_semi")
    counts = held.groupBy("word").agg(F.count("*").alias("n"))
    rarest = F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("word")).alias("size"), F.col("word").alias("word"))
    return each.join(counts, "word", "left").groupBy("pattern", "verdict", "level", "regex").agg(F.min(rarest).alias("least")).withColumn("word", F.col("least.word")).drop("least")


def judge(df: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = OTHERWISE) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (the pattern that decides, null if none fits), ``level`` and ``verdict``.

    ``rules`` (pattern, verdict, level) may be of any size. Of the rules that fit, the lowest level
    decides, then the longest pattern; block before allow, then the pattern's bytes, on ties. Equal addresses are
    judged once. A null address, or one without ``://``, has an empty host and path and is judged as
    such, as is an empty one. Repeated rows get equal verdicts, an empty table gives an empty one, very
    long addresses are taken whole, and columns of the names of the new ones are replaced.
    """
    host, path, query = parts(F.col(f"`{url_col}`"))
    subject, best = unused(df.columns, "_subject"), unused(df.columns, "_best")
    kept = [F.col(f"`{c}`") for c in without(df.columns, ("host", "path", "rule", "level", "verdict"))]
    rows = df.select(*kept, host.alias("host"), path.alias("path"), F.concat(F.lit("//"), host, path, query).alias(subject))
    subjects = rows.select(F.col(subject).alias("subject")).distinct()
    index = indexed(compiled(rules), subjects)
    fetched = subjects.select("subject", F.explode(words_of(F.col("subject"))).alias("word")).join(index, "word")
    fits = fetched.where(F.regexp_like("subject", F.col("regex")))
    order = F.struct("level", -F.length("pattern"), F.when(F.col("verdict") == "block", 0).otherwise(1), "pattern")
    decided = fits.groupBy(F.col("subject").alias(subject)).agg(F.min_by(F.struct(F.col("pattern").alias("rule"), "level", "verdict"), order).alias(best))
    out = rows.join(decided, subject, "left").drop(subject)
    return out.select("*", f"{best}.rule", f"{best}.level", F.coalesce(f"{best}.verdict", F.lit(otherwise)).alias("verdict")).drop(best)


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address judged by the contract's rules, and by the default ones where none of them fits."""
    rules = rules_table(spark, CONTRACT_RULES).unionByName(rules_table(spark, DEFAULT_RULES, 1))
    judged = judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    named = F.when(F.col("level") == 0, F.substring("rule", 3, 1 << 20))
    return judged.select("page_id", "host", "path", named.alias("rule"), F.when(F.col("level") == 1, F.col("rule")).alias("pattern"), "verdict")


def _sql() -> str:
    """Every rule against every address: the contract's by the ends of hosts and starts of paths, the others by regular expressions."""
    values = ", ".join(f"('{p[2:]}', '{p[2:].partition('/')[0]}', '/{p[2:].partition('/')[2]}', '{v}')" for p, v in CONTRACT_RULES)
    edge = "(?:[^A-Za-z0-9]|$)"
    regex = lambda p: "(?is)" + "".join({"*": ".*", "^": edge}.get(c, c if c.isalnum() or c in "/=_" else f"[{c}]") for c in p)
    others = ", ".join(f"('{p}', '{regex(p)}', '{v}')" for p, v in DEFAULT_RULES)
    return f"""
WITH r(rule, rule_host, rule_path, verdict) AS (VALUES {values}), o(pattern, regex, verdict) AS (VALUES {others}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '(?s)^[^?#]*([?][^#]*)?', 1) AS query FROM u),
h AS (
    SELECT DISTINCT host, path, r.rule, r.verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(r.rule) DESC) AS k
    FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
),
m AS (
    SELECT host, path, query, o.pattern, o.verdict, row_number() OVER (PARTITION BY host, path, query ORDER BY length(o.pattern) DESC, o.verdict DESC, o.pattern) AS k
    FROM (SELECT DISTINCT host, path, query FROM p) JOIN o ON regexp_matches('//' || host || path || query, o.regex)
)
SELECT p.page_id, p.host, p.path, h.rule, CASE WHEN h.rule IS NULL THEN m.pattern END AS pattern, coalesce(h.verdict, m.verdict, '{OTHERWISE}') AS verdict
FROM p LEFT JOIN h ON h.host = p.host AND h.path = p.path AND h.k = 1
LEFT JOIN m ON m.host = p.host AND m.path = p.path AND m.query = p.query AND m.k = 1
"""


QUERIES = {"op11_urls": op11_urls}
ORACLES = {"op11_urls": _sql()}
