"""URL filters, divergence of sources and alignment of tokenizers, against brute force and SQL on odd inputs."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from meibo.llm import alignment, divergence, urls

SCHEMA = "doc_id long, text string, lang string, source string, extra string"


def _sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"_{name}", df.toArrow())
        con.sql(f"CREATE TABLE {name} AS SELECT * FROM _{name}")
    out = con.sql(sql)
    return sorted((dict(zip(out.columns, r, strict=True)) for r in out.fetchall()), key=repr)


def _rows(df):
    return sorted((r.asDict() for r in df.collect()), key=repr)


# --- URL filters


URLS = (
    None, "", "no scheme/path", "http://", "http://Example.NET/en/", "http://a.b.example.net/en/x?y#z", "http://example.net/EN/", "http://notexample.net/en/",
    "http://example.com/de/", "http://example.com/de", "http://x.example.com?/de/", "http://foo.org/fr/1", "http://org/fr/", "http://foo.org:80/fr/", "http://net", "http://net/",
    "http://net?/", "http://a.net#/", "http://u@x.net/p", "http://x?y.net/", "a://b://c.net/", "https://best-casino.example.com/", "https://bestcasino.example.com/", "http://a.com/x/Ads/1",
    "http://a.com/wp-login.php", "http://a.com/wp-loginXphp", "http://a.com/wiki/casino", "http://a.com/casino/wiki/casino/", "http://a.com/?PHPSESSID=3", "http://a.com/#casino",
    "http://a.com/payday-loans", "http://a.com/payday.loan\nx", "http://é.com/ads/ü", "http://a.com/feed/", "http://a.com/" + "x/" * 50_000 + "cart/", "http://pharmacy", "HTTP://A.COM/\\.[x](*)^$|+",
)


def test_urls_equal_every_rule_on_every_address(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(1, URLS[4]), (None, URLS[4]), (None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    pages.createOrReplaceTempView("pages_of_test")
    rules = urls.rules_table(spark, urls.CONTRACT_RULES).unionByName(urls.rules_table(spark, urls.DEFAULT_RULES, 1))
    out = urls.judge(pages, rules)
    assert out.count() == len(rows)
    got = [(r.page_id, r.host, r.path, r.rule[2:] if r.level == 0 else None, r.rule if r.level == 1 else None, r.verdict) for r in out.collect()]
    # the SQL joins its verdicts to pages by address, so null ids are no matter
    want = [tuple(r[c] for c in ("page_id", "host", "path", "rule", "pattern", "verdict")) for r in _sql(urls.ORACLES["op11_urls"], pages=pages)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    by = {r[0]: r for r in got}
    assert by[URLS.index("http://a.b.example.net/en/x?y#z")][3:] == ("example.net/en/", None, "allow")
    assert by[URLS.index("http://example.net/EN/")][3:] == ("net/", None, "block")
    assert by[URLS.index("http://net")][1:] == ("net", "", None, None, "allow")
    assert by[URLS.index("http://a.com/casino/wiki/casino/")][4:] == ("^wiki/casino^", "allow")


def test_urls_rules_are_indexed_by_their_rarest_word(spark):
    pages = spark.createDataFrame([("//a.com/common/rare",), ("//a.com/common",), ("//b.com/common",)], "subject string")
    rules = urls.rules_table(spark, [("/common/rare^", "block"), ("^com/*", "block"), ("*", "allow"), ("-*x", "block"), ("/common/never^", "block")])
    index = {r.pattern: r.word for r in urls.indexed(urls.compiled(rules), pages).collect()}
    assert index == {"/common/rare^": "rare", "^com/*": "com", "*": "", "-*x": "", "/common/never^": "never"}


def test_urls_words_of_a_rule_are_in_every_address_it_fits(spark):
    import re

    rng = random.Random(5)
    piece = ["ads", "net", "x", "/", ".", "-", "?", "é", "Ads", "1"]
    patterns = {"".join(rng.choice([*piece, "*", "^"]) for _ in range(rng.randint(1, 5))) for _ in range(200)} | {"||" + "".join(rng.choice(piece) for _ in range(3)) for _ in range(60)}
    subjects = {"//" + "".join(rng.choice(piece) for _ in range(rng.randint(0, 12))) for _ in range(300)}
    rules = urls.compiled(urls.rules_table(spark, [(p, "block") for p in sorted(patterns)])).collect()
    for r in rules:
        regex = re.compile(r.regex, re.ASCII)
        for s in subjects:
            if regex.search(s):
                assert set(r.words) <= {*re.split("[^a-z0-9]+", urls_lower(s)), ""}, (r.pattern, s)


def urls_lower(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def test_urls_keep_other_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([("http://a.net/", "old", "h")], "url string, verdict string, host string")
    rules = urls.rules_table(spark, urls.CONTRACT_RULES)
    assert urls.judge(rows, rules).columns == ["url", "host", "path", "rule", "level", "verdict"]
    assert urls.judge(rows.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(rows, rules.limit(0)).collect()} == {"allow"}


# --- divergence of sources


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def test_divergence_equals_sql(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta", "BETA", "été", "Été", "日本", "x1y", "a_b", "İx", "ß", "\U0001f600z", "don't"]
    rows = []
    for k in range(400):
        text = rng.choice([None, "", "  12 ", *(" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(9))])
        rows.append((rng.choice([k, None, 7]), text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "Ü", None, ""])))
    rows += [(1, "alpha only here", "fr", "s1"), (2, "alpha", "fr", "s2"), (3, None, "es", "s1")]  # nothing kept; one source
    rows += [(4, "alpha beta " * 40_000, "en", "s1")] * 3
    docs = _docs(spark, rows)
    assert _rows(divergence.divergence(docs)) == _sql(divergence._SQL, documents=docs)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_divergence_counts_copies_wherever_they_are(spark):
    rows = [(k, "one two three", "en", "s1" if k % 3 else "s2") for k in range(300)] + [(k, f"two w{k % 20}", "en", "s3") for k in range(300)]
    docs = _docs(spark, rows)
    want = _sql(divergence._SQL, documents=docs)
    assert _rows(divergence.divergence(docs.repartition(7, "doc_id"))) == want
    assert _rows(divergence.divergence(docs.coalesce(1))) == want
    texts = divergence.collapsed(docs)
    assert texts.count() == 21
    assert {r.text: sorted(map(tuple, r.sources)) for r in texts.collect()}["one two three"] == [("s1", 200), ("s2", 100)]


def test_divergence_slices_do_not_matter(spark, monkeypatch):
    rows = [(k, f"a b c{k % 5} d", "en", f"s{k % 4}") for k in range(200)]
    docs = _docs(spark, rows)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 1)
    assert _rows(divergence.divergence(docs)) == _sql(divergence._SQL, documents=docs)


@pytest.mark.parametrize("n", [0, 5, 10**9, 10**15, 10**18])
def test_shares_are_exact(spark, n):
    from pyspark.sql import functions as F

    total, v = n + 10**17, 10**6
    got = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(v).cast("long")).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


# --- alignment of tokenizers


def _spans(ids, piece):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(piece[i]), i))
        at += len(piece[i])
    return out


def _brute(texts):
    """The contract's columns of each text, token by token over whole texts."""
    a_path, b_path = alignment.default_tokenizer(), alignment.default_pieces()
    tok_a, tok_b = alignment._byte_tokenizer(a_path), alignment._piece_tokenizer(b_path)
    bytes_a, bytes_b = alignment.pieces(a_path), alignment.piece_bytes(b_path)
    found, count = [], Counter()
    for t in texts:
        if not t:
            found.append(None)
            continue
        a, b, want = tok_a.encode(" " + t, add_special_tokens=False).ids, tok_b.encode(t), (" " + t).encode()
        if b"".join(bytes_a[i] for i in a) != want or b"".join(bytes_b[i] for i in b) != want:
            found.append(None)
            continue
        left, right = _spans(a, bytes_a), _spans(b, bytes_b)
        links = [(x, y) for lo, hi, x in left for p, q, y in right if lo < q and p < hi]
        cut = sorted({hi for _, hi, _ in left} & {hi for _, hi, _ in right})
        groups = []
        for lo, hi in zip([0, *cut], cut, strict=False):
            groups.append("|".join(",".join(str(i) for p, q, i in side if lo <= p and q <= hi) for side in (left, right)))
        found.append((len(a), len(b), len(cut), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        count.update(links)
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    zero = (0,) * 6 + ("",)
    return [zero if f is None else (*f[:3], len(f[3]), sum(count[x] == top[x[1]] for x in f[3]), sum(count[x] for x in f[3]), f[4]) for f in found]


ODD = (
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \n b", "\ta\t b ", "<|endoftext|>", "x<|endoftext|> y", "<s> </s><unk>", "don't we'll", "naïve café", "日本語 テキスト", "日本　語 x",
    "▁", "a▁ b", "a ▁b", "\u00a0x y", "x\u2003 y", "é é", "\U0001f600 \U0001f601\U0001f602", "\x00 \x01", "1,234.5 (six)", "....   ....", "a" * 3000, "word " * 2000, "한국어 문장 입니다", "\u0085 x", "\u200b x",
)


def test_alignment_equals_brute_force(spark):
    rng = random.Random(9)
    parts = ["the", "of", " ", "  ", "\n", "é", "日", "don't", "x1", "<s>", "…", "Ünder", "zzyzx", ",", "\t", "\u3000"]
    texts = [*ODD, *("".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(150)), *["the same text"] * 40, "the same"]
    docs = spark.createDataFrame([(k if k % 9 else None, t, "n", 5) for k, t in enumerate(texts)], "doc_id long, text string, source string, n_a int")
    out = alignment.align(docs.repartition(5)).collect()
    assert len(out) == len(texts)
    want = sorted((k if k % 9 else None, *w) for (k, _), w in zip(enumerate(texts), _brute(texts), strict=True) if k % 9)
    names = ("doc_id", *alignment.MEASURES, "groups_sha256")
    assert sorted(tuple(r[c] for c in names) for r in out if r.doc_id is not None) == want
    assert set(out[0].asDict()) == {*names, "source"}


def test_alignment_blocks_do_not_matter(spark, monkeypatch):
    texts = [f"some words {k % 7} of text number {k % 30}" for k in range(120)] + ["x" * 500, None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    want = sorted((k, *w) for k, w in enumerate(_brute(texts)))
    for size in (1, 100, 1 << 20):
        monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
        out = alignment.align(docs)
        assert sorted(tuple(r[c] for c in ("doc_id", *alignment.MEASURES, "groups_sha256")) for r in out.collect()) == want
    assert alignment.align(docs.limit(0)).count() == 0


def test_alignment_table_counts_copies(spark):
    docs = spark.createDataFrame([("hello world",)] * 3 + [("hello there",), (None,)], "text string")
    rows = alignment.alignment_table(docs).collect()
    model = alignment._piece_tokenizer(alignment.default_pieces())
    hello = model.encode("hello")[0]
    assert [r["count"] for r in rows if r.b == hello] == [4]
    assert all(r.best for r in rows)


def test_columns_that_clash_with_those_of_the_operators(spark):
    odd = spark.createDataFrame([("http://a.net/", "t", 1, 2, 3, 4)], "url string, text string, _subject int, _best_ int, Verdict int, _Key int")
    judged = urls.judge(odd, urls.rules_table(spark, urls.CONTRACT_RULES))
    assert judged.columns == ["url", "text", "_subject", "_best_", "_Key", "host", "path", "rule", "level", "verdict"]
    assert judged.first().asDict() | {"text": "t", "_subject": 1, "_best_": 2, "_Key": 4, "verdict": "block"} == judged.first().asDict()
    aligned = alignment.align(odd.withColumnRenamed("Verdict", "N_A").withColumnRenamed("url", "key")).first().asDict()
    assert aligned["_Key"] == 4 and aligned["key"] == "http://a.net/" and aligned["n_a"] == 1 and "N_A" not in aligned
    named = spark.createDataFrame([("en", "a b", "s", 1, 2)], "lang string, text string, source string, sources int, n int")
    assert divergence.divergence(named).count() == 0
