"""What is added step by step: imports that are repeated, results of workers, and streams."""

import random
import re

from pyspark.sql import functions as F

from meibo.operators import pages, paths
from meibo.schema import CSV_HEADERS, NAMES
from meibo.sources import files
from meibo.streaming import ingest


def _csv(path, *companies):
    path.parent.mkdir(exist_ok=True)
    rows = [",".join(CSV_HEADERS), *(",".join([f'"{c}"', *[""] * (len(NAMES) - 1)]) for c in companies)]
    path.write_text("﻿" + "\r\n".join(rows) + "\r\n", encoding="utf-8")
    return str(path)


def test_append_adds_a_batch_once_and_numbers_from_the_stored_maximum(spark, tmp_path):
    table, a, b = str(tmp_path / "table"), _csv(tmp_path / "a.csv", "A", "B", "A"), _csv(tmp_path / "b.csv", "C", "A")
    assert files.stored_companies(spark, table) is None
    for batch, source in (("one", a), ("one", a), ("two/x", b), ("one", b), ("two/x", b)):
        out = files.append_companies(spark, table, source, batch, unique_by="company")
    assert [(r.id, r.company, r.batch) for r in out.orderBy("id").collect()] == [(1, "A", "one"), (2, "B", "one"), (3, "C", "two/x"), (4, "A", "two/x")]


def test_import_numbers_new_rows_after_existing_ones_by_file_and_row(spark, tmp_path):
    sources = [_csv(tmp_path / f"{k}.csv", *[f"{k}{n}" for n in range(3)]) for k in "cab"]
    old = spark.createDataFrame([(7, "old")], "id long, company string").select("id", *[F.col("company") if f == "company" else F.lit(None).cast("string").alias(f) for f in NAMES])
    rows, counts = files.import_companies(spark, sources, existing=old)
    assert [(r.id, r.company) for r in rows.orderBy("id").collect()] == [(7, "old"), *((8 + n, f"{k}{m}") for n, (k, m) in enumerate((k, m) for k in "abc" for m in range(3)))]
    assert tuple(counts.first()) == (9, 0)


def _brute(rows):
    """Results one after another."""
    at, out = {}, []
    for batch, job, index, status, reason in sorted(rows, key=lambda r: (r[0], r[2], r[3], r[4])):
        if index >= at.get(job, 0):
            out += [(job, k, "failed", ingest.GAP) for k in range(at.get(job, 0), index)] + [(job, index, status, reason)]
            at[job] = index + 1
    return sorted(out)


def test_results_of_one_large_job_are_many_parts(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), "big" if rng.random() < 0.9 else f"j{rng.randrange(4)}", rng.randrange(400), rng.choice(["done", "failed"]), rng.choice("xy")) for _ in range(900)]
    df = spark.createDataFrame(rows, "batch int, job_id string, target_index int, status string, reason string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ingest.ingest_results(df)
        assert sorted(map(tuple, got.collect())) == _brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert ingest.ingest_results(df.limit(0)).count() == 0


def test_result_stream_keeps_its_state_between_runs(spark, tmp_path):
    rng = random.Random(3)
    rows = [(b, f"j{rng.randrange(2)}", rng.randrange(60), "done", "r") for b in range(3) for _ in range(15)]
    for b in range(3):
        df = spark.createDataFrame([r for r in rows if r[0] == b], "batch int, job_id string, target_index long, status string, reason string")
        df.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        out = ingest.run_once(ingest.ingest_results_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), str(tmp_path))
    assert sorted(map(tuple, out.collect())) == _brute(rows)


def test_login_stream_drops_replays_and_what_is_late(spark, tmp_path):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    sent = [[(1, "a", day(1)), (2, "a", day(1))], [(1, "a", day(1)), (3, "b", day(2))], [(4, "b", day(20))], [(5, "a", day(20)), (1, "a", day(1)), (6, "c", day(2))]]
    for some in sent:
        df = spark.createDataFrame(some, "event_id int, user_id string, t string").select("event_id", "user_id", F.to_timestamp("t").alias("logged_at"))
        df.write.mode("append").parquet(str(tmp_path / "in"))
        query = ingest.login_history_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), delay="3 days")
        query.processAllAvailable()
        query.stop()
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out/data")).collect())
    assert got == [1, 2, 3, 4, 5]  # the replay of 1 is late by then, and so is 6


def test_guessed_addresses_follow_links_and_stand_once(spark):
    html = '<a href="/company/">会社概要</a><a href="/x.pdf">会社概要</a><a href="https://other.test/company/">会社概要</a><a href="/about.html">x</a>'
    df = spark.createDataFrame([(1, "https://A.test/top", html), (2, "mailto:x", None), (3, None, "")], "k int, url string, html string")
    rows = paths.candidate_pages(df, pages.extract_links(df, "k"), "k").collect()
    assert {r.k for r in rows} == {1}
    for focus, (_, most, _) in pages.LINK_LIMITS.items():
        own = sorted((r for r in rows if r.focus == focus), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and len(own) <= most
        assert len({r.link.lower() for r in own}) == len(own)
        turns = [r.guessed for r in own]
        assert turns == sorted(turns, reverse=focus == paths.GUESSED_FIRST)
        assert not any("other" in r.link for r in own)


def test_guessed_addresses_are_not_shuffled(spark):
    """every guessed address was looked through for every word, and shuffled and sorted twice."""
    df = spark.createDataFrame([(1, "https://a.test/", "")], "k int, url string, html string")
    plan = paths.candidate_pages(df, pages.extract_links(df, "k"), "k")._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange", 1)
    assert "posexplode(" in above and "explode(" not in below


def test_candidate_pages_of_keys_with_many_sites(spark):
    """rows put together one by one, for keys of several sites, sites with words, and a null key."""
    a = "".join(f'<a href="/{w}">{w}</a>' for w in ("company/", "about.html", "x/recruit", "staff.html", "news/1", "data/", "contact", "a.jpg"))
    rows = [(1, "https://staff-data.test/", a), (1, "http://b.test/top", a), (1, "http://b.test/top", a), (None, "https://recruit.test/", '<a href="/profile/">会社概要</a>'), (2, "x", "")]
    df = spark.createDataFrame(rows, "k int, url string, html string")
    links = pages.extract_links(df, "k")

    def score(focus, target):
        hit = lambda w: re.search(w, target, re.IGNORECASE) is not None
        return sum(n for w, n in pages.LINK_RULES[focus] if hit(w)) - (250 if focus == "employee_count" and hit(pages.RECRUIT) and not hit(pages.HEADCOUNT) else 0)

    wanted = set()
    for k in (1, None):
        for focus, (low, most, _) in pages.LINK_LIMITS.items():
            real = {(-s, r.seq, r.link, "") for r in links.collect() if r.k == k and not r.link.endswith(".jpg") and (s := score(focus, f"{r.label} {r.link}")) > low}
            sites = {"/".join(u.split("/")[:3]) for key, u, _ in rows if key == k}
            made = {(-score(focus, f"{path} {s}{path}"), n, s, path) for s in sites for n, path in enumerate(paths.guessed_paths(focus))}
            order = dict.fromkeys((h + path, low, path != "") for kind in ((made, real) if focus == paths.GUESSED_FIRST else (real, made)) for low, _, h, path in sorted(kind))
            once = {}
            for link, low, guessed in order:
                once.setdefault(link, (-low, guessed))
            wanted |= {(k, focus, link, s, n, guessed) for n, (link, (s, guessed)) in enumerate(once.items(), 1) if n <= most}
    got = [tuple(r) for r in paths.candidate_pages(df, links, "k").collect()]
    assert len(got) == len(wanted) and set(got) == wanted
