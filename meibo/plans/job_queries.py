"""Queries of jobs, review and merge, settings and logins."""

from __future__ import annotations

from pyspark.sql import functions as F

from meibo.operators import access, jobs, merge
from meibo.schema import companies, with_companies

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# targets from orders: twenty jobs, a place for each order, states and times by order
TARGETS = """
SELECT 'j' || cast(o_custkey % 20 AS string) AS job_id,
  cast(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS int) AS target_index,
  o_custkey AS row_id, CASE WHEN o_orderkey % 4 = 0 THEN 'a' || cast(o_orderkey AS string) END AS address,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'skipped' ELSE CASE o_orderkey % 5 WHEN 0 THEN 'processing' WHEN 1 THEN 'waiting' WHEN 2 THEN 'failed' ELSE 'done' END END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS started_at,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + interval '90' second END AS finished_at,
  cast(NULL AS string) AS skip_reason, cast(NULL AS string) AS error_message
FROM {orders}
"""
# previews: a row for every second order; offices 0 to 2
PREVIEW = """
SELECT 'j' || cast(o_custkey % 20 AS string) AS job_id, 'p' || cast(o_orderkey AS string) AS preview_row_id, o_custkey AS row_id,
  cast(o_orderkey % 3 AS int) AS office_index, o_totalprice AS price FROM {orders} WHERE o_orderkey % 2 = 0
"""
USERS = """
SELECT CASE WHEN user_id % 10 = 0 THEN ' ' ELSE 'u' || cast(user_id AS string) END AS user_id,
  'org' || cast(event_id % 3 AS string) AS organization, CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS updated_at,
  event_type AS allowed_filters, event_id FROM {events}
"""
LOGINS = """
SELECT 'u' || cast(user_id AS string) AS user_id, ts AS logged_at, event_id,
  CASE event_id % 7 WHEN 0 THEN '10.0.0.1, 10.0.0.2' WHEN 1 THEN '::1' WHEN 2 THEN ' ' WHEN 3 THEN NULL ELSE '192.168.0.' || cast(event_id % 250 AS string) END AS forwarded,
  CASE WHEN event_id % 14 = 2 THEN '127.0.0.1' END AS real_ip,
  CASE event_id % 5 WHEN 0 THEN 'Mozilla/5.0 Chrome/120 Safari/537 Edg/120' WHEN 1 THEN 'Mozilla/5.0 Chrome/120 Safari/537' WHEN 2 THEN 'Mozilla/5.0 FxiOS/9'
    WHEN 3 THEN 'Mozilla/5.0 Version/17 Safari/605' END AS agent FROM {events}
"""


def _frames(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    orders, events = t("orders"), t("events")
    return {
        "targets": spark.sql(TARGETS, orders=orders), "preview": spark.sql(PREVIEW, orders=orders), "companies": companies(spark, sf_dir),
        "users": spark.sql(USERS, events=events), "logins": spark.sql(LOGINS, events=events),
    }


_VIEWS = ", ".join(
    f"{n} AS ({s.format(orders='orders', events='events')})" for n, s in (("targets", TARGETS), ("preview", PREVIEW), ("users", USERS), ("logins", LOGINS))
)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(_frames(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            ORACLES[name] = with_companies(f"WITH {_VIEWS}" + (", " + body[5:] if body[:5].upper() == "WITH " else " " + body))
        return f

    return add


_ENDED = "status IN ('done', 'skipped', 'failed')"
query(
    "job_progress",
    f"""SELECT job_id, count(*) AS total, count(*) FILTER ({_ENDED}) AS processed, count(*) FILTER (status = 'done') AS updated,
    count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed,
    coalesce(min(target_index) FILTER (NOT {_ENDED}), count(*))::BIGINT AS next_index,
    coalesce(min(target_index) FILTER (NOT {_ENDED}), count(*)) >= count(*) AS completed FROM targets GROUP BY job_id""",
)(lambda f: jobs.job_progress(f["targets"]))
query(
    "job_elapsed_ms",
    """SELECT job_id, floor(sum(greatest(0.0, (epoch_us(coalesce(finished_at, CASE WHEN status = 'processing' THEN TIMESTAMP '1998-01-01' END, started_at)) - epoch_us(started_at)) / 1000)))::BIGINT AS elapsed_ms
    FROM targets WHERE started_at IS NOT NULL GROUP BY job_id""",
)(lambda f: jobs.job_elapsed_ms(f["targets"], F.lit("1998-01-01").cast("timestamp")))
query(
    "targets_join_companies",
    "SELECT t.job_id, t.target_index, t.row_id, c.company AS now_company, coalesce(t.address, c.address) AS address FROM targets t LEFT JOIN companies c ON c.id = t.row_id",
)(lambda f: jobs.targets_join_companies(f["targets"], f["companies"]).select("job_id", "target_index", "row_id", "now_company", "address"))
_HIDDEN = f"SELECT * FROM targets t WHERE {_ENDED} AND NOT EXISTS (SELECT 1 FROM preview p WHERE p.job_id = t.job_id AND p.row_id = t.row_id)"
query("targets_without_preview", f"SELECT job_id, target_index, row_id FROM ({_HIDDEN})")(
    lambda f: jobs.targets_without_preview(f["targets"], f["preview"]).select("job_id", "target_index", "row_id")
)
query(
    "preview_counts",
    f"""SELECT j.job_id, (SELECT count(*) FROM preview p WHERE p.job_id = j.job_id) AS preview_total,
    (SELECT count(*) FROM ({_HIDDEN}) h WHERE h.job_id = j.job_id) AS excluded_count FROM (SELECT DISTINCT job_id FROM targets) j""",
)(lambda f: jobs.preview_counts(f["targets"], f["preview"]))
query(
    "preview_page",
    """SELECT row_id, office_index FROM (SELECT *, row_number() OVER (ORDER BY row_id, office_index) - 1 AS k, count(*) OVER () AS total
      FROM (SELECT DISTINCT row_id, office_index FROM preview WHERE job_id = 'j4')) WHERE k // 20 = least(2, greatest(1, (total + 19) // 20)) - 1""",
)(lambda f: jobs.preview_page(f["preview"].select("job_id", "row_id", "office_index").distinct(), "j4", 2).select("row_id", "office_index"))
query("preview_join_source", "SELECT p.preview_row_id, c.company, c.phone FROM preview p JOIN companies c ON c.id = p.row_id")(
    lambda f: f["preview"].join(f["companies"].withColumnRenamed("id", "row_id"), "row_id").select("preview_row_id", "company", "phone")
)
query(
    "target_status_update",
    """SELECT t.job_id, t.target_index, coalesce(u.s, t.status) AS status, t.started_at, CASE WHEN u.s IS NOT NULL THEN TIMESTAMP '1999-01-01' ELSE t.finished_at END AS finished_at,
    CASE WHEN u.s = 'skipped' THEN 'r' END AS skip_reason, CASE WHEN u.s = 'failed' THEN 'r' END AS error_message
    FROM (SELECT * FROM targets WHERE started_at IS NOT NULL) t LEFT JOIN (SELECT job_id, target_index, CASE WHEN target_index % 2 = 0 THEN 'skipped' ELSE 'failed' END AS s FROM targets WHERE status = 'processing') u
    ON u.job_id = t.job_id AND u.target_index = t.target_index""",
)(
    lambda f: jobs.target_status_update(
        f["targets"].where("started_at IS NOT NULL"),
        f["targets"].where("status = 'processing'").select(
            "job_id", "target_index", F.expr("CASE WHEN target_index % 2 = 0 THEN 'skipped' ELSE 'failed' END").alias("status"), F.lit("r").alias("reason"),
            F.lit("1999-01-01").cast("timestamp").alias("at"),
        ),
    ).select("job_id", "target_index", "status", "started_at", "finished_at", "skip_reason", "error_message")
)
query(
    "result_status",
    """SELECT job_id, target_index, CASE WHEN status = 'done' AND target_index % 3 = 0 THEN 'failed' WHEN status = 'done' AND target_index % 5 = 0 THEN 'skipped' ELSE status END AS status,
    CASE WHEN status = 'done' AND target_index % 3 = 0 THEN '結果がありません' WHEN status = 'done' AND target_index % 5 = 0 THEN '更新候補なし' END AS reason FROM targets""",
)(
    lambda f: f["targets"].withColumn("r", jobs.result_status(F.col("status"), F.expr("target_index % 3 <> 0"), F.expr("target_index % 5"))).select(
        "job_id", "target_index", "r.status", "r.reason"
    )
)

# extracted records: what a page gave for every third company, some of it equal to the stored row
_EXTRACTED = """
SELECT 'p' || cast(id AS string) || '-' || cast(k AS string) AS preview_row_id, id AS row_id, cast(k AS int) AS office_index,
  {a}'03-1111-' || lpad(cast(id % 10000 AS string), 4, '0'), CASE WHEN id % 2 = 0 THEN '＋81-3-1111-' || lpad(cast(id % 10000 AS string), 4, '0') END, ' '{z} AS phone,
  {a}coalesce(email, 'new@example.jp'){z} AS email, {a}address, CASE WHEN id % 4 = 0 THEN '別の住所' END{z} AS address,
  CASE WHEN id % 5 = 0 THEN company ELSE '株式会社新' END AS company, 'https://new.example.jp' AS website_url, representative_name,
  CASE WHEN id % 2 = 0 THEN employee_count ELSE '77名' END AS employee_count
FROM (SELECT *, 0 AS k FROM {companies} WHERE id % 3 = 0 UNION ALL SELECT *, 1 AS k FROM {companies} WHERE id % 12 = 0)
"""
_CHOICES = """
SELECT preview_row_id, 'employee_count' AS field, CASE WHEN row_id % 9 = 0 THEN '99名' END AS value FROM {extracted} WHERE row_id % 6 = 3
"""


def _review(f):
    spark = f["companies"].sparkSession
    extracted = spark.sql(_EXTRACTED.replace("{a}", "array(").replace("{z}", ")"), companies=f["companies"])
    changes = merge.diff(merge.bundle(extracted), f["companies"])
    choices = spark.sql(_CHOICES, extracted=extracted)
    return extracted, changes, choices


_NULLABLE = "nullif(trim({0}, ' 　'), '')"
_REVIEW = f"""
extracted AS ({_EXTRACTED.replace('{a}', '[').replace('{z}', ']').format(companies='companies')}),
bundles AS (
  SELECT preview_row_id, row_id, office_index, field, list_filter(c, lambda v, i: list_position(c, v) = i) AS candidates FROM (
    SELECT preview_row_id, row_id, office_index, field, list_filter(list_transform(c, lambda v: {_NULLABLE.format('v')}), lambda v: v IS NOT NULL) AS c FROM (
      SELECT preview_row_id, row_id, office_index, unnest([{{'field': 'phone', 'c': phone}}, {{'field': 'email', 'c': email}}, {{'field': 'address', 'c': address}}, {{'field': 'company', 'c': [company]}},
        {{'field': 'website_url', 'c': [website_url]}}, {{'field': 'representative_name', 'c': [representative_name]}}, {{'field': 'employee_count', 'c': [employee_count]}}], recursive := true) FROM extracted))
  WHERE len(c) > 0),
stored AS (SELECT id AS row_id, unnest([{', '.join(f"{{'field': '{f}', 'before': {_NULLABLE.format(f)}}}" for f in ('phone', 'email', 'address', 'company', 'website_url', 'representative_name', 'employee_count'))}], recursive := true) FROM companies),
changes AS (SELECT preview_row_id, row_id, office_index, field, before, candidates[1] AS after, candidates FROM bundles JOIN stored USING (row_id, field)
  WHERE (len(candidates) > 1 AND field IN ('phone', 'email', 'address')) OR candidates[1] IS DISTINCT FROM before OR field IN ('representative_name', 'employee_count')),
choices AS ({_CHOICES.format(extracted='extracted')}),
vals AS (SELECT * FROM (SELECT c.preview_row_id, c.row_id, c.office_index, c.field, CASE WHEN h.field IS NOT NULL THEN h.value ELSE c.after END AS value
  FROM changes c LEFT JOIN choices h ON h.preview_row_id = c.preview_row_id AND h.field = c.field) WHERE value IS NOT NULL)
"""
query("build_bundle", f"WITH {_REVIEW} SELECT preview_row_id, office_index, field, array_to_string(candidates, '|') AS candidates FROM bundles")(
    lambda f: merge.bundle(_review(f)[0]).select("preview_row_id", "office_index", "field", F.array_join("candidates", "|").alias("candidates"))
)
query("diff_candidates", f"WITH {_REVIEW} SELECT preview_row_id, field, before, after, array_to_string(candidates, '|') AS candidates FROM changes")(
    lambda f: _review(f)[1].select("preview_row_id", "field", "before", "after", F.array_join("candidates", "|").alias("candidates"))
)
query(
    "multi_candidate_rows",
    f"WITH {_REVIEW} SELECT preview_row_id, field FROM changes WHERE len(candidates) > 1 AND field = 'address'",
)(lambda f: merge.multi_candidate_rows(_review(f)[1]).select("preview_row_id", "field"))
query("selected_values", f"WITH {_REVIEW} SELECT preview_row_id, field, value FROM vals")(
    lambda f: merge.selected_values(*_review(f)[1:]).select("preview_row_id", "field", "value")
)
_MERGED = {
    "company": "CASE WHEN trim(coalesce({0}, ''), ' ') = '' THEN coalesce({1}, {0}) ELSE {0} END",
    "website_url": "CASE WHEN trim(coalesce({0}, ''), ' ') = '' THEN coalesce({1}, {0}) ELSE {0} END",
}
_F = ("phone", "email", "address", "company", "website_url", "representative_name", "employee_count")
_PIVOT = f"pivoted AS (SELECT row_id, office_index, {', '.join(f"max(value) FILTER (field = '{f}') AS new_{f}" for f in _F)} FROM vals GROUP BY preview_row_id, row_id, office_index)"
query(
    "merge_candidates",
    f"""WITH {_REVIEW}, {_PIVOT}
    SELECT id, {', '.join(_MERGED.get(f, 'coalesce({1}, {0})').format(f, f'new_{f}') + f' AS {f}' for f in _F)} FROM companies LEFT JOIN pivoted ON row_id = id AND office_index = 0""",
)(lambda f: merge.merge_candidates(f["companies"], merge.selected_values(*_review(f)[1:])).where("id IS NOT NULL").select("id", *_F))
query(
    "merge_insert_offices",
    f"""WITH {_REVIEW}, {_PIVOT}
    SELECT company_kana, {', '.join(f'coalesce(new_{f}, {f}) AS {f}' for f in _F)} FROM companies JOIN pivoted ON row_id = id AND office_index > 0""",
)(lambda f: merge.merge_candidates(f["companies"], merge.selected_values(*_review(f)[1:])).where("id IS NULL").select("company_kana", *_F))
query(
    "merge_result_counts",
    f"""WITH {_REVIEW} SELECT count(*) AS processed, count(*) FILTER (preview_row_id IN (SELECT preview_row_id FROM vals)) AS updated,
    count(*) FILTER (preview_row_id NOT IN (SELECT preview_row_id FROM vals)) AS skipped FROM extracted""",
)(lambda f: merge.merge_counts(_review(f)[0].select("preview_row_id", "row_id"), merge.selected_values(*_review(f)[1:]), f["companies"]))
query(
    "upsert_preview",
    """WITH n AS (SELECT job_id, preview_row_id, row_id, 9 AS office_index, price * 2 AS price FROM preview WHERE row_id % 5 = 0 UNION ALL
      SELECT job_id, preview_row_id || 'x', row_id, 9, price FROM preview WHERE row_id % 7 = 0)
    SELECT preview_row_id, office_index, price FROM n UNION ALL SELECT preview_row_id, office_index, price FROM preview WHERE preview_row_id NOT IN (SELECT preview_row_id FROM n)""",
)(
    lambda f: merge.upsert(
        f["preview"],
        f["preview"].where("row_id % 5 = 0").withColumns({"office_index": F.lit(9), "price": F.col("price") * 2}).unionByName(
            f["preview"].where("row_id % 7 = 0").withColumns({"office_index": F.lit(9), "preview_row_id": F.concat("preview_row_id", F.lit("x"))})
        ),
    ).select("preview_row_id", "office_index", "price")
)
query("delete_processed_preview", "SELECT preview_row_id FROM preview WHERE row_id % 5 <> 0")(
    lambda f: merge.delete_processed(f["preview"], f["preview"].where("row_id % 5 = 0")).select("preview_row_id")
)
query(
    "apply_inspection_changes",
    """SELECT id, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 6 = 1 THEN '新 名前' ELSE representative_name END AS representative_name FROM companies""",
)(
    lambda f: merge.apply_inspection_changes(
        f["companies"],
        f["companies"].where("id % 6 < 3").select(
            F.col("id").alias("row_id"), F.expr("CASE WHEN id % 6 = 0 THEN 'delete' ELSE 'update' END").alias("action"),
            F.expr("CASE WHEN id % 6 = 1 THEN ' 新 名前　' ELSE ' ' END").alias("after_value"),
        ),
    ).select("id", "representative_name")
)
_OFFICES = """
SELECT id AS row_id, k AS office_index, CASE k WHEN 0 THEN '本社' WHEN 1 THEN '大阪支店' END AS office_name, company,
  {a}CASE WHEN id % 2 = k THEN address ELSE '東京都千代田区丸の内9-' || cast(k AS string) END{z} AS address,
  {a}'03-1111-' || lpad(cast(id % 10000 AS string), 4, '0'), '06-2222-' || lpad(cast(k AS string), 4, '0'){z} AS phone
FROM (SELECT *, 0 AS k FROM {companies} UNION ALL SELECT *, 1 AS k FROM {companies})
"""
query(
    "office_source_score_join",
    f"""WITH offices AS ({_OFFICES.replace('{a}', '[').replace('{z}', ']').format(companies='companies')}),
    s AS (SELECT row_id, office_index, CASE WHEN trim(replace(coalesce(company, ''), '株式会社', ''), ' 　') <> '' THEN 120 ELSE 0 END + CASE WHEN row_id % 2 = office_index THEN 2000 ELSE 0 END AS score FROM offices)
    SELECT row_id, office_index, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, office_index)::INT AS place FROM s""",
)(lambda f: merge.office_scores(f["companies"].sparkSession.sql(_OFFICES.replace("{a}", "array(").replace("{z}", ")"), companies=f["companies"]), f["companies"]))
query(
    "office_labelled_candidates",
    """SELECT id AS row_id, unnest(['本社：03-1111-' || lpad(cast(id % 10000 AS varchar), 4, '0'), '本社：06-2222-0000', '大阪支店：06-2222-0001']) AS labelled FROM companies""",
)(
    lambda f: merge.labelled_candidates(
        f["companies"].sparkSession.sql(_OFFICES.replace("{a}", "array(").replace("{z}", ")"), companies=f["companies"]), "phone"
    ).select("row_id", "labelled")
)

# settings and logins
_LATEST = "SELECT * FROM users WHERE trim(user_id, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC NULLS LAST, organization DESC, allowed_filters DESC, event_id DESC) = 1"
query("latest_per_user", f"SELECT user_id, organization, updated_at, allowed_filters, event_id FROM ({_LATEST})")(lambda f: access.latest_per_user(f["users"]))
query(
    "settings_for_user",
    "SELECT user_id, organization, updated_at FROM users WHERE user_id = 'u7' ORDER BY (organization = 'org1') DESC, updated_at DESC NULLS LAST LIMIT 1",
)(lambda f: access.settings_for_user(f["users"], "u7", "org1").select("user_id", "organization", "updated_at"))
query(
    "user_settings_join",
    f"""SELECT 'u' || cast(u AS varchar) AS user_id, l.organization AS permissions, l.allowed_filters FROM (SELECT DISTINCT user_id AS u FROM events) LEFT JOIN ({_LATEST}) l ON l.user_id = 'u' || cast(u AS varchar)""",
)(
    lambda f: access.user_settings_join(
        f["logins"].select("user_id").distinct(), f["users"].withColumn("permissions", F.col("organization")), f["users"]
    )
)
query(
    "default_permissions",
    "SELECT user_id, event_id, true AS list, CASE WHEN event_id % 2 = 0 THEN false ELSE true END AS export FROM users",
)(
    lambda f: access.default_permissions(
        f["users"].select("user_id", "event_id", F.expr("CASE WHEN event_id % 2 = 0 THEN map('export', false, 'old', false) WHEN event_id % 3 = 0 THEN map('list', cast(NULL AS boolean)) END").alias("permissions")),
        ["list", "export"],
    ).select("user_id", "event_id", F.col("permissions")["list"].alias("list"), F.col("permissions")["export"].alias("export"))
)
query(
    "upsert_user_settings",
    f"WITH l AS ({_LATEST}) SELECT user_id, CASE WHEN user_id LIKE 'u1%' THEN 'new' ELSE organization END AS organization FROM l",
)(
    lambda f: merge.upsert(
        access.latest_per_user(f["users"]),
        access.latest_per_user(f["users"]).where("user_id LIKE 'u1%'").withColumn("organization", F.lit("new")),
        ("user_id",),
        "updated_at",
    ).select("user_id", "organization")
)
_IP = """CASE WHEN trim(coalesce(split_part(forwarded, ',', 1), ''), ' ') = '::1' THEN 'ローカル環境' WHEN trim(coalesce(split_part(forwarded, ',', 1), ''), ' ') <> '' THEN trim(split_part(forwarded, ',', 1), ' ')
  WHEN real_ip IS NOT NULL THEN 'ローカル環境' ELSE '取得できません' END"""
_AGENT = "CASE event_id % 5 WHEN 0 THEN 'Edge' WHEN 1 THEN 'Chrome' WHEN 2 THEN 'Firefox' WHEN 3 THEN 'Safari' ELSE '不明' END"
query("normalize_ip", f"SELECT event_id, {_IP} AS ip FROM logins")(
    lambda f: f["logins"].select("event_id", access.request_ip("forwarded", "real_ip").alias("ip"))
)
query("browser_label", f"SELECT event_id, {_AGENT} AS browser FROM logins")(lambda f: f["logins"].select("event_id", access.browser_label("agent").alias("browser")))
query(
    "login_history_top",
    f"""SELECT user_id, logged_at, event_id, {_IP} AS ip_address, {_AGENT} AS browser, row_number() OVER (PARTITION BY user_id ORDER BY logged_at DESC, event_id DESC)::INT AS n FROM logins
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY logged_at DESC, event_id DESC) <= 50""",
)(lambda f: access.login_report(f["logins"]))
