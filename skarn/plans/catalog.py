"""Queries of the catalogue, sync and health operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.operators import catalog, health, sync

from . import fixtures as fx
from .registry import query

_SRC2 = "s2 AS (SELECT *, CASE id % 3 WHEN 0 THEN 'pending' ELSE 'active' END AS status, CASE id % 4 WHEN 0 THEN 'upload' ELSE 'crawl' END AS source_type FROM src)"


def sources2(spark, sf):
    s = fx.sources(spark, sf)
    return s.withColumn("status", F.when(F.col("id") % 3 == 0, "pending").otherwise("active")).withColumn("source_type", F.when(F.col("id") % 4 == 0, "upload").otherwise("crawl"))


def _with(views: str, more: str, body: str) -> str:
    return fx.sql(views, "").rstrip() + ",\n" + more + "\n" + body


@query("sources_by_status", _with("src", _SRC2, "SELECT id, name, base_url FROM s2 WHERE status = 'active'"))
def sources_by_status(spark, sf):
    return catalog.list_sources(sources2(spark, sf), "active").select("id", "name", "base_url")


@query("sources_by_names", fx.sql("src", "SELECT id, name FROM src WHERE name IN ('src1', 'src3', 'nowhere')"))
def sources_by_names(spark, sf):
    return catalog.by_names(fx.sources(spark, sf), ["src1", "src3", "nowhere"]).select("id", "name")


@query("source_by_id", fx.sql("src", "SELECT * FROM src WHERE id = 5"))
def source_by_id(spark, sf):
    return catalog.by_id(fx.sources(spark, sf), 5)


@query("list_sources_counts", fx.sql("ck", "SELECT s.id, s.name, count(c.chunk_id) AS chunk_count FROM src s LEFT JOIN pg p ON p.source_id = s.id LEFT JOIN ck c ON c.page_id = p.id GROUP BY 1, 2"))
def list_sources_counts(spark, sf):
    return catalog.source_counts(fx.sources(spark, sf), fx.pages(spark, sf), fx.chunks(spark, sf)).drop("page_count")


@query("source_tree", fx.sql("ck", "SELECT s.id, s.name, count(DISTINCT p.id) AS page_count, count(c.chunk_id) AS chunk_count FROM src s LEFT JOIN pg p ON p.source_id = s.id LEFT JOIN ck c ON c.page_id = p.id GROUP BY 1, 2"))
def source_tree(spark, sf):
    return catalog.source_counts(fx.sources(spark, sf), fx.pages(spark, sf), fx.chunks(spark, sf))


@query("placeholder_sources_cascade", fx.sql("ck", r"""SELECT (SELECT count(*) FROM src WHERE id % 3 <> 0) AS sources, (SELECT count(*) FROM pg WHERE source_id % 3 <> 0) AS pages, (SELECT count(*) FROM ck WHERE source_id % 3 <> 0) AS chunks"""))
def placeholder_sources_cascade(spark, sf):
    s = fx.sources(spark, sf)
    s = s.withColumn("base_url", F.when(F.col("id") % 3 == 0, F.concat(F.lit("HTTPS://Docs.Example.com/"), "name")).otherwise(F.concat(F.lit("https://notexample.com/"), "name")))
    s, p, c = catalog.without_placeholders(s, fx.pages(spark, sf), fx.chunks(spark, sf))
    count = lambda df, n: df.agg(F.count("*").alias(n))
    return count(s, "sources").join(count(p, "pages")).join(count(c, "chunks"))


@query("cascade_tree_counts", "SELECT n.n_name, count(DISTINCT c.c_custkey) AS customers, count(o.o_orderkey) AS orders FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def cascade_tree_counts(spark, sf):
    n, c, o = (fx.table(spark, sf, t) for t in ("nation", "customer", "orders"))
    per = o.groupBy("o_custkey").agg(F.count("*").alias("k"))
    by = c.select("c_custkey", "c_nationkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.countDistinct("c_custkey").alias("customers"), F.sum(F.coalesce("k", F.lit(0))).alias("orders"))
    return n.join(by, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("orders", F.lit(0)).alias("orders"))


def _dated(pages):
    return pages.withColumn("fetched_at", F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") * 37) % 1000).cast("timestamp_ntz"))


_PG_AT = "pa AS (SELECT *, TIMESTAMP '2024-01-01' + to_seconds((id * 37) % 1000) AS fetched_at FROM pg)"


@query("page_list", _with("ck", _PG_AT, "SELECT p.id, s.name AS source, p.url, p.fetched_at, (SELECT count(*) FROM ck c WHERE c.page_id = p.id) AS chunk_count FROM pa p JOIN src s ON s.id = p.source_id ORDER BY p.fetched_at DESC, p.id LIMIT 100"))
def page_list(spark, sf):
    return catalog.page_list(_dated(fx.pages(spark, sf)), fx.chunks(spark, sf), fx.sources(spark, sf))


@query("page_list_ilike_exists", _with("ck", _PG_AT, "SELECT p.id, s.name AS source, p.url, p.fetched_at, (SELECT count(*) FROM ck c WHERE c.page_id = p.id) AS chunk_count FROM pa p JOIN src s ON s.id = p.source_id WHERE p.source_id = 4 AND (p.url ILIKE '%the_r%' OR EXISTS (SELECT 1 FROM ck c WHERE c.page_id = p.id AND c.content ILIKE '%the_r%')) ORDER BY p.fetched_at DESC, p.id LIMIT 100"))
def page_list_ilike_exists(spark, sf):
    return catalog.page_list(_dated(fx.pages(spark, sf)), fx.chunks(spark, sf), fx.sources(spark, sf), source_id=4, search="the_r")


@query("page_chunks", fx.sql("ck", "SELECT chunk_id, content FROM ck WHERE page_id = 11"))
def page_chunks(spark, sf):
    return catalog.page_chunks(fx.chunks(spark, sf), 11).select("chunk_id", "content")


@query("chunk_by_id", fx.sql("ck", "SELECT c.chunk_id, s.name AS source, c.url, c.content FROM ck c JOIN src s ON s.id = c.source_id WHERE c.chunk_id = 17"))
def chunk_by_id(spark, sf):
    return catalog.chunk_detail(fx.chunks(spark, sf), fx.sources(spark, sf), 17).select("chunk_id", "source", "url", "content")


@query("page_validators", fx.sql("pg", "SELECT url, 'W/' || content_hash[1:8] AS etag FROM pg WHERE source_id = 2"))
def page_validators(spark, sf):
    p = fx.pages(spark, sf).withColumn("etag", F.concat(F.lit("W/"), F.substring("content_hash", 1, 8))).withColumn("last_modified", F.lit(None).cast("string"))
    return catalog.page_validators(p, 2).select("url", "etag")


@query("hash_diff_classes", fx.sql("prev", "SELECT p.url, CASE WHEN o.url IS NULL THEN 'new' WHEN o.content_hash = p.content_hash THEN 'same' ELSE 'changed' END AS class FROM pg p LEFT JOIN prev o USING (url)"))
def hash_diff_classes(spark, sf):
    return sync.hash_diff(fx.pages(spark, sf).select("url", "content_hash"), fx.previous(spark, sf)).select("url", "class")


@query("missing_pages_anti", fx.sql("prev", "SELECT url FROM prev WHERE url NOT IN (SELECT url FROM pg WHERE id % 11 <> 0)"))
def missing_pages_anti(spark, sf):
    return fx.previous(spark, sf).join(fx.pages(spark, sf).where("id % 11 <> 0").select("url"), "url", "left_anti").select("url")


@query("seen_minus_failed", fx.sql("pg", "SELECT url FROM pg WHERE id % 11 <> 0 EXCEPT SELECT url FROM pg WHERE id % 13 = 0"))
def seen_minus_failed(spark, sf):
    p = fx.pages(spark, sf)
    return p.where("id % 11 <> 0").select("url").join(p.where("id % 13 = 0").select("url"), "url", "left_anti").distinct()


_SEEN = "sn AS (SELECT url FROM pg WHERE CASE WHEN source_id % 3 = 0 THEN id % 11 = 0 ELSE id % 11 <> 0 END), fl AS (SELECT url FROM pg WHERE id % 13 = 0)"
_GUARD = """SELECT source_id, existing, would_delete, seen, covered, round(would_delete / existing, 9) AS delete_ratio, round(covered / existing, 9) AS coverage,
  seen > 0 AND existing >= 20 AND would_delete / existing > 0.5 AND covered / existing < 0.3 AS guarded, seen = 0 OR (existing >= 20 AND would_delete / existing > 0.5 AND covered / existing < 0.3) AS refused FROM (
  SELECT source_id, count(*) AS existing, count(*) FILTER (sn.url IS NULL) AS would_delete, count(sn.url) AS seen, count(*) FILTER (sn.url IS NOT NULL AND fl.url IS NULL) AS covered
  FROM prev LEFT JOIN sn USING (url) LEFT JOIN fl USING (url) GROUP BY 1)"""


def _seen(spark, sf):
    p = fx.pages(spark, sf)
    return p.where(F.when(F.col("source_id") % 3 == 0, F.col("id") % 11 == 0).otherwise(F.col("id") % 11 != 0)).select("url"), p.where("id % 13 = 0").select("url")


@query("purge_guard", _with("prev", _SEEN, _GUARD))
def purge_guard(spark, sf):
    return sync.purge_plan(fx.previous(spark, sf), *_seen(spark, sf))


@query("purge_result", _with("prev", _SEEN, f"SELECT p.id, p.url FROM prev p LEFT JOIN sn USING (url) JOIN ({_GUARD}) g USING (source_id) WHERE sn.url IS NOT NULL OR g.refused"))
def purge_result(spark, sf):
    return sync.purge(fx.previous(spark, sf), *_seen(spark, sf)).select("id", "url")


_BARE = r"length(regexp_replace(coalesce(p.text, ''), '^\s+|\s+$', '', 'g'))"
_OUT = f"""oc AS (SELECT p.source_id, p.url, {_BARE} AS length, CASE WHEN p.id % 13 = 0 THEN 'fetch_failed' WHEN p.id % 17 = 0 THEN 'not_modified' WHEN {_BARE} < 200 THEN 'soft_failed'
  WHEN o.content_hash = p.content_hash THEN 'skipped' ELSE 'fetched' END AS outcome FROM pg p LEFT JOIN prev o USING (url))"""


def _fetched(spark, sf):
    return fx.pages(spark, sf).select("id", "source_id", F.col("source_id").cast("string").alias("source"), "url", (F.col("id") % 13 != 0).alias("fetch_ok"), (F.col("id") % 17 == 0).alias("not_modified"), F.col("text").alias("markdown"))


@query("page_outcomes", _with("prev", _OUT, "SELECT url, outcome FROM oc"))
def page_outcomes(spark, sf):
    return sync.page_outcomes(_fetched(spark, sf), fx.previous(spark, sf)).select("url", "outcome")


@query("outcome_counters", _with("prev", _OUT, """SELECT source_id::VARCHAR AS source, count(*) FILTER (outcome = 'fetched') AS pages_fetched, count(*) FILTER (outcome = 'skipped') AS pages_skipped, count(*) FILTER (outcome = 'not_modified') AS pages_not_modified,
  count(*) FILTER (outcome IN ('soft_failed', 'fetch_failed')) AS pages_soft_failed, count(*) FILTER (outcome = 'failed') AS pages_failed FROM oc GROUP BY 1"""))
def outcome_counters(spark, sf):
    return sync.outcome_counters(sync.page_outcomes(_fetched(spark, sf), fx.previous(spark, sf)))


@query("shell_length_groups", _with("pg", "sh AS (SELECT source_id % 2 AS g, length(trim(text, ' ')) // 20 AS length FROM pg WHERE length(trim(text, ' ')) < 200)", "SELECT g::VARCHAR AS source, length::INT AS length, count(*) AS pages FROM sh GROUP BY 1, 2 HAVING count(*) >= 3"))
def shell_length_groups(spark, sf):
    n = F.length(F.trim("text"))
    out = fx.pages(spark, sf).where(n < 200).select((F.col("source_id") % 2).cast("string").alias("source"), F.floor(n / 20).cast("int").alias("length"), F.lit("soft_failed").alias("outcome"))
    return sync.shells(out)


@query("sync_pages_after", _with("prev", _OUT + "," + _SEEN.split(", fl AS")[0].replace("CASE WHEN source_id % 3 = 0 THEN id % 11 = 0 ELSE id % 11 <> 0 END", "true"), """SELECT url, content_hash FROM (
  SELECT p.url, p.content_hash FROM pg p JOIN oc USING (url) WHERE outcome = 'fetched' UNION ALL
  SELECT o.url, o.content_hash FROM prev o WHERE o.url NOT IN (SELECT url FROM oc WHERE outcome = 'fetched'))"""))
def sync_pages_after(spark, sf):
    return sync.sync(_fetched(spark, sf), fx.previous(spark, sf).select("source_id", "url", "content_hash"))[0].select("url", "content_hash")


_CRAWLED = "fe AS (SELECT * FROM pg WHERE CASE WHEN source_id % 3 = 0 THEN id % 11 = 0 ELSE id % 11 <> 0 END)"
_SIGNALS = "sg AS (SELECT id AS source_id, name AS source, id % 11 = 4 AS cancelled, id % 7 = 2 AS aborted, id % 5 = 1 AS truncated, id % 13 = 8 AS unchanged FROM src)"
_ENDED = f"""{_CRAWLED}, {_OUT.replace("FROM pg p", "FROM fe p")}, {_SIGNALS},
  ct AS (SELECT source_id, count(*) FILTER (outcome = 'fetched') AS fetched, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'not_modified') AS not_modified, count(*) FILTER (outcome IN ('soft_failed', 'fetch_failed')) AS soft_failed FROM oc GROUP BY 1),
  sh AS (SELECT source_id, sum(n) AS shell_suspected FROM (SELECT source_id, length, count(*) AS n FROM oc WHERE outcome = 'soft_failed' GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1),
  ex AS (SELECT o.source_id, count(*) AS existing, count(*) FILTER (f.url IS NULL) AS gone FROM prev o LEFT JOIN fe f USING (url) GROUP BY 1),
  se AS (SELECT source_id, count(*) AS seen, count(*) FILTER (outcome <> 'fetch_failed') AS covered FROM oc GROUP BY 1),
  gd AS (SELECT *, existing >= 20 AND seen > 0 AND gone / existing > 0.5 AND covered / existing < 0.3 AS guarded FROM ex LEFT JOIN se USING (source_id)),
  rw AS (SELECT source, coalesce(fetched, 0) AS fetched, coalesce(skipped, 0) AS skipped, CASE WHEN unchanged THEN coalesce(existing, 0) ELSE coalesce(not_modified, 0) END AS not_modified, coalesce(soft_failed, 0) AS soft_failed, 0::BIGINT AS failed,
    coalesce(shell_suspected, 0)::BIGINT AS shell_suspected, cancelled, aborted, truncated, unchanged, NOT (cancelled OR aborted OR truncated OR unchanged) AS whole, coalesce(guarded, false) AS guarded, coalesce(seen, 0) AS seen, coalesce(gone, 0) AS gone
    FROM sg LEFT JOIN ct USING (source_id) LEFT JOIN sh USING (source_id) LEFT JOIN gd USING (source_id))"""


@query("run_status_end_to_end", _with("prev", _ENDED, """SELECT source, fetched, skipped, not_modified, soft_failed, failed, CASE WHEN whole AND NOT guarded AND seen > 0 THEN gone ELSE 0 END AS pages_removed, shell_suspected, cancelled, whole AND guarded AS purge_refused, aborted, truncated,
  CASE WHEN unchanged AND NOT cancelled THEN 'ok' WHEN cancelled OR fetched + skipped + not_modified = 0 THEN 'failed' WHEN (whole AND guarded) OR aborted OR truncated THEN 'partial'
  WHEN soft_failed / greatest(fetched + skipped + not_modified + soft_failed, 1) > 0.2 THEN 'partial' ELSE 'ok' END AS status FROM rw"""))
def run_status_end_to_end(spark, sf):
    """Refused, truncated, aborted, cancelled and unchanged runs, from pages to status."""
    return sync.sync(_crawled(spark, sf), fx.previous(spark, sf), signals=_signals(spark, sf))[2]


def _crawled(spark, sf):
    return _fetched(spark, sf).where(F.when(F.col("source_id") % 3 == 0, F.col("id") % 11 == 0).otherwise(F.col("id") % 11 != 0)).drop("source").join(fx.sources(spark, sf).select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")


def _signals(spark, sf):
    i = F.col("id")
    return fx.sources(spark, sf).select(i.alias("source_id"), F.col("name").alias("source"), (i % 11 == 4).alias("cancelled"), (i % 7 == 2).alias("aborted"), (i % 5 == 1).alias("truncated"), (i % 13 == 8).alias("unchanged"))


@query("run_pages_end_to_end", _with("prev", _ENDED, """SELECT p.url, p.content_hash FROM fe p JOIN oc USING (url) WHERE outcome = 'fetched' UNION ALL
  SELECT o.url, o.content_hash FROM prev o LEFT JOIN fe f USING (url) LEFT JOIN oc USING (url) JOIN src s ON s.id = o.source_id JOIN rw ON rw.source = s.name
  WHERE coalesce(outcome, '') <> 'fetched' AND NOT (f.url IS NULL AND whole AND NOT guarded AND seen > 0)"""))
def run_pages_end_to_end(spark, sf):
    return sync.sync(_crawled(spark, sf), fx.previous(spark, sf), signals=_signals(spark, sf))[0].select("url", "content_hash")


_FLAGS = "rf AS (SELECT *, day(finished_at) % 9 = 0 AS cancelled, day(finished_at) % 7 = 3 AS purge_refused, false AS aborted, day(finished_at) % 11 = 5 AS truncated FROM runs)"
_STATUS = """rs AS (SELECT *, CASE WHEN cancelled THEN 'failed' WHEN fetched + skipped + not_modified = 0 THEN 'failed' WHEN purge_refused OR aborted OR truncated OR failed > 0 THEN 'partial'
  WHEN soft_failed / greatest(fetched + skipped + not_modified + soft_failed + failed, 1) > 0.2 THEN 'partial' ELSE 'ok' END AS status FROM rf)"""


def runs_with_status(spark, sf):
    r, d = fx.runs(spark, sf), F.dayofmonth("finished_at")
    return sync.with_status(r.withColumn("cancelled", d % 9 == 0).withColumn("purge_refused", d % 7 == 3).withColumn("truncated", d % 11 == 5))


@query("classify_runs", _with("runs", f"{_FLAGS}, {_STATUS}", "SELECT source, finished_at, status FROM rs"))
def classify_runs(spark, sf):
    return runs_with_status(spark, sf).select("source", "finished_at", "status")


@query("run_totals", _with("runs", f"{_FLAGS}, {_STATUS}", """SELECT sum(fetched)::BIGINT AS fetched, sum(skipped)::BIGINT AS skipped, sum(not_modified)::BIGINT AS not_modified, sum(soft_failed)::BIGINT AS soft_failed, sum(failed)::BIGINT AS failed,
  string_agg(CASE WHEN status = 'failed' THEN source END, '; ' ORDER BY source) AS errors, CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'ok' END AS status FROM rs"""))
def run_totals(spark, sf):
    return sync.totals(runs_with_status(spark, sf))


@query("last_status_gauge", _with("runs", f"{_FLAGS}, {_STATUS}", "SELECT source, arg_max(status, finished_at) AS status, max(finished_at) AS finished_at FROM rs GROUP BY 1"))
def last_status_gauge(spark, sf):
    return health.last_status(runs_with_status(spark, sf))


@query("status_one_hot", _with("runs", f"{_FLAGS}, {_STATUS}", "SELECT l.source, t.s AS status, (l.status = t.s)::BIGINT AS value FROM (SELECT source, arg_max(status, finished_at) AS status FROM rs GROUP BY 1) l, (VALUES ('ok'), ('partial'), ('failed')) t(s)"))
def status_one_hot(spark, sf):
    return health.one_hot(runs_with_status(spark, sf))


@query("duration_histogram", "SELECT le::DOUBLE AS le, (SELECT count(*) FROM events WHERE value <= le) AS n FROM (VALUES (1), (5), (10), (30), (60), (300), (900), (3600)) t(le) UNION ALL SELECT 'infinity'::DOUBLE, count(value) FROM events")
def duration_histogram(spark, sf):
    return health.histogram(fx.table(spark, sf, "events"), "value")


_INC = "SELECT source, finished_at, %s FROM runs WINDOW w AS (PARTITION BY source ORDER BY finished_at RANGE BETWEEN INTERVAL 30 HOURS PRECEDING AND CURRENT ROW)"


@query("increase_30h", fx.sql("runs", _INC % "sum(fetched) OVER w::BIGINT AS fetched, sum(soft_failed) OVER w::BIGINT AS soft_failed, count(*) OVER w AS runs".replace("OVER w::BIGINT", "OVER w")))
def increase_30h(spark, sf):
    return health.increase(fx.runs(spark, sf), ["fetched", "soft_failed"])


@query("indexed_nothing_alert", fx.sql("runs", f"SELECT source, finished_at FROM ({_INC % 'sum(fetched + skipped + not_modified) OVER w AS n'}) WHERE n = 0"))
def indexed_nothing_alert(spark, sf):
    return health.indexed_nothing(fx.runs(spark, sf))


_BUSY = _INC.replace("FROM runs", "FROM busy")
_RATIO = "SELECT source, finished_at, total::BIGINT AS total, round(bad / greatest(total, 1), 9) AS ratio FROM (%s) WHERE round(bad / greatest(total, 1), 9) > 0.2 AND total > 20"


@query("soft_fail_ratio_alert", fx.sql("busy", _RATIO % (_BUSY % "sum(fetched + skipped + not_modified + soft_failed) OVER w AS total, sum(soft_failed) OVER w AS bad")))
def soft_fail_ratio_alert(spark, sf):
    return health.ratio_alert(fx.busy_runs(spark, sf), "soft_failed")


@query("shell_ratio_alert", fx.sql("busy", _RATIO % (_BUSY % "sum(fetched + skipped + not_modified + soft_failed) OVER w AS total, sum(shell_suspected) OVER w AS bad")))
def shell_ratio_alert(spark, sf):
    return health.ratio_alert(fx.busy_runs(spark, sf), "shell_suspected")


@query("run_counters", fx.sql("runs", "SELECT source, t.name, CASE t.name WHEN 'fetched' THEN f WHEN 'skipped' THEN s ELSE d END AS value FROM (SELECT source, sum(fetched)::BIGINT AS f, sum(skipped)::BIGINT AS s, sum(failed)::BIGINT AS d FROM runs GROUP BY 1), (VALUES ('fetched'), ('skipped'), ('failed')) t(name)"))
def run_counters(spark, sf):
    return health.counters(fx.runs(spark, sf), ["fetched", "skipped", "failed"])


@query("last_success_gauge", _with("runs", f"{_FLAGS}, {_STATUS}", "SELECT source, epoch(max(finished_at))::DOUBLE AS last_success FROM rs WHERE status IN ('ok', 'partial') GROUP BY 1"))
def last_success_gauge(spark, sf):
    return health.last_success(runs_with_status(spark, sf))


@query("stale_sources", _with("runs", f"{_FLAGS}, {_STATUS}", "SELECT source, max(finished_at) AS last_success FROM rs WHERE status IN ('ok', 'partial') GROUP BY 1 HAVING epoch(TIMESTAMP '2024-01-31') - epoch(max(finished_at)) > 172800"))
def stale_sources(spark, sf):
    return health.stale(runs_with_status(spark, sf), F.expr("timestamp_ntz'2024-01-31 00:00:00'"))


@query("degraded_sources", _with("runs", f"{_FLAGS}, {_STATUS}", "SELECT source FROM rs GROUP BY 1 HAVING arg_max(status, finished_at) = 'partial'"))
def degraded_sources(spark, sf):
    return health.last_status(runs_with_status(spark, sf)).where("status = 'partial'").select("source")


@query("no_metrics_alert", fx.sql("runs", "SELECT count(*) FILTER (finished_at BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-03-02') = 0 AS absent FROM runs"))
def no_metrics_alert(spark, sf):
    return health.no_metrics(fx.runs(spark, sf), F.expr("timestamp_ntz'2024-03-01 00:00:00'"), F.expr("timestamp_ntz'2024-03-02 00:00:00'"))


@query("status_hold_islands", _with("runs", f"{_FLAGS}, {_STATUS}", """SELECT source, min(finished_at) AS since, max(finished_at) AS until FROM (
  SELECT source, finished_at, status, sum(CASE WHEN status = 'partial' THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY finished_at) AS g FROM rs) WHERE status = 'partial' GROUP BY source, g HAVING epoch(max(finished_at)) - epoch(min(finished_at)) >= 86400"""))
def status_hold_islands(spark, sf):
    return health.held(runs_with_status(spark, sf).select("source", F.col("finished_at").alias("at"), (F.col("status") == "partial").alias("on")), 86_400)


@query("breaker_runs", """SELECT source, min(ord) AS tripped_at FROM (SELECT source, ord, row_number() OVER (PARTITION BY source, g, ok ORDER BY ord) AS n, ok FROM (
  SELECT user_id AS source, event_id AS ord, event_type <> 'error' AND event_type <> 'view' AS ok, sum(CASE WHEN event_type <> 'error' AND event_type <> 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)) WHERE NOT ok AND n = 3 GROUP BY 1""")
def breaker_runs(spark, sf):
    e = fx.table(spark, sf, "events")
    return sync.breaker_trips(e.select(F.col("user_id").alias("source"), F.col("event_id").alias("ord"), (~F.col("event_type").isin("error", "view")).alias("ok")))


@query("upsert_sources", _with("src", _SRC2, """SELECT coalesce(o.name, n.name) AS name, CASE WHEN n.base_url IS NULL OR o.source_type = 'upload' THEN coalesce(o.base_url, n.base_url) ELSE n.base_url END AS base_url, coalesce(o.source_type, n.source_type) AS source_type
  FROM (SELECT * FROM s2 WHERE id % 5 <> 0) o FULL JOIN (SELECT name, 'https://new.' || name || '.dev/' AS base_url, source_type FROM s2 WHERE id % 2 = 0 OR id % 5 = 0) n ON n.name = o.name"""))
def upsert_sources(spark, sf):
    s = sources2(spark, sf)
    new = s.where("id % 2 = 0 or id % 5 = 0").select("name", F.concat(F.lit("https://new."), "name", F.lit(".dev/")).alias("base_url"), "source_type")
    return catalog.upsert_sources(s.where("id % 5 <> 0"), new)


@query("import_classes", _with("src", _SRC2, """SELECT f.name, CASE WHEN t.name IS NULL THEN 'created' WHEN t.base_url IS NOT DISTINCT FROM f.base_url AND t.cap IS NOT DISTINCT FROM f.cap THEN 'skipped' ELSE 'updated' END AS class
  FROM (SELECT name, base_url, CASE WHEN id % 4 = 0 THEN NULL ELSE id END AS cap FROM s2) f LEFT JOIN (SELECT name, base_url, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN id + 1 ELSE id END AS cap FROM s2 WHERE id % 6 <> 0) t ON t.name = f.name"""))
def import_classes(spark, sf):
    s = sources2(spark, sf)
    file = s.select("name", "base_url", F.when(F.col("id") % 4 != 0, F.col("id")).alias("cap"))
    table = s.where("id % 6 <> 0").select("name", "base_url", F.when(F.col("id") % 4 == 1, F.col("id") + 1).when(F.col("id") % 4 != 0, F.col("id")).alias("cap"))
    return catalog.import_classes(table, file, ["base_url", "cap"])


@query("delete_source_cascade", fx.sql("ck", "SELECT (SELECT count(*) FROM src WHERE id <> 3) AS sources, (SELECT count(*) FROM pg WHERE source_id <> 3) AS pages, (SELECT count(*) FROM ck WHERE source_id <> 3) AS chunks"))
def delete_source_cascade(spark, sf):
    s, p, c = catalog.delete_source(fx.sources(spark, sf), fx.pages(spark, sf), fx.chunks(spark, sf), 3)
    count = lambda df, n: df.agg(F.count("*").alias(n))
    return count(s, "sources").join(count(p, "pages")).join(count(c, "chunks"))


@query("replace_pages", fx.sql("prev", "SELECT url, content_hash FROM prev WHERE url NOT IN (SELECT url FROM pg WHERE id % 3 = 0) UNION ALL SELECT url, content_hash FROM pg WHERE id % 3 = 0"))
def replace_pages(spark, sf):
    return catalog.replace_pages(fx.previous(spark, sf).select("url", "content_hash"), fx.pages(spark, sf).where("id % 3 = 0").select("url", "content_hash"))


@query("refresh_validators", fx.sql("pg", "SELECT url, CASE WHEN id % 2 = 0 THEN 'new' ELSE 'old' END AS etag, CASE WHEN id % 4 = 0 THEN 'm' END AS last_modified FROM pg"))
def refresh_validators(spark, sf):
    p = fx.pages(spark, sf).select("id", "url", F.lit("old").alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    seen = p.where("id % 2 = 0").select("url", F.lit("new").alias("etag"), F.when(F.col("id") % 4 == 0, "m").alias("last_modified"))
    return catalog.refresh_validators(p, seen).select("url", "etag", "last_modified")


@query("keep_newest_n", "SELECT source AS \"table\", doc_id AS taken_at FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn FROM documents WHERE source IS NOT NULL) WHERE rn <= 5")
def keep_newest_n(spark, sf):
    d = fx.table(spark, sf, "documents").where("source is not null")
    return catalog.keep_newest(d.select(F.col("source").alias("table"), F.col("doc_id").alias("taken_at")), 5)


@query("duplicate_names", "SELECT sha256(text) AS name, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf):
    return catalog.duplicate_names(fx.table(spark, sf, "documents").select(F.sha2("text", 256).alias("name")))


@query("proposers", "SELECT user_id, 'token-' || sha256(user_id::VARCHAR)[1:16] AS proposed_by FROM (SELECT DISTINCT user_id FROM events)")
def proposers(spark, sf):
    return fx.table(spark, sf, "events").select("user_id").distinct().select("user_id", catalog.proposer(F.col("user_id").cast("string")).alias("proposed_by"))


@query("minute_bucket_dedupe", "SELECT user_id, date_trunc('minute', ts) AS minute, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def minute_bucket_dedupe(spark, sf):
    e = fx.table(spark, sf, "events").select("user_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), "event_id")
    return e.groupBy("user_id", "minute").agg(F.min("event_id").alias("event_id"))
