"""Queries over plans, reports and observations of files and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.config import Settings
from pagewright.functions.ranges import format_indices
from pagewright.operators import segmentation as seg
from pagewright.plans.page_queries import _IMG, _STRIP, LINES, SEGMENTS, _blank, _marked_lines, _pages_sql, _review_sql
from pagewright.plans.registry import query
from pagewright.session import table
from pagewright.sinks import plans
from pagewright.sources.describe import describer
from pagewright.sources.tables import conversation_pages, line_pages
from pagewright.streaming import gate, stability
from pagewright.workers import let_workers_import


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _marked_lines(spark, sf_dir)
    segs = seg.segments(pages, head=F.min(F.struct("index", "header", "markdown", "footer"))).withColumn("pages", format_indices(F.col("indices")))
    docs = segs.withColumns({f"first_{c}": F.col(f"head.{c}") for c in ("header", "markdown", "footer")})
    return docs.select("stack_id", "seg", "pages", "n_pages", seg.document_confidence().cast("string").alias("confidence"), seg.review_reason().alias("review_reason")).withColumns({"needs_review": F.col("review_reason") != "", "name": F.concat(F.lit("d"), F.col("seg").cast("string"), F.lit(".pdf"))})


@query(f"""WITH {SEGMENTS}, rv AS ({_review_sql('segs', 'lines')}), d AS (SELECT s.stack_id, s.seg, p.pages, s.n_pages, round(least(start_confidence, coalesce(join_confidence, 1)), 2)::DECIMAL(4,2)::VARCHAR AS c, rv.review_reason AS r
  FROM segs s JOIN {_pages_sql('sg', 'stack_id, seg', 'index', 'pages')} p USING (stack_id, seg) JOIN rv USING (stack_id, seg))
SELECT stack_id, sum(n_pages)::BIGINT || ' pages, ' || count(*) || ' documents, ' || count(*) FILTER (WHERE r <> '') || ' flagged for review.' || chr(10) || chr(10) || '| # | Pages | File | Confidence | Review |' || chr(10) || '|---|---|---|---|---|' || chr(10) ||
  string_agg('| ' || seg::BIGINT || ' | ' || pages || ' | d' || seg::BIGINT || '.pdf | ' || c || ' | ' || CASE WHEN r <> '' THEN '⚠ ' || r ELSE '' END || ' |', chr(10) ORDER BY seg) AS report FROM d GROUP BY stack_id""")
def review_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.review_report(_documents(spark, sf_dir), "stack_id", "seg")


@query(f"WITH {SEGMENTS}, rv AS ({_review_sql('segs', 'lines')}) SELECT s.stack_id, row_number() OVER (PARTITION BY s.stack_id ORDER BY s.seg) AS number, p.pages, rv.review_reason <> '' AS needs_review, rv.review_reason FROM segs s JOIN {_pages_sql('sg', 'stack_id, seg', 'index', 'pages')} p USING (stack_id, seg) JOIN rv USING (stack_id, seg)")
def plan_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans written as JSON and read again."""
    written = plans.to_plan(_documents(spark, sf_dir), "stack_id", "seg")
    return plans.from_plan(written, "stack_id").select("stack_id", "number", "pages", "needs_review", "review_reason")


@query(f"WITH {SEGMENTS}, p AS (SELECT stack_id, seg, index, row_number() OVER (PARTITION BY stack_id, seg ORDER BY index) - 1 AS place FROM sg) SELECT 's' || (stack_id % 40) || '/' || stack_id AS folder, 'document' || CASE WHEN seg = 1 THEN '' ELSE ' (' || seg::BIGINT || ')' END || '.pdf' AS name, seg::BIGINT AS number, place::INT AS place, index::BIGINT AS index FROM p")
def pages_to_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that a document sink writes, with free names in each folder."""
    docs = _documents(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("stack_id") % 40).cast("string"), F.lit("/"), F.col("stack_id").cast("string")).alias("folder"), F.lit("document").alias("stem"), F.col("seg").alias("number"), "pages")
    return plans.pages_to_write(docs, F.lit(1_000_000))


_SEEN = "SELECT user_id::VARCHAR AS path, floor(epoch(ts))::DOUBLE AS t, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 10 ELSE 20 END AS size, event_type <> 'click' AS complete FROM events"
_READY = "CASE WHEN r.size <> f.size THEN false WHEN r.size = 0 THEN r.t - f.since >= 600 ELSE r.t - f.since >= 300 AND (r.complete OR r.t - f.since >= 600) END"
_WARN = f"NOT ({_READY}) AND NOT (r.size = f.size AND r.size > 0 AND r.t - f.since < 300) AND NOT f.warned AND r.t - f.began >= 600"


@query(f"""WITH RECURSIVE o AS ({_SEEN}), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY t, size, complete) AS i FROM o),
f AS (SELECT path, i, t, size, t AS since, t AS began, false AS warned, false AS ready, false AS waiting_long FROM r WHERE i = 1
  UNION ALL SELECT r.path, r.i, r.t, r.size, CASE WHEN r.size = f.size THEN f.since ELSE r.t END, f.began, f.warned OR ({_WARN}), {_READY}, {_WARN} FROM f JOIN r ON r.path = f.path AND r.i = f.i + 1)
SELECT path, t AS at, ready, waiting_long FROM f""")
def stability_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of files: when each is ready."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double")
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("path"), at.alias("at"), F.when(kind == "error", 0).when(kind == "signup", 10).otherwise(20).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), (kind != "click").alias("complete")
    )
    return stability.readiness(rows, 300.0)


_STEPS = "SELECT user_id::VARCHAR AS key, floor(epoch(ts))::DOUBLE AS t, event_id AS n, CASE event_type WHEN 'error' THEN 'limit' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'skip' ELSE 'try' END AS step FROM events"
_ALLOWED = "(r.step <> 'try' OR NOT f.paused OR (NOT f.probing AND r.t >= f.next_probe))"


@query(f"""WITH RECURSIVE s AS ({_STEPS}), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, n) AS i FROM s),
f AS (SELECT key, i, t, step, true AS allowed, step = 'limit' AS paused, false AS probing, CASE WHEN step = 'limit' THEN t + 86400 ELSE 0 END AS next_probe FROM r WHERE i = 1
  UNION ALL SELECT r.key, r.i, r.t, r.step, {_ALLOWED}, CASE r.step WHEN 'limit' THEN true WHEN 'done' THEN false ELSE f.paused END,
    r.step = 'try' AND (f.probing OR (f.paused AND {_ALLOWED})), CASE WHEN r.step = 'limit' THEN r.t + 86400 ELSE f.next_probe END FROM f JOIN r ON r.key = f.key AND r.i = f.i + 1)
SELECT key, t AS at, step, allowed, paused FROM f""")
def pause_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of accounts: which files may start while an account is refused, with a probe a day."""
    kind = F.col("event_type")
    step = F.when(kind == "error", "limit").when(kind == "purchase", "done").when(kind == "signup", "skip").otherwise("try")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.col("event_id").alias("n"), step.alias("step"))
    return gate.gate(rows, 86_400.0)


@query(f"""WITH {LINES}, b AS (SELECT stack_id, index, {_blank()} AS blank FROM lines), k AS (SELECT * FROM b WHERE NOT blank), d AS (SELECT * FROM b WHERE blank), n AS (SELECT stack_id, count(*) AS page_count FROM b GROUP BY stack_id)
SELECT n.stack_id, n.page_count, 'file ' || n.stack_id AS title, coalesce(kp.pages, '') AS pages, coalesce(dp.pages, '') AS dropped_pages, CASE WHEN kp.pages IS NULL THEN 'every page of the scan is blank' END AS problem
FROM n LEFT JOIN {_pages_sql('k', 'stack_id', 'index', 'pages')} kp USING (stack_id) LEFT JOIN {_pages_sql('d', 'stack_id', 'index', 'pages')} dp USING (stack_id)""")
def keep_name_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks that keep their name: one document of all pages that aren't blank."""
    pages = line_pages(spark, sf_dir)
    return plans.keep_name_plans(pages, F.concat(F.lit("file "), F.col("stack_id").cast("string")), seg.is_blank())


@query(f"""WITH p AS (SELECT conv_id AS stack_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS index, coalesce(text, '') AS markdown FROM conversations),
t AS (SELECT stack_id, bool_or(role = 'system') AS known, string_agg('--- page ' || (index + 1) || ' ---' || chr(10) || {_STRIP(f"regexp_replace(markdown, '{_IMG}', '', 'g')")}, chr(10) || chr(10) ORDER BY index) AS x FROM p GROUP BY stack_id)
SELECT stack_id, CASE WHEN known THEN 'known ' || stack_id ELSE trim(left(regexp_replace(regexp_extract(x, '^--- page [0-9]+ ---\n([^\n]*)', 1), '[^A-Za-z0-9 ]+', '', 'g'), 40)) END AS title, NOT known AS asked FROM t""")
def described_by_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents described by a model as a table function in SQL: pages in, a record per document out; those with a system's turn have theirs already."""
    pages = conversation_pages(spark, sf_dir)
    known = pages.groupBy("stack_id").agg(F.bool_or(F.col("reason") == "role system").alias("known"))
    record = F.when(F.col("known"), F.to_json(F.struct(F.concat(F.lit("known "), F.col("stack_id").cast("string")).alias("title"))))
    rows = pages.join(known, "stack_id").select("stack_id", "index", "header", "markdown", "footer", record.alias("cached"))
    let_workers_import(spark)
    spark.udtf.register("describe_documents", describer())
    return spark.sql(f"SELECT stack_id, title, asked FROM describe_documents(TABLE({{pages}}), {Settings.metadata_max_chars})", pages=rows)
