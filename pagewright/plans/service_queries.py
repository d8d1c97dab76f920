"""Queries around services: waits, caches, payloads, jobs, rights, routes and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.operators import segmentation as seg
from pagewright.operators import service
from pagewright.plans.page_queries import _IMG, _STRIP, LINES, LONG_STEP, LONG_WINDOW, _blank, _marker
from pagewright.plans.registry import query
from pagewright.session import table
from pagewright.sinks import plans
from pagewright.sources import answers, files, raster
from pagewright.sources.tables import conversation_pages, line_pages

_RETRY = "CASE event_id % 5 WHEN 0 THEN '90' WHEN 1 THEN 'soon' WHEN 2 THEN ' 500 ' WHEN 3 THEN '1' END"


@query(f"""WITH r AS (SELECT event_id, (event_id % 8 + 1)::DOUBLE AS attempt, {_RETRY} AS ra, (event_id % 100) / 100.0::DOUBLE AS jitter FROM events)
SELECT event_id, round(greatest(least(60.0, 2 ** attempt) + jitter, least(coalesce(TRY_CAST(trim(ra) AS DOUBLE), 0), 120)) * 100)::BIGINT AS centis FROM r""")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long to wait before each next attempt."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 8 + 1).cast("double").alias("attempt"), F.expr(_RETRY).alias("ra"), (F.col("event_id") % 100 / F.lit(100.0)).alias("jitter"))
    return rows.select("event_id", F.round(service.retry_delay(F.col("attempt"), F.col("ra"), F.col("jitter")) * 100).cast("long").alias("centis"))


@query("""WITH r AS (SELECT user_id, event_id, floor(epoch(ts))::DOUBLE AS arrival, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT user_id, event_id, (max(arrival - i * 43200) OVER (PARTITION BY user_id ORDER BY i) + i * 43200)::BIGINT AS start FROM r""")
def rate_limited_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each request of an account may start, half a day apart at least."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("arrival"))
    return service.spaced_starts(rows, "user_id", ["ts", "event_id"], "arrival", 43_200.0).select("user_id", "event_id", F.col("start").cast("long").alias("start"))


@query("""WITH l AS (SELECT DISTINCT lang, coalesce(text, '') AS said FROM documents JOIN labels USING (doc_id)) SELECT doc_id, 'answer to ' || md5(d.lang || coalesce(text, '')) AS answer, l.said IS NOT NULL AS cached FROM documents d LEFT JOIN l ON l.lang = d.lang AND l.said = coalesce(text, '')""")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests against a cache, which holds answers to those with a label: equal ones are asked once, cached ones never."""
    rows = table(spark, sf_dir, "documents").select("doc_id", service.request_key(F.lit("model"), F.col("lang"), F.coalesce("text", F.lit(""))).alias("key"), F.md5(F.concat("lang", F.coalesce("text", F.lit("")))).alias("said"))
    answer = F.concat(F.lit("answer to "), F.min("said")).alias("answer")
    cache = rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("key").agg(answer)
    found, fresh = service.answered(rows, cache, lambda missing: missing.groupBy("key").agg(answer))
    return found.join(fresh.select("key", F.lit(False).alias("old")), "key", "left").select("doc_id", "answer", F.coalesce("old", F.lit(True)).alias("cached"))


_K, _N = (_marker("header", "markdown", "footer", g) for g in (1, 2))
_CONTENT = f"""{LINES}, ct AS (SELECT *, row_number() OVER (PARTITION BY stack_id ORDER BY index) - 1 AS pos, count(*) OVER (PARTITION BY stack_id) AS n FROM lines WHERE NOT {_blank()}),
sw AS (SELECT stack_id, n, unnest(list_distinct(CASE WHEN n <= 12 THEN [0] ELSE list_concat(range(0, n - 11, 6), [n - 12]) END)) AS start FROM (SELECT DISTINCT stack_id, n FROM ct)),
tx AS (SELECT *, {_STRIP(f"regexp_replace(markdown, '{_IMG}', '[image]', 'g')")} AS t FROM ct),
pg AS (SELECT stack_id, pos, struct_pack(page := index + 1, page_marker := {_K} || ' of ' || {_N}, header := nullif(left(trim(header), 300), ''), footer := nullif(left(trim(footer), 300), ''),
  "text" := CASE WHEN length(t) <= 1600 THEN t ELSE left(t, 1200) || chr(10) || '[...]' || chr(10) || right(t, 400) END) AS x FROM tx)"""


@query(f"""WITH {_CONTENT} SELECT sw.stack_id, start::INT AS start, count(*) AS pages, md5(to_json(list(x ORDER BY pos))::VARCHAR) AS payload FROM sw JOIN pg ON pg.stack_id = sw.stack_id AND pos BETWEEN start AND start + 11 GROUP BY ALL""")
def window_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is asked about each of the overlapping windows of content pages: their excerpts, markers, headers and footers; a digest of the JSON text."""
    pages = seg.content_positions(line_pages(spark, sf_dir))
    members = seg.window_members(pages.select("stack_id", "n_content").distinct(), LONG_WINDOW, LONG_STEP)
    mark = text.page_marker(F.col("header"), F.col("markdown"), F.col("footer"))
    marked = pages.drop("n_content").withColumn("mark", mark)
    marker = F.concat(F.col("mark.k").cast("string"), F.lit(" of "), F.col("mark.n").cast("string"))
    made = service.window_payloads(marked, members.select("stack_id", "start", "pos"), marker, text.excerpt(F.col("markdown")))
    return made.select("stack_id", "start", F.json_array_length("payload").cast("long").alias("pages"), F.md5("payload").alias("payload"))


@query("""WITH p AS (SELECT conv_id AS stack_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS index, role, coalesce(text, '') AS t FROM conversations)
SELECT stack_id, 0 AS start, index::INT AS index, role = 'user' AS starts_new, greatest(0.0, least(1.0, (length(t) % 300 - 50) / 200.0::DOUBLE))::DOUBLE AS confidence, left(t, 200) AS reason FROM p WHERE role <> 'system'""")
def window_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts out of a model's answers about a conversation's turns: what it says of a system's turn, and of a page that isn't there, goes, numbers are kept within bounds, reasons are cut."""
    pages = conversation_pages(spark, sf_dir)
    item = F.struct((F.col("index") + 1).alias("page"), (F.col("reason") == "role user").alias("starts_new_document"), ((F.length("markdown") % 300 - 50) / F.lit(200.0)).alias("confidence"), F.col("markdown").alias("reason"))
    beyond = F.struct((F.count("*") + 7).cast("int").alias("page"), F.lit(True).alias("starts_new_document"), F.lit(1.0).alias("confidence"), F.lit("not there").alias("reason"))
    listed = F.array_append(F.collect_list(item), beyond)
    answers_ = pages.groupBy("stack_id").agg(F.to_json(F.struct(listed.alias("pages"))).alias("answer")).select("stack_id", F.lit(0).alias("start"), "answer")
    return service.window_answers(answers_, pages.where("reason <> 'role system'").select("stack_id", F.lit(0).alias("start"), "index"))


@query("""WITH j AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS kind, strftime(max(ts), '%Y-%m-%d') AS day FROM events GROUP BY 1)
SELECT id, CASE kind WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status, CASE WHEN kind IN ('purchase', 'error') THEN day END AS started_at FROM j""")
def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as jobs, in the state that their last event says, after a restart: those that ran wait again."""
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"))
    kind = F.col("x.event_type")
    status = F.when(kind == "view", "running").when(kind == "purchase", "done").when(kind == "error", "failed").otherwise("queued")
    started = F.when(kind.isin("view", "purchase", "error"), F.date_format("x.ts", "yyyy-MM-dd"))
    return service.recovered(last.select("id", status.alias("status"), started.alias("started_at")))


@query("""WITH j AS (SELECT o_orderkey AS id, o_orderstatus AS s, strftime(o_orderdate, '%Y-%m-%d') AS c FROM orders), f AS (SELECT id FROM j WHERE s = 'O' ORDER BY c, id LIMIT 1)
SELECT id, CASE WHEN id IN (SELECT id FROM f) THEN 'running' WHEN s = 'O' THEN 'queued' ELSE 'done' END AS status FROM j""")
def job_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after the oldest waiting one was taken."""
    status = F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"), F.lit(None).cast("string").alias("started_at"))
    return service.claimed(rows, F.lit("now")).select("id", "status")


@query("""SELECT 'https://' || o_custkey || '.example' AS url, o_orderkey AS id, '{"id":' || o_orderkey || ',"status":"' || CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'failed' END || '","message":"' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'broken' END || '","links":{"result":"/jobs/' || o_orderkey || '"}}' AS body
FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_custkey % 2 = 1""")
def callback_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What callers are told when their job is finished."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("queued")
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), status.alias("status"), F.when(F.col("o_orderstatus") == "P", "broken").alias("error"),
        F.when(F.col("o_custkey") % 2 == 1, F.concat(F.lit("https://"), F.col("o_custkey").cast("string"), F.lit(".example"))).alias("callback_url"), F.struct(F.concat(F.lit("/jobs/"), key).alias("result")).alias("links"),
    )
    return service.callbacks(rows)


@query("""WITH f AS (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE 'n' || c_nationkey END AS folder, c_mktsegment AS stem, CASE c_custkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'duplicates' ELSE 'archive' END AS root FROM customer),
n AS (SELECT *, row_number() OVER (PARTITION BY root, folder, stem ORDER BY c_custkey) AS r FROM f)
SELECT c_custkey, root || '/' || CASE WHEN folder = '' THEN '' ELSE folder || '/' END || stem || CASE WHEN r = 1 THEN '' ELSE ' (' || r || ')' END || '.pdf' AS target FROM n""")
def archive_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where files go that are done with."""
    outcome = F.when(F.col("c_custkey") % 4 == 0, "failed").when(F.col("c_custkey") % 4 == 1, "duplicate").otherwise("done")
    folder = F.when(F.col("c_nationkey") % 3 == 0, "").otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", folder.alias("folder"), F.col("c_mktsegment").alias("stem"), F.lit(".pdf").alias("suffix"), outcome.alias("outcome"))
    return service.routes(rows, "c_custkey").select("c_custkey", "target")


@query("""WITH u AS (SELECT DISTINCT c_nationkey::BIGINT AS id FROM customer), o AS (SELECT p_partkey AS id, CASE WHEN p_size % 6 = 0 THEN NULL ELSE (p_size % 25)::BIGINT END AS owner FROM part),
w AS (SELECT o.id, owner, list(u.id ORDER BY u.id) AS wanted FROM o, u WHERE owner IS NOT NULL AND u.id <> owner GROUP BY o.id, owner)
SELECT id, owner, array_to_string(wanted, ',') AS viewers FROM w WHERE id % 3 <> 0""")
def permission_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose rights differ from what they are to be."""
    users = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("id"))
    every = users.agg(F.array_sort(F.collect_set("id")).alias("ids")).scalar()
    owner = F.when(F.col("p_size") % 6 != 0, (F.col("p_size") % 25).cast("long"))
    right = F.reverse(F.filter("every", lambda u: u != F.col("owner")))  # in another order, which is no difference
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), owner.alias("owner")).withColumn("every", every).withColumn("viewers", F.when(F.col("id") % 3 == 0, right)).withColumns({"changers": F.lit(None).cast("array<bigint>"), "groups": F.lit(None).cast("array<bigint>")})
    return service.permission_changes(rows, users).select("id", "owner", F.array_join("viewers", ",").alias("viewers"))


@query("""WITH t AS (SELECT max(c_name) AS name, sha256('key_' || c_mktsegment) AS h FROM customer GROUP BY c_mktsegment), r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'key_' END || CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE c_mktsegment END AS token FROM customer)
SELECT c_custkey, CASE WHEN starts_with(token, 'key_') THEN name END AS owner FROM r LEFT JOIN t ON sha256(token) = h""")
def token_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom a token belongs to, by its hash."""
    c = table(spark, sf_dir, "customer")
    tokens = c.select(F.col("c_name").alias("name"), F.sha2(F.concat(F.lit("key_"), "c_mktsegment"), 256).alias("sha256"))
    token = F.concat(F.when(F.col("c_custkey") % 3 == 0, "").otherwise("key_"), F.when(F.col("c_custkey") % 5 == 0, "none").otherwise(F.col("c_mktsegment")))
    return service.token_owner(c.select("c_custkey", token.alias("token")), tokens, "key_").select("c_custkey", F.col("name").alias("owner"))


@query(f"""WITH {LINES}, i AS (SELECT stack_id, index, length(markdown) % 50 AS m FROM lines WHERE NOT (stack_id % 4 = 0 AND index = 0)), c AS (SELECT stack_id, count(*) AS n FROM lines GROUP BY stack_id), d AS (SELECT stack_id, count(*) AS n FROM i GROUP BY stack_id)
SELECT l.stack_id, l.index, coalesce(m, -1)::BIGINT AS ink, coalesce(d.n, 0) <> c.n AS differ FROM lines l LEFT JOIN i USING (stack_id, index) JOIN c ON c.stack_id = l.stack_id LEFT JOIN d ON d.stack_id = l.stack_id""")
def ink_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their measured ink, and whether a stack's measurements are one per page."""
    pages = line_pages(spark, sf_dir).drop("ink")
    ink = pages.filter("not (stack_id % 4 = 0 and index = 0)").select("stack_id", "index", (F.length("markdown") % 50).cast("long").alias("ink"))
    return service.with_ink(pages, ink).select("stack_id", "index", F.coalesce("ink", F.lit(-1)).alias("ink"), F.col("problem").isNotNull().alias("differ"))


@query(f"""WITH {LINES} SELECT stack_id, index, CASE WHEN stack_id % 3 = 0 THEN reverse(markdown) ELSE markdown END AS markdown, CASE WHEN stack_id % 3 = 0 THEN '' ELSE header END AS header, stack_id % 3 = 0 OR has_images AS has_images FROM lines""")
def text_source_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' texts from the text layer or from what was read, as each stack is set."""
    read = line_pages(spark, sf_dir)
    layer = read.select("stack_id", "index", F.reverse("markdown").alias("text"))
    return service.page_texts(layer, read, F.when(F.col("stack_id") % 3 == 0, "layer").otherwise("read")).select("stack_id", "index", "markdown", "header", "has_images")


@query(f"""WITH {LINES}, a AS (SELECT stack_id, index FROM lines WHERE index % 2 = 0 UNION ALL SELECT stack_id, index FROM lines WHERE index % 2 = 1 UNION ALL SELECT stack_id, index FROM lines WHERE index = 0) SELECT stack_id, count(*) AS n, sum(index)::BIGINT AS total FROM a GROUP BY stack_id""")
def result_pages_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages of several chunks, one behind the other; repeated ones stay."""
    pages = line_pages(spark, sf_dir).select("stack_id", "index")
    every = pages.filter("index % 2 = 0").unionByName(pages.filter("index % 2 = 1")).unionByName(pages.filter("index = 0"))
    return every.groupBy("stack_id").agg(F.count("*").alias("n"), F.sum("index").alias("total"))


@query("SELECT l_orderkey, array_to_string(list(l_suppkey * 997 % 65536 // 256 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), ',') AS grey FROM lineitem GROUP BY l_orderkey")
def to_8bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit grey values to 8 bits."""
    values = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(values.alias("v"))
    wide = F.transform("v", lambda x: x["l_suppkey"] * 997 % 65536)
    return rows.select("l_orderkey", F.array_join(raster.to_8bit(wide).cast("array<string>"), ",").alias("grey"))


_INBOX = "SELECT '/in/' || CASE c_custkey % 5 WHEN 0 THEN 'duplicates/' WHEN 1 THEN '.hidden/' WHEN 2 THEN c_mktsegment || '/' ELSE '' END || c_name || CASE WHEN c_custkey % 3 = 0 THEN '.PDF' WHEN c_custkey % 7 = 0 THEN '.txt' ELSE '.pdf' END AS path FROM customer"


@query(f"WITH f AS ({_INBOX}) SELECT count(*) AS n FROM f WHERE lower(path) LIKE '%.pdf' AND path NOT LIKE '%/.%' AND path NOT LIKE '/in/duplicates/%'")
def inbox_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files wait in an inbox, without hidden ones and one of its folders."""
    listed = spark.sql(_INBOX.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return files.count_candidates(listed, "/in", "duplicates")


_WORK = "SELECT user_id AS folder, CASE event_type WHEN 'view' THEN 'searchable' WHEN 'signup' THEN 'upload' ELSE 'page' END AS kind, ts AS mtime, event_id % 1000 AS size FROM events WHERE event_type <> 'signup' OR user_id % 2 = 0"


@query(f"""WITH f AS ({_WORK}), g AS (SELECT folder, max(mtime) AS lc, sum(size)::BIGINT AS bytes FROM f GROUP BY folder HAVING bool_or(kind = 'searchable') AND NOT bool_or(kind = 'upload'))
SELECT folder, bytes FROM g WHERE folder % 7 <> 0 AND lc <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def retention_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work folders that uploads which failed have left."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "searchable").when(F.col("event_type") == "signup", "upload").otherwise("page")
    rows = events.filter("event_type <> 'signup' OR user_id % 2 = 0").select(F.col("user_id").alias("folder"), kind.alias("kind"), F.col("ts").alias("mtime"), (F.col("event_id") % 1000).alias("size"))
    active = events.filter("user_id % 7 = 0").select(F.col("user_id").alias("folder")).distinct()
    return service.expired_uploads(rows, active, events.agg(F.max("ts")).scalar() - F.expr("INTERVAL 1 HOUR"), 30).select("folder", "bytes")


@query("WITH g AS (SELECT user_id AS name, max(ts) AS lc, sum(event_id % 1000)::BIGINT AS bytes FROM events GROUP BY user_id) SELECT name, bytes FROM g WHERE lc <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY")
def retention_temporary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporary entries that nothing has changed for two days."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("name"), F.col("ts").alias("mtime"), (F.col("event_id") % 1000).alias("size"))
    return service.expired_temporary(rows, events.agg(F.max("ts")).scalar(), 30).select("name", "bytes")


@query("""SELECT event_id, '{"ts":"' || strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.000Z","level":"INFO","event":"' || event_type || '","user":"' || user_id || '"' || CASE WHEN event_id % 2 = 0 THEN ',"source":"own"}' ELSE ',"source":"log"}' END AS line FROM events""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a log."""
    user, none = F.col("user_id").cast("string"), F.lit(None).cast("string")
    fields = F.create_map(F.lit("user"), user, F.lit("thread"), F.lit("reserved"), F.lit("_own"), F.lit("hidden"), F.lit("level"), F.lit("twice"), F.lit("pageno"), none)
    fields = F.when(F.col("event_id") % 2 == 0, F.map_concat(fields, F.create_map(F.lit("source"), F.lit("own")))).otherwise(fields)
    rows = table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("at"), F.lit("INFO").alias("level"), F.col("event_type").alias("event"), F.lit("log").alias("source"), fields.alias("fields"))
    return service.log_lines(rows, ["event_id"])


@query(f"""WITH {LINES}, d AS (SELECT stack_id, index, index % 4 = 0 AS s FROM lines) SELECT stack_id, '[' || string_agg('{{"page":' || (index + 1) || ',"starts_new":' || s || ',"confidence":0.5,"reason":"r ' || index || '"}}', ',' ORDER BY index) || ']' AS decisions FROM d GROUP BY stack_id""")
def decisions_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page with its reason, as JSON text."""
    rows = line_pages(spark, sf_dir).select("stack_id", "index", (F.col("index") % 4 == 0).alias("starts_new"), F.lit(0.5).alias("confidence"), F.concat(F.lit("r "), F.col("index").cast("string")).alias("reason"))
    return plans.to_decisions(rows, "stack_id")


_ANSWER = """CASE event_type WHEN 'view' THEN '{"custom_id":"u' || user_id || '","response":{"status_code":200,"body":' || props || '}}' WHEN 'click' THEN '{"custom_id":"u' || user_id || '","response":{"status_code":200,"body":[' || props || ']}}'
  WHEN 'purchase' THEN '{"custom_id":"u' || user_id || '","response":{"status_code":200,"body":null}}' WHEN 'signup' THEN '{"custom_id":"u' || user_id || '","response":{"status_code":429,"body":' || props || '}}' ELSE '{"custom_id":"u' || user_id || '","response":' || props END"""


@query(f"""WITH l AS (SELECT event_id, {_ANSWER} AS value FROM events), v AS (SELECT event_id, CASE WHEN json_valid(value) THEN value::JSON END AS v FROM l)
SELECT v->>'$.custom_id' AS custom_id, arg_max((v->>'$.response.body.k')::BIGINT, event_id) AS k, true AS is_object FROM v WHERE (v->>'$.response.status_code') = '200' AND json_type(v, '$.response.body') = 'OBJECT' GROUP BY 1""")
def variant_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch job's lines as variants: broken ones, arrays, null bodies and refusals are left out, and the last answer to each request counts."""
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("number"), F.expr(_ANSWER).alias("value"))
    found = answers.batch_answers(lines)
    return found.select("custom_id", answers.field(F.col("body"), "$.k", "long").alias("k"), answers.is_object(F.col("body")).alias("is_object"))
