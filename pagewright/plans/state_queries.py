"""Queries over tables that change: ledgers and written documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import records as bookkeeping
from pagewright.plans.registry import query
from pagewright.session import table
from pagewright.shared import scratch_path
from pagewright.sinks.committed import records, write_committed
from pagewright.sinks.ledger import UPLOADS, Ledger, archived, uploaded
from pagewright.streaming import timers


@query("""WITH f AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha, lang || '/' || source AS file, lang FROM documents),
a AS (SELECT sha, min(doc_id) AS document, arg_min(file, doc_id) AS file FROM f WHERE lang IN ('de', 'en') GROUP BY sha),
b AS (SELECT DISTINCT sha FROM f JOIN labels USING (doc_id)),
c AS (SELECT sha, min(doc_id) AS document, arg_min(file, doc_id) AS file FROM f GROUP BY sha)
SELECT c.sha, coalesce(a.document, c.document) AS document, coalesce(a.file, c.file) AS file, a.sha IS NULL OR b.sha IS NULL AS pending, 3 AS version FROM c LEFT JOIN a USING (sha) LEFT JOIN b USING (sha)""")
def ledger_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of uploads after three changes: the documents of two languages are uploaded, those of them with a label archived, and then all documents uploaded, of which those that the ledger has stay."""
    files = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.concat_ws("/", "lang", "source").alias("file"))

    def first(some: DataFrame) -> DataFrame:
        return some.groupBy("sha").agg(F.min(F.struct("doc_id", "file")).alias("x")).select("sha", F.col("x.doc_id").alias("document"), "x.file")

    ledger = Ledger.create(spark, scratch_path(spark, "ledger"), UPLOADS, "sha", 16)
    uploaded(ledger, first(files.where(F.col("lang").isin("de", "en"))))
    archived(ledger, files.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"))
    last = uploaded(ledger, first(files))
    return ledger.read(last.number).withColumn("version", F.lit(last.number))


@query("""WITH d AS (SELECT lang, source, text, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents)
SELECT lang AS folder, source || CASE WHEN r = 1 THEN '' ELSE ' (' || r || ')' END || '.txt' AS name, sha256(coalesce(text, '')) AS sha256, sha256(coalesce(text, '')) AS recorded FROM d""")
def committed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files of a language's folder under free names, as the folder and the records have them."""
    root = scratch_path(spark, "documents")
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.concat_ws("/", "lang", "source").alias("plan"), F.col("doc_id").alias("number"), F.col("lang").alias("folder"), F.col("source").alias("stem"), F.lit(".txt").alias("suffix"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    write_committed(rows, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    there = files.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), F.sha2("content", 256).alias("sha256"))
    named = records(spark, root).select(F.substring_index("name", "/", 1).alias("folder"), F.substring_index("name", "/", -1).alias("name"), F.col("sha256").alias("recorded"))
    return there.join(named, ["folder", "name"], "full")


@query("""WITH p AS (SELECT event_type AS kind, user_id::VARCHAR AS id, date_diff('day', DATE '2024-01-01', ts::DATE) AS round, count(*)::VARCHAR AS body FROM events GROUP BY ALL),
r AS (SELECT kind, round, row_number() OVER (PARTITION BY kind ORDER BY round) AS n FROM (SELECT DISTINCT kind, round FROM p)),
q AS (SELECT p.*, r.n FROM p JOIN r USING (kind, round))
SELECT q.kind, q.id, q.round, CASE WHEN b.id IS NULL THEN 'added' ELSE 'changed' END AS change, q.body FROM q LEFT JOIN q b ON b.kind = q.kind AND b.id = q.id AND b.n = q.n - 1 WHERE b.id IS NULL OR b.body <> q.body
UNION ALL SELECT b.kind, b.id, r.round, 'gone', b.body FROM q b JOIN r ON r.kind = b.kind AND r.n = b.n + 1 LEFT JOIN q ON q.kind = b.kind AND q.id = b.id AND q.n = b.n + 1 WHERE q.id IS NULL""")
def snapshot_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's users of a kind of event as a snapshot with their numbers of events, streamed: what was added, changed or gone since the day before."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    seen = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("id"), day.alias("round")).agg(F.count("*").cast("string").alias("body"))
    inputs, outputs, state = (scratch_path(spark, f"differences-{x}") for x in ("in", "out", "state"))
    rows = timers.in_buckets(seen, seen.select("kind", "round").distinct(), 8)
    rows.write.parquet(inputs)
    stream = timers.differences(spark.readStream.schema(rows.schema).parquet(inputs))
    stream.writeStream.format("parquet").option("path", outputs).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(timers.CHANGE).parquet(outputs).select("kind", "id", "round", "change", "body")


_NAMED = "SELECT lang AS kind, doc_id AS id, CASE WHEN n_chars > 500 THEN ' ' ELSE '' END || CASE WHEN n_chars > 300 THEN translate(left(text, 3), 'AEIOUST', 'aeioust') ELSE left(text, 3) END AS name, CASE WHEN source NOT IN ('src0', 'src1', 'src2') THEN source END AS owner, n_chars < 150 AS refused FROM documents WHERE text <> ''"


@query(f"""WITH RECURSIVE o AS ({_NAMED}), n AS (SELECT *, replace(lower(trim(name, ' ' || chr(9) || chr(10))), 'ß', 'ss') AS folded FROM o), r AS (SELECT *, row_number() OVER (PARTITION BY kind, folded ORDER BY owner IS NOT NULL, id) AS i FROM n),
f AS (SELECT kind, folded, i, id, owner, CASE WHEN owner IS NULL OR NOT refused THEN [name] ELSE [] END AS taken, CASE WHEN owner IS NULL OR NOT refused THEN id END AS last, owner IS NULL OR NOT refused AS shared, NULL::BIGINT AS same_name_as FROM r WHERE i = 1
  UNION ALL SELECT r.kind, r.folded, r.i, r.id, r.owner, CASE WHEN (r.owner IS NULL OR NOT (r.refused OR list_contains(f.taken, r.name))) THEN list_append(f.taken, r.name) ELSE f.taken END,
    CASE WHEN (r.owner IS NULL OR NOT (r.refused OR list_contains(f.taken, r.name))) THEN r.id ELSE f.last END, r.owner IS NULL OR NOT (r.refused OR list_contains(f.taken, r.name)),
    CASE WHEN r.owner IS NULL OR NOT (r.refused OR list_contains(f.taken, r.name)) THEN NULL ELSE f.last END FROM f JOIN r ON r.kind = f.kind AND r.folded = f.folded AND r.i = f.i + 1)
SELECT kind, id, shared, coalesce(same_name_as, -1) AS same_name_as FROM f WHERE owner IS NOT NULL""")
def shares_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as objects named by their first letters, shared one after another, where each that succeeds takes its name."""
    name = F.concat(F.when(F.col("n_chars") > 500, " ").otherwise(""), F.when(F.col("n_chars") > 300, F.translate(F.left("text", F.lit(3)), "AEIOUST", "aeioust")).otherwise(F.left("text", F.lit(3))))
    owner = F.when(~F.col("source").isin("src0", "src1", "src2"), F.col("source"))
    objects = table(spark, sf_dir, "documents").where("text <> ''").select(F.col("lang").alias("kind"), F.col("doc_id").alias("id"), F.col("doc_id").alias("place"), name.alias("name"), owner.alias("owner"), (F.col("n_chars") < 150).alias("refused"))
    return bookkeeping.shares_in_turn(objects, ["kind"]).select("kind", "id", "shared", F.coalesce("same_name_as", F.lit(-1)).alias("same_name_as"))
