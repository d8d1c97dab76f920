"""Smaller queries: decoding answers, visibility, places, names of folders, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import names
from pagewright.operators import layout, merge, records
from pagewright.plans.layout_queries import BLOCKS, WORDS, _blocks, _two_readings, _words
from pagewright.plans.page_queries import LINES
from pagewright.plans.record_queries import _stacks
from pagewright.plans.registry import query
from pagewright.session import table
from pagewright.sources import recognition
from pagewright.sources.tables import line_pages


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as answers of a service: five to a chunk, some fields missing, indices within the chunk in reverse."""
    rows = line_pages(spark, sf_dir).withColumn("start", (F.floor(F.col("index") / 5) * 5).cast("int"))
    page = F.struct((F.col("index") - F.col("start")).alias("index"), F.col("markdown"), F.when(F.col("header") != "", F.col("header")).alias("header"), F.when(F.col("has_images"), F.array(F.lit("img"))).alias("images"))
    chunks = rows.groupBy("stack_id", "start").agg(F.sort_array(F.collect_list(page), asc=False).alias("pages"))
    return chunks.select("stack_id", "start", F.to_json("pages").alias("answer"))


@query(f"WITH {LINES} SELECT stack_id, index, markdown, header, '' AS footer, has_images FROM lines")
def answer_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.decode_chunks(_answers(spark, sf_dir))


@query(f"WITH {LINES}, st AS (SELECT stack_id, count(*) AS total FROM lines GROUP BY stack_id), ch AS (SELECT stack_id, s::INT AS start, least(5, total - s)::INT AS expected FROM st, unnest(range(0, total, 5)) AS u(s)), g AS (SELECT stack_id, (index // 5 * 5)::INT AS start, count(*) AS got FROM lines WHERE index % 7 <> 3 GROUP BY ALL) SELECT stack_id, start, expected, coalesce(got, 0) AS got FROM ch LEFT JOIN g USING (stack_id, start) WHERE coalesce(got, 0) <> expected")
def chunk_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose answer lacks pages."""
    pages = line_pages(spark, sf_dir).filter("index % 7 <> 3")
    return recognition.short_chunks(pages, records.chunk_starts(_stacks(spark, sf_dir), 5), 5)


@query(f"WITH {LINES} SELECT stack_id, index, index = 0 AS starts_new, '1.0000' AS confidence, 'single document per file' AS reason FROM lines")
def single_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a file that is one document by definition."""
    first = F.row_number().over(W.partitionBy("stack_id").orderBy("index")) == 1
    return line_pages(spark, sf_dir).select("stack_id", "index", first.alias("starts_new"), F.lit("1.0000").alias("confidence"), F.lit("single document per file").alias("reason"))


@query("SELECT o_orderkey AS id, 'c' || o_custkey AS owner, o_orderstatus AS status FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def visible_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's own jobs, without what is private."""
    orders = table(spark, sf_dir, "orders")
    caller = orders.agg(F.min("o_custkey")).scalar()  # who asks
    return orders.filter(F.col("o_custkey") == caller).select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("owner"), F.col("o_orderstatus").alias("status"))


@query(f"""WITH {WORDS}, {BLOCKS} SELECT page, word_no, coalesce((SELECT b.block_no FROM blocks b WHERE b.page = w.page AND b.top + 100 * b.block_no > w.top ORDER BY b.top + 100 * b.block_no, b.block_no LIMIT 1), -1) AS before_block FROM words w""")
def paragraph_place_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block that begins below a word, in reading order; -1 if it goes to the end."""
    blocks = _blocks(spark, sf_dir).select("page", "block_no", (F.col("top") + F.col("block_no") * 100).alias("b_top"))
    words = _words(spark, sf_dir)
    below = words.select("page", "word_no", "top").join(blocks, "page").filter("b_top > top").groupBy("page", "word_no").agg(F.min(F.struct("b_top", "block_no")).alias("b"))
    return words.join(below, ["page", "word_no"], "left").select("page", "word_no", F.coalesce("b.block_no", F.lit(-1)).alias("before_block"))


@query("SELECT doc_id, source || '/' || lang || '/doc' || doc_id || '-' || left(sha256(coalesce(text, '')), 8) AS work FROM documents")
def work_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a file is worked on: profile, folder, and name with the start of its hash."""
    sha = F.left(F.sha2(F.coalesce("text", F.lit("")), 256), F.lit(8))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat_ws("-", F.concat(F.lit("doc"), F.col("doc_id").cast("string")), sha)).alias("work"))


@query("""WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, coalesce(html, '') AS html FROM pages), e AS (SELECT page_id, host, 'GET ' || url || ' failed: ' || html AS message FROM p)
SELECT page_id, left(CASE WHEN host = '' THEN message ELSE replace(message, host, '<host>') END, 300) AS error, md5(CASE WHEN host = '' THEN message ELSE replace(message, host, '<host>') END) AS whole FROM e""")
def error_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with what a service sent, without its host, which may be a secret."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.concat(F.lit("GET "), "url", F.lit(" failed: "), F.coalesce("html", F.lit(""))).alias("message"))
    safe = rows.select("page_id", F.when(F.col("host") == "", F.col("message")).otherwise(F.replace("message", F.col("host"), F.lit("<host>"))).alias("safe"))
    return safe.select("page_id", F.left("safe", F.lit(300)).alias("error"), F.md5("safe").alias("whole"))


@query("SELECT l_orderkey AS page, max(greatest(l_partkey % 300 + 72, l_suppkey % 300 + 72))::INT AS dpi FROM lineitem GROUP BY 1")
def max_image_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    dpi = lambda c: (F.col(c) % 300 + 72).cast("double")
    images = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), dpi("l_partkey").alias("dpi_x"), dpi("l_suppkey").alias("dpi_y"))
    return recognition.max_dpi(images, "page").select("page", F.col("dpi").cast("int").alias("dpi"))


@query("SELECT l_orderkey AS file, bool_and(l_linenumber <= 3) AS inherited FROM lineitem GROUP BY 1")
def inherited_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files all of whose problems were there before."""
    files = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.collect_set(F.concat(F.lit("p"), F.col("l_linenumber").cast("string"))).alias("problems"))
    return files.select("file", recognition.only_known(F.col("problems"), ["p1", "p2", "p3"]).alias("inherited"))


_FOLDER = "replace(replace(replace(replace(regexp_replace(url, '^[a-z]+://', ''), 'www.', '/'), 'm.', '../'), 'blog.', './'), '/de/', '/x/../../../')"


@query(f"""WITH f AS (SELECT page_id, {_FOLDER} AS folder FROM pages), s AS (SELECT page_id, folder, list_transform(string_split(folder, '/'), lambda x: CASE WHEN x = '..' THEN -1 WHEN x IN ('', '.') THEN 0 ELSE 1 END) AS steps FROM f)
SELECT page_id, folder, NOT starts_with(folder, '/') AND list_min(list_transform(range(1, len(steps) + 1), lambda i: list_sum(steps[1:i]))) >= 0 AS inside FROM s""")
def folder_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans may not name a folder outside of the output tree; the folders are pages' addresses, some with parts that climb."""
    rows = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", F.expr(_FOLDER).alias("folder"))
    return rows.withColumn("inside", names.is_inside(F.col("folder")))


@query()
def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines were kept, replaced and added, per block."""
    return merge.merge_stats(merge.merge_lines(*_two_readings(spark, sf_dir), "block"), "block")


@query(f"WITH {WORDS} SELECT page, bool_and(greatest(\"right\", bottom) <= 1100) AS small FROM words GROUP BY page")
def coordinate_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a page's coordinates stay below a bound, as the test for shares of the page asks."""
    return layout.union_boxes(_words(spark, sf_dir), "page").select("page", (F.greatest("right", "bottom") <= 1100).alias("small"))
