"""Queries over boxes, words and lines; line items stand for words, orders for pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.operators import layout, tree
from pagewright.operators.alignment import assign_words
from pagewright.operators.merge import merge_lines
from pagewright.plans.registry import query
from pagewright.session import table

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
WORDS = f"""words AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) - 1 AS word_no, (l_partkey * 7 % 900)::DOUBLE AS "left", (l_suppkey * 13 % 1200)::DOUBLE AS top,
  (l_partkey * 7 % 900 + 10 + l_quantity * 2)::DOUBLE AS "right", (l_suppkey * 13 % 1200 + 12)::DOUBLE AS bottom, CASE WHEN l_partkey % 17 <> 0 THEN (l_partkey % 100) / 100.0::DOUBLE END AS confidence FROM lineitem)"""
BLOCKS = """blocks AS (SELECT o_orderkey AS page, b::INT AS block_no, (b * 300)::DOUBLE AS "left", (o_custkey % 300)::DOUBLE AS top, (b * 300 + 320)::DOUBLE AS "right", (o_custkey % 300 + 500)::DOUBLE AS bottom FROM orders, range(3) AS t(b) WHERE o_orderkey % 5 <> 0)"""
_CLAIMED = """claimed AS (SELECT w.page, w.word_no, min(b.block_no) AS block_no FROM words w JOIN blocks b ON w.page = b.page AND w."left" + w."right" BETWEEN 2 * b."left" AND 2 * b."right" AND w.top + w.bottom BETWEEN 2 * b.top AND 2 * b.bottom GROUP BY ALL)"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    x, y = F.col("l_partkey") * 7 % 900, F.col("l_suppkey") * 13 % 1200
    return rows.select(
        F.col("l_orderkey").alias("page"), (F.row_number().over(order) - 1).alias("word_no"), x.cast("double").alias("left"), y.cast("double").alias("top"),
        (x + 10 + F.col("l_quantity") * 2).cast("double").alias("right"), (y + 12).cast("double").alias("bottom"), F.when(F.col("l_partkey") % 17 != 0, (F.col("l_partkey") % 100) / F.lit(100.0)).alias("confidence"),
    )


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(2))))
    left, top = F.col("b") * 300, F.col("o_custkey") % 300
    return rows.select(F.col("o_orderkey").alias("page"), F.col("b").alias("block_no"), left.cast("double").alias("left"), top.cast("double").alias("top"), (left + 320).cast("double").alias("right"), (top + 500).cast("double").alias("bottom"))


@query(f"WITH {WORDS}, {BLOCKS}, {_CLAIMED} SELECT * FROM claimed")
def word_block_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.words_in_blocks(_words(spark, sf_dir), _blocks(spark, sf_dir))


@query(f"WITH {WORDS}, {BLOCKS}, {_CLAIMED} SELECT page, word_no FROM words w WHERE NOT (coalesce(confidence < 0.6, false) AND page IN (SELECT page FROM blocks) AND NOT EXISTS (SELECT 1 FROM claimed c WHERE c.page = w.page AND c.word_no = w.word_no))")
def noise_words_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, blocks = _words(spark, sf_dir), _blocks(spark, sf_dir)
    return layout.without_noise(words, layout.words_in_blocks(words, blocks), blocks).select("page", "word_no")


_RAW = """raw AS (SELECT page, word_no AS block_no, CASE word_no % 4 WHEN 0 THEN 'table' ELSE 'text' END AS kind, CASE WHEN page % 3 = 0 THEN "left" / 1024.0 ELSE "left" END AS x1, CASE WHEN page % 3 = 0 THEN top / 2048.0 ELSE top END AS y1,
  CASE WHEN word_no % 6 = 5 THEN NULL WHEN page % 3 = 0 THEN "right" / 1024.0 ELSE "right" END AS x2, CASE WHEN page % 3 = 0 THEN bottom / 2048.0 ELSE bottom END AS y2, CASE WHEN page % 4 = 1 THEN NULL ELSE 512.0::DOUBLE END AS dim_w, 1024.0::DOUBLE AS dim_h FROM words)"""


@query(f"""WITH {WORDS}, {_RAW}, s AS (SELECT *, max(greatest(coalesce(x1, 0), coalesce(y1, 0), coalesce(x2, 0), coalesce(y2, 0))) OVER (PARTITION BY page) <= 1.0 AS shares FROM raw),
b AS (SELECT page, block_no, kind, x1, y1, x2, y2, CASE WHEN shares THEN 1024.0 ELSE coalesce(1024.0 / dim_w, 1.0) END AS sx, CASE WHEN shares THEN 2048.0 ELSE 2048.0 / dim_h END AS sy FROM s WHERE x2 IS NOT NULL AND kind = 'text'),
c AS (SELECT page, block_no, greatest(0.0, x1 * sx) AS a, least(1024.0, x2 * sx) AS b, greatest(0.0, y1 * sy) AS c, least(2048.0, y2 * sy) AS d FROM b)
SELECT page, block_no, floor(least(a, b) * 8)::BIGINT AS l, floor(least(c, d) * 8)::BIGINT AS t, floor(greatest(a, b) * 8)::BIGINT AS r, floor(greatest(c, d) * 8)::BIGINT AS bt FROM c WHERE abs(b - a) >= 1 AND abs(d - c) >= 1""")
def blocks_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in pixels of another size, or as shares, brought to one page image."""
    w = _words(spark, sf_dir)
    part = lambda c, by: F.when(F.col("page") % 3 == 0, F.col(c) / F.lit(by)).otherwise(F.col(c))
    raw = w.select(
        "page", F.col("word_no").alias("block_no"), F.when(F.col("word_no") % 4 == 0, "table").otherwise("text").alias("kind"), part("left", 1024.0).alias("x1"), part("top", 2048.0).alias("y1"),
        F.when(F.col("word_no") % 6 != 5, part("right", 1024.0)).alias("x2"), part("bottom", 2048.0).alias("y2"), F.when(F.col("page") % 4 != 1, F.lit(512.0)).alias("dim_w"), F.lit(1024.0).alias("dim_h"),
    )
    whole = lambda c: F.floor(F.col(c) * 8).cast("long")
    return layout.normalise_blocks(raw, 1024.0, 2048.0).select("page", "block_no", whole("left").alias("l"), whole("top").alias("t"), whole("right").alias("r"), whole("bottom").alias("bt"))


@query(f"WITH {BLOCKS}, s AS (SELECT page, block_no, top, (bottom - top) / (1 + page % 6) AS step, i FROM blocks, unnest(range(0, 1 + page % 6)) AS u(i)) SELECT page, block_no, i::BIGINT AS line_no, floor((top + i * step) * 100)::BIGINT AS line_top, floor((top + (i + 1) * step) * 100)::BIGINT AS line_bottom FROM s")
def stripe_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = layout.stripes(_blocks(spark, sf_dir).withColumn("n_lines", F.lit(1) + F.col("page") % 6))
    cents = lambda c: F.floor(F.col(c) * 100).cast("long").alias(c)
    return each.select("page", "block_no", "line_no", cents("line_top"), cents("line_bottom"))


_TURN_WORDS = "tw AS (SELECT conv_id, turn, i - 1 AS i, ws[i] AS word FROM (SELECT conv_id, turn, list_filter(string_split_regex(coalesce(text, ''), '[ \\n]+'), lambda x: x <> '') AS ws FROM conversations), unnest(range(1, len(ws) + 1)) AS u(i))"


def _turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\n]+"), lambda x: x != "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(words).alias("i", "word"))


@query(f"""WITH {_TURN_WORDS}, s AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS done, sum(length(word) + 1) OVER (PARTITION BY conv_id, turn)::DOUBLE AS total FROM tw),
x AS (SELECT *, 1000.0::DOUBLE / greatest(1, total - 1) AS unit, done * (1000.0::DOUBLE / greatest(1, total - 1)) AS l FROM s) SELECT conv_id, turn, i, floor(l * 100)::BIGINT AS word_left, floor(greatest(least(1000.0::DOUBLE, l + length(word) * unit), l + 0.5) * 100)::BIGINT AS word_right FROM x""")
def word_spread_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = layout.spread_words(_turn_words(spark, sf_dir), ["conv_id", "turn"], "i", F.lit(0.0), F.lit(1000.0))
    cents = lambda c: F.floor(F.col(c) * 100).cast("long").alias(c)
    return each.select("conv_id", "turn", "i", cents("word_left"), cents("word_right"))


@query(f"""WITH {WORDS}, s AS (SELECT page, bottom - top AS h, lead(top) OVER (PARTITION BY page ORDER BY top) - top AS step FROM words), g AS (SELECT page, list_sort(list(step) FILTER (WHERE step > 0)) AS ss, list_sort(list(h)) AS hs FROM s GROUP BY page)
SELECT page, floor((CASE WHEN coalesce(len(ss), 0) = 0 THEN hs[len(hs) // 2 + 1] * 1.6::DOUBLE ELSE greatest(hs[len(hs) // 2 + 1], least(ss[len(ss) // 2 + 1], hs[len(hs) // 2 + 1] * 2)) END) * 100)::BIGINT AS pitch FROM g""")
def line_pitch_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.line_pitch(_words(spark, sf_dir), "page").select("page", F.floor(F.col("pitch") * 100).cast("long").alias("pitch"))


_HIST = "hist AS (SELECT l_orderkey AS page, l_suppkey * 37 % 256 AS value, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL)"


@query(f"""WITH {_HIST}, r AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY value) AS run, sum(n) OVER (PARTITION BY page) AS total FROM hist), p AS (SELECT page, min(value) FILTER (WHERE run * 2 >= total) AS paper, max(total) AS total FROM r GROUP BY page)
SELECT page, coalesce(sum(n) FILTER (WHERE value < greatest(0, CASE WHEN paper < 128 THEN 255 ELSE paper END - 40)), 0)::BIGINT AS dark, max(total)::BIGINT AS total FROM hist JOIN p USING (page) GROUP BY page""")
def ink_from_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page"), (F.col("l_suppkey") * 37 % 256).alias("value")).agg(F.sum("l_quantity").cast("long").alias("n"))
    return layout.ink_coverage(hist, "page")


@query(f"WITH {_TURN_WORDS}, s AS (SELECT conv_id, turn, i, coalesce(sum(length(word) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, sum(length(word) + 1) OVER (PARTITION BY conv_id, turn) AS total FROM tw) SELECT conv_id, turn, i, least(3, done * 4 // total)::INT AS bucket FROM s")
def bucket_split_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.split_runs(_turn_words(spark, sf_dir), ["conv_id", "turn"], "i", F.lit(4)).select("conv_id", "turn", "i", "bucket")


_VOTES = "v AS (SELECT l_orderkey AS page, l_suppkey % 5 AS word, l_partkey % 3 AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS place FROM lineitem)"


@query(f"WITH {_VOTES}, c AS (SELECT page, word, line, count(*) AS n, min(place) AS f FROM v GROUP BY ALL) SELECT page, word, line, n FROM (SELECT *, row_number() OVER (PARTITION BY page, word ORDER BY n DESC, f) AS r FROM c) WHERE r = 1")
def vote_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.vote_winners(_votes(spark, sf_dir))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 5).alias("word"), (F.col("l_partkey") % 3).alias("line"), F.row_number().over(order).alias("place"))


@query(f"WITH {_VOTES} SELECT page, place, max(line) OVER (PARTITION BY page ORDER BY place) AS line FROM v")
def running_max_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.never_back(_votes(spark, sf_dir), "page", "place", "line").select("page", "place", "line")


@query(f"WITH {_VOTES}, h AS (SELECT page, line, row_number() OVER (PARTITION BY page, line ORDER BY place) - 1 AS i, word > 2 AS hit FROM v) SELECT page, line, coalesce(min(i) FILTER (WHERE hit), count(*)) AS lead, coalesce(count(*) - 1 - max(i) FILTER (WHERE hit), 0) AS trail FROM h GROUP BY page, line")
def lead_trail_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _votes(spark, sf_dir).select("page", "line", (F.row_number().over(W.partitionBy("page", "line").orderBy("place")) - 1).alias("i"), (F.col("word") > 2).alias("hit"))
    return layout.edge_runs(flags, ["page", "line"], "i", "hit")


@query(f'WITH {WORDS} SELECT page, min("left")::BIGINT AS l, min(top)::BIGINT AS t, max("right")::BIGINT AS r, max(bottom)::BIGINT AS b FROM words GROUP BY page')
def union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.union_boxes(_words(spark, sf_dir), "page").select("page", F.col("left").cast("long").alias("l"), F.col("top").cast("long").alias("t"), F.col("right").cast("long").alias("r"), F.col("bottom").cast("long").alias("b"))


@query("SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) <= 400 AS fits FROM part")
def cumulative_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.within_limit(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey", "p_size", 400).select("p_partkey", "fits")


def _two_readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, words of the other reading, blocks). Parts of a brand and size are lines of a block, 30 apart; the other reading has some letters changed, some words added, and lines
    of its own where the first has a gap."""
    rows = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("block"), F.col("p_partkey").alias("line_no"), F.col("p_name").alias("line"))
    in_block = W.partitionBy("block").orderBy("line_no")
    missed = F.col("line_no") % 5 == 0
    top = F.sum(F.when(missed, 90).otherwise(30)).over(in_block).cast("double")
    width = F.col("line_no") % 200
    lines = rows.withColumns({"left": F.lit(100.0), "top": top - F.when(missed, 90).otherwise(30), "right": (width + 400).cast("double")}).withColumn("bottom", F.col("top") + 20)
    other = F.when(F.col("line_no") % 4 == 0, F.translate("line", "ae", "oo")).when(F.col("line_no") % 7 == 0, F.concat("line", F.lit(" added words"))).when(missed, F.concat("line", F.lit(" quick brown jumps over lazy dogs"))).otherwise(F.col("line"))
    each = rows.select("block", "line_no", F.posexplode(F.split(other, " ")).alias("i", "word"))
    words = each.withColumn("word_no", F.row_number().over(W.partitionBy("block").orderBy("line_no", "i")) - 1).select("block", "word_no", "word")
    blocks = lines.groupBy("block").agg(F.lit(90.0).alias("left"), F.min("top").alias("top"), F.lit(700.0).alias("right"), (F.max("bottom") + 40).alias("bottom"))
    return lines, words, blocks


@query()
def assign_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of one reading dealt to the lines of another."""
    lines, words, _ = _two_readings(spark, sf_dir)
    return words.join(assign_words(lines, words, "block"), ["block", "word_no"])


@query()
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line as read, replaced or added, with its box, where two readings of a block differ."""
    return merge_lines(*_two_readings(spark, sf_dir), "block")


def _page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as a page of areas of eight lines, paragraphs of four, lines and words."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    n, top = F.col("n"), (F.col("n") * 10).cast("double")
    area, paragraph = (F.floor(n / 8)).cast("int"), (F.floor(n / 4)).cast("int")
    name = lambda kind, number: F.concat(F.lit(kind), number.cast("string"))

    def level(rows: DataFrame, own, parent, place, kind: str, at, text=None) -> DataFrame:
        return rows.select("page", own.alias("id"), parent.alias("parent"), place.cast("int").alias("place"), F.lit(kind).alias("kind"), at.alias("top"), (F.lit(None) if text is None else text).cast("string").alias("text"))

    words = lines.select("page", "n", F.posexplode(F.split("line", " ")).alias("i", "word"))
    return (
        level(lines.where("n = 0"), F.lit("p"), F.lit(None).cast("string"), F.lit(0), tree.PAGE, F.lit(0.0))
        .unionByName(level(lines.where("n % 8 = 0"), name("a", area), F.lit("p"), area, "area", top))
        .unionByName(level(lines.where("n % 4 = 0"), name("g", paragraph), name("a", area), paragraph, tree.PARAGRAPH, top))
        .unionByName(level(lines, name("l", n), name("g", paragraph), n, tree.LINE, top))
        .unionByName(level(words, F.concat_ws(".", name("w", n), F.col("i").cast("string")), name("l", n), F.col("i"), tree.WORD, top, F.col("word")))
    )


@query(r"""WITH RECURSIVE l AS (SELECT doc_id AS page, (generate_subscripts(ls, 1) - 1)::INT AS n, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
w AS (SELECT page, n, (generate_subscripts(ws, 1) - 1)::INT AS i, unnest(ws) AS word FROM (SELECT page, n, string_split(line, ' ') AS ws FROM l)),
e AS (SELECT page, 'p' AS id, NULL::VARCHAR AS parent, 0 AS place, 'page' AS kind, 0 AS top, NULL::VARCHAR AS text FROM l WHERE n = 0
  UNION ALL SELECT page, 'a' || (n // 8), 'p', n // 8, 'area', n * 10, NULL FROM l WHERE n % 8 = 0 UNION ALL SELECT page, 'g' || (n // 4), 'a' || (n // 8), n // 4, 'paragraph', n * 10, NULL FROM l WHERE n % 4 = 0
  UNION ALL SELECT page, 'l' || n, 'g' || (n // 4), n, 'line', n * 10, NULL FROM l UNION ALL SELECT page, 'w' || n || '.' || i, 'l' || n, i, 'word', n * 10, word FROM w),
up AS (SELECT page, id, parent FROM e WHERE kind = 'word' AND length(text) >= 6 UNION SELECT e.page, e.id, e.parent FROM up JOIN e ON e.page = up.page AND e.id = up.parent),
ad AS (SELECT page, n, n // 4 AS g, n * 10 + 5 AS top, '>' || string_split(line, ' ')[1] AS text FROM l WHERE n % 8 = 1 UNION ALL SELECT page, n, n // 4, n * 10 - 15, '<' || string_split(line, ' ')[1] FROM l WHERE n % 8 = 6),
hi AS (SELECT l.page, l.n // 4 AS g, min(l.n * 10) AS highest FROM l JOIN up ON up.page = l.page AND up.id = 'l' || l.n GROUP BY ALL),
kept AS (SELECT w.page, w.n, string_agg(w.word, ' ' ORDER BY w.i) FILTER (w.word <> '') AS text FROM w JOIN up ON up.page = w.page AND up.id = 'w' || w.n || '.' || w.i GROUP BY ALL),
tops AS (SELECT l.page, l.n // 8 AS area, l.n * 10 AS top FROM l WHERE l.n % 8 = 0 AND (EXISTS (SELECT 1 FROM up WHERE up.page = l.page AND up.id = 'a' || (l.n // 8)) OR EXISTS (SELECT 1 FROM ad WHERE ad.page = l.page AND ad.n // 8 = l.n // 8))),
lo AS (SELECT doc_id AS page, 10 * len(string_split(coalesce(text, ''), chr(10))) / 2 AS top, lang || '|' || source AS text FROM documents),
slot AS (SELECT lo.page, lo.text, coalesce(min(area) FILTER (tops.top > lo.top), max(area) + 1, 0) AS area FROM lo LEFT JOIN tops ON tops.page = lo.page GROUP BY ALL),
o AS (SELECT page, [n // 8, 1, n // 4, 0, n] AS path, text FROM kept
  UNION ALL SELECT ad.page, [n // 8, 1, ad.g, CASE WHEN highest < ad.top THEN 1 ELSE -1 END, n], text FROM ad LEFT JOIN hi ON hi.page = ad.page AND hi.g = ad.g
  UNION ALL SELECT page, [area, 0, 0, 0, 0], text FROM slot)
SELECT page, count(*) AS n_lines, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY path) || chr(10)) AS digest FROM o GROUP BY page""")
def rebuilt_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without their short words, with a paragraph for the second and the seventh line of each area and a loose one, read in order."""
    elements = _page_tree(spark, sf_dir)
    drop = elements.where((F.col("kind") == tree.WORD) & (F.length("text") < 6)).select("page", "id")
    firsts = elements.where((F.col("kind") == tree.WORD) & (F.col("place") == 0)).select("page", F.col("parent").alias("anchor"), (F.col("top") / 10).cast("int").alias("n"), "text")
    second, seventh = F.col("n") % 8 == 1, F.col("n") % 8 == 6
    new = firsts.where(second | seventh).select("page", "anchor", "n", F.concat(F.when(second, ">").otherwise("<"), "text").alias("text"), (F.col("n") * 10 + F.when(second, 5).otherwise(-15)).cast("double").alias("top"))
    docs = table(spark, sf_dir, "documents")
    loose = docs.select(F.col("doc_id").alias("page"), F.lit(None).cast("string").alias("anchor"), F.lit(-1).alias("n"), F.concat_ws("|", "lang", "source").alias("text"), (F.size(F.split(F.coalesce("text", F.lit("")), "\n")) * 5).cast("double").alias("top"))
    both = new.unionByName(loose).withColumn("own", F.concat(F.lit("n"), F.col("n").cast("string")))
    parts = F.array(*(F.struct(F.concat("own", F.lit(s)).alias("id"), F.concat("own", F.lit(p)).alias("parent") if p is not None else F.lit(None).cast("string").alias("parent"), F.lit(k).alias("kind"), (F.col("text") if k == tree.WORD else F.lit(None).cast("string")).alias("text")) for s, p, k in (("", None, tree.PARAGRAPH), ("l", "", tree.LINE), ("w", "l", tree.WORD))))
    added = both.select("page", "anchor", "n", "top", F.explode(parts).alias("x")).select("page", "x.id", "x.parent", F.col("n").alias("place"), "x.kind", "top", "x.text", "anchor")
    rebuilt = tree.rebuilt(elements, drop, added, "page")
    counts = rebuilt.where(F.col("kind") == tree.LINE).groupBy("page").agg(F.count("*").alias("n_lines"))
    return tree.text_of(rebuilt, "page").join(counts, "page").select("page", "n_lines", F.md5("text").alias("digest"))
