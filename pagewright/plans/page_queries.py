"""Queries over stacks of pages: text functions, windows, verdicts, segments, ranges, and the whole split plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.backends import describe
from pagewright.config import Settings
from pagewright.functions import names, ranges, text
from pagewright.operators import segmentation as seg
from pagewright.plans.registry import query
from pagewright.session import table
from pagewright.sources.tables import conversation_pages, line_pages

WINDOW, STEP = 4, 2  # stacks of conversations are short
LONG_WINDOW, LONG_STEP = 12, 6

_WS = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_IMG = r"!\[[^\]]*\]\([^)]*\)"
_EDGES = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
_MARK = r"(?i)\b(?:seite|page|blatt|pagina|s\.)\s*(\d{1,3})\s*(?:von|of|/|aus|de|di)\s*(\d{1,3})\b"

CONV = """conv AS (SELECT conv_id AS stack_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS index, coalesce(text, '') AS markdown, '' AS header, '' AS footer,
  false AS has_images, NULL::DOUBLE AS ink, role = 'user' AS starts_new, ((50 + length(coalesce(text, '')) % 50) / 100.0)::DECIMAL(6,4) AS confidence, 'role ' || role AS reason FROM conversations)"""
LINES = """lines0 AS (SELECT doc_id AS stack_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT stack_id, (i - 1)::INT AS index, ls[i] AS markdown,
  CASE WHEN (i - 1) % 3 = 0 THEN 'Seite ' || ((i - 1) % 4 + 1) || ' von 3' ELSE '' END AS header,
  CASE WHEN (i - 1) % 5 = 0 THEN 'Blatt ' || ((i - 1) % 3 + 1) || ' / ' || ((i - 1) % 3 + 2) ELSE '' END AS footer,
  (i - 1) % 7 = 0 AS has_images, CASE WHEN (i - 1) % 6 <> 0 THEN (length(ls[i]) % 50) / 10000.0::DOUBLE END AS ink
  FROM lines0, unnest(range(1, len(ls) + 1)) AS u(i))"""


def _chars(h: str, b: str, f: str) -> str:
    return f"length(regexp_replace(regexp_replace({h} || chr(10) || {b} || chr(10) || {f}, '{_IMG}', '', 'g'), '[{_WS}#*_|`>\\-=~.:]+', '', 'g'))"


def _blank(a: str = "") -> str:
    return f"(coalesce({a}ink < 0.002, false) OR (NOT {a}has_images AND {_chars(a + 'header', a + 'markdown', a + 'footer')} <= 15))"


def _marker(h: str, b: str, f: str, g: int) -> str:
    def first(t: str) -> str:
        ks, ns = (f"regexp_extract_all({t}, '{_MARK}', {i})" for i in (1, 2))
        return f"list_filter(list_transform(range(1, len({ks}) + 1), lambda i: [({ks}[i])::INT, ({ns}[i])::INT]), lambda p: p[1] >= 1 AND p[1] <= p[2])[1][{g}]"

    return f"coalesce({first(h)}, {first(f)}, {first(f'right({b}, 400)')}, {first(f'left({b}, 400)')})"


def _pages_sql(source: str, keys: str, index: str, name: str) -> str:
    return f"""(SELECT {keys}, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS {name} FROM (
      SELECT {keys}, min(i) + 1 AS a, max(i) + 1 AS b FROM (SELECT {keys}, i, i - row_number() OVER (PARTITION BY {keys} ORDER BY i) AS g FROM (SELECT DISTINCT {keys}, {index} AS i FROM {source})) GROUP BY {keys}, g) GROUP BY {keys})"""


@query(f"WITH {LINES} SELECT stack_id, index, {_chars('header', 'markdown', 'footer')} AS text_chars FROM lines")
def page_text_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_pages(spark, sf_dir).select("stack_id", "index", text.text_chars(F.col("header"), F.col("markdown"), F.col("footer")).alias("text_chars"))


@query(f"WITH {LINES} SELECT stack_id, index, {_blank()} AS blank FROM lines")
def blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_pages(spark, sf_dir).select("stack_id", "index", seg.is_blank().alias("blank"))


@query(f"WITH {LINES} SELECT stack_id, bool_and({_blank()}) AS all_blank, count(*) AS n_pages FROM lines GROUP BY stack_id HAVING bool_and({_blank()})")
def empty_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks without content: an error for whoever sent them."""
    return line_pages(spark, sf_dir).groupBy("stack_id").agg(F.bool_and(seg.is_blank()).alias("all_blank"), F.count("*").alias("n_pages")).filter("all_blank")


@query(f"WITH {LINES} SELECT stack_id, index, row_number() OVER (PARTITION BY stack_id ORDER BY index) - 1 AS pos, count(*) OVER (PARTITION BY stack_id) AS n_content FROM lines WHERE NOT {_blank()}")
def content_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.content_positions(line_pages(spark, sf_dir)).select("stack_id", "index", "pos", "n_content")


@query(f"WITH {LINES} SELECT stack_id, index, coalesce({_marker('header', 'markdown', 'footer', 1)}, 0) AS k, coalesce({_marker('header', 'markdown', 'footer', 2)}, 0) AS n FROM lines")
def page_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = text.page_marker(F.col("header"), F.col("markdown"), F.col("footer"))
    return line_pages(spark, sf_dir).select("stack_id", "index", marker.alias("m")).select("stack_id", "index", F.coalesce("m.k", F.lit(0)).alias("k"), F.coalesce("m.n", F.lit(0)).alias("n"))


def _marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of lines with a verdict from the line's length."""
    i = F.col("index")
    given = line_pages(spark, sf_dir).withColumns({"starts_new": i % 4 == 1, "confidence": ((F.lit(40) + F.length("markdown") % 60) / F.lit(100)).cast(seg.CONFIDENCE), "reason": F.concat(F.lit("length "), F.length("markdown").cast("string"))})
    return seg.apply_markers(given)


MARKED = f"""{LINES}, mk AS (SELECT *, {_marker('header', 'markdown', 'footer', 1)} AS k, {_marker('header', 'markdown', 'footer', 2)} AS n, index % 4 = 1 AS s0,
  ((40 + length(markdown) % 60) / 100.0)::DECIMAL(6,4) AS c0, 'length ' || length(markdown) AS r0 FROM lines),
marked AS (SELECT stack_id, index, markdown, header, footer, has_images, ink,
  index = 0 OR CASE WHEN k = 1 AND n > 1 THEN true WHEN k > 1 THEN false ELSE s0 END AS starts_new,
  CASE WHEN index = 0 THEN 1.0 WHEN (k = 1 AND n > 1) OR k > 1 THEN greatest(c0, 0.97) ELSE c0 END::DECIMAL(6,4) AS confidence,
  CASE WHEN index = 0 THEN 'first page of stack' WHEN k = 1 AND n > 1 THEN 'page marker 1 of n' WHEN k > 1 THEN 'page marker k of n, k > 1' ELSE r0 END AS reason FROM mk)"""


@query(f"WITH {MARKED} SELECT stack_id, index, starts_new, confidence::VARCHAR AS confidence, reason FROM marked")
def marker_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked_lines(spark, sf_dir).select("stack_id", "index", "starts_new", F.col("confidence").cast("string").alias("confidence"), "reason")


def _stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_pages(spark, sf_dir).groupBy("stack_id").agg(F.count("*").alias("n_content"))


_STARTS = f"""{LINES}, st AS (SELECT stack_id, count(*)::INT AS n FROM lines GROUP BY stack_id),
starts AS (SELECT stack_id, n, start FROM st, unnest(list_distinct(CASE WHEN n <= 12 THEN [0] ELSE list_concat(range(0, n - 11, 6), [n - 12]) END)) AS u(start)),
members AS (SELECT stack_id, n, start, pos FROM starts, unnest(range(start, least(start + 12, n))) AS v(pos)),
margins AS (SELECT *, least(CASE WHEN start > 0 THEN pos - start ELSE 12 END, CASE WHEN least(start + 12, n) - 1 < n - 1 THEN least(start + 12, n) - 1 - pos ELSE 12 END) AS margin FROM members)"""


@query(f"WITH {_STARTS} SELECT stack_id, start::INT AS start FROM starts")
def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stacks(spark, sf_dir).select("stack_id", F.explode(seg.window_starts(F.col("n_content").cast("int"), LONG_WINDOW, LONG_STEP)).alias("start"))


@query(f"WITH {_STARTS} SELECT stack_id, start::INT AS start, pos::INT AS pos FROM members")
def window_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.window_members(_stacks(spark, sf_dir), LONG_WINDOW, LONG_STEP).select("stack_id", "start", "pos")


@query(f"WITH {_STARTS} SELECT stack_id, pos::INT AS pos, start::INT AS start FROM (SELECT *, row_number() OVER (PARTITION BY stack_id, pos ORDER BY margin DESC, start) AS r FROM margins) WHERE r = 1")
def best_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.best_windows(seg.window_members(_stacks(spark, sf_dir), LONG_WINDOW, LONG_STEP), LONG_WINDOW)


@query(f"""WITH {_STARTS}, ans AS (SELECT *, (start + pos * 7) % 5 <> 0 AND pos % 11 <> 5 AS has, (pos + start) % 3 = 0 AS s, ((50 + (start * 3 + pos * 11) % 60) / 100.0)::DECIMAL(6,4) AS c,
  row_number() OVER (PARTITION BY stack_id, pos ORDER BY margin DESC, start) = 1 AS best FROM margins),
ch AS (SELECT *, row_number() OVER (PARTITION BY stack_id, pos ORDER BY has AND best DESC, has DESC, start) AS r FROM ans)
SELECT stack_id, pos::INT AS pos, has AND s AS starts_new, CASE WHEN has THEN greatest(0, least(1, c)) ELSE 0 END::DECIMAL(6,4)::VARCHAR AS confidence,
  CASE WHEN has THEN 'window ' || start ELSE 'no answer from model' END AS reason FROM ch WHERE r = 1""")
def verdict_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that some windows don't give: the best window's, else any, else none."""
    members = seg.window_members(_stacks(spark, sf_dir), LONG_WINDOW, LONG_STEP)
    s, p = F.col("start"), F.col("pos")
    answers = members.filter(((s + p * 7) % 5 != 0) & (p % 11 != 5)).select(
        "stack_id", "start", "pos", ((p + s) % 3 == 0).alias("starts_new"), ((F.lit(50) + (s * 3 + p * 11) % 60) / F.lit(100)).cast(seg.CONFIDENCE).alias("confidence"), F.concat(F.lit("window "), s.cast("string")).alias("reason")
    )
    return seg.select_verdicts(members, answers, LONG_WINDOW).withColumn("confidence", F.col("confidence").cast("string"))


SEGMENTS = f"""{MARKED}, sg AS (SELECT *, sum(starts_new::INT) OVER (PARTITION BY stack_id ORDER BY index ROWS UNBOUNDED PRECEDING) AS seg FROM marked),
op AS (SELECT stack_id, seg, confidence AS start_confidence, reason AS start_reason FROM sg WHERE starts_new),
wk AS (SELECT * FROM (SELECT stack_id, seg, index AS join_index, confidence AS join_confidence, reason AS join_reason, row_number() OVER (PARTITION BY stack_id, seg ORDER BY confidence, index) AS r FROM sg WHERE NOT starts_new) WHERE r = 1),
segs AS (SELECT g.*, start_confidence, start_reason, join_index, join_confidence, join_reason FROM (SELECT stack_id, seg, min(index) AS first_index, count(*) AS n_pages FROM sg GROUP BY stack_id, seg) g JOIN op USING (stack_id, seg) LEFT JOIN wk USING (stack_id, seg))"""


@query(f"WITH {SEGMENTS} SELECT s.stack_id, s.seg::BIGINT AS seg, s.first_index, s.n_pages, p.pages FROM segs s JOIN {_pages_sql('sg', 'stack_id, seg', 'index', 'pages')} p USING (stack_id, seg)")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.segments(_marked_lines(spark, sf_dir)).select("stack_id", "seg", "first_index", "n_pages", ranges.format_indices(F.col("indices")).alias("pages"))


@query(f"WITH {SEGMENTS} SELECT stack_id, seg::BIGINT AS seg, coalesce(join_index, -1) AS join_index, join_confidence::VARCHAR AS join_confidence, join_reason FROM segs")
def weakest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.segments(_marked_lines(spark, sf_dir)).select("stack_id", "seg", F.coalesce("join_index", F.lit(-1)).alias("join_index"), F.col("join_confidence").cast("string").alias("join_confidence"), "join_reason")


@query(f"WITH {SEGMENTS} SELECT stack_id, seg::BIGINT AS seg, round(least(start_confidence, coalesce(join_confidence, 1)), 2)::DECIMAL(4,2)::VARCHAR AS confidence FROM segs")
def doc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seg.segments(_marked_lines(spark, sf_dir)).select("stack_id", "seg", seg.document_confidence().cast("string").alias("confidence"))


def _review_sql(segs: str, pages: str) -> str:
    two = lambda c: f"round({c}, 2)::DECIMAL(4,2)::VARCHAR"
    k, n = (_marker("f.header", "f.markdown", "f.footer", g) for g in (1, 2))
    return f"""SELECT s.stack_id, s.seg::BIGINT AS seg, concat_ws('; ',
      CASE WHEN {k} > 1 THEN 'starts with page ' || {k} || ' of ' || {n} || '; earlier pages missing or misplaced' END,
      CASE WHEN s.n_pages = 1 AND {_chars('f.header', 'f.markdown', 'f.footer')} < 60 THEN 'single, nearly empty page ' || (s.first_index + 1) END,
      CASE WHEN s.start_confidence < 0.8 THEN 'uncertain split before page ' || (s.first_index + 1) || ' (' || {two('s.start_confidence')} || ': ' || s.start_reason || ')' END,
      CASE WHEN s.join_confidence < 0.8 THEN 'uncertain continuation at page ' || (s.join_index + 1) || ' (' || {two('s.join_confidence')} || ': ' || s.join_reason || ')' END) AS review_reason
      FROM {segs} s JOIN {pages} f ON f.stack_id = s.stack_id AND f.index = s.first_index"""


@query(f"WITH {SEGMENTS} {_review_sql('segs', 'lines')}")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = seg.segments(_marked_lines(spark, sf_dir), head=F.min(F.struct("index", "header", "markdown", "footer")))
    opened = segs.withColumns({f"first_{c}": F.col(f"head.{c}") for c in ("header", "markdown", "footer")})
    return opened.select("stack_id", "seg", seg.review_reason().alias("review_reason"))


@query(f"WITH {LINES}, b AS (SELECT * FROM lines WHERE NOT {_blank()}) SELECT stack_id, pages FROM {_pages_sql('b', 'stack_id', 'index', 'pages')}")
def page_ranges_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of the content pages: what a plan without splitting holds."""
    return ranges.format_pages(line_pages(spark, sf_dir).filter(~seg.is_blank()), ["stack_id"], "index")


_RANGE_TEXT = "CASE o_orderkey % 8 WHEN 0 THEN a || '-' || (a + 2) || ', ' || (a + 4) WHEN 1 THEN (a + 3) || ', ' || a || '-' || a WHEN 2 THEN ' ' || a || ' - ' || (a + 1) || ' ,, ' WHEN 3 THEN '0' WHEN 4 THEN (a + 1) || '-' || a WHEN 5 THEN 'x-' || a WHEN 6 THEN '' ELSE a || ',' || a END"


@query(f"""WITH r AS (SELECT o_orderkey, {_RANGE_TEXT} AS t FROM (SELECT o_orderkey, o_custkey % 9 + 1 AS a FROM orders)),
p AS (SELECT o_orderkey, t, list_filter(string_split(t, ','), lambda x: trim(x) <> '') AS ps FROM r),
q AS (SELECT o_orderkey, t, ps, list_transform(ps, lambda x: regexp_matches(x, '^\\s*\\d{{1,9}}\\s*(-\\s*\\d{{1,9}}\\s*)?$')) AS shaped, list_transform(ps, lambda x: TRY_CAST(regexp_extract(x, '(\\d+)', 1) AS BIGINT)) AS a,
  list_transform(ps, lambda x: coalesce(TRY_CAST(regexp_extract(x, '-\\s*(\\d+)', 1) AS BIGINT), TRY_CAST(regexp_extract(x, '(\\d+)', 1) AS BIGINT))) AS b FROM p),
v AS (SELECT *, len(ps) > 0 AND len(list_filter(range(1, len(ps) + 1), lambda i: NOT coalesce(shaped[i] AND a[i] >= 1 AND a[i] <= b[i] AND b[i] <= 10, false))) = 0 AS ok FROM q)
SELECT o_orderkey, t AS pages, ok AS valid, CASE WHEN ok THEN array_to_string(flatten(list_transform(range(1, len(ps) + 1), lambda i: range(a[i] - 1, b[i]))), ' ') END AS indices FROM v""")
def page_ranges_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 9 + 1).alias("a")).select("o_orderkey", F.expr(_RANGE_TEXT).alias("pages"))
    return rows.select("o_orderkey", "pages", ranges.pages_valid(F.col("pages"), F.lit(10)).alias("valid"), F.array_join(F.transform(ranges.parse_pages(F.col("pages"), F.lit(10)), lambda x: x.cast("string")), " ").alias("indices"))


@query(f"""WITH {LINES}, b AS (SELECT *, {_blank()} AS blank FROM lines), c AS (SELECT *, CASE WHEN NOT blank THEN sum(CASE WHEN NOT blank AND index % 4 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY stack_id ORDER BY index) END AS seg FROM b)
SELECT stack_id, index, coalesce(last_value(seg IGNORE NULLS) OVER (PARTITION BY stack_id ORDER BY index ROWS UNBOUNDED PRECEDING), min(seg) OVER (PARTITION BY stack_id))::BIGINT AS owner FROM c""")
def blank_attach_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = line_pages(spark, sf_dir).withColumn("blank", seg.is_blank())
    begun = F.sum(F.when(~F.col("blank") & (F.col("index") % 4 == 1), 1).otherwise(0)).over(W.partitionBy("stack_id").orderBy("index").rowsBetween(W.unboundedPreceding, 0))
    return seg.attach_blanks(pages.withColumn("seg", F.when(~F.col("blank"), begun))).select("stack_id", "index", "owner")


_STRIP = lambda x: f"trim({x}, {_EDGES})"
_EX = _STRIP(f"regexp_replace(t, '{_IMG}', '[image]', 'g')")


@query(f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), e AS (SELECT doc_id, {_EX} AS x FROM d) SELECT doc_id, CASE WHEN length(x) <= 1600 THEN x ELSE left(x, 1200) || chr(10) || '[...]' || chr(10) || right(x, 400) END AS excerpt FROM e")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.coalesce("text", F.lit(""))).alias("excerpt"))


_MOST = Settings.metadata_max_chars
_PARTS = f"list_filter([header, regexp_replace(markdown, '{_IMG}', '', 'g'), footer], lambda x: {_STRIP('x')} <> '')"


@query(f"""WITH {SEGMENTS}, t AS (SELECT stack_id, seg, string_agg('--- page ' || (index + 1) || ' ---' || chr(10) || {_STRIP(f"array_to_string({_PARTS}, chr(10))")}, chr(10) || chr(10) ORDER BY index) AS x FROM sg GROUP BY stack_id, seg)
SELECT stack_id, seg::BIGINT AS seg, CASE WHEN length(x) <= {_MOST} THEN x ELSE left(x, {_MOST * 3 // 4}) || chr(10) || chr(10) || '[... middle omitted ...]' || chr(10) || chr(10) || right(x, {_MOST - _MOST * 3 // 4}) END AS text FROM t""")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    piece = text.page_chunk(F.col("index") + 1, F.col("header"), F.col("markdown"), F.col("footer"))
    whole = seg.document_texts(seg.with_segments(_marked_lines(spark, sf_dir)), ["stack_id", "seg"], piece, "\n\n")
    return whole.select("stack_id", "seg", text.clipped_text(F.col("text"), _MOST).alias("text"))


_CPARTS = f"list_filter([{_STRIP('header')}, {_STRIP(f'''regexp_replace(markdown, '{_IMG}', '', 'g')''')}, {_STRIP('footer')}], lambda x: x <> '')"


@query(f"WITH {LINES}, c AS (SELECT stack_id, index, array_to_string({_CPARTS}, chr(10) || chr(10)) AS x FROM lines) SELECT stack_id, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY index) FILTER (WHERE x <> ''), '') AS text FROM c GROUP BY stack_id")
def content_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    piece = text.content_block(F.col("header"), F.col("markdown"), F.col("footer"))
    return seg.document_texts(line_pages(spark, sf_dir), ["stack_id"], piece, "\n\n")


@query("SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+', '', 'g') AS letters FROM documents")
def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.letters(F.coalesce("text", F.lit(""))).alias("letters"))


_PLAIN = "t"
for _p, _r in ((_IMG, ""), (r"\[([^\]]*)\]\([^)]*\)", "\\1"), (rf"(?m)^[{_WS}]{{0,3}}#{{1,6}}[{_WS}]*", ""), (rf"(?m)^[{_WS}]*>[{_WS}]?", ""), (rf"(?m)^[{_WS}]*(?:[-*+]|\d+[.)])[{_WS}]+", ""), (r"\$+([^$]*)\$+", "\\1"), (r"[*_`~]+", ""), (r"<[^>\n]+>", "")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_p}', '{_r}', 'g')"


@query(f"""WITH s AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT -page_id - 1, html FROM pages), p AS (SELECT id, {_PLAIN} AS x FROM s),
l AS (SELECT id, list_filter(list_transform(string_split_regex(x, '\\r\\n|[\\n\\r\\x{{0B}}\\f\\x{{1C}}\\x{{1D}}\\x{{1E}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda y: {_STRIP(f"regexp_replace(replace(y, '|', ' '), '[{_WS}]+', ' ', 'g')")}), lambda y: y <> '') AS ls FROM p)
SELECT id, len(ls) AS n_lines, array_to_string(ls, chr(10)) AS plain FROM l""")
def plain_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    pages = table(spark, sf_dir, "pages").select((-F.col("page_id") - 1).alias("id"), F.col("html").alias("t"))
    lines = docs.unionByName(pages).select("id", text.plain_lines(F.col("t")).alias("ls"))
    return lines.select("id", F.size("ls").alias("n_lines"), F.array_join("ls", "\n").alias("plain"))


def split_plan_of(pages: DataFrame, drop_blank: bool = True) -> DataFrame:
    """The whole way from pages with verdicts to named documents: blank filter, markers, segments, ranges, review, description, file name.

    One exchange by stack serves the windows and the aggregation; pages that stay though blank are attached by a second pass."""
    blank = seg.is_blank()
    content = seg.apply_markers(pages.filter(~blank))
    piece = text.page_chunk(F.col("index") + 1, F.col("header"), F.col("markdown"), F.col("footer"))
    head = F.min(F.struct("index", "header", "markdown", "footer"))
    docs = seg.segments(content, text=seg.ordered_pieces(piece, "\n\n"), head=head)
    if drop_blank:
        docs = docs.withColumn("pages", ranges.format_indices(F.col("indices")))
    else:
        every = pages.withColumn("__blank", blank).select("stack_id", "index", "__blank").join(seg.with_segments(content).select("stack_id", "seg", "index"), ["stack_id", "index"], "left")
        owned = seg.attach_blanks(every).filter("owner is not null").select("stack_id", F.col("owner").alias("seg"), "index")
        docs = docs.join(ranges.format_pages(owned, ["stack_id", "seg"], "index"), ["stack_id", "seg"])
    docs = docs.withColumns({f"first_{c}": F.col(f"head.{c}") for c in ("header", "markdown", "footer")}).select("*", *describe(F.col("text")))
    reason = seg.review_reason()
    reason = F.concat_ws("; ", F.when(reason != "", reason), F.when(F.col("title") == "", F.lit("no title found")))
    out = docs.select("stack_id", "seg", "pages", "title", "date", seg.document_confidence().cast("string").alias("confidence"), reason.alias("review_reason"))
    stem = names.build_stem("{title} {date}", F.col("title"), F.col("date"), "undated", compose=False)
    return out.withColumns({"needs_review": F.col("review_reason") != "", "stem": stem})


_TITLE = f"{_STRIP('''left(regexp_replace(regexp_extract(x, '^--- page [0-9]+ ---\\n([^\\n]*)', 1), '[^A-Za-z0-9 ]+', '', 'g'), 40)''')}"


@query(f"""WITH {CONV}, b AS (SELECT * FROM conv WHERE NOT {_blank()}),
mk AS (SELECT *, {_marker('header', 'markdown', 'footer', 1)} AS k, {_marker('header', 'markdown', 'footer', 2)} AS n, row_number() OVER (PARTITION BY stack_id ORDER BY index) = 1 AS fst FROM b),
m2 AS (SELECT stack_id, index, markdown, header, footer, fst OR CASE WHEN k = 1 AND n > 1 THEN true WHEN k > 1 THEN false ELSE starts_new END AS starts_new,
  CASE WHEN fst THEN 1.0 WHEN (k = 1 AND n > 1) OR k > 1 THEN greatest(confidence, 0.97) ELSE confidence END::DECIMAL(6,4) AS confidence,
  CASE WHEN fst THEN 'first page of stack' WHEN k = 1 AND n > 1 THEN 'page marker 1 of n' WHEN k > 1 THEN 'page marker k of n, k > 1' ELSE reason END AS reason FROM mk),
sg AS (SELECT *, sum(starts_new::INT) OVER (PARTITION BY stack_id ORDER BY index ROWS UNBOUNDED PRECEDING) AS seg FROM m2),
op AS (SELECT stack_id, seg, confidence AS start_confidence, reason AS start_reason FROM sg WHERE starts_new),
wk AS (SELECT * FROM (SELECT stack_id, seg, index AS join_index, confidence AS join_confidence, reason AS join_reason, row_number() OVER (PARTITION BY stack_id, seg ORDER BY confidence, index) AS r FROM sg WHERE NOT starts_new) WHERE r = 1),
segs AS (SELECT g.*, start_confidence, start_reason, join_index, join_confidence, join_reason FROM (SELECT stack_id, seg, min(index) AS first_index, count(*) AS n_pages FROM sg GROUP BY stack_id, seg) g JOIN op USING (stack_id, seg) LEFT JOIN wk USING (stack_id, seg)),
rv AS ({_review_sql('segs', 'b')}),
tx AS (SELECT stack_id, seg, string_agg('--- page ' || (index + 1) || ' ---' || chr(10) || {_STRIP(f"array_to_string({_PARTS}, chr(10))")}, chr(10) || chr(10) ORDER BY index) AS x FROM sg GROUP BY stack_id, seg),
ds AS (SELECT stack_id, seg, {_TITLE} AS title, nullif(regexp_extract(x, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '') AS d0 FROM tx),
d2 AS (SELECT stack_id, seg, title, CASE WHEN TRY_CAST(d0 AS DATE) IS NOT NULL AND NOT starts_with(d0, '0000') THEN d0 END AS date FROM ds)
SELECT s.stack_id, s.seg::BIGINT AS seg, p.pages, title, date, round(least(start_confidence, coalesce(join_confidence, 1)), 2)::DECIMAL(4,2)::VARCHAR AS confidence,
  concat_ws('; ', nullif(rv.review_reason, ''), CASE WHEN title = '' THEN 'no title found' END) AS review_reason,
  concat_ws('; ', nullif(rv.review_reason, ''), CASE WHEN title = '' THEN 'no title found' END) <> '' AS needs_review,
  trim(regexp_replace(CASE WHEN title = '' THEN 'Document' ELSE title END || ' ' || coalesce(date, 'undated'), ' +', ' ', 'g'), ' .') AS stem
FROM segs s JOIN {_pages_sql('sg', 'stack_id, seg', 'index', 'pages')} p USING (stack_id, seg) JOIN rv USING (stack_id, seg) JOIN d2 USING (stack_id, seg)""")
def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: conversations as stacks of pages, split into named documents with review flags."""
    return split_plan_of(conversation_pages(spark, sf_dir))
