"""Queries over boxes, gates, interaction, sources and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelattice.functions import geometry, text
from pagelattice.operators import crawl, gates, report
from pagelattice.plans import adapters as a
from pagelattice.sources import cache, captures, events, html, model_answers, ocr

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _boxes(spark, sf) -> DataFrame:
    """Two boxes of whole pixels for each order line, an order being a page, on pages 1000 by 4000 and 5000 pixels."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    ord_ = F.row_number().over(order)
    li = a.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pair_id"), ord_.alias("ord"), "l_partkey", "l_suppkey", "l_quantity")
    p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    one = lambda *c: geometry.box(*[x.cast("double") for x in c])
    source = one(p % 700, (p * 7 + s) % 3600, 50 + q * 5, 20 + q * 7)
    target = one((p + s) % 700, (p * 7 + s * 3) % 4600, 50 + q * 6, 20 + (q * 11 + s) % 400)
    return li.select("pair_id", "ord", source.alias("source"), target.alias("target"), ((p + s) % 21 / 100 + F.lit(0.8)).alias("confidence"))


BOXES = """
boxes AS (
  SELECT l_orderkey AS pair_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS ord,
    CAST(l_partkey % 700 AS DOUBLE) AS sx, CAST((l_partkey * 7 + l_suppkey) % 3600 AS DOUBLE) AS sy, CAST(50 + l_quantity * 5 AS DOUBLE) AS sw, CAST(20 + l_quantity * 7 AS DOUBLE) AS sh,
    CAST((l_partkey + l_suppkey) % 700 AS DOUBLE) AS tx, CAST((l_partkey * 7 + l_suppkey * 3) % 4600 AS DOUBLE) AS ty, CAST(50 + l_quantity * 6 AS DOUBLE) AS tw,
    CAST(20 + (l_quantity * 11 + l_suppkey) % 400 AS DOUBLE) AS th
  FROM lineitem
)"""


@query(
    f"WITH {BOXES}, p AS (SELECT *, (ty + th / 2) / 5000 - (sy + sh / 2) / 4000 AS d, ty + th / 2 - sy - sh / 2 AS e FROM boxes) "
    "SELECT pair_id, CAST(ord AS BIGINT) AS ord, CASE WHEN abs(d) <= 0.14 THEN 'aligned' WHEN d > 0.14 THEN 'lower_on_page' ELSE 'higher_on_page' END AS placement, "
    "CASE WHEN abs(e) <= 200 THEN 'aligned' WHEN e > 200 THEN 'lower_on_page' ELSE 'higher_on_page' END AS absolute, round(d, 6) AS delta FROM p"
)
def vertical_placement(spark: SparkSession, sf: str) -> DataFrame:
    """G3, P17."""
    b = _boxes(spark, sf)
    d = geometry.relative_delta(F.col("source"), F.col("target"), F.lit(4000), F.lit(5000))
    absolute = geometry.absolute_placement(F.col("source"), F.col("target"), F.lit(4000))
    return b.select("pair_id", F.col("ord").cast("long").alias("ord"), geometry.placement(d, 0.14).alias("placement"), absolute.alias("absolute"), F.round(d, 6).alias("delta"))


@query(
    f"WITH {BOXES}, o AS (SELECT a.pair_id, a.ord AS a_ord, b.ord AS b_ord, least(a.sx + a.sw, b.sx + b.sw) - greatest(a.sx, b.sx) AS w, "
    "least(a.sy + a.sh, b.sy + b.sh) - greatest(a.sy, b.sy) AS h, a.sw * a.sh + b.sw * b.sh AS areas FROM boxes a JOIN boxes b ON b.pair_id = a.pair_id AND a.ord < b.ord) "
    "SELECT pair_id, CAST(a_ord AS BIGINT) AS a_ord, CAST(b_ord AS BIGINT) AS b_ord, round(w * h / (areas - w * h), 6) AS iou FROM o WHERE w > 0 AND h > 0 AND w * h / (areas - w * h) > 0.2"
)
def block_iou_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """J16."""
    found = gates.overlaps(_boxes(spark, sf).select("pair_id", "ord", F.col("source").alias("box")))
    return found.select("pair_id", F.col("a_ord").cast("long").alias("a_ord"), F.col("b_ord").cast("long").alias("b_ord"), F.round("iou", 6).alias("iou"))


_W, _H = "(least(tx + tw, p.x + p.w) - greatest(tx, p.x))", "(least(ty + th, p.y + p.h) - greatest(ty, p.y))"
ACCEPTANCE = f"""
WITH RECURSIVE {BOXES.replace("CAST(l_partkey % 700", "(l_partkey + l_suppkey) % 21 / 100 + 0.8 AS conf, CAST(l_partkey % 700", 1)},
d AS (SELECT *, conf > 0.82 AS found, (ty + th / 2) / 5000 - (sy + sh / 2) / 4000 AS d FROM boxes),
m AS (
  SELECT *, CASE WHEN abs(d) <= 0.14 THEN 'aligned' WHEN d > 0 THEN 'lower_on_page' ELSE 'higher_on_page' END AS placement,
    list_filter([CASE WHEN conf < 0.85 THEN 'confidence_below_min' END, CASE WHEN abs(d) > 0.14 AND conf < 0.9 THEN 'reordered_low_confidence' END,
      CASE WHEN abs(d) > 0.14 THEN 'relative_vertical_offset_exceeded' END,
      CASE WHEN abs(ln(th / sh)) > 0.75 AND NOT (abs(d) <= 0.14 AND conf >= 0.85) THEN 'height_ratio_mismatch' END], lambda x: x IS NOT NULL) AS own
  FROM d
),
fold(pair_id, ord, prior, hit) AS (
  SELECT DISTINCT pair_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[]), false FROM boxes
  UNION ALL
  SELECT pair_id, ord, CASE WHEN found AND len(own) = 0 AND NOT hit THEN list_append(prior, struct_pack(x := tx, y := ty, w := tw, h := th)) ELSE prior END, hit
  FROM (
    SELECT m.*, f.prior, found AND len(list_filter(f.prior, lambda p: {_W} > 0 AND {_H} > 0 AND {_W} * {_H} / (tw * th + p.w * p.h - {_W} * {_H}) > 0.2)) > 0 AS hit
    FROM fold f JOIN m ON m.pair_id = f.pair_id AND m.ord = f.ord + 1
  )
)
SELECT CAST(m.pair_id AS VARCHAR) AS pair_id, CAST(m.ord AS INTEGER) AS iter, found AND len(own) = 0 AND NOT hit AS accepted,
  array_to_string(CASE WHEN NOT found THEN ['ai_not_found'] WHEN hit THEN list_append(own, 'overlaps_prior_match') ELSE own END, ',') AS reasons,
  CASE WHEN found THEN placement END AS placement, round(CASE WHEN found THEN abs(d) END, 9) AS delta
FROM m JOIN fold USING (pair_id, ord)
"""


@query(ACCEPTANCE)
def match_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    """G4."""
    b = _boxes(spark, sf).withColumns({"found": F.col("confidence") > 0.82, "source_height": F.lit(4000), "target_height": F.lit(5000)})
    found = gates.accept_in_order(b.withColumnRenamed("ord", "iter"))
    return found.withColumns({"reasons": F.array_join("reasons", ","), "delta": F.round("delta", 9)})


@query(
    "SELECT pair_id, CAST(ord AS BIGINT) AS ord, CAST(coalesce(sum(sy + sh) OVER (PARTITION BY pair_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS remainder_top "
    f"FROM (WITH {BOXES} SELECT * FROM boxes)"
)
def remainder_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """W10."""
    cuts = _boxes(spark, sf).select("pair_id", F.col("ord").alias("iter"), F.col("source.y").alias("y"), F.col("source.height").alias("height"))
    return gates.remainder_offsets(cuts).select("pair_id", F.col("iter").cast("long").alias("ord"), F.col("remainder_top").cast("double").alias("remainder_top"))


@query(
    f"WITH RECURSIVE {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ty DESC, th DESC) AS k FROM boxes), "
    "f(pair_id, k, rows_left) AS (SELECT DISTINCT pair_id, CAST(0 AS BIGINT), CAST(5000 AS DOUBLE) FROM boxes UNION ALL "
    "SELECT o.pair_id, o.k, greatest(1, f.rows_left - greatest(1, least(o.th, f.rows_left - greatest(0, least(o.ty, f.rows_left - 1))))) FROM f JOIN o ON o.pair_id = f.pair_id AND o.k = f.k + 1) "
    "SELECT pair_id, arg_max(rows_left, k) AS rows_left FROM f GROUP BY pair_id"
)
def stitched_heights(spark: SparkSession, sf: str) -> DataFrame:
    """G10, K4."""
    bands = _boxes(spark, sf).select("pair_id", F.lit(5000.0).alias("page_height"), F.col("target.y").alias("y"), F.col("target.height").alias("height"))
    return gates.height_after_removals(bands).select("pair_id", "rows_left")


def _shares(b, width, height):
    return geometry.to_shares(b, F.lit(width), F.lit(height))


@query(
    f"WITH {BOXES}, s AS (SELECT pair_id, ord, sx / 1000 AS x, sy / 4000 AS y, sw / 1000 AS w, sh / 4000 AS h FROM boxes), "
    "r AS (SELECT pair_id, ord, floor(x * 801 + 0.5) AS x, floor(y * 3003 + 0.5) AS y, floor(w * 801 + 0.5) AS w, floor(h * 3003 + 0.5) AS h FROM s), "
    "c AS (SELECT pair_id, ord, greatest(0, least(x, 800)) AS x, greatest(0, least(y, 3002)) AS y, w, h FROM r) "
    "SELECT pair_id, CAST(ord AS BIGINT) AS ord, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(greatest(1, least(w, 801 - x)) AS BIGINT) AS width, "
    "CAST(greatest(1, least(h, 3003 - y)) AS BIGINT) AS height, CAST(greatest(1, 3003 - y - greatest(1, least(h, 3003 - y))) AS BIGINT) AS below FROM c"
)
def box_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """P14, P15, G10."""
    px = geometry.to_pixels(_shares(F.col("source"), 1000, 4000), F.lit(801), F.lit(3003))
    found = _boxes(spark, sf).select("pair_id", "ord", px.alias("b"))
    below = geometry.height_below(F.col("b"), F.lit(801), F.lit(3003))
    fields = [F.col(f"b.{c}").cast("long").alias(c) for c in ("x", "y", "width", "height")]
    return found.select("pair_id", F.col("ord").cast("long").alias("ord"), *fields, below.cast("long").alias("below"))


LABELS = ("card row", "Hero cards", "Promotional cards", "links below", "footer cards", "Happening now", "text row", "Sign up", "three card teaser", "")
LABEL_SQL = "[" + ", ".join(f"'{x}'" for x in LABELS) + "][1 + CAST(sx AS INTEGER) % 10]"


@query(
    f"WITH {BOXES}, l AS (SELECT pair_id, ord, sx, sy % 300 AS y, sh AS h, {LABEL_SQL} AS label FROM boxes), "
    f"f AS (SELECT *, trim(label) <> '' AND NOT regexp_matches(label, '{geometry.NOT_CARDS}') AND regexp_matches(label, '{geometry.CARDS}') AS card, regexp_matches(label, '{geometry.CARD_TEXT}') AS words FROM l) "
    "SELECT pair_id, CAST(ord AS BIGINT) AS ord, card, words, card AND h < 620 AS incomplete, y <= 100 AND h <= 280 AND (card OR words) AS strip, "
    "y <= 100 AND h <= 280 AND (words OR (card AND h < 200)) AS fragment, "
    "CASE WHEN card AND h < 620 AND least(greatest(h, least(620, h + 200)), 700 - y) > h THEN least(greatest(h, least(620, h + 200)), 700 - y) ELSE h END AS extended FROM f"
)
def card_row_guards(spark: SparkSession, sf: str) -> DataFrame:
    """P18, P19."""
    label = F.get(F.array(*map(F.lit, LABELS)), F.col("source.x").cast("int") % 10)
    b = _boxes(spark, sf).select("pair_id", "ord", label.alias("label"), geometry.box(F.col("source.x"), F.col("source.y") % 300, F.col("source.width"), F.col("source.height")).alias("b"))
    c, n = F.col("b"), F.col("label")
    return b.select(
        "pair_id", F.col("ord").cast("long").alias("ord"), geometry.is_card_row(n).alias("card"), geometry.is_card_text(n).alias("words"),
        geometry.is_incomplete_row(c, n).alias("incomplete"), geometry.is_strip(c, n).alias("strip"), geometry.is_fragment(c, n).alias("fragment"),
        geometry.extended_row(c, n, F.lit(700.0))["height"].cast("double").alias("extended"),
    )


@query()
def segment_replay(spark: SparkSession, sf: str) -> DataFrame:
    """G5-G7 over answers made from boxes: every fourth has no box until it is asked again, rows of cards are asked for more twice."""
    label = F.get(F.array(*map(F.lit, LABELS)), F.col("source.x").cast("int") % 10)
    high = lambda k: geometry.box(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.col("source.height") * k / 4000)
    more = lambda k: F.struct(high(k).alias("segment"), label.alias("label"), F.lit(False).alias("done"))
    found = _boxes(spark, sf).select(
        "pair_id", F.col("ord").alias("iter"), label.alias("label"), F.when(F.col("ord") % 4 != 0, high(1.0)).alias("segment"),
        F.array(more(1.0)).alias("retries"), F.array(more(1.25), more(1.5)).alias("expansions"), (F.col("ord") > 6).alias("done"), F.lit(True).alias("parsed"),
        (F.col("confidence") > 0.82).alias("found"), "confidence", _shares(F.col("target"), 1000, 5000).alias("target"), F.lit(1000.0).alias("width"),
        F.lit(4000.0).alias("height"), F.lit(1000.0).alias("target_width"), F.lit(5000.0).alias("target_height"),
    )
    return gates.replay(found)


@query(
    f"WITH {BOXES} SELECT pair_id, CAST(ord AS BIGINT) AS ord, CAST(tw AS BIGINT) AS width, CAST(th AS BIGINT) AS height FROM boxes WHERE tw >= 150 AND th >= 140"
)
def extra_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """G8, with limits that these boxes are around."""
    blocks = _boxes(spark, sf).select("pair_id", "ord", F.lit(None).cast("string").alias("label"), _shares(F.col("target"), 8000, 8000).alias("bbox"), F.lit(8000).alias("width"), F.lit(8000).alias("height"))
    found = gates.extra_blocks(blocks, 150, 140)
    return found.select("pair_id", F.col("ord").cast("long").alias("ord"), F.col("rect.width").cast("long").alias("width"), F.col("rect.height").cast("long").alias("height"))


# --- interaction -------------------------------------------------------------------------------------------

CRAWL = f"""
{a.LINES_SQL},
base AS (SELECT pair_id, ord, line AS text FROM source_lines WHERE ord % 3 = 0),
revealed AS (SELECT pair_id, ord, line AS text, 'trigger ' || (ord % 4) AS trigger_label, (ord % 4) * 100 AS x, (ord % 4) * 50 AS y FROM source_lines WHERE ord % 3 <> 0),
shown AS (SELECT pair_id, ord, line AS text, 'control ' || (ord % 5) AS trigger_label FROM target_lines),
corpus AS (SELECT pair_id, ' ' || string_agg({a.crawl_key_sql("text")}, '  ' ORDER BY ord) || ' ' AS corpus FROM shown GROUP BY pair_id)
"""


def _crawl(spark, sf):
    lines = a.source_lines(spark, sf).withColumnRenamed("line", "text")
    base = lines.where("ord % 3 = 0")
    label = F.concat(F.lit("trigger "), F.col("ord") % 4)
    revealed = lines.where("ord % 3 <> 0").withColumns({"trigger_label": label, "x": F.col("ord") % 4 * 100, "y": F.col("ord") % 4 * 50})
    shown = a.target_lines(spark, sf).withColumnRenamed("line", "text").withColumn("trigger_label", F.concat(F.lit("control "), F.col("ord") % 5))
    return base, revealed, shown


KEY = a.crawl_key_sql("text")


@query(
    f"WITH {CRAWL}, m AS (SELECT pair_id, ord, {KEY} AS q FROM base), p AS (SELECT m.* FROM m JOIN corpus c ON c.pair_id = m.pair_id WHERE length(q) >= 2 AND contains(corpus, q)), "
    f"s AS (SELECT pair_id, ord, {KEY} AS r, trigger_label FROM shown) "
    "SELECT p.pair_id, p.ord, arg_min(s.trigger_label, s.ord) FILTER (contains(s.r, p.q) OR contains(p.q, s.r)) AS trigger_label FROM p LEFT JOIN s ON s.pair_id = p.pair_id GROUP BY p.pair_id, p.ord"
)
def gated_present(spark: SparkSession, sf: str) -> DataFrame:
    """J17."""
    base, _, shown = _crawl(spark, sf)
    return crawl.gated_present(base, shown).select("pair_id", "ord", "trigger_label")


@query(
    f"WITH {CRAWL} SELECT r.pair_id, r.ord, r.trigger_label FROM revealed r LEFT JOIN corpus c ON c.pair_id = r.pair_id "
    f"WHERE NOT coalesce(length({a.crawl_key_sql('r.text')}) >= 2 AND contains(corpus, {a.crawl_key_sql('r.text')}), FALSE)"
)
def gated_missing(spark: SparkSession, sf: str) -> DataFrame:
    """J18."""
    _, revealed, shown = _crawl(spark, sf)
    return crawl.gated_missing(revealed, shown).select("pair_id", "ord", "trigger_label")


@query(
    f"WITH {CRAWL}, t AS (SELECT r.*, coalesce(length({a.crawl_key_sql('r.text')}) >= 2 AND contains(corpus, {a.crawl_key_sql('r.text')}), FALSE) AS here FROM revealed r LEFT JOIN corpus c ON c.pair_id = r.pair_id) "
    "SELECT pair_id, trigger_label, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, min(ord) AS first_ord, count(*) AS revealed, count(*) FILTER (here) AS present FROM t GROUP BY pair_id, trigger_label, x, y"
)
def trigger_groups(spark: SparkSession, sf: str) -> DataFrame:
    """A10."""
    _, revealed, shown = _crawl(spark, sf)
    found = crawl.trigger_groups(revealed, shown)
    return found.select("pair_id", "trigger_label", "x", "y", "first_ord", "revealed", "present")


@query(
    f"WITH {CRAWL}, k AS (SELECT pair_id, ord, ord % 4 AS trigger, {KEY} AS key FROM revealed), b AS (SELECT DISTINCT pair_id, {KEY} AS key FROM base), "
    "r AS (SELECT k.*, row_number() OVER (PARTITION BY k.pair_id, k.key ORDER BY trigger, ord) AS n FROM k WHERE key <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.pair_id = k.pair_id AND b.key = k.key)) "
    "SELECT pair_id, ord, trigger, key FROM r WHERE n = 1"
)
def crawl_first_reveal(spark: SparkSession, sf: str) -> DataFrame:
    """W8."""
    base, revealed, _ = _crawl(spark, sf)
    return crawl.first_reveals(revealed.withColumn("trigger", F.col("ord") % 4), base).select("pair_id", "ord", "trigger", "key")


@query(
    f"WITH {CRAWL}, s AS (SELECT pair_id // 3 AS pair_id, pair_id AS ord, text AS signature FROM base WHERE ord = 0), "
    "f AS (SELECT pair_id, signature, min(ord) AS ord FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ord) AS n FROM f) "
    "SELECT pair_id, signature, ord FROM r WHERE n <= 40"
)
def crawl_states(spark: SparkSession, sf: str) -> DataFrame:
    """The first forty distinct states of a pair, told by their first line."""
    base = _crawl(spark, sf)[0].where("ord = 0")
    states = base.select(F.floor(F.col("pair_id") / 3).cast("long").alias("pair_id"), F.col("pair_id").alias("ord"), F.col("text").alias("signature"))
    return crawl.distinct_states(states, 40).select("pair_id", "signature", "ord")


BASE_KEY = rf"'t:' || lower(trim(regexp_replace(coalesce(text, ''), '{a.SPACES}', ' ', 'g')))"


@query(
    f"WITH {CRAWL}, b AS (SELECT DISTINCT pair_id, {BASE_KEY} AS content FROM base) SELECT pair_id, ord, content FROM (SELECT pair_id, ord, {BASE_KEY} AS content FROM revealed) s "
    "WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.pair_id = s.pair_id AND b.content = s.content)"
)
def state_delta(spark: SparkSession, sf: str) -> DataFrame:
    """J22, U4."""
    base, revealed, _ = _crawl(spark, sf)
    nodes = lambda d: d.withColumns({"kind": F.lit("text"), "src": F.lit(None).cast("string")})
    return crawl.state_delta(nodes(revealed), nodes(base)).select("pair_id", "ord", "content")


@query()
def trigger_snap(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as labels, their places drifted by up to 400 pixels."""
    lines = a.source_lines(spark, sf).select("pair_id", F.col("ord").cast("int").alias("ord"), F.col("line").alias("label"))
    at = lines.withColumns({"x": (F.col("ord") % 3 * 200).cast("double"), "y": (F.col("ord") * 60).cast("double"), "w": F.lit(150.0), "h": F.lit(20.0)})
    elements = at.where("ord % 5 <> 0").select("pair_id", F.col("ord").alias("e_ord"), F.when(F.col("ord") % 2 == 0, "click").otherwise("text").alias("kind"), "label", "x", "y", "w", "h")
    return crawl.snap(at.withColumn("y", F.col("y") + F.col("ord") * 37 % 400), elements)


@query(
    f"WITH {CRAWL}, g AS (SELECT pair_id, ord % 4 AS g_ord, 'trigger ' || (ord % 4) AS g_label, list({KEY}) AS lines FROM revealed GROUP BY 1, 2, 3), "
    f"w AS (SELECT pair_id, ord, {a.crawl_key_sql("'trigger ' || (ord % 6)")} AS label, {KEY} AS said FROM base), "
    f"m AS (SELECT w.pair_id, w.ord, g_ord, label <> '' AND {a.crawl_key_sql('g_label')} = label AS l, said <> '' AND len(list_filter(lines, lambda r: r <> '' AND (contains(r, said) OR contains(said, r)))) > 0 AS t FROM w JOIN g ON g.pair_id = w.pair_id), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY pair_id, ord ORDER BY CASE WHEN l AND t THEN 0 WHEN l THEN 1 ELSE 2 END, g_ord) AS n FROM m WHERE l OR t) "
    "SELECT w.pair_id, w.ord, o.g_ord FROM w LEFT JOIN o ON o.pair_id = w.pair_id AND o.ord = w.ord AND o.n = 1"
)
def find_trigger(spark: SparkSession, sf: str) -> DataFrame:
    """J23."""
    base, revealed, _ = _crawl(spark, sf)
    groups = revealed.groupBy("pair_id", (F.col("ord") % 4).alias("g_ord"), F.col("trigger_label").alias("g_label")).agg(F.collect_list("text").alias("lines"))
    wanted = base.withColumn("label", F.concat(F.lit("trigger "), F.col("ord") % 6))
    return crawl.find_trigger(wanted, groups).select("pair_id", "ord", "g_ord")


# --- sources and logs --------------------------------------------------------------------------------------


@query()
def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    """S6."""
    return html.page_lines(a.table(spark, sf, "pages"))


@query()
def eds_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's article taken as a main element with named blocks."""
    page = F.replace(F.replace("html", F.lit("<article>"), F.lit('<main><div class="block hero">')), F.lit("</article>"), F.lit('</div><div data-block-name="end">x</div></main>'))
    return html.page_blocks(a.table(spark, sf, "pages").select("page_id", page.alias("html")))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    """S7."""
    return html.titles(a.table(spark, sf, "pages"))


@query(
    f"""WITH {a.LINES_SQL},
words AS (SELECT pair_id, ord AS line, generate_subscripts(w, 1) - 1 AS k, unnest(w) AS text FROM (SELECT pair_id, ord, string_split(line, ' ') AS w FROM source_lines)),
kept AS (SELECT *, k * 60 AS x, line * 20 AS y FROM words WHERE (pair_id * 7 + k) % 100 >= 40 AND trim(text) <> ''),
g AS (SELECT pair_id, line, string_agg(text, ' ' ORDER BY k) AS text, min(x) AS x, max(x) + 50 - min(x) AS w FROM kept GROUP BY 1, 2)
SELECT pair_id AS image_id, text, CAST(x AS BIGINT) AS x, CAST(line * 20 AS BIGINT) AS y, CAST(w AS BIGINT) AS w FROM g
WHERE regexp_matches(text, '[a-zA-Z]') AND NOT (NOT regexp_matches(regexp_replace(text, '^{a.SPACES}|{a.SPACES}$', '', 'g'), '{a.SPACES}') AND length(regexp_replace(text, '^{a.SPACES}|{a.SPACES}$', '', 'g')) <= 2)"""
)
def ocr_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A9, P9."""
    split = a.source_lines(spark, sf).select("pair_id", "ord", F.posexplode(F.split("line", " ")).alias("k", "text"))
    words = split.select(
        F.col("pair_id").alias("image_id"), F.lit(0).alias("tile_top"), F.lit(5).alias("level"), F.lit(0).alias("block_num"), F.lit(0).alias("par_num"), F.col("ord").alias("line_num"),
        F.col("k").alias("ord"), (F.col("k") * 60).alias("left"), (F.col("ord") * 20).cast("int").alias("top"), F.lit(50).alias("width"), F.lit(16).alias("height"),
        ((F.col("pair_id") * 7 + F.col("k")) % 100).cast("double").alias("conf"), "text",
    )
    return ocr.lines(words).select("image_id", "text", *[F.col(c).cast("long").alias(c) for c in ("x", "y", "w")])


@query("SELECT DISTINCT user_id || ':' || event_id % 20 AS key FROM events EXCEPT SELECT user_id || ':' || event_id % 20 FROM events WHERE event_id % 3 = 0")
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Events stand for requests, every third for a stored answer."""
    e = a.table(spark, sf, "events").withColumn("key", F.concat_ws(":", "user_id", F.col("event_id") % 20))
    return cache.misses(e.select("key"), e.where("event_id % 3 = 0"))


@query(
    "WITH r AS (SELECT user_id || ':' || event_id % 20 AS key, event_id FROM events), c AS (SELECT DISTINCT key FROM r WHERE event_id % 3 = 0), "
    "j AS (SELECT count(*) AS requests, count(c.key) AS hits FROM r LEFT JOIN c ON c.key = r.key) SELECT requests, hits, requests - hits AS misses, round(100.0 * hits / requests, 1) AS hit_percent FROM j"
)
def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A17."""
    e = a.table(spark, sf, "events").withColumn("key", F.concat_ws(":", "user_id", F.col("event_id") % 20))
    return cache.stats(e, e.where("event_id % 3 = 0"))


@query(
    "WITH c AS (SELECT user_id AS pair_id, ['source', 'target'][1 + event_id % 2] AS role, ['desktop', 'mobile'][1 + event_id // 2 % 2] AS profile, event_id // 4 % 8 AS attempt, "
    "CASE WHEN event_id % 3 <> 0 THEN 'error ' || event_id % 7 END AS error, event_id % 1000 AS height FROM events WHERE user_id IS NOT NULL), "
    "g AS (SELECT pair_id, role, unnest(['desktop', 'mobile']) AS profile FROM (SELECT pair_id, unnest(['source', 'target']) AS role FROM (SELECT DISTINCT pair_id FROM c))), "
    "t AS (SELECT *, row_number() OVER (PARTITION BY pair_id, role, profile ORDER BY error IS NOT NULL, CASE WHEN error IS NULL THEN attempt ELSE -attempt END, coalesce(error, ''), height) AS n FROM c WHERE attempt <= 5) "
    "SELECT g.pair_id, g.role, g.profile, CASE WHEN attempt IS NULL THEN 'not captured' ELSE error END AS error, CAST(height AS INTEGER) AS height, CAST(coalesce(attempt + 1, 0) AS INTEGER) AS attempts, "
    "CAST(coalesce(2500 * attempt * (attempt + 1), 0) AS BIGINT) AS waited FROM g LEFT JOIN t ON t.pair_id = g.pair_id AND t.role = g.role AND t.profile = g.profile AND t.n = 1"
)
def settled_captures(spark: SparkSession, sf: str) -> DataFrame:
    """Events stand for attempts to capture a user's pages."""
    e = a.table(spark, sf, "events").where("user_id is not null")
    n = F.col("event_id")
    tried = e.select(
        F.col("user_id").alias("pair_id"), F.when(n % 2 == 0, "source").otherwise("target").alias("role"), F.when(F.floor(n / 2) % 2 == 0, "desktop").otherwise("mobile").alias("profile"),
        (F.floor(n / 4) % 8).cast("int").alias("attempt"), F.when(n % 3 != 0, F.concat(F.lit("error "), n % 7)).alias("error"), (n % 1000).cast("int").alias("height"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("visible", "array<string>"), ("expanded", "array<string>"), ("items", f"array<{captures.ITEM}>"))],
    )
    grid = captures.wanted(e.select(F.col("user_id").alias("idx")).distinct(), ["desktop", "mobile"])
    return captures.settled(tried, grid).select("pair_id", "role", "profile", "error", "height", "attempts", "waited")


@query(
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS in_window FROM events WHERE ts IS NOT NULL"
)
def rate_window(spark: SparkSession, sf: str) -> DataFrame:
    """W11."""
    return events.in_last_minute(a.table(spark, sf, "events").where("ts is not null"), "user_id").select("event_id", "in_window")


ANSWER = "CASE CAST(conv_id + turn AS INTEGER) % 5 WHEN 0 THEN 'so: ```json\n{\"n\": ' || turn || '}\n``` done' WHEN 1 THEN 'see {\"n\": ' || turn || '} here' WHEN 2 THEN 'none' WHEN 3 THEN '{broken' || turn || '}' ELSE '```\n[' || turn || ']\n```' END"


@query(
    f"WITH t AS (SELECT conv_id, turn, {ANSWER} AS raw FROM conversations) SELECT conv_id, turn, CASE CAST(conv_id + turn AS INTEGER) % 5 WHEN 0 THEN '{{\"n\": ' || turn || '}}' "
    "WHEN 1 THEN '{\"n\": ' || turn || '}' WHEN 4 THEN '[' || turn || ']' END AS json FROM t"
)
def json_extract(spark: SparkSession, sf: str) -> DataFrame:
    """S29."""
    raw = F.expr(ANSWER.replace("\n", "\\n"))
    return a.table(spark, sf, "conversations").select("conv_id", "turn", model_answers.json_object(raw).alias("json"))


@query(
    "WITH o AS (SELECT user_id AS page_id, event_id AS ord, ['cookie-banner','age-verification','modal'][1 + event_id % 3] AS type, ['high','medium','low'][1 + event_id // 3 % 3] AS urgency, "
    "['center','top'][1 + event_id // 7 % 2] AS location FROM events), p AS (SELECT *, CASE type WHEN 'cookie-banner' THEN 100 WHEN 'age-verification' THEN 150 ELSE 0 END + "
    "CASE urgency WHEN 'high' THEN 50 WHEN 'medium' THEN 25 ELSE 0 END + CASE location WHEN 'center' THEN 30 ELSE 0 END AS priority FROM o), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, ord) AS place FROM p) SELECT page_id, ord, CAST(priority AS BIGINT) AS priority, place FROM r WHERE place <= 8"
)
def overlay_priority(spark: SparkSession, sf: str) -> DataFrame:
    """P23, K3."""
    e = a.table(spark, sf, "events")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    n = F.col("event_id")
    o = e.select(
        F.col("user_id").alias("page_id"), n.alias("ord"), pick(["cookie-banner", "age-verification", "modal"], n % 3).alias("type"),
        pick(["high", "medium", "low"], F.floor(n / 3) % 3).alias("urgency"), pick(["center", "top"], F.floor(n / 7) % 2).alias("location"), F.lit(None).cast("string").alias("bounds"),
    )
    return report.first_overlays(o).select("page_id", "ord", F.col("priority").cast("long").alias("priority"), F.col("place").cast("long").alias("place"))


@query(
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE round((0.299 * (p_size * 5 % 256) + 0.587 * (p_size * 3 % 256) + 0.114 * (p_partkey % 256)) / 255, 6) END AS luminance, "
    "CASE CAST(p_partkey AS INTEGER) % 3 WHEN 0 THEN 'div.a' WHEN 1 THEN '#b' END AS selector FROM part"
)
def style_values(spark: SparkSession, sf: str) -> DataFrame:
    """P20, P22."""
    p = a.table(spark, sf, "part")
    alpha = F.when(F.col("p_size") % 5 == 0, ", 0.01)").otherwise(", 0.5)")
    colour = F.concat(F.lit("rgba("), F.concat_ws(", ", F.col("p_size") * 5 % 256, F.col("p_size") * 3 % 256, F.col("p_partkey") % 256), alpha)
    k = F.col("p_partkey") % 3
    selector = F.when(k == 0, "div.a:contains(x), p").when(k == 1, "#b:visible,").otherwise(":has-text(y)")
    return p.select("p_partkey", F.round(text.luminance(colour), 6).alias("luminance"), text.selector(selector).alias("selector"))


@query("SELECT event_type AS classification, count(*) AS n FROM events GROUP BY 1")
def run_counters(spark: SparkSession, sf: str) -> DataFrame:
    """A18."""
    return a.table(spark, sf, "events").groupBy(F.col("event_type").alias("classification")).agg(F.count("*").alias("n"))


@query(
    f"WITH {a.LINES_SQL} SELECT pair_id, 'desktop' AS profile, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS characters FROM source_lines GROUP BY 1"
)
def capture_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A12, A20."""
    docs = a.table(spark, sf, "documents").select(
        F.col("doc_id").alias("pair_id"), F.lit("source").alias("role"), F.lit("desktop").alias("profile"), F.lit("base").alias("state_id"), F.split("text", "\n").alias("lines")
    )
    found = report.capture_summary(docs)
    return found.select("pair_id", "profile", "lines", F.col("characters").cast("long").alias("characters"))
