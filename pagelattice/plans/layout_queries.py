"""Queries over positioned text and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.functions import text
from pagelattice.operators import images, layout
from pagelattice.plans import adapters as a

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _items(spark, sf) -> tuple[DataFrame, DataFrame]:
    return a.items(a.source_lines(spark, sf)), a.items(a.target_lines(spark, sf))


ITEMS = a.LINES_SQL + "".join(
    f""",
{side}_items AS (
  SELECT pair_id, n AS ord, line AS text, 10 * (n % 3) AS x, 20 * n AS y, 8 * length(line) AS w, 16 AS h
  FROM (SELECT pair_id, line, row_number() OVER (PARTITION BY pair_id ORDER BY ord) - 1 AS n FROM {side}_lines)
)"""
    for side in ("source", "target")
)
TRIMMED = rf"regexp_replace(text, '^{a.SPACES}|{a.SPACES}$', '', 'g')"
CHROME = " OR ".join(rf"regexp_matches({TRIMMED}, '{p}')" for p in text.CHROME)
PREPARED = ITEMS + "".join(
    f""",
{side} AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ord) AS k
  FROM (SELECT *, {a.key_sql(a.line_sql("text"))} AS key FROM {side}_items WHERE NOT ({CHROME})) WHERE key <> ''
)"""
    for side in ("source", "target")
)
ALIKE = (
    "({0} = {1} OR (least(length({0}), length({1})) >= 6 AND abs(length({0}) - length({1})) <= greatest(1, floor(least(length({0}), length({1})) * 0.15)) "
    "AND levenshtein({0}, {1}) <= greatest(1, floor(least(length({0}), length({1})) * 0.15))))"
)


@query(
    f"WITH {ITEMS}, n AS (SELECT *, {a.line_sql('text')} AS norm FROM source_items), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY y, x) - 1 AS index FROM n WHERE norm <> '') "
    "SELECT pair_id, CAST(index AS BIGINT) AS index, norm, CAST(x - lag(x, 1, x) OVER w AS BIGINT) AS dx, CAST(y - lag(y, 1, y) OVER w AS BIGINT) AS dy "
    "FROM o WINDOW w AS (PARTITION BY pair_id ORDER BY index)"
)
def fingerprint_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """W1; lines lie further apart than the tolerance, so the reading order is that of y."""
    found = layout.with_deltas(layout.ordered_items(_items(spark, sf)[0], ["pair_id"]), ["pair_id"])
    return _longs(found, "index", "dx", "dy").select("pair_id", "index", "norm", "dx", "dy")


@query(
    f"WITH {ITEMS}, n AS (SELECT pair_id // 5 AS pair_id, pair_id * 1000 + ord AS ord, {a.line_sql('text')} AS norm, x FROM source_items) "
    "SELECT CAST(pair_id AS BIGINT) AS pair_id, norm, CAST(x AS BIGINT) AS x, CAST(min(ord) AS BIGINT) AS ord FROM n WHERE norm <> '' GROUP BY pair_id, norm, x"
)
def item_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """W4 over five documents at a time, all at one y."""
    items = _items(spark, sf)[0].withColumn("ord", F.col("pair_id") * 1000 + F.col("ord")).withColumn("y", F.lit(0))
    five = items.withColumn("pair_id", F.floor(F.col("pair_id") / 5).cast("long"))
    return _longs(layout.first_items(five, ["pair_id"]), "x", "ord").select("pair_id", "norm", "x", "ord")


@query()
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """W2 with items that overlap in y."""
    items = _items(spark, sf)[0].withColumn("y", (F.col("y") * 7 % 60 + F.col("y") / 3).cast("int"))
    return _longs(layout.ordered_items(items, ["pair_id"]), "index", "ord").select("pair_id", "index", "ord")


@query()
def inline_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    """W3 with items that touch in x."""
    items = _items(spark, sf)[0].withColumns({"y": (F.col("ord") / 3).cast("int") * 20, "w": F.lit(8), "x": (F.col("ord") % 3) * 12})
    return _longs(layout.ordered_items(items, ["pair_id"], coalesce=True), "index", "w").select("pair_id", "index", "text", "w")


def _aligned(spark, sf) -> DataFrame:
    return layout.align(*_items(spark, sf))


@query()
def layout_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """J9."""
    return _longs(_aligned(spark, sf), "op", "ord", "counterpart").select("pair_id", "op", "side", "ord", "status", "counterpart")


@query(
    f"WITH RECURSIVE {PREPARED}, t AS (SELECT pair_id, list(key ORDER BY k) AS keys FROM target GROUP BY pair_id), "
    "dp(pair_id, k, cells) AS (SELECT pair_id, CAST(0 AS BIGINT), list_transform(range(len(keys) + 1), lambda j: CAST(0 AS BIGINT)) FROM t UNION ALL "
    "SELECT pair_id, k, list_concat([CAST(0 AS BIGINT)], list_transform(range(1, len(best) + 1), lambda j: list_max(best[1:j]))) FROM ("
    f"SELECT d.pair_id, s.k, list_transform(range(1, len(t.keys) + 1), lambda j: CASE WHEN {ALIKE.format('s.key', 't.keys[j]')} THEN d.cells[j] + 1 ELSE d.cells[j + 1] END) AS best "
    "FROM dp d JOIN source s ON s.pair_id = d.pair_id AND s.k = d.k + 1 JOIN t ON t.pair_id = d.pair_id)) "
    "SELECT CAST(pair_id AS VARCHAR) AS pair_id, CAST(max(list_max(cells)) AS BIGINT) AS matched FROM dp GROUP BY pair_id"
)
def layout_lcs_length(spark: SparkSession, sf: str) -> DataFrame:
    """The matches of a pair whose sides both have items; their number is that of a longest common subsequence."""
    found = _aligned(spark, sf).groupBy("pair_id").agg(
        F.count_if((F.col("side") == "source") & (F.col("status") == "matched")).alias("matched"), F.count_if(F.col("side") == "target").alias("n")
    )
    return found.where("n > 0").select("pair_id", "matched")


@query(
    f"WITH RECURSIVE {PREPARED}, t AS (SELECT pair_id, list(key ORDER BY k) AS keys, list(ord ORDER BY k) AS places FROM target GROUP BY pair_id), "
    "s AS (SELECT pair_id, list(key ORDER BY k) AS keys, list(ord ORDER BY k) AS places FROM source GROUP BY pair_id), "
    "pages AS (SELECT s.pair_id, s.keys AS a, t.keys AS b, s.places AS pa, t.places AS pb FROM s JOIN t USING (pair_id)), "
    # rows of the table from the last source item to the first; cells are those of target places 1 to m + 1
    "dp(pair_id, i, cells) AS (SELECT pair_id, CAST(len(a) + 1 AS BIGINT), list_transform(range(len(b) + 1), lambda j: CAST(0 AS BIGINT)) FROM pages UNION ALL "
    "SELECT pair_id, i, list_concat(list_transform(range(1, len(best) + 1), lambda j: list_max(best[j:])), [CAST(0 AS BIGINT)]) FROM ("
    f"SELECT d.pair_id, d.i - 1 AS i, list_transform(range(1, len(b) + 1), lambda j: CASE WHEN {ALIKE.format('a[d.i - 1]', 'b[j]')} THEN d.cells[j + 1] + 1 ELSE d.cells[j] END) AS best "
    "FROM dp d JOIN pages USING (pair_id) WHERE d.i > 1)), "
    "step(pair_id, op, i, j, di, dj) AS (SELECT pair_id, CAST(-1 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM pages UNION ALL "
    "SELECT pair_id, op, i, j, di, CASE WHEN hit OR di = 0 THEN 1 ELSE 0 END FROM ("
    "SELECT pair_id, op, i, j, hit, CASE WHEN hit THEN 1 WHEN j > m THEN 1 WHEN i > n THEN 0 WHEN down >= across THEN 1 ELSE 0 END AS di FROM ("
    "SELECT x.pair_id, x.op + 1 AS op, x.i + x.di AS i, x.j + x.dj AS j, len(a) AS n, len(b) AS m, "
    f"coalesce(x.i + x.di <= len(a) AND x.j + x.dj <= len(b) AND {ALIKE.format('a[x.i + x.di]', 'b[x.j + x.dj]')}, false) AS hit, lower_row.cells[x.j + x.dj] AS down, own_row.cells[x.j + x.dj + 1] AS across "
    "FROM step x JOIN pages USING (pair_id) LEFT JOIN dp own_row ON own_row.pair_id = x.pair_id AND own_row.i = x.i + x.di "
    "LEFT JOIN dp lower_row ON lower_row.pair_id = x.pair_id AND lower_row.i = x.i + x.di + 1 WHERE x.i + x.di <= len(a) OR x.j + x.dj <= len(b)))) "
    "SELECT CAST(pair_id AS VARCHAR) AS pair_id, op, CASE WHEN di = 1 THEN CAST(pa[i] AS BIGINT) END AS source_ord, CASE WHEN dj = 1 THEN CAST(pb[j] AS BIGINT) END AS target_ord "
    "FROM step JOIN pages USING (pair_id) WHERE op >= 0"
)
def layout_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """The steps of the walk itself, for pairs whose sides both have items."""
    return _longs(layout.steps(*_items(spark, sf)), "op", "source_ord", "target_ord")


@query()
def layout_moved(spark: SparkSession, sf: str) -> DataFrame:
    """J10."""
    return _longs(_aligned(spark, sf).where("side = 'source' and status = 'moved'"), "y", "other_y").select("pair_id", "text", "y", "other_y")


@query()
def layout_reflow(spark: SparkSession, sf: str) -> DataFrame:
    """A7."""
    return _longs(_aligned(spark, sf).where("status = 'reflow'"), "segment", "ord").select("pair_id", "segment", "side", "ord", "text")


@query()
def divergence_segments(spark: SparkSession, sf: str) -> DataFrame:
    """W5, A6."""
    return layout.segments(_aligned(spark, sf)).select("pair_id", "segment", "missing_count", "extra_count", "source_top", "target_bottom")


@query()
def layout_drift(spark: SparkSession, sf: str) -> DataFrame:
    """W6."""
    return layout.drift(_aligned(spark, sf)).select("pair_id", "op", "source_gap", "target_gap", "gap_delta")


@query()
def layout_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A5."""
    return layout.summary(_aligned(spark, sf))


@query()
def overlay_index(spark: SparkSession, sf: str) -> DataFrame:
    """W7."""
    return layout.overlay_index(_aligned(spark, sf)).select("pair_id", "side", "ord", "idx", "matched", "moved")


@query(
    f"WITH {PREPARED} SELECT s.pair_id, CAST(s.ord AS BIGINT) AS source_ord, CAST(t.ord AS BIGINT) AS target_ord FROM source s JOIN target t ON t.pair_id = s.pair_id "
    f"AND {ALIKE.format('s.key', 't.key')}"
)
def fuzzy_line_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """J11 within pairs."""
    return layout.alike_items(*(layout.prepared(i) for i in _items(spark, sf)))


@query(
    f"WITH {ITEMS}, m AS (SELECT pair_id, ord, x, y, x + ord * 7 % 5 AS ox, y + ord * 13 % 50 AS oy FROM source_items), "
    "r AS (SELECT a.pair_id, a.ord, a.x, a.y, a.ox, a.oy, b.ox - b.x AS dx, b.oy - b.y AS dy, row_number() OVER (PARTITION BY a.pair_id, a.ord ORDER BY abs(b.y - a.y), b.ord) AS k "
    "FROM m a JOIN m b ON b.pair_id = a.pair_id AND b.ord <> a.ord), "
    "d AS (SELECT pair_id, ord, any_value(x) AS x, any_value(y) AS y, any_value(ox) AS ox, any_value(oy) AS oy, median(dx) AS mdx, median(dy) AS mdy FROM r WHERE k <= 10 GROUP BY pair_id, ord), "
    "e AS (SELECT m.pair_id, m.ord, coalesce(greatest(abs(m.ox - m.x - mdx), abs(m.oy - m.y - mdy)), 0.0) AS drift FROM m LEFT JOIN d ON d.pair_id = m.pair_id AND d.ord = m.ord) "
    "SELECT pair_id, CAST(ord AS BIGINT) AS ord, CAST(drift AS DOUBLE) AS drift, CASE WHEN drift <= 20 THEN 'good' WHEN drift <= 40 THEN 'fair' ELSE 'poor' END AS grade FROM e"
)
def local_drift(spark: SparkSession, sf: str) -> DataFrame:
    """A19."""
    items = _items(spark, sf)[0]
    matches = items.select("pair_id", "ord", "x", "y", (F.col("x") + F.col("ord") * 7 % 5).alias("other_x"), (F.col("y") + F.col("ord") * 13 % 50).alias("other_y"))
    return _longs(layout.local_drift(matches), "ord")


NODES = """
bits AS (
  SELECT vec_id, list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN CAST(1 AS HUGEINT) << CAST(i - 1 AS INTEGER) ELSE CAST(0 AS HUGEINT) END)) AS u
  FROM embeddings WHERE vec_id IS NOT NULL
),
nodes AS (
  SELECT vec_id // 10 AS pair_id, CASE WHEN vec_id % 2 = 0 THEN 'source' ELSE 'target' END AS side, vec_id AS ord,
    CAST(vec_id * 37 % 900 AS DOUBLE) AS x, CAST(vec_id * 53 % 1700 AS DOUBLE) AS y,
    CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS hash
  FROM bits
)"""


@query(
    f"WITH {NODES} SELECT s.pair_id, s.ord AS source_ord, t.ord AS target_ord, CAST(bit_count(xor(s.hash, t.hash)) AS BIGINT) AS bits "
    "FROM nodes s JOIN nodes t ON t.pair_id = s.pair_id AND s.side = 'source' AND t.side = 'target'"
)
def hash_hamming_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A16 of the images of a pair, source by target."""
    nodes = a.image_nodes(spark, sf)
    s, t = (nodes.where(f"side = '{n}'").select("pair_id", F.col("ord").cast("long").alias(f"{n}_ord"), F.col("hash").alias(n)) for n in ("source", "target"))
    return s.join(t, "pair_id").select("pair_id", "source_ord", "target_ord", images.hamming(F.col("source"), F.col("target")).cast("long").alias("bits"))


def _nodes_and_anchors(spark, sf):
    nodes = a.image_nodes(spark, sf)
    anchors = nodes.where("side = 'source' and ord % 4 = 0").select(
        "pair_id", F.col("ord").alias("anchor"), "x", "y", (F.col("x") + 5).alias("cx"), (F.col("y") + 100).alias("cy")
    )
    return nodes, anchors


@query(
    f"WITH {NODES}, d AS (SELECT n.pair_id, n.ord, b.ord AS anchor, sqrt((b.x - n.x) * (b.x - n.x) + (b.y - n.y) * (b.y - n.y)) AS d FROM nodes n JOIN nodes b "
    "ON b.pair_id = n.pair_id AND b.side = 'source' AND b.ord % 4 = 0 WHERE n.side = 'target'), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, ord ORDER BY d, anchor) AS k FROM d) "
    "SELECT pair_id, ord, anchor, round(d, 6) AS anchor_distance FROM r WHERE k = 1"
)
def nearest_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """J13."""
    nodes, anchors = _nodes_and_anchors(spark, sf)
    found = images.near_anchors(nodes.where("side = 'target'"), anchors)
    return _longs(found, "ord", "anchor").select("pair_id", "ord", "anchor", F.round("anchor_distance", 6).alias("anchor_distance"))


@query()
def image_match(spark: SparkSession, sf: str) -> DataFrame:
    """J12-J15; a source image's copy with a few bits changed stands on the target side."""
    nodes, anchors = _nodes_and_anchors(spark, sf)
    source = nodes.where("side = 'source'").drop("side").withColumn("pair_id", F.col("pair_id").cast("string"))
    copies = source.withColumns({"hash": F.col("hash").bitwiseXOR(F.col("ord") % 16), "x": F.col("x") + 5, "y": F.col("y") + 100 + F.col("ord") % 7})
    target = copies.where("ord % 6 <> 0").unionByName(nodes.where("side = 'target'").drop("side").withColumn("pair_id", F.col("pair_id").cast("string")))
    anchors = anchors.withColumn("pair_id", F.col("pair_id").cast("string"))
    return images.match_images(source, target, anchors)
