"""Queries over pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.operators import images
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


BANDS = f"""
WITH {a.LINES_SQL},
edited_text AS (SELECT pair_id, string_agg(line, chr(10) ORDER BY ord) AS t FROM target_lines GROUP BY 1),
sides AS (
  SELECT row_number() OVER () AS n, doc_id AS pair_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS s, regexp_extract_all(hex(encode(coalesce(t, ''))), '..') AS t
  FROM documents LEFT JOIN edited_text ON edited_text.pair_id = documents.doc_id
),
high AS (SELECT *, greatest(1, (len(s) + 255) // 256) AS sh, greatest(1, (len(t) + 255) // 256) AS th, greatest(sh, th) AS height FROM sides),
canvas AS (
  SELECT n, pair_id, height, list_resize(list_resize(s, sh * 256, 'FF'), height * 256, 'C8') AS s, list_resize(list_resize(t, th * 256, 'FF'), height * 256, 'C8') AS t FROM high
),
pixels AS (SELECT n, pair_id, height, unnest(s) AS x, unnest(t) AS y, unnest(range(height * 256)) AS k FROM canvas),
bands AS (
  SELECT n, pair_id, height, least(k // 256 // greatest(1, height // 8), 7) AS band, count(*) AS pixels,
    count(*) FILTER (0.5053 * power(CAST('0x' || x AS INTEGER) - CAST('0x' || y AS INTEGER), 2) > 352.15) AS differ
  FROM pixels GROUP BY ALL
)
SELECT pair_id, height, round(1 - sum(differ) / sum(pixels), 6) AS similarity, count(*) AS bands, count(*) FILTER (1 - differ / pixels < 0.9) AS changed_bands,
  round(min(1 - differ / pixels), 6) AS least
FROM bands GROUP BY n, pair_id, height
"""


@query(BANDS)
def picture_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pictures at their own size, band by band."""
    found = images.compare_pictures(a.picture_pairs(spark, sf), width=a.PICTURE_WIDTH, longest=1 << 30)
    return found.select(
        "pair_id", F.col("height").cast("long").alias("height"), F.round("similarity", 6).alias("similarity"), F.size("bands").cast("long").alias("bands"),
        F.col("changed_bands").cast("long").alias("changed_bands"), F.round(F.array_min("bands"), 6).alias("least"),
    )


@query()
def picture_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """A14 as screening reads it: pictures made as small as production makes them."""
    found = images.compare_pictures(a.picture_pairs(spark, sf))
    return found.select("pair_id", "width", "height", F.round("similarity", 6).alias("similarity"), "changed_bands", "error")


@query()
def picture_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of all squares of 256 pixels of the documents' pictures, the last of which may be lower."""
    docs = a.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), F.coalesce("text", F.lit("")).alias("png"))
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length("png") / a.PICTURE_WIDTH)).cast("int")
    squares = docs.groupBy("image_id").agg(F.max(rows).alias("rows")).select("*", F.explode(F.expr("sequence(0, (rows - 1) div 256)")).alias("ord"))
    boxes = squares.select("image_id", "ord", F.lit(0).alias("x"), (F.col("ord") * 256).alias("y"), F.lit(256).alias("w"), F.least(F.lit(256), F.col("rows") - F.col("ord") * 256).alias("h"))
    return images.hash_pictures(boxes, a.pictures(docs, "png"))
