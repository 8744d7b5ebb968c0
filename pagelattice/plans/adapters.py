"""Stand-ins for captures, made from whole test tables by fixed rules, and the same rules as SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.operators.groups import small_batches, spread
from pagelattice.sources import pictures as png

#: Pixels a row of the pictures that stand in for screenshots.
PICTURE_WIDTH = 256

SPACES = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i, line: the lines of each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), F.col("i").cast("long").alias("ord"), "line")


def target_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document edited: every 7th line gone, every 5th spaced out, every 11th at the end, every 6th cut in two."""
    lines = doc_lines(spark, sf_dir).where("i % 7 <> 0")
    line = F.when(F.col("i") % 5 == 0, F.replace("line", F.lit(" "), F.lit("  "))).otherwise(F.col("line"))
    at = F.floor(F.length("line") / 2).cast("int")
    parts = F.when(F.col("i") % 6 == 0, F.array(F.substring(line, F.lit(1), at), F.substring(line, at + 1, F.length(line)))).otherwise(F.array(line))
    place = F.when(F.col("i") % 11 == 0, F.col("i") + 1000000).otherwise(F.col("i")) * 2
    made = lines.select("doc_id", place.alias("place"), F.posexplode(parts).alias("k", "line"))
    return made.select(F.col("doc_id").alias("pair_id"), (F.col("place") + F.col("k")).cast("long").alias("ord"), "line")


def profiled(lines: DataFrame, modulus: int) -> DataFrame:
    """The lines under two profiles: desktop has all, mobile lacks those whose place is divisible by ``modulus``."""
    two = F.array(F.struct(F.lit("desktop").alias("profile"), F.lit(0).alias("rank")), F.struct(F.lit("mobile").alias("profile"), F.lit(1).alias("rank")))
    out = lines.select("*", F.explode(two).alias("p")).select("pair_id", "p.*", "ord", "line")
    return out.where(f"profile = 'desktop' or ord % {modulus} <> 0")


def items(lines: DataFrame) -> DataFrame:
    """Positioned items of each line, 20 pixels a line; dealt by pair."""
    at = F.row_number().over(_by_pair()) - 1
    placed = spread(lines, "pair_id").withColumn("n", at)
    return placed.select(
        F.col("pair_id"), F.col("n").cast("int").alias("ord"), F.col("line").alias("text"), (10 * (F.col("n") % 3)).cast("int").alias("x"),
        (20 * F.col("n")).cast("int").alias("y"), (8 * F.length("line")).cast("int").alias("w"), F.lit(16).alias("h"), F.lit(16).alias("font_size"),
    )


def _by_pair():
    from pyspark.sql import Window

    return Window.partitionBy("pair_id").orderBy("ord")


def image_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes from vectors: the hash is the signs of 64 components; ten vectors are a pair, by place source or target."""
    bits = F.expr("aggregate(transform(embedding, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    v = table(spark, sf_dir, "embeddings").where("vec_id is not null").withColumn("hash", bits)
    return v.select(
        F.floor(F.col("vec_id") / 10).cast("long").alias("pair_id"), F.when(F.col("vec_id") % 2 == 0, "source").otherwise("target").alias("side"),
        F.col("vec_id").cast("int").alias("ord"), (F.col("vec_id") * 37 % 900).cast("double").alias("x"), (F.col("vec_id") * 53 % 1700).cast("double").alias("y"), "hash",
    )


def pictures(texts: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of texts as PNG files of grey pixels: a pixel is a byte, 256 are a row, the last row ends white, no text is a white row."""
    small_batches(texts.sparkSession)

    def run(batches):
        for part in batches:
            for c in columns:
                part[c] = [_picture(t.encode()) for t in part[c]]
            yield part

    fields = [f"{f.name} {'binary' if f.name in columns else f.dataType.simpleString()}" for f in texts.schema]
    return texts.mapInPandas(run, ", ".join(fields))


def _picture(data: bytes) -> bytes:
    rows = max(1, -(-len(data) // PICTURE_WIDTH))
    return png.encode(np.frombuffer(data.ljust(rows * PICTURE_WIDTH, b"\xff"), np.uint8).reshape(rows, PICTURE_WIDTH, 1))


def picture_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, source, target: each document and its edited form as pictures."""
    lines = F.array_sort(F.collect_list(F.struct("ord", "line")))
    edited = spread(target_lines(spark, sf_dir), "pair_id").groupBy("pair_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("target"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.coalesce("text", F.lit("")).alias("source"))
    # both sides are dealt once, and pictures are made where the rows then are
    return pictures(spread(docs, "pair_id").join(edited, "pair_id", "left").select("pair_id", "source", F.coalesce("target", F.lit("")).alias("target")), "source", "target")


# --- the same rules in SQL ---------------------------------------------------------------------------------

LINES_SQL = """
doc_lines AS (
  SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
),
source_lines AS (SELECT doc_id AS pair_id, CAST(i AS BIGINT) AS ord, line FROM doc_lines),
edited AS (
  SELECT doc_id AS pair_id, (CASE WHEN i % 11 = 0 THEN i + 1000000 ELSE i END) * 2 AS place, i,
         CASE WHEN i % 5 = 0 THEN replace(line, ' ', '  ') ELSE line END AS line, length(line) // 2 AS half
  FROM doc_lines WHERE i % 7 <> 0
),
target_lines AS (
  SELECT pair_id, CAST(place AS BIGINT) AS ord, CASE WHEN i % 6 = 0 THEN substring(line, 1, half) ELSE line END AS line FROM edited
  UNION ALL
  SELECT pair_id, CAST(place + 1 AS BIGINT), substring(line, half + 1) FROM edited WHERE i % 6 = 0
)
"""


def line_sql(c: str) -> str:
    """P1."""
    bare = rf"regexp_replace(coalesce({c}, ''), '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g')"
    return f"lower(trim(regexp_replace({bare}, '{SPACES}', ' ', 'g')))"


def key_sql(normal: str) -> str:
    """P4 of a normalised line."""
    return f"trim(regexp_replace({normal}, '[^a-z0-9]+', ' ', 'g'))"


def crawl_key_sql(c: str) -> str:
    """P5."""
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"


def profiled_sql(lines: str, modulus: int) -> str:
    return (
        f"SELECT pair_id, 'desktop' AS profile, 0 AS rank, ord, line FROM {lines} UNION ALL "
        f"SELECT pair_id, 'mobile', 1, ord, line FROM {lines} WHERE ord % {modulus} <> 0"
    )
