"""Lines of recognised words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.functions.geometry import rounded
from pagelattice.functions.text import is_noise

# The columns of the recogniser's table.
COLUMNS = (
    "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, "
    "conf double, text string"
)
WORD, LEAST_CONFIDENCE, SEAM = 5, 40, 6


def read(spark: SparkSession, path: str) -> DataFrame:
    """Tables of words, one file for each tile of an image; the file's path is kept."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=COLUMNS, quote="")
    return rows.withColumn("tile", F.col("_metadata.file_path"))


def lines(words: DataFrame, keys: tuple[str, ...] = ("image_id", "tile_top"), least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Words of a line joined in order, with the box around them; noise goes, and what two tiles both hold counts once.

    ``words`` has the table's columns, the keys and ``ord``. ``tile_top`` is where a tile begins in its image.
    """
    kept = words.where((F.col("level") == WORD) & (F.col("conf") >= least) & (F.trim("text") != ""))
    kept = kept.withColumn("y", F.col("top") + F.col("tile_top"))
    # two lists of plain values are half the bytes of one of structs when lines are shuffled; a word without a place comes first
    placed = F.arrays_zip(F.collect_list(F.coalesce("ord", F.lit(-(2**31)))).alias("ord"), F.collect_list("text").alias("text"))
    said = F.array_join(F.transform(F.array_sort(placed), lambda w: w["text"]), " ")
    grouped = kept.groupBy(*keys, "block_num", "par_num", "line_num").agg(
        F.min("ord").alias("ord"), said.alias("text"), F.min("left").alias("x"), F.min("y").alias("y"),
        (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("w"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("h"),
    )
    grouped = grouped.where(~is_noise(F.col("text")))
    seam = [rounded(F.col("y") / SEAM), F.greatest(F.lit(0), rounded(F.col("x") / SEAM))]
    first = grouped.withColumns({"sy": seam[0], "sx": seam[1]}).groupBy(keys[0], "sy", "sx", "text")
    return first.agg(F.min_by(F.struct("ord", "x", "y", "w", "h"), F.struct("tile_top", "ord")).alias("at")).select(keys[0], "text", "at.*")
