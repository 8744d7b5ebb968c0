"""The run's files over the test tables: one query a file, over the lazy graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice import run
from pagelattice.plans import adapters as a
from pagelattice.plans.text_queries import AUDIT, ROLLUP, SCREEN, SUMMARY, _profiles, _ratio

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def graph(spark: SparkSession, sf: str) -> run.Run:
    """Each document and its edited form are a pair; captures of every tenth failed. Both profiles share scores; texts are the desktop's."""
    sides = dict(zip(("source", "target"), _profiles(spark, sf), strict=True))
    lines = None
    for role, found in sides.items():
        own = found.select("pair_id", F.lit(role).alias("role"), "profile", "rank", F.lit("visible").alias("kind"), "ord", "line")
        lines = own if lines is None else lines.unionByName(own)
    ids = a.table(spark, sf, "documents").select(F.col("doc_id").alias("idx"))
    pairs = run.pair_list(ids.select("idx", F.concat(F.lit("https://a/"), F.col("idx")).alias("source_url"), F.concat(F.lit("https://b/"), F.col("idx")).alias("target_url")))
    heights = [f(spark, sf).groupBy("pair_id").agg((20 * F.count("*")).alias(n)) for f, n in ((a.source_lines, "source_height"), (a.target_lines, "target_height"))]
    scores = heights[0].join(heights[1], "pair_id", "full").withColumn("image_similarity", F.col("pair_id") * 37 % 101 / F.lit(100.0))
    scores = scores.withColumn("profile", F.explode(F.array(F.lit("desktop"), F.lit("mobile"))))
    texts = [a.items(f(spark, sf)).withColumn("role", F.lit(r)) for f, r in ((a.source_lines, "source"), (a.target_lines, "target"))]
    failures = ids.where("idx % 10 = 9").select(F.col("idx").alias("pair_id"), F.lit("no page").alias("error"))
    return run.Run(run.Captures(pairs, lines, texts[0].unionByName(texts[1]), scores, failures), run.Config())


NAMES = (
    "names AS (SELECT doc_id AS pair_id, 'https://a/' || doc_id AS \"sourceUrl\", 'https://b/' || doc_id AS \"targetUrl\", "
    "printf('pair-%04d-%s', doc_id, substring(sha256('https://a/' || doc_id || '|https://b/' || doc_id), 1, 10)) AS slug FROM documents WHERE doc_id % 10 <> 9)"
)


@query(
    f"WITH {AUDIT}, {SCREEN}, {NAMES} SELECT slug, \"sourceUrl\", \"targetUrl\", verdict AS \"screeningVerdict\", CAST(NULL AS VARCHAR) AS \"finishedReason\", "
    "ord AS \"lineIndex\", line AS \"sourceLine\" FROM audited JOIN names USING (pair_id) JOIN screened USING (pair_id) WHERE match_type = 'missing' AND verdict <> 'fail'"
)
def run_text_missing(spark: SparkSession, sf: str) -> DataFrame:
    """S20."""
    return graph(spark, sf).text_missing()


@query(
    f"WITH {ROLLUP}, {NAMES} SELECT slug, CASE WHEN y.match_type = 'missing' THEN 'missing_entirely' ELSE 'viewport_shifted' END AS classification, "
    "m.profile AS \"missingUnderProfile\", m.line AS \"sourceLine\", \"sourceUrl\", \"targetUrl\" "
    "FROM missed m JOIN yaudited y ON y.pair_id = m.pair_id AND y.normal = m.normal JOIN names ON names.pair_id = m.pair_id"
)
def run_content_missing(spark: SparkSession, sf: str) -> DataFrame:
    """S21, U5."""
    return graph(spark, sf).content_missing()


@query(
    f"WITH {a.LINES_SQL}, {SCREEN}, {NAMES} SELECT slug, verdict, verdict = 'fail' AS \"skipAi\", round(image, 9) AS \"imageSimilarity\", round(recall, 9) AS \"textRecall\", "
    "round(ratio, 9) AS \"heightRatio\", \"sourceUrl\", \"targetUrl\" FROM screened JOIN names USING (pair_id)"
)
def run_screening_summary(spark: SparkSession, sf: str) -> DataFrame:
    """S17."""
    found = graph(spark, sf).screening_summary()
    return found.withColumns({c: _ratio(F.col(c)) for c in ("imageSimilarity", "textRecall", "heightRatio")})


@query(
    f"WITH {AUDIT}, {SCREEN}, summed AS ({SUMMARY}), told AS (SELECT s.* FROM summed s JOIN screened USING (pair_id) WHERE verdict <> 'fail' AND s.pair_id % 10 <> 9) "
    "SELECT d.doc_id AS pair_id, verdict, CASE WHEN d.doc_id % 10 = 9 THEN 'capture_failed' WHEN verdict = 'fail' THEN 'screening_fail' END AS finished_reason, "
    "coalesce(missing_lines, 0) AS text_missing_lines, coalesce(coverage, 1.0) AS text_coverage, coalesce(status, 'skipped') AS text_status "
    "FROM documents d LEFT JOIN told ON told.pair_id = d.doc_id LEFT JOIN screened c ON c.pair_id = d.doc_id AND d.doc_id % 10 <> 9"
)
def run_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The run's row of each pair, here without the layout's columns."""
    g = graph(spark, sf)
    told = g.text_summary.select("pair_id", F.col("missing_lines").alias("text_missing_lines"), _ratio(F.col("coverage")).alias("text_coverage"), F.col("status").alias("text_status"))
    return g.screened.select("pair_id", "verdict", "finished_reason").join(told, "pair_id")


@query()
def run_layout_missing(spark: SparkSession, sf: str) -> DataFrame:
    """S23."""
    return graph(spark, sf).layout_missing()


@query()
def run_layout_moved(spark: SparkSession, sf: str) -> DataFrame:
    """S23."""
    return graph(spark, sf).layout_moved()
