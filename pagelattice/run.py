"""The run: from a list of pairs and their captures to all tables and files.

``Run`` is the graph of tables keyed by pair. Each audit and alignment is made once: ``run`` writes it and everything
behind reads what was written; without a folder the same graph stays lazy. A pair whose capture failed keeps its row
in the summary and takes part in nothing else, so it cannot stop the others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.functions import text
from pagelattice.operators import audit, content, layout, report, screening
from pagelattice.operators.groups import spread
from pagelattice.sources import sinks


@dataclass(frozen=True)
class Config:
    """``folder``: where tables and files go, none for a lazy graph. ``profile``: whose captures the audits read."""

    folder: str | None = None
    profile: str = "desktop"
    expanded: bool = True
    text_only: bool = False
    screening_only: bool = False
    audit_failed: bool = False
    rules: tuple[dict, ...] = ()
    thresholds: screening.Thresholds = field(default_factory=screening.Thresholds)
    header: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Captures:
    """What a run starts from.

    pairs: idx, source_url, target_url, slug. lines: pair_id, role (source or target), profile, rank, kind (visible or expanded), ord, line.
    items: pair_id, role, ord, text, x, y, w, h of the audited profile. scores: pair_id, profile, image_similarity,
    source_height, target_height. failures: pair_id, error.
    """

    pairs: DataFrame
    lines: DataFrame
    items: DataFrame
    scores: DataFrame
    failures: DataFrame


def lines_to_audit(lines: DataFrame, expanded: bool = True) -> DataFrame:
    """P10: of a capture the lines after expansion where it has any and they are asked for, else the visible ones."""
    keys = ["pair_id", "role", "profile"]
    if not expanded:
        return lines.where("kind = 'visible'").drop("kind")
    has = lines.where("kind = 'expanded'").select(*keys).distinct().withColumn("has", F.lit(True))
    wanted = F.when(F.col("has"), "expanded").otherwise("visible")
    return lines.join(has, keys, "left").where(F.col("kind") == wanted).drop("kind", "has")


def text_items(nodes: DataFrame) -> DataFrame:
    """The texts among a page's nodes, with the columns that alignment reads."""
    return nodes.where("kind = 'text'").select("pair_id", "role", "ord", "text", "x", "y", "w", "h")


def merged_rounds(rounds: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Lines (keys, round, ord, line) once each, by first sight; and how many each round added, 0 included."""
    first = rounds.groupBy(*keys, "line").agg(F.min(F.struct("round", "ord")).alias("at")).select(*keys, F.col("at.round").alias("round"), F.col("at.ord").alias("ord"), "line")
    seen = rounds.select(*keys, "round").distinct()
    return first, seen.join(first.groupBy(*keys, "round").agg(F.count("*").alias("added")), [*keys, "round"], "left").na.fill(0, ["added"])


class Run:
    def __init__(self, captures: Captures, config: Config):
        self.given, self.config = captures, config

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        if self.config.folder is None:
            return df
        path = f"{self.config.folder}/tables/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _whole(self, df: DataFrame) -> DataFrame:
        """Rows of pairs whose captures are there, dealt by pair, as all that follows needs them.

        An anti join would be moved below the dealing, which then is the join's own and may be merged into few partitions.
        """
        failed = self.given.failures.select("pair_id").distinct().withColumn("failed", F.lit(True))
        return spread(df, "pair_id").join(failed, "pair_id", "left").where("failed is null").drop("failed")

    def _side(self, df: DataFrame, role: str) -> DataFrame:
        return df.where(F.col("role") == role).drop("role")

    @cached_property
    def lines(self) -> DataFrame:
        return self._kept("lines", lines_to_audit(self._whole(self.given.lines), self.config.expanded))

    @cached_property
    def screening_by_profile(self) -> DataFrame:
        """G1 for each profile that both sides have; screening reads the normalised visible lines, before expansion."""
        seen = self._whole(self.given.lines).where("kind = 'visible'").withColumn("line", text.line("line"))
        metrics = audit.line_metrics(self._side(seen, "source"), self._side(seen, "target"), ["pair_id", "profile"])
        both = self._whole(self.given.scores).join(metrics, ["pair_id", "profile"])
        both = both.withColumn("height_ratio", screening.height_ratio(F.col("source_height"), F.col("target_height")))
        told = screening.verdict(F.col("image_similarity"), F.col("recall"), F.col("height_ratio"), self.config.thresholds)
        found = both.withColumn("s", told).select("pair_id", "profile", "s.*", "image_similarity", F.col("recall").alias("text_recall"), "height_ratio")
        return self._kept("screening-by-profile", found)

    @cached_property
    def screened(self) -> DataFrame:
        """A row for each pair of the list."""
        own = self.screening_by_profile.where(F.col("profile") == self.config.profile).drop("profile")
        pairs = self.given.pairs.withColumnRenamed("idx", "pair_id")
        errors = self.given.failures.groupBy("pair_id").agg(F.min("error").alias("capture_error"))
        found = pairs.join(own, "pair_id", "left").join(screening.worst(self.screening_by_profile), "pair_id", "left").join(errors, "pair_id", "left")
        ended = screening.finished_reason(F.col("verdict"), F.lit(self.config.text_only), F.lit(self.config.screening_only), F.coalesce("skip_ai", F.lit(False)))
        return self._kept("screening", found.withColumn("finished_reason", F.when(F.col("capture_error").isNotNull(), "capture_failed").otherwise(ended)))

    @cached_property
    def audited(self) -> DataFrame:
        """J3-J5 for the audited profile, without the pairs that failed screening unless those are asked for."""
        lines = self.lines.where(F.col("profile") == self.config.profile)
        if not self.config.audit_failed:
            lines = lines.join(self.screened.where("verdict = 'fail'").select("pair_id"), "pair_id", "left_anti")
        return self._kept("text-audit", audit.audit_lines(self._side(lines, "source"), self._side(lines, "target")))

    @cached_property
    def text_summary(self) -> DataFrame:
        """A2, A3."""
        reason = F.when(F.col("capture_error").isNotNull(), "capture_failed").when(F.col("verdict") == "fail", "skipped_screening_fail").otherwise("no_source_lines")
        pairs = self.screened.select("pair_id", "verdict", "capture_error")
        return self._kept("text-summary", audit.with_skipped(pairs, audit.audit_summary(self.audited), reason).drop("verdict", "capture_error"))

    @cached_property
    def content(self) -> DataFrame:
        """J7, J8 over all profiles."""
        return self._kept("content", content.rollup(self._side(self.lines, "source"), self._side(self.lines, "target")))

    def _alignment(self, only: tuple[str, str] | None = None) -> DataFrame:
        items = self._whole(self.given.items)
        return layout.align(self._side(items, "source"), self._side(items, "target"), list(self.config.rules), only)

    @cached_property
    def aligned(self) -> DataFrame:
        """J9 over the positioned texts."""
        return self._kept("layout", self._alignment())

    @cached_property
    def layout_summary(self) -> DataFrame:
        return self._kept("layout-summary", layout.summary(self.aligned))

    @cached_property
    def pairs(self) -> DataFrame:
        """Each pair of the list with what every part says of it."""
        rolled = content.rollup_summary(self.screened, self.content)
        found = self.screened.drop("reasons")
        found = report.with_fields(found, self.text_summary, "text")
        found = report.with_fields(found, rolled, "content")
        laid = self.layout_summary.withColumn("pair_id", F.col("pair_id").cast("long"))
        return self._kept("pairs", report.with_fields(found, laid, "layout"))

    def _named(self, df: DataFrame, *told: str) -> DataFrame:
        """``df`` with its pair's slug and addresses, and what screening ``told`` of it; nothing is screened for the names alone."""
        pairs = self.screened if told else self.given.pairs.withColumnRenamed("idx", "pair_id")
        return df.join(pairs.select("pair_id", "slug", F.col("source_url").alias("sourceUrl"), F.col("target_url").alias("targetUrl"), *told), "pair_id")

    def text_missing(self) -> DataFrame:
        """S20."""
        found = self._named(audit.missing_lines(self.audited).select("pair_id", "ord", "line"), "verdict", "finished_reason")
        return found.select("slug", "sourceUrl", "targetUrl", F.coalesce("verdict", F.lit("")).alias("screeningVerdict"), F.col("finished_reason").alias("finishedReason"), F.col("ord").alias("lineIndex"), F.col("line").alias("sourceLine"))

    def content_missing(self) -> DataFrame:
        """What is missing entirely and what moved to another profile, in one table with a tag."""
        found = self._named(self.content)
        return found.select("slug", "classification", F.col("missing_under_profile").alias("missingUnderProfile"), F.col("source_line").alias("sourceLine"), "sourceUrl", "targetUrl")

    def screening_summary(self) -> DataFrame:
        """S17."""
        return self.screened.where("capture_error is null and verdict is not null").select(
            "slug", "verdict", F.col("skip_ai").alias("skipAi"), F.col("image_similarity").alias("imageSimilarity"), F.col("text_recall").alias("textRecall"),
            F.col("height_ratio").alias("heightRatio"), F.col("source_url").alias("sourceUrl"), F.col("target_url").alias("targetUrl"),
        )

    def screening_profiles(self) -> DataFrame:
        """S22."""
        found = self.screening_by_profile.select("pair_id", "profile", F.col("verdict").alias("own"), "image_similarity", "text_recall", "height_ratio")
        return self._named(found, "aggregate_verdict").select(
            "slug", "profile", F.col("own").alias("verdict"), F.col("image_similarity").alias("imageSimilarity"), F.col("text_recall").alias("textRecall"),
            F.col("height_ratio").alias("heightRatio"), F.coalesce("aggregate_verdict", F.lit("")).alias("aggregateVerdict"), "sourceUrl", "targetUrl",
        )

    def _laid(self, status: str) -> DataFrame:
        found = self._alignment(("source", status)) if self.config.folder is None else self.aligned.where((F.col("side") == "source") & (F.col("status") == status))
        return self._named(found.select(F.col("pair_id").cast("long").alias("pair_id"), "x", "y", "other_y", "text"))

    def layout_missing(self) -> DataFrame:
        """S23."""
        return self._laid("missing").select("slug", F.col("y").alias("sourceY"), F.col("x").alias("sourceX"), "text", "sourceUrl", "targetUrl")

    def layout_moved(self) -> DataFrame:
        """S23."""
        return self._laid("moved").select("slug", F.col("y").alias("sourceY"), F.col("other_y").alias("targetY"), "text", "sourceUrl", "targetUrl")

    @property
    def files(self) -> dict[str, Callable[[], DataFrame]]:
        return {
            "screening-summary": self.screening_summary, "screening-by-profile": self.screening_profiles, "text-missing": self.text_missing,
            "content-missing": self.content_missing, "layout-missing": self.layout_missing, "layout-moved": self.layout_moved,
        }

    def artifacts(self) -> dict[str, DataFrame]:
        """What is kept for each pair, one folder a pair."""
        return {
            "pair-report": self.pairs.drop("pair_id"),
            "text-audit": self._named(self.audited).select("slug", "ord", "line", "match_type", "token_coverage"),
            "content-comparison": self.content_missing().drop("sourceUrl", "targetUrl"),
        }


def capture_lists(results: DataFrame) -> dict[str, DataFrame]:
    """From answered pairs (slug, source_url, target_url, capture_error and arrays of structs) one row an entry.

    missing: iter, crop_path, label. extra_on_target: label, y, height. reordered_matches: iter, placement, label. Pairs whose
    capture failed have no rows, and a null array is an empty one.
    """
    there = results.where("capture_error is null")
    urls = [F.col("source_url").alias("sourceUrl"), F.col("target_url").alias("targetUrl")]
    label = F.coalesce("m.label", F.lit("")).alias("label")
    each = lambda name: there.select("slug", *urls, F.explode(name).alias("m"))
    return {
        "missing": each("missing").select("slug", "m.iter", F.col("m.crop_path").alias("cropPath"), label, "sourceUrl", "targetUrl"),
        "extra-on-target": each("extra_on_target").select("slug", label, F.col("m.y").alias("bboxY"), F.col("m.height").alias("bboxHeight"), "sourceUrl", "targetUrl"),
        "reordered-matches": each("reordered_matches").select("slug", "m.iter", F.coalesce("m.placement", F.lit("")).alias("placement"), label, "sourceUrl", "targetUrl"),
    }


def run(spark: SparkSession, captures: Captures, config: Config) -> DataFrame:
    """Writes all tables, files and artifacts of a run below ``config.folder`` and returns the rows of its pairs."""
    if config.folder is None:
        raise ValueError("a run needs a folder")
    graph = Run(captures, config)
    pairs = graph.pairs
    for name, make in graph.files.items():
        sinks.write_csv(make(), name, f"{config.folder}/files")
    for name, rows in graph.artifacts().items():
        sinks.write_artifacts(rows, name, f"{config.folder}/pairs")
    sinks.write_lines(pairs, f"{config.folder}/files")
    return pairs


def pair_list(pairs: DataFrame) -> DataFrame:
    """Pairs (idx, source_url, target_url) with their slug."""
    return pairs.withColumn("slug", text.slug(F.col("idx"), F.col("source_url"), F.col("target_url")))
