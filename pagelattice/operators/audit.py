"""Text comparison of a source and a target: set recall, and the staged audit of lines.

Lines are tables (pair_id, profile, ord, line); every operator works within its ``keys``, which are the
partition keys throughout, so a corpus of pairs needs one shuffle of each side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions import text
from pagelattice.operators.groups import spread

LEAST_KEY, LEAST_TOKENS, LEAST_COVERAGE = 8, 4, 0.8


def line_metrics(source: DataFrame, target: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """A1: recall of source lines (with repeats) and Jaccard index of the line sets; lines are compared as they are.

    Distinct lines of both sides meet by the line itself, so the lines of a pair are never held together. Null lines
    count nowhere, but a pair that has no others keeps its row.
    """
    keys = list(keys)
    counted = lambda side, name: side.groupBy(*keys, "line").agg(F.count("line").alias(name))
    met = counted(source, "n").join(counted(target, "m"), [*keys, "line"], "full").na.fill(0, ["n", "m"])
    both, either = (F.col("n") > 0) & (F.col("m") > 0), (F.col("n") > 0) | (F.col("m") > 0)
    found = met.groupBy(*keys).agg(
        F.sum("n").alias("source_lines"),
        F.sum("m").alias("target_lines"),
        F.sum(F.when(both, F.col("n")).otherwise(0)).alias("matched_lines"),
        F.count_if(both).alias("common"),
        F.count_if(either).alias("united"),
    )
    share = lambda part, whole: F.when(F.col(whole) == 0, 1.0).otherwise(F.col(part) / F.col(whole))
    return found.select(
        *keys, "source_lines", "target_lines", "matched_lines",
        share("matched_lines", "source_lines").alias("recall"), share("common", "united").alias("jaccard"),
    )


def target_index(target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The exact lines of a target, its keys as one stream of words with a space at both ends, and hashes of two words in a row there."""
    normal = target.select(*keys, "ord", text.line("line").alias("normal")).withColumn("key", text.key_of_line(F.col("normal")))
    stream = F.array_sort(F.collect_list(F.when(F.col("key") != "", F.struct("ord", "key"))))
    found = normal.groupBy(*keys).agg(
        F.collect_set("normal").alias("exact"),
        F.concat(F.lit(" "), F.array_join(F.transform(stream, lambda s: s["key"]), " "), F.lit(" ")).alias("blob"),
    )
    return found.withColumn("twos", F.array_distinct(_two_words(text.tokens(F.col("blob")))))


def _two_words(words: Column) -> Column:
    """A hash of each two words in a row."""
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(words) < 2, F.array().cast("array<bigint>")).otherwise(text.once(words, pairs))


def _spaced(c: Column) -> Column:
    return F.concat(F.lit(" "), c, F.lit(" "))


def longest_run(words: Column, blob: Column, twos: Column) -> Column:
    """How many of the words in a row follow each other in a stream of words, at most; ``twos`` are the stream's two words in a row.

    The words are parted wherever two in a row are nowhere in the stream. A part that the stream holds whole needs one search; in another
    a window grows where the stream holds it and moves on where not. All of it is an expression over one row: no word becomes a row.
    """

    def grown(part: Column, best: Column) -> Column:
        window = lambda size, last: F.array_join(F.slice(part, last - size, size + 1), " ")
        step = lambda size, last: size + F.contains(blob, _spaced(window(size, last))).cast("int")
        return F.aggregate(F.sequence(best + 1, F.size(part)), best, step)

    def longer(best: Column, part: Column) -> Column:
        n = F.size(F.split(part, " "))
        return F.when(n <= best, best).when(F.contains(blob, _spaced(part)), n).otherwise(text.once(F.split(part, " "), lambda p: grown(p, best)))

    def whole(s: Column) -> Column:
        ended = F.zip_with(s["words"], s["own"], lambda w, two: F.concat(w, F.when(F.array_contains(s["met"], two), " ").otherwise("\n")))
        return F.aggregate(F.filter(F.split(F.array_join(ended, ""), "\n"), lambda p: p != ""), F.lit(0), longer)

    own = _two_words(words)
    return text.once(F.struct(words.alias("words"), own.alias("own"), F.array_intersect(own, twos).alias("met")), whole)


def longest_runs(lines: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, key, longest: of each line's key with two words or more that follow each other in the target's stream of words the longest run.

    ``lines``: keys and key, without repeats. ``target``: keys and blob.
    """
    keys = list(keys)
    met = lines.join(target, keys).where("key <> ''").withColumn("twos", _two_words(text.tokens(F.col("blob"))))
    return met.select(*keys, "key", longest_run(text.tokens(F.col("key")), F.col("blob"), F.col("twos")).alias("longest")).where("longest > 1")


def _joined(lines: DataFrame, index: DataFrame, keys: list[str], dealt: list[str], how: str) -> DataFrame:
    """Lines and the row of their target. Equality of keys by which nothing is dealt is no equality to the planner, which would deal by them, too."""
    rest = [k for k in keys if k not in dealt]
    if not rest:
        return lines.join(index, keys, how)
    index = index.withColumnsRenamed({k: f"__{k}" for k in keys})
    met = [F.col(k) == F.col(f"__{k}") for k in dealt] + [F.array_contains(F.array(f"__{k}"), F.col(k)) for k in rest]
    return lines.join(index, reduce(lambda a, b: a & b, met), how).drop(*[f"__{k}" for k in keys])


def audit_lines(source: DataFrame, target: DataFrame, keys: Sequence[str] = ("pair_id",), how: str = "left", dealt: Sequence[str] | None = None) -> DataFrame:
    """Each source line's match: exact, substring (of the word stream), partial (by its longest run) or missing.

    ``token_coverage`` is the run's share of the line's words, where the last stage was reached. Both sides are shuffled once by
    ``keys``, or by the ones that are ``dealt``, and not at all where they are so already; all stages are expressions over a line and its
    target. ``how`` is inner to leave out lines without a target.
    """
    keys, dealt = list(keys), list(dealt or keys)
    lines = spread(source.select(*keys, "ord", "line"), *dealt).withColumn("normal", text.line("line")).withColumn("key", text.key_of_line(F.col("normal")))
    index = target_index(spread(target.select(*keys, "ord", "line"), *dealt), keys)
    met = _joined(lines, index, keys, dealt, how).withColumns({"blob": F.coalesce("blob", F.lit("  ")), "words": text.tokens(F.col("key"))})
    stage = (
        F.when((F.col("normal") != "") & F.coalesce(F.array_contains("exact", F.col("normal")), F.lit(False)), "exact")
        .when((F.length("key") >= LEAST_KEY) & F.contains("blob", _spaced(F.col("key"))), "substring")
        .when(F.size("words") >= LEAST_TOKENS, "run")
        .otherwise("missing")
    )
    coverage = F.when(F.col("stage") == "run", longest_run(F.col("words"), F.col("blob"), F.col("twos")) / F.size("words"))
    staged = met.withColumn("stage", stage).withColumn("token_coverage", coverage)
    told = F.when(F.col("stage") != "run", F.col("stage")).when(F.col("token_coverage") >= LEAST_COVERAGE, "partial").otherwise("missing")
    return staged.select(*keys, "ord", "line", "normal", "key", told.alias("match_type"), "token_coverage")


def of_type(name: str) -> Column:
    return F.count_if(F.col("match_type") == name)


def audit_summary(audited: DataFrame, keys: Sequence[str] = ("pair_id",)) -> DataFrame:
    """A2: totals, coverage and status of audited lines."""
    total = F.count("*")
    found = audited.groupBy(*keys).agg(
        total.alias("source_lines"),
        *[of_type(t).alias(f"{t}_lines") for t in ("exact", "substring", "partial", "missing")],
    )
    return found.select(
        "*",
        ((F.col("source_lines") - F.col("missing_lines")) / F.col("source_lines")).alias("coverage"),
        F.when(F.col("missing_lines") > 0, "discrepancies").otherwise("ok").alias("status"),
    )


def with_skipped(pairs: DataFrame, summary: DataFrame, reason: Column, key: str = "pair_id") -> DataFrame:
    """A3: pairs without an audit get a row of zeros, coverage 1, status skipped and the reason."""
    found = pairs.join(summary, key, "left")
    skipped = F.col("status").isNull()
    counts = [c for c in summary.columns if c.endswith("_lines")]
    return found.select(
        *pairs.columns,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        F.coalesce("coverage", F.lit(1.0)).alias("coverage"),
        F.coalesce("status", F.lit("skipped")).alias("status"),
        F.when(skipped, reason).alias("reason"),
    )


def missing_lines(audited: DataFrame) -> DataFrame:
    """J6."""
    return audited.where("match_type = 'missing'")
