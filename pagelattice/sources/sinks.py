"""Run-level files. Tables stay distributed; each file set is one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of the run's CSV files, in order.
FILES = {
    "screening-summary": "slug verdict skipAi imageSimilarity textRecall heightRatio sourceUrl targetUrl",
    "missing": "slug iter cropPath label sourceUrl targetUrl",
    "extra-on-target": "slug label bboxY bboxHeight sourceUrl targetUrl",
    "reordered-matches": "slug iter placement label sourceUrl targetUrl",
    "text-missing": "slug sourceUrl targetUrl screeningVerdict finishedReason lineIndex sourceLine",
    "content-missing": "slug classification missingUnderProfile sourceLine sourceUrl targetUrl",
    "screening-by-profile": "slug profile verdict imageSimilarity textRecall heightRatio aggregateVerdict sourceUrl targetUrl",
    "layout-missing": "slug sourceY sourceX text sourceUrl targetUrl",
    "layout-moved": "slug sourceY targetY text sourceUrl targetUrl",
}


def columns_of(name: str) -> list[str]:
    return FILES[name].split()


def write_csv(rows: DataFrame, name: str, folder: str) -> None:
    """The columns of a file; switches as 1 and 0, a field quoted where it must be, null as nothing."""
    found = rows.select(*columns_of(name))
    for f in found.schema:
        if f.dataType.typeName() == "boolean":
            found = found.withColumn(f.name, F.col(f.name).cast("int"))
    found.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(f"{folder}/{name}")


def write_lines(rows: DataFrame, folder: str) -> None:
    """A JSON object for each pair."""
    rows.write.mode("append").json(f"{folder}/summary-lines")


def write_artifacts(rows: DataFrame, name: str, folder: str) -> None:
    """One folder of JSON for each pair."""
    rows.write.mode("overwrite").partitionBy("slug").json(f"{folder}/{name}")


def run_summary(pairs: DataFrame, header: dict[str, str]) -> DataFrame:
    """The run's header beside its results in the order of the input, as one JSON text.

    A summary holds a small row for each pair of a run, so one row can hold a run.
    """
    results = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct(*pairs.columns).alias("row")))), lambda r: r["row"])
    return pairs.agg(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in header.items()], results.alias("results"))).alias("json"))


def escaped(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def page_html(nodes: DataFrame) -> DataFrame:
    """A page's nodes as boxes placed absolutely, images first and texts on top.

    ``nodes``: page_id, ord, kind, text, src, tag, x, y, w, h, font_size, color.
    """
    place = F.format_string("position:absolute;left:%spx;top:%spx;width:%spx;height:%spx;", "x", "y", "w", "h")
    said = F.format_string('<div class="t" style="%sfont-size:%spx;color:%s;">%s</div>', place, F.col("font_size"), escaped(F.col("color")), escaped(F.col("text")))
    shown = F.format_string('<div class="i" style="%s" title="%s">%s</div>', place, escaped(F.col("src")), escaped(F.coalesce("tag", F.lit("img"))))
    is_text = F.col("kind") == "text"
    piece = F.struct(is_text.alias("on_top"), F.col("ord"), F.when(is_text, said).otherwise(shown).alias("html"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["html"]), "\n")
    return nodes.groupBy("page_id").agg(F.concat(F.lit('<!doctype html><meta charset="utf-8"><body style="position:relative">'), body, F.lit("</body>")).alias("html"))


def overlay_svg(items: DataFrame, colour: str) -> DataFrame:
    """Outlines of a page's items as SVG; pixels are not drawn."""
    box = F.format_string(f'<rect x="%s" y="%s" width="%s" height="%s" fill="none" stroke="{colour}"/>', "x", "y", "w", "h")
    shapes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", box.alias("shape")))), lambda s: s["shape"]), "")
    return items.groupBy("pair_id").agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), shapes, F.lit("</svg>")).alias("svg"))
