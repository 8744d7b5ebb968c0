"""Content that interaction reveals: presence on the other side, grouping by trigger, snapping to the base layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions import text
from pagelattice.functions.geometry import rounded

SNAP, NEIGHBOUR, LOCAL, DISTINCTIVE, LABEL, NEAREST = 300, 1500, 150, 12, 60, 5
#: Characters of a label that are read first for its key.
BEGINNING = 128


def corpora(lines: DataFrame, name: str = "corpus", keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """A pair's lines (pair_id, ord, text) as one string; two spaces part lines, so no match spans them."""
    stream = F.array_sort(F.collect_list(F.struct("ord", text.crawl_key("text").alias("key"))))
    joined = F.array_join(F.transform(stream, lambda s: s["key"]), "  ")
    return lines.groupBy(*keys).agg(F.concat(F.lit(" "), joined, F.lit(" ")).alias(name))


def is_present(line: Column, corpus: Column) -> Column:
    """Two characters at least, anywhere in the corpus, also within words."""
    k = text.crawl_key(line)
    return F.coalesce((F.length(k) >= 2) & F.contains(corpus, k), F.lit(False))


def gated_present(missing: DataFrame, revealed: DataFrame) -> DataFrame:
    """Missing lines (pair_id, ord, text) that the target's interaction reveals, with the first trigger that does.

    ``revealed``: pair_id, ord, text, trigger_label. A pair's revealed keys are one sorted array beside its corpus, so each
    missing line reads them once and no table of pairs of lines is made.
    """
    entry = F.struct("ord", text.crawl_key("text").alias("key"), F.col("trigger_label").alias("label"))
    lines = revealed.groupBy("pair_id").agg(F.array_sort(F.collect_list(entry)).alias("lines"))
    keyed = missing.select("pair_id", "ord", "text", text.crawl_key("text").alias("q"))
    held = F.concat(F.lit(" "), F.array_join(F.transform("lines", lambda r: r["key"]), "  "), F.lit(" "))
    behind = keyed.where(F.length("q") >= 2).join(lines.withColumn("corpus", held), "pair_id").where(F.contains("corpus", F.col("q")))
    told = F.filter("lines", lambda r: F.contains(r["key"], F.col("q")) | F.contains(F.col("q"), r["key"]))
    return behind.select("pair_id", "ord", "text", F.get(told, F.lit(0))["label"].alias("trigger_label"))


def gated_missing(revealed: DataFrame, target: DataFrame) -> DataFrame:
    """Revealed source lines that no line of the target (pair_id, ord, text) holds."""
    found = revealed.join(corpora(target), "pair_id", "left")
    return found.where(~is_present(F.col("text"), F.col("corpus"))).drop("corpus")


def trigger_groups(revealed: DataFrame, other: DataFrame) -> DataFrame:
    """A10: revealed lines by label and place of their trigger, each told present or missing on the other side."""
    tag = F.when(is_present(F.col("text"), F.col("corpus")), "present").otherwise("missing")
    lines = F.array_sort(F.collect_list(F.struct("ord", "text", tag.alias("on_other"))))
    found = revealed.join(corpora(other), "pair_id", "left").groupBy("pair_id", "trigger_label", "x", "y")
    return found.agg(F.min("ord").alias("first_ord"), F.count("*").alias("revealed"), F.count_if(tag == "present").alias("present"), lines.alias("lines"))


def attach_states(groups: DataFrame, states: DataFrame) -> DataFrame:
    """A group's state, by label and place; the last of several."""
    last = states.groupBy("pair_id", "trigger_label", "x", "y").agg(F.max_by("state_id", "ord").alias("state_id"))
    return groups.join(last, ["pair_id", "trigger_label", "x", "y"], "left")


def content_key(kind: Column, words: Column, src: Column) -> Column:
    """What a node is, whatever its place: its text, or its file's name."""
    said = F.lower(F.trim(F.regexp_replace(F.coalesce(words, F.lit("")), text.SPACE, " ")))
    name = F.substring_index(F.substring_index(F.coalesce(src, F.lit("")), "/", -1), "?", 1)
    return F.when(kind == "text", F.concat(F.lit("t:"), said)).otherwise(F.concat(F.lit("i:"), name))


def state_delta(state: DataFrame, base: DataFrame) -> DataFrame:
    """Nodes (pair_id, kind, text, src) of a state that the base page does not hold."""
    keyed = lambda d: d.withColumn("content", content_key(F.col("kind"), F.col("text"), F.col("src")))
    return keyed(state).join(keyed(base).select("pair_id", "content").distinct(), ["pair_id", "content"], "left_anti")


def first_reveals(lines: DataFrame, base: DataFrame) -> DataFrame:
    """A revealed line (pair_id, trigger, ord, text) belongs to the first trigger that shows it; base lines belong to none."""
    keyed = lambda d: d.withColumn("key", text.crawl_key("text"))
    rank = F.row_number().over(Window.partitionBy("pair_id", "key").orderBy("trigger", "ord"))
    new = keyed(lines).where("key <> ''").join(keyed(base).select("pair_id", "key").distinct(), ["pair_id", "key"], "left_anti")
    return new.withColumn("n", rank).where("n = 1").drop("n")


def distinct_states(states: DataFrame, most: int = 60) -> DataFrame:
    """The first of equal signatures, and at most so many states a pair."""
    first = F.row_number().over(Window.partitionBy("pair_id", "signature").orderBy("ord"))
    kept = states.withColumn("n", first).where("n = 1")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("pair_id").orderBy("ord"))).where(F.col("n") <= most).drop("n")


def find_trigger(wanted: DataFrame, groups: DataFrame) -> DataFrame:
    """The trigger of a wanted (pair_id, ord, label, text): by label and text, else by label, else by text.

    ``groups``: pair_id, g_ord, g_label, lines (array of revealed texts). Groups are keyed once and lie with their pair.
    """
    keys = F.filter(F.transform("lines", text.crawl_key), lambda r: r != "")
    entry = F.struct("g_ord", text.crawl_key("g_label").alias("label"), F.coalesce(keys, F.array().cast("array<string>")).alias("keys"))
    held = groups.groupBy("pair_id").agg(F.collect_list(entry).alias("held"))
    keyed = wanted.withColumns({"__label": text.crawl_key("label"), "__said": text.crawl_key("text")}).join(held, "pair_id", "left")
    label, said = F.col("__label"), F.col("__said")

    def place(g: Column) -> Column:
        by_label = (label != "") & (g["label"] == label)
        by_text = (said != "") & F.exists(g["keys"], lambda r: F.contains(r, said) | F.contains(said, r))
        order = F.when(by_label & by_text, 0).when(by_label, 1).when(by_text, 2)
        return F.when(order.isNotNull(), F.struct(order.alias("order"), g["g_ord"].alias("g_ord")))

    best = F.array_min(F.transform("held", place))
    return keyed.select(*wanted.columns, best["g_ord"].alias("g_ord"))


def _labelled(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the first ``LABEL`` characters of their label's crawl key, made once for each row, also where filters and joins read it again.

    The label's beginning tells them, unless too little of it stays in the key; then the whole label is read.
    """
    label = F.coalesce("label", F.lit(""))
    told = lambda k: (F.length(k) >= LABEL) | (F.length(label) <= BEGINNING)
    key = F.transform(F.array(text.crawl_key(F.substring(label, 1, BEGINNING))), lambda k: F.when(told(k), k).otherwise(text.crawl_key(label)))
    return rows.select("*", F.explode(key).alias("__key")).withColumn(name, F.substring("__key", 1, LABEL)).drop("__key")


def snap(triggers: DataFrame, elements: DataFrame) -> DataFrame:
    """Triggers (pair_id, ord, label, x, y, w, h) moved onto the base layout.

    ``elements``: pair_id, e_ord, kind (click or text), label, x, y, w, h. A trigger takes the geometry of the
    clickable, or else of the text (and the clickable around it), with its label: equal, or one the start of
    the other of five characters at least. The nearest counts, within SNAP pixels unless it is the only one
    and its label is long or of several words. Other triggers move by the median shift of their five nearest
    snapped ones, LOCAL pixels at most, if one is within NEIGHBOUR pixels.
    """
    t = triggers.withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})
    e = elements.select("pair_id", "e_ord", "kind", "label", *[F.col(c).alias(f"e_{c}") for c in "xywh"])
    keyed, e_keyed = _labelled(t, "key").where("key <> ''"), _labelled(e, "e_key").where("e_key <> ''").drop("label")
    # labels of five characters or more share their first five if one starts the other; shorter ones are equal
    start = lambda c: F.when(F.length(c) >= 5, F.substring(c, 1, 5)).otherwise(c)
    met = keyed.withColumn("start", start(F.col("key"))).join(e_keyed.withColumn("start", start(F.col("e_key"))), ["pair_id", "start"])
    related = (F.col("key") == F.col("e_key")) | (
        (F.least(F.length("key"), F.length("e_key")) >= 5) & (F.startswith("key", F.col("e_key")) | F.startswith("e_key", F.col("key")))
    )
    distance = F.hypot(F.col("e_x") + F.col("e_w") / 2 - F.col("cx"), F.col("e_y") + F.col("e_h") / 2 - F.col("cy"))
    kinds = met.where(related).withColumn("d", distance).groupBy("pair_id", "ord", "kind", "key")
    picked = kinds.agg(F.count("*").alias("n"), F.min_by(F.struct("d", "e_x", "e_y", "e_w", "e_h"), F.struct("d", "e_ord")).alias("best"))
    sure = (F.col("n") == 1) & ((F.length("key") >= DISTINCTIVE) | F.contains("key", F.lit(" ")))
    picked = picked.where(sure | (F.col("best.d") <= SNAP)).select("pair_id", "ord", "kind", "best.*")
    one = picked.groupBy("pair_id", "ord").agg(F.min_by(F.struct("kind", "e_x", "e_y", "e_w", "e_h"), "kind").alias("g")).select("pair_id", "ord", "g.*")
    clicks = e.where("kind = 'click'").select("pair_id", F.col("e_ord").alias("c_ord"), *[F.col(f"e_{c}").alias(f"c_{c}") for c in "xywh"])
    mx, my = F.col("e_x") + F.col("e_w") / 2, F.col("e_y") + F.col("e_h") / 2
    around = one.where("kind = 'text'").join(clicks, "pair_id").where(
        mx.between(F.col("c_x"), F.col("c_x") + F.col("c_w")) & my.between(F.col("c_y"), F.col("c_y") + F.col("c_h"))
    )
    holder = around.groupBy("pair_id", "ord").agg(F.min_by(F.struct("c_x", "c_y", "c_w", "c_h"), "c_ord").alias("c"))
    snapped = one.join(holder, ["pair_id", "ord"], "left").select("pair_id", "ord", *[F.coalesce(F.col(f"c.c_{c}"), F.col(f"e_{c}")).alias(f"n_{c}") for c in "xywh"])
    placed = t.join(snapped, ["pair_id", "ord"], "left")
    anchors = placed.where("n_x is not null").select(
        "pair_id", F.col("ord").alias("a_ord"), F.col("cx").alias("acx"), F.col("cy").alias("acy"),
        (F.col("n_x") + F.col("n_w") / 2 - F.col("cx")).alias("dx"), (F.col("n_y") + F.col("n_h") / 2 - F.col("cy")).alias("dy"),
    )
    apart = F.abs(F.col("acx") - F.col("cx")) + F.abs(F.col("acy") - F.col("cy"))
    near = placed.where("n_x is null").join(anchors, "pair_id").withColumn("apart", apart)
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("pair_id", "ord").orderBy("apart", "a_ord"))).where(F.col("k") <= NEAREST)
    shift = near.groupBy("pair_id", "ord").agg(F.min("apart").alias("least"), F.median("dx").alias("mx"), F.median("dy").alias("my")).where(F.col("least") <= NEIGHBOUR)
    held = lambda c: F.greatest(F.lit(-LOCAL), F.least(F.lit(LOCAL), F.col(c)))
    out = placed.join(shift, ["pair_id", "ord"], "left")
    moved = {c: F.coalesce(F.col(f"n_{c}"), rounded(F.col(c) + held(m)), F.col(c)).cast("double") for c, m in (("x", "mx"), ("y", "my"))}
    kept = {c: F.coalesce(F.col(f"n_{c}"), F.col(c)).cast("double") for c in "wh"}
    how = F.when(F.col("n_x").isNotNull(), "label").when(F.col("mx").isNotNull(), "neighbours").otherwise("kept")
    return out.select("pair_id", "ord", "label", *[v.alias(k) for k, v in (moved | kept).items()], how.alias("how"))
