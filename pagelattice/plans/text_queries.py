"""Queries over lines of text: normalisers, recall, audit, content, screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.functions import text
from pagelattice.operators import audit, content, report, screening
from pagelattice.plans import adapters as a

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _ratio(c):
    return F.round(c, 9)


NORMAL = a.line_sql("line")
VISIBLE = f"""
normal AS (SELECT pair_id, ord, line, {NORMAL} AS norm FROM source_lines),
kept AS (
  SELECT * FROM normal WHERE length(norm) >= 2 AND NOT ({" OR ".join(f"contains(norm, '{p}')" for p in text.COOKIE_PHRASES)})
)"""


@query(f"WITH {a.LINES_SQL} SELECT doc_id, CAST(i AS BIGINT) AS i, {NORMAL} AS norm FROM doc_lines")
def line_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """P1."""
    return a.doc_lines(spark, sf).select("doc_id", F.col("i").cast("long").alias("i"), text.line("line").alias("norm"))


@query(f"WITH {a.LINES_SQL}, {VISIBLE} SELECT pair_id, ord, norm FROM kept")
def boilerplate_filter(spark: SparkSession, sf: str) -> DataFrame:
    """P2."""
    lines = a.source_lines(spark, sf).select("pair_id", "ord", text.line("line").alias("norm"))
    return lines.where(~text.is_boilerplate(F.col("norm")))


@query(
    f"WITH {a.LINES_SQL}, {VISIBLE} SELECT pair_id, norm, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY ord) AS BIGINT) AS place "
    "FROM (SELECT pair_id, norm, min(ord) AS ord FROM kept GROUP BY pair_id, norm)"
)
def visible_lines(spark: SparkSession, sf: str) -> DataFrame:
    """P3 over arrays, one row a line."""
    docs = a.table(spark, sf, "documents").select(F.col("doc_id").alias("pair_id"), text.visible_lines(F.split("text", "\n")).alias("lines"))
    return docs.select("pair_id", F.posexplode("lines").alias("p", "norm")).select("pair_id", "norm", (F.col("p") + 1).cast("long").alias("place"))


@query(f"WITH {a.LINES_SQL} SELECT doc_id, CAST(i AS BIGINT) AS i, {a.key_sql(NORMAL)} AS key FROM doc_lines")
def substring_key(spark: SparkSession, sf: str) -> DataFrame:
    """P4."""
    return a.doc_lines(spark, sf).select("doc_id", F.col("i").cast("long").alias("i"), text.key("line").alias("key"))


@query(f"WITH {a.LINES_SQL} SELECT doc_id, CAST(i AS BIGINT) AS i, {a.crawl_key_sql('line')} AS key FROM doc_lines")
def crawl_key(spark: SparkSession, sf: str) -> DataFrame:
    """P5."""
    return a.doc_lines(spark, sf).select("doc_id", F.col("i").cast("long").alias("i"), text.crawl_key("line").alias("key"))


@query(
    f"WITH {a.LINES_SQL} SELECT pair_id, ord, trim(regexp_replace(regexp_replace(regexp_replace(line, 'the', 'THE', 'gi'), '[0-9]+', '', 'g'), "
    f"'{a.SPACES}', ' ', 'g')) AS line FROM source_lines"
)
def normalize_rules(spark: SparkSession, sf: str) -> DataFrame:
    """P7 with a literal rule and a pattern."""
    rules = [{"from": "the", "to": "THE"}, {"ignorePattern": "[0-9]+"}]
    return a.source_lines(spark, sf).select("pair_id", "ord", text.with_rules(F.col("line"), rules).alias("line"))


METRICS = f"""
s AS (SELECT pair_id, {NORMAL} AS line FROM source_lines),
t AS (SELECT pair_id, {NORMAL} AS line FROM target_lines),
td AS (SELECT DISTINCT * FROM t), sd AS (SELECT DISTINCT * FROM s),
m AS (
  SELECT s.pair_id, count(*) AS source_lines, count(td.line) AS matched_lines FROM s LEFT JOIN td ON td.pair_id = s.pair_id AND td.line = s.line
  GROUP BY s.pair_id
),
u AS (
  SELECT coalesce(sd.pair_id, td.pair_id) AS pair_id, count(*) AS united, count(*) FILTER (sd.line IS NOT NULL AND td.line IS NOT NULL) AS common
  FROM sd FULL JOIN td ON td.pair_id = sd.pair_id AND td.line = sd.line GROUP BY 1
)"""


def _metrics(spark, sf):
    source, target = (f(spark, sf).withColumn("line", text.line("line")) for f in (a.source_lines, a.target_lines))
    return audit.line_metrics(source, target)


@query(
    f"WITH {a.LINES_SQL}, {METRICS} SELECT pair_id, CAST(source_lines AS BIGINT) AS source_lines, CAST(matched_lines AS BIGINT) AS matched_lines, "
    "round(matched_lines / source_lines, 9) AS recall FROM m"
)
def text_recall(spark: SparkSession, sf: str) -> DataFrame:
    """J1, A1."""
    return _metrics(spark, sf).select("pair_id", "source_lines", "matched_lines", _ratio(F.col("recall")).alias("recall"))


@query(f"WITH {a.LINES_SQL}, {METRICS} SELECT pair_id, round(common / united, 9) AS jaccard FROM u")
def text_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """J2, U3."""
    return _metrics(spark, sf).select("pair_id", _ratio(F.col("jaccard")).alias("jaccard"))


def audit_sql(source: str, target: str, keys: str, order: str = "ord", prefix: str = "") -> str:
    """Common tables that end in {prefix}audited (keys, ord, line, normal, key, match_type, token_coverage).

    The longest run is found by lining up equal words of line and stream: a run is an island on a diagonal.
    """
    k = keys.split(", ")
    on = lambda x, y: " AND ".join(f"{x}.{c} = {y}.{c}" for c in k)
    p = prefix
    return f"""
{p}sn AS (SELECT *, {a.key_sql("normal")} AS key FROM (SELECT {keys}, ord, line, {NORMAL} AS normal FROM {source})),
{p}tn AS (SELECT *, {a.key_sql("normal")} AS key FROM (SELECT {keys}, {order} AS ord, {NORMAL} AS normal FROM {target})),
{p}blob AS (SELECT {keys}, ' ' || coalesce(string_agg(key, ' ' ORDER BY ord) FILTER (key <> ''), '') || ' ' AS blob FROM {p}tn GROUP BY {keys}),
{p}staged AS (
  SELECT s.*, CASE WHEN key = '' THEN 0 ELSE len(string_split(key, ' ')) END AS n,
    CASE WHEN normal <> '' AND EXISTS (SELECT 1 FROM {p}tn t WHERE {on("t", "s")} AND t.normal = s.normal) THEN 'exact'
         WHEN length(key) >= 8 AND contains(coalesce(blob, '  '), ' ' || key || ' ') THEN 'substring'
         WHEN key <> '' AND len(string_split(key, ' ')) >= 4 THEN 'run' ELSE 'missing' END AS stage
  FROM {p}sn s LEFT JOIN {p}blob b ON {on("b", "s")}
),
{p}sw AS (
  SELECT {keys}, ord, generate_subscripts(w, 1) AS i, unnest(w) AS word
  FROM (SELECT {keys}, ord, string_split(key, ' ') AS w FROM {p}staged WHERE stage = 'run')
),
{p}tw AS (
  SELECT {keys}, generate_subscripts(w, 1) AS j, unnest(w) AS word FROM (SELECT {keys}, string_split(trim(blob), ' ') AS w FROM {p}blob)
),
{p}hits AS (SELECT {", ".join(f"s.{c}" for c in k)}, s.ord, s.i, t.j - s.i AS d FROM {p}sw s JOIN {p}tw t ON {on("t", "s")} AND t.word = s.word),
{p}islands AS (SELECT {keys}, ord, d, i - row_number() OVER (PARTITION BY {keys}, ord, d ORDER BY i) AS g FROM {p}hits),
{p}runs AS (
  SELECT {keys}, ord, max(n) AS longest FROM (SELECT {keys}, ord, count(*) AS n FROM {p}islands GROUP BY {keys}, ord, d, g) GROUP BY {keys}, ord
),
{p}audited AS (
  SELECT {", ".join(f"s.{c}" for c in k)}, s.ord, s.line, s.normal, s.key,
    CASE WHEN stage <> 'run' THEN stage WHEN coalesce(longest, 0) / n >= 0.8 THEN 'partial' ELSE 'missing' END AS match_type,
    CASE WHEN stage = 'run' THEN coalesce(longest, 0) / n END AS token_coverage
  FROM {p}staged s LEFT JOIN {p}runs r ON {on("r", "s")} AND r.ord = s.ord
)"""


AUDIT = f"{a.LINES_SQL}, {audit_sql('source_lines', 'target_lines', 'pair_id')}"


def _audited(spark, sf):
    return audit.audit_lines(a.source_lines(spark, sf), a.target_lines(spark, sf))


@query(f"WITH {AUDIT} SELECT pair_id, ord, match_type, round(token_coverage, 9) AS token_coverage FROM audited")
def text_audit_lines(spark: SparkSession, sf: str) -> DataFrame:
    """J3-J5."""
    return _audited(spark, sf).select("pair_id", "ord", "match_type", _ratio(F.col("token_coverage")).alias("token_coverage"))


SUMMARY = """
SELECT pair_id, count(*) AS source_lines, count(*) FILTER (match_type = 'exact') AS exact_lines,
  count(*) FILTER (match_type = 'substring') AS substring_lines, count(*) FILTER (match_type = 'partial') AS partial_lines,
  count(*) FILTER (match_type = 'missing') AS missing_lines,
  round(count(*) FILTER (match_type <> 'missing') / count(*), 9) AS coverage,
  CASE WHEN count(*) FILTER (match_type = 'missing') > 0 THEN 'discrepancies' ELSE 'ok' END AS status
FROM audited GROUP BY pair_id"""


@query(f"WITH {AUDIT} {SUMMARY}")
def text_audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A2."""
    return audit.audit_summary(_audited(spark, sf)).withColumn("coverage", _ratio(F.col("coverage")))


@query(
    f"WITH {AUDIT}, summed AS ({SUMMARY}) SELECT d.doc_id AS pair_id, coalesce(missing_lines, 0) AS missing_lines, coalesce(coverage, 1.0) AS coverage, "
    "coalesce(status, 'skipped') AS status, CASE WHEN status IS NULL THEN 'skipped_screening_fail' END AS reason "
    "FROM documents d LEFT JOIN summed s ON s.pair_id = d.doc_id AND d.doc_id % 10 <> 3"
)
def text_audit_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """A3: pairs whose id ends in 3 stand for pairs that failed screening."""
    pairs = a.table(spark, sf, "documents").select(F.col("doc_id").alias("pair_id"))
    found = audit.audit_summary(_audited(spark, sf)).where("pair_id % 10 <> 3")
    told = audit.with_skipped(pairs, found, F.lit("skipped_screening_fail"))
    return told.select("pair_id", "missing_lines", _ratio(F.col("coverage")).alias("coverage"), "status", "reason")


@query(f"WITH {AUDIT} SELECT pair_id, ord, line FROM audited WHERE match_type = 'missing'")
def text_missing(spark: SparkSession, sf: str) -> DataFrame:
    """J6."""
    return audit.missing_lines(_audited(spark, sf)).select("pair_id", "ord", "line")


BENCH = f"""
{a.LINES_SQL},
probe AS (SELECT 1 AS pair_id, item_id AS ord, text AS line FROM benchmark),
held AS (SELECT 1 AS pair_id, doc_id, i, line FROM doc_lines),
pk AS (SELECT ord, {a.key_sql(a.line_sql("line"))} AS key FROM probe),
docs AS (SELECT doc_id, ' ' || coalesce(string_agg(k, ' ' ORDER BY i) FILTER (k <> ''), '') || ' ' AS blob
         FROM (SELECT doc_id, i, {a.key_sql(a.line_sql("line"))} AS k FROM held) GROUP BY doc_id)
"""


@query(f"WITH {BENCH} SELECT p.ord AS item_id, count(*) AS documents, min(doc_id) AS first_doc FROM pk p JOIN docs d ON contains(d.blob, ' ' || p.key || ' ') WHERE length(p.key) >= 8 GROUP BY p.ord")
def benchmark_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """J4 at scale: documents that hold a benchmark passage.

    Passages meet documents by their first words, so a document is not held against every passage.
    """
    first = 4
    head = lambda words: F.array_join(F.slice(words, 1, first), " ")
    keys = a.table(spark, sf, "benchmark").select("item_id", text.key("text").alias("key")).where("length(key) >= 8")
    words = text.tokens(F.col("key"))
    keys = keys.withColumn("head", head(words)).withColumn("size", F.size(words))
    lines = a.doc_lines(spark, sf).withColumn("k", text.key("line"))
    stream = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") != "", F.struct("i", "k")))), lambda s: s["k"]), " ")
    docs = lines.groupBy("doc_id").agg(F.concat(F.lit(" "), stream, F.lit(" ")).alias("blob"))
    w = text.tokens(F.col("blob"))
    heads = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - first + 1)), lambda i: F.array_join(F.slice("w", i, first), " ")))
    places = docs.withColumn("w", w).select("doc_id", F.explode(heads).alias("head"))
    met = places.join(keys.where(f"size >= {first}").select("item_id", "head"), "head").select("doc_id", "item_id")
    short = keys.where(f"size < {first}").select("item_id", "key", F.element_at(F.split("key", " "), 1).alias("word"))
    few = docs.select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("blob")))).alias("word")).join(short, "word").select("doc_id", "item_id")
    pairs = met.unionByName(few).join(keys.select("item_id", "key"), "item_id").join(docs, "doc_id")
    held = pairs.where(F.contains("blob", F.concat(F.lit(" "), F.col("key"), F.lit(" "))))
    return held.groupBy("item_id").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


PROFILES = f"""
{a.LINES_SQL},
sp AS ({a.profiled_sql("source_lines", 4)}), tp AS ({a.profiled_sql("target_lines", 3)} ),
spd AS (SELECT * FROM sp WHERE pair_id % 5 <> 0 OR profile = 'desktop' OR TRUE),
tpd AS (SELECT * FROM tp WHERE NOT (pair_id % 5 = 0 AND profile = 'mobile'))
"""


def _profiles(spark, sf):
    source, target = a.profiled(a.source_lines(spark, sf), 4), a.profiled(a.target_lines(spark, sf), 3)
    return source, target.where("not (pair_id % 5 = 0 and profile = 'mobile')")


UNION = "SELECT pair_id, line, min(rank * 10000000000 + ord) AS ord FROM tpd GROUP BY pair_id, line"
ROLLUP = f"""
{PROFILES},
shared AS (SELECT DISTINCT s.pair_id, s.profile FROM spd s JOIN tpd t ON t.pair_id = s.pair_id AND t.profile = s.profile),
ss AS (SELECT s.* FROM spd s JOIN shared USING (pair_id, profile)),
{audit_sql("ss", "tpd", "pair_id, profile", prefix="x")},
missed AS (
  SELECT pair_id, normal, arg_min(profile, (CASE profile WHEN 'desktop' THEN 0 ELSE 10000000000 END) + ord) AS profile,
    arg_min(line, (CASE profile WHEN 'desktop' THEN 0 ELSE 10000000000 END) + ord) AS line
  FROM xaudited WHERE match_type = 'missing' AND normal <> '' GROUP BY pair_id, normal
),
everywhere AS ({UNION}),
probes AS (SELECT pair_id, row_number() OVER (ORDER BY pair_id, normal) AS ord, line FROM missed),
{audit_sql("probes", "everywhere", "pair_id", prefix="y")}"""


@query(
    f"WITH {ROLLUP} SELECT m.pair_id, CASE WHEN y.match_type = 'missing' THEN 'missing_entirely' ELSE 'viewport_shifted' END AS classification, "
    "m.profile AS missing_under_profile, m.line AS source_line FROM missed m JOIN yaudited y ON y.pair_id = m.pair_id AND y.normal = m.normal"
)
def content_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """J8."""
    return content.rollup(*_profiles(spark, sf))


@query(
    f"WITH {PROFILES} SELECT DISTINCT s.pair_id, s.profile FROM spd s WHERE NOT EXISTS "
    "(SELECT 1 FROM tpd t WHERE t.pair_id = s.pair_id AND t.profile = s.profile)"
)
def source_only_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """J7."""
    return content.shared_profiles(*_profiles(spark, sf))[1]


@query(f"WITH {PROFILES}, u AS ({UNION}) SELECT pair_id, line, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY ord) AS BIGINT) AS place FROM u")
def profile_union(spark: SparkSession, sf: str) -> DataFrame:
    """A4, U2."""
    from pyspark.sql import Window

    found = content.union_of_profiles(_profiles(spark, sf)[1])
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("rank", "ord"))
    return found.select("pair_id", "line", place.cast("long").alias("place"))


IMAGE = "(pair_id * 37 % 101) / 100.0"
SCREEN = f"""
{METRICS},
heights AS (SELECT coalesce(x.pair_id, y.pair_id) AS pair_id, coalesce(sn, 0) AS sh, coalesce(tn, 0) AS th FROM
  (SELECT pair_id, 20 * count(*) AS sn FROM source_lines GROUP BY 1) x FULL JOIN (SELECT pair_id, 20 * count(*) AS tn FROM target_lines GROUP BY 1) y ON x.pair_id = y.pair_id),
scored AS (SELECT m.pair_id, {IMAGE.replace("pair_id", "m.pair_id")} AS image, matched_lines / source_lines AS recall,
  CASE WHEN sh > 0 AND th > 0 THEN sh / th WHEN sh = th THEN 1.0 ELSE 0.0 END AS ratio FROM m JOIN heights h ON h.pair_id = m.pair_id),
flags AS (SELECT *, image >= 0.94 AS i, recall >= 0.96 AS t, ratio BETWEEN 0.85 AND 1.15 AS h, image < 0.35 AS li, recall < 0.25 AS lt,
  ratio > 0 AND (ratio < 0.5 OR ratio > 2.0) AS bh FROM scored),
screened AS (SELECT *, CASE WHEN i AND t AND h THEN 'pass' WHEN CAST(li AS INT) + CAST(lt AS INT) + CAST(bh AS INT) >= 2 THEN 'fail' ELSE 'needs_ai' END AS verdict FROM flags)
"""
REASONS = """
CASE verdict WHEN 'pass' THEN 'pass_all_signals'
  WHEN 'fail' THEN concat_ws(',', CASE WHEN li THEN 'extreme_low_image' END, CASE WHEN lt THEN 'extreme_low_text_recall' END, CASE WHEN bh THEN 'extreme_height_mismatch' END)
  ELSE concat_ws(',', CASE WHEN NOT i THEN 'image_below_pass' END, CASE WHEN NOT t THEN 'text_below_pass' END, CASE WHEN NOT h THEN 'height_outside_pass_band' END) END"""


def _screened(spark, sf):
    scores = _metrics(spark, sf).where("source_lines > 0")
    heights = [f(spark, sf).groupBy("pair_id").agg((20 * F.count("*")).alias(n)) for f, n in ((a.source_lines, "sh"), (a.target_lines, "th"))]
    both = scores.join(heights[0].join(heights[1], "pair_id", "full"), "pair_id")
    image, ratio = (F.col("pair_id") * 37 % 101) / F.lit(100.0), screening.height_ratio(F.col("sh"), F.col("th"))
    found = both.withColumns({"image": image, "ratio": ratio})
    return found.withColumn("s", screening.verdict(F.col("image"), F.col("recall"), F.col("ratio")))


@query(f"WITH {a.LINES_SQL}, {SCREEN} SELECT pair_id, verdict, verdict = 'fail' AS skip_ai, {REASONS} AS reasons FROM screened")
def screening_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """G1."""
    return _screened(spark, sf).select("pair_id", "s.verdict", "s.skip_ai", F.array_join("s.reasons", ",").alias("reasons"))


@query(
    f"WITH {a.LINES_SQL}, {SCREEN} SELECT pair_id // 4 AS run_id, CASE max(CASE verdict WHEN 'fail' THEN 3 WHEN 'needs_ai' THEN 2 ELSE 1 END) "
    "WHEN 3 THEN 'fail' WHEN 2 THEN 'needs_ai' ELSE 'pass' END AS aggregate_verdict FROM screened GROUP BY 1"
)
def aggregate_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Four pairs stand for the profiles of one."""
    found = _screened(spark, sf).select(F.floor(F.col("pair_id") / 4).cast("long").alias("run_id"), "s.verdict")
    return screening.worst(found, "run_id")


@query(
    f"WITH {a.LINES_SQL}, {SCREEN}, w AS (SELECT pair_id // 4 AS run_id, max(CASE verdict WHEN 'fail' THEN 3 WHEN 'needs_ai' THEN 2 ELSE 1 END) AS r FROM screened GROUP BY 1) "
    "SELECT run_id, CAST(pair_id % 4 AS BIGINT) AS profile, verdict, round(recall, 9) AS text_recall, round(ratio, 9) AS height_ratio, "
    "CASE r WHEN 3 THEN 'fail' WHEN 2 THEN 'needs_ai' ELSE 'pass' END AS aggregate_verdict FROM screened s JOIN w ON w.run_id = s.pair_id // 4"
)
def screening_by_profile(spark: SparkSession, sf: str) -> DataFrame:
    """S22."""
    found = _screened(spark, sf).select(
        F.floor(F.col("pair_id") / 4).cast("long").alias("run_id"), (F.col("pair_id") % 4).alias("profile"), "s.verdict",
        _ratio(F.col("recall")).alias("text_recall"), _ratio(F.col("ratio")).alias("height_ratio"),
    )
    return found.join(screening.worst(found, "run_id"), "run_id")


@query(
    f"WITH {AUDIT}, {SCREEN}, summed AS ({SUMMARY}), joined AS (SELECT s.pair_id AS idx, verdict, missing_lines AS missing_entirely, coverage "
    "FROM screened s JOIN summed USING (pair_id)) SELECT idx, verdict, missing_entirely, coverage, row_number() OVER (ORDER BY "
    "CASE verdict WHEN 'fail' THEN 3 WHEN 'needs_ai' THEN 2 ELSE 1 END DESC, missing_entirely DESC, coverage, idx) AS place FROM joined"
)
def triage_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs in order of review."""
    summed = audit.audit_summary(_audited(spark, sf)).select("pair_id", F.col("missing_lines").alias("missing_entirely"), _ratio(F.col("coverage")).alias("coverage"))
    verdicts = _screened(spark, sf).select("pair_id", "s.verdict").join(summed, "pair_id").withColumnRenamed("pair_id", "idx")
    return report.triage(verdicts).withColumn("place", F.col("place").cast("long"))


@query(
    f"WITH {a.LINES_SQL}, lines AS (SELECT pair_id, list({a.crawl_key_sql('line')} ORDER BY ord) AS k, string_agg(line, chr(10) ORDER BY ord) AS t FROM source_lines GROUP BY 1) "
    "SELECT pair_id, substring(sha256(t), 1, 16) AS dom_signature, sha1(array_to_string(list_sort(k), chr(10))) AS state_signature FROM lines"
)
def dom_signature(spark: SparkSession, sf: str) -> DataFrame:
    """A11."""
    docs = a.table(spark, sf, "documents").select(F.col("doc_id").alias("pair_id"), F.split("text", "\n").alias("lines"))
    return docs.select("pair_id", text.dom_signature(F.col("lines")).alias("dom_signature"), text.state_signature(F.transform("lines", text.crawl_key)).alias("state_signature"))


@query("SELECT page_id, printf('pair-%04d-%s', page_id, substring(sha256(url || '|' || replace(url, 'http://', 'https://')), 1, 10)) AS slug FROM pages")
def pair_slug(spark: SparkSession, sf: str) -> DataFrame:
    """P28."""
    secure = F.replace("url", F.lit("http://"), F.lit("https://"))
    return a.table(spark, sf, "pages").select("page_id", text.slug(F.col("page_id"), F.col("url"), secure).alias("slug"))


@query(
    f"WITH {a.LINES_SQL} SELECT pair_id, ord, CASE WHEN regexp_matches(line, '[\",\\n\\r]') THEN '\"' || replace(line, '\"', '\"\"') || '\"' ELSE line END AS field FROM source_lines"
)
def csv_escape(spark: SparkSession, sf: str) -> DataFrame:
    """S24."""
    return a.source_lines(spark, sf).select("pair_id", "ord", text.csv_field(F.col("line")).alias("field"))
