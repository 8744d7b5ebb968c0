"""SQL for the operators that SQL can express."""

#: Common tables: ``crc_table`` holds the 256 entries of CRC-32 in one list, made from its rule.
CRC = """
crc_steps(n, c, k) AS (
  SELECT CAST(n AS BIGINT), CAST(n AS BIGINT), 0 FROM range(256) AS r(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY n) AS l FROM crc_steps WHERE k = 8)
"""


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, where ``crc_table`` is among the tables of the query."""
    bytes_ = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: CAST(('0x' || substr(hex(encode({text})), i, 2)) AS BIGINT))"
    return f"xor(4294967295, list_reduce({bytes_}, lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1]), 4294967295))"


OP11 = f"""
WITH RECURSIVE {CRC},
c AS (
  SELECT change_id, client_id, op, valid_at, CAST(CASE WHEN abs(balance) < 9e16 THEN floor(100 * balance + 0.5) END AS BIGINT) AS balance_cents,
    CAST(greatest(0, least(11, floor((date_diff('day', DATE '1970-01-01', CAST(valid_at AS DATE)) + coalesce({crc32("CAST(change_id AS VARCHAR)")} % 4, 0) - 19723) * 12 / 152))) AS BIGINT) AS batch
  FROM (SELECT DISTINCT * FROM client_changes WHERE valid_at IS NOT NULL), crc_table
),
s AS (
  SELECT sale_id, client_id, sold_at, row_number() OVER () AS n,
    CAST(greatest(0, least(11, floor((date_diff('day', DATE '1970-01-01', CAST(arrived_at AS DATE)) - 19723) * 12 / 152))) AS BIGINT) AS batch
  FROM sales
),
h AS (
  SELECT b, (SELECT max(sold_at) FROM s WHERE batch < b) AS sold, (SELECT max(valid_at) FROM c WHERE batch < b) AS valid FROM range(0, 12) AS r(b)
),
horizon AS (SELECT b, valid AS late_before, CASE WHEN sold IS NOT NULL AND valid IS NOT NULL THEN least(sold, valid) END AS horizon FROM h),
judged AS (SELECT c.*, coalesce(valid_at < late_before, false) AS late FROM c JOIN horizon ON b = batch),
version AS (SELECT * FROM judged WHERE NOT late AND client_id IS NOT NULL),
emitted AS (
  SELECT s.*, coalesce((SELECT min(b) FROM horizon WHERE b >= s.batch AND (s.sold_at IS NULL OR s.sold_at < horizon)), 12) AS e FROM s
),
old AS (
  SELECT v.*, e, v.batch < e AND v.valid_at <= horizon AS below
  FROM version v JOIN (SELECT b + 1 AS e, horizon FROM horizon UNION ALL SELECT 0, NULL) ON v.batch <= e
),
held AS (
  SELECT * FROM old
  QUALIFY NOT coalesce(below, false) OR row_number() OVER (PARTITION BY e, client_id, coalesce(below, false) ORDER BY valid_at DESC, change_id DESC NULLS LAST) = 1
),
many AS (SELECT e, client_id, count(*) AS n FROM held GROUP BY ALL),
last AS (
  SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY e, client_id, valid_at ORDER BY change_id DESC NULLS LAST) = 1
),
joined AS (
  SELECT x.sale_id, x.e, x.client_id, last.change_id, last.balance_cents, last.op
  FROM emitted x ASOF LEFT JOIN last ON x.client_id = last.client_id AND x.e = last.e AND x.sold_at >= last.valid_at
)
SELECT 'late' AS rec, change_id AS id, batch, CAST(NULL AS BIGINT) AS n_held, CAST(NULL AS BIGINT) AS change_id, CAST(NULL AS BIGINT) AS balance_cents, CAST(NULL AS VARCHAR) AS op
FROM judged WHERE late
UNION ALL
SELECT 'sale', sale_id, joined.e, coalesce(n, 0), change_id, balance_cents, op FROM joined LEFT JOIN many ON many.e = joined.e AND many.client_id = joined.client_id
"""

#: Words of documents and benchmark; a row of documents is told from others by its number.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12 = f"""
WITH RECURSIVE {CRC},
d AS (SELECT doc_id, row_number() OVER () AS n, {_WORDS} AS words FROM documents),
w AS (SELECT n, unnest(words) AS w FROM d),
b AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
bucket AS (SELECT w, {crc32("w")} % 10000 AS k FROM (SELECT w FROM w UNION SELECT w FROM b), crc_table),
source AS (SELECT k, count(*) AS s FROM w JOIN bucket USING (w) GROUP BY k),
target AS (SELECT k, count(*) AS t FROM b JOIN bucket USING (w) GROUP BY k),
totals AS (SELECT (SELECT count(*) FROM w) AS all_s, (SELECT count(*) FROM b) AS all_t),
gain AS (
  SELECT k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000)))) AS BIGINT) AS gain
  FROM source LEFT JOIN target USING (k), totals
),
weighed AS (SELECT n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM w JOIN bucket USING (w) JOIN gain USING (k) GROUP BY n),
scored AS (
  SELECT doc_id, n, len(words) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed USING (n)
),
ranked AS (
  SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n) AS rank, count(*) OVER () AS eligible FROM scored WHERE n_features >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 10 * eligible // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (n)
"""
