"""DuckDB SQL texts giving the expected result of each named query.

They are written independently of the Spark code: plain SQL over the driver
tables (``dirty_orders`` is re-derived in a CTE from the same text), with the
same output names, 6-decimal rounding of doubles and ISO timestamp text.
"""

from __future__ import annotations

from scrubspark.functions.text import DATE_HINT_PATTERN
from scrubspark.sources.tables import DIRTY_ORDERS_SQL

DIRTY = f"dirty_orders AS ({DIRTY_ORDERS_SQL})"
DIRTY_COLS = ["o_orderkey", "priority_text", "date_text", "price_text", "price", "cust_num", "order_ts"]
DIRTY_TYPES = ["bigint", "string", "string", "string", "double", "double", "timestamp_ntz"]
TEXT_COLS = ["priority_text", "date_text", "price_text"]


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def num(x: str) -> str:
    t = f"regexp_replace(regexp_replace({strip(x)}, '^\\((.*)\\)$', '-\\1'), '[$€£¥,\\s%]', '', 'g')"
    return (
        f"(CASE WHEN regexp_full_match({t}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') "
        f"THEN TRY_CAST({t} AS DOUBLE) END)"
    )


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"


def r6(x: str) -> str:
    # "+ 0.0" folds -0.0 into 0.0, as Spark's decimal rounding does
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


HINT = DATE_HINT_PATTERN.replace("'", "''")

# stripped -> dedup -> converted -> cleaned chain over dirty_orders
CHAIN = f"""{DIRTY},
stripped AS (SELECT o_orderkey, {strip('priority_text')} AS priority_text, {strip('date_text')} AS date_text,
             {strip('price_text')} AS price_text, price, cust_num, order_ts FROM dirty_orders),
dedup AS (SELECT DISTINCT * FROM stripped),
conv AS (SELECT o_orderkey, priority_text, try_strptime(date_text, '%Y-%m-%d') AS date_text,
         {num('price_text')} AS price_text, price, cust_num, order_ts FROM dedup),
med AS (SELECT quantile_cont(price_text, 0.5) AS m_price_text, quantile_cont(price, 0.5) AS m_price,
        quantile_cont(cust_num, 0.5) AS m_cust_num FROM conv),
cleaned AS (SELECT o_orderkey, coalesce(priority_text, 'Unknown') AS priority_text, date_text,
            coalesce(price_text, m_price_text) AS price_text, coalesce(price, m_price) AS price,
            coalesce(cust_num, m_cust_num) AS cust_num, order_ts FROM conv, med)"""


def canon_dirty(src: str, date_is_ts: bool = False) -> str:
    d = iso("date_text") if date_is_ts else "date_text"
    return (
        f"SELECT o_orderkey, priority_text, {d} AS date_text, "
        + (f"{r6('price_text')} AS price_text, " if src in ("conv", "cleaned") else "price_text, ")
        + f"{r6('price')} AS price, {r6('cust_num')} AS cust_num, {iso('order_ts')} AS order_ts FROM {src}"
    )


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# ----------------------------------------------------------------------------- numeric statistics helpers


def quart_cte(table: str, cols: list[str], name: str = "qs") -> str:
    sel = ", ".join(
        f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1_{c}, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3_{c}"
        for c in cols
    )
    return f"{name} AS (SELECT {sel} FROM {table})"


def outlier_expr(c: str) -> str:
    iqr = f"(q3_{c} - q1_{c})"
    return (
        f"count(*) FILTER (WHERE {iqr} <> 0 AND (CAST({c} AS DOUBLE) < q1_{c} - 1.5 * {iqr} "
        f"OR CAST({c} AS DOUBLE) > q3_{c} + 1.5 * {iqr}))"
    )


def outliers_cte(table: str, cols: list[str], name: str = "oc") -> str:
    sel = ", ".join(f"CAST({outlier_expr(c)} AS BIGINT) AS o_{c}" for c in cols)
    return f"{name} AS (SELECT count(*) AS n_rows, {sel} FROM {table}, qs)"


def describe_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"""SELECT '{c}' AS "column", CAST(count({x}) AS BIGINT) AS count, {r6(f'avg({x})')} AS mean,
  {r6(f'quantile_cont({x}, 0.5)')} AS median,
  {r6(f'CASE WHEN count({x}) > 1 THEN stddev_samp({x}) ELSE 0 END')} AS std,
  {r6(f'min({x})')} AS min, {r6(f'max({x})')} AS max,
  {r6(f'quantile_cont({x}, 0.25)')} AS percentile_25, {r6(f'quantile_cont({x}, 0.75)')} AS percentile_75,
  {r6(f'CASE WHEN count({x}) > 2 AND var_samp({x}) > 0 THEN skewness({x}) ELSE 0 END')} AS skewness,
  {r6(f'CASE WHEN count({x}) > 3 AND var_samp({x}) > 0 THEN kurtosis({x}) ELSE 0 END')} AS kurtosis,
  (SELECT o_{c} FROM oc) AS outlier_count,
  {r6(f'(SELECT o_{c} FROM oc) / count(*) * 100')} AS outlier_percentage
FROM {table}"""
        )
    return f"WITH {quart_cte(table, cols)}, {outliers_cte(table, cols)}\n" + union(parts)


def bins_ctes(table: str, cols: list[str], integral: set[str]) -> str:
    """CTEs: spec (per column auto-bin parameters), binned (column, bin, v)."""
    specs = []
    binned = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        is_int = "TRUE" if c in integral else "FALSE"
        specs.append(
            f"""SELECT '{c}' AS col, count({x}) AS n, min({x}) AS mn, max({x}) AS mx,
  quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3, {is_int} AS is_int FROM {table}"""
        )
        binned.append(f"SELECT '{c}' AS col, {x} AS v FROM {table} WHERE {c} IS NOT NULL")
    return f"""raw_spec AS ({union(specs)}),
spec0 AS (SELECT *, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS first,
  CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS last, mx - mn AS ptp FROM raw_spec WHERE n > 0),
spec1 AS (SELECT *, ptp / sqrt(n) AS sqrt_bw, ptp / (log2(n) + 1.0) AS sturges_bw,
  2.0 * (q3 - q1) * pow(n, -1.0 / 3.0) AS fd_bw FROM spec0),
spec2 AS (SELECT *, CASE WHEN greatest(fd_bw, sqrt_bw / 2) <> 0 THEN least(greatest(fd_bw, sqrt_bw / 2), sturges_bw)
  ELSE sturges_bw END AS w0 FROM spec1),
spec3 AS (SELECT *, CASE WHEN is_int AND w0 <> 0 AND w0 < 1 THEN 1.0 ELSE w0 END AS width FROM spec2),
spec AS (SELECT col, n, first, last, CAST(CASE WHEN width <> 0 THEN greatest(ceil((last - first) / width), 1) ELSE 1 END AS INTEGER) AS k
  FROM spec3),
spec_s AS (SELECT *, (last - first) / k AS step FROM spec),
vals AS ({union(binned)}),
g AS (SELECT col, v, first, last, k, step,
  least(greatest(CAST(floor((v - first) / (last - first) * k) AS INTEGER), 0), k - 1) AS g1 FROM vals JOIN spec_s USING (col)),
g2 AS (SELECT *, CASE WHEN v < (CASE WHEN g1 >= k THEN last ELSE g1 * step + first END) THEN g1 - 1 ELSE g1 END AS gb FROM g),
binned AS (SELECT col, v, k, CASE WHEN v >= (CASE WHEN gb + 1 >= k THEN last ELSE (gb + 1) * step + first END) AND gb <> k - 1
  THEN gb + 2 ELSE gb + 1 END AS bin FROM g2),
allbins AS (SELECT col, first, last, k, step, CAST(unnest(range(1, k + 1)) AS INTEGER) AS bin FROM spec_s),
hist AS (SELECT a.col, a.bin, a.k, a.first, a.last, a.step, coalesce(b.cnt, 0) AS cnt FROM allbins a
  LEFT JOIN (SELECT col, bin, count(*) AS cnt FROM binned GROUP BY col, bin) b USING (col, bin))"""


def bimodal_ctes(table: str, cols: list[str], integral: set[str]) -> str:
    distinct = union([f"SELECT '{c}' AS col, count(DISTINCT {c}) AS u FROM {table}" for c in cols])
    return (
        bins_ctes(table, cols, integral)
        + f""",
peaks AS (SELECT col, count(*) FILTER (WHERE bin > 1 AND bin < k AND cnt > prv AND cnt > nxt AND cnt >= 0.2 * mc) AS p
  FROM (SELECT col, bin, k, cnt, lag(cnt) OVER (PARTITION BY col ORDER BY bin) AS prv,
        lead(cnt) OVER (PARTITION BY col ORDER BY bin) AS nxt, max(cnt) OVER (PARTITION BY col) AS mc FROM hist) z
  GROUP BY col),
dist AS ({distinct}),
bimodal AS (SELECT s.col, (s.n >= 30 AND d.u >= 5 AND s.k >= 5 AND coalesce(p.p, 0) >= 2) AS bimodal
  FROM spec s JOIN dist d USING (col) LEFT JOIN peaks p USING (col))"""
    )


def shape_sql(table: str, cols: list[str], integral: set[str]) -> str:
    sk = union(
        [
            f"SELECT '{c}' AS col, CASE WHEN count({c}) > 2 AND var_samp(CAST({c} AS DOUBLE)) > 0 "
            f"THEN skewness(CAST({c} AS DOUBLE)) ELSE 0 END AS s FROM {table}"
            for c in cols
        ]
    )
    return f"""WITH {bimodal_ctes(table, cols, integral)},
sk AS ({sk})
SELECT sk.col AS "column",
  CASE WHEN b.bimodal THEN 'bimodal' WHEN sk.s > 0.5 THEN 'right-skewed' WHEN sk.s < -0.5 THEN 'left-skewed'
       ELSE 'normal' END AS classification,
  {r6('sk.s')} AS skewness, (sk.s > 1 OR sk.s < -1) AS high_skew
FROM sk JOIN bimodal b USING (col)"""


# ----------------------------------------------------------------------------- correlation helpers

LINEITEM_NUM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


def pairs_cte(table: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i < j:
                parts.append(
                    f"SELECT {i} AS i, {j} AS j, '{a}' AS column_a, '{b}' AS column_b, "
                    f"CASE WHEN stddev_samp(CAST({a} AS DOUBLE)) FILTER (WHERE {b} IS NOT NULL) > 0 "
                    f"AND stddev_samp(CAST({b} AS DOUBLE)) FILTER (WHERE {a} IS NOT NULL) > 0 "
                    f"THEN corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) END AS r FROM {table}"
                )
    return f"pairs AS ({union(parts)})"


def matrix_sql(table: str, cols: list[str], digits: int | None = None) -> str:
    diag = union(
        [
            f"SELECT {i} AS i, {i} AS j, '{c}' AS column_a, '{c}' AS column_b, "
            f"CASE WHEN var_samp(CAST({c} AS DOUBLE)) > 0 THEN 1.0 END AS r FROM {table}"
            for i, c in enumerate(cols)
        ]
    )
    rr = "r" if digits is None else f"round(r, {digits})"
    return f"""WITH {pairs_cte(table, cols)},
full_m AS (SELECT column_a, column_b, r FROM pairs UNION ALL SELECT column_b, column_a, r FROM pairs
           UNION ALL SELECT column_a, column_b, r FROM ({diag}))
SELECT column_a, column_b, {r6(rr)} AS r FROM full_m"""


def corr_top_sql(table: str, cols: list[str]) -> str:
    return f"""WITH {pairs_cte(table, cols)}
SELECT direction, CAST(rank AS INTEGER) AS rank, column_a, column_b, {r6('r')} AS r FROM (
  SELECT 'positive' AS direction, row_number() OVER (ORDER BY r DESC, i, j) AS rank, column_a, column_b, r
  FROM pairs WHERE r > 0
  UNION ALL
  SELECT 'negative', row_number() OVER (ORDER BY r ASC, i, j), column_a, column_b, r FROM pairs WHERE r < 0
) z WHERE rank <= 5"""


# ----------------------------------------------------------------------------- categorical helpers


def freq_cte(table: str, cols: list[str]) -> str:
    parts = [f"SELECT {i} AS pos, '{c}' AS col, coalesce({c}, 'Unknown') AS value FROM {table}" for i, c in enumerate(cols)]
    return f"freq AS (SELECT pos, col, value, count(*) AS cnt FROM ({union(parts)}) z GROUP BY pos, col, value)"


def top_sql(table: str, cols: list[str], k: int = 10) -> str:
    return f"""WITH {freq_cte(table, cols)}, t AS (SELECT count(*) AS n FROM {table})
SELECT col AS "column", CAST(rank AS INTEGER) AS rank, value, CAST(cnt AS BIGINT) AS count,
  {r6('cnt / n * 100')} AS percentage
FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY cnt DESC, value) AS rank FROM freq) z, t
WHERE rank <= {k}"""


# ----------------------------------------------------------------------------- the texts

ORDERS_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
ORDERS_INT = {"o_orderkey", "o_custkey"}


def _profile_columns() -> str:
    parts = []
    for i, (c, t) in enumerate(zip(DIRTY_COLS, DIRTY_TYPES)):
        parts.append(
            f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column", '{t}' AS dtype,
  CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count,
  {r6(f'round(CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / count(*) * 100, 2)')} AS null_percentage,
  CAST(count(DISTINCT {c}) AS BIGINT) AS unique_count FROM dirty_orders"""
        )
    return f"WITH {DIRTY}\n" + union(parts)


def _profile_samples() -> str:
    cols = [
        ("o_orderkey", "CAST(o_orderkey AS VARCHAR)"),
        ("o_custkey", "CAST(o_custkey AS VARCHAR)"),
        ("o_orderstatus", "o_orderstatus"),
        ("o_totalprice", "CAST(o_totalprice AS VARCHAR)"),
        ("o_orderdate", "CAST(o_orderdate AS VARCHAR)"),
        ("o_orderpriority", "o_orderpriority"),
    ]
    parts = [f"SELECT '{c}' AS col, o_orderkey AS k, {e} AS value FROM orders" for c, e in cols]
    return f"""SELECT col AS "column", CAST(ord AS INTEGER) AS ord, value FROM (
  SELECT col, value, row_number() OVER (PARTITION BY col ORDER BY k) AS ord FROM ({union(parts)}) l
  WHERE value IS NOT NULL) r WHERE ord <= 3"""


def _dups(src: str) -> str:
    cols = ", ".join(DIRTY_COLS)
    return f"(SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM {src} GROUP BY {cols}) g)"


def _ratio_rows(src: str, cols: list[str], kind: str) -> str:
    parts = []
    for c in cols:
        if kind == "hint":
            hit = f"count(*) FILTER (WHERE regexp_matches({strip(c)}, '{HINT}', 'i'))"
        else:
            hit = f"count({num(c)})"
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(count({c}) AS BIGINT) AS non_null, CAST({hit} AS BIGINT) AS hit, "
            f"{r6(f'CASE WHEN count({c}) > 0 THEN CAST({hit} AS DOUBLE) / count({c}) ELSE 0 END')} AS ratio FROM {src}"
        )
    return union(parts)


CLEAN_NUM = ["o_orderkey", "price_text", "price", "cust_num"]


def _quality_score() -> str:
    return f"""WITH {CHAIN},
{quart_cte('cleaned', CLEAN_NUM)}, {outliers_cte('cleaned', CLEAN_NUM)},
pre AS (SELECT count(*) AS rows_before, 7 AS total_columns,
  ({' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in DIRTY_COLS)}) AS missing FROM dirty_orders),
dup AS (SELECT {_dups('stripped')} AS d),
outl AS (SELECT CAST({' + '.join(f'o_{c}' for c in CLEAN_NUM)} AS DOUBLE) / (n_rows * {len(CLEAN_NUM)}) * 100 AS pct FROM oc),
hc AS (SELECT CAST(count(DISTINCT priority_text) > 0.5 * count(*) AS INTEGER) AS h FROM cleaned),
f AS (SELECT CAST(missing AS DOUBLE) / (rows_before * total_columns) * 100 AS m,
  CAST(d AS DOUBLE) / rows_before * 100 AS dp, pct AS op, h, (SELECT count(*) FROM ({_conversions()}) cv) AS conv, total_columns FROM pre, dup, outl, hc)
SELECT CAST(round_even(greatest(0, least(100, 100 - (least(35, m * 0.7) + least(25, dp * 1.2) + least(20, op * 1.5)
  + least(10, h / 1 * 10) + least(5, CAST(conv AS DOUBLE) / total_columns * 5)))), 0) AS INTEGER) AS score,
  {r6('round_even(m, 2)')} AS missing_cell_percentage, {r6('round_even(dp, 2)')} AS duplicate_row_percentage,
  {r6('round_even(op, 2)')} AS outlier_percentage, CAST(h AS BIGINT) AS high_cardinality_columns,
  CAST(conv AS BIGINT) AS type_conversions FROM f"""


def _change_rows() -> str:
    return f"""WITH {CHAIN},
st AS (SELECT count(*) FILTER (WHERE priority_text <> {strip('priority_text')}) AS s_p FROM dirty_orders),
nl AS (SELECT count(*) FILTER (WHERE priority_text IS NULL) AS n_p, count(*) FILTER (WHERE price_text IS NULL) AS n_pt,
  count(*) FILTER (WHERE price IS NULL) AS n_pr, count(*) FILTER (WHERE cust_num IS NULL) AS n_c FROM conv)"""


def _history_base() -> str:
    return """reports AS (SELECT CAST(doc_id AS VARCHAR) AS id, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at,
  source AS client_id, printf('cleaned/%s_report_%s.csv', lang, CAST(doc_id AS VARCHAR)) AS dataset_path,
  '{"executive_summary":"' || printf('Report in %s over %s characters', lang, CAST(n_chars AS VARCHAR)) ||
  '","data_quality_assessment":{"score":' || CAST(n_chars % 101 AS VARCHAR) || '}}' AS ai_report,
  '{"dataset_overview":{"total_rows":' || CAST(n_chars AS VARCHAR) || '}}' AS analysis_results, lang, n_chars, doc_id
  FROM documents)"""


def _fetch(report_id: str, client: str) -> str:
    return f"""WITH {_history_base()}
SELECT id AS report_id, {iso('created_at')} AS created_at, dataset_path, ai_report, analysis_results
FROM reports WHERE id = '{report_id}' AND client_id = '{client}'"""


def _storage_names() -> str:
    path = "url_decode(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1))"
    sp = f"regexp_replace(CASE WHEN regexp_matches(url, '^https?://') THEN {path} ELSE url END, '^/+', '')"
    return f"""WITH a AS (SELECT url, {sp} AS storage_path FROM pages),
b AS (SELECT url, storage_path, CASE WHEN regexp_extract(storage_path, '([^/]*)$', 1) = '' THEN 'dataset.csv'
  ELSE regexp_extract(storage_path, '([^/]*)$', 1) END AS filename FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(lower(trim(CASE WHEN contains(filename, '.')
  THEN regexp_extract(filename, '^(.*)\\.[^.]*$', 1) ELSE filename END)), '\\s+', '_', 'g'), '[^a-z0-9_-]', '', 'g') AS s FROM b)
SELECT url, storage_path, filename, CASE WHEN s = '' THEN 'dataset' ELSE s END AS safe_stem FROM c"""


def _normalize_headers() -> str:
    n = f"lower({strip('p_type')})"
    n = f"regexp_replace({n}, '\\s+', '_', 'g')"
    n = f"regexp_replace({n}, '[^a-z0-9_]', '', 'g')"
    n = f"regexp_replace({n}, '_+', '_', 'g')"
    n = f"regexp_replace({n}, '^_+|_+$', '', 'g')"
    return f"""WITH b AS (SELECT p_partkey, p_type, {n} AS n FROM part),
c AS (SELECT p_partkey, p_type, CASE WHEN n = '' THEN 'column_' || CAST(p_partkey AS VARCHAR) ELSE n END AS base FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM c)
SELECT CAST(p_partkey AS BIGINT) AS position, p_type AS name,
  CASE WHEN k = 1 THEN base ELSE base || '_' || CAST(k AS VARCHAR) END AS normalized FROM d"""


def _histogram(table, cols, integral) -> str:
    return f"""WITH {bins_ctes(table, cols, integral)}
SELECT col AS "column", bin, {r6('(bin - 1) * step + first')} AS lo,
  {r6('CASE WHEN bin = k THEN last ELSE bin * step + first END')} AS hi, CAST(cnt AS BIGINT) AS count FROM hist"""


def _box_data() -> str:
    cols = ["event_id", "user_id", "value"]
    fence = {
        c: (f"(q1_{c} - 1.5 * (q3_{c} - q1_{c}))", f"(q3_{c} + 1.5 * (q3_{c} - q1_{c}))") for c in cols
    }
    parts = []
    for i, c in enumerate(cols):
        x = f"CAST({c} AS DOUBLE)"
        lo, hi = fence[c]
        parts.append(
            f"""SELECT {i} AS pos, '{c}' AS "column", {r6(f'quantile_cont({x}, 0.25)')} AS q1,
  {r6(f'quantile_cont({x}, 0.5)')} AS median, {r6(f'quantile_cont({x}, 0.75)')} AS q3,
  {r6(f'min({x}) FILTER (WHERE {x} >= {lo})')} AS whisker_lo, {r6(f'max({x}) FILTER (WHERE {x} <= {hi})')} AS whisker_hi,
  (SELECT o_{c} FROM oc) AS fliers FROM events, qs"""
        )
    return f"""WITH {quart_cte('events', cols)}, {outliers_cte('events', cols)},
b AS ({union(parts)})
SELECT "column", q1, median, q3, whisker_lo, whisker_hi, fliers FROM (
  SELECT *, row_number() OVER (ORDER BY pos) AS rk FROM b WHERE fliers > 0) z WHERE rk <= 3"""


def _monthly() -> str:
    return """SELECT strftime(o_orderdate, '%Y-%m') AS period, avg(o_totalprice) AS value FROM orders
  WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1"""


def _overview() -> str:
    tot = " + ".join(f"o_{c}" for c in ORDERS_NUM)
    return f"""WITH {quart_cte('orders', ORDERS_NUM)}, {outliers_cte('orders', ORDERS_NUM)}
SELECT CAST(n_rows AS BIGINT) AS total_rows, k.*, CAST({tot} AS BIGINT) AS total_outliers_detected,
  {r6(f'CAST({tot} AS DOUBLE) / (n_rows * numeric_columns_count) * 100')} AS overall_outlier_percentage
FROM oc, (SELECT count(*) AS total_columns, count(*) FILTER (kind = 'n') AS numeric_columns_count,
    count(*) FILTER (kind = 'c') AS categorical_columns_count, count(*) FILTER (kind = 'd') AS datetime_columns_detected,
    string_agg(name, ', ' ORDER BY pos) FILTER (kind = 'n') AS numeric_columns,
    string_agg(name, ', ' ORDER BY pos) FILTER (kind = 'c') AS categorical_columns,
    string_agg(name, ', ' ORDER BY pos) FILTER (kind = 'd') AS datetime_columns
  FROM (SELECT row_number() OVER () AS pos, column_name AS name, CASE WHEN column_type = 'VARCHAR' THEN 'c'
      WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'd' ELSE 'n' END AS kind FROM (DESCRIBE orders)) t) k"""


def _outlier_ranking() -> str:
    cols = ["doc_id", "n_chars"]
    parts = [f"SELECT {i} AS pos, '{c}' AS col, o_{c} AS oc, n_rows FROM oc" for i, c in enumerate(cols)]
    return f"""WITH {quart_cte('documents', cols)}, {outliers_cte('documents', cols)}
SELECT CAST(row_number() OVER (ORDER BY oc DESC, pos) AS INTEGER) AS rank, col AS "column",
  CAST(oc AS BIGINT) AS outlier_count, {r6('oc / n_rows * 100')} AS outlier_percentage FROM ({union(parts)}) z"""


def _flag_outliers() -> str:
    cols = ["doc_id", "n_chars"]
    flags = ", ".join(
        f"coalesce((q3_{c} - q1_{c}) <> 0 AND (CAST({c} AS DOUBLE) < q1_{c} - 1.5 * (q3_{c} - q1_{c}) "
        f"OR CAST({c} AS DOUBLE) > q3_{c} + 1.5 * (q3_{c} - q1_{c})), FALSE) AS {c}_is_outlier"
        for c in cols
    )
    return f"WITH {quart_cte('documents', cols)} SELECT doc_id, {flags} FROM documents, qs"


def _cardinality() -> str:
    cols = ["c_name", "c_mktsegment"]
    return f"""WITH {freq_cte('customer', cols)}, t AS (SELECT count(*) AS n FROM customer)
SELECT col AS "column", CAST(count(*) AS BIGINT) AS unique_count, CAST(any_value(n) AS BIGINT) AS total_rows,
  {r6('count(*) / any_value(n)')} AS unique_ratio, count(*) > 0.5 * any_value(n) AS high_cardinality
FROM freq, t GROUP BY col"""


def _top_variance(table, cols, k) -> str:
    parts = [f"SELECT {i} AS pos, '{c}' AS col, var_samp(CAST({c} AS DOUBLE)) AS v FROM {table}" for i, c in enumerate(cols)]
    return f"""SELECT CAST(rank AS INTEGER) AS rank, col AS "column", {r6('v')} AS variance FROM (
  SELECT *, row_number() OVER (ORDER BY v DESC NULLS LAST, pos) AS rank FROM ({union(parts)}) z) y WHERE rank <= {k}"""


def _trend() -> str:
    return f"""WITH m AS ({_monthly()}),
i AS (SELECT value, CAST(row_number() OVER (ORDER BY period) - 1 AS DOUBLE) AS x FROM m),
a AS (SELECT count(*) AS months, regr_slope(value, x) AS slope, avg(value) AS mean FROM i)
SELECT 'o_orderdate' AS date_column, 'o_totalprice' AS value_column, months > 0 AS detected, CAST(months AS BIGINT) AS months,
  CASE WHEN months < 2 THEN 'flat' WHEN slope > greatest(abs(mean), 1) * 0.01 THEN 'increasing'
       WHEN slope < greatest(abs(mean), 1) * -0.01 THEN 'decreasing' ELSE 'flat' END AS trend_direction,
  {r6('CASE WHEN months >= 2 THEN slope ELSE 0 END')} AS slope FROM a"""


def _clean_report() -> str:
    return f"""WITH {CHAIN},
nl AS (SELECT count(*) FILTER (WHERE priority_text IS NULL) + count(*) FILTER (WHERE price_text IS NULL)
  + count(*) FILTER (WHERE price IS NULL) + count(*) FILTER (WHERE cust_num IS NULL) AS filled FROM conv)
SELECT CAST((SELECT count(*) FROM dirty_orders) AS BIGINT) AS rows_before,
  CAST((SELECT count(*) FROM dedup) AS BIGINT) AS rows_after,
  {_dups('stripped')} AS duplicates_removed, {_dups('dirty_orders')} AS raw_duplicate_rows,
  CAST((SELECT filled FROM nl) AS BIGINT) AS nulls_filled, CAST((SELECT count(*) FROM ({_conversions()}) cv) AS BIGINT) AS type_conversions,
  CAST((SELECT count(*) FROM ({_changed()}) ch) AS BIGINT) AS columns_cleaned"""


def _conversions() -> str:
    """Rows of the conversion log, over the CHAIN's CTEs."""
    hint = f"count(*) FILTER (WHERE regexp_matches({strip('date_text')}, '{HINT}', 'i'))"
    parse = "count(try_strptime(date_text, '%Y-%m-%d'))"
    return f"""SELECT 'date_text' AS "column", 'string' AS original_dtype, 'timestamp' AS converted_dtype, 'datetime' AS conversion
FROM dedup HAVING {hint} >= 0.6 * count(date_text) AND {parse} >= 0.6 * count(date_text)
UNION ALL
SELECT 'price_text', 'string', 'double', 'numeric' FROM dedup HAVING count({num('price_text')}) >= 0.8 * count(price_text)
UNION ALL
SELECT 'priority_text', 'string', 'double', 'numeric' FROM dedup
HAVING count({num('priority_text')}) > 0 AND count({num('priority_text')}) >= 0.8 * count(priority_text)"""


def _conversion_log() -> str:
    return f"WITH {CHAIN}\n{_conversions()}"


def _changed() -> str:
    """Columns that the cleaning changes: stripped, converted or filled."""
    stripped = [f"SELECT '{c}' AS c FROM dirty_orders HAVING count(*) FILTER (WHERE {c} <> {strip(c)}) > 0" for c in TEXT_COLS]
    filled = [f"SELECT '{c}' FROM conv HAVING count(*) FILTER (WHERE {c} IS NULL) > 0" for c in ("o_orderkey", "priority_text", "price_text", "price", "cust_num")]
    return f"SELECT DISTINCT c FROM ({union([*stripped, *filled])} UNION ALL SELECT \"column\" FROM ({_conversions()}) cv) z"


def _change_log() -> str:
    return (
        _change_rows()
        + f"""
SELECT 'priority_text' AS "column", 'priority_text' AS original_column, 'string' AS original_dtype,
  'string' AS converted_dtype, CAST(n_p AS BIGINT) AS nulls_filled,
  'stripped whitespace from ' || CAST(s_p AS VARCHAR) || ' values; filled text nulls with "Unknown"' AS transformations
FROM st, nl
UNION ALL SELECT 'date_text', 'date_text', 'string', 'timestamp', CAST(0 AS BIGINT), 'converted to datetime'
UNION ALL SELECT 'price_text', 'price_text', 'string', 'double', CAST(n_pt AS BIGINT),
  'converted numeric text to number; filled numeric nulls with median' FROM nl
UNION ALL SELECT 'price', 'price', 'double', 'double', CAST(n_pr AS BIGINT), 'filled numeric nulls with median' FROM nl
UNION ALL SELECT 'cust_num', 'cust_num', 'double', 'double', CAST(n_c AS BIGINT), 'filled numeric nulls with median' FROM nl"""
    )


def _fill_keeps_digits() -> str:
    names = {"long_id": 7, "odd_id": 11, "price": 13}
    kept = {
        "long_id": "1234567890123456::HUGEINT * 1000000000 + o_orderkey",
        "odd_id": "9007199254740993::HUGEINT + o_orderkey",
        "price": "CAST(o_totalprice AS DECIMAL(14,2))",
    }
    cells = ", ".join(f"CASE WHEN o_orderkey % {m} = 0 THEN NULL ELSE CAST({kept[c]} AS DECIMAL(30,3)) END AS {c}" for c, m in names.items())
    lists = ", ".join(f"list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL)) AS l_{c}" for c in names)
    middle = lambda c: f"(l_{c}[(len(l_{c}) + 1) // 2] + l_{c}[len(l_{c}) // 2 + 1]) * 0.5::DECIMAL(2,1)"
    filled = ", ".join(f"CAST(CAST(coalesce({c}, {middle(c)}) AS DECIMAL(38,3)) AS VARCHAR) AS {c}" for c in names)
    return f"WITH ids AS (SELECT o_orderkey, {cells} FROM orders), mid AS (SELECT {lists} FROM ids) SELECT o_orderkey, {filled} FROM ids, mid"


def _fill_median() -> str:
    return f"""WITH {CHAIN}
SELECT 'o_orderkey' AS "column", CAST(NULL AS DOUBLE) AS fill_value, CAST(count(*) FILTER (WHERE o_orderkey IS NULL) AS BIGINT) AS nulls_filled FROM conv
UNION ALL SELECT 'price_text', {r6('quantile_cont(price_text, 0.5)')}, CAST(count(*) FILTER (WHERE price_text IS NULL) AS BIGINT) FROM conv
UNION ALL SELECT 'price', {r6('quantile_cont(price, 0.5)')}, CAST(count(*) FILTER (WHERE price IS NULL) AS BIGINT) FROM conv
UNION ALL SELECT 'cust_num', {r6('quantile_cont(cust_num, 0.5)')}, CAST(count(*) FILTER (WHERE cust_num IS NULL) AS BIGINT) FROM conv"""


def _score_band() -> str:
    return f"""WITH s AS ({_quality_score()})
SELECT score, CASE WHEN score >= 80 THEN 'Strong' WHEN score >= 60 THEN 'Needs review' ELSE 'High risk' END AS band,
  CASE WHEN score >= 90 THEN 'very clean' WHEN score >= 70 THEN 'generally usable' WHEN score >= 40 THEN 'needs review'
       ELSE 'severe problems' END AS guidance_band FROM s"""


def _score_finding() -> str:
    return f"""WITH s AS ({_quality_score()})
SELECT score, 'Objective quality score factors: missing cells ' || CAST(missing_cell_percentage AS VARCHAR) ||
  '%, duplicate rows ' || CAST(duplicate_row_percentage AS VARCHAR) || '%, outlier cells ' ||
  CAST(outlier_percentage AS VARCHAR) || '%, high-cardinality categorical columns ' ||
  CAST(high_cardinality_columns AS VARCHAR) || '.' AS finding FROM s"""


def _lenient_json() -> str:
    t = (
        "text || chr(10) || '```json' || chr(10) || '{\"turn\": ' || CAST(turn AS VARCHAR) || "
        "', \"role\": \"' || role || '\"}' || chr(10) || '```'"
    )
    d = f"regexp_replace({strip(t)}, '^```(?:json)?', '', 'i')"
    d = f"{strip(d)}"
    d = f"regexp_replace({d}, '```$', '')"
    d = f"{strip(d)}"
    return f"""WITH a AS (SELECT conv_id, turn, {d} AS t FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN json_valid(t) THEN t
  WHEN json_valid(regexp_extract(t, '(?s)(\\{{.*\\}})', 1)) THEN regexp_extract(t, '(?s)(\\{{.*\\}})', 1) END AS j FROM a)
SELECT conv_id, turn, coalesce(json_type(CAST(j AS JSON)) = 'OBJECT', FALSE) AS is_object,
  TRY_CAST(json_extract(CAST(j AS JSON), '$.turn') AS BIGINT) AS parsed_turn,
  json_extract_string(CAST(j AS JSON), '$.role') AS parsed_role FROM b"""


def _history_list() -> str:
    return f"""WITH {_history_base()}
SELECT id, {iso('created_at')} AS created_at, dataset_path, regexp_extract(dataset_path, '([^/]*)$', 1) AS filename,
  printf('Report in %s over %s characters', lang, CAST(n_chars AS VARCHAR)) AS executive_summary,
  CAST(n_chars % 101 AS INTEGER) AS data_quality_score, CAST(n_chars AS BIGINT) AS row_count
FROM reports WHERE client_id = 'src1' ORDER BY created_at DESC, id DESC LIMIT 20"""


def _corr_strength() -> str:
    return f"""WITH c AS ({corr_top_sql('lineitem', LINEITEM_NUM)})
SELECT *, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM c"""


def _bar_data() -> str:
    return top_sql("orders", ["o_orderstatus", "o_orderpriority"], 10).replace(
        "SELECT col AS \"column\", CAST(rank AS INTEGER) AS rank, value, CAST(cnt AS BIGINT) AS count,\n  "
        + r6("cnt / n * 100")
        + " AS percentage",
        "SELECT col AS \"column\", CAST(rank AS INTEGER) AS rank, value, CAST(cnt AS BIGINT) AS count",
    )


# ----------------------------------------------------------------------------- files, dates, samples


def _delimiter_counts() -> str:
    cands = {",": "','", ";": "';'", "\t": "chr(9)", "|": "'|'"}
    parts = [
        f"SELECT {i} AS pos, {lit} AS delimiter, min(n) AS least, avg(n) AS mean, stddev_pop(n) AS spread "
        f"FROM (SELECT length(l) - length(replace(l, {lit}, '')) AS n FROM lines WHERE l <> '') z"
        for i, lit in enumerate(cands.values())
    ]
    return f"""WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS l FROM documents),
c AS ({union(parts)}),
best AS (SELECT pos FROM c WHERE least >= 1 ORDER BY spread / mean, pos LIMIT 1)
SELECT delimiter, CAST(least AS INTEGER) AS least, {r6('mean')} AS mean, {r6('spread')} AS spread,
  pos = coalesce((SELECT pos FROM best), 0) AS chosen FROM c"""


def _date_shapes() -> str:
    day = "strftime(o_orderdate, '%Y-%m-%dT00:00:00')"
    minute = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:00')"
    return f"""SELECT o_orderkey, {iso('o_orderdate')} AS fraction, {iso('o_orderdate')} AS zone, {minute} AS minutes,
  {day} AS day_month, {day} AS month_day FROM orders"""


def _sample_points() -> str:
    text = "CAST(l_quantity AS VARCHAR) || '|' || CAST(l_extendedprice AS VARCHAR) || '|42'"
    return f"""SELECT {r6('l_quantity')} AS l_quantity, {r6('l_extendedprice')} AS l_extendedprice FROM (
  SELECT l_quantity, l_extendedprice, row_number() OVER (ORDER BY md5({text}), l_quantity, l_extendedprice) AS k FROM lineitem) z
WHERE k <= 1800"""


def _history_rows() -> str:
    parts = " || ".join(f"CAST(length({c}) AS VARCHAR) || ':' || {c}" for c in ("client_id", "dataset_path", "ai_report", "analysis_results"))
    return f"""WITH {_history_base()}
SELECT sha256({parts}) AS id, client_id, dataset_path, ai_report, analysis_results FROM reports"""


def _history_stored(batches: list[str]) -> str:
    names = ", ".join(f"('{b}')" for b in batches)
    return f"""SELECT sha256(CAST(length(batch) AS VARCHAR) || ':' || batch || ':' || id || ':0000:1') AS id,
  client_id, dataset_path, ai_report, analysis_results FROM ({_history_rows()}) h, (VALUES {names}) b(batch)"""


# ----------------------------------------------------------------------------- charts over wide tables

LINEITEM_INT = {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"}
WIDE_LINEITEM = """wide AS (SELECT *, l_quantity * 3 AS quantity_3, l_extendedprice * (1 - l_discount) AS net,
  CAST(l_linenumber % 2 AS INTEGER) AS odd_line FROM lineitem)"""
WIDE_NUM = LINEITEM_NUM + ["quantity_3", "net", "odd_line"]
WIDE_TEXT_COLS = ["o_orderstatus", "o_orderpriority", "k3", "k5", "k7", "k11", "k13", "k40"]
WIDE_ORDERS = "wide AS (SELECT o_orderstatus, o_orderpriority, " + ", ".join(
    f"CAST(o_orderkey % {m} AS VARCHAR) AS k{m}" for m in (3, 5, 7, 11, 13, 40)
) + " FROM orders)"


def _with(cte: str, sql: str) -> str:
    return sql.replace("WITH ", f"WITH {cte}, ", 1) if sql.startswith("WITH ") else f"WITH {cte}\n{sql}"


def _distribution_data() -> str:
    top = _top_variance("lineitem", LINEITEM_NUM, 4)
    return f"""SELECT * FROM ({_histogram("lineitem", LINEITEM_NUM, LINEITEM_INT)}) h
WHERE "column" IN (SELECT "column" FROM ({top}) t)"""


def _heatmap_wide() -> str:
    top = f'SELECT "column" FROM ({_top_variance("wide", WIDE_NUM, 8)}) t'
    m = matrix_sql("wide", WIDE_NUM, digits=2)
    return f"WITH {WIDE_LINEITEM}\nSELECT * FROM ({m}) m WHERE column_a IN ({top}) AND column_b IN ({top})"


def _bar_data_wide() -> str:
    return f"""WITH {WIDE_ORDERS}, {freq_cte('wide', WIDE_TEXT_COLS)},
u AS (SELECT col, count(*) AS u FROM freq GROUP BY col HAVING count(*) < 20 ORDER BY u, col LIMIT 6)
SELECT col AS "column", CAST(rank AS INTEGER) AS rank, value, CAST(cnt AS BIGINT) AS count FROM (
  SELECT *, row_number() OVER (PARTITION BY col ORDER BY cnt DESC, value) AS rank FROM freq JOIN u USING (col)) z WHERE rank <= 10"""


def _rows(sql: str) -> str:
    return f"(SELECT count(*) FROM ({sql}) q)"


def _chart_bundle() -> str:
    charts = {
        "distributions": f"SELECT * FROM ({_histogram('orders', ORDERS_NUM, ORDERS_INT)}) h",
        "correlation_heatmap": matrix_sql("orders", ORDERS_NUM),
        "categorical_bars": _bar_data(),
        "time_series": _monthly(),
    }
    boxes = " + ".join(f"CAST(o_{c} > 0 AS INTEGER)" for c in ORDERS_NUM)
    return union([f"SELECT '{k}' AS chart, {_rows(q)} AS row_count" for k, q in charts.items()]) + f"""
UNION ALL SELECT 'outlier_boxes', n FROM (WITH {quart_cte('orders', ORDERS_NUM)}, {outliers_cte('orders', ORDERS_NUM)}
  SELECT {boxes} AS n FROM oc) b WHERE n > 0"""


def _analysis_sections() -> str:
    n = len(ORDERS_NUM)
    return union(
        [
            f"SELECT '{k}' AS section, {v} AS row_count"
            for k, v in {
                "column_types": "(SELECT count(*) FROM (DESCRIBE orders))",
                "overview": 1,
                "descriptive_stats": n,
                "categorical_top": _rows(top_sql("orders", ["o_orderstatus", "o_orderpriority"], 10)),
                "cardinality": 2,
                "correlation_matrix": n * n,
                "correlation_top": _rows(corr_top_sql("orders", ORDERS_NUM)),
                "distribution": n,
                "outlier_ranking": n,
                "monthly": _rows(_monthly()),
                "trend": 1,
            }.items()
        ]
    )


# ----------------------------------------------------------------------------- report texts


def _f3(x: str) -> str:
    return f"coalesce(printf('%.3f', {x}), 'N/A')"


def _facts() -> str:
    """(section, ord, line) of the fact lines of ``orders``."""
    cats = ["o_orderstatus", "o_orderpriority"]
    order = lambda cols: " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(cols))
    numeric = f"""SELECT 1 AS section, CASE d."column" {order(ORDERS_NUM)} END AS ord, '- ' || d."column" || ': count=' || CAST(d.count AS VARCHAR)
  || ', mean=' || {_f3('d.mean')} || ', median=' || {_f3('d.median')} || ', std=' || CASE WHEN d.count > 1 THEN {_f3('d.std')} ELSE '0' END
  || ', skewness=' || CASE WHEN d.count > 2 THEN {_f3('d.skewness')} ELSE '0' END || ', outliers=' || CAST(d.outlier_count AS VARCHAR)
  || ', distribution=' || s.classification AS line
FROM ({describe_sql('orders', ORDERS_NUM)}) d JOIN ({shape_sql('orders', ORDERS_NUM, ORDERS_INT)}) s USING ("column")"""
    pairs = [
        f"""SELECT {section}, rank, '- ' || column_a || ' and ' || column_b || ': r=' || {_f3('r')} FROM ({corr_top_sql('orders', ORDERS_NUM)}) c{section}
WHERE direction = '{direction}'
UNION ALL SELECT {section}, 0, '- No qualifying correlation pairs detected.'
WHERE NOT EXISTS (SELECT 1 FROM ({corr_top_sql('orders', ORDERS_NUM)}) e{section} WHERE direction = '{direction}')"""
        for section, direction in ((2, "positive"), (3, "negative"))
    ]
    share = _f3("cnt / n * 100")
    categorical = f"""SELECT 4, CASE col {order(cats)} END, '- ' || col || ': unique=' || CAST(any_value(u) AS VARCHAR) || ' of ' || CAST(any_value(n) AS VARCHAR)
  || ' rows, high_cardinality=' || CASE WHEN any_value(u) > 0.5 * any_value(n) THEN 'True' ELSE 'False' END || ', top values: '
  || string_agg(value || ' (' || CAST(cnt AS VARCHAR) || ' rows, ' || {share} || '%)', ', ' ORDER BY rank)
FROM (WITH {freq_cte('orders', cats)} SELECT *, row_number() OVER (PARTITION BY col ORDER BY cnt DESC, value) AS rank,
  count(*) OVER (PARTITION BY col) AS u, (SELECT count(*) FROM orders) AS n FROM freq) z WHERE rank <= 5 GROUP BY col"""
    record = "'{\"period\":\"' || period || '\",\"value\":' || CAST(round(value, 6) AS VARCHAR) || '}'"
    series = f"""SELECT 5, ord, line FROM (WITH t AS ({_trend()}), m AS (SELECT *, row_number() OVER (ORDER BY period) AS i, count(*) OVER () AS n FROM ({_monthly()}) q)
  SELECT 0 AS ord, '- Date column: ' || date_column AS line FROM t
  UNION ALL SELECT 1, '- Value column: ' || value_column FROM t
  UNION ALL SELECT 2, '- Trend direction: ' || trend_direction FROM t
  UNION ALL SELECT 3, '- Slope: ' || {_f3('slope')} FROM t
  UNION ALL SELECT 4, '- Monthly aggregation sample start: [' || string_agg({record}, ',' ORDER BY i) || ']' FROM m WHERE i <= 3
  UNION ALL SELECT 5, '- Monthly aggregation sample end: [' || coalesce(string_agg({record}, ',' ORDER BY i) FILTER (i > n - 3 AND n > 3), '') || ']' FROM m) s"""
    return union([numeric, *pairs, categorical, series])


def _report_facts() -> str:
    return f"SELECT CAST(section AS INTEGER) AS section, CAST(ord AS INTEGER) AS ord, line FROM ({_facts()}) f"


def _report_context() -> str:
    heads = {-2: "Dataset overview:", 1: "Numeric column statistics:", 2: "Top positive correlations:", 3: "Top negative correlations:",
             4: "Categorical breakdowns:", 5: "Time series:", 6: "Anomaly and outlier summary:"}
    o = f"({_overview()}) o"
    rank = {c: i for i, c in enumerate(ORDERS_NUM)}
    ranked = union([f"SELECT {i} AS p, '{c}' AS c, o_{c} AS n FROM oc" for c, i in rank.items()])
    item = "'{\"column\":\"' || c || '\",\"outlier_count\":' || CAST(n AS VARCHAR) || '}'"
    lines = [
        *[f"SELECT {s} AS section, -1 AS ord, '{h}' AS line" for s, h in heads.items()],
        f"SELECT -2, 0, '- Total rows: ' || CAST(total_rows AS VARCHAR) FROM {o}",
        f"SELECT -2, 1, '- Total columns: ' || CAST(total_columns AS VARCHAR) FROM {o}",
        f"SELECT -2, 2, '- Numeric columns: ' || CAST(numeric_columns_count AS VARCHAR) || ' (' || numeric_columns || ')' FROM {o}",
        f"SELECT -2, 3, '- Categorical columns: ' || CAST(categorical_columns_count AS VARCHAR) || ' (' || categorical_columns || ')' FROM {o}",
        f"SELECT -2, 4, '- Datetime columns detected: ' || CAST(datetime_columns_detected AS VARCHAR) || ' (' || datetime_columns || ')' FROM {o}",
        f"SELECT section, ord, line FROM ({_facts()}) f",
        f"SELECT 6, 0, '- Total outliers detected: ' || CAST(total_outliers_detected AS VARCHAR) FROM {o}",
        f"SELECT 6, 1, '- Overall outlier percentage: ' || {_f3('overall_outlier_percentage')} || '%' FROM {o}",
        f"""SELECT 6, 2, '- Columns with most outliers: [' || string_agg({item}, ',' ORDER BY n DESC, p) || ']'
FROM (WITH {quart_cte('orders', ORDERS_NUM)}, {outliers_cte('orders', ORDERS_NUM)} SELECT * FROM ({ranked}) r ORDER BY n DESC, p LIMIT 5) z""",
    ]
    return f"""SELECT string_agg(line, chr(10) ORDER BY section, ord) AS context, count(*) AS lines FROM ({union(lines)}) l"""


def _cleaning_facts() -> str:
    conv = "'{' || string_agg('\"' || k || '\":\"' || v || '\"', ',') || '}'"
    keys = union([f"SELECT {i} AS i, \"column\" AS c, '{k}' AS k, \"{k}\" AS v FROM ({_conversions()}) q{i}" for i, k in enumerate(["column", "original_dtype", "converted_dtype", "conversion"])])
    conv = conv.replace("',')", "',' ORDER BY i)")
    return f"""WITH {CHAIN}, r AS ({_clean_report().replace(f'WITH {CHAIN},', 'WITH ', 1)})
SELECT CAST(ord AS INTEGER) AS ord, line FROM (
SELECT 0 AS ord, '- Rows before cleaning: ' || CAST(rows_before AS VARCHAR) AS line FROM r
UNION ALL SELECT 1, '- Rows after cleaning: ' || CAST(rows_after AS VARCHAR) FROM r
UNION ALL SELECT 2, '- Full-row duplicates removed: ' || CAST(duplicates_removed AS VARCHAR) FROM r
UNION ALL SELECT 3, '- Nulls filled: ' || CAST(nulls_filled AS VARCHAR) FROM r
UNION ALL SELECT 4, '- Type conversions: [' || coalesce(string_agg(j, ',' ORDER BY c), '') || ']' FROM (SELECT c, {conv} AS j FROM ({keys}) k GROUP BY c) t
UNION ALL SELECT 5, '- Columns cleaned: [' || coalesce(string_agg('"' || c || '"', ',' ORDER BY c), '') || ']' FROM ({_changed()}) ch) z"""


def _findings_merge() -> str:
    line = f"(SELECT finding FROM ({_score_finding()}) f)"
    number = lambda c: f"CAST({c} AS VARCHAR)"
    names = ["missing_cell_percentage", "duplicate_row_percentage", "outlier_percentage", "high_cardinality_columns", "type_conversions"]
    factors = " || ',' || ".join(f"'\"{n}\":' || {number(n)}" for n in names)
    return f"""SELECT doc_id, (SELECT score FROM ({_quality_score()}) s) AS data_quality_score,
  CASE doc_id % 3 WHEN 0 THEN source || ' / ' || {line} WHEN 1 THEN {line} || ' / ' || source ELSE {line} END AS findings,
  (SELECT '{{' || {factors} || '}}' FROM ({_quality_score()}) s) AS score_factors FROM documents"""


def _safe_numbers() -> str:
    return f"""WITH {DIRTY} SELECT o_orderkey, {r6('coalesce(TRY_CAST(price_text AS DOUBLE), price, 0)')} AS number, {_f3('price')} AS shown FROM dirty_orders"""


ORACLE = {
    "profile_columns": _profile_columns(),
    "profile_samples": _profile_samples(),
    "duplicate_rows": f"WITH {CHAIN} SELECT {_dups('dirty_orders')} AS raw_duplicate_rows, {_dups('stripped')} AS stripped_duplicate_rows",
    "strip_text": f"WITH {CHAIN}\n" + canon_dirty("stripped"),
    "strip_counts": f"WITH {DIRTY}\n"
    + union(
        [
            f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} <> {strip(c)}) AS BIGINT) AS stripped_values FROM dirty_orders"
            for c in TEXT_COLS
        ]
    ),
    "dedup_rows": f"WITH {CHAIN}\n" + canon_dirty("dedup"),
    "date_hint_ratio": f"WITH {CHAIN}\nSELECT \"column\", non_null, hit AS hinted, ratio AS hint_ratio FROM ("
    + _ratio_rows("dedup", TEXT_COLS, "hint")
    + ") z",
    "cast_dates": f"""WITH {CHAIN}
SELECT o_orderkey, priority_text, {iso("try_strptime(date_text, '%Y-%m-%d')")} AS date_text, price_text,
  {r6('price')} AS price, {r6('cust_num')} AS cust_num, {iso('order_ts')} AS order_ts FROM dedup""",
    "numeric_ratio": f"WITH {CHAIN}\nSELECT \"column\", non_null, hit AS numeric, ratio AS numeric_ratio FROM ("
    + _ratio_rows("dedup", ["priority_text", "price_text"], "num")
    + ") z",
    "cast_numbers": f"WITH {CHAIN}\n" + canon_dirty("conv", date_is_ts=True),
    "fill_median": _fill_median(),
    "fill_keeps_digits": _fill_keeps_digits(),
    "fill_unknown": f"WITH {CHAIN} SELECT 'priority_text' AS \"column\", CAST(count(*) FILTER (WHERE priority_text IS NULL) AS BIGINT) AS nulls_filled FROM conv",
    "keep_date_nulls": f"""WITH {CHAIN}
SELECT 'date_text' AS "column", CAST(count(*) FILTER (WHERE date_text IS NULL) AS BIGINT) AS null_count, CAST(0 AS BIGINT) AS nulls_filled FROM cleaned
UNION ALL SELECT 'order_ts', CAST(count(*) FILTER (WHERE order_ts IS NULL) AS BIGINT), CAST(0 AS BIGINT) FROM cleaned""",
    "normalize_headers": _normalize_headers(),
    "conversion_log": _conversion_log(),
    "change_log": _change_log(),
    "clean_report": _clean_report(),
    "clean_table": f"WITH {CHAIN}\n" + canon_dirty("cleaned", date_is_ts=True),
    "column_types": """SELECT * FROM (VALUES (0, 'o_orderkey', 'bigint', 'numeric'), (1, 'o_custkey', 'bigint', 'numeric'),
  (2, 'o_orderstatus', 'string', 'categorical'), (3, 'o_totalprice', 'double', 'numeric'),
  (4, 'o_orderdate', 'timestamp_ntz', 'datetime'), (5, 'o_orderpriority', 'string', 'categorical'))
  AS t(position, "column", dtype, kind)""",
    "overview": _overview(),
    "describe_numeric": describe_sql("lineitem", LINEITEM_NUM),
    "outlier_counts": f"""WITH {quart_cte('events', ['event_id', 'user_id', 'value'])}, {outliers_cte('events', ['event_id', 'user_id', 'value'])}
SELECT 'event_id' AS "column", o_event_id AS outlier_count, {r6('o_event_id / n_rows * 100')} AS outlier_percentage FROM oc
UNION ALL SELECT 'user_id', o_user_id, {r6('o_user_id / n_rows * 100')} FROM oc
UNION ALL SELECT 'value', o_value, {r6('o_value / n_rows * 100')} FROM oc""",
    "flag_outliers": _flag_outliers(),
    "outlier_ranking": _outlier_ranking(),
    "category_top10": top_sql("orders", ["o_orderstatus", "o_orderpriority"], 10),
    "cardinality": _cardinality(),
    "correlation_matrix": matrix_sql("lineitem", LINEITEM_NUM),
    "correlation_top": corr_top_sql("lineitem", LINEITEM_NUM),
    "histogram_auto": _histogram("orders", ORDERS_NUM, ORDERS_INT),
    "bimodal_check": f"WITH {bimodal_ctes('part', ['p_partkey', 'p_size', 'p_retailprice'], {'p_partkey', 'p_size'})}\n"
    'SELECT col AS "column", bimodal FROM bimodal',
    "shape_class": shape_sql("events", ["event_id", "user_id", "value"], {"event_id", "user_id"}),
    "pick_series": "SELECT 'o_orderdate' AS date_column, (SELECT col FROM (SELECT 'o_orderkey' AS col, var_samp(o_orderkey) AS v, 0 AS p FROM orders "
    "UNION ALL SELECT 'o_custkey', var_samp(o_custkey), 1 FROM orders UNION ALL SELECT 'o_totalprice', var_samp(o_totalprice), 2 FROM orders) z "
    "ORDER BY v DESC NULLS LAST, p LIMIT 1) AS value_column",
    "monthly_mean": f"SELECT period, {r6('value')} AS value FROM ({_monthly()}) m",
    "trend": _trend(),
    "top_variance": _top_variance("lineitem", LINEITEM_NUM, 8).replace(r6("v"), "round(v, 2)"),
    "heatmap": matrix_sql("lineitem", LINEITEM_NUM, digits=2),
    "bar_data": _bar_data(),
    "box_data": _box_data(),
    "line_data": f"SELECT period, strftime(CAST(period || '-01' AS DATE), '%Y-%m-%d') AS period_start, {r6('value')} AS value FROM ({_monthly()}) m",
    "quality_score": _quality_score(),
    "score_finding": _score_finding(),
    "score_band": _score_band(),
    "corr_strength": _corr_strength(),
    "lenient_json": _lenient_json(),
    "history_list": _history_list(),
    "history_fetch": _fetch("21", "src1"),
    "history_isolation": _fetch("21", "src2"),
    "storage_names": _storage_names(),
    "preview": f"""SELECT o_orderkey, o_custkey, o_orderstatus, {r6('o_totalprice')} AS o_totalprice,
  {iso('o_orderdate')} AS o_orderdate, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 10""",
    "json_rows": f"""SELECT event_id, {iso('ts')} AS ts, user_id, event_type, {r6('value')} AS value, props FROM events""",
    "sample_points": _sample_points(),
    "csv_typing": f"""SELECT o_orderkey, o_custkey, o_orderstatus, {r6('o_totalprice')} AS o_totalprice, o_orderpriority,
  '1234567890123456789' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS long_id, o_custkey % 2 = 0 AS even,
  CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END AS gaps FROM orders""",
    "csv_round_trip": f"SELECT c_custkey, c_name, c_nationkey, {r6('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer",
    "delimiter_counts": _delimiter_counts(),
    "date_shapes": _date_shapes(),
    "history_rows": _history_rows(),
    "history_append": _history_stored(["first", "second"]),
    "history_compacted": _history_stored(["first", "second"]),
    "history_client": f"SELECT * FROM ({_history_stored(['first'])}) s WHERE client_id = 'src1'",
    "csv_latin1": f"SELECT c_custkey, c_name || ' é, à' AS c_name, {r6('c_acctbal')} AS c_acctbal FROM customer",
    "csv_quoted": f"""SELECT c_custkey, CASE WHEN c_custkey % 3 > 0
  THEN 'say "' || c_name || '", then;' || chr(10) || chr(92) || ' and' || chr(9) || '"' || CAST(c_custkey AS VARCHAR) || chr(10) || ', end'
  ELSE c_name END AS note, {r6('c_acctbal')} AS c_acctbal FROM customer""",
    "csv_folder": f"SELECT c_custkey, c_name || ' é, à' AS c_name, CASE WHEN c_custkey % 3 < 2 THEN {r6('c_acctbal')} END AS c_acctbal FROM customer",
    "distribution_data": _distribution_data(),
    "chart_bundle": _chart_bundle(),
    "analysis_sections": _analysis_sections(),
    "top_variance_wide": _with(WIDE_LINEITEM, _top_variance("wide", WIDE_NUM, 8).replace(r6("v"), "round(v, 2)")),
    "heatmap_wide": _heatmap_wide(),
    "bar_data_wide": _bar_data_wide(),
    "report_facts": _report_facts(),
    "report_context": _report_context(),
    "cleaning_facts": _cleaning_facts(),
    "findings_merge": _findings_merge(),
    "safe_numbers": _safe_numbers(),
}
