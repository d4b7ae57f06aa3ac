"""DuckDB oracle SQL for P1-P4, P6, P7 (catalog from information_schema) and C1-C14 on retail_dirty."""

from __future__ import annotations

from shelfcast.plans.fixtures import RETAIL_DIRTY_SQL, TABLES

# Names, tokens and weights of the role rules, written out here a second time so that
# a change of the library's own tables shows.
DATE_WEIGHTS = {'date': 3.0, 'day': 1.5, 'time': 1.0, 'timestamp': 2.5, 'order': 1.0, 'invoice': 1.0, 'bill': 1.0, 'transaction': 1.0, 'period': 1.0}
TARGET_WEIGHTS = {'sales': 3.0,
 'sale': 2.5,
 'amount': 2.5,
 'revenue': 2.5,
 'qty': 2.0,
 'quantity': 2.5,
 'demand': 2.0,
 'units': 2.0,
 'total': 1.0,
 'net': 1.0}
ITEM_WEIGHTS = {'item': 3.0, 'product': 3.0, 'category': 2.5, 'supplier': 2.0, 'sku': 3.0, 'brand': 1.5, 'department': 1.5, 'segment': 1.5}
GROUP_WEIGHTS = {'category': 3.0, 'type': 2.0, 'department': 2.0, 'supplier': 2.0, 'store': 2.0, 'branch': 2.0, 'region': 1.5}
TARGET_EXCLUDE = ['date', 'time', 'day', 'timestamp', 'id']
ITEM_EXCLUDE = ['date', 'sales', 'amount', 'revenue']
EXCLUSION_PENALTY = 2.5
DATE_NAMES = ['date', 'sale_date', 'transaction_date', 'invoice_date', 'order_date']
TARGET_NAMES = ['retail_sales', 'total_sale', 'total_amount', 'sales', 'sales_amount', 'quantity', 'quantiy', 'warehouse_sales']
ITEM_NAMES = ['item_description', 'product_category', 'category', 'item_code', 'product_id', 'product', 'item', 'supplier']
GROUP_NAMES = ['item_type', 'product_category', 'category', 'supplier']
SALES_TOKENS = ['sales', 'sale', 'amount', 'quantity', 'revenue', 'demand', 'units']
DATE_CANDIDATE_TOKENS = ['date', 'day', 'time', 'timestamp', 'period']
ITEM_CANDIDATE_TOKENS = ['item', 'product', 'category', 'supplier', 'sku', 'brand', 'department']
CONTEXT_TAGS = {'promotion': ['promo', 'promotion', 'discount', 'offer'],
 'holiday': ['holiday', 'festival'],
 'store': ['store', 'branch', 'location'],
 'category': ['category', 'type', 'segment']}

# Columns of the driver's tables.
TABLE_COLUMNS = {'region': ['r_regionkey', 'r_name'],
 'nation': ['n_nationkey', 'n_name', 'n_regionkey'],
 'customer': ['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'],
 'supplier': ['s_suppkey', 's_name', 's_nationkey', 's_acctbal'],
 'part': ['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice'],
 'orders': ['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'],
 'lineitem': ['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax',
              'l_returnflag', 'l_linestatus', 'l_shipdate'],
 'events': ['event_id', 'ts', 'user_id', 'event_type', 'value', 'props'],
 'documents': ['doc_id', 'text', 'lang', 'source', 'n_chars'],
 'embeddings': ['vec_id', 'embedding', 'label'],
 'pages': ['page_id', 'url', 'html'],
 'benchmark': ['item_id', 'text'],
 'labels': ['doc_id', 'quality', 'toxic'],
 'conversations': ['conv_id', 'turn', 'role', 'text']}


def _lst(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _score(weights, excl=()):
    s = " + ".join(f"(CASE WHEN contains(n, '{t}') THEN {w} ELSE 0.0 END)" for t, w in weights.items())
    if excl:
        s = f"({s}) - (CASE WHEN {_any(excl)} THEN {EXCLUSION_PENALTY} ELSE 0.0 END)"
    return f"({s})"


def _any(tokens):
    return "(" + " OR ".join(f"contains(n, '{t}')" for t in tokens) + ")"


CATALOG_CTE = f"""
cat AS (
  SELECT table_name, CAST(ordinal_position AS INTEGER) AS ordinal, column_name,
         regexp_replace(regexp_replace(lower(regexp_replace(column_name, '^\\s+|\\s+$', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS n
  FROM information_schema.columns
  WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)})
)"""

# Per column: non-null and distinct values.
PROFILE_CTE = "prof AS (\n  " + "\n  UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS name, COUNT({c}) AS non_null, COUNT(DISTINCT {c}) AS distinct_values FROM {t}"
    for t, columns in TABLE_COLUMNS.items() for c in columns) + ")"

NORMALIZED_SQL = f"""WITH {CATALOG_CTE.strip()},
{PROFILE_CTE}
SELECT table_name, ordinal, column_name, n AS normalized_name, non_null, distinct_values
FROM cat JOIN prof USING (table_name) WHERE column_name = name"""

ROLE_SCORES_SQL = f"""WITH {CATALOG_CTE.strip()},
{PROFILE_CTE},
s AS (
  SELECT table_name, ordinal, n AS column_name, 'date' AS role, {_score(DATE_WEIGHTS)} AS score FROM cat
  UNION ALL SELECT table_name, ordinal, n, 'target', {_score(TARGET_WEIGHTS, TARGET_EXCLUDE)} FROM cat
  UNION ALL SELECT table_name, ordinal, n, 'item', {_score(ITEM_WEIGHTS, ITEM_EXCLUDE)} FROM cat
  UNION ALL SELECT table_name, ordinal, n, 'group', {_score(GROUP_WEIGHTS, ITEM_EXCLUDE)} FROM cat
)
SELECT s.*, non_null, distinct_values FROM s JOIN prof p ON p.table_name = s.table_name AND p.name = s.column_name WHERE score > 0"""


def _exact(names):
    return f"arg_min(n, (list_position({_lst(names)}, n), ordinal)) FILTER (WHERE list_position({_lst(names)}, n) > 0)"


def _best(weights, excl=()):
    sc = _score(weights, excl)
    return f"arg_max(n, ({sc}, -ordinal)) FILTER (WHERE {sc} > 0)"


def _names(cond):
    return f"COALESCE(string_agg(n, ',' ORDER BY ordinal) FILTER (WHERE {cond}), '')"


_SALES = f"({_any(SALES_TOKENS)} AND NOT {_any(TARGET_EXCLUDE)})"

ROLE_DETECTION_SQL = f"""WITH {CATALOG_CTE.strip()},
{PROFILE_CTE},
d AS (
  SELECT table_name,
    COALESCE({_exact(DATE_NAMES)}, {_best(DATE_WEIGHTS)}) AS date_column,
    MAX(CASE WHEN n = 'year' THEN n END) AS year_column,
    MAX(CASE WHEN n = 'month' THEN n END) AS month_column,
    MAX(CASE WHEN n = 'sale_time' THEN n END) AS time_column,
    COALESCE({_exact(TARGET_NAMES)}, {_best(TARGET_WEIGHTS, TARGET_EXCLUDE)}) AS target_column,
    COALESCE({_exact(ITEM_NAMES)}, {_best(ITEM_WEIGHTS, ITEM_EXCLUDE)}) AS item_column,
    COALESCE({_exact(GROUP_NAMES)}, {_best(GROUP_WEIGHTS, ITEM_EXCLUDE)}) AS item_group_column,
    {_names(_SALES)} AS sales_columns,
    {_names(_any(DATE_CANDIDATE_TOKENS))} AS date_candidates,
    {_names(_SALES)} AS target_candidates,
    {_names(_any(ITEM_CANDIDATE_TOKENS))} AS item_candidates
  FROM cat GROUP BY table_name
)
SELECT d.*, (target_column IS NOT NULL AND (date_column IS NOT NULL OR (year_column IS NOT NULL AND month_column IS NOT NULL))) AS can_auto_detect,
  COALESCE((SELECT non_null FROM prof p WHERE p.table_name = d.table_name AND name = date_column), 0) AS date_values,
  COALESCE((SELECT non_null FROM prof p WHERE p.table_name = d.table_name AND name = target_column), 0) AS target_values,
  COALESCE((SELECT distinct_values FROM prof p WHERE p.table_name = d.table_name AND name = item_column), 0) AS distinct_items,
  COALESCE((SELECT distinct_values FROM prof p WHERE p.table_name = d.table_name AND name = item_group_column), 0) AS distinct_groups
FROM d"""

CONTEXT_SQL = f"WITH {CATALOG_CTE.strip()},\n{PROFILE_CTE}\n" + "\nUNION ALL\n".join(
    f"SELECT table_name, '{tag}' AS tag, {i} AS tag_order, string_agg(n, ',' ORDER BY ordinal) AS columns, "
    f"SUM(non_null)::BIGINT AS non_null FROM cat JOIN prof USING (table_name) WHERE column_name = name AND {_any(toks)} GROUP BY table_name"
    for i, (tag, toks) in enumerate(CONTEXT_TAGS.items()))


# ---------------------------------------------------------------- cleaning on retail_dirty

def _trim(c):
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _blank(c):
    return f"CASE WHEN {_trim(c)} IN ('', 'nan', 'None') THEN NULL ELSE {_trim(c)} END"


_DIRTY_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "sale_date", "retail_sales",
               "item_code", "item_type", "warehouse_sales"]

CLEAN_CTES = RETAIL_DIRTY_SQL + f""",
dd AS (SELECT DISTINCT * FROM retail_dirty),
tb AS (SELECT {", ".join(f"{_blank(c)} AS {c}" for c in _DIRTY_COLS)} FROM dd),
co AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sale_date,
         TRY_CAST(retail_sales AS DOUBLE) AS retail_sales, item_code, item_type,
         TRY_CAST(warehouse_sales AS DOUBLE) AS warehouse_sales,
         CAST(try_strptime(sale_date, '%Y-%m-%d') AS TIMESTAMP) AS analysis_date
  FROM tb
),
valid AS (SELECT * FROM co WHERE analysis_date IS NOT NULL AND retail_sales IS NOT NULL),
fill AS (
  SELECT (SELECT MEDIAN(warehouse_sales) FROM valid) AS wh_med,
         (SELECT item_type FROM valid WHERE item_type IS NOT NULL GROUP BY item_type
          ORDER BY COUNT(*) DESC, item_type LIMIT 1) AS type_mode
)"""

CLEAN_ROWS_SQL = "WITH " + CLEAN_CTES.strip() + """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sale_date, retail_sales, item_code,
       COALESCE(item_type, fill.type_mode) AS item_type,
       COALESCE(warehouse_sales, fill.wh_med) AS warehouse_sales, analysis_date
FROM valid, fill"""

_NULL_COUNTS = ",\n".join(
    f"  SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing FROM valid" for c in _DIRTY_COLS)

MISSING_PROFILE_SQL = "WITH " + CLEAN_CTES.strip() + f""",
nc AS (
{chr(10).join(("  " if i == 0 else "  UNION ALL ") + f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing FROM valid" for i, c in enumerate(_DIRTY_COLS))}
)
SELECT 'before' AS stage, column_name, missing FROM nc WHERE missing > 0
UNION ALL
SELECT 'after', column_name, missing FROM (
  SELECT 'item_type' AS column_name, COUNT(*) FILTER (COALESCE(item_type, (SELECT type_mode FROM fill)) IS NULL) AS missing FROM valid
  UNION ALL SELECT 'warehouse_sales', COUNT(*) FILTER (COALESCE(warehouse_sales, (SELECT wh_med FROM fill)) IS NULL) FROM valid)
WHERE missing > 0"""

# The text columns whose values change when they are trimmed.
_TRIMMED = " || ".join(f"(CASE WHEN EXISTS (SELECT 1 FROM dd WHERE {c} <> {_trim(c)}) THEN ',{c}' ELSE '' END)" for c in _DIRTY_COLS)

CLEANING_SUMMARY_SQL = "WITH " + CLEAN_CTES.strip() + f""",
nc AS (
{chr(10).join(("  " if i == 0 else "  UNION ALL ") + f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing FROM valid" for i, c in enumerate(_DIRTY_COLS))}
)
SELECT
  (SELECT COUNT(*) FROM retail_dirty) AS original_rows,
  (SELECT COUNT(*) FROM valid) AS rows_after_cleaning,
  (SELECT COUNT(*) FROM retail_dirty) - (SELECT COUNT(*) FROM dd) AS duplicates_removed,
  (SELECT COUNT(*) FROM co WHERE analysis_date IS NULL) AS invalid_dates_removed,
  (SELECT COUNT(*) FROM co WHERE analysis_date IS NOT NULL AND retail_sales IS NULL) AS target_values_removed,
  ltrim({_TRIMMED}, ',') AS trimmed_text_columns,
  (SELECT string_agg(column_name || '=' || CAST(missing AS VARCHAR), ',' ORDER BY column_name) FROM nc WHERE missing > 0) AS missing_values_before,
  CASE WHEN (SELECT type_mode FROM fill) IS NULL OR (SELECT wh_med FROM fill) IS NULL THEN 'some' ELSE '' END AS missing_values_after,
  'warehouse_sales=' || CAST(ROUND((SELECT wh_med FROM fill), 4) AS VARCHAR) AS filled_numeric_columns,
  'item_type=' || (SELECT type_mode FROM fill) AS filled_categorical_columns,
  (SELECT COUNT(*) FROM retail_dirty) > (SELECT COUNT(*) FROM valid) OR {_TRIMMED} <> ''
  OR EXISTS (SELECT 1 FROM nc WHERE missing > 0) AS cleaning_applied"""


def cleaning_report_sql() -> str:
    from shelfcast.plans.sql_monthly import dense_ctes, totals_ctes
    fmt = lambda x: f"format('{{:,}}', CAST({x} AS BIGINT))"
    return "WITH " + CLEAN_CTES.strip() + ",\nclean AS (SELECT * FROM valid)," + totals_ctes().strip("\n") + "," \
        + dense_ctes().strip("\n") + f""",
g AS (SELECT CAST(SUM(CAST(filled AS INTEGER)) AS INTEGER) AS mmf FROM dense),
s AS (
  SELECT (SELECT COUNT(*) FROM retail_dirty) AS original_rows,
         (SELECT COUNT(*) FROM valid) AS rows_after,
         (SELECT COUNT(*) FROM retail_dirty) - (SELECT COUNT(*) FROM dd) AS dups,
         (SELECT COUNT(*) FROM co WHERE analysis_date IS NULL) AS bad_dates,
         (SELECT COUNT(*) FROM co WHERE analysis_date IS NOT NULL AND retail_sales IS NULL) AS bad_targets,
         (SELECT mmf FROM g) AS mmf
)
SELECT 1 AS pos, 'Rows before cleaning' AS label, {fmt('original_rows')} AS value FROM s
UNION ALL SELECT 2, 'Rows after cleaning', {fmt('rows_after')} FROM s
UNION ALL SELECT 3, 'Duplicates removed', {fmt('dups')} FROM s
UNION ALL SELECT 4, 'Invalid dates removed', {fmt('bad_dates')} FROM s
UNION ALL SELECT 5, 'Invalid target rows removed', {fmt('bad_targets')} FROM s
UNION ALL SELECT 6, 'Monthly gaps handled', {fmt('mmf')} || ' (' || CASE WHEN mmf > 0 THEN 'linear interpolation' ELSE 'not needed' END || ')' FROM s
UNION ALL SELECT 7, 'Trimmed text columns', COALESCE(NULLIF(replace(ltrim({_TRIMMED}, ','), ',', ', '), ''), 'None') FROM s"""


# retail_dirty after a CSV round trip: NA tokens null, all-numeric columns typed.
CSV_SCAN_SQL = "WITH " + RETAIL_DIRTY_SQL.strip() + """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey,
       sale_date, retail_sales, CAST(item_code AS BIGINT) AS item_code, NULLIF(item_type, 'nan') AS item_type,
       CAST(warehouse_sales AS DOUBLE) AS warehouse_sales, '5" (' || l_partkey || '),' || chr(10) || '"' || item_code || '",' AS note
FROM retail_dirty"""


def dated_rows_sql(view: str) -> str:
    """Rows, sum and range of the analysis date per month, over a view with the CTE ``dated``."""
    return f"""WITH {view.strip()}
SELECT CAST(date_trunc('month', analysis_date) AS DATE) AS date, COUNT(*) AS row_count, SUM(retail_sales) AS target,
       strftime(MIN(analysis_date), '%Y-%m-%d %H:%M:%S.%g') AS first_seen, strftime(MAX(analysis_date), '%Y-%m-%d %H:%M:%S.%g') AS last_seen
FROM dated WHERE analysis_date IS NOT NULL GROUP BY 1"""
