"""The registered queries as plain SQL over the same tables, for comparison only."""

from tablekeep.functions.vocab import PATTERNS
from tablekeep.plans.star_catalogue import RECIPES, TABLES, inputs_of

ORACLES: dict[str, str] = {}


def _closure(names: list[str]) -> list[str]:
    """Recipes needed for these, inputs first."""
    out: list[str] = []
    for name in names:
        if name in RECIPES:
            for needed in (*_closure(inputs_of(name)), name):
                if needed not in out:
                    out.append(needed)
    return out


def oracle(key: str, names: str, body: str, ctes: str = "", recursive: bool = False) -> None:
    """Register ``body`` with the recipes ``names`` (and more ``ctes``) in front."""
    same = {n: n for n in (*TABLES, *RECIPES)}
    parts = [f"{n} AS ({RECIPES[n].format(**same)})" for n in _closure(names.split())]
    if ctes:
        parts.append(ctes.strip().rstrip(","))
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else ""
    ORACLES[key] = head + body


# --- rules -------------------------------------------------------------------------------------


def _constraint(rule: str, check: str, column: str, passed: str, bad: str) -> str:
    return f"""
        SELECT '{rule}' AS rule_id, '{check}' AS check_name, '{column}' AS column_name,
               CASE WHEN {passed} THEN 'passed' ELSE 'failed' END AS status,
               CASE WHEN {passed} THEN 0 ELSE count(*) FILTER (WHERE {bad}) END AS error_count,
               count(*) AS total_count,
               count(*) FILTER (WHERE {column} IS NULL) AS null_count,
               count(*) FILTER (WHERE trim(CAST({column} AS VARCHAR)) = '') AS blank_count
        FROM dirty_orders"""


_EMPTY = "{c} IS NULL OR trim(CAST({c} AS VARCHAR)) = ''"
_IN = "{c} IS NULL OR {c} NOT IN ({v})"


def _allowed(rule: str, column: str, values: str) -> str:
    bad = _IN.format(c=column, v=values)
    passed = f"count(*) FILTER (WHERE {column} NOT IN ({values})) = 0"
    return _constraint(rule, "allowed_values", column, passed, bad)


_CONSTRAINTS = " UNION ALL ".join(
    [
        _constraint(
            "r001", "completeness", "o_orderstatus", "count(o_orderstatus) >= 0.95 * count(*)",
            _EMPTY.format(c="o_orderstatus"),
        ),
        _constraint(
            "r002", "completeness", "o_orderstatus", "count(o_orderstatus) >= 0.5 * count(*)",
            _EMPTY.format(c="o_orderstatus"),
        ),
        _constraint(
            "r003", "completeness", "o_custkey", "count(o_custkey) >= count(*)",
            _EMPTY.format(c="o_custkey"),
        ),
        _constraint(
            "r004", "min", "o_totalprice", "min(o_totalprice) >= 2000", "o_totalprice < 2000"
        ),
        _constraint(
            "r005", "max", "o_totalprice", "max(o_totalprice) <= 499000", "o_totalprice > 499000"
        ),
        _constraint("r006", "max", "o_custkey", "max(o_custkey) <= 1e12", "o_custkey > 1e12"),
        _allowed("r007", "o_orderstatus", "'F', 'O'"),
        _allowed("r008", "o_orderpriority", "'1-URGENT', '2-HIGH'"),
        _allowed("r009", "o_orderstatus", "'F', 'O', 'P', '', '  ', 'NULL'"),
    ]
)
oracle(
    "dq_constraints",
    "dirty_orders",
    f"""
SELECT rule_id, check_name, column_name, status, error_count, total_count,
       error_count || '/' || total_count AS ratio, null_count, blank_count
FROM ({_CONSTRAINTS})""",
)


def _pattern(rule: str, pattern: str, column: str) -> str:
    text = f"trim(CAST({column} AS VARCHAR))"
    usable = f"{text} <> '' AND {text} <> 'NULL'"
    return f"""
        SELECT '{rule}' AS rule_id, 'regex_{pattern}' AS check_name, '{column}' AS column_name,
               count(*) FILTER (WHERE {usable}
                                AND NOT regexp_matches({text}, '{PATTERNS[pattern]}')) AS error_count,
               count(*) FILTER (WHERE {usable}) AS total_count
        FROM contacts"""


_PATTERNS = " UNION ALL ".join(
    _pattern(f"r{i:03d}", pattern, column)
    for i, (pattern, column) in enumerate(
        [
            ("email", "email"),
            ("phone", "phone"),
            ("postal_code", "postal_code"),
            ("numeric", "digits"),
            ("alphanumeric", "word"),
            ("date", "day"),
            ("ip", "ip"),
            ("numeric", "c_custkey"),
        ],
        1,
    )
)
oracle(
    "dq_regex",
    "contacts",
    f"""
SELECT *, CASE WHEN error_count = 0 THEN 'passed' ELSE 'failed' END AS status,
       error_count || '/' || total_count AS ratio
FROM ({_PATTERNS})""",
)

_STATUS_TEXT = "CASE WHEN o_orderstatus IS NULL THEN 'NULL' ELSE o_orderstatus END"
oracle(
    "dq_examples",
    "dirty_orders",
    """
SELECT rule_id, status, coalesce(examples, '') AS examples
FROM (VALUES ('r001', 'failed'), ('r002', 'passed'), ('r003', 'passed'), ('r004', 'failed'),
             ('r005', 'failed'), ('r006', 'passed'), ('r007', 'failed'), ('r008', 'failed'),
             ('r009', 'passed')) AS rules(rule_id, status)
LEFT JOIN (
    SELECT rule_id, string_agg(value, '|' ORDER BY place) AS examples
    FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY value) AS place FROM failing)
    WHERE place <= 5 GROUP BY rule_id
) AS found USING (rule_id)""",
    f"""
failing AS (
    SELECT 'r001' AS rule_id,
           CASE WHEN o_orderstatus IS NULL THEN 'NULL' ELSE 'VIDE' END AS value
    FROM dirty_orders WHERE o_orderstatus IS NULL OR trim(o_orderstatus) = ''
    UNION ALL SELECT 'r004', CAST(o_totalprice AS VARCHAR) FROM dirty_orders
              WHERE o_totalprice < 2000
    UNION ALL SELECT 'r005', CAST(o_totalprice AS VARCHAR) FROM dirty_orders
              WHERE o_totalprice > 499000
    UNION ALL SELECT DISTINCT 'r007', {_STATUS_TEXT} FROM dirty_orders
              WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT DISTINCT 'r008', o_orderpriority FROM dirty_orders
              WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
)""",
)

_DUPLICATE_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus"]
_VALUES = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM dirty_orders"
    for c in _DUPLICATE_COLUMNS
)
oracle(
    "dq_column_duplicates",
    "dirty_orders",
    """
SELECT column_name, count(*) FILTER (WHERE n > 1) AS duplicates,
       CAST(sum(n) AS BIGINT) AS rows,
       coalesce(string_agg(coalesce(value, 'NULL'), '|' ORDER BY place)
                FILTER (WHERE n > 1 AND place <= 5), '') AS examples
FROM (
    SELECT *, row_number() OVER (PARTITION BY column_name
                                 ORDER BY n DESC, value ASC NULLS FIRST) AS place
    FROM (SELECT column_name, value, count(*) AS n FROM entries GROUP BY column_name, value)
)
GROUP BY column_name""",
    f"entries AS ({_VALUES})",
)

oracle(
    "dq_row_duplicates",
    "double_lineitem",
    """
SELECT CAST(sum(n) - count(*) AS BIGINT) AS duplicates, CAST(sum(n) AS BIGINT) AS rows,
       coalesce(string_agg(l_orderkey || '/' || l_partkey || '/' || l_suppkey || '/' || l_linenumber
                           || '/' || l_returnflag, '|' ORDER BY place)
                FILTER (WHERE n > 1 AND place <= 5), '') AS examples
FROM (SELECT *, row_number() OVER (ORDER BY n DESC, l_orderkey || ',', l_partkey || ',', l_suppkey || ',',
                                   l_linenumber || ',') AS place
      FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
                   l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, count(*) AS n
            FROM double_lineitem GROUP BY ALL))""",
)

oracle(
    "dq_skips",
    "dirty_orders",
    """
SELECT rule_id, check_name, column_name, 'skipped' AS status, CAST(0 AS BIGINT) AS error_count,
       CASE WHEN check_name LIKE 'regex%' THEN 0 ELSE n END AS total_count,
       '0/' || CASE WHEN check_name LIKE 'regex%' THEN 0 ELSE n END AS ratio, message
FROM (VALUES
    ('r001', 'min', '', 'no column named'),
    ('r002', 'max', 'no_such_column', 'column ''no_such_column'' not found'),
    ('r003', 'unique', 'o_custkey', 'unknown check ''unique'''),
    ('r004', 'completeness', 'o_custkey', 'threshold must be between 0 and 1'),
    ('r005', 'min', 'o_custkey', 'threshold must be a finite number'),
    ('r006', 'allowed_values', 'o_custkey', 'at least one allowed value is needed'),
    ('r007', 'min', 'o_orderdate', 'column ''o_orderdate'' is not numeric'),
    ('r008', 'regex_zip', 'o_orderstatus', 'unknown pattern ''zip'''),
    ('r009', 'regex_email', 'missing', 'column ''missing'' not found'),
    ('r010', 'column_duplicates', 'missing', 'column ''missing'' not found')
) AS rules(rule_id, check_name, column_name, message)
CROSS JOIN (SELECT count(*) AS n FROM dirty_orders)""",
)


def _counted(rule: str, check: str, column: str, errors: str, total: str) -> str:
    return f"""
        SELECT '{rule}' AS rule_id, '{check}' AS check_name, '{column}' AS column_name,
               CAST({errors} AS BIGINT) AS error_count, CAST({total} AS BIGINT) AS total_count"""


def _repeated(column: str) -> str:
    return f"""(SELECT count(*) FROM (SELECT {column} FROM contacts GROUP BY {column}
                HAVING count(*) > 1))"""


_ALL_ROWS = "(SELECT count(*) FROM contacts)"
_BLANK_WORDS = "(SELECT count(*) FROM contacts WHERE word IS NULL OR trim(word) = '')"
_SURPLUS = f"{_ALL_ROWS} - (SELECT count(*) FROM (SELECT DISTINCT * FROM contacts))"
_VALIDATE = " UNION ALL ".join(
    [
        _counted("r001", "completeness", "word", _BLANK_WORDS, _ALL_ROWS),
        _pattern("r002", "email", "email"),
        _pattern("r003", "ip", "ip"),
        _counted("r004", "column_duplicates", "postal_code", _repeated("postal_code"), _ALL_ROWS),
        _counted("r005", "column_duplicates", "day", _repeated("day"), _ALL_ROWS),
        _counted("r006", "row_duplicates", "", _SURPLUS, _ALL_ROWS),
    ]
)
oracle(
    "dq_validate",
    "contacts",
    f"""
SELECT *, CASE WHEN error_count = 0 THEN 'passed' ELSE 'failed' END AS status,
       error_count || '/' || total_count AS ratio
FROM ({_VALIDATE})""",
)

oracle(
    "dq_faults",
    "contacts",
    f"""
SELECT *, CASE WHEN error_count = 0 THEN 'passed' ELSE 'failed' END AS status,
       error_count || '/' || total_count AS ratio
FROM ({" UNION ALL ".join([
    _counted("r001", "completeness", "word", _BLANK_WORDS, _ALL_ROWS),
    _counted("r002", "min", "age", _ALL_ROWS, _ALL_ROWS),
    _counted("r003", "max", "c_custkey", "0", _ALL_ROWS),
    _counted("r004", "allowed_values", "age", _ALL_ROWS, _ALL_ROWS),
    _pattern("r005", "email", "email"),
    _counted("r006", "regex_numeric", "age", _ALL_ROWS, _ALL_ROWS),
    _counted("r007", "column_duplicates", "age", _ALL_ROWS, _ALL_ROWS),
    _counted("r008", "column_duplicates", "day", _repeated("day"), _ALL_ROWS),
    _counted("r009", "row_duplicates", "", _ALL_ROWS, _ALL_ROWS),
])})""",
)

oracle(
    "dq_rule_sets",
    "version_columns",
    """
SELECT o_orderkey AS run_id, CAST(shapes.position AS BIGINT) AS position, family,
       check_name AS "check", shapes.column_name AS "column",
       CASE WHEN threshold = -2 THEN CAST(o_custkey AS DOUBLE) ELSE threshold END AS threshold,
       allowed AS "values",
       CASE WHEN problem <> '' THEN problem
            WHEN check_name <> 'row_duplicates' AND v.column_name IS NULL
            THEN 'column ''' || shapes.column_name || ''' not found' ELSE '' END AS problem
FROM orders
JOIN (VALUES
    (0, 1, 'constraint', 'completeness', 'red bolt', 1.0, '', ''),
    (0, 2, 'constraint', 'min', 'old_gear', -2.0, '', ''),
    (0, 3, 'constraint', 'allowed_values', '', -1.0, 'a', 'no column named'),
    (0, 4, 'duplicates', 'column_duplicates', 'red bolt', -1.0, '', ''),
    (1, 1, 'regex', 'email', 'hot ring', -1.0, '', ''),
    (1, 2, 'regex', 'email', 'new gear', -1.0, '', ''),
    (1, 3, 'regex', 'ip', 'no such', -1.0, '', ''),
    (1, 4, 'duplicates', 'row_duplicates', '', -1.0, '', ''),
    (2, 1, 'constraint', 'completeness', 'blue_bolt', 1.5, '', 'threshold must be between 0 and 1'),
    (2, 2, 'constraint', 'max', 'blue_bolt', -1.0, '', 'threshold must be a finite number'),
    (2, 3, 'regex', 'phone', 'blue_bolt', -1.0, '', ''),
    (2, 4, 'regex', 'word', 'blue_bolt', -1.0, '', 'unknown pattern ''word'''),
    (3, 1, 'constraint', 'allowed_values', 'small ring', -1.0, ' A ||B', ''),
    (3, 2, 'constraint', 'allowed_values', 'small ring', -1.0, ' ',
     'at least one allowed value is needed'),
    (3, 3, 'constraint', 'unique', 'small ring', -1.0, '', 'unknown check ''unique'''),
    (3, 4, 'regex', 'date', 'small ring', -1.0, '', ''),
    (3, 5, 'duplicates', 'column_duplicates', 'small ring', -1.0, '', ''),
    (4, 1, 'constraint', 'allowed_values', 'small ring', -1.0, 'a|b', ''),
    (4, 2, 'constraint', 'completeness', 'hot ring', -1.0, '', 'threshold must be between 0 and 1'),
    (4, 3, 'regex', 'email', 'hot ring', -1.0, '', ''),
    (4, 4, 'duplicates', 'column_duplicates', 'old_gear', -1.0, '', ''),
    (4, 5, 'duplicates', 'row_duplicates', '', -1.0, '', ''),
    (5, 1, 'unreadable', 'unreadable', '', -1.0, '', 'the rule set is no JSON object')
) AS shapes(kind, position, family, check_name, column_name, threshold, allowed, problem)
  ON kind = o_orderkey % 6
LEFT JOIN version_columns AS v
  ON v.version_id = o_orderkey AND v.column_name = shapes.column_name""",
)

# --- results -----------------------------------------------------------------------------------


def _mapped(status: str) -> str:
    word = f"trim(lower(coalesce({status}, '')))"
    return f"""CASE WHEN {word} IN ('réussi', 'pass', 'passed') THEN 'passed'
            WHEN {word} IN ('échoué', 'fail', 'failed') THEN 'failed'
            WHEN {word} IN ('ignoré', 'skipped') THEN 'skipped' ELSE 'unknown' END"""


_WORD = "lower(coalesce(status, ''))"
_SUCCESS = f"{_WORD} IN ('réussi', 'réussie', 'succès', 'success', 'pass', 'passed')"
_FAILURE = f"{_WORD} IN ('échoué', 'échouée', 'échec', 'failed', 'fail')"

oracle(
    "dq_standardise",
    "checks",
    f"""
SELECT dag_run_id AS run_id, version_id,
       CASE WHEN rule_type LIKE 'regex%' THEN 'regex' ELSE rule_type END AS rule_type,
       coalesce(column_name, '') AS column_name, {_mapped("status")} AS status, error_count,
       coalesce(ratio, '0/0') AS ratio,
       CASE WHEN rule_type LIKE 'regex%' THEN '' ELSE example END AS examples
FROM checks""",
)

oracle(
    "dq_ratio_parse",
    "checks",
    f"""
SELECT md5(CAST(version_id AS VARCHAR)) AS dag_run_uuid, rule_type AS check_type,
       coalesce(column_name, '') AS column_name, {_mapped("status")} AS status, error_count,
       round(CASE WHEN ratio IN ('junk', '', '1/2/3') OR ratio IS NULL THEN 0.0
            WHEN ratio = '0.5' THEN 0.5
            WHEN split_part(ratio, '/', 2) = '0' THEN 0.0
            ELSE CAST(split_part(ratio, '/', 1) AS DOUBLE)
                 / CAST(split_part(ratio, '/', 2) AS DOUBLE) END, 6) AS ratio,
       CAST({_mapped("status")} = 'failed' AS BIGINT) AS alert,
       '["' || example || '"]' AS examples
FROM checks JOIN orders ON o_orderkey = version_id""",
)

oracle(
    "dq_summary",
    "checks",
    """
SELECT *,
       '✅ ' || success || '/' || total || ' (' || printf('%.1f', success_rate) || '%) | ❌ '
       || failed || ' | ⚠️ ' || warnings AS summary_text,
       CASE WHEN failed = 0 THEN 'DQ_SUCCESS' ELSE 'DQ_WARNING' END AS fallback_tag
FROM (
    SELECT version_id, total, success, failed, total - success - failed AS warnings,
           CAST(printf('%.1f', success / total * 100) AS DOUBLE) AS success_rate
    FROM counts
)""",
    f"""
counts AS (
    SELECT version_id, count(*) AS total, count(*) FILTER (WHERE {_SUCCESS}) AS success,
           count(*) FILTER (WHERE {_FAILURE}) AS failed
    FROM checks GROUP BY version_id
)""",
)

oracle(
    "dq_report",
    "checks",
    """
SELECT *, CASE WHEN total = 0 THEN 'N/A'
               WHEN (success / total * 100 * 4) % 1 = 0
               THEN printf('%.1f', round(success / total * 100, 1)) || '%'
               ELSE printf('%.1f', success / total * 100) || '%' END AS rate,
       CASE WHEN failed > 0 THEN 'red' ELSE 'green' END AS colour
FROM counts""",
    f"""
counts AS (
    SELECT version_id, count(*) FILTER (WHERE status <> '') AS total,
           count(*) FILTER (WHERE {_mapped("status")} = 'passed') AS success,
           count(*) FILTER (WHERE {_mapped("status")} = 'failed') AS failed
    FROM checks GROUP BY version_id
)""",
)

oracle(
    "dq_tags",
    "checks",
    """
SELECT rule_type,
       CASE WHEN lower(status) IN ('réussi', 'success', 'pass', 'succès', 'passed')
                THEN 'DQ_SUCCESS'
            WHEN lower(status) IN ('échoué', 'failed', 'fail', 'echec') THEN 'DQ_FAILED'
            ELSE 'DQ_WARNING' END AS tag,
       count(*) AS checks
FROM checks GROUP BY ALL""",
)

for _key, _wanted in (
    ("dq_json_roundtrip", ""),
    ("dq_stream_pickup", ""),
    ("dq_one_run", " WHERE dag_run_id = (SELECT min(dag_run_id) FROM checks)"),
):
    oracle(
        _key,
        "checks",
        """
SELECT dag_run_id, CAST(version_id AS VARCHAR) AS dataset_version_id,
       CAST(year(o_orderdate) AS VARCHAR) AS execution_date, rule_type,
       coalesce(column_name, '') AS column_name, coalesce(status, '') AS status, error_count,
       coalesce(ratio, '') AS ratio, example AS examples
FROM checks JOIN orders ON o_orderkey = version_id"""
        + _wanted,
    )

# --- datasets and profiles ---------------------------------------------------------------------

oracle("ds_preview", "", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")

_LINEITEM = [
    ("l_orderkey", "numeric"),
    ("l_partkey", "numeric"),
    ("l_suppkey", "numeric"),
    ("l_linenumber", "numeric"),
    ("l_quantity", "numeric"),
    ("l_extendedprice", "numeric"),
    ("l_discount", "numeric"),
    ("l_tax", "numeric"),
    ("l_returnflag", "string"),
    ("l_linestatus", "string"),
    ("l_shipdate", "datetime"),
]


def _stats(position: int, column: str, kind: str) -> str:
    numbers = [
        f"CAST(round({f}({column}), 4) AS DOUBLE)" if kind == "numeric" else "CAST(-1 AS DOUBLE)"
        for f in ("min", "max", "avg", "stddev_samp")
    ]
    return f"""
SELECT CAST({position} AS BIGINT) AS position, '{column}' AS column_name, '{kind}' AS data_type,
       count(*) AS rows_count, {numbers[0]} AS min, {numbers[1]} AS max, {numbers[2]} AS mean,
       {numbers[3]} AS std
FROM lineitem"""


oracle(
    "profile_numeric",
    "",
    " UNION ALL ".join(_stats(i, c, k) for i, (c, k) in enumerate(_LINEITEM)),
)

_ORDERS = [
    "o_orderkey",
    "o_custkey",
    "o_orderstatus",
    "o_totalprice",
    "o_orderdate",
    "o_orderpriority",
]
oracle(
    "profile_distinct",
    "",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, "
        "CAST(1 AS BIGINT) AS close FROM orders"
        for c in _ORDERS
    ),
)


def _sample_hash(table: str, column: str) -> str:
    return f"""
SELECT '{column}' AS column_name,
       sha256(coalesce(string_agg(value, chr(31) ORDER BY digest, value), '')) AS sample_hash
FROM (SELECT value, md5(value) AS digest
      FROM (SELECT DISTINCT CAST({column} AS VARCHAR) AS value FROM {table}
            WHERE {column} IS NOT NULL)
      ORDER BY digest, value LIMIT 20)"""


oracle("profile_sample_hash", "", " UNION ALL ".join(_sample_hash("orders", c) for c in _ORDERS))

_DOCUMENTS = [
    ("doc_id", "numeric"),
    ("text", "string"),
    ("lang", "string"),
    ("source", "string"),
    ("n_chars", "numeric"),
]


def _numbers(column: str, kind: str) -> str:
    return ", ".join(
        (f"CAST(round({f}({column}), 4) AS DOUBLE)" if kind == "numeric" else "CAST(-1 AS DOUBLE)") + f" AS {name}"
        for f, name in (("min", "min"), ("max", "max"), ("avg", "mean"), ("stddev_samp", "std"))
    )


def _signature(table: str, columns: list[tuple[str, str]]) -> str:
    structure = ",".join(sorted(f"{c}:{k}" for c, k in columns))
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS dtype, count(*) AS rows_count, {_numbers(c, k)} FROM {table}"
        for c, k in columns
    )
    hashes = " UNION ALL ".join(_sample_hash(table, c) for c, _ in columns)
    return f"""
SELECT '{table}' AS name_base, CAST({len(columns)} AS BIGINT) AS columns_count, rows_count,
       sha256('{structure}') AS structure_hash, column_name, dtype, min, max, mean, std,
       CAST(1 AS BIGINT) AS close, sample_hash
FROM ({rows}) JOIN ({hashes}) USING (column_name)"""


oracle(
    "profile_signature",
    "",
    _signature("lineitem", _LINEITEM) + " UNION ALL " + _signature("documents", _DOCUMENTS),
)
oracle(
    "profile_listing",
    "",
    " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, '{k}' AS data_type, count({c}) AS filled FROM documents"
        for i, (c, k) in enumerate(_DOCUMENTS)
    ),
)
_ORDER_KINDS = ["numeric", "numeric", "string", "numeric", "datetime", "string"]
oracle(
    "profile_merged",
    "",
    " UNION ALL ".join(
        f"""
SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, '{k}' AS data_type, count(*) AS rows_count,
       {_numbers(c, k)}, count(DISTINCT {c}) AS distinct_count, CAST(1 AS BIGINT) AS close FROM orders"""
        for i, (c, k) in enumerate(zip(_ORDERS, _ORDER_KINDS, strict=True))
    ),
)
oracle(
    "ds_content",
    "",
    """
SELECT CAST(c_nationkey AS BIGINT) AS nation, CAST(sum(strlen(c_name) + 1) AS BIGINT) AS length,
       sha256(string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10)) AS hash
FROM customer GROUP BY c_nationkey""",
)
oracle(
    "ds_register",
    "version_columns",
    """
SELECT left(sha256('p7|/data/' || o_orderkey || '.csv|' || sha256(CAST(o_orderkey AS VARCHAR))), 32) AS dataset_id,
       o_orderkey || '.csv' AS name, '/data/' || o_orderkey || '.csv' AS file_path,
       sha256(CAST(o_orderkey AS VARCHAR)) AS hash, columns_list, 'ann' AS owner_employee_id, 'p7' AS project_id,
       'orders of a customer' AS description
FROM orders JOIN (SELECT version_id, string_agg(column_name, '|' ORDER BY position) AS columns_list
                  FROM version_columns GROUP BY version_id) ON version_id = o_orderkey""",
)
oracle(
    "ds_signature_rows",
    "signatures",
    """
SELECT left(sha256(dataset_id || '|' || structure_hash || '|' || CAST(o_orderdate AS VARCHAR)), 32) AS id,
       dataset_id, structure_hash, name_base, columns, columns_count, CAST(o_custkey AS BIGINT) AS rows_count,
       'v1' AS algo_version, o_orderdate AS created_at
FROM (SELECT dataset_id, min(name_base) AS name_base, count(*) AS columns_count,
             sha256(string_agg(column_name || ':' || data_type, ',' ORDER BY column_name || ':' || data_type))
                 AS structure_hash,
             string_agg(column_name || ':' || data_type || ':' || sample_hash, '|'
                        ORDER BY column_name || ':' || data_type || ':' || sample_hash) AS columns
      FROM signatures GROUP BY dataset_id) JOIN orders ON o_orderkey = dataset_id""",
)
# The forms of each type, as in the types of CSV columns.
_FORMS = {
    "int": ("^[+-]?[0-9]{1,10}$", "INTEGER"),
    "bigint": ("^[+-]?[0-9]{1,19}$", "BIGINT"),
    "double": ("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$", "DOUBLE"),
    "date": ("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "DATE"),
    "timestamp": ("^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2})?$", "TIMESTAMP"),
    "boolean": ("^(true|false)$", "BOOLEAN"),
}


def _misfits(column: str) -> str:
    text = f"trim(CAST({column} AS VARCHAR))"
    counts = ", ".join(
        f"count(*) FILTER (WHERE {column} IS NOT NULL AND NOT (regexp_matches({text}, '{form}')"
        f" AND TRY_CAST({text} AS {kind}) IS NOT NULL)) AS not_{name}"
        for name, (form, kind) in _FORMS.items()
    )
    return f"SELECT '{column}' AS column_name, count({column}) AS filled, {counts} FROM contacts"


oracle(
    "ds_csv_types",
    "contacts",
    "SELECT *, CASE "
    + " ".join(f"WHEN filled > 0 AND not_{name} = 0 THEN '{name}'" for name in _FORMS)
    + " ELSE 'string' END AS type FROM ("
    + " UNION ALL ".join(_misfits(c) for c in ("c_custkey", "email", "phone", "postal_code", "digits", "word", "day", "ip"))
    + ")",
)

oracle(
    "profile_latest",
    "versions",
    """
SELECT c_custkey AS dataset_id, CAST(id IS NOT NULL AS BIGINT) AS has_signature,
       coalesce(id, -1) AS signature_id,
       coalesce(left(md5(CAST(id AS VARCHAR)), 16), '') AS signature_hash,
       coalesce(CAST(created_at AS VARCHAR), '') AS signature_date
FROM customer LEFT JOIN (
    SELECT *, row_number() OVER (PARTITION BY dataset_id
                                 ORDER BY created_at DESC, id DESC) AS place
    FROM versions WHERE version_number % 3 <> 1
) ON dataset_id = c_custkey AND place = 1""",
)

# --- similarity --------------------------------------------------------------------------------

# Common subsequence of s and t by the usual table, one recursion step per character of t:
# row is the line of the table for s against the characters of t read so far. A cell is the
# larger of the one above and the one to the left, where the diagonal may have added a match.
_LCS = """
lcs_rows AS (
    SELECT s, t, CAST(0 AS BIGINT) AS i,
           list_transform(range(len(s) + 1), lambda k: CAST(0 AS BIGINT)) AS cells
    FROM lcs_pairs
    UNION ALL
    SELECT s, t, i + 1,
           list_transform(range(len(s) + 1), lambda k: list_max(
               list_transform(range(k + 1), lambda j:
                   greatest(cells[j + 1],
                            CASE WHEN j > 0 AND substr(s, j, 1) = substr(t, i + 1, 1)
                                 THEN cells[j] + 1 ELSE 0 END))))
    FROM lcs_rows WHERE i < len(t)
),
lcs AS (SELECT s, t, cells[len(s) + 1] AS n FROM lcs_rows WHERE i = len(t))"""

_PART_TEXT = """
texts AS (
    SELECT p_partkey, p_name AS x, lower(p_type) || ' ' || lower(p_brand) AS y FROM part
)"""
oracle(
    "text_indel_ratio",
    "",
    """
SELECT p_partkey, round(2.0 * n / (len(x) + len(y)), 6) AS ratio
FROM texts JOIN lcs ON s = x AND t = y""",
    f"{_PART_TEXT}, lcs_pairs AS (SELECT DISTINCT x AS s, y AS t FROM texts), {_LCS}",
    recursive=True,
)

# Best window of the longer string, for the pairs of partial_pairs(x, y).
_PARTIAL = f"""
directions AS (
    SELECT DISTINCT x, y, x AS s, y AS l FROM partial_pairs WHERE len(x) <= len(y)
    UNION SELECT DISTINCT x, y, y AS s, x AS l FROM partial_pairs WHERE len(y) <= len(x)
),
windows AS (
    SELECT x, y, s, substr(l, CAST(greatest(1, e - len(s) + 1) AS BIGINT),
               CAST(least(e, len(l)) - greatest(1, e - len(s) + 1) + 1 AS BIGINT)) AS t
    FROM (SELECT *, unnest(range(1, len(s) + len(l))) AS e FROM directions)
),
lcs_pairs AS (SELECT DISTINCT s, t FROM windows),
{_LCS},
partials AS (
    SELECT x, y, max(2.0 * n / (len(s) + len(t))) AS ratio
    FROM windows JOIN lcs USING (s, t) GROUP BY x, y
)"""
oracle(
    "text_partial_ratio",
    "",
    "SELECT p_partkey, round(ratio, 6) AS ratio FROM texts JOIN partials USING (x, y)",
    f"{_PART_TEXT}, partial_pairs AS (SELECT DISTINCT x, y FROM texts), {_PARTIAL}",
    recursive=True,
)

# All dataset pairs of a project, scored one by one.
_SCORED = f"""
sizes AS (
    SELECT project_id, dataset_id, name_base, count(*) AS n,
           sha256('{{"name_base":"' || name_base || '","columns":[' || string_agg(
               '{{"column_name":"' || column_name || '","data_type":"' || data_type
               || '","sample_hash":"' || sample_hash || '"}}', ',' ORDER BY column_name) || ']}}') AS profile_id
    FROM signatures GROUP BY project_id, dataset_id, name_base
),
names AS (SELECT DISTINCT name_base FROM signatures),
partial_pairs AS (SELECT a.name_base AS x, b.name_base AS y FROM names a, names b),
{_PARTIAL},
shared AS (
    SELECT a.dataset_id AS a, b.dataset_id AS b, count(*) AS common,
           count(*) FILTER (WHERE a.data_type = b.data_type) AS same_type,
           count(*) FILTER (WHERE a.sample_hash = b.sample_hash) AS same_sample
    FROM signatures a JOIN signatures b
      ON a.project_id = b.project_id AND a.column_name = b.column_name
         AND a.dataset_id <> b.dataset_id
    GROUP BY a.dataset_id, b.dataset_id
),
scored AS (
    SELECT *, 0.60 * (0.7 * jaccard + 0.3 * type_agreement) + 0.30 * name_similarity
              + sample_agreement * 0.10 AS score
    FROM (
        SELECT sa.project_id, a, b, sa.profile_id AS profile_a, sb.profile_id AS profile_b,
               CAST(common AS DOUBLE) / (sa.n + sb.n - common) AS jaccard,
               CAST(same_type AS DOUBLE) / common AS type_agreement,
               CAST(same_sample AS DOUBLE) / common AS sample_agreement,
               ratio AS name_similarity, common = sa.n AS a_in_b, common = sb.n AS b_in_a
        FROM shared JOIN sizes sa ON a = sa.dataset_id JOIN sizes sb ON b = sb.dataset_id
        JOIN partials ON x = sa.name_base AND y = sb.name_base
    )
),
accepted AS (
    SELECT *, score >= CASE WHEN b_in_a THEN 0.45 WHEN jaccard > 0.8 THEN 0.55 ELSE 0.60 END
               AS accept_b_for_a,
           score >= CASE WHEN a_in_b THEN 0.45 WHEN jaccard > 0.8 THEN 0.55 ELSE 0.60 END
               AS accept_a_for_b
    FROM scored
)"""
oracle(
    "sim_scores",
    "signatures",
    """
SELECT DISTINCT project_id, profile_a, profile_b, round(jaccard, 6) AS jaccard,
       round(type_agreement, 6) AS type_agreement, round(sample_agreement, 6) AS sample_agreement,
       round(name_similarity, 6) AS name_similarity, round(score, 6) AS score,
       CAST(accept_a_for_b AS BIGINT) AS accept_a_for_b,
       CAST(accept_b_for_a AS BIGINT) AS accept_b_for_a
FROM accepted WHERE profile_a < profile_b AND (accept_a_for_b OR accept_b_for_a)""",
    _SCORED,
    recursive=True,
)
oracle(
    "sim_parents",
    "signatures published",
    """
SELECT a AS dataset_id, b AS parent_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place
      FROM accepted JOIN published ON b = dataset_id WHERE score >= 0.60)
WHERE place = 1""",
    _SCORED,
    recursive=True,
)
_RANKED = f"""{_SCORED},
ranked AS (
    SELECT a AS dataset_id, b AS parent_id, score,
           row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank
    FROM accepted JOIN published ON b = dataset_id WHERE accept_b_for_a
)"""
oracle(
    "sim_suggestions",
    "signatures published",
    "SELECT dataset_id, parent_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5",
    _RANKED,
    recursive=True,
)
oracle(
    "sim_descriptions",
    "signatures published descriptions",
    """
SELECT dataset_id, column_name, description, parent_id AS source_dataset,
       CAST(printf('%.3f', score) AS DOUBLE) AS similarity_score
FROM (SELECT ranked.*, column_name, description,
             row_number() OVER (PARTITION BY dataset_id, column_name ORDER BY rank) AS place
      FROM ranked JOIN descriptions ON version_id = parent_id WHERE rank <= 5)
WHERE place = 1""",
    _RANKED,
    recursive=True,
)

# --- columns -----------------------------------------------------------------------------------

# Every child column against every column of its parent version.
_MATCH = f"""
lcs_pairs AS (
    SELECT DISTINCT lower(c.column_name) AS s, lower(k.column_name) AS t
    FROM child_columns c JOIN known_columns k ON k.version_id = c.parent_version_id
),
{_LCS},
usable AS (SELECT * FROM known_columns WHERE logical_id IS NOT NULL),
fuzzy AS (
    SELECT version_id, column_name, logical_id AS fuzzy_id
    FROM (
        SELECT c.version_id, c.column_name, u.logical_id,
               row_number() OVER (PARTITION BY c.version_id, c.column_name
                                  ORDER BY 2.0 * n / (len(s) + len(t)) DESC, u.position) AS place
        FROM child_columns c JOIN usable u ON u.version_id = c.parent_version_id
        JOIN lcs ON s = lower(c.column_name) AND t = lower(u.column_name)
        WHERE n * 200 >= 82 * (len(s) + len(t))
    )
    WHERE place = 1
),
matched AS (
    SELECT c.*,
           left(sha256(c.qualified_name || '.' || c.column_name), 32) AS fresh_id,
           coalesce(existing_id, byname.logical_id, bypos.logical_id, fuzzy_id,
                    left(sha256(c.qualified_name || '.' || c.column_name), 32)) AS logical_id,
           CASE WHEN existing_id IS NOT NULL THEN 'existing'
                WHEN byname.logical_id IS NOT NULL THEN 'exact_name'
                WHEN bypos.logical_id IS NOT NULL THEN 'position'
                WHEN fuzzy_id IS NOT NULL THEN 'fuzzy' ELSE 'new' END AS strategy
    FROM child_columns c
    LEFT JOIN usable byname ON byname.version_id = c.parent_version_id
                               AND byname.column_name = c.column_name
    LEFT JOIN usable bypos ON bypos.version_id = c.parent_version_id
                              AND bypos.position = c.position
    LEFT JOIN fuzzy ON fuzzy.version_id = c.version_id AND fuzzy.column_name = c.column_name
)"""
_MATCH_TABLES = "child_columns known_columns lineage"
oracle(
    "col_match",
    _MATCH_TABLES,
    "SELECT version_id, column_name, logical_id, strategy FROM matched",
    _MATCH,
    recursive=True,
)
oracle(
    "col_match_exclusive",
    _MATCH_TABLES,
    """
SELECT version_id, column_name,
       CASE WHEN place > 1 THEN fresh_id ELSE logical_id END AS logical_id,
       CASE WHEN place > 1 THEN 'new' ELSE strategy END AS strategy
FROM (
    SELECT *, row_number() OVER (
        PARTITION BY version_id, logical_id
        ORDER BY CASE strategy WHEN 'existing' THEN 1 WHEN 'exact_name' THEN 2
                               WHEN 'position' THEN 3 WHEN 'fuzzy' THEN 4 ELSE 5 END,
                 position) AS place
    FROM matched
)""",
    _MATCH,
    recursive=True,
)
# Pairs in their order, taken one by one: a list of ends that are gone grows along the pairs of a version.
oracle(
    "col_assign",
    _MATCH_TABLES,
    """
SELECT c.version_id, c.column_name, coalesce(f.logical_id, g.logical_id, left(sha256(c.qualified_name || '.' || c.column_name), 32))
           AS logical_id,
       CASE WHEN f.logical_id IS NOT NULL THEN 'existing' ELSE coalesce(g.strategy, 'new') END AS strategy
FROM child_columns c
LEFT JOIN firsts f ON f.version_id = c.version_id AND f.column_name = c.column_name
LEFT JOIN taken g ON g.version_id = c.version_id AND g.column_name = c.column_name""",
    f"""{_MATCH},
firsts AS (
    SELECT version_id, existing_id AS logical_id, arg_min(column_name, position) AS column_name
    FROM child_columns WHERE existing_id IS NOT NULL GROUP BY version_id, existing_id
),
open_columns AS (SELECT * FROM child_columns WHERE existing_id IS NULL AND parent_version_id IS NOT NULL),
offers AS (
    SELECT c.version_id, c.column_name, u.logical_id, 1 AS rank, -1.0 AS ratio, c.position, u.position AS place
    FROM open_columns c JOIN usable u ON u.version_id = c.parent_version_id AND u.column_name = c.column_name
    UNION ALL
    SELECT c.version_id, c.column_name, u.logical_id, 2, -1.0, c.position, u.position
    FROM open_columns c JOIN usable u ON u.version_id = c.parent_version_id AND u.position = c.position
    UNION ALL
    SELECT c.version_id, c.column_name, u.logical_id, 3, -2.0 * n / (len(s) + len(t)), c.position, u.position
    FROM open_columns c JOIN usable u ON u.version_id = c.parent_version_id
    JOIN lcs ON s = lower(c.column_name) AND t = lower(u.column_name)
    WHERE n * 200 >= 82 * (len(s) + len(t))
),
ordered AS (
    SELECT version_id, list([column_name, logical_id, CAST(rank AS VARCHAR)]
                            ORDER BY rank, ratio, position, place, logical_id) AS pairs
    FROM offers o
    WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.version_id = o.version_id AND f.logical_id = o.logical_id)
    GROUP BY version_id
),
walked AS (
    SELECT version_id, list_reduce(list_prepend(CAST([] AS VARCHAR[]), pairs), lambda gone, x:
        CASE WHEN list_contains(gone, 'c' || x[1]) OR list_contains(gone, 'p' || x[2]) THEN gone
             ELSE list_concat(gone, ['c' || x[1], 'p' || x[2], 'r' || x[3]]) END) AS gone
    FROM ordered
),
taken AS (
    SELECT version_id, substr(gone[3 * i + 1], 2) AS column_name, substr(gone[3 * i + 2], 2) AS logical_id,
           CASE gone[3 * i + 3] WHEN 'r1' THEN 'exact_name' WHEN 'r2' THEN 'position' ELSE 'fuzzy' END AS strategy
    FROM (SELECT version_id, gone, unnest(range(len(gone) // 3)) AS i FROM walked)
)""",
    recursive=True,
)
oracle(
    "col_match_counts",
    _MATCH_TABLES,
    """
SELECT version_id, count(*) AS columns, count(*) FILTER (WHERE known) AS propagated,
       count(DISTINCT logical_id) - count(*) FILTER (WHERE known) AS new_ids
FROM (SELECT m.*, EXISTS (SELECT 1 FROM known_columns k WHERE k.version_id = m.parent_version_id
                          AND k.logical_id = m.logical_id) AS known
      FROM matched m)
GROUP BY version_id""",
    _MATCH,
    recursive=True,
)

oracle(
    "col_parent_lookup",
    "version_columns",
    """
SELECT dataset_id, column_name FROM names
UNION ALL
SELECT o_orderkey, p.column_name
FROM orders JOIN prefixed p ON p.owner_name = 'ds.v' || o_orderkey
WHERE o_orderkey NOT IN (SELECT dataset_id FROM names)""",
    """
names AS (SELECT version_id AS dataset_id, column_name FROM version_columns WHERE flag <> 'A'),
prefixed AS (
    SELECT 'ds.v' || version_id AS owner_name, column_name FROM version_columns
)""",
)

oracle(
    "col_edges",
    "version_columns versions",
    """
SELECT c.external_id AS child, p.external_id AS parent, c.column_name
FROM named c JOIN versions v ON v.id = c.version_id
JOIN named p ON p.version_id = v.parent_version_id AND p.column_name = c.column_name
WHERE c.external_id <> p.external_id AND c.external_id NOT LIKE '-col-%'
  AND p.external_id NOT LIKE '-col-%'""",
    """
named AS (
    SELECT version_id, column_name,
           CASE WHEN quantity = 7 THEN '-col-' || position
                WHEN quantity <> 9 THEN md5(version_id || '|' || column_name) END AS external_id
    FROM version_columns
)""",
)

_LINEAGE = f"""{_MATCH},
linked AS (
    SELECT m.version_id AS dataset_version_id, m.column_name, m.logical_id AS logical_column_id,
           CASE WHEN m.column_name IN (SELECT l.column_name FROM lineage l
                                       WHERE l.dataset_version_id = m.parent_version_id)
                THEN (SELECT min(l.id) FROM lineage l
                      WHERE l.dataset_version_id = m.parent_version_id
                        AND l.logical_column_id = m.logical_id) END AS parent_column_id
    FROM matched m
)"""
oracle(
    "col_lineage",
    f"{_MATCH_TABLES} version_columns",
    """
SELECT left(sha256('{"version_id":"' || dataset_version_id || '","column_name":"' || linked.column_name || '"}'), 32) AS id,
       dataset_version_id, linked.column_name, logical_column_id, coalesce(parent_column_id, '') AS parent_column_id,
       type AS data_type
FROM linked JOIN version_columns v ON v.version_id = dataset_version_id AND v.column_name = linked.column_name""",
    _LINEAGE,
    recursive=True,
)

# Walk from every node to its ancestors; the walk of a cyclic node never meets a root.
_WALK = """
up AS (
    SELECT id, parent_id, rank_1, rank_2 FROM nodes
    WHERE parent_id IN (SELECT id FROM nodes) OR parent_id IS NULL
    UNION ALL
    SELECT id, NULL, rank_1, rank_2 FROM nodes
    WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM nodes)
),
walk AS (
    SELECT id AS node, id AS ancestor, parent_id, CAST(0 AS BIGINT) AS steps, [id] AS seen FROM up
    UNION ALL
    SELECT node, up.id, up.parent_id, steps + 1, seen || [up.id]
    FROM walk JOIN up ON up.id = walk.parent_id WHERE NOT list_contains(seen, up.id)
),
rooted AS (
    SELECT node, ancestor AS root_id, steps + 1 AS depth FROM walk WHERE parent_id IS NULL
),
newest AS (
    SELECT ancestor, node AS latest_id
    FROM (SELECT w.ancestor, w.node,
                 row_number() OVER (PARTITION BY w.ancestor
                                    ORDER BY w.steps DESC, u.rank_1 DESC, u.rank_2 DESC) AS place
          FROM walk w JOIN rooted r ON r.node = w.node JOIN up u ON u.id = w.node)
    WHERE place = 1
)"""
oracle(
    "col_history",
    _MATCH_TABLES,
    """
SELECT id, coalesce(root_id, '') AS root_id, coalesce(depth, -1) AS depth,
       CASE WHEN depth IS NULL THEN '' ELSE latest_id END AS latest_id,
       CAST(depth IS NULL AS BIGINT) AS is_cyclic
FROM up LEFT JOIN rooted ON rooted.node = id LEFT JOIN newest ON newest.ancestor = id""",
    f"""{_LINEAGE},
nodes AS (
    SELECT md5(dataset_version_id || '|' || column_name) AS id, parent_column_id AS parent_id,
           0 AS rank_1, md5(dataset_version_id || '|' || column_name) AS rank_2
    FROM linked
),
{_WALK}""",
    recursive=True,
)

# --- versions ----------------------------------------------------------------------------------

_CHAIN = f"""
nodes AS (
    SELECT id, parent_version_id AS parent_id, version_number AS rank_1, id AS rank_2 FROM versions
),
{_WALK}"""
oracle(
    "version_chain",
    "versions",
    """
SELECT id, coalesce(root_id, -1) AS root_id, coalesce(depth, -1) AS depth,
       CASE WHEN depth IS NULL THEN -1 ELSE latest_id END AS latest_id,
       CAST(depth IS NULL AS BIGINT) AS is_cyclic
FROM up LEFT JOIN rooted ON rooted.node = id LEFT JOIN newest ON newest.ancestor = id""",
    _CHAIN,
    recursive=True,
)

ORACLES["version_chain_delta"] = ORACLES["version_chain"]

_NUMBERED = """
own AS (
    SELECT dataset_id, max(version_number) AS highest,
           max(version_number) FILTER (WHERE external_id IS NOT NULL) AS published
    FROM versions GROUP BY dataset_id
),
numbered AS (
    SELECT p.dataset_id, p.parent_version_id,
           CAST(CASE WHEN v.id IS NOT NULL
                     THEN greatest(v.version_number + 1, coalesce(own.published, 0) + 1)
                     ELSE coalesce(own.highest, 0) + 1 END AS BIGINT) AS next_version
    FROM pushes p LEFT JOIN versions v ON v.id = p.parent_version_id
    LEFT JOIN own ON own.dataset_id = p.dataset_id
)"""
oracle(
    "version_next",
    "versions pushes",
    """
SELECT dataset_id, next_version, coalesce(depth, 0) + 1 AS process_version,
       'Reupload v' || (coalesce(depth, 0) + 1) AS process_name
FROM numbered LEFT JOIN rooted ON node = parent_version_id""",
    f"{_CHAIN}, {_NUMBERED}",
    recursive=True,
)
oracle(
    "version_process",
    "versions",
    """
SELECT parent_version_id || '_to_' || id AS process_id,
       'Reupload v' || (coalesce(depth, 0) + 1) AS process_name,
       'TRANSFORMATION' AS operation_type, parent_version_id AS input_version_id,
       id AS output_version_id, CAST(dataset_id AS VARCHAR) AS created_by,
       CAST(version_number * 10 AS BIGINT) AS execution_time_ms, 'SUCCESS' AS status,
       '{"parent_qn":"v' || parent_version_id || '"}' AS metadata
FROM versions LEFT JOIN rooted ON node = parent_version_id
WHERE parent_version_id IS NOT NULL""",
    _CHAIN,
    recursive=True,
)
oracle(
    "version_latest",
    "versions",
    """
SELECT l.dataset_id, l.id, CAST(l.version_number AS BIGINT) AS version_number,
       coalesce(p.id, -1) AS published_id, coalesce(p.external_id, '') AS external_id
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY version_number DESC) AS place
      FROM versions) l
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY dataset_id
                                        ORDER BY version_number DESC) AS place
           FROM versions WHERE external_id IS NOT NULL) p
  ON p.dataset_id = l.dataset_id AND p.place = 1
WHERE l.place = 1""",
)
oracle(
    "version_drafts",
    "versions pushes",
    """
SELECT n.dataset_id, n.next_version, CAST(d.id IS NOT NULL AS BIGINT) AS reuse_draft,
       coalesce(d.id, -1) AS draft_id,
       CASE WHEN d.id IS NULL THEN coalesce(f.id, -1) ELSE -1 END AS transfer_from
FROM numbered n
LEFT JOIN versions d ON d.dataset_id = n.dataset_id AND d.external_id IS NULL
                        AND d.version_number = n.next_version
LEFT JOIN (SELECT dataset_id, id, row_number() OVER (PARTITION BY dataset_id
                                                     ORDER BY version_number) AS place
           FROM versions WHERE external_id IS NULL) f
  ON f.dataset_id = n.dataset_id AND f.place = 1""",
    _NUMBERED,
)
oracle(
    "version_publish",
    "versions",
    """
SELECT id, 'new' || id AS external_id, 'Push depuis ' || dataset_id AS change_comment,
       CAST(version_number AS BIGINT) AS version_number
FROM versions WHERE external_id IS NULL""",
)
oracle(
    "version_edges",
    "versions",
    """
SELECT c.external_id AS child, p.external_id AS parent
FROM versions c JOIN versions p ON p.id = c.parent_version_id
WHERE c.external_id <> p.external_id""",
)
oracle(
    "version_names",
    "versions",
    """
SELECT id,
       CASE WHEN dataset_id % 2 = 0 THEN dataset_id || '_' ELSE '' END || md5(CAST(id AS VARCHAR))
       || CASE WHEN version_number > 1 THEN '_v' || version_number ELSE '' END
       || CASE WHEN external_id IS NULL THEN '_' || CAST(epoch(created_at) AS BIGINT) ELSE '' END
           AS qualified_name,
       CASE WHEN external_id IS NULL THEN CAST(-1 AS BIGINT) ELSE 1 END AS known
FROM versions""",
)

# --- descriptions ------------------------------------------------------------------------------

oracle(
    "desc_upsert",
    "descriptions edits",
    """
SELECT coalesce(d.version_id, e.version_id) AS version_id,
       coalesce(d.column_name, e.column_name) AS column_name,
       coalesce(last_text, description) AS description,
       coalesce(created_by, first_user) AS created_by,
       CASE WHEN d.version_id IS NULL THEN first_time ELSE TIMESTAMP '2024-01-01' END AS created_at,
       CASE WHEN n > 1 OR (n = 1 AND d.version_id IS NOT NULL) THEN last_user ELSE '' END
           AS updated_by,
       CASE WHEN n > 1 OR (n = 1 AND d.version_id IS NOT NULL)
            THEN CAST(last_time AS VARCHAR) ELSE '' END AS updated_at
FROM descriptions d
FULL JOIN (
    SELECT version_id, column_name, count(*) AS n,
           arg_min(user_id, place) AS first_user, arg_min(submitted_at, place) AS first_time,
           arg_max(user_id, place) AS last_user, arg_max(submitted_at, place) AS last_time,
           arg_max(trim(description), place) AS last_text
    FROM (SELECT *, row_number() OVER (PARTITION BY version_id, column_name
                                       ORDER BY submitted_at, seq) AS place
          FROM edits WHERE trim(description) <> '')
    GROUP BY version_id, column_name
) e ON d.version_id = e.version_id AND d.column_name = e.column_name""",
)
oracle(
    "desc_upsert_text",
    "",
    """
SELECT coalesce(s.conv_id, e.conv_id) AS version_id, coalesce(s.role, e.role) AS column_name,
       coalesce(last_text, first_text) AS description,
       CASE WHEN s.conv_id IS NOT NULL THEN '0' ELSE CAST(first_turn AS VARCHAR) END AS created_by,
       CASE WHEN n > 1 OR (n = 1 AND s.conv_id IS NOT NULL) THEN CAST(last_turn AS VARCHAR) ELSE '' END
           AS updated_by
FROM (SELECT conv_id, role, arg_min(text, turn) AS first_text FROM conversations
      WHERE conv_id % 2 = 0 GROUP BY conv_id, role) s
FULL JOIN (SELECT conv_id, role, count(*) AS n, arg_max(trim(text), turn) AS last_text,
                  min(turn) AS first_turn, max(turn) AS last_turn
           FROM conversations WHERE trim(text) <> '' GROUP BY conv_id, role) e
  ON s.conv_id = e.conv_id AND s.role = e.role""",
)
oracle(
    "desc_latest",
    "versions descriptions",
    """
SELECT l.dataset_id, version_id, CAST(version_number AS BIGINT) AS version_number, column_name,
       description, published
FROM (
    SELECT id, version_number, dataset_id, CAST(0 AS BIGINT) AS published
    FROM versions WHERE (dataset_id, version_number) IN
        (SELECT (dataset_id, max(version_number)) FROM versions GROUP BY dataset_id)
    UNION ALL
    SELECT id, version_number, dataset_id, 1
    FROM versions WHERE (dataset_id, version_number) IN
        (SELECT (dataset_id, max(version_number)) FROM versions
         WHERE external_id IS NOT NULL GROUP BY dataset_id)
) l JOIN descriptions ON version_id = l.id""",
)
oracle(
    "desc_coverage",
    "versions descriptions",
    """
SELECT dataset_id, CAST(count(version_id) > 0 AS BIGINT) AS has_descriptions,
       count(DISTINCT version_id) AS versions_count, count(version_id) AS total_descriptions
FROM versions LEFT JOIN descriptions ON version_id = id GROUP BY dataset_id""",
)
oracle(
    "desc_delete",
    "versions descriptions",
    """
SELECT version_id, count(*) AS n,
       CASE WHEN any_value(external_id) IS NULL THEN 'deleted' ELSE 'kept' END AS state
FROM descriptions JOIN versions ON id = version_id GROUP BY version_id""",
)
oracle(
    "desc_copy",
    "versions descriptions",
    """
SELECT id AS version_id, column_name, description, CAST(dataset_id AS VARCHAR) AS created_by,
       created_at
FROM versions JOIN descriptions d ON d.version_id = parent_version_id""",
)
oracle(
    "desc_inherited",
    "versions descriptions",
    """
SELECT dataset_id, v.id AS version_id, CAST(version_number AS BIGINT) AS version_number,
       string_agg(column_name || '=' || description, '|' ORDER BY column_name) AS descriptions
FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY version_number DESC) AS place
      FROM versions WHERE external_id IS NOT NULL) v
JOIN descriptions d ON d.version_id = v.id WHERE place <= 5
GROUP BY dataset_id, v.id, version_number""",
)
oracle(
    "desc_final",
    "version_columns",
    """
SELECT version_id, column_name,
       CASE WHEN flag = 'A' THEN type WHEN quantity > 30 THEN 'old ' || type
            ELSE 'Colonne ' || column_name END AS description
FROM version_columns""",
)
oracle(
    "desc_autofill",
    "version_columns edits",
    """
SELECT dataset_id, count(*) FILTER (WHERE blank AND offer IS NOT NULL) AS filled,
       string_agg(column_name || coalesce('=' || text, ''), '|'
                  ORDER BY column_name || coalesce('=' || text, '')) AS descriptions
FROM (
    SELECT *, CASE WHEN blank THEN coalesce(offer, given) ELSE given END AS text
    FROM (
        SELECT c.version_id AS dataset_id, c.column_name, flag <> 'N' AS blank, offer,
               CASE flag WHEN 'R' THEN ' ' WHEN 'N' THEN type END AS given
        FROM version_columns c
        LEFT JOIN (SELECT version_id, column_name, trim(max(description)) AS offer FROM edits
                   GROUP BY version_id, column_name HAVING trim(max(description)) <> '') o
          ON o.version_id = c.version_id AND o.column_name = c.column_name
    )
)
GROUP BY dataset_id""",
)

# --- classifications ---------------------------------------------------------------------------

_VALID = """
valid AS (
    SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id, column_name
                                 ORDER BY applied_at DESC, id DESC) AS place
    FROM class_log
    WHERE (entity_type = 'DATASET' AND classification IN ('PUBLIC', 'RESTRICTED'))
       OR (entity_type = 'COLUMN' AND classification IN ('PII', 'SENSITIVE'))
)"""
oracle(
    "class_valid",
    "class_log",
    """
SELECT id, entity_type, classification,
       CASE entity_type WHEN 'DATASET' THEN 'not a dataset class'
                        WHEN 'COLUMN' THEN 'not a column class'
                        ELSE 'unknown entity type' END AS problem
FROM class_log WHERE id NOT IN (SELECT id FROM valid)""",
    _VALID,
)
oracle(
    "class_history",
    "class_log",
    """
SELECT id, entity_type, entity_id, coalesce(column_name, '') AS column_name,
       CAST(place = 1 AS BIGINT) AS is_active
FROM valid""",
    _VALID,
)
oracle(
    "class_active",
    "class_log",
    """
SELECT entity_id AS dataset_id,
       coalesce(max(classification) FILTER (WHERE entity_type = 'DATASET'), '') AS security_class,
       coalesce(string_agg(column_name || '=' || classification, '|' ORDER BY column_name)
                FILTER (WHERE entity_type = 'COLUMN'), '') AS columns
FROM valid WHERE place = 1 GROUP BY entity_id""",
    _VALID,
)
oracle(
    "class_allowed",
    "class_log",
    """
SELECT c_custkey AS dataset_id, coalesce(classification, 'RESTRICTED') AS security_class,
       'PII|SENSITIVE' AS allowed
FROM customer
LEFT JOIN valid ON entity_id = c_custkey AND entity_type = 'DATASET' AND place = 1""",
    _VALID,
)
oracle(
    "class_allowed_strict",
    "class_log",
    """
SELECT c_custkey AS dataset_id, coalesce(classification, '') AS security_class,
       CASE WHEN classification IS NULL THEN '' ELSE 'PII|SENSITIVE' END AS allowed
FROM customer
LEFT JOIN valid ON entity_id = c_custkey AND entity_type = 'DATASET' AND place = 1""",
    _VALID,
)
oracle(
    "class_consistency",
    "class_log",
    """
SELECT l.entity_id AS dataset_id, CAST(l.id AS VARCHAR) AS column_name, l.classification,
       coalesce(v.classification, 'RESTRICTED') AS security_class
FROM class_log l
LEFT JOIN valid v ON v.entity_id = l.entity_id AND v.entity_type = 'DATASET' AND v.place = 1
WHERE l.classification NOT IN ('PII', 'SENSITIVE')""",
    _VALID,
)
oracle(
    "class_defaults",
    "class_log users",
    """
SELECT id, classification,
       CASE WHEN classification = 'RESTRICTED'
            THEN 'department=' || coalesce(department, 'UNKNOWN') || '|' ELSE '' END
       || CASE WHEN id % 10 = 1 THEN 'note=x' ELSE '' END
       || CASE WHEN id % 10 = 1 AND classification IN ('RESTRICTED', 'PUBLIC') THEN '|' ELSE '' END
       || CASE WHEN id % 10 = 0 THEN 'visibility_scope=TEAM'
               WHEN classification = 'RESTRICTED' THEN 'visibility_scope=DEPARTMENT'
               WHEN classification = 'PUBLIC' THEN 'visibility_scope=ENTERPRISE' ELSE '' END
           AS attributes
FROM class_log LEFT JOIN users ON employee_id = applied_by""",
)
_TAGS = """
tags AS (SELECT DISTINCT entity_id, classification AS tag FROM class_log),
changes AS (
    SELECT entity_id, CASE WHEN max(id) % 2 = 0 THEN 'PUBLIC' ELSE 'RESTRICTED' END AS tag
    FROM class_log WHERE entity_type = 'TABLE' GROUP BY entity_id
)"""
oracle(
    "class_replace",
    "class_log",
    """
SELECT entity_id, string_agg(tag, '|' ORDER BY tag) AS tags
FROM (SELECT * FROM tags
      WHERE tag NOT IN ('PUBLIC', 'RESTRICTED')
         OR entity_id NOT IN (SELECT entity_id FROM changes)
      UNION ALL SELECT * FROM changes)
GROUP BY entity_id""",
    _TAGS,
)
oracle(
    "class_tags",
    "class_log",
    """
SELECT entity_id, string_agg(tag, '|' ORDER BY tag) AS tags, count(*) AS rows
FROM ((SELECT * FROM tags UNION SELECT * FROM changes
       UNION SELECT entity_id, 'DQ_SUMMARY' FROM class_log)
      EXCEPT SELECT entity_id, 'PII' FROM class_log WHERE classification = 'UNKNOWN')
GROUP BY entity_id""",
    _TAGS,
)

# --- graph and access --------------------------------------------------------------------------

oracle(
    "graph_datasets",
    "versions",
    """
SELECT external_id AS node_id,
       c_nationkey || '_' || md5(c_name) || '_v' || version_number AS qualified_name,
       c_name || '.csv' AS name,
       CASE WHEN c_acctbal > 0 THEN c_mktsegment
            ELSE 'Dataset importé depuis /data/' || c_name END AS description,
       CASE WHEN parent_version_id IS NULL THEN 'Version initiale'
            ELSE 'Version dérivée de v' || parent_version_id END AS version_comment,
       columns_count, columns_list, CAST(c_custkey AS VARCHAR) AS owner,
       CAST(c_nationkey AS VARCHAR) AS project
FROM versions JOIN customer ON c_custkey = dataset_id
JOIN (SELECT o_custkey, count(DISTINCT p_type) AS columns_count,
             string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS columns_list
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
      GROUP BY o_custkey) ON o_custkey = dataset_id
WHERE external_id IS NOT NULL""",
)

_COLUMN_NODES = f"""{_MATCH},
column_nodes AS (
    SELECT sha256(m.qualified_name || '.' || m.column_name) AS node_id,
           m.qualified_name || '.' || m.column_name AS qualified_name, m.column_name AS name,
           v.type, CAST(m.position AS BIGINT) AS position, m.logical_id,
           coalesce(CASE WHEN trim(d.description) <> '' THEN d.description END,
                    CASE WHEN v.quantity > 40 THEN 'old ' || v.type END,
                    'Colonne ' || m.column_name) AS description,
           m.version_id, m.parent_version_id
    FROM matched m JOIN version_columns v
      ON v.version_id = m.version_id AND v.column_name = m.column_name
    LEFT JOIN descriptions d ON d.version_id = m.version_id AND d.column_name = m.column_name
)"""
oracle(
    "graph_columns",
    f"{_MATCH_TABLES} version_columns descriptions",
    "SELECT * EXCLUDE (version_id, parent_version_id) FROM column_nodes",
    _COLUMN_NODES,
    recursive=True,
)

_CHECK_NODES = """
check_nodes AS (
    SELECT sha256(unique_name) AS node_id, unique_name AS qualified_name,
           rule_type || ' - ' || coalesce(column_name, 'dataset') AS name,
           upper(rule_type) AS check_type, coalesce(column_name, '') AS column_name, error_count,
           round(CASE WHEN ratio IN ('junk', '', '1/2/3') OR ratio IS NULL THEN 0.0
                WHEN ratio = '0.5' THEN 0.5 WHEN split_part(ratio, '/', 2) = '0' THEN 0.0
                ELSE CAST(split_part(ratio, '/', 1) AS DOUBLE)
                     / CAST(split_part(ratio, '/', 2) AS DOUBLE) END, 6) AS ratio,
           dag_run_id, '["' || example || '"]' AS examples,
           CASE WHEN lower(status) IN ('réussi', 'success', 'pass', 'succès', 'passed')
                    THEN 'DQ_SUCCESS'
                WHEN lower(status) IN ('échoué', 'failed', 'fail', 'echec') THEN 'DQ_FAILED'
                ELSE 'DQ_WARNING' END AS quality_tag,
           version_id,
           CASE WHEN column_name IS NOT NULL AND known
                THEN sha256('p_' || version_id || '.' || column_name) ELSE '' END AS column_node
    FROM (
        SELECT c.*, v.column_name IS NOT NULL AS known,
               'g' || c.version_id || '.' || coalesce(c.column_name, 'dataset') || '.'
               || rule_type || '.' || dag_run_id AS unique_name
        FROM checks c LEFT JOIN version_columns v
          ON v.version_id = c.version_id AND v.column_name = c.column_name AND v.flag <> 'N'
    )
)"""
oracle(
    "graph_checks",
    "checks version_columns",
    "SELECT * EXCLUDE (version_id) FROM check_nodes",
    _CHECK_NODES,
)
oracle(
    "graph_check_links",
    "checks version_columns",
    """
SELECT 'g' || version_id AS version_node, count(*) FILTER (WHERE column_node <> '') AS on_columns,
       count(*) FILTER (WHERE column_node = '') AS on_dataset
FROM check_nodes GROUP BY version_id""",
    _CHECK_NODES,
)
oracle(
    "graph_edges",
    f"{_MATCH_TABLES} version_columns descriptions checks",
    """
SELECT 'dataset_columns' AS edge_type, 'g' || version_id AS source, node_id AS target
FROM column_nodes
UNION ALL
SELECT 'dataset_versioning', c.external_id, p.external_id
FROM versions c JOIN versions p ON p.id = c.parent_version_id
WHERE c.external_id <> p.external_id
UNION ALL
SELECT 'column_versioning', c.node_id, p.node_id
FROM column_nodes c JOIN column_nodes p
  ON p.version_id = c.parent_version_id AND p.name = c.name AND p.node_id <> c.node_id
UNION ALL
SELECT 'datasetversion_dqchecks', 'g' || version_id, node_id FROM check_nodes
UNION ALL
SELECT 'column_dqchecks', column_node, node_id FROM check_nodes WHERE column_node <> ''""",
    f"{_COLUMN_NODES}, {_CHECK_NODES}",
    recursive=True,
)

# Every user against every project, as the rules are worded.
_ACCESS = """
pairs AS (
    SELECT u.employee_id, u.role, u.department, p.project_id, p.owner_employee_id,
           u.role = 'ADMIN' OR (u.role = 'DATA_OWNER' AND (p.visibility = 'PUBLIC'
               OR coalesce(o.department = u.department, false))) AS upload
    FROM users u CROSS JOIN projects p
    LEFT JOIN users o ON o.employee_id = p.owner_employee_id
)"""
oracle(
    "access_grants",
    "users projects",
    """
SELECT project_id, role, '*' AS department, action
FROM projects CROSS JOIN (VALUES ('ADMIN', 'view'), ('AUDIT', 'view'), ('ADMIN', 'upload'))
     AS r(role, action)
UNION ALL
SELECT project_id, 'DATA_OWNER', '*', action
FROM projects CROSS JOIN (VALUES ('view'), ('upload')) AS a(action) WHERE visibility = 'PUBLIC'
UNION ALL
SELECT project_id, 'DATA_OWNER', department, action
FROM projects JOIN users ON employee_id = owner_employee_id
CROSS JOIN (VALUES ('view'), ('upload')) AS a(action) WHERE visibility = 'DEPARTMENT'""",
)
oracle(
    "access_counts",
    "users projects",
    """
SELECT employee_id, count(*) FILTER (WHERE upload OR role = 'AUDIT') AS view,
       count(*) FILTER (WHERE upload) AS upload
FROM pairs GROUP BY employee_id""",
    _ACCESS,
)
oracle(
    "access_owners",
    "users projects",
    """
SELECT employee_id, count(*) FILTER (WHERE upload OR role = 'AUDIT') AS projects,
       count(*) FILTER (WHERE (upload OR role = 'AUDIT') AND owner_employee_id = employee_id)
           AS own_projects
FROM pairs GROUP BY employee_id""",
    _ACCESS,
)
oracle(
    "access_owned",
    "users projects project_datasets",
    """
SELECT dataset_id, owner_employee_id
FROM project_datasets JOIN projects USING (project_id)
WHERE owner_employee_id IN (SELECT employee_id FROM users)""",
)
oracle(
    "ds_identical",
    "",
    """
SELECT hash, count(*) AS copies, min(path) AS first_path
FROM (SELECT 'documents/' || doc_id AS path, sha256(text) AS hash FROM documents
      UNION ALL SELECT 'pages/' || page_id, sha256(html) FROM pages) AS uploads
GROUP BY hash HAVING count(*) > 1""",
)
oracle(
    "ds_csv_import",
    "",
    """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, 'int|int|string|double|timestamp|string' AS kinds
FROM orders""",
)
oracle(
    "access_overview",
    "users projects project_datasets",
    """
SELECT p.project_id, p.name, count(d.dataset_id) AS datasets_count,
       CASE WHEN count(d.dataset_id) = 0 AND any_value(role) IN ('ADMIN', 'DATA_OWNER')
            THEN CAST(1 AS BIGINT) ELSE -1 END AS deletable
FROM projects p LEFT JOIN project_datasets d ON d.project_id = p.project_id
LEFT JOIN users ON employee_id = owner_employee_id
GROUP BY p.project_id, p.name""",
)

# --- publishing --------------------------------------------------------------------------------

# Drafts have no published version, so their parent is the most similar published dataset.
_PUSH = f"""{_SCORED},
parents AS (
    SELECT a AS dataset_id, b AS parent_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place
          FROM accepted JOIN published ON b = dataset_id WHERE score >= 0.60)
    WHERE place = 1
),
pushed AS (
    SELECT o_orderkey AS dataset_id, parent_id, coalesce(score, 0.0) AS score, o_totalprice,
           o_custkey, o_orderdate,
           -- The draft is version 1 and only reused when the parent does not ask for 2.
           CAST(2 AS BIGINT) AS version_number,
           o_custkey || '_' || md5(CAST(o_orderkey AS VARCHAR)) || '_v2' AS qualified_name
    FROM orders LEFT JOIN parents ON parents.dataset_id = o_orderkey
    WHERE o_orderpriority = '5-LOW'
),
push_pairs AS (
    SELECT DISTINCT lower(c.column_name) AS s2, lower(k.column_name) AS t2
    FROM pushed JOIN version_columns c ON c.version_id = pushed.dataset_id
    JOIN known_columns k ON k.version_id = pushed.parent_id
),
push_rows AS (
    SELECT s2, t2, CAST(0 AS BIGINT) AS i,
           list_transform(range(len(s2) + 1), lambda k: CAST(0 AS BIGINT)) AS cells
    FROM push_pairs
    UNION ALL
    SELECT s2, t2, i + 1,
           list_transform(range(len(s2) + 1), lambda k: list_max(
               list_transform(range(k + 1), lambda j:
                   greatest(cells[j + 1],
                            CASE WHEN j > 0 AND substr(s2, j, 1) = substr(t2, i + 1, 1)
                                 THEN cells[j] + 1 ELSE 0 END))))
    FROM push_rows WHERE i < len(t2)
),
push_lcs AS (SELECT s2, t2, cells[len(s2) + 1] AS n FROM push_rows WHERE i = len(t2)),
push_usable AS (SELECT * FROM known_columns WHERE logical_id IS NOT NULL),
push_fuzzy AS (
    SELECT version_id, column_name, logical_id
    FROM (
        SELECT c.version_id, c.column_name, u.logical_id,
               row_number() OVER (PARTITION BY c.version_id, c.column_name
                   ORDER BY 2.0 * n / (len(s2) + len(t2)) DESC, u.position) AS place
        FROM pushed JOIN version_columns c ON c.version_id = pushed.dataset_id
        JOIN push_usable u ON u.version_id = pushed.parent_id
        JOIN push_lcs ON s2 = lower(c.column_name) AND t2 = lower(u.column_name)
        WHERE n * 200 >= 82 * (len(s2) + len(t2))
    )
    WHERE place = 1
),
push_columns AS (
    SELECT c.version_id, c.column_name, pushed.parent_id,
           coalesce(byname.logical_id, bypos.logical_id, f.logical_id) AS logical_id
    FROM pushed JOIN version_columns c ON c.version_id = pushed.dataset_id
    LEFT JOIN push_usable byname ON byname.version_id = parent_id
                                    AND byname.column_name = c.column_name
    LEFT JOIN push_usable bypos ON bypos.version_id = parent_id AND bypos.position = c.position
    LEFT JOIN push_fuzzy f ON f.version_id = c.version_id AND f.column_name = c.column_name
),
push_counts AS (
    SELECT version_id, count(*) AS columns_count, count(*) FILTER (WHERE taken) AS propagated
    FROM (SELECT p.*, EXISTS (SELECT 1 FROM lineage l WHERE l.dataset_version_id = p.parent_id
                              AND l.column_name = p.column_name)
                 AND EXISTS (SELECT 1 FROM lineage l WHERE l.dataset_version_id = p.parent_id
                             AND l.logical_column_id = p.logical_id) AS taken
          FROM push_columns p)
    GROUP BY version_id
),
report AS (
    SELECT dataset_id, left(sha256(qualified_name), 32) AS version_id, version_number,
           coalesce(CAST(parent_id AS VARCHAR), '') AS parent_version_id,
           CASE WHEN parent_id IS NULL THEN 'Reupload v1' ELSE 'Reupload v2' END AS process_name,
           coalesce(columns_count, 0) AS columns_count,
           CAST(floor(o_totalprice) AS BIGINT) AS rows_count,
           coalesce(propagated, 0) AS propagated, round(score, 6) AS similarity_score,
           (SELECT count(*) FROM checks WHERE version_id = dataset_id) AS data_quality_checks,
           o_custkey, o_orderdate
    FROM pushed LEFT JOIN push_counts ON push_counts.version_id = dataset_id
)"""
_PUSH_TABLES = "signatures published version_columns known_columns lineage checks"
oracle(
    "push_report",
    _PUSH_TABLES,
    """
SELECT * EXCLUDE (o_custkey, o_orderdate),
       CAST(data_quality_checks > 0 AS BIGINT) AS quality_summary_added,
       CAST(dataset_id % 2 = 0 AS BIGINT) AS dataset_existed
FROM report""",
    _PUSH,
    recursive=True,
)
oracle(
    "push_history",
    _PUSH_TABLES,
    """
SELECT dataset_id, o_orderdate AS pushed_at, CAST(o_custkey AS VARCHAR) AS pushed_by,
       'SUCCESS' AS status, '' AS error_message, columns_count, rows_count,
       CAST(parent_version_id <> '' AS BIGINT) AS parent_found,
       CASE WHEN similarity_score > 0 THEN similarity_score ELSE -1.0 END AS similarity_score,
       propagated AS propagated_columns_count
FROM report
UNION ALL
SELECT doc_id, TIMESTAMP '2024-01-01', source, 'FAILED', left(text, 500), -1, -1, -1, -1.0, -1
FROM documents""",
    _PUSH,
    recursive=True,
)

oracle(
    "dq_dead_letters",
    "checks",
    """
SELECT 'checks' AS kind, 'run' || version_id AS document, n AS rows FROM runs WHERE version_id % 5 > 2
UNION ALL
SELECT 'no run', '{"dataset_version_id":"' || version_id || '"}', 1 FROM runs WHERE version_id % 5 = 2
UNION ALL
SELECT kind, '{"dag_run_id": "run' || version_id || '", "checks": [', 1
FROM runs, (VALUES ('unreadable'), ('listed')) AS kinds(kind) WHERE version_id % 5 = 0""",
    "runs AS (SELECT version_id, count(*) AS n FROM checks GROUP BY version_id)",
)

# All customers go on from the published end of their chains, or from their newest published version.
_LINKED = f"""{_CHAIN},
own_published AS (
    SELECT dataset_id, arg_max(id, version_number) AS own, max(version_number) AS published
    FROM versions WHERE external_id IS NOT NULL GROUP BY dataset_id
),
highest AS (SELECT dataset_id, max(version_number) AS highest FROM versions GROUP BY dataset_id),
parents AS (
    SELECT o.dataset_id, published,
           CASE WHEN r.depth IS NOT NULL AND e.external_id IS NOT NULL THEN e.id ELSE own END AS parent_id
    FROM own_published o LEFT JOIN rooted r ON r.node = own LEFT JOIN newest n ON n.ancestor = own
    LEFT JOIN versions e ON e.id = n.latest_id
),
placed AS (
    SELECT c.*, p.parent_id, v.external_id AS parent_node, v.version_number AS parent_number,
           CASE WHEN p.parent_id IS NOT NULL THEN greatest(v.version_number + 1, p.published + 1)
                ELSE coalesce(h.highest, 0) + 1 END AS next_version
    FROM customer c LEFT JOIN parents p ON p.dataset_id = c_custkey LEFT JOIN versions v ON v.id = p.parent_id
    LEFT JOIN highest h ON h.dataset_id = c_custkey
),
pushed AS (
    SELECT p.*, d.id AS draft_id, d.parent_version_id AS draft_parent, f.first_draft,
           c_nationkey || '_' || md5(c_name) || '_v' || next_version AS qualified_name,
           left(sha256(c_nationkey || '_' || md5(c_name) || '_v' || next_version), 32) AS node_id,
           coalesce(CAST(d.id AS VARCHAR),
                    left(sha256(c_nationkey || '_' || md5(c_name) || '_v' || next_version), 32)) AS push_id,
           c_nationkey || '_' || md5(c_name) || '_v' || parent_number AS parent_name
    FROM placed p
    LEFT JOIN versions d ON d.dataset_id = c_custkey AND d.external_id IS NULL AND d.version_number = next_version
    LEFT JOIN (SELECT dataset_id, arg_min(id, version_number) AS first_draft FROM versions
               WHERE external_id IS NULL GROUP BY dataset_id) f ON f.dataset_id = c_custkey
)"""
oracle(
    "push_versions",
    "versions",
    """
SELECT CAST(v.id AS VARCHAR) AS id, v.dataset_id, CAST(v.version_number AS BIGINT) AS version_number,
       coalesce(v.external_id, '') AS external_id, coalesce(CAST(v.parent_version_id AS VARCHAR), '') AS parent_version_id,
       'Version temporaire (en attente de push)' AS change_comment
FROM versions v WHERE v.id NOT IN (SELECT draft_id FROM pushed WHERE draft_id IS NOT NULL)
UNION ALL
SELECT push_id, c_custkey, CAST(next_version AS BIGINT), node_id,
       coalesce(CAST(CASE WHEN draft_id IS NULL THEN parent_id ELSE draft_parent END AS VARCHAR), ''),
       'Push depuis /data/' || c_name || '.csv'
FROM pushed""",
    _LINKED,
    recursive=True,
)
oracle(
    "push_nodes",
    "versions version_columns users",
    """
SELECT node_id, qualified_name, c_name || '.csv' AS name,
       CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'Dataset importé depuis /data/' || c_name || '.csv' END
           AS description,
       CASE WHEN parent_id IS NULL THEN 'Version initiale' ELSE 'Version dérivée de ' || parent_name END
           AS version_comment,
       coalesce(columns_count, 0) AS columns_count, coalesce(columns_list, '') AS columns_list,
       CAST(c_custkey AS VARCHAR) AS owner, CAST(c_nationkey AS VARCHAR) AS project,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'PUBLIC' ELSE 'RESTRICTED' END AS classification,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'ENTERPRISE' ELSE 'DEPARTMENT' END AS scope,
       CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE department END AS department,
       CAST(c_custkey AS VARCHAR) AS last_modified_by
FROM pushed JOIN users ON employee_id = c_custkey
LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS newest_order FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
LEFT JOIN (SELECT version_id, count(*) AS columns_count, string_agg(column_name, '|' ORDER BY position) AS columns_list
           FROM version_columns GROUP BY version_id) ON version_id = newest_order""",
    _LINKED,
    recursive=True,
)
oracle(
    "push_results",
    "versions checks",
    """
SELECT md5(CAST(version_id AS VARCHAR)) AS dag_run_uuid, push_id AS dataset_version_id, rule_type AS check_type,
       coalesce(column_name, '') AS column_name, {mapped} AS status, error_count,
       round(CASE WHEN ratio IN ('junk', '', '1/2/3') OR ratio IS NULL THEN 0.0
            WHEN ratio = '0.5' THEN 0.5 WHEN split_part(ratio, '/', 2) = '0' THEN 0.0
            ELSE CAST(split_part(ratio, '/', 1) AS DOUBLE) / CAST(split_part(ratio, '/', 2) AS DOUBLE) END, 6) AS ratio,
       CAST({mapped} = 'failed' AS BIGINT) AS alert, '["' || example || '"]' AS examples
FROM checks JOIN (SELECT o_custkey, max(o_orderkey) AS newest_order FROM orders GROUP BY o_custkey) ON newest_order = version_id
JOIN pushed ON c_custkey = o_custkey WHERE version_id % 3 <> 0""".format(mapped=_mapped("status")),
    _LINKED,
    recursive=True,
)
oracle(
    "push_descriptions",
    "versions descriptions",
    """
SELECT push_id AS version_id, column_name, d.description, created_by, TIMESTAMP '2024-01-01' AS created_at,
       CAST(c_custkey AS VARCHAR) AS updated_by, TIMESTAMP '2024-02-01' AS updated_at
FROM pushed JOIN descriptions d ON d.version_id = first_draft WHERE draft_id IS NULL""",
    _LINKED,
    recursive=True,
)
oracle(
    "push_processes",
    "versions",
    """
SELECT parent_id || '_to_' || push_id AS process_id, 'Reupload v' || (coalesce(depth, 0) + 1) AS process_name,
       CAST(parent_id AS VARCHAR) AS input_version_id, push_id AS output_version_id,
       CAST(c_custkey AS VARCHAR) AS created_by, 'SUCCESS' AS status, parent_name
FROM pushed LEFT JOIN rooted ON node = parent_id WHERE parent_id IS NOT NULL""",
    _LINKED,
    recursive=True,
)
