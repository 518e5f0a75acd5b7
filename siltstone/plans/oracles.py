"""The SQL that each registered query must agree with, written independently for DuckDB."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# --- rules -----------------------------------------------------------------------------------

_LABELLED = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"

ORACLES["rule_required"] = f"""
SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'quality is required' ELSE '' END AS errors FROM {_LABELLED}"""
ORACLES["rule_min"] = """
SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 's_acctbal below min 0' ELSE '' END AS errors FROM supplier"""
ORACLES["rule_max"] = """
SELECT p_partkey, CASE WHEN p_size > 45 THEN 'p_size above max 45' ELSE '' END AS errors FROM part"""
ORACLES["rule_min_date"] = """
SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01'
  THEN 'o_orderdate must be later than "1998-01-01"' ELSE '' END AS errors FROM orders"""
ORACLES["rule_max_rate"] = """
SELECT event_id, CASE WHEN value > 100 THEN 'value must be less than 100' ELSE '' END AS errors FROM events"""
ORACLES["rule_min_rate"] = """
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_tax < 0.000001 THEN 'l_tax must be more than 1e-06' ELSE '' END AS errors FROM lineitem"""
ORACLES["rule_length"] = """
SELECT p_partkey, CASE WHEN length(p_name) <> 9 THEN 'p_name must be 9 characters long' ELSE '' END AS errors FROM part"""
ORACLES["rule_format"] = """
SELECT p_partkey, CASE WHEN NOT regexp_full_match(p_brand, 'Brand#[0-9]')
  THEN 'p_brand does not match Brand#[0-9]' ELSE '' END AS errors FROM part"""
ORACLES["rule_type"] = """
WITH landed AS (SELECT p_partkey, p_partkey % 7 AS odd, p_size, p_retailprice FROM part)
SELECT p_partkey, CASE WHEN odd <> 0 THEN p_size::VARCHAR END AS size,
  CASE WHEN odd NOT IN (1, 2) THEN p_retailprice::VARCHAR::DECIMAL(20,10) END AS price,
  CASE WHEN odd <> 3 THEN (p_size > 25)::VARCHAR END AS large,
  concat_ws('; ', CASE WHEN odd = 0 THEN 'size is not of type integer' END, CASE WHEN odd = 2 THEN 'price is not of type decimal' END,
    CASE WHEN odd = 3 THEN 'large is not of type boolean' END,
    CASE WHEN odd = 0 THEN 'size is required' WHEN p_size > 45 THEN 'size above max 45' END,
    CASE WHEN odd NOT IN (1, 2) AND p_retailprice::VARCHAR::DECIMAL(20,10) < 1000 THEN 'price must be more than 1000' END) AS errors
FROM landed"""
ORACLES["rule_combined"] = """
SELECT p_partkey, concat_ws(', ',
  CASE WHEN p_size IS NULL THEN 'p_size is required' END,
  CASE WHEN p_size < 10 THEN 'p_size below min 10' END,
  CASE WHEN p_size > 5 THEN 'p_size above max 5' END,
  CASE WHEN p_size > 30 THEN 'p_size must be less than 30' END) AS errors FROM part"""
ORACLES["rule_accumulated"] = """
SELECT o_orderkey, concat_ws('; ',
  CASE WHEN o_totalprice < 100000 THEN 'o_totalprice below min 100000'
       WHEN o_totalprice > 400000 THEN 'o_totalprice above max 400000' END,
  CASE WHEN o_orderdate < TIMESTAMP '1996-06-01' THEN 'o_orderdate must be later than "1996-06-01"' END,
  CASE WHEN length(o_orderpriority) <> 6 THEN 'o_orderpriority must be 6 characters long' END) AS errors FROM orders"""

# --- quarantine ------------------------------------------------------------------------------

_LINE_ERRORS = """concat_ws('; ',
  nullif(concat_ws(', ', CASE WHEN l_quantity IS NULL THEN 'l_quantity is required' END,
    CASE WHEN l_quantity < 5 THEN 'l_quantity below min 5' END,
    CASE WHEN l_quantity > 45 THEN 'l_quantity above max 45' END), ''),
  CASE WHEN l_discount > 0.09::DOUBLE THEN 'l_discount must be less than 0.09' END,
  CASE WHEN l_shipdate < TIMESTAMP '1996-01-01' THEN 'l_shipdate must be later than "1996-01-01"' END,
  nullif(concat_ws(', ', CASE WHEN l_returnflag IS NULL THEN 'l_returnflag is required' END,
    CASE WHEN length(l_returnflag) <> 1 THEN 'l_returnflag must be 1 characters long' END), ''))"""
_LINES = f"(SELECT *, {_LINE_ERRORS} AS errors FROM lineitem)"

ORACLES["quarantine_valid"] = f"SELECT * EXCLUDE (errors) FROM {_LINES} WHERE errors = ''"
ORACLES["quarantine_rejected"] = f"SELECT * FROM {_LINES} WHERE errors <> ''"
ORACLES["quarantine_counts"] = f"""
SELECT count(*) AS n_input, count(*) FILTER (errors = '') AS n_valid, count(*) FILTER (errors <> '') AS n_rejected
FROM {_LINES}"""
ORACLES["quarantine_written"] = f"""
WITH c AS (SELECT *, strftime(l_shipdate, '%Y') AS batch FROM {_LINES}),
kept AS (
  SELECT * FROM c WHERE errors = ''
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC,
    l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC,
    l_shipdate DESC) = 1)
SELECT batch, 'valid' AS verdict, count(*) AS n FROM kept GROUP BY batch
UNION ALL SELECT batch, 'rejected', count(*) FROM c WHERE errors <> '' GROUP BY batch"""

ORACLES["quarantine_rerun"] = """
SELECT strftime(l_shipdate, '%Y') AS batch, l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity > 45
UNION ALL SELECT strftime(l_shipdate, '%Y'), l_orderkey, l_linenumber, l_quantity - 2 FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_quantity - 2 > 45"""

# --- cleaning --------------------------------------------------------------------------------

_TEXT_LINES = """(SELECT doc_id, i::INT AS pos, string_split(text, chr(10))[i + 1] AS line
  FROM documents, unnest(range(len(string_split(text, chr(10))))) AS r(i))"""


def _cleaned(value: str) -> str:
    """The cleaning steps in order, for text whose only entities are the four below."""
    steps = value
    for entity, char in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&amp;?", "&")):
        steps = f"regexp_replace({steps}, '{entity}', '{char}', 'g')"
    steps = f"nfc_normalize({steps})"
    steps = f"regexp_replace({steps}, '[\\x00-\\x08\\x0b-\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"
    steps = f"regexp_replace({steps}, '\\r+', '', 'g')"
    steps = f"regexp_replace({steps}, '[\\n\\t]+', ' ', 'g')"
    steps = f"regexp_replace({steps}, '[\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{feff}}]', '', 'g')"
    steps = f"regexp_replace({steps}, '\\s{{2,}}', ' ', 'g')"
    return f"nullif(trim({steps}), '')"


ORACLES["blank_to_null"] = f"SELECT doc_id, pos, CASE WHEN trim(line) <> '' THEN line END AS line FROM {_TEXT_LINES}"
ORACLES["code_lpad"] = """
SELECT c_custkey, lpad(c_custkey::VARCHAR, 3, '0') AS code,
  CASE WHEN length(c_custkey::VARCHAR) < 3 THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS code_whole
FROM customer"""
ORACLES["clean_fields"] = f"SELECT doc_id, pos, {_cleaned('line')} AS line FROM {_TEXT_LINES}"
ORACLES["clean_text_full"] = f"""
SELECT 'document' AS kind, doc_id AS id, 0::BIGINT AS part, {_cleaned('text')} AS text FROM documents
UNION ALL SELECT 'page', page_id, 0::BIGINT, {_cleaned('html')} FROM pages
UNION ALL SELECT 'turn', conv_id, turn, {_cleaned('text')} FROM conversations"""

# --- landing ---------------------------------------------------------------------------------

ORACLES["payload_explode"] = """
SELECT event_id, k AS code, CAST(json_extract_string(props, '$.' || k) AS DECIMAL(20,10)) AS rate
FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"""
ORACLES["payload_empty_guard"] = """
SELECT event_id, event_type AS curr_base, k AS currency,
  CAST(json_extract_string(props, '$.' || k) AS DECIMAL(20,10)) AS rate, date_trunc('second', ts) AS rate_date
FROM (SELECT *, unnest(json_keys(props)) AS k FROM events WHERE event_type <> 'error')"""
ORACLES["payload_corrupt"] = """
SELECT event_id, CASE WHEN event_type IN ('click', 'signup') THEN event_type END AS curr_base,
  CASE WHEN event_type IN ('click', 'signup') THEN 'k' END AS currency,
  CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS DECIMAL(20,10)) END AS rate,
  CASE WHEN event_type = 'signup' THEN date_trunc('second', ts)::TIMESTAMP END AS rate_date,
  CASE event_type WHEN 'click' THEN 'rate_date: soon' WHEN 'signup' THEN 'rate: n/a'
    ELSE '{"response":{"date":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","base":"' || event_type || '","rates":'
      || CASE event_type WHEN 'error' THEN '"oops"}}' ELSE props END END AS corrupt
FROM events WHERE event_type <> 'view'"""
_EMPTY_TEXT = "event_type = 'view' AND user_id % 2 = 0"
_NO_ENVELOPE = f"(event_type = 'error' OR ({_EMPTY_TEXT}))"
_FULL = "event_type NOT IN ('error', 'signup', 'view')"
ORACLES["payload_rescued"] = f"""
SELECT event_id, NULL AS curr_base, NULL AS currency, NULL::DECIMAL(20,10) AS rate, NULL::TIMESTAMP AS rate_date,
  CASE WHEN event_type = 'error' THEN '{{"error":"quota"}}' ELSE '' END AS corrupt,
  CASE WHEN event_type = 'error' THEN '{{"error":"quota"}}' END AS rescued
FROM events WHERE {_NO_ENVELOPE}
UNION ALL SELECT event_id, event_type, NULL, 2.5, date_trunc('second', ts)::TIMESTAMP, 'currency: ', NULL FROM events WHERE event_type = 'signup'
UNION ALL SELECT event_id, event_type, k, CAST(json_extract_string(props, '$.' || k) AS DECIMAL(20,10)), date_trunc('second', ts)::TIMESTAMP, NULL,
  CASE WHEN event_type = 'click' THEN '{{"meta":"7","response.note":"late"}}' END
FROM (SELECT *, unnest(json_keys(props)) AS k FROM events WHERE {_FULL})"""
ORACLES["records_rescued"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS name,
  CASE WHEN o_orderstatus = 'P' THEN '{"error":"quota"}' END AS corrupt,
  CASE WHEN o_orderstatus <> 'P' THEN '{"extra":"' || o_custkey || '"}' END AS rescued
FROM orders WHERE o_orderstatus <> 'O'"""
ORACLES["payload_records"] = """
SELECT o_orderkey, 'status' AS kind, o_orderstatus AS name FROM orders
UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders"""
ORACLES["payload_files"] = ORACLES["payload_records"]
ORACLES["payload_files_streamed"] = f"SELECT * EXCLUDE (event_id) FROM ({ORACLES['payload_empty_guard']})"
ORACLES["add_lineage"] = """
SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS _ingested_at, 'events' AS _source_file,
  strftime(date_trunc('day', ts), '%Y%m%d_%H%M%S') AS _batch_id FROM events"""
ORACLES["parse_timestamp"] = """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS text, date_trunc('second', ts)::TIMESTAMP AS parsed FROM events"""
ORACLES["decimal_exact"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice::VARCHAR::DECIMAL(20,10) AS price,
  l_discount::VARCHAR::DECIMAL(20,10) AS discount FROM lineitem"""

# --- batches and reference lists -------------------------------------------------------------

_LATER_LINE = """row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC,
  l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC,
  l_linestatus DESC) = 1"""

ORACLES["landed_run_latest"] = """
SELECT event_id, event_type, user_id, TIMESTAMP '2024-02-02 06:00:00' AS _ingested_at, 'events' AS _source_file,
  '20240202_060000' AS _batch_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 12:00:00'"""
ORACLES["latest_batch"] = """
SELECT *, date_trunc('day', ts)::TIMESTAMP AS _ingested_at FROM events
WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events)"""
ORACLES["dedupe_by_key"] = f"SELECT * FROM lineitem QUALIFY {_LATER_LINE}"
ORACLES["known_semi_join"] = """
SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""
ORACLES["known_semi_join_both"] = """
WITH codes AS (SELECT p_partkey FROM part WHERE p_size >= 10)
SELECT * FROM lineitem WHERE l_suppkey IN (FROM codes) AND l_partkey IN (FROM codes)"""
# --- dimensions and facts --------------------------------------------------------------------

_RATES = """rates AS (SELECT event_type AS curr_base, user_id::VARCHAR AS currency,
  value::VARCHAR::DECIMAL(20,10) AS rate, ts AS rate_date, date_trunc('minute', ts)::TIMESTAMP AS minute FROM events)"""
_SEEN = "seen AS (SELECT * FROM rates WHERE rate_date < TIMESTAMP '2024-01-20 12:00:00' AND curr_base <> 'error')"
_KEY = "strftime({}, '%Y%m%d%H%M')::BIGINT"
_LAST_OF_MINUTE = "row_number() OVER (PARTITION BY minute, curr_base, currency ORDER BY rate_date DESC, rate DESC) = 1"


def _facts(source: str, where: str = "true") -> str:
    return f"""SELECT {_KEY.format('minute')} AS date_key, curr_base, currency, rate
  FROM (SELECT * FROM {source} WHERE {where}) QUALIFY {_LAST_OF_MINUTE}"""


_MARK = "(SELECT max(minute) FROM seen)"

ORACLES["dim_date_full"] = f"WITH {_RATES} SELECT DISTINCT {_KEY.format('minute')} AS date_key, minute AS date FROM rates"
ORACLES["dim_date_incremental"] = f"""
WITH {_RATES}, {_SEEN}
SELECT DISTINCT {_KEY.format('minute')} AS date_key, minute AS date FROM (
  SELECT minute FROM seen UNION ALL SELECT minute FROM rates WHERE rate_date > {_MARK})"""
ORACLES["fact_full"] = f"WITH {_RATES} {_facts('rates')}"
ORACLES["fact_late_rows"] = ORACLES["fact_full"]
ORACLES["fact_full_every_row"] = f"WITH {_RATES} SELECT {_KEY.format('minute')} AS date_key, curr_base, currency, rate FROM rates"
ORACLES["fact_incremental"] = f"""
WITH {_RATES}, {_SEEN}, before AS ({_facts('seen')}), fresh AS ({_facts('rates', 'rate_date > ' + _MARK)})
SELECT * FROM before b WHERE NOT EXISTS (SELECT 1 FROM fresh f
  WHERE f.date_key = b.date_key AND f.curr_base = b.curr_base AND f.currency = b.currency)
UNION ALL SELECT * FROM fresh"""
ORACLES["star_loaded"] = f"""
SELECT strptime(date_key::VARCHAR, '%Y%m%d%H%M')::TIMESTAMP AS date, curr_base, currency, rate
FROM ({ORACLES["fact_incremental"]})"""
ORACLES["fact_full_refresh"] = f"WITH {_RATES} {_facts('rates', '''rate_date >= TIMESTAMP '2024-01-20 12:00:00' ''')}"
ORACLES["empty_target_incremental"] = ORACLES["fact_full"]
ORACLES["star_loaded_empty_first"] = ORACLES["fact_full"]
ORACLES["fact_by_ledger"] = ORACLES["fact_full"]
ORACLES["upsert_moved"] = f"""
SELECT * EXCLUDE (l_returnflag), CASE WHEN l_linenumber = 2 THEN 'X' ELSE l_returnflag END AS l_returnflag
FROM lineitem QUALIFY {_LATER_LINE}"""
ORACLES["upsert_delete_insert"] = f"""
WITH target AS (SELECT * FROM lineitem WHERE l_returnflag <> 'R' QUALIFY {_LATER_LINE}),
fresh AS (SELECT * FROM lineitem WHERE l_returnflag = 'R' QUALIFY {_LATER_LINE})
SELECT * FROM target t WHERE NOT EXISTS (
  SELECT 1 FROM fresh f WHERE f.l_orderkey = t.l_orderkey AND f.l_linenumber = t.l_linenumber)
UNION ALL SELECT * FROM fresh"""
ORACLES["upsert_partitions"] = f"""
SELECT strftime(ts, '%Y%m%d')::INT AS day, {_KEY.format('ts')} AS date_key, event_type, user_id,
  CASE WHEN ts >= TIMESTAMP '2024-01-21' THEN 0.0::DOUBLE ELSE value END AS value, event_id
FROM events QUALIFY row_number() OVER (
  PARTITION BY {_KEY.format('ts')}, event_type, user_id ORDER BY event_id DESC) = 1"""

# --- history ---------------------------------------------------------------------------------

_FIRST, _SECOND = "TIMESTAMP '1997-01-01'", "TIMESTAMP '1999-06-01'"
_LATER = """later AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'TOOLS' ELSE c_mktsegment END AS c_mktsegment
  FROM customer WHERE c_nationkey <> 3
  UNION ALL SELECT c_custkey + 1000000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey = 7)"""


def _versions(gone: str) -> str:
    """The history after both snapshots; ``gone`` ends the version of a vanished key."""
    differs = " OR ".join(f"o.{c} IS DISTINCT FROM n.{c}" for c in ("c_name", "c_nationkey", "c_mktsegment"))
    return f"""{_LATER}, hist AS (
  SELECT o.*, {_FIRST} AS valid_from,
    CASE WHEN n.c_custkey IS NULL THEN {gone} WHEN {differs} THEN {_SECOND} END AS valid_to
  FROM customer o LEFT JOIN later n ON o.c_custkey = n.c_custkey
  UNION ALL
  SELECT n.*, {_SECOND}, NULL FROM later n LEFT JOIN customer o ON o.c_custkey = n.c_custkey
  WHERE o.c_custkey IS NULL OR {differs})"""


_HIST = "WITH " + _versions("NULL::TIMESTAMP")
_ASOF = "SELECT o_orderkey, o_custkey, o_orderdate, c_mktsegment, valid_from, valid_to FROM orders JOIN hist ON o_custkey = c_custkey"
_HALF = "o_orderdate >= valid_from AND (valid_to IS NULL OR o_orderdate < valid_to)"
_BOTH = "o_orderdate BETWEEN valid_from AND coalesce(valid_to, TIMESTAMP '9999-12-31')"
_SK = "md5(c_custkey::VARCHAR || '-' || coalesce({}::VARCHAR, '_dbt_utils_surrogate_key_null_'))"

ORACLES["scd2_snapshot"] = f"{_HIST} SELECT * FROM hist"
ORACLES["scd2_stored"] = ORACLES["scd2_snapshot"]
ORACLES["scd2_hard_deletes"] = f"WITH {_versions(_SECOND)} SELECT * FROM hist"
ORACLES["scd2_rerun"] = ORACLES["scd2_snapshot"]
ORACLES["scd2_dim"] = f"""{_HIST}
SELECT c_custkey AS customer_key, c_name AS name, c_mktsegment AS segment, valid_from, valid_to,
  valid_to IS NULL AS is_current FROM hist"""
ORACLES["scd2_asof_closed"] = f"{_HIST} {_ASOF} AND {_BOTH}"
ORACLES["scd2_asof_halfopen"] = f"{_HIST} {_ASOF} AND {_HALF}"
ORACLES["scd2_asof_chosen"] = ORACLES["scd2_asof_halfopen"]
ORACLES["surrogate_key"] = f"""{_HIST}
SELECT c_custkey, valid_from, {_SK.format('valid_from')} AS customer_sk, {_SK.format('valid_to')} AS closing_sk FROM hist"""
ORACLES["resolve_surrogate"] = f"""{_HIST}
SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN c_custkey IS NOT NULL THEN {_SK.format('valid_from')} END AS customer_sk
FROM orders LEFT JOIN hist ON o_custkey = c_custkey AND {_HALF}"""



def _valid_at(alias: str, code: str, moment: str) -> str:
    return f"{code} = {alias}.c_custkey AND {moment} >= {alias}.valid_from AND ({alias}.valid_to IS NULL OR {moment} < {alias}.valid_to)"


ORACLES["asof_two_roles"] = f"""{_HIST}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, s.c_mktsegment AS seller_segment, s.valid_from AS seller_from,
  b.c_mktsegment AS buyer_segment
FROM lineitem LEFT JOIN hist s ON {_valid_at('s', 'l_suppkey', 'l_shipdate')} LEFT JOIN hist b ON {_valid_at('b', 'l_partkey', 'l_shipdate')}"""
_LATE_HIST = _HIST.replace(_FIRST, "TIMESTAMP '2023-01-01'").replace(_SECOND, "TIMESTAMP '2024-01-20 12:00:00'")
_VERSION_KEY = "CASE WHEN {0}.c_custkey IS NOT NULL THEN md5({0}.c_custkey::VARCHAR || '-' || {0}.valid_from::VARCHAR) END"
ORACLES["fact_with_surrogates"] = f"""{_LATE_HIST}, rates AS (
  SELECT event_id AS curr_base, user_id AS currency, value::VARCHAR::DECIMAL(20,10) AS rate, ts AS rate_date,
    date_trunc('minute', ts)::TIMESTAMP AS minute FROM events),
kept AS (SELECT * FROM rates QUALIFY {_LAST_OF_MINUTE})
SELECT {_KEY.format('minute')} AS date_key, curr_base, currency, rate,
  {_VERSION_KEY.format('b')} AS curr_base_sk, {_VERSION_KEY.format('q')} AS currency_sk
FROM kept LEFT JOIN hist b ON {_valid_at('b', 'curr_base', 'rate_date')} LEFT JOIN hist q ON {_valid_at('q', 'currency', 'rate_date')}"""

_STATES = """states AS (
  SELECT o_custkey, o_orderpriority, o_orderstatus, o_orderdate AS seen_at FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderpriority DESC, o_orderstatus DESC) = 1),
changes AS (
  SELECT * FROM states WINDOW w AS (PARTITION BY o_custkey ORDER BY seen_at)
  QUALIFY lag(seen_at) OVER w IS NULL OR o_orderpriority IS DISTINCT FROM lag(o_orderpriority) OVER w
    OR o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w),
long_hist AS (
  SELECT o_custkey, o_orderpriority, o_orderstatus, seen_at AS valid_from,
    lead(seen_at) OVER (PARTITION BY o_custkey ORDER BY seen_at) AS valid_to FROM changes)"""
_LONG = """SELECT f.o_orderkey, f.o_custkey, f.o_orderdate, h.o_orderpriority, h.o_orderstatus, valid_from, valid_to
FROM orders f JOIN long_hist h ON f.o_custkey = h.o_custkey"""

ORACLES["scd2_replay"] = f"WITH {_STATES} SELECT * FROM long_hist"
ORACLES["scd2_asof_merge"] = f"WITH {_STATES} {_LONG} AND {_HALF}"
ORACLES["scd2_asof_merge_closed"] = f"WITH {_STATES} {_LONG} AND {_BOTH}"



def _islands(states: str, key: str, checks: tuple[str, ...]) -> str:
    """The history of states seen in batches, closed where a key is missing from a batch."""
    changed = " OR ".join(f"{c} IS DISTINCT FROM lag({c}) OVER w" for c in checks)
    return f"""WITH {states},
calendar AS (SELECT seen_at, row_number() OVER (ORDER BY seen_at) AS b, lead(seen_at) OVER (ORDER BY seen_at) AS after
  FROM (SELECT DISTINCT seen_at FROM states)),
placed AS (SELECT s.*, b, after, lag(b) OVER w IS NULL OR lag(b) OVER w <> b - 1 OR {changed} AS opens, lead(b) OVER w AS then_b
  FROM states s JOIN calendar USING (seen_at) WINDOW w AS (PARTITION BY {key} ORDER BY b)),
numbered AS (SELECT *, sum(opens::INT) OVER (PARTITION BY {key} ORDER BY b) AS version FROM placed),
ends AS (SELECT {key}, version, after AS valid_to FROM numbered
  QUALIFY row_number() OVER (PARTITION BY {key}, version ORDER BY b DESC) = 1)
SELECT n.{key}, {", ".join(f"n.{c}" for c in checks)}, n.seen_at AS valid_from, e.valid_to
FROM numbered n JOIN ends e ON n.{key} = e.{key} AND n.version = e.version WHERE n.opens"""


ORACLES["scd2_replay_deletes"] = _islands("""states AS (
  SELECT o_custkey, o_orderpriority, o_orderstatus, date_trunc('month', o_orderdate)::TIMESTAMP AS seen_at FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderpriority DESC, o_orderstatus DESC) = 1)""",
    "o_custkey", ("o_orderpriority", "o_orderstatus"))
ORACLES["scd2_backdated"] = _islands("""states AS (
  SELECT c_custkey, c_nationkey, c_mktsegment, TIMESTAMP '1996-01-01' AS seen_at FROM customer WHERE c_nationkey <> 4
  UNION ALL SELECT c_custkey, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END, TIMESTAMP '1997-01-01'
  FROM customer WHERE c_nationkey NOT IN (3, 4)
  UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment, TIMESTAMP '1998-01-01' FROM customer WHERE c_nationkey <> 5)""",
    "c_custkey", ("c_nationkey", "c_mktsegment"))
ORACLES["scd2_stored_backdated"] = ORACLES["scd2_backdated"]
ORACLES["scd2_stored_deletes"] = f"""
SELECT c_custkey, c_name, c_mktsegment, {_FIRST} AS valid_from,
  CASE WHEN c_custkey % 3 = 0 THEN {_SECOND} ELSE TIMESTAMP '2000-01-01' END AS valid_to FROM customer"""

# --- star ------------------------------------------------------------------------------------

ORACLES["fact_readback"] = f"""
WITH {_RATES} SELECT minute AS date, curr_base, currency, rate FROM rates QUALIFY {_LAST_OF_MINUTE}"""
ORACLES["fact_topn"] = f"""
WITH {_RATES} SELECT * FROM ({_facts('rates')}) ORDER BY date_key, curr_base, currency, rate LIMIT 100"""
ORACLES["role_playing_dims"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, b.n_name AS buyer, s.n_name AS seller
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation b ON c_nationkey = b.n_nationkey
JOIN nation s ON s_nationkey = s.n_nationkey"""

# --- quality ---------------------------------------------------------------------------------

_SOUND = "(SELECT * FROM customer WHERE c_acctbal > 0)"
_ORPHANS = f"orders o WHERE NOT EXISTS (SELECT 1 FROM {_SOUND} c WHERE c.c_custkey = o.o_custkey)"
_REPEATED = "(SELECT l_orderkey, l_linenumber, count(*) AS n_records FROM lineitem GROUP BY ALL HAVING count(*) > 1)"
_REPEATED_ORDER = "(SELECT l_orderkey, count(*) AS n_records FROM lineitem GROUP BY ALL HAVING count(*) > 1)"

ORACLES["dq_not_null"] = f"SELECT d.doc_id FROM {_LABELLED} WHERE quality IS NULL OR toxic IS NULL"
ORACLES["dq_unique"] = f"SELECT * FROM {_REPEATED_ORDER}"
ORACLES["dq_primary_key"] = f"SELECT * FROM {_REPEATED}"
ORACLES["dq_relationships"] = f"SELECT o_custkey, count(*) AS n_records FROM {_ORPHANS} GROUP BY o_custkey"
ORACLES["dq_foreign_key"] = f"SELECT * FROM {_ORPHANS}"
ORACLES["dq_suite"] = f"""
SELECT 'not_null' AS test, 'labelled' AS "table", 'doc_id' AS "column", count(*) AS failures FROM {_LABELLED} WHERE d.doc_id IS NULL
UNION ALL SELECT 'not_null', 'labelled', 'quality', count(*) FROM {_LABELLED} WHERE quality IS NULL
UNION ALL SELECT 'not_null', 'labelled', 'toxic', count(*) FROM {_LABELLED} WHERE toxic IS NULL
UNION ALL SELECT 'not_null', 'orders', 'o_custkey', count(*) FROM orders WHERE o_custkey IS NULL
UNION ALL SELECT 'unique', 'orders', 'o_orderkey', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'unique', 'lineitem', 'l_orderkey', count(*) FROM {_REPEATED_ORDER}
UNION ALL SELECT 'primary_key', 'lineitem', 'l_orderkey,l_linenumber', count(*) FROM {_REPEATED}
UNION ALL SELECT 'foreign_key', 'lineitem', 'l_orderkey', count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'relationships', 'orders', 'o_custkey', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'relationships', 'orders', 'o_custkey', count(DISTINCT o_custkey) FROM {_ORPHANS}"""

ORACLES["dq_incremental"] = ORACLES["dq_primary_key"]
ORACLES["dq_incremental_references"] = ORACLES["dq_relationships"]

# --- layers ----------------------------------------------------------------------------------

ORACLES["layer_overwritten"] = "SELECT * FROM supplier WHERE s_acctbal > 0"
ORACLES["layer_roundtrip"] = "SELECT * FROM lineitem"
ORACLES["layer_counts"] = "SELECT count(*) AS n_rows, max(l_orderkey) AS largest FROM lineitem"
ORACLES["read_optional"] = "SELECT * FROM orders"
ORACLES["materialize_table"] = f"""{_HIST}
SELECT c_custkey AS customer_key, c_name AS name, c_mktsegment AS segment, valid_from, valid_to, true AS is_current
FROM hist WHERE valid_to IS NULL"""
ORACLES["load_stage"] = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
ORACLES["register_layer"] = "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL"

# --- recipes ---------------------------------------------------------------------------------

_CURRENCIES = """landed AS (SELECT p_partkey::INT AS id, nullif(trim(p_name), '') AS name,
  (p_partkey % 1200)::VARCHAR AS short_code, lpad(p_size::VARCHAR, 3, '0') AS code,
  (length(p_brand) - 6)::INT AS precision, floor(p_retailprice)::INT AS subunit, p_brand AS symbol,
  p_size > 25 AS symbol_first, (p_size % 12)::VARCHAR AS decimal_mark,
  CASE WHEN p_size > 10 THEN (p_size % 11)::VARCHAR END AS thousands_separator FROM part),
checked AS (SELECT *, concat_ws('; ',
  CASE WHEN id IS NULL THEN 'id is required' WHEN id < 1 THEN 'id below min 1' END,
  CASE WHEN precision < 0 THEN 'precision below min 0' WHEN precision > 3 THEN 'precision above max 3' END,
  CASE WHEN subunit < 1 THEN 'subunit below min 1' WHEN subunit > 1000 THEN 'subunit above max 1000' END,
  CASE WHEN name IS NULL THEN 'name is required' END,
  CASE WHEN short_code IS NULL THEN 'short_code is required'
       WHEN length(short_code) <> 3 THEN 'short_code must be 3 characters long' END,
  CASE WHEN length(code) <> 3 THEN 'code must be 3 characters long' END,
  CASE WHEN symbol IS NULL THEN 'symbol is required' END,
  CASE WHEN decimal_mark IS NULL THEN 'decimal_mark is required'
       WHEN length(decimal_mark) <> 1 THEN 'decimal_mark must be 1 characters long' END,
  CASE WHEN length(thousands_separator) <> 1 THEN 'thousands_separator must be 1 characters long' END) AS errors
  FROM landed)"""

ORACLES["silver_dimension_valid"] = f"WITH {_CURRENCIES} SELECT * EXCLUDE (errors) FROM checked WHERE errors = ''"
ORACLES["silver_dimension_rejected"] = f"WITH {_CURRENCIES} SELECT id, errors FROM checked WHERE errors <> ''"

_SILVER = """landed AS (SELECT (length(event_type) + 99 - event_id % 7)::VARCHAR AS curr_base, user_id::VARCHAR AS currency,
  (value - 1)::VARCHAR::DECIMAL(20,10) AS rate, date_trunc('hour', ts)::TIMESTAMP AS rate_date,
  date_trunc('month', ts)::TIMESTAMP AS _ingested_at FROM events),
codes AS (SELECT curr_base AS short_code FROM landed WHERE curr_base <> '101'
  UNION SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal > 0),
checked AS (SELECT *, concat_ws('; ',
  CASE WHEN rate_date < TIMESTAMP '2019-01-01' THEN 'rate_date must be later than "2019-01-01"' END,
  CASE WHEN rate > 100000000 THEN 'rate must be less than 100000000'
       WHEN rate < 0.000001 THEN 'rate must be more than 1e-06' END,
  CASE WHEN length(curr_base) <> 3 THEN 'curr_base must be 3 characters long' END,
  CASE WHEN length(currency) <> 3 THEN 'currency must be 3 characters long' END) AS errors
  FROM landed WHERE _ingested_at = (SELECT max(_ingested_at) FROM landed)
    AND curr_base IN (SELECT short_code FROM codes) AND currency IN (SELECT short_code FROM codes))"""

ORACLES["silver_fact_valid"] = f"""WITH {_SILVER} SELECT * EXCLUDE (errors) FROM checked WHERE errors = ''
QUALIFY row_number() OVER (PARTITION BY curr_base, currency, rate_date ORDER BY rate DESC) = 1"""
ORACLES["silver_fact_rejected"] = f"WITH {_SILVER} SELECT * FROM checked WHERE errors <> ''"


def _nulls(name: str, columns: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT 'not_null' AS test, '{name}' AS "table", '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS failures FROM {name}""" for c in columns.split())


def _repeats(test: str, name: str, columns: str) -> str:
    return f"""SELECT '{test}', '{name}', '{columns}', count(*) FROM (SELECT 1 FROM {name} GROUP BY {columns} HAVING count(*) > 1)"""


def _strays(test: str, name: str, c: str, parent: str, p: str) -> str:
    return f"SELECT '{test}', '{name}', '{c}', count(DISTINCT {c}) FROM {name} WHERE {c} NOT IN (SELECT {p} FROM {parent})"


ORACLES["dq_star"] = f"""WITH {_CURRENCIES},
currencies AS (SELECT * EXCLUDE (errors) FROM checked WHERE errors = ''),
rates AS (SELECT * FROM (
    SELECT (event_id % 1200)::VARCHAR AS curr_base, (user_id % 1300)::VARCHAR AS currency, value::VARCHAR::DECIMAL(20,10) AS rate,
      date_trunc('hour', ts)::TIMESTAMP AS rate_date, date_trunc('year', ts) AS year FROM events)
  WHERE year = (SELECT max(date_trunc('year', ts)) FROM events) AND length(curr_base) = 3 AND length(currency) = 3
    AND rate BETWEEN 0.000001 AND 100000000
  QUALIFY row_number() OVER (PARTITION BY curr_base, currency, rate_date ORDER BY rate DESC) = 1),
dim_currencies AS (SELECT short_code AS currency_key, * EXCLUDE (id, short_code), {_FIRST} AS valid_from, true AS is_current FROM currencies
  QUALIFY row_number() OVER (PARTITION BY short_code ORDER BY id DESC) = 1),
dim_date AS (SELECT DISTINCT rate_date AS date, {_KEY.format('rate_date')} AS date_key FROM rates),
fact_rates AS (SELECT *, {_KEY.format('rate_date')} AS date_key FROM rates)
{_nulls('currencies', 'id name short_code code precision subunit symbol symbol_first decimal_mark')}
UNION ALL {_nulls('rates', 'curr_base currency rate_date')}
UNION ALL {_nulls('dim_currencies', 'currency_key name code precision subunit symbol symbol_first decimal_mark valid_from is_current')}
UNION ALL {_nulls('dim_date', 'date_key date')}
UNION ALL {_nulls('fact_rates', 'curr_base currency date_key')}
UNION ALL {_repeats('unique', 'currencies', 'short_code')} UNION ALL {_repeats('unique', 'currencies', 'code')}
UNION ALL {_repeats('primary_key', 'currencies', 'short_code')} UNION ALL {_repeats('primary_key', 'rates', 'curr_base,currency,rate_date')}
UNION ALL {_repeats('unique', 'dim_currencies', 'currency_key,valid_from')} UNION ALL {_repeats('unique', 'dim_date', 'date_key')}
UNION ALL {_strays('foreign_key', 'rates', 'curr_base', 'currencies', 'short_code')}
UNION ALL {_strays('foreign_key', 'rates', 'currency', 'currencies', 'short_code')}
UNION ALL {_strays('relationships', 'fact_rates', 'curr_base', 'dim_currencies', 'currency_key')}
UNION ALL {_strays('relationships', 'fact_rates', 'currency', 'dim_currencies', 'currency_key')}
UNION ALL {_strays('relationships', 'fact_rates', 'date_key', 'dim_date', 'date_key')}"""
ORACLES["events_star"] = """
SELECT date_trunc('minute', ts)::TIMESTAMP AS date, event_type, user_id, value FROM events
WHERE value BETWEEN 1 AND 300 AND ts >= TIMESTAMP '2024-01-01'
QUALIFY row_number() OVER (
  PARTITION BY date_trunc('minute', ts), event_type, user_id ORDER BY ts DESC, value DESC) = 1"""

# Decimals leave every query as their text.
_DECIMAL_COLUMNS = {
    "payload_explode": ("rate",), "payload_empty_guard": ("rate",), "payload_corrupt": ("rate",), "payload_files_streamed": ("rate",), "decimal_exact": ("price", "discount"),
    "fact_full": ("rate",), "fact_by_ledger": ("rate",), "star_loaded_empty_first": ("rate",), "payload_rescued": ("rate",), "rule_type": ("price",), "fact_late_rows": ("rate",), "fact_with_surrogates": ("rate",), "fact_full_every_row": ("rate",), "fact_incremental": ("rate",), "fact_full_refresh": ("rate",),
    "empty_target_incremental": ("rate",), "fact_readback": ("rate",), "star_loaded": ("rate",), "fact_topn": ("rate",),
    "silver_fact_valid": ("rate",), "silver_fact_rejected": ("rate",),
}
for _name, _columns in _DECIMAL_COLUMNS.items():
    _texts = ", ".join(f"{c}::VARCHAR AS {c}" for c in _columns)
    ORACLES[_name] = f"SELECT * REPLACE ({_texts}) FROM ({ORACLES[_name]})"
