"""DuckDB SQL for the same results as the catalogue, written independently of it.

Every text starts from the test tables; the ledger mapping is repeated as common
table expressions.
"""

from __future__ import annotations

from ledgerscope.functions.explanations import COLUMNS, DEFAULT_EXPLANATION, EXPLANATIONS

# Fixed values, stated here again so that a change of the library's own does not pass unseen.
FEATURES = {
    "sent_count_log": "activity volume",
    "received_count_log": "incoming volume",
    "send_receive_balance": "send/receive balance",
    "avg_sent_value_log": "transfer size",
    "avg_gas_price_log": "gas price posture",
    "counterparty_diversity": "counterparty spread",
    "contract_call_ratio": "contract-call ratio",
    "recent_burst_ratio": "recent burstiness",
    "night_ratio": "overnight activity",
    "weekend_ratio": "weekend activity",
    "active_span_log": "activity span",
}
# Address, name, type, risk, hub, contract.
BUILTIN_LABELS = [
    ("0xdAC17F958D2ee523a2206206994597C13D831ec7", "Tether USD", "stablecoin", "low", True, True),
    ("0xA0b86991c6218b36c1d19D4a2e9Eb0cE3606eB48", "USD Coin", "stablecoin", "low", True, True),
    ("0xC02aaA39b223FE8D0A0e5C4F27eAD9083C756Cc2", "Wrapped Ether", "token", "none", True, True),
    ("0x6B175474E89094C44Da98b954EedeAC495271d0F", "Dai Stablecoin", "stablecoin", "low", True, True),
    ("0x7a250d5630B4cF539739dF2C5dAcb4c659F2488D", "Uniswap V2 Router", "dex", "low", True, True),
    ("0xE592427A0AEce92De3Edee1F18E0157C05861564", "Uniswap V3 Router", "dex", "low", True, True),
    ("0x2260FAC5E5542a773Aa44fBCfeDf7C193bc2C599", "Wrapped Bitcoin", "wrapped_asset", "low", True, True),
    ("0xae7ab96520DE3A18E5e111B5EaAb095312D7fE84", "Lido Staked Ether", "staking", "low", True, True),
    ("0x514910771AF9Ca656af840dff83E8264EcF986CA", "Chainlink Token", "oracle_token", "low", True, True),
    ("0x9f8F72aA9304c8B593d555F12eF6589cC3A579A2", "Maker", "governance_token", "low", True, True),
]


def addr(number: str) -> str:
    return f"('0x' || lpad(lower(to_hex(({number})::BIGINT)), 40, '0'))"


def txh(number: str) -> str:
    return f"('0x' || sha256(({number})::VARCHAR))"


def pick(values: list[str], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[({index})::INT + 1]"


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + str(value).replace("'", "''") + "'"


ENTITY_TYPES = ["wallet", "exchange", "stablecoin", "mixer", "bridge"]
RISK_LEVELS = ["none", "low", "medium", "high"]
FLAG_TYPES = ["circular_flow", "similar_bytecode", "velocity_spike", "unknown_signal"]
SEVERITIES = ["low", "medium", "high"]
RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def label_of(rank: str) -> str:
    return f"CASE {rank} WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END"


CTES = {
    "ev": """SELECT event_id, ts AS timestamp, user_id, event_type, value, props,
        json_extract_string(props, '$.k')::BIGINT AS k FROM events""",
    "tx": f"""SELECT {txh('event_id')} AS hash, {addr('user_id')} AS from_address,
        CASE WHEN event_type <> 'signup' THEN {addr('k')} END AS to_address,
        round(value * 100)::BIGINT::HUGEINT * 10000000000000000::HUGEINT AS value,
        21000 + event_id % 50000 AS gas,
        (event_id % 97 + 1)::HUGEINT * 1000000000 AS gas_price,
        row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id) - 1 AS nonce,
        0::BIGINT AS block_number,
        CASE WHEN event_type IN ('click', 'view') THEN encode(props) END AS data,
        timestamp, event_type, event_id FROM ev""",
    "run": "SELECT max(timestamp) AS as_of FROM tx",
    "code": f"SELECT {addr('doc_id')} AS address, encode(text) AS bytecode FROM documents",
    "meta": f"""SELECT {addr('page_id')} AS address, html AS source_code,
        'v0.8.' || (page_id % 30) AS compiler_version, page_id % 2 = 0 AS verified FROM pages""",
    "ent": f"""SELECT {addr('n_nationkey')} AS address, n_name AS name,
        {pick(ENTITY_TYPES, 'n_regionkey')} AS entity_type, {pick(RISK_LEVELS, 'n_nationkey % 4')} AS risk_level,
        n_nationkey % 5 = 0 AS is_hub, CASE WHEN n_nationkey % 6 = 0 THEN 'manual' ELSE 'seed' END AS source,
        TIMESTAMP '2024-01-01' AS updated_at FROM nation""",
    "fl": f"""SELECT event_id AS id, {txh('event_id')} AS tx_hash, {addr('user_id')} AS address,
        {pick(FLAG_TYPES, 'k % 4')} AS flag_type, {pick(SEVERITIES, 'event_id % 3')} AS severity,
        CASE WHEN k % 10 <> 0 THEN 'k=' || k END AS description, timestamp AS detected_at
        FROM ev WHERE event_type = 'error'""",
    "jb": f"""SELECT {txh('o_orderkey')} AS tx_hash,
        CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' END AS status,
        (o_orderkey % 4)::INT AS attempts, CASE WHEN o_orderkey % 4 > 1 THEN 'timeout' END AS last_error,
        o_orderdate AS available_at, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS locked_at,
        o_orderdate AS updated_at FROM orders""",
    "tch": """SELECT hash, 'out' AS direction, from_address AS address, to_address AS counterparty, value, gas_price, data, timestamp FROM tx
        UNION ALL SELECT hash, 'in', to_address, from_address, value, gas_price, data, timestamp FROM tx WHERE to_address IS NOT NULL""",
    "acc": """SELECT address, 0::HUGEINT AS balance,
        bool_or(direction = 'in' AND octet_length(data) > 0) IS TRUE AND address IN (SELECT address FROM code) AS is_contract,
        min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM tch GROUP BY address""",
    "risk": f"SELECT address, {label_of(f'max({RANK})')} AS flag_risk FROM fl GROUP BY address",
    "lab": """SELECT a.address, a.is_contract, coalesce(e.name, '') AS entity_name,
        coalesce(e.entity_type, CASE WHEN a.is_contract THEN 'contract' ELSE 'wallet' END) AS entity_type,
        coalesce(e.risk_level, r.flag_risk, 'none') AS risk_level,
        CASE WHEN r.flag_risk <> 'none' THEN r.flag_risk ELSE coalesce(e.risk_level, 'none') END AS graph_risk,
        coalesce(e.is_hub, false) AS is_hub, e.updated_at
        FROM acc a LEFT JOIN ent e USING (address) LEFT JOIN risk r USING (address)""",
    "edg": "SELECT * FROM tx WHERE to_address IS NOT NULL",
    "prs": """SELECT from_address AS src, to_address AS dst, min(hash) AS hash, min(timestamp) AS since
        FROM edg GROUP BY from_address, to_address""",
    "act": """SELECT address, count(*) FILTER (direction = 'out') AS sent_count,
        count(*) FILTER (direction = 'in') AS received_count, count(*) AS total_count,
        coalesce(sum(value) FILTER (direction = 'out'), 0)::VARCHAR AS total_sent,
        coalesce(sum(value) FILTER (direction = 'in'), 0)::VARCHAR AS total_received FROM tch GROUP BY address""",
    "partners": """SELECT *, row_number() OVER (PARTITION BY address ORDER BY total_count DESC, last_seen DESC, counterparty) AS position
        FROM (SELECT address, counterparty, count(*) FILTER (direction = 'out') AS sent_count,
              count(*) FILTER (direction = 'in') AS received_count, count(*) AS total_count,
              sum(value) AS total_value, max(timestamp) AS last_seen
              FROM tch WHERE counterparty IS NOT NULL GROUP BY address, counterparty)
        QUALIFY position <= 8""",
    "once": "SELECT * FROM tch WHERE NOT (direction = 'in' AND address = counterparty)",
    "recent8": """SELECT o.address, t.*, row_number() OVER (PARTITION BY o.address ORDER BY t.timestamp DESC, t.hash) AS position
        FROM once o JOIN tx t USING (hash) QUALIFY position <= 8""",
    "deliv": f"""SELECT {txh('event_id')} AS hash, {addr('user_id')} AS from_address,
        CASE WHEN event_type <> 'signup' THEN {addr('k')} END AS to_address,
        CASE WHEN event_type = 'signup' THEN '0' WHEN k IN (97, 98, 99) THEN NULL
             ELSE (round(value * 100)::BIGINT::HUGEINT * 10000000000000000::HUGEINT)::VARCHAR END AS value,
        21000 + event_id % 50000 AS gas, ((event_id % 97 + 1)::HUGEINT * 1000000000)::VARCHAR AS gas_price,
        0::BIGINT AS nonce, 0::BIGINT AS block_number,
        CASE WHEN event_type IN ('click', 'view') THEN encode(props) END AS data,
        timestamp + to_minutes((5 * copy)::INT) AS timestamp,
        CASE WHEN event_type <> 'signup' AND k IN (97, 98, 99) THEN 'value does not fit' END AS problem
        FROM ev, LATERAL (SELECT unnest(CASE WHEN event_type = 'error' THEN [0, 1] ELSE [0] END) AS copy)""",
    "repflags": f"""SELECT (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS id, {txh('l_orderkey')} AS tx_hash,
        CASE WHEN l_suppkey % 10 <> 0 THEN {addr('l_suppkey % 50')} END AS address,
        {pick(FLAG_TYPES, 'l_partkey % 4')} AS flag_type, l_shipdate AS detected_at FROM lineitem""",
    "nodetch": f"""SELECT event_type, timestamp, {addr('user_id')} AS address, event_id * 2 AS touch_id, false AS called
        FROM ev WHERE event_type <> 'signup'
        UNION ALL SELECT event_type, timestamp, {addr('k')}, event_id * 2 + 1, event_type IN ('click', 'view')
        FROM ev WHERE event_type <> 'signup'""",
    "nodes": """SELECT address, event_type, min(touch_id) AS node_id, bool_or(called) AS is_contract,
        min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM nodetch GROUP BY address, event_type""",
    "stored": """SELECT address, bytecode, address IN (SELECT address FROM fl WHERE flag_type = 'similar_bytecode') AS flagged
        FROM code WHERE octet_length(bytecode) > 0""",
    "stats": """SELECT address, count(*) FILTER (direction = 'out') AS sent_count,
        count(*) FILTER (direction = 'in') AS received_count,
        coalesce(sum(value) FILTER (direction = 'out')::DOUBLE / nullif(count(value) FILTER (direction = 'out'), 0), 0) AS avg_sent_value,
        coalesce(sum(gas_price) FILTER (direction = 'out')::DOUBLE / nullif(count(gas_price) FILTER (direction = 'out'), 0), 0) AS avg_gas_price,
        count(DISTINCT counterparty) AS unique_counterparties,
        count(*) FILTER (direction = 'out' AND octet_length(data) > 0) / count(*) AS contract_call_ratio,
        count(*) FILTER (timestamp >= (SELECT as_of FROM run) - INTERVAL 1 HOUR) AS recent_one_hour,
        count(*) FILTER (timestamp >= (SELECT as_of FROM run) - INTERVAL 24 HOUR) AS recent_twenty_four_hours,
        count(*) FILTER (hour(timestamp) BETWEEN 0 AND 5) / count(*) AS night_ratio,
        count(*) FILTER (dayofweek(timestamp) IN (0, 6)) / count(*) AS weekend_ratio,
        (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3.6e9 AS active_span_hours
        FROM once GROUP BY address""",
    "feat": """SELECT address, sent_count + received_count AS sample_size,
        ln(1 + sent_count) AS sent_count_log, ln(1 + received_count) AS received_count_log,
        (sent_count - received_count) / (sent_count + received_count) AS send_receive_balance,
        log10(avg_sent_value + 1) AS avg_sent_value_log, log10(avg_gas_price + 1) AS avg_gas_price_log,
        unique_counterparties / (sent_count + received_count) AS counterparty_diversity, contract_call_ratio,
        CASE WHEN recent_twenty_four_hours > 0 THEN recent_one_hour / recent_twenty_four_hours ELSE 0 END AS recent_burst_ratio,
        night_ratio, weekend_ratio, ln(1 + active_span_hours) AS active_span_log FROM stats""",
    "fvec": f"""SELECT address, list_concat([round(f / sqrt(list_sum([g * g FOR g IN fs])), 6)::FLOAT FOR f IN fs],
        [0::FLOAT FOR i IN range(117)]) AS embedding FROM (SELECT address, [{', '.join(FEATURES)}] AS fs FROM feat)""",
    "fsim": """SELECT a.address, b.address AS match,
        round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity,
        row_number() OVER (PARTITION BY a.address ORDER BY
            round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.address) AS position
        FROM fvec a JOIN fvec b ON a.address <> b.address QUALIFY position <= 6""",
}

# Fingerprints: three counted contributions per byte, from the hexadecimal text of the code.
FINGERPRINT = """
octets_{n} AS (SELECT address, unnest(range(len(l))) AS i, unnest(l) AS b, unnest(list_concat([NULL], l)[:len(l)]) AS p
    FROM (SELECT address, list_transform(regexp_extract_all(hex(bytecode), '..'), lambda h: ('0x' || h)::INT) AS l
          FROM {source} WHERE octet_length(bytecode) > 0)),
slots_{n} AS (SELECT address, slot, sum(w) AS w FROM (
    SELECT address, b % 128 AS slot, 1.0::DOUBLE AS w FROM octets_{n}
    UNION ALL SELECT address, (i + b) % 128, 0.25 FROM octets_{n}
    UNION ALL SELECT address, xor(p, b) % 128, 0.5 FROM octets_{n} WHERE p IS NOT NULL) GROUP BY address, slot),
{n} AS (SELECT address, list(round(coalesce(w, 0) / length, 6)::FLOAT ORDER BY slot) AS embedding
    FROM (SELECT address, sqrt(sum(w * w)) AS length, unnest(range(128)) AS slot FROM slots_{n} GROUP BY address)
    LEFT JOIN slots_{n} USING (address, slot) GROUP BY address)"""

MICRO = "list_aggregate([round(x::DOUBLE * 1000000)::BIGINT::VARCHAR FOR x IN embedding], 'string_agg', ',')"

DEPENDS = {
    "tx": ["ev"], "run": ["tx"], "fl": ["ev"], "tch": ["tx"], "acc": ["tch", "code"], "risk": ["fl"],
    "lab": ["acc", "ent", "risk"], "edg": ["tx"], "prs": ["edg"], "act": ["tch"], "partners": ["tch"],
    "once": ["tch"], "recent8": ["once", "tx"], "deliv": ["ev"], "nodetch": ["ev"], "nodes": ["nodetch"],
    "stored": ["code", "fl"], "stats": ["once", "run"], "feat": ["stats"], "fvec": ["feat"], "fsim": ["fvec"],
}


def sql(body: str, *needs: str, extra: str = "") -> str:
    """``body`` after the table expressions it needs, each after its own needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        for below in DEPENDS.get(name, []):
            visit(below)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    parts = [f"{name} AS ({CTES[name]})" for name in order]
    if extra:
        parts.append(extra)
    return f"WITH {', '.join(parts)} {body}" if parts else body


def network(bucket: str, hours: int) -> str:
    return f"""(SELECT b.bucket, b.transaction_count, p.unique_addresses, b.avg_gas_price, b.total_value FROM
        (SELECT date_trunc('{bucket}', timestamp)::TIMESTAMP AS bucket, count(*) AS transaction_count,
                sum(gas_price)::DOUBLE / count(*) AS avg_gas_price, sum(value)::VARCHAR AS total_value
         FROM tx WHERE timestamp >= (SELECT as_of FROM run) - INTERVAL {hours} HOUR GROUP BY 1) b
        JOIN (SELECT date_trunc('{bucket}', timestamp)::TIMESTAMP AS bucket, count(DISTINCT address) AS unique_addresses
         FROM tch WHERE timestamp >= (SELECT as_of FROM run) - INTERVAL {hours} HOUR GROUP BY 1) p USING (bucket))"""


def velocity(hours: int) -> str:
    return f"""SELECT address, date_trunc('hour', timestamp)::TIMESTAMP AS bucket,
        count(*) FILTER (direction = 'out') AS sent_count, count(*) FILTER (direction = 'in') AS received_count,
        count(*) AS total_count, coalesce(sum(value) FILTER (direction = 'out'), 0)::VARCHAR AS sent_value,
        coalesce(sum(value) FILTER (direction = 'in'), 0)::VARCHAR AS received_value, sum(value)::VARCHAR AS total_value
        FROM tch WHERE timestamp >= (SELECT as_of FROM run) - INTERVAL {hours} HOUR GROUP BY 1, 2"""


def flag_series(bucket: str, hours: int) -> str:
    return f"""SELECT date_trunc('{bucket}', detected_at)::TIMESTAMP AS bucket, flag_type, severity, count(*) AS count
        FROM fl WHERE detected_at >= (SELECT as_of FROM run) - INTERVAL {hours} HOUR GROUP BY 1, 2, 3"""


def delta(now: str, before: str) -> str:
    return f"""CASE WHEN coalesce({before}, 0) = 0 THEN CASE WHEN {now} <> 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END
        ELSE ({now} - {before})::DOUBLE / greatest({before}, 1) * 100 END"""


def unit(amount: str, power: int, precision: int, suffix: str) -> str:
    whole = f"({amount} // (10::HUGEINT ** {power})::HUGEINT)::VARCHAR"
    rest = f"rtrim(left(right(lpad({amount}::VARCHAR, {power + 30}, '0'), {power}), {precision}), '0')"
    return f"{whole} || CASE WHEN {rest} <> '' THEN '.' || {rest} ELSE '' END || ' {suffix}'"


def compact(value: str) -> str:
    def scaled(divisor: str, suffix: str) -> str:
        return f"regexp_replace(printf('%.1f', round({value} / {divisor}, 1)), '\\.0$', '') || '{suffix}'"

    return f"""CASE WHEN {value} IS NULL THEN '0' WHEN {value} < 999.95 THEN {scaled('1e0', '')}
        WHEN {value} < 999.95e3 THEN {scaled('1e3', 'K')} WHEN {value} < 999.95e6 THEN {scaled('1e6', 'M')}
        WHEN {value} < 999.95e9 THEN {scaled('1e9', 'B')} ELSE {scaled('1e12', 'T')} END"""


def explained(column: int) -> str:
    cases = " ".join(f"WHEN {quoted(name)} THEN {quoted(texts[column])}" for name, texts in EXPLANATIONS.items())
    return f"CASE flag_type {cases} ELSE {quoted(DEFAULT_EXPLANATION[column])} END AS {COLUMNS[column]}"


EXPLAINED = ", ".join(explained(i) for i in range(len(COLUMNS)))
LISTED_FLAGS = """SELECT id, coalesce(tx_hash, '') AS tx_hash, address, flag_type, severity,
    coalesce(description, '') AS description, detected_at FROM fl"""
LISTED_TX = """hash, from_address, to_address, value::VARCHAR AS value, gas, gas_price::VARCHAR AS gas_price, nonce,
    block_number, timestamp"""
HEX_DATA = "'0x' || lower(hex(coalesce(data, ''::BLOB)))"
RECENT_CONTRACTS = """(SELECT a.address, coalesce(s.flagged, false) AS flagged, coalesce(octet_length(s.bytecode), 0)::INT AS bytecode_size,
    a.first_seen, a.last_seen FROM acc a LEFT JOIN stored s USING (address) WHERE a.is_contract ORDER BY a.last_seen DESC, a.address LIMIT {n})"""

# All shortest walks between requested ends, level by level over collapsed pairs.
WALKS = """
w1 AS (SELECT q.src, q.dst, 1 AS hops, p.src || ',' || p.dst AS path, p.hash AS hashes FROM req q JOIN prs p USING (src, dst)),
w2 AS (SELECT q.src, q.dst, 2 AS hops, min(a.src || ',' || a.dst || ',' || b.dst) AS path,
        min_by(a.hash || ',' || b.hash, a.dst) AS hashes
    FROM req q ANTI JOIN w1 USING (src, dst) JOIN prs a ON a.src = q.src JOIN prs b ON b.src = a.dst AND b.dst = q.dst
    GROUP BY q.src, q.dst),
left3 AS (SELECT * FROM req ANTI JOIN w1 USING (src, dst) ANTI JOIN w2 USING (src, dst)),
w3 AS (SELECT q.src, q.dst, 3 AS hops, min(a.src || ',' || a.dst || ',' || b.dst || ',' || c.dst) AS path,
        min_by(a.hash || ',' || b.hash || ',' || c.hash, a.dst || b.dst) AS hashes
    FROM left3 q JOIN prs a ON a.src = q.src JOIN prs b ON b.src = a.dst JOIN prs c ON c.src = b.dst AND c.dst = q.dst
    GROUP BY q.src, q.dst),
walks AS (FROM w1 UNION ALL FROM w2 UNION ALL FROM w3)"""

TO_HUB = """req AS (SELECT address AS src, hub AS dst FROM acc, (SELECT address AS hub FROM
    (SELECT from_address AS address FROM edg UNION ALL SELECT to_address FROM edg)
    GROUP BY address ORDER BY count(*) DESC, address LIMIT 1))"""

# Undirected trails of up to two edges around every account, the first fifty each.
TRAILS = """
sides AS (SELECT from_address AS node, to_address AS other, hash FROM edg
    UNION ALL SELECT to_address, from_address, hash FROM edg WHERE from_address <> to_address),
t1 AS (SELECT node AS center, other AS tip, [hash] AS hashes, [node, other] AS nodes FROM sides),
t2 AS (SELECT t1.center, s.other AS tip, list_append(hashes, s.hash) AS hashes, list_append(nodes, s.other) AS nodes
    FROM t1 JOIN sides s ON s.node = t1.tip AND NOT list_contains(hashes, s.hash)),
trails AS (SELECT *, row_number() OVER (PARTITION BY center ORDER BY len(hashes), hashes) AS n
    FROM (FROM t1 UNION ALL FROM t2) QUALIFY n <= 50),
gnodes AS (SELECT DISTINCT center, unnest(nodes) AS node FROM trails),
gedges AS (SELECT DISTINCT center, unnest(hashes) AS hash FROM trails),
gdeg AS (SELECT center, node, count(*) AS degree FROM (
    SELECT center, from_address AS node FROM gedges JOIN edg USING (hash)
    UNION ALL SELECT center, to_address FROM gedges JOIN edg USING (hash)) GROUP BY center, node),
gout AS (SELECT g.center, g.node, coalesce(l.is_contract, false) AS is_contract, coalesce(l.entity_name, '') AS entity_name,
        coalesce(l.entity_type, 'wallet') AS entity_type, coalesce(l.graph_risk, 'none') AS risk_level,
        coalesce(l.is_hub, false) OR coalesce(d.degree, 0) >= 4 AS is_hub, coalesce(d.degree, 0) AS degree
    FROM gnodes g LEFT JOIN gdeg d USING (center, node) LEFT JOIN lab l ON l.address = g.node
    UNION ALL SELECT address, address, is_contract, entity_name, entity_type,
        CASE WHEN address IN (SELECT address FROM risk WHERE flag_risk <> 'none') THEN graph_risk ELSE risk_level END, is_hub, 0
    FROM lab WHERE address NOT IN (SELECT node FROM sides))"""

# The earliest-complete return path per pair and hop count: latest edge first, then the next, then addresses.
RETURNS = """
req AS (SELECT DISTINCT to_address AS src, from_address AS dst FROM edg WHERE coalesce(octet_length(data), 0) = 0),
b1 AS (SELECT src, dst, 1 AS hops, [since] AS times, [src, dst] AS path FROM req JOIN prs USING (src, dst)),
b2 AS (SELECT q.src, q.dst, 2 AS hops, min({'t': list_sort([a.since, b.since], 'DESC'), 'p': [a.src, a.dst, b.dst]}) AS best
    FROM req q JOIN prs a ON a.src = q.src JOIN prs b ON b.src = a.dst AND b.dst = q.dst GROUP BY ALL),
b3 AS (SELECT q.src, q.dst, 3 AS hops,
        min({'t': list_sort([a.since, b.since, c.since], 'DESC'), 'p': [a.src, a.dst, b.dst, c.dst]}) AS best
    FROM req q JOIN prs a ON a.src = q.src JOIN prs b ON b.src = a.dst JOIN prs c ON c.src = b.dst AND c.dst = q.dst GROUP BY ALL),
returns AS (FROM b1 UNION ALL SELECT src, dst, hops, best.t, best.p FROM b2 UNION ALL SELECT src, dst, hops, best.t, best.p FROM b3),
circular AS (SELECT t.hash AS tx_hash, t.from_address AS address, 'circular_flow' AS flag_type,
        CASE WHEN r.hops <= 2 THEN 'high' ELSE 'medium' END AS severity,
        'Detected a ' || r.hops || '-hop return path from ' || t.to_address || ' back to ' || t.from_address || ': '
            || array_to_string(r.path, ' -> ') AS description,
        t.timestamp AS detected_at, r.hops
    FROM edg t JOIN returns r ON r.src = t.to_address AND r.dst = t.from_address AND r.times[1] <= t.timestamp
    WHERE coalesce(octet_length(t.data), 0) = 0
    QUALIFY row_number() OVER (PARTITION BY t.hash ORDER BY r.hops) = 1)"""

CALLS = """SELECT t.hash, t.from_address, t.to_address, octet_length(c.bytecode)::INT AS bytecode_size, t.timestamp
    FROM tx t JOIN code c ON c.address = t.to_address WHERE octet_length(t.data) > 0 AND octet_length(c.bytecode) > 0"""


def nearest(queries: str, pool: str, k: int) -> str:
    return f"""(SELECT a.address, b.address AS match, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s,
        row_number() OVER (PARTITION BY a.address ORDER BY
            round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.address) AS position
        FROM {queries} a JOIN {pool} b ON a.address <> b.address QUALIFY position <= {k})"""


def similar_flags(pool: str) -> str:
    return f"""SELECT c.hash AS tx_hash, c.to_address AS address, 'similar_bytecode' AS flag_type,
        CASE WHEN s >= 0.995 THEN 'high' WHEN s >= 0.985 THEN 'medium' ELSE 'low' END AS severity,
        'Contract ' || c.to_address || ' is ' || printf('%.2f', s) || ' similar to ' || n.match
            || ' based on pgvector bytecode fingerprints' AS description,
        c.timestamp AS detected_at, s AS similarity
        FROM ({CALLS}) c JOIN {nearest(pool, pool, 1)} n ON n.address = c.to_address WHERE s >= 0.98"""


# Events arrive in four batches; a call is held against the contracts called so far.
SIMILAR_SO_FAR = f"""bounds AS (SELECT min(event_id) AS low, (max(event_id) - min(event_id)) // 4 + 1 AS step FROM ev),
calls AS (SELECT c.*, (e.event_id - b.low) // b.step AS part FROM ({CALLS}) c JOIN ev e ON c.hash = {txh('e.event_id')} CROSS JOIN bounds b),
seen AS (SELECT v.*, f.part FROM vec v JOIN (SELECT to_address AS address, min(part) AS part FROM calls GROUP BY 1) f USING (address)),
best AS (SELECT p.to_address, p.part, max(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)) AS s
    FROM (SELECT DISTINCT to_address, part FROM calls) p JOIN seen a ON a.address = p.to_address
    JOIN seen b ON b.address <> a.address AND b.part <= p.part GROUP BY 1, 2),
alike AS (SELECT c.hash AS tx_hash, c.to_address AS address, 'similar_bytecode' AS flag_type,
    CASE WHEN s >= 0.995 THEN 'high' WHEN s >= 0.985 THEN 'medium' ELSE 'low' END AS severity, c.timestamp AS detected_at
    FROM calls c JOIN best USING (to_address, part) WHERE s >= 0.98)"""


def features_top() -> str:
    unpivoted = " UNION ALL ".join(
        f"SELECT address, {i} AS i, '{n}' AS feature, {n} AS v FROM feat" for i, n in enumerate(FEATURES)
    )
    return f"""SELECT address, row_number() OVER (PARTITION BY address ORDER BY abs(v) DESC, i) AS position, feature,
        array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(feature, '_')], ' ') AS label,
        printf('%+.2f', round(v, 2)) AS shown FROM ({unpivoted}) QUALIFY position <= 5"""


def highlights() -> str:
    deltas = ", ".join(
        f"{{'d': abs(a.{n} - b.{n}), 'i': {i}, 't': 'similar {words}'}}" for i, (n, words) in enumerate(FEATURES.items())
    )
    return f"""SELECT s.address, s.match, array_to_string([x.t FOR x IN list_sort([{deltas}])[:3]], '; ') AS highlights
        FROM fsim s JOIN feat a ON a.address = s.address JOIN feat b ON b.address = s.match"""


SEEDS = ", ".join(
    f"({quoted(a.lower())}, {quoted(n)}, {quoted(t)}, {quoted(r)}, {quoted(h)}, {quoted(c)})" for a, n, t, r, h, c in BUILTIN_LABELS
)
SEED_CTE = f"""seeds AS (SELECT * FROM (VALUES {SEEDS}) s(address, name, entity_type, risk_level, is_hub, is_contract))"""
ROUNDED_FEATURES = ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in FEATURES)

def velocity_flags(minimum: int) -> str:
    return f"""SELECT last.hash AS tx_hash, address, 'velocity_spike' AS flag_type, 'medium' AS severity,
    total_count || ' transactions within an hour after ' || baseline_count || ' in the 24 hours before' AS description,
    last.timestamp AS detected_at, bucket, total_count, baseline_count
    FROM (SELECT *, coalesce(sum(total_count) OVER (PARTITION BY address ORDER BY bucket
            RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND INTERVAL 1 HOUR PRECEDING), 0)::BIGINT AS baseline_count
        FROM (SELECT address, date_trunc('hour', timestamp)::TIMESTAMP AS bucket, count(*) AS total_count,
            max({{'timestamp': timestamp, 'hash': hash}}) AS last FROM tch GROUP BY ALL))
    WHERE total_count >= {minimum} AND total_count * 24 > baseline_count * 3"""


JOB_STATES = f"""WITH je AS (SELECT {txh('l_orderkey')} AS tx_hash,
        CASE l_returnflag WHEN 'A' THEN 'claimed' WHEN 'R' THEN 'failed' WHEN 'N' THEN 'done' END AS kind,
        'line ' || l_linenumber AS error, l_shipdate AS moved, l_linenumber AS seq FROM lineitem),
    jf AS (SELECT tx_hash, arg_max(kind, row(moved, seq, kind)) AS k, max(moved) AS last_at,
        count(*) FILTER (kind = 'claimed') AS attempts,
        arg_max(CASE WHEN kind = 'failed' THEN error ELSE '' END, row(moved, seq, kind)) FILTER (kind <> 'claimed') AS err,
        max(moved) FILTER (kind = 'failed') AS failed_at, min(moved) AS first_at FROM je GROUP BY tx_hash)
    SELECT tx_hash, CASE k WHEN 'claimed' THEN 'processing' WHEN 'done' THEN 'done' ELSE 'pending' END AS status, attempts,
        nullif(err, '') AS last_error, coalesce(failed_at + INTERVAL 15 SECOND, first_at) AS available_at,
        CASE WHEN k = 'claimed' THEN last_at END AS locked_at, last_at AS updated_at FROM jf"""


ORACLES: dict[str, str] = {
    "ledger_projection": sql(f"SELECT * EXCLUDE (data), {HEX_DATA} AS data FROM deliv", "deliv"),
    "ledger_dedup": sql(
        """SELECT hash, from_address, to_address, value, min(timestamp) AS timestamp FROM deliv WHERE problem IS NULL
        GROUP BY hash, from_address, to_address, value""",
        "deliv",
    ),
    "accounts_build": sql("SELECT * REPLACE (balance::VARCHAR AS balance) FROM acc", "acc"),
    "jobs_enqueue": sql(
        """SELECT hash AS tx_hash, 'pending' AS status, 0 AS attempts, (SELECT as_of FROM run) AS available_at
        FROM tx WHERE to_address IS NOT NULL AND hash NOT IN (SELECT tx_hash FROM jb WHERE status <> 'done')""",
        "run", "jb",
    ),
    "flags_dedup": sql(
        """SELECT * FROM repflags QUALIFY address IS NULL
        OR row_number() OVER (PARTITION BY tx_hash, address, flag_type ORDER BY detected_at, id) = 1""",
        "repflags",
    ),
    "flags_dedup_latest": sql(
        """SELECT * FROM repflags QUALIFY address IS NULL
        OR row_number() OVER (PARTITION BY tx_hash, address, flag_type ORDER BY id DESC, detected_at DESC) = 1""",
        "repflags",
    ),
    "entities_seed_merge": sql(
        f"""SELECT coalesce(o.address, s.address) AS address,
        CASE WHEN w THEN s.name ELSE o.name END AS name, CASE WHEN w THEN s.entity_type ELSE o.entity_type END AS entity_type,
        CASE WHEN w THEN s.risk_level ELSE o.risk_level END AS risk_level, CASE WHEN w THEN s.is_hub ELSE o.is_hub END AS is_hub,
        CASE WHEN w THEN 'seed' ELSE o.source END AS source,
        CASE WHEN w THEN (SELECT as_of FROM run) ELSE o.updated_at END AS updated_at, w AS written
        FROM (SELECT o, s, s.address IS NOT NULL AND coalesce(o.source, '') <> 'manual' AS w FROM ent o FULL JOIN allseeds s USING (address))""",
        "ent", "run",
        extra=f"""{SEED_CTE}, allseeds AS (SELECT address, name, entity_type, risk_level, is_hub FROM seeds
        UNION ALL SELECT {addr('s_suppkey')}, s_name, {pick(ENTITY_TYPES, 's_suppkey % 5')},
        {pick(RISK_LEVELS, 's_nationkey % 4')}, s_suppkey % 3 = 0 FROM supplier)""",
    ),
    "seeded_accounts": sql(
        """SELECT coalesce(a.address, s.address) AS address, coalesce(a.balance, 0)::VARCHAR AS balance,
        coalesce(a.is_contract, false) OR coalesce(s.is_contract, false) AS is_contract,
        coalesce(a.first_seen, (SELECT as_of FROM run)) AS first_seen, coalesce(a.last_seen, (SELECT as_of FROM run)) AS last_seen
        FROM acc a FULL JOIN seeds s USING (address)""",
        "acc", "run", extra=SEED_CTE,
    ),
    "contract_vectors_build": sql(
        f"SELECT address, octet_length(bytecode)::INT AS bytecode_size, {MICRO} AS embedding, false AS flagged FROM code JOIN vec USING (address)",
        "code", extra=FINGERPRINT.format(n="vec", source="code"),
    ),
    "latest_bytecode": f"""SELECT address, '0x' || lower(hex(max_by(code, (seen, code)))) AS bytecode FROM (
        SELECT {addr('doc_id')} AS address, encode(text) AS code, n_chars AS seen FROM documents
        UNION ALL SELECT {addr('page_id')}, encode(html), length(html) FROM pages) WHERE octet_length(code) > 0 GROUP BY address""",
    "contracts_flagged": sql("SELECT address, flagged FROM stored", "stored"),
    "graph_edges": sql(f"SELECT {LISTED_TX} FROM edg", "edg"),
    "graph_vertices": sql(
        """SELECT address, address IN (SELECT address FROM acc WHERE is_contract) AS is_contract,
        min(timestamp) AS first_seen, max(timestamp) AS last_seen
        FROM (SELECT from_address AS address, timestamp FROM edg UNION ALL SELECT to_address, timestamp FROM edg) GROUP BY address""",
        "edg", "acc",
    ),
    "contract_calls_with_code": sql(f"SELECT hash, from_address, to_address, bytecode_size FROM ({CALLS})", "tx", "code"),
    "network_history_csv": sql(
        f"SELECT bucket, transaction_count, unique_addresses, total_value FROM {network('hour', 168)}", "tx", "tch", "run"
    ),
    "account_lookup": sql(
        "SELECT * REPLACE (balance::VARCHAR AS balance) FROM acc WHERE address IN (SELECT address FROM ent)", "acc", "ent"
    ),
    "tx_by_hash": sql(
        f"SELECT {LISTED_TX}, {HEX_DATA} AS data FROM tx WHERE hash IN (SELECT tx_hash FROM jb)", "tx", "jb"
    ),
    "flags_for_tx": sql(f"{LISTED_FLAGS} WHERE tx_hash IN (SELECT tx_hash FROM jb)", "fl", "jb"),
    "entities_by_addresses": sql("SELECT * FROM ent WHERE address IN (SELECT address FROM tch)", "ent", "tch"),
    "recent_tx_per_account": sql(
        "SELECT address, position, hash, from_address, to_address, value::VARCHAR AS value, nonce, timestamp FROM recent8", "recent8"
    ),
    "recent_tx_window": sql(
        """SELECT hash, timestamp FROM (SELECT * FROM tx ORDER BY timestamp DESC, hash LIMIT 50)
        WHERE timestamp >= (SELECT as_of FROM run) - INTERVAL 1 HOUR""",
        "tx", "run",
    ),
    "jobs_claimable": sql(
        """SELECT tx_hash, status, attempts, available_at, from_address, to_address, value::VARCHAR AS value
        FROM jb JOIN tx ON tx_hash = hash WHERE available_at <= (SELECT as_of FROM run)
        AND (status = 'pending' OR (status = 'processing' AND locked_at <= (SELECT as_of FROM run) - INTERVAL 2 MINUTE))""",
        "jb", "tx", "run",
    ),
    "jobs_claimable_first": sql(
        """SELECT tx_hash, status, attempts, available_at, row_number() OVER (ORDER BY available_at, updated_at, tx_hash) AS place
        FROM jb JOIN tx ON tx_hash = hash WHERE available_at <= (SELECT as_of FROM run)
        AND (status = 'pending' OR (status = 'processing' AND locked_at <= (SELECT as_of FROM run) - INTERVAL 2 MINUTE))
        QUALIFY place <= 50""",
        "jb", "tx", "run",
    ),
    "jobs_latest_state": JOB_STATES,
    "circular_candidates": sql(
        "SELECT hash, from_address, to_address, timestamp FROM edg WHERE coalesce(octet_length(data), 0) = 0", "edg"
    ),
    "classify_search_terms": sql(
        """SELECT DISTINCT term, CASE WHEN regexp_full_match(term, '0x[0-9a-fA-F]{64}') THEN 'transaction' ELSE 'account' END AS target
        FROM (SELECT hash AS term FROM tch UNION ALL SELECT address FROM tch)""",
        "tch",
    ),
    "touches": sql("SELECT hash, direction, address, counterparty FROM tch", "tch"),
    "address_risk": sql("SELECT * FROM risk", "risk"),
    "risk_label_first": sql("SELECT address, risk_level FROM lab", "lab"),
    "risk_flags_first": sql("SELECT address, graph_risk AS risk_level FROM lab", "lab"),
    "address_activity": sql("SELECT * FROM act", "act"),
    "account_profile": sql(
        """SELECT a.address, a.balance::VARCHAR AS balance, a.is_contract, a.first_seen, a.last_seen, t.sent_count, t.received_count,
        t.total_count, t.total_sent, t.total_received, coalesce(f.n, 0) AS flag_count, coalesce(f.high, 0) AS high_severity_flag_count,
        l.risk_level, l.entity_name, l.entity_type, l.is_hub, p.counterparties, r.recent_transactions
        FROM acc a JOIN act t USING (address) JOIN lab l USING (address)
        LEFT JOIN (SELECT address, count(*) AS n, count(*) FILTER (severity = 'high') AS high FROM fl GROUP BY address) f USING (address)
        LEFT JOIN (SELECT address, string_agg(counterparty, ',' ORDER BY position) AS counterparties FROM partners GROUP BY address) p USING (address)
        LEFT JOIN (SELECT address, string_agg(hash, ',' ORDER BY position) AS recent_transactions FROM recent8 GROUP BY address) r USING (address)""",
        "lab", "act", "fl", "partners", "recent8",
    ),
    "counterparties": sql(
        """SELECT p.address, p.counterparty, p.position, l.entity_name, l.entity_type, l.risk_level, l.is_contract, p.sent_count,
        p.received_count, p.total_count, p.total_value::VARCHAR AS total_value, p.last_seen
        FROM partners p JOIN lab l ON l.address = p.counterparty""",
        "partners", "lab",
    ),
    "counterparty_total": sql("SELECT address, sum(total_value)::VARCHAR AS total_value FROM partners GROUP BY address", "partners"),
    "network_metrics": sql(f"SELECT * FROM {network('hour', 24)}", "tx", "tch", "run"),
    "network_metrics_daily": sql(f"SELECT * FROM {network('day', 720)}", "tx", "tch", "run"),
    "address_velocity": sql(velocity(72), "tch", "run"),
    "velocity_peak": sql(
        f"SELECT address, max(total_count) AS peak, count(*) AS buckets FROM ({velocity(720)}) GROUP BY address", "tch", "run"
    ),
    "flag_series": sql(flag_series("hour", 24), "fl", "run"),
    "flag_series_daily": sql(flag_series("day", 720), "fl", "run"),
    "overview_stats": sql(
        """SELECT (SELECT count(*) FROM tx) AS transaction_count, (SELECT count(*) FROM acc) AS account_count,
        (SELECT count(*) FROM acc WHERE is_contract) AS contract_count, (SELECT count(*) FROM fl) AS flag_count,
        (SELECT count(*) FROM jb WHERE status = 'pending') AS pending_enrichment,
        (SELECT count(*) FROM jb WHERE status = 'processing') AS processing_enrichment,
        (SELECT count(*) FROM jb WHERE status = 'done') AS done_enrichment, (SELECT as_of FROM run) AS latest_transaction_at""",
        "run", "acc", "fl", "jb",
    ),
    "enrichment_status": sql(
        """SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'processing') AS processing,
        count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'pending' AND attempts > 0) AS retrying,
        max(attempts) AS max_attempts, min(available_at) FILTER (status = 'pending') AS oldest_pending_at FROM jb""",
        "jb",
    ),
    "top_addresses": sql(
        """SELECT address, is_contract, first_seen, last_seen, sent_count, received_count, total_count, total_sent, total_received
        FROM acc JOIN act USING (address) ORDER BY total_count DESC, last_seen DESC, address LIMIT 20""",
        "acc", "act",
    ),
    "active_candidates": sql(
        "SELECT address, count(*) AS tx_count FROM tch GROUP BY address ORDER BY tx_count DESC, address LIMIT 72", "tch"
    ),
    "behavior_stats": sql(
        """SELECT * REPLACE (round(contract_call_ratio, 6) AS contract_call_ratio, round(night_ratio, 6) AS night_ratio,
        round(weekend_ratio, 6) AS weekend_ratio, round(active_span_hours, 6) AS active_span_hours) FROM stats""",
        "stats",
    ),
    "node_degrees": sql(
        """SELECT address, count(*) FILTER (o) AS out_degree, count(*) FILTER (NOT o) AS in_degree, count(*) AS degree
        FROM (SELECT from_address AS address, true AS o FROM edg UNION ALL SELECT to_address, false FROM edg) GROUP BY address""",
        "edg",
    ),
    "duplicate_summary": sql(
        """SELECT count(*) AS duplicate_groups, coalesce(sum(n - 1), 0)::BIGINT AS extra_nodes
        FROM (SELECT address, count(*) AS n FROM nodes GROUP BY address HAVING n > 1)""",
        "nodes",
    ),
    "duplicate_groups": sql(
        """SELECT address, size, node_id FROM nodes JOIN
        (SELECT address, count(*) AS size FROM nodes GROUP BY address HAVING size > 1 ORDER BY size DESC, address LIMIT 100) USING (address)""",
        "nodes",
    ),
    "flag_signal_delta": sql(
        f"""SELECT high_count, flag_count, round({delta('high_count', '(flag_count - high_count)')}, 6) AS signal_delta FROM
        (SELECT count(*) FILTER (severity = 'high') AS high_count, count(*) AS flag_count
         FROM (SELECT * FROM fl ORDER BY detected_at DESC, id DESC LIMIT 50))""",
        "fl",
    ),
    "network_totals": sql(
        f"""SELECT count(*) AS buckets, min(bucket) AS first_bucket, max(bucket) AS last_bucket,
        sum(total_value::HUGEINT)::VARCHAR AS total_value FROM {network('hour', 168)}""",
        "tx", "tch", "run",
    ),
    "half_window_change": sql(
        f"""SELECT p::VARCHAR AS previous_value, c::VARCHAR AS current_value,
        CASE WHEN p = 0 THEN CASE WHEN c > 0 THEN 100 ELSE 0 END ELSE round((c - p)::DOUBLE / p::DOUBLE * 100, 6) END AS value_change
        FROM (SELECT coalesce(sum(v) FILTER (i < greatest(1, n // 2)), 0) AS p, coalesce(sum(v) FILTER (i >= greatest(1, n // 2)), 0) AS c
        FROM (SELECT total_value::HUGEINT AS v, row_number() OVER (ORDER BY bucket) - 1 AS i, count(*) OVER () AS n FROM {network('hour', 24)}))""",
        "tx", "tch", "run",
    ),
    "compress_series": sql(
        f"""SELECT max(m.bucket) AS bucket, sum(m.transaction_count)::BIGINT AS transaction_count,
        floor(avg(m.unique_addresses) + 0.5)::BIGINT AS unique_addresses, max_by(m.avg_gas_price, m.bucket) AS avg_gas_price,
        sum(m.total_value::HUGEINT)::VARCHAR AS total_value
        FROM (SELECT *, row_number() OVER (ORDER BY bucket) - 1 AS i, count(*) OVER () AS n FROM {network('hour', 24)}) m
        JOIN (SELECT unnest(range(8)) AS slot) s ON m.i >= s.slot * m.n // 8 AND m.i < (s.slot + 1) * m.n // 8
        GROUP BY s.slot""",
        "tx", "tch", "run",
    ),
    "bucket_deltas": sql(
        f"""SELECT bucket, round({delta('transaction_count', 't0')}, 6) AS transaction_delta,
        round({delta('unique_addresses', 'u0')}, 6) AS address_delta
        FROM (SELECT *, lag(transaction_count) OVER (ORDER BY bucket) AS t0, lag(unique_addresses) OVER (ORDER BY bucket) AS u0
        FROM {network('hour', 24)}) ORDER BY bucket DESC LIMIT 1""",
        "tx", "tch", "run",
    ),
    "contract_queue_counts": sql(
        f"""SELECT count(*) AS contracts, count(*) FILTER (flagged) AS flagged_count,
        count(*) FILTER (bytecode_size > 0) AS with_bytecode_count FROM {RECENT_CONTRACTS.format(n=12)}""",
        "acc", "stored",
    ),
    "constraint_violations": sql(
        """SELECT 'flag severity' AS rule, 0::BIGINT AS violations
        UNION ALL SELECT 'job status', count(*) FILTER (status NOT IN ('pending', 'processing', 'done')) FROM jb
        UNION ALL SELECT 'label risk', count(*) FILTER (risk_level NOT IN ('none', 'low', 'medium', 'high')) FROM ent
        UNION ALL SELECT 'unique signal', count(*) - count(DISTINCT tx_hash || address || flag_type) FROM repflags WHERE address IS NOT NULL
        UNION ALL SELECT 'unique account', count(*) - count(DISTINCT address) FROM acc
        UNION ALL SELECT 'unique transaction', count(*) - count(DISTINCT hash) FROM tx
        UNION ALL SELECT 'known sender', count(*) FROM tx WHERE from_address NOT IN (SELECT address FROM acc)
        UNION ALL SELECT 'known recipient', count(*) FROM tx WHERE to_address NOT IN (SELECT address FROM acc)""",
        "jb", "ent", "repflags", "acc",
    ),
    "recent_transactions": sql(f"SELECT {LISTED_TX} FROM tx ORDER BY timestamp DESC, hash LIMIT 50", "tx"),
    "recent_contracts": sql(f"SELECT * FROM {RECENT_CONTRACTS.format(n=20)}", "acc", "stored"),
    "recent_flags": sql(f"{LISTED_FLAGS} ORDER BY detected_at DESC, id DESC LIMIT 50", "fl"),
    "top_features": sql(features_top(), "feat"),
    "normalize_addresses": sql("SELECT DISTINCT address, 4::BIGINT AS spellings FROM tch", "tch"),
    "flags_explained": sql(f"SELECT *, {EXPLAINED} FROM ({LISTED_FLAGS})", "fl"),
    "format_wei": sql(
        f"SELECT hash, {unit('value', 18, 4, 'ETH')} AS eth, {unit('gas_price', 9, 2, 'Gwei')} AS gwei FROM tx", "tx"
    ),
    "short_address": sql(
        "SELECT hash, CASE WHEN to_address IS NULL THEN 'Unknown' ELSE left(to_address, 8) || '…' || right(to_address, 6) END AS recipient FROM tx",
        "tx",
    ),
    "compact_count": sql(f"SELECT hash, {compact('gas')} AS gas, {compact('gas_price::DOUBLE')} AS gas_price FROM tx", "tx"),
    "percent_format": sql(
        """SELECT address, CASE WHEN s IS NULL THEN '0%' ELSE round(s::DECIMAL(30, 18), 1)::DECIMAL(20, 1) || '%' END AS percent,
        CASE WHEN s IS NULL THEN '0%' ELSE round((s * 100)::DECIMAL(30, 18), 1)::DECIMAL(20, 1) || '%' END AS similarity
        FROM (SELECT address, CASE WHEN received_count > 0 THEN round(sent_count / total_count, 4) END AS s FROM act)""",
        "act",
    ),
    "datetime_label": sql(
        """SELECT hash AS tx_hash, strftime(timestamp, '%b %-d, %Y, %H:%M UTC') AS seen,
        CASE WHEN tx_hash IS NULL THEN NULL ELSE coalesce(strftime(locked_at, '%b %-d, %Y, %H:%M UTC'), 'Unavailable') END AS locked
        FROM tx LEFT JOIN jb ON tx_hash = hash""",
        "tx", "jb",
    ),
    "payload_hex": sql(f"SELECT hash, {HEX_DATA} AS binary_payload, {HEX_DATA} AS text_payload FROM tx", "tx"),
    "tx_direction": sql(
        """SELECT address, hash, CASE WHEN from_address = address THEN 'Outbound' ELSE 'Inbound' END AS side,
        CASE WHEN from_address = address THEN coalesce(to_address, 'Contract creation') ELSE from_address END AS other FROM recent8""",
        "recent8",
    ),
    "risk_text": sql("SELECT address, coalesce(lower(e.risk_level), 'unknown') AS risk FROM acc LEFT JOIN ent e USING (address)", "acc", "ent"),
    "features_json_roundtrip": sql("SELECT address, 11 AS size, round(sent_count_log, 6) AS sent_count_log FROM feat", "feat"),
    "contract_detail": sql(
        """SELECT l.address, l.entity_name, l.entity_type, l.risk_level, coalesce(s.flagged, false) AS flagged,
        coalesce(octet_length(s.bytecode), 0)::INT AS bytecode_size, '0x' || lower(hex(coalesce(s.bytecode, ''::BLOB))) AS bytecode,
        a.first_seen, a.last_seen, coalesce(m.verified, false) AS verified, coalesce(m.compiler_version, '') AS compiler_version,
        NULL::VARCHAR AS abi, coalesce(m.source_code, '') AS source_code, '' AS decompiled_code
        FROM lab l JOIN acc a USING (address) LEFT JOIN stored s USING (address) LEFT JOIN meta m USING (address) WHERE l.is_contract""",
        "lab", "stored", "meta",
    ),
    "tx_detail": sql(
        f"""SELECT t.hash, t.from_address, t.to_address, t.value::VARCHAR AS value, t.timestamp, {HEX_DATA.replace('data', 't.data')} AS payload,
        t.to_address IS NULL AS is_creation, coalesce(f.n, 0) AS flag_count, f.flag_type AS latest_flag_type, f.next_action AS latest_next_action,
        a.entity_name AS from_entity_name, a.risk_level AS from_risk_level, x.total_count AS from_total_count,
        b.entity_name AS to_entity_name, b.risk_level AS to_risk_level, y.total_count AS to_total_count
        FROM tx t LEFT JOIN (SELECT tx_hash, count(*) AS n, max_by(flag_type, (detected_at, id)) AS flag_type,
            max_by(next_action, (detected_at, id)) AS next_action FROM (SELECT *, {EXPLAINED} FROM fl) GROUP BY tx_hash) f ON f.tx_hash = t.hash
        LEFT JOIN lab a ON a.address = t.from_address LEFT JOIN act x ON x.address = t.from_address
        LEFT JOIN lab b ON b.address = t.to_address LEFT JOIN act y ON y.address = t.to_address""",
        "tx", "fl", "lab", "act",
    ),
    "tx_related_flag": sql(
        """SELECT t.hash, f.flag_type, f.severity, coalesce(f.address, t.to_address, t.from_address) AS subject FROM tx t
        LEFT JOIN (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY tx_hash ORDER BY detected_at, id) = 1) f ON f.tx_hash = t.hash""",
        "tx", "fl",
    ),
    "return_paths": sql(
        "SELECT dst AS from_address, src AS to_address, hops, path, hashes FROM walks",
        "prs", extra=f"req AS (SELECT dst AS src, src AS dst FROM prs), {WALKS}",
    ),
    "trace_path": sql(
        "SELECT src AS from_address, dst AS to_address, hops, path, hashes FROM walks",
        "prs", "acc", "edg", extra=f"{TO_HUB}, {WALKS}",
    ),
    "trace_edges": sql(
        """SELECT src, dst, step::INT AS step, hash, from_address, to_address, value::VARCHAR AS value, timestamp
        FROM (SELECT src, dst, unnest(string_split(hashes, ',')) AS hash, unnest(range(1, hops + 1)) AS step FROM walks) JOIN edg USING (hash)""",
        "prs", "acc", "edg", extra=f"{TO_HUB}, {WALKS}",
    ),
    "snapshot_contents": sql(
        f"""SELECT (SELECT count(*) FROM tx) AS transaction_count, (SELECT count(*) FROM acc) AS account_count,
        (SELECT count(*) FROM jb WHERE status = 'pending') AS pending, (SELECT max(attempts) FROM jb)::BIGINT AS max_attempts,
        (SELECT string_agg(hash, ',' ORDER BY timestamp DESC, hash) FROM (FROM tx ORDER BY timestamp DESC, hash LIMIT 10)) AS transactions,
        f.ids AS flags, f.confidences FROM (SELECT string_agg(id, ',' ORDER BY detected_at DESC, id DESC) AS ids,
            string_agg(confidence, ',' ORDER BY detected_at DESC, id DESC) AS confidences
            FROM (SELECT *, {EXPLAINED} FROM fl ORDER BY detected_at DESC, id DESC LIMIT 10)) f""",
        "acc", "jb", "fl",
    ),
    "circular_flows": sql(
        """SELECT * FROM (SELECT 2 AS hops, concat_ws(',', a.from_address, a.to_address, a.from_address) AS path, a.hash || ',' || b.hash AS hashes
            FROM edg a JOIN edg b ON b.from_address = a.to_address AND b.to_address = a.from_address AND a.hash <> b.hash
            UNION ALL SELECT 3, concat_ws(',', a.from_address, b.from_address, c.from_address, a.from_address), concat_ws(',', a.hash, b.hash, c.hash)
            FROM edg a JOIN edg b ON b.from_address = a.to_address AND a.hash <> b.hash
            JOIN edg c ON c.from_address = b.to_address AND c.to_address = a.from_address AND c.hash <> a.hash AND c.hash <> b.hash)
        ORDER BY hops, path, hashes LIMIT 100""",
        "edg",
    ),
    "circular_flows_three": sql(
        """SELECT 3 AS hops, concat_ws(',', a.from_address, b.from_address, c.from_address, a.from_address) AS path,
            concat_ws(',', a.hash, b.hash, c.hash) AS hashes
            FROM edg a JOIN edg b ON b.from_address = a.to_address AND a.hash <> b.hash
            JOIN edg c ON c.from_address = b.to_address AND c.to_address = a.from_address AND c.hash <> a.hash AND c.hash <> b.hash
        ORDER BY path, hashes LIMIT 100""",
        "edg",
    ),
    "address_graph": sql(
        """SELECT a.address AS center, coalesce(n.nodes, a.address) AS nodes, coalesce(e.edges, '') AS edges FROM acc a
        LEFT JOIN (SELECT center, string_agg(node, ',' ORDER BY node) AS nodes FROM gnodes GROUP BY center) n ON n.center = a.address
        LEFT JOIN (SELECT center, string_agg(hash, ',' ORDER BY hash) AS edges FROM gedges GROUP BY center) e ON e.center = a.address""",
        "edg", "lab", extra=TRAILS,
    ),
    "address_graph_nodes": sql("SELECT * FROM gout", "edg", "lab", extra=TRAILS),
    "graph_counters": sql(
        """SELECT center, count(*) FILTER (risk_level = 'high') AS flagged_nodes, count(*) FILTER (is_contract) AS contract_nodes,
        coalesce(any_value(e.n), 0) AS visible_edges FROM gout
        LEFT JOIN (SELECT center, count(*) AS n FROM gedges GROUP BY center) e USING (center) GROUP BY center""",
        "edg", "lab", extra=TRAILS,
    ),
    "graph_node_priority": sql(
        """SELECT center, node, priority, row_number() OVER (PARTITION BY center ORDER BY priority DESC, node) <=
            CASE WHEN count(*) OVER (PARTITION BY center) <= 10 THEN 10 ELSE 9 END AS labelled
        FROM (SELECT center, node, CASE WHEN node = center THEN 1000 ELSE degree + CASE WHEN is_hub THEN 120 ELSE 0 END
            + CASE WHEN risk_level = 'high' THEN 90 ELSE 0 END + CASE WHEN is_contract THEN 24 ELSE 0 END END AS priority FROM gout)""",
        "edg", "lab", extra=TRAILS,
    ),
    "top_hubs": sql(
        """SELECT d.*, l.is_contract, l.entity_name, l.entity_type, l.graph_risk AS risk_level, true AS is_hub, l.updated_at FROM
        (SELECT address, count(*) FILTER (o) AS out_degree, count(*) FILTER (NOT o) AS in_degree, count(*) AS degree
         FROM (SELECT from_address AS address, true AS o FROM edg UNION ALL SELECT to_address, false FROM edg) GROUP BY address
         ORDER BY degree DESC, out_degree DESC, in_degree DESC, address LIMIT 8) d JOIN lab l USING (address)""",
        "edg", "lab",
    ),
    "merge_duplicate_vertices": sql(
        """SELECT min(node_id) AS node_id, address, bool_or(is_contract) AS is_contract, min(first_seen) AS first_seen,
        max(last_seen) AS last_seen FROM nodes GROUP BY address""",
        "nodes",
    ),
    "merge_duplicate_edges": sql(
        f"""SELECT f.id AS from_id, {txh('event_id')} AS hash, t.id AS to_id FROM ev
        JOIN (SELECT address, min(node_id) AS id FROM nodes GROUP BY address) f ON f.address = {addr('user_id')}
        JOIN (SELECT address, min(node_id) AS id FROM nodes GROUP BY address) t ON t.address = {addr('k')} WHERE event_type <> 'signup'""",
        "nodes",
    ),
    "bytecode_embedding": sql(f"SELECT address, {MICRO} AS embedding FROM vec", "code", extra=FINGERPRINT.format(n="vec", source="code")),
    "cosine_pairs": """SELECT v.vec_id, h.vec_id AS first_id,
        round(list_cosine_similarity(v.embedding::DOUBLE[], h.embedding::DOUBLE[]), 9) AS similarity
        FROM embeddings v JOIN (SELECT * FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) h USING (label)""",
    "knn_embeddings": """WITH e AS (SELECT vec_id AS address, embedding FROM embeddings)
        SELECT address AS vec_id, match, position, s AS similarity FROM """ + nearest("e", "e", 5),
    "knn_embeddings_tiles": """WITH e AS (SELECT vec_id AS address, embedding FROM embeddings)
        SELECT address AS vec_id, match, position, s AS similarity FROM """ + nearest("e", "e", 5),
    "similar_contracts": sql(
        f"SELECT n.match, n.address, s AS similarity, position, flagged FROM {nearest('vec', 'vec', 5)} n JOIN stored p ON p.address = n.match",
        "stored", extra=FINGERPRINT.format(n="vec", source="code"),
    ),
    "similar_bytecode": sql(
        f"SELECT n.match, n.address, s AS similarity, position, flagged FROM {nearest('samplevec', 'vec', 5)} n JOIN stored p ON p.address = n.match",
        "stored", "meta",
        extra="samples AS (SELECT address, encode(source_code) AS bytecode FROM meta), "
        + FINGERPRINT.format(n="vec", source="code") + ", " + FINGERPRINT.format(n="samplevec", source="samples"),
    ),
    "behavior_features": sql(f"SELECT address, sample_size, {ROUNDED_FEATURES} FROM feat", "feat"),
    "behavior_profiles": sql(
        "SELECT address, is_contract, entity_name, entity_type, risk_level, 11 AS features, sample_size FROM lab JOIN feat USING (address)", "lab", "feat"
    ),
    "behavior_embedding": sql(f"SELECT address, 128 AS dims, {MICRO} AS embedding FROM fvec", "fvec"),
    "behavior_vectors_upsert": sql(
        f"""SELECT 1 AS version, address, sample_size, {MICRO} AS embedding FROM fvec JOIN feat USING (address)
        UNION ALL SELECT 0, address, sample_size, {MICRO} FROM vec_then JOIN feat_then USING (address)""",
        "fvec", "run",
        extra=f"""then_once AS (SELECT * FROM once WHERE timestamp <= (SELECT as_of FROM run) - INTERVAL 15 DAY),
        stats_then AS ({CTES['stats'].replace('FROM once', 'FROM then_once')}),
        feat_then AS ({CTES['feat'].replace('FROM stats', 'FROM stats_then')}),
        vec_then AS ({CTES['fvec'].replace('FROM feat', 'FROM feat_then')})""",
    ),
    "similar_accounts": sql(
        """SELECT s.address, s.match, s.position, greatest(0, least(1, s.similarity)) AS similarity,
        l.entity_name, l.entity_type, l.risk_level, l.is_contract FROM fsim s JOIN lab l ON l.address = s.match""",
        "fsim", "lab",
    ),
    "similar_active_accounts": sql(
        """SELECT a.address, b.address AS match, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity,
        row_number() OVER (PARTITION BY a.address ORDER BY
            round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.address) AS position
        FROM fvec a JOIN fvec b ON a.address <> b.address
        WHERE b.address IN (SELECT address FROM tch GROUP BY address ORDER BY count(*) DESC, address LIMIT 72) QUALIFY position <= 6""",
        "fvec",
    ),
    "behavior_highlights": sql(highlights(), "fsim"),
    "detect_circular": sql("SELECT * FROM circular", "prs", extra=RETURNS),
    "detect_similar_bytecode": sql(similar_flags("vec"), "tx", "code", extra=FINGERPRINT.format(n="vec", source="code")),
    "detect_velocity": sql(velocity_flags(5), "tch"),
    "detect_velocity_sensitive": sql(velocity_flags(2), "tch"),
    "detect_high_value": sql(
        """SELECT hash AS tx_hash, from_address AS address, 'high_value_transfer' AS flag_type, 'low' AS severity,
        'Transfer of ' || value || ' wei reaches the threshold of 1000000000000000000' AS description, timestamp AS detected_at, value::VARCHAR AS value
        FROM tx WHERE value >= 1000000000000000000""",
        "tx",
    ),
    "detect_hub": sql(
        """SELECT hash AS tx_hash, t.counterparty AS address, 'hub_interaction' AS flag_type, 'low' AS severity,
        t.counterparty || ' interacts with ' || t.address || ' (' || coalesce(entity_type, 'node of degree ' || degree) || ')' AS description,
        timestamp AS detected_at, t.address AS hub, degree
        FROM tch t JOIN (SELECT address, count(*) AS degree FROM tch WHERE counterparty IS NOT NULL GROUP BY address) d USING (address)
        LEFT JOIN (FROM ent WHERE is_hub OR entity_type IN ('hub', 'bridge', 'exchange', 'mixer')) e USING (address)
        WHERE t.counterparty <> t.address AND (degree >= 100 OR e.address IS NOT NULL)""",
        "tch", "ent",
    ),
    "stream_ingest": sql("SELECT DISTINCT hash, from_address, to_address, value FROM deliv WHERE problem IS NULL", "deliv"),
    "stream_enrich": sql(
        f"""SELECT tx_hash, address, flag_type, severity, detected_at FROM circular
        UNION ALL SELECT tx_hash, address, flag_type, severity, detected_at FROM alike""",
        "prs", "code", "ev",
        extra=f"""{RETURNS}, {FINGERPRINT.format(n='vec', source='code')}, {SIMILAR_SO_FAR}""",
    ),
    "stream_retry": f"""SELECT *, status = 'pending' AND available_at <= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 1 DAY AS due FROM ({JOB_STATES})""",
    "stream_network_metrics": sql(
        """SELECT b.bucket, transaction_count, unique_addresses, avg_gas_price, total_value FROM
        (SELECT date_trunc('hour', timestamp)::TIMESTAMP AS bucket, count(*) AS transaction_count, sum(value)::VARCHAR AS total_value,
            sum(gas_price)::DOUBLE / count(gas_price) AS avg_gas_price FROM tx GROUP BY 1) b
        JOIN (SELECT date_trunc('hour', timestamp)::TIMESTAMP AS bucket, count(DISTINCT address) AS unique_addresses FROM tch GROUP BY 1) p USING (bucket)""",
        "tch",
    ),
}

# Lookups by keys give the rows that the whole document has for them.
_ENTITIES = f"address IN (SELECT {addr('n_nationkey')} FROM nation)"
ORACLES |= {
    "account_profile_by_keys": f"SELECT * FROM ({ORACLES['account_profile']}) WHERE {_ENTITIES}",
    "contract_detail_by_keys": f"SELECT * FROM ({ORACLES['contract_detail']}) WHERE {_ENTITIES}",
    "tx_detail_by_keys": f"SELECT * FROM ({ORACLES['tx_detail']}) ORDER BY timestamp DESC, hash LIMIT 50",
}
