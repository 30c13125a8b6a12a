"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _fingerprints() -> str:
    word = lambda digest, i: f"('0x' || substr({digest}, {8 * i + 1}, 8))::BIGINT"
    wide = ", ".join(f"(sum({word(d, i)}) % 4294967296)::BIGINT" for d in ("d", "e") for i in range(4))
    bits = [(i, b) for i in range(3) for b in range(16)]
    bits += [(i, b + 16) for i, b in bits]
    ones = ", ".join(f"sum((w[{i + 1}] >> {b}) & 1)::BIGINT" for i, b in bits)
    hexed = lambda v, width: f"array_to_string([lpad(to_hex(x % {16**width}), {width}, '0') FOR x IN {v}], '')"
    text = lambda p: f"to_base64(unhex({hexed(f'list_concat({p}.wide, {p}.ones, [{p}.runs])', 8)}))"
    signed = lambda p: f"[2 * x - {p}.runs FOR x IN {p}.ones]"

    def near(a: str, b: str) -> str:
        dot = lambda x, y: f"list_sum([p[1] * p[2] FOR p IN list_zip({signed(x)}, {signed(y)})])"
        size = f"(sqrt({dot(a, a)}::DOUBLE) * sqrt({dot(b, b)}::DOUBLE))"
        cosine = f"CASE WHEN {size} > 0 THEN {dot(a, b)} / {size} ELSE 0 END"
        same = f"{a}.wide = {b}.wide AND {a}.ones = {b}.ones AND {a}.runs = {b}.runs"
        return f"CASE WHEN {same} THEN 1.0::DOUBLE ELSE round(greatest(0, least(1, {cosine})), 6)::DOUBLE END"

    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
    e AS (SELECT *, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
        coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
        FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    t AS (SELECT doc_id, 0 AS which, text FROM e
        UNION ALL SELECT doc_id, 1, substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2) FROM e),
    lines AS (SELECT doc_id, which, md5('P' || line) AS d, md5('QP' || line) AS e
        FROM (SELECT doc_id, which, unnest(string_split(text, chr(10))) AS line FROM t)),
    wide AS (SELECT doc_id, which, [{wide}] AS wide FROM lines GROUP BY ALL),
    runs AS (SELECT doc_id, which, [{word('m', 0)}, {word('m', 1)}, {word('m', 2)}] AS w FROM (SELECT doc_id, which, md5('R' || run) AS m
        FROM (SELECT doc_id, which, unnest(regexp_extract_all(text, '[^\n]{{1,32}}')) AS run FROM t))),
    ones AS (SELECT doc_id, which, [{ones}] AS ones, count(*) AS runs FROM runs GROUP BY ALL),
    f AS (SELECT doc_id, which, wide, coalesce(ones, [0::BIGINT FOR x IN range(96)]) AS ones, coalesce(runs, 0) AS runs
        FROM wide LEFT JOIN ones USING (doc_id, which))
    SELECT e.doc_id, n AS n_chars, sha256(substr(e.text, 1, n - n // 2) || substr(next_text, 1, n // 2)) AS edited_sha256,
        {text('o')} AS fingerprint, {text('c')} AS edited_fingerprint, {near('o', 'c')} AS near_edited, {near('o', 'x')} AS near_next
    FROM e JOIN f o ON o.doc_id = e.doc_id AND o.which = 0 JOIN f c ON c.doc_id = e.doc_id AND c.which = 1
    JOIN f x ON x.doc_id = e.next_id AND x.which = 0"""


MIXING = f"""WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size,
        ('0x' || substr(md5('mix:' || doc_id), 1, 12))::BIGINT AS draw FROM documents),
    src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s GROUP BY source),
    w AS (SELECT *, ([5.0, 2.0, 1.0])[(rank - 1) % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM src),
    c AS (SELECT *, sum(cap) OVER (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING) - cap AS filled,
        sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
    l AS (SELECT ((SELECT sum(source_size) FROM src) - filled) / open AS level FROM c
        WHERE cap > ((SELECT sum(source_size) FROM src) - filled) / open * weight ORDER BY cap / weight, rank LIMIT 1),
    p AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l) * weight, cap)) AS target FROM w),
    q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM p),
    d AS (SELECT s.*, source_size, target, whole, target - whole * source_size AS rest,
        sum(size) OVER (PARTITION BY s.source ORDER BY draw RANGE UNBOUNDED PRECEDING) AS upto, sum(size) OVER (PARTITION BY s.source, draw) AS tied
        FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source),
    f AS (SELECT *, upto - tied / 2 <= rest AS fits, rest - coalesce(max(upto) FILTER (upto - tied / 2 <= rest) OVER (PARTITION BY source), 0) AS gap FROM d),
    g AS (SELECT *, CASE WHEN gap > 0 AND NOT fits THEN abs(gap - size) WHEN gap < 0 AND fits THEN abs(gap + size) END AS off FROM f),
    x AS (SELECT source, arg_min(draw, {{'o': off, 'd': draw}}) AS swap FROM g WHERE off < abs(gap) GROUP BY source)
    SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM (
        SELECT g.*, whole + (fits <> coalesce(draw = swap, false))::BIGINT AS copies
        FROM g LEFT JOIN x ON g.source IS NOT DISTINCT FROM x.source)"""

NEARDUPS = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({LOWERED}, ''), '{WORDS}') AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] ELSE w END) AS shingles FROM w),
    n AS (SELECT doc_id, len(shingles) AS n FROM s),
    u AS (SELECT doc_id, n, unnest(shingles) AS shingle FROM s JOIN n USING (doc_id)),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
        AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT a, b FROM ways UNION SELECT r.a, b.b FROM reach r JOIN ways b ON r.b = b.a),
    lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
    FROM n LEFT JOIN lowest ON a = doc_id"""



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text that is not empty."""
    bits = "[0::BIGINT FOR i IN range(8)]"
    shifted = f"list_reduce(list_prepend(xor(c, b) & 255, {bits}), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    codes = f"[ascii(c)::BIGINT FOR c IN string_split({text}, '')]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, {shifted})), 4294967295)"


RUNS = f"""WITH o AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w, {_crc32('doc_id::VARCHAR')} AS h FROM documents),
    c AS (SELECT doc_id, w, h, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM o),
    e AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE
        [w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1] FOR i IN range(n)] END AS w FROM c),
    x AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM e),
    same AS (SELECT a.doc_id, b.i, b.i - a.i AS p FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND (b.i - a.i) * 4 <= a.n),
    isles AS (SELECT doc_id, p, min(i) - p AS s, max(i) + 1 AS t FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS isle FROM same)
        GROUP BY doc_id, p, isle HAVING count(*) >= 3 * p),
    runs AS (SELECT doc_id, s, t - s AS l, min(p) AS p FROM isles GROUP BY doc_id, s, t HAVING t - s >= 6),
    listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' ORDER BY s, p) AS runs,
        max_by({{'s': s, 'l': l, 'p': p}}, [l, -s, -p]) AS best FROM runs GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + l)) AS i FROM runs),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, 1000 * best.l // best.p AS exponent_milli,
        sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256, n AS n_words
    FROM e LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _chats() -> str:
    controls = ["<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"]

    def escaped(text: str) -> str:
        text = f"replace({text}, chr(92), repeat(chr(92), 2))"
        for c in controls:
            text = f"replace({text}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
        return text

    return f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations
        UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
    t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
    g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS spoken,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
        sum({sum(map(len, controls[:3]))} + length({escaped('role')}) + length({escaped('text')}))::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g"""


TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '{TERMS}')) AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
    c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM d),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED}, '{TERMS}')) AS term FROM benchmark),
    s AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
            * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))))::BIGINT AS score
        FROM q JOIN tf USING (term) JOIN df USING (term) JOIN d USING (doc_id), c GROUP BY item_id, doc_id)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""

ORACLES: dict[str, str] = {"op2_fingerprints": _fingerprints(), "op5_mixing": MIXING, "op8_neardups": NEARDUPS, "op11_runs": RUNS, "op12_chats": _chats(), "op13_search": SEARCH}
