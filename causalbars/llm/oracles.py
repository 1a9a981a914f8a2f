"""DuckDB SQL of the queries that SQL can express; tables are registered under their names."""

from __future__ import annotations

from causalbars.llm.sharding import Feistel

_SHARDS = 8


def _feistel_once(number: str, source: str) -> str:
    """One pass over the grid ``rows`` x ``cols`` as nested SELECTs that keep all columns of ``source``."""
    sql = f"SELECT *, {number} // cols AS l, {number} % cols AS r FROM {source}"
    prime = (1 << 31) - 1
    for i, (a, b, c) in enumerate(Feistel(1).keys):
        half = "r" if i % 2 == 0 else "l"
        sql = f"SELECT *, ({half} % {prime} * {a} + {b}) % {prime} AS x0 FROM ({sql})"
        sql = f"SELECT * EXCLUDE (x0), x0 * x0 % {prime} AS x1 FROM ({sql})"
        sql = f"SELECT * EXCLUDE (x1), xor(x1, x1 >> 15) * {c} % {prime} AS x2 FROM ({sql})"
        new = "(l + x2) % grid_rows AS l" if i % 2 == 0 else "(r + x2) % cols AS r"
        sql = f"SELECT * EXCLUDE (x2) REPLACE ({new}) FROM ({sql})"
    return f"SELECT * EXCLUDE (l, r), l * cols + r AS place FROM ({sql})"


OP6_FEISTEL_SHARDS = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, coalesce(text, '') AS body
  FROM documents),
crc_table AS (
  WITH RECURSIVE t(n, k, v) AS (
    SELECT n, 0, n FROM range(256) r(n)
    UNION ALL
    SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t WHERE k < 8)
  SELECT list(v ORDER BY n) AS tab FROM t WHERE k = 8),
sized AS (
  SELECT doc_id, size, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda acc, byte: xor(acc >> 8, tab[xor(acc & 255, byte) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM base, crc_table),
numbers AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS number,
    count(*) OVER () AS n
  FROM sized),
grid AS (
  SELECT *, CASE WHEN n % grid_rows = 0 THEN n // grid_rows ELSE n // grid_rows + 1 END AS cols
  FROM (SELECT *, ceil(sqrt(n))::BIGINT AS grid_rows FROM numbers)),
walk AS (
  SELECT doc_id, size, text_crc32, number, n, grid_rows, cols, place FROM ({_feistel_once('number', 'grid')})
  UNION ALL
  SELECT doc_id, size, text_crc32, number, n, grid_rows, cols, place
  FROM ({_feistel_once('old', '(SELECT * EXCLUDE (place), place AS old FROM walk WHERE place >= n)')}))
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {_SHARDS})::INT AS shard,
  place // {_SHARDS} AS slot, NULL::INT AS grown_shard
FROM walk WHERE place < n
"""

OP9_URL_FILTER = r"""
WITH parts AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
base(no, rule, said, rule_host, rule_path) AS (VALUES
  (0, 'net/', 'block', 'net', '/'), (1, 'example.net/en/', 'allow', 'example.net', '/en/'),
  (2, 'example.com/de/', 'block', 'example.com', '/de/'), (3, 'org/fr/', 'allow', 'org', '/fr/')),
words(no, word) AS (VALUES (4, 'cheap-pills'), (5, 'casino'), (6, 'viagra'), (7, 'free-money'), (8, 'lottery'),
  (9, 'adult'), (10, 'xxx'), (11, 'payday-loans'), (12, 'replica-watches')),
judged AS (
  SELECT p.*,
    (SELECT max_by(b, length(b.rule) * 100 - b.no) FROM base b
     WHERE (p.host = b.rule_host OR ends_with(p.host, '.' || b.rule_host)) AND starts_with(p.path, b.rule_path)) AS b,
    (SELECT max_by(w.word, length(w.word) * 100 - w.no) FROM words w
     WHERE regexp_matches(translate(p.url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])' || w.word || '([^a-z0-9]|$)')) AS w
  FROM parts p)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.said, CASE WHEN w IS NOT NULL THEN 'block' END, 'allow') AS verdict,
  CASE WHEN b IS NULL THEN w END AS pattern_rule
FROM judged
"""

OP5_MIX_SOURCES = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('0:' || doc_id) AS ord
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS total FROM docs GROUP BY source),
weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, 3.0 * total AS cap,
    sum(total) OVER () AS all_words
  FROM sources),
filled AS (
  SELECT *,
    (all_words - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
level AS (SELECT arg_min(level, cap / w) FILTER (WHERE level * w <= cap) AS lv FROM filled),
planned AS (SELECT source, total, least(cap, w * lv) AS target FROM filled, level),
flowed AS (
  SELECT *, CASE WHEN total = 0 THEN 0 ELSE round_even(target, 0)::BIGINT // total END AS passes,
    CASE WHEN total = 0 THEN 0 ELSE round_even(target, 0)::BIGINT % total END AS rest
  FROM planned),
ranked AS (
  SELECT d.*, f.total, f.target, f.passes, f.rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord) AS so_far
  FROM docs d JOIN flowed f ON d.source IS NOT DISTINCT FROM f.source),
taken AS (SELECT *, (passes + (2 * so_far - size <= 2 * rest AND rest > 0)::INT)::INT AS repeats FROM ranked)
SELECT doc_id, size, total AS source_size, round(target, 6) AS target, repeats * size AS taken, repeats FROM taken
"""

# The kinds of personal data, with the patterns written for an engine without possessive quantifiers.
_PII = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
    "ip": (
        "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+",
        "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR try_cast('0' || right(p, 3) AS INT) > 255)) = 0",
    ),
    "card": ("[0-9](?:[ -]?[0-9])+", "length(d) BETWEEN 16 AND 19 AND luhn = 0"),
    "phone": ("\\+[0-9][ ().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15"),
    "iban": (
        "[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
        "length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform("
        "regexp_extract_all(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), '.'), "
        "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)), "
        "lambda r, v: CASE WHEN v < 10 THEN (r * 10 + v) % 97 ELSE (r * 100 + v) % 97 END) = 1",
    ),
    "secret": ("AKIA[0-9A-Z]{16}|password=[0-9A-Za-z]{6,64}", "true"),
    "id_number": (
        "[0-9](?:[ -]?[0-9])+",
        "length(d) BETWEEN 6 AND 19 AND NOT (length(d) >= 16 AND luhn = 0) AND regexp_matches(lower("
        "substr(body, greatest(s - 40, 0) + 1, least(s, 40)) || ' ' || substr(body, e + 1, 40)), "
        "'ssn|passport|social security|tax id|account|ausweis|konto|passeport|cuenta')",
    ),
}


def _pii_kind(number: int, kind: str, pattern: str, check: str) -> str:
    """Spans of one kind: a match starts after the gaps and matches before it."""
    return f"""SELECT doc_id, {number} AS k, '{kind}' AS kind, s, e FROM (
      SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d, list_sum(list_transform(
          regexp_extract_all(regexp_replace(m, '[^0-9]', '', 'g'), '.'),
          lambda c, i: CASE WHEN (length(regexp_replace(m, '[^0-9]', '', 'g')) - i) % 2 = 0 THEN c::INT
            WHEN c::INT < 5 THEN 2 * c::INT ELSE 2 * c::INT - 9 END)) % 10 AS luhn
      FROM (
        SELECT doc_id, body, m, e - length(m) AS s, e FROM (
          SELECT doc_id, body, m, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e
          FROM (SELECT doc_id, body, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i
            FROM (SELECT doc_id, body, regexp_extract_all(body, '{pattern}') AS ms,
              string_split_regex(body, '{pattern}') AS gs FROM bodies)))))
    WHERE {check}"""


OP4_PII = f"""
WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
spans AS (
  {" UNION ALL ".join(_pii_kind(i, k, p, c) for i, (k, (p, c)) in enumerate(_PII.items()))}),
listed AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
    count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (WHERE k < 4) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip,
  coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""

OP1_QUALITY_RULES = r"""
WITH lists AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists),
line_stats AS (
  SELECT doc_id, sum(times - 1)::BIGINT AS n_dup_lines, sum(times)::BIGINT AS n_lines
  FROM (SELECT doc_id, line, count(*) AS times FROM (SELECT doc_id, unnest(lines) AS line FROM lists)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
counted AS (
  SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS twice FROM windows),
covered AS (
  SELECT doc_id, i, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM counted),
repeats AS (SELECT doc_id, sum(c)::BIGINT AS n_repeat_words FROM covered GROUP BY doc_id),
word_stats AS (
  SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars,
    count(*) FILTER (WHERE w = upper(w) AND w <> lower(w)) AS n_upper,
    count(*) FILTER (WHERE regexp_matches(w, '\pL')) AS n_alpha,
    count(*) FILTER (WHERE ends_with(w, '!')) AS n_cry
  FROM words GROUP BY doc_id),
most AS (SELECT doc_id, max(c) AS top FROM (SELECT doc_id, w, count(*) AS c FROM words GROUP BY ALL) GROUP BY doc_id),
stats AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_upper, n_alpha, n_cry, top
  FROM lists LEFT JOIN word_stats USING (doc_id) LEFT JOIN line_stats USING (doc_id)
    LEFT JOIN repeats USING (doc_id) LEFT JOIN most USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words
    OR 10 * n_dup_lines > 6 * n_lines OR 2 * n_upper > n_words OR 10 * n_alpha < 7 * n_words
    OR 100 * top > 30 * n_words OR 4 * n_cry > n_words) AS kept
FROM based
"""

OP12_DECONTAMINATE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[s:s + 9], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
places AS (
  SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s
  FROM d, (SELECT DISTINCT size FROM item_windows)),
found AS (
  SELECT DISTINCT r, s, p.size, item_id
  FROM (SELECT r, s, size, array_to_string(w[s:s + size - 1], ' ') AS words FROM places) p
  JOIN item_windows t ON t.size = p.size AND t.words = p.words),
hits AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS pos FROM found) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""


def _back_step() -> str:
    """Costs of four states before a turn, from those after it (s0 to s3)."""
    kept = "CASE WHEN fault = 2 THEN 1000000000 WHEN fault = 1 THEN 5 ELSE 0 END"
    user = f"s2 + ({kept}) + CASE WHEN initial = 'u' THEN 0 ELSE 1 END"
    assistant = f"s3 + ({kept}) + CASE WHEN initial = 'a' THEN 0 ELSE 1 END"
    system = f"CASE WHEN initial = 's' THEN s1 + ({kept}) ELSE 1000000000 END"
    base = (
        f"SELECT *, least(s0 + 2, {user}, {system}) AS b0, least(s1 + 2, {user}) AS b1, "
        f"least(s2 + 2, {assistant}) AS b2, least(s3 + 2, {user}) AS b3 FROM joined"
    )
    return (
        "SELECT c, i, least(b0, b2 + 5, b3 + 10)::BIGINT AS s0, least(b1, b2 + 5, b3 + 10)::BIGINT AS s1, "
        f"least(b2, b3 + 5)::BIGINT AS s2, least(b3, b2 + 5)::BIGINT AS s3 FROM ({base})"
    )


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP13_REPAIR_CONVERSATIONS = f"""
WITH RECURSIVE crc_table AS (
  WITH RECURSIVE t(n, k, v) AS (
    SELECT n, 0, n FROM range(256) r(n)
    UNION ALL
    SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t WHERE k < 8)
  SELECT list(v ORDER BY n) AS tab FROM t WHERE k = 8),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(
        regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda acc, byte: xor(acc >> 8, tab[xor(acc & 255, byte) + 1])), 4294967295)::BIGINT % 20 AS fault
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, range(2) copy(k) WHERE fault <> 0 AND (k = 0 OR fault = 3)),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM given)),
turns AS (
  SELECT c, turn, role, text, left(role, 1) AS initial, right(rtrim(text, {_BLANKS}), 1) AS last_sign,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged JOIN ids ON damaged.conv_id IS NOT DISTINCT FROM ids.conv_id),
judged AS (
  SELECT *, CASE WHEN last_sign = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN last_sign NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS named,
    lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair
  FROM turns),
rows_of AS (SELECT *, CASE named WHEN 'sound' THEN 0 WHEN 'truncated' THEN 1 ELSE 2 END AS fault FROM judged),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (named = 'blank') AS blank,
    count(*) FILTER (named = 'duplicate') AS duplicate, count(*) FILTER (named = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM rows_of GROUP BY c),
back(c, i, s0, s1, s2, s3) AS (
  SELECT c, n + 1, 0::BIGINT, 10::BIGINT, 5::BIGINT, 0::BIGINT FROM counts
  UNION ALL
  {_back_step().replace("joined", "(SELECT b.c, b.i - 1 AS i, s0, s1, s2, s3, initial, fault FROM back b JOIN rows_of r ON r.c = b.c AND r.i = b.i - 1)")}),
edges AS (
  SELECT b.c, b.i, q, [b.s0, b.s1, b.s2, b.s3][q + 1] AS here, [b.s0, b.s1, b.s2, b.s3][[2, 2, 3, 2][q + 1] + 1] AS there,
    [2, 2, 3, 2][q + 1] AS next, [a.s0, a.s1, a.s2, a.s3] AS later, initial, fault, role, text
  FROM back b JOIN range(4) states(q) ON true LEFT JOIN back a ON a.c = b.c AND a.i = b.i + 1
    LEFT JOIN rows_of r ON r.c = b.c AND r.i = b.i),
best AS (
  SELECT c, i, q, CASE
    WHEN later[q + 1] + 2 = here THEN struct_pack(edit := 'D', to_i := i + 1, to_q := q, line := NULL::VARCHAR)
    WHEN there + 5 = here THEN struct_pack(edit := 'I', to_i := i, to_q := next, line := CASE next WHEN 2 THEN 'user:' ELSE 'assistant:' END)
    WHEN role IS NULL THEN NULL
    WHEN q = 0 AND initial = 's' AND later[2] + 5 * fault = here THEN struct_pack(edit := 'K', to_i := i + 1, to_q := 1, line := role || ':' || text)
    WHEN initial = CASE next WHEN 2 THEN 'u' ELSE 'a' END AND later[next + 1] + 5 * fault = here
      THEN struct_pack(edit := 'K', to_i := i + 1, to_q := next, line := role || ':' || text)
    ELSE struct_pack(edit := 'R', to_i := i + 1, to_q := next, line := CASE next WHEN 2 THEN 'user:' ELSE 'assistant:' END || text) END AS e
  FROM edges),
walk(c, i, q, step, edit, line) AS (
  SELECT c, 1::BIGINT, 0, 0, ''::VARCHAR, NULL::VARCHAR FROM counts
  UNION ALL
  SELECT w.c, e.to_i, e.to_q, step + 1, e.edit, e.line FROM walk w JOIN best b ON b.c = w.c AND b.i = w.i AND b.q = w.q WHERE e IS NOT NULL),
told AS (
  SELECT c, string_agg(edit, '' ORDER BY step) AS audit, sha256(coalesce(string_agg(line, chr(10) ORDER BY step), '')) AS repaired_sha256
  FROM walk GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s0, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (c) LEFT JOIN told USING (c) LEFT JOIN back ON back.c = ids.c AND back.i = 1
"""
