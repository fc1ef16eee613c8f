"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from tideline.llm import mix

BLANK = r"[\x20\x09-\x0D]+"

CONTAMINATED = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{BLANK}'), lambda x: x <> '') AS words FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{BLANK}'), lambda x: x <> '') AS words FROM benchmark),
dg AS (SELECT doc_id, len(words) AS n, unnest(range(len(words) - 4)) AS pos, unnest(list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' '))) AS gram FROM d WHERE len(words) >= 5),
ig AS (SELECT item_id, len(words) AS size, unnest(range(len(words) - 4)) AS place, unnest(list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' '))) AS gram FROM i WHERE len(words) >= 5),
ic AS (SELECT item_id, gram, count(*) AS of_item FROM ig GROUP BY ALL),
hits AS (SELECT * FROM dg JOIN ig USING (gram)),
pairs AS (SELECT DISTINCT doc_id, item_id, size, n FROM hits),
windows AS (SELECT *, unnest(range(greatest(0, n - size) + 1)) AS start FROM pairs),
stands AS (SELECT DISTINCT doc_id, item_id, gram, pos FROM hits),
counts AS (SELECT doc_id, item_id, size, n, start, gram, count(*) AS c FROM windows JOIN stands USING (doc_id, item_id) WHERE pos >= start AND pos <= start + least(size, n) - 5 GROUP BY ALL),
sums AS (SELECT doc_id, item_id, size, n, start, CAST(sum(least(c, of_item)) AS BIGINT) AS n_common FROM counts JOIN ic USING (item_id, gram) GROUP BY ALL),
scored AS (SELECT *, CAST(least(size, n) - 4 + size - 4 - n_common AS BIGINT) AS n_union FROM sums)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, n_common, n_union, n_common / n_union AS similarity FROM scored
WHERE n_common / n_union >= 0.75
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_common / n_union DESC, start) = 1
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{BLANK}'), lambda x: x <> '') AS words, text FROM d),
win AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS k, unnest(list_transform(range(1, len(words) - 1), lambda k: array_to_string(words[k:k + 2], ' '))) AS g FROM w WHERE len(words) >= 3),
twice AS (SELECT doc_id, k FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
raw AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
norm AS (SELECT doc_id, host, text, list_filter(regexp_split_to_array(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[0-9]', '0', 'g'), '{BLANK}'), lambda x: x <> '') AS words FROM raw),
lines AS (SELECT doc_id, host, text, array_to_string(words, ' ') AS line, sum(len(words)) AS n FROM norm WHERE len(words) > 0 GROUP BY ALL),
hosts AS (SELECT host, greatest(10, floor(count(DISTINCT text) * 0.005)) AS lim FROM d GROUP BY host),
above AS (SELECT host, line, min(doc_id) AS first FROM lines GROUP BY host, line HAVING count(DISTINCT text) > 10 AND count(DISTINCT text) > (SELECT lim FROM hosts h WHERE h.host = lines.host)),
gone AS (SELECT doc_id, sum(n) AS n FROM lines JOIN above USING (host, line) WHERE doc_id <> first GROUP BY doc_id),
base AS (SELECT d.doc_id, host, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
    FROM d JOIN w USING (doc_id) LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 2 * n_removed_words > n_words AS depleted,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (2 * n_removed_words > n_words) AS kept FROM base
"""


def _mix_sql() -> str:
    margins = ("source", "lang", "topic")
    parts = [
        f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {mix.topic_sql()} AS topic,
    CAST(len(list_filter(regexp_split_to_array(text, '{BLANK}'), lambda x: x <> '')) AS BIGINT) AS n_tokens,
    CAST(CAST('0x' || substr(md5('{mix.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / CAST({1 << 52} AS DOUBLE) AS draw
    FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents))""",
        "c AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY ALL)",
        "total AS (SELECT sum(tokens) AS total FROM c)",
    ]
    for m in margins:
        parts.append(f"s_{m} AS (SELECT {m}, pow(CAST(sum(tokens) AS DOUBLE), {mix.TEMPER[m]}) AS raw FROM c GROUP BY {m} HAVING sum(tokens) > 0)")
        parts.append(f"g_{m} AS (SELECT {m}, raw / (SELECT sum(raw) FROM s_{m}) * (SELECT CAST(total AS DOUBLE) FROM total) AS goal FROM s_{m})")
    now = "c0"
    parts.append("c0 AS MATERIALIZED (SELECT *, CAST(1 AS DOUBLE) AS weight FROM c)")
    for k in range(mix.ROUNDS):
        for m in margins:
            then = f"c{k}_{m}"
            parts.append(f"{then} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * coalesce(goal / sum(weight * tokens) OVER (PARTITION BY {m}), 1.0) AS weight FROM {now} LEFT JOIN g_{m} USING ({m}))")
            now = then
    parts.append(f"r0 AS MATERIALIZED (SELECT CAST({mix.BUDGET} AS DOUBLE) AS rate)")
    for k in range(mix.RATE_ROUNDS):
        at = f"(SELECT rate FROM r{k})"
        free = f"sum(tokens * weight) FILTER (WHERE weight * {at} < 1)"
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT CASE WHEN coalesce({free}, 0) = 0 THEN {at} ELSE greatest(0, ({mix.BUDGET} * (SELECT CAST(total AS DOUBLE) FROM total) - coalesce(sum(tokens) FILTER (WHERE weight * {at} >= 1), 0)) / {free}) END AS rate FROM {now})")
    parts.append(f"p AS (SELECT *, least(1.0, weight * (SELECT rate FROM r{mix.RATE_ROUNDS})) AS probability FROM {now})")
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, source, lang, topic, n_tokens, floor(weight * 1000000 + 0.5) / 1000000 AS weight, floor(probability * 1000000 + 0.5) / 1000000 AS probability, draw < probability AS kept
FROM d JOIN p USING (source, lang, topic)"""


MIXED = _mix_sql()

_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def _crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes; the table is column ``crc`` of relation ``t``."""
    raw = f"hex(encode({text}))"
    octets = f"list_transform(range(1, length({raw}), 2), lambda k: ('0x' || substr({raw}, k, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1])), 4294967295)"


PREFIX_TRIE = f"""
WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS crc),
own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
),
sizes AS (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id),
convs AS (SELECT conv_id, n, conv_id - conv_id % 100 AS donor, {_crc32("conv_id::VARCHAR")} % 6 AS h FROM sizes, t),
heads AS (SELECT c.*, least(c.h, coalesce(d.n, 0)) AS taken FROM convs c LEFT JOIN sizes d ON d.conv_id = c.donor),
turns AS (
    SELECT c.conv_id, o.pos AS d, o.role, o.text FROM heads c JOIN own o ON o.conv_id = c.donor AND o.pos <= c.h
    UNION ALL
    SELECT c.conv_id, c.taken + o.pos - c.h, o.role, o.text FROM heads c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
),
keyed AS (
    SELECT conv_id, d, length(text) AS len, d = max(d) OVER (PARTITION BY conv_id) AS ends,
        sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d)) AS key
    FROM turns
),
members AS (
    SELECT conv_id, d, len, ends, key, lag(key, 1, 'root') OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM keyed
    UNION ALL
    SELECT conv_id, 0, 0, conv_id NOT IN (SELECT conv_id FROM turns), 'root', NULL FROM convs
),
nodes AS (
    SELECT key, any_value(parent) AS parent, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(len) AS len,
        coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
    FROM members GROUP BY key
),
children AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
up AS (
    SELECT key, key AS node FROM nodes
    UNION ALL
    SELECT u.key, n.parent FROM up u JOIN nodes n ON n.key = u.node WHERE n.parent IS NOT NULL
),
sums AS (
    SELECT u.node AS key, sum(CASE WHEN c.key IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.len)::BIGINT AS saved_tokens
    FROM up u JOIN nodes n ON n.key = u.key LEFT JOIN children c ON c.key = u.key GROUP BY u.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.key = n.key LEFT JOIN children c ON c.key = n.key LEFT JOIN nodes p ON p.key = n.parent
"""

SPELLING_VARIANTS = f"""
WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS crc),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
counted AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted, t),
mangled AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM mangled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, left(word, i - 1) AS a, substr(word, i + 1) AS b FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (
    SELECT x.word, y.word AS other, y.n FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT x.word, w.word, w.n FROM cut x JOIN words w ON w.word = x.a || x.b
    UNION SELECT w.word, x.word, x.n FROM cut x JOIN words w ON w.word = x.a || x.b
),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 2 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 2 * w.n THEN b.other_n END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word
),
path AS (
    SELECT word, word AS at FROM forms
    UNION ALL
    SELECT p.word, f.form FROM path p JOIN forms f ON f.word = p.at WHERE f.form IS NOT NULL
),
roots AS (SELECT p.word, p.at AS root FROM path p JOIN forms f ON f.word = p.at WHERE f.form IS NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, r.root FROM forms f JOIN roots r ON r.word = f.word
"""
