"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)),
places AS (SELECT rid, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT rid, w, n, unnest(range(1, greatest(0, len(w) - n + 1) + 1)) AS k FROM d, (SELECT DISTINCT n FROM windows))),
found AS (SELECT rid, k, n, item_id FROM places JOIN windows USING (n, win)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT rid, k, n FROM found)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)"""

_ESCAPED = "length(replace(replace(replace({}, '\\', '\\\\'), '<', '\\l'), '>', '\\g'))"

OP9 = rf"""WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
a AS (SELECT *, len(regexp_extract_all(text, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}]|[\p{{L}}\p{{M}}]{{1,4}}|\p{{N}}|[^\s\p{{L}}\p{{M}}\p{{N}}]')) + 6 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
 {_ESCAPED.format("role")} + {_ESCAPED.format("text")} + 16 AS size FROM given),
b AS (SELECT *, n = 1 AND role = 'system' AS sys, CASE WHEN n = 1 AND role = 'system' THEN 0 ELSE tokens END AS load FROM a),
c AS (SELECT *, max(CASE WHEN sys THEN tokens END) OVER (PARTITION BY conv_id) AS sys_tokens, max(CASE WHEN sys THEN size END) OVER (PARTITION BY conv_id) AS sys_size, sum(load) OVER (PARTITION BY conv_id ORDER BY n) - load AS before FROM b),
e AS (SELECT *, greatest(1, floor((1024 - 192 - coalesce(sys_tokens, 0)) / 2)) AS w FROM c),
f AS (SELECT *, load > w AS big, floor(before / w) AS slot FROM e),
g AS (SELECT *, n > 1 AND (big OR lag(big, 1, FALSE) OVER o OR lag(slot, 1, 0) OVER o <> slot) AS new FROM f WINDOW o AS (PARTITION BY conv_id ORDER BY n)),
h AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY n) AS span FROM g),
s AS (SELECT conv_id, span - 1 AS span, min(before) AS next_before, sum(load) AS next_load FROM h GROUP BY conv_id, span),
p AS (SELECT h.*, NOT sys AND s.next_before - before <= 192 AND s.next_before - before + s.next_load + coalesce(sys_tokens, 0) <= 1024 AS again FROM h LEFT JOIN s ON h.conv_id IS NOT DISTINCT FROM s.conv_id AND h.span = s.span)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) + coalesce(sum(size) FILTER (again), 0) + max(span) * coalesce(max(sys_size), 0) AS BIGINT) AS formatted_chars FROM p GROUP BY conv_id"""

OP11 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
lab AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, t, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT w.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
 CAST(len(words) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER)
 + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) AS INTEGER)
 + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(first < w.doc_id, FALSE) AS INTEGER) AS mask
 FROM w LEFT JOIN lab ON w.doc_id = lab.doc_id),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
 FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INTEGER AS before FROM (SELECT *, unnest(range(1, 6)) AS k FROM orders)),
told AS (SELECT part, filter_order, step, bit,
 sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
 sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
 sum(good) FILTER (mask & before = 0 AND mask & bit > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0) AS toxic_lost
 FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
 CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
 CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM told"""

SQL: dict[str, str] = {"op5_prefix_join": OP5, "op9_chat_windows": OP9, "op11_subset_zeta": OP11}
