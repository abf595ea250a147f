"""DuckDB SQL of the queries that SQL can express.

No SQL is given for op1 and op4 (XXH64 orders them), op2 and op7 (trained), op5 (a tokenizer's merges), op6 (links found by an
approximate index) and op10 (bytes of partial characters): tests compare these with brute force, round trips or held-out labels.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MORE = lambda c, marks: " + ".join(f"(length({c}) - length(replace({c}, '{m}', '')))" for m in marks)

OP3 = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
 p AS (SELECT *, 4 + length(role) + {_MORE("role", chr(92) + "<[]")} + 1 + length(text) + {_MORE("text", chr(92) + "<[]")} + 4 AS size,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
 c AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
 (coalesce(sum(length(text)) FILTER (role = 'assistant'), 0))::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
 (sum(upto) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""

OP8 = rf"""WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM documents),
 i AS (SELECT item_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS w FROM benchmark),
 iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k + 1:k + least(13, len(w))], ' ') AS key FROM (SELECT *, unnest(range(0, greatest(1, len(w) - 12))) AS k FROM i WHERE len(w) > 0)),
 dw AS (SELECT doc_id, k, n, array_to_string(w[k + 1:k + n], ' ') AS key FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
 hit AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.key = iw.key),
 spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY 1),
 its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',')) AS items_sha256 FROM hit GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN its USING (doc_id)"""

OP9 = r"""WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
 win AS (SELECT doc_id, k, array_to_string(w[k + 1:k + 50], ' ') AS key FROM (SELECT *, unnest(range(0, len(w) - 49)) AS k FROM d WHERE len(w) >= 50)),
 late AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY key) AS first FROM win) WHERE doc_id > first),
 gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM late),
 word AS (SELECT doc_id, unnest(w) AS x, unnest(range(0, len(w))) AS p FROM d),
 kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
 n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""


#: CRC-32 in SQL: the table of 256 remainders, the bytes of a string, and one step a byte.
_CRC = """crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b) ORDER BY b) AS entries FROM (SELECT unnest(range(256)) AS b))"""


def _crc(text: str, entries: str = "entries") -> str:
    at = f"list_transform(range(0, length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({at}, lambda c, b: xor(c // 256, {entries}[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295)"


_WORDS11 = rf"[x FOR x IN string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']"
OP11 = rf"""WITH {_CRC}, d AS (SELECT doc_id, {_WORDS11} AS w FROM documents), i AS (SELECT {_WORDS11} AS w FROM benchmark),
 dw AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY ALL), iw AS (SELECT x, count(*) AS n FROM (SELECT unnest(w) AS x FROM i) GROUP BY ALL),
 v AS (SELECT x, {_crc("x")} % 10000 AS bucket FROM (SELECT x FROM dw UNION SELECT x FROM iw), crc_table),
 s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM dw JOIN v USING (x) GROUP BY 1), t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM iw JOIN v USING (x) GROUP BY 1),
 z AS (SELECT coalesce((SELECT sum(s) FROM s), 0) + 10000 AS ss, coalesce((SELECT sum(t) FROM t), 0) + 10000 AS tt),
 g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ss / ((coalesce(s, 0) + 1) * tt)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), z),
 f AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dw JOIN v USING (x) JOIN g USING (bucket) GROUP BY 1),
 h AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN f USING (doc_id)),
 k AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h),
 r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM k WHERE n_features >= 20)
SELECT k.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM k LEFT JOIN r USING (doc_id)"""

_KEY12 = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
OP12 = rf"""WITH RECURSIVE {_CRC}, base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc(_KEY12)} % 20 AS fate FROM conversations, crc_table),
 hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
   unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM base WHERE fate <> 0),
 placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM hurt),
 met AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS seen, left(role, 1) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS mark FROM placed),
 rows_ AS (SELECT *, CASE WHEN mark = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN mark NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM met),
 ins(i, j, cost, audit, rep) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (1, 2, 2, 'I', chr(10) || 'user:'), (3, 2, 2, 'I', chr(10) || 'user:'),
   (2, 3, 2, 'I', chr(10) || 'assistant:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
 keep(i, role, j) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
 edit AS (SELECT conv_id, k, e.i, e.j, e.cost, e.audit, e.rep FROM rows_ r, LATERAL (
   SELECT s AS i, s AS j, 3 AS cost, 'D' AS audit, '' AS rep FROM range(4) t(s)
   UNION ALL SELECT s, CASE s WHEN 2 THEN 3 ELSE 2 END, 2 + (r.fault = 't')::INT, 'R', chr(10) || CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END || r.text FROM range(4) t(s) WHERE r.fault NOT IN ('b', 'd')
   UNION ALL SELECT keep.i, keep.j, (r.fault = 't')::INT, 'K', chr(10) || r.role || ':' || r.text FROM keep WHERE keep.role = r.i AND r.fault NOT IN ('b', 'd')) e),
 walk AS (SELECT DISTINCT conv_id, 1::BIGINT AS k, 0::BIGINT AS j, {{'cost': 0::BIGINT, 'audit': '', 'rep': ''}} AS v FROM hurt
  UNION ALL SELECT w.conv_id, w.k + 1, e.j::BIGINT, min({{'cost': w.v.cost + n.cost + e.cost, 'audit': w.v.audit || n.audit || e.audit, 'rep': w.v.rep || n.rep || e.rep}}) FROM walk w JOIN ins n ON n.i = w.j JOIN edit e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.k = w.k AND e.i = n.j GROUP BY w.conv_id, w.k, e.j),
 ends AS (SELECT conv_id, max(k) AS k FROM walk GROUP BY conv_id),
 best AS (SELECT w.conv_id, min({{'cost': w.v.cost + n.cost, 'audit': w.v.audit || n.audit, 'rep': w.v.rep || n.rep}}) AS v FROM walk w JOIN ends e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.k = w.k JOIN ins n ON n.i = w.j WHERE n.j IN (0, 3) GROUP BY w.conv_id),
 c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
   count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(b.v.cost, 0)::BIGINT AS cost, coalesce(b.v.audit, '') AS audit, sha256(substr(coalesce(b.v.rep, ''), 2)) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id"""

OP13 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), c AS (SELECT h, max(page_id) AS last FROM p WHERE strlen(h) >= 1000 GROUP BY h),
 r AS (SELECT page_id, p.h, last, last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM p LEFT JOIN c USING (h))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to FROM r"""
