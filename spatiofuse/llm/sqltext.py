"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from spatiofuse.llm import importance, lexical, quality

WORD = r"[^\x20\x09-\x0D]+"

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{WORD}') AS ws FROM d),
windows AS (SELECT r, unnest(list_transform(range(1, len(ws) - 1), lambda i: struct_pack(i := i, k := ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS x FROM w WHERE len(ws) >= 3),
often AS (SELECT r, x.i AS i FROM windows QUALIFY count(*) OVER (PARTITION BY r, x.k) > 1),
repeated AS (SELECT r, count(DISTINCT i + o) AS n FROM often, (VALUES (0), (1), (2)) AS v(o) GROUP BY r),
lines AS (SELECT r, source, text, l, regexp_replace(lower(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[0-9]+', '0', 'g') AS h
          FROM (SELECT r, source, text, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD}')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM documents GROUP BY source),
frequent AS (SELECT l.source, h FROM lines l JOIN hosts ON hosts.source = l.source GROUP BY l.source, h
             HAVING count(DISTINCT text) > {quality.MIN_DOCS} AND count(DISTINCT text) > any_value(hosts.n) * {quality.MAX_SHARE}::DOUBLE),
lost AS (SELECT r, sum(len(regexp_extract_all(l, '{WORD}'))) AS n FROM lines JOIN frequent USING (source, h) GROUP BY r),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words
      FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lost USING (r))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)
  AND NOT (removed_words > 0 AND (n_words - removed_words < {quality.MIN_WORDS} OR n_words - removed_words < {quality.MIN_LEFT}::DOUBLE * n_words)) AS kept
FROM m"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, turn, role, text,
        length('<|' || replace(replace(role, '%', '%25'), '|', '%7C') || '|>' || chr(10))
        + length(regexp_replace(text, '(<|\[)(\\*)(\||s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')) + length('<|end|>' || chr(10)) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, 'messages' AS layout
FROM t GROUP BY conv_id"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _term_rows(table: str) -> str:
    """(r, t): every term of every row of a table with its row number."""
    return f"SELECT r, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS t FROM {table}"


# the CRC-32 of a word, bit by bit over its bytes
_CRC = """xor(4294967295, list_reduce(list_transform(range(octet_length(encode(t))), lambda i: CAST('0x' || hex(encode(t))[2 * i + 1:2 * i + 2] AS BIGINT)),
  lambda c, b: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), CAST(4294967295 AS BIGINT)))"""

IMPORTANCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), i AS (SELECT row_number() OVER () AS r, text FROM benchmark),
dt AS ({_term_rows('d')}), it AS ({_term_rows('i')}),
words AS (SELECT t, ({_CRC}) % {importance.BUCKETS} AS b FROM (SELECT t FROM dt UNION SELECT t FROM it)),
f AS (SELECT r, b FROM dt JOIN words USING (t)),
s AS (SELECT b, count(*) AS s FROM f GROUP BY b), t AS (SELECT b, count(*) AS t FROM it JOIN words USING (t) GROUP BY b),
n AS (SELECT CAST((SELECT count(*) FROM dt) AS DOUBLE) AS s_all, CAST((SELECT count(*) FROM it) AS DOUBLE) AS t_all),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + {importance.BUCKETS}) / ((s::DOUBLE + 1) * (t_all + {importance.BUCKETS})))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b), n),
w AS (SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS w FROM f JOIN gain USING (b) GROUP BY r),
h AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
        CAST('0x' || left(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
x AS (SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS k, count(*) OVER () AS able FROM x WHERE n_features >= {importance.MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= able * {importance.PERCENT} // 100 THEN k END AS rank FROM x LEFT JOIN k USING (r)"""

SEARCH = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), i AS (SELECT row_number() OVER () AS r, item_id, text FROM benchmark),
dt AS ({_term_rows('d')}), tf AS (SELECT r, t, count(*) AS tf FROM dt GROUP BY r, t), len AS (SELECT r, sum(tf) AS n FROM tf GROUP BY r),
a AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM len),
asked AS (SELECT DISTINCT r AS q, t FROM ({_term_rows('i')})),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, a WHERE t IN (SELECT t FROM asked) GROUP BY t),
m AS (SELECT r, CAST({100 - lexical.LENGTH_PERCENT} + ({lexical.LENGTH_PERCENT} * n * nd) // l AS BIGINT) AS m FROM len, a),
s AS (SELECT q, r, CAST(sum(w * (({lexical.SCALE} * tf) // (1000 * tf + {lexical.SATURATION} * m))) AS BIGINT) AS score FROM asked JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY q, r),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS k FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(k AS INT) AS rank, doc_id, score FROM k JOIN i ON i.r = q WHERE k <= {lexical.TOP}"""
