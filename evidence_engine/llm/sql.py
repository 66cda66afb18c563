"""DuckDB SQL that gives the same rows as the queries of this subpackage, where SQL can express them."""

WHITE = r"(chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP1 = f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
held AS (
  SELECT key, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS n FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(h.n >= 2 AND k.doc_id > h.first_doc, false) AS gone
  FROM keyed k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP2 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
wins AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM docs WHERE len(w) >= 5),
keys AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS k FROM wins),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keys) WHERE n >= 2),
rep AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM again) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs d LEFT JOIN rep ON d.doc_id = rep.doc_id),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 2 * length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > word_chars
            OR 5 * (length(text) - length(replace(text, '!', ''))) > n_words
            OR 2 * len(regexp_extract_all(text, '\p{L}+')) < n_words) AS kept
FROM failed
"""

OP3 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'))
            + length(role) + 13 AS n,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS was
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN was IS NULL THEN role IN ('system', 'user')
                     WHEN was = 'system' THEN role = 'user'
                     WHEN was = 'user' THEN role = 'assistant'
                     WHEN was = 'assistant' THEN role = 'user'
                     ELSE false END)
         AND NOT (count(*) = 1 AND min(role) = 'system') AS valid
FROM f GROUP BY conv_id
"""

OP12 = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
wins AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM docs WHERE len(w) >= 35),
keys AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS k FROM wins),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM keys) WHERE n >= 2),
placed AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
marked AS (
  SELECT p.doc_id, p.word, p.i, coalesce(p.i - max(a.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS UNBOUNDED PRECEDING) < 35, false) AS gone
  FROM placed p LEFT JOIN again a ON p.doc_id = a.doc_id AND p.i = a.i),
told AS (
  SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(t.n_removed, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN told t ON d.doc_id = t.doc_id
"""

OP13 = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
docs AS (
  SELECT *, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                            lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 3 = 0 AS bad,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents, crc),
hashed AS (
  SELECT doc_id, lang, bad, unnest([text, low]) AS t, unnest(['leaf', 'changed']) AS kind, source, n_chars FROM docs),
leaves AS (
  SELECT doc_id, lang, kind, bad,
         sha256(concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                       coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'), coalesce(strlen(t) || ':' || t, '-'))) AS h
  FROM hashed),
own AS (
  SELECT doc_id, lang, bad, max(h) FILTER (WHERE kind = 'leaf') AS leaf, max(h) FILTER (WHERE kind = 'changed') AS changed FROM leaves GROUP BY doc_id, lang, bad),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM own),
nodes AS (
  SELECT lang, 0 AS lvl, i, leaf AS h, n FROM numbered
  UNION ALL
  SELECT lang, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, lvl, i // 8),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS groups FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, g AS i, subroot AS h, groups AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM tops WHERE n > 1 GROUP BY lvl, i // 8),
beside AS (
  SELECT lang, lvl, i, n,
         coalesce(string_agg(h, '') OVER (PARTITION BY lang, lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY lang, lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM nodes),
over_tops AS (
  SELECT lvl, i, n,
         coalesce(string_agg(h, '') OVER (PARTITION BY lvl, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY lvl, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM tops),
walk AS (
  SELECT doc_id, lang, 0 AS lvl, i, CASE WHEN bad THEN changed ELSE leaf END AS v, '' AS proof FROM numbered
  UNION ALL
  SELECT w.doc_id, w.lang, w.lvl + 1, w.i // 8, sha256(b.l || w.v || b.r), w.proof || b.l || b.r
  FROM walk w JOIN beside b ON w.lang IS NOT DISTINCT FROM b.lang AND w.lvl = b.lvl AND w.i = b.i WHERE b.n > 1),
climbed AS (
  SELECT w.doc_id, w.v, w.proof, s.g, s.subroot FROM walk w JOIN subroots s ON w.lang IS NOT DISTINCT FROM s.lang
  QUALIFY w.lvl = max(w.lvl) OVER (PARTITION BY w.doc_id)),
rise AS (
  SELECT doc_id, 0 AS lvl, g AS i, v, proof FROM climbed
  UNION ALL
  SELECT w.doc_id, w.lvl + 1, w.i // 8, sha256(b.l || w.v || b.r), w.proof || b.l || b.r FROM rise w JOIN over_tops b ON w.lvl = b.lvl AND w.i = b.i WHERE b.n > 1),
ended AS (SELECT * FROM rise QUALIFY lvl = max(lvl) OVER (PARTITION BY doc_id))
SELECT o.doc_id, o.leaf, c.subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.v AS folded_root, e.v = t.h AS verified
FROM own o JOIN climbed c ON o.doc_id = c.doc_id JOIN ended e ON o.doc_id = e.doc_id, (SELECT h FROM tops WHERE n = 1) t
"""

def _plus(state: str, cost: str, edit: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}'}}"


_FAR = "{'c': 1000000000, 'a': ''}"  # a state that can't be reached
_KEPT = lambda states, initial: ", ".join(f"CASE WHEN stays AND initial = '{initial}' THEN {_plus(s, 'extra', 'K')} ELSE {_FAR} END" for s in states)
_NAMED = lambda states: ", ".join(f"CASE WHEN stays THEN {_plus(s, '2 + extra', 'R')} ELSE {_FAR} END" for s in states)

#: States: s0 the start, s1 after a system turn, s2 after a user's, s3 after an assistant's; a state is its cost and edits.
OP11 = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                         lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 20 AS by_crc FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN by_crc = 4 THEN 'user' ELSE role END AS role, CASE by_crc WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM t WHERE by_crc <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM t WHERE by_crc = 3),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seq) AS i, left(role, 1) AS initial
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seq FROM d)),
o AS (
  SELECT *, fault IS NULL OR fault = 'truncated' AS stays, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra FROM (
    SELECT *, CASE WHEN trim(text, {WHITE}) = '' THEN 'blank' WHEN seq > 1 THEN 'duplicate' WHEN right(rtrim(text, {WHITE}), 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM p)),
ids AS (SELECT DISTINCT conv_id FROM conversations),
v AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': ''}} AS s0, {_FAR} AS s1, {{'c': 2, 'a': 'I'}} AS s2, {{'c': 4, 'a': 'II'}} AS s3 FROM ids
  UNION ALL
  SELECT conv_id, i, s0, s1, u AS s2, list_min([n3, {_plus("u", "2", "I")}]) AS s3 FROM (
    SELECT conv_id, i, s0, s1, n3, list_min([n2, {_plus("s0", "2", "I")}, {_plus("s1", "2", "I")}, {_plus("n3", "2", "I")}]) AS u FROM (
      SELECT v.conv_id, o.i, {_plus("s0", "3", "D")} AS s0, list_min([{_plus("s1", "3", "D")}, {_KEPT(["s0"], "s")}]) AS s1,
             list_min([{_plus("s2", "3", "D")}, {_KEPT(["s0", "s1", "s3"], "u")}, {_NAMED(["s0", "s1", "s3"])}]) AS n2,
             list_min([{_plus("s3", "3", "D")}, {_KEPT(["s2"], "a")}, {_NAMED(["s2"])}]) AS n3
      FROM v JOIN o ON o.conv_id IS NOT DISTINCT FROM v.conv_id AND o.i = v.i + 1))),
best AS (SELECT conv_id, list_min([s0, s3]) AS b FROM v QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
w AS (
  SELECT conv_id, b.a AS audit, 1 AS pos, 0::BIGINT AS i, 's0' AS state, CAST([] AS VARCHAR[]) AS said FROM best
  UNION ALL
  SELECT conv_id, audit, pos + 1, CASE WHEN e = 'I' THEN i ELSE i + 1 END,
         CASE WHEN e = 'D' THEN state WHEN e = 'K' THEN CASE initial WHEN 's' THEN 's1' WHEN 'u' THEN 's2' ELSE 's3' END WHEN state = 's2' THEN 's3' ELSE 's2' END,
         CASE WHEN e = 'D' THEN said ELSE list_append(said, CASE WHEN e = 'K' THEN role WHEN state = 's2' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END) END
  FROM (SELECT w.*, substr(audit, pos, 1) AS e, o.initial, o.role, o.text FROM w LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i + 1 WHERE w.pos <= length(audit))),
told AS (SELECT conv_id, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256 FROM w WHERE pos = length(audit) + 1),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv_id)
SELECT told.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(best.b.c AS BIGINT) AS cost, told.audit, told.repaired_sha256
FROM told JOIN best ON best.conv_id IS NOT DISTINCT FROM told.conv_id LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM told.conv_id
"""

ORACLES = {"op1_line_dedup": OP1, "op2_quality_rules": OP2, "op3_chat_format": OP3, "op11_conversation_repair": OP11, "op12_substring_dedup": OP12, "op13_merkle_manifest": OP13}
