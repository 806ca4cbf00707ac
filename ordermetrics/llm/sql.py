"""DuckDB SQL for the operators that SQL can express."""

_WORDS = r"""list_filter(string_split_regex(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP2 = f"""
WITH items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format(text='text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS words, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(text='text')} AS w FROM documents),
lengths AS (SELECT DISTINCT words FROM windows),
spans AS (
  SELECT r, s, words, array_to_string(w[s:s + words - 1], ' ') AS phrase
  FROM (SELECT r, w, words, unnest(generate_series(1, len(w) - words + 1)) AS s FROM docs, lengths WHERE len(w) >= words)),
hits AS (SELECT spans.r, spans.s, spans.words, item FROM spans JOIN windows USING (phrase, words)),
hit_words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(s, s + words - 1)) AS p FROM (SELECT DISTINCT r, s, words FROM hits)) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit_words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(hit_items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(hit_words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

OP3 = r"""
WITH lines AS (
  SELECT doc_id, text, pos, CASE WHEN regexp_matches(m, '[0-9]') THEN regexp_replace(m, '[^ 0-9]*[0-9][^ ]*', '<*>', 'g') ELSE m END AS m
  FROM (SELECT doc_id, text, pos, trim(regexp_replace(part[pos + 1], '[ \t\r]+', ' ', 'g'), ' ') AS m
        FROM (SELECT doc_id, text, part, unnest(generate_series(0, len(part) - 1)) AS pos
              FROM (SELECT doc_id, text, string_split(text, chr(10)) AS part FROM documents)))),
keyed AS (
  SELECT *, len(string_split(m, ' ')) AS n, array_to_string(string_split(m, ' ')[1:3], ' ') AS leaf FROM lines WHERE m <> ''),
templates AS (SELECT m, leaf, n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM keyed GROUP BY m, leaf, n),
rare AS (SELECT * FROM templates WHERE docs < 10 AND n > 3),
leaves AS (SELECT leaf, n FROM rare GROUP BY leaf, n HAVING sum(docs) >= 10 AND count(*) > 1),
tokens AS (
  SELECT leaf, n, m, docs, pos, string_split(m, ' ')[pos] AS token
  FROM (SELECT rare.*, unnest(generate_series(1, n)) AS pos FROM rare SEMI JOIN leaves USING (leaf, n))),
votes AS (SELECT leaf, n, pos, token, sum(docs) AS votes FROM tokens GROUP BY leaf, n, pos, token),
common AS (
  SELECT leaf, n, pos, token FROM (SELECT *, sum(votes) OVER (PARTITION BY leaf, n, pos) AS whole,
    row_number() OVER (PARTITION BY leaf, n, pos ORDER BY votes DESC, token) AS place FROM votes) WHERE place = 1 AND 2 * votes >= whole),
members AS (SELECT leaf, n, m FROM tokens JOIN common USING (leaf, n, pos, token) GROUP BY leaf, n, m HAVING 4 * count(*) >= 3 * n),
general AS (
  SELECT leaf, n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM keyed SEMI JOIN members USING (leaf, n, m) GROUP BY leaf, n HAVING count(DISTINCT doc_id) >= 10),
bad AS (
  SELECT m, first FROM templates WHERE docs >= 10
  UNION ALL SELECT m, general.first FROM members JOIN general USING (leaf, n)),
hit AS (SELECT DISTINCT doc_id, text, pos FROM keyed JOIN bad USING (m) WHERE doc_id IS DISTINCT FROM first),
cleaned AS (
  SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, coalesce(len(gone), 0) AS n_dropped,
    CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
  FROM documents LEFT JOIN (SELECT doc_id, text, list(pos) AS gone FROM hit GROUP BY doc_id, text) USING (doc_id, text))
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(coalesce(text, '')) AS text_sha256,
  CAST(length(text) AS BIGINT) AS n_chars FROM cleaned
"""

OP10 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
"""

OP1 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e,
    coalesce(len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS good
  FROM embeddings),
links AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r AND a.good AND b.good AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.9 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(vec_id) AS m FROM reach JOIN v ON v.r = reach.b GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, m) AS component_id, vec_id = least(vec_id, m) AS kept
FROM v LEFT JOIN least ON least.a = r LEFT JOIN counted ON counted.a = r
"""

OP4 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS shingle
  FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.r <> y.r GROUP BY ALL)
  JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(doc_id) AS m FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, m) AS component_id, doc_id = least(doc_id, m) AS kept
FROM d LEFT JOIN least ON least.a = d.r LEFT JOIN n ON n.r = d.r
"""

# 24 code points of each turn are its marks: <|im_start|>, line break, <|im_end|>, line break.
OP5 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
counted AS (
  SELECT *, length(role) + length(text) + 24
    + len(regexp_extract_all(text, '<\\*(\|im_start\||\|im_end\||\|endoftext\||s|/s)>|\[\\*(INST|/INST)\]'))
    + len(regexp_extract_all(role, '[\\\n]')) + len(regexp_extract_all(role, '<\\*(\|im_start\||\|im_end\||\|endoftext\||s|/s)>|\[\\*(INST|/INST)\]')) AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM counted GROUP BY conv_id
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, i, line, w, array_to_string(w, '') AS run
  FROM (SELECT r, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
        FROM (SELECT r, i, part[i] AS line
              FROM (SELECT r, part, unnest(generate_series(1, len(part))) AS i FROM (SELECT r, string_split(text, chr(10)) AS part FROM d))))),
facts AS (
  SELECT *, length(run) AS chars, len(list_filter(w, lambda x: regexp_full_match(x, '[|>»•·/\\<–—:\-]+'))) AS separators,
    length(run) - length(regexp_replace(run, '[#*$%&|<>]', '', 'g')) AS symbols,
    regexp_matches(translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      'all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|terms of use|terms of service|privacy policy|cookie policy|uses cookies|enable javascript|lorem ipsum|licensed under|released under|copyright ©|©') AS notice,
    i = max(CASE WHEN len(w) > 0 THEN i END) OVER (PARTITION BY r) AS last
  FROM lines),
ruled AS (
  SELECT *, len(w) > 0 AND ((separators > 0 AND 4 * separators >= len(w)) OR 10 * symbols > chars OR (len(w) <= 30 AND notice)
    OR (NOT last AND len(w) >= 5 AND NOT contains('.!?…:;"''”’»)]}。！？；：」』', right(w[len(w)], 1)))) AS fails
  FROM facts),
per_text AS (
  SELECT r, sum(chars) AS word_chars, sum(symbols) AS n_symbols, count(*) FILTER (len(w) > 0) - count(DISTINCT line) FILTER (len(w) > 0) AS n_dup_lines,
    count(*) FILTER (fails) AS n_removed, coalesce(sum(chars) FILTER (fails), 0) AS lost_chars,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT fails), '') AS cleaned
  FROM ruled GROUP BY r),
words AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
windows AS (SELECT r, p, w[p:p + 2] AS win FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS p FROM words WHERE len(w) > 2)),
again AS (SELECT r, unnest(list(p)) AS p FROM windows GROUP BY r, win HAVING count(*) > 1),
repeated AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM again) GROUP BY r),
base AS (
  SELECT d.doc_id, len(w) AS n_words, word_chars, n_symbols, n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, n_removed, lost_chars, cleaned,
    len(w) < 50 OR 100 * coalesce(repeated.n, 0) > 50 * len(w) AS base_failed
  FROM d JOIN per_text USING (r) JOIN words USING (r) LEFT JOIN repeated USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept, CAST(n_removed AS BIGINT) AS n_removed,
  CAST(lost_chars AS BIGINT) AS lost_chars, sha256(cleaned) AS text_sha256
FROM base
"""

ORACLE = {
    "op1_embedding_dedup": OP1, "op4_minhash_dedup": OP4, "op5_chat_format": OP5, "op2_decontamination": OP2, "op3_line_dedup": OP3,
    "op10_warc": OP10, "op11_quality_rules": OP11}
