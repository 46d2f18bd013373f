"""DuckDB twins of the queries that SQL can express."""

_CHAT_SOURCE = """src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
   UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))"""


def _escaped(c: str) -> str:
    c = f"replace({c}, '\\', '\\\\')"
    for mark in ("[INST]", "[/INST]", "<s>", "</s>"):
        c = f"replace({c}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return c


CHAT = f"""WITH {_CHAT_SOURCE},
marked AS (SELECT *, bool_or(contains(text, '[/INST]') OR contains(text, '</s>') OR (role <> 'assistant' AND (contains(role, '[/INST]')
   OR contains(role, '</s>') OR contains(role, chr(10))))) OVER (PARTITION BY conv_id) AS esc FROM src),
sized AS (SELECT *, CASE WHEN esc THEN length({_escaped('text')}) ELSE length(text) END AS t_len,
   CASE WHEN esc THEN length(replace({_escaped('role')}, chr(10), '\\n')) ELSE length(role) END AS r_len FROM marked)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (CASE WHEN esc THEN 10 ELSE 6 END + sum(t_len + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + r_len END))::BIGINT AS formatted_chars, esc AS escaped
FROM sized GROUP BY conv_id, esc"""

WARC = """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM f"""

# Measurements of op6; ascii white space separates words.
QUALITY = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) > 5),
k AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS win FROM g),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, win) AS c FROM k) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(5)) AS j) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
  len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS n_stutter, len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter
  FROM w LEFT JOIN rep USING (rid)),
f AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (2 * n_dup_lines > n_lines)::BIGINT
  + 16 * (word_chars < 3 * n_words OR word_chars > 12 * n_words)::BIGINT + 32 * (100 * n_stutter > 20 * n_words)::BIGINT + 64 * (2 * n_letter < n_words)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits, fail_bits & 7 = 0 AS kept_v1,
  CASE fail_bits WHEN 1 THEN 'short' WHEN 2 THEN 'repeats' WHEN 4 THEN 'symbols' WHEN 8 THEN 'dup_lines' WHEN 16 THEN 'word_length' WHEN 32 THEN 'stutter' WHEN 64 THEN 'no_letters' END AS only_rule,
  CASE WHEN fail_bits IN (1, 2, 4, 8, 16, 32, 64) THEN count(*) OVER (PARTITION BY fail_bits) END AS only_rule_docs FROM f"""

# Windows of ten words (or the whole shorter item) as space-joined text.
_WORDS = "list_filter(string_split_regex(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
   FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM win),
p AS (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
h AS (SELECT rid, p.m, i, item_id FROM p JOIN win USING (m, s)),
n AS (SELECT rid, count(DISTINCT i + j) AS n_hit FROM (SELECT rid, i, unnest(range(m)) AS j FROM (SELECT DISTINCT rid, m, i FROM h)) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)"""

NEAR_DUPLICATES = """WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
   FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n AS u ON u.doc_id = x JOIN n AS v ON v.doc_id = y WHERE 100 * c >= 75 * (u.n + v.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n"""

EXACT_DUPLICATES = """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(text) AS text_sha256 FROM d JOIN g USING (text)"""

FILTER_AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part,
   list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
   + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 4 ELSE 0 END
   + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first_id < doc_id THEN 16 ELSE 0 END AS bits, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
   FROM d JOIN e USING (text) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, bits, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT chr(65 + i::INT) AS letter, 1 << i::INT AS bit FROM range(5) AS t(i)),
o AS (SELECT a.letter || b.letter || g.letter || h.letter || k.letter AS filter_order FROM x AS a, x AS b, x AS g, x AS h, x AS k
   WHERE a.bit + b.bit + g.bit + h.bit + k.bit = 31 AND len(list_distinct([a.letter, b.letter, g.letter, h.letter, k.letter])) = 5),
s AS (SELECT filter_order, step, x.letter, x.bit, (SELECT coalesce(sum(y.bit), 0) FROM x AS y WHERE contains(left(filter_order, step - 1), y.letter))::INT AS before
   FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o) JOIN x ON x.letter = filter_order[step]),
r AS (SELECT part, filter_order, step, s.letter, coalesce(sum(n) FILTER (bits & (before | bit) = 0), 0)::BIGINT AS kept,
   coalesce(sum(n) FILTER (bits & before = 0 AND bits & bit <> 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (bits & before <> 0 AND bits & bit <> 0), 0)::BIGINT AS redundant,
   coalesce(sum(n) FILTER (bits = bit), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (bits & before = 0 AND bits & bit <> 0 AND good), 0)::BIGINT AS good_lost,
   coalesce(sum(n) FILTER (bits & before = 0 AND bits & bit <> 0 AND toxic), 0)::BIGINT AS toxic_lost FROM c, s GROUP BY part, filter_order, step, s.letter, s.bit)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""
