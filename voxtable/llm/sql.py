"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The documents with the words of each, A-Z in lower case.
_WORDED = f"""
d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, {WORDS}) AS words FROM documents)"""

#: CRC-32 of doc_id as text: each digit is added and then shifted out bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT)"""

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS all_lines FROM documents WHERE text IS NOT NULL),
occ AS (
  SELECT doc_id, i - 1 AS line_no, all_lines[i] AS line FROM (SELECT *, unnest(range(1, len(all_lines) + 1)) AS i FROM d)
  WHERE regexp_matches(all_lines[i], '[^\x20\x09-\x0D]')),
firsts AS (SELECT line, min({'d': doc_id, 'n': line_no}) AS place, length(line) AS n FROM occ GROUP BY line),
halves AS (
  SELECT line, place, n, m, side, CASE side WHEN 0 THEN substr(line, 1, m // 2) ELSE substr(line, n - (m - m // 2) + 1) END AS half
  FROM (SELECT *, unnest([n, n - 1]) AS m FROM firsts WHERE n >= 20), (SELECT unnest([0, 1]) AS side)),
pairs AS (
  SELECT DISTINCT a.line AS a, b.line AS b, a.place AS a_place, b.place AS b_place, a.n AS a_n, b.n AS b_n
  FROM halves a JOIN halves b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND a.line <> b.line AND a.n <= b.n AND b.n <= a.n + 1),
close AS (
  SELECT * FROM pairs WHERE len(list_filter(range(1, b_n + 1), lambda i:
    substr(b, 1, i - 1) || substr(b, i + 1) = CASE WHEN a_n = b_n THEN substr(a, 1, i - 1) || substr(a, i + 1) ELSE a END)) > 0),
near AS (
  SELECT line, min(other) AS other FROM (SELECT a AS line, a_place AS place, b_place AS other FROM close UNION ALL SELECT b, b_place, a_place FROM close)
  WHERE other < place GROUP BY line),
judged AS (
  SELECT o.doc_id, o.line_no, {'d': o.doc_id, 'n': o.line_no} <> f.place AS copy, x.line IS NOT NULL AS near
  FROM occ o JOIN firsts f USING (line) LEFT JOIN near x USING (line))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (copy) AS n_copies, count(*) FILTER (near AND NOT copy) AS n_near,
  coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (copy OR near), '') AS removed
FROM judged GROUP BY doc_id
"""

LM_SCORING = f"""
WITH {_WORDED.strip()},
tok AS (SELECT doc_id, i, coalesce(words[i], ' end') AS w, coalesce(words[i - 1], ' start') AS v
        FROM (SELECT doc_id, words, unnest(range(1, len(words) + 2)) AS i FROM d)),
fold AS (SELECT doc_id, {_CRC} % 7 = 2 AS held_out FROM d),
train AS (SELECT v, w FROM tok JOIN fold USING (doc_id) WHERE NOT held_out),
uni AS (SELECT w, count(*) AS c FROM train GROUP BY w),
bi AS (SELECT v, w, count(*) AS c FROM train GROUP BY v, w),
ended AS (SELECT w, count(*) AS e FROM bi GROUP BY w),
ctx AS (SELECT v, sum(c) AS t, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2, count(*) FILTER (c > 2) AS n3 FROM bi GROUP BY v),
tot AS (SELECT (SELECT sum(c) FROM uni) AS n, (SELECT count(*) FROM uni) AS vocabulary, (SELECT count(*) FROM bi) AS b),
cc AS (
  SELECT 'high' AS o, c FROM bi UNION ALL SELECT 'low', e FROM ended),
nn AS (SELECT o, count(*) FILTER (c = 1)::DOUBLE AS a1, count(*) FILTER (c = 2)::DOUBLE AS a2, count(*) FILTER (c = 3)::DOUBLE AS a3,
       count(*) FILTER (c = 4)::DOUBLE AS a4, count(*) FILTER (c > 2)::DOUBLE AS more FROM cc GROUP BY o),
y AS (SELECT *, CASE WHEN a1 > 0 THEN a1 / (a1 + 2 * a2) ELSE 0 END AS y FROM nn),
dd AS (SELECT o, a1, a2, more,
  CASE WHEN a1 > 0 THEN least(1, greatest(0, 1 - 2 * y * a2 / a1)) ELSE 0.5 END::DOUBLE AS d1,
  CASE WHEN a2 > 0 THEN least(2, greatest(0, 2 - 3 * y * a3 / a2)) ELSE 1 END::DOUBLE AS d2,
  CASE WHEN a3 > 0 THEN least(3, greatest(0, 3 - 4 * y * a4 / a3)) ELSE 1.5 END::DOUBLE AS d3 FROM y),
hi AS (SELECT * FROM dd WHERE o = 'high'), lo AS (SELECT * FROM dd WHERE o = 'low'),
each AS (
  SELECT tok.doc_id, coalesce(uni.c, 0) AS c, n, vocabulary, ctx.t, coalesce(bi.c, 0) AS bc,
    hi.d1 * n1 + hi.d2 * n2 + hi.d3 * n3 AS rest, hi.d1 AS h1, hi.d2 AS h2, hi.d3 AS h3,
    (coalesce(e, 0) - CASE coalesce(e, 0) WHEN 0 THEN 0 WHEN 1 THEN lo.d1 WHEN 2 THEN lo.d2 ELSE lo.d3 END) / b
      + (lo.d1 * lo.a1 + lo.d2 * lo.a2 + lo.d3 * lo.more) / b / (vocabulary + 1) AS p_low
  FROM tok, tot, hi, lo LEFT JOIN uni ON uni.w = tok.w LEFT JOIN ended ON ended.w = tok.w
  LEFT JOIN ctx ON ctx.v = tok.v LEFT JOIN bi ON bi.v = tok.v AND bi.w = tok.w),
scored AS (
  SELECT doc_id, c, n, log10((c + 1.0::DOUBLE) / (n + vocabulary + 1)) AS base,
    log10(CASE WHEN t > 0 THEN (bc - CASE bc WHEN 0 THEN 0 WHEN 1 THEN h1 WHEN 2 THEN h2 ELSE h3 END + rest * p_low) / t ELSE p_low END) AS s
  FROM each)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
  round(sum(base), 6) AS base_score, round(sum(s), 6) AS score
FROM scored JOIN fold USING (doc_id) GROUP BY doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE {_WORDED.strip()},
sh AS (SELECT doc_id, len(words) AS n, unnest(range(1, greatest(len(words) - 3, 2))) AS i, words FROM d WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, words[i:i + 4] AS k FROM sh),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM two UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b = t.a),
comp AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) AS kept
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, {WORDS}) AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, words[i:i + 4] AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(0, 5) r(j) GROUP BY doc_id),
f AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals
  FROM w LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR 10 * n_symbols > n_words
    OR 100 * n_dup_lines > 30 * n_lines OR 2 * n_capitals > word_chars) AS kept
FROM f
"""

#: UTF-8 bytes of a text of letters below U+0100, and its CRC-32 by a table of 256 entries that is made by rule.
_TABLE = """crc_table AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END) ORDER BY b) AS t FROM range(256) r(b))"""
_BYTES = "flatten(list_transform(string_split({}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, unicode(ch)::BIGINT - 64] END))"

SPELLING_VARIANTS = rf"""
WITH {_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents WHERE text IS NOT NULL)
  GROUP BY doc_id, run),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")}),
    lambda a, x: xor(t[(xor(a, x) % 256) + 1], a // 256)), 4294967295::BIGINT) AS h FROM runs, crc_table),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
halves AS (
  SELECT word, n, l, m, side, CASE side WHEN 0 THEN substr(word, 1, m // 2) ELSE substr(word, l - (m - m // 2) + 1) END AS half
  FROM (SELECT word, n, length(word) AS l, unnest([length(word), length(word) - 1]) AS m FROM words), (SELECT unnest([0, 1]) AS side)),
pairs AS (
  SELECT DISTINCT a.word AS a, b.word AS b, a.n AS a_n, b.n AS b_n, a.l AS a_l, b.l AS b_l
  FROM halves a JOIN halves b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND a.word <> b.word AND a.l <= b.l AND b.l <= a.l + 1 AND a.l = a.m),
close AS (
  SELECT * FROM pairs WHERE len(list_filter(range(1, b_l + 1), lambda i:
    substr(b, 1, i - 1) || substr(b, i + 1) = CASE WHEN a_l = b_l THEN substr(a, 1, i - 1) || substr(a, i + 1) ELSE a END)) > 0),
near AS (SELECT DISTINCT * FROM (SELECT a AS word, a_n AS n, b AS other, b_n AS other_n FROM close UNION ALL SELECT b, b_n, a, a_n FROM close)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near),
best AS (SELECT word, n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM ranked WHERE place = 1),
formed AS (SELECT w.word, w.n, form, coalesce(n_near, 0) AS n_near, form_n FROM words w LEFT JOIN best USING (word)),
steps AS (
  SELECT f1.word, coalesce(f6.form, f5.form, f4.form, f3.form, f2.form, f1.form, f1.word) AS root FROM formed f1
  LEFT JOIN formed f2 ON f2.word = f1.form LEFT JOIN formed f3 ON f3.word = f2.form LEFT JOIN formed f4 ON f4.word = f3.form
  LEFT JOIN formed f5 ON f5.word = f4.form LEFT JOIN formed f6 ON f6.word = f5.form)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN steps USING (word)
"""

_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_PLUS = "CASE WHEN {1} IS NOT NULL THEN {{'c': {1}.c + {0}, 'a': {2} || {1}.a}} END"


def _least(*choices: str) -> str:
    return f"list_min(list_filter([{', '.join(choices)}], lambda x: x IS NOT NULL))"


def _state(state: int, kept: str) -> str:
    """Cheapest edits at a row from a state on, before any insertion; ``kept``: when the row may stay, and the state then."""
    after = (2, 2, 3, 2)[state]
    return _least(
        _PLUS.format(2, f"f{state}", "'D'"),
        f"CASE WHEN stays THEN {_PLUS.format('1 + late', f'f{after}', chr(39) + 'R' + chr(39))} END",
        *(f"CASE WHEN stays AND c = '{c}' THEN {_PLUS.format('late', f'f{to}', chr(39) + 'K' + chr(39))} END" for c, to in (x.split(">") for x in kept.split())),
    )


def _insert(state: int) -> str:
    once = (2, 2, 3, 2)[state]
    twice = (2, 2, 3, 2)[once]
    return _least(f"b{state}", _PLUS.format(5, f"b{once}", "'I'"), _PLUS.format(10, f"b{twice}", "'II'"))


CONVERSATION_REPAIR = rf"""
WITH RECURSIVE {_TABLE},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_KEY} AS k FROM conversations),
source AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES.format("k")}), lambda a, x: xor(t[(xor(a, x) % 256) + 1], a // 256)), 4294967295::BIGINT) % 20 AS f
  FROM keyed, crc_table),
d AS (
  SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE f WHEN 3 THEN [0, 1] ELSE [0] END) AS again
  FROM source WHERE f <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) > 1 AS seen,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS e
  FROM d),
s AS (
  SELECT conv_id, turn, i, role, text, left(role, 1) AS c, e = '' AS blank, e <> '' AND seen AS duplicate,
    e <> '' AND NOT seen AND right(e, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two
  FROM o),
counted AS (
  SELECT conv_id, count(*) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM s GROUP BY conv_id),
steps AS (
  SELECT conv_id, rows_ AS i, {{'c': 0::BIGINT, 'a': ''}} AS f0, {{'c': 10::BIGINT, 'a': 'II'}} AS f1, {{'c': 5::BIGINT, 'a': 'I'}} AS f2, {{'c': 0::BIGINT, 'a': ''}} AS f3 FROM counted
  UNION ALL
  SELECT conv_id, i - 1, {_insert(0)}, {_insert(1)}, {_insert(2)}, {_insert(3)} FROM (
    SELECT conv_id, i, {_state(0, "s>1 u>2")} AS b0, {_state(1, "u>2")} AS b1, {_state(2, "a>3")} AS b2, {_state(3, "u>2")} AS b3 FROM (
      SELECT steps.*, s.c, NOT blank AND NOT duplicate AS stays, 5 * truncated::BIGINT AS late
      FROM steps JOIN s ON steps.conv_id IS NOT DISTINCT FROM s.conv_id AND steps.i = s.i))),
solved AS (SELECT conv_id, f0.c AS cost, f0.a AS audit FROM steps WHERE i = 0),
edits AS (
  SELECT conv_id, j, ops[j] AS op, len(list_filter(ops[1:j], lambda x: x <> 'I')) AS i, len(list_filter(ops[1:j], lambda x: x <> 'D')) - 1 AS position
  FROM (SELECT conv_id, string_split(audit, '') AS ops, unnest(range(1, length(audit) + 1)) AS j FROM solved)),
lines AS (
  SELECT x.conv_id, j, position, CASE op WHEN 'K' THEN s.role END AS own, CASE op WHEN 'I' THEN '' ELSE s.text END AS text,
    max(CASE WHEN op = 'K' AND position = 0 AND s.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY x.conv_id) AS shift
  FROM edits x LEFT JOIN s ON x.conv_id IS NOT DISTINCT FROM s.conv_id AND x.i = s.i WHERE op <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(coalesce(own, CASE WHEN (position - shift) % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j) AS body
  FROM lines GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counted b ON a.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN solved c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON a.conv_id IS NOT DISTINCT FROM r.conv_id
"""
