"""SQL of the chat, spelling and manifest queries, as DuckDB runs it."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The table of CRC-32, by its polynomial.
_CRC = """crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i)))"""
_CRC_OF = """xor(list_reduce([CAST('0x' || substr(hex(encode({0})), 2 * k - 1, 2) AS BIGINT) for k in range(1, octet_length(encode({0})) + 1)],
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1]), 4294967295), 4294967295)"""

OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)),
escapes AS (
  SELECT *, length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7 + coalesce(list_sum([length(x) - 2 for x in regexp_extract_all(text, '#{3,}')]), 0) AS more,
    length(role) - length(replace(role, '\', '')) + (length(role) - length(replace(role, '</turn>', ''))) // 7 + coalesce(list_sum([length(x) - 2 for x in regexp_extract_all(role, '#{3,}')]), 0)
      + (length(role) - length(replace(role, ': ', ''))) // 2 AS role_more FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + role_more + 2 + length(text) + more + 8) AS BIGINT) AS formatted_chars
FROM escapes GROUP BY conv_id
"""

OP12_SQL = f"""
WITH RECURSIVE {_CRC},
runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOWER.format('text')}, '[a-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY id, run),
hashed AS (SELECT run, n, {_CRC_OF.format("(id || ':' || run)")} AS h FROM runs, crc WHERE length(run) >= 6),
spoilt AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (
  SELECT word, n, k, CASE k WHEN 0 THEN word ELSE substr(word, 1, k - 1) || substr(word, k + 1) END AS v
  FROM (SELECT word, n, unnest(range(0, length(word) + 1)) AS k FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.v = b.v AND a.word != b.word
  WHERE a.k = b.k OR a.k = 0 OR b.k = 0),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
links AS MATERIALIZED (SELECT word, form FROM formed WHERE form IS NOT NULL),
ways AS (
  SELECT word, form AS root, 1 AS step FROM links UNION ALL
  SELECT w.word, l.form, step + 1 FROM ways w JOIN links l ON l.word = w.root)
SELECT f.word, n, n_near, form, form_n, coalesce(r.root, f.word) AS root
FROM formed f LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM ways GROUP BY word) r USING (word)
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = lambda n_chars: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"

OP13_SQL = f"""
WITH RECURSIVE {_CRC},
hashed AS (
  SELECT row_number() OVER () AS row_id, doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp, {_LEAF('n_chars')} AS leaf,
    CASE WHEN {_CRC_OF.format("coalesce(CAST(doc_id AS VARCHAR), '')")} % 7 = 0 THEN {_LEAF('(n_chars + 1)')} ELSE {_LEAF('n_chars')} END AS claimed
  FROM documents, crc),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM hashed),
tree AS (
  SELECT grp, i, leaf AS d, 0 AS lvl, n FROM placed UNION ALL
  SELECT grp, i // 2, sha256(string_agg(d, '' ORDER BY i)), lvl + 1, (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY grp, i // 2, lvl, n),
subroots AS MATERIALIZED (SELECT grp, d, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT i, d, 0 AS lvl, n FROM subroots UNION ALL
  SELECT i // 2, sha256(string_agg(d, '' ORDER BY i)), lvl + 1, (n + 1) // 2 FROM top WHERE n > 1 GROUP BY i // 2, lvl, n),
up AS (
  SELECT row_id, grp, i, n, 0 AS lvl, claimed AS d, '' AS proof FROM placed UNION ALL
  SELECT f.row_id, f.grp, f.i // 2, (f.n + 1) // 2, f.lvl + 1, sha256(CASE WHEN f.i % 2 = 1 THEN s.d || f.d ELSE f.d || coalesce(s.d, '') END), f.proof || coalesce(s.d, '')
  FROM up f LEFT JOIN tree s ON s.grp = f.grp AND s.lvl = f.lvl AND s.i = xor(f.i, 1) WHERE f.n > 1),
over AS (
  SELECT row_id, r.i, r.n, 0 AS lvl, f.d, proof FROM up f JOIN subroots r USING (grp) WHERE f.n = 1 UNION ALL
  SELECT f.row_id, f.i // 2, (f.n + 1) // 2, f.lvl + 1, sha256(CASE WHEN f.i % 2 = 1 THEN s.d || f.d ELSE f.d || coalesce(s.d, '') END), f.proof || coalesce(s.d, '')
  FROM over f LEFT JOIN top s ON s.lvl = f.lvl AND s.i = xor(f.i, 1) WHERE f.n > 1)
SELECT doc_id, leaf, r.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, o.d AS folded_root, o.d = t.d AS verified
FROM placed p JOIN over o USING (row_id) JOIN subroots r ON r.grp = p.grp JOIN top t ON t.n = 1 WHERE o.n = 1
"""
