"""DuckDB SQL for the operators that SQL can express, over whole tables."""

WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"

#: ``links`` (a, b) in both directions -> the smallest id each node reaches.
REACH = """reach AS (SELECT id AS node, id AS top FROM nodes
  UNION SELECT l.b, r.top FROM reach r JOIN links l ON l.a = r.node),
named AS (SELECT node, MIN(top) AS component_id FROM reach GROUP BY node)"""

OP2 = f"""WITH RECURSIVE v AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
nodes AS (SELECT id FROM v),
fine AS (SELECT id, x FROM v WHERE x IS NOT NULL AND len(x) > 0
  AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform(x, lambda c: abs(c))) > 0),
links AS (SELECT p.id AS a, q.id AS b FROM fine p JOIN fine q ON p.id <> q.id AND len(p.x) = len(q.x)
  AND list_cosine_similarity(p.x, q.x) >= 0.9),
{REACH}
SELECT node AS vec_id, (SELECT COUNT(*) FROM links WHERE a = node) AS n_links, component_id,
  node = component_id AS kept FROM named"""

OP4 = f"""WITH RECURSIVE w AS (
  SELECT doc_id AS id, {WORDS.format(t="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words
  FROM documents),
nodes AS (SELECT id FROM w),
s AS (SELECT DISTINCT id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (
  SELECT id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT id, COUNT(*) AS n FROM s GROUP BY id),
common AS (SELECT p.id AS a, q.id AS b, COUNT(*) AS c FROM s p JOIN s q ON p.shingle = q.shingle AND p.id <> q.id
  GROUP BY p.id, q.id),
links AS (SELECT a, b FROM common JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b
  WHERE 100 * c >= 85 * (p.n + q.n - c)),
{REACH}
SELECT node AS doc_id, coalesce(n, 0) AS n_shingles, component_id, node = component_id AS kept
FROM named LEFT JOIN sizes ON sizes.id = node"""

OP8 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {WORDS.format(t="t")} AS words FROM d),
windows AS (SELECT r, i, array_to_string(words[i:i + 2], ' ') AS win FROM (
  SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, COUNT(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, COUNT(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM twice, (VALUES (0), (1), (2)) AS o(k))
  GROUP BY r),
lines AS (SELECT r, COUNT(*) AS n, COUNT(DISTINCT line) AS u FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT w.r, doc_id, CAST(len(words) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(l.n - l.u, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
  len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha
  FROM w LEFT JOIN lines l ON l.r = w.r LEFT JOIN covered c ON c.r = w.r),
f AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END
  + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 8 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END
  + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 32 ELSE 0 END
  + CASE WHEN 100 * n_alpha < 60 * n_words THEN 64 ELSE 0 END AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failed = 0 AS kept, failed FROM f"""


#: ``tab``: the 256 steps of CRC-32; ``crc``: over a list of bytes.
CRC_TABLE = """tab AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM range(256) AS r(i)))"""
CRC = "xor(list_reduce([4294967295] || {b}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)"
CODES = "list_transform(string_split({s}, ''), lambda c: CAST(ord(c) AS BIGINT))"
UTF8 = ("flatten(list_transform(string_split({s}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] "
        "ELSE [195, CAST(ord(c) - 64 AS BIGINT)] END))")

OP11 = rf"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, COUNT(*) AS n FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, {CRC.format(b="(" + CODES.format(s="coalesce(CAST(doc_id AS VARCHAR), '') || ':'") + " || "
  + UTF8.format(s="run") + ")")} AS h FROM counted, tab),
changed AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2)
  ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(SUM(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 6 GROUP BY word HAVING SUM(n) >= 5),
spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
blanks AS (SELECT word, n, substring(word, 1, i - 1) || '*' || substring(word, i + 1) AS form FROM spots),
cuts AS (SELECT DISTINCT word, n, substring(word, 1, i - 1) || substring(word, i + 1) AS form FROM spots),
pairs AS (SELECT a.word AS a, b.word AS b, b.n FROM blanks a JOIN blanks b ON a.form = b.form AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.form = w.word
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.form = w.word),
near AS (SELECT a, COUNT(*) AS n_near, MAX(n) AS most FROM pairs GROUP BY a),
best AS (SELECT p.a, MIN(p.b) AS form FROM pairs p JOIN near m ON p.a = m.a AND p.n = m.most GROUP BY p.a),
forms AS (SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN m.most >= 5 * w.n THEN b.form END AS form,
  CASE WHEN m.most >= 5 * w.n THEN m.most END AS form_n
  FROM words w LEFT JOIN near m ON m.a = w.word LEFT JOIN best b ON b.a = w.word),
walk AS (SELECT word, word AS here FROM forms
  UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.here WHERE f.form IS NOT NULL),
roots AS (SELECT w.word, w.here AS root FROM walk w JOIN forms f ON f.word = w.here WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word"""

FIELD = "coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
LEAF = "sha256(" + " || ".join(FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: the levels of all trees in ``from``: (tree, level, pos, digest, n), n being the level's nodes
LEVELS = """UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 8, n"""
#: each node's siblings to the left and to the right
BESIDE = """SELECT a.tree, a.level, a.pos, a.digest, a.n,
  coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
  coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8
  GROUP BY a.tree, a.level, a.pos, a.digest, a.n"""

OP12 = f"""WITH RECURSIVE {CRC_TABLE},
hashed AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {LEAF.format(text="text")} AS leaf,
  CASE WHEN {CRC.format(b=CODES.format(s="CAST(doc_id AS VARCHAR)"))} % 3 = 0
  THEN {LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents, tab),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  COUNT(*) OVER (PARTITION BY tree) AS n FROM hashed),
up AS (SELECT tree, 0 AS level, pos, leaf AS digest, n FROM leaves {LEVELS.format(name="up")}),
subroots AS (SELECT tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, COUNT(*) OVER () AS n
  FROM up WHERE n = 1),
top AS (SELECT '' AS tree, 0 AS level, pos, digest, n FROM subroots {LEVELS.format(name="top")}),
beside AS ({BESIDE.format(name="up")}), above AS ({BESIDE.format(name="top")}),
climb AS (SELECT tree, pos AS leaf_pos, 0 AS level, pos, '' AS proof, coalesce(changed, leaf) AS fold FROM leaves
  UNION ALL SELECT c.tree, c.leaf_pos, c.level + 1, c.pos // 8, c.proof || b.l || b.r, sha256(b.l || c.fold || b.r)
  FROM climb c JOIN beside b ON b.tree = c.tree AND b.level = c.level AND b.pos = c.pos AND b.n > 1),
reached AS (SELECT c.*, b.digest AS subroot FROM climb c JOIN beside b ON b.tree = c.tree AND b.level = c.level AND b.pos = c.pos AND b.n = 1),
over AS (SELECT r.tree, r.leaf_pos, r.subroot, 0 AS level, s.pos, r.proof, r.fold FROM reached r JOIN subroots s ON s.name = r.tree
  UNION ALL SELECT c.tree, c.leaf_pos, c.subroot, c.level + 1, c.pos // 8, c.proof || b.l || b.r, sha256(b.l || c.fold || b.r)
  FROM over c JOIN above b ON b.level = c.level AND b.pos = c.pos AND b.n > 1),
done AS (SELECT o.*, b.digest AS root FROM over o JOIN above b ON b.level = o.level AND b.pos = o.pos AND b.n = 1)
SELECT l.doc_id, l.leaf, d.subroot, d.root, sha256(d.proof) AS proof_sha256, d.fold AS folded_root, d.fold = d.root AS verified
FROM leaves l JOIN done d ON d.tree = l.tree AND d.leaf_pos = l.pos"""
