"""DuckDB SQL for the operators that SQL can express."""

import string

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_PUNCT = string.punctuation.replace("'", "''")
_PLAIN = f"translate(coalesce(text, ''), '{string.ascii_uppercase}{_PUNCT}', '{string.ascii_lowercase}{' ' * len(string.punctuation)}')"


def _shingles(table: str, key: str, text: str, k: int) -> str:
    """Distinct k-word shingles; shorter word lists count whole."""
    parts = ", ".join(f"w[i + {j}]" for j in range(k))
    return f"""
      SELECT DISTINCT {key}, CASE WHEN len(w) < {k} THEN w ELSE [{parts}] END AS s FROM (
        SELECT {key}, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i FROM (
          SELECT {key}, regexp_extract_all({text}, '{_WORD}') AS w FROM {table}) WHERE len(w) > 0)"""


OP3 = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS no, ls[i] AS line FROM (
    SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (
      SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))),
bags AS (
  SELECT doc_id, no, list_sort(list_distinct(regexp_extract_all(lower(line), '{_WORD}'))) AS k FROM lines),
sets AS (SELECT k, len(k) AS n, min((doc_id, no)) AS f FROM bags WHERE len(k) > 0 GROUP BY k),
words AS (SELECT f, n, unnest(k) AS w FROM sets),
df AS (SELECT w, count(*) AS c FROM words GROUP BY w),
pref AS (
  SELECT f, w FROM (
    SELECT f, n, words.w, row_number() OVER (PARTITION BY f ORDER BY c, words.w) AS r FROM words JOIN df USING (w))
  WHERE r <= n - (4 * n + 4) // 5 + 1),
cand AS (SELECT DISTINCT a.f AS s, b.f AS t FROM pref a JOIN pref b USING (w) WHERE a.f > b.f),
later AS (
  SELECT DISTINCT s FROM (
    SELECT s, a.n + b.n AS total, len(list_intersect(a.k, b.k)) AS x
    FROM cand JOIN sets a ON a.f = s JOIN sets b ON b.f = t) WHERE 5 * x >= 4 * (total - x)),
gone AS (
  SELECT bags.doc_id, bags.no FROM bags JOIN sets USING (k)
  WHERE f <> (bags.doc_id, bags.no) OR f IN (SELECT s FROM later)),
rest AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY no) FILTER (WHERE g IS NULL) AS text, count(g) AS n FROM (
    SELECT lines.*, gone.no AS g FROM lines LEFT JOIN gone ON lines.doc_id = gone.doc_id AND lines.no = gone.no)
  GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN rest.n > 0 THEN coalesce(rest.text, '') ELSE d.text END AS text, d.lang, d.source,
       CASE WHEN rest.n > 0 THEN length(coalesce(rest.text, '')) ELSE d.n_chars END AS n_chars, coalesce(rest.n, 0) AS lines_removed
FROM documents d LEFT JOIN rest ON d.doc_id = rest.doc_id
"""

OP5 = f"""
WITH RECURSIVE sh AS ({_shingles("documents", "doc_id", _LOWER, 3)}),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT x.a, x.b FROM (
    SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM sh p JOIN sh q USING (s) WHERE p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
class AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM (
    SELECT doc_id, list(s ORDER BY s) AS k FROM sh GROUP BY doc_id))
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id,
       coalesce(class.class_id, d.doc_id) AS class_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) r USING (doc_id)
LEFT JOIN class USING (doc_id)
"""

OP6 = f"""
WITH d AS ({_shingles("documents", "doc_id", _PLAIN, 5)}),
b AS ({_shingles("benchmark", "item_id", _PLAIN, 5)}),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (s) GROUP BY ALL) JOIN n USING (item_id)
WHERE 5 * shared >= 4 * item_shingles
"""

OP9 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
tri AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM tri) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
lines AS (
  SELECT r, doc_id, source, l, regexp_extract_all(lower(l), '{_WORD}') AS ws FROM (
    SELECT r, doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_WORD}')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
hosts AS (SELECT source, count(DISTINCT [doc_id]) AS n FROM d GROUP BY source),
freq AS (
  SELECT f.source, ws, f FROM (
    SELECT source, ws, min(doc_id) AS f, count(DISTINCT [doc_id]) AS c FROM lines GROUP BY source, ws HAVING count(DISTINCT [doc_id]) > 5) f
  JOIN hosts ON f.source IS NOT DISTINCT FROM hosts.source WHERE 100 * c > n),
gone AS (
  SELECT lines.r, sum(len(lines.ws)) AS n FROM lines
  JOIN freq ON lines.source IS NOT DISTINCT FROM freq.source AND lines.ws = freq.ws AND lines.doc_id IS DISTINCT FROM freq.f GROUP BY ALL),
base AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
         coalesce(cov.n, 0) AS n_repeat_words, cast(coalesce(gone.n, 0) AS bigint) AS removed_words
  FROM d LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 50
       AND 2 * (n_words - removed_words) >= n_words AS kept
FROM base
"""

_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')"

OP11 = f"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, {_NORMAL} AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER g = 1 AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST)
"""

#: crc32 of a short ASCII text, bit by bit.
_CRC = """
  xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split({0}, ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


_SPACES = r"[\x20\x09-\x0D]"
_NEVER = 1 << 40


def _edit(then: str, cost: str, letter: str, line: str = "''") -> str:
    """The cheapest way to the end ``then`` with one edit before it: cost, audit, lines behind line feeds."""
    return f"{{'c': {then}.c + {cost}, 'a': '{letter}' || {then}.a, 'r': {line} || {then}.r}}"


def _state(q: str) -> str:
    """Least of deleting, keeping and retyping row x in state q, given s0, ss, su, sa behind the row."""
    cut, whole = "CASE WHEN x.fault = 3 THEN 5 ELSE 0 END", "x.fault NOT IN (1, 2)"
    ways = [_edit(f"y.s{q}", "2", "D")]
    for initial, to in (("s", "s"), ("u", "u"), ("a", "a")):
        if q in {"s": "0", "u": "0sa", "a": "u"}[initial]:
            kept = _edit(f"y.s{to}", cut, "K", "chr(10) || x.role || ':' || x.text")
            ways.append(f"CASE WHEN {whole} AND x.role[1] = '{initial}' THEN {kept} ELSE never END")
    to, role = ("a", "assistant") if q == "u" else ("u", "user")
    ways.append(f"CASE WHEN {whole} THEN {_edit(f'y.s{to}', f'1 + {cut}', 'R', f"chr(10) || '{role}:' || x.text")} ELSE never END")
    return f"list_min([{', '.join(ways)}])"


_IN_U, _IN_A = (_edit("{0}", "5", "I", f"chr(10) || '{r}:'") for r in ("user", "assistant"))


def _least(own: str, insert: str, then: str) -> str:
    return f"list_min([{own}, {insert.replace('{0}', then)}])"


OP12 = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ') AS k FROM conversations),
hit AS (SELECT *, {_CRC.format("k")} % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hit WHERE kind <> 0),
numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '{_SPACES}+$', '') AS t
  FROM damaged),
rows AS (
  SELECT *, CASE WHEN t = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 2
                 WHEN t[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(role[1]) OVER (PARTITION BY conv ORDER BY i) || role[1] AS pair
  FROM numbered),
stats AS (
  SELECT conv_id, conv, count(*) AS n, coalesce(max(turn)::hugeint - min(turn) + 1 - count(DISTINCT turn), 0)::bigint AS gaps,
         count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id, conv),
step AS (
  SELECT conv, n + 1 AS i, {{'c': {_NEVER}::bigint, 'a': 'Z', 'r': ''}} AS never, {{'c': 0::bigint, 'a': '', 'r': ''}} AS s0,
         {{'c': 10::bigint, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS ss,
         {{'c': 5::bigint, 'a': 'I', 'r': chr(10) || 'assistant:'}} AS su, {{'c': 0::bigint, 'a': '', 'r': ''}} AS sa
  FROM stats
  UNION ALL
  SELECT conv, i, never, {_least("b0", _IN_U, "cu")}, {_least("bs", _IN_U, "cu")}, cu, ca FROM (
    SELECT *, {_least("bu", _IN_A, "ba")} AS cu, {_least("ba", _IN_U, "bu")} AS ca FROM (
      SELECT y.conv, x.i, never, {_state("0")} AS b0, {_state("s")} AS bs, {_state("u")} AS bu, {_state("a")} AS ba
      FROM step y JOIN rows x ON x.conv = y.conv AND x.i = y.i - 1)))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(s0.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN step ON step.conv = stats.conv AND step.i = 1
"""


def _leaf(n_chars: str) -> str:
    parts = (f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in (f"cast({c} AS varchar)" for c in ("doc_id", "source", "lang", n_chars, "text")))
    return f"sha256({' || '.join(parts)})"


def _levels(name: str, start: str) -> str:
    """CTE of all nodes of the trees over ``start`` (tree, idx, size, h)."""
    return f"""
{name} AS (
  SELECT tree, 0 AS lvl, idx, size, h FROM {start}
  UNION ALL
  SELECT tree, lvl + 1, idx // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE size > 1
  GROUP BY tree, lvl, idx // 2, size)"""


def _climb(name: str, start: str, levels: str) -> str:
    """CTE of what the leaves of ``start`` (no, tree, idx, size, folded, proof) meet on the way up."""
    return f"""
{name} AS (
  SELECT no, tree, 0 AS lvl, idx, size, folded, proof FROM {start}
  UNION ALL
  SELECT no, c.tree, c.lvl + 1, c.idx // 2, (c.size + 1) // 2,
         sha256(CASE WHEN c.idx % 2 = 0 THEN folded || coalesce(s.h, '') ELSE s.h || folded END), proof || coalesce(s.h, '')
  FROM {name} c LEFT JOIN {levels} s ON s.tree IS NOT DISTINCT FROM c.tree AND s.lvl = c.lvl AND s.idx = xor(c.idx, 1) WHERE c.size > 1)"""


OP13 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang AS tree, {_leaf("n_chars")} AS h, '' AS proof,
         CASE WHEN doc_id IS NOT NULL AND {_CRC.format("cast(doc_id AS varchar)")} % 7 = 0 THEN {_leaf("n_chars::hugeint + 1")} ELSE {_leaf("n_chars")} END AS folded
  FROM documents),
l AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, h) AS no, count(*) OVER (PARTITION BY tree) AS size,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx
  FROM d),
{_levels("nodes", "l")},
{_climb("up", "l", "nodes")},
s AS (
  SELECT 0 AS tree, tree AS lang, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx, count(*) OVER () AS size
  FROM nodes WHERE size = 1),
{_levels("tops", "s")},
mid AS (
  SELECT no, s.tree, s.idx, s.size, folded, proof FROM up JOIN s ON s.lang IS NOT DISTINCT FROM up.tree WHERE up.size = 1),
{_climb("way", "mid", "tops")}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, tops.h AS root, sha256(way.proof) AS proof_sha256, way.folded AS folded_root,
       way.folded = tops.h AS verified
FROM way JOIN l USING (no) JOIN s ON s.lang IS NOT DISTINCT FROM l.tree JOIN tops ON tops.size = 1 WHERE way.size = 1
"""

ORACLE_SQL = {
    "op3_line_dedup": OP3, "op5_ngram_join": OP5, "op6_decontamination": OP6, "op9_line_rules": OP9,
    "op11_exact_dedup": OP11, "op12_conversations": OP12, "op13_merkle": OP13,
}
