"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import spotsigs

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

NGRAM_JACCARD = rf"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (SELECT r, doc_id, list_distinct(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles FROM w),
flat AS (SELECT r, len(shingles) AS n, unnest(shingles) AS s FROM sets),
common AS (SELECT a.r AS a, b.r AS b, a.n AS an, b.n AS bn, count(*) AS c FROM flat a JOIN flat b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (an + bn - c)),
reach(a, b) AS (SELECT r, r FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT s.doc_id, any_value(len(s.shingles)) AS n_shingles, min(t.doc_id) AS component_id FROM sets s JOIN reach ON reach.a = s.r JOIN sets t ON t.r = reach.b GROUP BY s.r, s.doc_id"""

_SIGS = f"""SELECT r, which, list_sort(list_distinct(list(md5(w || ' ' || coalesce(c1, '') || coalesce(' ' || c2, ''))[1:{spotsigs.DIGITS}]) FILTER (anchor))) AS found FROM (
  SELECT *, nth_value(CASE WHEN NOT anchor THEN w END, 1 IGNORE NULLS) OVER f AS c1, nth_value(CASE WHEN NOT anchor THEN w END, 2 IGNORE NULLS) OVER f AS c2 FROM (
    SELECT r, which, i, words[i] AS w, list_contains({list(spotsigs.ANCHORS)}, words[i]) AS anchor FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM words))
  WINDOW f AS (PARTITION BY r, which ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) GROUP BY r, which"""


def _likeness(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE END"


FINGERPRINTS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER o AS r, lead(coalesce(text, '')) OVER o AS after, first_value(coalesce(text, '')) OVER o AS first FROM documents WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, '')))),
e AS (SELECT *, coalesce(after, first) AS following, length(text) // 3 AS cut, count(*) OVER () AS n FROM d),
x AS (SELECT *, left(text, length(text) - cut) || left(following, cut) AS edited FROM e),
variants AS (SELECT r, 't' AS which, text AS t FROM x UNION ALL SELECT r, 'e', edited FROM x),
joined AS (SELECT *, trim(regexp_replace(lower(t), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS j FROM variants),
words AS (SELECT *, CASE WHEN j = '' THEN [] ELSE string_split(j, ' ') END AS words FROM joined),
found AS ({_SIGS}),
sigs AS (SELECT w.r, w.which, CASE WHEN w.t = '' THEN [] WHEN len(coalesce(found, [])) > 0 THEN found ELSE [md5(' ' || CASE WHEN j = '' THEN t ELSE j END)[1:{spotsigs.DIGITS}]] END AS s FROM words w LEFT JOIN found USING (r, which)),
m AS (SELECT x.*, a.s AS sigs, b.s AS edited_sigs, c.s AS next_sigs FROM x JOIN sigs a ON a.r = x.r AND a.which = 't' JOIN sigs b ON b.r = x.r AND b.which = 'e' JOIN sigs c ON c.r = x.r % x.n + 1 AND c.which = 't'),
k AS (SELECT *, {_likeness("sigs", "edited_sigs")} AS near_edited, {_likeness("sigs", "next_sigs")} AS near_next,
  {", ".join(f"CASE WHEN len({c}) > 0 THEN floor(ln(len({c})) / ln(1.25::DOUBLE) + 1e-9)::INTEGER ELSE -1 END AS {n}" for c, n in (("sigs", "length_class"), ("edited_sigs", "ec"), ("next_sigs", "nc")))} FROM m)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(sigs, '') AS fingerprint, array_to_string(edited_sigs, '') AS edited_fingerprint, near_edited, near_next, length_class,
  abs(length_class - ec) <= 1 AND near_edited >= {spotsigs.SIMILAR} AS copy_edited, abs(length_class - nc) <= 1 AND near_next >= {spotsigs.SIMILAR} AS copy_next FROM k"""

_ESCAPED = r"replace(replace(replace({0}, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn')"
_HOSTILE = r"\### Assistant: </turn> ok"

CHAT_FORMATTING = f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{_HOSTILE}'), (-7, 1, 'assistant', '{_HOSTILE}')),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM c),
f AS (SELECT *, '<turn>' || replace({_ESCAPED.format("role")}, chr(10), '\\n') || chr(10) || {_ESCAPED.format("text")} || '</turn>' || chr(10) AS shown FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns, coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss, sum(length(shown))::BIGINT AS formatted_chars FROM f GROUP BY 1)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

FILTER_AUDIT = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
told AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(w) < 100)::INTEGER + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INTEGER + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t))::INTEGER
  + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INTEGER AS mask FROM d LEFT JOIN told ON told.doc_id = d.doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM f GROUP BY ALL),
b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.l || b1.l || b2.l || b3.l || b4.l AS filter_order FROM b a, b b1, b b2, b b3, b b4 WHERE len(list_distinct([a.l, b1.l, b2.l, b3.l, b4.l])) = 5),
s AS (SELECT filter_order, step, b.bit, (SELECT coalesce(sum(e.bit), 0)::INTEGER FROM b e WHERE strpos(left(filter_order, step::INTEGER - 1), e.l) > 0) AS before FROM o, range(1, 6) r(step), b WHERE b.l = filter_order[step]),
p AS (SELECT DISTINCT part FROM f),
r AS (SELECT part, filter_order, step::INTEGER AS step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(g) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost FROM p JOIN c USING (part), s GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""


def _after(state: int, cost: str, edit: str, only: str = "true") -> str:
    """The path v[state] with an edit more, null where it isn't reached."""
    return f"CASE WHEN v[{state}] IS NOT NULL AND {only} THEN {{'c': v[{state}].c + {cost}, 'a': v[{state}].a || '{edit}'}} END"


def _least(*paths: str) -> str:
    return f"list_sort(list_filter([{', '.join(paths)}], lambda x: x IS NOT NULL))[1]"


def _closed(paths: str, source: str) -> str:
    """Rows of source with the list v of paths followed by insertions."""
    first = f"SELECT * REPLACE ([v[1], v[2], {_least('v[3]', _after(1, '2', 'I'), _after(2, '2', 'I'))}, v[4]] AS v) FROM (SELECT {paths} FROM {source})"
    second = f"SELECT * REPLACE ([v[1], v[2], v[3], {_least('v[4]', _after(3, '2', 'I'))}] AS v) FROM ({first})"
    return f"SELECT * REPLACE ([v[1], v[2], {_least('v[3]', _after(4, '2', 'I'))}, v[4]] AS v) FROM ({second})"


def _taken(state: int, initial: str) -> tuple[str, str]:
    return _after(state, "late", "K", f"NOT gone AND i = '{initial}'"), _after(state, "2 + late", "R", "NOT gone")


_STEP = ", ".join([
    _after(1, "3", "D"), _least(_after(2, "3", "D"), _after(1, "late", "K", "NOT gone AND i = 's'")),
    _least(_after(3, "3", "D"), *_taken(1, "u"), *_taken(2, "u"), *_taken(4, "u")), _least(_after(4, "3", "D"), *_taken(3, "a")),
])
_CRC = "xor(list_reduce(flatten(list_transform(string_split(key, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0])), lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384), 4294967295::BIGINT), 4294967295)"

STRUCTURE_REPAIR = rf"""WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT *, {_CRC} % 20 AS kind FROM named),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
o AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM d),
f AS (SELECT *, role[1] AS i, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut FROM o),
g AS (SELECT *, blank OR again AS gone, (NOT blank AND NOT again AND cut)::BIGINT AS late, lag(i) OVER (PARTITION BY conv_id ORDER BY k) || i AS pair FROM f),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, sum(late)::BIGINT AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM g GROUP BY 1),
best(conv_id, k, v) AS ({_closed("*", "(SELECT conv_id, 0::BIGINT AS k, [{'c': 0::BIGINT, 'a': ''}, NULL, NULL, NULL] AS v FROM told)")}
  UNION ALL {_closed(f"conv_id, k, [{_STEP}] AS v", "(SELECT g.*, v FROM best JOIN g ON g.conv_id IS NOT DISTINCT FROM best.conv_id AND g.k = best.k + 1)")}),
ends AS (SELECT told.*, {_least("v[1]", "v[4]")} AS p FROM told JOIN best ON best.conv_id IS NOT DISTINCT FROM told.conv_id AND best.k = told.n),
edits AS (SELECT conv_id, nr, p.a[nr] AS edit FROM (SELECT conv_id, p, unnest(range(1, len(p.a) + 1)) AS nr FROM ends)),
places AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS k, count(*) FILTER (edit <> 'D') OVER w AS place FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY nr)),
kept AS (SELECT e.*, g.role, g.text, bool_or(edit = 'K' AND i = 's') OVER (PARTITION BY e.conv_id)::INTEGER AS shift FROM places e LEFT JOIN g ON edit <> 'I' AND g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.k = e.k WHERE edit <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY nr) AS whole FROM kept GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(p.c, 0) AS cost, coalesce(p.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM c.conv_id"""
