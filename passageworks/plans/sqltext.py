"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from passageworks.functions.wordlists import FOLD_FROM, FOLD_TO, IRREGULAR_FORMS, KEEP_WORDS, STOP_STEMS, SUFFIXES

WORD = r"'\p{L}+(?:[''’-]\p{L}+)*'"


def listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


LINES = "SELECT lang AS coll, doc_id AS grp, unnest(range(len(l)))::INT AS num, unnest(l) AS text FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)"
#: The turns in two collections, by whether the conversation's number is even.
HALVES = "SELECT CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS coll, conv_id AS grp, turn::INT AS num, text FROM conversations"
TURNS = "SELECT 'all' AS coll, conv_id AS grp, turn::INT AS num, text FROM conversations"


def norm(word: str) -> str:
    return f"regexp_replace(translate(lower(regexp_replace({word}, '[''’][sS]$', '')), '{FOLD_FROM}', '{FOLD_TO}'), '[^a-z0-9]', '', 'g')"


def passages(source: str) -> str:
    return f"p AS (SELECT row_number() OVER (ORDER BY grp, num) - 1 AS passage_id, coll, grp, num, text FROM ({source}))"


def tokens(source: str) -> str:
    """CTEs p (passages), t (tokens with norm), sm (stem of each norm), tok (tokens with stem), dl (lengths)."""
    return f"""{passages(source)},
ws AS (SELECT passage_id, regexp_extract_all(text, {WORD}) AS w FROM p),
dl AS (SELECT passage_id, len(w) AS dl FROM ws),
t AS (SELECT passage_id, pos, surface, {norm("surface")} AS norm FROM (SELECT passage_id, unnest(range(len(w)))::INT AS pos, unnest(w) AS surface FROM ws)),
{stems("SELECT DISTINCT norm FROM t")},
tok AS (SELECT t.*, sm.stem FROM t JOIN sm USING (norm))"""


def stems(source: str, name: str = "sm") -> str:
    irregular = ", ".join(f"('{a}', '{b}')" for a, b in IRREGULAR_FORMS.items())
    endings = " ".join(
        f"WHEN ends_with(norm, '{s}') AND length(norm) >= {len(s) + 3} AND regexp_matches(left(norm, length(norm) - {len(s)}), '[aeiouy]')" + (" AND right(left(norm, length(norm) - 1), 1) NOT IN ('s', 'u', 'i')" if s == "s" else "") + f" THEN left(norm, length(norm) - {len(s)})"
        for s in SUFFIXES
    )
    return f"""{name}_a AS (SELECT v.norm, CASE WHEN i.form IS NOT NULL THEN i.base WHEN v.norm IN ({listed(KEEP_WORDS)}) OR length(v.norm) <= 3 THEN NULL
  ELSE CASE {endings} ELSE v.norm END END AS b FROM ({source}) v LEFT JOIN (VALUES {irregular}) i(form, base) ON i.form = v.norm),
{name}_b AS (SELECT norm, CASE WHEN length(b) >= 4 AND right(b, 1) = left(right(b, 2), 1) AND contains('bdgmnprt', right(b, 1)) THEN left(b, length(b) - 1) ELSE b END AS b FROM {name}_a),
{name}_c AS (SELECT norm, CASE WHEN length(b) > 3 AND right(b, 1) = 'e' THEN left(b, length(b) - 1) ELSE b END AS b FROM {name}_b),
{name} AS (SELECT norm, coalesce(CASE WHEN length(b) > 2 AND right(b, 1) = 'i' THEN left(b, length(b) - 1) || 'y' ELSE b END, norm) AS stem FROM {name}_c)"""


STOP = f"({listed(STOP_STEMS)})"


def asked(rows: list[tuple[int, int, str]]) -> str:
    """CTE q of query words: plain ones, none of them required, open or a code."""
    return described([(*r, False, False, None) for r in rows])


def described(items: list[tuple[int, int, str, bool, bool, str | None]]) -> str:
    """CTE q (qid, term_no, norm, required, open, code, stem, stop) of query items (qid, term_no, norm, required, open, code)."""
    values = ", ".join(f"({q}, {k}, '{w}', {r}, {o}, {f"'{c}'" if c else 'NULL::VARCHAR'})" for q, k, w, r, o, c in items)
    return f"""q0 AS (SELECT * FROM (VALUES {values}) v(qid, term_no, norm, required, "open", code)),
{stems("SELECT DISTINCT norm FROM q0", "qs")},
q1 AS (SELECT q0.*, qs.stem, qs.stem IN {STOP} AS s FROM q0 JOIN qs USING (norm)),
q AS (SELECT qid, term_no, norm, required, "open", code, stem, s AND NOT required AND code IS NULL AND NOT min(s) OVER (PARTITION BY qid) AS stop FROM q1)"""


#: Words of the text themselves: the only way that a term of a plain search matches.
EXACT = "e AS (SELECT qid, term_no, 'stem' AS kind, stem AS target, 1.0 AS weight, 'exact' AS why FROM q)"


def expanded(synonyms: list[tuple[str, str, int]], names: list[tuple[str, str]]) -> str:
    """CTE e (qid, term_no, kind, target, weight, why): every way each item of q may match, over tokens with codes (``coded``), and fix (the repairs)."""
    syn, nam = ", ".join(f"('{k}', '{w}', {n})" for k, w, n in synonyms), ", ".join(f"('{n}', '{c}')" for n, c in names)
    return f"""v AS (SELECT norm, stem, count(*) AS n FROM tok GROUP BY ALL),
sc0 AS (SELECT stem, code, count(*) AS k FROM coded GROUP BY ALL),
sc1 AS (SELECT stem, code, k / sum(k) OVER (PARTITION BY stem) AS part FROM sc0),
sc2 AS (SELECT stem, code, floor(part * 255 + 0.5)::INT AS share, row_number() OVER (PARTITION BY stem ORDER BY floor(part * 255 + 0.5) DESC, substr(code, 2)::INT) AS place FROM sc1 WHERE part >= 0.05),
src AS (SELECT * FROM (VALUES {syn}) x(key, word, weight)), {stems("SELECT key AS norm FROM src UNION SELECT word FROM src", "ss")},
sy0 AS (SELECT a.stem, b.stem AS target, max(weight) AS weight FROM src JOIN ss a ON a.norm = src.key JOIN ss b ON b.norm = src.word WHERE a.stem <> b.stem AND b.stem NOT IN {STOP} GROUP BY ALL),
sy1 AS (SELECT sy0.*, row_number() OVER (PARTITION BY sy0.stem ORDER BY weight DESC, l) AS place FROM sy0 JOIN (SELECT stem AS target, min(norm) AS l FROM tok WHERE norm <> '' GROUP BY stem) USING (target)),
nam AS (SELECT name, code, row_number() OVER (PARTITION BY name ORDER BY code) AS place FROM (VALUES {nam}) x(name, code) WHERE code IN (SELECT target FROM df WHERE kind = 'code') AND name NOT IN (SELECT norm FROM v)),
qd AS (SELECT q.*, df.df, coalesce(df.df, 0) < 5 AS rare, stop OR required AS bound FROM q LEFT JOIN df ON df.kind = 'stem' AND df.target = q.stem),
free AS (SELECT * FROM qd WHERE code IS NULL AND NOT bound AND norm <> ''),
pre AS (SELECT f.qid, f.term_no, v.stem, row_number() OVER (PARTITION BY f.qid, f.term_no ORDER BY n DESC, v.norm) AS place FROM free f JOIN v ON starts_with(v.norm, f.norm) AND v.stem <> f.stem WHERE f."open" AND length(f.norm) >= 2),
way AS (SELECT qid, term_no, 'code' AS kind, code AS target, 1.0 AS weight, 'code' AS why, 0 AS ord FROM qd WHERE code IN (SELECT target FROM df WHERE kind = 'code')
  UNION ALL SELECT qid, term_no, 'stem', stem, 1.0, 'exact', 0 FROM qd WHERE code IS NULL AND df IS NOT NULL AND (bound OR norm <> '')
  UNION ALL SELECT qid, term_no, 'code', sc2.code, 0.75 * sqrt(share / 255), 'code', 1000 + place FROM free JOIN sc2 USING (stem) WHERE stem NOT IN {STOP} AND df IS NOT NULL AND NOT rare AND place <= 6 AND share / 255 >= 0.12
  UNION ALL SELECT qid, term_no, 'code', nam.code, 1.0, 'code', 2000 + place FROM free JOIN nam ON nam.name = free.norm
  UNION ALL SELECT qid, term_no, 'stem', sy1.target, CASE WHEN rare THEN 0.8 ELSE 0.5 END * sy1.weight / 100, 'synonym', 3000 + place FROM free JOIN sy1 USING (stem) WHERE stem NOT IN {STOP} AND place <= 12
  UNION ALL SELECT qid, term_no, 'stem', stem, 0.85, 'prefix', 4000 + place FROM pre WHERE place <= 30),
lost AS (SELECT * FROM free f WHERE length(norm) >= 4 AND NOT EXISTS (SELECT 1 FROM way WHERE way.qid = f.qid AND way.term_no = f.term_no)),
near AS (SELECT l.qid, l.term_no, l.norm AS asked, v.norm, v.stem, v.n, damerau_levenshtein(l.norm, v.norm) AS d, CASE WHEN length(l.norm) >= 8 THEN 2 ELSE 1 END AS most FROM lost l, v WHERE v.norm <> '' AND abs(length(l.norm) - length(v.norm)) <= 2),
fix AS (SELECT *, row_number() OVER (PARTITION BY qid, term_no ORDER BY d, n DESC, norm) AS place FROM near WHERE d <= most),
every_way AS (SELECT * FROM way UNION ALL SELECT qid, term_no, 'stem', stem, CASE WHEN d = 1 THEN 0.8 ELSE 0.6 END, 'typo', 5000 + place FROM fix WHERE place <= 4),
e AS (SELECT qid, term_no, kind, target, weight, why FROM (SELECT *, row_number() OVER (PARTITION BY qid, term_no, kind, target ORDER BY weight DESC, ord) AS k FROM every_way) WHERE k = 1)"""


def scored(rows: list[tuple[int, int, str]], excluded: list[tuple[int, str]], source: str = TURNS) -> str:
    """All CTEs of a search by exact words, up to ``ranked``."""
    return searched(asked(rows), [(q, "stem", w) for q, w in excluded], source)


CODED = "coded AS (SELECT *, 'G' || (length(norm) * 10 + length(stem)) AS code FROM tok)"


def searched(items: str, excluded: list[tuple[int, str, str]], source: str = TURNS, *, ways: str = EXACT, phrases: list[tuple[int, str]] | None = None, scopes: list[tuple[int, str]] | None = None) -> str:
    """All CTEs of a search, up to ``ranked``: ``items`` and ``ways`` give q and e; exclusions are (qid, kind, target), phrases flattened."""
    out = ", ".join(f"({q}, '{k}', '{w}')" for q, k, w in excluded) or "(-1, 'stem', 'none')"
    said = ", ".join(f"({q}, '{p}')" for q, p in phrases or [(-1, "none")])
    only = ", ".join(f"({q}, '{c}')" for q, c in scopes or [(-1, "none")])
    return f"""WITH RECURSIVE {tokens(source)},
{CODED},
post AS (SELECT 'stem' AS kind, stem AS target, passage_id, least(count(*), 255) AS tf FROM tok GROUP BY ALL UNION ALL SELECT 'code', code, passage_id, least(count(*), 255) FROM coded GROUP BY ALL),
df AS (SELECT kind, target, count(*) AS df FROM post GROUP BY ALL),
{items},
{ways},
av AS (SELECT count(*) AS n, sum(dl) / count(*) AS a FROM dl),
per AS (SELECT q.qid, q.term_no, q.stop, post.passage_id, max(e.weight * ln(1 + (av.n - df.df + 0.5) / (df.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.5 + 0.5 * dl.dl / av.a))) AS score, bool_or(e.why = 'exact') AS literal
  FROM q JOIN e USING (qid, term_no) JOIN post ON post.kind = e.kind AND post.target = e.target JOIN df ON df.kind = e.kind AND df.target = e.target JOIN dl USING (passage_id), av GROUP BY ALL),
said AS (SELECT * FROM (VALUES {said}) x(qid, phrase)), only_in AS (SELECT * FROM (VALUES {only}) x(qid, coll)),
nc AS (SELECT qid, greatest(count(*) FILTER (WHERE NOT stop), 1) AS n_content, CASE WHEN qid IN (SELECT qid FROM said) THEN 0 ELSE count(*) FILTER (WHERE NOT stop) END AS contents, coalesce(bit_or(1::BIGINT << term_no) FILTER (WHERE required), 0) AS required_mask FROM q GROUP BY qid),
m AS (SELECT qid, passage_id, coalesce(sum(score) FILTER (WHERE NOT stop), 0) AS content, coalesce(sum(score) FILTER (WHERE stop), 0) AS stops, count(*) FILTER (WHERE NOT stop) AS hit, count(*) FILTER (WHERE NOT stop AND literal) AS own, coalesce(bit_or(1::BIGINT << term_no) FILTER (WHERE NOT stop), 0) AS mask FROM per GROUP BY ALL),
ex AS (SELECT DISTINCT x.qid, post.passage_id FROM (VALUES {out}) x(qid, kind, target) JOIN post USING (kind, target)),
flat AS (SELECT passage_id, ' ' || coalesce(list_aggregate(list_transform(regexp_extract_all(text, {WORD}), lambda w: {norm("w")} || ' '), 'string_agg', ''), '') AS line FROM p),
cand AS (SELECT m.*, p.coll, p.grp, p.num, m.content * pow(m.hit / nc.n_content, 1.5) + 0.3 * m.stops AS raw, m.hit = nc.n_content AS "full", m.own = nc.n_content AS literal FROM m JOIN nc USING (qid) JOIN p USING (passage_id)
  WHERE m.hit > 0 AND m.mask & nc.required_mask = nc.required_mask AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.qid = m.qid AND ex.passage_id = m.passage_id)
  AND (m.qid NOT IN (SELECT qid FROM only_in) OR EXISTS (SELECT 1 FROM only_in o WHERE o.qid = m.qid AND o.coll = p.coll))
  AND NOT EXISTS (SELECT 1 FROM said JOIN flat ON flat.passage_id = m.passage_id WHERE said.qid = m.qid AND NOT contains(flat.line, said.phrase))),
close AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(raw, 9) DESC, passage_id) AS place FROM cand) WHERE place <= 300),
pr AS (SELECT a.qid, a.term_no, a.stem AS s1, b.stem AS s2, count(*) OVER (PARTITION BY a.qid) AS pairs FROM q a JOIN q b ON a.qid = b.qid AND b.term_no = a.term_no + 1 WHERE a.stem IN (SELECT target FROM df WHERE kind = 'stem') AND b.stem IN (SELECT target FROM df WHERE kind = 'stem')),
bonus AS (SELECT c.qid, c.passage_id, 1 + 0.6 * count(DISTINCT pr.term_no) / max(pr.pairs) AS bonus FROM close c JOIN pr USING (qid) JOIN tok x ON x.passage_id = c.passage_id AND x.stem = pr.s1 JOIN tok y ON y.passage_id = c.passage_id AND y.pos = x.pos + 1 AND y.stem = pr.s2 GROUP BY ALL),
singles AS (SELECT cand.qid, cand.coll, cand.grp, cand.passage_id AS "first", 1 AS span, raw * coalesce(bonus, 1) AS score, "full" FROM cand LEFT JOIN bonus USING (qid, passage_id)),
gb AS (SELECT coll, grp, min(passage_id) AS first_id, max(passage_id) + 1 AS end_id FROM p GROUP BY ALL),
spans AS (SELECT DISTINCT c.qid, c.coll, c.grp, s.passage_id AS "first", k.span FROM close c JOIN nc USING (qid) JOIN gb USING (coll, grp), (VALUES (2), (3), (4)) k(span), p s
  WHERE nc.contents >= 2 AND s.coll = c.coll AND s.grp = c.grp AND s.passage_id BETWEEN greatest(c.passage_id - k.span + 1, gb.first_id) AND c.passage_id AND s.passage_id + k.span <= gb.end_id),
rm AS (SELECT s.*, coalesce(a.mask, 0) AS a, coalesce(z.mask, 0) AS z, coalesce((SELECT bit_or(i.mask) FROM m i WHERE i.qid = s.qid AND i.passage_id > s."first" AND i.passage_id < s."first" + s.span - 1), 0) AS mid
  FROM spans s LEFT JOIN m a ON a.qid = s.qid AND a.passage_id = s."first" LEFT JOIN m z ON z.qid = s.qid AND z.passage_id = s."first" + s.span - 1
  WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.qid = s.qid AND ex.passage_id BETWEEN s."first" AND s."first" + s.span - 1)),
runs AS (SELECT qid, coll, grp, "first", span FROM rm WHERE bit_count(a) >= 2 AND bit_count(z) >= 2 AND (a & ~(mid | z)) <> 0 AND (z & ~(mid | a)) <> 0),
rbest AS (SELECT r.qid, r.coll, r.grp, r."first", r.span, per.term_no, per.stop, max(per.score) AS score FROM runs r JOIN per ON per.qid = r.qid AND per.passage_id BETWEEN r."first" AND r."first" + r.span - 1 GROUP BY ALL),
rsum AS (SELECT qid, coll, grp, "first", span, coalesce(sum(score) FILTER (WHERE NOT stop), 0) AS content, coalesce(sum(score) FILTER (WHERE stop), 0) AS stops, count(*) FILTER (WHERE NOT stop) AS hit FROM rbest GROUP BY ALL),
rline AS (SELECT r.qid, r."first", r.span, tok.stem, row_number() OVER (PARTITION BY r.qid, r."first", r.span ORDER BY tok.passage_id, tok.pos) AS k FROM runs r JOIN tok ON tok.passage_id BETWEEN r."first" AND r."first" + r.span - 1),
rbonus AS (SELECT x.qid, x."first", x.span, 1 + 0.6 * count(DISTINCT pr.term_no) / max(pr.pairs) AS bonus FROM rline x JOIN pr ON pr.qid = x.qid AND pr.s1 = x.stem JOIN rline y ON y.qid = x.qid AND y."first" = x."first" AND y.span = x.span AND y.k = x.k + 1 AND y.stem = pr.s2 GROUP BY ALL),
rscored AS (SELECT s.qid, s.coll, s.grp, s."first", s.span, (s.content * pow(s.hit / nc.n_content, 1.5) + 0.3 * s.stops) * pow(0.8, s.span - 1) * coalesce(bonus, 1) AS score, s.hit = nc.n_content AS "full" FROM rsum s JOIN nc USING (qid) LEFT JOIN rbonus USING (qid, "first", span)),
every AS (SELECT * FROM singles UNION ALL SELECT * FROM rscored),
lined AS (SELECT e.*, row_number() OVER (PARTITION BY qid, e.coll, e.grp ORDER BY round(score, 9) DESC, "first", span) AS k, ((1::BIGINT << span) - 1) << ("first" - gb.first_id) AS mask FROM every e JOIN gb USING (coll, grp)),
greedy(qid, coll, grp, k, taken, keep) AS (SELECT DISTINCT qid, coll, grp, 0::BIGINT, 0::BIGINT, false FROM lined
  UNION ALL SELECT l.qid, l.coll, l.grp, l.k, CASE WHEN g.taken & l.mask = 0 THEN g.taken | l.mask ELSE g.taken END, g.taken & l.mask = 0 FROM greedy g JOIN lined l ON l.qid = g.qid AND l.coll = g.coll AND l.grp = g.grp AND l.k = g.k + 1),
kept AS (SELECT l.* FROM lined l JOIN greedy g ON g.qid = l.qid AND g.coll = l.coll AND g.grp = l.grp AND g.k = l.k AND g.keep),
ranked AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, "first") AS rank, row_number() OVER (PARTITION BY qid ORDER BY "full" DESC, "first") AS canonical_rank, coll, grp, "first", span, score, "full" FROM kept)
"""


def cut_boxes(name: str, start: str) -> str:
    """Recursive CTE of boxes split in order: ``start`` gives (key, s, a, b, x, y, w, h), s the running weights from 0; rows of b = a + 1 are done.

    The cut is the running weight nearest to half, of two as near the later, across the longer side.
    """
    return f"""{name}(key, s, a, b, x, y, w, h) AS ({start}
  UNION ALL SELECT key, s, CASE WHEN side = 0 THEN a ELSE k END, CASE WHEN side = 0 THEN k ELSE b END,
    CASE WHEN side = 1 AND w >= h THEN x + w * part ELSE x END, CASE WHEN side = 1 AND w < h THEN y + h * part ELSE y END,
    CASE WHEN w < h THEN w WHEN side = 0 THEN w * part ELSE w * (1 - part) END, CASE WHEN w >= h THEN h WHEN side = 0 THEN h * part ELSE h * (1 - part) END
  FROM (SELECT *, (s[k + 1] - s[a + 1]) / (s[b + 1] - s[a + 1]) AS part FROM (SELECT *, least(CASE WHEN c > a + 1 AND half - s[c] < s[c + 1] - half THEN c - 1 ELSE c END, b - 1) AS k
    FROM (SELECT *, a + 1 + len(list_filter(s[a + 2 : b], lambda z: z < half)) AS c FROM (SELECT *, s[a + 1] + (s[b + 1] - s[a + 1]) / 2 AS half FROM {name} WHERE b - a > 1)))), (VALUES (0), (1)) v(side))"""


def running(weights: str) -> str:
    return f"list_transform(range(len({weights}) + 1), lambda i: coalesce(list_sum({weights}[1 : i]), 0)::DOUBLE)"


def treemap(source: str, aspect: float) -> str:
    """All levels of the ordered treemap, one collection below none other: (level, coll, grp, passage_id, x, y, w, h)."""
    return f"""WITH RECURSIVE {passages(source)},
leaf AS (SELECT passage_id, coll, grp, (strlen(text) + 30)::DOUBLE AS wt FROM p),
gw AS (SELECT coll, grp, sum(wt) AS wt, min(passage_id) AS lead_id FROM leaf GROUP BY ALL),
cw AS (SELECT coll, sum(wt) AS wt, min(lead_id) AS lead_id FROM gw GROUP BY ALL),
c0 AS (SELECT list(coll ORDER BY lead_id) AS ids, list(wt ORDER BY lead_id) AS ws FROM cw),
{cut_boxes("cc", f"SELECT 0, {running('ws')}, 0::BIGINT, len(ws)::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, {aspect}::DOUBLE, 1.0::DOUBLE FROM c0")},
cb AS (SELECT ids[a + 1] AS coll, x, y, w, h FROM cc, c0 WHERE b - a = 1),
g0 AS (SELECT coll, list(grp ORDER BY lead_id) AS ids, list(wt ORDER BY lead_id) AS ws FROM gw GROUP BY coll),
{cut_boxes("gc", f"SELECT coll, {running('ws')}, 0::BIGINT, len(ws)::BIGINT, x, y, w, h FROM g0 JOIN cb USING (coll)")},
gb AS (SELECT g0.coll, ids[a + 1] AS grp, x, y, w, h FROM gc JOIN g0 ON g0.coll = gc.key WHERE b - a = 1),
p0 AS (SELECT coll, grp, min(passage_id) AS lead_id, list(passage_id ORDER BY passage_id) AS ids, list(wt ORDER BY passage_id) AS ws FROM leaf GROUP BY ALL),
{cut_boxes("pc", f"SELECT lead_id, {running('ws')}, 0::BIGINT, len(ws)::BIGINT, x, y, w, h FROM p0 JOIN gb USING (coll, grp)")},
pb AS (SELECT p0.coll, p0.grp, ids[a + 1] AS passage_id, x, y, w, h FROM pc JOIN p0 ON p0.lead_id = pc.key WHERE b - a = 1)
SELECT 'collection' AS level, coll, NULL::BIGINT AS grp, NULL::BIGINT AS passage_id, x, y, w, h FROM cb
UNION ALL SELECT 'group', coll, grp, NULL, x, y, w, h FROM gb UNION ALL SELECT 'passage', coll, grp, passage_id, x, y, w, h FROM pb"""
