"""SQL that says the same as the queries, where SQL can on whole tables in fair time."""

from __future__ import annotations

from corpusloom.llm import truncation as X

_WS = r"[\s\x0B\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


_SIDES = f"side AS (SELECT c.clause_id, a.split AS side FROM clauses c JOIN split_aliases a ON a.alias = lower({_strip('c.split')}))"

_P1 = f"""WITH {_SIDES}, nm AS (SELECT label_name, regexp_replace(lower({_strip('label_name')}), '{_WS}+', ' ', 'g') AS plain FROM label_names),
 cat AS (SELECT s.side, CASE WHEN c.label IS NULL THEN (SELECT min(label_name) FROM nm WHERE nm.plain = regexp_replace(lower({_strip('c.label_name')}), '{_WS}+', ' ', 'g'))
   ELSE (SELECT l.label_name FROM label_names l WHERE l.label = c.label) END AS category FROM clauses c JOIN side s USING (clause_id)),
 n AS (SELECT side, count(*) // 5 AS n FROM cat WHERE category IS NOT NULL GROUP BY 1), k AS (SELECT side, category, count(*) AS k FROM cat GROUP BY 1, 2),
 need AS (SELECT t.*, greatest(min_rows, (target_permille * coalesce(n.n, 0) + 999) // 1000) AS need, coalesce(k.k, 0) AS k FROM sample_targets t LEFT JOIN n ON n.side = t.split LEFT JOIN k ON k.side = t.split AND k.category = t.label_name)"""

_SHINGLES = f"""w AS (SELECT clause_id AS id, string_split(trim(regexp_replace(lower(text), '{_WS}+', ' ', 'g')), ' ') AS w FROM clauses WHERE text IS NOT NULL),
 s AS (SELECT DISTINCT id, sh FROM (SELECT id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM w WHERE len(w) >= 5)),
 n AS (SELECT id, count(*) AS n FROM s GROUP BY 1), o AS (SELECT x.id AS a, y.id AS b, count(*) AS o FROM s x JOIN s y ON x.sh = y.sh AND x.id < y.id GROUP BY 1, 2),
 near AS (SELECT a, b FROM o JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE o * 5 >= (p.n + q.n - o) * 4)"""

_PIECES = r"list_sort(list_filter(list_transform(string_split_regex(text, '[\n|]'), lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]+', '', 'g')), lambda x: x <> ''))"
_P6 = f"WITH r AS (SELECT record_id, {_PIECES} AS p FROM raw_records WHERE text IS NOT NULL), g AS (SELECT p, min(record_id) AS keep, count(*) AS copies FROM r WHERE len(p) > 0 GROUP BY p)"

_P7 = f"""WITH RECURSIVE e AS (SELECT lower({_strip('doc_id_a')}) AS a, lower({_strip('doc_id_b')}) AS b FROM match_pairs WHERE is_match), l AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
 low(a, m) AS (SELECT a, min(b) FROM l GROUP BY 1), reach(id, r) AS (SELECT DISTINCT a, a FROM l WHERE NOT EXISTS (SELECT 1 FROM low WHERE low.a = l.a AND low.m < l.a) UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.id)"""

_P5 = """WITH win AS (SELECT doc_id, i, substr(text, i::INT + 1, 200) AS w FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS i FROM documents WHERE length(text) >= 200)),
 hit AS (SELECT doc_id, i FROM win SEMI JOIN (SELECT w FROM win GROUP BY w HAVING min(doc_id) < max(doc_id)) x USING (w)),
 runs AS (SELECT doc_id, i, sum(CASE WHEN i <= p + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM hit)),
 spans AS (SELECT doc_id, min(i)::INT AS span_start, (max(i) + 200)::INT AS span_end FROM runs GROUP BY doc_id, run)"""

_Q = lambda x: x.replace("'", "''")
_FEED = f"lower({_strip('source')})"
_HAS = lambda p: f"regexp_matches(e, '{_Q(p)}')"
_AROUND = "OVER (PARTITION BY feed, unit ORDER BY length RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING)"
_TAIL = lambda k, e: f"CASE WHEN {k} > {e} THEN exp(-({k} * ln({k} / {e}) - {k} + {e})) ELSE 1.0::DOUBLE END"
_BH = lambda t: f"(SELECT coalesce(max(p), -1) FROM (SELECT p, sum(count(*)) OVER (ORDER BY p) AS rank FROM {t} WHERE p <= 0.01::DOUBLE GROUP BY p) WHERE p <= 0.01::DOUBLE * rank / (SELECT count(*) FROM {t}))"
_P10 = f"""WITH raw AS (SELECT doc_id, {_FEED} AS feed, text, coalesce(length(text), 0) AS chars, coalesce(strlen(text), 0) AS bytes, rtrim(regexp_replace(right(rtrim(text, '{X.BLANKS}'), {X.REACH}), '{_Q(X.FOOT)}', ''), '{X.BLANKS}') AS e FROM documents),
 st AS (SELECT doc_id, feed, coalesce(feed, '') AS f, text, chars, bytes, CASE WHEN e IS NULL OR e = '' THEN 0 WHEN {_HAS(X.MARK)} OR {_HAS(X.BROKEN)} THEN 2 WHEN {_HAS(X.DOUBTFUL)} THEN 1 WHEN {_HAS(X.STOP)} OR {_HAS(X.LINE)} THEN 0 ELSE 2 END AS state FROM raw),
 one AS (SELECT f AS feed, chars, bytes, max(state) AS state FROM st WHERE chars > 0 GROUP BY f, text, chars, bytes),
 lens AS (SELECT feed, unit, length, count(*) AS ended FROM (SELECT feed, 'chars' AS unit, chars AS length FROM one UNION ALL SELECT feed, 'bytes', bytes FROM one) GROUP BY 1, 2, 3),
 win AS (SELECT *, greatest(length - 25, 1) AS lo, sum(ended) {_AROUND} AS near, sum(ended * length) {_AROUND} AS mass, sum(ended) OVER (PARTITION BY feed, unit ORDER BY length RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk,
  coalesce(sum(ended) OVER (PARTITION BY feed, unit ORDER BY length RANGE BETWEEN 26 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS beyond FROM lens),
 expo AS (SELECT *, (mass + (1 - lo) * near + beyond * (length + 25 - lo + 1) - at_risk)::DOUBLE AS exposed FROM win),
 expd AS (SELECT feed, unit, length, ended, at_risk, at_risk::DOUBLE * CASE WHEN exposed > 0 THEN least((near - ended + 0.5::DOUBLE) / exposed, 1) ELSE 1 END AS expected FROM expo),
 hz AS (SELECT *, {_TAIL('ended::DOUBLE', 'expected')} AS p FROM expd), sig AS (SELECT * FROM hz WHERE p <= {_BH('hz')}),
 off AS (SELECT feed, count(*) AS texts, count(*) FILTER (state = 2) AS opened, count(*) * 0.002::DOUBLE AS expected FROM one o WHERE NOT EXISTS (SELECT 1 FROM sig WHERE sig.feed = o.feed AND ((unit = 'chars' AND length = chars) OR (unit = 'bytes' AND length = bytes))) GROUP BY 1),
 tr AS (SELECT *, {_TAIL('opened::DOUBLE', 'expected')} AS p FROM off), own AS (SELECT *, p <= {_BH('tr')} AS sure FROM tr), rest AS (SELECT sum(opened)::DOUBLE AS k, sum(expected) AS e FROM own WHERE NOT sure),
 bad AS (SELECT feed FROM own, rest WHERE sure OR coalesce({_TAIL('k', 'e')} <= 0.01::DOUBLE, false)),
 flag AS (SELECT *, EXISTS (SELECT 1 FROM sig WHERE sig.feed = st.f AND ((unit = 'chars' AND length = chars) OR (unit = 'bytes' AND length = bytes))) AS at_limit FROM st),
 cut AS (SELECT *, CASE WHEN at_limit THEN state > 0 ELSE state = 2 AND f IN (SELECT feed FROM bad) END AS cut FROM flag)"""

SQL = {
    "p10_found": f"{_P10} SELECT doc_id FROM cut WHERE cut",
    "p10_hazards": f"{_P10} SELECT feed, unit, length::INT AS length, ended, at_risk::BIGINT AS at_risk FROM sig",
    "p10_report": f"{_P10} SELECT feed AS source, count(*) AS docs, count(*) FILTER (cut) AS cut, count(*) FILTER (cut AND at_limit) AS cut_at_limit, round(count(*) FILTER (cut)::DOUBLE / count(*), 6) AS cut_share FROM cut GROUP BY feed",
    "p1_found": f"{_P1} SELECT split, label_name FROM need WHERE k < need",
    "p1_report": f"{_P1} SELECT split, label_name, target_permille, min_rows, need::BIGINT AS need, k::BIGINT AS available, least(need, k)::BIGINT AS drawn, (need - least(need, k))::BIGINT AS gap FROM need",
    "p2_found": f"WITH {_SIDES}, {_SHINGLES} SELECT a AS clause_id_a, b AS clause_id_b FROM near JOIN side x ON x.clause_id = a JOIN side y ON y.clause_id = b WHERE (x.side = 'train') <> (y.side = 'train')",
    "p2_report": f"""WITH {_SIDES}, {_SHINGLES}, pr AS (SELECT a AS e, b AS t FROM near UNION ALL SELECT b, a FROM near)
 SELECT x.side AS split, lower({_strip('c.source')}) AS source, count(*) AS pairs, count(DISTINCT e) AS clauses FROM pr JOIN side x ON x.clause_id = e JOIN side y ON y.clause_id = t JOIN clauses c ON c.clause_id = e
 WHERE x.side <> 'train' AND y.side = 'train' GROUP BY 1, 2""",
    "p3_found": f"""WITH RECURSIVE {_SHINGLES}, l AS (SELECT a, b FROM near UNION SELECT b, a FROM near), reach(id, r) AS (SELECT a, a FROM l UNION SELECT reach.id, l.b FROM reach JOIN l ON l.a = reach.r)
 SELECT id AS clause_id, min(r) AS group_id FROM reach GROUP BY id""",
    "p4_found": f"WITH {_SIDES} SELECT dup_cluster FROM clauses JOIN side USING (clause_id) WHERE dup_cluster >= 0 GROUP BY 1 HAVING count(DISTINCT side) > 1",
    "p4_whole": "SELECT dup_cluster::BIGINT AS dup_cluster, count(*) AS rows, 1::BIGINT AS splits FROM clauses WHERE dup_cluster >= 0 GROUP BY 1",
    "p9_caps": f"SELECT {_FEED} AS source, count(*) AS docs, 0::BIGINT AS over FROM documents WHERE {_FEED} IN (SELECT {_FEED} FROM mix_targets) GROUP BY 1",
    "p5_found": f"{_P5} SELECT doc_id, span_start, span_end FROM spans",
    "p5_shares": f"""{_P5} SELECT d.doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(s, 0)::BIGINT AS shared_chars, round(coalesce(coalesce(s, 0)::DOUBLE / nullif(length(text), 0), 0), 6) AS shared_share
 FROM documents d LEFT JOIN (SELECT doc_id, sum(span_end - span_start) AS s FROM spans GROUP BY 1) USING (doc_id)""",
    "p6_found": f"{_P6} SELECT keep AS keep_id, record_id AS copy_id FROM r JOIN g USING (p) WHERE record_id <> keep",
    "p6_records": f"{_P6} SELECT keep AS record_id, copies FROM g UNION ALL SELECT record_id, 1 FROM raw_records WHERE record_id NOT IN (SELECT record_id FROM r WHERE len(p) > 0)",
    "p7_found": f"{_P7} SELECT id AS doc_id, min(r) AS dup_cluster FROM reach GROUP BY id",
}
