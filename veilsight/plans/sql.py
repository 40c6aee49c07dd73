"""Parts of the registered queries' SQL, for DuckDB over the same tables."""

from __future__ import annotations

from veilsight.config import FREQ_EDGES, LONG_SENTENCE_WORDS, MIN_CLAUSE_WORDS
from veilsight.functions.text import ADJECTIVE_ENDS, DETERMINERS, PREPOSITION_TAGS, STOPWORDS

_START, _END = r"^[\s,;:.\-]+", r"[\s,;:.\-]+$"
_CONJ = r"(?i)\s*(?:,\s*)?(?:and|but|while|although|though|whereas|however|because|since|when|after|before)\s+"


def norm(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '{_START}', ''), '{_END}', ''), '\\s+', ' ', 'g')"


def wc(x: str) -> str:
    return f"(CASE WHEN trim({x}) = '' THEN 0 ELSE len(string_split_regex(trim({x}), '\\s+')) END)"


def listed(items) -> str:
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


def draw(seed: int, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def mod1000(key: str) -> str:
    word = lambda i: f"('0x' || substr(md5('42:' || {key}), {8 * i + 1}, 8))::BIGINT"
    return f"((((({word(0)} % 1000) * 296 + {word(1)}) % 1000 * 296 + {word(2)}) % 1000 * 296 + {word(3)}) % 1000)"


def g2(a: str, b: str, c: str, d: str) -> str:
    a, b, c, d = (f"({x})::DOUBLE" for x in (a, b, c, d))
    n = f"({a} + {b} + {c} + {d})"
    parts = []
    for o, r, k in ((a, f"({a} + {b})", f"({a} + {c})"), (b, f"({a} + {b})", f"({b} + {d})"), (c, f"({c} + {d})", f"({a} + {c})"), (d, f"({c} + {d})", f"({b} + {d})")):
        parts.append(f"CASE WHEN {o} > 0 AND {r} * {k} / {n} > 0 THEN 2 * {o} * ln({o} / ({r} * {k} / {n})) ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


def lemma(w: str) -> str:
    return (
        f"CASE WHEN regexp_matches({w}, '[^aeiou]ies$') AND length({w}) > 4 THEN regexp_replace({w}, 'ies$', 'y') WHEN regexp_matches({w}, '(ss|x|z|ch|sh)es$') THEN regexp_replace({w}, 'es$', '') "
        f"WHEN regexp_matches({w}, '[^su]s$') AND length({w}) > 3 THEN regexp_replace({w}, 's$', '') ELSE {w} END"
    )


_PARTS = f"list_filter(list_transform(string_split_regex(s, '{_CONJ}'), lambda x: {norm('x')}), lambda x: x <> '')"

#: cl: uuid, field, clause_pos, clause, label
CLAUSES = f"""WITH src AS (
  SELECT doc_id AS uuid, source AS field, text, CASE WHEN toxic = 1 THEN 'PII' WHEN quality = 1 THEN 'PROFILE' ELSE 'NONE' END AS label
  FROM documents JOIN labels USING (doc_id)),
sen AS (SELECT uuid, field, label, list_filter(list_transform(string_split_regex(text, '(?:\\r?\\n)+|[.!?;]+'), lambda x: {norm("x")}), lambda x: x <> '') AS sents FROM src),
par AS (SELECT uuid, field, label, flatten(list_transform(sents, lambda s: CASE WHEN {wc("s")} > {LONG_SENTENCE_WORDS} AND len({_PARTS}) > 1 THEN {_PARTS} ELSE [s] END)) AS p FROM sen),
ded AS (SELECT uuid, field, label, list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: lower(y)), lower(x)) = i) AS c FROM par),
kep AS (SELECT uuid, field, label, CASE WHEN len(list_filter(c, lambda x: {wc("x")} >= {MIN_CLAUSE_WORDS})) > 0 THEN list_filter(c, lambda x: {wc("x")} >= {MIN_CLAUSE_WORDS}) ELSE c END AS c FROM ded),
cl AS (SELECT uuid, field, label, unnest(c) AS clause, generate_subscripts(c, 1) - 1 AS clause_pos FROM kep)
"""

_ADJ = "(length(token) > 4 AND (" + " OR ".join(f"ends_with(token, '{e}')" for e in ADJECTIVE_ENDS) + "))"
_NOUN = f"NOT token IN {listed(DETERMINERS)} AND NOT token IN {listed(PREPOSITION_TAGS)} AND NOT token IN {listed(STOPWORDS)} AND NOT {_ADJ}"
#: tok: label, token
TOKENS = CLAUSES + f""", wds AS (SELECT label, unnest(regexp_extract_all(lower(clause), '[a-z]+')) AS token FROM cl WHERE label IN ('PROFILE', 'NONE')),
tok AS (SELECT * FROM wds WHERE length(token) >= 3 AND {_NOUN})
"""
#: cells: token, freq_profile, freq_none, a, b, c, d
CELLS = TOKENS + """, cnt AS (SELECT token, count(*) FILTER (label = 'PROFILE') AS fp, count(*) FILTER (label = 'NONE') AS fn FROM tok GROUP BY token),
tot AS (SELECT count(*) FILTER (label = 'PROFILE') AS np, count(*) FILTER (label = 'NONE') AS nn FROM cl),
cells AS (SELECT token, fp AS freq_profile, fn AS freq_none, CAST(fp AS BIGINT) AS a, CAST(np - fp AS BIGINT) AS b, CAST(fn AS BIGINT) AS c, CAST(nn - fn AS BIGINT) AS d FROM cnt, tot WHERE fp > 0)
"""
FISHER = CELLS + """, fx AS (SELECT DISTINCT a, b, c, d FROM cells),
fp AS (SELECT a, b, c, d, CASE WHEN b < 0 OR d < 0 THEN NULL ELSE least(1.0, list_sum(list_transform(range(a, least(a + b, a + c) + 1), lambda x:
  exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1)
      - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1))))) END AS p FROM fx),
fisher AS (SELECT cells.*, p FROM cells JOIN fp USING (a, b, c, d))
"""
BH = FISHER + """, bh0 AS (SELECT *, p * count(p) OVER () / count(p) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM fisher),
bh AS (SELECT token, freq_profile, freq_none, p, CASE WHEN p IS NOT NULL THEN least(1.0, min(v) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS q, CAST(count(*) OVER () AS BIGINT) AS n_tested FROM bh0)
"""

_TAG = f"CASE WHEN w IN {listed(DETERMINERS)} THEN 'D' WHEN w IN {listed(PREPOSITION_TAGS)} THEN 'I' WHEN w IN {listed(STOPWORDS)} THEN 'O' WHEN {_ADJ.replace('token', 'w')} THEN 'J' ELSE 'N' END"
#: found: uuid, field, clause_pos, clause, token, phrase
PHRASES = TOKENS + f""", voc AS (SELECT token FROM tok WHERE label = 'PROFILE' GROUP BY token HAVING count(*) >= 3),
np0 AS (SELECT uuid, field, clause_pos, clause, regexp_extract_all(lower(clause), '[a-z]+') AS ws FROM cl WHERE label = 'PROFILE'),
np1 AS (SELECT *, regexp_extract_all(array_to_string(list_transform(ws, lambda w: ({_TAG}) || ':' || w), ' ') || ' ', '(?:D:\\S+ )?(?:J:\\S+ )*(?:N:\\S+ )+') AS raw FROM np0),
np2 AS (SELECT *, list_transform(raw, lambda p: trim(regexp_replace(p, '[DIJN]:', '', 'g'))) AS nps FROM np1),
ex AS (SELECT uuid, field, clause_pos, clause, nps, unnest(list_distinct(ws)) AS token FROM np2),
hit AS (SELECT ex.*, list_filter(nps, lambda p: list_contains(string_split(p, ' '), token)) AS has FROM ex JOIN voc USING (token)),
lng AS (SELECT *, CASE WHEN len(has) = 0 THEN token ELSE list_filter(has, lambda p: length(p) = list_max(list_transform(has, lambda r: length(r))))[1] END AS np FROM hit),
found AS (SELECT uuid, field, clause_pos, clause, token, array_to_string(list_transform(list_filter(string_split(np, ' '), lambda w: w NOT IN {listed(DETERMINERS)}), lambda w: {lemma("w")}), ' ') AS phrase FROM lng)
"""


def basket(term: str) -> str:
    """b: lines; det: orders with their set t."""
    return f"""WITH b AS (SELECT o_custkey AS uuid, o_orderpriority AS field, l_orderkey AS clause_pos, {term} AS term,
  CASE l_returnflag WHEN 'R' THEN 'PII' WHEN 'A' THEN 'PROFILE' ELSE 'NONE' END AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
det AS (SELECT uuid, field, clause_pos, list_sort(list_distinct(list(term))) AS t FROM b GROUP BY uuid, field, clause_pos)
"""


_UNIT = {"clause": "uuid, field, clause_pos", "field": "uuid, field", "uuid": "uuid"}
SETS = ", sets AS (" + " UNION ALL ".join(f"SELECT '{u}' AS unit, list_sort(list_distinct(list(term))) AS t FROM b GROUP BY {k}" for u, k in _UNIT.items()) + ")\n"


def set_probability(unit: str) -> str:
    return f", s AS (SELECT list_sort(list_distinct(list(term))) AS t FROM b GROUP BY {_UNIT[unit]}) SELECT array_to_string(t, '|') AS terms, CAST(len(t) AS INTEGER) AS set_size, CAST(count(*) AS BIGINT) AS cnt, round(count(*)::DOUBLE / (SELECT count(*) FROM s), 8) AS probability FROM s GROUP BY t"


def set_records(grain: str) -> str:
    return f", s AS (SELECT uuid, list_sort(list_distinct(list(term))) AS t FROM b GROUP BY {_UNIT[grain]}) SELECT array_to_string(t, '|') AS terms, CAST(len(t) AS INTEGER) AS set_size, CAST(count(DISTINCT uuid) AS BIGINT) AS record_count, round(count(DISTINCT uuid)::DOUBLE / (SELECT count(DISTINCT uuid) FROM b), 8) AS probability FROM s GROUP BY t"


_CO = """, e AS (SELECT row_number() OVER () AS sid, unit, t FROM sets), x AS (SELECT sid, unit, unnest(t) AS term FROM e),
co AS (SELECT l.unit, l.term AS a, r.term AS b, count(*) AS co_count FROM x l JOIN x r ON l.sid = r.sid AND l.term < r.term GROUP BY ALL HAVING count(*) >= 2),
tc AS (SELECT unit, term, count(*) AS c FROM x GROUP BY ALL), nu AS (SELECT unit, count(*) AS n FROM sets GROUP BY unit),
pairs AS (SELECT co.unit, a, co.b, CAST(co_count AS BIGINT) AS co_count, CAST(ta.c AS BIGINT) AS count_a, CAST(tb.c AS BIGINT) AS count_b, CAST(n AS BIGINT) AS n
  FROM co JOIN tc ta ON ta.unit = co.unit AND ta.term = a JOIN tc tb ON tb.unit = co.unit AND tb.term = co.b JOIN nu ON nu.unit = co.unit)
"""
PAIRS = basket("p_brand") + SETS + _CO
#: The same at clause and text grain, a text being the orders of a year and status.
TEXT_PAIRS = basket("p_brand") + """, y AS (SELECT o_orderkey AS clause_pos, year(o_orderdate) || o_orderstatus AS text FROM orders),
sets AS (SELECT 'clause' AS unit, list_sort(list_distinct(list(term))) AS t FROM b GROUP BY uuid, field, clause_pos
  UNION ALL SELECT 'text', list_sort(list_distinct(list(term))) FROM b JOIN y USING (clause_pos) GROUP BY uuid, field, text)
""" + _CO
#: erfc(x) to some 1e-13: a series of positive terms; beyond 6 it is below 1e-16.
_ERFC = "CASE WHEN x > 6 THEN 0 WHEN x <= 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 200), lambda n: exp((2 * n + 1) * ln(x) + n * ln(4.0::DOUBLE) + lgamma(n + 1) - lgamma(2 * n + 2)))) END"
#: fdr: pairs with g2, positive, pmi and q of their unit
FDR = f""", g AS (SELECT *, {g2('co_count', 'count_a - co_count', 'count_b - co_count', 'n - count_a - count_b + co_count')} AS g2, co_count > count_a::DOUBLE * count_b / n AS positive FROM pairs),
tl AS (SELECT *, {_ERFC} AS tail FROM (SELECT *, sqrt(greatest(g2, 0) / 2) AS x FROM g)), pv AS (SELECT *, CASE WHEN positive THEN tail / 2 ELSE 1 - tail / 2 END AS p FROM tl),
qv AS (SELECT *, p * count(*) OVER (PARTITION BY unit) / count(*) OVER (PARTITION BY unit ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM pv),
fdr AS (SELECT *, least(1.0::DOUBLE, min(v) OVER (PARTITION BY unit ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM qv)
SELECT unit, a AS phrase_a, b AS phrase_b, co_count, count_a, count_b, round(co_count::DOUBLE / n, 8) AS probability, round(log2(co_count::DOUBLE * n / (count_a::DOUBLE * count_b)), 4) AS pmi,
  round(g2, 4) AS g2, round(q, 6) AS q_value FROM fdr WHERE positive AND q <= 0.05
"""
#: items of any size: every subset of every distinct set, grown by its next term.  For a WITH RECURSIVE.
ITEMSETS = """, s AS (SELECT list_sort(list_distinct(list(term))) AS t FROM b GROUP BY uuid, field), ws AS (SELECT row_number() OVER (ORDER BY t) AS sid, t, count(*) AS cnt FROM s GROUP BY t),
x AS (SELECT sid, cnt, unnest(t) AS i FROM ws),
sub AS (SELECT sid, cnt, i AS combo, i AS last, 1 AS size FROM x UNION ALL SELECT sub.sid, sub.cnt, combo || '|' || i, i, size + 1 FROM sub JOIN x ON sub.sid = x.sid AND i > last),
items AS (SELECT combo, size, CAST(sum(cnt) AS BIGINT) AS support_count FROM sub GROUP BY combo, size HAVING sum(cnt) >= 5)
"""
#: spans: text, label, qi, qi_json, size, freq; rec: qi, record_count
SPANS = basket("p_brand") + """, o AS (SELECT clause_pos, uuid, max(label) AS label, CASE WHEN clause_pos % 4 = 0 THEN 'customer ' || uuid ELSE 'order ' || clause_pos END AS text FROM b GROUP BY clause_pos, uuid),
j AS (SELECT text, label, t, '["' || array_to_string(t, '", "') || '"]' AS js FROM o JOIN det USING (clause_pos, uuid)),
spans AS (SELECT text, max(label) AS label, arg_max(t, js) AS qi, max(js) AS qi_json, CAST(len(arg_max(t, js)) AS INTEGER) AS size, CAST(count(*) AS BIGINT) AS freq FROM j GROUP BY text),
rec AS (SELECT t AS qi, CAST(count(DISTINCT uuid) AS BIGINT) AS record_count FROM det GROUP BY t)
"""
#: scored: spans with all scores
SCORES = SPANS + """, N AS (SELECT count(DISTINCT uuid) AS n FROM b), df AS (SELECT term, CAST(count(DISTINCT uuid) AS BIGINT) AS df FROM b GROUP BY term),
fl AS (SELECT DISTINCT qi FROM spans), bt AS (SELECT qi, sum(log10((SELECT n FROM N)::DOUBLE) - log10(df::DOUBLE)) AS bits, min(df) AS mn, min((df, term)) AS rare FROM (SELECT qi, unnest(qi) AS term FROM fl) JOIN df USING (term) GROUP BY qi),
sc0 AS (SELECT spans.*, label AS provenance, CAST(CASE WHEN label = 'PROFILE' AND coalesce(record_count, 0) = 0 THEN 1 ELSE coalesce(record_count, 0) END AS BIGINT) AS support, CASE WHEN label = 'NONE' THEN 0 ELSE bits END AS raw, mn, rare, log10(n::DOUBLE) AS logn, n
  FROM spans LEFT JOIN rec USING (qi) LEFT JOIN bt USING (qi), N WHERE label = 'NONE' OR size > 0),
sc1 AS (SELECT *, CASE WHEN label = 'NONE' THEN 0 ELSE round(log10(n::DOUBLE / greatest(1, support)), 6) END AS r0 FROM sc0),
sc2 AS (SELECT *, round(raw, 6) AS b0, round(least(logn, raw), 6) AS bc0, round(CASE WHEN label = 'NONE' THEN 0 WHEN support >= 2 THEN r0 ELSE greatest(logn, raw) END, 6) AS c0 FROM sc1),
top AS (SELECT coalesce(max(b0) FILTER (label = 'PROFILE'), max(logn)) AS tb, coalesce(max(c0) FILTER (label = 'PROFILE'), max(logn)) AS tc FROM sc2),
scored AS (SELECT text, label, provenance, qi, qi_json, size, freq, support, rare, CASE WHEN label = 'NONE' THEN 0::BIGINT ELSE mn END AS min_constituent_df,
  CASE WHEN label = 'PII' THEN round(logn, 6) ELSE r0 END AS y_risk, CASE WHEN label = 'PII' THEN round(tb, 6) ELSE b0 END AS y_bits,
  CASE WHEN label = 'PII' THEN round(logn, 6) ELSE bc0 END AS y_bits_capped, CASE WHEN label = 'PII' THEN round(tc, 6) ELSE c0 END AS y_combined FROM sc2, top)
"""
SPLIT_KEY = "CASE WHEN size > 0 THEN rare[2] ELSE 'EMPTY:' || substr(md5(text), 1, 12) END"
#: lds: text, y_risk, w
LDS = """, mm AS (SELECT min(y_risk)::DOUBLE AS lo, max(y_risk)::DOUBLE AS hi FROM scored), bn AS (SELECT text, y_risk, CAST(least(floor((y_risk - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin FROM scored, mm),
ct AS (SELECT bin, count(*) AS n FROM bn GROUP BY bin), ks AS (SELECT sum(exp(-(k * k) / 8.0)) AS total FROM range(-6, 7) r(k)),
dn AS (SELECT a.bin, a.n, sum(c.n * exp(-((c.bin - a.bin) ** 2) / 8.0) / total) AS d FROM ct a JOIN ct c ON abs(c.bin - a.bin) <= 6, ks GROUP BY a.bin, a.n),
w1 AS (SELECT bin, n, (1 / d) * sum(n) OVER () / (sum(n / d) OVER ()) AS w FROM dn), w2 AS (SELECT bin, n, greatest(least(w, 10), 0.1) AS w FROM w1),
w3 AS (SELECT bin, w * sum(n) OVER () / (sum(n * w) OVER ()) AS w FROM w2), lds AS (SELECT text, y_risk, w FROM bn JOIN w3 USING (bin))
"""
#: p: y_true, y_pred, support of test rows
PREDICTIONS = """WITH e AS (SELECT event_id, round(log10(1000.0::DOUBLE / (1 + (event_id * 7919) % 1000)), 6) AS y_true, 1 + (event_id * 7919) % 1000 AS support FROM events),
p AS (SELECT y_true, round(y_true + ((event_id * 31) % 17) / 17.0::DOUBLE - 0.5, 2) AS y_pred, support FROM e WHERE event_id % 5 = 0)
"""
STRATA = """, mx AS (SELECT max(y_true) AS top FROM p),
st AS (SELECT 'NONE(y=0)' AS stratum, y_true, y_pred FROM p WHERE abs(y_true) <= 1e-8
  UNION ALL SELECT CASE WHEN y_true < 1 THEN '(0,1)' WHEN floor(y_true) + 1 >= top THEN '[' || floor(y_true)::INT || ',' || printf('%.2f', top) || ')' ELSE '[' || floor(y_true)::INT || ',' || (floor(y_true)::INT + 1) || ')' END, y_true, y_pred
    FROM p, mx WHERE y_true > 0 AND (y_true < 1 OR y_true < top)
  UNION ALL SELECT 'UNIQUE(y=' || printf('%.2f', top) || ')', y_true, y_pred FROM p, mx WHERE abs(y_true - top) <= 1e-8 + 1e-5 * abs(top)),
per AS (SELECT stratum, CAST(count(*) AS BIGINT) AS n, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(y_true) AS mean_true, avg(y_pred) AS mean_pred FROM st GROUP BY stratum)
"""
RANKS = """, r AS (SELECT y_true, rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2.0 AS ry FROM p)
"""
FREQS = "WITH f AS (SELECT CAST(l_partkey AS VARCHAR) AS phrase, count(*) AS freq FROM lineitem GROUP BY 1) "
FREQ_BINS = "SELECT * FROM (VALUES " + ", ".join(f"({a}, {b})" for a, b in zip(FREQ_EDGES[:-1], FREQ_EDGES[1:], strict=True)) + ") v(lo, hi)"

