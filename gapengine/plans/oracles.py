"""The registered queries in ANSI SQL, as run by the correctness check."""

from __future__ import annotations

from gapengine import fixed
from gapengine.plans import explained, maintained, persisted, records


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def norm(x: str) -> str:
    """TXT-1 without lookaround: hyphens before digits are set aside first."""
    spaced = f"regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    kept = f"regexp_replace(replace(strip_accents({spaced}), '_', ' '), '-([0-9])', chr(1) || '\\1', 'g')"
    return f"lower(replace(replace({kept}, '-', ' '), chr(1), '-'))"


def is_token(t: str) -> str:
    return f"((length({t}) >= 2 OR regexp_matches({t}, '^[0-9]$')) AND {t} NOT IN ({_quoted(fixed.STOPWORDS)}))"


def toks(x: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex({norm(x)}, '[^a-z0-9%.]+'), lambda t: trim(t, '.')), "
        f"lambda t: {is_token('t')})"
    )


def _family(g: str) -> str:
    cases = " ".join(f"WHEN {g} IN ({_quoted(m)}) THEN '{k}'" for k, (_, m) in fixed.GAP_FAMILIES.items())
    return f"CASE {cases} END"


def _label(k: str) -> str:
    return "CASE " + " ".join(f"WHEN {k} = '{key}' THEN '{label}'" for key, (label, _) in fixed.GAP_FAMILIES.items()) + " END"


LINES = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_shipdate,
         CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS line_id,
         r_name AS feature, CAST(round(l_discount * 100) AS INTEGER) AS d, CAST(round(l_tax * 100) AS INTEGER) AS t
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey),
inc AS (SELECT *, row_number() OVER () AS rid, (d = 0 OR t = 0) AS low FROM lines WHERE l_returnflag = 'R'),
tests AS (SELECT *, (d = 0 OR t = 0) AS low FROM lines WHERE l_returnflag <> 'R')
"""

VERDICTS = LINES + """,
pairs AS (
  SELECT i.rid, i.d, i.t, i.low, k.feature = i.feature AS fm, k.line_id AS test_id, k.d AS td, k.t AS tt,
         (i.d = k.d)::INT AS md, (i.t = k.t)::INT AS mt, (i.low AND k.low)::INT AS ml,
         round(0.5 * CASE WHEN k.feature = i.feature THEN 1.3 ELSE 1.0 END * 1.15
               * CASE WHEN i.low AND k.low THEN 1.1 ELSE 1.0 END, 4) AS score
  FROM inc i JOIN tests k USING (l_partkey)),
scored AS (
  SELECT *, CASE WHEN low THEN ((md + mt) / 2.0 + ml) / 2.0 ELSE (md + mt) / 2.0 END AS strength FROM pairs),
tops AS (SELECT rid, max(score) AS retrieval_top, count(*) AS n FROM scored GROUP BY rid),
judged AS (
  SELECT rid, min(td) AS dlo, max(td) AS dhi, min(tt) AS tlo, max(tt) AS thi,
         max((td = d)::INT) AS d_same, max((tt = t)::INT) AS t_same, max(ml) AS low_seen
  FROM scored WHERE fm GROUP BY rid),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY strength DESC, score DESC, test_id) AS p
                 FROM scored WHERE fm) WHERE p = 1),
facts AS (
  SELECT i.*, b.test_id AS best_test_id, b.strength, b.md, b.mt, b.ml, j.* EXCLUDE (rid), x.retrieval_top,
         (SELECT count(*) FROM tests) AS corpus_size,
         CASE WHEN b.rid IS NULL THEN 'NOT_COVERED'
              WHEN b.md + b.mt = 2 AND (NOT i.low OR b.ml = 1) THEN 'COVERED' ELSE 'PARTIAL' END AS coverage
  FROM inc i LEFT JOIN best b USING (rid) LEFT JOIN judged j USING (rid) LEFT JOIN tops x USING (rid)),
gaps AS (
  SELECT *, CASE
    WHEN coverage = 'COVERED' THEN 'WEAK_ASSERTION'
    WHEN best_test_id IS NOT NULL AND (
      (md = 0 AND (d > dhi OR d < dlo OR (d IN (0, 100) AND d_same = 0))) OR
      (mt = 0 AND (t > thi OR t < tlo OR (t IN (0, 100) AND t_same = 0)))) THEN 'BOUNDARY_CONDITION'
    WHEN low AND coalesce(ml, 0) = 0 THEN 'BOUNDARY_CONDITION'
    WHEN best_test_id IS NULL THEN 'MISSING_TEST' ELSE 'TEST_DATA_MISMATCH' END AS gap_type
  FROM facts),
verdicts AS (
  SELECT *, """ + _family("gap_type") + """ AS family_key,
    CASE coverage WHEN 'COVERED' THEN 'POTENTIALLY_INEFFECTIVE' WHEN 'PARTIAL' THEN 'INSUFFICIENT_COVERAGE'
         ELSE 'NO_COVERAGE' END AS effectiveness,
    round(0.30 * least(1.0, coalesce(retrieval_top, 0) / 0.8)
        + 0.30 * CASE WHEN retrieval_top IS NULL THEN 0 ELSE 2 / 3.0 * 0.6 + CASE WHEN low THEN 1 ELSE 0 END / 3.0 * 0.4 END
        + 0.25 * CASE WHEN best_test_id IS NULL THEN 0.15 WHEN coverage = 'COVERED' THEN 1.0
                      WHEN md + mt < 2 THEN 0.9 ELSE 0.7 END
        + 0.15 * least(1.0, corpus_size / 200.0), 3) AS confidence
  FROM gaps)
"""

OBSERVED = VERDICTS + """,
obs AS (
  SELECT line_id AS incident_id, l_shipdate AS arrival, gap_type, family_key, feature, coverage, low, l_partkey, l_suppkey,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM'
         ELSE 'LOW' END AS severity
  FROM verdicts JOIN orders ON l_orderkey = o_orderkey)
"""

RECURRENCE = OBSERVED + """,
firsts AS (SELECT family_key, incident_id, min(arrival) AS arrival FROM obs GROUP BY ALL),
asks AS (SELECT incident_id, min(arrival) AS arrival, bool_or(low) AS low FROM obs GROUP BY incident_id),
boundary AS (SELECT * FROM firsts WHERE family_key = 'BOUNDARY_CONDITIONS'),
marks AS (
  SELECT incident_id, arrival, 1 AS g FROM boundary UNION ALL
  SELECT incident_id, arrival, 0 AS g FROM asks WHERE low),
running AS (
  SELECT *, sum(g) OVER (ORDER BY arrival, incident_id RANGE UNBOUNDED PRECEDING)
          - sum(g) OVER (PARTITION BY arrival, incident_id) AS before FROM marks),
recurrence AS (
  SELECT a.incident_id, coalesce(CAST(max(r.before) AS BIGINT), 0) AS similar_incidents
  FROM asks a LEFT JOIN (SELECT * FROM running WHERE g = 0) r USING (incident_id) GROUP BY a.incident_id)
"""


def _points(c: str) -> str:
    return f"CASE {c} WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 0 ELSE 1 END"


def _recurrence_points(n: str) -> str:
    return f"CASE WHEN {n} >= 6 THEN 3 WHEN {n} >= 3 THEN 2 WHEN {n} >= 2 THEN 1 ELSE 0 END"


PATTERNS = """,
per_incident AS (SELECT family_key, incident_id, min(arrival) AS first_seen, count(*) AS n FROM obs GROUP BY ALL),
totals AS (SELECT family_key, count(*) AS incident_count, CAST(sum(n) AS BIGINT) AS gap_count FROM per_incident GROUP BY family_key),
worst AS (SELECT family_key, max(""" + _points("severity") + """) AS worst,
                 count(*) FILTER (coverage = 'NOT_COVERED') AS n_uncovered, count(DISTINCT feature) AS n_features
          FROM obs GROUP BY family_key),
types AS (SELECT family_key, string_agg(gap_type, '|' ORDER BY n DESC, gap_type) AS gap_types,
                 first(gap_type ORDER BY n DESC, gap_type) AS leading_type
          FROM (SELECT family_key, gap_type, count(*) AS n FROM obs GROUP BY ALL) GROUP BY family_key),
feats AS (SELECT family_key, feature, count(*) AS n,
                 row_number() OVER (PARTITION BY family_key ORDER BY count(*) DESC, feature) AS p FROM obs GROUP BY family_key, feature),
features AS (SELECT family_key, string_agg(feature, '|' ORDER BY p) FILTER (p <= 4) AS features,
                    string_agg(feature, ', ' ORDER BY p) FILTER (p <= 3) AS top3, count(*) FILTER (p <= 4) AS n_top,
                    max(feature) FILTER (p = 1) AS lead_feature, max(n) FILTER (p = 1) AS leading_n
             FROM feats GROUP BY family_key),
examples AS (SELECT family_key, string_agg(incident_id, '|' ORDER BY p) AS examples
             FROM (SELECT *, row_number() OVER (PARTITION BY family_key ORDER BY first_seen, incident_id) AS p FROM per_incident)
             WHERE p <= 12 GROUP BY family_key),
pats AS (
  SELECT family_key, """ + _label("family_key") + """ AS label, incident_count, gap_count,
    """ + _recurrence_points("incident_count") + """ + worst
      + CASE WHEN n_uncovered / gap_count >= 0.6 THEN 2 WHEN n_uncovered > 0 THEN 1 ELSE 0 END
      + CASE WHEN n_features >= 3 THEN 1 ELSE 0 END AS points,
    gap_types, features, examples, lead_feature AS concentrated_in, round(leading_n / gap_count, 2) AS concentration,
    leading_n / gap_count AS share, top3, n_top, leading_type
  FROM totals JOIN worst USING (family_key) JOIN types USING (family_key) JOIN features USING (family_key)
       JOIN examples USING (family_key) WHERE incident_count >= 3),
patterns AS (
  SELECT *, CASE WHEN points >= 7 THEN 'HIGH' WHEN points >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
    label || ' x' || incident_count || '; ' || CASE
      WHEN share >= 0.6 THEN 'mostly ' || concentrated_in || ' (' || CAST(floor(share * 100) AS BIGINT) || ' %)'
      WHEN n_top > 1 THEN 'several areas: ' || top3 ELSE 'only ' || concentrated_in END
    || '; usual gap: ' || lower(replace(leading_type, '_', ' ')) AS summary
  FROM pats)
"""
PATTERN_SELECT = """
SELECT family_key, label, incident_count, gap_count, risk, gap_types, features, examples, summary, concentrated_in, concentration
FROM patterns"""

EVENT_OBS = """
obs AS (
  SELECT CAST(user_id AS VARCHAR) AS incident_id, gap_type, """ + _family("gap_type") + """ AS family_key,
         'Team ' || (user_id % 7) AS feature,
         CASE WHEN value >= 50 THEN 'CRITICAL' WHEN value >= 20 THEN 'HIGH' ELSE 'LOW' END AS severity,
         CASE WHEN event_type IN ('error', 'click') THEN 'NOT_COVERED' ELSE 'PARTIAL' END AS coverage, event_id AS arrival
  FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'MISSING_FIELD' WHEN 'view' THEN 'WEAK_ASSERTION'
               WHEN 'error' THEN 'ERROR_HANDLING' WHEN 'click' THEN 'CONCURRENCY' WHEN 'purchase' THEN 'BOUNDARY_CONDITION'
               ELSE 'MISSING_TEST' END AS gap_type FROM events))
"""
EVENT_VERDICT = "CASE event_type WHEN 'purchase' THEN 'COVERED' WHEN 'view' THEN 'PARTIAL' ELSE 'NOT_COVERED' END"

TERMS = f"""
docs AS (SELECT doc_id, text, lang AS feature FROM documents),
words AS (
  SELECT doc_id, feature, pos, t AS term FROM (
    SELECT doc_id, feature, unnest({toks('text')}) AS t, generate_subscripts({toks('text')}, 1) AS pos FROM docs)),
terms AS (
  SELECT doc_id, term, count(*) AS tf, CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS BIGINT) AS doc_length
  FROM words GROUP BY doc_id, term),
corpus AS (SELECT (SELECT count(*) FROM docs) AS n_docs, (SELECT sum(tf) FROM terms) / (SELECT count(*) FROM docs) AS avg_length),
stats AS (SELECT term, count(*) AS df, ln(1.0 + (n_docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf,
                 count(*) / n_docs AS share,
                 (count(*) < n_docs AND count(*) / n_docs <= greatest({fixed.DISTINCTIVE_SHARE}, 1.0 / n_docs)) AS is_distinctive
          FROM terms, corpus GROUP BY term, n_docs)
"""

_SYN_ROWS = ", ".join(f"('{h}', '{s}')" for h, r in fixed.SYNONYMS.items() for s in r)

QUERY_WORDS = f""",
syn(term, synonym) AS (VALUES {_SYN_ROWS}),
qwords AS (
  SELECT query_id, pos, t AS term FROM (
    SELECT item_id AS query_id, unnest({toks('text')}) AS t, generate_subscripts({toks('text')}, 1) AS pos FROM benchmark)),
qliteral AS (SELECT DISTINCT query_id, term FROM qwords),
qterms AS (
  SELECT query_id, term, max(weight) AS weight FROM (
    SELECT query_id, term, 1.0 AS weight FROM qliteral UNION ALL
    SELECT query_id, synonym, 0.5 FROM qliteral JOIN syn USING (term)) GROUP BY query_id, term),
bm25 AS (
  SELECT query_id, doc_id, sum(weight * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_length / avg_length))) AS bm25
  FROM qterms JOIN stats USING (term) JOIN terms USING (term), corpus GROUP BY query_id, doc_id)
"""


def _features(name: str, words: str, key: str) -> str:
    """Weighted features and signed bucket sums of (key, pos, term) rows."""
    bucket = "CAST(('0x' || substr(md5(feature), 1, 15))::BIGINT % 512 AS BIGINT)"
    return f""",
{name}_f AS (
  SELECT {key}, feature, CASE WHEN sum(w) > 0 THEN sum(w) ELSE max(s) END AS c FROM (
    SELECT {key}, term AS feature, 1.0 AS w, 0.0 AS s FROM {words} UNION ALL
    SELECT {key}, term || '_' || nxt, 0.7, 0.0 FROM (
      SELECT {key}, term, lead(term) OVER (PARTITION BY {key} ORDER BY pos) AS nxt FROM {words}) WHERE nxt IS NOT NULL
    UNION ALL SELECT {key}, synonym, 0.0, 0.4 FROM {words} JOIN syn USING (term)) GROUP BY {key}, feature),
{name}_b AS (
  SELECT {key}, {bucket} AS bucket,
         sum(CASE WHEN substr(md5(feature), 16, 1) >= '8' THEN 1.0 ELSE -1.0 END * CASE WHEN c > 1 THEN 1.0 + ln(c) ELSE c END) AS raw
  FROM {name}_f GROUP BY 1, 2)"""


VECTORS = (
    QUERY_WORDS
    + _features("dv", "words", "doc_id")
    + _features("qv", "qwords", "query_id")
    + """,
bidf AS (SELECT bucket, ln((n_docs + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM dv_b, corpus GROUP BY bucket, n_docs),
dvec AS (SELECT doc_id, bucket, raw * idf / greatest(sqrt(sum(raw * idf * raw * idf) OVER (PARTITION BY doc_id)), 1e-12) AS w
         FROM dv_b JOIN bidf USING (bucket)),
qw AS (SELECT query_id, bucket, raw * coalesce(idf, ln(n_docs + 1.0) + 1.0) AS w
       FROM qv_b LEFT JOIN bidf USING (bucket), corpus),
qvec AS (SELECT query_id, bucket, w / greatest(sqrt(sum(w * w) OVER (PARTITION BY query_id)), 1e-12) AS w FROM qw),
qids AS (SELECT DISTINCT query_id FROM qvec), dids AS (SELECT DISTINCT doc_id FROM dvec),
sims AS (
  SELECT query_id, doc_id, round(coalesce(s, 0), 9) AS similarity FROM qids CROSS JOIN dids
  LEFT JOIN (SELECT query_id, doc_id, sum(q.w * d.w) AS s FROM qvec q JOIN dvec d USING (bucket) GROUP BY ALL) USING (query_id, doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS p FROM sims)
"""
)

VOCAB = """,
vwords AS (SELECT doc_id, feature, term FROM words UNION ALL SELECT doc_id, feature, feature FROM docs
           WHERE feature NOT IN (""" + _quoted(fixed.STOPWORDS) + """)),
ft AS (SELECT feature, term, count(*) AS n FROM vwords GROUP BY ALL),
ftot AS (SELECT feature, sum(n) AS ft FROM ft GROUP BY feature), ttot AS (SELECT term, sum(n) AS tt FROM ft GROUP BY term),
nt AS (SELECT feature, count(DISTINCT doc_id) AS n_tests FROM vwords GROUP BY feature),
lifted AS (
  SELECT feature, term, round(ln(1 + n) * ((n / ft) / (tt / (SELECT sum(n) FROM ft))), 9) AS raw
  FROM ft JOIN ftot USING (feature) JOIN ttot USING (term) JOIN nt USING (feature)
  WHERE n_tests >= 2 AND (n / ft) / (tt / (SELECT sum(n) FROM ft)) >= 1.5),
voc AS (
  SELECT feature, term, round(raw / max(raw) OVER (PARTITION BY feature), 4) AS weight
  FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY raw DESC, term) AS p FROM lifted) WHERE p <= 40)
"""
CLASSIFIED = VOCAB + """,
guess AS (
  SELECT doc_id, feature, score FROM (
    SELECT doc_id, v.feature, round(sum(weight), 6) AS score, max(n_tests) AS n_tests,
           row_number() OVER (PARTITION BY doc_id ORDER BY round(sum(weight), 6) DESC, max(n_tests) DESC, v.feature DESC) AS p
    FROM (SELECT DISTINCT doc_id, term FROM words) w JOIN voc v USING (term) JOIN nt ON nt.feature = v.feature
    GROUP BY doc_id, v.feature HAVING round(sum(weight), 6) > 0) WHERE p = 1),
classified AS (SELECT doc_id, coalesce(guess.feature, 'Unknown') AS feature, coalesce(score, 0.0) AS score FROM docs LEFT JOIN guess USING (doc_id))
"""

SENTENCES = """
s AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE (l_orderkey + l_linenumber) % 8
    WHEN 0 THEN 'Checkout failed when a ' || pct || '% discount was applied, quantity was ' || qty
    WHEN 1 THEN 'The cart quantity = ' || qty || ' and tax rate of ' || tax || ' timed out after a retry'
    WHEN 2 THEN 'Order total was invalid, page size: ' || qty || ', coupon is expired'
    WHEN 3 THEN 'Refund of ' || qty || ' percent was rejected because the email is null'
    WHEN 4 THEN 'Two concurrent requests with session_token missing value and items ' || qty
    WHEN 5 THEN 'Empty cart, tax ' || tax || '% of the price and shipping = ' || qty || ' exceeded the maximum'
    WHEN 6 THEN 'A user without permission saw status ' || qty || ' in staging; unknown username'
    ELSE 'Retry count of ' || qty || ' followed by a server error in the xml parser, discount at ' || pct || ' pct' END AS sentence
  FROM (SELECT *, CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) AS pct, CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) AS tax,
               CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS qty FROM lineitem))
"""


def _signals(x: str) -> str:
    """TXT-16 with the one lookbehind each for zero and 0 % written without it."""
    parts = []
    for name, pattern in fixed.SIGNAL_PATTERNS.items():
        text = x
        if name == "boundary_min":
            text = f"replace({x}, 'division by zero', 'division by nought')"
            pattern = (
                pattern.replace("(?<!division by )", "").replace("(?<![\\d.])0", "(?:^|[^0-9.])0")
            )
        parts.append(f"CASE WHEN regexp_matches({text}, '{pattern}') THEN '{name}' END")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda s: s IS NOT NULL), '|')"


ORACLES = {
    "coverage_verdicts": f"WITH {VERDICTS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, feature, coverage, "
    "effectiveness, gap_type, family_key, best_test_id, round(strength, 6) AS best_strength FROM verdicts",
    "confidence_scores": f"WITH {VERDICTS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coverage, confidence, "
    "CASE WHEN confidence >= 0.75 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level FROM verdicts",
    "recurrence_on_arrival": f"WITH {RECURRENCE} SELECT incident_id, similar_incidents FROM recurrence",
    "risk_scores": f"""WITH {RECURRENCE}, p AS (
      SELECT *, CAST({_points('severity')} + CASE coverage WHEN 'NOT_COVERED' THEN 2 ELSE 1 END + 1
             + {_recurrence_points('similar_incidents')} AS BIGINT) AS points FROM obs JOIN recurrence USING (incident_id))
      SELECT incident_id, l_partkey, l_suppkey, severity, coverage, similar_incidents, points,
             CASE WHEN points >= 6 THEN 'HIGH' WHEN points >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM p""",
    "recurring_patterns": f"WITH {OBSERVED}{PATTERNS}{PATTERN_SELECT}",
    "gap_pattern_links": f"WITH {OBSERVED}{PATTERNS} SELECT o.family_key, o.gap_type, p.label AS pattern_label, "
    "p.risk AS pattern_risk, count(*) AS n FROM obs o LEFT JOIN patterns p USING (family_key) GROUP BY ALL",
    "verdict_mix": f"WITH {VERDICTS} SELECT coverage, count(*) AS n FROM verdicts GROUP BY coverage",
    "catalogue_statistics": f"""WITH {LINES} SELECT 'feature' AS dimension, feature AS value, count(*) AS n FROM tests GROUP BY feature
      UNION ALL SELECT 'framework', l_returnflag, count(*) FROM tests GROUP BY l_returnflag
      UNION ALL SELECT 'total', '', count(*) FROM tests""",
    "evidence_by_condition": f"""WITH {VERDICTS}, k AS (
      SELECT feature, 'discount' AS key, d_same AS same FROM verdicts UNION ALL SELECT feature, 'tax', t_same FROM verdicts)
      SELECT feature, key, CASE WHEN same = 1 THEN 'condition_matched' WHEN same = 0 THEN 'condition_difference'
             ELSE 'condition_absent' END AS kind, count(*) AS n FROM k GROUP BY ALL""",
    "missing_conditions": f"""WITH {VERDICTS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      concat_ws(';', CASE WHEN coalesce(d_same, 0) = 0 THEN 'discount=' || d || '%' END,
                     CASE WHEN coalesce(t_same, 0) = 0 THEN 'tax=' || t || '%' END) AS missing,
      CASE WHEN low AND coalesce(low_seen, 0) = 0 THEN 'boundary_min' ELSE '' END AS missing_signals FROM verdicts""",
    "tested_ranges": f"""WITH {LINES}, v AS (SELECT l_partkey, feature, 'discount' AS key, d AS v FROM tests
      UNION ALL SELECT l_partkey, feature, 'tax', t FROM tests)
      SELECT l_partkey, feature, key, CAST(min(v) AS BIGINT) AS lowest, CAST(max(v) AS BIGINT) AS highest,
             array_to_string(list_sort(list(DISTINCT v)), ',') AS tested FROM v GROUP BY ALL""",
    "boundary_recommendations": f"""WITH {VERDICTS}, open AS (
      SELECT DISTINCT l_partkey, feature, d, t FROM verdicts WHERE gap_type = 'BOUNDARY_CONDITION'),
      p(x) AS (VALUES (0), (50), (100))
      SELECT feature, x || '%' AS suggested, count(*) AS n FROM open o CROSS JOIN p
      WHERE NOT EXISTS (SELECT 1 FROM tests k WHERE k.l_partkey = o.l_partkey AND k.feature = o.feature AND k.d = x) GROUP BY ALL""",
    "return_profiles": f"WITH {LINES} SELECT l_partkey, feature, d AS discount_pct, t AS tax_pct, count(*) AS n_incidents FROM inc GROUP BY ALL",
    "unique_test_ids": """WITH l AS (SELECT *, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS base FROM lineitem WHERE l_returnflag <> 'R'),
      n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS p FROM l)
      SELECT CASE WHEN p = 1 THEN base ELSE base || '#' || p END AS test_id, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM n""",
    "document_duplicates": """WITH f AS (SELECT doc_id, n_chars, sha256(lower(trim(text)) || '||||') AS fingerprint FROM documents)
      SELECT min(doc_id) AS doc_id, arg_min(n_chars, doc_id) AS n_chars, fingerprint FROM f GROUP BY fingerprint""",
    "cross_source_duplicates": """WITH f AS (SELECT source, lower(trim(text)) AS k, min(source) OVER (PARTITION BY lower(trim(text))) AS owner FROM documents)
      SELECT source, count(DISTINCT k) AS stored FROM f WHERE source = owner GROUP BY source""",
    "catalogue_search": """SELECT p_partkey AS seq, p_name AS name, p_type AS feature, p_brand AS framework FROM part
      WHERE p_type = 'ECONOMY' AND (contains(lower(p_name), 'red') OR contains(CAST(p_partkey AS VARCHAR), 'red')) ORDER BY p_partkey LIMIT 50 OFFSET 10""",
    "normalized_documents": f"SELECT doc_id, {norm('text')} AS normalized FROM documents",
    "document_tokens": f"SELECT doc_id, array_to_string({toks('text')}, ' ') AS tokens FROM documents",
    "document_bigrams": f"""WITH t AS (SELECT doc_id, {toks('text')} AS t FROM documents)
      SELECT doc_id, CAST(greatest(len(t) - 1, 0) AS BIGINT) AS n,
             array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]), ' ') AS bigrams FROM t""",
    "document_keywords": f"""WITH w AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, {toks('text')} AS t FROM documents)),
      f AS (SELECT doc_id, term, min(pos) AS pos FROM w GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM f),
      k AS (SELECT doc_id, string_agg(term, ' ' ORDER BY p) AS keywords FROM r WHERE p <= 25 GROUP BY doc_id)
      SELECT doc_id, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN k USING (doc_id)""",
    "document_numbers": r"""WITH x AS (SELECT doc_id, regexp_extract_all(text, '-?\d+(?:\.\d+)?') AS n,
             regexp_extract_all(text, '(-?\d+(?:\.\d+)?)\s*(?:%|percent|pct)\b', 1) AS p FROM documents)
      SELECT doc_id, CAST(len(n) AS BIGINT) AS n_numbers, list_max(list_transform(n, lambda v: CAST(v AS DOUBLE))) AS largest,
             CAST(len(p) AS BIGINT) AS n_percentages FROM x""",
    "value_numbers": r"""SELECT p_partkey, CASE WHEN length(c || ' per item') <= 12 THEN CAST(c AS DOUBLE) END AS number_a,
             CAST(p_size AS DOUBLE) AS number_b, CAST(c AS DOUBLE) AS number_c,
             regexp_replace(regexp_replace(c, '0+$', ''), '\.$', '') AS trimmed
      FROM (SELECT *, CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR) AS c FROM part)""",
    "token_overlap": f"""WITH t AS (SELECT conv_id, turn, role, list_distinct({toks('text')}) AS t FROM conversations),
      p AS (SELECT a.conv_id, a.turn, a.t AS x, b.t AS y FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user')
      SELECT conv_id, turn, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS jaccard FROM p""",
    "incident_fields": r"""WITH u AS (SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS d, lower(text) AS low FROM conversations WHERE role = 'user'),
      l AS (SELECT *, regexp_replace(split_part(d, chr(10), 1), '^\s+|\s+$', '', 'g') AS line FROM u)
      SELECT conv_id, turn,
        CASE WHEN length(line) <= 120 THEN line ELSE split_part(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1), 1) END AS title,
        CASE """ + " ".join(
        "WHEN " + " OR ".join(f"contains(low, '{k}')" for k in keys) + f" THEN '{level}'" for level, keys in fixed.SEVERITY_KEYWORDS
    ) + r""" ELSE 'MEDIUM' END AS severity,
        regexp_replace(split_part(regexp_replace(d, '([.!?])\s', '\1' || chr(1), 'g'), chr(1), 1), '^\s+|\s+$', '', 'g') AS scenario FROM l""",
    "code_labels": """WITH c AS (SELECT upper(event_type) AS code FROM events UNION ALL SELECT upper(replace(o_orderpriority, '-', '_')) FROM orders)
      SELECT code, array_to_string(list_transform(string_split(replace(lower(code), '_', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS label, count(*) AS n FROM c GROUP BY code""",
    "sentence_signals": f"WITH {SENTENCES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_signals(norm('sentence'))} AS signals FROM s",
    "sentence_conditions": f"""WITH {SENTENCES}, v AS (SELECT *, regexp_extract_all(sentence, '[0-9]+') AS n FROM s)
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE (l_orderkey + l_linenumber) % 8
        WHEN 0 THEN 'discount=' || n[1] || '%;quantity=' || n[2]
        WHEN 1 THEN 'cart_quantity=' || n[1] || ';tax_rate=' || n[2]
        WHEN 2 THEN 'page_size=' || n[1] || ';order_total=invalid;coupon=expired'
        WHEN 3 THEN 'refund=' || n[1] || '%;email=null'
        WHEN 4 THEN 'item=' || n[1] || ';value=missing'
        WHEN 5 THEN 'tax=' || n[1] || '%;shipping=' || n[2]
        WHEN 6 THEN 'status=' || n[1] || ';username=unknown'
        ELSE 'discount=' || n[2] || '%;retry_count=' || n[1] END AS conditions FROM v""",
    "term_statistics": f"WITH {TERMS} SELECT term, df, round(idf, 6) AS idf, round(share, 6) AS share, is_distinctive FROM stats",
    "postings": f"WITH {TERMS} SELECT doc_id, term, tf, doc_length FROM terms",
    "bm25_top": f"""WITH {TERMS}{QUERY_WORDS}, r AS (SELECT query_id, doc_id, round(bm25, 6) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS rank FROM bm25)
      SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 20""",
    "lexical_maxima": f"WITH {TERMS}{QUERY_WORDS} SELECT query_id, round(max(bm25), 6) AS best, count(*) AS n_hits FROM bm25 GROUP BY query_id",
    "bucket_weights": f"WITH {TERMS}{VECTORS} SELECT bucket, round(idf, 6) AS idf FROM bidf",
    "text_vector_top": f"WITH {TERMS}{VECTORS} SELECT query_id, doc_id, round(similarity, 5) AS similarity FROM ranked WHERE p <= 10",
    "embedding_top": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
      s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS similarity FROM e a CROSS JOIN e b),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS p FROM s)
      SELECT query_id, doc_id, round(similarity, 6) AS similarity FROM r WHERE p <= 10""",
    "hybrid_candidates": f"""WITH {TERMS}{VECTORS},
      hits AS (SELECT query_id, doc_id, similarity FROM ranked WHERE p <= 90),
      lex AS (SELECT query_id, doc_id, bm25 / max(bm25) OVER (PARTITION BY query_id) AS lexical FROM bm25),
      u AS (SELECT query_id, doc_id, greatest(coalesce(similarity, 0), 0) AS v, coalesce(lexical, 0) AS l FROM hits FULL JOIN lex USING (query_id, doc_id)),
      sc AS (SELECT query_id, doc_id, feature = 'en' AS feature_match,
                    round(least((0.5 * v + 0.5 * l) * CASE WHEN feature = 'en' THEN 1.3 ELSE 1.0 END, 1.0), 4) AS score FROM u JOIN docs USING (doc_id)),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS p, max(score) OVER (PARTITION BY query_id) AS top FROM sc),
      f AS (SELECT *, greatest(0.08, 0.35 * top) AS floor FROM r)
      SELECT query_id, doc_id, score, feature_match FROM f WHERE (score >= floor AND p <= 15) OR (top < floor AND p <= 3)""",
    "learned_vocabulary": f"WITH {TERMS}{VOCAB} SELECT feature, term, weight FROM voc",
    "classified_documents": f"WITH {TERMS}{CLASSIFIED} SELECT doc_id, feature, score FROM classified",
    "classification_matrix": f"""WITH {TERMS}{CLASSIFIED} SELECT d.feature, """ + ", ".join(
        f"count(*) FILTER (c.feature = '{x}') AS \"{x}\"" for x in ("en", "fr", "de", "es", "Unknown")
    ) + " FROM classified c JOIN docs d USING (doc_id) GROUP BY d.feature",
    "latest_analyses": f"""SELECT user_id AS incident_id, event_id AS analysis_id, {EVENT_VERDICT} AS coverage, round(value / 100, 4) AS confidence
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events) WHERE p = 1""",
    "coverage_counts": f"""WITH l AS (SELECT {EVENT_VERDICT} AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events) WHERE p = 1),
      c(coverage) AS (VALUES ('COVERED'), ('PARTIAL'), ('NOT_COVERED'), ('INSUFFICIENT_EVIDENCE'))
      SELECT c.coverage, count(l.coverage) AS n FROM c LEFT JOIN l USING (coverage) GROUP BY c.coverage""",
    "event_patterns": f"WITH {EVENT_OBS}{PATTERNS}{PATTERN_SELECT}",
    "streamed_patterns": f"WITH {EVENT_OBS}{PATTERNS}{PATTERN_SELECT}",
    "family_recurrence": f"WITH {EVENT_OBS} SELECT family_key, count(DISTINCT incident_id) AS n_incidents FROM obs GROUP BY family_key",
    "event_recurrence": f"""WITH {EVENT_OBS}, i AS (SELECT incident_id, min(arrival) AS arrival FROM obs GROUP BY 1),
      f AS (SELECT family_key, incident_id, min(arrival) AS arrival FROM obs WHERE family_key IN ('RESILIENCE_RETRY_TIMEOUT', 'ERROR_HANDLING') GROUP BY 1, 2)
      SELECT i.incident_id, count(f.incident_id) AS similar_incidents FROM i LEFT JOIN f ON f.arrival < i.arrival GROUP BY 1""",
    "streamed_recurrence": f"""WITH {EVENT_OBS}, i AS (SELECT incident_id, min(arrival) AS arrival FROM obs GROUP BY 1),
      f AS (SELECT family_key, incident_id, min(arrival) AS arrival FROM obs WHERE family_key IN ('RESILIENCE_RETRY_TIMEOUT', 'ERROR_HANDLING') GROUP BY 1, 2)
      SELECT i.incident_id, count(f.incident_id) AS similar_incidents FROM i LEFT JOIN f ON f.arrival < i.arrival GROUP BY 1""",
    "streamed_trend": f"""WITH {EVENT_OBS} SELECT strftime(ts, '%Y-%m-%d') AS day, family_key, count(*) AS n,
      count(*) FILTER (coverage = 'NOT_COVERED') AS n_uncovered FROM obs JOIN events ON arrival = event_id GROUP BY ALL""",
    "family_page": f"""WITH {EVENT_OBS}, h AS (SELECT incident_id, max(arrival) AS analysis_id FROM obs WHERE family_key = 'CONCURRENCY' GROUP BY 1),
      x AS (SELECT incident_id, max(feature) AS feature FROM obs GROUP BY 1)
      SELECT incident_id, analysis_id, feature FROM h JOIN x USING (incident_id) ORDER BY analysis_id DESC LIMIT 12""",
    "status_updates": """WITH u AS (SELECT l_partkey, CASE l_returnflag WHEN 'A' THEN 'ACCEPTED' ELSE 'IGNORED' END AS s,
        row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS p
        FROM lineitem WHERE l_returnflag IN ('A', 'N'))
      SELECT p_partkey AS recommendation_id, coalesce(s, 'PROPOSED') AS status FROM part LEFT JOIN u ON p_partkey = l_partkey AND p = 1""",
    "dashboard": f"""WITH {EVENT_OBS}, l AS (SELECT {EVENT_VERDICT} AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p FROM events) WHERE p = 1)
      SELECT 'incidents' AS metric, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'test_gaps', count(*) FROM events
      UNION ALL SELECT 'tests_indexed', count(*) FROM part
      UNION ALL SELECT 'patterns', count(*) FROM (SELECT family_key FROM obs GROUP BY 1 HAVING count(DISTINCT incident_id) >= 3)
      UNION ALL SELECT lower(c), (SELECT count(*) FROM l WHERE coverage = c) FROM (VALUES ('COVERED'), ('PARTIAL'), ('NOT_COVERED'), ('INSUFFICIENT_EVIDENCE')) v(c)""",
    "recent_runs": "SELECT event_id, event_type, ts FROM events ORDER BY ts DESC, event_id LIMIT 6",
    "incident_page": """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS p FROM orders)
      SELECT c_custkey AS incident_id, c_name AS title, c_mktsegment AS feature, 'COVERED' AS coverage, o_orderkey AS analysis_id
      FROM customer JOIN o ON c_custkey = o_custkey AND p = 1 WHERE o_orderstatus = 'F' AND (contains(lower(c_name), '9') OR contains(CAST(c_custkey AS VARCHAR), '9'))
      ORDER BY c_custkey DESC LIMIT 25 OFFSET 5""",
}

ORACLES |= {f"{name}_by_bounds": ORACLES[name] for name in ("bm25_top", "hybrid_candidates", "text_vector_top", "embedding_top")}

_SYNONYMS = ", ".join(f"('{head}', '{word}')" for head, words in fixed.SYNONYMS.items() for word in words)
ORACLES |= records.ORACLES | persisted.ORACLES | maintained.oracles(TERMS, QUERY_WORDS, VECTORS) | explained.oracles(LINES, VERDICTS) | {
    "url_features": f"""WITH s AS (SELECT page_id, list_filter(string_split(replace(url, '\\', '/'), '/'), lambda x: trim(x) <> '') AS p FROM pages),
      n AS (SELECT page_id, list_concat(list_reverse(p[:len(p) - 1]), [regexp_replace(p[len(p)], '\\.[^.]*$', '')]) AS p FROM s),
      f AS (SELECT page_id, list_filter(list_transform(p, lambda x: array_to_string(list_transform(list_filter(string_split_regex({norm('x')}, '[^A-Za-z0-9]+'),
              lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN ({_quoted(fixed.FEATURE_NOISE)}))[:{fixed.FEATURE_WORDS}],
              lambda w: upper(w[1]) || lower(w[2:])), ' ')), lambda x: x <> '') AS l FROM n)
      SELECT page_id, coalesce(l[1], '{fixed.UNKNOWN}') AS feature FROM f""",
    "synonym_expansion": f"""WITH {SENTENCES}, y(head, word) AS (VALUES {_SYNONYMS}),
      d AS (SELECT sentence, count(*) AS lines FROM s GROUP BY sentence), t AS (SELECT sentence, lines, list_distinct({toks('sentence')}) AS t FROM d),
      w AS (SELECT sentence, unnest(t) AS word FROM t), e AS (SELECT sentence, word FROM w UNION SELECT sentence, y.word FROM w JOIN y ON w.word = head),
      c AS (SELECT sentence, count(*) AS n_expanded FROM e GROUP BY sentence)
      SELECT CAST(len(t) AS BIGINT) AS n_tokens, coalesce(n_expanded, 0) AS n_expanded, CAST(sum(lines) AS BIGINT) AS n
      FROM t LEFT JOIN c USING (sentence) GROUP BY ALL""",
    "proposed_facts": f"""WITH b AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS earlier, lag(turn) OVER w = turn - 1 AS follows
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
      SELECT conv_id || '-' || turn AS incident_id, CASE WHEN role = 'system' THEN 'Unknown' ELSE role END AS feature,
        concat_ws(';', CASE WHEN length(trim(text)) >= {fixed.MIN_QUOTE_CHARS} THEN role || '=x' END,
          CASE WHEN follows AND length(trim(earlier)) >= {fixed.MIN_QUOTE_CHARS} AND contains({norm('text')}, trim({norm('earlier')})) THEN role || '_before=x' END) AS conditions FROM b""",
}
