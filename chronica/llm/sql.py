"""The same results in SQL, where SQL can give them on whole tables."""

from __future__ import annotations

NUMBER = """CASE WHEN regexp_full_match(regexp_replace({0}, '\\s', '', 'g'), '[0-9]+(\\.[0-9]+)?[eE]\\+?[0-9]+')
       THEN CAST(CAST(regexp_replace({0}, '\\s', '', 'g') AS DOUBLE) AS BIGINT)
     WHEN regexp_full_match(regexp_replace({0}, '\\s', '', 'g'), '[0-9]+\\.0*')
       THEN CAST(regexp_extract(regexp_replace({0}, '\\s', '', 'g'), '^([0-9]+)\\.', 1) AS BIGINT)
     ELSE TRY_CAST(nullif(regexp_replace({0}, '[^0-9]', '', 'g'), '') AS BIGINT) END"""

_P1 = f"""
WITH RECURSIVE e AS (
  SELECT {NUMBER.format('old_subject_id')} AS a, {NUMBER.format('new_subject_id')} AS b FROM subject_links
), edges AS (
  SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b
), reach AS (
  SELECT a AS node, a AS seen FROM edges UNION SELECT r.node, x.b FROM reach r JOIN edges x ON r.seen = x.a
), component AS (
  SELECT node, min(seen) AS c FROM reach GROUP BY node
), every AS (
  SELECT h.hadm_id, coalesce(c.c, h.n) AS person
  FROM (SELECT hadm_id, {NUMBER.format('subject_id')} AS n FROM cohort) h LEFT JOIN component c ON h.n = c.node
  WHERE h.n IS NOT NULL
), people AS (
  SELECT DISTINCT hadm_id, person FROM every WHERE hadm_id IS NOT NULL
), firsts AS (
  SELECT person, min(hadm_id) AS a FROM people GROUP BY person
)
"""
P1_FOUND = _P1 + "SELECT f.a AS hadm_id_a, p.hadm_id AS hadm_id_b FROM people p JOIN firsts f USING (person) WHERE p.hadm_id > f.a"
P1_TOGETHER = _P1 + "SELECT count(*) AS records, count(DISTINCT person) AS persons, 0::BIGINT AS torn FROM every"

_P3 = """
WITH raw AS (
  SELECT hadm_id, unnest(list_concat(list_concat(coalesce(conditions, []), coalesce(procedures, [])), coalesce(drugs, []))) AS item
  FROM visits WHERE hadm_id IS NOT NULL
), items AS (
  SELECT DISTINCT hadm_id, lower(trim(regexp_replace(item, '\\s+', ' ', 'g'))) AS item FROM raw WHERE trim(regexp_replace(item, '\\s+', ' ', 'g')) <> ''
), n AS (SELECT count(DISTINCT hadm_id) AS n_records FROM visits),
single AS (SELECT item, count(*) AS n FROM items GROUP BY item),
pairs AS (
  SELECT x.item AS item_a, y.item AS item_b, count(*) AS n_ab
  FROM items x JOIN items y ON x.hadm_id = y.hadm_id AND x.item < y.item GROUP BY ALL HAVING count(*) >= 5
), scored AS (
  SELECT p.item_a, p.item_b, p.n_ab, a.n AS n_a, b.n AS n_b, n.n_records
  FROM pairs p JOIN single a ON a.item = p.item_a JOIN single b ON b.item = p.item_b CROSS JOIN n
)
"""
P3_PAIRS = _P3 + """
SELECT item_a, item_b, n_ab, n_a, n_b, n_records,
  n_ab::DOUBLE * n_records::DOUBLE / (n_a::DOUBLE * n_b::DOUBLE) AS lift,
  CASE WHEN n_ab < n_a THEN (1 - n_b::DOUBLE / n_records::DOUBLE) / (1 - n_ab::DOUBLE / n_a::DOUBLE) END AS conviction
FROM scored
"""
P3_EVERY_PAIR = P3_PAIRS.replace("HAVING count(*) >= 5", "")
P3_FOUND = _P3 + """
SELECT item_a, item_b FROM scored
WHERE n_ab::HUGEINT * 1000 >= n_records AND n_ab::HUGEINT * n_records >= 3 * n_a::HUGEINT * n_b
"""

P4_FOUND = f"""
WITH l AS (
  SELECT {NUMBER.format('subject_id')} AS s, itemid, coalesce(charttime, storetime) AS t, labevent_id
  FROM labevents WHERE valuenum IS NOT NULL AND NOT isnan(valuenum)
), c AS (
  SELECT DISTINCT {NUMBER.format('subject_id')} AS s, hadm_id, t_dec FROM cohort WHERE t_dec IS NOT NULL AND hadm_id IS NOT NULL
), m AS (
  SELECT c.hadm_id, l.itemid, l.labevent_id, row_number() OVER (
    PARTITION BY c.hadm_id, l.itemid ORDER BY abs(epoch_us(l.t) - epoch_us(c.t_dec)), l.t, l.labevent_id) AS rn
  FROM c JOIN l ON l.s = c.s AND l.t BETWEEN c.t_dec - INTERVAL 2 HOUR AND c.t_dec + INTERVAL 2 HOUR
  WHERE l.itemid IS NOT NULL
)
SELECT hadm_id, itemid, labevent_id FROM m WHERE rn = 1
"""

_P7 = """
WITH v AS (SELECT dose_id, index_t0, unnest(visits) AS v FROM profiles),
c AS (
  SELECT dose_id, index_t0, v, unnest(list_concat(list_concat(coalesce(v.conditions, []), coalesce(v.procedures, [])), coalesce(v.drugs, []))) AS concept FROM v
), s AS (
  SELECT dose_id, index_t0, concept, coalesce(nullif(trim(v.concept_times[concept]), ''), nullif(trim(v.admittime), '')) AS txt FROM c WHERE concept IS NOT NULL
), t AS (
  SELECT dose_id, concept, min(TRY_CAST(index_t0 AS TIMESTAMP)) AS t0,
    min(CASE WHEN length(txt) <= 10 THEN TRY_CAST(txt AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND ELSE TRY_CAST(txt AS TIMESTAMP) END) AS known
  FROM s GROUP BY dose_id, concept
), h AS (SELECT * FROM history_events WHERE hours_before_t_dec IS NOT NULL),
parts AS (
  SELECT hist_id, 'row' AS item, hours_before_t_dec > 0 AS ok FROM h
  UNION ALL SELECT hist_id, 'uo_6h_after_ml', hours_before_t_dec >= 6 FROM h WHERE uo_6h_after_ml IS NOT NULL AND hours_before_t_dec > 0
  UNION ALL SELECT hist_id, 'escalated_24h', hours_before_t_dec >= 24 FROM h WHERE escalated_24h IS NOT NULL AND hours_before_t_dec > 0
  UNION ALL SELECT hist_id, 'creatinine_after_48h', hours_before_t_dec >= 48 FROM h WHERE creatinine_after_48h IS NOT NULL AND hours_before_t_dec > 0
), every AS (
  SELECT 'profile' AS origin, dose_id AS record_id, concept AS item, known < t0 AS ok FROM t WHERE known IS NOT NULL AND t0 IS NOT NULL
  UNION ALL SELECT 'history', CAST(hist_id AS VARCHAR), item, bool_and(ok) FROM parts GROUP BY hist_id, item
)
"""
P7_FOUND = _P7 + "SELECT origin, record_id, item FROM every WHERE NOT ok"
P7_KNOWN = _P7 + "SELECT origin, record_id, item FROM every WHERE ok"


def oracle_sql() -> dict[str, str]:
    return {
        "p8_held": "SELECT pack_name, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS over_full, 0::BIGINT AS torn FROM pack_sizes",
        "p1_found": P1_FOUND, "p1_together": P1_TOGETHER, "p3_found": P3_FOUND, "p3_pairs": P3_PAIRS, "p3_every_pair": P3_EVERY_PAIR, "p4_found": P4_FOUND, "p7_found": P7_FOUND, "p7_known": P7_KNOWN,
    }
