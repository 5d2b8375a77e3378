"""SQL of the training-data queries, where SQL can express them on whole tables."""

from __future__ import annotations

_LETTERS = lambda c: f"upper(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}]+', '', 'g'))"

_P5_PART = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_P5_KEY = " || chr(31) || ".join([f"least({_P5_PART('heavy')}, {_P5_PART('light')})", f"greatest({_P5_PART('heavy')}, {_P5_PART('light')})", _P5_PART("antigen_id")])

_P1_PAIRS = f"""WITH r AS (SELECT DISTINCT record_id, {_LETTERS('heavy')} AS h, {_LETTERS('light')} AS l, lower(trim(split)) AS s, replace(trim(source_group), chr(92), '/') AS g FROM math_demo WHERE record_id IS NOT NULL),
    t AS (SELECT * FROM r WHERE h <> '' AND s = 'train'), v AS (SELECT * FROM r WHERE h <> '' AND s IN ('validation', 'test')),
    p AS (SELECT t.record_id AS a, v.record_id AS b, v.s, v.g, levenshtein(t.h, v.h) + levenshtein(t.l, v.l) AS d FROM t, v WHERE abs(length(t.h) - length(v.h)) + abs(length(t.l) - length(v.l)) <= 3 AND levenshtein(t.h, v.h) + levenshtein(t.l, v.l) <= 3 AND t.record_id <> v.record_id)"""

_P4 = f"""WITH RECURSIVE r AS (SELECT DISTINCT record_id, nullif(lower(trim(split)), '') AS s, 'g' || nullif(replace(trim(source_group), chr(92), '/'), '') AS g, 'h' || nullif({_LETTERS('heavy')}, '') AS h FROM math_demo WHERE record_id IS NOT NULL),
    n AS (SELECT record_id, g AS k FROM r WHERE regexp_matches(substr(g, 2), '\\S') UNION SELECT record_id, h FROM r WHERE h IS NOT NULL), e AS (SELECT DISTINCT n.record_id AS u, m.v FROM n JOIN (SELECT k, min(record_id) AS v FROM n GROUP BY k) m USING (k)),
    b AS (SELECT u, v FROM e UNION SELECT v, u FROM e UNION SELECT record_id, record_id FROM r),
    c(node, root) USING KEY (node) AS (SELECT DISTINCT u, u FROM b UNION SELECT b.v, min(c.root) FROM c JOIN b ON b.u = c.node JOIN recurring.c AS x ON x.node = b.v WHERE c.root < x.root GROUP BY b.v)"""

_RUNS = lambda table, key, text: f"SELECT {key}, i, w[i : i + 11] AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, regexp_extract_all(lower(regexp_replace({text}, '[^A-Za-z0-9]', ' ', 'g')), '[a-z0-9]+') AS w FROM {table} WHERE {text} IS NOT NULL AND {key} IS NOT NULL) WHERE len(w) >= 12)"

SQL = {
    "p1_found": f"{_P1_PAIRS} SELECT DISTINCT least(a, b) AS record_id_a, greatest(a, b) AS record_id_b FROM p",
    "p1_report": f"{_P1_PAIRS} SELECT s AS split, g AS source_group, count(DISTINCT b) AS records, count(*) AS pairs, count(DISTINCT CASE WHEN d = 0 THEN b END) AS exact_records FROM (SELECT DISTINCT a, b, s, g, d FROM p) GROUP BY 1, 2",
    "p4_found": f"{_P4}, j AS (SELECT r.record_id, c.root, min(r.s) OVER (PARTITION BY c.root) AS lo, max(r.s) OVER (PARTITION BY c.root) AS hi FROM r JOIN c ON c.node = r.record_id) SELECT DISTINCT record_id, root AS set_key FROM j WHERE lo < hi",
    "p5_found": f"SELECT min(raw_id) AS first_raw_id, count(*) AS copies FROM raw_record GROUP BY {_P5_KEY} HAVING count(*) > 1",
    "p5_collapsed": f"SELECT g.raw_id, r.record_id, g.copies FROM (SELECT min(raw_id) AS raw_id, count(*) AS copies FROM raw_record GROUP BY {_P5_KEY}) g JOIN raw_record r ON r.raw_id = g.raw_id",
    "p7_found": """
        WITH best AS (SELECT record_id, max(value) AS v FROM score_row WHERE task_name = 'affinity_rank' AND value IS NOT NULL AND NOT isnan(value) GROUP BY record_id),
             earlier AS (SELECT record_id, min(value) AS t FROM rank_row GROUP BY record_id),
             placed AS (SELECT r.antigen_id, r.record_id, row_number() OVER (PARTITION BY r.antigen_id ORDER BY b.v DESC, e.t ASC NULLS LAST, r.record_id) AS place
                        FROM raw_record r JOIN best b USING (record_id) LEFT JOIN earlier e USING (record_id) WHERE regexp_matches(r.antigen_id, '\\S'))
        SELECT antigen_id, record_id, CAST(place AS INTEGER) AS place FROM placed WHERE place <= 10""",
    "p8_spans": f"""WITH m AS (SELECT DISTINCT i.item_id, d.doc_id, d.i AS place, d.i - i.i AS line FROM ({_RUNS('documents', 'doc_id', 'text')}) d JOIN ({_RUNS('heldout_item', 'item_id', 'item_text')}) i USING (run)),
        g AS (SELECT *, place - row_number() OVER (PARTITION BY item_id, doc_id, line ORDER BY place) AS island FROM m), r AS (SELECT item_id, doc_id, count(*) + 11 AS longest, max(place) + 10 AS last_word FROM g GROUP BY item_id, doc_id, line, island)
        SELECT item_id, doc_id, max(longest)::INTEGER AS longest, arg_min(last_word, {{'a': -longest, 'b': last_word}})::INTEGER AS last_word FROM r GROUP BY 1, 2""",
    "p8_found": f"SELECT DISTINCT i.item_id, d.doc_id FROM ({_RUNS('documents', 'doc_id', 'text')}) d JOIN ({_RUNS('heldout_item', 'item_id', 'item_text')}) i USING (run)",
}
