"""SQL for the queries: known answers are recomputed from the tables, geometry is never re-implemented."""

from __future__ import annotations

ORDERS = """
o AS (
  SELECT o_orderkey AS key, o_custkey + 10000000 AS mb, o_orderstatus AS status, floor(o_totalprice)::BIGINT AS amount,
         year(o_orderdate) AS year, o_orderdate AS mtime, o_custkey FROM orders),
r AS (
  SELECT *, replace(format('{:,}', amount), ',', '.') AS dotted, replace(format('{:,}', amount), ',', ' ') AS spaced FROM o),
s AS (
  SELECT *, CASE key % 6 WHEN 0 THEN amount::VARCHAR WHEN 1 THEN dotted WHEN 2 THEN spaced WHEN 3 THEN '(' || amount || ')'
                         WHEN 4 THEN amount || '-' ELSE dotted || ',00' END AS raw,
         CASE WHEN key % 6 IN (3, 4) THEN -amount ELSE amount END AS signed,
         CASE WHEN key % 3 = 0 THEN -(amount % 100000) ELSE amount % 100000 END AS capital FROM r)"""

ENTRIES = """
e AS (
  SELECT key, mb, year, mtime, unnest(CASE status WHEN 'F' THEN ['bu'] WHEN 'O' THEN ['bs'] ELSE ['bu', 'bs'] END) AS form_type,
         'in/' || key || '.pdf' AS path, amount, capital, signed FROM s),
l AS (
  SELECT *, row_number() OVER (PARTITION BY mb, form_type ORDER BY CASE WHEN year >= 2000 THEN year ELSE 0 END DESC, mtime DESC, path) AS n FROM e)"""

ROSTER = """
roster AS (
  SELECT c_custkey + 2 AS row_index, CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN '0' || (c_custkey + 10000000)
         ELSE (c_custkey + 10000000)::VARCHAR END AS mb, c_custkey + 10000000 AS mb_key,
         CASE WHEN c_custkey % 5 = 0 THEN c_custkey * 10 END AS revenue FROM customer)"""

#: A whole run: e and l over all orders, one row per roster row with what each form gives.
RUN = (
    "WITH "
    + ORDERS
    + ","
    + ENTRIES
    + ","
    + ROSTER
    + """,
notes AS (
  SELECT mb, string_agg(note, ' | ' ORDER BY form_type, ord) AS notes FROM (
    SELECT b.mb AS mb, b.form_type AS form_type, b.ord AS ord,
           'Multiple ' || upper(b.form_type) || ' forms detected for MB ' || b.mb || '. Selection is based on period and modification time. Candidates: '
           || string_agg(a.path, ', ' ORDER BY CASE WHEN a.year >= 2000 THEN a.year ELSE 0 END DESC, a.mtime DESC, a.ord) AS note
    FROM (SELECT *, row_number() OVER (PARTITION BY mb, form_type ORDER BY path) AS ord FROM e) b
    JOIN (SELECT *, row_number() OVER (PARTITION BY mb, form_type ORDER BY path) AS ord FROM e) a
      ON a.mb = b.mb AND a.form_type = b.form_type AND a.ord <= b.ord
    WHERE b.ord > 1 GROUP BY b.mb, b.form_type, b.ord) GROUP BY mb),
j AS (
  SELECT roster.*, bu.key AS bu, bs.key AS bs, bu.signed AS new_revenue, 2 * bs.amount AS new_assets,
         CASE WHEN bs.capital < 0 THEN -bs.capital WHEN bs.key IS NOT NULL THEN 0 END AS new_loss, bs.capital, notes.notes AS index_notes
  FROM roster LEFT JOIN l bu ON roster.mb <> '' AND bu.mb = mb_key AND bu.form_type = 'bu' AND bu.n = 1
  LEFT JOIN l bs ON roster.mb <> '' AND bs.mb = mb_key AND bs.form_type = 'bs' AND bs.n = 1
  LEFT JOIN notes ON roster.mb = notes.mb::VARCHAR),
x AS (
  SELECT *, mb <> '' AND revenue IS NULL AND bu IS NULL AS missing_bu, mb <> '' AND bs IS NULL AS missing_bs,
         mb <> '' AND revenue IS NULL AS wants_revenue FROM j)"""
)

LOSS_NOTE = (
    "'WARNING diagnostic_value_source: Value derived from capital AOP 0401 using the prescribed formula (aop_code=0401, capital_value=' || capital"
    " || ', computed_value=' || new_loss || ', source=capital_formula)'"
)

SQL = {
    "parse_amounts": f"WITH {ORDERS} SELECT key, raw, signed AS value, signed::VARCHAR AS normalized, NULL::VARCHAR AS error FROM s",
    "fold_tokens": """
        WITH f AS (SELECT c_custkey, translate(concat_ws(' ', c_name, c_mktsegment), 'ABCEHhKkMmOPTtXYaceopxyJj', 'АВСЕНнКкМмОРТтХУасеорхуЈј') AS folded FROM customer)
        SELECT c_custkey, folded, regexp_replace(lower(folded), '[^\\p{L}\\p{N}]', '', 'g') AS token FROM f""",
    "norm_headers": """
        SELECT p_partkey, regexp_replace(lower(' ' || p_name || '.: ' || p_type || ';-'), '[\\s.:;\\-]+', '', 'g') AS header,
               trim(' ' || p_name || '.: ' || p_type || ';-') AS stripped FROM part""",
    "norm_ids": """
        WITH d AS (SELECT c_custkey, lower(c_mktsegment) AS form_type, '00' || c_custkey || c_nationkey AS roster_id FROM customer)
        SELECT c_custkey, roster_id, coalesce(nullif(ltrim(roster_id, '0'), ''), roster_id) AS index_id, form_type FROM d""",
    "detect_ids": f"""
        WITH {ORDERS},
        d AS (SELECT 'd' || doc_id AS doc, regexp_extract(coalesce(text, ''), '(?:^|[^0-9])([0-9]{{8,9}})(?:[^0-9]|$)', 1) AS digits FROM documents)
        SELECT doc, CASE WHEN digits <> '' THEN coalesce(nullif(ltrim(digits, '0'), ''), digits) END AS mb_key FROM d
        UNION ALL SELECT 'o' || key, mb::VARCHAR FROM s""",
    "detect_years": """
        SELECT doc_id, list_max(list_transform(regexp_extract_all(coalesce(text, ''), '20[0-9]{2}'), lambda y: y::INT)) AS year,
               list_max(list_filter(list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+'), lambda y: length(y) = 4), lambda y: y::INT), lambda y: y >= 2000)) AS standalone_year
        FROM documents""",
    "detect_forms": "SELECT o_orderkey::VARCHAR AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'bu' WHEN 'O' THEN 'bs' ELSE 'bu,bs' END AS forms FROM orders",
    "latest_document": f"WITH {ORDERS}, {ENTRIES} SELECT mb::VARCHAR AS mb_key, form_type, key::VARCHAR AS doc_id, CASE WHEN year >= 2000 THEN year END::INT AS year FROM l WHERE n = 1",
    "roster_join": f"""
        WITH {ORDERS}, {ENTRIES}, {ROSTER}
        SELECT row_index, f.form_type, l.key::VARCHAR AS doc_id FROM roster, (VALUES ('bu'), ('bs')) f(form_type)
        LEFT JOIN l ON l.mb = mb_key AND l.form_type = f.form_type AND n = 1 WHERE roster.mb <> ''""",
    "missing_documents": f"""
        WITH {ORDERS}, {ENTRIES}, {ROSTER}
        SELECT row_index, roster.mb, f.form_type FROM roster, (VALUES ('bu'), ('bs')) f(form_type)
        WHERE roster.mb <> '' AND NOT EXISTS (SELECT 1 FROM e WHERE e.mb = mb_key AND e.form_type = f.form_type)""",
    "duplicate_notes": f"""
        WITH {ORDERS}, {ENTRIES}, k AS (SELECT *, row_number() OVER (PARTITION BY mb, form_type ORDER BY path) AS ord FROM e)
        SELECT b.mb::VARCHAR AS mb_key, b.form_type, b.ord,
               'Multiple ' || upper(b.form_type) || ' forms detected for MB ' || b.mb || '. Selection is based on period and modification time. Candidates: '
               || string_agg(a.path, ', ' ORDER BY CASE WHEN a.year >= 2000 THEN a.year ELSE 0 END DESC, a.mtime DESC, a.ord) AS note
        FROM k b JOIN k a ON a.mb = b.mb AND a.form_type = b.form_type AND a.ord <= b.ord WHERE b.ord > 1 GROUP BY b.mb, b.form_type, b.ord""",
    "registrations": f"""
        WITH {ORDERS}, {ENTRIES}, k AS (SELECT *, row_number() OVER (PARTITION BY mb, form_type ORDER BY path) AS ord, count(*) OVER (PARTITION BY mb, form_type) AS all_ FROM l)
        SELECT mb::VARCHAR AS mb_key, form_type, all_ AS n, ord, n AS place, path FROM k WHERE all_ > 1""",
    "rejected_amounts": f"""
        WITH {ORDERS}, spoilt AS (
          SELECT key, amount, CASE key % 8 WHEN 0 THEN amount || ',5' WHEN 1 THEN 'n/a' WHEN 2 THEN amount || 'x4' WHEN 3 THEN amount || ',5x' WHEN 4 THEN '9' || repeat('0', 20) || amount
                        WHEN 5 THEN NULL WHEN 6 THEN '-' || amount ELSE amount || '00000000' END AS raw FROM s)
        SELECT key, raw, CASE WHEN key % 8 = 7 AND amount <= 99999 THEN amount * 100000000 END AS value,
               CASE key % 8 WHEN 0 THEN 'Non-integer value encountered: ''' || raw || '''' WHEN 1 THEN 'No digits detected in ''n/a''' WHEN 2 THEN 'Invalid integer component in ''' || raw || ''''
                        WHEN 3 THEN 'Invalid decimal component in ''' || raw || '''' WHEN 4 THEN 'Value out of range: ''' || raw || '''' WHEN 5 THEN 'No value supplied'
                        WHEN 6 THEN 'Value -' || amount || ' is below the permitted minimum of 0'
                        ELSE CASE WHEN amount > 99999 THEN 'Value ' || amount || '00000000 exceeds the permitted maximum of 9999900000000' END END AS error FROM spoilt""",
    "lines_from_words": f"""
        WITH {ORDERS}, p AS (SELECT *, (amount + 1)::VARCHAR AS before, CASE WHEN key % 6 = 2 THEN length(spaced) - length(replace(spaced, ' ', '')) ELSE 0 END AS gaps FROM s)
        SELECT key, 1::BIGINT AS line, 'Текућа година Претходна година' AS text, 440::BIGINT AS box_left, 40::BIGINT AS box_top, 836::BIGINT AS box_right, 60::BIGINT AS box_bottom FROM p
        UNION ALL SELECT key, 2, 'Пословни приходи 1001 ' || raw || ' ' || before, 20, 100, 796, 120 FROM p
        UNION ALL SELECT key, 3, 'Укупна актива 0059 ' || (amount * 2) || ' ' || before, 20, 160, 796, 180 FROM p
        UNION ALL SELECT key, 4, 'A. КАПИТАЛ 0401 ' || capital || ' ' || before, 20, 220, 796, 240 FROM p""",
    "page_confidence": f"""
        WITH {ORDERS}, n AS (SELECT key, 19 + CASE WHEN key % 6 = 2 THEN length(spaced) - length(replace(spaced, ' ', '')) ELSE 0 END AS words FROM s),
        w AS (SELECT key, unnest(range(words)) AS pos FROM n)
        SELECT key, 1 AS page, round(avg(CASE WHEN pos % 7 <> 6 THEN 50 + pos * 13 % 50 END), 6) AS confidence FROM w GROUP BY key""",
    "doc_confidence": "SELECT l_orderkey AS doc_id, round(avg(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END), 6) AS average_confidence FROM lineitem GROUP BY l_orderkey",
    "numeric_clusters": f"""
        WITH {ORDERS}, p AS (SELECT *, (amount + 1)::VARCHAR AS before, CASE WHEN key % 6 = 2 THEN length(spaced) - length(replace(spaced, ' ', '')) ELSE 0 END AS gaps FROM s),
        c AS (
          SELECT key, unnest([
            {{'n': 1, 't': '1001', 'l': 300, 'r': 336}}, {{'n': 2, 't': raw, 'l': 440, 'r': 476 + 40 * gaps}}, {{'n': 3, 't': before, 'l': 760, 'r': 796}},
            {{'n': 4, 't': '0059', 'l': 300, 'r': 336}}, {{'n': 5, 't': (amount * 2)::VARCHAR, 'l': 440, 'r': 476}}, {{'n': 6, 't': before, 'l': 760, 'r': 796}},
            {{'n': 7, 't': '0401', 'l': 300, 'r': 336}}, {{'n': 8, 't': capital::VARCHAR, 'l': 440, 'r': 476}}, {{'n': 9, 't': before, 'l': 760, 'r': 796}}]) AS u FROM p)
        SELECT key, u.n::BIGINT AS cluster, u.t AS text, u.l::BIGINT AS left, u.r::BIGINT AS right FROM c""",
    "column_bands": f"""
        WITH {ORDERS}, p AS (SELECT *, (amount + 1)::VARCHAR AS before, CASE WHEN key % 6 = 2 THEN length(spaced) - length(replace(spaced, ' ', '')) ELSE 0 END AS gaps FROM s)
        SELECT key, 0::BIGINT AS band, 20::BIGINT AS left, 96::BIGINT AS right, concat_ws(chr(10), 'Пословни приходи', 'Укупна актива', 'A. КАПИТАЛ') AS text FROM p
        UNION ALL SELECT key, 1, 300, 336, concat_ws(chr(10), '1001', '0059', '0401') FROM p
        UNION ALL SELECT key, 2, 440, greatest(516, 476 + 40 * gaps), concat_ws(chr(10), 'Текућа година', raw, (amount * 2)::VARCHAR, capital::VARCHAR) FROM p
        UNION ALL SELECT key, 3, 760, 836, concat_ws(chr(10), 'Претходна година', before, before, before) FROM p""",
    "year_columns": "SELECT o_orderkey AS key, 440::BIGINT AS current_left, 516::BIGINT AS current_right, 40::BIGINT AS current_top, 760::BIGINT AS previous_left, 836::BIGINT AS previous_right, 40::BIGINT AS previous_top FROM orders",
    "carry_forward": """
        WITH h AS (SELECT o_orderkey AS key, unnest([1, 2, 3])::BIGINT AS page FROM orders),
        c AS (SELECT *, CASE WHEN page = 1 THEN 440 WHEN page = 3 AND key % 2 = 0 THEN 448 END AS own FROM h)
        SELECT key, page, last_value(own IGNORE NULLS) OVER w::BIGINT AS current_left, last_value(CASE WHEN own IS NOT NULL THEN page END IGNORE NULLS) OVER w AS from_page,
               page = 3 AND key % 2 = 0 AS no_previous FROM c WINDOW w AS (PARTITION BY key ORDER BY page)""",
    "extract_revenue": f"WITH {ORDERS} SELECT key, signed AS value, raw AS raw_text, 'current' AS column_label, 0::BIGINT AS n_errors FROM s",
    "extract_assets": f"WITH {ORDERS} SELECT key, 2 * amount AS value, (2 * amount)::VARCHAR AS raw_text, 'current' AS column_label, 0::BIGINT AS n_errors FROM s",
    "extract_capital_loss": f"WITH {ORDERS} SELECT key, CASE WHEN capital < 0 THEN -capital ELSE 0 END AS value, 1::BIGINT AS n_warnings, 'capital_formula' AS source FROM s",
    "fallback_column": f"WITH {ORDERS} SELECT key, amount AS value, amount::VARCHAR AS raw_text, CASE WHEN amount BETWEEN 2000 AND 9999 THEN 'current' ELSE 'previous' END AS column_label, 0::BIGINT AS n_errors, CASE WHEN amount BETWEEN 2000 AND 9999 THEN NULL ELSE 'column_fallback_used' END AS warning FROM s",  # an amount of four digits is taken for the year, and its own word for that year's header
    "aop_fallback": f"WITH {ORDERS} SELECT key, amount AS value, amount::VARCHAR AS raw_text, 'current' AS column_label, 0::BIGINT AS n_errors FROM s",
    "multiline_anchor": f"WITH {ORDERS} SELECT key, amount AS value, amount::VARCHAR AS raw_text, 'current' AS column_label, 0::BIGINT AS n_errors FROM s",
    "upsert_results": RUN + " SELECT row_index, mb, coalesce(revenue, new_revenue) AS revenue, new_assets AS assets, new_loss AS capital_loss FROM x",
    "exceptions_report": RUN
    + f"""
        , t AS (
          SELECT *, concat_ws(',', CASE WHEN missing_bs THEN 'assets,capital_loss' END, CASE WHEN missing_bu THEN 'revenue' END) AS fields,
                 CASE WHEN mb = '' THEN 'Excel row is missing Матични број' ELSE concat_ws(' | ', index_notes, CASE WHEN missing_bu THEN 'No BU PDF found for MB ' || mb END,
                   CASE WHEN missing_bs THEN 'No BS PDF found for MB ' || mb END, CASE WHEN bs IS NOT NULL THEN {LOSS_NOTE} END) END AS notes FROM x)
        SELECT row_index, CASE WHEN mb = '' THEN '<missing>' ELSE mb END AS "MB", CASE WHEN missing_bu THEN 'yes' ELSE 'no' END AS missing_bu,
               CASE WHEN missing_bs THEN 'yes' ELSE 'no' END AS missing_bs, fields AS missing_fields, notes FROM t WHERE notes <> ''""",
    "run_stats": RUN
    + """
        , w AS (SELECT *, (CASE WHEN wants_revenue AND bu IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN mb <> '' AND bs IS NOT NULL THEN 2 ELSE 0 END) AS written FROM x)
        SELECT count(*) AS rows_total, count(*) FILTER (mb <> '') AS rows_with_mb, count(*) FILTER (written > 0) AS rows_with_updates, sum(written)::BIGINT AS values_written,
               count(*) FILTER (mb <> '' AND revenue IS NOT NULL) AS values_skipped, count(*) FILTER (missing_bu) AS missing_revenue,
               count(*) FILTER (missing_bs) AS missing_assets, count(*) FILTER (missing_bs) AS missing_capital_loss FROM w""",
    "content_hash_dedup": """
        WITH d AS (SELECT doc_id, sha1(coalesce(text, '')) AS key FROM documents)
        SELECT key, count(*) AS copies, min(doc_id) AS first_doc FROM d WHERE key NOT IN (SELECT key FROM d WHERE doc_id % 5 = 0) GROUP BY key""",
    "retry_best_of": """
        WITH a AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS attempt, max(l_quantity * 2) AS confidence FROM lineitem GROUP BY ALL),
        b AS (SELECT *, coalesce(max(confidence) OVER (PARTITION BY doc_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM a),
        c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, attempt) AS n FROM b WHERE so_far < 70)
        SELECT doc_id, attempt, confidence FROM c WHERE n = 1""",
    "parse_tsv": """
        SELECT c_custkey AS doc_id, 0::BIGINT AS pos, '5' AS level, c_custkey::VARCHAR AS left, c_name AS text FROM customer
        UNION ALL SELECT c_custkey, 1, '4', c_custkey::VARCHAR, '' FROM customer""",
    "page_limit": "SELECT l_orderkey AS doc_id, count(*) AS n_pages, max(l_linenumber)::BIGINT AS last_page FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey",
    "first_lines": """
        WITH p AS (SELECT doc_id, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))[1:5] AS parts FROM documents)
        SELECT doc_id, (unnest(range(1, len(parts) + 1)) - 1)::BIGINT AS ord, unnest(parts) AS text FROM p""",
    "cache_merge": "WITH e AS (SELECT user_id AS key, props AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, ts DESC) AS n FROM events) SELECT key, payload FROM e WHERE n = 1",
}
