"""The SQL that the queries are compared with, for DuckDB."""

from __future__ import annotations

from docmetrics.operators import units
from docmetrics.operators.context import BREAK, WORDS
from docmetrics.operators.evaluate import FACTORS
from docmetrics.operators.extract import KEYWORDS
from docmetrics.schemas import METRICS

_CHAR = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_NEG = r"(?s)^(?:\((.*)\)|-(.*))$"
_SIGN = r"^(US\$|CA\$|HK\$|A\$|\$|€|£|¥|₹|₩|₣)"
_SCALE = r"(?i)(?:\b(?:trillions?|billions?|bn|millions?|mn|mm|thousands?)\s*|[kmb])$"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_CHAR}+|{_CHAR}+$', '', 'g')"


def number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {_q(_FLOAT)}) THEN TRY_CAST({x} AS DOUBLE) END"


METRIC_ROWS = "m AS (SELECT * FROM metric_records QUALIFY row_number() OVER (PARTITION BY metric_id ORDER BY extracted_at) = 1)"
CALLS = "c AS (SELECT * REPLACE (CASE WHEN NOT isnan(latency_ms) AND latency_ms >= 0 THEN latency_ms END AS latency_ms) FROM llm_calls QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY received_at) = 1)"
FIRST = "g AS (SELECT *, trim(lower(company), ' .') AS company_key FROM gt_records WHERE company IS NOT NULL AND fiscal_year IS NOT NULL QUALIFY row_number() OVER (PARTITION BY trim(lower(company), ' .'), fiscal_year ORDER BY gt_id) = 1)"
KNOWN = "k AS (" + " UNION ALL ".join(f"SELECT company_key, fiscal_year, '{f}' AS field_name, {f} AS ground_truth, unit AS ground_truth_unit FROM g" for f in METRICS) + ")"


def _errors(source: str) -> str:
    return f"""r AS (SELECT *, abs(predicted - ground_truth) AS absolute_error, predicted = ground_truth AS exact_match,
      CASE WHEN ground_truth <> 0 THEN abs(predicted - ground_truth) / abs(ground_truth) END AS relative_error FROM {source}),
    e AS (SELECT *, relative_error <= 0.005 AS within_05pct, relative_error <= 0.01 AS within_1pct, relative_error <= 0.05 AS within_5pct FROM r)"""


RESULTS = f"""{METRIC_ROWS}, {FIRST}, {KNOWN},
    u AS (SELECT DISTINCT m.extraction_id AS run_id, m.document_id, m.pipeline, f.company, f.fiscal_year FROM m JOIN filings f USING (document_id)),
    v AS (SELECT extraction_id AS run_id, field_name, CASE WHEN NOT isnan(value) THEN value END AS value, unit FROM m
          QUALIFY row_number() OVER (PARTITION BY extraction_id, field_name ORDER BY m.value DESC NULLS LAST, unit DESC NULLS LAST) = 1),
    w AS (SELECT u.*, k.company_key, k.field_name, v.value AS predicted, v.unit AS predicted_unit, k.ground_truth, k.ground_truth_unit
          FROM u JOIN k ON trim(lower(u.company), ' .') = k.company_key AND u.fiscal_year = k.fiscal_year
          LEFT JOIN v ON v.run_id = u.run_id AND v.field_name = k.field_name),
    {_errors("w")}"""
_RATIO = "predicted / nullif(ground_truth, 0)"
_SCALED = " OR ".join(f"abs(abs({_RATIO}) / {f!r} - 1.0) <= 0.05" for f, _ in FACTORS)
FAILED = f"""x AS (SELECT *, CASE WHEN predicted IS NULL THEN 'MISSING_VALUE' WHEN abs({_RATIO} / -1.0 - 1.0) <= 0.05 THEN 'SIGN_ERROR'
      WHEN predicted <> 0 AND ({_SCALED}) THEN 'UNIT_NORMALIZATION' ELSE 'NEEDS_REVIEW' END AS failure_type
      FROM e WHERE ground_truth IS NOT NULL AND (predicted IS NULL OR relative_error > 0.05)),
    y AS (SELECT *, CASE failure_type WHEN 'MISSING_VALUE' THEN 'medium' WHEN 'SIGN_ERROR' THEN 'high' WHEN 'UNIT_NORMALIZATION' THEN 'critical'
      ELSE CASE WHEN relative_error IS NULL THEN 'medium' WHEN relative_error < 0.01 THEN 'low' WHEN relative_error < 0.05 THEN 'medium'
      WHEN relative_error < 0.20 THEN 'high' ELSE 'critical' END END AS severity FROM x)"""
_COMPARABLE = "predicted IS NOT NULL AND ground_truth IS NOT NULL"


def _share(flag: str) -> str:
    return f"coalesce(count_if({flag}) / nullif(count_if({_COMPARABLE}), 0), 0.0)::DOUBLE"


ACCURACY = f"""a AS (SELECT pipeline, count(*) AS total_fields, count(predicted) AS extracted_fields, count(*) - count(predicted) AS missing_fields,
    count(predicted) / count(*) AS extraction_coverage, {_share("exact_match")} AS exact_accuracy, {_share("within_05pct")} AS accuracy_05pct,
    {_share("within_1pct")} AS accuracy_1pct, {_share("within_5pct")} AS accuracy_5pct, round(avg(relative_error), 6) AS mean_relative_error FROM e GROUP BY pipeline)"""
STATS = """count(latency_ms) AS n, round(avg(latency_ms), 6) AS mean, quantile_cont(latency_ms, 0.5) AS median,
    list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL))[least(floor(0.95::DOUBLE * count(latency_ms) + 0.5)::BIGINT, count(latency_ms) - 1) + 1] AS p95,
    min(latency_ms) AS least, max(latency_ms) AS most"""
_CLEAN = strip("regexp_replace(regexp_replace(" + strip("text") + r", '^```(?:json)?\s*', ''), '\s*```$', '')")
OBJECTS = f"""{CALLS}, o AS (SELECT *, {_CLEAN} AS cleaned, CASE WHEN json_type(TRY_CAST({_CLEAN} AS JSON)) = 'OBJECT' THEN TRY_CAST({_CLEAN} AS JSON) END AS j FROM c)"""


def _prices(rows: list[tuple]) -> str:
    body = ", ".join(f"({_q(k)}, {n}, {i}::DOUBLE, {o}::DOUBLE)" for k, n, i, o in rows)
    return f"""prices(key, ordinal, pin, pout) AS (VALUES {body}),
    pm AS (SELECT model, key, pin, pout FROM (SELECT DISTINCT model FROM llm_calls WHERE model IS NOT NULL) LEFT JOIN prices ON starts_with(model, key) OR starts_with(key, model)
           QUALIFY row_number() OVER (PARTITION BY model ORDER BY CASE WHEN model = key THEN -1 ELSE ordinal END) = 1)"""


_COST = "CASE WHEN c.input_tokens IS NOT NULL OR c.output_tokens IS NOT NULL THEN coalesce(c.input_tokens, 0) / 1000000 * pin + coalesce(c.output_tokens, 0) / 1000000 * pout END"
PAGES = "p AS (SELECT document_id, page_number, coalesce(full_text, '') AS text FROM parsed_pages WHERE document_id IS NOT NULL AND page_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, page_number ORDER BY page_id DESC) = 1)"
_HIT = "regexp_matches(lower({}), " + _q("|".join(WORDS)) + ")"
_TABLE_TEXT = "coalesce(array_to_string(list_transform(rows, lambda r: '| ' || array_to_string(list_transform(coalesce(r, []), lambda x: coalesce(x, '')), ' | ') || ' |'), chr(10)), '')"
TEXT_CONTEXT = f"""{PAGES}, tc AS (SELECT document_id, left(coalesce(string_agg(text, {_q(BREAK)} ORDER BY page_number) FILTER ({_HIT.format("text")}),
    string_agg(text, {_q(BREAK)} ORDER BY page_number)), 12000) AS context FROM p GROUP BY document_id)"""
TABLES = f"tt AS (SELECT document_id, page, table_index, {_TABLE_TEXT} AS grid FROM parsed_tables WHERE document_id IS NOT NULL AND page IS NOT NULL), th AS (SELECT * FROM tt WHERE {_HIT.format('grid')})"


def _parts(name: str, parts: str) -> str:
    return f"""{name} AS (SELECT tc.document_id, coalesce(left(q.t, 12000), tc.context) AS context FROM tc LEFT JOIN
    (SELECT document_id, string_agg(t, chr(10) || chr(10) ORDER BY a, b, c, d) AS t FROM ({parts}) GROUP BY document_id) q USING (document_id))"""


_GRID = "'[Table on page ' || page || ']' || chr(10) || grid"
LAYOUT = _parts("lc", f"""SELECT document_id, page AS a, table_index AS b, 0 AS c, 0 AS d, '[Page ' || page || ' context]' || chr(10) || left(text, 300) AS t
    FROM th JOIN p USING (document_id) WHERE p.page_number = th.page AND {strip("left(text, 300)")} <> ''
    UNION ALL SELECT document_id, page, table_index, 1, 0, {_GRID} FROM th""")
HYBRID = _parts("hc", f"""SELECT document_id, 0 AS a, page AS b, table_index AS c, 0 AS d, '[Page ' || page || ' — full text]' || chr(10) || left(text, 1500) AS t
    FROM (SELECT document_id, page, min(table_index) AS table_index FROM th GROUP BY ALL) th JOIN p USING (document_id) WHERE p.page_number = th.page
    UNION ALL SELECT document_id, 0, page, table_index, 1, {_GRID} FROM th
    UNION ALL SELECT document_id, 1, page_number, 0, 0, '[Page ' || page_number || ']' || chr(10) || left(text, 2000) FROM p
    WHERE {_HIT.format("text")} AND NOT EXISTS (SELECT 1 FROM th WHERE th.document_id = p.document_id AND th.page = p.page_number)""")
_AFTER = r"^(?:[^\n]*\n){0,2}?[\t ]*:?[\t ]*\$?([-(]?[0-9,]+(?:\.[0-9]+)?\)?)"


def _scan(source: str, keys: str) -> str:
    """(keys, field_name, value, source_text): one row for each keyword that is followed by a number, the first keyword of a field kept."""
    words = ", ".join(f"({_q(w.lower())}, {_q(f)}, {i})" for i, (w, f) in enumerate(KEYWORDS))
    found = f"instr(lower(context), word) AS pos, regexp_extract(substr(context, instr(lower(context), word) + length(word), 300), {_q(_AFTER)}, 1) AS value"
    source_text = strip("substr(context, greatest(1, pos - 20), pos + length(word) + 80 - greatest(1, pos - 20))")
    return f"""sc AS (SELECT {keys}, field_name, value, {source_text} AS source_text FROM (SELECT {keys}, context, word, field_name, k, {found}
    FROM {source}, (VALUES {words}) AS kw(word, field_name, k)) WHERE pos > 0 AND value <> '' QUALIFY row_number() OVER (PARTITION BY {keys}, field_name ORDER BY k) = 1)"""


def _normal(source: str, raw: str, keys: str) -> str:
    """Steps of the normaliser as a chain of subqueries."""
    case = lambda x: f"CASE lower({strip(x)}) " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in [("trillion", 1e12), ("trillions", 1e12), ("billion", 1e9), ("billions", 1e9), ("bn", 1e9), ("b", 1e9), ("million", 1e6), ("millions", 1e6), ("mn", 1e6), ("mm", 1e6), ("m", 1e6), ("thousand", 1e3), ("thousands", 1e3), ("k", 1e3)]) + " ELSE 1.0 END"
    signs = " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in [("US$", "USD"), ("CA$", "CAD"), ("HK$", "HKD"), ("A$", "AUD"), ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"), ("₩", "KRW"), ("₣", "CHF")])
    unsigned = lambda x: strip(rf"regexp_replace({x}, '{_NEG}', '\1\2')")
    return f"""n1 AS (SELECT {keys}, {raw} AS raw, {strip(raw)} AS t FROM {source}),
    n2 AS (SELECT *, regexp_matches(t, '{_NEG}') AS first, {unsigned("t")} AS i FROM n1),
    n3 AS (SELECT *, CASE regexp_extract(i, '{_SIGN}', 1) {signs} ELSE 'USD' END AS money, {strip(f"regexp_replace(i, '{_SIGN}', '')")} AS b FROM n2),
    n4 AS (SELECT *, {case(f"regexp_extract(b, '{_SCALE}', 0)")} AS factor, {strip(f"regexp_replace(b, '{_SCALE}', '')")} AS s FROM n3),
    n5 AS (SELECT *, first OR regexp_matches(s, '{_NEG}') AS neg, {strip(f"replace(CASE WHEN first THEN s ELSE {unsigned('s')} END, ',', '')")} AS digits FROM n4),
    n6 AS (SELECT *, {number("digits")} AS x FROM n5),
    n AS (SELECT *, CASE WHEN coalesce(t, '') = '' THEN 'empty_input' WHEN digits = '' THEN 'empty_number' WHEN x IS NULL THEN 'not_a_number' END AS error,
      CASE WHEN neg THEN -(x * factor) ELSE x * factor END AS value,
      CASE factor WHEN 1e12 THEN 'trillion ' WHEN 1e9 THEN 'billion ' WHEN 1e6 THEN 'million ' WHEN 1e3 THEN 'thousand ' ELSE '' END AS label FROM n6)"""


_CTX = f"{TEXT_CONTEXT}, {TABLES}, {LAYOUT}, {HYBRID}, fl AS (SELECT DISTINCT document_id, company, fiscal_year FROM filings WHERE fiscal_year BETWEEN 1900 AND 2100)"
EXPERIMENT = f"""{_CTX}, cx AS (SELECT x.* FROM (SELECT document_id, 'text_only' AS pipeline, context FROM tc UNION ALL SELECT document_id, 'layout_aware', context FROM lc
    UNION ALL SELECT document_id, 'hybrid', context FROM hc) x SEMI JOIN fl USING (document_id)),
    {_scan("cx", "document_id, pipeline")}, {_normal("sc", "value", "document_id, pipeline, field_name, source_text")},
    em AS (SELECT document_id, pipeline, field_name, source_text, raw AS original_value, value, 'million USD' AS unit FROM n WHERE error IS NULL)"""
EXPERIMENT_RESULTS = f"""{EXPERIMENT}, {FIRST}, {KNOWN},
    w AS (SELECT cx.document_id, cx.pipeline, k.field_name, em.value AS predicted, em.unit AS predicted_unit, k.ground_truth, k.ground_truth_unit
          FROM cx JOIN fl USING (document_id) JOIN k ON trim(lower(fl.company), ' .') = k.company_key AND fl.fiscal_year = k.fiscal_year
          LEFT JOIN em ON em.document_id = cx.document_id AND em.pipeline = cx.pipeline AND em.field_name = k.field_name), {_errors("w")}"""

#: Fields of a CSV record that is well quoted: each after a comma, quoted or without quotes.
_FIELD = r',("(?:[^"]|"")*"|[^",]*)'
_WELL = r'^(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*$'
_GROUPED = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]*)?([eE][+-]?[0-9]+)?$"
_CSV_FIELDS = ["company", "fiscal_year", *METRICS, "currency", "unit", "source"]


def _csv() -> str:
    value = {f: f"CASE WHEN starts_with(l[{i}], '\"') THEN replace(substr(l[{i}], 2, length(l[{i}]) - 2), '\"\"', '\"') ELSE l[{i}] END" for i, f in enumerate(_CSV_FIELDS, 1)}
    clean = {f: strip(value[f]) for f in _CSV_FIELDS}
    num = {f: f"CASE WHEN (regexp_matches({clean[f]}, {_q(_FLOAT)}) OR regexp_matches({clean[f]}, {_q(_GROUPED)})) AND isfinite(TRY_CAST(replace({clean[f]}, ',', '') AS DOUBLE)) THEN TRY_CAST(replace({clean[f]}, ',', '') AS DOUBLE) END" for f in METRICS}
    year = f"CASE WHEN regexp_matches({clean['fiscal_year']}, '^\\+?[0-9]{{4}}$') AND TRY_CAST({clean['fiscal_year']} AS INTEGER) BETWEEN 1900 AND 2100 THEN TRY_CAST({clean['fiscal_year']} AS INTEGER) END"
    typed = ", ".join([f"nullif({value['company']}, '') AS company", f"{year} AS fiscal_year", *[f"{num[f]} AS {f}, {clean[f]} = '' AS {f}_blank" for f in METRICS], *[f"nullif({value[f]}, '') AS {f}" for f in ("currency", "unit", "source")]])
    bad = " OR ".join(["fiscal_year IS NULL", *[f"({f} IS NULL AND NOT coalesce({f}_blank, true))" for f in METRICS]])
    return f"""c1 AS (SELECT record_id, coalesce(raw_line, '') AS raw, regexp_matches(coalesce(raw_line, ''), {_q(_WELL)}) AS well,
      regexp_extract_all(',' || coalesce(raw_line, ''), {_q(_FIELD)}, 1) AS l FROM financial_metrics_raw),
    c2 AS (SELECT record_id, well, len(l) AS n, {typed} FROM c1),
    c3 AS (SELECT *, CASE WHEN NOT well THEN 'broken_quoting' WHEN n <> 12 THEN 'column_count' WHEN {bad} THEN 'invalid_value' END AS reason FROM c2)"""


def _alone(pattern: str) -> str:
    """The pattern without look-around, for tests of whether it occurs."""
    for around, plain in (("(?<![a-z])", "(?:^|[^a-z])"), ("(?![a-z])", "(?:$|[^a-z])"), ("(?<![0-9,.])", "(?:^|[^0-9,.])"), ("(?<![0-9])", "(?:^|[^0-9])")):
        pattern = pattern.replace(around, plain)
    return pattern


def _quantities() -> str:
    """q: (metric_id, document_id, field_name, usd), from what the records state."""
    first = lambda rules, x: "CASE " + " ".join(f"WHEN regexp_matches({x}, {_q(_alone(p))}) THEN {_q(v) if isinstance(v, str) else v}" for v, p in rules) + " END"
    texts = ("original_value", "unit", "source_text")
    # spaces between figures and letters make "5m" and "kUSD" read like words; codes of currencies are cut out first
    bare = lambda c: f"regexp_replace(regexp_replace(lower({c}), {_q(units._CODES)}, ' ', 'g'), '([0-9])([a-z])', '\\1 \\2', 'g')"
    scale = "coalesce(" + ", ".join(first(units.SCALES, bare(c)) for c in texts) + ")"
    money = "coalesce(" + ", ".join(first(units.CURRENCIES, f"lower({c})") for c in ("original_value", "unit", "currency", "source_text")) + ")"
    cents = " OR ".join(f"coalesce(regexp_matches(lower({c}), {_q(_alone(units.CENTS))}), false)" for c in texts)
    raw = f"regexp_replace(regexp_extract(original_value, {_q(units.NUMBER.replace(chr(92) + 's', chr(92) + 's'))}, 0), {_q(units.SPACES)}, '', 'g')"
    minus = " OR ".join(f"regexp_matches(original_value, {_q(p)})" for p in (r"^\s*\(.*\)\s*$", r"^[^0-9]*[-−–][^0-9]*[0-9]", r"[0-9]\s*[-−–]\s*([a-zA-Z].*)?$"))
    return f"""{METRIC_ROWS}, q1 AS (SELECT *, {raw} AS raw, {money} AS money, CASE WHEN field_name = 'eps' THEN CASE WHEN {cents} THEN 0.01 ELSE 1 END ELSE coalesce({scale}, 1) END::DOUBLE AS factor FROM m),
    q2 AS (SELECT *, CASE WHEN regexp_matches(raw, ',[0-9]{{2}}$') THEN regexp_replace(left(raw, length(raw) - 3), '[.,]', '', 'g') || '.' || right(raw, 2)
      WHEN regexp_matches(raw, '^[0-9,]*\\.[0-9]+$') THEN replace(raw, ',', '') ELSE regexp_replace(raw, '[.,]', '', 'g') END AS digits FROM q1),
    q3 AS (SELECT *, CASE WHEN original_value IS NULL THEN CASE WHEN NOT isnan(value) THEN value END ELSE CASE WHEN {minus} THEN -1.0 ELSE 1.0 END * TRY_CAST(digits AS DOUBLE) END AS x FROM q2),
    q AS (SELECT metric_id, q3.document_id, field_name, x * factor * CASE WHEN money = 'USD' THEN 1.0 ELSE r.usd_per_unit END AS usd FROM q3
      LEFT JOIN (SELECT document_id, max(fiscal_year) AS fiscal_year FROM filings GROUP BY 1) f ON f.document_id = q3.document_id
      LEFT JOIN (SELECT currency, fiscal_year, max(usd_per_unit) AS usd_per_unit FROM fx_rates GROUP BY 1, 2) r ON r.currency = money AND r.fiscal_year = f.fiscal_year)"""


def _wide() -> str:
    return ", ".join(f"max(value) FILTER (field_name = '{f}' AND NOT isnan(value)) AS {f}" for f in METRICS)


def _name_parts() -> str:
    stem = r"regexp_replace(regexp_extract(filename, '[^/\\]*$', 0), '(.)\.[^.]*$', '\1')"
    left = "CASE WHEN mark <> '' THEN trim(substr(stem, 1, instr(stem, mark) - 1), '_- ') ELSE stem END"
    for s in ("10k", "10K", "AR", "annual", "report", "filing"):
        left = f"trim(replace({left}, '{s}', ''), '_- ')"
    return rf"""s1 AS (SELECT filing_id, filename, {stem} AS stem, regexp_extract({stem}, '(?:FY|fy)?(\b20[0-9]{{2}}\b)', 0) AS mark,
      TRY_CAST(regexp_extract({stem}, '(?:FY|fy)?(\b20[0-9]{{2}}\b)', 1) AS INTEGER) AS year FROM filings),
    s AS (SELECT filing_id, filename, nullif({left}, '') AS company, year AS fiscal_year FROM s1)"""


def _warnings() -> str:
    rules = [("operating_income_above_revenue", "revenue > 0 AND operating_income > revenue"), ("liabilities_above_assets", "total_assets > 0 AND total_liabilities > total_assets"), ("revenue_not_positive", "revenue <= 0")]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules) + ")"


def oracles(prices: list[tuple]) -> dict[str, str]:
    price = _prices(prices)
    csv = _csv()
    fields = ", ".join(_CSV_FIELDS)
    out = {
        "p2_found": f"WITH {csv} SELECT record_id, reason FROM c3 WHERE reason IS NOT NULL",
        "p2_loaded": f"WITH {csv} SELECT record_id, {fields} FROM c3 WHERE reason IS NULL",
        "p3_found": f"WITH {_quantities()} SELECT a.metric_id AS metric_id_a, b.metric_id AS metric_id_b FROM q a JOIN q b USING (document_id, field_name) WHERE a.metric_id < b.metric_id AND abs(a.usd - b.usd) > 0.01 * greatest(abs(a.usd), abs(b.usd))",
        "field_result": f"WITH {RESULTS} SELECT run_id, field_name, predicted, ground_truth, absolute_error, relative_error, exact_match, within_05pct, within_1pct, within_5pct FROM e",
        "failure_classify": f"WITH {RESULTS}, {FAILED} SELECT run_id, field_name, failure_type FROM y",
        "failure_severity": f"WITH {RESULTS}, {FAILED} SELECT run_id, field_name, severity FROM y",
        "failure_summary": f"WITH {RESULTS}, {FAILED} SELECT failure_type, count(*) AS failures FROM y GROUP BY ALL",
        "failure_bars": f"WITH {RESULTS}, {FAILED} SELECT failure_type, count(*) AS failures FROM y GROUP BY ALL",
        "failures_filtered": f"WITH {RESULTS}, {FAILED} SELECT run_id, document_id, field_name FROM y WHERE pipeline = 'hybrid' AND failure_type = 'UNIT_NORMALIZATION'",
        "per_field_accuracy": f"WITH {RESULTS} SELECT pipeline, field_name, count_if({_COMPARABLE}) AS comparable, {_share('within_1pct')} AS accuracy_1pct FROM e GROUP BY ALL HAVING count_if({_COMPARABLE}) > 0",
        "per_company_accuracy": f"WITH {RESULTS} SELECT company_key, count(*) AS total_fields, count(predicted) AS extracted_fields, {_share('within_1pct')} AS accuracy_1pct, {_share('within_5pct')} AS accuracy_5pct FROM e GROUP BY ALL",
        "accuracy_bars": f"WITH {RESULTS}, {ACCURACY} UNPIVOT (SELECT pipeline, exact_accuracy, accuracy_1pct, accuracy_5pct FROM a) ON exact_accuracy, accuracy_1pct, accuracy_5pct INTO NAME measure VALUE accuracy",
        "pipeline_metrics": f"""WITH {RESULTS}, {ACCURACY}, {OBJECTS}, {price},
            ru AS (SELECT x.pipeline, c.latency_ms, {_COST} AS cost, c.j IS NULL AS bad FROM o c LEFT JOIN pm USING (model) JOIN experiments x USING (experiment_id)),
            t AS (SELECT pipeline, count(*) AS document_count, round(sum(cost), 6) AS total, sum(cost) AS raw_total, round(avg(bad::INT), 6) AS validation_failure_rate, {STATS} FROM ru GROUP BY pipeline)
            SELECT pipeline, document_count, total_fields, extracted_fields, missing_fields, extraction_coverage, exact_accuracy, accuracy_05pct, accuracy_1pct, accuracy_5pct, mean_relative_error,
              mean AS mean_latency_ms, median AS median_latency_ms, p95 AS p95_latency_ms, least AS min_latency_ms, most AS max_latency_ms, total AS total_cost_usd,
              round(raw_total / document_count, 6) AS cost_per_document_usd, validation_failure_rate FROM t JOIN a USING (pipeline)""",
        "coverage": f"WITH {METRIC_ROWS}, x AS (SELECT extraction_id, count(DISTINCT field_name) FILTER (value IS NOT NULL AND field_name IN ({', '.join(map(_q, METRICS))})) AS extracted FROM m GROUP BY ALL) SELECT extraction_id, extracted, extracted / 7 AS coverage, CASE WHEN extracted = 0 THEN 'invalid' WHEN extracted < 7 THEN 'partial' ELSE 'valid' END AS status FROM x",
        "latency_stats": f"WITH {CALLS} SELECT model, {STATS} FROM c GROUP BY model HAVING count(latency_ms) > 0",
        "latency_windows": "SELECT date_trunc('hour', called_at) AS start, model, count(*) AS calls FROM (SELECT DISTINCT call_id, called_at, model FROM llm_calls WHERE called_at IS NOT NULL) GROUP BY ALL",
        "normalize_value": f"WITH {METRIC_ROWS}, {_normal('m', 'original_value', 'metric_id')} SELECT metric_id, CASE WHEN error IS NULL THEN value END AS value, CASE WHEN error IS NULL THEN trim(label || 'USD') END AS unit, CASE WHEN error IS NULL THEN money END AS currency, CASE WHEN error IS NULL THEN neg END AS is_negative, CASE WHEN error IS NULL THEN factor::DOUBLE END AS multiplier FROM n",
        "normalize_errors": f"WITH {METRIC_ROWS}, {_normal('m', 'original_value', 'metric_id')} SELECT metric_id, error FROM n WHERE error IS NOT NULL",
        "normalize_currency": f"WITH {METRIC_ROWS}, x AS (SELECT metric_id, {strip('currency')} AS c FROM m) SELECT metric_id, CASE WHEN regexp_matches(upper(c), '^[A-Z]{{3}}$') THEN upper(c) ELSE coalesce(CASE c WHEN 'US$' THEN 'USD' WHEN 'CA$' THEN 'CAD' WHEN 'HK$' THEN 'HKD' WHEN 'A$' THEN 'AUD' WHEN '$' THEN 'USD' WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' WHEN '¥' THEN 'JPY' WHEN '₹' THEN 'INR' WHEN '₩' THEN 'KRW' WHEN '₣' THEN 'CHF' END, CASE WHEN lower(c) IN ('us dollar', 'us dollars', 'dollar', 'dollars') THEN 'USD' WHEN lower(c) IN ('euro', 'euros') THEN 'EUR' WHEN lower(c) IN ('pound', 'pounds') THEN 'GBP' WHEN lower(c) IN ('rupee', 'rupees') THEN 'INR' END) END AS code FROM x",
        "normalize_unit": f"WITH {METRIC_ROWS}, x AS (SELECT metric_id, lower({strip('unit')}) AS u FROM m) SELECT metric_id, CASE WHEN u IN ('millions', 'mn', 'mm') THEN 'million' WHEN u IN ('billions', 'bn') THEN 'billion' WHEN u IN ('thousands', 'k') THEN 'thousand' ELSE u END AS unit_name FROM x",
        "numeric_cells": f"WITH {csv} SELECT record_id, revenue FROM c3 WHERE reason IS NULL",
        "ground_truth_join": f"WITH {FIRST} SELECT f.filing_id, g.gt_id, g.revenue FROM filings f LEFT JOIN g ON trim(lower(f.company), ' .') = g.company_key AND f.fiscal_year = g.fiscal_year",
        "ground_truth_first_match": f"WITH {FIRST} SELECT company_key, fiscal_year, gt_id FROM g",
        "ground_truth_fields": f"WITH {FIRST}, {KNOWN} SELECT company_key, fiscal_year, field_name, ground_truth, ground_truth_unit FROM k",
        "company_override": f"WITH {_name_parts()}, g AS (SELECT filename, max(company) AS company, max(fiscal_year) AS fiscal_year FROM filings WHERE source_url IS NOT NULL AND filename IS NOT NULL GROUP BY filename) SELECT s.filing_id, coalesce(nullif(g.company, ''), s.company, 'Unknown') AS company, coalesce(nullif(g.fiscal_year, 0), s.fiscal_year, 0)::INTEGER AS fiscal_year FROM s LEFT JOIN g USING (filename)",
        "token_estimate": "SELECT doc_id, greatest(1, floor(length(text) / 4))::BIGINT AS tokens FROM documents",
        "pricing_match": f"WITH {price} SELECT model, key FROM pm",
        "call_cost": f"WITH {CALLS}, {price} SELECT call_id, (c.input_tokens IS NOT NULL OR c.output_tokens IS NOT NULL) AND key IS NOT NULL AS priced, round({_COST}, 9) AS cost_usd FROM c LEFT JOIN pm USING (model)",
        "cost_rollup": f"WITH {CALLS}, {price}, x AS (SELECT c.*, {_COST} AS cost FROM c LEFT JOIN pm USING (model)) SELECT model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost), 6) AS cost_known_usd, CASE WHEN sum(cost) > 0 THEN round(sum(cost), 6) END AS cost_usd FROM x GROUP BY model",
        "all_text": f"WITH {PAGES} SELECT document_id, sha256(string_agg(text, chr(10) ORDER BY page_number)) AS digest, length(string_agg(text, chr(10) ORDER BY page_number)) AS n FROM p GROUP BY document_id",
        "keyword_pages": f"WITH {PAGES} SELECT document_id, page_number FROM p WHERE {_HIT.format('text')}",
        "text_context": f"WITH {TEXT_CONTEXT} SELECT document_id, context FROM tc",
        "layout_context": f"WITH {TEXT_CONTEXT}, {TABLES}, {LAYOUT} SELECT document_id, context FROM lc",
        "hybrid_context": f"WITH {TEXT_CONTEXT}, {TABLES}, {HYBRID} SELECT document_id, context FROM hc",
        "table_to_text": f"SELECT table_id, {_TABLE_TEXT} AS text FROM parsed_tables",
        "table_headers": f"""WITH x AS (SELECT table_id, list_filter(list_transform(coalesce(rows[1], []), lambda c: coalesce(c, '')), lambda c: {strip("c")} <> '') AS f FROM parsed_tables)
            SELECT table_id, coalesce(len(f) > 0 AND len(list_filter(f, lambda c: regexp_matches(regexp_replace(regexp_replace(c, '[$€£¥,%()]|{_CHAR}', '', 'g'), '^-', ''), {_q(_FLOAT)}))) * 2 < len(f), false) AS first_is_header FROM x""",
        "table_keyword": "SELECT document_id, page, table_index, table_id FROM parsed_tables WHERE document_id IS NOT NULL AND contains(lower(array_to_string(list_transform(flatten(rows), lambda c: coalesce(c, '')), ' ')), 'net income') QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY page NULLS FIRST, table_index NULLS FIRST, table_id) = 1",
        "table_grid": """WITH x AS (SELECT table_id, rows, list_max(list_transform(rows, lambda r: len(coalesce(r, [])))) AS n FROM parsed_tables)
            SELECT table_id, array_to_string(list_transform(rows, lambda r: '| ' || array_to_string(list_transform(list_resize(coalesce(r, []), n, ''), lambda c: coalesce(c, '')), ' | ') || ' |'), chr(10)) AS text FROM x WHERE n > 0""",
        "block_numbers": "SELECT document_id, page, block_index, (row_number() OVER (PARTITION BY document_id, page ORDER BY block_index) - 1)::INTEGER AS running FROM (SELECT DISTINCT document_id, page, block_index FROM text_blocks)",
        "table_counts": "SELECT document_id, count(*) AS tables, coalesce(max(table_index), 0) AS last_index FROM parsed_tables GROUP BY document_id",
        "experiment_stored": f"WITH {EXPERIMENT} SELECT left(sha256(document_id || chr(31) || pipeline), 32) AS extraction_id, field_name, value FROM em",
        "page_boxes": "SELECT b.document_id, b.page, b.block_index, CASE WHEN h.height IS NULL THEN bbox[2] ELSE h.height - bbox[2] END AS top FROM text_blocks b LEFT JOIN (SELECT document_id, page_number, max(height) AS height FROM parsed_pages GROUP BY ALL) h ON h.document_id = b.document_id AND h.page_number = b.page",
        "mock_scan": f"WITH {TEXT_CONTEXT}, {_scan('tc', 'document_id')} SELECT document_id, field_name, value, source_text FROM sc",
        "json_clean": f"WITH {OBJECTS} SELECT call_id, cleaned, j IS NOT NULL AS is_object FROM o",
        "json_map": f"WITH {OBJECTS}, f AS ({' UNION ALL '.join(f'''SELECT call_id, '{x}' AS field_name, json_extract(j, '$.{x}') AS v FROM o WHERE j IS NOT NULL''' for x in METRICS)}) SELECT call_id, field_name, TRY_CAST(v AS DOUBLE) AS value, json_extract_string(v, '$') AS original_value, 'USD' AS unit, 'USD' AS currency FROM f WHERE json_type(v) IN ('UBIGINT', 'BIGINT', 'DOUBLE')",
        "assemble_status": f"WITH {OBJECTS}, x AS (SELECT call_id, ({' + '.join(f'''coalesce(json_type(json_extract(j, '$.{x}')) <> 'NULL', false)::INT''' for x in METRICS)})::BIGINT AS extracted FROM o WHERE j IS NOT NULL) SELECT call_id, extracted, CASE WHEN extracted = 0 THEN 'invalid' WHEN extracted < 7 THEN 'partial' ELSE 'valid' END AS status FROM x",
        "keyword_occurrences": "WITH x AS (SELECT page_id, full_text AS t, unnest(list_filter(range(1, length(full_text) - 8), lambda i: substr(lower(full_text), i, 10) = 'net income')) AS i FROM parsed_pages WHERE length(full_text) >= 10) SELECT page_id, i - 1 AS position, substr(t, greatest(1, i - 250), i + 260 - greatest(1, i - 250)) AS context FROM x",
        "value_source": f"""WITH {METRIC_ROWS}, {PAGES}, a AS (SELECT metric_id, document_id, lower(original_value) AS s FROM m WHERE original_value <> ''),
            h AS (SELECT metric_id, page_number AS page, 0 AS kind, 0 AS k, {strip("substr(text, greatest(1, instr(lower(text), s) - 100), instr(lower(text), s) + length(s) + 100 - greatest(1, instr(lower(text), s) - 100))")} AS source_text FROM a JOIN p USING (document_id) WHERE contains(lower(text), s)
              UNION ALL SELECT metric_id, b.page, 1, block_index, left(b.text, 500) FROM a JOIN text_blocks b USING (document_id) SEMI JOIN p ON p.document_id = a.document_id AND p.page_number = b.page WHERE contains(lower(b.text), s)),
            b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY metric_id ORDER BY page, kind, k, source_text) = 1)
            SELECT m.metric_id, b.page, b.source_text FROM m LEFT JOIN b USING (metric_id)""",
        "content_id": "SELECT doc_id, left(sha256(text), 32) AS document_id FROM documents",
        "ingest_idempotent": "SELECT document_id, min(filename) AS filename FROM filings WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM filings WHERE page_count IS NOT NULL AND document_id IS NOT NULL) GROUP BY document_id",
        "filename_metadata": f"WITH {_name_parts()} SELECT filing_id, company, fiscal_year FROM s",
        "recent_documents": "SELECT filing_id, ingested_at FROM filings ORDER BY ingested_at DESC NULLS LAST, filing_id LIMIT 100",
        "recent_experiments": "SELECT experiment_id, started_at FROM experiments ORDER BY started_at DESC NULLS LAST, experiment_id LIMIT 10",
        "metric_validation": f"""WITH {METRIC_ROWS} SELECT metric_id, concat_ws(',', CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN 'value' END,
            CASE WHEN NOT regexp_matches(upper({strip("currency")}), '^[A-Z]{{3}}$') THEN 'currency' END, CASE WHEN confidence < 0 OR confidence > 1 OR isnan(confidence) THEN 'confidence' END,
            CASE WHEN page < 1 THEN 'page' END, CASE WHEN length(source_text) > 2000 THEN 'source_text' END) AS errors FROM m""",
        "consistency_checks": f"WITH {METRIC_ROWS}, w AS (SELECT extraction_id, {_wide()} FROM m GROUP BY ALL) SELECT extraction_id, {_warnings()} AS warnings FROM w",
        "wide_report": f"WITH {METRIC_ROWS} SELECT extraction_id, {_wide()} FROM m GROUP BY ALL",
        "experiment_metrics": f"WITH {EXPERIMENT} SELECT document_id, pipeline, field_name, value, original_value, unit FROM em",
        "experiment_reports": f"""WITH {EXPERIMENT}, w AS (SELECT document_id, pipeline, {_wide()}, count(value) AS extracted FROM em GROUP BY ALL),
            bad AS (SELECT document_id, pipeline, count(*) AS n FROM n WHERE error IS NOT NULL GROUP BY ALL)
            SELECT cx.document_id, cx.pipeline, coalesce(extracted, 0) AS extracted, CASE WHEN coalesce(extracted, 0) = 0 THEN 'invalid' WHEN extracted < 7 THEN 'partial' ELSE 'valid' END AS status,
              (coalesce(bad.n, 0) + (extracted IS NULL)::INT + CASE WHEN cx.pipeline = 'hybrid' THEN coalesce((revenue > 0 AND operating_income > revenue)::INT, 0) + coalesce((total_assets > 0 AND total_liabilities > total_assets)::INT, 0) + coalesce((revenue <= 0)::INT, 0) ELSE 0 END)::INTEGER AS n_errors
            FROM cx LEFT JOIN w USING (document_id, pipeline) LEFT JOIN bad USING (document_id, pipeline)""",
        "experiment_provenance": f"""WITH {EXPERIMENT}, a AS (SELECT document_id, pipeline, field_name, source_text AS st, lower(original_value) AS s FROM em),
            h AS (SELECT a.document_id, pipeline, field_name, page_number AS page, 0 AS kind FROM a JOIN p USING (document_id) WHERE contains(lower(p.text), s)
              UNION ALL SELECT a.document_id, pipeline, field_name, b.page, 1 FROM a JOIN text_blocks b USING (document_id) SEMI JOIN p ON p.document_id = a.document_id AND p.page_number = b.page WHERE contains(lower(b.text), s)),
            b AS (SELECT document_id, pipeline, field_name, min(page) AS page FROM h GROUP BY ALL)
            SELECT a.document_id, a.pipeline, a.field_name, b.page, a.st AS source_text FROM a LEFT JOIN b USING (document_id, pipeline, field_name)""",
        "experiment_failures": f"WITH {EXPERIMENT_RESULTS}, {FAILED} SELECT document_id, pipeline, field_name, failure_type, severity FROM y",
        "experiment_summary": f"""WITH {EXPERIMENT_RESULTS}, {ACCURACY}, d AS (SELECT pipeline, count(*) AS documents FROM cx GROUP BY ALL)
            SELECT pipeline, documents, round_even(coalesce(extraction_coverage, 0) * 100, 1) AS coverage, round_even(coalesce(exact_accuracy, 0) * 100, 1) AS exact_accuracy_pct,
              round_even(coalesce(accuracy_1pct, 0) * 100, 1) AS accuracy_1pct_pct, round_even(coalesce(accuracy_5pct, 0) * 100, 1) AS accuracy_5pct_pct FROM d LEFT JOIN a USING (pipeline)""",
    }
    return out
