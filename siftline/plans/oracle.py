"""The catalogue's queries as plain SQL, to check results against another engine."""

from __future__ import annotations

from siftline.config import (
    CLASS_LABELS,
    DEFAULT_RUBRIC,
    DISTRIBUTION_HEADERS,
    HISTOGRAM_HEADERS,
    NEUTRAL_REASON,
    REVIEW_HEADERS,
)
from siftline.plans.catalog import JUNK_TEST_PHRASES, MANY_PHRASES, VIP_TEST_PHRASES


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _first(phrases: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN contains(t, {_quote(p)}) THEN {_quote(p)}" for p in phrases)
    return f"CASE {cases} END"


LEADS = {
    "documents": """SELECT CAST(doc_id AS VARCHAR) AS id, source AS ten_khach, lang AS sdt,
        text AS nhu_cau_mo_ta FROM documents""",
    "conversations": """SELECT CAST(conv_id AS VARCHAR) AS id, role AS ten_khach,
        CAST(turn AS VARCHAR) AS sdt, text AS nhu_cau_mo_ta FROM conversations""",
    "pages": "SELECT CAST(page_id AS VARCHAR) AS id, url AS ten_khach, html AS nhu_cau_mo_ta FROM pages",
}


def _scored(table: str = "documents") -> str:
    """CTEs: leads, hits (vip, junk per row), scored (with all lead columns)."""
    return f"""WITH leads AS ({LEADS[table]}),
    hits AS (SELECT *, {_first(VIP_TEST_PHRASES)} AS vip, {_first(JUNK_TEST_PHRASES)} AS junk
        FROM (SELECT *, lower(coalesce(nhu_cau_mo_ta, '')) AS t FROM leads)),
    wide AS (SELECT *,
        CAST(CASE WHEN junk IS NOT NULL THEN -50 WHEN vip IS NOT NULL THEN 50 ELSE 10 END AS DOUBLE) AS score,
        CASE WHEN junk IS NOT NULL THEN 'JUNK' WHEN vip IS NOT NULL THEN 'HOT' ELSE 'WARM' END AS classification,
        concat_ws('; ', 'VIP: Chứa từ khóa ''' || vip || '''', 'Rác: Chứa từ khóa ''' || junk || '''',
            CASE WHEN vip IS NULL AND junk IS NULL THEN {_quote(NEUTRAL_REASON)} END) AS reason
        FROM hits),
    scored AS (SELECT id, score, classification, reason FROM wide),
    final AS (SELECT l.*, s.score, s.classification, s.reason FROM leads l
        LEFT JOIN scored s ON l.id IS NOT DISTINCT FROM s.id)"""


LABELS = """labels_scored AS (SELECT CAST(doc_id AS VARCHAR) AS id,
        CAST(CASE WHEN toxic = 1 THEN -50 WHEN quality = 1 THEN 50 ELSE 10 END AS DOUBLE) AS score,
        CASE WHEN toxic = 1 THEN 'JUNK' WHEN quality = 1 THEN 'HOT' ELSE 'Warm' END AS classification,
        'label ' || CAST(quality AS VARCHAR) AS reason FROM labels)"""

GAPS = f"""WITH leads AS ({LEADS["documents"]}), {LABELS},
    final AS (SELECT l.*, s.score, s.classification, s.reason FROM leads l
        LEFT JOIN labels_scored s ON l.id = s.id)"""

KPIS = """SELECT CAST(count(*) AS BIGINT) AS total,
    CAST(count(*) FILTER (WHERE classification = 'HOT') AS BIGINT) AS hot,
    CAST(count(*) FILTER (WHERE classification = 'WARM') AS BIGINT) AS warm,
    CAST(count(*) FILTER (WHERE classification = 'JUNK') AS BIGINT) AS junk,
    coalesce(CAST(count(*) FILTER (WHERE classification IN ('HOT', 'WARM')) AS DOUBLE)
        / nullif(count(*), 0) * 100, 0.0) AS potential_rate FROM final"""

CLASS_COUNTS = """SELECT classification, CAST(count(*) AS BIGINT) AS n FROM final
    WHERE classification IS NOT NULL GROUP BY classification"""

HISTOGRAM = "SELECT score, CAST(count(*) AS BIGINT) AS n FROM final WHERE score IS NOT NULL GROUP BY score"

_LABEL_ROWS = ", ".join(f"({_quote(c)}, {_quote(label)})" for c, label in CLASS_LABELS.items())
DISTRIBUTION = f"""SELECT label, CAST(count(final.classification) AS BIGINT) AS n
    FROM (VALUES {_LABEL_ROWS}) AS d(class, label)
    LEFT JOIN final ON final.classification = d.class GROUP BY label"""

DIRTY = """SELECT CAST(doc_id AS VARCHAR) AS id,
    CASE WHEN doc_id % 3 <> 0 THEN source END AS ten_khach,
    CASE WHEN doc_id % 4 <> 0 THEN lang END AS sdt,
    CASE WHEN doc_id % 7 <> 0 THEN text END AS nhu_cau_mo_ta,
    CASE doc_id % 12 WHEN 0 THEN n_chars || '' WHEN 1 THEN ' ' || n_chars || ' ' WHEN 2 THEN '-' || n_chars || '.9'
        WHEN 3 THEN n_chars || 'e1' WHEN 4 THEN n_chars || 'd' WHEN 5 THEN n_chars || 'e400'
        WHEN 6 THEN n_chars || '000000000' WHEN 7 THEN '.' || n_chars WHEN 8 THEN '' WHEN 9 THEN 'nan'
        WHEN 10 THEN lang END AS score,
    CASE doc_id % 5 WHEN 0 THEN 'HOT' WHEN 1 THEN 'Hot' WHEN 2 THEN 'JUNK' WHEN 3 THEN 'WARM' END AS classification,
    CASE WHEN doc_id % 6 <> 0 THEN source END AS reason FROM documents"""

NUMBER = r"""CASE WHEN regexp_full_match(score, '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')
    THEN TRY_CAST(trim(score) AS DOUBLE) END"""

REPAIRED = f"""SELECT id, coalesce(ten_khach, '') AS ten_khach, coalesce(sdt, '') AS sdt,
    coalesce(nhu_cau_mo_ta, '') AS nhu_cau_mo_ta,
    CAST(CASE WHEN abs(x) < 9223372036854775808 THEN trunc(x) ELSE 10 END AS BIGINT) AS score,
    CASE WHEN classification IN ('HOT', 'WARM', 'JUNK') THEN classification ELSE 'WARM' END AS classification,
    coalesce(reason, {_quote(NEUTRAL_REASON)}) AS reason FROM (SELECT *, {NUMBER} AS x FROM ({DIRTY}))"""

RECORD = "{'id': CAST(doc_id AS VARCHAR), 'score': CAST(n_chars AS VARCHAR), 'classification': lang, 'reason': text}"

STRIPPED = f"""SELECT CAST(doc_id AS BIGINT) AS batch_id,
    CASE WHEN doc_id % 6 < 3 THEN CAST(to_json([{RECORD}]) AS VARCHAR)
        WHEN doc_id % 6 = 3 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g')
        WHEN doc_id % 6 = 4 THEN CAST(to_json({RECORD}) AS VARCHAR)
        ELSE CAST(to_json([{RECORD}]) AS VARCHAR) || ' and so on' END AS text FROM documents"""

PLACED = """WITH placed AS (SELECT *, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 20 AS BIGINT) AS batch_id,
    CAST((row_number() OVER (ORDER BY doc_id) - 1) % 20 AS INTEGER) AS pos FROM documents)"""

REQUESTS = f"""{PLACED},
    requests AS (SELECT batch_id, CAST(count(*) AS BIGINT) AS n_leads,
        CAST(to_json(list({{'id': CAST(doc_id AS VARCHAR), 'nhu_cau_mo_ta': text}} ORDER BY pos)) AS VARCHAR) AS payload
        FROM placed GROUP BY batch_id)"""

# What the stub scorer does with a batch, by its first lead.
SHAPES = f"""{PLACED},
    shapes AS (SELECT batch_id, min_by(doc_id, pos) AS first_id, min_by(doc_id, pos) // 20 % 4 AS shape,
        CAST(count(*) AS BIGINT) AS n_leads,
        list({{'id': CAST(doc_id AS VARCHAR), 'score': length(text),
            'classification': CASE WHEN length(text) > 500 THEN 'HOT' ELSE 'WARM' END,
            'reason': 'len ' || length(text)}} ORDER BY pos) AS records
        FROM placed GROUP BY batch_id)"""

_STUB_ERROR = "'RuntimeError: no answer for ' || first_id"

MODEL = f"""{_scored()}, {SHAPES.removeprefix("WITH ")},
    model AS (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(length(text) AS DOUBLE) AS score,
            CASE WHEN length(text) > 500 THEN 'HOT' ELSE 'WARM' END AS classification,
            'len ' || length(text) AS reason
            FROM placed JOIN shapes USING (batch_id) WHERE shape IN (1, 3)),
    fallback AS (SELECT scored.* FROM scored JOIN placed ON scored.id = CAST(placed.doc_id AS VARCHAR)
            JOIN shapes USING (batch_id) WHERE shape IN (0, 2))"""

HANDOVER = """SELECT id, ten_khach, sdt, nhu_cau_mo_ta, CAST(score AS BIGINT) AS score, classification, reason,
    CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS BIGINT) AS place FROM final"""

EDITS = f"""{_scored()},
    review AS (SELECT CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS BIGINT) AS row_id, id, ten_khach,
        sdt, nhu_cau_mo_ta, CAST(score AS BIGINT) AS score, classification, reason FROM final),
    edits AS (SELECT * FROM (SELECT CASE row_id % 20 WHEN 17 THEN -row_id ELSE row_id END AS row_id,
        CASE row_id % 10 WHEN 0 THEN 'delete' WHEN 3 THEN 'insert' WHEN 5 THEN 'merge' WHEN 6 THEN NULL ELSE 'update' END AS op,
        CASE WHEN row_id % 10 = 3 OR row_id % 20 = 18 THEN 'new-' || id END AS id,
        CASE row_id % 10 WHEN 1 THEN upper(ten_khach) WHEN 3 THEN ten_khach END AS ten_khach,
        CASE row_id % 10 WHEN 3 THEN nhu_cau_mo_ta END AS nhu_cau_mo_ta,
        CASE row_id % 20 WHEN 7 THEN '50.0' WHEN 8 THEN '1e2' WHEN 9 THEN '9000000000' WHEN 19 THEN '1e19'
            ELSE CASE row_id % 10 WHEN 1 THEN '77' WHEN 3 THEN '10' WHEN 4 THEN '1.5' END END AS score,
        CASE row_id % 10 WHEN 1 THEN 'HOT' WHEN 2 THEN 'Hot' WHEN 3 THEN 'WARM' END AS classification,
        CASE row_id % 10 WHEN 1 THEN 'seen ' || id END AS reason,
        CASE row_id % 20 WHEN 8 THEN 'sdt' END AS cleared FROM review) WHERE op IS NOT NULL),
    checked AS (SELECT *, CASE WHEN op = 'merge' THEN 'unknown operation' WHEN row_id < 0 THEN 'unknown row'
        WHEN score IN ('1.5', '1e19') THEN 'score is no integer' WHEN classification = 'Hot' THEN 'unknown class'
        WHEN op = 'update' AND id IS NOT NULL THEN 'locked column' END AS rejected FROM edits),
    valid AS (SELECT * EXCLUDE (rejected) FROM checked WHERE rejected IS NULL),
    edited AS (
        SELECT r.row_id, r.id, coalesce(e.ten_khach, r.ten_khach) AS ten_khach,
            CASE WHEN e.cleared IS NULL THEN r.sdt END AS sdt, r.nhu_cau_mo_ta,
            coalesce(CAST(CAST(e.score AS DOUBLE) AS BIGINT), r.score) AS score,
            coalesce(e.classification, r.classification) AS classification, coalesce(e.reason, r.reason) AS reason
        FROM review r LEFT JOIN valid e ON r.row_id = e.row_id AND e.op IN ('update', 'delete')
        WHERE e.op IS NULL OR e.op <> 'delete'
        UNION ALL
        SELECT NULL, id, ten_khach, NULL, nhu_cau_mo_ta, CAST(score AS BIGINT), classification, reason
        FROM valid WHERE op = 'insert')"""

SCORED_COLUMNS = "id, score, classification, reason"


def _renamed(sql: str, headers: dict[str, str]) -> str:
    columns = ", ".join(f'{old} AS "{new}"' for old, new in headers.items())
    return f"SELECT {columns} FROM ({sql})"


def oracle_sql() -> dict[str, str]:
    docs, talks = _scored(), _scored("conversations")
    leads = f"SELECT * FROM ({LEADS['documents']})"
    numbered = """SELECT CAST(row_number() OVER (ORDER BY doc_id) AS VARCHAR) AS id, doc_id, lang AS sdt FROM documents"""
    return {
        # sources and sinks
        "read_leads": leads,
        "read_leads_csv": leads,
        "require_rows": leads,
        "ensure_id": numbered,
        "ensure_id_stored_order": numbered,
        "ensure_id_csv": numbered,
        "ensure_id_filtered": f"{numbered} WHERE lang = 'en'",
        "assign_batches_csv": f"{PLACED} SELECT doc_id, batch_id, pos FROM placed",
        "assign_batches_filtered": f"""{PLACED.replace("FROM documents", "FROM documents WHERE lang = 'en'")}
            SELECT doc_id, batch_id, pos FROM placed""",
        "materialize": f"{docs} SELECT {SCORED_COLUMNS} FROM scored",
        "export_handover": f"{docs} {HANDOVER}",
        "export_handover_csv": f"{docs} {HANDOVER}",
        "row_count": "SELECT CAST(count(*) AS BIGINT) AS n FROM documents",
        # projections
        "normalize_text": f"SELECT id, lower(coalesce(nhu_cau_mo_ta, '')) AS text FROM ({LEADS['documents']})",
        "first_keyword": f"{docs} SELECT id, vip, junk FROM hits",
        "first_keyword_many": f"""SELECT id, {_first(MANY_PHRASES)} AS hit
            FROM (SELECT id, lower(coalesce(nhu_cau_mo_ta, '')) AS t FROM ({LEADS['documents']}))""",
        "rule_score": f"{docs} SELECT id, CAST(score AS INTEGER) AS score FROM wide",
        "classify": f"{docs} SELECT id, classification FROM wide",
        "reason_text": f"{docs} SELECT id, reason FROM wide",
        "score_leads": f"{docs} SELECT * FROM scored",
        "score_leads_pages": f"{_scored('pages')} SELECT * FROM scored",
        "score_inline": f"{docs} SELECT id, ten_khach, sdt, nhu_cau_mo_ta, score, classification, reason FROM wide",
        "prune_for_model": f"SELECT id, nhu_cau_mo_ta FROM ({LEADS['documents']})",
        "to_json_payload": f"""SELECT id, CAST(to_json([{{'id': id, 'nhu_cau_mo_ta': nhu_cau_mo_ta}}]) AS VARCHAR) AS payload
            FROM ({LEADS['documents']})""",
        "strip_fence": STRIPPED,
        "parse_scores": """SELECT CAST(doc_id AS BIGINT) AS batch_id,
            CAST(CASE WHEN doc_id % 6 < 3 THEN 1 END AS INTEGER) AS n FROM documents""",
        "flatten_scores": """SELECT CAST(doc_id AS VARCHAR) AS id, CAST(n_chars AS DOUBLE) AS score, lang AS classification,
            text AS reason FROM documents WHERE doc_id % 6 < 3""",
        "fill_text": f"SELECT id, ten_khach, sdt, nhu_cau_mo_ta FROM ({REPAIRED})",
        "coerce_score": f"SELECT id, score FROM ({REPAIRED})",
        "coerce_class": f"SELECT id, classification FROM ({REPAIRED})",
        "fill_reason": f"SELECT id, reason FROM ({REPAIRED})",
        "repair_for_review": REPAIRED,
        "display_names": f"{GAPS} {_renamed(HISTOGRAM, HISTOGRAM_HEADERS)}",
        "display_names_distribution": f"{GAPS} {_renamed(DISTRIBUTION, DISTRIBUTION_HEADERS)}",
        "display_names_review": _renamed(REPAIRED, REVIEW_HEADERS),
        "format_rate": f"{GAPS} SELECT potential_rate, printf('%.1f', potential_rate) AS shown FROM ({KPIS})",
        # join and union
        "enrich": f"{docs} SELECT * FROM final",
        "enrich_fanout": f"{talks} SELECT * FROM final",
        "enrich_gaps": f"{GAPS} SELECT * FROM final",
        "enrich_compact": f"""{talks} SELECT l.*, s.score, s.classification, s.reason, s.copies FROM leads l
            LEFT JOIN (SELECT {SCORED_COLUMNS}, CAST(count(*) AS BIGINT) AS copies FROM scored
                GROUP BY {SCORED_COLUMNS}) s ON l.id IS NOT DISTINCT FROM s.id""",
        "expand_copies": "SELECT CAST(conv_id AS VARCHAR) AS id, CAST(count(*) * count(*) AS BIGINT) AS n "
        "FROM conversations GROUP BY conv_id",
        "union_results": f"{docs}, {LABELS} SELECT * FROM scored UNION ALL SELECT * FROM labels_scored",
        # dashboard
        "class_counts": f"{GAPS} {CLASS_COUNTS}",
        "kpis": f"{docs} {KPIS}",
        "kpis_gaps": f"{GAPS} {KPIS}",
        "kpis_fanout": f"{talks} {KPIS}",
        "class_distribution": f"{GAPS} {DISTRIBUTION}",
        "score_histogram": f"{GAPS} {HISTOGRAM}",
        "score_histogram_fanout": f"{talks} {HISTOGRAM}",
        # review
        "review_order": f"""{GAPS} SELECT *,
            CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS BIGINT) AS row_id FROM final""",
        "review_order_sorted": f"""{GAPS} SELECT id, score, classification,
            CAST(row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS BIGINT) AS place FROM final""",
        "validate_edits": f"{EDITS} SELECT row_id, op, id, ten_khach, nhu_cau_mo_ta, score, classification, reason, rejected FROM checked WHERE rejected IS NOT NULL",
        "validate_edits_valid": f"{EDITS} SELECT row_id, op, id, ten_khach, nhu_cau_mo_ta, score, classification, reason FROM valid",
        "apply_review_edits": f"{EDITS} SELECT * FROM edited",
        # model
        "assign_batches": f"{PLACED} SELECT doc_id, batch_id, pos FROM placed",
        "build_requests": f"{REQUESTS} SELECT batch_id, n_leads, payload FROM requests",
        "render_prompt": f"""{REQUESTS} SELECT batch_id,
            {_quote(DEFAULT_RUBRIC.head)} || payload || {_quote(DEFAULT_RUBRIC.tail)} AS prompt FROM requests""",
        "call_scorer": f"""{SHAPES} SELECT batch_id,
            CASE shape WHEN 1 THEN '```json' || chr(10) || CAST(to_json(records) AS VARCHAR) || chr(10) || '```'
                WHEN 2 THEN CAST(to_json(records[1]) AS VARCHAR)
                WHEN 3 THEN CAST(to_json(records) AS VARCHAR) END AS response,
            CASE shape WHEN 0 THEN {_STUB_ERROR} END AS error FROM shapes""",
        "batch_fallback": f"{MODEL} SELECT {SCORED_COLUMNS} FROM fallback",
        "batch_report": f"""{SHAPES} SELECT batch_id, n_leads,
            CASE WHEN shape IN (0, 2) THEN 'fallback' ELSE 'ok' END AS status,
            CASE shape WHEN 0 THEN {_STUB_ERROR}
                WHEN 2 THEN 'the response is not a JSON list of objects' END AS error FROM shapes""",
        "run_fallback": f"{docs} SELECT * FROM scored",
        "score_with_model": f"{MODEL} SELECT {SCORED_COLUMNS} FROM model UNION ALL SELECT {SCORED_COLUMNS} FROM fallback",
        "score_with_model_resumed": """SELECT CAST(doc_id AS VARCHAR) AS id, CAST(length(coalesce(text, '')) AS DOUBLE) AS score,
            'HOT' AS classification, 'len ' || length(coalesce(text, '')) AS reason FROM documents""",
        "score_with_model_report": f"""{SHAPES} SELECT batch_id, n_leads,
            CASE WHEN shape IN (0, 2) THEN 'fallback' ELSE 'ok' END AS status,
            CASE shape WHEN 0 THEN {_STUB_ERROR}
                WHEN 2 THEN 'the response is not a JSON list of objects' END AS error FROM shapes""",
        # whole jobs
        "triage_kpis": f"{docs} {KPIS}",
        "triage_final": f"{docs} SELECT * FROM final",
        "triage_with_model": f"{MODEL} SELECT {SCORED_COLUMNS} FROM model UNION ALL SELECT {SCORED_COLUMNS} FROM fallback",
        "dashboard": f"""{docs}, numbers AS ({KPIS})
            SELECT 'kpi' AS part, label, value FROM (
                SELECT 'total' AS label, CAST(total AS DOUBLE) AS value FROM numbers
                UNION ALL SELECT 'hot', CAST(hot AS DOUBLE) FROM numbers
                UNION ALL SELECT 'warm', CAST(warm AS DOUBLE) FROM numbers
                UNION ALL SELECT 'junk', CAST(junk AS DOUBLE) FROM numbers
                UNION ALL SELECT 'potential_rate', potential_rate FROM numbers)
            UNION ALL SELECT 'class', classification, CAST(n AS DOUBLE) FROM ({CLASS_COUNTS})
            UNION ALL SELECT 'distribution', label, CAST(n AS DOUBLE) FROM ({DISTRIBUTION})
            UNION ALL SELECT 'histogram', CAST(CAST(score AS INTEGER) AS VARCHAR), CAST(n AS DOUBLE)
                FROM ({HISTOGRAM})""",
        "review_and_export": f"""{EDITS}
            SELECT id, ten_khach, sdt, nhu_cau_mo_ta, score, classification, reason FROM edited""",
    }
