"""Queries of cleaning, segmentation, extraction and chunking, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from casewright.functions import rules
from casewright.functions import text as tx
from casewright.operators import chunking, cleaning, extraction, segmentation
from casewright.plans.views import ctes, view

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# --- cleaning ---------------------------------------------------------------------------------------------------------

_SQUEEZE = "trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM {t})"
# documents as marked-up pages: headers, lists, tables and page comments around the text
MARKED = """'<!-- Page 1 -->' || chr(10) || '##Title ' || CAST(doc_id % 5 AS STRING) || ':' || chr(10) || '##Title ' || CAST(doc_id % 5 AS STRING) || ':' || chr(10) || '3) first' || chr(10) || '7) second' || chr(10) || text || chr(10) || '12' || chr(10) || '--' || chr(10) || '| a | b |' || chr(10) || '| ' || lang || ' |' || chr(10) || '<!-- page 2 -->' || chr(10) || 'hyphen-' || chr(10) || 'ated end' || chr(10) || text"""
_MARKED = f"m AS (SELECT doc_id, {MARKED} AS text FROM documents)"


def _marked(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.expr(MARKED).alias("text"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || chr(13) || chr(10) || '  <!-- page 3 -->' || chr(9) || 'x', '\\r\\n?', chr(10), 'g'), '(?i)<!--\\s*page\\s+\\d+\\s*-->', chr(10), 'g'), '[ \\t\\f\\v]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents""")
def t1_clean_text(spark, sf):
    return view(spark, sf, "docs").select("doc_id", tx.clean_text(F.concat("text", F.lit("\r\n  <!-- page 3 -->\tx"))).alias("text"))


@query(f"WITH {_MARKED} SELECT doc_id, CAST(p AS INTEGER) AS page_no, CAST(CASE WHEN p = 1 THEN instr(text, '| ' || '') > 0 ELSE true END AS BOOLEAN) AS has_text FROM m, (SELECT 1 AS p UNION ALL SELECT 2) AS pages")
def t2_explode_pages(spark, sf):
    return cleaning.explode_pages(_marked(spark, sf)).select("doc_id", "page_no", (F.length("text") > 0).alias("has_text"))


@query("SELECT doc_id, translate('क्र. ' || CAST(doc_id AS VARCHAR) || ' १२३' || text, '०१२३४५६७८९', '0123456789') AS text FROM documents")
def t3_normalize_numerals(spark, sf):
    return view(spark, sf, "docs").select("doc_id", tx.normalize_numerals(F.concat(F.lit("क्र. "), F.col("doc_id").cast("string"), F.lit(" १२३"), "text")).alias("text"))


def _fixed(c: str) -> str:
    for pattern, new in rules.OCR_FIXES:
        new = re.sub(r"\$([123])", r"\\\1", new).replace("\n", "' || chr(10) || '")
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return c


_NOISY = "'a@b c 5~6 I8 3$4 &amp;&lt; ' || repeat(chr(10), 4) || 'AB' || chr(10) || text"


@query(f"SELECT doc_id, {_fixed(_NOISY)} AS text FROM documents")
def t4_apply_ocr_fixes(spark, sf):
    return view(spark, sf, "docs").select("doc_id", cleaning.apply_fixes(F.expr(_NOISY)).alias("text"))


def _fields(spark, sf, labelled="doc_id % 10 <> 7"):
    """Fields of all documents; those that are not labelled have their text alone, which holds no such field."""
    note = F.concat(F.lit("दिनांक: "), (F.col("doc_id") % 40).cast("string"), F.lit("/12/2023 रु. 5,000 लाख क्रमांक 12"), F.when(F.col("doc_id") % 3 == 0, "$").otherwise(""), F.lit("4/5\n"), "text")
    return cleaning.critical_fields(view(spark, sf, "docs").select("doc_id", F.lit(1).alias("page_no"), F.when(F.expr(labelled), note).otherwise(F.col("text")).alias("text")))


def _found_fields(labelled: str) -> str:
    """The fields of `_fields` as SQL: every match in a whole text, the note and what follows it."""
    blank, strip = r"[ \t\n\x0B\f\r]", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    date, amount, ref = (p.replace(r"[\s:—-]", r"[ \t\n\x0B\f\r:—-]").replace(r"[\s.]", r"[ \t\n\x0B\f\r.]").replace(r"[\d/$\s]", r"[\d/$ \t\n\x0B\f\r]").replace(r"\s", blank) for p in (rules.CRITICAL_DATE, rules.CRITICAL_AMOUNT, rules.CRITICAL_REFERENCE))
    group = lambda p, k: f"unnest(regexp_extract_all(t, '{p}', {k}))"
    return f"""WITH t AS (SELECT doc_id, CASE WHEN {labelled} THEN 'दिनांक: ' || CAST(doc_id % 40 AS VARCHAR) || '/12/2023 रु. 5,000 लाख क्रमांक 12' || CASE WHEN doc_id % 3 = 0 THEN '$' ELSE '' END || '4/5' || chr(10) || text ELSE text END AS t FROM documents),
d AS (SELECT doc_id, {group(date, 1)} AS d, {group(date, 2)} AS m, {group(date, 3)} AS y FROM t), a AS (SELECT doc_id, {group(amount, 1)} AS v, {group(amount, 2)} AS u FROM t), r AS (SELECT doc_id, {group(ref, 1)} AS v FROM t),
fields AS (SELECT doc_id, 1 AS page_no, 'date' AS kind, concat_ws('/', d, m, y) AS value, '' AS unit, CAST(d AS INTEGER) > 31 OR CAST(m AS INTEGER) > 12 AS suspicious FROM d
UNION ALL SELECT doc_id, 1, 'amount', replace(v, ',', ''), coalesce(u, ''), false FROM a
UNION ALL SELECT doc_id, 1, 'reference', trim(v, {strip}), '', contains(v, '$') FROM r)"""


@query(_found_fields("doc_id % 10 <> 7") + " SELECT * FROM fields")
def t5_critical_fields(spark, sf):
    # reads every document; a tenth of them holds no field
    return _fields(spark, sf).drop("raw")


@query(_found_fields("true") + " SELECT * FROM fields")
def t5_critical_fields_all(spark, sf):
    """t5_critical_fields with fields in every document."""
    return _fields(spark, sf, "true").drop("raw")


@query(_found_fields("doc_id % 10 <> 7") + """, c AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'date') AS dates, count(*) FILTER (WHERE kind = 'amount') AS amounts, count(*) FILTER (WHERE kind = 'reference') AS refs, count(*) FILTER (WHERE suspicious) AS suspicious FROM fields GROUP BY doc_id),
q AS (SELECT doc_id, coalesce(dates, 0) AS dates, coalesce(amounts, 0) AS amounts, coalesce(refs, 0) AS refs, coalesce(suspicious, 0) AS suspicious FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN c USING (doc_id))
SELECT *, list_filter([CASE WHEN dates = 0 THEN 'no dates' END, CASE WHEN refs = 0 THEN 'no reference numbers' END, CASE WHEN suspicious > 0 THEN 'suspicious values' END], lambda f: f IS NOT NULL) AS flags FROM q""")
def t6_document_quality(spark, sf):
    return cleaning.document_quality(view(spark, sf, "docs"), _fields(spark, sf))


def _count(lines):
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query(f"""WITH {_MARKED}, {_LINES.format(t='m')}, s AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM l),
k AS (SELECT * FROM s WHERE s = '' OR (s LIKE '|%|' AND length(regexp_replace(s, '[^|]', '', 'g')) >= 2) OR s LIKE '#%' OR s LIKE '<!--%' OR NOT (regexp_full_match(s, '(?i)\\s*[-—]*\\s*(Page\\s*)?\\d{{1,4}}\\s*[-—]*\\s*') OR (length(s) <= 3 AND NOT regexp_matches(s, '[ऀ-ॿA-Za-z]')) OR (length(s) < 5 AND length(regexp_replace(s, '[^ऀ-ॿA-Za-z0-9]', '', 'g')) < 2)))
SELECT doc_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM k GROUP BY doc_id""")
def t7_drop_artifact_lines(spark, sf):
    return _count(cleaning.drop_artifact_lines(cleaning.explode_lines(_marked(spark, sf))))


@query(f"""WITH {_MARKED}, {_LINES.format(t='m')}, s AS (SELECT *, regexp_matches(trim(line), '^#{{1,6}}') AS head FROM l),
f AS (SELECT doc_id, line_no, head, CASE WHEN head THEN regexp_extract(trim(line), '^(#+)', 1) || ' ' || regexp_replace(trim(regexp_replace(trim(line), '^#+', '')), '[:-]+$', '') ELSE line END AS line FROM s),
d AS (SELECT * FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before, lag(head) OVER (PARTITION BY doc_id ORDER BY line_no) AS was FROM f) WHERE NOT (head AND coalesce(was, false) AND line = before)),
g AS (SELECT *, head AND trim(coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), '')) <> '' AS gap FROM d)
SELECT doc_id, count(*) + count(*) FILTER (WHERE gap) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM g GROUP BY doc_id""")
def t8_fix_headers(spark, sf):
    return _count(cleaning.fix_headers(cleaning.explode_lines(_marked(spark, sf))))


@query()
def t9_repair_tables(spark, sf):
    return cleaning.assemble_lines(cleaning.repair_tables(cleaning.explode_lines(_marked(spark, sf))))


@query(f"""WITH {_MARKED}, {_LINES.format(t='m')} SELECT doc_id, line_no, CASE line WHEN '3) first' THEN '1. first' WHEN '7) second' THEN '2. second' ELSE line END AS line FROM l""")
def t10_renumber_lists(spark, sf):
    return cleaning.renumber_lists(cleaning.explode_lines(_marked(spark, sf))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"""WITH {_LINES.format(t='documents')}, n AS (SELECT *, lower(regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS f FROM l),
k AS (SELECT *, CASE WHEN length(f) > 30 AND f NOT LIKE '#%' AND f NOT LIKE '<!--%' AND NOT (f LIKE '|%|') THEN row_number() OVER (PARTITION BY doc_id, f ORDER BY line_no) ELSE 1 END AS r FROM n)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM k WHERE r = 1""")
def t11_dedup_paragraphs(spark, sf):
    return cleaning.dedup_paragraphs(cleaning.explode_lines(view(spark, sf, "docs"))).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"""WITH {_MARKED}, {_LINES.format(t='m')}, r AS (SELECT doc_id, line_no, regexp_replace(line, '\\s+$', '') AS line, trim(line) AS s FROM l),
c AS (SELECT doc_id, line_no, CASE WHEN s LIKE '|%|' AND length(regexp_replace(s, '[^|]', '', 'g')) >= 2 THEN line ELSE replace(regexp_replace(replace(replace(line, '| ', '|' || chr(1)), ' |', chr(1) || '|'), '  +', ' ', 'g'), chr(1), ' ') END AS line FROM r),
j AS (SELECT *, coalesce(lag(line) OVER w LIKE '%-' AND regexp_matches(line, '^\\p{{Ll}}'), false) AS joins FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
o AS (SELECT *, coalesce(lead(joins) OVER w, false) AS open, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER w AS place FROM j WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
p AS (SELECT doc_id, place, string_agg(CASE WHEN open THEN line[1:length(line) - 1] ELSE line END, '' ORDER BY line_no) AS line FROM o GROUP BY doc_id, place)
SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS text FROM p GROUP BY doc_id""")
def t12_join_hyphenated(spark, sf):
    return cleaning.assemble_lines(cleaning.join_hyphenated(cleaning.explode_lines(_marked(spark, sf))))


@query()
def t13_clean_markdown(spark, sf):
    return cleaning.clean_markdown(_marked(spark, sf))


@query("""WITH r AS (SELECT doc_id, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS a, CAST(sum(length(trim(regexp_replace(coalesce(text, ''), '[aeiou]', '', 'g')))) AS BIGINT) AS b FROM documents GROUP BY ROLLUP (doc_id))
SELECT doc_id, a AS chars_in, b AS chars_out, CASE WHEN a > 0 THEN ((2000 * (a - b) + a) // (2 * a)) / 10 ELSE 0 END::DOUBLE AS reduced_pct FROM r""")
def t14_reduction_report(spark, sf):
    docs = view(spark, sf, "docs")
    return cleaning.reduction_report(docs, docs.select("doc_id", F.trim(F.regexp_replace("text", "[aeiou]", "")).alias("text")))


_SCRIPT = """WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || repeat(' सूचना', length(text) // 5) WHEN 2 THEN repeat('सूचना ', length(text) // 50) || text ELSE 'सूचना ' || text END AS t FROM documents),
s AS (SELECT doc_id, length(regexp_replace(t, '[^ऀ-ॿ]', '', 'g')) AS m, length(regexp_replace(t, '\\s', '', 'g')) AS n, length(regexp_replace(t, '[^ऀ-ॿA-Za-z]', '', 'g')) AS c FROM d)
SELECT doc_id, CASE WHEN n = 0 THEN 'unknown' WHEN m / n > 0.3 THEN 'hi' WHEN m / n > 0.05 THEN 'mixed' ELSE 'en' END AS a, CASE WHEN n = 0 OR m / n < 0.05 THEN 'en' WHEN m / n > 0.3 THEN 'hi' ELSE 'mixed' END AS b,
CASE WHEN c = 0 OR m / c < 0.05 THEN 'english' WHEN m / c > 0.5 THEN 'hindi' ELSE 'mixed' END AS c FROM s"""


@query(_SCRIPT)
def t15_detect_script(spark, sf):
    """Whole texts with Hindi words around them."""
    t = F.expr("CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || repeat(' सूचना', CAST(length(text) DIV 5 AS INT)) WHEN 2 THEN repeat('सूचना ', CAST(length(text) DIV 50 AS INT)) || text ELSE 'सूचना ' || text END")
    return tx.detect_scripts(view(spark, sf, "docs"), t)


@query(_SCRIPT)
def t15_detect_script_all(spark, sf):
    return t15_detect_script(spark, sf)


_WORDS = "w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT word, count(*) AS freq FROM w GROUP BY word), dict AS (SELECT * FROM c WHERE freq >= 40)"


def _words(spark, sf):
    """(every counted word, the dictionary); spell_candidates takes the dictionary's own words out."""
    counted = view(spark, sf, "docs").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    return counted.select("word"), counted.where("freq >= 40")


_CANDIDATES = f"""WITH {_WORDS}, a AS (SELECT word FROM c WHERE freq < 40), p AS (SELECT a.word, dict.word AS term, freq, levenshtein(a.word, dict.word) AS distance FROM a JOIN dict ON abs(length(a.word) - length(dict.word)) <= 2 WHERE length(a.word) BETWEEN 3 AND 6),
k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, freq DESC, term) AS r FROM p WHERE distance <= CASE WHEN length(word) <= 4 THEN 1 ELSE 2 END)
SELECT word, term, freq, CAST(distance AS INTEGER) AS distance, freq >= CASE WHEN distance = 1 THEN 4 ELSE 50 END AS accepted FROM k WHERE r = 1"""


@query(_CANDIDATES)
def t16_spell_candidates(spark, sf):
    return cleaning.spell_candidates(*_words(spark, sf))


@query(_CANDIDATES)
def t16_spell_candidates_all(spark, sf):
    return t16_spell_candidates(spark, sf)


@query(f"""WITH {_LINES.format(t='documents')}, fix AS (SELECT word, term FROM ({_CANDIDATES}) WHERE accepted),
k AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM l), f AS (SELECT *, s = '' OR regexp_matches(s, '^(?:[:॥#|>]|```|<!--|---)') OR regexp_matches(s, '^[-*]\\s') OR regexp_matches(s, '^\\d+\\.\\s') AS fixed FROM k),
w AS (SELECT doc_id, line_no, fixed, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM (SELECT *, CASE WHEN fixed THEN [line] ELSE string_split(regexp_replace(line, '([a-z]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) END AS pieces FROM f)),
o AS (SELECT doc_id, line_no, string_agg(coalesce(CASE WHEN NOT fixed THEN term END, piece), '' ORDER BY k) AS line FROM w LEFT JOIN fix ON piece = word GROUP BY doc_id, line_no)
SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM o GROUP BY doc_id""")
def t17_apply_corrections(spark, sf):
    return cleaning.apply_corrections(view(spark, sf, "docs"), cleaning.spell_candidates(*_words(spark, sf)), "[a-z]+")[0]


@query(f"WITH {_WORDS}, n AS (SELECT word, count(*) AS n FROM w GROUP BY word) SELECT word, freq + 500 * coalesce(n, 0) AS freq FROM dict LEFT JOIN n USING (word)")
def t18_boost_frequencies(spark, sf):
    words = view(spark, sf, "docs").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    return cleaning.boost_frequencies(_words(spark, sf)[1], words)


@query("SELECT doc_id, text FROM documents")
def t19_strip_embedded_images(spark, sf):
    return view(spark, sf, "docs").select("doc_id", cleaning.strip_embedded_images(F.concat(F.lit("![Image](data:image/png;base64,AAAA)\n"), "text")).alias("text"))


# --- segmentation -----------------------------------------------------------------------------------------------------


def _decisions(spark, sf):
    return segmentation.normalized(view(spark, sf, "decision_docs"))


def _bounds(spark, sf):
    return segmentation.resolve_boundaries(segmentation.find_boundaries(_decisions(spark, sf)))


@query()
def g1_find_boundaries(spark, sf):
    return segmentation.find_boundaries(_decisions(spark, sf))


@query()
def g2_resolve_boundaries(spark, sf):
    return _bounds(spark, sf)


@query()
def g3_slice_sections(spark, sf):
    return segmentation.slice_sections(_decisions(spark, sf), _bounds(spark, sf))


@query("""WITH s AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'BACKGROUND' WHEN 1 THEN 'FINAL_ORDER' ELSE 'PENALTY' END AS section, text, 0.5::DOUBLE AS confidence FROM documents)
SELECT * FROM s UNION ALL SELECT doc_id, CASE section WHEN 'BACKGROUND' THEN 'FACTS' ELSE 'DIRECTIONS' END, text, confidence FROM s WHERE section <> 'PENALTY'""")
def g4_sync_aliases(spark, sf):
    kind = F.when(F.col("doc_id") % 3 == 0, "BACKGROUND").when(F.col("doc_id") % 3 == 1, "FINAL_ORDER").otherwise("PENALTY")
    return segmentation.sync_aliases(view(spark, sf, "docs").select("doc_id", kind.alias("section"), "text", F.lit(0.5).alias("confidence")))


@query("SELECT doc_id, 'DATES_TABLE' AS section, 'Date of hearing: ' || CAST(1 + doc_id % 28 AS VARCHAR) || '/03/2025' || chr(10) || 'CPIO Reply: The CPIO replied under Section 8(1)(j) and Section 10.' AS text, 0.86::DOUBLE AS confidence FROM documents")
def g5_extract_dates_table(spark, sf):
    return segmentation.dates_table(_decisions(spark, sf))


@query()
def g6_extract_header_and_parties(spark, sf):
    return segmentation.header_and_parties(_decisions(spark, sf), _bounds(spark, sf))


@query()
def g7_augment_sections(spark, sf):
    docs = _decisions(spark, sf)
    return segmentation.augment_sections(docs, segmentation.slice_sections(docs, _bounds(spark, sf)))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'BACKGROUND' ELSE 'COMMISSION_FINDINGS' END AS section, text, CASE WHEN doc_id % 2 = 0 THEN 0.8 ELSE 0.35 END::DOUBLE AS confidence FROM documents UNION ALL SELECT doc_id, 'PARTIES', text, 0.8::DOUBLE FROM documents WHERE doc_id % 2 = 1")
def g8_fallback_section(spark, sf):
    docs = view(spark, sf, "docs")
    kind = F.when(F.col("doc_id") % 2 == 0, "BACKGROUND").when(F.col("doc_id") % 2 == 1, "PARTIES")
    sections = docs.select("doc_id", kind.alias("section"), "text", F.lit(0.8).alias("confidence")).where("section is not null")
    return segmentation.fallback_section(docs, sections)


@query()
def g9_labelled_blocks(spark, sf):
    return segmentation.labelled_blocks(_decisions(spark, sf))


@query()
def g10_segmentation_coverage(spark, sf):
    docs = view(spark, sf, "decision_docs")
    return segmentation.segmentation_coverage(docs, segmentation.segment(docs))


# --- extraction -------------------------------------------------------------------------------------------------------

_D = ctes("decision_docs")


# letters outside ASCII as _, which ends no word and is in no pattern
_WORDLIKE = "regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{L}\\p{N}]', '!', 'g'), '[^\\x00-\\x7F]', '_', 'g')"


def _first_seen(values):
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def _sql(pattern):
    return pattern.replace("'", "''")


def _dated(label):
    found = f"regexp_extract(text, '(?is)(?:{label})\\s*:?\\s*({rules.DATE}|Not\\s+on\\s+Record)', 1)"
    return f"CAST(try_strptime({found}, ['%Y-%m-%d', '%d.%m.%Y', '%d/%m/%Y', '%d-%m-%Y']) AS DATE)"


_STRICT = f"nullif(upper(regexp_replace(regexp_replace(regexp_replace(regexp_extract({_WORDLIKE}, '{rules.CASE_NUMBER}', 0), '[_-]+', '/', 'g'), '/+', '/', 'g'), '^/|/$', '', 'g')), '')"
_CITED = f"list_transform(regexp_extract_all({_WORDLIKE}, '{rules.CITATION.replace('(?=', '(?:')}', 1), lambda s: lower(regexp_replace(s, '\\s+', '', 'g')))"


@query(_D + f" SELECT doc_id, coalesce({_STRICT}, 'UNKNOWN') AS case_number FROM v_decision_docs")
def e1_case_number(spark, sf):
    return view(spark, sf, "decision_docs").select("doc_id", extraction.case_number(F.col("text")).alias("case_number"))


@query("""WITH d AS (SELECT doc_id, 1 + doc_id % 28 AS d, 1 + doc_id % 12 AS m, doc_id % 100 AS y FROM documents)
SELECT doc_id, make_date(2024, m, d) AS long_form, make_date(CASE WHEN y >= 69 THEN 1900 ELSE 2000 END + y, m, d) AS short_form, CAST(NULL AS DATE) AS bad FROM d""")
def e2_normalize_date(spark, sf):
    d, m, y = (F.col("doc_id") % 28 + 1).cast("string"), (F.col("doc_id") % 12 + 1).cast("string"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0")
    long_form = F.when(F.col("doc_id") % 2 == 0, F.concat_ws("/", d, m, F.lit("2024"))).otherwise(F.concat_ws(".", d, m, F.lit("2024")))
    return view(spark, sf, "docs").select("doc_id", tx.normalize_date(long_form).alias("long_form"), tx.normalize_date(F.concat_ws(".", d, m, y)).alias("short_form"), tx.normalize_date(F.concat(F.lit("41/13/"), y)).alias("bad"))


@query(_D + f" SELECT doc_id, {_dated('Date\\s+of\\s+Decision|Decision\\s+Date')} AS decision_date, {_dated('Date\\s+of\\s+hearing|Hearing\\s+date')} AS hearing_date, {_dated('First\\s+Appeal')} AS first_appeal_date FROM v_decision_docs")
def e3_labelled_dates(spark, sf):
    return extraction.labelled_dates(view(spark, sf, "decision_docs")).select("doc_id", "decision_date", "hearing_date", "first_appeal_date")


@query(_D + f", c AS (SELECT doc_id, {_CITED} AS l FROM v_decision_docs), u AS (SELECT doc_id, {_first_seen('l')} AS cited FROM c) SELECT doc_id, cited, list_filter(cited, lambda x: regexp_matches(x, '{rules.EXEMPTION_PREFIX}')) AS exempt FROM u")
def e4_section_citations(spark, sf):
    cited = extraction.citations(F.col("text"))
    return view(spark, sf, "decision_docs").select("doc_id", cited.alias("cited"), extraction.exemptions(cited).alias("exempt"))


@query(_D + f", a AS (SELECT doc_id, TRY_CAST(replace(regexp_extract(text, '{rules.AMOUNT}', 1), ',', '') AS BIGINT) AS amount FROM v_decision_docs) SELECT doc_id, coalesce(amount, 0) > 0 AS imposed, amount FROM a")
def e5_penalty(spark, sf):
    imposed, amount = extraction.penalty(F.lit(""), F.col("text"))
    return view(spark, sf, "decision_docs").select("doc_id", imposed.alias("imposed"), amount.alias("amount"))


def _party(label):
    return f"regexp_replace(regexp_extract(text, '(?im)^\\s*{label}\\s*[:\\-]\\s*(.+)$', 1), '^[ .,:;\\-]+|[ .,:;\\-]+$', '', 'g')"


@query(_D + f" SELECT doc_id, {_party('appellant')} AS appellant, {_party('respondent')} AS respondent FROM v_decision_docs")
def e6_named_parties(spark, sf):
    return extraction.named_parties(view(spark, sf, "decision_docs")).select("doc_id", "appellant", "respondent")


@query(_D + r""" SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)Central\s+Information\s+Commission|\bCIC/') THEN 'CIC' WHEN regexp_matches(text, '(?i)State\s+Information\s+Commission|\bSIC/') THEN 'SIC' WHEN regexp_matches(text, '(?i)High\s+Court|Supreme\s+Court') THEN 'COURT' WHEN regexp_matches(text, '(?i)circular|office memorandum|guidelines') THEN 'CIRCULAR' ELSE 'CIC' END AS source,
CASE WHEN regexp_matches(text, '(?i)Central\s+Information\s+Commission') THEN 'Central Information Commission' WHEN regexp_matches(text, '(?i)State\s+Information\s+Commission') THEN 'State Information Commission' END AS commission FROM v_decision_docs""")
def e7_source_and_commission(spark, sf):
    return view(spark, sf, "decision_docs").select("doc_id", extraction.source_of(F.col("text")).alias("source"), extraction.commission_of(F.col("text")).alias("commission"))


@query(_D + """, l AS (SELECT doc_id, lower(text) AS t FROM v_decision_docs) SELECT doc_id, CASE WHEN regexp_matches(t, '\\bpenalty|show cause|section\\s*20') THEN 'PENALTY' WHEN regexp_matches(t, 'partly allowed|partially allowed|redact|severance|section\\s*10') THEN 'PARTIAL' END AS by_document,
CASE WHEN regexp_matches(t, '\\b(partly allowed|partially allowed|redact|severance|section 10)\\b') THEN 'PARTIAL' END AS by_rules FROM l""")
def e8_classify_outcome(spark, sf):
    return view(spark, sf, "decision_docs").select("doc_id", extraction.outcome(F.col("text")).alias("by_document"), extraction.outcome(F.col("text"), rules.OUTCOME_RULES, F.lit(False)).alias("by_rules"))


@query(_D + " SELECT doc_id, CASE WHEN contains(lower(text), 'directed to provide') THEN 'Incomplete replies can lead to direction for revised pointwise disclosure.' ELSE 'PIO should verify record custody, statutory exemptions, and provide a reasoned reply.' END AS signal, ['Personal information/privacy exemption analysis', 'Partial'] AS tags FROM v_decision_docs")
def e9_reasoning_tags(spark, sf):
    return view(spark, sf, "decision_docs").select("doc_id", extraction.learning_signal(F.col("text")).alias("signal"), extraction.reasoning_tags(F.col("text"), F.lit("PARTIAL")).alias("tags"))


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(" + _SQUEEZE.format(c="text") + ", '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"""WITH s AS (SELECT doc_id, list_filter(list_transform({_SENTENCES}, lambda s: regexp_replace(s, '^[ \\-.]+|[ \\-.]+$', '', 'g')), lambda s: len(string_split(s, ' ')) >= 5) AS s FROM documents)
SELECT doc_id, list_filter(s, lambda x: regexp_matches(x, '(?i)(^| )(the|der|que)( |$)'))[1:6] AS observations FROM s""")
def e10_key_sentences(spark, sf):
    return view(spark, sf, "docs").select("doc_id", extraction.key_sentences(F.col("text"), r"(?i)(^| )(the|der|que)( |$)", 6, first_two=False).alias("observations"))


def _compact(c, limit):
    return f"CASE WHEN length({_SQUEEZE.format(c=c)}) <= {limit} THEN {_SQUEEZE.format(c=c)} ELSE rtrim(substr({_SQUEEZE.format(c=c)}, 1, {limit - 3})) || '...' END"


_EDGE = "regexp_replace({c}, '^[ ;.]+|[ ;.]+$', '', 'g')"


@query(_D + f""", t AS (SELECT doc_id, regexp_replace(regexp_replace({_SQUEEZE.format(c='text')}, '(?i)^.*?\\bsought\\s+information\\s+(?:on|regarding|about)\\b', ''), '(?i)\\b(?:Grounds\\s+for\\s+(?:Second\\s+)?Appeal|CPIO\\s+reply)\\b.*$', '') AS part FROM v_decision_docs),
n AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(part, '(?:^|\\s)(?:\\d+[).]|[a-z]\\))\\s*([^.;]+(?:[.;]|$))', 1), lambda s: {_EDGE.format(c=_compact('s', 220))}), lambda s: s <> '')[1:12] AS numbered,
list_transform(list_filter(string_split(regexp_replace(part, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))[1:8], lambda s: len(regexp_split_to_array(trim(s), '\\s+')) >= 4), lambda s: {_EDGE.format(c=_compact('s', 240))}) AS plain FROM t)
SELECT doc_id, CASE WHEN len(numbered) > 0 THEN numbered ELSE plain END AS items FROM n""")
def e11_requested_items(spark, sf):
    return view(spark, sf, "decision_docs").select("doc_id", extraction.requested_items(F.col("text")).alias("items"))


def _cited(pattern):
    text = _WORDLIKE.replace("(text,", "('the High Court of Delhi, Circular No. 5/2020, and so on' || chr(10) || text,")
    found = f"list_transform(regexp_extract_all({text}, '{_sql(pattern)}'), lambda s: {_SQUEEZE.format(c='s')})"
    return f"list_filter({_first_seen(found)}, lambda s: s <> '')"


@query(f"SELECT doc_id, {_cited(rules.COURTS)} AS courts, {_cited(rules.CIRCULARS)} AS circulars FROM documents")
def e12_references(spark, sf):
    t = F.concat(F.lit("the High Court of Delhi, Circular No. 5/2020, and so on\n"), "text")
    return view(spark, sf, "docs").select("doc_id", extraction.references(t, rules.COURTS).alias("courts"), extraction.references(t, rules.CIRCULARS).alias("circulars"))


def _found(pattern, n):
    # letters outside ASCII end words like others; they stand as 0, which no pattern takes in
    start = f"regexp_replace(regexp_replace(text[1:{n}], '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', '!', 'g'), '[^\\x00-\\x7F]', '0', 'g')"
    found = f"list_transform(regexp_extract_all({start}, '{pattern}'), lambda s: trim({_SQUEEZE.format(c='s')}, ' ,.'))"
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)[1:12]"


@query(_D + f" SELECT doc_id, {_found(rules.PEOPLE, 5000)} AS people, {_found(rules.AUTHORITIES, 6000)} AS authorities, {_found(rules.DEPARTMENTS, 6000)} AS departments, {_found(rules.LOCATIONS, 8000)} AS locations FROM v_decision_docs")
def e13_entities(spark, sf):
    return extraction.entities(view(spark, sf, "decision_docs"))


_PLAIN = "regexp_replace(regexp_replace(text[1:5000], '[^\\x00-\\x7F\\p{L}\\p{N}]', '!', 'g'), '[^\\x00-\\x7F]', '0', 'g')"
_GENERAL = " || ".join(f"list_transform(regexp_extract_all({_PLAIN}, '{p}'), lambda s: {_SQUEEZE.format(c='s')})" for p in rules.GENERAL_ENTITIES)


@query(_D + f", p AS (SELECT doc_id, {_party('appellant')} AS appellant, text FROM v_decision_docs), g AS (SELECT doc_id, appellant, list_prepend('Records Office', list_filter({_GENERAL}, lambda v: length(v) <= 80)) AS names, list_prepend(appellant, {_found(rules.PEOPLE, 5000)}) AS people FROM p) SELECT doc_id, list_filter(names, lambda x, i: list_position(names, x) = i)[1:20] AS names, list_filter(people, lambda x, i: list_position(people, x) = i)[1:12] AS people FROM g")
def e13_general_entities(spark, sf):
    """Names of any kind after the public authority, people after the appellant."""
    docs = view(spark, sf, "decision_docs")
    known = docs.join(extraction.named_parties(docs).select("doc_id", "appellant"), "doc_id").withColumn("public_authority", F.lit("Records Office"))
    return known.select("doc_id", extraction.general_entities(known).alias("names")).join(extraction.entities(known).select("doc_id", "people"), "doc_id")


@query()
def e14_precedent_summary(spark, sf):
    return extraction.extract_cases(view(spark, sf, "decision_docs"), ["precedent"])


@query("SELECT doc_id, round(0.25::DOUBLE + CASE WHEN doc_id % 2 = 0 THEN 0.20::DOUBLE ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 0.15::DOUBLE ELSE 0 END, 3) AS confidence FROM documents")
def e15_extraction_confidence(spark, sf):
    has = {"case_number": F.col("doc_id") % 2 == 0, "sections_invoked": F.col("doc_id") % 3 == 0}
    return view(spark, sf, "docs").select("doc_id", extraction.extraction_confidence(has).alias("confidence"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'better' ELSE lang END AS lang, source, doc_id % 2 = 0 OR doc_id % 3 = 0 AS flag FROM documents")
def e16_merge_layers(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base = docs.select("doc_id", "lang", "source", (F.col("doc_id") % 2 == 0).alias("flag"))
    top = docs.where("doc_id % 3 <> 1").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "better").otherwise("").alias("lang"), (F.col("doc_id") % 3 == 0).alias("flag"))
    return extraction.merge_layers(base, top, ["lang"], ["flag"])


_RAW_OUTCOME = "CASE doc_id % 8 WHEN 0 THEN ' partly allowed' WHEN 1 THEN 'Show-Cause' WHEN 2 THEN 'no interference required.' WHEN 3 THEN 'DENIED' WHEN 4 THEN 'appeal disposed' WHEN 5 THEN lang WHEN 6 THEN '' ELSE 'allowed' END"


@query(f"""WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[,;\n]+'), lambda s: trim({_SQUEEZE.format(c="s")}, ' -•' || chr(9) || chr(10) || '.')), lambda s: s <> '') AS l,
trim(regexp_replace(upper(trim({_RAW_OUTCOME})), '[^A-Z]+', '_', 'g'), '_') AS o FROM documents)
SELECT doc_id, list_filter(l, lambda x, i: NOT list_contains(list_transform(l[1:i - 1], lambda y: lower(y)), lower(x))) AS items,
CASE WHEN o IN ('ALLOWED', 'APPEAL_ALLOWED') THEN 'APPEAL_ALLOWED' WHEN o IN ('DISMISSED', 'REJECTED', 'DENIED') THEN 'REJECTED' WHEN o IN ('DISPOSED', 'APPEAL_DISPOSED', 'APPEAL_DISPOSED_NO_INTERVENTION', 'NO_INTERVENTION', 'NO_INTERFERENCE_REQUIRED') THEN 'APPEAL_DISPOSED'
WHEN o IN ('PARTLY_ALLOWED', 'PARTIALLY_ALLOWED', 'PARTIAL') THEN 'PARTIAL' WHEN o IN ('PENALTY', 'SHOW_CAUSE') THEN 'PENALTY' END AS outcome, least(1, greatest(0, doc_id / 100)) AS score FROM d""")
def e17_normalize_case_lists(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", extraction.list_field(F.col("text")).alias("items"), extraction.normalize_outcome(F.expr(_RAW_OUTCOME)).alias("outcome"), extraction.clamp(F.col("doc_id") / 100).alias("score"))


#: The classes of requests as SQL over lower-case text t. Letters outside ASCII become Q, so that word edges are those of all letters.
REQUEST_CLASS = """CASE WHEN regexp_matches(t, 'firewall|password|credential|ip address|server config|network security|port scan|cyber') THEN 'cybersecurity' WHEN regexp_matches(t, 'tender|bid|quotation|procurement|purchase order|contractor') THEN 'procurement'
WHEN regexp_matches(t, 'source code|architecture diagram|database schema|system design|software code') THEN 'architecture' WHEN regexp_matches(t, 'service book|salary slip|leave record|performance report|pension file|employee') THEN 'employee'
WHEN regexp_matches(t, 'land record|caste certificate|ration card|grievance details|my application|birth certificate') THEN 'citizen_data' WHEN regexp_matches(t, 'cabinet note|state security|confidential minutes|secret') THEN 'confidential'
WHEN regexp_matches(t, 'file sheet|noting|office memo|internal circular') THEN 'internal' WHEN regexp_matches(t, 'third party|proprietary|trade secret|commercial confidence') THEN 'third_party_commercial' ELSE 'other' END"""
REQUEST_CLASSES = f"""l AS (SELECT request_id, text, lower(text) AS t FROM v_requests), rc AS (SELECT *, {REQUEST_CLASS} AS information_type FROM l),
cl AS (SELECT request_id, t, information_type, CASE WHEN information_type <> 'procurement' THEN 'none' WHEN regexp_matches(t, 'active|ongoing|live|advertised|not open') THEN 'active_tender' ELSE 'completed_tender' END AS procurement_status,
information_type IN ('employee', 'citizen_data') OR regexp_matches(t, 'personal|medical|address|phone number|salary|bank account|aadhaar|pan card') AS personal_data,
regexp_matches(t, 'corruption|human rights|violation|bribe|scam|fraud|scandal|torture') AS public_interest_override,
list_transform(list_filter(['e-district', 'pmgsy', 'hrms', 'database', 'portal', 'website', 'server', 'router', 'network'], lambda w: contains(t, w)), lambda w: upper(w)) AS systems,
list_concat(list_transform(regexp_extract_all(text, '\\b\\d{{2}}[-/.]\\d{{2}}[-/.]\\d{{4}}\\b'), lambda d: 'Date: ' || d),
list_transform(list_filter(regexp_extract_all(regexp_replace(regexp_replace(t, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', '!', 'g'), '[^\\x00-\\x7F]', 'Q', 'g'), '\\b(?:doc|id|ref|tender|file|no|no\\.)[-:\\s]*([a-z0-9/_-]+)\\b', 1), lambda n: length(n) > 4), lambda n: 'Ref Number: ' || n)) AS entities FROM rc)"""


@query("""SELECT doc_id, CASE WHEN regexp_matches(t, 'file noting|note sheet|file note') THEN 'file_request' WHEN regexp_matches(t, 'service book|salary|medical|personal|employee') THEN 'personal_records'
WHEN regexp_matches(t, 'tender|contract|bid|procurement') THEN 'procurement' WHEN regexp_matches(t, 'source code|server|password|security audit|ip address') THEN 'technical_or_security' ELSE 'information_request' END AS category
FROM (SELECT doc_id, lower(coalesce(text, '')) || CASE doc_id % 5 WHEN 0 THEN ' note sheet' WHEN 1 THEN ' service book' WHEN 2 THEN ' procurement' WHEN 3 THEN ' ip address' ELSE '' END AS t FROM documents)""")
def e18_request_category(spark, sf):
    """Whole texts, four of five with a word of a category behind them."""
    docs = view(spark, sf, "docs")
    more = F.when(F.col("doc_id") % 5 == 0, " Note sheet").when(F.col("doc_id") % 5 == 1, " service book").when(F.col("doc_id") % 5 == 2, " procurement").when(F.col("doc_id") % 5 == 3, " IP address").otherwise("")
    return docs.select("doc_id", extraction.request_category(F.concat(F.coalesce("text", F.lit("")), more)).alias("category"))


@query(ctes("requests") + f", {REQUEST_CLASSES} SELECT * EXCLUDE (t) FROM cl")
def e18_classify_requests(spark, sf):
    return extraction.classify_requests(view(spark, sf, "requests"))


@query("SELECT doc_id, 'A. B ' || CAST(doc_id AS VARCHAR) AS name, 'Address not provided' AS address FROM documents")
def e19_applicant_details(spark, sf):
    name, place = extraction.applicant_details(F.concat(F.lit("To\nName: A. B "), F.col("doc_id").cast("string"), F.lit("\n"), "text"))
    return view(spark, sf, "docs").select("doc_id", name.alias("name"), place.alias("address"))


@query(_D + " SELECT count(*) AS cases, 1.0::DOUBLE AS with_number, 1.0::DOUBLE AS with_sections, 1.0::DOUBLE AS with_outcome FROM v_decision_docs")
def e20_extraction_quality(spark, sf):
    return extraction.extraction_quality(extraction.extract_cases(view(spark, sf, "decision_docs"), ["case_number", "rti_sections", "outcome"]))


# --- chunking ---------------------------------------------------------------------------------------------------------


def _sections(spark, sf):
    kind = F.when(F.col("doc_id") % 2 == 0, "COMMISSION_FINDINGS").otherwise("CPIO_REPLY")
    return view(spark, sf, "docs").select("doc_id", kind.alias("section"), "text")


@query()
def c1_chunk_sections(spark, sf):
    cases = view(spark, sf, "docs").select("doc_id", F.col("doc_id").cast("string").alias("case_number"))
    return chunking.chunk_sections(_sections(spark, sf), cases).select("doc_id", "chunk_id", "chunk_type", "part_index", "part_count", "token_count", "text")


# halves to even in integers: 13 n is ten times the tokens
_TOKENS = f"""WITH n AS (SELECT doc_id, 13 * len(list_filter(string_split({_SQUEEZE.format(c='text')}, ' '), lambda w: w <> '')) AS n FROM documents)
SELECT doc_id, CAST(greatest(1, (n + 5) // 10 - CASE WHEN n % 20 = 5 THEN 1 ELSE 0 END) AS INTEGER) AS tokens FROM n"""


@query(_TOKENS)
def c2_approx_tokens(spark, sf):
    return view(spark, sf, "docs").select("doc_id", tx.approx_tokens(F.col("text")).alias("tokens"))


@query(_TOKENS)
def c2_approx_tokens_all(spark, sf):
    return c2_approx_tokens(spark, sf)


@query()
def c3_split_long(spark, sf):
    return view(spark, sf, "docs").select("doc_id", F.posexplode(chunking.split_long(F.col("text"), 200, 40)).alias("part", "text"))


@query()
def c4_synthetic_chunks(spark, sf):
    return chunking.synthetic_chunks(extraction.extract_cases(view(spark, sf, "decision_docs")))


@query()
def c5_summary_chunk(spark, sf):
    return chunking.summary_chunk(extraction.extract_cases(view(spark, sf, "decision_docs"), ["case_number", "precedent", "outcome", "rti_sections", "key_findings"]))


@query()
def c6_chunk_metadata(spark, sf):
    cases = extraction.extract_cases(view(spark, sf, "decision_docs")).withColumn("chunk_type", F.lit("FACTS"))
    return chunking.flatten_metadata(cases.select("doc_id", chunking.chunk_metadata(cases.columns).alias("m")).select("doc_id", "m.*"), ["doc_id", "date", "public_authority", "rti_sections", "exemption_sections", "keywords"])


@query("SELECT c_custkey, 'name' AS facet, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'both', c_name || ', ' || c_mktsegment FROM customer")
def c7_unpivot_profile(spark, sf):
    dim = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("").alias("none"), F.array("c_name", "c_mktsegment").alias("both"))
    return chunking.unpivot_profile(dim, "c_custkey", ["name", "segment", "none", "both"])
