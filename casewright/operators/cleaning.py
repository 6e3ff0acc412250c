"""Text cleaning over tables of pages and lines.

Line passes keep (doc_id, line_no, line), so several run one after the other and a document is put together once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import rules
from casewright.functions import text as tx


def _line():
    return Window.partitionBy("doc_id").orderBy("line_no")


def _so_far():
    return _line().rowsBetween(Window.unboundedPreceding, 0)


def page_markers(text: Column) -> Column:
    """Page comments in one form, with blank lines around them."""
    return F.regexp_replace(F.regexp_replace(tx.blank_if_null(text), r"\s*<!--\s*[Pp]age\s*(\d+)\s*-->\s*", "\n\n<!-- page $1 -->\n\n"), "\n{3,}", "\n\n")


def explode_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_no, text): what follows each page comment; text before the first is page 0 if it is not blank."""
    parts = F.split(page_markers(F.col("text")), r"<!-- page (?=\d+ -->)")
    rows = docs.select("doc_id", F.posexplode_outer(parts).alias("k", "part")).where("k is not null")  # see tx.each
    page = F.when(F.col("k") == 0, 0).otherwise(F.expr(r"try_cast(regexp_extract(part, '\\A(\\d+) -->', 1) AS INT)"))
    text = F.trim(F.when(F.col("k") == 0, F.col("part")).otherwise(F.regexp_replace("part", r"\A\d+ -->", "")), F.lit("\n "))
    return rows.where((F.col("k") > 0) | (F.trim("part", F.lit("\n ")) != "")).select("doc_id", page.alias("page_no"), text.alias("text"))


def apply_fixes(text: Column, fixes=rules.OCR_FIXES) -> Column:
    for pattern, replacement in fixes:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def critical_fields(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, kind, raw, value, unit, suspicious) for dates, amounts and reference numbers."""
    t = F.col("text")
    whole = lambda p, g: F.regexp_extract_all(t, F.lit(p), g)
    date, amount, ref = rules.CRITICAL_DATE, rules.CRITICAL_AMOUNT, rules.CRITICAL_REFERENCE
    dates = F.transform(F.arrays_zip(whole(date, 0).alias("raw"), whole(date, 1).alias("d"), whole(date, 2).alias("m"), whole(date, 3).alias("y")), lambda x: F.struct(F.lit("date").alias("kind"), x["raw"].alias("raw"), F.concat_ws("/", x["d"], x["m"], x["y"]).alias("value"), F.lit("").alias("unit"), ((x["d"].cast("int") > 31) | (x["m"].cast("int") > 12)).alias("suspicious")))
    amounts = F.transform(F.arrays_zip(whole(amount, 0).alias("raw"), whole(amount, 1).alias("v"), whole(amount, 2).alias("u")), lambda x: F.struct(F.lit("amount").alias("kind"), x["raw"].alias("raw"), F.regexp_replace(x["v"], ",", "").alias("value"), F.coalesce(x["u"], F.lit("")).alias("unit"), F.lit(False).alias("suspicious")))
    refs = F.transform(F.arrays_zip(whole(ref, 0).alias("raw"), whole(ref, 1).alias("v")), lambda x: F.struct(F.lit("reference").alias("kind"), x["raw"].alias("raw"), bare(x["v"]).alias("value"), F.lit("").alias("unit"), F.contains(x["v"], F.lit("$")).alias("suspicious")))
    return pages.select("doc_id", "page_no", tx.each(F.concat(dates, amounts, refs)).alias("f")).where("f is not null").select("doc_id", "page_no", "f.*")


def document_quality(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Per document: counts by kind, suspicious values, and what is missing altogether."""
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    seen = fields.groupBy("doc_id").agg(n("date").alias("dates"), n("amount").alias("amounts"), n("reference").alias("refs"), F.count(F.when(F.col("suspicious"), 1)).alias("suspicious"))
    full = docs.select("doc_id").distinct().join(seen, "doc_id", "left").fillna(0)
    flags = F.array_compact(F.array(F.when(F.col("dates") == 0, "no dates"), F.when(F.col("refs") == 0, "no reference numbers"), F.when(F.col("suspicious") > 0, "suspicious values")))
    return full.withColumn("flags", flags)


# --- lines ------------------------------------------------------------------------------------------------------------


def explode_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode_outer(F.split(F.regexp_replace(tx.blank_if_null(F.col("text")), "\r\n?", "\n"), "\n")).alias("line_no", "line"))  # see tx.each; no split is empty


def assemble_lines(lines: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def bare(line: Column) -> Column:
    return F.trim(line, F.lit(tx.BLANKS))


def is_table_row(line: Column) -> Column:
    s = bare(line)
    return F.startswith(s, F.lit("|")) & F.endswith(s, F.lit("|")) & (F.length(F.regexp_replace(s, "[^|]", "")) >= 2)


def drop_artifact_lines(lines: DataFrame) -> DataFrame:
    """Page numbers, lone symbols and short noise go; tables, headers, comments, blanks and code stay."""
    s = bare(F.col("line"))
    fence = F.startswith(s, F.lit("```"))
    fences = F.sum(fence.cast("int")).over(_so_far())
    kept = (s == "") | is_table_row(s) | F.startswith(s, F.lit("#")) | F.startswith(s, F.lit("<!--"))
    page = s.rlike(r"(?i)\A\s*[-—]*\s*(Page\s*)?\d{1,4}\s*[-—]*\s*\z")
    noise = (F.length(s) <= 3) & ~s.rlike("[ऀ-ॿA-Za-z]")
    thin = (F.length(s) < 5) & (F.length(F.regexp_replace(s, "[^ऀ-ॿA-Za-z0-9]", "")) < 2)
    return lines.withColumn("_in", fences % 2 == 1).where(F.col("_in") | fence | kept | ~(page | noise | thin)).drop("_in")


def fix_headers(lines: DataFrame) -> DataFrame:
    """One blank after the marks, no bold, no trailing colons or dashes; a header equal to the line before goes.

    A blank line stands before each header that follows text.
    """
    s = bare(F.col("line"))
    head = s.rlike(r"\A#{1,6}")
    content = F.regexp_replace(F.regexp_replace(bare(F.regexp_extract(s, r"(?s)\A#{1,6}\s*(.*)", 1)), r"\A\*\*(.+?)\*\*\z", "$1"), r"[:-]+\z", "")
    fixed = F.rtrim(F.concat(F.regexp_extract(s, r"\A(#{1,6})", 1), F.lit(" "), content))
    out = lines.withColumn("_head", head).withColumn("line", F.when(head, fixed).otherwise(F.col("line")))
    out = out.withColumn("_before", F.when(F.lag("_head").over(_line()), F.lag("line").over(_line())))
    out = out.where(~(F.col("_head") & F.col("line").eqNullSafe(F.col("_before"))))
    gap = F.col("_head") & (bare(F.coalesce(F.lag("line").over(_line()), F.lit(""))) != "")
    rows = out.withColumn("_gap", gap).select("doc_id", "line_no", F.explode(F.when(F.col("_gap"), F.array(F.lit(""), F.col("line"))).otherwise(F.array("line"))).alias("line"), F.col("_gap"))
    first = (F.col("line") == "") & F.col("_gap")
    return rows.select("doc_id", (F.col("line_no") * 2 + F.when(first, 0).otherwise(1)).alias("line_no"), "line")


def repair_tables(lines: DataFrame) -> DataFrame:
    """Each run of table rows: cells padded to the widest, rows of one repeated value as a bold label, one separator.

    The separator stands after the first row. Blank lines between rows of a run go, and one follows it.
    """
    row = is_table_row(F.col("line"))
    blank = bare(F.col("line")) == ""
    texts = F.sum((~row & ~blank).cast("int")).over(_so_far())
    out = lines.withColumn("_row", row).withColumn("_blank", blank).withColumn("_run", texts)
    own = Window.partitionBy("doc_id", "_run")
    place = F.sum(F.col("_row").cast("int")).over(own.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("_place", place).where((F.col("_place") == 0) | ~F.col("_blank"))  # of a row its number, too
    inner = F.transform(F.split(F.regexp_replace(bare(F.col("line")), r"\A\|+|\|+\z", ""), r"\|"), bare)
    out = out.withColumn("_cells", F.when(F.col("_row"), inner))
    width = F.max(F.when(F.col("_row"), F.size("_cells"))).over(own)
    last = F.max(F.when(F.col("_row"), F.col("line_no"))).over(own)
    out = out.withColumn("_width", width).withColumn("_last", last)
    filled = F.filter("_cells", lambda c: c != "")
    span = (F.size(filled) > 1) & (F.size(F.array_distinct(filled)) == 1)
    separator = F.forall("_cells", lambda c: c.rlike(r"\A:?-+:?\z") | (c == ""))
    padded = F.concat("_cells", F.array_repeat(F.lit(""), F.col("_width") - F.size("_cells")))
    label = F.concat(F.array(F.concat(F.lit("**"), F.element_at("_cells", 1), F.lit("**"))), F.array_repeat(F.lit(""), F.col("_width") - 1))
    render = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = render(F.array_repeat(F.lit("---"), F.col("_width")))
    body = F.when(span, F.array(render(label))).when(separator, F.when(F.col("_place") == 1, F.array(rule)).otherwise(F.array().cast("array<string>"))).otherwise(F.array(render(padded)))
    body = F.when((F.col("_place") == 1) & ~(separator & ~span), F.array_append(body, rule)).otherwise(body)
    body = F.when(F.col("line_no") == F.col("_last"), F.array_append(body, F.lit(""))).otherwise(body)
    parts = F.when(F.col("_row"), body).otherwise(F.array("line"))
    rows = out.select("doc_id", "line_no", F.posexplode_outer(parts).alias("k", "line")).where("k is not null")
    return rows.select("doc_id", (F.col("line_no") * 4 + F.col("k")).alias("line_no"), "line")


def renumber_lists(lines: DataFrame) -> DataFrame:
    """Bullets as dashes, `1)` as `1.`, and numbers counted anew in each run of a list.

    A number is the items so far less those up to the last line that ended a list: all in the lines' own order.
    """
    line = F.regexp_replace(F.regexp_replace("line", r"\A(\s*)[–—•▪➤►▶]\s+", "$1- "), r"\A(\s*)(\d+)\)\s+", "$1$2. ")
    out = lines.withColumn("line", line).withColumn("_item", F.col("line").rlike(r"\A\s*\d+\.\s+"))
    ends = ~F.col("_item") & (bare(F.col("line")) != "") & ~F.startswith(bare(F.col("line")), F.lit("-"))
    out = out.withColumn("_ends", ends).withColumn("_n", F.sum(F.col("_item").cast("int")).over(_so_far()))
    out = out.withColumn("_before", F.max(F.when(F.col("_ends"), F.col("_n"))).over(_so_far()))
    number = F.col("_n") - F.coalesce("_before", F.lit(0))
    numbered = F.concat(F.regexp_extract("line", r"\A(\s*)", 1), number.cast("string"), F.lit(". "), F.regexp_extract("line", r"(?s)\A\s*\d+\.\s+(.*)", 1))
    return out.withColumn("line", F.when(F.col("_item"), numbered).otherwise(F.col("line"))).drop("_item", "_ends", "_n", "_before")


def dedup_paragraphs(lines: DataFrame) -> DataFrame:
    """Of a document's long lines (over 30 characters, no table, header or comment) that agree without case, the first."""
    s = bare(F.col("line"))
    lines = lines.withColumn("_form", F.lower(F.regexp_replace(s, tx.RUNS, " ")))  # a column, as it is named twice
    counts = (F.length("_form") > 30) & ~is_table_row(s) & ~F.startswith(s, F.lit("#")) & ~F.startswith(s, F.lit("<!--"))
    key = F.when(counts, F.col("_form")).otherwise(F.concat(F.lit("\n"), F.col("line_no").cast("string")))
    first = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy("line_no"))
    return lines.withColumn("_key", key).drop("_form").withColumn("_k", first).where("_k = 1").drop("_key", "_k")


def join_hyphenated(lines: DataFrame) -> DataFrame:
    """No trailing blanks, single inner blanks; a line that ends in a dash takes the next if that starts lower-case."""
    line = F.rtrim("line", F.lit(tx.BLANKS))
    line = F.when(~F.contains(line, F.lit("  ")) | is_table_row(line), line).otherwise(F.regexp_replace(line, r"(?<!\|)  +(?!\|)", " "))
    out = lines.withColumn("line", line)
    joins = F.endswith(F.lag("line").over(_line()), F.lit("-")) & F.col("line").rlike(r"\A\p{Ll}")
    out = out.withColumn("_joins", F.coalesce(joins, F.lit(False))).withColumn("_open", F.coalesce(F.lead("_joins").over(_line()), F.lit(False)))
    out = out.withColumn("_to", F.sum((~F.col("_joins")).cast("int")).over(_so_far()))
    piece = F.when(F.col("_open"), F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    joined = out.withColumn("piece", piece).groupBy("doc_id", "_to").agg(F.min("line_no").alias("line_no"), F.sort_array(F.collect_list(F.struct("line_no", "piece"))).alias("p"))
    return joined.select("doc_id", "line_no", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("line"))


def clean_markdown(docs: DataFrame) -> DataFrame:
    """All line passes in order; a document is put together once."""
    lines = explode_lines(docs.select("doc_id", page_markers(F.regexp_replace(tx.blank_if_null(F.col("text")), "\r\n?", "\n")).alias("text")))
    for step in (drop_artifact_lines, fix_headers, repair_tables, renumber_lists, dedup_paragraphs, join_hyphenated):
        lines = step(lines)
    text = F.regexp_replace(F.regexp_replace("text", "\n{3,}", "\n\n"), r"(<!-- page \d+ -->)\n{2,}", "$1\n")
    return assemble_lines(lines).select("doc_id", bare(text).alias("text"))


def reduction_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Characters in and out and percent reduced, per document and in all (doc_id null).

    The percentage is rounded from whole numbers, halves away from zero: 2,000 characters that become 1,413 are 29.4.
    """
    both = before.select("doc_id", F.length(tx.blank_if_null(F.col("text"))).alias("a")).join(after.select("doc_id", F.length(tx.blank_if_null(F.col("text"))).alias("b")), "doc_id")
    out = both.rollup("doc_id").agg(F.sum("a").alias("chars_in"), F.sum("b").alias("chars_out"))
    tenths = F.expr("sign(chars_in - chars_out) * ((2000 * abs(chars_in - chars_out) + chars_in) div (2 * chars_in))")
    return out.withColumn("reduced_pct", F.when(F.col("chars_in") > 0, tenths / 10).otherwise(0.0))


def strip_embedded_images(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda s: ~s.rlike(r"\A\s*!\[[^\]]*\]\(data:image/")), "\n")


# --- spelling ---------------------------------------------------------------------------------------------------------


def _deletes(word: Column, depth: int) -> Column:
    """The word and all words left by deleting up to `depth` of its characters."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    out = F.array(word)
    level = F.array(word)
    for _ in range(depth):
        level = F.array_distinct(F.flatten(F.transform(level, once)))
        out = F.array_union(out, level)
    return out


def spell_candidates(words: DataFrame, dictionary: DataFrame, low: int = 3, high: int = 6) -> DataFrame:
    """words (word) not in dictionary (word, freq), with the closest and then most frequent entry where it is accepted.

    Words that lie one or two edits apart share a deletion variant, so candidates come from an equi-join.
    """
    unknown = words.select("word").distinct().where(F.length("word").between(low, high)).join(dictionary.select("word"), "word", "left_anti")
    near = unknown.select("word", F.explode(F.when(F.length("word") <= 4, _deletes(F.col("word"), 1)).otherwise(_deletes(F.col("word"), 2))).alias("variant"))
    known = dictionary.where(F.length("word").between(low - 2, high + 2)).select(F.col("word").alias("term"), "freq", F.explode(_deletes(F.col("word"), 2)).alias("variant"))
    pairs = near.join(known, "variant").select("word", "term", "freq").distinct().withColumn("distance", F.levenshtein("word", "term"))
    most = F.when(F.length("word") <= 4, 1).otherwise(2)
    order = Window.partitionBy("word").orderBy("distance", F.desc("freq"), "term")
    best = pairs.where(F.col("distance") <= most).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    needed = F.when(F.col("distance") == 1, 4).otherwise(50)
    return best.withColumn("accepted", F.col("freq") >= needed)


def apply_corrections(docs: DataFrame, corrections: DataFrame, word: str = r"[ऀ-ॿ]+") -> tuple[DataFrame, DataFrame]:
    """(documents with corrected words, log of word and term counts); structural lines stay as they are.

    Of a document each distinct piece is joined to the corrections once, and those it has come back to it as a map: what is
    shuffled is its vocabulary and its text, not a row for each piece. A word with several terms takes the first of them.
    """
    text = F.regexp_replace(tx.blank_if_null(F.col("text")), "\r\n?", "\n")

    def structural(line: Column) -> Column:
        s = bare(line)
        return (s == "") | s.rlike(r"\A(?:[:॥#|>]|```|<!--|---)") | s.rlike(r"\A[-*]\s") | s.rlike(r"\A\d+\.\s")

    marked = lambda line: F.filter(F.split(F.regexp_replace(line, f"({word})", "\u0001$1\u0001"), "\u0001"), lambda x: x != "")
    pieces = F.flatten(F.transform(F.filter(F.split(text, "\n"), lambda line: ~structural(line)), marked))
    fix = corrections.where("accepted").groupBy(F.col("word").alias("piece")).agg(F.min("term").alias("term"))
    some = docs.select("doc_id", tx.each(F.array_distinct(pieces)).alias("piece")).where("piece is not null")
    own = some.join(fix, "piece").groupBy(F.col("doc_id").alias("_of")).agg(F.map_from_entries(F.collect_set(F.struct("piece", "term"))).alias("_terms"))
    both = docs.select("doc_id", text.alias("text")).join(own, F.col("doc_id").eqNullSafe(F.col("_of")), "left")
    fixed = lambda line: F.array_join(F.transform(marked(line), lambda x: F.coalesce(F.try_element_at(F.col("_terms"), x), x)), "")
    lines = F.transform(F.split("text", "\n"), lambda line: F.when(structural(line), line).otherwise(fixed(line)))
    changed = F.col("_terms").isNotNull() | F.contains(F.col("text"), F.lit("\u0001"))
    log = docs.select(tx.each(pieces).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("n"))
    log = log.join(fix.withColumnRenamed("piece", "word"), "word").select("word", "term", "n")
    return both.select("doc_id", F.when(changed, F.array_join(lines, "\n")).otherwise(F.col("text")).alias("text")), log


def boost_frequencies(dictionary: DataFrame, words: DataFrame, step: int = 500) -> DataFrame:
    """dictionary with `step` more for each occurrence of a known word."""
    seen = words.groupBy("word").agg(F.count("*").alias("n"))
    return dictionary.join(seen, "word", "left").select("word", (F.col("freq") + step * F.coalesce("n", F.lit(0))).alias("freq"))
