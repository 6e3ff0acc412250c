"""Facts of a case as column expressions over its text, and the tables made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import rules
from casewright.functions import text as tx
from casewright.operators import segmentation
from casewright.sources.scratch import scratch, written


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _once(value: Column, made) -> Column:
    """made(value), where value is worked out once however often `made` names it."""
    return F.transform(F.array(value), made)[0]


def case_number(text: Column) -> Column:
    """The strict form, else a labelled number with a slash or underscore, else UNKNOWN."""
    strict = _some(tx.extract(tx.blank_if_null(text), rules.CASE_NUMBER, 0))
    loose = F.regexp_replace(tx.extract(tx.blank_if_null(text), rules.CASE_NUMBER_FALLBACK, 1), r"\A[ .,:;]+|[ .,:;]+\z", "")
    return F.coalesce(tx.normalize_case_number(strict), tx.normalize_case_number(F.when(loose.rlike("[/_]"), loose)), F.lit("UNKNOWN"))


def _date_text(text: Column, label: str) -> Column:
    found = F.regexp_extract(tx.blank_if_null(text), rf"(?is)(?:{label})\s*:?\s*({rules.DATE}|Not\s+on\s+Record)", 1)
    return F.when(tx.may_match(tx.blank_if_null(text), label), _some(found))


def labelled_date(text: Column, label: str) -> Column:
    """The date after a label; null for "Not on Record"; text that is no known format gives null."""
    return tx.normalize_date(_date_text(text, label))


def labelled_dates(docs: DataFrame, labels=rules.DATE_LABELS) -> DataFrame:
    return _with_dates(docs.select("doc_id", "text"), labels).drop("text")


def _with_dates(docs: DataFrame, labels=rules.DATE_LABELS) -> DataFrame:
    """docs with their dates; what stands after a label is found in a step of its own, as each known format looks at it."""
    found = docs.select("*", *[_date_text(F.col("text"), pattern).alias(name) for name, pattern in labels])
    return found.select(*docs.columns, *[tx.normalize_date(F.col(name)).alias(name) for name, _ in labels])


def citations(text: Column) -> Column:
    """Sections cited by name, without blanks, in lower case, first seen first."""
    return F.array_distinct(F.transform(F.regexp_extract_all(tx.blank_if_null(text), F.lit(tx.ahead(rules.CITATION)), 1), lambda s: F.lower(F.regexp_replace(s, r"\s+", ""))))


def exemptions(cited: Column) -> Column:
    return F.filter(cited, lambda s: s.rlike(rules.EXEMPTION_PREFIX))


def amount(text: Column) -> Column:
    digits = F.regexp_replace(F.regexp_extract(tx.blank_if_null(text), tx.ahead(rules.AMOUNT), 1), r"\D", "")
    return F.when(digits != "", digits).cast("bigint")


def penalty(section: Column, text: Column) -> tuple[Column, Column]:
    """(imposed, amount): an amount anywhere, or penalty words in the penalty section."""
    value = F.coalesce(amount(section), amount(text))
    words = tx.matches(tx.blank_if_null(section), r"(?i)\bpenalt(?:y|ies)\b|\bshow\s*cause\b|\bSection\s*20\b")
    return (F.coalesce(value, F.lit(0)) > 0) | words, value


def _party_lines(text: Column, label: str) -> tuple[Column, Column]:
    after = tx.extract(tx.blank_if_null(text), rf"(?im)^\s*{label}\s*[:\-]\s*(.+)$", 1)
    before = tx.extract(tx.blank_if_null(text), rf"(?im)^(.+?)\s+\.*\s*{label}\b.*$", 1)
    clean = lambda c: F.regexp_replace(c, r"\A[ .,:;\-]+|[ .,:;\-]+\z", "")
    return clean(after), clean(before)


def _party_of(after: Column, before: Column) -> Column:
    ok = lambda c: _once(c, lambda v: F.when((v != "") & (F.length(v) <= 180), v))
    return F.coalesce(ok(after), ok(before))


def party(text: Column, label: str) -> Column:
    """The value of a `label:` line, else what stands before the label on its line."""
    return _party_of(*_party_lines(text, label))


PARTIES = {"appellant": ["appellant", "complainant"], "respondent": ["respondent"], "officer": ["cpio", "pio"], "appellate_authority": ["faa", "first appellate authority"]}


def named_parties(docs: DataFrame) -> DataFrame:
    return _with_parties(docs.select("doc_id", "text")).drop("text")


def _with_parties(docs: DataFrame) -> DataFrame:
    """docs with their parties, then what follows from them. A label's later forms are looked for where the earlier have none."""
    t = F.col("text")
    who = [F.coalesce(*[party(t, label) for label in own]).alias(name) for name, own in PARTIES.items()]
    judge = F.coalesce(_some(F.trim(tx.extract(t, r"(?im)^\s*\[?([A-Z][A-Za-z .]+)\]?\s*\n\s*Information\s+Commissioner", 1), F.lit(" []"))), _some(F.trim(tx.extract(t, r"(?i)(?:Chief )?Information Commissioner\s*[:\-]?\s*([^\n]+)", 1), F.lit(" ,:"))))
    ministry = _some(F.trim(tx.extract(t, r"(?i)\b(Ministry\s+of\s+[A-Za-z &,/.-]+)", 1), F.lit(" ,.")))
    named = docs.select(*docs.columns, *who, judge.alias("commissioner"), ministry.alias("ministry"))
    body = _some(F.trim(tx.squeeze(F.regexp_extract(F.coalesce("respondent", t), rules.PUBLIC_AUTHORITY, 0)), F.lit(" ,.")))
    named = named.withColumn("public_authority", body).withColumn("department", F.when(F.contains("public_authority", F.lit("Department")), F.col("public_authority")))
    return named.select(*docs.columns, "appellant", "respondent", "commissioner", "officer", "appellate_authority", "public_authority", "department", "ministry")


def source_of(text: Column, table=rules.SOURCE_RULES) -> Column:
    out = F
    for name, pattern in table:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("CIC")


def commission_of(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)Central\s+Information\s+Commission"), "Central Information Commission").when(text.rlike(r"(?i)State\s+Information\s+Commission"), "State Information Commission")


def outcome(text: Column, table=rules.DOCUMENT_OUTCOME_RULES, penalty_imposed: Column | None = None) -> Column:
    """The first rule whose pattern the lower-case text has; with penalty_imposed, its rule comes first."""

    def told(low: Column) -> Column:
        out = F if penalty_imposed is None else F.when(penalty_imposed & tx.matches(low, rules.PENALTY_RULE, low), "PENALTY")
        for name, pattern in table:
            out = out.when(tx.matches(low, pattern, low), name)
        return out

    return _once(F.lower(tx.blank_if_null(text)), told)


def reasoning_tags(text: Column, result: Column, table=rules.REASONING_TAGS) -> Column:
    has = lambda low, words: reduce(lambda a, b: a & b, [F.contains(low, F.lit(w)) for w in words], F.lit(True))
    tags = _once(F.lower(tx.blank_if_null(text)), lambda low: F.array(*[F.when(has(low, words), name) for name, words in table]))
    return F.array_distinct(F.array_compact(F.concat(tags, F.array(F.initcap(F.translate(result, "_", " "))))))


def learning_signal(text: Column) -> Column:
    has = lambda w: F.contains(F.lower(tx.blank_if_null(text)), F.lit(w))
    return F.when(has("just and proper") & has("pointwise"), "Pointwise and reasoned CPIO replies are more likely to be upheld.").when(has("directed to provide"), "Incomplete replies can lead to direction for revised pointwise disclosure.").when(has("not called for"), "Commission may decline intervention when reply is proper and appellant does not contest.").otherwise("PIO should verify record custody, statutory exemptions, and provide a reasoned reply.")


def key_sentences(text: Column, words: str = rules.FINDING_WORDS, most: int = 5, first_two: bool = True) -> Column:
    """Sentences of five words or more that hold a key word (or are among the first two of all), the first `most`."""
    long = F.filter(F.transform(tx.sentences(text), lambda s: F.trim(s, F.lit(" -."))), lambda s: F.size(F.split(s, " ")) >= 5)
    if not first_two:
        return F.slice(F.filter(long, lambda s: s.rlike(tx.ahead(words))), 1, most)
    # the second taken sentence is the last that needs no key word
    taken = F.aggregate(long, F.array().cast("array<string>"), lambda acc, s: F.when((F.size(acc) < most) & ((F.size(acc) < 2) | s.rlike(tx.ahead(words))), F.array_append(acc, s)).otherwise(acc))
    return taken


def requested_items(facts: Column) -> Column:
    """What was asked for: the numbered items, else sentences of four words or more, after the marker and before the grounds."""
    once = lambda value, made: F.transform(F.array(value), made)[0]  # noqa: E731  a value that is named several times
    part = lambda t: F.element_at(F.split(F.coalesce(F.try_element_at(F.split(t, tx.ahead(r"(?i)\bsought\s+information\s+(?:on|regarding|about)\b"), 2), F.lit(2)), t), tx.ahead(r"(?i)\bGrounds\s+for\s+(?:Second\s+)?Appeal\b|\bCPIO\s+reply\b"), 2), 1)
    edge = lambda s: F.regexp_replace(s, r"\A[ ;.]+|[ ;.]+\z", "")
    numbered = lambda p: F.slice(F.filter(F.transform(F.regexp_extract_all(p, F.lit(r"(?:^|\s)(?:\d+[).]|[a-z]\))\s*([^.;]+(?:[.;]|$))"), 1), lambda s: edge(tx.compact(s, 220))), lambda s: s != ""), 1, 12)
    # eight sentences are looked at: the rest of the text stays one piece
    plain = lambda p: F.transform(F.filter(F.slice(F.split(p, r"(?<=[.!?])\s+", 9), 1, 8), lambda s: F.size(F.split(F.trim(s), r"\s+")) >= 4), lambda s: edge(tx.compact(s, 240)))
    return once(once(tx.squeeze(facts), part), lambda p: once(numbered(p), lambda n: F.when(F.size(n) > 0, n).otherwise(plain(p))))


def final_order(text: Column, patterns=rules.FINAL_ORDER_PATTERNS) -> Column:
    # each text is squeezed once, and what a pattern finds is squeezed once
    found = lambda t, p: F.transform(F.array(F.when(tx.matches(t, p), F.regexp_extract(t, p, 1))), lambda x: F.when(x.isNotNull(), tx.compact(x, 650)))[0]
    return F.transform(F.array(tx.squeeze(text)), lambda t: F.coalesce(*[found(t, p) for p in patterns]))[0]


def references(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(tx.blank_if_null(text), F.lit(pattern), 0), tx.squeeze), lambda s: s != ""))


def entities(docs: DataFrame, most: int = 12, general: bool = False) -> DataFrame:
    """People, authorities, departments and locations, first seen first, from bounded starts of the text; with `general`, names
    of any kind as `entities`.

    An appellant and a public_authority, where docs have these columns, come first among people and authorities.
    """
    return docs.select("doc_id", *[c.alias(name) for name, c in _entity_columns(docs, most).items()], *([general_entities(docs).alias("entities")] if general else []))


ONE_LINE = (rules.AUTHORITIES, rules.DEPARTMENTS, rules.LOCATIONS)  # no match of these holds a line end


def _entity_columns(docs: DataFrame, most: int = 12) -> dict[str, Column]:
    def found(p: str, n: int, lead: str = "") -> Column:
        start = F.substring(tx.blank_if_null(F.col("text")), 1, n)
        if p in ONE_LINE:  # tried from every capital of a long line these are dear, and only lines with their words can match
            lines = F.filter(F.split(start, "\n"), lambda s: tx.may_match(s, p))
            all_of = F.flatten(F.transform(lines, lambda s: F.regexp_extract_all(s, F.lit(tx.ahead(p)), 0)))
        else:
            all_of = F.regexp_extract_all(start, F.lit(tx.ahead(p)), 0)
        seen = F.transform(all_of, lambda s: F.trim(tx.squeeze(s), F.lit(" ,.")))
        return F.slice(F.array_distinct(F.concat(_lead(docs, lead), seen)), 1, most)

    return {"people": found(rules.PEOPLE, 5000, "appellant"), "authorities": found(rules.AUTHORITIES, 6000, "public_authority"), "departments": found(rules.DEPARTMENTS, 6000), "locations": found(rules.LOCATIONS, 8000)}


def _lead(docs: DataFrame, name: str) -> Column:
    some = F.filter(F.array(F.col(name)), lambda v: F.coalesce(v, F.lit("")) != "") if name in docs.columns else F.array()
    return some.cast("array<string>")


def general_entities(docs: DataFrame, most: int = 20, chars: int = 5000, longest: int = 80, patterns=rules.GENERAL_ENTITIES) -> Column:
    """Names of any kind in the first characters, pattern by pattern, each once; the public_authority, if docs have one, first."""
    names = [F.transform(F.regexp_extract_all(F.substring(tx.blank_if_null(F.col("text")), 1, chars), F.lit(tx.ahead(p)), 0), tx.squeeze) for p in patterns]
    return F.slice(F.array_distinct(F.concat(_lead(docs, "public_authority"), F.filter(F.concat(*names), lambda v: F.length(v) <= longest))), 1, most)


def precedent_summary(items: Column, observations: Column, order: Column, result: Column) -> Column:
    """What was sought, observed (the strongest first), ordered and decided, in 1200 characters."""
    strong = F.filter(observations, lambda s: s.rlike(r"(?i)just\s+and\s+proper|pointwise|interference|directed|disclosed|exempt"))
    chosen = F.slice(F.array_union(strong, observations), 1, 4)
    said = lambda label, a: F.when(F.size(a) > 0, F.concat(F.lit(label), F.array_join(a, "; ")))
    parts = F.concat_ws(". ", said("Applicant sought ", F.slice(items, 1, 4)), said("Commission observed ", chosen), F.concat(F.lit("Final order: "), order), F.concat(F.lit("Outcome: "), result))
    return F.when(parts != "", tx.compact(parts, 1200))


# What each present field adds.
CONFIDENCE = {"case_number": 0.20, "decision_date": 0.10, "sections_invoked": 0.15, "party": 0.10, "request": 0.08, "findings": 0.08, "outcome": 0.04}


def extraction_confidence(present: dict[str, Column], weights: dict[str, float] = CONFIDENCE, base: float = 0.25, most: float = 1.0) -> Column:
    total = F.lit(base)
    for name, has in present.items():
        total = total + F.when(F.coalesce(has, F.lit(False)), weights[name]).otherwise(0.0)
    return F.round(F.least(total, F.lit(most)), 3)


def merge_layers(base: DataFrame, overlay: DataFrame, semantic: list[str], flags: list[str]) -> DataFrame:
    """The overlay's non-empty semantic fields win, all others stay; flags are joined by or."""
    kinds = dict(base.dtypes)
    top = overlay.select("doc_id", *[F.col(c).alias(f"_{c}") for c in [*semantic, *flags]])
    filled = lambda c: F.when(F.size(F.col(c)) > 0, F.col(c)) if kinds[c[1:]].startswith("array") else _some(F.col(c))
    out = base.join(top, "doc_id", "left")
    return out.select(*[F.coalesce(filled(f"_{c}"), c).alias(c) if c in semantic else (F.coalesce(F.col(c), F.lit(False)) | F.coalesce(F.col(f"_{c}"), F.lit(False))).alias(c) if c in flags else F.col(c) for c in base.columns])


def list_field(text: Column, sections: bool = False) -> Column:
    """A text with , ; or line ends as a list: tidied, not empty, first-seen without case; sections lose their word and blanks."""
    tidy = lambda s: F.regexp_replace(F.regexp_replace(F.trim(s), r"(?i)^section\s+", ""), r"\s+", "") if sections else tx.squeeze(s)
    items = F.transform(F.split(tx.blank_if_null(text), r"[,;\n]+"), lambda s: F.trim(tidy(s), F.lit(" -•\t\n.")))
    return tx.unique_by_lower(F.filter(items, lambda s: s != ""))


def normalize_outcome(text: Column, aliases=rules.OUTCOME_ALIASES, known=rules.OUTCOMES) -> Column:
    """The outcome that the text names, by letters alone; null for a name that is none."""
    name = F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), "[^A-Z]+", "_"), r"^_+|_+$", "")
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    mapped = F.coalesce(F.try_element_at(table, name), name)
    return F.when(mapped.isin(known), mapped)


def short_findings(values: Column, most: int = 5, words: int = 38) -> Column:
    return F.slice(F.filter(F.transform(values, lambda s: F.array_join(F.slice(tx.words(s), 1, words), " ")), lambda s: s != ""), 1, most)


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))))


def _has_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(tx.blank_if_null(text)), w))


def classify_requests(requests: DataFrame, table=rules.REQUEST_RULES) -> DataFrame:
    """(request_id, information_type, procurement_status, personal_data, public_interest_override, systems, entities)."""
    t = F.col("text")
    kind = F
    for name, words in table:
        kind = kind.when(_has_any(t, words), name)
    kind = kind.otherwise("other")
    tender = F.when(kind == "procurement", F.when(_has_any(t, rules.ACTIVE_TENDER_WORDS), "active_tender").otherwise("completed_tender")).otherwise("none")
    systems = F.transform(F.filter(F.array(*map(F.lit, rules.SYSTEM_WORDS)), lambda w: F.contains(F.lower(tx.blank_if_null(t)), w)), F.upper)
    dates = F.transform(F.regexp_extract_all(tx.blank_if_null(t), F.lit(rules.REQUEST_DATE), 0), lambda d: F.concat(F.lit("Date: "), d))
    numbers = F.filter(F.regexp_extract_all(F.lower(tx.blank_if_null(t)), F.lit(rules.REQUEST_REFERENCE), 1), lambda n: F.length(n) > 4)
    entities = F.concat(dates, F.transform(numbers, lambda n: F.concat(F.lit("Ref Number: "), n)))
    personal = kind.isin(rules.PERSONAL_TYPES) | _has_any(t, rules.PERSONAL_WORDS)
    return requests.select("request_id", kind.alias("information_type"), tender.alias("procurement_status"), personal.alias("personal_data"), _has_any(t, rules.PUBLIC_INTEREST_WORDS).alias("public_interest_override"), systems.alias("systems"), entities.alias("entities"))


def request_category(text: Column, table=rules.REQUEST_CATEGORIES) -> Column:
    """The first category of which the text has a word, else information_request."""
    out = F
    for name, words in table:
        out = out.when(_has_any(text, words), name)
    return out.otherwise("information_request")


def applicant_details(text: Column) -> tuple[Column, Column]:
    """(name, address) after their labels in English or Hindi, with defaults."""
    name = _some(F.trim(F.regexp_extract(text, r"(?im)^\s*(?:Name|Applicant|नाम|आवेदक)\s*[:\-]\s*(.+)$", 1)))
    place = _some(F.trim(F.regexp_extract(text, r"(?im)^\s*(?:Address|पता)\s*[:\-]\s*(.+)$", 1)))
    return F.coalesce(name, F.lit("Applicant")), F.coalesce(place, F.lit("Address not provided"))


# What makes a case a good sample.
SAMPLE_SCORE = {"case_number": 4, "decision_date": 3, "appellant_name": 2, "respondent_name": 2, "department": 2, "rti_sections": 5, "outcome": 3}


def extraction_quality(cases: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return cases.agg(F.count("*").alias("cases"), share(F.coalesce(F.col("case_number"), F.lit("UNKNOWN")) != "UNKNOWN").alias("with_number"), share(F.coalesce(F.size("rti_sections"), F.lit(0)) > 0).alias("with_sections"), share(F.col("outcome").isNotNull()).alias("with_outcome"))


def representative_cases(cases: DataFrame, n: int = 5) -> DataFrame:
    """The n cases with the most facts."""
    score = F.lit(0)
    for c, v in SAMPLE_SCORE.items():
        has = F.size(c) > 0 if dict(cases.dtypes)[c].startswith("array") else F.col(c).isNotNull() & (F.col(c).cast("string") != "") & (F.col(c).cast("string") != "UNKNOWN")
        score = score + F.when(has, v).otherwise(0)
    return cases.withColumn("sample_score", score).orderBy(F.desc("sample_score"), "case_number").limit(n)


def extract_cases(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """documents (doc_id, text) to one case each, with the fields of the case table, or those named beside doc_id.

    The table is written once: what reads it, filters it or names a field several times makes no search of a text again.
    """
    spark = docs.sparkSession
    clean = docs.select("doc_id", tx.clean_text(F.col("text"), 3).alias("text"))
    # the searches of a text cost far more than dealing the texts out evenly
    dealt = clean.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    found = segmentation.with_matches(dealt, blocks=rules.LABELLED_BLOCKS)
    return written(case_table(found, fields), scratch(spark, "cases-made"))


def case_table(found: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """clean texts and their labelled blocks (doc_id, text, blocks) to cases; all is found in a document's own row."""
    block = lambda name: _once(segmentation.block_of(F.col("text"), F.col("blocks"), F.lit(name)), lambda t: F.when(t.isNotNull(), tx.squeeze(t)))
    clean = found.select("doc_id", "text", *[block(b).alias(f"_{b}") for b in ("facts", "grounds")])
    known = _with_dates(_with_parties(clean))
    named = known.select("*", *[c.alias(f"entities_{name}") for name, c in _entity_columns(known).items()], general_entities(known).alias("entities"))
    base = named.select("*", F.col("_facts").alias("facts"), F.col("_grounds").alias("grounds")).drop("_facts", "_grounds")
    cited = citations(F.col("text"))
    imposed, value = penalty(F.col("text"), F.col("text"))
    observed = key_sentences(F.col("text"), rules.OBSERVATION_WORDS, 6, first_two=False)
    out = base.withColumn("case_number", case_number(F.col("text"))).withColumn("rti_sections", cited).withColumn("penalty_amount", value).withColumn("penalty_imposed", imposed)
    out = out.withColumn("outcome", F.coalesce(outcome(F.col("text"), rules.OUTCOME_RULES, F.col("penalty_imposed")), outcome(F.col("text")))).withColumn("key_findings", observed)
    out = out.withColumn("exemption_sections", exemptions(F.col("rti_sections"))).withColumn("source", source_of(F.col("text"))).withColumn("public_interest_discussed", tx.matches(F.col("text"), r"(?i)public\s+interest|Section\s*8\s*\(\s*2\s*\)"))
    out = out.withColumn("commission", commission_of(F.col("text"))).withColumn("information_requested", requested_items(F.coalesce("facts", "text"))).withColumn("final_order", final_order(F.col("text")))
    out = out.withColumn("reasoning_pattern", reasoning_tags(F.col("text"), F.col("outcome"))).withColumn("learning_signal", learning_signal(F.col("text")))
    out = out.withColumn("precedent", precedent_summary(F.col("information_requested"), F.col("key_findings"), F.col("final_order"), F.col("outcome")))
    present = {"case_number": F.col("case_number") != "UNKNOWN", "decision_date": F.col("decision_date").isNotNull(), "sections_invoked": F.size("rti_sections") > 0, "party": F.coalesce("appellant", "respondent").isNotNull(), "request": F.lit(False), "findings": F.size("key_findings") > 0, "outcome": F.col("outcome").isNotNull()}
    out = out.withColumn("extraction_confidence", extraction_confidence(present)).drop("text")
    return out if fields is None else out.select("doc_id", *fields)
