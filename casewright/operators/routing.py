"""Requests to departments, rules to flags, names to names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import rules
from casewright.functions import text as tx

SELF = "chips"


def request_tokens(text: Column) -> Column:
    """Latin words in lower case, then Devanagari words."""
    t = tx.blank_if_null(text)
    return F.concat(F.transform(F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9\-]+"), 0), F.lower), F.regexp_extract_all(t, F.lit(r"[ऀ-ॿ]+"), 0))


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))))


def _keywords_inside(tok: DataFrame, kw: DataFrame) -> DataFrame:
    """(request_id, kws): keywords of which a text holds the rarest trigram (or the whole, if it is shorter)."""
    words = kw.select("kw").distinct()
    size = F.least(F.length("kw"), F.lit(3))
    own = F.when(size == 3, _grams(F.col("kw"), 3)).otherwise(F.array("kw"))
    grams = words.where("kw <> ''").select("kw", tx.each(own).alias("gram")).where("gram is not null")
    rare = grams.join(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram").groupBy("kw").agg(F.min(F.struct("n", "gram")).alias("rare")).select("kw", F.col("rare.gram").alias("gram"))
    lengths = [r.n for r in rare.select(F.length("gram").alias("n")).distinct().collect()]  # 1, 2 or 3
    held = tok.select("request_id", tx.each(F.array_distinct(F.flatten(F.array_compact(F.array(*[_grams(F.col("joined"), n) for n in lengths] or [F.array().cast("array<string>")]))))).alias("gram")).where("gram is not null")
    found = held.join(rare, "gram").groupBy("request_id").agg(F.collect_set("kw").alias("kws"))
    if words.where("kw = ''").isEmpty():
        return found
    every = tok.select("request_id").distinct().join(found, "request_id", "left")
    return every.select("request_id", F.concat(F.coalesce("kws", F.array().cast("array<string>")), F.array(F.lit(""))).alias("kws"))


KEYWORDS = 2000  # of all departments, up to which they travel as one row


def route_keywords(requests: DataFrame, departments: DataFrame, most: int = KEYWORDS) -> DataFrame:
    """(request_id, department_id, hits, keyword_score) for every department with a keyword in the request.

    A keyword counts 1 as a token or, of several words, within the tokens; half inside a token; the department's own id
    adds 3 once something matched. Up to `most` keywords travel as one array beside each request; more of them are found
    by an index of letter trigrams, so that the cost follows the matches and not requests times keywords.

    Defined cases: a null text has no tokens; rows that repeat a request_id add up; an empty keyword is inside every text.
    """
    kw = departments.select("department_id", F.explode(F.array_distinct(F.concat(F.transform("keywords_en", F.lower), "keywords_hi"))).alias("kw"))
    tok = requests.select("request_id", request_tokens(F.col("text")).alias("tokens")).withColumn("joined", F.array_join("tokens", " "))
    worth = lambda k: F.when(F.array_contains(F.col("tokens"), k), 1.0).when(F.contains(k, F.lit(" ")) & F.contains(F.col("joined"), k), 1.0).when(~F.contains(k, F.lit(" ")) & F.contains(F.col("joined"), k), 0.5).otherwise(0.0)
    if kw.count() <= most:
        table = kw.groupBy().agg(F.sort_array(F.collect_list(F.struct("department_id", "kw"))).alias("table"))
        hits = F.filter(F.transform("table", lambda k: F.struct(k["department_id"].alias("department_id"), worth(k["kw"]).alias("w"))), lambda x: x["w"] > 0)
        rows = tok.join(F.broadcast(table)).select("request_id", "joined", tx.each(hits).alias("h")).where("h is not null")  # table is one row of at most `most` keywords
    else:
        held = tok.join(_keywords_inside(tok, kw), "request_id").select("request_id", "tokens", "joined", "kws")
        hits = F.filter(F.transform("kws", lambda k: F.struct(k.alias("kw"), worth(k).alias("w"))), lambda x: x["w"] > 0)
        rows = held.select("request_id", "joined", tx.each(hits).alias("x")).where("x is not null")
        rows = rows.join(kw, F.col("x.kw") == F.col("kw")).select("request_id", "joined", F.struct("department_id", "x.w").alias("h"))
    out = rows.groupBy("request_id", "h.department_id").agg(F.sum("h.w").alias("w"), F.max(F.contains("joined", F.lower(F.col("h.department_id")))).alias("named"))
    total = F.col("w") + F.when(F.col("named"), 3.0).otherwise(0.0)
    return out.select("request_id", "department_id", total.alias("hits"), F.round(F.least(F.lit(1.0), 0.25 + 0.20 * F.log2(1 + total)), 4).alias("keyword_score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def route_blend(scores: DataFrame, request_vectors: DataFrame, department_vectors: DataFrame) -> DataFrame:
    """.4 keyword + .6 (cosine + 1) / 2; a missing vector keeps the keyword score."""
    j = scores.join(request_vectors.select("request_id", F.col("embedding").alias("rv")), "request_id", "left").join(department_vectors.select("department_id", F.col("embedding").alias("dv")), "department_id", "left")
    blended = 0.4 * F.col("keyword_score") + 0.6 * (cosine(F.col("rv"), F.col("dv")) + 1) / 2
    return j.select("request_id", "department_id", "keyword_score", F.round(F.when(F.col("rv").isNull() | F.col("dv").isNull(), F.col("keyword_score")).otherwise(blended), 4).alias("score"))


def band(score: Column) -> Column:
    return F.when(score > 0.90, "HIGH").when(score >= 0.70, "MEDIUM").otherwise("LOW")


def route_decide(requests: DataFrame, scores: DataFrame, own: str = SELF) -> DataFrame:
    """The best department of each request, its band, the next three, and whether to transfer or to look again."""
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "department_id")
    ranked = scores.withColumn("rank", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("score").over(order), F.lit(0.0)))
    alternatives = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank").between(2, 4) & (F.col("score") > 0), F.struct("rank", "department_id", "score")))), lambda x: x["department_id"])
    best = ranked.groupBy("request_id").agg(F.max(F.when(F.col("rank") == 1, F.col("department_id"))).alias("department"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("rank") == 1, F.col("score") - F.col("next"))).alias("gap"), alternatives.alias("alternatives"))
    out = requests.select("request_id").join(best, "request_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    out = out.withColumn("department", F.coalesce("department", F.lit("UNKNOWN"))).withColumn("band", band(F.col("score"))).withColumn("overlap", F.round(F.coalesce("gap", F.lit(0.0)), 9) < 0.10)
    return out.select("request_id", "department", "score", "band", F.coalesce("alternatives", F.array().cast("array<string>")).alias("alternatives"), "overlap", (F.col("department") != own).alias("transfer"), ((F.col("band") == "LOW") | F.col("overlap")).alias("manual_review"))


def routing_accuracy(decided: DataFrame, truth: DataFrame) -> DataFrame:
    """Per language and in all: rows, share right, share right with half credit for alternatives; and the parity gap."""
    j = decided.join(truth, "request_id").withColumn("credit", F.when(F.col("department") == F.col("expected"), 1.0).when(F.array_contains("alternatives", F.col("expected")), 0.5).otherwise(0.0))
    out = j.groupingSets([[], [F.col("language")]], F.col("language")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("credit") == 1, 1.0).otherwise(0.0)).alias("right"), F.avg("credit").alias("credit"))
    gap = out.where("language is not null").agg((F.max("right") - F.min("right")).alias("parity_gap"))
    return out.join(F.broadcast(gap)).select(F.coalesce("language", F.lit("all")).alias("language"), "n", F.round("right", 6).alias("right"), F.round("credit", 6).alias("credit"), F.round("parity_gap", 6).alias("parity_gap"))  # gap is one row


def band_distribution(decided: DataFrame) -> DataFrame:
    """(band, n): decisions of each band, also of those that none has."""
    bands = F.explode(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW")))).alias("band")
    every = decided.sparkSession.range(1).select(bands, F.lit(0).cast("long").alias("n"))
    return every.unionByName(decided.select("band", F.lit(1).cast("long").alias("n"))).groupBy("band").agg(F.sum("n").alias("n"))


def exemption_rules(extracted: DataFrame, keywords: list[str] = rules.SECURITY_KEYWORDS) -> DataFrame:
    """(request_id, section, title, overridden): four rules; public interest overrides section 8(1), never 11."""
    sensitive = F.exists("systems", lambda s: F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(s), k)))
    kind, public = F.col("information_type"), F.coalesce("public_interest_override", F.lit(False))
    table = [
        (kind.isin("cybersecurity", "architecture") | F.coalesce(sensitive, F.lit(False)), "Section 8(1)(a)", "Security & Scientific/Economic Interests", public),
        (F.col("procurement_status") == "active_tender", "Section 8(1)(d)", "Commercial Confidence / Active Tenders", public),
        (F.coalesce("personal_data", F.lit(False)) | kind.isin("employee", "citizen_data"), "Section 8(1)(j)", "Personal Information & Privacy", public),
        (kind == "third_party_commercial", "Section 11", "Third-Party Information Notice Requirement", F.lit(False)),
    ]
    flags = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("section"), F.lit(t).alias("title"), o.alias("overridden"))) for c, s, t, o in table]))
    return extracted.select("request_id", F.explode(flags).alias("f")).select("request_id", "f.*")


def recommend(routed: DataFrame, extracted: DataFrame, flags: DataFrame, departments: DataFrame | None = None) -> DataFrame:
    """TRANSFER, PARTIALLY_APPROVE, REJECT or APPROVE, with sections, reason, next step, risks, and whether a notice is due.

    flags may carry the confidence of each exemption; a strength is STRONG over .8, and so it is without one. departments
    (department_id, name) name where a request goes; without them the id stands for the name.
    """
    sure = F.col("confidence") > 0.8 if "confidence" in flags.columns else F.lit(True)
    brief = F.struct(F.replace("section", F.lit("Section "), F.lit("")).alias("section"), F.when(sure, "STRONG").otherwise("MODERATE").alias("strength"))
    own = flags.groupBy("request_id").agg(F.sort_array(F.collect_set(F.when(~F.col("overridden"), F.col("section")))).alias("found"), F.sort_array(F.collect_set(F.when(~F.col("overridden"), brief))).alias("applicable"), F.sort_array(F.collect_set(F.when(F.col("overridden"), F.replace("section", F.lit("Section "), F.lit(""))))).alias("dismissed"))
    j = routed.join(extracted.select("request_id", "personal_data"), "request_id").join(own, "request_id", "left")
    if departments is not None:
        j = j.join(departments.select(F.col("department_id").alias("department"), F.col("name").alias("department_name")), "department", "left")
    name = F.coalesce("department_name", "department") if departments is not None else F.col("department")
    none = F.array().cast("array<string>")
    found = F.coalesce("found", none)
    some, notice = F.size(found) > 0, F.exists(found, lambda s: F.contains(s, F.lit("11")))
    action = F.when(F.col("transfer"), "TRANSFER").when(some & F.coalesce("personal_data", F.lit(False)), "PARTIALLY_APPROVE").when(some, "REJECT").otherwise("APPROVE")
    sections = F.concat(F.when(F.col("transfer"), F.array(F.lit("Section 6(3)"))).otherwise(none), found)
    step = F.when(notice, rules.NOTICE_STEP).when(F.col("transfer"), F.concat(F.lit(rules.TRANSFER_STEP[0]), name, F.lit(rules.TRANSFER_STEP[1])))
    for kind, text in rules.NEXT_STEPS.items():
        step = step.when(action == kind, text)
    risk = F
    for section, text in rules.DISCLOSURE_RISKS:
        risk = risk.when(F.array_contains(found, section), text)
    reason = F.concat(F.lit("Recommendation is to "), action, F.lit(". The jurisdiction belongs to "), F.upper("department"), F.lit(". "), F.when(some, F.concat(F.lit("Exemption grounds found under: "), F.array_join(sections, ", "), F.lit(". "))).otherwise("No exemption grounds apply."))
    return j.select(
        "request_id", action.alias("recommendation"), "band", reason.alias("reason"), sections.alias("sections"), F.coalesce("applicable", F.array().cast("array<struct<section:string,strength:string>>")).alias("applicable"), F.coalesce("dismissed", none).alias("dismissed"),
        step.alias("next_step"), risk.otherwise("N/A").alias("disclosure_risk"), F.lit(rules.REJECTION_RISK).alias("rejection_risk"), notice.alias("notice"), some.alias("legal_consultation"),
    )


def disclosure_factors(requests: DataFrame, flags: DataFrame, arguments: DataFrame, default: str) -> DataFrame:
    """The arguments (section, position, argument) of a request's flags, in order, joined by bars; a default without flags."""
    mine = flags.join(arguments, "section").groupBy("request_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "argument"))), lambda x: x["argument"]), " | ").alias("argument"))
    return requests.select("request_id").join(mine, "request_id", "left").select("request_id", F.coalesce("argument", F.lit(default)).alias("argument"))


def deadline_and_risk(requests: DataFrame, days: int = 30) -> DataFrame:
    """requests (request_id, date text, confidence, cases, levels): due date, risk, label, whether to look by hand."""
    manual = (F.coalesce("cases", F.lit(0)) == 0) & (F.col("confidence") < 0.35)
    has = lambda level: F.coalesce(F.array_contains("levels", level), F.lit(False))
    risk = F.when(manual | (F.col("confidence") < 0.45) | has("HIGH"), "HIGH").when(has("MEDIUM") | (F.col("confidence") < 0.70), "MEDIUM").otherwise("LOW")
    label = F.when(F.col("confidence") >= 0.75, "HIGH").when(F.col("confidence") >= 0.45, "MEDIUM").otherwise("LOW")
    return requests.select("request_id", F.date_add(tx.normalize_date(F.col("date")), days).alias("due"), risk.alias("risk"), label.alias("confidence_label"), manual.alias("manual_review"))


# --- names ------------------------------------------------------------------------------------------------------------


def plain_name(name: Column) -> Column:
    t = F.lower(tx.blank_if_null(name))
    for old, new in (("&", "and"), ("department", ""), ("dept", ""), ("government", ""), ("welfare", ""), ("-", " "), ("_", " ")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return tx.squeeze(t)


def sorted_tokens(name: Column) -> Column:
    return F.array_join(F.sort_array(tx.words(name)), " ")


def _best_names(threshold: float):
    """Blocks of names (a, b: lists) to the best of b for every a: 100 * (1 - indel distance / lengths), over a threshold.

    What two names have in common in order is at most what they have in common in any order, so pairs come by that bound,
    and a name is done when the bound is below the best score so far.
    """
    import numpy as np
    import pyarrow as pa

    def counts(names: list[str], letters: dict[str, int]) -> np.ndarray:
        out = np.zeros((len(names), len(letters) or 1), np.int16)
        for k, name in enumerate(names):
            for c in name:
                if c in letters:
                    out[k, letters[c]] += 1
        return out

    def common(masks: dict[str, int], size: int, b: str) -> int:
        """The longest common subsequence, a bit for each letter of the one name (size letters, their places in masks)."""
        full = (1 << size) - 1
        free = full
        for c in b:
            hit = free & masks.get(c, 0)
            free = ((free + hit) | (free - hit)) & full
        return size - free.bit_count()

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                left, right = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                letters = {c: n for n, c in enumerate(sorted(set("".join(left)) & set("".join(right))))}
                a, b = counts(left, letters), counts(right, letters)
                sizes = np.array([len(x) for x in right])
                out = []
                for i, name in enumerate(left):
                    both = np.minimum(a[i], b).sum(axis=1)
                    total = len(name) + sizes
                    bound = np.where(total > 0, 200.0 * both / np.maximum(total, 1), 100.0)
                    masks: dict[str, int] = {}
                    for n, c in enumerate(name):
                        masks[c] = masks.get(c, 0) | 1 << n
                    best = threshold
                    for at in np.argsort(-bound, kind="stable").tolist():
                        if bound[at] < best:
                            break
                        score = 200.0 * common(masks, len(name), right[at]) / total[at] if total[at] else 100.0
                        if score >= best:
                            best = score
                            out.append((name, right[at], score))
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], names=["a", "b", "score"])

    return run


NAMES = 512  # names in a block


LENGTHS = 4  # letters that one length class of blocks spans


def match_entities(left: DataFrame, right: DataFrame, threshold: float = 65.0) -> DataFrame:
    """left (left_id, name) to the best right (right_id, name) by token-sorted similarity; unmatched have a null right_id.

    Similarity is 200 * common / (lengths), and no more is common than the shorter name has, so names of lengths l and m can
    reach the threshold only if the shorter is at least threshold / (200 - threshold) of the longer. Distinct names meet in
    blocks of such length classes alone, the left ones being the query set; inside, a bound on letters in common spares
    most comparisons. (Grams of two letters or more are no sure sign: two names of twenty letters that reach 65 may have no
    two letters next to each other in common.) Of equal scores the smaller right_id is taken.
    """
    norm = lambda df, i: df.select(i, sorted_tokens(plain_name(F.col("name"))).alias("n"))
    a, b = norm(left, "left_id"), norm(right, "right_id")
    forms = b.groupBy("n").agg(F.min("right_id").alias("right_id"))
    kind = F.floor(F.length("n") / LENGTHS).cast("int")
    ratio = max(threshold, 0.0) / (200.0 - min(threshold, 100.0))

    def blocks(names: DataFrame, name: str) -> DataFrame:
        sizes = names.groupBy(kind.alias("kind")).agg(F.ceil(F.count("*") / NAMES).cast("int").alias("parts"))
        dealt = names.withColumn("kind", kind).join(sizes, "kind").withColumn("part", F.pmod(F.xxhash64("n"), "parts").cast("int"))
        return dealt.groupBy("kind", "part").agg(F.collect_list("n").alias(name))

    rights, lefts = blocks(forms, "b"), blocks(a.select("n").distinct(), "a")
    # the shortest and longest names that a name of the class can match, as classes
    low = F.floor(F.ceil(F.col("kind") * LENGTHS * ratio - 1e-9) / LENGTHS).cast("int")
    longest = F.floor((F.col("kind") * LENGTHS + LENGTHS - 1) / ratio + 1e-9) if ratio > 0 else F.lit(1 << 20)
    high = F.least(F.floor(longest / LENGTHS), F.lit(1 << 20)).cast("int")
    held = rights.groupBy("kind").agg(F.max("part").alias("last")).groupBy().agg(F.collect_list(F.struct("kind", "last")).alias("held"))  # a row of length classes
    asked = lefts.join(F.broadcast(held)).withColumn("fit", F.filter("held", lambda x: (x["kind"] >= low) & (x["kind"] <= high)))
    asked = asked.select("a", tx.each(F.flatten(F.transform("fit", lambda x: F.transform(F.sequence(F.lit(0), x["last"]), lambda p: F.struct(x["kind"].alias("kind"), p.alias("part")))))).alias("at")).where("at is not null")
    scored = asked.select("a", "at.kind", "at.part").join(rights, ["kind", "part"]).select("a", "b").mapInArrow(_best_names(threshold), "a string, b string, score double")
    order = Window.partitionBy("a").orderBy(F.desc("score"), "right_id")
    best = scored.join(forms.withColumnRenamed("n", "b"), "b").withColumn("_k", F.row_number().over(order)).where("_k = 1").select("a", "right_id", F.round("score", 6).alias("score"))
    return a.join(best, a["n"] == best["a"], "left").select("left_id", "right_id", "score")


def merge_master(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Matched records as one: the left's name, both names as aliases, all keywords once."""
    j = matches.where("right_id is not null").join(left.select("left_id", F.col("name").alias("ln"), F.col("keywords").alias("lk")), "left_id").join(right.select("right_id", F.col("name").alias("rn"), F.col("keywords").alias("rk")), "right_id")
    return j.select("left_id", "right_id", F.coalesce("ln", "rn").alias("name"), F.sort_array(F.array_distinct(F.array_compact(F.array("ln", "rn")))).alias("aliases"), F.sort_array(F.array_distinct(F.concat(F.coalesce("lk", F.array().cast("array<string>")), F.coalesce("rk", F.array().cast("array<string>"))))).alias("keywords"))


def curate_master(master: DataFrame, new: DataFrame, relabel: dict[str, str]) -> DataFrame:
    """Relabelled and with the first of equal (id, name); new records only if their name is not there without case."""
    table = F.create_map(*[F.lit(x) for kv in relabel.items() for x in kv]) if relabel else F.lit(None).cast("map<string,string>")
    named = master.withColumn("name", F.coalesce(F.try_element_at(table, F.col("name")), F.col("name")))
    one = named.withColumn("_k", F.row_number().over(Window.partitionBy("id", "name").orderBy("position"))).where("_k = 1").drop("_k")
    fresh = new.join(one.select(F.lower("name").alias("_n")).distinct(), F.lower("name") == F.col("_n"), "left_anti")
    return one.unionByName(fresh)
