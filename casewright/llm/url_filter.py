"""URL filter: stated rules first, boosted trees on lexical features for the rest.

A rule fits its host and all subdomains of it if the url's path starts with the rule's; the longest rule wins. Urls that
a rule decides are the labelled ones: gradient-boosted trees learn from a bounded sample of them (about TRAIN_ROWS rows,
drawn by hash, and of each class about CLASS_ROWS at least, or all it has) and judge the others. Features: lengths, depth, digit ratio, entropy, counts of parameters, labels and marks,
and statistics of the host's suffix counted over all urls.

Defined cases: a url that is null or has no "://" has an empty host and path, fits no rule and is judged by the trees;
repeated rows are judged each; with labels of one class only (or none) the trees are not trained and that class (or
allow) is the verdict; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.work import Work, read

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
TRAIN_ROWS, CLASS_ROWS = 20_000, 1_000
TREES, DEPTH = 12, 3
FEATURES = ["url_length", "host_length", "path_length", "depth", "digit_ratio", "host_digit_ratio", "entropy", "parameters", "labels", "hyphens", "letters_in_path", "first_part_length", "suffix_log_count", "suffix_share"]


def with_parts(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), upper, lower)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule, verdict = F, F
    for kind, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = rule.when(fits, host + path), verdict.when(fits, kind)
    return rule, verdict


def _share(text: Column, pattern: str) -> Column:
    """Characters of the class in the text, over its length."""
    return F.length(F.regexp_replace(text, f"[^{pattern}]", "")) / F.greatest(F.length(text), F.lit(1))


def with_features(parts: DataFrame, suffixes: DataFrame, total: int) -> DataFrame:
    """parts (url, host, path, suffix) with FEATURES; suffixes: (suffix, n) over all urls."""
    url = F.coalesce(F.col("url"), F.lit(""))
    letters = F.split(url, "")
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / size
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return parts.join(suffixes, "suffix", "left").select(
        *parts.columns,
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        (F.size(F.split("path", "/")) - 1).cast("double").alias("depth"),
        _share(url, "0-9").alias("digit_ratio"),
        _share(F.col("host"), "0-9").alias("host_digit_ratio"),
        F.coalesce(entropy, F.lit(0.0)).alias("entropy"),
        F.length(F.regexp_replace(query, "[^=]", "")).cast("double").alias("parameters"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        F.length(F.regexp_replace("host", "[^-]", "")).cast("double").alias("hyphens"),
        _share(F.col("path"), "A-Za-z").alias("letters_in_path"),
        F.length(F.regexp_extract("path", r"\A/([^/]*)", 1)).cast("double").alias("first_part_length"),
        F.log1p(F.coalesce("n", F.lit(0)).cast("double")).alias("suffix_log_count"),
        (F.coalesce("n", F.lit(0)) / F.lit(max(total, 1))).alias("suffix_share"),
    )


def judge(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """pages (page_id, url) as page_id, host, path, rule, verdict, block_score (null where a rule decides)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    work = Work(pages.sparkSession, "urls")
    rule, verdict = rule_columns(rules)
    parts = with_parts(pages.select("page_id", "url")).withColumn("rule", rule).withColumn("ruled", verdict).withColumn("suffix", F.substring_index("host", ".", -1))
    suffixes = work.table(parts.groupBy("suffix").agg(F.count("*").alias("n"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"), F.count("ruled").alias("labelled")), "suffixes")
    sums = suffixes.agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")).first()
    total, blocked, labelled = sums.n or 0, sums.blocked or 0, sums.labelled or 0
    full = with_features(parts, suffixes.select("suffix", "n"), total)
    out = ["page_id", "host", "path", "rule"]
    if not 0 < blocked < labelled:
        other = F.lit("block" if blocked else "allow")
        return full.select(*out, F.coalesce("ruled", other).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    million = 1_000_000
    share = lambda n: million * min(1.0, max(train_rows / labelled, CLASS_ROWS / n))
    drawn = F.when(F.col("ruled") == "block", share(blocked)).otherwise(share(labelled - blocked))
    sample = full.where("ruled is not null").where(F.pmod(F.xxhash64("url", "page_id"), F.lit(million)) < drawn)
    sample = work.table(sample.select(*FEATURES, F.when(F.col("ruled") == "block", 1.0).otherwise(0.0).alias("label")).coalesce(2), "train")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7).fit(assembler.transform(sample))
    scored = model.transform(assembler.transform(full)).withColumn("score", F.round(vector_to_array("probability")[1], 9))
    free = F.col("rule").isNull()
    return scored.select(*out, F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), F.when(free, F.col("score")).alias("block_score"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"))
