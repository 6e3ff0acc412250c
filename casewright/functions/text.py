"""Column functions over text. All are built-in expressions, so plans stay in generated code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that carry no weight in search.
STOPWORDS = ("the", "a", "an", "is", "are", "was", "were", "in", "of", "and", "to", "that", "this", "it", "be", "as", "at", "by")
# What a section reference and a case number look like in lower-case text.
SECTION_REF = r"\b\d+\s*\(\s*\d+\s*\)\s*\(\s*[a-z]\s*\)|\b\d+\s*\(\s*\d+\s*\)|\bsection\s+\d+\s*\(\s*\d+\s*\)\s*\(\s*[a-z]\s*\)|\bsection\s+\d+\s*\(\s*\d+\s*\)|\bsection\s+\d+\b"
CASE_REF = r"\b(?:cic|sic)[/_-][a-z0-9/_-]+\b"
BLANKS = " \t\n\x0B\f\r"  # white space as patterns have it
RUNS = r"\s{2,}|[\t\n\x0B\f\r]"  # white space that is more or other than one blank
WORD = r"[a-z0-9]+(?:/[a-z0-9]+)*"


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def squeeze(text: Column) -> Column:
    """White space runs become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(blank_if_null(text), RUNS, " "))  # single blanks stay untouched


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.array_remove(F.split(squeeze(text), " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def needed(pattern: str) -> list[str] | None:
    """Lower-case words of which every match of the pattern has one, read off its text; None where that cannot be told.

    Of each choice outside all brackets the longest run of plain letters, digits and blanks that no bracket holds.
    """
    bare = re.sub(r"^\(\?[ims]+\)|\\b", "", pattern)
    if re.search(r"\(\?[^:]|\\[QEpPxu]", bare):
        return None
    bare = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "~", bare, flags=re.DOTALL)
    whole = re.fullmatch(r"\((?:\?:)?([^()]*(?:\([^()]*\)[^()]*)*)\)", bare)
    bare = whole[1] if whole else bare
    groups = re.findall(r"(?<!\()\((?:\?:)?([^()]*)\)(?![?*{)])", bare)
    nested = re.search(r"\([^()]*\(", bare)
    while (inner := re.sub(r"\([^()]*\)", "~", bare)) != bare:
        bare = inner
    if "|" not in bare and not nested and not re.search("[A-Za-z0-9]", re.sub(r".(?:[?*]|\{[^}]*\})", "~", bare)):
        # no plain letter outside brackets: each match has a choice of every bracket
        told = [words for words in map(needed, groups) if words]
        return max(told, key=lambda words: min(map(len, words)), default=None)
    # a letter that may be left out is none to count on
    runs = [re.findall(r"[A-Za-z0-9][A-Za-z0-9 ]*", re.sub(r".(?:[?*]|\{[^}]*\})", "~", part)) for part in bare.split("|")]
    return sorted({max(own, key=len).lower() for own in runs}) if all(runs) else None


def _firsts(pattern: str) -> list[str] | None:
    """What the first character of any match is, as parts of a class; None where that cannot be told from the pattern's text."""
    depth, parts, cut, k = 0, [], 0, 0
    while k < len(pattern):
        if pattern[k] == "[":
            k = re.compile(r"\[\^?\]?(?:\\.|[^\]\\])*\]", re.DOTALL).match(pattern, k).end() - 1
        depth += {"(": 1, ")": -1}.get(pattern[k], 0)
        if pattern[k] == "|" and not depth:
            parts, cut = [*parts, pattern[cut:k]], k + 1
        k += 2 if pattern[k] == "\\" else 1
    if parts:
        each = [_firsts(part) for part in [*parts, pattern[cut:]]]
        return sum(each, []) if all(each) else None
    rest = pattern.removeprefix("\\b")
    group = re.match(r"\((\?:)?((?:[^()\[\]\\]|\\.|\[\^?\]?(?:\\.|[^\]\\])*\])*)\)(?![?*{])", rest, re.DOTALL)
    if group and not group[2].startswith("?"):
        return _firsts(group[2])
    one = re.match(r"(?:\[([^\^\[\]\\&](?:[^\[\]\\&])*)\]|([^\W_]|₹))(?![?*{])", rest)
    return [one[1] or one[2]] if one else None


def ahead(pattern: str) -> str:
    """The same pattern, which looks at the next character first: a word's edge, or a choice, takes ten times as long."""
    flags = re.match(r"(?:\(\?[ims]+\))?", pattern)[0]
    rest = pattern[len(flags) :]
    known = _firsts(rest)
    return f"{flags}(?=[{''.join(known)}])(?:{rest})" if known else pattern


def may_match(text: Column, pattern: str, low: Column | None = None) -> Column:
    """False only for texts in which the pattern has no match: plain searches tell, at a fraction of the pattern's cost.

    low: the text in lower case, where that is at hand.
    """
    low = F.lower(text) if low is None else low
    found = [F.contains(low, F.lit(w)) for w in needed(pattern) or []]
    return reduce(lambda a, b: a | b, found) if found else F.lit(True)


def extract(text: Column, pattern: str, group: int) -> Column:
    """`regexp_extract`, where the pattern is searched for only in texts that may have it."""
    return F.when(may_match(text, pattern), F.regexp_extract(text, ahead(pattern), group)).otherwise("")


def matches(text: Column, pattern: str, low: Column | None = None) -> Column:
    """`rlike`, where the pattern is searched for only in texts that may have it."""
    return F.when(may_match(text, pattern, low), text.rlike(ahead(pattern))).otherwise(False)


def each(array: Column) -> Column:
    """The items of an array as rows, one null for an empty one: a plain explode makes Spark filter by the array's size first,
    which works a costly array out twice, and ahead of a shuffle that was to spread the work. Rows without an item are to be
    filtered after it."""
    return F.explode_outer(array)


def approx_tokens(text: Column, floor: int = 1) -> Column:
    """Words times 1.3, rounded half to even, at least `floor`."""
    return F.greatest(F.lit(floor), F.bround(word_count(text) * F.lit(1.3)).cast("int"))


def legal_tokens(text: Column) -> Column:
    """Search terms: section references and case numbers whole (case numbers by part, too), then plain words."""
    once = lambda value, made: F.transform(F.array(value), made)[0]  # noqa: E731  a value that is named several times
    none = F.array().cast("array<string>")
    # few texts hold a reference or a case number, and a plain search tells which
    cites = lambda low: F.contains(low, F.lit("(")) | F.contains(low, F.lit("section"))
    refs = lambda low: F.transform(F.regexp_extract_all(low, F.lit(SECTION_REF), 0), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", ""), "^section", ""))
    cases = lambda rest: F.flatten(F.transform(F.transform(F.regexp_extract_all(rest, F.lit(CASE_REF), 0), lambda x: F.translate(x, "_-", "//")), lambda x: F.concat(F.array(x), F.split(x, "/"))))
    words = lambda plain: F.regexp_extract_all(plain, F.lit(WORD), 0)  # noqa: E731  punctuation is in no word, so it may stay
    after = lambda rest: F.when(rest.rlike("[cs]ic[/_-]"), F.concat(cases(rest), words(F.regexp_replace(rest, CASE_REF, " ")))).otherwise(words(rest))
    made = lambda low: once(cites(low), lambda c: F.concat(F.when(c, refs(low)).otherwise(none), once(F.when(c, F.regexp_replace(low, SECTION_REF, " ")).otherwise(low), after)))
    return F.filter(once(F.lower(blank_if_null(text)), made), lambda t: (t != "") & ~t.isin(*STOPWORDS))


def clean_text(text: Column, most_newlines: int = 3, comments: str | None = "newline") -> Column:
    """NUL to blank, one kind of line end, single blanks, no blanks around line ends, runs of line ends capped."""
    swap = lambda t, old, new: F.replace(t, F.lit(old), F.lit(new))  # noqa: E731  plain search, where no pattern is needed
    t = swap(swap(swap(blank_if_null(text), "\0", " "), "\r\n", "\n"), "\r", "\n")
    if comments:
        t = F.regexp_replace(t, r"(?i)<!--\s*page\s+\d+\s*-->", "\n" if comments == "newline" else "")
    t = F.regexp_replace(t, r"[ \t\f\x0B]{2,}|[\t\f\x0B]", " ")
    t = swap(swap(t, " \n", "\n"), "\n ", "\n")
    return F.trim(F.regexp_replace(t, f"\n{{{most_newlines + 1},}}", "\n" * most_newlines), F.lit(BLANKS))


def compact(text: Column, limit: int) -> Column:
    """Squeezed text of `limit` characters at most, with dots where it was cut."""
    t = squeeze(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("...")))


def normalize_numerals(text: Column) -> Column:
    """Devanagari digits as ASCII digits."""
    return F.translate(text, "०१२३४५६७८९", "0123456789")


def _counts(t: Column) -> dict[str, Column]:
    """Devanagari characters, ASCII letters, and characters that are no white space. Whole runs go at once, and no class of
    several alphabets is searched for: such a one takes ten times as long."""
    gone = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    return {"marks": gone(r"[^ऀ-ॿ]+"), "ascii": F.length(t) - gone("[A-Za-z]+"), "all": gone(r"\s+")}


def devanagari_share(text: Column, of: str = "all") -> Column:
    """Devanagari characters over all characters that are no white space, or over all letters."""
    n = _counts(blank_if_null(text))
    return _share(n["marks"], n["all"] if of == "all" else n["marks"] + n["ascii"])


def _share(marks: Column, total: Column) -> Column:
    return F.when(total > 0, marks / total)


def detect_script(text: Column, variant: str = "A") -> Column:
    """A: over 0.3 hi, over 0.05 mixed, else en, none unknown. B: under 0.05 en, over 0.3 hi, else mixed, none en. C: words."""
    return _script(devanagari_share(text, "all" if variant != "C" else "letters"), variant)


def detect_scripts(docs: DataFrame, text: Column, variants: str = "ABC") -> DataFrame:
    """(doc_id, a column for each variant in lower case): `detect_script` of several variants, where each search of the text and
    each count is made once."""
    counted = docs.select("doc_id", blank_if_null(text).alias("t")).select("doc_id", *[c.alias(name) for name, c in _counts(F.col("t")).items()])
    shares = counted.select("doc_id", _share(F.col("marks"), F.col("all")).alias("share"), _share(F.col("marks"), F.col("marks") + F.col("ascii")).alias("of_letters"))
    return shares.select("doc_id", *[_script(F.col("share" if v != "C" else "of_letters"), v).alias(v.lower()) for v in variants])


def _script(share: Column, variant: str) -> Column:
    if variant == "A":
        return F.when(share.isNull(), "unknown").when(share > 0.3, "hi").when(share > 0.05, "mixed").otherwise("en")
    if variant == "B":
        return F.when(share.isNull() | (share < 0.05), "en").when(share > 0.3, "hi").otherwise("mixed")
    return F.when(share.isNull() | (share < 0.05), "english").when(share > 0.5, "hindi").otherwise("mixed")


DATE_FORMATS = ("yyyy-MM-dd", "d.M.yyyy", "d/M/yyyy", "d-M-yyyy")


def normalize_date(text: Column) -> Column:
    """The first format that reads the text as a date; two-digit years pivot at 69; null if none does."""
    t = F.trim(text)
    long_form = F.coalesce(*[F.when(t.rlike(p), F.try_to_date(t, f)) for p, f in ((r"^\d{4}-\d{2}-\d{2}$", DATE_FORMATS[0]), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", DATE_FORMATS[1]), (r"^\d{1,2}/\d{1,2}/\d{4}$", DATE_FORMATS[2]), (r"^\d{1,2}-\d{1,2}-\d{4}$", DATE_FORMATS[3]))])
    short = F.regexp_extract(t, r"^(\d{1,2})([./])(\d{1,2})\2(\d{2})$", 4)
    century = F.when(short == "", None).when(short.try_cast("int") >= 69, "19").otherwise("20") if hasattr(Column, "try_cast") else F.when(short == "", None).when(short >= "69", "19").otherwise("20")
    full = F.concat(F.regexp_extract(t, r"^(\d{1,2}[./]\d{1,2}[./])\d{2}$", 1), century, short)
    return F.coalesce(long_form, F.try_to_date(F.translate(full, "/", "."), "d.M.yyyy"))


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! ? before an upper-case letter or digit."""
    # squeezed, all white space is one blank; a pattern that begins with what stands behind would look there from every place
    return F.filter(F.transform(F.split(squeeze(text), r" (?<=[.!?] )(?=[A-Z0-9])"), lambda s: F.trim(s)), lambda s: s != "")


def unique_by_lower(values: Column) -> Column:
    """First-seen values, compared without case."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda acc, v: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(v)), acc).otherwise(F.array_append(acc, v)))


def normalize_case_number(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.translate(text, "\\", "/")), "[_-]+", "/"), "/+", "/"), "^/|/$", ""))
