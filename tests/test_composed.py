"""Composed queries without SQL against plain versions, over the whole smallest tables."""

import hashlib
import re
import unicodedata

from casewright.functions import rules
from casewright.operators import cases, extraction
from casewright.plans.registry import QUERIES
from casewright.plans.views import view
from tests.test_plain import SF, clean, is_row, matches, repaired, resolved, split, texts, tokens

WHITE = " \t\n\v\f\r"


def test_chunks_of_sections(spark):
    want = {}
    for doc, text in texts(spark, "documents").items():
        section = "COMMISSION_FINDINGS" if doc % 2 == 0 else "CPIO_REPLY"
        kind, text = rules.SECTION_CHUNKS[section], clean(text)
        if len(text) < 50:
            continue
        parts = split(text, 800, 50 if kind == "COMMISSION_FINDINGS" else 0)
        for k, part in enumerate(parts, 1):
            name = hashlib.sha256(f"{doc}|{kind}|{section}|{k}".encode()).hexdigest()
            part = part if part.startswith(f"[{kind}]") else f"[{kind}] {part}"
            want[doc, k] = (name, kind, len(parts), tokens(part), part)
    got = {(r.doc_id, r.part_index): (r.chunk_id, r.chunk_type, r.part_count, r.token_count, r.text) for r in QUERIES["c1_chunk_sections"](spark, SF).collect()}
    assert got == want and max(k for _, k in want) > 2


def head_and_parties(text, first):
    seen = lambda p, t: re.search(p, t, re.ASCII)
    mark = seen(rules.HEADER_END, text)
    ends = [x for x in (first, mark.start() if mark else None) if x is not None]
    header = text[: min(ends) if ends else min(len(text), 1800)].strip(" \n")
    if not seen(rules.CASE_HEADER, header):
        header = "\n".join(header.split("\n")[:20]).strip(" \n")
    score = min(0.95, 0.45 + 0.30 * bool(seen(rules.CASE_HEADER, header)) + 0.15 * bool(seen(rules.HEADER_DATE, header)) + 0.10 * bool(seen(rules.HEADER_JUDGE, header)))
    lines = {}
    for line in text[:5000].split("\n"):
        if seen(rules.PARTY_LINE, line):
            lines.setdefault(line.strip(" ").lower(), line.strip(" "))
    found = {name: (header, round(score, 6)) for name in ("HEADER", "CASE_HEADER") if header}
    parties = "\n".join(list(lines.values())[:20])
    return found | ({"PARTIES": (parties, 0.82)} if parties else {})


def test_header_and_parties(spark):
    want = {}
    for doc, text in texts(spark, "decisions").items():
        starts = [x[1] for x in resolved(matches(text)) if x[1] > 0]
        want |= {(doc, s): v for s, v in head_and_parties(text, min(starts, default=None)).items()}
    got = {(r.doc_id, r.section): (r.text, round(r.confidence, 6)) for r in QUERIES["g6_extract_header_and_parties"](spark, SF).collect()}
    assert got == want


def test_augmented_sections(spark):
    sliced = {(r.doc_id, r.section): (r.text, round(r.confidence, 6)) for r in QUERIES["g3_slice_sections"](spark, SF).collect()}
    want = dict(sliced)
    for doc, text in texts(spark, "decisions").items():
        said = [m[0].strip(" ") for m in re.finditer(rules.SECTION_MENTION, text, re.ASCII)][:8]
        window = re.search(rules.PUBLIC_INTEREST_WINDOW, text, re.ASCII)
        for section, found, score in (("SECTION_ANALYSIS", "\n\n".join(said), 0.62), ("PUBLIC_INTEREST", window[0].strip(" \n") if window else "", 0.68)):
            if found:
                want.setdefault((doc, section), (found, score))
    got = {(r.doc_id, r.section): (r.text, round(r.confidence, 6)) for r in QUERIES["g7_augment_sections"](spark, SF).collect()}
    assert got == want and len(want) > len(sliced)


def test_chunk_metadata(spark):
    want = {}
    for r in extraction.extract_cases(view(spark, SF, "decision_docs")).collect():
        words = ["FACTS", *r.rti_sections, *r.exemption_sections, *r.reasoning_pattern, *[x for x in (r.public_authority, r.outcome) if x is not None]]
        keywords = {}
        for w in (" ".join(w.split()) for w in words):
            if w:
                keywords.setdefault(w.lower(), w)
        date = r.decision_date or r.hearing_date or r.rti_application_date
        want[r.doc_id] = (str(date or ""), r.public_authority or "", ", ".join(r.rti_sections), ", ".join(r.exemption_sections), ", ".join(list(keywords.values())[:30]))
    got = {int(r.doc_id): (r.date, r.public_authority, r.rti_sections, r.exemption_sections, r.keywords) for r in QUERIES["c6_chunk_metadata"](spark, SF).collect()}
    assert got == want


def without_artifacts(lines):
    fences = 0
    for line in lines:
        s = line.strip(WHITE)
        fence = s.startswith("```")
        fences += fence
        kept = s == "" or is_row(s) or s.startswith("#") or s.startswith("<!--")
        page = re.fullmatch(r"(?i)\s*[-—]*\s*(Page\s*)?[0-9]{1,4}\s*[-—]*\s*", s)
        noise = len(s) <= 3 and not re.search("[ऀ-ॿA-Za-z]", s)
        thin = len(s) < 5 and len(re.sub("[^ऀ-ॿA-Za-z0-9]", "", s)) < 2
        if fences % 2 or fence or kept or not (page or noise or thin):
            yield line


def with_headers(lines):
    fixed = []
    for line in lines:
        marks = re.match("#{1,6}", line.strip(WHITE))
        if marks:
            content = re.sub(r"\A\*\*(.+?)\*\*\Z", r"\1", line.strip(WHITE)[marks.end() :].strip(WHITE))
            line = f"{marks[0]} {re.sub('[:-]+$', '', content)}".rstrip(" ")
        fixed.append((bool(marks), line))
    kept = [x for k, x in enumerate(fixed) if not (k and x[0] and fixed[k - 1] == x)]
    for k, (head, line) in enumerate(kept):
        if head and k and kept[k - 1][1].strip(WHITE):
            yield ""
        yield line


def renumbered(lines):
    number = 0
    for line in lines:
        line = re.sub(r"\A(\s*)[–—•▪➤►▶]\s+", r"\1- ", line)
        line = re.sub(r"\A(\s*)([0-9]+)\)\s+", r"\1\2. ", line)
        item = re.match(r"(?s)(\s*)[0-9]+\.\s+(.*)", line)
        if item:
            number += 1
            line = f"{item[1]}{number}. {item[2]}"
        elif line.strip(WHITE) and not line.strip(WHITE).startswith("-"):
            number = 0
        yield line


def without_repeats(lines):
    seen = set()
    for line in lines:
        s = line.strip(WHITE)
        form = re.sub(r"[ \t\n\v\f\r]+", " ", s).lower()
        if len(form) > 30 and not is_row(s) and not s.startswith("#") and not s.startswith("<!--"):
            if form in seen:
                continue
            seen.add(form)
        yield line


def joined(lines):
    out, before = [], ""
    for line in lines:
        line = line.rstrip(WHITE)
        line = line if is_row(line) else re.sub(r"(?<!\|)  +(?!\|)", " ", line)
        if out and before.endswith("-") and line and unicodedata.category(line[0]) == "Ll":
            out[-1] = out[-1][:-1] + line
        else:
            out.append(line)
        before = line
    return out


def markdown(text):
    text = re.sub(r"\s*<!--\s*[Pp]age\s*([0-9]+)\s*-->\s*", r"\n\n<!-- page \1 -->\n\n", re.sub("\r\n?", "\n", text))
    lines = list(with_headers(without_artifacts(re.sub("\n{3,}", "\n\n", text).split("\n"))))
    text = "\n".join(joined(without_repeats(renumbered(repaired("\n".join(lines)).split("\n")))))
    return re.sub(r"(<!-- page [0-9]+ -->)\n{2,}", r"\1\n", re.sub("\n{3,}", "\n\n", text)).strip(WHITE)


def test_clean_markdown(spark):
    got = {r.doc_id: r.text for r in QUERIES["t13_clean_markdown"](spark, SF).collect()}
    for doc, text in texts(spark, "marked").items():
        assert got[doc] == markdown(text), doc
    assert len(got) == len(texts(spark, "marked"))


def test_a_case_held_twice_is_updated_once(spark):
    kind = "case_number string, outcome string, created_at int, updated_at int"
    base = spark.createDataFrame([("A/1", "x", 5, 5), ("A/1", "y", 3, 6), ("B/1", "z", 1, 1)], kind)
    new = spark.createDataFrame([("a_1", "new", 9, 9, 1), ("C/1", "c", 8, 8, 2)], kind + ", arrived int")
    assert sorted(map(tuple, cases.upsert_cases(base, new).collect())) == [("A/1", "new", 3, 9), ("B/1", "z", 1, 1), ("C/1", "c", 8, 8)]
