"""Queries without SQL against plain versions, over the whole smallest tables."""

import re
from collections import Counter

from casewright.functions import rules
from casewright.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def texts(spark, name):
    from casewright.plans.document_queries import _decisions, _marked

    df = _decisions(spark, SF) if name == "decisions" else _marked(spark, SF) if name == "marked" else spark.read.parquet(f"{SF}/documents.parquet")
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def matches(text, patterns=rules.BOUNDARY_PATTERNS):
    return [(k, m.start(), m.end(), s, c, m[0].strip()) for k, (s, p, c) in enumerate(patterns) for m in re.finditer(p, text, re.I | re.M | re.S)]


def resolved(found, near=40):
    kept = []
    for x in sorted(found):
        if not any(x[1] < k[2] and x[2] > k[1] for k in kept):
            kept.append(x)
    thin = []
    for x in sorted(kept, key=lambda x: (x[1], x[2], x[0])):
        if thin and x[1] - thin[-1][1] < near:
            if x[4] > thin[-1][4]:
                thin[-1] = x
        else:
            thin.append(x)
    return thin


def test_boundaries_and_slices(spark):
    docs = texts(spark, "decisions")
    want = Counter((i, s, a, b, c, m, k) for i, t in docs.items() for k, a, b, s, c, m in matches(t))
    assert Counter((r.doc_id, r.section, r.start, r.end, r.score, r.marker, r.priority) for r in QUERIES["g1_find_boundaries"](spark, SF).collect()) == want
    bounds = {i: resolved(matches(t)) for i, t in docs.items()}
    got = Counter((r.doc_id, r.section, r.start, r.end, r.score, r.marker) for r in QUERIES["g2_resolve_boundaries"](spark, SF).collect())
    assert got == Counter((i, s, a, b, c, m) for i, x in bounds.items() for _, a, b, s, c, m in x)
    sections = {}
    for i, found in bounds.items():
        for n, (_, _, end, name, score, marker) in enumerate(found):
            stop = found[n + 1][1] if n + 1 < len(found) else len(docs[i])
            body, mark = docs[i][end:stop].strip(" \n:-"), marker.strip(" \n:-")
            if mark and body.lower().startswith(mark.lower()):
                body = body[len(mark) :].strip(" \n:-")
            if body:
                old = sections.get((i, name))
                sections[i, name] = (f"{old[0]}\n\n{body}", max(old[1], score - 0.05)) if old else (body, score)
    got = {(r.doc_id, r.section): (r.text, round(r.confidence, 9)) for r in QUERIES["g3_slice_sections"](spark, SF).collect()}
    assert got == {k: (t, round(c, 9)) for k, (t, c) in sections.items()}


def test_labelled_blocks(spark):
    want = {}
    for i, t in texts(spark, "decisions").items():
        found = sorted((a, b, name) for _, a, b, name, _, _ in matches(t, rules.LABELLED_BLOCKS))
        for n, (_, end, name) in enumerate(found):
            want[i, name] = t[end : found[n + 1][0] if n + 1 < len(found) else len(t)].strip(" :\n")
    assert {(r.doc_id, r.block): r.text for r in QUERIES["g9_labelled_blocks"](spark, SF).collect()} == want


def tokens(text):
    return max(1, round(len(text.split()) * 1.3))


def clean(text, most=2):
    text = re.sub(r"[ \t\f\v]+", " ", re.sub("\r\n?", "\n", (text or "").replace("\0", " ")))
    return re.sub(rf"\n{{{most + 1},}}", "\n" * most, re.sub(" *\n *", "\n", text)).strip(" \t\n\v\f\r")


def split(text, most, overlap):
    text = clean(text)
    if not text:
        return []
    if tokens(text) <= most:
        return [text]
    size, parts, now = int(most / 1.3), [], []
    for s in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9])", " ".join(text.split())):
        words = s.split()
        if tokens(s) > most:
            parts += [now] if now else []
            parts += [words[k : k + size] for k in range(0, len(words), size)]
            now = []
            continue
        if now and tokens(" ".join([*now, s])) > most:
            parts.append(now)
            tail = []
            for x in reversed(now if overlap else []):
                if tail and sum(map(tokens, tail)) + tokens(x) > overlap:
                    break
                tail.insert(0, x)
            now = tail
        now = [*now, s]
    return [" ".join(x) for x in parts + [now] * bool(now)]


def test_long_texts_are_split(spark):
    docs = texts(spark, "documents")
    got = {}
    for r in sorted(QUERIES["c3_split_long"](spark, SF).collect(), key=lambda r: (r.doc_id, r.part)):
        got.setdefault(r.doc_id, []).append(r.text)
    for i, t in docs.items():
        assert got.get(i, []) == split(t, 200, 40), i


def is_row(line):
    s = line.strip()
    return s.startswith("|") and s.endswith("|") and s.count("|") >= 2


def repaired(text):
    lines, out, k = text.split("\n"), [], 0
    while k < len(lines):
        if not is_row(lines[k]):
            out.append(lines[k])
            k += 1
            continue
        run = []
        while k < len(lines) and (is_row(lines[k]) or not lines[k].strip()):
            if lines[k].strip():
                run.append([c.strip() for c in lines[k].strip().strip("|").split("|")])
            k += 1
        width, made = max(map(len, run)), []
        rule = "| " + " | ".join(["---"] * width) + " |"
        for n, cells in enumerate(run):
            filled = [c for c in cells if c]
            span = len(filled) > 1 and len(set(filled)) == 1
            separator = all(not c or re.fullmatch(":?-+:?", c) for c in cells)
            if span:
                made.append("| " + " | ".join([f"**{cells[0]}**"] + [""] * (width - 1)) + " |")
            elif separator:
                made += [rule] if n == 0 else []
            else:
                made.append("| " + " | ".join(cells + [""] * (width - len(cells))) + " |")
            if n == 0 and not (separator and not span):
                made.append(rule)
        out += [*made, ""]
    return "\n".join(out)


def test_tables_are_repaired(spark):
    docs = texts(spark, "marked")
    got = {r.doc_id: r.text for r in QUERIES["t9_repair_tables"](spark, SF).collect()}
    assert got == {i: repaired(t.replace("\r\n", "\n").replace("\r", "\n")) for i, t in docs.items()}
