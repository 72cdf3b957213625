"""De-identification against a plain version, pattern by pattern; names, subjects, reports, vocabulary patterns."""

import re
from collections import Counter

import pytest

from sluice import catalogue
from sluice.functions import patterns as P
from sluice.operators import deident

SMALL = "/root/testdata/sf0.001"
MAILS = [
    (1, "Dear John Smith,\nplease call 713-853-1234 x4567 or mail john.smith@example.com.\nRegards,\nMary Jones", "John Smith's trip"),
    (2, "Anna Brown wrote that Anna Brown and Anna Brown met. Anna's card 4111 1111 1111 1111, not 4111 1111 1111 1112.", "Anna Brown"),
    (3, "IBAN GB82 WEST 1234 5698 7654 32 but not GB83 WEST 1234 5698 7654 32; passport no. 123456789; SSN 123-45-6789", None),
    (4, "<html><br>see http://www.example.com/a?b=1 and example.org</br></html> 12 Main Street, P.O. Box 77", ""),
    (5, "Kept line.\nThis message is confidential.\nIt is for the intended recipient only.", "\"Doe, Jane\" <jane@doe.com>"),
    (6, None, "hello Anna"),
    (7, "   \n", "x"),
    (8, "A very long note that goes on and on before it ends. If you received this in error, delete it. More.", "Phil K/HOU/ECT@ECT"),
    (9, "- Bob\n<<attached.doc>> text  with   spaces =\njoined me@host.=\ncom", "12 March 2001"),
]


@pytest.fixture(scope="module")
def mails(spark):
    return spark.createDataFrame(MAILS, "doc_id long, text string, subject string")


def plain(pattern):
    return re.compile(P.python_dialect(pattern))


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()]
    for i in range(len(digits) - 2, -1, -2):
        digits[i] = digits[i] * 2 - 9 * (digits[i] > 4)
    return sum(digits) % 10 == 0 and 13 <= len(digits) <= 19


def hits(label, pattern, text):
    found = [m.group() for m in plain(pattern).finditer(text or "")]
    return sum(luhn(x) for x in found) if label.startswith("card") else len(found)


def test_audit_of_all_patterns(spark, mails):
    for rows in (mails.select("doc_id", "text").unionByName(mails.selectExpr("doc_id", "subject as text")), spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")):
        texts = [r["text"] for r in rows.collect()]
        want = {label: (kind and "identifier" or "residue", sum(hits(label, p, t) > 0 for t in texts), sum(hits(label, p, t) for t in texts)) for label, p, kind in P.AUDIT}
        assert {r["label"]: (r["kind"], r["n_rows"], r["n_hits"]) for r in deident.audit(rows, "text").collect()} == want and len(want) == 18


def cleaned(text):
    text = plain(P.SPLIT_EMAIL).sub(r"\1", re.sub(P.SOFT_BREAK, "", text))
    if re.search(P.HTML_ISH, text):
        text = re.sub(P.HTML_TAG, " ", text)
    text = re.sub(P.ATTACHMENT, " ", text)
    opened = [m.start() for m in re.finditer(P.DISCLAIMER_OPEN, text) if re.search(P.DISCLAIMER_CONFIRM, text[m.start() : m.start() + 400])]
    text = text[: opened[0]] if opened else text
    phrase = re.search(P.DISCLAIMER_INLINE, text)
    if phrase and phrase.start() > 0.35 * len(text):
        head = text[: phrase.start()]
        cut = max(head.rfind("\n"), head.rfind(". ") + 1)
        text = text[:cut] if cut > 0 else text
    return re.sub(r"[ \t]{2,}", " ", text).strip()


def labelled(text):
    """Of every character, the island it is in: every pair of overlapping spans is one, by repeated joining."""
    spans = [(a, b, k, s, src) for a, b, k, s, src in deident.capitalised_pairs(text)]
    for kind, pattern, score, group, accept, _ in P.RULES:
        if kind not in P.KINDS or not text.strip():
            continue
        for m in plain(pattern).finditer(text):
            value = m.group(group).strip()
            ok = {"": True, "luhn": luhn(value) if accept == "luhn" else 0, "iban": accept == "iban" and valid_iban(value), "namey": bool(re.match(P.NAMEY, value)), "unlisted": value.split()[:1] and value.split()[0].lower() not in P.STOPLIST}[accept]
            if ok and value:
                spans.append((m.start(group), m.start(group) + len(value) if group else m.end(), kind, score, "rule"))
    groups = [[s] for s in sorted(spans, key=lambda s: (s[0], -s[1]))]
    joined = True
    while joined:
        joined = False
        for i in range(len(groups) - 1):
            if groups[i + 1][0][0] < max(s[1] for s in groups[i]):
                groups[i] += groups.pop(i + 1)
                joined = True
                break
    out = []
    for g in groups:
        best = max(g, key=lambda s: s[3])
        out.append((g[0][0], max(s[1] for s in g), best[2], best[4]))
    return out


def valid_iban(value):
    only = re.sub("[ -]", "", value)
    number = "".join(str(ord(c) - 55) if c.isalpha() else c for c in only[4:] + only[:4])
    return 15 <= len(only) <= 34 and int(number) % 97 == 1


def vocabulary(pool):
    tagged, seen = Counter(), Counter()
    for text, spans in pool:
        seen.update(re.findall(r"\b[A-Z][\w'-]{2,}\b", text))
        for a, b, kind, source in spans:
            if kind == "PERSON" and source == "ner":
                tagged.update(t for t in re.findall(r"[A-Z][\w'-]+", text[a:b]) if len(t) >= 3 and t.lower() not in P.STOPLIST)
    return {n: (c, seen[n]) for n, c in tagged.items() if c >= 3 and c / max(seen[n], c) >= 0.5}


def rewritten(text, spans, names):
    for a, b, kind, _ in reversed(spans):
        text = text[:a] + P.PLACEHOLDER[kind] + text[b:]
    if names:
        text = re.sub(r"\b(?:" + "|".join(map(re.escape, sorted(names, key=lambda n: (-len(n), n)))) + r")(?:['’]s)?\b", "<PERSON>", text)
    text = re.sub(r"(<(?:PERSON|EMAIL|PHONE|LOCATION|DATE|ID_NUMBER|ADDRESS|URL)>)(?:[\s/,&]+\1)+", r"\1", text)
    return re.sub(r"<(<[A-Z_]+>)>", r"\1", text)


def test_mails_equal_the_plain_version(spark, mails):
    small = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id + 100 as doc_id", "text", "cast(null as string) as subject")
    for rows in (mails, small):
        texts = {r["doc_id"]: (cleaned(r["text"] or ""), r["subject"] or "") for r in rows.collect()}
        pool = [(t, labelled(t)) for pair in texts.values() for t in pair]
        names = vocabulary(pool)
        want = {i: tuple(rewritten(t, labelled(t), names) for t in pair) for i, pair in texts.items()}
        got = deident.scrub(rows, "text", "subject").collect()
        assert {r["doc_id"]: (r["scrubbed"], r["scrubbed_subject"]) for r in got} == want
        assert {r["n_names"] for r in got} == {len(names)}
    done = {r["doc_id"]: r for r in deident.scrub(mails, "text", "subject").collect()}
    assert "<ID_NUMBER>" in done[3]["scrubbed"] and "GB82" not in done[3]["scrubbed"] and "GB83" in done[3]["scrubbed"] and "123456789" not in done[3]["scrubbed"]
    assert done[6]["scrubbed_subject"] == "hello <PERSON>" and done[9]["scrubbed_subject"] == "12 March 2001"
    dated = {r["doc_id"]: r["scrubbed_subject"] for r in deident.scrub(mails, "text", "subject", kinds=(*P.KINDS, "DATE_TIME")).collect()}
    assert dated[9] == "<DATE>"


def test_counts_reports_and_samples(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    pool = [(t, labelled(t)) for t in texts.values()]
    assert {r["token"]: (r["tagged"], r["seen"]) for r in catalogue.QUERIES["name_vocabulary"](spark, SMALL).collect()} == vocabulary(pool)
    clean = {i: cleaned(t) for i, t in texts.items()}
    names = vocabulary([(t, labelled(t)) for t in clean.values()])
    done = {i: rewritten(t, labelled(t), names) for i, t in clean.items()}
    counts = {r["tag"]: r["n"] for r in catalogue.QUERIES["placeholder_counts"](spark, SMALL).collect()}
    assert counts == {tag: sum(t.count(tag) for t in done.values()) for tag in set(P.PLACEHOLDER.values())}
    report = {r["label"]: r for r in catalogue.QUERIES["audit_report"](spark, SMALL).collect()}
    for label, pattern, kind in P.AUDIT:
        before, after = (sum(hits(label, pattern, t) > 0 for t in x.values()) for x in (texts, done))
        r = report[label]
        assert (r["rows_before"], r["rows_after"]) == (before, after) and r["status"] == ("clear" if not after else "unchanged" if after >= before else "reduced")
        assert r["kind"] == ("identifier" if kind else "residue")
    total = catalogue.QUERIES["audit_totals"](spark, SMALL).first()
    assert total["n_rows"] == len(texts) and abs(total["kept"] - sum(map(len, done.values())) / sum(map(len, texts.values()))) < 1e-8
    assert total["leaks"] == sum(r["rows_after"] for r in report.values() if r["kind"] == "identifier")
    assert catalogue.QUERIES["review_samples"](spark, SMALL).count() == 20


def test_vocabulary_patterns():
    names = ["Ann", "Anna", "Anna-Lee", "An", "Bob", "O'Hara", "Annabel"]
    (pattern,) = deident.sweeps(names)
    own, plainly = re.compile(P.python_dialect(pattern)), re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?:['’]s)?\b")
    text = "An Ann Anna Annab Annabel's Anna-Lee Anna-Leeds Bobby Bob’s O'Hara O'Har"
    assert own.sub("<P>", text) == plainly.sub("<P>", text) and len(deident.sweeps(names, 3)) == 3
