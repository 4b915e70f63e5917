import hashlib
import math
import re

from inkprobe.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        n = int(c) * (2 if i % 2 else 1)
        s += n // 10 + n % 10
    return s % 10 == 0


def _brute(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"\D", "", m.group())
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                    "card": lambda: 14 <= len(digits) <= 19 and _luhn(digits),
                    "phone": lambda: 10 <= len(digits) <= 15}[name]()
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


ODD = ["a@b.c@d.e f@g", "@x.y a@b a@b.c.", "x.y%z+1@a-b.co.uk,", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "12.3.4",
       "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111", "+1 (017) 555-7713 +12 +1234567890123456",
       "++49 30 1234567.", "é@b.cd ü+4930123456789 ", "9" * 5_000 + ".1.1.1", "a" * 3_000 + "@", "1.1.1." + "0" * 4_400 + "7",
       "x@y..z x@y.z..w", "", None, "1-2 3", "4111  1111"]


def test_base_spans_equal_the_patterns(small_docs):
    import sys

    sys.set_int_max_str_digits(0)
    texts = ODD + [r.text for r in small_docs.collect()]
    for t in texts:
        assert pii.base_spans(t) == _brute(t), (t or "")[:80]


def _entity_docs(spark):
    rows = [(i, f"filler{i} words{i} agent redfox{i % 2} wrote from ann@corp.example about item{i} today") for i in range(8)]
    rows += [(100 + i, f"agent common today wrote from about nothing{i}") for i in range(200)]
    rows += [(300 + i, "agent common codename bluebird bob@corp.example") for i in range(9)]  # copies
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_terms_equal_brute_force(spark):
    docs = _entity_docs(spark)
    texts = [r.text for r in docs.collect()]
    blocks = [set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower())) for t in texts]
    total = len(blocks)
    with_e = [b for b, t in zip(blocks, texts) if "ann@" in t]
    want = {}
    for term in set().union(*with_e) - {"ann", "corp", "example"}:
        n_te, n_t = sum(term in b for b in with_e), sum(term in b for b in blocks)
        ic = math.log(total / len(with_e))
        if n_te >= 3 and math.log(total * n_te / (n_t * len(with_e))) / ic >= pii.GENERALISE:
            want[term] = math.log(total * n_te / (n_t * len(with_e))) / ic
    found = pii.base(docs)
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosing(found, docs).collect()}
    assert set(want) == {"redfox0", "redfox1"}
    assert {t for e, t in got} == set(want)  # copies of one block prove nothing
    assert all(abs(got["email:ann@corp.example", t] - w) < 1e-9 for t, w in want.items())


def test_spans_and_sanitised_text(spark):
    docs = _entity_docs(spark)
    found = pii.find(docs)
    rows = {r.doc_id: r for r in found.collect()}
    text = docs.filter("doc_id = 0").first().text
    assert [(text[s.start:s.end], pii.KINDS[s.kind]) for s in rows[0].spans] == [
        ("redfox0", "term"), ("ann@corp.example", "email")]
    assert len(rows[0].base) == 1 and rows[300].spans == rows[300].base
    clean = {r.doc_id: r.text for r in pii.sanitise(docs, found).collect()}
    assert "redfox" not in clean[0] and "[EMAIL]" in clean[0] and "ann" not in clean[0]
    assert clean[150] == docs.filter("doc_id = 150").first().text


def test_query_columns(spark):
    from inkprobe.llm import queries

    got = queries.op9_pii(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        spans = _brute(docs[r.doc_id])
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in spans) for k in range(4))
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


def test_odd_rows(docs, no_docs):
    got = pii.find(docs).collect()
    assert len(got) == 12 and all(r.spans == [] for r in got)
    assert pii.find(no_docs).count() == 0
    assert pii.redacted("abcdef", [(1, 0, 3), (2, 4, 5)], {2}) == "a[EMAIL]f"


def _with_filler(spark, texts, n=400):
    rows = [(1000 + i, f"plain words of every day stand in this text too {i}") for i in range(n)]
    return spark.createDataFrame([*enumerate(texts), *rows], "doc_id bigint, text string")


def _terms(docs):
    found = {r.doc_id: r for r in pii.find(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    return {i: {texts[i][s.start:s.end] for s in r.spans if pii.KINDS[s.kind] == "term"} for i, r in found.items()}


def test_entities_of_one_or_two_places_have_terms(spark):
    got = _terms(_with_filler(spark, [
        "plain words of Quillon eve@corp.example in this text", "this day Quillon wrote as eve@corp.example too",
        "plain words of staff 48213 zed@corp.example in this text", *["plain Copied sam@corp.example words"] * 3]))
    assert "Quillon" in got[0] and "Quillon" in got[1]
    assert got[2] == {"staff", "48213"}
    assert got[3] == got[4] == got[5] == {"Copied"}
    assert not any(terms & {"plain", "words", "text"} for terms in got.values())


def test_terms_do_not_depend_on_what_stands_before(spark):
    word = "plain words of every day stand in this text too".split()
    near = [" ".join([*(word * 5)[:31 + shift], "Quillon", *(word * 4)[:gap], "eve@corp.example", *(word * 4)[:gap], "Zorvex"])
            for shift in range(0, 33, 4) for gap in (0, 1, 15, 31)]
    far = " ".join(["Distantly", *(word * 4)[:32], "eve@corp.example"])
    got = _terms(_with_filler(spark, [*near, far], 4_000))
    assert all(got[i] == {"Quillon", "Zorvex"} for i in range(len(near)))
    assert got[len(near)] == set()


def test_rows_with_null_or_repeated_keys_are_redacted_one_by_one(spark):
    rows = [(None, "mail a.b@c.org now"), (None, "ip 10.0.0.1"), (4, "card"), (4, "to x@y.de"), (4, "to x@y.de"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.text or "") for r in pii.sanitise(docs).collect())
    assert len(got) == 6 and not any("@" in t or "10.0" in t for _, t in got)
    assert [t.count("[EMAIL]") for k, t in got if k == 4] == [0, 1, 1]
