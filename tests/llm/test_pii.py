import hashlib
import re

from buildlens.llm import pii

ODD = [(-1, "a@b.c_d@e.f x@y a.b@c 1.2.3.4.5 300.1.1.1 1.2.3.4"), (-2, None), (-2, None), (None, ""),
       (-3, "1 " * 20000 + "4111 1111 1111 1111x +1 (375) 555-4393. call 555-123-4567, mail bob [at] mail.com ssn 123-45-6789"),
       (-4, "é" * 50 + "@b.com \U0001f600x@y.zz " + "a." * 20000 + " +1" + "(" * 3000), (-5, "4111111111111111@a.b 4111-1111-1111-1111 12.34.56.78.com a@1.2.3.4"),
       (-6, "nothing here, version 1.2.3, 2024-01-02")]


def luhn(digits):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    found = [(0, m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((1, m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((3, m.span()))
    return ",".join(f"{pii.BASE[k]}:{a}:{b}" for k, (a, b) in sorted(found))


def test_base_spans_are_those_of_the_patterns(spark, documents):
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = pii.digest(pii.spans(documents(*ODD, *real))).collect()
    want = sorted((str(i), hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t in [*ODD, *real])
    assert sorted((str(r.doc_id), r.base_sha256) for r in rows) == want
    assert all(r.spans.startswith(base_spans(dict(real).get(r.doc_id) or "")) for r in rows if r.doc_id and r.doc_id > 0)


def test_added_spans_never_overlap_base(documents):
    found = {r.doc_id: r.spans for r in pii.digest(pii.spans(documents(*ODD))).collect()}
    assert re.sub(r":\d+:\d+", "", found[-3]) == "phone,address_spelled,phone_national,ssn"
    assert found[-6] == ""


def test_redaction_keeps_columns_and_nulls(documents):
    docs = documents(*ODD)
    rows = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert rows[-2].text is None and rows[-2].score == 1.0 and rows[-6].text == ODD[-1][1]
    assert rows[-5].text == "<EMAIL> <CARD> <IP>.com <EMAIL>"
    assert pii.redact(docs.limit(0)).columns == docs.columns


def test_empty_table(documents):
    assert pii.digest(pii.spans(documents())).collect() == []


def test_reliable_labelers_are_found():
    counts = [("ip", 1, 1, 0, 1, 90), ("ip", -1, -1, 0, 1, 60), ("ip", 1, -1, 0, 1, 5), ("ip", -1, 1, 0, 1, 5)]
    prior, tables = pii.reliabilities(counts)
    assert 0.5 < prior["ip"] < 0.7
    assert tables[0][1][0] > 0.8 and tables[0][1][1] < 0.2
    assert abs(tables[3][1][0] - tables[3][1][1]) < 0.05
