import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from remitweave.llm import pii, queries


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(x * 2 - 9 * (x > 4) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def base(text):
    return [s[:3] for s in pii.find(text) if s[0] in pii.BASE]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("ab@.-+ 0123456789(%_é")), max_size=60))
def test_base_spans_match_the_patterns(text):
    assert base(text) == brute(text)


def test_long_runs_are_read_once():
    text = "1" * 300_000 + " " + "1.2.3.4.5.6.7.8.9." * 20_000 + "@" * 1000 + "+" + "(" * 200_000
    assert base(text)[:2] == [("ip", 300_001, 300_008), ("ip", 300_009, 300_016)]


def test_kinds():
    text = "Pay card 4111 1111 1111 1111, mail a.b@x.co.uk@y.de or +49 (30) 1234-567; host 10.0.0.256 10.0.0.1 é DE89 3704 0044 0532 0130 00 SSN 123-45-6789 ref 123-45-6780"
    assert base(text) == brute(text)
    assert [s[0] for s in pii.find(text) if s[0] not in pii.BASE] == ["iban", "ssn", "ssn"]
    assert {s[0] for s in pii.find(text)} == {"email", "ip", "card", "phone", "iban", "ssn"}
    (a, b), = [s[1:3] for s in pii.find(text) if s[0] == "iban"]
    assert text[a:b] == "DE89 3704 0044 0532 0130 00"
    assert not any(s[0] == "iban" for s in pii.find("account DE89 3704 0044 0532 0130 01"))
    assert not any(s[0] == "ssn" for s in pii.find("part 123-45-6789"))
    near, far = (pii.find(f"{w} 4111111111111111")[0][3] for w in ("visa", "blue"))
    assert near > far


def test_secrets():
    key = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    assert [(k, a, b) for k, a, b, _ in pii.find(f'token = "{key}" x')] == [("secret", 9, 49)]
    assert [s[0] for s in pii.find(f"API_KEY: {key.upper()}!!")] == ["secret"]
    for clean in (f"commit {key}", "token a1" + "a" * 30, "secret " + "z" * 40, "password internationalisation-of-words", "token 12345678901234567890123"):
        assert not any(s[0] == "secret" for s in pii.find(clean)), clean


def test_detect(odd_docs, no_docs):
    found = pii.detect(odd_docs).collect()
    assert len(found) == odd_docs.count() and not any(r["spans"] for r in found)
    assert pii.detect(no_docs).count() == 0


def test_query(spark, tmp_path):
    rows = [(1, "a@b.cc 1.2.3.4"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in queries.op10_pii(spark, str(tmp_path)).collect()}
    assert found[1]["spans"] == "email:0:6,ip:7:14" and found[1]["n_email"] == 1 and found[2]["spans"] == ""
    assert found[1]["base_sha256"] == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest() and found[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert found[1]["n_spans"] == 2 and found[1]["scores"] == "0.85,0.75" and found[2]["n_spans"] == found[2]["n_ip"] == 0
