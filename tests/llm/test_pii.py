import hashlib
import random
import re

from twinframe.llm import pii

from .helpers import DOCS, corpus, frame

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def passes_luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and passes_luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def texts():
    rng = random.Random(6)
    fixed = ["a@b@c.com x@y.z.w@q.org é@x.de", "1.2.3.4.5.6.7.8 999.1.1.1 000255.1.1.1 10.0.0.256", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (017) 555-7713, +44 20 7946 0958 +1", "😀 a.b+c%d@mail-1.example.co.uk.", ".@x.y", "@", "", "+", "1" * 400, "a" * 3000 + "@" + "b" * 3000]
    mixed = ["".join(rng.choice(("1", "23", "4.", ".", "@", "a", "b-", "+", " ", "(", ")", "-", "é", "x.y", "4111111111111111", "+1 555 123 4567")) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    return fixed + mixed


def test_base_spans_against_plain_search():
    for t in texts():
        assert [s for s in pii.find_spans(t) if s[0] in pii.KINDS[:4]] == plain(t), t


def test_added_kinds():
    kinds = lambda t: [k for k, _, _ in pii.find_spans(t)]
    assert "iban" in kinds("IBAN DE89 3704 0044 0532 0130 00.") and "iban" not in kinds("IBAN DE89 3704 0044 0532 0130 01.")
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert kinds(f'token = "{key}"') == ["secret"] and kinds(f"commit {key}") == [] and kinds(key) == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"] and kinds("part no 123-45-6789") == [] and "ssn" not in kinds("ssn 000-45-6789")


def test_query_columns_and_mask(spark):
    rows = corpus() + [(900 + i, t, "en", "s", 1) for i, t in enumerate(texts()[:200])]
    for r in pii.with_pii(frame(spark, rows)).collect():
        base = plain(r.text or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == s[0] for s in base) for k in pii.KINDS[:4])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    masked = pii.mask_pii(frame(spark, rows))
    assert masked.columns == frame(spark, rows).columns and masked.filter("text is null").count() == 1
    got = {r.doc_id: r.text for r in masked.collect()}
    assert all(got[i] == t for i, t, *_ in rows if i >= 900 and not pii.find_spans(t))
    assert pii.mask("a 1.2.3.4 b", [("ip", 2, 9)]) == "a <IP> b"
    assert pii.mask("0123456789", [("card", 2, 6), ("phone", 4, 8), ("ip", 8, 9)]) == "01<CARD><IP>9"
    assert pii.mask("0123456789", [("card", 1, 9), ("ip", 2, 4), ("ip", 5, 7)]) == "0<CARD>9"


def test_edges(spark):
    assert pii.with_pii(spark.createDataFrame([], DOCS)).collect() == []
    odd = frame(spark, corpus()).selectExpr("*", "'x' as spans", "1 as n_ip")
    assert pii.with_pii(odd).count() == len(corpus()) and pii.mask_pii(odd).columns == odd.columns


def test_iban_before_other_capitals():
    for text, number in (
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89 3704 0044 0532 0130 00"),
        ("IBAN DE89370400440532013000 2024", "DE89370400440532013000"),
        ("GB82 WEST 1234 5698 7654 32 UK", "GB82 WEST 1234 5698 7654 32"),
        ("AB12 CDEF GHIJ KLMN DE89 3704 0044 0532 0130 00 THE END", "DE89 3704 0044 0532 0130 00"),
    ):
        assert [text[a:b] for k, a, b in pii.find_spans(text) if k == "iban"] == [number]
    two = "NO93 8601 1117 947 DE89 3704 0044 0532 0130 00"
    assert [two[a:b] for k, a, b in pii.find_spans(two) if k == "iban"] == ["NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00"]
    assert not [s for s in pii.find_spans("DE88 3704 0044 0532 0130 00 BIC") if s[0] == "iban"]
