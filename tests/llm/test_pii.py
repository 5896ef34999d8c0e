import hashlib
import random
import re

from sigspark.llm import pii as P, queries as Q


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def texts():
    rng = random.Random(9)
    odd = ["", None, "a@b.c_d@e.f.g x@y 1.2.3.4.5.6.7.8.9 300.1.1.1 0001.2.3.255 1.2.3.0000000000000000000000000000001",
           "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567... +49.30.1234567890123456 ++12345678 9",
           "é@x.y ü+123 456 789 0é 😀 a@b.co 😀 1.1.1.1", "1" * 5000 + " " + "a" * 30000 + "@ " + "a.b@c." * 500, "x@y.z " * 700, "9-" * 7000 + "9 +" + "1" * 8000,
           "IBAN: DE89 3704 0044 0532 0130 00 ok, GB82WEST12345698765432 x, DE89 3704 0044 0532 0130 01", "my ssn 123-45-6789 x", "number 123-45-6789", "a@b.c\n@d.e.f"]
    for _ in range(150):
        odd.append("".join(rng.choice(["1", "23", "4", " ", "-", ".", "@", "a", "b%", "+", "(", ")", "é", "😀", "25", "\n", "4111111111111111"]) for _ in range(rng.randint(1, 80))))
    return odd


def test_base_spans_and_digest(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r.spans for r in P.find(df).collect()}
    for i, t in rows:
        assert [(s.kind, s.start, s.end) for s in got[i] if s.kind in P.BASE] == base(t or ""), t
        assert all((t or "")[s.start:s.end] == s.value and 0 <= s.score <= 1 for s in got[i])
    added = [(s.kind, s.value) for i in got for s in got[i] if s.kind not in P.BASE]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in added and ("iban", "GB82WEST12345698765432") in added and len([k for k, _ in added if k == "ssn"]) == 1


def test_query_columns(spark, tmp_path):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())] + [(None, "a@b.c"), (1, None)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in Q.QUERIES["op4_personal_data"](spark, str(tmp_path)).collect():
        if r.doc_id is not None and r.doc_id != 1:
            b = base(texts()[r.doc_id] or "")
            assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in b) for x in P.BASE)
    assert P.find(df.limit(0)).count() == 0


def test_context_reaches_over_other_matches_and_secrets_need_one(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = ["SSN: 123-45-6789, 223-45-6789", "x" * 60 + " ssn " + "y" * 45 + " 123-45-6789", f'token = "{key}" and more', f"commit {key} fixed it", "token aaaaaaaaaaaaaaaaaaaaaaaa1", "secret of an" + "overlylongword" * 3]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.value) for s in r.spans if s.kind not in P.BASE] for r in P.find(df).collect()}
    assert got == {0: [("ssn", 5, "123-45-6789"), ("ssn", 18, "223-45-6789")], 1: [], 2: [("secret", 9, key)], 3: [], 4: [], 5: []}
