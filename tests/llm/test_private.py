import hashlib
import random
import re


from cases import TEXTS, empty, table
from vellumist.llm import private as P


def brute(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


def random_texts(n=4000):
    r = random.Random(7)
    parts = ["a", "b.c", "@", ".", "x@y.z", "1", "12", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "4111111111111111", " ", "-", "+1 (372) 555-7739", "+", "(", "é", "İ", "%", "token = ", "http://", "\n", "0", "Account no: A12345678"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_base_spans_equal_the_expressions():
    for x in [t or "" for t in TEXTS] + random_texts():
        assert [s for s in P.find(x) if s[0] in P.BASE] == brute(x), repr(x)


def test_added_kinds():
    x = 'see https://h.example.org/a?b=c. my token = "2abc3ff2ca8f", Account No: DE89370400440532013000, discount = abc and tokens are fine'
    assert [(k, x[a:b]) for k, a, b in P.find(x)] == [("address", "https://h.example.org/a?b=c"), ("account", "2abc3ff2ca8f"), ("account", "DE89370400440532013000")]
    assert P.masked(x, P.find(x)).startswith('see <ADDRESS>. my token = "<ACCOUNT>"')


PLANTED = [  # (text, what is to be found of the added kinds)
    ("Konto: 1234567890 bitte", ["1234567890"]),
    ("Ihre Kontonummer lautet 12 345 678.", ["12 345 678"]),
    ("contraseña: hunter22", ["hunter22"]),
    ("Passwort = geheim77!", ["geheim77"]),
    ("mot de passe : soleil2024 ok", ["soleil2024"]),
    ("la cuenta bancaria número 0049 1500 0512 3456 sigue", ["0049 1500 0512 3456"]),
    ("IBAN: DE89 3704 0044 0532 0130 00 und mehr", ["DE89 3704 0044 0532 0130 00"]),
    ("iban DE89370400440532013000", ["DE89370400440532013000"]),
    ("IBAN GB82 WEST 1234 5698 7654 32.", ["GB82 WEST 1234 5698 7654 32"]),
    ("account number 12345678", ["12345678"]),
    ("ssn 123-45-6789", ["123-45-6789"]),
    ("Social Security No. 078-05-1120,", ["078-05-1120"]),
    ("passport no: C01X00T47", ["C01X00T47"]),
    ("see www.example.com/path and", ["www.example.com/path"]),
    ("ftp://files.example.org:2121/a_b?c=d.", ["ftp://files.example.org:2121/a_b?c=d"]),
    ("http://user:pw@10.0.0.1:80/x", ["http://user:pw@10.0.0.1:80/x"]),
    ("mailto:jo@mail.example.com", ["mailto:jo@mail.example.com"]),
    ("tel:+49-30-1234567", ["tel:+49-30-1234567"]),
    ('{"api_key": "sk_live_9f8a7b6c"}', ["sk_live_9f8a7b6c"]),
    ("the password is correct1horse", ["correct1horse"]),
    # nothing to be found
    ("account is temporarily1 closed", []),
    ("an account of 3 travellers in 1999", []),
    ("iban DE00370400440532013000", []),
    ("ssn 666-45-6789 and ssn 900-12-3456 and ssn 123-00-6789", []),
    ("http://]]]a and http://.. and http://-", []),
    ("the token economy of 2024", []),
    ("cuenta con 3 amigos", []),
    ("die Kontonummer fehlt", []),
    ("subtokens=12345678 discount: 123456", []),
    ("tel: ask for 12", []),
    ("password: required", []),
]


def test_recall_and_precision_on_planted_cases():
    found = right = wanted = 0
    for x, want in PLANTED:
        got = [x[a:b] for k, a, b in P.find(x) if k not in P.BASE]
        found, right, wanted = found + len(got), right + len(set(got) & set(want)), wanted + len(want)
        assert got == want, (x, got)
    assert right == wanted == found == 20


def test_iban_checksum_by_brute_force():
    for code in ("DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "ES9121000418450200051332"):
        assert P.iban(code, 0) == len(code)
        for i in range(4, len(code)):
            other = code[:i] + str((int(code[i], 36) + 1) % 10) + code[i + 1 :]
            assert P.iban(other, 0) < len(code)


def test_long_texts_are_linear():
    for x in ("1" * 300_000, "1 " * 150_000, "a@" * 100_000, "+1" + "(" * 100_000, "token = " * 50_000, "1." * 100_000, "iban " * 50_000, "iban " + "DE11" * 50_000, "http://" + "a." * 100_000, "www." * 100_000, "konto " + "1 " * 100_000, "account number " * 50_000):
        P.find(x)


def test_tables(spark):
    rows = {r.doc_id: r for r in P._mapped(table(spark), "text", "doc_id", True).collect()}
    for i, x in enumerate(TEXTS):
        base = brute(x or "")
        assert rows[i].base_sha256 == hashlib.sha256(P.written(base).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in P.BASE] == [sum(s[0] == k for s in base) for k in P.BASE]
    assert P.find_personal(empty(spark)).collect() == []
    masked = P.mask_personal(table(spark))
    assert masked.columns == table(spark).columns
    text = {r.doc_id: r.text for r in masked.collect()}
    assert text[0] is None and text[3] == "one" and "<EMAIL>" in text[10] and "@mail" not in text[10]
