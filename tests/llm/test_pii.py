import hashlib
import random
import re

from forumlens.llm import pii, queries

KINDS = ["email", "ip", "card", "phone"]
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for rank, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = (
                kind == "email"
                or kind == "ip"
                and all(int(p) <= 255 for p in m[0].split("."))
                or kind == "card"
                and 14 <= len(d) <= 19
                and luhn(d)
                or kind == "phone"
                and 10 <= len(d) <= 15
            )
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def texts():
    rng = random.Random(11)
    bits = ["a@b.co", "x_y@d.e-f.g", "@", ".", "-", " ", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1",
            "1.2.3.4.5.6.7.8", "+1 (555) 123-4567", "+", "7", "00012", "𝔘é", "ü", "\n", "c-_x@d.e", "5105105105105100", "(", ")", "%", "x"]
    yield from (None, "", "none", "a@b.c-_x@d.e", "1" * 30, "0000000255.1.1.001", "4111 1111 1111 1111 5105105105105100")
    for _ in range(400):
        yield "".join(rng.choice(bits) for _ in range(rng.choice([3, 8, 40])))
    yield "é 4111111111111111 a@b.co 10.0.0.1 " * 700
    yield "9" * 60000 + " a" + ".a" * 60000 + "@"
    yield "1-" * 40000


def test_base_spans_match_plain_expressions(spark):
    every = list(texts())
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(every)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in queries.pii_digest(df).collect()}
    assert len(got) == len(every)
    for i, t in enumerate(every):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (t or "")[:200]
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
        assert got[i].n_email == want.count("email:") and got[i].n_card == want.count("card:")
    assert queries.pii_digest(df.limit(0)).count() == 0


def test_checks_and_context(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "IBAN DE88370400440532013000"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_pii(df).collect()}
    assert got == {1: [("iban", 5, 32)], 2: [], 3: [("ssn", 4, 15)], 4: []}


def test_ibans_in_running_text(spark):
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606", "NO9386011117947"]
    after = ["", " Bitte", " bitte", " BITTE ZAHLEN", " 42 EUR", " 1234567890", ".", ", Dank", "\nDE89 3704 0044 0532 0130 00 Und", " A"]
    rows, want = [], []
    for iban in ibans:
        for tail in after:
            text = f"Konto {iban}{tail}"
            rows.append((len(rows), text))
            want.append([(6, 6 + len(iban))] + ([(7 + len(iban), 34 + len(iban))] if "\n" in tail else []))
    for text in ("DE89370400440532013000Bitte", "DE88370400440532013000 Bitte", "xDE89370400440532013000"):
        rows.append((len(rows), text))
        want.append([])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: [(s.start, s.end) for s in r.spans if s.kind == "iban"] for r in pii.find_pii(df).collect()}
    for i, spans in enumerate(want):
        assert got[i] == spans, rows[i]
