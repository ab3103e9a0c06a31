import random

import brute
from quernel.llm import pii

GIVEN = "Anna Giovanni Yuki Thabo Svetlana Bartholomew Mei Kwame Ottilie Zeynep Rahel Tomasz".split()
FAMILY = "Schmidt Rossi Tanaka Johansson Kowalski Petrov Gonzalez McAllister Whitfield Ivanenko Andersen Nakamura".split()
DECOYS = ["Contact Customer Service for help", "from New York to South Dakota", "by Monday Morning", "name: Privacy Policy", "order 123-45-6789 was shipped", "build 078-05-1120", "see Figure Two", "DE12345678901234567890 is a part number", "version GB33BUKB20201555555556 of the file", "from Last Summer"]


def account(r, country, n):
    body = "".join(r.choice("0123456789") for _ in range(n))
    return next(f"{country}{c:02d}{body}" for c in range(2, 99) if brute.remainder97(f"{country}{c:02d}{body}") == 1)


def planted(r):
    """(text, the spans planted in it)."""
    out, spans = "", []
    for _ in range(r.randrange(1, 6)):
        kind = r.choice(["name", "ssn", "iban", None, None])
        if kind is None:
            out += r.choice(DECOYS) + ". "
            continue
        if kind == "name":
            before, value = r.choice(["contact ", "Dr. ", "signed, ", "name: ", "kontakt: "]), f"{r.choice(GIVEN)} {r.choice(FAMILY)}"
            if before == "Dr. ":
                before, value = "we met ", "Dr. " + value
        elif kind == "ssn":
            before, value = r.choice(["ssn ", "social security number: "]), f"{r.randrange(1, 666):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}"
        else:
            before, value = r.choice(["iban ", "account: ", "paid to "]), account(r, r.choice(["DE", "FR", "ES"]), 18)
            if r.random() < 0.3:
                value = " ".join(value[i : i + 4] for i in range(0, len(value), 4))
        out += "text " + before
        spans.append((kind, len(out), len(out) + len(value)))
        out += value + ". "
    return out, spans


def test_added_spans_on_planted_text(spark):
    """Precision and recall of what the classifier adds; both are in the README."""
    r = random.Random(13)
    texts = [planted(r) for _ in range(600)]
    rows = pii.digest(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect()
    found = {(x.doc_id, n, int(a), int(b)) for x in rows for s in x.spans.split(",") if s for n, a, b in [s.split(":")] if n not in pii.BASE}
    wanted = {(i, *s) for i, (_, spans) in enumerate(texts) for s in spans}
    for kind in ("name", "ssn", "iban"):
        f, w = ({x for x in s if x[1] == kind} for s in (found, wanted))
        print(kind, "precision", len(f & w) / len(f), "recall", len(f & w) / len(w), len(w))
        assert len(f & w) >= 0.9 * len(f) and len(f & w) >= 0.9 * len(w), (kind, sorted(f - w)[:5], sorted(w - f)[:5])


def test_all_spans_are_brute_force(spark):
    r = random.Random(17)
    bits = [lambda: planted(r)[0], lambda: r.choice(GIVEN) + r.choice([" ", "  ", "-", "\n"]) + r.choice(FAMILY), lambda: r.choice(["Mr ", "Frau ", "contact: ", "Name,\n", "xDr ", "é", "日本 ", "1.2.3.4 ", "a@b.org "]), lambda: account(r, "DE", 18)[: r.randrange(10, 24)] + " ", lambda: r.choice(["O'Brien", "Jean-Luc Picard", "Müller", "LI CHEN"]) + " "]
    texts = ["".join(r.choice(bits)() for _ in range(r.randrange(8))) for _ in range(400)] + [None, "", "Mr Smith " * 3000 + "contact Anna Schmidt"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(pii.vote_patterns(pii.candidates(df)))
    got = {x.doc_id: x.spans for x in pii.digest(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{n}:{a}:{b}" for a, _, b, n in brute.all_personal(t, pii, model)), t


def test_account_numbers(spark):
    right = ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"]
    df = spark.createDataFrame([(x,) for x in [*right, "DE89370400440532013001"]], "v string")
    assert [r[0] for r in df.select(pii.remainder97(df["v"])).collect()][:3] == [1, 1, 1] and brute.remainder97(right[1]) == 1
    assert df.select(pii.remainder97(df["v"]).alias("r")).collect()[3].r != 1
