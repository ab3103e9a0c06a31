import random
import string

import brute
from quernel.llm import secrets

KEY = "Zx81kQ7vTn4LpR2wYc9HsB6mJd3FgA5e"


def test_placeholders_allow_their_own_part_only(spark):
    r = random.Random(7)
    blob = "".join(r.choice(string.ascii_letters + string.digits) for _ in range(60))
    texts = [f"at sample_key={KEY}.", f"GET /example/reset/{KEY}", f"{blob}+xxxxxxx/{KEY}", f"{KEY}-dummy", f"{KEY}EXAMPLE", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "example1/internationalization-of-words-and-more", "/sample/123e4567-e89b-12d3-a456-426614174000/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "sample_" * 2000 + KEY, "g" * 100_000 + "example"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {x.doc_id: [tuple(s.split(":")) for s in x.spans.split(",") if s] for x in secrets.digest(df).collect()}
    found = {i: [texts[i][int(a) : int(b)] for _, a, b in s] for i, s in spans.items()}
    for i in (0, 1, 2, 3, 9):
        assert any(KEY in x for x in found[i]), (i, found[i])
    assert found[2][0] == blob and found[3] == [KEY] and found[9] == [KEY]
    for i in (4, 5, 6, 7, 8, 10):
        assert found[i] == [], (i, found[i])
    clean = {x.doc_id: x.text for x in secrets.redact(df).collect()}
    assert all(KEY not in clean[i] for i in (0, 1, 2, 3, 9)) and clean[5] == texts[5]


def test_all_spans_are_brute_force(spark):
    r = random.Random(11)
    letters = string.ascii_letters + string.digits + "+/_=-"
    noise = lambda n: "".join(r.choice(letters) for _ in range(n))
    hexes = lambda n: "".join(r.choice("0123456789ABCDEF") for _ in range(n))
    bits = [lambda: noise(r.randrange(50)), lambda: hexes(r.randrange(60)), lambda: "a" * r.randrange(40), lambda: r.choice(["example", "Sample", "dummy", "xxxxxx", "abcdefgh", "01234567"]), lambda: r.choice("+/_=- \n.é"), lambda: "token=" + noise(12), lambda: "word"]
    texts = ["".join(r.choice(bits)() for _ in range(r.randrange(14))) for _ in range(500)]
    texts += [noise(32) + "a" * 2000 + noise(32), noise(40).translate(str.maketrans("+/_=-", "abcde")) + "sample", "x" * 30 + KEY * 3 + "abcdefgh" + KEY * 3, "123e4567-e89b-12d3-a456-426614174000" * 3]
    got = {x.doc_id: x.spans for x in secrets.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == ",".join(f"{n}:{a}:{b}" for a, _, b, n in brute.all_secrets(t)), t
    # calm text between two keys, and a placeholder in a long blob, hide nothing and aren't hidden
    assert got[500].count("entropy_base64") == 2 and got[501] and got[502]
