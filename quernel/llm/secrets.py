"""Secret scans with DataFrame functions only.

Base findings are assignments to secret-like names, access keys and long hexadecimal runs. Further spans come from
a sliding window over candidate strings: for each character class, a window of WINDOW characters moves along the
candidate; counts per character change by the one that enters and the one that leaves, and with them the sum of
c * log2(c) that gives the window's Shannon entropy. The counts lie in a few long integers, FIELD bits each, so a step costs the
same whatever the class's size. Where the entropy reaches the class's bound the window is hot. Hot windows that overlap are one
span, so calm text between two of them stays outside, unless a base span already covers the candidate or the allow list suppresses it.

The allow list takes out whole candidates of known forms, and the parts of others that hold a placeholder's word, up to the next
separator on either side. A part that is long for its placeholders, beyond PART_RATIO characters for each of theirs, is
not allowed. What lies before, between and after allowed parts are candidates of their own. The allow list concerns these
spans only; base ones stay.

Edge cases. A null text is the empty text and has no spans; texts of any length are scanned whole; repeated rows give
repeated results; an empty table gives an empty table; extra columns pass through (`redact`, `scan`), one with an
output's name gives way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans

#: The contract's patterns. The last is the same as [0-9a-f]+ with 32 characters or more.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{32,}+"
WINDOW = 24
#: Character classes: candidates, and the bits a window must reach (a window of 24 has 4.58 at most).
CLASSES = {"entropy_base64": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+", 4.0), "entropy_hex": (r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,}+", 3.2)}
#: Allow list. Parts of a candidate, between separators, that hold a placeholder's word; and whole candidates: UUIDs, and
#: names or paths made of words (no digit, or no letter).
WORDS = r"(?i)example|sample|placeholder|dummy|changeme|x{6}|abcdefgh|01234567"
PART = rf"(?<![A-Za-z0-9])[A-Za-z0-9]*?(?:{WORDS})[A-Za-z0-9]*+"
ALLOWED = [r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^[^0-9]*$", r"^[^A-Za-z]*$"]
#: Characters of a part for each character of the placeholders in it, at most, if the part is to be allowed.
PART_RATIO = 6
#: Candidate characters, each with a count of FIELD bits; FIELDS counts share a long.
ALPHABET = "+-/=_0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
FIELD, FIELDS = 5, 12
#: What rounding may take from an entropy that just reaches its bound.
SLACK = 1e-9


def _hot(value: Column, bound: float) -> Column:
    """(first, last) starts of the windows of each run of overlapping hot windows."""
    # the place of a character's count, from 0, follows from its code; 24 counts of 5 bits never overflow
    place = F.array(*[F.lit(ALPHABET.find(chr(c))) for c in range(128)])
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.get(place, F.ascii(c)))
    units, log = F.array(*[F.lit(1 << FIELD * i).cast("bigint") for i in range(FIELDS)]), F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    words = -(-len(ALPHABET) // FIELDS)
    state = "struct<counts:array<bigint>,sum:double,i:int,runs:array<struct<first:int,last:int>>>"
    zero = F.struct(F.array_repeat(F.lit(0).cast("bigint"), words).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.array().alias("runs")).cast(state)
    pairs = F.transform(codes, lambda c, i: F.struct(c.alias("enters"), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).alias("leaves")))
    of = lambda c: F.struct((c / FIELDS).cast("int").alias("word"), F.get(units, c % FIELDS).alias("unit"), (c % FIELDS * FIELD).alias("shift"))
    pairs = F.transform(pairs, lambda p: F.struct(of(p["enters"]).alias("enters"), F.when(p["leaves"].isNotNull() & (p["leaves"] != p["enters"]), of(p["leaves"])).alias("leaves"), (p["leaves"].isNotNull() & (p["leaves"] == p["enters"])).alias("same")))
    count = lambda a, c: F.call_function("shiftright", F.get(a["counts"], c["word"]), c["shift"]).bitwiseAND((1 << FIELD) - 1).cast("int")

    def step(a: Column, p: Column) -> Column:
        enters, leaves = p["enters"], p["leaves"]
        gain = F.get(log, count(a, enters) + 1) - F.get(log, count(a, enters))
        loss = F.when(leaves.isNotNull(), F.get(log, count(a, leaves)) - F.get(log, count(a, leaves) - 1)).otherwise(0.0)
        total = a["sum"] + F.when(p["same"], 0.0).otherwise(gain - loss)
        moved = F.transform(a["counts"], lambda w, j: w + F.when(j == enters["word"], enters["unit"]).otherwise(0) - F.when(j == leaves["word"], leaves["unit"]).otherwise(0))
        start = a["i"] - (WINDOW - 1)
        hot = (start >= 0) & (F.lit(math.log2(WINDOW) - bound + SLACK) - total / WINDOW >= 0)
        n, last = F.size(a["runs"]), F.element_at(a["runs"], -1)
        fresh = F.array(F.struct(start.alias("first"), start.alias("last")))
        longer = F.concat(F.slice(a["runs"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.struct(last["first"].alias("first"), start.alias("last"))))
        runs = F.when(~hot, a["runs"]).when((n > 0) & (start < last["last"] + WINDOW), longer).otherwise(F.concat(a["runs"], fresh))
        return F.struct(F.when(p["same"], a["counts"]).otherwise(moved).alias("counts"), total.alias("sum"), (a["i"] + 1).alias("i"), runs.alias("runs")).cast(state)

    return F.aggregate(pairs, zero, step, lambda a: a["runs"])


def _windows(bound: float):
    return lambda s: F.struct(s["start"].alias("at"), _hot(s["match"], bound).alias("runs"))


def _rest(s: Column) -> Column:
    """The candidate, or what allowed parts leave of it, without separators at the ends (but =, which may be padding)."""
    kind = "array<struct<start:bigint,end:bigint,match:string>>"
    parts = F.zip_with(F.split(s["match"], PART, -1), F.regexp_extract_all(s["match"], F.lit(PART), F.lit(0)), lambda x, gone: F.struct(x.alias("x"), F.coalesce(gone, F.lit("")).alias("gone")))
    # `at` is where the next piece begins, `held` what has come since the last allowed part
    zero = F.struct(s["start"].alias("at"), F.lit("").alias("held"), F.array().cast(kind).alias("out"))

    def cut(at: Column, held: Column) -> Column:
        """What of `held`, which ends at `at`, is a candidate."""
        x = F.ltrim(held, F.lit("+/_=-"))
        kept = F.rtrim(x, F.lit("+/_-"))
        start = at - F.length(x)
        one = F.struct(start.alias("start"), (start + F.length(kept)).alias("end"), kept.alias("match"))
        return F.when(F.length(kept) >= WINDOW, F.array(one).cast(kind)).otherwise(F.array().cast(kind))

    def step(a: Column, p: Column) -> Column:
        held, end = F.concat(a["held"], p["x"]), a["at"] + F.length(p["x"])
        words = F.length(p["gone"]) - F.length(F.regexp_replace(p["gone"], WORDS, ""))
        allowed = words * PART_RATIO >= F.length(p["gone"])
        return F.struct((end + F.length(p["gone"])).alias("at"), F.when(allowed, "").otherwise(F.concat(held, p["gone"])).alias("held"), F.when(allowed, F.concat(a["out"], cut(end, held))).otherwise(a["out"]).alias("out"))

    whole = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"))).cast(kind)
    # the piece after the last part has nothing gone, which counts as allowed: it ends the candidate
    return F.when(s["match"].rlike(WORDS), F.aggregate(parts, zero, step, lambda a: a["out"])).otherwise(whole)


def _hot_spans(kind: int, name: str):
    return lambda s: F.transform(s["runs"], lambda r: F.struct((s["at"] + r["first"]).alias("start"), F.lit(kind).alias("kind"), (s["at"] + r["last"] + WINDOW).alias("end"), F.lit(name).alias("name")))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `base` and `found` (arrays of spans: start, kind, end, name); `found` holds the base ones too."""
    return spans.unpacked(_scan(spans.packed(df, text)), df.columns, ["base", "found"])


def _scan(df: DataFrame) -> DataFrame:
    """(row, text, base, found) of a packed frame."""
    patterns = {"_assign": (ASSIGN, 2), "_access": (ACCESS, 0), "_hex": (HEX, 0)} | {f"_{n}": (p, 0) for n, (p, _) in CLASSES.items()}
    df = spans.matches(df, "text", patterns)
    kept = [F.transform(F.filter("_assign", lambda s: F.length(s["value"]) >= 8), lambda s: spans.span(s, 0, "assign")), F.transform(F.filter("_access", lambda s: s["end"] - s["start"] >= 16), lambda s: spans.span(s, 1, "access")), F.transform("_hex", lambda s: spans.span(s, 2, "hex"))]
    df = df.withColumn("base", F.array_sort(F.concat(*kept)))

    def suspect(s: Column) -> Column:
        calm = F.lit(False)
        for p in ALLOWED:
            calm = calm | s["match"].rlike(p)
        return ~calm & ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))

    more = []
    for k, (n, (_, bound)) in enumerate(CLASSES.items()):
        # whole candidates first, then what is left of those that hold an allowed part
        df = df.withColumn(f"_{n}", F.filter(f"_{n}", suspect))
        df = df.withColumn(f"_{n}", F.filter(F.flatten(F.transform(f"_{n}", _rest)), suspect))
        df = df.withColumn(f"_{n}", F.transform(f"_{n}", _windows(bound)))
        more.append(F.flatten(F.transform(f"_{n}", _hot_spans(3 + k, n))))
    df = df.withColumn("found", F.array_sort(F.concat("base", *[m.cast(spans.SPAN) for m in more])))
    return df.select("row", "text", "base", "found")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same columns and rows, with each secret in the text replaced by a mark. A null text stays null."""
    clean = F.when(F.col(f"row.`{text}`").isNotNull(), spans.redacted(F.col("text"), F.col("found"), mark))
    return spans.unpacked(_scan(spans.packed(df, text)), df.columns, [], {text: clean})


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The scan's counts and digests for each row."""
    found = scan(df.select(key, text), text)
    count = lambda name: F.size(F.filter("base", lambda s: s["name"] == name)).cast("bigint").alias(f"n_{name}")
    return found.select(key, count("assign"), count("access"), count("hex"), F.sha2(spans.shown(F.col("base")), 256).alias("base_sha256"), spans.shown(F.col("found")).alias("spans"))
