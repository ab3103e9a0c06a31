"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans come from patterns: the four base kinds (e-mail, IP address, payment card, phone) and further ones
(names after a title, a given name or a cue word, national numbers, bank account numbers). Labelers vote on each candidate,
for, against or not at all: a strict form of the kind's pattern (an account number's remainder by 97 too), a gazetteer, cue words
before the span, and its borders. A labeler that passes what nearly all candidates pass says nothing for them. The gazetteer of names is a list of given names and a rule for family names. The votes of all documents are counted by kind and pattern of votes; that table has at most
kinds * 3**labelers rows whatever the corpus, and on it expectation-maximisation estimates how reliable each labeler is
and a logistic span classifier is trained on the posteriors. Base spans that pass their checks always stay; a
further candidate is a span where the classifier gives at least THRESHOLD.

Edge cases. A null text is the empty text; texts of any length are scanned whole; without candidates the classifier
keeps its neutral weights; repeated rows count once each; an empty table gives an empty table; extra columns pass
through, one with an output's name gives way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import stored

#: The contract's patterns. A run of local characters can only match from its start, or from where the
#: last match ended, so the guards in front change no match; possessive loops don't either, as what follows
#: them can't be inside them. They keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Frequent given names of several languages, and titles.
FIRST_NAMES = (
    "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|William|Elizabeth|David|Barbara|Richard|Susan|Joseph|Jessica|Thomas|Sarah|Charles|Karen|Daniel|Emily|Matthew|Emma|Andrew|Olivia|George|Anne|Paul|Laura|Kevin|Amanda|"
    "Hans|Peter|Klaus|Ursula|Anna|Stefan|Heike|Jürgen|Sabine|Wolfgang|Monika|Andreas|Petra|Lukas|Lena|"
    "Pierre|Marie|Jean|Camille|Luc|Sophie|Michel|Isabelle|Jacques|Claire|Louis|Chloé|"
    "Carlos|Juan|Ana|Jose|José|Maria|María|Luis|Carmen|Miguel|Lucía|Javier|Pilar|João|Beatriz|"
    "Giovanni|Giulia|Marco|Francesca|Luca|Chiara|Ivan|Olga|Dmitri|Natalia|Piotr|Agnieszka|Erik|Ingrid|Lars|Astrid|"
    "Mohammed|Fatima|Ahmed|Aisha|Omar|Layla|Wei|Li|Yuki|Hiroshi|Sakura|Kenji|Min|Priya|Raj|Anjali"
)
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Sr|Sra|Monsieur|Madame|Mme|Signor|Signora|Sir|Lady"
#: Words before a name, and words that make no name of two capitalised ones.
BEFORE = "contact|name|named|author|attn|signed|regards|sincerely|dear|from|by|kontakt|nombre|nom"
NO_NAME = "service|services|support|team|office|center|centre|street|road|avenue|department|university|college|school|church|hotel|company|corporation|inc|ltd|gmbh|bank|group|club|policy|terms|conditions|information|page|website|customer|customers|sales|help|desk|north|south|east|west|new|city|county|state|the|this|that|our|your|all|rights|privacy|press|news|monday|tuesday|wednesday|thursday|friday|saturday|sunday|january|february|march|april|may|june|july|august|september|october|november|december"
#: How family names of many languages begin or end: the rule that stands for a list of them.
FAMILY = r"(?:^|\x20)(?:(?:Mc|Mac|O['’])\p{Lu}\p{Ll}+|(?:Smith|Jones|Brown|Lee|Kim|Chen|Wang|Singh|Khan|Silva|Lopez|Garcia)|\p{Lu}\p{Ll}*(?:son|sen|mann|man|berg|burg|stein|feld|bach|meier|meyer|mayer|maier|bauer|huber|schmidt|schulz|ler|ner|dt|tz|sch|ski|ska|sky|wicz|czyk|ova|ov|eva|ev|in|enko|chuk|vić|ić|escu|ez|es|az|ini|etti|elli|ossi|ucci|ello|ano|ado|eira|oglu|oğlu|opoulos|idis|akis|shvili|yan|ian|eau|ault|ier|ard|et|aka|oto|ura|shi|awa|ada|ama|uchi|wara|ton|ley|ford|wood|field|worth))$"
CAP = r"(?:Mc|Mac|O['’])?\p{Lu}\p{Ll}+(?:[-'’]\p{Lu}\p{Ll}+)?"
NAME = rf"(?=\p{{Lu}})(?<![\p{{L}}])(?:(?:{TITLES})\.?(?:\x20{CAP}){{1,3}}|(?:{FIRST_NAMES})(?:\x20{CAP}){{1,2}}|(?<=(?<![\p{{L}}])(?i:{BEFORE})[:,]?[\x20\n]){CAP}(?:\x20{CAP}){{1,2}})(?![\p{{L}}])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "name": NAME, "ssn": SSN, "iban": IBAN}
BASE = ("email", "ip", "card", "phone")
LABELERS = ("form", "gazetteer", "context", "border")
#: Strict forms; what fails one is voted against.
FORMS = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}$", "ip": r"^(?!0)(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$", "card": r"^[3-6][0-9]{3}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$", "phone": r"^\+[1-9][0-9]{0,2}[\x20.(-]",
    "name": r"^\P{N}+$", "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", "iban": r"^[A-Z]{2}(?!00|01|99)[0-9]{2}(?:\x20?[A-Z0-9]){11,30}$",
}
#: What a gazetteer knows of a kind, and what it knows to be none; anything else gets no vote from it.
KNOWN = {
    "email": r"(?i)[@.](?:example|gmail|yahoo|hotmail|outlook|icloud|gmx|web|orange|mail)\.(?:com|org|net|de|fr|es)$", "ip": r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.", "card": r"^(?:4|5[1-5]|3[47]|6011|65)", "phone": r"^\+(?:1|7|20|27|3[0-46-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "name": rf"^(?:(?:{TITLES})\.?\x20)?(?:{FIRST_NAMES})(?:\x20|$)|{FAMILY}", "ssn": r"(?!)", "iban": r"^(?:AT|BE|CH|DE|ES|FR|GB|IE|IT|LU|NL|PL|PT)",
}
UNKNOWN = {"name": rf"(?i)(?<![\p{{L}}])(?:{NO_NAME})(?![\p{{L}}])", "ssn": r"^(?:078-05-1120|219-09-9999|123-45-6789|987-65-4320)$"}
CUES = r"e-?mail|contact|phone|tel|mobile|call|fax|card|visa|mastercard|address|addr|\bip\b|host|\bname|\bmr|\bdr|ssn|social security|iban|account|konto|kontakt|correo|courriel|signed|regards|sincerely|dear|author|attn|nombre|\bnom\b"
DOUBTS = r"version|license|licence|isbn|issn|order|build|release|sha|serial|\bv\.?$|#$"
CONTEXT, CHUNK = 48, 1024
THRESHOLD, ROUNDS, STEPS = 0.5, 60, 400
#: What the labelers are taken for before any candidate is seen: votes (against, for, none) given no span and given a span. For each
#: kind that counts as much as FIRM times its candidates, lest agreement of two weak labelers outweigh a strong one.
START = {"form": ([0.5, 0.25, 0.25], [0.05, 0.7, 0.25]), "gazetteer": ([0.5, 0.08, 0.42], [0.02, 0.5, 0.48]), "context": ([0.3, 0.2, 0.5], [0.05, 0.45, 0.5]), "border": ([0.2, 0.2, 0.6], [0.05, 0.35, 0.6])}
FIRM = 1.0
#: How likely a further candidate is a span before any vote: without evidence it is none.
PRIOR = 0.4



def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of ASCII digits is right."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: _doubled(c.cast("int"), i))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _doubled(v: Column, i: Column) -> Column:
    return F.when(i % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)


def remainder97(s: Column) -> Column:
    """An account number's remainder by 97, letters being 10 to 35 and the first four characters read last; 1 if it is right."""
    plain = F.regexp_replace(s, r"\x20", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    codes = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0), lambda a, c: F.when(c < 65, a * 10 + c - 48).otherwise(a * 100 + c - 55) % 97)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(name: str):
    """The contract's check of a base kind."""
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return {
        "ip": lambda s: s["match"].rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": lambda s: F.when(F.length(_digits(s["match"])).between(12, 19), luhn(_digits(s["match"]))).otherwise(False),
        "phone": lambda s: F.length(_digits(s["match"])).between(9, 15),
    }.get(name, lambda s: F.lit(True))


def _voted(name: str, kind: int, chunks: Column):
    """A candidate with its votes: 1 for, 0 against, 2 none. The text comes in chunks, so that looking around a span
    doesn't walk the text from its beginning."""

    def piece(start: Column, length: Column) -> Column:
        k = F.floor(start / CHUNK).cast("int")
        near = F.concat(F.coalesce(F.get(chunks, k), F.lit("")), F.coalesce(F.get(chunks, k + 1), F.lit("")))
        return F.substring(near, (start - k * CHUNK + 1).cast("int"), length.cast("int"))

    def of(s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT, F.lit(0))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), piece(first, s["start"] - first).alias("before"), piece(s["end"], F.lit(1)).alias("after"))

    def vote(s: Column) -> Column:
        cue, letter = F.lower(s["before"]), r"[\p{L}\p{N}_]"
        form = s["match"].rlike(FORMS[name]) & (remainder97(s["match"]) == 1) if name == "iban" else s["match"].rlike(FORMS[name])
        known = F.when(s["match"].rlike(KNOWN[name]), 1).otherwise(2)
        known = F.when(s["match"].rlike(UNKNOWN[name]), 0).otherwise(known) if name in UNKNOWN else known
        votes = [F.when(~form, 0).otherwise(2 if name == "name" else 1), known, F.when(cue.rlike(DOUBTS), 0).when(cue.rlike(CUES), 1).otherwise(2), F.when(s["before"].rlike(letter + "$") | s["after"].rlike(letter), 0).otherwise(2)]
        return F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lit(name).alias("name"), F.array(*[v.cast("int") for v in votes]).alias("votes"))

    return of, vote


CANDIDATE = "array<struct<start:bigint,kind:int,end:bigint,name:string,votes:array<int>>>"


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `candidates`: spans with their votes, in order."""
    return spans.unpacked(_candidates(spans.packed(df, text)), df.columns, ["candidates"])


def _candidates(df: DataFrame) -> DataFrame:
    """(row, text, candidates) of a packed frame."""
    df = spans.matches(df, "text", {f"_{n}": (p, 0) for n, p in KINDS.items()})
    df = df.withColumns({f"_{n}": F.filter(f"_{n}", _valid(n)) for n in BASE})
    some = F.lit(False)
    for n in KINDS:
        some = some | (F.size(f"_{n}") > 0)
    df = df.withColumn("_chunks", F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    parts = []
    for k, n in enumerate(KINDS):
        of, vote = _voted(n, k, F.col("_chunks"))
        parts.append(F.when(F.size(f"_{n}") > 0, F.transform(F.transform(f"_{n}", of), vote)).otherwise(F.array().cast(CANDIDATE)).cast(CANDIDATE))
    return df.withColumn("candidates", F.array_sort(F.concat(*parts))).select("row", "text", "candidates")


@dataclass
class Model:
    """What the label model and the span classifier have learned."""

    #: For each kind and labeler, the chance of each vote (against, for, none) given no span and given a span.
    reliability: list[tuple[list[float], list[float]]]
    bias: float
    kind_weights: list[float]
    vote_weights: list[list[float]]


def fit(patterns: list[tuple[int, tuple[int, ...], int]]) -> Model:
    """Learns from (kind, votes, count) rows: expectation-maximisation for each kind, then logistic regression on the posteriors."""
    n = len(LABELERS)
    firm = [FIRM * sum(c for of, _, c in patterns if of == k) + 1 for k in range(len(KINDS))]
    tables = {k: [START[name] for name in LABELERS] for k in range(len(KINDS))}
    posterior = [0.5] * len(patterns)
    for _ in range(ROUNDS if patterns else 0):
        for r, (k, votes, _) in enumerate(patterns):
            yes, no = math.log(PRIOR), math.log(1 - PRIOR)
            for (against, favour), v in zip(tables[k], votes, strict=True):
                yes += math.log(favour[v])
                no += math.log(against[v])
            posterior[r] = 1 / (1 + math.exp(min(700.0, no - yes)))
        for k in tables:
            sums = [tuple([firm[k] * x for x in side] for side in START[name]) for name in LABELERS]
            for (of, votes, c), p in zip(patterns, posterior, strict=True):
                if of == k:
                    for (against, favour), v in zip(sums, votes, strict=True):
                        against[v] += c * (1 - p)
                        favour[v] += c * p
            tables[k] = [([x / sum(a) for x in a], [x / sum(f) for x in f]) for a, f in sums]
    bias, kinds, weights = 0.0, [0.0] * len(KINDS), [[0.0] * 3 for _ in range(n)]
    total = sum(c for _, _, c in patterns) or 1
    for _ in range(STEPS if patterns else 0):
        g0, gk, gv = 0.0, [1e-3 * w for w in kinds], [[1e-3 * x for x in w] for w in weights]
        for (k, votes, c), p in zip(patterns, posterior, strict=True):
            z = bias + kinds[k] + sum(w[v] for w, v in zip(weights, votes, strict=True))
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * c / total
            g0 += d
            gk[k] += d
            for w, v in zip(gv, votes, strict=True):
                w[v] += d
        bias -= g0
        kinds = [w - g for w, g in zip(kinds, gk, strict=True)]
        weights = [[x - g for x, g in zip(w, gs, strict=True)] for w, gs in zip(weights, gv, strict=True)]
    seen = sorted({k for k, _, _ in patterns})
    return Model([t for k in seen for t in tables[k]], bias, kinds, weights)


def vote_patterns(found: DataFrame) -> list[tuple[int, tuple[int, ...], int]]:
    """Counts of candidates by kind and votes: len(KINDS) * 3 ** len(LABELERS) rows at most. The candidates are stored first: the
    optimizer would push the choice of their fields into all that makes them, and not come to an end."""
    return _patterns(stored(found.select("candidates"), "pii-votes"))


def _patterns(held: DataFrame) -> list[tuple[int, tuple[int, ...], int]]:
    rows = held.select(F.explode("candidates").alias("c")).groupBy(F.col("c.kind").alias("kind"), F.col("c.votes").alias("votes")).agg(F.count("*").alias("n")).collect()
    return sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in rows)


def classified(found: DataFrame, model: Model) -> DataFrame:
    """`candidates` become `base` and `found`."""
    kind_weights, vote_weights = F.array(*map(F.lit, model.kind_weights)), [F.array(*map(F.lit, w)) for w in model.vote_weights]

    def likely(s: Column) -> Column:
        z = F.lit(model.bias) + F.get(kind_weights, s["kind"])
        for i, w in enumerate(vote_weights):
            z = z + F.get(w, s["votes"][i])
        return 1 / (1 + F.exp(-z)) >= THRESHOLD

    plain = lambda s: F.struct(s["start"], s["kind"], s["end"], s["name"])
    base = F.filter("candidates", lambda s: s["kind"] < len(BASE))
    kept = F.filter("candidates", lambda s: (s["kind"] < len(BASE)) | likely(s))
    return found.withColumns({"base": F.transform(base, plain).cast(spans.SPAN), "found": F.transform(kept, plain).cast(spans.SPAN)}).drop("candidates")


def scan(df: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """Adds `base` and `found` (arrays of spans: start, kind, end, name); `found` holds the base ones too. Without a
    model, one is fitted on all rows first."""
    found = _candidates(spans.packed(df, text))
    return spans.unpacked(classified(found, model or fit(vote_patterns(found))), df.columns, ["base", "found"])


def redact(df: DataFrame, text: str = "text", mark: str = "[PII]", model: Model | None = None) -> DataFrame:
    """The same columns and rows, with each span replaced by a mark."""
    found = _candidates(spans.packed(df, text))
    clean = F.when(F.col(f"row.`{text}`").isNotNull(), spans.redacted(F.col("text"), F.col("found"), mark))
    return spans.unpacked(classified(found, model or fit(vote_patterns(found))), df.columns, [], {text: clean})


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digests for each row. The candidates are stored once, without texts, for fitting and for the result."""
    found = stored(candidates(df.select(key, text), text).drop(text), "pii")
    found = classified(found, fit(_patterns(found)))
    count = lambda name: F.size(F.filter("base", lambda s: s["name"] == name)).cast("bigint").alias(f"n_{name}")
    return found.select(key, *[count(n) for n in BASE], F.sha2(spans.shown(F.col("base")), 256).alias("base_sha256"), spans.shown(F.col("found")).alias("spans"))
