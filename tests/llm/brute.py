"""Plain versions of the operators."""

from __future__ import annotations

import hashlib
import math
import re

import regex


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        if i % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def secrets(text: str | None) -> list[tuple]:
    t, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))"), t, re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


WORDS = re.compile(r"example|sample|placeholder|dummy|changeme|x{6}|abcdefgh|01234567", re.I)


def hot_runs(value: str, bound: float, window: int = 24) -> list[tuple[int, int]]:
    """Stretches of overlapping windows whose entropy reaches the bound, each window counted from scratch."""
    out: list[tuple[int, int]] = []
    for i in range(len(value) - window + 1):
        part = value[i : i + window]
        if sum(-n / window * math.log2(n / window) for n in map(part.count, set(part))) >= bound - 1e-9:
            if out and i < out[-1][1]:
                out[-1] = (out[-1][0], i + window)
            else:
                out.append((i, i + window))
    return out


def leftovers(value: str) -> list[tuple[int, str]]:
    """What a candidate's allowed parts leave of it."""
    if not WORDS.search(value):
        return [(0, value)]
    gone = bytearray(len(value))
    for m in re.finditer("[A-Za-z0-9]+", value):
        if WORDS.search(m[0]) and 6 * sum(len(w[0]) for w in WORDS.finditer(m[0])) >= len(m[0]):
            gone[m.start() : m.end()] = b"x" * len(m[0])
    out = []
    for m in re.finditer(b"\0+", bytes(gone)):
        whole = value[m.start() : m.end()]
        kept = whole.lstrip("+/_=-").rstrip("+/_-")
        if len(kept) >= 24:
            out.append((m.start() + len(whole) - len(whole.lstrip("+/_=-")), kept))
    return out


def all_secrets(text: str | None) -> list[tuple]:
    """Base spans and those of the entropy windows."""
    t, base = text or "", secrets(text)

    def suspect(start, value):
        calm = re.fullmatch(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", value) or not re.search("[0-9]", value) or not re.search("[A-Za-z]", value)
        return not calm and not any(a <= start and b >= start + len(value) for a, _, b, _ in base)

    out = list(base)
    for kind, name, letters, bound in ((3, "entropy_base64", "A-Za-z0-9+/_=-", 4.0), (4, "entropy_hex", "0-9A-Fa-f", 3.2)):
        for m in re.finditer(f"[{letters}]+", t):
            if len(m[0]) >= 24 and suspect(m.start(), m[0]):
                for at, value in leftovers(m[0]):
                    if suspect(m.start() + at, value):
                        out += [(m.start() + at + a, kind, m.start() + at + b, name) for a, b in hot_runs(value, bound)]
    return sorted(out)


def personal(text: str | None) -> list[tuple]:
    t, out = text or "", []
    out += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def remainder97(value: str) -> int:
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97


def all_personal(text: str | None, pii, model) -> list[tuple]:
    """Base spans, and further candidates that the model's classifier takes, voted on one by one."""
    t, base = text or "", personal(text)
    out = list(base)
    for kind, name in enumerate(pii.KINDS):
        if name in pii.BASE:
            continue
        for m in regex.finditer(pii.KINDS[name], t):
            v, before, after = m[0], t[max(0, m.start() - pii.CONTEXT) : m.start()], t[m.end() : m.end() + 1]
            form = bool(regex.search(pii.FORMS[name], v)) and (name != "iban" or remainder97(v) == 1)
            known = 1 if regex.search(pii.KNOWN[name], v) else 2
            if name in pii.UNKNOWN and regex.search(pii.UNKNOWN[name], v):
                known = 0
            cue = 0 if regex.search(pii.DOUBTS, before.lower()) else 1 if regex.search(pii.CUES, before.lower()) else 2
            border = 0 if regex.search(r"[\p{L}\p{N}_]$", before) or regex.match(r"[\p{L}\p{N}_]", after) else 2
            z = model.bias + model.kind_weights[kind] + sum(w[x] for w, x in zip(model.vote_weights, (0 if not form else 2 if name == "name" else 1, known, cue, border), strict=True))
            if 1 / (1 + math.exp(-z)) >= pii.THRESHOLD:
                out.append((m.start(), kind, m.end(), name))
    return sorted(out)


def sha(spans: list[tuple]) -> str:
    return hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in spans).encode()).hexdigest()


def shingles(text: str | None, size: int) -> frozenset:
    w = (text or "").encode().lower().split()
    n = min(size, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def groups(docs: list[tuple], size: int, num: int) -> dict[int, int]:
    """doc_id to the smallest id reachable, by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t, size)) for i, t in docs]
    label = {i: i for i, _ in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    having: dict = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            having.setdefault(x, []).append(k)
    for k, (i, s) in enumerate(sets):
        for j in {j for x in s for j in having[x] if j < k}:
            o, t = sets[j]
            if 100 * len(s & t) >= num * len(s | t):
                a, b = root(i), root(o)
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in sets}


def bench_words(text: str | None) -> list[str]:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def hits(text: str | None, items: list[tuple], window: int = 13) -> tuple[int, int, list[str]]:
    w, covered, found = bench_words(text), set(), set()
    for item, body in items:
        b = bench_words(body)
        m = min(window, len(b))
        for i in range(len(b) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == b[i : i + m]:
                    covered.update(range(j, j + m))
                    found.add(str(item))
    return len(w), len(covered), sorted(found)
