"""The extraction of personal data once more, in plain Python, text by text and pattern by pattern."""

import re
from collections import defaultdict

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
ORDER = [*KINDS, "secret"]
CANDIDATE = re.compile("|".join(f"(?:{p})" for p in (KINDS["email"], r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9](?:[\x20-]?[0-9]){12,}+(?![0-9A-Za-z:/@]|\.[0-9])", KINDS["phone"], r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")))


def luhn(digits):
    return sum((2 * x - 9 if x > 4 else 2 * x) if i % 2 else x for i, x in enumerate(map(int, digits[::-1]))) % 10 == 0


def digits_of(token):
    return re.sub("[^0-9]", "", token)


def valid(kind, match):
    n = len(digits_of(match))
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    return kind == "email" or kind == "card" and 13 <= n <= 19 and luhn(digits_of(match)) or kind == "phone" and 9 <= n <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text) if valid(k, m[0])]


def as_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def kind_of(token):
    for k, p in KINDS.items():
        if re.fullmatch(p, token) and valid(k, token):
            return k
    mixed = re.fullmatch("[0-9A-Fa-f]{32,}", token) and re.search("[0-9]", token) and re.search("[A-Fa-f]", token)
    return "secret" if mixed else "none" if any(re.fullmatch(p, token) and (k != "card" or 13 <= len(digits_of(token)) <= 19) and (k != "ip" or re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", token)) for k, p in KINDS.items()) else None


def lower(share, n):
    z = 1.96
    return (share + z * z / (2 * n) - z * (max(0.0, share * (1 - share)) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)


def form(token):
    if len(token) >= 16 and re.fullmatch("[0-9A-Za-z]+", token) and re.search("[0-9]", token) and re.search("[A-Za-z]", token):
        return f"mixed {len(token)}"
    runs = ""
    for c in token:
        c = "0" if c in "0123456789" else "A" if c.isalpha() and c.isupper() else "a" if c.isalpha() else c
        runs += "" if c in "Aa" and runs[-1:] == c else c
    return runs


def patterns_of(token, left, right):
    plain = lambda s: re.sub("[0-9]", "0", re.sub("[\x20\x09-\x0d]+", " ", s.lower())).strip(" ")
    before, after = plain(left[-80:]).split(" "), plain(right[:80]).split(" ")
    words = [("two before", " ".join(before[-2:])), ("before", before[-1]), ("after", after[0])]
    out = [(s, c) for s, c in words if any(x.isalpha() for x in c) and (s != "two before" or " " in c)]
    shape = form(token)
    out += [("shape", shape), ("form", re.sub("0+", "0", shape))]
    n = len(digits_of(token))
    return out + ([("checked", f"{n} digits")] if 12 <= n <= 19 and luhn(digits_of(token)) else [])


def alike(kind, token):
    n = len(digits_of(token))
    if kind == "email":
        return "@" in token and len(token) >= 5
    if kind == "secret":
        return len(token) >= 16 and n > 0 and re.search("[A-Za-z]", token) is not None and "@" not in token
    return n >= 4 and ("." in token or ":" in token) if kind == "ip" else n >= 12 if kind == "card" else n >= 7


def private_spans(texts, rounds=3, confidence=0.75, support=5):
    """All spans of each text."""
    places = []  # (text, start, token, patterns)
    for i, text in enumerate(texts):
        found = list(CANDIDATE.finditer(text))
        for k, m in enumerate(found):
            left = text[found[k - 1].end() if k else 0 : m.start()]
            right = text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)]
            bare = re.sub(r"^[\x22'(<\[{,;:]+", "", m[0])
            start, token = m.end() - len(bare), re.sub(r"(?<=[^\W_])[\W_]+$", "", bare)
            if token:
                places.append((i, start, token, patterns_of(token, left, right)))
    edges = {(t, p) for _, _, t, ps in places for p in ps}
    tokens = defaultdict(set)
    for t, p in edges:
        tokens[p].add(t)
    tokens = {p: ts for p, ts in tokens.items() if len(ts) >= support}
    view = lambda p: {"two before": "left", "before": "left", "after": "right"}.get(p[0], "own")
    scores, trust = {}, {}  # scores: (token, kind, view of the pattern that says so)
    for _ in range(rounds):
        trust = {}
        for p, ts in tokens.items():
            known = sum(kind_of(t) is not None for t in ts)
            for kind in ORDER:
                seeds = [1.0 for t in ts if kind_of(t) == kind]
                told = [max((s for v in ("left", "right", "own") if v != view(p) and (s := scores.get((t, kind, v))) is not None), default=0.0) for t in ts if kind_of(t) is None]
                if sum(x >= confidence for x in seeds + told) >= support:
                    n = known + sum(told) + 0.25 * (len(ts) - known - sum(told))
                    trust[p, kind] = lower(min(sum(seeds) + sum(told), n) / n, n)
        scores = {}
        for p, ts in tokens.items():
            for t in ts:
                for kind in ORDER:
                    if kind_of(t) is None and (p, kind) in trust and alike(kind, t):
                        at = (t, kind, view(p))
                        scores[at] = max(scores.get(at, 0.0), trust[p, kind])
    out = [base_spans(t) for t in texts]
    for i, start, token, ps in places:
        kinds = [(trust[p, k], k) for p in ps for k in ORDER if trust.get((p, k), 0) >= confidence and alike(k, token)]
        stop = start + len(token)
        if kinds and kind_of(token) in (None, "secret") and all(b <= start or a >= stop for _, a, b in base_spans(texts[i])):
            out[i].append((max(kinds)[1], start, stop))
    return [sorted(x, key=lambda s: (ORDER.index(s[0]), s[1])) for x in out]
