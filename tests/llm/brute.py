"""Plain versions of operators, one text at a time."""

import hashlib
import re

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_base(text):
    """(n_email, n_ip, n_card, n_phone, base list) of a text."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    names = ("email", "ip", "card", "phone")
    listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found))
    return [sum(k == i for _, k, _ in found) for i in range(4)], hashlib.sha256(listed.encode()).hexdigest(), listed


def pii_spans(text):
    """Spans (start, end) of all base kinds, as they are masked one kind after another."""
    out = []
    for listed in filter(None, pii_base(text)[2].split(",")):
        kind, a, b = listed.split(":")
        out.append((int(a), int(b)))
    return out


def pii_tokens(text):
    """(a, b, token, start, end, is_seed) of every token that isn't = or :, for texts whose seeds don't overlap."""
    at, pieces = 0, []
    for a, b in sorted(pii_spans(text)):
        pieces += [(text[at:a], at, False), (text[a:b], a, True)]
        at = b
    pieces.append((text[at:], at, False))
    tokens = []
    for piece, start, seed in pieces:
        if seed:
            tokens.append((piece, start, True))
        else:
            tokens += [(m[0], start + m.start(), False) for m in re.finditer(r"[=:]+|[^\x20\x09-\x0D=:\"'()\[\]<>{}|`]+", piece)]
    out = []
    for i, (x, start, seed) in enumerate(tokens):
        if x[0] not in "=:" or seed:
            out.append((tokens[i - 2] if i > 1 else None, tokens[i - 1] if i else None, x, start, start + len(x), seed))
    return out


def pii_found(texts, confident, support, share, turns, unknown):
    """Found identifiers by text: {number: {(start, end)}}, by the plain method on whole lists."""

    def joint(t):
        return t is not None and not t[2] and t[0][0] in "=:"

    def word(t):
        return "\x01" if t[2] else re.sub("[1-9]", "0", t[0].lower())

    def patterns(a, b):
        if b is None:
            return []
        if joint(b):
            return [word(a) + " ="] if a else []
        return [word(b), word(a) + " " + word(b)] if a and not joint(a) else [word(b)]

    def shed(x):
        lead = next((i for i, c in enumerate(x) if c.isalnum()), len(x))
        end = len(x) - next((i for i, c in enumerate(reversed(x)) if c.isalnum()), len(x))
        return lead, max(lead, end)

    secret = re.compile(r"(?=.*[A-Fa-f])(?=.*[0-9])[0-9A-Fa-f]{32,}|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{20,}")
    rows = []
    for n, text in enumerate(texts):
        for a, b, x, start, end, seed in pii_tokens(text or ""):
            low, high = (0, len(x)) if seed else shed(x)
            is_seed = seed or joint(b) and bool(secret.fullmatch(re.sub(r"[^A-Za-z0-9]+$", "", x)))
            for p in patterns(a, b):
                rows.append((n, p, ("\x01" + x) if seed else x[low:high].lower(), is_seed, seed, start + low, start + high))
    by = {}
    for _, p, inst, is_seed, _, _, _ in rows:
        one = by.setdefault(p, [0, 0, {}])
        one[0] += 1
        one[1] += is_seed
        one[2][inst] = one[2].get(inst, False) or is_seed
    good = {p: {i: s for i, s in insts.items() if i} for p, (n, seeds, insts) in by.items() if sum(insts.values()) >= support and seeds >= share * n}
    said = {}
    for text in texts:
        for m in re.finditer(r"[^\x20\x09-\x0D=:\"'()\[\]<>{}|`\x01\x02]+", text or ""):
            low, high = shed(m[0])
            said[m[0][low:high].lower()] = said.get(m[0][low:high].lower(), 0) + 1
    behind = {}
    for _, p, inst, _, base, _, _ in rows:
        if not base:
            behind[p, inst] = behind.get((p, inst), 0) + 1

    def ordinary(p, i):
        return not good[p][i] and said.get(i, 0) > 2 * behind.get((p, i), 0)

    scores = {}
    for _ in range(turns):
        trust = {}
        for p, insts in good.items():
            pro = {i: 1.0 if s else (scores.get(i, 0) if scores.get(i, 0) >= confident else 0.0) for i, s in insts.items()}
            con = sum(0 if x else 1 if ordinary(p, i) else unknown[0] if re.search("[0-9]", i) else unknown[1] for i, x in pro.items())
            trust[p] = sum(pro.values()) / (sum(pro.values()) + con + 1)
        doubt = {}
        for p, insts in good.items():
            two = " " in p and not p.endswith(" =")
            for i in insts:
                if not ordinary(p, i):
                    doubt[i, two] = doubt.get((i, two), 1.0) * (1 - trust[p])
        scores = {}
        for (i, _), v in doubt.items():
            scores[i] = max(scores.get(i, 0.0), 1 - v)
    out = {}
    for n, p, inst, seed, base, a, b in rows:
        if not base and inst and (seed or p in good and scores.get(inst, 0) >= confident):
            out.setdefault(n, set()).add((a, b))
    return out
