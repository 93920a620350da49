"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower(text):
    return (text or "").translate(str.maketrans(UPPER, UPPER.lower()))


def words(text):
    return re.findall(f"[^{SPACE}]+", text or "")


def shingle_list(ws):
    return [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)] if len(ws) >= 5 else [tuple(ws)] if ws else []


def shingles(text):
    return frozenset(shingle_list(words(lower(text))))


def alike(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def groups(keys, linked):
    """Smallest key in reach for each key; ``linked`` gives pairs."""
    up = {k: k for k in keys}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in linked:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {k: top(k) for k in keys}


def jaccard(rows):
    """{doc_id: (size, component)} for rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and alike(sets[a], sets[b])]
    comp = groups(ids, pairs)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def leaks(rows, items):
    """{(doc_id, item_id)} whose best aligned window has weighted similarity of 0.8 or more; windows at every start."""
    out = set()
    for i, t in rows:
        ws = words(lower(t))
        for j, item in items:
            need = words(lower(item))
            m = len(need)
            if not m or not ws:
                continue
            want = Counter(shingle_list(need))
            if len(need) >= 5 and want.keys().isdisjoint(shingle_list(ws)):
                continue
            for start in range(max(1, len(ws) - m + 1)):
                have = Counter(shingle_list(ws[start : start + m]))
                both = sum((want & have).values())
                if 100 * both >= 80 * sum((want | have).values()):
                    out.add((i, j))
                    break
    return out


BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
)


def base_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, rx, g, least) in enumerate(BASE) for m in rx.finditer(text or "") if len(m[g]) >= least]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def repeat_words(text):
    ws = words(text)
    n = len(ws) - 7
    seen = Counter(tuple(ws[k : k + 8]) for k in range(n))
    return len({j for k in range(n) if seen[tuple(ws[k : k + 8])] > 1 for j in range(k, k + 8)})


def dedup_lines(rows):
    """[(doc_id, lines, dropped, text)] in the order of ``rows``; ids are not null."""
    held = defaultdict(set)
    key = lambda line: lower(line.strip(SPACE))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 5 and max(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def holders(rows, length):
    """Documents with ``length`` words in a row that another document has, too."""
    seen = defaultdict(set)
    for i, t in rows:
        ws = words(lower(t))
        for k in range(len(ws) - length + 1):
            seen[tuple(ws[k : k + length])].add(i)
    return {i for ids in seen.values() if len(ids) > 1 for i in ids}


def repeated_passages(rows, places, width=32, least=36):
    """{(doc_id, first word, words, counterpart, its word)}; ``places(text)`` gives the words at which paragraphs begin."""
    sets, opening = {}, {}
    for i, t in rows:
        ws = words(lower(t))
        for k in places(t):
            sets[i, k], opening[i, k] = shingles(" ".join(ws[k : k + width])), tuple(ws[k : k + 5])
    held = defaultdict(list)
    for k, x in opening.items():
        held[x].append(k)
    many = {k for ks in held.values() if len({sets[k] for k in ks}) > 1 for k in ks}
    ids = sorted(k for ks in held.values() if len(ks) > 1 for k in ks)
    by = defaultdict(set)
    for k in ids:
        for x in sets[k]:
            by[x].add(k)
    near = {(a, b) for ks in by.values() for a in ks for b in ks if a < b}
    comp = groups(ids, [(a, b) for a, b in near if sets[a] == sets[b] or {a, b} <= many and alike(sets[a], sets[b])])
    members = defaultdict(list)
    for k, c in comp.items():
        members[c].append(k)
    good = {c for c, ks in members.items() if len({i for i, _ in ks}) > 1}
    runs = {}
    for (i, k), (j, m) in sorted(comp.items()):
        if (j, m) in good and (i != j or k == m or k >= m + width):
            mine = runs.setdefault((i, j, (i, k) != (j, m)), [])
            if mine and k - mine[-1][1] <= width:
                mine[-1][1] = k
            else:
                mine.append([k, k, m])
    return {(i, a, b - a + width, j, m) for (i, j, _), mine in runs.items() for a, b, m in mine if b - a + width >= least}


def all_passages(rows, places, width=32, least=36):
    """As ``repeated_passages``, with the links of all pairs of paragraphs, however they begin."""
    sets = {(i, k): shingles(" ".join(words(lower(t))[k : k + width])) for i, t in rows for k in places(t)}
    by = defaultdict(set)
    for k, xs in sets.items():
        for x in xs:
            by[x].add(k)
    near = {(a, b) for ks in by.values() for a in ks for b in ks if a < b}
    comp = groups(sorted(sets), [(a, b) for a, b in near if alike(sets[a], sets[b])])
    held = defaultdict(set)
    for (i, _), c in comp.items():
        held[c].add(i)
    runs = defaultdict(list)
    for (i, k), (j, m) in sorted(comp.items()):
        if len(held[j, m]) > 1 and (i != j or k == m or k >= m + width):
            mine = runs[i, j, (i, k) != (j, m)]
            if mine and k - mine[-1][1] <= width:
                mine[-1][1] = k
            else:
                mine.append([k, k, m])
    return {(i, a, b - a + width, j, m) for (i, j, _), mine in runs.items() for a, b, m in mine if b - a + width >= least}


FRAME = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "subscribe to our newsletter", "click here", "share this", "skip to content", "powered by",
    "alle rechte vorbehalten", "datenschutzerklärung", "impressum", "nutzungsbedingungen", "newsletter abonnieren", "hier klicken", "zum inhalt springen",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "cliquez ici", "aller au contenu",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso", "haga clic aquí", "ir al contenido",
)


def line_fails(line):
    """Whether a line with words fails a rule of its own."""
    ws = words(line)
    marks = len(re.findall(r"[#*$%&|<>]", line))
    if 4 * marks > len(ws) and 20 * marks > sum(len(w.encode()) for w in ws):
        return True
    if len(ws) <= 15 and any(x in line.lower() for x in FRAME):
        return True
    capitals, letters = sum(c.isupper() for c in line), sum(c.isalpha() for c in line)
    if letters > 10 and 2 * capitals > letters and (2 * capitals > len(line) or line == line.upper()):
        return True
    if re.search(r"""[.!?:;…。！？]["'”’»)\]]*$""", line.rstrip(SPACE)):
        return False
    return len(ws) < 4 or 40 * sum(w[-1] in ".!?:;" for w in ws) < len(ws)


def failed_lines(text):
    """(lines that fail or repeat, their characters in words, all characters in words)."""
    seen, failed, lost = set(), 0, 0
    for line in (text or "").split("\n"):
        ws = words(line)
        if ws:
            if line in seen or line_fails(line):
                failed, lost = failed + 1, lost + sum(map(len, ws))
            seen.add(line)
    return failed, lost, sum(map(len, words(text)))
