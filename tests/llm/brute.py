"""Plain Python versions of the operators, for small inputs."""
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and blank texts, ties, repeated rows, a very long text.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one two", "en", None, 7),
    (5, "one two", "en", "b", 7), (5, "one two", "en", "b", 7), (None, "no id here but some words", "de", "b", 25),
    (6, "tie " * 30000, "en", "c", 120000), (7, "a b c d e f g h i j k l m n", "en", "a", 27), (8, "É ß 語 \x00 x", "fr", "a", 9),
]


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    hit = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), failed


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(rows):
    """(doc_id, n_shingles, component_id, kept) for rows of (doc_id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    pairs = {(a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, d), d)
    return [(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)]


TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(docs, bench):
    import hashlib

    index = defaultdict(set)
    for item, text in bench:
        w = terms(text)
        for i in range(len(w) - 9) if len(w) >= 10 else ([0] if w else []):
            index[tuple(w[i : i + 10])].add(item)
    lengths = {len(k) for k in index}
    out = []
    for doc, text in docs:
        w, hit, items = terms(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if found := index.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        names = ",".join(sorted(map(str, items)))
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def counts(rows):
    return Counter(map(tuple, rows))


PHRASES = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "sign in to", "subscribe to", "terms of service", "terms of use",
    "tous droits réservés", "cliquez ici", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "alle rechte vorbehalten", "hier klicken", "datenschutzerklärung",
    "impressum und datenschutz", "nutzungsbedingungen", "todos los derechos reservados", "haga clic aquí", "política de privacidad", "aviso legal", "términos de uso",
)


def cleaned(text):
    """(kept, text without failing lines) by the quality rules."""
    n, *_, failed = base(text)
    lines, good = [x for x in (text or "").split("\n") if WORD.search(x)], []
    for line in lines:
        w = len(WORD.findall(line))
        count = lambda chars, line=line: sum(c in chars for c in line)
        bad = 10 * count("#*$%&|<>") > 3 * w or (w >= 4 and line.upper() == line and line.lower() != line) or (w >= 8 and not count(".!?:;"))
        bad = bad or (w >= 3 and 5 * count("|>•»") >= w) or (w <= 15 and any(p in line.lower() for p in PHRASES))
        if not bad:
            good.append(line)
    left = sum(len(WORD.findall(x)) for x in good)
    return not failed and left >= 0.5 * n, text if len(good) == len(lines) else "\n".join(good)
