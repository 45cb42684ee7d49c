"""Plain Python for what the operators compute, and a table of documents with every awkward case."""

import hashlib
import random
import re
from collections import defaultdict

FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, label string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(FOLD)) if w]


def soup(rnd, n):
    return " ".join(rnd.choice(["alpha", "Beta", "gamma,", "délta", "epsilon.", "zeta", "eta", "theta", "ÏOTA", "kappa", "mu", "nu"]) + str(rnd.randrange(40)) for _ in range(n))


def texts():
    """Copies, near copies, chains of near copies, empty, null, spaces, one word, four words, very long."""
    rnd = random.Random(4)
    base = soup(rnd, 120)
    w = base.split()
    chain = [list(w)]
    for i in range(1, 5):
        nxt = list(chain[-1])
        nxt[i * 20] = f"changed{i}"
        nxt[i * 20 + 7] = f"other{i}"
        chain.append(nxt)
    passage = soup(rnd, 60)
    out = [base, base, base.replace(" ", "  "), base.upper(), *(" ".join(c) for c in chain), "", None, " \n\t", "one", "ONE", "four short words here", "four short words here", passage, soup(rnd, 80) + "\n" + passage + "\n" + soup(rnd, 30), soup(rnd, 10) + "\n" + passage.replace("zeta", "zeta") + "\nend", soup(rnd, 6000)]
    out += [soup(rnd, rnd.randrange(3, 60)) for _ in range(20)]
    return out


def rows():
    """(doc_id, ...) with extra columns whose names the operators use; a repeated row, a null id and a repeated id at the end."""
    t = texts()
    found = [(i, x, "en", None if i % 7 == 3 else f"src{i % 3}", None, 1.5, "s", "l") for i, x in enumerate(t)]
    return [*found, found[5], (None, t[0], None, None, None, None, None, None), (6, "a different text under a used id with enough words", "en", "src1", 3, None, None, None)]


def exact(rows_):
    groups = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows_):
        text = text or ""
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0d]", "", text).encode()).hexdigest()].append((-len(text), doc_id is None, doc_id or 0, i))
    out = []
    for h, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        out += [(None if null else d, keep, len(members), h) for _, null, d, _ in members]
    return out, len(groups)


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def shingles(text, k=5):
    w = tokens(text)
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def near(a, b):
    both = len(a & b)
    return bool(both) and 100 * both >= 80 * len(a | b)
