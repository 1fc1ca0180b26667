"""Small documents that hold every awkward case, and plain versions of what operators compute."""

import random
import re

SCHEMA = "doc_id bigint, text string, source string, label string, kept int"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, fold=True):
    text = (text or "").translate(LOW) if fold else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def documents(seed=1, size=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéñß", k=rng.randrange(2, 9))) for _ in range(900)]

    def line(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage = line(25)
    common = line(9)
    rows = []
    for i in range(size):
        lines = [line(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6))]
        if i % 7 == 0:
            lines.insert(1, common)
        if i % 11 == 0:
            lines.append(line(3) + " " + passage + " " + line(2))
        rows.append((i, "\n".join(lines), f"src{i % 3}"))
    base = rows[5][1].split(" ")
    for k in range(20):  # near copies of one document, some close to others only
        copy = list(base)
        for _ in range(1 + k % 6):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((100 + k, " ".join(copy), "src0"))
    rows += [(200 + k, rows[9][1], "src0") for k in range(15)]  # exact copies
    rows += [(300, None, "a"), (301, "", None), (302, " \n\t\n ", "a"), (303, "One", "a"), (304, "ONE", "a"), (305, "one two", "a")]
    rows += [(306, line(4000), "long"), (307, "x" * 3000, "long"), (308, "x" * 2500, "long"), (309, "same same same " * 300, "a")]
    rows += [(310, rows[9][1].upper(), "a"), (311, "a\r\nb\n\na\r\nb\n", "a"), (312, "🙂 東京 " * 30, "a"), (9, rows[9][1], "src0")]
    rng.shuffle(rows)
    return [(*r, "extra", 7) for r in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


class Union:
    """Components under their smallest member."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, width):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def near_components(rows, width, similar=80):
    """``{doc_id: (set size, component)}``."""
    sets = {r[0]: shingles(r[1], width) for r in rows}
    union = Union()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= similar * len(x | y):
                union.join(a, b)
    return {d: (len(s), union.find(d)) for d, s in sets.items()}


def line_removals(rows, similar=80):
    """``{(doc_id, line)}`` that an earlier line is similar to."""
    lines = []
    for doc, text, *_ in sorted({r[:2] for r in rows}, key=lambda r: r[0]):
        lines += [(doc, n, frozenset(words(part))) for n, part in enumerate((text or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    gone = set()
    for i, (doc, n, x) in enumerate(lines):
        if any(100 * len(x & y) >= similar * len(x | y) for _, _, y in lines[:i]):
            gone.add((doc, n))
    return gone


def repeated_bytes(rows, length=50):
    """``{doc_id: mask}`` of bytes covered by strings that start in a document of a smaller id."""
    first = {}
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for doc, raw in texts:
        for i in range(len(raw) - length + 1):
            key = raw[i : i + length]
            first[key] = min(first.get(key, doc), doc)
    out = {}
    for doc, raw in texts:
        mask = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < doc:
                mask[i : i + length] = [True] * length
        out[doc] = mask
    return out
