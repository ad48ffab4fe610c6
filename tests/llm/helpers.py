"""Fixtures of the corpus operators: a table of awkward documents, and plain versions to compare with."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, _rest string, _size string, _row string, "
          "_id string, token long, node long, score string, n_lines string, copy string, `a.b` string, _host string")
EXTRA = ("r", "s", "w", "i", 1, 2, "sc", "nl", "c", "ab", "h")


def prose(seed: int, words: int, vocabulary: int = 4000) -> str:
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(words))


def lined(text: str, width: int = 12) -> str:
    words = text.split()
    return "\n".join(" ".join(words[k:k + width]) for k in range(0, len(words), width))


def awkward() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, copies, near copies, ties and repeated rows."""
    base = lined(prose(1, 120))
    near = base.replace(base.split()[60], "changed", 1)
    long = lined(prose(2, 150_000, 50_000))
    texts = [
        (0, base), (1, base), (2, near), (3, lined(prose(3, 90))), (3, lined(prose(3, 90))), (4, None), (5, ""), (6, " \n\t "),
        (7, "one two"), (8, "one two"), (9, long), (10, lined(prose(4, 60)) + "\n" + base), (None, base), (None, None),
        (11, "same same same same same same same same same same same same same same same same same same same same same same same"),
        (12, "Idiot! You are a worthless idiot."), (13, "x" * 300_000), (14, "UPPER lower Upper LOWER mixed Case"), (15, "upper lower upper lower mixed case"),
    ]
    rows = [(i, t, None if i == 4 else "en", None if i in (5, None) else f"src{(i or 0) % 3}", None if i == 7 else len(t or "")) + EXTRA for i, t in texts]
    rows.append((16, prose(5, 40), None, None, None) + (None,) * len(EXTRA))
    return rows


def groups(nodes, linked) -> dict:
    """Smallest node reachable over the pairs for which linked(a, b) holds."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
