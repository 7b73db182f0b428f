import random

from tests.llm.test_duplicates import shingles
from weftline.llm import neardup, suffixes


def roots(rows, percent):
    """Smallest doc_id reachable from each, where documents link if any of their texts are similar."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def texts(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def near(text, k):
    return " ".join([*text.split()[:-1], f"n{k}"])


def test_one_id_with_two_texts(make_docs):
    rng = random.Random(3)
    a, b = texts(rng, 60), texts(rng, 60)
    rows = [(1, a), (5, a), (5, b), (7, near(b, 7))]
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(make_docs(*rows)).collect()} == {(1, 1), (5, 1), (7, 1)}
    assert [r.doc_id for r in neardup.deduplicate(make_docs(*rows)).collect()] == [1]


def test_near_links_of_every_text(make_docs):
    rng = random.Random(4)
    base = [texts(rng, 60) for _ in range(12)]
    rows = [(100, t) for t in base[:6]] + [(100, base[0])] + [(200 + k, near(t, k)) for k, t in enumerate(base)] + [(50, base[6]), (50, base[7]), (60, near(base[7], 60)), (60, base[8])]
    found = {}
    for r in neardup.near_duplicates(make_docs(*rows)).collect():
        found.setdefault(r.doc_id, set()).add(r.component_id)
    assert found == {i: {root} for i, root in roots(rows, 80).items()}


def test_a_crowd_of_equal_rows_repeats_itself(make_docs):
    """3000 rows of one id and text, long enough to repeat: all of each goes; a text of its own stays, one that shares a part loses it."""
    crowd, other = " ".join(f"word{k * 7919 % 1000}" for k in range(150)), " ".join(f"lone{k * 31 % 997}" for k in range(150))
    mixed = other[:300] + crowd[100:600]
    rows = suffixes.repeat_counts(make_docs(*[(7, crowd)] * 3000, (8, " ".join(f"own{k}" for k in range(200))), (9, mixed))).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in rows} == {(7, len(crowd), len(crowd), 1), (8, len(" ".join(f"own{k}" for k in range(200))), 0, 0), (9, 800, 500, 1)} and len(rows) == 3002
