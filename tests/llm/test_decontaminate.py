import itertools
import random
import time

import numpy as np
import pytest

from weftline.llm import decontaminate


def best_of_all(same, size):
    most = max((int(same[i:j].sum()) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if 4 * same[i:j].sum() >= 3 * (j - i)), default=0)
    return most if most >= decontaminate.needed(size) else 0


def test_a_short_run_hides_no_longer_stretch():
    for before, other, after in ((9, 3, 9), (12, 3, 9), (12, 4, 12)):
        same = np.repeat([True, False, True], [before, other, after])
        assert decontaminate.stretch(same, len(same)) == before + after
    rng = random.Random(1)
    for _ in range(500):
        same = np.array([rng.random() < 0.75 for _ in range(rng.randrange(36))], bool)
        size = rng.choice([max(5, len(same)), 60])
        assert decontaminate.stretch(same, size) == best_of_all(same, size)


def seeded(same):
    return any(all(same[s + p] for p in mask) for mask in decontaminate.MASKS for s in range(len(same) - mask[-1]))


def unseeded_overlap(need):
    """A pattern of the rule without any seed, or None: over all patterns, by the last words alone, the best sum of
    (equal - 3 x other) for each count of equal words."""
    span = max(m[-1] for m in decontaminate.MASKS)
    best = {((), 0): 0}
    for _ in range(120):
        after = {}
        for (last, equal), gain in best.items():
            for bit in (1, 0):
                word = (*last, bit)
                if any(len(word) > m[-1] and all(word[len(word) - 1 - m[-1] + p] for p in m) for m in decontaminate.MASKS):
                    continue
                key, value = (word[-span:], min(need, equal + bit)), gain + (1 if bit else -3)
                if value >= -3 * need and after.get(key, -999) < value:
                    after[key] = value
        best = after
        if any(equal == need and gain >= 0 for (_, equal), gain in best.items()):
            return best
    return None


def test_no_admitted_overlap_escapes_the_masks():
    assert unseeded_overlap(decontaminate.MATCHED) is None
    for n in range(decontaminate.LEAST, 18):
        for other in itertools.combinations(range(n), n // 4):
            assert seeded([i not in other for i in range(n)])


def test_substituted_phrase_is_found(make_docs, spark):
    item = [f"w{i}" for i in range(28)]
    text = [*item[:12], "a", "b", "c", "d", *item[16:]]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    row = decontaminate.find_leaks(make_docs((1, " ".join(["x", *text, "y"]))), bench).first()
    assert row.item_ids == [7] and row.best_match == 24


@pytest.mark.parametrize("equal", [0.75, 0.8, 0.9])
@pytest.mark.parametrize("size", [13, 17, 25, 40])
def test_planted_passages_are_all_found(equal, size):
    """Recall 1.0 at every length and share of equal words of the rule."""
    rng = random.Random(size)
    items = [[f"w{rng.randrange(400)}" for _ in range(size)] for _ in range(60)]
    index = decontaminate.Index([(k, " ".join(w)) for k, w in enumerate(items)])
    for k, item in enumerate(items):
        other = set(rng.sample(range(size), int(size * (1 - equal) + 1e-9)))
        text = [f"w{rng.randrange(400)}" for _ in range(60)]
        text[30:30] = [f"o{i}" if i in other else w for i, w in enumerate(item)]
        assert k in [i for i, _ in index.overlaps(" ".join(text))]


def cases():
    """Places of substituted words: overlaps that meet the rule, by length, and every fourth word at several lengths."""
    rng = random.Random(2)
    for n, m in ((5, 1), (8, 2), (12, 3), (16, 3), (17, 4), (20, 4), (20, 5), (24, 6)):
        yield from ((n, set(rng.sample(range(n), m))) for _ in range(100))
    yield from ((n, set(range(3, n, 4))) for n in (17, 31, 60, 200))


def test_every_admitted_pattern_is_found(monkeypatch):
    rows = list(cases())
    for chunk in (decontaminate.CHUNK, 4):
        monkeypatch.setattr(decontaminate, "CHUNK", chunk)
        index = decontaminate.Index([(k, " ".join(f"w{k}x{i}" for i in range(n))) for k, (n, _) in enumerate(rows)])
        for k, (n, other) in enumerate(rows):
            text = " ".join(["before", *(f"o{i}" if i in other else f"w{k}x{i}" for i in range(n)), "after"])
            same = np.array([i not in other for i in range(n)])
            assert index.overlaps(text) == [(k, decontaminate.stretch(same, n))]
    assert decontaminate.Index([]).overlaps("some words that no item has") == []


def brute_overlaps(items, text):
    w = decontaminate.words(text)
    out = {}
    for k, t in items:
        item = decontaminate.words(t)
        if len(item) < decontaminate.LEAST:
            continue
        for start in range(-len(item) + 1, len(w)):
            same = np.array([0 <= start + i < len(w) and w[start + i] == item[i] for i in range(len(item))])
            if most := best_of_all(same, len(item)):
                out[k] = max(most, out.get(k, 0))
    return sorted(out.items())


def test_few_words_in_any_order_match_brute_force():
    """Texts and items of two or three words: repeats, periods, ties and hits that go on."""
    rng = random.Random(4)
    for round_ in range(60):
        letters = "ab" if round_ % 2 else "abc"
        items = [(k, " ".join(rng.choice(letters) for _ in range(rng.randrange(3, 20)))) for k in range(4)] + [(8, "a b " * 10), (9, "a " * 15)]
        text = " ".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))
        assert decontaminate.Index(items).overlaps(text) == brute_overlaps(items, text)


def test_items_that_repeat_words():
    index = decontaminate.Index([(1, "a b " * 10), (2, "a a a a a"), (3, "a b c"), (4, None)])
    assert index.overlaps("x " + "a b " * 9) == [(1, 18)]
    assert index.overlaps("b a a a a a") == [(2, 5)]
    assert index.overlaps("a b c") == index.overlaps(None) == []


def test_equal_words_cost_their_number():
    index = decontaminate.Index([(1, "word " * 200), (2, "word other " * 100)])
    start = time.time()
    assert index.overlaps("word " * 8_000)[0] == (1, 200)
    assert index.overlaps("word other " * 4_000)[-1] == (2, 200)
    assert time.time() - start < 2


def test_odd_and_repeated_documents(spark, odd_docs, make_docs):
    bench = spark.createDataFrame([(1, "word " * 30), (1, "no id at all here my friend"), (2, None), (None, "x y z u v w"), (3, "")], "item_id long, text string")
    rows = decontaminate.find_leaks(odd_docs, bench).collect()
    assert len(rows) == odd_docs.count()
    assert {r.doc_id: (r.item_ids, r.best_match) for r in rows if r.contaminated} == {None: ([1], 7), 5: ([1], 30)}
    assert decontaminate.find_leaks(make_docs(), bench).count() == 0
    assert decontaminate.remove_contaminated(odd_docs, bench.limit(0)).count() == odd_docs.count()
    clashing = odd_docs.selectExpr("text as raw", "doc_id", "text", "1 as item_ids", "2 as best", "3 as start")
    kept = decontaminate.remove_contaminated(clashing, bench)
    assert kept.columns == clashing.columns and kept.count() == odd_docs.count() - 2


def test_many_blocks_find_the_same(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 20)
    items = [(k, " ".join(f"w{k}x{i}" for i in range(20))) for k in range(12)]
    docs = make_docs(*[(k, f"start {items[k][1]} and {items[(k + 5) % 12][1]}") for k in range(12)], (99, "clean"))
    found = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.item_ids for r in found} == {**{k: sorted([k, (k + 5) % 12]) for k in range(12)}, 99: []}
