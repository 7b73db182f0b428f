import hashlib
import random
import re
from collections import Counter

import numpy as np

from weftline.llm import neardup, suffixes
from weftline.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(texts, percent):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(docs, percent):
    want = brute_groups(dict(docs.select("doc_id", "text").collect()), percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, percent).collect()}
    assert got == want


def test_groups_match_brute_force(documents):
    check(documents, 85)
    check(documents, 80)


def test_a_crowd_of_near_copies_in_many_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(copy)))
    check(make_docs(*rows), 85)


def test_far_members_meet_the_whole_group(make_docs, monkeypatch):
    """Chains of copies that drift away from the pivot, in blocks of four: far members are linked by others alone."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 4)
    rng = random.Random(8)
    copy, rows = [f"w{rng.randrange(10**6)}" for _ in range(80)], []
    for i in range(40):
        copy = list(copy)
        copy[rng.randrange(80)] = f"n{i}"
        rows.append((i * 3 % 41, " ".join(copy)))
    check(make_docs(*rows), 85)
    check(make_docs(*rows), 80)


def test_texts_sent_grow_with_the_group(spark):
    """5000 near copies: each is sent once, and the pivot once for each block."""
    met = spark.range(5000).selectExpr("cast(7 as long) as pivot", "cast(1 as long) as pivot_key", "id as doc_id", "cast(1 as long) as text_key", "cast(100 as long) as n_shingles")
    groups = neardup.groups_of(met, "blocks")
    blocks = groups.first()["blocks"]
    rows = neardup.pivot_rows(met, groups)
    assert rows.count() == 4999 + blocks and rows.groupBy("block").count().agg({"count": "max"}).first()[0] < 2 * neardup.BLOCK_DOCS
    far = neardup.far_rows(met.filter("doc_id < 100"), met, groups)
    assert far.count() == 5000 + 100 * blocks


def templated(rng, count, words=200):
    """Documents of which one half is a template, every third one with a near copy; no two others are similar."""
    template, rows = [f"t{i}" for i in range(words)], []
    for i in range(count):
        own = [f"o{rng.randrange(10**9)}" for _ in range(words)]
        rows.append((i, " ".join(template + own)))
        if i % 3 == 0:
            own[rng.randrange(words)] = "changed"
            rows.append((i + 10**6, " ".join(template + own)))
    return rows


def test_documents_of_one_template_meet_in_few_texts(make_docs, monkeypatch):
    """All share bands, so all are far members of a few pivots; texts sent must not grow with the square."""
    rows, sent, blocks = templated(random.Random(12), 900), [], []
    docs = make_docs(*rows)
    texts, pairs = neardup.pivot_rows, neardup.far_rows
    monkeypatch.setattr(neardup, "pivot_rows", lambda *a: (sent.append(texts(*a)), sent[-1])[1])
    monkeypatch.setattr(neardup, "far_rows", lambda *a: (blocks.append(pairs(*a).count()), pairs(*a))[1])
    monkeypatch.setattr(neardup, "drop_kept", lambda *tables: None)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 85).collect()}
    assert got == {i: i % 10**6 for i, _ in rows}
    assert len(sent) == 2 and sent[1].count() < 3 * len(rows) and sum(blocks) < 3 * len(rows)


def test_rare_prefixes_of_similar_sets_meet():
    """Whatever the order of the shingles, sets that reach the similarity share one of their prefixes."""
    rng = np.random.default_rng(11)
    for percent in (80, 85):
        for trial in range(300):
            common = rng.integers(2, 5, 1 << neardup.SLOT_BITS).astype(np.uint32)
            whole = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 80)).astype(np.uint64))
            a, b = (np.unique(whole[rng.random(len(whole)) < 0.96]) for _ in range(2))
            both = len(np.intersect1d(a, b))
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                assert len(np.intersect1d(neardup.rare_prefix(a, common, percent), neardup.rare_prefix(b, common, percent)))


def test_shared_counts_with_common_shingles():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, 120).astype(np.uint64)) for _ in range(60)]
    counts = neardup.shared_counts(sets)
    for i in range(0, 60, 7):
        for j in range(60):
            if i != j:
                assert counts[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_odd_documents_near_duplicates(odd_docs, make_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[None].component_id is None and by[None].kept
    assert by[1].n_shingles == by[3].n_shingles == 0 and by[3].component_id == 3
    assert by[4].n_shingles == 1 and sum(r.doc_id == 4 for r in rows) == 2
    assert neardup.near_duplicates(make_docs()).count() == 0
    kept = neardup.deduplicate(make_docs((2, "a b c d e f"), (1, "A b c d e f"), (3, "other")))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_components_of_chains_hubs_and_rings(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(1000, 1100)]
    ring = [(2000, 2001), (2001, 2002), (2002, 2000), (2001, 2001)]
    found = dict(components(spark.createDataFrame([*chain, *hub, *ring, *ring], "a long, b long")).collect())
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(1000, 1100)} == {5} and found[2002] == 2000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(texts):
    seen = Counter(t[s : s + 400] for t in texts for s in range(len(t) - 399))
    out = []
    for t in texts:
        runs = []
        for s in range(len(t) - 399):
            if seen[t[s : s + 400]] > 1:
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = s + 400
                else:
                    runs.append([s, s + 400])
        out.append([tuple(r) for r in runs])
    return out


def check_removed(docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = Counter((i, len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(suffixes.without(t, runs)).hexdigest()) for (i, t), runs in zip(rows, brute_removed([t for _, t in rows])))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.repeat_counts(docs).collect())
    assert got == want


def test_removed_bytes_match_brute_force(documents):
    check_removed(documents.limit(120))


def random_text(rng, n):
    return "".join(rng.choice("abcdefgh é") for _ in range(n))


def test_edges_of_repeats(make_docs, monkeypatch):
    rng = random.Random(9)
    passage, other = random_text(rng, 900), random_text(rng, 420)
    texts = [random_text(rng, rng.randrange(0, 300)) + passage[a : a + n] + random_text(rng, rng.randrange(0, 300)) for a, n in ((0, 900), (100, 410), (100, 399), (250, 600), (0, 401), (333, 500))]
    texts += [other + "x" + other, other[:400], "ab" * 700, "z" * 399, "z" * 400, "z" * 401, passage]
    docs = make_docs(*[(i, t) for i, t in enumerate(texts)], (None, None), (50, passage), (50, passage))
    check_removed(docs)
    monkeypatch.setattr(suffixes, "HOT", 1)
    check_removed(docs)
    monkeypatch.setattr(suffixes, "SEGMENT", 512)
    check_removed(docs)


def test_deep_shallow_order():
    rng = np.random.default_rng(4)
    strings = rng.integers(97, 99, (300, 72)).astype(np.uint8)
    strings[100:200, :60] = strings[0, :60]
    strings[150:160] = strings[150]
    group = np.repeat([3, 1, 2], 100)
    order, common = suffixes.deep_shallow(group, strings)
    keys = [(group[i], strings[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for k in range(300):
        if k == 0 or keys[k][0] != keys[k - 1][0]:
            assert common[k] == -1
        else:
            a, b = keys[k][1], keys[k - 1][1]
            assert common[k] == next((i for i in range(72) if a[i] != b[i]), 72)


def test_remove_repeats_keeps_columns(make_docs):
    passage = random_text(random.Random(1), 500)
    out = {r.doc_id: r.text for r in suffixes.remove_repeats(make_docs((1, "head " + passage), (2, passage + " tail"), (3, "short"), (4, None))).collect()}
    assert out == {1: "head ", 2: " tail", 3: "short", 4: None}
    assert suffixes.repeat_counts(make_docs()).count() == 0


def test_clashing_columns_change_nothing(make_docs):
    docs = make_docs((2, "a b c d e f"), (1, "A b c d e f"), (3, random_text(random.Random(2), 900)), (4, random_text(random.Random(2), 900)), (None, None))
    odd = docs.selectExpr("1 as raw", "2 as bucket", "3 as core", "4 as at", "5 as repeat_doc", "text", "'x' as left_text", "doc_id", "6 as pivot", "7 as text_key", "8 as row", "9 as root")
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(neardup.near_duplicates(odd)) == plain(neardup.near_duplicates(docs))
    assert plain(suffixes.repeat_counts(odd)) == plain(suffixes.repeat_counts(docs))
    assert plain(neardup.deduplicate(odd).select("doc_id", "text")) == plain(neardup.deduplicate(docs).select("doc_id", "text"))
    cut = suffixes.remove_repeats(odd)
    assert cut.columns == odd.columns and plain(cut.select("doc_id", "text")) == plain(suffixes.remove_repeats(docs).select("doc_id", "text"))


def test_a_very_long_text_and_a_hot_core(make_docs, monkeypatch):
    rng = random.Random(6)
    passage = random_text(rng, 460)
    long = "".join(random_text(rng, 50_000) + passage for _ in range(3))
    check_removed(make_docs((1, long), (2, "head" + passage[:430]), (3, long[70_000:70_399]), (4, None)))
