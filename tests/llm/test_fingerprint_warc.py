import hashlib

import pytest
from pyspark.sql.functions import xxhash64

from weftline.llm import fingerprint as fp
from weftline.llm import warc


def test_digests_tell_edits_from_strangers(documents):
    rows = fp.fingerprint_documents(documents).collect()
    texts = dict(documents.select("doc_id", "text").collect())
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    assert len(rows) == len(texts)
    near, far = [], []
    for r in rows:
        text, after = texts[r.doc_id] or "", texts[following[r.doc_id]] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + after[:third]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == fp.fingerprint(text) and r.edited_fingerprint == fp.fingerprint(changed)
        near.append(r.near_edited)
        far.append(r.near_next)
    assert sum(n > f for n, f in zip(near, far)) > 0.95 * len(rows)
    assert sorted(near)[len(near) // 2] > 0.5 and sorted(far)[len(far) // 2] < 0.1


def test_entropy_matches_plain_counting():
    import math
    from collections import Counter

    import numpy as np

    data = np.frombuffer(b"the quick brown fox jumps over the lazy dog, aaaa aaaa aaaa aaaa aaaa aaaa", np.uint8)
    for i, step in enumerate(fp.entropy_steps(data)):
        h = -sum(c / 32 * math.log2(c / 32) for c in Counter(data[i : i + 32].tolist()).values())
        assert step == pytest.approx(h / 5 * 1000, abs=1.01)


def test_segments_change_nothing(monkeypatch):
    text = " ".join(f"word{i * 7919 % 1013}" for i in range(5000)).encode()
    whole = fp.features(text, fp.rarity())
    monkeypatch.setattr(fp, "SEGMENT", 4096)
    assert fp.features(text, fp.rarity()).tolist() == whole.tolist()


def test_odd_documents(odd_docs, make_docs):
    rows = {(r.doc_id, r.n_chars): r for r in fp.fingerprint_documents(odd_docs).collect()}
    assert fp.fingerprint_documents(odd_docs).count() == odd_docs.count()
    assert rows[(1, 0)].fingerprint == rows[(2, 0)].fingerprint == "0:" and rows[(2, 0)].near_next == 1.0
    assert fp.fingerprint_documents(make_docs()).count() == 0
    alone = fp.fingerprint_documents(make_docs((1, "just one document in all"))).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_archives_give_every_page_back(spark):
    html = ["<p>one</p>", "<p>one</p>", None, "", "ends in a line\r\n", "holds\r\n\r\nWARC/1.1\r\n\r\nblank lines\r\n\r\n", "<p>one</p>", "é 日本"]
    pages = spark.createDataFrame([(10 - i, f"https://a.org/{i} x", h) for i, h in enumerate(html)] + [(None, None, "no id")], "page_id long, url string, html string")
    found = {r.page_id: r for r in warc.archive_and_read(pages).collect()}
    assert len(found) == len(html) + 1
    first = {}
    for i, h in sorted(((10 - i, (h or "").encode()) for i, h in enumerate(html))):
        first.setdefault(h, i)
        r = found[i]
        assert (r.payload_bytes, r.payload_digest) == (len(h), warc.bare_digest(h))
        assert (r.record_type, r.refers_to) == (("response", None) if first[h] == i else ("revisit", first[h]))
        assert r.has_request and r.n_metadata == 1
    assert found[None].record_type == "response"
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_repeated_rows_and_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "same"), (1, "u", "same"), (2, "u", "same")], "page_id long, url string, html string")
    kinds = sorted((r.page_id, r.record_type) for r in warc.archive_and_read(pages).collect())
    assert kinds == [(1, "response"), (1, "response"), (2, "revisit")]
    warc.write_archives(pages, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.filter("kind = 'response'").first()["payload"] == b"same"
    whole = warc.assemble(records).filter("response.kind = 'response'").first()
    assert whole.request.kind == "request" and b"payload-bytes: 4" in whole.metadata[0].payload


def test_a_hot_payload_is_split(spark):
    """Half of the pages are equal: adaptive execution splits the exchange that holds them."""
    pages = spark.range(4000).selectExpr("id as page_id", "concat('u', id) as url", "if(id % 2 = 0, repeat('same html ', 400), repeat(sha2(cast(id as string), 256), 60)) as html")
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "40"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = warc.first_of_equal(pages, "page_id", "html")
        assert sum(r["first"] == 0 for r in joined.collect()) == 2000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_long_payloads_and_clashing_columns(spark):
    html = "<p>" + "long line\r\n\r\n" * 200_000
    pages = spark.createDataFrame([(1, "u", html, 5, "x"), (2, "v", html, 6, "y")], "page_id long, url string, html string, first long, sha string")
    rows = {r.page_id: r for r in warc.archive_and_read(pages).collect()}
    assert rows[1].payload_bytes == rows[2].payload_bytes == len(html) and rows[2].refers_to == 1


def plain_features(raw, window, span, popular):
    """Windows that win in ``popular`` or more of the spans of neighbours: entropy by counting, ties to the left."""
    import math
    from collections import Counter

    ranks = fp.rarity()
    # the scale in integers, as the digest defines it: sums of rounded steps of c log2 c
    gain = [round(65536 * ((c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0))) for c in range(window)]
    steps = []
    for i in range(len(raw) - window + 1):
        lost = sum(sum(gain[:c]) for c in Counter(raw[i : i + window]).values())
        steps.append(fp.STEPS - lost * fp.STEPS // sum(gain))
    order = [(int(ranks[s]), i) for i, s in enumerate(steps)]
    wins = Counter(min(order[max(0, a) : a + span])[1] for a in range(1 - span, len(order)))
    found = [i for i in range(len(order)) if wins[i] >= popular and order[i][0] < 1 << 20]
    found = found or [max(range(len(order)), key=lambda i: (wins[i], -i))]
    return [raw[i : i + window] for i in found]


def test_features_match_a_plain_version():
    import random

    rng = random.Random(3)
    for n in (40, 100, 300, 700):
        raw = " ".join(rng.choice(["alpha", "beta", "gamma", "delta9", "zeta,", "eta"]) for _ in range(n // 5)).encode()[:n]
        want = plain_features(raw, fp.NARROW, fp.NEAR, fp.OFTEN) if len(raw) < fp.SHORT else []
        want += plain_features(raw, fp.WINDOW, fp.SPAN, fp.POPULAR)
        got = fp.features(raw, fp.rarity())
        assert len(got) == len(set(want)) and len(got) > 0


def test_filters_and_likeness_match_a_plain_version():
    import random

    import numpy as np

    rng = random.Random(4)
    make = lambda n: [rng.getrandbits(64) for _ in range(n)]

    def plain(hashes):
        return [{(x >> (11 * i)) % fp.BITS for x in hashes[at : at + fp.PER_FILTER] for i in range(fp.HASHES)} for at in range(0, len(hashes), fp.PER_FILTER)]

    def one_way(a, b):
        best = [max(max(0.0, (len(x & y) - len(x) * len(y) / fp.BITS) / (min(len(x), len(y)) - len(x) * len(y) / fp.BITS)) for y in b) for x in a]
        return sum(s * len(x) for s, x in zip(best, a)) / sum(map(len, a))

    base = make(400)
    for a, b in ((base, base[:150] + make(250)), (base, base[:90]), (make(30), make(500)), (base[:200], base[200:])):
        x, y = fp.digest_bits(np.array(a, np.uint64)), fp.digest_bits(np.array(b, np.uint64))
        p, q = plain(a), plain(b)
        assert [set(np.flatnonzero(r).tolist()) for r in x] == p and [set(np.flatnonzero(r).tolist()) for r in y] == q
        want = (one_way(p, q) + one_way(q, p)) / 2 if len(p) == len(q) else one_way(p, q) if len(p) < len(q) else one_way(q, p)
        assert fp.likeness(x, y) == pytest.approx(min(1.0, want), abs=1e-6) and fp.likeness(x, y) == pytest.approx(fp.likeness(y, x))


def test_crowded_ids_are_split(spark, make_docs):
    """A third of all rows without an id, and one id that repeats: parts by hash, each row once and in the defined order."""
    docs = make_docs(*[(None, f"text without id {i}") for i in range(400)], *[(7, f"text of seven {i % 90}") for i in range(200)], *[(i, f"text {i}") for i in range(100, 700)])
    placed = fp.with_following(docs).filter("not halo")
    sizes = [r["count"] for r in placed.groupBy("bucket", "part").count().collect()]
    assert sum(sizes) == docs.count() and max(sizes) < 250
    rows = fp.fingerprint_documents(docs).collect()
    own = sorted(docs.withColumn("h", xxhash64("text")).collect(), key=lambda r: (-r.doc_id if r.doc_id is not None else 1 << 70, r.h))
    pairs = [(a.text, b.text) for a, b in zip(own, own[1:] + own[:1])]
    want = sorted((r.doc_id or -1, len(a), hashlib.sha256(fp.edited(a, b).encode()).hexdigest()) for r, (a, b) in zip(own, pairs))
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in rows) == want


def test_clashing_columns_of_fingerprints(make_docs):
    docs = make_docs((1, "one text"), (2, "another text"), (None, None))
    odd = docs.selectExpr("7 as bucket", "8 as part", "'z' as tie", "9 as key", "text", "doc_id", "3 as `order`")
    assert sorted(map(str, fp.fingerprint_documents(odd).collect())) == sorted(map(str, fp.fingerprint_documents(docs).collect()))
