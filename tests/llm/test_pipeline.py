"""Each stage against what it should keep, at sf0.001."""

import numpy as np

import corpus_pipeline
from cadenza.llm import op8_simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.identify_languages(spark, docs, SF)
    assert kept.columns == columns and kept.count() > 190
    good = corpus_pipeline.keep_quality(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert good.columns == columns and good.join(labels.where("quality = 1"), "doc_id").count() >= 0.97 * docs.join(labels.where("quality = 1"), "doc_id").count()
    single = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    left = {r.doc_id: r.text for r in single.collect()}
    assert single.columns == columns and len(set(left.values())) == len(left)
    gone = [r for r in docs.collect() if r.doc_id not in left]
    assert all(max(op8_simhash.jaccard(r.text, t, 5) for t in [x.text for x in docs.collect() if x.doc_id != r.doc_id]) >= 0.8 for r in gone)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_duplicate_groups_are_those_of_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, set(h for part in op8_simhash.shingle_hashes(r.text, 5) for h in part.tolist())) for r in docs.collect()]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, x) in enumerate(rows):
        for j, y in rows[:n]:
            if (len(x & y) >= 0.8 * len(x | y)) if x or y else True:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r.doc_id: r.group_id for r in op8_simhash.near_duplicate_groups(docs).collect()} == {i: find(i) for i, _ in rows}


def test_near_duplicates_with_null_and_repeated_ids(spark):
    """Groups decide what stays, not ids: (id, text) of six texts that share nothing, and a near copy."""
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcdef")
    rows = [(None, a), (None, b), (7, c), (7, d), (3, e), (None, e), (2, e + " tail"), (None, f), (None, f), (9, f), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, a), (None, b), (7, c), (7, d), (2, e + " tail"), (9, f), (None, None)], key=str)
    groups = sorted(((r.doc_id, r.group_id) for r in op8_simhash.near_duplicate_groups(docs).collect()), key=str)
    assert groups == sorted([(None, None)] * 3 + [(7, 7)] * 2 + [(3, 2), (None, 2), (2, 2)] + [(None, 9)] * 2 + [(9, 9)], key=str)


def test_near_duplicates_in_a_crowd(spark):
    """400 documents whose similarity with each other is 0.7, too little, but for 200 pairs of 0.8: most table entries hold many groups."""
    common = [f"c{i}" for i in range(169)]
    own = lambda n: [f"o{n // 2}.{i}" for i in range(13)] + [f"p{n}.{i}" for i in range(22)]
    rows = [(n, " ".join(common + own(n))) for n in range(400)]
    assert op8_simhash.jaccard(rows[0][1], rows[1][1], 5) >= 0.8 > 0.71 > op8_simhash.jaccard(rows[1][1], rows[2][1], 5)
    fps, weak = zip(*(op8_simhash.long_fingerprint(op8_simhash.distinct_shingles(t, 5)) for _, t in rows))
    keys = op8_simhash.long_keys(np.stack(fps), list(weak))
    meet = [bool(np.isin(keys[a], keys[b, 0]).any() or np.isin(keys[b], keys[a, 0]).any()) for a, b in zip(range(0, 400, 2), range(1, 400, 2))]
    apart = [int(np.bitwise_count((fps[a] ^ fps[a + 1]).view(np.uint64)).sum()) for a in range(0, 400, 2)]
    found = {2 * n for n in range(200) if meet[n] and apart[n] <= op8_simhash.Limits.of(0.8).far}
    groups = {r.doc_id: r.group_id for r in op8_simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    joined = {n for n in range(0, 400, 2) if groups[n + 1] == n}
    print(f"pairs that share an entry: {sum(meet)}, and are near enough: {len(found)}, joined: {len(joined)} of 200")
    assert joined <= found and len(joined) >= 190
    assert all(groups[n] in (n, n - n % 2) for n in groups)


def test_blocks_make_each_pair_of_different_groups_once(spark, monkeypatch):
    """Each probe of a group that isn't its entry's first with each member of another group."""
    monkeypatch.setattr(op8_simhash, "BLOCK", 3)
    monkeypatch.setattr(op8_simhash, "MAX_BROADCAST_KEYS", 1)
    rng = np.random.default_rng(2)
    rows = [(int(k), n, n if rng.random() < 0.5 else -1, 0, False, bool(rng.random() < 0.6)) for k in range(12) for n in range(25)]
    rows += [(99, 0, 0, 0, False, True), (99, 1, 1, 0, False, False), (98, 0, 0, 0, False, True), (98, 1, 0, 0, False, True)]
    first = {k: min(g for l, _, g, *_ in rows if l == k) for k, *_ in rows}
    want = {(a, ga, b, gb) if a < b else (b, gb, a, ga) for k, a, ga, *_ in rows for l, b, gb, _, _, m in rows if k == l and m and ga != gb and ga != first[k]}
    every = spark.createDataFrame(rows, "key long, node long, group long, sketch long, short boolean, member boolean")
    prints = spark.createDataFrame([(n, [0] * op8_simhash.LONG_WORDS) for n in range(25)], "node long, fp array<long>")
    got = [(r.node, r.group, r.other, r.other_group) for r in op8_simhash.met_in_blocks(every, prints, op8_simhash.Limits.of(0.8)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_short_texts_meet_exactly(spark):
    """8 words with one appended have a similarity of exactly 0.8, as have 40 such pairs; a longer one has 0.75."""
    rows = []
    for i in range(40):
        words = [f"w{i}.{k}" for k in range(9)]
        rows += [(2 * i, " ".join(words[:8])), (2 * i + 1, " ".join(words))]
    rows += [(100, "p q r s t u v"), (101, "p q r s t u v w x")]
    groups = {r.doc_id: r.group_id for r in op8_simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert groups == {**{i: i - i % 2 for i in range(80)}, 100: 100, 101: 101}
