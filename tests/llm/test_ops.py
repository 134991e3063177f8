"""The ten operators and the pipeline on small tables, against brute force; and odd inputs."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import bytecnn, op1_urls, op2_media, op3_quality, op4_bpe, op5_packing, op6_lm, op7_langid, op8_simhash, op9_chat, op10_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS, PIECES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, queue string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, very long, copies, ties and clashing names."""
    rng, names = random.Random(4), ["en", "fr", "de", None]
    vocabulary = {n: ["".join(rng.choice("abcdeéßñ" if n == "fr" else "klmnopqr") for _ in range(rng.randint(1, 8))) for _ in range(60)] for n in ("en", "fr", "de")}
    rows = []
    for i in range(60):
        lang = names[i % 4]
        rows.append((i, " ".join(rng.choice(vocabulary[lang or "en"]) for _ in range(rng.randint(1, 120))), lang, f"src{i % 3}" if i % 7 else None, i, "x", "q"))
    rows += [(60, None, None, None, None, None, None), (61, "", "en", "src0", 0, "", ""), (62, " \t\n 12 !! ", "en", "src0", 0, "", ""), (63, rows[5][1], "fr", "src1", 1, "", ""), (64, rows[5][1] + " tail", "fr", "src1", 1, "", ""), (5, rows[5][1], "fr", "src1", 1, "", ""), (65, "Ab<|im_end|>\\ " * 20_000, "en", "src2", 1, "", ""), (66, "aaaa" * 3000, "de", "src2", 1, "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)


def lower(text):
    return text.translate(str.maketrans(op1_urls.UPPER, op1_urls.LOWER))


def test_op1(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("a.org", "/x", "block"), ("a.org", "/x", "allow"), ("com", "", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://B.a.ORG/x1?q"), (2, "u://a.org/y"), (3, "u://a.org"), (4, None), (5, "none"), (5, "none"), (None, "h://q.com#/x"), (7, "a://b://c.com/x")], "page_id long, url string")
    got = sorted([(r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in op1_urls.judge_urls(pages, rules).collect()])
    assert got == sorted([(1, "b.a.org", "/x1", "a.org/x", "block"), (2, "a.org", "/y", "org/", "allow"), (3, "a.org", "", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (5, "", "", None, "allow"), (0, "q.com", "", "com", "block"), (7, "b:", "//c.com/x", None, "allow")])
    assert op1_urls.judge_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == 8
    assert op1_urls.judge_urls(pages.limit(0), rules).count() == 0


def test_op1_many_rules_take_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(op1_urls, "MAX_BROADCAST_RULES", 1)
    rules = spark.range(500).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(1000).select(F.col("id").alias("page_id"), F.concat(F.lit("u://h"), "id", F.lit(".org/")).alias("url"))
    assert op1_urls.judge_urls(pages, rules).groupBy("verdict").count().orderBy("verdict").collect() == [("allow", 500), ("block", 500)]


def test_op2(spark, docs):
    media = op2_media.describe_media(op2_media.store_media(docs)).collect()
    assert len(media) == len({t for _, t in texts(docs)})
    by = {r.digest: r for r in media}
    for _, t in texts(docs):
        p = op2_media.pad_payload(t.encode())
        r = by[sha256(t.encode()).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(p), sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    d = sha256(b"").hexdigest()
    pages = spark.createDataFrame([(1, f"<p>a</p><img src='sha256:{d}' alt='alone'>b<figure><img src='sha256:00'><figcaption>cap</figcaption></figure>"), (2, None)], "page_id long, html string")
    rows = {r.page_id: r.sequence for r in op2_media.interleaved(op2_media.sequences(pages), op2_media.describe_media(op2_media.store_media(docs))).collect()}
    assert [(i.position, i.kind, i.text, i.caption, i.n_bytes) for i in rows[1]] == [(0, "text", "a", None, None), (1, "image", None, "alone", 0), (2, "text", "b", None, None), (3, "image", None, "cap", None)]
    assert rows[2] == []


def test_op3_and_op7(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 4 != 2)) for i in range(60)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = op3_quality.train_quality_model(docs, labels, steps=600)
    got = {r.doc_id: r.score for r in op3_quality.score_quality(docs, model).collect()}
    assert len(got) == 67 and all(0 <= s <= 1 for s in got.values())
    assert op3_quality.train_quality_model(docs, labels.limit(0)).constant == 0.5 and op3_quality.score_quality(empty, model).count() == 0
    language = op7_langid.train_language_model(docs, steps=600)
    rows = op7_langid.predict_languages(docs, language, keep=("lang",)).collect()
    assert len(rows) == docs.count() and {r.lang_pred for r in rows if r.doc_id in (60, 61, 62)} == {"und"}
    held = [r for r in rows if r.doc_id < 60 and r.lang == "fr"]
    assert np.mean([r.lang_pred == "fr" for r in held]) > 0.9
    none = op7_langid.train_language_model(empty)
    assert {r.lang_pred for r in op7_langid.predict_languages(docs, none).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = (op7_langid.fold_of("doc_id", 5) == 0)
    found = op7_langid.predict_languages(documents, op7_langid.train_language_model(documents), keep=("lang",)).where(held).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.95
    scored = op3_quality.score_quality(documents, op3_quality.train_quality_model(documents, labels)).join(labels, "doc_id").where(held).toPandas()
    assert ((scored.score >= 0.3) == (scored.quality == 1)).mean() > 0.9


def test_op4(docs):
    encoder = op4_bpe.text_encoder(RANKS, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})
    got = {r.doc_id: r for r in op4_bpe.digest_documents(docs, RANKS, P.PATTERN).collect()}
    for key, t in texts(docs):
        ids = enc.encode_ordinary(t)
        assert (got[key].n_tokens, got[key].ids_sha256, got[key].decoded_sha256) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(t.encode()).hexdigest())
    rng = random.Random(1)
    for _ in range(1500):
        t = "".join(rng.choice("ab'stre ll\n\t 12.,!?éß  \x1c日本  ") for _ in range(rng.randint(0, 40)))
        assert encoder.encode(t) == ",".join(map(str, enc.encode_ordinary(t)))
    v = encoder.vocabulary
    for _ in range(150):
        x = bytes(rng.choice(b"aaabth er") for _ in range(rng.randint(1, 300)))
        pieces, a = op4_bpe.PrefixEncoder(v, x), rng.randint(0, len(x))
        b, new = rng.randint(a, min(len(x), a + 5)), bytes(rng.choice(b"abth") for _ in range(rng.randint(0, 5)))
        pieces.replace(a, b, new)
        assert pieces.tokens() == op4_bpe.PrefixEncoder(v, x[:a] + new + x[b:]).tokens()
        pieces.append(x)
        assert pieces.tokens() == op4_bpe.PrefixEncoder(v, x[:a] + new + x[b:] + x).tokens()


@pytest.mark.parametrize("weights", [None, {"src0": 0.5, "src1": 0.3, "src2": 0.2}])
def test_op5(docs, empty, weights):
    found = op5_packing.pack(docs, PIECES, 1, sequence=64, window_sequences=4, weights=weights).toPandas()
    tokenizer = Tokenizer.from_file(PIECES)
    want = Counter()
    for key, t in texts(docs):
        want[key, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1] += 1
    assert sum(n * c for (_, n), c in want.items()) == found.length.sum()
    one = found[found.doc_id == 64].sort_values("start")
    ids = np.array(tokenizer.encode(dict(texts(docs))[64], add_special_tokens=False).ids + [1], "<u4")
    assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(one.start, one.length, one.ids_crc32)) and one.length.sum() == len(ids)
    for _, g in found.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all() and g.length.sum() <= 64
    sums = found.groupby("sequence_id").length.sum()
    assert (sums == 64).sum() >= len(sums) - 1
    if weights is None:  # every window holds each queue's share but for fractions of tokens at its two borders
        found["window"] = found.sequence_id // 4
        total, whole = found.length.sum(), found[found.sequence_id // 4 < found.sequence_id.max() // 4]
        for queue, part in found.groupby("queue"):
            share = part.length.sum() / total * 256
            assert (abs(whole[whole.queue == queue].groupby("window").length.sum() - share) < 2).all()
    assert op5_packing.pack(empty, PIECES, 1).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_op6(docs, empty, order):
    got = {}
    for r in op6_lm.score_documents(docs, order=order).collect():
        got.setdefault(r.doc_id, r)
    counts, tokens = Counter(), {}
    for key, t in texts(docs):
        tokens[key] = [*WORD.findall(lower(t)), None]
        if zlib.crc32(str(key).encode()) % 7 != 2:
            counts.update(tokens[key])
    n, v = sum(counts.values()), len(counts)
    for key, w in tokens.items():
        assert got[key].base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert (got[key].n_tokens, got[key].n_known, got[key].train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n) and got[key].score < 0
    assert op6_lm.score_documents(empty).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_op6_scores_against_naive_deleted_interpolation(spark, order):
    """Counts, expectation-maximisation and probabilities written out token by token."""
    rng, words = random.Random(8), [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([3, 25])]) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    got = {r.doc_id: r for r in op6_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), order=order).collect()}
    tokens = {i: ["<s>"] * (order - 1) + [*t.split(), "</s>"] for i, t in rows}
    taught = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    grams = [Counter(tuple(w[j - k : j + 1]) for i in taught for w in [tokens[i]] for j in range(order - 1, len(w))) for k in range(order)]
    heads = [Counter(tuple(w[j - k : j]) for i in taught for w in [tokens[i]] for j in range(order - 1, len(w))) for k in range(order)]
    n, v = sum(grams[0].values()), len(grams[0])
    places = [(w, j) for i in taught for w in [tokens[i]] for j in range(order - 1, len(w))]
    bucket = lambda c: int(math.log2(c)) + 1 if c > 0 else 0
    lower, shares = [1 / (v + 1)] * len(places), []
    for k in range(order):
        found = [(max(heads[k][tuple(w[j - k : j])] - 1, 0), grams[k][tuple(w[j - k : j + 1])] - 1) for w, j in places]
        share = dict.fromkeys(range(64), 0.5)
        ratio = [min(1.0, c / h) if h else 0.0 for h, c in found]
        at = [0 if k == 0 else bucket(h) for h, _ in found]
        for _ in range(40):
            part, seen = Counter(), Counter()
            for b, r, p in zip(at, ratio, lower):
                long, short = share[b] * r, (1 - share[b]) * p
                part[b] += long / (long + short)
                seen[b] += 1
            share = {b: (part[b] + 0.5) / (seen[b] + 1) for b in range(64)}
        share = {b: min(max(s, 1e-6), 1 - 1e-6) for b, s in share.items()} | ({0: 0.0} if k else {})
        lower = [share[b] * r + (1 - share[b]) * p for b, r, p in zip(at, ratio, lower)]
        shares.append(share)
    for i, w in tokens.items():
        total = 0.0
        for j in range(order - 1, len(w)):
            p = 1 / (v + 1)
            for k, share in enumerate(shares):
                h = n if k == 0 else heads[k][tuple(w[j - k : j])]
                s = share[0 if k == 0 else bucket(h)]
                p = s * (grams[k][tuple(w[j - k : j + 1])] / h if h else 0.0) + (1 - s) * p
            total += math.log10(p)
        assert got[i].score == pytest.approx(total, rel=0.03)  # the weights come from counts in cells of a quarter of a doubling


def test_op6_is_a_distribution():
    """The mixture over all words and one unknown sums to 1 in a context."""
    counts = np.array([5, 3, 2, 0])
    after = np.array([2, 1, 0, 0])
    weights = [np.full(64, 0.7), np.full(64, 0.4)]
    p = op6_lm.probabilities([counts, after], [np.full(4, 3)], weights, 10, 3)
    assert p.sum() == pytest.approx(1.0)


def roots_of(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op5_ids_are_those_of_the_plain_call():
    tokenizer, own = Tokenizer.from_file(PIECES), op5_packing.word_tokenizer(PIECES)
    rng = random.Random(2)
    made = ["hi <|endoftext|> there", "<|ENDOFTEXT|> a<|startoftext|>b", "", " ", "a<|endoftext|>", "<|endoftext|><|endoftext|>"]
    made += ["".join(rng.choice(["<|endoftext|>", "<|", "|>", "é", "E", " ", "'s", "日", "1", "\n", "\u0301", "<|EndOfText|>"]) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    for text, ids in zip(made, own.encode([t.encode() for t in made])):
        assert np.frombuffer(ids, own.type).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_op5_keeps_a_queue_for_each_of_many_sources(spark):
    """1,100 sources of 4 documents, in order of their sources, and one large source; the same with weights."""
    rows = [(4 * n + i, f"w{n} x", f"src{n:04}") for n in range(1100) for i in range(4)] + [(5000 + i, "a b c d e f", "large") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartitionByRange(3, "doc_id")
    found = op5_packing.pack(docs, PIECES, 1, sequence=64, window_sequences=16).toPandas()
    assert found.queue.nunique() == 1101 and set(found.queue) == {f"s:{s}" for _, _, s in rows}
    found["window"] = found.sequence_id // 16
    total, last = found.length.sum(), found.window.max()
    for _, part in found.groupby("queue"):
        sums = part.groupby("window").length.sum().reindex(range(last), fill_value=0)
        assert (abs(sums - part.length.sum() / total * 1024) < 2).all()
    for weights in (None, {"src0007": 0.5, "large": 0.5}):
        got = op5_packing.pack(docs, PIECES, 1, sequence=64, window_sequences=16, weights=weights).toPandas().sort_values(["sequence_id", "offset"])
        slots = got.sequence_id * 64 + got.offset
        assert (slots.to_numpy() == np.concatenate([[0], np.cumsum(got.length)[:-1]])).all() and got.length.sum() == total
        assert got.groupby("doc_id").length.sum().equals(found.groupby("doc_id").length.sum())
    first = got[got.sequence_id * 64 + got.offset < got[got.queue.isin(["s:src0007", "s:large"])].length.sum()]
    assert set(first.queue) == {"s:src0007", "s:large"}


def test_op8(docs, empty):
    prints = {}
    for key, t in texts(docs):
        w = WORD.findall(lower(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0) if h else np.zeros(64)
        prints[key] = sum(1 << i for i in range(64) if 2 * int(bits[i]) > len(h))
    ids = sorted(prints)
    want = roots_of(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in op8_simhash.link_close(docs).collect()}
    assert got == {i: (prints[i], want[i]) for i in ids}
    assert op8_simhash.link_close(empty).count() == 0


def test_op8_finds_every_close_pair_and_long_chains(spark):
    rng, base = np.random.default_rng(0), int(np.random.default_rng(9).integers(1 << 62))
    values = {base}
    for _ in range(400):
        values.add(base ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 4)))))
    signed = sorted(np.array(sorted(values), np.uint64).view(np.int64).tolist())
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 2}
    found = spark.createDataFrame([(x,) for x in signed], "fp long")
    assert {(r.a, r.b) for r in op8_simhash.close_pairs(found).collect()} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.root for r in op8_simhash.components(chain).collect()} == {0}


def test_near_duplicates(docs, empty):
    got = {r.doc_id: r.group_id for r in op8_simhash.near_duplicate_groups(docs).collect()}
    assert got[63] == got[5] == got[64] == 5 and got[60] == got[61] == 60
    assert op8_simhash.near_duplicate_groups(empty).count() == 0


def test_op9(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", None]), "".join(rng.choice("<|\\n\n>abc é") for _ in range(rng.randint(0, 20))) if rng.random() < 0.9 else None) for c in range(20) for t in range(rng.randint(1, 6))]
    rows += [(3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (None, 0, "user", "x")]
    got = {r.conv_id: r for r in op9_chat.digest_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for key in {r[0] for r in rows}:
        own = sorted([(t, r or "", x or "") for c, t, r, x in rows if c == key])
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[key].n_turns, got[key].turns_sha256) == (len(own), sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest())
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), sha256(loss.encode()).hexdigest())
    assert op9_chat.digest_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_op9_templates():
    render = lambda t, **names: "".join(x for x, _ in op9_chat.compile_template(t)(names))
    assert render("{% for x in xs %}{% if x.a == 1 and not false %}A{% elif x['a'] == 2 %}B{% else %}C{% endif %}{% endfor %}", xs=[{"a": 1}, {"a": 2}, {"a": 3}]) == "ABC"
    assert render("{% set y = n + 1 %}{{ y ~ 'z' | upper }}", n=1) == "2Z"
    assert op9_chat.fold(op9_chat.parse("a{% if 1 == 1 %}b{{ 'x' ~ 2 }}{% endif %}"), {}).parts == (op9_chat.Node("text", "abx2"),)
    for bad in ("{{ x.__class__ | nothing }}", "{% if x %}", "{% for x %}{% endfor %}", "{{ f(1) }}", "{% endfor %}"):
        with pytest.raises(op9_chat.TemplateError):
            op9_chat.parse(bad)
    with pytest.raises(op9_chat.TemplateError):
        render("{{ x.real }}", x=1)


def test_op10(docs, empty):
    got = op10_minhash.edited_neighbours(docs).toPandas()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (-x[0], [-ord(c) for c in x[1]]))
    assert len(got) == len(rows)
    shingles = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(WORD.findall(t))
    error = []
    for i, (key, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        mine = got[(got.doc_id == key) & (got.edited_sha256 == sha256(edited.encode()).hexdigest())]
        assert len(mine) and mine.n_chars.iloc[0] == len(t)
        a, b = shingles(t), shingles(edited)
        error.append(mine.near_edited.iloc[0] - len(a & b) / len(a | b))
    assert abs(np.mean(error)) < 0.02 and np.abs(error).max() < 0.2
    assert got[got.doc_id.isin([5, 63])].fingerprint.nunique() == 1
    assert op10_minhash.edited_neighbours(empty).count() == 0


def test_op10_fingerprints_against_a_naive_sketch(spark, docs):
    """One permutation, bins, densification by the shared sequence, low-order bits: word by word, with the library's hash."""
    signed = lambda x: x - 2**64 if x >= 2**63 else x

    def chained(*values):
        seed = 42
        for x in values:
            seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else int(x).to_bytes(8, "little", signed=True), seed)
        return seed

    def sketch(text):
        w = WORD.findall(text)
        hashes = {chained(*w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {chained(" ".join(w))}
        least = {}
        for h in sorted(hashes, key=signed):
            least.setdefault(h >> 57, signed(h))
        out = []
        for b in range(128):
            value = least.get(b)
            for t in range(op10_minhash.ATTEMPTS):
                if value is None:
                    value = least.get(signed(chained(b, t)) % 128)
            if value is None:
                value = min((signed(chained(b, x)), v) for x, v in least.items())[1]
            out.append(value & 255)
        return out

    rows = sorted(((r.doc_id, r.text or "") for r in docs.where("doc_id <> 5").collect()), key=lambda x: -x[0])
    got = {r.doc_id: r for r in op10_minhash.edited_neighbours(docs.where("doc_id <> 5")).collect()}
    like = lambda a, b: max(0.0, (sum(x == y for x, y in zip(a, b)) / 128 - 1 / 256) / (1 - 1 / 256))
    prints = [sketch(t) for _, t in rows]
    for i, (key, text) in enumerate(rows):
        k, follow = len(text) // 3, (i + 1) % len(rows)
        edited = sketch(text[: len(text) - k] + rows[follow][1][:k])
        assert got[key].fingerprint == bytes(prints[i]).hex() and got[key].edited_fingerprint == bytes(edited).hex()
        assert got[key].near_next == pytest.approx(like(prints[i], prints[follow])) and got[key].near_edited == pytest.approx(like(prints[i], edited))


def test_op10_hot_and_null_ids_are_dealt_over_buckets(spark, monkeypatch):
    """400 rows of one id and 400 without one: a bucket number grows with (id, hash), and none holds them all."""
    monkeypatch.setattr(op10_minhash, "BUCKET_BYTES", 2000)
    rows = [(7, f"a{i} b c d e {i}") for i in range(400)] + [(None, f"n{i} b c d e {i}") for i in range(400)] + [(i, f"x{i} b c d e") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = op10_minhash.edited_neighbours(docs).collect()
    assert len(got) == 1200
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h"))
    bounds = hashed.agg(F.percentile_approx("doc_id", [i / 1000 for i in range(1, 1000)], 10_000)).first()[0]
    placed = hashed.withColumn("b", op10_minhash._bucket_of(F.col("doc_id"), F.col("h"), bounds, 40, 14)).collect()
    order = sorted(placed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))
    assert [r.b for r in order] == sorted(r.b for r in order)
    assert max(Counter(r.b for r in placed).values()) < 100 and len({r.b for r in placed}) > 40
    text = {(r.doc_id, t): h for r, t, h in ((r, r.text, r.h) for r in docs.withColumn("h", F.xxhash64("text")).collect())}
    ranked = [(i, t) for _, _, i, t in sorted(((i is not None, (i or 0, h), i, t) for (i, t), h in text.items()), key=lambda x: x[:2], reverse=True)]
    edits = Counter()
    for (i, t), (_, follow) in zip(ranked, ranked[1:] + ranked[:1]):
        edits[i, sha256((t[: len(t) - len(t) // 3] + follow[: len(t) // 3]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == edits


def test_op10_buckets_do_not_change_results(docs, monkeypatch):
    columns = ["doc_id", "edited_sha256", "fingerprint", "near_edited", "near_next"]
    one = op10_minhash.edited_neighbours(docs).toPandas()[columns].sort_values(columns).reset_index(drop=True)
    monkeypatch.setattr(op10_minhash, "BUCKET_BYTES", 20_000)
    assert op10_minhash.edited_neighbours(docs).toPandas()[columns].sort_values(columns).reset_index(drop=True).equals(one)


def test_byte_networks_against_loops():
    """Windows, the forward pass and gradients by differences."""
    rng = np.random.default_rng(1)
    made = [b"", b"ab", bytes(rng.integers(1, 255, 23, dtype=np.uint8)), bytes(rng.integers(1, 255, 50, dtype=np.uint8))]
    windows, first, held = bytecnn.windows_of(made, 10, 8, 2)
    at = 0
    for i, t in enumerate(made):
        assert first[i] == at
        starts = [0]
        while starts[-1] + 10 < len(t):
            starts.append(starts[-1] + 8)
        for lo in starts:
            assert bytes(windows[at]) == (t + bytes(20))[lo : lo + 12] and held[at] == min(10, max(0, len(t) - lo))
            at += 1
    net = bytecnn.ByteCNN.fresh((2, 3), 4, 3, 5)
    net.bias += rng.normal(0, 0.1, net.bias.shape).astype(np.float32)
    z = net.logits(windows)
    for w, row in zip(windows, z):
        hidden = []
        for f in range(8):
            width = 3 if f < 4 else 2
            hidden.append(max(0.0, max(sum(net.tables[j][w[p + j], f] for j in range(width)) for p in range(10)) + net.bias[f]))
        assert row == pytest.approx(np.array(hidden) @ net.dense + net.dense_bias, abs=1e-4)
    labels = rng.integers(0, 3, len(windows))
    loss = lambda n: -np.log(bytecnn.softmax(n.logits(windows).astype(float)))[np.arange(len(labels)), labels].mean()
    before = loss(net)
    net.train(windows, labels, np.ones(len(labels)), 60, 1)
    assert loss(net) < 0.5 * before


def test_quality_combines_all_chunks_of_a_text():
    """The score of a long text follows from every chunk's log-odds."""
    net = bytecnn.ByteCNN.fresh((3,), 4, 2, 1)
    model = op3_quality.QualityModel(net, np.array([0.5, -0.2, 0.3, 0.1]))
    made = [b"", b"short", bytes(range(32, 127)) * 40]
    for t, s in zip(made, model.score(made)):
        odds = []
        for lo in [0, *range(op3_quality.STRIDE, max(1, len(t) - op3_quality.CHUNK + op3_quality.STRIDE), op3_quality.STRIDE)]:
            z = net.logits(np.frombuffer((t + bytes(1000))[lo : lo + op3_quality.CHUNK + 2], np.uint8)[None])
            odds.append(float(z[0, 1] - z[0, 0]))
        want = 0.5 * np.mean(odds) - 0.2 * min(odds) + 0.3 * max(odds) + 0.1
        assert s == pytest.approx(1 / (1 + math.exp(-want)), abs=1e-5)
