"""Prefix trie, vector codes and source mix against brute force."""

import math
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from cadenza.llm import op11_trie, op12_codes, op13_mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURN = "conv_id long, turn long, role string, text string, node string, head string"


def rebuilt(rows):
    """By the rule, from (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn, sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32], role, text))
    own = {c: [x[3:] for x in sorted(t, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, t in by.items()}
    return {c: own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + own[c][zlib.crc32(str(c).encode()) % 6 :] for c in own}


def trie(convs):
    nodes, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    for n in nodes:
        if n:
            children[n[:-1]] += 1
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1]) if n else 0
            leaves[n[:d]] += not children[n]
    ends = {n: ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(n)) for n, m in nodes.items()}
    return sorted([(min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], sha256(ends[n].encode()).hexdigest()) for n, m in nodes.items()], key=str)


def talks(rng):
    """Shared heads of several depths, copies, ties, nulls, long conversations, few different turns."""
    rows = []
    for c in [*range(0, 40), 100, 101, 102, 205, 300, 307, 311, 2**53 + 1]:
        for turn in range(rng.choice([0, 1, 2, 3, 8, 30])):
            rows.append((c, rng.choice([None, turn, turn]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b é", "", None])))
    rows += [(c, t, "user", f"same {t}") for c in range(500, 540) for t in range(6)]
    rows += [(None, 0, "user", "x"), (700, 0, "u", "tie"), (700, 0, "u", "tie"), (700, 0, "u", "other")]
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_op11_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op11_trie, "BLOCK", block)
    monkeypatch.setattr(op11_trie, "CHUNK", block)
    rows = talks(random.Random(block))
    turns = op11_trie.digested(spark.createDataFrame([(*r, "n", "h") for r in rows], TURN).repartition(5))
    got = sorted(map(tuple, op11_trie.prefix_trie(*op11_trie.with_shared_heads(turns)).collect()), key=str)
    assert got == trie(rebuilt(rows))


def test_op11_without_shared_heads_and_empty(spark):
    """A chain of copies, each one turn longer than the one before: one path. Nothing for an empty table, a root for turnless conversations."""
    rows = [(c, t, "user", f"t{t}") for c in range(1, 30) for t in range(c)]
    turns = op11_trie.digested(spark.createDataFrame([(*r, "n", "h") for r in rows], TURN))
    own = op11_trie.numbered(turns, "conv_id", ["turn", "digest"])
    got = sorted(map(tuple, op11_trie.prefix_trie(own, own.select("conv_id").distinct()).collect()), key=str)
    assert got == trie({c: [("user", f"t{t}") for t in range(c)] for c in range(1, 30)})
    empty = op11_trie.digested(spark.createDataFrame([], TURN))
    assert op11_trie.prefix_trie(*op11_trie.with_shared_heads(empty)).count() == 0
    only = op11_trie.prefix_trie(own.limit(0), spark.createDataFrame([(4,), (5,)], "conv_id long")).collect()
    assert [tuple(r) for r in only] == [(4, 0, None, 2, 0, 1, 0, sha256(b"4,5").hexdigest())]


def lloyd(rows, entries=16, rounds=6):
    kept = sorted(((i, v, x) for i, v, x in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = 8 * -(-max(len(v) for _, v, _ in kept) // 8)
    ints = [[math.floor(4096 * c) for c in v] + [0] * (length - len(v)) for _, v, _ in kept]
    part = lambda x, p: x[p * length // 8 : (p + 1) * length // 8]
    books = [[part(x, p) for x in ints[:entries]] for p in range(8)]
    nearest = lambda: [[min((sum((a - b) ** 2 for a, b in zip(part(x, p), e)), j) for j, e in enumerate(books[p])) for p in range(8)] for x in ints]
    for _ in range(rounds):
        at = nearest()
        for p in range(8):
            for j in range(len(books[p])):
                mine = [part(x, p) for x, row in zip(ints, at) if row[p][1] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    at, by = nearest(), defaultdict(int)
    for (_, _, x), row in zip(kept, at):
        by[x] += sum(d for d, _ in row)
    most, digest = 2**63 - 1, sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{j:02x}" for _, j in row), min(most, sum(d for d, _ in row)), min(most, by[x]), digest) for (i, _, x), row in zip(kept, at)], key=str)


def vectors(rng, kind):
    """(vec_id, vector, label): ties everywhere; bad components; repeated and null ids; other lengths; components of any size."""
    odd = [(7, None, 1), (8, [None] * 16, 1), (9, [math.nan] * 16, 2), (9, [math.inf] * 16, 2), (None, [0.5] * 16, None), (3, [0.25] * 16, 2), (3, [0.25] * 16, 2)]
    if kind == "ties":
        return [(i, [rng.choice([-1.0, 0.0, 0.25, 1.0]) for _ in range(16)], i % 3 or None) for i in range(200)] + odd
    if kind == "few":
        return odd
    if kind == "huge":
        return [(i, [float(np.float32(rng.gauss(0, 10.0 ** rng.choice([0, 3, 9, 20])))) for _ in range(8)], i % 2) for i in range(120)]
    return [(i, [float(np.float32(rng.gauss(i % 7, 0.3))) for _ in range(rng.choice([9, 16, 3]))], 0) for i in range(150)]


@pytest.mark.parametrize("kind", ["ties", "few", "huge", "lengths"])
def test_op12_against_plain_lloyd(spark, kind):
    rows = vectors(random.Random(5), kind)
    made = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, kept string").repartition(3)
    got = op12_codes.encode_vectors(made).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == lloyd(rows)
    if kind == "few":
        named = made.withColumn("vec_id", made["vec_id"].cast("string")).withColumn("label", made["label"].cast("string"))
        assert sorted(r.code for r in op12_codes.encode_vectors(named).collect()) == sorted(r[1] for r in lloyd(rows))
        assert op12_codes.encode_vectors(made.limit(0)).count() == 0
        assert op12_codes.encode_vectors(made.where("vec_id = 7")).count() == 0


def test_op12_bounds_spare_scans():
    """Rounds by bounds give what full scans give, and look at a part of the groups only once entries settle."""
    rng = np.random.default_rng(3)
    x = rng.integers(-4000, 4000, (40, 8))[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 8))
    x = x.astype(np.int64).reshape(3000, 2, 4)
    start = np.ascontiguousarray(x[:16].transpose(1, 0, 2))
    books = op12_codes.Codebooks(start, op12_codes.grouped(start, 4))
    code, upper, lower = op12_codes.full_scan(x, books)
    scans = []
    for _ in range(8):
        before, made = books, books.entries.copy()
        for p, j in np.ndindex(2, 16):
            mine = x[code[:, p] == j, p]
            if len(mine):
                made[p, j] = mine.sum(0) // len(mine)
        books = op12_codes.Codebooks(made, books.groups)
        drift = op12_codes._root(op12_codes.squared(books.entries, before.entries)) * (1 + op12_codes.RELATIVE) + op12_codes.ABSOLUTE
        scans.append(op12_codes.rescan(x, code, upper, lower, books, drift))
        assert (code == op12_codes.full_scan(x, books)[0]).all()
        far = op12_codes.full_scan(x, books)[2]
        assert (lower <= far + 1e-3).all()
    assert scans[-1] < 0.5 * 3000 * 2 * 4


def targets(rows):
    """Sizes and targets of sources, share by share."""
    size, order = defaultdict(int), sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    weight, full = {s: (3, 1, 2)[n % 3] for n, s in enumerate(order)}, set()
    while True:
        rest, weights = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full), sum(w for s, w in weight.items() if s not in full)
        more = {s for s in order if s not in full and weight[s] * rest / weights >= 2 * size[s]} if weights else set()
        if not more:
            return {s: (size[s], 2.0 * size[s] if s in full else weight[s] * rest / weights) for s in order}
        full |= more


@pytest.mark.parametrize("kind", ["sources", "one", "hot", "empty texts"])
def test_op13_meets_targets(spark, monkeypatch, kind):
    monkeypatch.setattr(op13_mixing, "BUCKET", 7)
    rng = random.Random(kind)
    text = lambda: "w " * rng.choice([0, 1, 2, 10, 300, 5000])
    rows = [(i, text(), rng.choice(["é", "b", "c", "Z", "", None, "𐀀", "�"])) for i in range(400)]
    if kind == "one":
        rows = [(i, text(), "s") for i in range(30)]
    if kind == "hot":
        rows = [(i, text(), rng.choice(["a", "a", "a", f"s{i % 50}"])) for i in range(600)] + [(5, "same words", "a")] * 50
    if kind == "empty texts":
        rows = [(1, None, "a"), (2, "", "b"), (None, " \t", None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, kept string, size int")
    got, want = op13_mixing.mix(docs.repartition(4)).collect(), targets(rows)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(WORD.findall(t or ""))) for i, t, _ in rows)
    source_of, taken = {(i, len(WORD.findall(t or ""))): s for i, t, s in rows}, defaultdict(int)
    for r in got:
        source = source_of[r.doc_id, r.size]
        taken[source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == want[source][0]
        assert r.target == pytest.approx(want[source][1]) and abs(r.taken - r.rate * r.size) <= r.size
    assert all(abs(taken[s] - t) <= 0.5 + 1e-6 * t for s, (_, t) in want.items())
    again = op13_mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    # rates are the tilted ones: log(rate) is proportional to the size, where it is not at its limit
    for s in want:
        slopes = [math.log(r.rate) / r.size for r in got if r.size and source_of[r.doc_id, r.size] == s and 0 < r.rate < 2]
        assert not slopes or max(slopes) - min(slopes) < 1e-9


def test_op13_refuses_and_takes_nothing_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id string, text string, source string")
    assert op13_mixing.mix(docs).count() == 0
    with pytest.raises(ValueError):
        op13_mixing.mix(docs, percent=201)


def test_new_queries_have_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    want = {"op11_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"], "op12_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"], "op13_source_mix": ["doc_id", "size", "source_size", "target", "taken", "rate", "copies"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, sf).columns == columns
