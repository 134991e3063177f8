"""Plans of packing with many small queues, samples that a large text can't empty, and the template language."""

import random
import tracemalloc

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from cadenza.llm import op3_quality, op5_packing, op6_lm, op7_langid, op9_chat

PIECES = P.path("word_bpe_49k.json")


def packed(totals, weights, window, sequence, cuts=7):
    """(slot, queue, k-th token) of every token, queues cut into documents of a few tokens."""
    phases = op5_packing.plan_phases(totals, weights, window)
    out = []
    for queue, n in totals.items():
        for start in range(0, n, cuts):
            length = min(cuts, n - start)
            pieces = op5_packing.place(phases, queue, start, length, window, sequence)
            assert [p[0] for p in pieces] == list(np.cumsum([0, *[p[1] for p in pieces]]))[:-1] and sum(p[1] for p in pieces) == length
            assert all(slot // sequence == (slot + size - 1) // sequence for _, size, slot in pieces)
            out += [(slot + i, queue, start + done + i) for done, size, slot in pieces for i in range(size)]
    return sorted(out), phases


@pytest.mark.parametrize("seed", range(40))
def test_op5_plans_with_small_weights_have_no_overlap_and_no_hole(seed):
    rng = random.Random(seed)
    totals = {"a": rng.randint(2000, 6000), "b": rng.randint(2000, 6000)} | {f"s{i:02}": rng.randint(1, 60) for i in range(rng.randint(1, 40))}
    weights = rng.choice([None, {q: rng.choice([1.0, 50.0, 500.0]) if q in "ab" else rng.choice([0.01, 0.1, 1.0]) for q in totals}])
    window = rng.choice([64, 256, 1024])
    got, phases = packed(totals, weights, window, 64)
    assert [s for s, _, _ in got] == list(range(sum(totals.values())))
    order = {}
    for _, queue, k in got:  # queues are served in order
        assert order.get(queue, -1) < k
        order[queue] = k
    for phase in phases:
        rows = [(s - phase.start, q) for s, q, _ in got if phase.start <= s < phase.start + phase.length]
        for queue, (_, _, amount) in phase.queues.items():
            for w in range(phase.length // window):
                n = sum(q == queue for s, q in rows[w * window : (w + 1) * window])
                assert abs(n - window * amount / phase.length) < 3


def test_op5_places_of_small_queues_are_found_by_arithmetic():
    """As sorting finds them; and for a queue of ten million tokens without listing them."""
    rng = random.Random(6)
    for _ in range(300):
        whole = rng.randint(1, 400)
        amount = rng.randint(1, whole)
        steps = op5_packing.Steps(rng.randint(0, whole - amount), amount, whole)
        want = sorted((steps.below + j) * steps.step % whole for j in range(amount))
        start = rng.randint(0, amount - 1)
        assert list(steps.places(start, amount - start)) == want[start:]
    tracemalloc.start()
    steps = op5_packing.Steps(10**8, 10**7, 10**9 + 7)
    places = list(steps.places(9_999_000, 1000))
    assert tracemalloc.get_traced_memory()[1] < 2_000_000
    tracemalloc.stop()
    assert places == sorted(places) and places[-1] == max(places) and steps.before(places[0]) == 9_999_000 and steps.before(places[-1] + 1) == 10**7
    assert all((p * pow(steps.step, -1, steps.whole) - steps.below) % steps.whole < steps.amount for p in places)


def test_op5_packs_listed_small_sources(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 14}") for i in range(300)] + [(300 + i, "long text " * 300, "large") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    weights = {"large": 0.99} | {f"s{i}": 0.0005 * (i + 1) for i in range(12)}
    for window in (1, 4, None):
        got = op5_packing.pack(docs, PIECES, 1, sequence=64, window_sequences=window, weights=weights).toPandas().sort_values(["sequence_id", "offset"])
        slots = (got.sequence_id * 64 + got.offset).to_numpy()
        assert (slots == np.concatenate([[0], np.cumsum(got.length)[:-1]])).all()
        assert got.groupby("doc_id").length.sum().equals(got.groupby("doc_id").doc_tokens.first())


def test_op5_window_grows_with_queues(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 40).alias("text"), F.concat(F.lit("s"), F.col("id") % 400).alias("source"))
    assert op5_packing.pack(docs, PIECES, 1, sequence=64).count() < 0.6 * op5_packing.pack(docs, PIECES, 1, sequence=64, window_sequences=16).count()


def test_ids_named_as_results_are_refused(spark):
    docs = spark.createDataFrame([(1, 2.0, "a", "s")], "start long, score double, text string, source string")
    with pytest.raises(ValueError):
        op5_packing.pack(docs, PIECES, 1, id_col="start")
    with pytest.raises(ValueError):
        op6_lm.score_documents(docs, id_col="score")


def test_a_large_text_does_not_empty_the_sample(spark, monkeypatch):
    rows = spark.createDataFrame([(0, "a", "x" * 50_000)] + [(i, "ab"[i % 2], "text " * 100) for i in range(1, 41)], "rank long, label string, text string")
    got = op7_langid.sample_of(rows, 1.0, 100, 15_000)
    assert len(got) == 30 and set(got.text.str.len()) == {500}
    assert len(op7_langid.sample_of(rows, 1.0, 100, 10)) == 1 and len(op7_langid.sample_of(rows.limit(0), 1.0, 100)) == 0
    monkeypatch.setattr(op7_langid.sample_of, "__defaults__", (30_000,))
    docs = spark.createDataFrame([(i, ("der die das " if i % 2 else "the of and ") * (5000 if i == 3 else 10), "de" if i % 2 else "en") for i in range(60)], "doc_id long, text string, lang string")
    model = op7_langid.train_language_model(docs, steps=60)
    assert model.languages == ["de", "en"] and all(r.lang_pred == ("de" if r.doc_id % 2 else "en") for r in op7_langid.predict_languages(docs, model).collect())
    assert op3_quality.train_quality_model(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("quality")), steps=5).net is not None


def rendered(template, messages=(("user", "hi"), ("assistant", "yo"), ("user", "end")), **names):
    program = op9_chat.compile_template(template)
    return "".join(c for c, _ in program({"messages": ({"role": r, "text": t} for r, t in messages), **names}))


@pytest.mark.parametrize(
    "template, want",
    [
        ("a \n{%- if true -%}\n b{% endif %}", "ab"),
        ("x {{- 'y' -}} z {#- note -#} !", "xyz!"),
        ("{% for m in messages %}1{% endfor %}{% for m in messages %}2{% endfor %}", "111222"),
        ("{{ messages[0]['role'] }}:{% for m in messages %}{{ m.text }}{% if not loop.last %},{% endif %}{% endfor %}", "user:hi,yo,end"),
        ("{% for m in messages %}{{ loop.index }}{{ loop.index0 }}{% if loop.first %}f{% endif %} {% endfor %}{{ messages[1].text }}", "10f 21 32 yo"),
        ("{{ messages | length }}{{ messages[-1].text }}{% for m in messages[1:] %}{{ m.role[0:1] }}{% endfor %}", "3endau"),
        ("{% if false %}{{ 1 + 'a' }}{% endif %}ok", "ok"),
        ("{% if x is defined %}{{ x }}{% else %}none{% endif %}{% if messages[0].tool is defined %}t{% endif %}", "none"),
        ("{% if messages[0].role in ['user'] %}{% endif %}", None),
        ("{% for m in messages %}{% if m.text in 'hi there' and m.role is not none %}{{ m.text | upper }}{% endif %}{% if 'z' not in m.text %}.{% endif %}{% endfor %}", "HI..."),
        ("{% for m in messages %}{% for n in messages %}{{ n.text }}{% endfor %};{% endfor %}", "hiyoend;hiyoend;hiyoend;"),
        ("{% for loop in messages %}{% endfor %}{% set messages = 'q' %}{{ messages }}", "q"),
    ],
)
def test_op9_template_language(template, want):
    if want is None:
        with pytest.raises(op9_chat.TemplateError):
            rendered(template)
    else:
        assert rendered(template) == want


def test_op9_reads_as_little_as_the_template_needs():
    """One pass is a stream: the first chunks come before the last messages are read."""
    read = []

    def stream():
        for i in range(1000):
            read.append(i)
            yield {"role": "user", "text": str(i)}

    chunks = op9_chat.compile_template("{{ messages[0].text }}{% for m in messages %}{{ m.text }}{% endfor %}")({"messages": stream()})
    assert next(chunks) == ("0", False) and len(read) == 1
    assert op9_chat.needs(op9_chat.parse("{{ messages[2].text }}{% for m in messages %}{% endfor %}")) == op9_chat.Need(3, False)
    assert op9_chat.needs(op9_chat.parse("{% for m in messages %}{{ messages | length }}{% endfor %}")).all


def test_op9_ends_for_ids_that_are_no_numbers_and_templates_without_messages(spark):
    rows = [(float("nan"), 0, "user", "a"), (float("nan"), 1, "assistant", "b"), (1.0, 0, "user", "c"), (None, 0, "user", "d"), (2.0, 0, "user", "e"), (2.0, 1, "user", "f")]
    table = spark.createDataFrame(rows, "conv_id double, turn long, role string, text string")
    assert sorted((str(r.conv_id), r.n_turns) for r in op9_chat.digest_conversations(table).collect()) == [("1.0", 1), ("2.0", 2), ("None", 1), ("nan", 2)]
    assert sorted((str(r.conv_id), r.chunk) for r in op9_chat.format_conversations(table, "hi").collect()) == [("1.0", "hi"), ("2.0", "hi"), ("None", "hi"), ("nan", "hi")]
    assert sorted((str(r.conv_id), r.chunk) for r in op9_chat.format_conversations(table, "{{ messages[0].text }}").collect()) == [("1.0", "c"), ("2.0", "e"), ("None", "d"), ("nan", "a")]
