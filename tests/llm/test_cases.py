"""Odd inputs for every operator and stage: empty tables, nulls, repeated rows, large and non-numeric ids, clashing names."""

import uuid

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import op1_urls, op2_media, op3_quality, op4_bpe, op5_packing, op6_lm, op7_langid, op8_simhash, op9_chat, op10_minhash

RANKS, PIECES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
LARGE = 9007199254740993
NAMES = ("kept", "text_", "_text", "score", "lang_pred", "row", "id", "node", "fp", "queue", "part", "teach", "label", "rank", "digest", "_row", "html", "_bucket")
TEXTS = [(None, "one two three four five six"), (LARGE, "one two three four five six seven"), (7, "Das ist ein Haus und ein Garten"), (7, "another text with the same id"), (7, "another text with the same id"), (LARGE + 2, None), (9, ""), (None, None), (11, "12 34 -- ??"), (12, "x" * 5000 + " y")]


def table(spark, kind="long", rows=TEXTS):
    """documents with extra columns whose names the code might use."""
    schema = f"doc_id {kind}, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    one = lambda i: None if i is None else i if kind == "long" else f"id-{i}"
    made = [(one(i), t, "en" if t and "t" in t else "de", None if n % 3 else "s", len(t or ""), *["clash"] * len(NAMES)) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, schema).coalesce(1)


def labels(spark, kind="long"):
    return spark.createDataFrame([(7 if kind == "long" else "id-7", 1, 0), (9 if kind == "long" else "id-9", 0, 0), (None, 1, 1)], f"doc_id {kind}, quality int, toxic int")


def conversations(docs):
    return docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), "text", *NAMES)


def pages(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("u://a.org/"), "text").alias("url"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html_"), *[n for n in NAMES if n != "html"])


OPERATORS = {
    "op1": lambda s, d: op1_urls.judge_urls(pages(d), s.createDataFrame([("org", "/", "allow")], "host string, path string, verdict string")),
    "op2": lambda s, d: op2_media.interleaved(op2_media.sequences(pages(d), html_col="html_"), op2_media.describe_media(op2_media.store_media(d))),
    "op3": lambda s, d: op3_quality.score_quality(d, op3_quality.train_quality_model(d, labels(s, dict(d.dtypes)["doc_id"].replace("bigint", "long")), steps=5)),
    "op4": lambda s, d: op4_bpe.digest_documents(d, RANKS, P.PATTERN),
    "op4_round_trip": lambda s, d: op4_bpe.decode_documents(op4_bpe.encode_documents(d, RANKS, P.PATTERN), RANKS, P.PATTERN),
    "op5": lambda s, d: op5_packing.pack(d, PIECES, 1).groupBy("doc_id", "doc_tokens", "sequence_id", "offset", "start").count().drop("count"),
    "op6": lambda s, d: op6_lm.score_documents(d),
    "op7": lambda s, d: op7_langid.predict_languages(d, op7_langid.train_language_model(d, steps=5), keep=("score", "row")),
    "op8": lambda s, d: op8_simhash.link_close(d),
    "op8_near": lambda s, d: op8_simhash.near_duplicate_groups(d),
    "op9": lambda s, d: op9_chat.digest_conversations(conversations(d)),
    "op9_format": lambda s, d: op9_chat.format_conversations(conversations(d)).select("conv_id").distinct(),
    "op10": lambda s, d: op10_minhash.edited_neighbours(d),
}
ONE_ROW_AN_ID = ("op9", "op9_format")


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators_take_odd_rows(spark, name):
    """A result for each row, with the very id; nothing for an empty table."""
    for kind in ("long", "string") if name != "op10" else ("long",):
        docs = table(spark, kind)
        got = OPERATORS[name](spark, docs)
        ids = [r[0] for r in got.collect()]
        want = [r.doc_id for r in docs.collect()]
        if name in ONE_ROW_AN_ID:
            want = list(set(want))
        assert sorted(map(str, ids)) == sorted(map(str, want))
    assert OPERATORS[name](spark, table(spark, "long", [])).count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, tmp_path, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark)
    out = run(spark, docs, str(tmp_path))
    kept = [(r.doc_id, r.text) for r in out.collect()] if stage != "packing" else [(r.doc_id, None) for r in out.collect()]
    if stage != "packing":
        assert out.columns == docs.columns
        assert set(kept) <= set(TEXTS)
    if stage == "language_id":
        assert sorted(kept, key=str) == sorted([x for x in TEXTS if x[1] and any(c.isalpha() for c in x[1])], key=str)
    if stage == "near_duplicates":
        want = [(None, "one two three four five six"), (LARGE, "one two three four five six seven"), *TEXTS[2:4], (9, ""), *TEXTS[8:]]
        assert sorted(kept, key=str) == sorted(want, key=str)
    if stage == "packing":
        assert sorted(kept, key=str) == sorted([(i, None) for i, _ in TEXTS], key=str)
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_keep_all_where_nothing_can_be_learned(spark, tmp_path):
    spark.createDataFrame([(7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = table(spark).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_languages(spark, docs, str(tmp_path)).count() == 6
    assert corpus_pipeline.keep_quality(spark, docs, str(tmp_path)).count() == len(TEXTS)


def test_op2_sequences_of_one_id_and_malformed_pages(spark):
    rows = [(1, "<p>a</p>"), (1, "<p>a</p>"), (2, "<head><title>t<body><p>b</p>"), (3, "<figure><img src='sha256:00'><figcaption>cap"), (4, "<figure><img src='sha256:00'><figcaption>cap</figure><p>after"), (5, "<figcaption>alone</figcaption><script>x")]
    parsed = op2_media.sequences(spark.createDataFrame(rows, "page_id long, html string"))
    media = spark.createDataFrame([], "digest string, n_bytes long")
    got = sorted((r.page_id, [(i.position, i.kind, i.text, i.caption) for i in r.sequence]) for r in op2_media.interleaved(parsed, media).collect())
    assert got == [
        (1, [(0, "text", "a", None)]), (1, [(0, "text", "a", None)]), (2, [(0, "text", "b", None)]), (3, [(0, "image", None, "cap")]),
        (4, [(0, "image", None, "cap"), (1, "text", "after", None)]), (5, [(0, "text", "alone", None)]),
    ]


def test_op6_fails_rather_than_mixing_blocks(spark):
    """A table that gives other rows each time that it is read."""

    def other(batches):
        for batch in batches:
            yield batch.assign(text=[f"{t} {uuid.uuid4()}" for t in batch["text"]])

    docs = table(spark).select("doc_id", "text").mapInPandas(other, "doc_id long, text string")
    with pytest.raises(Exception, match="two orders"):
        op6_lm.score_documents(docs).collect()
