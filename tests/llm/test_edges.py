"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import bagminhash, bpe, chat, decontam, fmindex, langid, ngramlm, repetition, seekable, toxicity

LONG = " ".join(f"word{i % 5003}" for i in range(60_000))
ROWS = [
    (1, "plain words of a short text", "en"), (1, "plain words of a short text", "en"), (2, "", "en"), (3, None, "de"), (None, "text without an id that is here", None),
    (4, "   \n\t ", "en"), (5, LONG, "en"), (6, "plain words of a short text", "fr"), (None, None, None), (7, "ein kurzer deutscher Satz mit Wörtern", "de"), (8, "x" * 5000, "en"), (9, "é🙂 日本 \u0000 ok", "fr"),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    extra = {n: F.lit(k) for k, n in enumerate(("score", "h", "keep", "doc", "__c0", "__gone", "block", "TOKENS", "shard", "key", "n", "a", "b"))}
    return df.withColumns(extra).select("score", "text", "h", "doc_id", *[c for c in extra if c not in ("score", "h")], "lang").withColumn("n_chars", F.length("text"))


@pytest.fixture(scope="module")
def empty(rows):
    return rows.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "nothing like this item is in any of the texts that are here, it is long enough"), (2, None), (None, "x" * 100), (3, "short")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 1), (None, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda d, b, l: toxicity.toxic(d, l),
    "repetition": lambda d, b, l: repetition.annotate(d),
    "repetition keep": lambda d, b, l: repetition.keep(d),
    "langid": lambda d, b, l: langid.detect(d),
    "duplicates": lambda d, b, l: bagminhash.duplicates(d),
    "deduplicate": lambda d, b, l: bagminhash.deduplicate(d),
    "bpe": lambda d, b, l: bpe.encode(d),
    "decontam": lambda d, b, l: decontam.matches(d, b),
    "decontam clean": lambda d, b, l: decontam.clean(d, b),
    "repeats": lambda d, b, l: fmindex.repeats(d),
    "remove": lambda d, b, l: fmindex.remove(d),
    "lm": lambda d, b, l: ngramlm.scores(d, d),
    "seekable": lambda d, b, l: seekable.write_shared(d),
}


def _ids(out):
    return sorted(str(r["doc_id"]) for r in out)


ALL = sorted(str(d) for d, *_ in ROWS)
#: What each operator gives for the odd rows: ids, or what else is defined.
EXPECTED = {
    "toxicity": lambda out: out == [],
    "repetition": lambda out: _ids(out) == ALL and {r["keep"] for r in out if r["doc_id"] != 5} == {True} and not next(r for r in out if r["doc_id"] == 5)["keep"],
    "repetition keep": lambda out: _ids(out) == [d for d in ALL if d != "5"],
    "langid": lambda out: _ids(out) == ALL and all(r["lang"] in ("en", "de", "fr", "und") and (r["confidence"] is None) == (r["words"] == 0) == (r["lang"] == "und") for r in out) and all(0 <= r["confidence"] <= 1 for r in out if r["words"]),
    "duplicates": lambda out: [(r["doc_id"], r["duplicate_of"]) for r in out] == [(6, 1)],
    "deduplicate": lambda out: _ids(out) == ["1", "2", "3", "4", "5", "7", "8", "9", "None", "None"],
    "bpe": lambda out: _ids(out) == ALL and all((r["tokens"] is None) == (r["round_trip"] is None) for r in out) and all(r["round_trip"] for r in out if r["tokens"] is not None) and sum(r["tokens"] is None for r in out) == 2,
    "decontam": lambda out: sorted(tuple(r) for r in out) == [(1, 3, 0), (6, 3, 0)],
    "decontam clean": lambda out: _ids(out) == [d for d in ALL if d not in ("1", "6")],
    "repeats": lambda out: [(r["doc_id"], r["start"], r["end"]) for r in out] == [(5, 0, len(LONG))],
    "remove": lambda out: _ids(out) == ALL and next(r for r in out if r["doc_id"] == 5)["text"] == " ".join(LONG.split()[:5003]) and all(r["text"] == dict((d, t) for d, t, _ in ROWS)[r["doc_id"]] for r in out if r["doc_id"] not in (5, None)),
    "lm": lambda out: _ids(out) == ["1", "2", "3", "4", "5", "6", "7", "8", "9"] and next(r for r in out if r["doc_id"] == 5)["words"] == 59_999 and all((r["perplexity"] is None) == (r["words"] == 0) for r in out),
    "seekable": lambda out: _ids(out) == ALL and sum(r["n_tokens"] is None for r in out) == 2 and all(r["n_tokens"] == 0 for r in out if r["doc_id"] == 2),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(rows, bench, labels, name):
    assert EXPECTED[name](OPERATORS[name](rows, bench, labels).collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(empty, bench, labels, name):
    assert OPERATORS[name](empty, bench.limit(0), labels.limit(0)).collect() == []


def test_defined_results(rows, spark):
    assert {r["doc_id"]: r["duplicate_of"] for r in bagminhash.duplicates(rows).collect()} == {6: 1}
    kept = bagminhash.deduplicate(rows)
    assert kept.columns == rows.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "9", "None", "None"])
    got = {r["doc_id"]: r for r in bpe.encode(rows).collect()}
    assert got[3]["tokens"] is None and got[2]["tokens"] == [] and got[9]["round_trip"] and got[5]["round_trip"]
    assert {r["doc_id"]: r["lang"] for r in langid.detect(rows).collect()}[2] == "und"
    lm = {r["doc_id"]: r for r in ngramlm.scores(rows, rows).collect()}
    assert lm[1]["words"] == 10 and lm[6]["matched"] == 5 and lm[2]["words"] == 0 and lm[2]["perplexity"] is None
    spans = fmindex.repeats(spark.createDataFrame([(1, LONG), (1, LONG), (2, "a b")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["start"], r["end"]) for r in spans] == [(1, 0, len(LONG))]


def test_chat_edges(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 1, "assistant", "a1"), (1, 2, "user", None), (1, 3, "assistant", "a<|im_end|>2"), (2, 0, "user", "only"), (None, 0, "assistant", "x"), (3, None, "assistant", ""), (4, 0, None, "t"), (4, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit(1)).withColumn("n", F.lit(2))
    got = {r["pair_id"]: r for r in chat.format_preferences(chat.pairs_of(df)).collect()}
    assert sorted(got) == [1, 3, 4] and got[1]["prompt_turns"] == 3
    assert got[1]["chosen"] == "<|im_start|>assistant\na< |im_end|>2<|im_end|>\n" and got[1]["rejected"].count("a1") == 1
    for r in got.values():
        assert len(r["chosen"]) == len(r["chosen_mask"]) and len(r["rejected"]) == len(r["rejected_mask"])
    assert got[3]["chosen"] == got[3]["rejected"] == "" and got[3]["prompt_turns"] == 1
    assert chat.format_preferences(chat.pairs_of(df.limit(0))).collect() == []
    pairs = spark.createDataFrame([(1, None, None), (2, [("user", "a")], [("user", "a"), ("assistant", "b")])], "pair_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r["pair_id"]: r for r in chat.format_preferences(pairs).collect()}
    assert got[1]["prompt"] == "" and got[2]["chosen"] == "" and got[2]["rejected_mask"].count("1") == len("b<|im_end|>\n")


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, rows, empty, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, rows, "/root/testdata/sf0.001")
    got = _ids(out.collect())
    if k < 4:
        assert out.columns == rows.columns
    want = {"quality_rules": [d for d in ALL if d != "5"], "near_dedup": ["1", "2", "3", "4", "5", "7", "8", "9", "None", "None"]}
    assert got == want.get(name, ALL)
    none = stage(spark, empty, "/root/testdata/sf0.001")
    assert none.count() == 0 and (k == 4 or none.columns == rows.columns)
