import random

import pytest

from assay.llm import tokens

ODD = ["", None, "a", " ", "   x", "\n\n\n", "don't we'll", "naïve 🇫🇷👩‍👩‍👧 ﬁ", "<|endoftext|>", "x" * 5000, "word " * 3000, " " * 4000 + "end", "会議は三時から" * 400, "1234567890" * 500, "à" * 900, " \u0085  "]


@pytest.fixture(scope="module")
def encode():
    return tokens.byte_encoding("byte_bpe_50k").encode_ordinary


def noise(seed):
    rng = random.Random(seed)
    parts = ["hello", " ", "  ", "\n", "'s", "'re", "12", "...", "é", "\t", "ab", "_", "日", "'"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(300, 3000)))


def test_ids_with_tiny_chunks_equal_whole_encoding(spark, encode):
    texts = ODD + [noise(i) for i in range(40)] + [noise(1), "word " * 3000]
    df = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spec = tokens.ChunkSpec(chunk=64, overlap=24)
    got = tokens.token_ids(df, "text", spec=spec).collect()
    want = {None if i == 3 else i: encode(t) if t else [] for i, t in enumerate(texts)}
    assert len(got) == len(texts) and {r.doc_id: list(r.ids) for r in got} == want
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, "text", spec=spec).collect()}
    assert counts == {k: len(v) for k, v in want.items()}
    assert all(tokens.decode(v) == (texts[k] or "") for k, v in want.items() if k is not None)


def test_the_same_ids_as_the_other_library(encode):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in [t for t in ODD if t] + [noise(i) for i in range(60)]:
        assert other.encode(text, add_special_tokens=False).ids == encode(text)


def test_cut_lies_on_a_true_boundary():
    for seed in range(200):
        text = noise(seed)
        true = set(tokens.boundaries(text, 0, len(text), 0))
        start = 150
        before = tokens.boundaries(text, 0, min(len(text), start + 40), start)
        after = [start, *tokens.boundaries(text, start, len(text), start)]
        at = tokens.shared_cut(before, after)
        assert at is None or at in true


def test_repeated_rows_empty_table_and_clashing_column(spark):
    df = spark.createDataFrame([(1, "a " * 200, "x")] * 3, "doc_id long, text string, ids string")
    got = tokens.token_ids(df, "text", spec=tokens.ChunkSpec(chunk=32, overlap=8)).collect()
    assert len(got) == 3 and len({tuple(r.ids) for r in got}) == 1
    assert tokens.token_ids(df.limit(0), "text").count() == 0
    clash = spark.createDataFrame([("mine", 5, {"a": 1}, "word " * 100), (None, None, None, "word " * 90), ("mine", 5, None, "short")], "_text string, _row int, _k0 map<string,int>, body string")
    got = tokens.token_counts(clash, "body", spec=tokens.ChunkSpec(chunk=32, overlap=8)).collect()
    assert sorted((str(r._text), r._row or 0, str(r._k0), r.n_tokens) for r in got) == [("None", 0, "None", 91), ("mine", 5, "None", 1), ("mine", 5, "{'a': 1}", 101)]
    other = spark.createDataFrame([("mine", "k", 7, "word " * 100), ("mine", "k", 7, "short")], "text string, text_key string, no int, body string")
    got = tokens.token_counts(other, "body", spec=tokens.ChunkSpec(chunk=32, overlap=8)).collect()
    assert sorted((r.text, r.text_key, r.no, r.n_tokens) for r in got) == [("mine", "k", 7, 1), ("mine", "k", 7, 101)]


def test_texts_without_shared_boundaries_are_put_together_again(spark, encode):
    """Runs of letters longer than an overlap leave chunks without a common boundary; two rows share a text."""
    texts = ["x" * 300 + " end", "ab " * 40 + "y" * 100 + " cd" * 60, "z" * 64, "x" * 300 + " end", "ab " * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: list(r.ids) for r in tokens.token_ids(df, "text", spec=tokens.ChunkSpec(chunk=40, overlap=8)).collect()}
    assert got == {i: encode(t) for i, t in enumerate(texts)}


def test_long_texts_are_shuffled_once(spark):
    df = spark.createDataFrame([(i, "some words " * 50) for i in range(20)], "doc_id long, text string")
    plan = tokens.token_ids(df, "text", spec=tokens.ChunkSpec(chunk=40, overlap=8))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_row") <= 2 and "piece" not in "".join(line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line)
