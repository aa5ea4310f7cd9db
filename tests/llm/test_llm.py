import unicodedata

import numpy as np
import pytest
import tiktoken

from tripwright.llm.encoding import PIECE, _SAFE, decode, decoded, encode, encoded, encoder, pieces
from tripwright.llm.lookalike import ALIKE, Model, alike_classes, alike_pairs, learn, pair_counts, prepared, unified, visible
from tripwright.llm.mixing import drawn, filled, mix, permuted, shard_counts

NAME = "byte_bpe_50k"
DOCS = "doc_id bigint, source string, text string, extra string"
TEXTS = ["It's 42 m² here's", "", None, " ", "a" * 30_000, "x1" * 20_000, " \n\t" * 9_000 + "end", "Größe 😀👨‍👩‍👧 日本語", "<|endoftext|>", "don't stop'9s 'll " * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    return encoder(NAME)


def test_pieces_do_not_change_ids(tokenizer):
    for text in TEXTS:
        if text:
            assert "".join(pieces(text, 7)) == text
            assert [i for p in pieces(text, 7) for i in tokenizer.encode_ordinary(p)] == tokenizer.encode_ordinary(text)
            assert encode(text, tokenizer) == tokenizer.encode_ordinary(text)
    rng = np.random.default_rng(0)
    letters = list("ab'sl 12\n\t²é日. ​")
    for _ in range(300):
        text = "".join(rng.choice(letters, 60))
        assert [i for p in pieces(text, 1) for i in tokenizer.encode_ordinary(p)] == tokenizer.encode_ordinary(text)
    assert PIECE > 1000 and _SAFE.search("ab") is None and isinstance(tokenizer, tiktoken.Encoding)


def test_a_vocabulary_without_a_known_pattern_is_refused():
    with pytest.raises(ValueError, match="pattern"):
        encoder("other_bpe")
    assert encode("日本語 x", encoder("byte_bpe_multi_50k")) != encode("日本語 x", encoder(NAME))


def test_same_ids_as_the_other_library(tokenizer):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in TEXTS:
        if text and len(text) < 2000:
            assert encode(text, tokenizer) == other.encode(text, add_special_tokens=False).ids


def test_round_trip_in_spark(spark):
    docs = spark.createDataFrame([(i, "s", t, None) for i, t in enumerate(TEXTS)] + [(None, "s", "twice", None)] * 2, DOCS)
    ids = encoded(docs, "doc_id", "text", NAME)
    assert ids.columns == ["doc_id", "ids"] and ids.count() == len(TEXTS) + 2
    got = {r.doc_id: bytes(r.raw).decode() for r in decoded(ids, "doc_id", NAME).collect() if r.doc_id is not None}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}
    assert encoded(docs.limit(0), "doc_id", "text", NAME).count() == 0
    tok = encoder(NAME)
    raw = "日本".encode()
    some = encode("日本", tok)
    assert decode(some, tok) == raw and raw.startswith(decode(some[:1], tok))


def test_permutations():
    for size in (1, 2, 3, 17, 1000):
        for key in (0, 5):
            assert sorted(permuted(np.arange(size), size, key).tolist()) == list(range(size))
    assert (permuted(np.arange(100), 100, 1) != permuted(np.arange(100), 100, 2)).any()


def test_shards_draw_to_the_quotas():
    quota = np.array([700, 250, 50, 0, 24])
    for seed in (0, 1):
        every = [shard_counts(quota, i, 16, seed, 64) for i in range(16)]
        assert (sum(n for n, _ in every) == quota).all() and all(n.sum() == 64 for n, _ in every)
        assert all((b == sum((n for n, _ in every[:i]), np.zeros(5, np.int64))).all() for i, (_, b) in enumerate(every))
    # the last shards are drawn like the others
    runs = np.array([[shard_counts(quota, i, 16, seed, 64)[0] for i in range(16)] for seed in range(200)], float)
    assert np.abs(runs.mean(axis=0) - 64 * quota / 1024).max() < 1.5 and np.ptp(runs.std(axis=0)[:, 0]) < 1.2
    big = drawn(np.array([6 * 10**11, 3 * 10**11, 10]), 5 * 10**11, np.random.default_rng(0))
    assert big.sum() == 5 * 10**11 and abs(big[0] / big.sum() - 2 / 3) < 1e-4


def test_filling_to_caps():
    assert filled(np.array([0.5, 0.5, 0.0]), np.array([100.0, 10.0, 50.0]), 80.0).tolist() == [70.0, 10.0, 0.0]
    assert filled(np.array([0.5, 0.5]), np.array([10.0, 10.0]), 80.0).tolist() == [10.0, 10.0]
    assert filled(np.array([1.0]), np.array([0.0]), 8.0).tolist() == [0.0]


TARGETS = "source string, target_weight double, max_repeats int"


def test_mixture(spark):
    docs = [(i, "big", f"word{i} and some more words of it " * 20, None) for i in range(200)]
    docs += [(1000 + i, "small", f"tiny{i} text " * 30, None) for i in range(10)] + [(2000, "none", "no target", None), (2001, None, "x", None), (2002, "big", None, None), (2003, "big", "", None)]
    targets = spark.createDataFrame([("big", 0.6, 3), ("small", 0.4, 2), ("absent", 0.1, 2), ("none", 0.0, 9), (None, 0.5, 1)], TARGETS)
    m = mix(spark.createDataFrame(docs, DOCS), targets, NAME, block=64)
    rows = m.rows().collect()
    shares = {r.source: r for r in m.shares.collect()}
    assert set(shares) == {"big", "small", "absent", "none"} and shares["absent"].mixed_tokens == 0
    used = {}
    for r in rows:
        assert len(r.tokens) == r.n_tokens <= 64
        used[r.source, r.block] = used.get((r.source, r.block), 0) + 1
    assert max(n for (s, _), n in used.items() if s == "small") == 2  # capped, hence below its share
    assert shares["small"].times_used == 2 and shares["small"].actual_share < 0.4
    assert sum(r.n_tokens for r in rows) == sum(s.mixed_tokens for s in shares.values())
    # the blocks of a source hold the tokens of its documents, each once
    tok = encoder(NAME)
    want = sorted(i for d, s, t, _ in docs if s == "small" for i in encode(t, tok))
    assert sorted(i for r in m.blocks.where("source = 'small'").collect() for i in r.tokens) == want
    again = mix(spark.createDataFrame(docs, DOCS), targets, NAME, block=64).slots.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, m.slots.collect()))


def test_mixture_meets_targets_where_it_can(spark):
    docs = [(i, "ab"[i % 2], "some words to count " * 20, None) for i in range(300)]
    m = mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("a", 0.75, 3), ("b", 0.25, 3)], TARGETS), NAME, block=32)
    got = {r.source: r.actual_share for r in m.shares.collect()}
    assert got["a"] == pytest.approx(0.75, abs=0.002)


def test_empty_mixture(spark):
    m = mix(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS), NAME)
    assert m.rows().count() == 0 and [r.actual_share for r in m.shares.collect()] == [0.0]
    assert mix(spark.createDataFrame([], DOCS), spark.createDataFrame([], TARGETS), NAME).shares.count() == 0


def variants():
    base = "Le façade panel сор scores naïve Größe fine 2024"
    return base, [
        unicodedata.normalize("NFD", base), base.replace("a", "а"), base.replace("o", "ο").replace("s", "ѕ"), base.replace(" ", " "), base.replace("fi", "ﬁ"),
        base.replace("n", "n​"), base.replace("2", "２"), base.replace("сор", "cop"), "﻿" + base, base.replace("p", "ｐ"),
    ]


def test_looks_and_differences(spark):
    base, same = variants()
    other = [base.upper(), base.replace("ç", "c"), base.replace("2024", "2O24"), base.replace("ï", "i"), base + "²", base + "2", base + ".", "👨‍👩‍👧", "👨👩👧"]
    docs = spark.createDataFrame([(i, None, t, None) for i, t in enumerate([base, *same, base, *other, None, "", " ​​", " "])], DOCS)
    model = learn(docs, "text")
    got = {(r.doc_id_a, r.doc_id_b) for r in alike_pairs(unified(docs, "doc_id", "text", model), "doc_id").collect()}
    n = len(same) + 2
    texts = [base, *same, base]
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if texts[i] != texts[j]}
    assert got == want
    assert len({r.unified for r in unified(docs, "doc_id", "text", model).where(f"doc_id < {n}").collect()}) == 1
    assert alike_pairs(unified(docs.limit(0), "doc_id", "text", model), "doc_id").count() == 0


def test_the_path_keeps_to_one_script():
    from collections import Counter

    counts = Counter()
    for w in ("scope", "copper", "case", "после", "оса", "роса"):
        pair_counts(w, counts)
    m = Model(counts)
    assert m.word("ѕсоре") == m.word("scope") == "scope"
    assert m.word(unicodedata.normalize("NFD", "pоса")) == "роса"
    assert m.word("42") == "42" and m.word("") == ""
    assert not visible("​  ") and visible("a") and prepared("Ａ­") == "A"
    assert len({c for g in ALIKE for c in g}) == sum(map(len, ALIKE))


def test_hot_look_with_one_variant(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "case when id = 7 then 'cοpies' else 'copies' end as text")
    forms = unified(docs, "doc_id", "text", learn(docs, "text"))
    pairs = alike_pairs(forms, "doc_id")
    classes = alike_classes(forms, "doc_id").collect()
    assert len(classes) == 400 and {(r["class"], r.text, r.n_rows, r.n_texts) for r in classes} == {(0, 0, 400, 2), (0, 7, 400, 2)}
    assert pairs.count() == 399 and pairs.where("doc_id_a < doc_id_b").count() == 399
