import collections
import math
import tracemalloc

import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronoloom.llm import piece_sampling, token_counts

BYTES, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
BITS = ["a", "the", " ", "  ", "\n", "'re", "'ve", "'s", "'", "!", "23", "é", "中", "😀", "<|endoftext|>", "\t", "_", "²", "\x1c", "\x1d", "\x1f", "\x85", "\u2028", "\u3000", "\xa0", "ing", " hello", "====", "́", "’", "▁"]


def test_every_prefix_has_the_librarys_count(rng):
    own, library = token_counts.counter(BYTES), Tokenizer.from_file(BYTES)
    for _ in range(300):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))
        profile = own.profile(text)
        assert len(profile) == 2 * len(text)
        for i in range(len(text) + 1):
            assert token_counts.tokens_at(profile, i) == len(library.encode(text[:i], add_special_tokens=False).ids), (text, i)


def test_white_space_of_the_library(rng):
    """U+001C to U+001F aren't white space for the tokenizer, wherever they stand."""
    own, library = token_counts.counter(BYTES), Tokenizer.from_file(BYTES)
    chars = ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\n", "\t", " ", "\r", "\x0b", "\u2003", "\u200b", "a", "'s"]
    for text in ["\n\n\x1d", *("".join(rng.choice(chars) for _ in range(rng.randint(1, 7))) for _ in range(3000))]:
        assert token_counts.tokens_at(own.profile(text), len(text)) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_longest_prefix_within_a_budget(rng):
    own, library = token_counts.counter(BYTES), Tokenizer.from_file(BYTES)
    text = "".join(rng.choice(BITS) for _ in range(60))
    n = token_counts.chars_within(own.profile(text), 10)
    fits = [i for i in range(len(text) + 1) if len(library.encode(text[:i], add_special_tokens=False).ids) <= 10]
    assert n == max(fits)


def test_token_counts_of_a_table(spark):
    rows = [(1, "hello world", 5), (2, None, 6), (3, "", 7), (4, "x " * 5000, 8), (4, "x " * 5000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")  # an extra column with a clashing name
    got = token_counts.prefix_token_counts(df, BYTES, 3).orderBy("doc_id").collect()
    library = Tokenizer.from_file(BYTES)
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in got] == sorted((i, len((t or "").encode()), len(library.encode(t or "").ids)) for i, t, _ in rows)
    assert token_counts.prefix_token_counts(df.limit(0), BYTES, 3).count() == 0


def test_sampling_is_lossless_and_keyed():
    own = piece_sampling.sampler(PIECES)
    texts = ["", "a", " hello  world\n\nfoo ", "▁x▁ ▁", "日本語 é😀\x00", "x" * 500, None, "\n", "  ", "the cat"]
    out = own.encode(list(range(len(texts))), texts)
    assert [own.decode(x) for x in out] == texts
    for i, t in enumerate(texts):  # alone or together, the same
        alone = own.encode([i], [t])[0]
        assert alone is None if t is None else alone.tolist() == out[i].tolist()


def test_sampling_has_the_lattices_probabilities():
    own = piece_sampling.sampler(PIECES)
    lattice = own.lattice
    weight = {lattice.piece_text[i]: lattice.weight[i] for i in range(len(lattice.piece_text)) if lattice.weight[i] > 0}

    def ways(rest):
        if not rest:
            yield (), 1.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in weight:
                for more, p in ways(rest[k:]):
                    yield (rest[:k], *more), p * weight[rest[:k]]

    all_ways = dict(ways("▁there"))
    total, n = sum(all_ways.values()), 20_000
    seen = collections.Counter(tuple(lattice.piece_text[i] for i in x) for x in own.encode(list(range(n)), ["there"] * n))
    assert set(seen) <= set(all_ways)
    for way, p in all_ways.items():
        assert abs(seen[way] / n - p / total) < 5 * math.sqrt(p / total / n) + 1e-4


def test_sampling_has_bounded_arrays(spark, rng):
    """What a worker holds at once while it draws an Arrow batch of long texts, and that the draws don't depend on the steps."""

    class Table:
        sparkSession, dtypes = spark, [("doc_id", "bigint")]

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    letters = "etaoinshrdlu"
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(2, 10))) for _ in range(100_000)]
    texts = [" ".join(rng.choices(vocabulary, k=450)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(range(1000)), pa.array(texts)], ["doc_id", "key", "text"])
    run = piece_sampling.encode(Table(), PIECES)
    own = piece_sampling.sampler(PIECES)
    tracemalloc.start()
    try:
        found = [out.column(1) for out in run([batch])]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 110 << 20
    pieces = [x for column in found for x in column.to_pylist()]
    for i in range(0, 1000, 250):
        assert pieces[i] == own.encode([i], [texts[i]])[0].tolist()


def test_a_long_word_is_one_lattice():
    """Shares of the last pieces of a word of 2,000 characters against logarithms of sums over its whole lattice."""
    lattice = piece_sampling.sampler(PIECES).lattice
    weight = {lattice.piece_text[i]: math.log(lattice.weight[i]) for i in range(len(lattice.piece_text)) if lattice.weight[i] > 0}
    word = "▁" + "there" * 400
    assert piece_sampling.words_of(word) == [word]
    total = [0.0]
    add = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    for n in range(1, len(word) + 1):
        total.append(add([total[n - k] + weight[word[n - k : n]] for k in range(1, min(n, lattice.longest) + 1) if word[n - k : n] in weight]))
    keys, piece, before, last = lattice.forward([word])
    rows = [i for i in range(len(keys)) if keys[i] >> 32 == last[0]]
    shares = [int(keys[i] & ((1 << 32) - 1)) / 2**31 for i in rows]
    for i, share in zip(rows, [b - a for a, b in zip([0, *shares], shares)]):
        text = lattice.piece_text[piece[i]]
        assert abs(share - math.exp(total[len(word) - len(text)] + weight[text] - total[-1])) < 1e-6


def test_encode_and_decode_tables(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "a\nb ▁"), (4, "a\nb ▁")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    coded = piece_sampling.encode(df.repartition(3), PIECES)
    back = piece_sampling.decode(coded, PIECES).collect()
    assert sorted((r.doc_id, r.text or "~") for r in back) == sorted((i, t or "~") if t != "" else (i, "~") for i, t in rows)
    clash = piece_sampling.decode(coded.withColumn("text", F.lit(7)), PIECES)
    assert clash.columns == ["doc_id", "pieces", "text"] and {r.text for r in clash.collect()} == {t for _, t in rows}
    one = {r.doc_id: r.pieces for r in piece_sampling.encode(df.coalesce(1), PIECES).collect()}
    assert all(one[r.doc_id] == r.pieces for r in coded.collect())
    assert all(r.decoded_equal for r in piece_sampling.digests(df, PIECES).collect())
    assert piece_sampling.encode(df.limit(0), PIECES).count() == 0


def test_a_wrong_tokenizer_is_refused():
    with pytest.raises(ValueError):
        token_counts.PrefixCounter(P.path("word_bpe_49k.json"))
