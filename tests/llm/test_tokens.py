import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumigraph.llm import rans
from lumigraph.llm.common import new_path
from lumigraph.llm.token_counts import count_tokens
from lumigraph.llm.token_output import read_tokens, write_tokens
from lumigraph.llm.tokens import Vocabulary, parts, vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
TRICKY = ["", "a", "Don't it's we'll", "x<|endoftext|>y", "<|startoftext|>", "İstanbul ŞŠß ﬁ", "é ́x", "a b c", "\x1c\x1d a\x85b", "１２３ ²³ x2y", "日本語 テスト", "'S 'LL ''d", "Σας ΟΔΟΣ", "\U0001f600\U0001f600 ok", "½ƒ ªº", "A" * 3000, "tab\tnew\nline\r\n\x0b\x0c", "K Å ſ", "ĳ ŉ ǅ"]


LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_tricky_text_as_the_library():
    pack, count = vocabulary(PATH).packer(4), vocabulary(PATH).counter()
    assert vocabulary(PATH).separates
    rng = random.Random(0)
    chars = [chr(c) for c in [*range(32, 127), *range(160, 600), 0x301, 0x308, 0x130, 0x2028, 0x3000, 0x1F600]]
    for text in TRICKY + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 80))) for _ in range(300)]:
        ids = expected(text)
        assert np.frombuffer(pack(text.encode()), "<u4").tolist() == ids and count(text.encode()) == len(ids)


def test_parts_cut_at_white_space():
    text = b"aa bbb\ncccc " * 50 + b"x" * 300 + b" end"
    for size in (1, 7, 64, 10_000):
        assert b"".join(parts(text, size)) == text
        assert [w for p in parts(text, size) for w in p.split()] == text.split()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_read_whole_texts(make_docs, name):
    vocab = vocabulary(public_tokenizers.path(name))
    rows = [(1, "Hello  world "), (2, None), (3, "é\n\n x")]
    got = {r.doc_id: r.n_tokens for r in count_tokens(make_docs(rows), public_tokenizers.path(name)).collect()}
    assert got == {i: len(vocab.encode(t or "")) for i, t in rows}


def test_counts(make_docs, odd_rows):
    got = sorted(map(tuple, count_tokens(make_docs(odd_rows), PATH).collect()))
    assert got == sorted((i, len((t or "").encode()), len(expected(t or "")), len(expected(t or "")) > 2048) for i, t in odd_rows)
    assert count_tokens(make_docs([]), PATH).count() == 0


def test_rans_round_trip():
    rng = np.random.RandomState(0)
    for n, k in ((0, 5), (1, 1), (127, 3), (5000, 1), (200_000, 40_000), (600_000, 300)):
        ids = (rng.zipf(1.3, n) % k).astype(np.uint32)
        values, counts = np.unique(ids, return_counts=True)
        model = rans.Model.from_bytes(rans.Model.fit(values, counts).to_bytes())
        assert not n or int(model.freqs.sum()) == 1 << rans.SCALE_BITS
        block = rans.encode(ids, model)
        assert np.array_equal(rans.decode(block, model), ids)
        for before, size, at in rans.checkpoints(block):
            assert np.array_equal(rans.decode_from(block, at, model), ids[before : before + size])
        if n > 1000:
            p = counts / n
            assert len(block) * 8 <= 1.05 * n * -(p * np.log2(p)).sum() + 80 * rans.MOST_LANES * len(rans.checkpoints(block)) + 1000
            damaged = bytearray(block)
            damaged[-2] ^= 1
            with pytest.raises(ValueError, match="checksum"):
                rans.decode(bytes(damaged), model)
    with pytest.raises(ValueError, match="not seen"):
        rans.encode(np.array([9], np.uint32), rans.Model.fit(np.array([1]), np.array([1])))


@pytest.mark.parametrize("block_ids", [1 << 20, 40])
def test_files(spark, make_docs, odd_rows, block_ids):
    rows = odd_rows + [(None, "no id")]
    path = new_path(spark, "tokens")
    write_tokens(make_docs(rows), path, PATH, block_ids=block_ids)
    got = sorted(((r.doc_id is not None, r.doc_id, r.start, r.n_tokens, r.crc) for r in read_tokens(spark, path).withColumn("crc", F.crc32("ids")).collect()), key=lambda r: r[2])
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*expected(t or ""), 1]
        want.append((i is not None, i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    empty = new_path(spark, "tokens")
    write_tokens(make_docs([]), empty, PATH)
    assert read_tokens(spark, empty).count() == 0


def test_pre_tokens_as_the_library_and_a_small_table(monkeypatch):
    """Apostrophes, digits, marks and odd letters in every order; with a table that is always full."""
    monkeypatch.setattr("lumigraph.llm.tokens.MOST_KNOWN", 20)
    vocab, rng = Vocabulary(PATH), random.Random(6)
    bits = ["'", "''", "'s", "'S", "'re", "'ll", "'l", "'ve", "'v", "'m", "'d", "'t", "s", "re", "LL", "x", "É", "ß", "ÿ", "Ÿ", "İ", "ı", "ŀ", "Ŀ", "×", "÷", "7", "42", "<", "|", "<|", "-", "!", "¿", "ж", "日", "\U0001f600", "\x01", "\x7f", "\xa0", "́", " ", " ", "\n", "\t"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    want = [expected(t) for t in texts]
    flat, sizes = vocab.ids([t.encode() for t in texts])
    assert sizes.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    assert vocab.counts([t.encode() for t in texts]).tolist() == sizes.tolist()
    one = [vocab.ids([t.encode()])[0].tolist() for t in texts]
    assert one == want


@pytest.mark.parametrize("most", [0, 40, 1 << 18])
def test_counts_by_frequent_and_joined_pre_tokens(make_docs, odd_rows, monkeypatch, most):
    """However many pre-tokens are sent to the tasks, the counts are the library's."""
    monkeypatch.setattr("lumigraph.llm.token_counts.MOST_SENT", most)
    rng = random.Random(7)
    rows = [*odd_rows, (None, "no id here"), *[(100 + i, " ".join(f"w{rng.randint(0, 60)}{'x' * rng.randint(0, 90)}'s, {rng.random()}" for _ in range(rng.randint(0, 40)))) for i in range(60)], *enumerate(TRICKY, 1000)]
    rows += [*rows[-5:], (9000, " ".join(f"v{k % 5000},x" for k in range(300_000)))]  # the last in several stretches
    got = sorted(map(tuple, count_tokens(make_docs(rows), PATH).collect()), key=repr)
    assert got == sorted(((i, len((t or "").encode()), len(expected(t or "")), len(expected(t or "")) > 2048) for i, t in rows), key=repr)
