import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from pagewright.llm import bpe
from pagewright.llm.pieces import PieceStore

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    some = ["", " ", "\n\n  x", "It's we'll 'S <|endoftext|>", "ab" * 400, "a" * 3000, "日本語の文章です。" * 30, "\x1c\x85   x", "😀🏽 é", "1234567 89,000", "=" * 500 + "\t\t" + "-" * 129]
    for size in (5, 40, 400):
        some += ["".join(chr(c) for _ in range(size) if not 0xD800 <= (c := rng.choice((rng.randrange(32, 127), rng.randrange(0x3000), rng.randrange(0x20000)))) < 0xE000) for _ in range(60)]
    return some


def test_same_ids_as_the_library(library):
    own = bpe.coder(PATH)
    for text in texts():
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text), text[:50]
        assert own.decode(ids) == text.encode()


def test_long_pieces_merge_as_short_ones_do(library):
    own = bpe.coder(PATH)
    for text in ("tion" * 20, "aaab" * 31, "th" * 63, "tion" * 100, "=-" * 255, "日本語" * 50):
        assert own._long(text.encode()) == own.encode_pieces([text.encode()])[0]


def swapped(n):
    """The Thue-Morse word of n letters: it and its swap collide under any polynomial hash modulo a power of two."""
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_pieces_are_told_apart_by_their_bytes(library):
    words = [w for n in (1024, 2048, 4096, 65536) for w in (swapped(n), swapped(n).translate({97: 98, 98: 97}))]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(words))), "text": words})
    for row, text in zip(next(bpe._digest_batches(PATH, iter([batch]))).to_pylist(), words, strict=True):
        ids = library.encode_ordinary(text)
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_a_store_whose_hashes_all_collide():
    learned = []
    store = PieceStore(learned.extend, learned.clear, hashes=lambda data, start, end, pair: np.zeros(len(start), np.uint64))
    texts = ["one two three", "three two  one", "", "x" * 40 + " " + "x" * 39 + "y", "x" * 39 + "y two"]
    for some in (texts, texts[::-1], texts):
        numbers, bounds = store.numbers(pa.array(some))
        got = [b"".join(learned[i] for i in numbers[a:b]).decode() for a, b in zip(bounds, bounds[1:])]
        assert got == some and len(set(learned)) == len(learned)


def test_a_store_is_bounded_by_bytes():
    learned, anew = [], []
    store = PieceStore(learned.extend, lambda: (learned.clear(), anew.append(1)), most_bytes=1000)
    for i in range(30):
        numbers, _ = store.numbers(pa.array([f"{i}" * 120 + "\n" + chr(97 + i) * 100]))
        assert sum(map(len, learned)) <= 1400 and b"".join(learned[k] for k in numbers).decode() == f"{i}" * 120 + "\n" + chr(97 + i) * 100
    assert anew


@pytest.mark.parametrize("most", [1, 2, 3, 7])
def test_digests_of_any_part_of_pieces(library, monkeypatch, most):
    monkeypatch.setattr(bpe, "_PIECES_AT_A_TIME", most)
    texts = ["", "one two three four", "", "", "five", "six seven", "eight nine ten eleven twelve", ""]
    rows = next(bpe._digest_batches(PATH, iter([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})]))).to_pylist()
    for row, text in zip(rows, texts, strict=True):
        ids = library.encode_ordinary(text)
        assert tuple(row.values())[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert next(bpe._digest_batches(PATH, iter([pa.RecordBatch.from_pydict({"doc_id": [], "text": pa.array([], pa.string())})]))).num_rows == 0


def test_very_long_texts(library):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeföß ") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    for text in (" ".join(rng.choice(words) for _ in range(40_000)), "q" * 100_000, "QUFB" * 30_000):
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
        row = next(bpe._digest_batches(PATH, iter([batch]))).to_pylist()[0]
        ids = library.encode_ordinary(text)
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_digests(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello there", None), (3, "Hello there", None), (None, "ö" * 200, "y")]
    got = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    want = []
    for i, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_encode(spark, library):
    got = bpe.encode(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.ids for r in got} == {1: library.encode_ordinary("one two"), 2: []}
