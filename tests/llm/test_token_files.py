import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from pagewright.llm import token_files


def brute(rows, end_id=0):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for i, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ROWS = [(5, "It's one\n\n  two  "), (3, None), (9, ""), (3, "x" * 3000), (7, "a <|endoftext|> b"), (None, "ö 日本語"), (5, "It's one\n\n  two  "), *((i, f"text {i * 37} of many, \x85 {i}") for i in range(20, 90))]


def test_files_hold_what_the_library_gives(spark, tmp_path):
    docs = spark.createDataFrame([(*x, "y") for x in ROWS], "doc_id long, text string, start string")
    files = token_files.write(docs, str(tmp_path / "set"))
    assert token_files.load(str(tmp_path / "set")) == files
    got = sorted(map(tuple, token_files.read(spark, files).collect()), key=lambda x: x[1])
    assert got == brute(ROWS)
    first = token_files.Part(files.folder, files.parts[0][0], files.width)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert library.decode(first[0][:-1].tolist()) == "ö 日本語"


def test_empty_table(spark, tmp_path):
    files = token_files.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none")
    assert files.parts == [] and token_files.read(spark, files).count() == 0


def test_pieces_give_what_whole_texts_give():
    rng = random.Random(4)
    marks = [" ", " ", " ", "\n", "\t", "\x85", "\u00a0", "\u3000", "\x1c", "a", "Word", "it's", "'ll", "'", "'re", ".", "12", "²", "é", "<|endoftext|>", "<|endof", "text|>", "日本", "--", "\u0301"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(12))) for _ in range(4000)] + ["", " ", "a ", " a", "a  b", "a \nb"]
    texts += ["".join(chr(c) for _ in range(40) if not 0xD800 <= (c := rng.randrange(0x30000)) < 0xE000) for _ in range(800)]
    own = token_files.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert own.by_pieces
    for text in (*texts[::50], *(x for x in texts if "<|endoftext|>" not in x)):
        ids, bounds = own(pa.array([text]))
        assert ids.tolist() == own.library.encode(text, add_special_tokens=False).ids, text
        assert bounds.tolist() == [0, len(ids)]
    ids, bounds = own(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [own.library.encode(x, add_special_tokens=False).ids for x in texts]


def test_equal_hashes_and_very_long_texts():
    own = token_files.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"), 2)
    thue = "".join("ab"[bin(i).count("1") & 1] for i in range(65536))
    texts = [thue[:2048], thue[:2048].translate({97: 98, 98: 97}), thue, thue.translate({97: 98, 98: 97}), "word and " * 20_000, "z" * 100_000]
    ids, bounds = own(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [own.library.encode(x, add_special_tokens=False).ids for x in texts]


def test_a_small_store_starts_anew(monkeypatch):
    monkeypatch.setattr(token_files, "MOST_PIECES", 50)
    own = token_files.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"), 2)
    for at in range(0, 400, 40):
        texts = [f"word{at + i} and more{i}" for i in range(40)]
        ids, bounds = own(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [own.library.encode(x, add_special_tokens=False).ids for x in texts]
