import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from plait.llm import tokens


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    return t


def brute(tokenizer, rows):
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=lambda r: r[1])


def test_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, int), np.array([0]), rng.integers(0, 300, 5000), rng.integers(0, 2**32, 3000), np.array([255, 256, 65535, 65536])):
        f = tokens.TokenFile(tokens.pack([1, None], [0, len(ids) // 2, len(ids)], ids.astype(np.uint32)))
        assert f.slice(0, f.n_tokens).tolist() == ids.tolist() and f.doc_ids == [1, None]
        for i in rng.integers(0, len(ids), 50) if len(ids) else []:
            assert f[int(i)] == ids[i]
        for a, b in rng.integers(0, len(ids) + 1, (20, 2)):
            a, b = sorted((int(a), int(b)))
            assert f.slice(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        tokens.TokenFile(b"something else")


def test_words_encode_as_texts(tokenizer):
    enc = tokens.Encoder(open(tokens.vocabulary_path(), encoding="utf-8").read())
    assert enc.known
    for text in ["", "Hello  World's ~ tilde~d 007\x0b\x1cx  y", "é ́x ΑΣ Σ ΟΔΟΣ. ǅ İ", "<|endoftext|> a<|startoftext|>b", "我们 \U0001f600 a b\x85c", "don't we'll I'm"]:
        assert np.frombuffer(enc.encode([text.encode()])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_other_vocabularies_take_whole_texts():
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    enc = tokens.Encoder(open(path, encoding="utf-8").read())
    for text in ["Hello  World's\nA b", "", "É tΣ  <|endoftext|>"]:
        assert np.frombuffer(enc.encode([text.encode()])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_against_tokenizer(spark, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(None, "no id"), (7, "again"), (7, "again"), (500, None), (501, ""), (502, "long " * 30000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "2 as part").repartition(5)
    for limit in (tokens.FILE_TOKENS, 3000):
        manifest = tokens.write(d, tokens.vocabulary_path(), file_tokens=limit)
        assert got(tokens.read(manifest, tokens.crc32_of, "ids_crc32", "long")) == brute(tokenizer, rows)


def test_no_rows(spark, docs):
    assert tokens.read(tokens.write(docs([]), tokens.vocabulary_path()), tokens.crc32_of, "x", "long").count() == 0


def test_a_token_costs_a_few_blocks():
    class Counting:
        def __init__(self, raw):
            self.raw, self.read = raw, 0

        def size(self):
            return len(self.raw)

        def read_at(self, n, at):
            self.read += n
            return self.raw[at : at + n]

    ids = np.random.default_rng(2).integers(0, 2**32, 1 << 20).astype(np.uint32)
    source = Counting(tokens.pack([1], [0, len(ids)], ids))
    f = tokens.TokenFile(source)
    assert f[777_777] == ids[777_777] and source.read < 16 * tokens.BLOCK_BYTES < len(source.raw) / 4
