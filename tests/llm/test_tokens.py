import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from concordat.llm import token_files
from concordat.llm.textarrays import as_bytes
from concordat.llm.wavelet import WaveletMatrix, build

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain(text):
    own = Tokenizer.from_file(PATH)
    return own.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 3000])
def test_wavelet(n):
    rng = np.random.default_rng(n)
    tokens = rng.integers(0, 50, n).astype(np.uint16)
    tokens[rng.random(n) < 0.1] = 49000
    matrix = WaveletMatrix(n, 16, *build(tokens, 16))
    assert matrix.tokens().tolist() == tokens.tolist()
    for i in range(0, n, 97):
        assert matrix.access(i) == tokens[i]
    for token in (0, 7, 49000, 60000, 1 << 17):
        at = np.flatnonzero(tokens == token)
        assert matrix.count(token) == len(at) and matrix.count(token, n // 3, n // 2) == ((at >= n // 3) & (at < n // 2)).sum()
        assert [matrix.locate(token, j) for j in range(len(at))][:20] == at.tolist()[:20] and matrix.locate(token, len(at)) == -1


def test_pieces_give_the_ids_of_the_text():
    rng = random.Random(3)
    alphabet = list("aAbé ßʼ's't're0١५\t\n\r\v\f\x00\x1c\x1f\x7f\x85\xa0́̈​ 　ſKÅİ😀ﬁ'\"#_-.")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["", " ", "don't  we'LL <|endoftext|> x<|startoftext|>y", "é e ́", "Σίσυφος ΟΔΟΣ ΟΔΟΣ."]
    import pyarrow as pa

    own = token_files.Encoder(PATH)
    ids, bounds = own.encode(*as_bytes(pa.array(texts)))
    library = Tokenizer.from_file(PATH)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids + [1], text


def colliding():
    """Two words of 1,024 bytes that polynomial hashes modulo 2**64 do not tell apart."""
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_are_told_apart_by_their_bytes():
    import pyarrow as pa

    one, two = colliding()
    ids, bounds = token_files.Encoder(PATH).encode(*as_bytes(pa.array([f"{one} {two} {one}", f"{one}é {two}é"])))
    assert ids[: bounds[1]].tolist() == plain(f"{one} {two} {one}") and ids[bounds[1] :].tolist() == plain(f"{one}é {two}é")


def test_a_very_long_text():
    import pyarrow as pa

    text = "Längster Text, d'un côté 12345 — and words " * 30_000 + "x" * 70_000 + " end"
    ids, bounds = token_files.Encoder(PATH).encode(*as_bytes(pa.array([text])))
    assert len(text.encode()) > 2 * token_files.SLICE_BYTES and bounds.tolist() == [0, len(ids)] and ids.tolist() == plain(text)


def test_another_tokenizer_gets_whole_texts():
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, texts = token_files.Encoder(path), ["  two  spaces", "", "Ünder\nline"]
    ids, bounds = own.encode(*as_bytes(pa.array(texts)))
    library = Tokenizer.from_file(path)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids + [1]


def test_remembered_pieces_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "REMEMBERED", 50)
    own = token_files.Encoder(PATH)
    for k in range(20):
        texts = [" ".join(f"w{(k * 7 + j) % 90}" for j in range(60))]
        ids, _ = own.encode(*as_bytes(pa.array(texts)))
        assert ids.tolist() == plain(texts[0])


@pytest.mark.parametrize(("docs_each", "tokens_each"), [(4096, 1 << 18), (7, 50)])
def test_round_trip(spark, odd, small, tmp_path, docs_each, tokens_each):
    docs = odd.select("doc_id", "text").union(small.selectExpr("doc_id + 1000", "text").limit(60))
    where = f"file://{tmp_path}/files"
    token_files.write_token_files(docs, where, shard_docs=docs_each, block_tokens=tokens_each)
    got = [(r.id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, where).collect()]
    rows = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    start, want = 0, []
    for i, ids in rows:
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_blocks_answer_by_themselves(spark, small, tmp_path):
    docs, where = small.orderBy("doc_id").limit(30), f"file://{tmp_path}/files"
    token_files.write_token_files(docs, where, shard_docs=10, block_tokens=64)  # documents go on over several matrices
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    for row in spark.read.schema(token_files.BLOCKS).parquet(where).collect():
        own, every = list(token_files.matrices(row.asDict())), []
        for m in own:
            every += [m.access(i) for i in range(m.n)]
        ids, lengths = np.frombuffer(row.ids, "<i8").tolist(), np.frombuffer(row.lengths, "<i8").tolist()
        assert every == sum((want[i] for i in ids), []) and [len(want[i]) for i in ids] == lengths
        assert sum(m.count(1) for m in own) == every.count(1) and max(m.n for m in own) <= 64


def test_empty(spark):
    assert token_files.token_index(spark.createDataFrame([], "doc_id long, text string")).count() == 0
