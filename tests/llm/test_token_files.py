import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from docrisk.llm import token_files, tokens
from docrisk.session import work_folder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [
    None, "", " ", "   ", "\n\n\n", "a", " a", "a ", "two  spaces   three", "line\nline\n\n  indent\tTab", "café naïve Über straße", "日本語　テキスト 東京",
    "x  y  z", "\x1c\x1d odd \x1f controls", "don't we'll I'M they've", "1234567890 3.14 a1b2", "<|endoftext|> and a <|endoftext|>b  <|endoftext|>",
    "😀 emoji 👩‍👩‍👧 joined", "!" * 300, "word " * 5000, "́combining é", "a\r\nb\r\n", "x" * 200 + " " + "y" * 200,
]


@pytest.mark.parametrize("kind,path", [(tokens.ByteEncoder, BYTES), (tokens.WordEncoder, WORDS)])
@pytest.mark.parametrize("limit,group", [(1_000_000, 1 << 22), (7, 11), (50, 200)])
def test_chunks_give_the_ids_of_whole_texts(kind, path, limit, group):
    plain, encoder = Tokenizer.from_file(path), kind(path, limit, group)
    texts = [*AWKWARD, " ".join(AWKWARD[i] or "" for i in range(5, 17)), "nul\0 byte \0", "\x85next\u2028line  \u3000 x"]
    for some in ([t] for t in texts):
        assert [i.tolist() for i in encoder.ids(some)] == [plain.encode(some[0] or "", add_special_tokens=False).ids], repr(some)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [i.tolist() for i in encoder.ids(texts)] == want
    assert len(encoder.young.keys) <= limit and len(encoder.old.keys) <= limit


def test_encoder_on_given_documents(small):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{small}/documents.parquet", columns=["text"])["text"].to_pylist()
    for kind, path in ((tokens.ByteEncoder, BYTES), (tokens.WordEncoder, WORDS)):
        plain = Tokenizer.from_file(path)
        assert [i.tolist() for i in kind(path, limit=5000, group=30_000).ids(texts)] == [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def brute(rows):
    plain, out, at = Tokenizer.from_file(BYTES), [], 0
    for doc, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark, make, tmp_path):
    rows = [(97 - i, t, "en", "s") for i, t in enumerate(AWKWARD)] + [(None, "no id", "en", "s"), (None, None, "en", "s")]
    folder = str(tmp_path / "corpus")
    parts = token_files.write(make(rows), folder, BYTES)
    got = [tuple(r) for r in token_files.read(spark, folder, parts, block_docs=3).orderBy("start").collect()]
    assert [g[0] for g in got[:2]] == [None, None]
    nameless = [None, "no id"] if got[0][2] == 1 else ["no id", None]  # ordered by a hash of the text
    want = brute([(None, t) for t in nameless] + sorted((i, t) for i, t, *_ in rows if i is not None))
    assert got == want
    corpus = token_files.Corpus(folder)
    assert len(corpus) == len(want)
    for i, (_, _, n, crc) in enumerate(want):
        assert len(corpus[i]) == n and zlib.crc32(corpus[i].astype("<u4").tobytes()) == crc
    with pytest.raises(IndexError):
        corpus[len(corpus)]


def test_long_text_by_blocks(spark, docs_of, tmp_path):
    texts = ["some words " * 400, "short", "other words " * 30, "", "x"]
    folder = str(tmp_path / "corpus")
    parts = token_files.write(docs_of(list(enumerate(texts))), folder, BYTES)
    got = token_files.read(spark, folder, parts, block_ids=50).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(list(enumerate(texts)))


def test_rows_that_share_an_id_and_clashing_columns(spark, make):
    from pyspark.sql import functions as F

    rows = [(5, f"text {i % 4}", "en", "s") for i in range(40)]
    df = make(rows)
    for name in ("order", "part", "file", "start", "n_tokens", "ids_crc32", "width", "at"):
        df = df.withColumn(name, F.lit("x"))
    got = token_files.round_trip(spark, df, BYTES).orderBy("start").collect()
    assert len(got) == 40 and {r.doc_id for r in got} == {5}
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(40)]


def test_empty_table(spark, docs_of):
    folder = work_folder(spark, "none")
    df = docs_of([(1, "x")]).where("false")
    parts = token_files.write(df, folder, BYTES)
    assert parts == [] and len(token_files.Corpus(folder)) == 0
    assert token_files.read(spark, folder, parts).count() == 0
