import zlib

import numpy as np
import pytest

from docrisk.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


def direct_ids(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def check(rows, texts, window):
    """Every id in one piece, right CRCs, sequences gapless and not over the window."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    counts = {}
    for d, t in texts:
        counts[d] = counts.get(d, 0) + 1
    for d, t in texts:
        ids, at, seen = direct_ids(t), 0, sorted(by_doc[d], key=lambda r: (r["start"], r["sequence_id"]))
        for r in seen[:: counts[d]]:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
    return by_seq


def test_round_trip(spark, docs_of):
    words = "The quick brown-fox jumps 12 times; don't <|endoftext|> stop Ünï code x é\tend\x0bof\r\nline".split(" ")
    texts = [(i, " ".join(words[j % len(words)] for j in range(n))) for i, n in enumerate((0, 1, 2, 3, 50, 700, 701, 9000, 4000))]
    texts += [(20, None), (21, ""), (22, "  \n "), (4, texts[4][1])]
    rows = packing.pack(spark, docs_of(texts), PATH).collect()
    check(rows, texts, 4096)


def test_hot_length_is_cut_and_padding_is_small(spark, docs_of):
    texts = [(i, "cat " * 2500 if i % 3 else "dog " * (100 + i)) for i in range(300)]
    rows = packing.pack(spark, docs_of(texts), PATH).collect()
    by_seq = check(rows, texts, 4096)
    total = sum(r["length"] for r in rows)
    assert len(by_seq) * 4096 <= total * 1.03 + 4096


def test_empty_table(spark, docs_of):
    assert packing.pack(spark, docs_of([(1, "a")]).limit(0), PATH).count() == 0


def test_nnls_finds_a_nonnegative_solution():
    rng = np.random.default_rng(1)
    a = rng.random((20, 60))
    x = np.where(rng.random(60) < 0.2, rng.random(60), 0)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.linalg.norm(a @ got - a @ x) < 1e-4
    worse = packing.nnls(np.array([[1.0], [0.0]]), np.array([-1.0, 0.0]))
    assert (worse == 0).all()


def test_crc_of_a_middle_part():
    data = np.random.default_rng(2).bytes(5000)
    for a, b in ((0, 7), (8, 9), (128, 4000), (4999, 5000)):
        assert packing.crc_of_part(zlib.crc32(data[:a]), zlib.crc32(data[:b]), b - a) == zlib.crc32(data[a:b])
