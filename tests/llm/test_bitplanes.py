import io
import zlib

import numpy as np
import public_tokenizers
import pytest

from seepage.llm import bitplanes as B
from tests.llm import cases

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(VOCABULARY)


def brute(pairs):
    tok, out, start = tokenizer(), [], 0
    for d, t in pairs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files_against_the_library(spark, kind):
    pairs = [(d, t) for d, t in cases.rows(1, 30) if d != 3 and d != 5] + [(-4, "first"), (None, "nameless")]
    got = B.token_files(spark, cases.frame(spark, pairs), kind=kind, block=1000, file_ids=5000)
    want = brute(sorted(pairs, key=lambda p: (p[0] is not None, p[0])))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_equal_ids_stay_together(spark):
    got = B.token_files(spark, cases.frame(spark, [(1, "b c"), (1, "a"), (1, "a"), (0, "x y z")])).collect()
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [0, 1, 1, 1]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_format_round_trip(kind):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4") for n in (0, 1, 7, 8, 9, 1000, 0, 3)]
    f = io.BytesIO()
    w = B.PlaneWriter(f, 64, kind)
    for i, d in enumerate(docs):
        w.add(i if i else None, d.tobytes())
    w.close()
    r = B.PlaneReader(io.BytesIO(f.getvalue()))
    assert np.concatenate([r.chunk(i) for i in range(len(r.index["chunks"]))]).tolist() == np.concatenate(docs).tolist()
    assert [(d, n, c) for d, _, n, c in r.digests()] == [(i or None, len(d), zlib.crc32(d.tobytes())) for i, d in enumerate(docs)]
    with pytest.raises(ValueError):
        B.PlaneReader(io.BytesIO(f.getvalue()[:-3]))


def test_chunks_of_text_are_encoded_as_the_whole_text():
    tok, code = tokenizer(), B.Coder(VOCABULARY)
    for t in cases.texts(8, 20) + [x or "" for x in cases.ODD] + ["it's DON'T we'll'm", "ÀÉÎ ÷×µ ßtraße ÿ", "İstanbul ΣΑΣ", "é combining", "a_b 12.5%-", "<|startoftext|>x", "fin.ished!? (yes)", "1e5 x2"]:
        want = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(code.encode(t), "<u4").tolist() == want, t
        assert np.frombuffer(code.encode(t), "<u4").tolist() == want, t


def test_empty(spark):
    assert B.token_files(spark, cases.empty(spark)).count() == 0
