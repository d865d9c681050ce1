import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from cases import edge_docs

from folioforge.llm import packing as K

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_decreasing_against_plain_search(seed):
    rnd = random.Random(seed)
    row = rnd.choice([7, 16, 64, 100])
    lengths = [rnd.randint(1, row) for _ in range(rnd.randint(0, 200))]
    rooms, want = [], []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            fit = row
        else:
            rooms.remove(fit)
        if fit > n:
            rooms.append(fit - n)
        want.append((n, fit))
    got = K.best_fit_decreasing(lengths, row)
    assert sorted(i for r in got for i in r) == list(range(len(lengths)))
    assert sorted(row - sum(lengths[i] for i in r) for r in got if sum(lengths[i] for i in r) < row) == sorted(rooms)


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "a  b", "a   b", "x\n y", "x \ny", "it's  we'll", "é ñ\t ü  z", "a\xa0b c"])
def test_encoding_equals_library(text):
    e = K.ByteBpe(PATH, P.PATTERN)
    assert e.encode(text) == e.whole(text)


def check(docs, packed, row):
    e = K.ByteBpe(PATH, P.PATTERN)
    rows = packed.collect()
    got = defaultdict(list)
    ids, pos = K.matrix(rows, "ids", row), K.matrix(rows, "position_ids", row)
    for k, r in enumerate(rows):
        cu = r["cu_seqlens"]
        assert (len(cu), cu[0], cu[-1]) == (r["n_segments"] + 1, 0, r["n_tokens"]) and r["n_tokens"] <= row
        for d, s, a, b in zip(r["doc_ids"], r["seg_starts"], cu[:-1], cu[1:], strict=True):
            got[d].append((s, ids[k, a:b]))
            assert (pos[k, a:b] == np.arange(b - a)).all()
        assert (ids[k, cu[-1] :] == e.end).all()
    assert len({r["row_id"] for r in rows}) == len(rows)
    want = Counter((r["doc_id"], e.whole(r["text"] or "")) for r in docs.collect())
    for d in {k[0] for k in want}:
        texts = Counter({t: n for (i, t), n in want.items() if i == d})
        if sum(texts.values()) == 1:
            whole = np.concatenate([x for _, x in sorted(got[d], key=lambda x: x[0])])
            assert whole[-1] == e.end and whole[:-1].astype("<u2").tobytes() == next(iter(texts))
        else:
            assert sum(len(x) for _, x in got[d]) == sum((len(t) // 2 + 1) * n for t, n in texts.items())
    return rows


def test_lossless(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = check(docs, K.pack_documents(docs, PATH, P.PATTERN, 512, 20_000), 512)
    assert sum(r["n_tokens"] for r in rows) >= 0.9 * 512 * len(rows)
    K.write(K.pack_documents(docs, PATH, P.PATTERN), str(tmp_path / "packed"))
    check(docs, spark.read.parquet(str(tmp_path / "packed")), K.ROW)


def test_edge_cases(spark):
    docs = edge_docs(spark).selectExpr("*", "1 as ids", "2 as row_id")
    check(docs, K.pack_documents(docs, PATH, P.PATTERN, 64), 64)
    assert K.pack_documents(docs.limit(0), PATH, P.PATTERN).count() == 0
