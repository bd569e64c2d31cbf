import random

import numpy as np
import pytest

from lodestrata.llm import packing as P

rng = random.Random(3)


def brute_bfd(lengths, capacity):
    rooms, rows = [], []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= lengths[k]]
        if fits:
            room = min(r for r, _ in fits)
            i = next(i for r, i in fits if r == room)
        else:
            i = len(rooms)
            rooms.append(capacity)
            rows.append([])
        rooms[i] -= lengths[k]
        rows[i].append(k)
    return rooms


@pytest.mark.parametrize("capacity", [1, 7, 64, 100])
def test_best_fit(capacity):
    lengths = np.array([rng.randint(0, capacity) for _ in range(300)])
    rows = P.best_fit_decreasing(lengths, capacity)
    assert sorted(k for r in rows for k in r) == list(range(300))
    rooms = [capacity - int(lengths[r].sum()) for r in rows]
    assert min(rooms) >= 0 and sorted(rooms) == sorted(brute_bfd(lengths.tolist(), capacity))


def test_word_cache_is_exact():
    plain = P.load_encoder()
    cached = P.WordCache(plain, "<u2", entries=50)
    texts = ["", " ", "  two  spaces ", "a b\nc  d", "it's we'll 12 34,5", "nb sp  x", "tab \t x", "été où ça", "x" * 500, "\n\n a", "end "]
    texts += ["".join(rng.choice("ab ,.'\n1é ") for _ in range(200)) for _ in range(300)]
    for t in texts:
        assert cached.encode(t).tolist() == plain.encode_ordinary(t), repr(t)


def test_round_trip(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "short", 1), (3, "short", 1), (4, "word " * 5000, 1), (None, "no id", 1)] + [(k, "w" * k + " x y z", 1) for k in range(5, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    packed = P.pack(docs, seq_len=64, block_tokens=500)
    for r in packed.collect():
        assert r.n_tokens == r.cu_seqlens[-1] <= 64 and len(r.input_ids) == 128 and r.position_resets == r.cu_seqlens[:-1]
        want = [k for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False) for k in range(b - a)] + list(range(64 - r.n_tokens))
        assert P.position_ids(r.cu_seqlens, 64).tolist() == want
    whole = {}
    for r in sorted(P.unpack(packed).collect(), key=lambda r: r.offset):
        whole.setdefault(r.id, []).append((r.offset, bytes(r.ids)))
    coder = P.load_encoder()
    for k, t, _ in rows:
        ids = np.frombuffer(b"".join(x for _, x in whole[k]) if k != 3 else whole[k][0][1], "<u2").tolist()
        assert ids == coder.encode_ordinary(t or "") + [P.END_TOKEN]
    assert len(whole[3]) == 2
    assert P.pack(docs.limit(0)).count() == 0


def test_whole_query_equals_brute_force(spark):
    """Every shard block of the table packs as best fit decreasing by hand does, with the right contents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    coder = P.load_encoder()
    ids = {d: coder.encode_ordinary(t or "") + [P.END_TOKEN] for d, t in texts.items()}
    blocks = {}
    for r in P.pack(docs).collect():
        blocks.setdefault((r.shard, r.block), []).append(r)
    assert sorted({d for rows in blocks.values() for r in rows for d in r.doc_ids}) == sorted(texts)
    for rows in blocks.values():
        lengths = []
        for d in {d for r in rows for d in r.doc_ids}:
            whole = len(ids[d])
            lengths += [min(P.SEQ_LEN, whole - at) for at in range(0, whole, P.SEQ_LEN)]
        assert sorted(P.SEQ_LEN - r.n_tokens for r in rows) == sorted(brute_bfd(lengths, P.SEQ_LEN))
        for r in rows:
            row = np.frombuffer(r.input_ids, "<u2").tolist()
            for d, at, a, b in zip(r.doc_ids, r.offsets, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
                assert row[a:b] == ids[d][at : at + b - a]
            assert set(row[r.n_tokens :]) <= {P.END_TOKEN}


def test_ties_clashing_columns_and_shards(spark, tmp_path):
    rows = [(k, "same length", 7, "s", 1) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long, input_ids string, block int").coalesce(1)
    packed = P.pack(docs, seq_len=16)
    assert [d for r in packed.orderBy("row").collect() for d in r.doc_ids] == list(range(9))
    P.write_packed(packed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == packed.count()
