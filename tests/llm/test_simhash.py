import random

import numpy as np
import xxhash

from lodestrata.llm import simhash as S

rng = random.Random(5)


def brute_fp(text, k=3):
    w = ("" if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)).encode().split()
    if not w:
        return 0
    s = [b" ".join(w)] if len(w) < k else [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    parent = {i: i for i in range(len(prints))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2 or prints[i][0] == prints[j][0]:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        low.setdefault(find(i), []).append(d)
    return {(d, f"{f:016x}", min(low[find(i)])) for i, (d, f) in enumerate(prints)}


def test_trie_pairs():
    base = [rng.getrandbits(64) for _ in range(40)]
    keys = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(12)})
    a = np.array(keys, np.uint64)
    for fixed in (0, 5, 21):
        for leaf in (1, 8):
            got = {(int(i), int(j)) for x, y in S.trie_pairs(a, fixed, 2, leaf) for i, j in zip(x, y, strict=True)}
            want = {(i, j) for j in range(len(keys)) for i in range(j) if (keys[i] ^ keys[j]).bit_count() <= 2 and keys[i] >> (64 - fixed) == keys[j] >> (64 - fixed)}
            assert got == want


def texts():
    vocabulary = [f"w{k}" for k in range(300)]
    out = [(100, None), (101, ""), (102, " \t\n"), (103, "One two"), (104, "one two"), (105, "ONE TWO three"), (103, "other text here now")]
    for k in range(12):
        w = [rng.choice(vocabulary) for _ in range(400)]
        out.append((k * 7, " ".join(w)))
        out.append((k * 7 + 1, "\n".join(w)))
        for m in (2, 3):
            v = list(w)
            v[rng.randrange(400)] = "changed"
            out.append((k * 7 + m, " ".join(v)))
    out.append((999, "x" * 100_000 + " y" * 50_000))
    return out


def test_equals_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, fp string")
    want = brute_components([(d, brute_fp(t)) for d, t in rows])
    assert {tuple(r) for r in S.near_duplicate_report(docs).collect()} == want
    got = S.near_duplicates(docs, bucket_rows=2)
    assert {(r.id, f"{r.fp % 2**64:016x}", r.component_id) for r in got.collect()} == want
    first = {c for _, _, c in want}
    assert {r.doc_id for r in S.drop_near_duplicates(docs).collect()} == first


def test_empty(spark):
    assert S.near_duplicate_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_id(spark):
    rows = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (None, "quite another")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in S.near_duplicate_report(rows).collect()) == ["5", "5", "None"]
