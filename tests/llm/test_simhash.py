import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash
from lodestone.llm.components import components


def plain_fingerprint(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    runs = [words] if 0 < len(words) < width else [words[i:i + width] for i in range(len(words) - width + 1)]
    h = [xxhash.xxh64_intdigest(" ".join(r).encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=4):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))]


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 40, 300]))) for _ in range(60)]
    near = []
    for t in base[:40]:
        w = t.split(" ")
        for _ in range(4):
            w = list(w)
            w[rng.randrange(len(w))] = "Altered"
            near.append(" ".join(w))
    return [*base, *near, None, "", " \t\r\n", "A b", "a  B", "ÀB c d e", "x\x0by z w", "word " * 50_000, "a b c d e"]


def test_groups_equal_brute_force(spark):
    rows = [(i if i % 9 else None, t, "n", i) for i, t in enumerate(texts())] + [(7, "A b", "n", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, root long").repartition(5)
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_groups(df).collect()), key=str)
    plain = [(d, plain_fingerprint(t)) for d, t, *_ in rows]
    want = [(d, p - (1 << 64) if p >> 63 else p, c) for (d, p), c in zip(plain, plain_components(plain), strict=True)]
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    assert simhash.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_planes_equal_popcount(radius):
    rng = np.random.default_rng(radius)
    centre = rng.integers(0, 2**63, 30, dtype=np.uint64)
    prints = np.concatenate([centre ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for _ in range(7)])
    planes = simhash.planes_of(prints)
    for shift in (1, 5, 30, 63, 64, 65, 128, 150):
        lanes = simhash._lanes(np.ones(len(prints) - shift, np.uint8), planes.shape[1])
        want = np.flatnonzero(np.bitwise_count(prints[:-shift] ^ prints[shift:]) <= radius)
        assert simhash.close_lanes(planes, shift, lanes, radius).tolist() == want.tolist()


def test_masks_lose_no_pair():
    rng = random.Random(1)
    masks = simhash.block_masks(4)
    for _ in range(3000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randrange(5)):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_runs_across_batches():
    import pyarrow as pa
    rng = np.random.default_rng(0)
    prints = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64) & np.uint64(0xFF | 7 << 40))
    key = (prints >> np.uint64(40)).astype(np.int64)
    order = np.lexsort((prints, key))
    key, prints = key[order], prints[order]
    batches = [pa.RecordBatch.from_arrays([pa.array(np.zeros(len(k), np.int32)), pa.array(k), pa.array(p.view(np.int64))], ["band", "key", "fp"])
               for k, p in zip(np.array_split(key, 23), np.array_split(prints, 23), strict=True)]
    def classes(rows):
        out = list(simhash._link_batches(4, rows)(iter(batches)))
        links = [(a, b) for o in out for a, b in zip(o["a"].to_pylist(), o["b"].to_pylist(), strict=True)]
        seen = {int(p): int(p) for p in prints}
        for _ in range(20):
            for a, b in links:
                seen[a] = seen[b] = min(seen[a], seen[b])
        return seen
    assert classes(20) == classes(10_000)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 700)] + [(9, 9), (None, 3), (3, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {i: 500 for i in range(501, 700)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_texts_meet(spark):
    """Texts of similarity 0.88 and more join their group, unlike ones stay alone."""
    rng = random.Random(7)
    words = [f"v{i}" for i in range(4000)]
    rows, want = [], {}
    for g in range(60):
        base = [rng.choice(words) for _ in range(400)]
        for copy in range(3):
            w = list(base)
            for at in rng.sample(range(400), 3 * copy):
                w[at] = "edited"
            rows.append((len(rows), " ".join(w), g))
            want[len(rows) - 1] = 3 * g
    rows += [(None, rows[0][1], 0), (500, None, 0), (501, " ", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node long").repartition(6)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert sum(got[d] == c for d, c in want.items()) >= 178
    assert all(got[d] // 3 == d // 3 for d in want)
    assert got[None] == 0 and got[500] == got[501] == 500
    assert simhash.similar_groups(df.limit(0)).count() == 0


def test_rows_of_shared_buckets():
    import pyarrow as pa
    rng = np.random.default_rng(6)
    bucket = np.sort(rng.integers(0, 60, 80))
    for cuts in (1, 7, 40, 80):
        batches = [pa.RecordBatch.from_arrays([pa.array(b), pa.array(n)], ["bucket", "node"]) for b, n in zip(np.array_split(bucket, cuts), np.array_split(np.arange(80), cuts), strict=True)]
        out = [n for o in simhash._shared(iter(batches)) for n in o["node"].to_pylist()]
        assert out == [i for i in range(80) if (bucket == bucket[i]).sum() > 1]


def test_links_towards_the_least_keep_components():
    import pyarrow as pa
    rng = np.random.default_rng(8)
    links = np.unique(np.sort(rng.integers(0, 60, (90, 2)), axis=1)[:, ::-1], axis=0)
    for cuts in (1, 5, 40):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], ["a", "b"]) for x in np.array_split(links, cuts)]
        out = [(a, b) for o in simhash._towards_least(iter(batches)) for a, b in zip(o["a"].to_pylist(), o["b"].to_pylist(), strict=True)]
        def classes(pairs):
            least = list(range(60))
            for _ in range(60):
                for a, b in pairs:
                    least[a] = least[b] = min(least[a], least[b])
            return least
        assert classes(out) == classes(links.tolist())


def sets_of(texts, width=5):
    return [set(simhash.shingle_hashes(t.encode(), width).tolist()) for t in texts]


def jaccard_components(texts, bar=0.8):
    sets, root = sets_of(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= bar * len(sets[i] | sets[j]) - 1e-9:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def near_the_bar(groups, sizes=(400,)):
    """Groups of one text and copies of a similarity of 0.6 to 0.9, short ones too."""
    rng = random.Random(11)
    words = [f"v{i}" for i in range(4000)]
    out = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(sizes[g % len(sizes)])]
        out.append(" ".join(base))
        for share in (0.6, 0.7, 0.76, 0.79, 0.81, 0.85, 0.9):
            keep = round(len(base) * 2 * share / (1 + share))
            w = base[:keep] + [rng.choice(words) for _ in range(len(base) - keep)]
            out.append(" ".join(w))
    return out


def test_similarity_is_that_of_the_sets(spark):
    """Pairs below the bar stay apart, pairs above it are together."""
    texts = near_the_bar(40, (400, 12, 60, 1500))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = jaccard_components(texts)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert [got[d] for d in range(len(texts))] == want


def test_large_group_in_blocks(spark):
    """A group of many blocks gives the components of brute force, whatever is held at once."""
    rng = random.Random(2)
    base = [f"v{i}" for i in range(200)]
    texts = []
    for i in range(150):
        w = list(base)
        for at in rng.sample(range(200), rng.choice([1, 2, 3, 4, 5])):
            w[at] = f"x{i}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df, cfg=simhash.Wide(block=12)).collect()}
    want = jaccard_components(texts)
    assert len(set(want)) > 3 and [got[d] for d in range(len(texts))] == want


@pytest.mark.parametrize("held", [3, 16, 1 << 14])
def test_unit_larger_than_what_is_held(held):
    """One unit that fills several batches, with another behind it."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    base = np.sort(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sets = [np.unique(np.concatenate((base[:-3], rng.integers(0, 2**63, 3, dtype=np.uint64)))) for _ in range(50)] + [base, base[:199]]
    unit = np.array([1] * 50 + [2] * 2)
    columns = [pa.array(unit), pa.array(np.arange(52)), pa.array(np.arange(52)), pa.array([simhash.wide_signature(x, 8) for x in sets]), pa.array([x.tobytes() for x in sets])]
    table = pa.RecordBatch.from_arrays(columns, ["unit", "part", "node", "mark", "shingles"])
    for cut in (52, 10):
        batches = [table.slice(at, cut) for at in range(0, 52, cut)]
        out = [x for o in simhash._wide_links(125, 0.8, held)(iter(batches)) for x in zip(o["a"].to_pylist(), o["b"].to_pylist(), strict=True)]
        assert sorted(out) == [(i, 0) for i in range(1, 50)] + [(51, 50)]
