"""Components against all pairs compared on full sets."""

import random

import numpy as np
import pytest

from lethe.llm import minhash, queries

from .frames import DATA, clashing, documents, small


def sets_of(texts, n):
    found = []
    for t in texts:
        w = (t or "").encode().lower().split()
        found.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return found


def brute(ids, texts, n, percent):
    """n_shingles and component of each row."""
    sets, root = sets_of(texts, n), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and common and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


def families(seed):
    """Groups of edited copies, near and under the threshold; short and empty texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("bcdfghjklm") + rng.choice("aeiou") + rng.choice("nprst") + str(rng.randint(0, 30))
    texts = []
    for _ in range(8):
        base = [word() for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in copy))
    texts += ["a b", "A B", "a", None, "", "  ", texts[0], texts[0]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, n, percent", [(0, 3, 85), (1, 3, 85), (2, 5, 80), (3, 5, 80)])
def test_families(spark, seed, n, percent):
    texts = families(seed)
    ids = [1000 - i for i in range(len(texts))]
    frame = clashing(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).repartition(5)
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.dedup(frame, n=n, percent=percent).collect()}
    assert rows == {i: (*w, w[1] == i) for i, w in zip(ids, brute(ids, texts, n, percent))}
    kept = [r["doc_id"] for r in minhash.keep_first(frame, n=n, percent=percent).collect()]
    assert sorted(kept) == sorted(i for i, r in rows.items() if r[2])


def test_large_group_in_small_blocks(spark):
    """A chain of texts, each near the next alone, larger than a block."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 120)] + [" ".join(words[200:300] + [f"x{i}"]) for i in range(40)]
    ids = list(range(len(texts)))
    rows = minhash.cluster(documents(spark, texts).repartition(4), n=3, percent=85, block=16).select("id", "label").collect()
    label = {r["id"]: bytes(r["label"]) for r in rows}
    want = [c for _, c in brute(ids, texts, 3, 85)]
    assert len(set(zip(want, (label[i] for i in ids)))) == len(set(want)) == len(set(label.values()))


def test_repeated_rows_null_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "z y x w"), (2, None)], "doc_id long, text string")
    found = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.dedup(frame).collect())
    assert found == [("1", "1", True), ("1", "1", True), ("2", "2", True), ("None", "1", False), ("None", "None", True)]
    assert len(minhash.keep_first(frame).collect()) == 3
    assert minhash.dedup(frame.where("doc_id > 5")).count() == 0 and minhash.keep_first(frame.where("doc_id > 5")).count() == 0


def test_corrected_similarity():
    """Estimates from four bits lie around the true similarity."""
    rng = np.random.default_rng(7)
    for share in (0.9, 0.6, 0.2):
        found = []
        for _ in range(30):
            common, one, two = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (int(400 * share), int(200 * (1 - share)), int(200 * (1 - share))))
            _, bits = minhash.signatures([np.concatenate([common, one]), np.concatenate([common, two])])
            z = bits[0] ^ bits[1]
            groups = sum((int(v) >> s & 15) == 0 for v in z.view(np.uint64) for s in range(0, 64, 4))
            found.append(minhash.corrected(groups))
        assert abs(np.mean(found) - share) < 0.03


def test_query(spark):
    ids, texts = zip(*small())
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op9_minhash(spark, DATA).collect()}
    assert rows == {i: (*w, w[1] == i) for i, w in zip(ids, brute(ids, texts, 3, 85))}
