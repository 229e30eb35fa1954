"""Removed words against windows counted as tuples."""

import hashlib
import random
from collections import Counter

import pytest

from lethe.llm import queries, substring

from .frames import DATA, clashing, documents, small


def brute(texts, window):
    """n_words, n_removed and kept words of each text."""
    found = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in found for i in range(len(w) - window + 1))
    out = []
    for w in found:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def planted(seed):
    """Texts with shared passages around the window's length, copies, and one that repeats itself."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randint(1, 2)
    passages = [[word() for _ in range(n)] for n in (33, 34, 35, 36, 50, 120)]
    texts = []
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            body[at:at] = rng.choice(passages)
        texts.append(rng.choice([" ", "\n", "  "]).join(body))
    texts += [texts[3]] * 4 + ["x " * 200, "x " * 34, "x " * 36, "y z " * 40, "", None, "one"]
    return texts


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("window", [35, 8])
def test_planted(spark, seed, window):
    texts = planted(seed)
    rows = substring.dedup(clashing(documents(spark, texts)).repartition(3), window=window).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows}
    assert len(rows) == len(texts) and got == dict(enumerate(brute(texts, window)))


def test_repeated_rows_and_ids(spark):
    text = " ".join(map(str, range(50)))
    frame = documents(spark, [text]).union(documents(spark, [text])).union(documents(spark, [None, "a b"], 1))
    rows = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.dedup(frame).collect())
    assert rows == [(0, 50, 50, ""), (0, 50, 50, ""), (1, 0, 0, ""), (2, 2, 0, "a b")]


def test_nothing_repeated_and_empty_table(spark):
    frame = documents(spark, ["a b c", None])
    assert {r["n_removed"] for r in substring.dedup(frame).collect()} == {0}
    assert substring.dedup(frame.where("doc_id > 9")).count() == 0


def test_levels():
    assert substring.levels(35) == [18, 35]
    assert all(b <= 2 * a for n in (32, 50, 100, 777) for a, b in zip(substring.levels(n), substring.levels(n)[1:]))


def test_query(spark):
    want = brute([t for _, t in small()], 35)
    rows = {r["doc_id"]: r for r in queries.op2_substring_dedup(spark, DATA).collect()}
    assert len(rows) == len(small()) and any(n for _, n, _ in want)
    for (doc_id, _), (n, gone, kept) in zip(small(), want):
        assert (rows[doc_id]["n_words"], rows[doc_id]["n_removed"], rows[doc_id]["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
