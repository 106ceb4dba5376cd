"""Near-dedup by similarity against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lumenlint.llm import similar, simhash


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def copies(n_bases, n_copies, changes, seed=7):
    """(id, text): texts and copies of them with single words changed, each in its own places."""
    rng = random.Random(seed)
    out = []
    for b in range(n_bases):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for c in range(n_copies):
            own = list(words)
            for _ in range(rng.randrange(changes + 1) if c else 0):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            out.append((len(out), " ".join(own)))
    return out


def brute(docs):
    sets, fps, label = [shingles(t) for _, t in docs], [simhash.fingerprint(t) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            near = sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            if (near or (fps[i] ^ fps[j]).bit_count() <= 4) and label[i] != label[j]:
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label


@pytest.mark.parametrize("crowd", [3, 32])
def test_components_by_similarity(spark, monkeypatch, crowd):
    monkeypatch.setattr(similar, "CROWD", crowd)
    docs = copies(6, 9, 6) + [(54, ""), (55, "  "), (56, "two words"), (57, "Two  words"), (58, "other words")]
    got = {r.doc_id: r.component_id for r in similar.similar_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert [got[i] for i, _ in docs] == brute(docs)


def test_near_dedup_stage_drops_copies_with_changed_words(spark):
    docs = copies(5, 4, 4)
    frame = spark.createDataFrame([(i, t, "s", len(t)) for i, t in docs], "doc_id long, text string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect())
    assert kept == [0, 4, 8, 12, 16]


def test_crowd_links_reach_chains():
    sets = [np.arange(i, i + 50) for i in range(0, 40, 2)] + [np.arange(1000, 1050)]
    found = similar.crowd_links(sets, 0.8)
    assert len(found) == 19 and all(x != 20 for pair in found for x in pair)
