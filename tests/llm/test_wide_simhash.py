"""Near-dedup of the pipeline goes by SimHash first, and loses no pair for it."""

import random

import pytest

from clonospark.llm import jaccard, simhash


def components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("radius", [3, 11])
def test_wide_links_connect_what_brute_force_does(spark, radius):
    rnd = random.Random(radius)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for f in fps[:50]:
        for k in (1, 6, 10, 11, 12, 14):
            for b in rnd.sample(range(64), k):
                f ^= 1 << b
            fps.append(f)
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    got = [(r.a, r.b) for r in simhash.wide_links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius).collect()]
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius]
    assert components(fps, got) == components(fps, near)


def test_near_dedup_links_edited_copies_by_simhash(spark, monkeypatch):
    """Copies with one changed word of 150 to 400 are all found before any prefix is looked up."""
    import corpus_pipeline

    rnd, steps = random.Random(5), []
    texts = []
    for _ in range(20):
        w = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(rnd.randint(150, 400))]
        texts += [" ".join(w), " ".join([*w[:70], "edited", *w[71:]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "_links", lambda pairs, *a, links=jaccard._links: steps.append(links(pairs, *a)) or steps[-1])
    near = corpus_pipeline.near_dedup(spark, df, "").select("doc_id")
    assert sorted(r.doc_id for r in near.collect()) == list(range(0, 40, 2))
    found = jaccard._alike(jaccard._sets(df, "doc_id", "text", 5))
    assert found.count() == 20
    assert len(steps) == 3
