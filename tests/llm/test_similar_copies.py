import corpus_pipeline
import numpy as np
from emberline.llm import simhash_dedup


def words(seed, n):
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n)]


def edited(base, seed, edits):
    w = list(base)
    for k, at in enumerate(np.random.default_rng(seed).choice(np.arange(5, len(w) - 5), edits, replace=False)):
        w[at] = f"edit{seed}x{k}"
    return " ".join(w)


def brute_similar(texts, n=5, threshold=0.8):
    """doc_id -> smallest reachable doc_id, by the exact Jaccard similarity of all pairs."""
    ids = sorted(texts)
    sets = []
    for i in ids:
        w = texts[i].lower().split()
        m = min(n, len(w))
        sets.append({" ".join(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set())
    number = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    on = np.zeros((len(ids), len(number)), np.float32)
    for k, x in enumerate(sets):
        on[k, [number[y] for y in x]] = 1
    shared = on @ on.T
    size = on.sum(axis=1)
    near = shared >= threshold * (size[:, None] + size[None, :] - shared)
    root = np.arange(len(ids))
    while True:
        new = np.array([root[near[k]].min() for k in range(len(ids))])
        if (new == root).all():
            return {i: ids[r] for i, r in zip(ids, root)}
        root = new


def test_pipeline_by_brute_force(spark, tmp_path):
    texts = {}
    for g in range(6):
        base = words(500 + g, 220)
        texts |= {100 * g + c: edited(base, 100 * g + c, c % 4) for c in range(10)}
    texts |= {9000 + i: " ".join(words(700 + i, 150)) for i in range(20)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert got == set(brute_similar(texts).values())


def test_large_group_of_copies_that_only_share_their_source(spark):
    # two edits of the source are 0.70 similar, an edit and the source 0.84, so only the source holds the group together
    base = words(1, 60)
    texts = {i: edited(base, i, 1) for i in range(2000)} | {1500: " ".join(base)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    # copies that meet it under no fingerprint stay apart; all others have to be with it
    prints = {i: simhash_dedup.sketches(t) for i, t in texts.items()}
    meet = {i for i in texts if any(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in zip(prints[i], prints[1500]))}
    want = brute_similar(texts)
    got = {r.doc_id: r.component_id for r in simhash_dedup.group_similar(df).collect()}
    joined = {i for i in meet if want[i] == want[1500]}
    assert len(joined) > 300
    assert {got[i] for i in joined} == {min(joined)}


def test_a_chain_needs_all_fingerprints(spark):
    """A document that has a link already still links others under later fingerprints."""
    texts = {}
    for g in range(60):
        a = words(3000 + g, 100)
        b = a[:20] + ["one"] + a[21:]
        c = b[:70] + ["two", "three"] + b[72:]
        texts |= {3 * g + k: " ".join(w) for k, w in enumerate((a, b, c))}
    prints = {i: simhash_dedup.sketches(t) for i, t in texts.items()}
    near = lambda i, j: any(((x ^ y) & (1 << 64) - 1).bit_count() <= 3 for x, y in zip(prints[i], prints[j]))
    whole = [g for g in range(60) if near(3 * g, 3 * g + 1) and near(3 * g + 1, 3 * g + 2)]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash_dedup.group_similar(df).collect()}
    assert len(whole) > 5 and all(got[3 * g + 2] == 3 * g for g in whole)


def test_counts_never_hide_a_link():
    rng = np.random.default_rng(5)
    for n in (0, 1, 40, 3000, 200_000):
        x = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4"))
        y = np.unique(np.concatenate([x[: n * 9 // 10], rng.integers(0, 1 << 32, n // 10, dtype=np.uint64).astype("<u4")]))
        exact, total = simhash_dedup.shared_codes(x.tobytes(), y.tobytes())
        most, same = simhash_dedup.shared_at_most(simhash_dedup.shingle_counts(x.tobytes()), simhash_dedup.shingle_counts(y.tobytes()))
        assert same == total and exact <= most <= min(len(x), len(y))


def test_every_five_bytes_hold_a_plane():
    masks = {sum(0xFF << (8 * i) for i in five) for five in simhash_dedup.combinations(range(8), 5)}
    assert len(simhash_dedup.PLANES) == 14 and all(any(m & p == p for p in simhash_dedup.PLANES) for m in masks)


def test_near_pairs_are_all_linked(spark):
    """Texts that are near under a fingerprint and reach the similarity are linked; what is linked reaches it."""
    texts = {}
    for g in range(150):
        base = words(8000 + g, 120)
        texts |= {2 * g: " ".join(base), 2 * g + 1: edited(base, g, 1 + g % 3)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash_dedup.group_similar(df).collect()}
    prints = {i: simhash_dedup.sketches(t) for i, t in texts.items()}
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1)
    near = lambda a, b: apart(a, b).bit_count() <= 4 and apart(a, b).to_bytes(8, "big").count(0) >= 5
    want = brute_similar(texts)
    for i in range(0, 300, 2):
        linked = want[i + 1] == i and any(near(a, b) for a, b in zip(prints[i], prints[i + 1]))
        assert (got[i + 1] == i) == linked


def test_members_of_long_lists_have_few_candidates(spark):
    """A copy is in hundreds of long lists with the other copies; besides those that it is near it has one candidate for them all."""
    base = words(77, 150)
    prints = {i: simhash_dedup.sketches(edited(base, i, 1 + i % 4)) for i in range(300)}
    links, members = simhash_dedup._close(spark.createDataFrame(list(prints.items()), "id long, fs array<long>"))
    in_long = {r.id for r in members.select("id").distinct().collect()}
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1)
    near = lambda a, b: apart(a, b).bit_count() <= 4 and apart(a, b).to_bytes(8, "big").count(0) >= 5
    far = [r for r in links.collect() if not any(near(x, y) for x, y in zip(prints[r.a], prints[r.b]))]
    assert len(in_long) > 200 and len(far) <= len(in_long)


def test_links_of_a_block_are_thinned_to_a_forest():
    rng = np.random.default_rng(3)
    pairs = [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(500)]
    kept = simhash_dedup._forest(iter(pairs))

    def parts(links):
        root = {i: i for i in range(60)}
        for _ in range(60):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert len(kept) < 60 and parts([pairs[k] for k in kept]) == parts(pairs)
