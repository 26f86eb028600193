import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from conftest import ROWS
from emberline.llm import decontaminate, packing, queries
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(items, capacity):
    items = sorted(items, reverse=True)
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_dominance_keeps_the_optimum_and_best_fit_is_close():
    rng = random.Random(1)
    over = 0
    for _ in range(400):
        capacity = rng.choice([10, 20, 50])
        items = Counter(rng.randint(rng.choice([1, capacity // 4]), capacity) for _ in range(rng.randint(0, 8)))
        fixed, rest = packing.reduce(dict(items), capacity)
        best = fewest(list(items.elements()), capacity)
        assert sum(t for t, _ in fixed) + (fewest(list(Counter(rest).elements()), capacity) if rest else 0) == best
        found = packing.patterns(dict(items), capacity)
        held = Counter()
        for times, members in found:
            assert sum(n * k for n, k in members) <= capacity
            for n, k in members:
                held[n] += times * k
        assert held == items
        over += sum(t for t, _ in found) - best
    assert over <= 4


def check_packed(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[doc_id, k // capacity, k, len(part), crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(r.length for r in rows)
    return len(by), -(-total // capacity)


def test_packing_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = check_packed(queries.op8_best_fit_packing(spark, sf).collect(), texts, 4096)
    assert used <= least + 1


@pytest.mark.parametrize("part", [3, 200_000])
def test_packing_odd_rows(odd, empty, part, monkeypatch):
    monkeypatch.setattr(packing, "PART", part)
    check_packed(packing.pack(odd, capacity=64).collect(), [(i, t) for i, t, *_ in ROWS], 64)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize(
    "text",
    ["don't  stop\t<|endoftext|> now", "<|startoftext|>x<|endoftext|>", "e\u0301 ΑΣ ΑΣ. İ", "a\u00a0b\u2003c\x1cd", "\r\n x\n\n y", "x" * 5000, "ﬁ ½ ①", "'s 't're 12345"],
)
def test_chunks_give_the_tokenizer_ids(text):
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [1]
    assert packing.token_bytes(["a b", text, None], PATH)[1] == np.array(ids, "<u4").tobytes()


def brute_matches(docs, items, n=5, threshold=0.8):
    out = set()
    for item_id, item in items:
        words = decontaminate.words_of(item)
        if not words:
            continue
        m = min(n, len(words))
        s = decontaminate.shingles(words, m)
        for doc_id, text in docs:
            w = decontaminate.words_of(text)
            if len(w) >= m:
                shared = len(s & decontaminate.shingles(w, m))
                if shared >= threshold * len(s):
                    out.add((doc_id, item_id, shared, len(s)))
    return out


def test_leaks_by_brute_force(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    tests = [(r.item_id, r.text) for r in items.collect()]
    # documents that hold an item with some words changed, around the threshold
    for k, (item_id, text) in enumerate(tests[:12]):
        w = text.split()
        for j in range(k % 4):
            w[(7 * j + 3) % len(w)] = "changed"
        rows.append((10_000 + k, " ".join(["before"] * 30 + w + ["after"] * 200)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontaminate.search(df, items).collect()}
    assert got == brute_matches(rows, tests)
    kept = {r.doc_id for r in decontaminate.drop_contaminated(df, items).collect()}
    assert kept == {i for i, _ in rows} - {g[0] for g in got}


def test_leaks_in_blocks_and_odd_rows(spark, odd, empty, monkeypatch):
    items = spark.createDataFrame([(1, "Alpha beta gamma delta"), (2, None), (3, ""), (None, "word word word word word word"), (1, "Alpha beta gamma delta"), (4, "straße 😀 ünï")], "item_id long, text string")
    want = brute_matches([(i, t) for i, t, *_ in ROWS], {(r.item_id, r.text) for r in items.collect() if r.text})
    for chars in (decontaminate.BLOCK_CHARS, 10):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", chars)
        assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in decontaminate.search(odd, items).collect()} == want
        kept = decontaminate.drop_contaminated(odd, items)
        assert kept.columns == odd.columns and kept.count() == sum(i not in {w[0] for w in want} for i, *_ in ROWS)
    assert decontaminate.search(empty, items).count() == 0 and decontaminate.search(odd, items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(odd, items.limit(0)).count() == odd.count()


def test_words_of_many_texts_are_remembered():
    chunks = packing.Chunks(PATH)
    first = chunks.of([" ".join(f"w{i}" for i in range(150_000))])
    chunks.of(["other words"])
    assert "w0" in chunks.chunks and "w" in chunks.words
    assert chunks.of([" ".join(f"w{i}" for i in range(150_000))]) == first


def test_frequent_words_are_tokenised_once(monkeypatch):
    class Counting:
        def __init__(self, model):
            self.model, self.seen = model, Counter()

        def tokenize(self, word):
            self.seen[word] += 1
            return self.model.tokenize(word)

    monkeypatch.setattr(packing.Chunks, "MOST", 200)
    chunks = packing.Chunks(PATH)
    chunks.model = Counting(chunks.model)
    often = ["the", "burned", "area"]
    for k in range(30):
        rare = ["".join(chr(97 + int(d)) for d in f"{k:02}{i:03}") for i in range(60)]
        chunks.of([" ".join([*often, *rare])])
    assert all(chunks.model.seen[w] == 1 for w in often)
    assert len(chunks.chunks) <= 200 + 64 and len(chunks.older_chunks) <= 200 + 64
    assert len(chunks.words) <= 200 + 64 and len(chunks.older_words) <= 200 + 64


def test_random_texts_give_the_tokenizer_ids(monkeypatch):
    monkeypatch.setattr(packing.Chunks, "MOST", 50)
    rng = random.Random(5)
    signs = [*"aabbeessttTHE  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\xad''.,!?<|>09_-/", *"ÀÖ×Øßöµ÷ÿªº½", *"\u0301\u2019\u2028ſKİıσςΣжЖ漢😀ﬁ", "'s", "'RE", " 'll ", "<|endoftext|>", "<|ENDOFTEXT|>", "the "]
    batches = [[None if rng.random() < 0.05 else "".join(rng.choices(signs[: rng.choice([14, 40, len(signs)])], k=rng.randint(0, 60))) for _ in range(rng.randint(0, 12))] for _ in range(120)]
    tokenizer, chunks = Tokenizer.from_file(PATH), packing.Chunks(PATH)
    for batch in batches:
        want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for t in batch]
        assert chunks.of(batch) == want


def test_batches_are_cut_by_bytes(odd, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 40)
    check_packed(packing.pack(odd, capacity=64).collect(), [(i, t) for i, t, *_ in ROWS], 64)
