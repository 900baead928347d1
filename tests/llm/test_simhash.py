"""Against brute force over all pairs."""

import random

import numpy as np
import xxhash

from evalspark.llm import simhash
from evalspark.llm.components import components
from evalspark.llm.simhash import GrayIndex, near_duplicates_removed, near_links, simhash_near_dedup


def _bits(text):
    words = text.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def _classes(prints, distance):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= distance:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def _close_prints(rng, groups, each):
    found = set()
    for _ in range(groups):
        base = rng.getrandbits(64)
        for _ in range(each):
            value = base
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                value ^= 1 << bit
            found.add(value)
    return sorted(found)


def _signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_gray_index_finds_all_pairs():
    rng = random.Random(1)
    prints = np.array(_close_prints(rng, 10, 40), np.uint64)
    query, other = GrayIndex(prints).search(prints, 2)
    expected = {(i, j) for i in range(len(prints)) for j in range(len(prints)) if int(prints[i] ^ prints[j]).bit_count() <= 2}
    assert set(zip(query.tolist(), other.tolist())) == expected


def test_the_index_prunes():
    """Random fingerprints, and groups of near ones: few nodes are looked at beside those on the way to a hit."""
    rng = random.Random(4)
    for prints in ([rng.getrandbits(64) for _ in range(4096)], _close_prints(rng, 400, 10)):
        prints = np.array(sorted(set(prints)), np.uint64)
        index = GrayIndex(prints)
        hits = len(index.search(prints, 2)[0])
        nodes = sum(len(pattern) for pattern, _ in index.levels)
        assert hits >= len(prints) and index.visited < 0.2 * nodes * len(prints)


def test_links_connect_what_brute_force_connects(spark, monkeypatch):
    rng = random.Random(2)
    prints = _close_prints(rng, 6, 60) + [0, 1, 3, 7]
    prints = sorted(set(prints))
    frame = spark.createDataFrame([(_signed(p),) for p in prints], "fingerprint long")
    expected = _classes(prints, 2)
    for largest, indexed in ((8192, 4096), (8192, 1), (10, 4096), (1, 3)):
        monkeypatch.setattr(simhash, "LEAST_INDEXED", indexed)
        roots = {row.node & (1 << 64) - 1: row.root & (1 << 64) - 1 for row in components(near_links(frame, 2, largest)).collect()}
        groups, wanted = {}, {}
        for p in prints:
            groups.setdefault(roots.get(p, p), set()).add(p)
            wanted.setdefault(expected[p], set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_documents(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "délta", "x", "yy"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    texts += [None, "", " \n\t", "One", "one two", texts[0], texts[0] + " end", texts[0].upper(), "a b c " * 30_000]
    rows = [(i, text, "clash") for i, text in enumerate(texts)] + [(3, texts[5], "again"), (None, texts[7], "null")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    result = simhash_near_dedup(frame).collect()
    assert len(result) == len(rows)
    prints = [_bits(text or "") for _, text, _ in rows]
    classes = _classes(sorted(set(prints)), 2)
    least = {}
    for (key, _, _), p in zip(rows, prints):
        if key is not None:
            least[classes[p]] = min(key, least.get(classes[p], key))
    expected = sorted(((key, f"{p:016x}", least[classes[p]]) for (key, _, _), p in zip(rows, prints)), key=repr)
    assert sorted((tuple(row) for row in result), key=repr) == expected


    one_of_each = near_duplicates_removed(frame)
    assert one_of_each.columns == frame.columns
    kept = [(row.doc_id, classes[_bits(row.text or "")]) for row in one_of_each.collect()]
    assert sorted(kept, key=repr) == sorted(((key, c) for c, key in least.items()), key=repr)


def test_empty_table(spark):
    assert near_duplicates_removed(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert simhash_near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (700, 600), (600, 700)], "a long, b long")
    found = {row.node: row.root for row in components(links).collect()}
    assert found == {**{i: 0 for i in range(201)}, 600: 600, 700: 600}


def test_masks_leave_room_for_the_distance():
    masks = simhash.block_masks(2)
    assert len(masks) == 6 and all(mask.bit_count() == 32 for mask in masks)
