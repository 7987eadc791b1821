import hashlib
import random

import numpy as np
import pytest

from modsift.llm import bwt, near_dedup, substring_dedup
from modsift.llm.shingles import shingle_hashes, word_hashes


def test_word_hashes_follow_words():
    text = ("some words  here\tand\nthere " * 3 + "x" * 300 + " ").encode()
    words = text.split()
    h = word_hashes(text)
    assert len(h) == len(words) and len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    assert word_hashes(b"").size == word_hashes(b" \n").size == 0


def test_word_hashes_by_block(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500)).encode() + b" " + b"y" * 5000 + b" end"
    whole = word_hashes(text)
    monkeypatch.setattr("modsift.llm.shingles.BLOCK", 64)
    assert (word_hashes(text) == whole).all()


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    ones = np.ones(400)
    sig = near_dedup.prob_minhash(np.concatenate([a, b]), np.concatenate([ones, ones]), np.array([0, 400, 800]), 2000)
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.05
    # Weights: doubling all of them changes nothing that the measure sees; one heavy shingle in both dominates.
    heavy = np.where(np.arange(400) == 0, 4000.0, 1.0)
    sig = near_dedup.prob_minhash(np.concatenate([a, b]), np.concatenate([heavy, heavy * 2]), np.array([0, 400, 800]), 500)
    assert (sig[0] == sig[1]).mean() > 0.9
    few = near_dedup.prob_minhash(a[:1], np.ones(1), np.array([0, 1]), 320)
    assert len(set(few[0].tolist())) == 1


def brute_classes(texts):
    sets = []
    for _, t in texts:
        w = (t or "").encode().split()
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i][0] is not None and texts[j][0] is not None and sets[i] and sets[j] and label[i] != label[j]:
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                    old, new = label[i], label[j]
                    label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(texts, label):
        least[x] = min(least.get(x, 1 << 60), i if i is not None else 1 << 60)
    return sorted(((i if i is not None else -1), least[x] if i is not None else -1) for (i, _), x in zip(texts, label))


def family(rng, size, words=120, edits=6):
    """A star: a base text and copies with some words changed, which often are alike only through the base."""
    base = [f"b{rng.randrange(5000)}" for _ in range(words)]
    out = [base]
    for _ in range(size - 1):
        copy = list(base)
        for at in rng.sample(range(words), rng.randrange(edits)):
            copy[at] = f"e{rng.randrange(5000)}"
        out.append(copy)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("block", [4096, 4])
def test_classes_match_brute_force(docs_of, odd, block):
    rng = random.Random(5)
    texts = [t for n in (2, 3, 25) for t in family(rng, n)] + ["unrelated words only here " + str(i) for i in range(5)] + ["k " * 30] * 4
    rows = [(100 + i, t) for i, t in enumerate(texts)] + odd[1]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1) for r in near_dedup.near_classes(docs_of(rows), block=block).collect())
    assert got == brute_classes(rows)


@pytest.mark.parametrize("block", [4096, 2])
def test_texts_under_one_id_are_members_of_their_own(docs_of, block):
    """An id on a copy of a smaller id's text and on a text of its own, and one on two texts with equal shingles."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(4, a), (5, a), (5, b), (6, b + " more"), (7, c), (7, c.replace(" ", "  ")), (8, d), (9, d + " x"), (9, a + " y"), (5, b)]
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in near_dedup.near_classes(docs_of(rows), block=block).collect())
    assert got == sorted([(4, 4, 3), (5, 4, 3), (9, 4, 3), (5, 5, 3), (5, 5, 3), (6, 5, 3), (7, 7, 2), (7, 7, 2), (8, 8, 2), (9, 8, 2)])
    kept = sorted((r.doc_id, " ".join(r.text.split())) for r in near_dedup.keep_one(docs_of(rows), block=block).collect())
    assert kept == [(4, a), (5, b), (5, b), (7, c), (8, d)]


def test_uneven_repetition_does_not_part_a_class(docs_of):
    """The same shingle set with some parts repeated often, and one with a few words changed besides."""
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(12):
        words = [f"{w}v{k}" for w in base]
        cycle = words[:60]
        rows.append((10 * k, " ".join(words + cycle)))  # the seam from last to first word
        rows.append((10 * k + 1, " ".join(words + cycle + words[60:] + cycle)))  # equal set, twice as often in part
        rows.append((10 * k + 2, " ".join(words + cycle + (cycle[5:20] + ["x"]) * 60)))
    sets = brute_classes(rows)
    got = sorted((r.doc_id, r.class_id) for r in near_dedup.near_classes(docs_of(rows)).collect())
    assert got == sets and len({c for _, c in got}) == 12


def test_a_large_family_meets_through_few_edges(docs_of, monkeypatch):
    """Each member has one edge to its family, not one for every bucket that it shares with others."""
    edges, links = [], near_dedup._links
    monkeypatch.setattr(near_dedup, "_links", lambda docs, reps, found, *rest: edges.append(found.count()) or links(docs, reps, found, *rest))
    rows = list(enumerate(family(random.Random(2), 400, edits=7)))
    got = sorted((r.doc_id, r.class_id) for r in near_dedup.near_classes(docs_of(rows)).collect())
    assert got == brute_classes(rows) and len(rows) - 1 <= edges[0] < 3 * len(rows)


def test_candidate_edges_keep_the_components(spark):
    rng = random.Random(4)
    buckets = [rng.sample(range(300), rng.randrange(2, 6)) for _ in range(120)]
    met = spark.createDataFrame([(r, min(b), len(b)) for b in buckets for r in b], "rep LONG, low LONG, n LONG")
    found = [tuple(r) for r in near_dedup._candidate_edges(met).collect()]

    def parts(edges):
        label = list(range(300))
        for a, b in edges:
            old, new = label[a], label[b]
            label = [new if x == old else x for x in label]
        least = {}
        for i, x in enumerate(label):
            least.setdefault(x, i)
        return [least[x] for x in label]

    assert all(a < b for a, b in found) and len(found) == len(set(found))
    assert parts(found) == parts((min(b), r) for b in buckets for r in b)


def test_keep_one_and_empty(docs_of, odd):
    df = docs_of([(3, "a b c d e f"), (1, "a b c d e f"), (2, "x y"), (4, None), (5, "")])
    kept = near_dedup.keep_one(df)
    assert kept.schema.names == df.schema.names and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]
    assert near_dedup.near_classes(df.limit(0)).count() == 0
    sizes = {r.doc_id: r.class_size for r in near_dedup.near_classes(df).collect()}
    assert sizes == {1: 2, 3: 2, 2: 1, 4: 1, 5: 1}
    assert near_dedup.near_classes(odd[0]).count() == len(odd[1])


# --- merged transforms ----------------------------------------------------------------
def test_merge_orders_all_suffixes():
    rng = random.Random(2)
    shards = [np.array([rng.randrange(1, 4) for _ in range(40)] + [0], np.uint8) for _ in range(3)]
    orders, transforms = zip(*(bwt.shard_transform(x) for x in shards))
    source, group, common = bwt.merge(list(transforms), 6, lcp=True)
    seen = [0] * 3
    prefixes = []
    for s in source.tolist():
        at = orders[s][seen[s]]
        seen[s] += 1
        prefixes.append(tuple(np.roll(shards[s], -at)[:6].tolist()))
    assert prefixes == sorted(prefixes)
    for i in range(1, len(prefixes)):
        assert (group[i] == group[i - 1]) == (prefixes[i] == prefixes[i - 1])
        equal = next((k for k in range(6) if prefixes[i][k] != prefixes[i - 1][k]), 6)
        assert common[i] == equal // 2 * 2


def brute_passages(texts, length=50):
    first, out = {}, []
    order = sorted(texts, key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in order:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], (i is None, i or 0))
    for i, t in texts:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (i is None, i or 0):
                covered[s : s + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        out.append((-1 if i is None else i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("heavy,ranges", [(20_000, 400_000), (1, 300)])
def test_passages_match_brute_force(docs_of, odd, heavy, ranges):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = [(20 + i, " ".join([word(), rng.choice(passages)[rng.randrange(30) :], word(), rng.choice(passages), "zz " * rng.randrange(40)])) for i in range(30)]
    rows = texts + [r for r in odd[1] if not r[1] or len(r[1]) < 1000] + [(60, "ab" * 200), (61, "ab" * 100 + "\x00" * 60), (62, "\x00" * 80)]
    got = substring_dedup.repeated_passages(docs_of(rows), heavy=heavy, range_anchors=ranges).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_passages(rows)


def test_passages_of_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = substring_dedup.repeated_passages(documents).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_passages(rows)
    assert substring_dedup.repeated_passages(documents.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.repeated_passages(documents, length=20)


def test_shingles_of_short_texts():
    assert len(shingle_hashes(b"a b c")) == 1 and len(shingle_hashes(b"a b c d e f")) == 2
    assert shingle_hashes(b"a b c")[0] == shingle_hashes(b" a  b\nc ")[0] != shingle_hashes(b"a b d")[0]
