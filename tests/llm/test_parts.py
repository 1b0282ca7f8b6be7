"""The operators' parts against brute force, without Spark."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import chunks, decontaminate, language, near_dup, quality, tokens, topk


def test_sum_of_squares_equals_all_pairs():
    draw = np.random.default_rng(1)
    machine = quality.Machine(
        0.3, draw.normal(size=quality.SLOTS).astype(np.float32),
        draw.normal(size=(quality.SLOTS, quality.FACTORS)).astype(np.float32))
    slots, amounts = np.array([3, 9, 700]), np.array([0.5, 1.0, 2.0], np.float32)
    pairs = sum(
        machine.factors[slots[i]] @ machine.factors[slots[j]] * amounts[i] * amounts[j]
        for i in range(3) for j in range(i))
    expected = 0.3 + machine.weights[slots] @ amounts + pairs
    assert machine.raw(slots, amounts, np.array([0]))[0] == pytest.approx(expected, rel=1e-4)


@pytest.mark.parametrize("text", [None, "", " ", "!!", "a" * 100_000, "x y " * 50_000])
def test_features_of_odd_texts(text):
    slots, amounts = quality.Featuriser()(text, None)
    assert len(slots) == len(amounts) >= len(quality.STATISTICS)
    assert np.isfinite(amounts).all() and slots.max() < quality.SLOTS


def test_bit_sliced_search_equals_sorting():
    draw = np.random.default_rng(2)
    for size, width, spread in ((1, 3, 5), (70, 5, 2), (300, 8, 60), (128, 4, 0)):
        rows = draw.integers(-spread, spread + 1, (size, width))
        ids = np.sort(draw.choice(1000, size, replace=False)).astype(np.int64)
        found = topk.search_block(rows, ids, ids, topk.build_index(rows), 20)
        for query, own, (near, scores) in zip(rows, ids, found):
            exact = sorted((-int(query @ row), int(i)) for row, i in zip(rows, ids) if i != own)
            assert sorted(zip((-scores).tolist(), near.tolist())) == exact[:20]


@pytest.mark.parametrize("width", [1, 7, 16, 17, 31, 32])
@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
def test_bits_round_trip(width, size):
    ids = np.random.default_rng(width).integers(0, 1 << width, size)
    words = tokens.pack_ids(ids, width)
    assert len(words) == -(-size // 64) * width
    assert tokens.unpack_ids(words, width, 0, size).tolist() == ids.tolist()
    assert tokens.unpack_ids(words, width, size // 3, size // 2).tolist() == ids[
        size // 3:size // 2].tolist()


def test_pieces_encode_like_whole_texts(monkeypatch):
    encoder = tokens.Encoder(tokens.vocabulary_path())
    texts = [
        "", " ", "  a  b ", "a \n b", "a\n\nb", "don't, I'll\nGo. he's", "x.\n\ny z", "é.\nÉa,b",
        "tab\tq  \n", "<|endoftext|> hi", "a\r\nb c\x85d e\x1cf g", "12,3 45.6\n7a", "ab\n,c",
        "q|\nr|s |t", "\U0001f600 z!!\nA", "word " * 1000,
    ]
    monkeypatch.setattr(tokens, "REMEMBERED", 7)
    for text in texts * 2:
        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder(text), "<u4").tolist() == whole


def test_automaton_equals_windows():
    chance = random.Random(3)
    for _ in range(60):
        items = [(str(i), [chance.choice([b"a", b"b", b"c"]) for _ in range(chance.randrange(9))])
                 for i in range(5)]
        words = [chance.choice([b"a", b"b", b"c", b"z"]) for _ in range(80)]
        expected, names = np.zeros(80, bool), set()
        for name, item in items:
            n = min(4, len(item))
            for window in {tuple(item[i:i + n]) for i in range(len(item) - n + 1)} if n else ():
                for at in range(80 - n + 1):
                    if tuple(words[at:at + n]) == window:
                        expected[at:at + n] = True
                        names.add(name)
        hit = np.zeros(80, bool)
        found = decontaminate.Automaton(items, window=4).match(words, hit)
        assert found == names and hit.tolist() == expected.tolist()


def test_hits_are_cut_out():
    text = "Keep this, drop THESE words; and end.".encode()
    hit = np.array([0, 0, 1, 1, 1, 0, 0], bool)
    assert decontaminate.without_hits(text, hit) == b"Keep this, and end."
    assert decontaminate.without_hits(text, ~hit) == b"drop THESE words; "


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_band_equals_whole_table():
    chance = random.Random(4)
    for _ in range(2000):
        a = [chance.randrange(4) for _ in range(chance.randrange(1, 25))]
        b = [x for x in a if chance.random() > 0.1] + [9] * chance.randrange(3) or [1]
        limit = chance.randrange(max(len(a), len(b)))
        exact = plain_distance(a, b)
        assert near_dup.distance(a, b, limit) == (exact if exact <= limit else None)


def test_long_lists_are_aligned_in_places(monkeypatch):
    chance = random.Random(14)
    for size in (20, 300):
        for _ in range(40):
            a = [chance.randrange(30) for _ in range(size)]
            b = [x for x in a if chance.random() > 0.05]
            limit = chance.randrange(1, size // 3)
            monkeypatch.setattr(near_dup, "LONG", 1 << 15)
            dense = near_dup.distance(a, b, limit)
            monkeypatch.setattr(near_dup, "LONG", 0)
            assert near_dup.distance(a, b, limit) == dense


def test_a_million_words_in_bounded_memory():
    words = np.random.default_rng(3).integers(0, 50_000, 1_000_000).tolist()
    other = words[:400_000] + [-1] * 30 + words[400_020:]
    tracemalloc.start()
    assert near_dup.distance(words, other, 200) == 30
    masks = near_dup.Masks(words, 400_001)
    assert bin(masks(words[5], 0)).count("1") == words[:400_001].count(words[5])
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_bags_never_rule_out_a_near_pair():
    chance = random.Random(6)
    hashes = near_dup.WordHashes()
    for _ in range(500):
        a = [f"w{chance.randrange(40)}" for _ in range(chance.randrange(1, 90))]
        b = list(a)
        for _ in range(chance.randrange(1 + len(a) // 3)):
            place = chance.randrange(len(b) + 1)
            b[place:place + chance.randrange(2)] = ["x"] * chance.randrange(2)
        limit = near_dup.limit_of(max(len(a), len(b)))
        if b and plain_distance(a, b) <= limit:
            x, _ = near_dup.bags_of(pa.array([near_dup.bag_of(hashes.of(t)) for t in (a, b)]))
            assert not near_dup.apart(x[:1], x[1:], np.array([limit]))[0]


def test_cells_compare_all_classes():
    chance = random.Random(7)
    hashes = near_dup.WordHashes()
    texts = [[f"w{chance.randrange(9)}" for _ in range(chance.randrange(3, 12))] for _ in range(90)]
    bags = pa.array([near_dup.bag_of(hashes.of(t)) for t in texts])
    side, root = np.arange(90) % 2, np.arange(90) % 7
    table, words = near_dup.bags_of(bags)
    limits = near_dup.limits_of(words)
    for within in (True, False):
        found = {frozenset((int(a), int(b))) for x, y in near_dup._met_in_cell(
            side, root, bags, within) for a, b in zip(x, y)}
        assert found == {
            frozenset((i, j)) for i in range(90) for j in range(i)
            if root[i] != root[j] and (within or side[i] != side[j])
            and not near_dup.apart(table[[i]], table[[j]], np.maximum(limits[[i]], limits[[j]]))[0]}


# Words, similarity, how the edits are placed; at least nine in ten pairs must share a bucket.
SHAPES = [(5, 0.8, "middle"), (6, 0.8, "middle"), (9, 0.8, "middle"), (10, 0.9, "random"),
          (14, 0.8, "random"), (20, 0.8, "random"), (20, 0.85, "random"), (25, 0.8, "random"),
          (26, 0.8, "random"), (40, 0.8, "random"), (100, 0.8, "random"), (100, 0.85, "random"),
          (500, 0.8, "random"), (500, 0.8, "even")]


@pytest.mark.parametrize("size, similarity, placed", SHAPES)
def test_share_of_near_pairs_that_meet(size, similarity, placed):
    draw = np.random.default_rng([size, int(100 * similarity)])
    edits = int((1 - similarity) * size + 1e-9)
    met = 0
    for _ in range(150):
        a = draw.integers(1, 1 << 62, size).astype(np.uint64)
        b = a.copy()
        places = {"middle": [size // 2], "even": np.arange(edits) * size // max(edits, 1) + 2,
                  "random": draw.choice(size, edits, replace=False)}[placed]
        b[places] = draw.integers(1, 1 << 62, len(places)).astype(np.uint64)
        met += bool(set(near_dup.keys_of(a).tolist()) & set(near_dup.keys_of(b).tolist()))
    print(f"{size} words, {similarity}, {placed}: {met / 150:.3f}")
    assert met >= 135


def test_sketch_is_the_same_where_another_word_repeats():
    base = np.arange(1, 400, dtype=np.uint64) * near_dup.LABEL
    one = near_dup.sketch(near_dup.labelled_kmers(base))
    two = near_dup.sketch(near_dup.labelled_kmers(np.concatenate([base, base[:6]])))
    assert (one == two).sum() > near_dup.SKETCHES // 2


def test_chunks_cover_and_resist_an_insertion():
    chance = random.Random(5)
    data = bytes(chance.randrange(97, 123) for _ in range(20_000))
    for text in (data, data[:1], data[:300], b"a" * 5000):
        ends = chunks.cuts(text)
        assert ends[-1] == len(text) and ends == sorted(set(ends))
        assert max(b - a for a, b in zip([0, *ends], ends)) <= chunks.LARGEST

    def parts(text):
        ends = chunks.cuts(text)
        return {hashlib.md5(text[a:b]).digest() for a, b in zip([0, *ends], ends)}

    old, new = parts(data), parts(data[:9000] + b"inserted" + data[9000:])
    assert len(old - new) <= 5


def test_trigrams_are_bundled():
    found = language.bundles(["ab", None, "", "123", "ab ab", "a" * 10_000])
    letters = language.letter_vectors().astype(int)
    a, b = (1 + ord(c) % language.LETTER_SLOTS for c in "ab")
    roll = lambda v, n: np.roll(v, n)
    expected = roll(letters[0], 2) * roll(letters[a], 1) * letters[b]
    expected = expected + roll(letters[a], 2) * roll(letters[b], 1) * letters[0]
    assert found[0].astype(int).tolist() == expected.tolist()
    assert not found[1:4].any() and found[5].any()


def test_tables_of_trigrams_are_as_large_as_their_letters_need():
    language.bundles(["ab"])
    tracemalloc.start()
    try:
        language.bundles(["some words", "other words"])
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()
