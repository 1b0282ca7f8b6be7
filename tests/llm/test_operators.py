"""The operators on small tables with every odd case."""

import random
import re
import textwrap
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import (
    chunks, common, decontaminate, language, licences, mixing, near_dup, quality, sharding, tokens, topk,
)

DDL = "doc_id long, text string, lang string, source string, n_chars long, label string"
WORDS = [f"w{i}x" for i in range(120)]
PROSE = " ".join(WORDS)
ODD = [
    (1, PROSE, "en", "a", 9, "x"), (2, PROSE + " more", "en", "a", 9, None),
    (3, None, None, None, None, None), (4, "", "en", "b", 0, ""), (None, "lost id", "de", "b", 7, ""),
    (5, PROSE, "en", "c", 9, "x"), (5, PROSE, "en", "c", 9, "x"), (6, "!!", None, "c", 2, ""),
    (7, "Released under the MIT Licence!", "en", None, 3, ""), (8, "ein wort " * 9000, "de", "d", 1, ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def items(spark):
    data = [(1, " ".join(WORDS[40:60])), (2, "lost id"), (3, None), (4, "?"), (None, "ein wort ein")]
    return spark.createDataFrame(data, "item_id long, text string")


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (2, None)], "doc_id long, quality int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    assert {r.doc_id: r.held_out for r in found}[1] == (zlib.crc32(b"1") % 4 == 2)
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {round(r.score, 6) for r in none} == {0.5}
    assert quality.classify(empty, labels).count() == 0


def test_language(docs, empty):
    found = {(r.doc_id, r.lang_pred) for r in language.identify(docs).collect()}
    assert {(3, "und"), (4, "und"), (6, "und")} <= found
    assert language.identify(empty).count() == 0
    assert set(language.predict(docs, [], None).select("lang_pred").distinct().first()) == {"und"}


def test_top_k(spark, monkeypatch):
    data = [(i, [float(i % 5), -float(i % 3), 0.5]) for i in range(90)]
    data += [(200, None), (220, [float("nan")] * 3), (240, [None, 1.0, 1.0]), (None, [1.0] * 3),
             (0, [0.0, 0.0, 0.5]), (260, [3e6, 0.0, -2e6]), (300, [1.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 AS score")
    rows = {i: [int(64 * x // 1) for x in v] for i, v in data[:90]} | {
        260: [192_000_000, 0, -128_000_000], 300: [64, 0, 0]}
    expected = []
    for q in [i for i in rows if i % 20 == 0]:
        near = sorted((-sum(a * b for a, b in zip(rows[q], rows[c])), c) for c in rows if c != q)
        expected += [(q, r, c, -s) for r, (s, c) in enumerate(near[:20], 1)]
    assert sorted(map(tuple, topk.top_k(table).collect())) == sorted(expected)
    assert topk.top_k(table.limit(0)).count() == 0
    monkeypatch.setattr(topk, "BLOCK_ROWS", 20)
    monkeypatch.setattr(topk, "CHUNK_QUERIES", 2)
    assert sorted(map(tuple, topk.top_k(table).collect())) == sorted(expected)
    far = spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        topk.top_k(far)
    far = spark.createDataFrame([(0, [1e15])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        topk.top_k(far)


def test_licences(docs, empty):
    found = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert found[7].license == "MIT line" and found[3].digest is None and found[1].license is None
    assert licences.scan(empty).count() == 0


def test_licence_text_in_other_dress(spark):
    text = dict(licences.KNOWN)["BSD-3-Clause"]
    other = "Copyright (c) 2020 Some One\n" + text.upper().replace(",", " ;") + "\nAll rights reserved"
    table = spark.createDataFrame([(1, other), (2, text + " too")], "doc_id long, text string")
    assert [r.license for r in licences.scan(table).orderBy("doc_id").collect()] == [
        "BSD-3-Clause", None]


def test_licence_files_with_titles_and_wrapped_anew(spark):
    known = dict(licences.KNOWN)
    bare = [t for n, t in licences.KNOWN if n == "MIT"][-1]
    wraps = [textwrap.fill(" ".join(bare.split()), width) for width in range(30, 100, 10)]
    texts = [("MIT", "MIT License\n\nCopyright (c) 2020 Some One\n\n" + t) for t in wraps]
    texts += [("MIT", "Copyright Some One\n\n" + bare), ("MIT", "\u00a9 Some One\n" + bare)]
    texts += [("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright 2001, Some One\nAll rights reserved.\n\n"
               + re.sub(r"(?m)^\d\.", "*", known["BSD-3-Clause"]))]
    texts += [(n, " ".join(known[n].split())) for n in ("MPL-2.0", "CC0-1.0")]
    texts += [(n, known[n].replace("\n", "\r\n")) for n in ("Apache-2.0", "GPL-3.0", "LGPL-2.1")]
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    found = licences.scan(table).orderBy("doc_id").collect()
    assert [r.license for r in found] == [name for name, _ in texts]


def test_decontaminate(docs, items, empty):
    found = {r.doc_id: r for r in decontaminate.report(docs, items).collect()}
    assert (found[1].n_words, found[1].n_hit, found[1].n_items) == (120, 20, 1)
    assert found[None].n_hit == 2 and found[3].n_words == 0 and not found[6].contaminated
    assert found[8].n_hit == 18_000 - 1 and found[8].n_items == 0
    some = decontaminate.matches(docs, items, limit=5).select("doc_id", "n_hit", "hit_items")
    one = decontaminate.matches(docs, items).select("doc_id", "n_hit", "hit_items")
    assert sorted(map(str, some.collect())) == sorted(map(str, one.collect()))
    kept = {r.doc_id: r for r in decontaminate.remove_spans(docs, items).collect()}
    assert kept[1].text == " ".join(WORDS[:40] + WORDS[60:]) and kept[1].n_chars == len(kept[1].text)
    assert None not in kept and 8 not in kept and kept[3].text is None and kept[1].label == "x"
    assert decontaminate.report(empty, items.limit(0)).count() == 0


def test_token_files(spark, docs, empty, tmp_path):
    folder = str(tmp_path / "packs")
    tokens.write_packs(docs, folder)
    rows = sorted(tokens.read_packs(spark, folder).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(rows) == len(ODD)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(len(rows))]
    encoder = tokens.Encoder(tokens.vocabulary_path())
    for i, text in ((3, ""), (7, ODD[8][1])):
        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids + [tokens.END]
        assert [x.tolist() for x in tokens.ids_of(spark, folder, i)] == [whole]
    assert len(tokens.ids_of(spark, folder, 5)) == 2
    expected, start = [], 0
    for i, text in sorted(((d[0], d[1] or "") for d in ODD), key=lambda d: -1 if d[0] is None else d[0]):
        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids + [tokens.END]
        expected.append((i, start, len(whole), zlib.crc32(np.array(whole, "<u4").tobytes())))
        start += len(whole)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == expected
    assert tokens.binary_output(empty).count() == 0


def test_shards(spark, docs, empty):
    found = sharding.sharded(docs).collect()
    assert {r.size for r in found if r.doc_id in (3, 4)} == {1}
    many = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text")
    rows = sharding.sharded(many).collect()
    for shard in range(8):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and 250 < len(slots) < 500
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    assert any(r.grown_shard == 8 for r in rows)
    assert sharding.sharded(empty).count() == 0


def test_near_duplicates(docs, empty):
    found = near_dup.near_duplicates(docs).collect()
    assert sorted(r.class_id for r in found if r.doc_id in (1, 2, 5)) == [1] * 4
    assert {r.class_id for r in found if r.doc_id in (3, 4, 6, 7, 8)} == {3, 4, 6, 7, 8}
    kept = near_dup.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 3 4 6 7 8 None".split())
    assert near_dup.near_duplicates(empty).count() == 0


def classes_by_brute_force(texts):
    near = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or near_dup.similar(texts[i], texts[j]) is not None:
                near = [near[j] if c == near[i] else c for c in near]
    return [near.index(c) for c in near]


def classes_found(spark, texts):
    found = near_dup.near_duplicates(spark.createDataFrame(
        list(enumerate(texts)), "doc_id long, text string")).collect()
    return [c for _, c in sorted((r.doc_id, r.class_id) for r in found)]


def edited(chance, words, share):
    words = list(words)
    for place in chance.sample(range(len(words)), int(len(words) * share)):
        words[place] = f"n{chance.randrange(10 ** 9)}"
    return " ".join(words)


def test_groups_that_hang_together_through_one_original(spark):
    chance = random.Random(11)
    original = [f"o{i}" for i in range(100)]
    texts = [edited(chance, original, 0.15) for _ in range(40)]
    texts.insert(23, " ".join(original))
    # a bucket of mostly unlike texts that share a passage, with a near pair in it
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + edited(chance, ["x"] * 60, 1) for _ in range(60)]
    texts += [edited(chance, t.split(), 0.1) for t in texts[50:60]]
    assert classes_found(spark, texts) == classes_by_brute_force(texts)


def test_pairs_near_the_threshold_and_short_texts(spark):
    chance = random.Random(12)
    texts = []
    for i, (size, share) in enumerate([(100, 0.2), (500, 0.2), (20, 0.15), (10, 0.1), (300, 0.18)] * 4):
        words = [f"t{i}x{n}" for n in range(size)]
        texts += [" ".join(words), edited(chance, words, share)]
    for i, size in enumerate((5, 6, 7, 8, 9, 100, 400)):  # one edit in the middle, one in five words
        words = [f"m{i}x{n}" for n in range(size)]
        other = [f"new{i}x{n}" if n % 5 == 2 and (size > 9 or n < 5) else w for n, w in enumerate(words)]
        texts += [" ".join(words), " ".join(other)]
    texts += ["a b c d", "a b c d e", "one two three", "one two four"]
    found, exact = classes_found(spark, texts), classes_by_brute_force(texts)
    assert all(f in (i, e) for i, (f, e) in enumerate(zip(found, exact)))
    joined = [i for i, e in enumerate(exact) if e != i]
    assert sum(found[i] == exact[i] for i in joined) >= 0.95 * len(joined)


def test_cells_of_a_large_bucket_meet_in_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rows = [(1, bytes([i]), bytes([i if i % 3 else 0])) for i in range(40)]
    dealt = near_dup.cells(spark.createDataFrame(rows, "bucket long, node binary, root binary"))
    members = {}
    for r in dealt.collect():
        members.setdefault((r.i, r.j), []).append((r.side, r.node[0], bytes(r.root)))
    found = [frozenset((x[1], y[1])) for (i, j), cell in members.items() for x in cell for y in cell
             if x[1] < y[1] and x[2] != y[2] and (i == j or x[0] != y[0])]
    assert len(found) == len(set(found)) and set(found) == {
        frozenset((x, y)) for x in range(40) for y in range(x) if rows[x][2] != rows[y][2]}


def test_texts_of_unlike_length_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    chance = random.Random(13)
    rows = [(1, bytes([i]), bytes([i if i % 3 else 0]), chance.choice([7, 20, *range(20, 400, 7)]))
            for i in range(120)]
    dealt = near_dup.cells(spark.createDataFrame(
        rows, "bucket long, node binary, root binary, words int")).collect()
    members = {}
    for r in dealt:
        members.setdefault((r.i, r.j), []).append((r.side, r.node[0], bytes(r.root)))
    found = [frozenset((x[1], y[1])) for (i, j), cell in members.items() for x in cell for y in cell
             if x[1] < y[1] and x[2] != y[2] and (i == j or x[0] != y[0])]
    reached = {frozenset((x, y)) for x in range(120) for y in range(x) if rows[x][2] != rows[y][2]
               and abs(rows[x][3] - rows[y][3]) <= near_dup.limit_of(max(rows[x][3], rows[y][3]))}
    assert len(found) == len(set(found)) and reached <= set(found)
    assert len(dealt) < 120 * 120 / 4 / 3  # a copy of every text for every block is 120 * 120 / 4


def test_copies_go_whatever_the_columns_are_called(spark):
    rows = [(1, PROSE, "n", "c", "k"), (2, PROSE + " more", "n", "c", "k"), (3, None, "n", "c", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, class string, bag string")
    kept = near_dup.without_copies(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3}
    assert {r.class_id for r in near_dup.near_duplicates(docs).collect()} == {1, 3}


def test_chain_of_links_is_one_component(spark):
    nodes = [bytes([i]) * 16 for i in range(60)]
    links = spark.createDataFrame(list(zip(nodes, nodes[1:])), "a binary, b binary")
    assert {bytes(r.root) for r in near_dup.components(links).collect()} == {nodes[0]}


def test_repeats(docs, empty):
    found = chunks.repeats(docs).collect()
    assert {(r.doc_id, r.first_doc_id) for r in found} == {(2, 1), (5, 1), (8, 8)}
    assert all(r.end - r.begin >= chunks.SPAN_BYTES for r in found)
    assert chunks.repeats(empty).count() == 0


def plain_cuts(data):
    ends, last = [], 0
    for at in range(len(data)):
        code = 0
        for byte in data[max(0, at - chunks.WINDOW + 1):at + 1]:
            code = ((code << 1) + int(chunks.GEAR[byte])) & 0xFFFF
        if code >> (chunks.WINDOW - chunks.MASK_BITS) == 0 and at + 1 - last >= chunks.SMALLEST \
                or at + 1 - last == chunks.LARGEST:
            ends.append(at + 1)
            last = at + 1
    return ends + [len(data)] * (last < len(data))


def plain_repeats(texts, least):
    """(document, begin, end) by plain loops over ids in order."""
    first, out = {}, []
    for doc, text in texts:
        ends, spans, run = plain_cuts(text), [], None
        for begin, end in zip([0, *ends], ends):
            source = first.setdefault(text[begin:end], (doc, begin))
            if source == (doc, begin):
                continue
            if run and run[1] == begin and run[2:] == (source[0], begin - source[1]):
                run[1] = end
            else:
                run = [begin, end, source[0], begin - source[1]]
                spans.append(run)
        by_id = dict(texts)
        longer = []
        for begin, end, source, shift in spans:
            other, at, stop = by_id[source], begin, end
            while at > max(0, begin - chunks.REACH) and at > shift and text[at - 1] == other[at - 1 - shift]:
                at -= 1
            while stop < min(len(text), end + chunks.REACH) and stop - shift < len(other) \
                    and text[stop] == other[stop - shift]:
                stop += 1
            if stop - at >= least:
                longer.append((at, stop))
        joined = []
        for begin, end in sorted(longer):
            if joined and begin <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], end)
            else:
                joined.append([begin, end])
        out += [(doc, begin, end) for begin, end in joined]
    return out


@pytest.mark.parametrize("hot", [10_000, 3])
def test_repeats_equal_plain_loops(spark, monkeypatch, hot):
    monkeypatch.setattr(chunks, "HOT", hot)
    chance = random.Random(21)
    prose = lambda n: " ".join("".join(chance.choices("abcdeé", k=chance.randrange(2, 9)))
                               for _ in range(n))
    passages = [prose(n) for n in (12, 35, 50, 60, 60, 400)]
    texts = []
    for doc in range(40):
        parts = [prose(chance.randrange(0, 40))]
        for _ in range(chance.randrange(3)):
            parts += [chance.choice(passages), prose(chance.randrange(0, 30))]
        texts.append((doc, "".join(parts)))
    texts += [(50, (passages[5] + "|") * 9), (51, "x" * 3000), (52, "x" * 500)]
    table = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'a' AS k", "1 AS begin")
    found = sorted((r.doc_id, r.begin, r.end) for r in chunks.repeats(table).collect())
    plain = plain_repeats([(d, t.encode()) for d, t in texts], chunks.SPAN_BYTES)
    assert found == plain and {50, 51} <= {d for d, _, _ in plain}
    # a passage of over 50 words is found to its ends wherever it comes again
    long = [p.encode() for p in passages[3:]]
    seen = set()
    for doc, text in texts[:40]:
        for number, passage in enumerate(long):
            at = text.encode().find(passage)
            if at >= 0 and number in seen:
                assert any(d == doc and b <= at and e >= at + len(passage) for d, b, e in found)
            if at >= 0:
                seen.add(number)


def test_mix(docs, empty):
    rows = mixing.report(docs).collect()
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", d[1] or "")) for d in ODD]
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    assert all(r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size for r in rows)
    shares = mixing.rates(docs.select("source", mixing.words(docs.text).alias("size"))).collect()
    assert sum(r.target for r in shares) == pytest.approx(sum(sizes))
    assert mixing.mix(docs).columns == docs.columns
    clash = docs.selectExpr("*", "1 AS own_rate", "2 AS own_source", "3 AS own_copy", "4 AS _rate")
    assert mixing.mix(clash).columns == clash.columns
    assert mixing.mix(clash).count() == mixing.mix(docs).count()
    assert mixing.report(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_documents_without_ids_are_drawn_each(spark):
    rows = [(None, f"word number {i}", source) for source in "abc" for i in range(1000)]
    found = mixing.report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for target in {r.target for r in found}:
        taken = sum(r.taken for r in found if r.target == target)
        assert taken == pytest.approx(target, rel=0.1)


def test_many_different_letters_in_bounded_memory():
    chance = random.Random(9)
    texts = ["".join(chr(0x4E00 + chance.randrange(20_000)) for _ in range(3900)) for _ in range(64)]
    tracemalloc.start()
    found = language.bundles(texts)
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
    assert np.array_equal(found[:1], language.bundles(texts[:1]))


def test_gibberish_and_unknown_scripts_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    chance = random.Random(8)
    noise = []
    for i in range(200):
        letters = "abcdefghijklmnopqrstuvwxyz" if i % 2 else [chr(0x430 + n) for n in range(32)]
        noise.append((100_000 + i, " ".join("".join(chance.choices(letters, k=chance.randrange(2, 10)))
                                            for _ in range(100)), None, None, 0))
    # the noise has no language, so nothing is learned from it
    mixed = docs.union(spark.createDataFrame(noise, docs.schema))
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, mixed, "").select("doc_id").collect()}
    assert sum(i in kept for i in range(100_000, 100_200)) <= 4
    prose = [r.doc_id for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").collect()
             if re.search(r"[^\W\d_]", r.text)]
    gone = [i for i in prose if i not in kept]
    assert len(gone) <= 0.002 * len(prose), gone


def test_pipeline_stages_keep_the_columns(spark, docs, items, tmp_path):
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_languages_are_learned_from_the_smallest_hashes(spark):
    rows = [(i, f"{'ab' if i % 4 else 'xy'} word{chr(97 + i % 26)} {i}", "one" if i % 4 else "two")
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn(
        "_lang", F.lit("a clash"))
    ranked = docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).collect()
    for limit in (1, 7, 500):
        least = [r.doc_id for lang in ("one", "two") for r in sorted(
            (r for r in ranked if r.lang == lang), key=lambda r: r.h)[:limit]]
        names, vectors = language.prototypes(docs, limit)
        expected = language.prototypes(docs.where(F.col("doc_id").isin(least)), 1000)
        assert names == expected[0] == ["one", "two"]
        assert np.array_equal(vectors, expected[1])


def test_workers_release_what_they_free(spark):
    """The pipeline's stages share their workers, so what one frees must not stay with them."""
    common.importable(spark)

    def run(batches):
        def held():
            with open("/proc/self/status") as status:
                return int(re.search(r"RssAnon:\s+(\d+)", status.read())[1])

        def fill(size):
            return np.ones(size, np.uint8), pa.array([b"x" * size])

        for _ in batches:
            fill(1)
            before = held()
            for _ in range(3):
                fill(24 << 20)
            yield pa.RecordBatch.from_pydict({"more": pa.array([held() - before], pa.int64())})

    found = spark.range(0, 1, 1, 1).mapInArrow(run, "more long").collect()
    assert found[0].more < 8 << 10
