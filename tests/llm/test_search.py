"""Ranked search against plain scoring."""

import math
import random
import re

import numpy as np
import pytest

from larder.llm import search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(documents, queries, k):
    docs = [(i, words(t)) for i, t, *_ in documents]
    n, length = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    out = []
    for item, text in set((q[0], q[1]) for q in queries):
        best = []
        terms = set(words(text))
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in w for _, w in docs) + 1)))
                  for t in terms}
        for doc, w in docs:
            if w:
                m = 100 - 50 + 50 * len(w) * n // length
                score = sum(weight[t] * (10 ** 9 * w.count(t) // (1000 * w.count(t) + 20 * m))
                            for t in terms if t in w)
                if score > 0:
                    best.append((-score, doc is None, doc or 0, doc))
        best.sort()
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(best[:k], 1)]
    return sorted(out, key=repr)


def corpus(size, seed=1):
    chance = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    topics = [chance.sample(vocabulary, 25) for _ in range(12)]
    made = []
    for i in range(size):
        topic = chance.choice(topics)
        text = [chance.choice(topic if chance.random() < 0.7 else vocabulary)
                for _ in range(chance.randrange(1, 60))]
        made.append((i, " ".join(text), "x", 1))
    made += [(size + i, made[7][1], "copy", 1) for i in range(60)]
    queries = [(i, " ".join(chance.choice(topics)[:9] + chance.sample(vocabulary, 4))) for i in range(12)]
    return made, queries


@pytest.mark.parametrize("block, limit, sampled", [(64, 1 << 20, 32), (4, 900, 3), (1, 5000, 1)])
def test_equals_plain_scoring(spark, monkeypatch, block, limit, sampled):
    made, queries = corpus(500)
    queries += [(0, "W1 and w2!"), (0, "w1 and w2!"), (70, None), (71, "?!"), (None, "w3"),
                (72, "unknown words"), (73, made[7][1]), (73, made[7][1])]
    made += [(None, "w1 w1 w2", "", 0), (None, "w1 w1 w2", "", 0), (9001, None, "", 0), (9002, "", "", 0),
             (9003, "-- !!", "", 0), (3, "w3 É1 w4", "", 0), (9004, "w5 w6 " * 30_000, "", 0)]
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "SHARD_POSTINGS", limit)
    monkeypatch.setattr(search, "SAMPLED", sampled)
    docs = spark.createDataFrame(made, "doc_id long, text string, score string, rank int")
    asked = spark.createDataFrame(queries, "item_id long, text string")
    found = search.ranked(docs, asked, 20).collect()
    assert sorted(map(tuple, found), key=repr) == plain(made, queries, 20)


def test_query_groups(spark, monkeypatch):
    made, queries = corpus(60, 2)
    monkeypatch.setattr(search, "GROUP_TERMS", 20)
    docs = spark.createDataFrame(made, "doc_id long, text string, source string, n int")
    asked = spark.createDataFrame(queries, "item_id long, text string")
    assert sorted(map(tuple, search.ranked(docs, asked, 5).collect()), key=repr) == plain(
        made, queries, 5)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "w1")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1"), (2, "other")], "item_id long, text string")
    assert search.ranked(docs.limit(0), asked).count() == 0
    assert search.ranked(docs, asked.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in search.ranked(docs, asked).collect()] == [(1, 1, 1)]


def shard_of(size, blocks):
    made, queries = corpus(size, 3)
    known = {}
    each = [np.unique([known.setdefault(w, len(known)) for w in words(t)], return_counts=True)
            for _, t, *_ in made]
    lengths = [len(t) for t, _ in each]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    terms = np.concatenate([t for t, _ in each]).astype(np.int32)
    counts = np.concatenate([c for _, c in each])
    sizes = np.array([len(words(t)) for _, t, *_ in made])
    whole = search.Corpus(len(made), int(sizes.sum()), np.bincount(terms, minlength=len(known)))
    asked = [np.unique([known[w] for w in words(q) if w in known]) for _, q in queries]
    shard = search.build(np.arange(len(made)), sizes, starts, terms, counts, whole,
                         search.needed(asked, whole, np.zeros(len(asked), np.int64)))
    return shard, whole, asked


def test_blocks_hold_their_list_and_its_maxima(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    shard, whole, asked = shard_of(400, 8)
    vector = [dict(zip(shard.terms[a:b].tolist(), shard.impacts[a:b].tolist()))
              for a, b in zip(shard.starts, shard.starts[1:])]
    need = search.needed(asked, whole, np.zeros(len(asked), np.int64))
    for i, term in enumerate(shard.lists.tolist()):
        blocks = range(shard.list_starts[i], shard.list_starts[i + 1])
        every = []
        for block in blocks:
            members = shard.members[shard.block_starts[block]:shard.block_starts[block + 1]].tolist()
            assert 0 < len(members) <= 16
            every += members
            part = slice(shard.summary_starts[block], shard.summary_starts[block + 1])
            summary = dict(zip(shard.summary_terms[part].tolist(),
                               shard.summary_highest[part].tolist()))
            expected = {c: max(vector[d].get(c, 0) for d in members) for c in need[term].tolist()}
            assert summary == {c: v for c, v in expected.items() if v}
        assert sorted(every) == [d for d, v in enumerate(vector) if term in v]


def test_blocks_are_skipped_and_nothing_is_lost(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 8)
    shard, whole, asked = shard_of(1500, 8)
    scored = []
    real = search.scores_of
    monkeypatch.setattr(search, "scores_of", lambda s, t, i, w, rows: (
        scored.append(len(rows)), real(s, t, i, w, rows))[1])
    for query in asked:
        weights = np.zeros(len(whole.frequency), np.int64)
        weights[query] = whole.weights[query]
        everyone = real(shard.starts, shard.terms, shard.impacts, weights, np.arange(len(shard.ids)))
        top = search.best_of(everyone, shard.ids, 5)
        scores, ids = search.searched(shard, query, weights, 0, 5)
        order = search.best_of(scores, ids, 5)
        assert ids[order].tolist() == shard.ids[top].tolist()
    assert sum(scored) < 0.8 * len(asked) * len(shard.ids)
