"""The prefix trie against a plain one, and its queue against a heap."""

import hashlib
import heapq
import random
import zlib

import pytest

from larder.llm import prefix_trie

DDL = "conv_id long, turn int, role string, text string, k1 string, depth string"


def plain(rows):
    """The nodes of the rebuilt conversations by nested loops."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1] or 0, t[2:]))]
           for c, ts in own.items()}
    whole = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = own.get(conv - int(abs(conv) % 100 * (1 if conv >= 0 else -1)), [])
        whole[conv] = tuple(base[:h] + turns[h:])
    members = {(): sorted(whole)}
    for conv in sorted(whole):
        for d in range(1, len(whole[conv]) + 1):
            members.setdefault(whole[conv][:d], []).append(conv)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def totals(node):
        below = [totals(child) for child in children.get(node, ())]
        saved = max(len(members[node]) - 1, 0) * (len(node[-1][1]) if node else 0)
        return sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below)

    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if whole[c] == node)
        leaves, saved = totals(node)
        out.append((
            min(convs, default=None), len(node), min(members[node[:-1]]) if node else None,
            len(convs), len(children.get(node, ())), leaves, saved,
            hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    chance = random.Random(5)
    made = []
    for conv in [*range(0, 60), *range(100, 130), 250, 251, -7, -100, -105]:
        for turn in range(chance.randrange(1, 9)):
            made.append((conv, turn, chance.choice(["user", "assistant", None]),
                         chance.choice(["a", "b", None, "é" * 3]), "x", None))
    made += [(1, None, "user", "first", "", ""), (1, 2, "user", "tie", "", ""), (1, 2, "user", "a tie", "", "")]
    made += [(2, 3, "user", "twice", "", "")] * 2 + [(None, 0, "user", "lost", "", "")]
    made += [(300 + c, t, "user", "same", "", "") for c in range(40) for t in range(7)]
    made += [(500, t, "assistant", f"t{t}", "", "") for t in range(300)]
    return made


def test_equals_a_plain_trie(spark, rows):
    table = spark.createDataFrame(rows, DDL)
    assert found(prefix_trie.report(table)) == plain(rows)


def test_small_shards_and_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    table = spark.createDataFrame(rows, DDL)
    parts = prefix_trie.rebuilt(table)
    for limit, factor in ((1, 4), (9, 9), (200, 5000)):
        assert found(prefix_trie.trie(*parts, limit, factor)) == plain(rows)


def test_empty_table(spark):
    empty = hashlib.sha256(b"").hexdigest()
    table = spark.createDataFrame([], DDL)
    assert found(prefix_trie.report(table)) == [(None, 0, None, 0, 0, 1, 0, empty)]


def test_ids_of_one_node_in_many_texts(spark):
    ends = spark.range(3000).selectExpr("7L AS k1", "id % 2 AS k2", "id * 3 AS conv_id")
    digests = prefix_trie.digested(prefix_trie.joined_ids(ends, limit=50)).collect()
    assert {(r.k1, r.k2): r.ends_sha256 for r in digests} == {
        (7, odd): hashlib.sha256(",".join(
            str(3 * i) for i in range(odd, 3000, 2)).encode()).hexdigest() for odd in (0, 1)}


def test_spilling_queue_equals_a_heap():
    chance = random.Random(6)
    for limit in (1, 5, 1000):
        queue, heap = prefix_trie.SpillingQueue(limit, block=3), []
        for _ in range(2000):
            if heap and chance.random() < 0.45:
                assert queue.first() == heap[0] and queue.pop() == heapq.heappop(heap)
            else:
                item = (chance.randrange(50), chance.randrange(50))
                queue.push(item)
                heapq.heappush(heap, item)
        assert [queue.pop() for _ in heap] == sorted(heap) and not len(queue)


def test_forwarding_spills(monkeypatch):
    # One chain under each of many children of the top.
    nodes, expected = [], {}
    for child in range(50):
        for depth in range(1, 5):
            key = (child * 10 + depth, 0)
            parent = (child * 10 + depth - 1, 0) if depth > 1 else (-1, 0)
            nodes.append((0, -depth, key, parent, 1, 0, 0, 0))
            expected[key] = (0 if depth == 4 else 1, 1, 5 - depth)
    nodes.append((0, 0, (-1, 0), (0, 0), 0, 0, 0, 0))
    expected[(-1, 0)] = (50, 50, 200)
    got = {key: tuple(rest) for key, *rest in prefix_trie.forwarded(iter(sorted(nodes)), limit=3)}
    assert got == expected
