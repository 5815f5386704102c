import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gradelake.llm import prefix_trie
from gradelake.llm.radix_tree import Children, Node, Tree

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes by whole prefixes in dictionaries."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {conv: [t for _, t in sorted(turns)] for conv, turns in own.items()}
    rebuilt = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        rebuilt[conv] = tuple(own.get(conv - conv % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        leaves[path] = sum(leaves[c] for c in below) if below else 1
        here = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = here + sum(saved[c] for c in below)
    return sorted(
        (
            min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children[path]), leaves[path], saved[path],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if rebuilt[c] == path).encode()).hexdigest(),
        )
        for path, m in members.items()
    )


def nodes(spark, rows, schema=SCHEMA, **options):
    found = prefix_trie.trie(spark.createDataFrame(rows, schema), **options)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in found.collect())


def test_against_dictionaries(spark):
    random.seed(3)
    rows = [(c, t if t else None, random.choice(["user", None]), random.choice(["a", "é", "", None])) for c in range(60) for t in range(random.randrange(12))]
    assert nodes(spark, rows) == brute(rows)


def test_long_conversations_and_copies(spark, monkeypatch):
    """A conversation over many blocks, one that parts from it late, one whose blocks end evenly, and many copies."""
    monkeypatch.setattr(prefix_trie, "BLOCKS_TOGETHER", 2)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, t, "user", f"turn {t}") for c in (1000, 1003) for t in range(61)]
    rows += [(1008, t, "user", f"turn {t}" if t < 50 else f"other {t}") for t in range(70)]
    rows += [(2000 + c, t, "user", f"turn {t}") for c in range(40) for t in range(12)]
    rows += [(3000, t, "user", f"turn {t}") for t in range(16)]
    assert nodes(spark, rows, block=4) == brute(rows)


def test_nulls_repeats_ties_names_and_nothing(spark):
    rows = [(None, 1, "user", "lost"), (5, None, None, None), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (7, 2, "u", "ser"), (7, 2, "us", "er")]
    rows += [(6, 0, "user", "x" * 100_000), (9, 0, "user", "alone")]
    assert nodes(spark, rows) == brute(rows)
    assert nodes(spark, []) == []
    named = [(*r, 1, "n", 2) for r in rows]
    assert nodes(spark, named, SCHEMA + ", id long, node string, least int") == brute(rows)


def test_turnless_conversations_meet_at_the_root(spark):
    """Only the first member of a family could give turns; without it and with few of its own a conversation has none."""
    conv = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 3)
    assert nodes(spark, [(conv, t, "user", str(t)) for t in range(3)]) == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


@pytest.mark.parametrize("width", [4, 5, 16, 17, 48, 49, 256])
def test_layouts_grow(width):
    children = Children()
    order = list(range(width))
    random.Random(1).shuffle(order)
    for b in order:
        children.put(b, Node(bytes([b]), 1, [b]))
    assert children.layout == next(size for size in (4, 16, 48, 256) if size >= width)
    assert sorted(n.values[0] for n in children) == list(range(width))
    assert [children.get(b).values[0] if b < width else children.get(b) for b in range(256)] == [b if b < width else None for b in range(256)]


def test_tree_sums_every_prefix():
    rng = random.Random(2)
    keys = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    tree = Tree([int.__add__, min])
    for at, key in enumerate(keys):
        tree.insert(key, (1, at))
    found = {key[:depth]: tuple(values) for key, start, end, values in tree.spans() for depth in range(start + 1, end + 1)}
    prefixes = {k[:d] for k in keys for d in range(1, len(k) + 1)}
    assert found == {p: (sum(k.startswith(p) for k in keys), min(i for i, k in enumerate(keys) if k.startswith(p))) for p in prefixes}
