import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from folioweave.llm import prefixtrie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth int, path string"


def plain_trie(rows):
    """The contract, turn by turn, over (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    children = {n: sum(len(u) == len(n) + 1 for u in below[n]) for n in members}
    words = lambda n: len(n[-1][1].split()) if n else 0
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], sum(not children[u] for u in below[node]),
            sum((len(members[u]) - 1) * words(u) for u in below[node]), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(map(str, out))


def trie(spark, rows, block=P.BLOCK):
    frame = spark.createDataFrame([(*r, 3, "p") for r in rows], SCHEMA).repartition(3)
    found = P.prefix_trie(P.share_openings(P.paths(frame)), block).collect()
    assert found == [] or found[0].asDict().keys() == set("conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split())
    return sorted(str((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256)) for r in found)


def chats(seed, convs=120, longest=9):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(0, 400), convs):
        for turn in range(rnd.randint(1, longest)):
            say = rnd.choice([None, "", "a b", "a  b\tc", "é \x0b x"]) if rnd.random() < 0.6 else f"w{rnd.randint(0, 5)} " * 3
            rows.append((c, None if turn == 0 and rnd.random() < 0.2 else turn, rnd.choice(["user", "user", None, "bot"]), say))
    return rows


@pytest.mark.parametrize("seed, block", [(0, P.BLOCK), (1, 0), (2, 60), (3, 400)])
def test_against_brute_force(spark, seed, block):
    rows = chats(seed)
    assert trie(spark, rows, block) == plain_trie(rows)


def test_a_common_conversation_and_a_very_long_one(spark):
    rows = [(c, t, "user", f"turn {t} of all") for c in range(1000, 1400) for t in range(3)]
    rows += [(77, t, "bot", "long talk " * (t % 3)) for t in range(60)] + [(78, t, "bot", "long talk " * (t % 3)) for t in range(59)]
    want = plain_trie(rows)
    for block in (P.BLOCK, 50):
        assert trie(spark, rows, block) == want


def test_edges(spark):
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "user", "x")]) == []
    # repeated rows are turns of their own; role and text do not run together
    rows = [(5, 1, "user", "x y"), (5, 1, "user", "x y"), (6, 1, "userx", " y"), (7, None, None, None), (26, 1, "", "")]
    assert trie(spark, rows) == plain_trie(rows)
    long = [(1, 1, "user", "w " * 500_000), (2, 1, "user", "w " * 500_000)]
    assert trie(spark, long) == plain_trie(long)


def test_steps_take_levels_together_within_the_bound():
    assert P._steps({3: 5}, 0) == [(3, 2), (2, 1), (1, 0), (0, -1)]
    assert P._steps({400: 1, 8: 100, 2: 900}, 1000) == [(400, 2), (2, 1), (1, 0), (0, -1)]
    assert P._steps({400: 1, 8: 100, 2: 900}, 400)[:3] == [(400, 8), (8, 5), (5, 2)]
    assert P._steps({0: 4}, 10) == [(0, -1)]
