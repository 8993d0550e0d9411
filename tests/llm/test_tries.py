"""The conversation trie against a dictionary of prefixes: shards of any size, heavy upper levels, one very long conversation."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvana.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, rep long, node string, depth int, p1 long, k string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            by[conv].append(((turn is not None, turn or 0), role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    for told in by.values():
        told.sort(key=lambda t: t[:3])
    lines, members, children, ends = {}, defaultdict(list), defaultdict(set), defaultdict(list)
    for conv, told in by.items():
        h = zlib.crc32(str(conv).encode()) % 4
        donor = conv - (abs(conv) % 20) * (1 if conv >= 0 else -1)
        lines[conv] = tuple((t[1], t[3]) for t in [*by.get(donor, [])[:h], *told[h:]])
        for d in range(len(lines[conv]) + 1):
            members[lines[conv][:d]].append(conv)
            if d:
                children[lines[conv][: d - 1]].add(lines[conv][:d])
        ends[lines[conv]].append(conv)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in children[node])
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves[node], saved[node], sha))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rng, out = np.random.default_rng(3), []
    say = lambda: str(rng.choice(["hello", "hi there", "a b c d", "", "x\ty\nz", "who  are you"]))
    for conv in [*range(-25, 160), 10**12]:
        out += [(conv, t, str(rng.choice(["user", "assistant"])), say()) for t in range(int(rng.integers(1, 7)))]
    out += [(200 + k, t, "user", f"same {t}") for k in range(60) for t in range(5)]  # equal conversations
    out += [(400, t, "user", f"turn {t}") for t in range(300)] + [(401, t, "user", f"turn {t}") for t in range(200)]
    out += [(500, None, "user", "first"), (500, 1, None, None), (500, 1, "", ""), (500, 2, "user", None), (None, 1, "user", "lost"), (501, 5, "user", "only")]
    return [(*r, 1, "n", 2, 3, "k") for r in [*out, *out[:5]]]


@pytest.mark.parametrize(("shard", "piece"), [(50_000, 4096), (40, 7), (1, 2)])
def test_against_prefixes(spark, rows, monkeypatch, shard, piece):
    monkeypatch.setattr(tries, "SHARD", shard)
    monkeypatch.setattr(tries, "PIECE", piece)
    monkeypatch.setattr(tries, "DEEPEST", piece * 2**30 - 1)
    got = tries.trie(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert Counter(map(tuple, got.select(COLUMNS).collect())) == brute(rows)


def test_empty(spark):
    assert tries.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_louds():
    """Bits in level order: the super-root's trees, then a one for each child and a zero for each node."""
    codes = np.array([[0, 1], [0, 2], [0, 1], [0, 3], [0, 9]], np.uint64)
    f = tries.Forest(np.array([7, 7, 7, 7, 8]), np.array([1, 1, 2, 2, 3]), np.array([1, 2, 1, 2, 1]), codes, np.array([5, 6, 5, 7, 8]), np.array([0, 1, 0, 2, 1]))
    assert f.bits.astype(int).tolist() == [1, 1, 0, 1, 1, 0, 0, 0, 0]
    assert f.parent.tolist() == [-1, -1, 0, 0] and f.convs.tolist() == [3, 1, 1, 2] and f.leaves.tolist() == [2, 1, 1, 1]
    assert f.saved.tolist() == [2 * 5 + 7, 0, 0, 7]
