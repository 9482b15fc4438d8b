import hashlib
import math
import re
import zlib
from collections import defaultdict

import pytest

from styleframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, f1 long, conv int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, bytes.fromhex(sha(sha(role or "") + sha(text or ""))), role or "", text or ""))
    seqs = {}
    for c in own:
        own[c].sort()
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(t[3:] for t in own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(int)
    for s in members:
        if s:
            kids[s[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += kids[s] == 0
            saved[s[:d]] += cost
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], leaves[s], saved[s],
                   sha(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(s)))) for s, m in members.items())


def run(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(*r, 1, "k", 5, 2) for r in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in prefix_trie.trie(df, **kw).collect())


def corpus():
    rows = []
    for c in range(0, 90):
        if c in (20, 61):           # an absent base, an absent conversation
            continue
        for t in range(1 + c * 7 % 6):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c // 20} or {c % 3 if t > 2 else 0}"))
    rows += [(5, None, None, "null turn first"), (5, None, "user", None), (7, 2, "user", "tied"), (7, 2, "user", "tied"), (7, 2, "user", "another tie"),
             (None, 0, "user", "no conversation"), (85, 40, "", ""), (86, 41, None, None), (-40, 0, "user", "a negative id"), (-39, 3, "user", "x"), (-39, 9, "bot", "y \t z")]
    rows += [(88, 100 + i, "user", f"step {i}") for i in range(150)] + [(89, 100 + i, "user", f"step {i}") for i in range(150)]
    rows += [(84, 9, "user", "very long " * 50_000)]
    rows += [(c, 0, "user", "one and the same") for c in range(200, 260)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_tasks_hand_over_sums_and_chunks_stream(spark):
    """One conversation over many tasks; ids of one node in many chunks; short fingerprints collide and are made anew."""
    rows = [r for r in corpus() if r[0] is not None and r[0] >= 80]
    assert run(spark, rows, partitions=13, chunk=7, bits=3) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 10**7 + 3])
def test_powers(n):
    import numpy as np
    assert int(prefix_trie._power(prefix_trie.BASES[0], np.array([n, 0]))[0]) == pow(prefix_trie.BASES[0], n, 1 << 64)
