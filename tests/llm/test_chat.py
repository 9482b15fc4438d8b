import hashlib

from styleframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, pos int, key string"


def md(x):
    return "-" if x is None else hashlib.md5(x.encode()).hexdigest()


def brute(rows, segment=256):
    convs = {}
    for c, t, r, x in set(rows):
        key = hashlib.md5(f"{md(r)}:{md(x)}".encode()).hexdigest()
        convs.setdefault(c, []).append(((t is not None, t or 0, key), r, x))
    seqs = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: y[0])] for c, v in convs.items()}
    out = []
    for c, s in seqs.items():
        longer = any(len(o) > len(s) and o[:len(s)] == s for o in seqs.values())
        equal = [d for d, o in seqs.items() if o == s]
        if longer or c != min(equal, key=lambda d: (d is None, d or 0)):
            continue
        for k in range(0, len(s), segment):
            text = "".join(f"<|{r if r is not None else 'unknown'}|>\n{x or ''}\n<|end|>\n" for r, x in s[k:k + segment])
            out.append((c, k // segment, len(s), text))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 0, "k") for r in rows], SCHEMA).repartition(3)
    return sorted(((r["conv_id"], r["segment"], r["n_turns"], r["text"]) for r in chat.render(df, **how).collect()), key=str)


def snapshots():
    rows = []
    for c in range(40):
        n = c % 9 + 1
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c % 4} {t}") for t in range(n)]
    rows += [(100, t, "user", "other") for t in range(3)]
    rows += [(101, 5, None, None), (101, None, "user", ""), (102, None, "user", ""), (None, 0, "user", "lost"), (None, 1, "user", "row"), (103, 0, "user", "lost")]
    rows += [(104, 1, "user", "tie b"), (104, 1, "user", "tie a"), (105, 0, "user", None), (106, 0, "user", "")]
    return rows + rows[5:15] + rows[:3]


def test_matches_brute_force(spark):
    assert run(spark, snapshots()) == brute(snapshots())


def test_a_conversation_over_many_tasks(spark):
    rows = snapshots() + [(50, t, "user", f"long {t % 3}") for t in range(1500)] + [(51, t, "user", f"long {t % 3}") for t in range(700)]
    rows += [(52, t, "user", f"long {t % 3}") for t in range(699)] + [(52, 699, "user", "differs")]
    for parts in (1, 2, 13, 40):
        assert run(spark, rows, partitions=parts, segment=100) == brute(rows, 100)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.render(df).count() == 0
