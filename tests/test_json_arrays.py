"""JSON array files are read element by element, however they are cut into chunks."""

import json
import random
import tracemalloc

from styleframe.sources import entries
from styleframe.sources.json_arrays import elements, read_elements

ODD = ['a "b" [c', "back\\slash\\", "é😀,]", "", "{}", "\\\""]


def chunks(data, size):
    return (data[i:i + size] for i in range(0, len(data), size))


def value(r, level=0):
    kind = r.randrange(6 if level < 3 else 4)
    if kind < 2:
        return r.choice(ODD)
    if kind < 4:
        return r.choice([None, True, 1.5, -3])
    if kind == 4:
        return [value(r, level + 1) for _ in range(r.randrange(4))]
    return {r.choice(ODD) + str(i): value(r, level + 1) for i in range(r.randrange(4))}


def expected(data, depth, at=()):
    if not isinstance(data, list):
        return []
    if depth == 1:
        return [([*at, i], x) for i, x in enumerate(data)]
    return [e for i, x in enumerate(data) for e in expected(x, depth - 1, (*at, i))]


def test_any_values_and_any_chunks():
    r = random.Random(5)
    for n in range(150):
        data = [value(r) for _ in range(r.randrange(6))]
        raw = json.dumps(data, ensure_ascii=n % 2 == 0, indent=n % 3 or None).encode()
        for depth in (1, 2, 3):
            for size in (1, 3, 7, 1 << 20):
                got = [(at, json.loads(t)) for at, t in elements(chunks(raw, size), depth)]
                assert got == expected(data, depth), (raw, depth, size)


def test_empty_broken_and_other_values():
    assert list(elements([b""])) == [] and list(elements([b" [ ] "])) == []
    assert list(elements([b'{"a": [1, 2]}'])) == []
    assert [t for _, t in elements([b'[{"a": 1}, {"b": [2'])] == [b'{"a": 1}']


def test_memory_does_not_grow_with_the_file():
    one = json.dumps([[{"text": ["x" * 200], "user": "u"}] for _ in range(1000)]).encode()

    def stream():
        yield b"["
        for i in range(100):          # 24 MB
            yield (b"," if i else b"") + one
        yield b"]"
    tracemalloc.start()
    n = sum(1 for _ in elements(stream(), 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100_000 and peak < 4 * len(one)


def test_files_of_entries_and_hierarchies(spark, tmp):
    import os
    os.makedirs(tmp + "/e")
    os.makedirs(tmp + "/h")
    for f in range(3):
        with open(f"{tmp}/e/{f}.json", "w") as h:
            json.dump([{"sentence": f"{f} s, [é] {i}", "tags": ["a"] if i % 2 else None} for i in range(500)], h, ensure_ascii=False)
    open(tmp + "/e/none.json", "w").close()
    got = entries.read_entries(spark, tmp + "/e", array_file=True).collect()
    assert sorted(r.sentence for r in got) == sorted(f"{f} s, [é] {i}" for f in range(3) for i in range(500))
    assert {tuple(r.tags) for r in got} == {("a",), ()}
    users = [[[{"text": ["x"], "user": None}, {"text": ["y", "z"], "user": None}], []], [[{"text": ["w"], "user": "ann"}]]]
    with open(tmp + "/h/eg.json", "w") as h:
        json.dump(users, h)
    got = entries.read_hierarchy(spark, tmp + "/h", nested_files=True).collect()
    assert sorted((r.dialect, r.user, r.comment, r.sent_idx, tuple(r.text)) for r in got) == [
        ("eg", "ann", 0, 0, ("w",)), ("eg", "user_0", 0, 0, ("x",)), ("eg", "user_0", 0, 1, ("y", "z"))]
    assert read_elements(spark, tmp + "/h", 2).count() == 3
