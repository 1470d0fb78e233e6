"""Memory of the similarity join."""

from itertools import combinations

import numpy as np
import pyarrow as pa

from fieldsift.llm import similarity

RNG = np.random.Generator(np.random.PCG64(4))


def _texts():
    """Groups of near copies of random texts, and texts of their own."""
    texts = []
    for k in range(12):
        words = [f"w{x}" for x in RNG.integers(0, 400, 120)]
        texts.append(" ".join(words))
        for c in range(k % 4):
            copy = list(words)
            copy[(17 * c + k) % 120] = "other"
            texts.append(" ".join(copy))
    return texts


def _components(texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    root = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root


def test_whole_sets_are_compared_row_by_row(spark, monkeypatch, capsys):
    """No Python batch holds thousands of whole sets, and the groups are those of brute force."""
    plans, stored = {}, similarity.stored

    def noted(rows, name):
        capsys.readouterr()
        rows.explain()
        plans.setdefault(name, []).append(capsys.readouterr().out)
        return stored(rows, name)

    monkeypatch.setattr(similarity, "stored", noted)
    monkeypatch.setattr(similarity, "_LIST_BYTES", 1000)
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similarity.components(docs).collect()}
    assert [got[k] for k in range(len(texts))] == _components(texts)
    assert plans["links"]
    for plan in plans["links"]:
        assert "MapInArrow" not in plan and "array_intersect" in plan


def test_cells_are_read_where_arrow_holds_them():
    bits = [RNG.bytes(8 << int(k)) for k in RNG.integers(0, 4, 60)]
    own = pa.array(range(60), pa.int64())
    columns = {k: own for k in ("sig", "n", "place", "group", "side")}
    table = pa.table({**columns, "bits": pa.array(bits, pa.binary())})
    parts = pa.concat_tables([table.slice(0, 20), table.slice(20, 7), table.slice(27)])
    for some, begin in ((table, 0), (table.slice(13, 30), 13), (parts, 0), (parts.slice(22), 22)):
        entries = similarity.Entries(some)
        for k in range(len(some)):
            cells = entries.cells(np.array([k]), int(entries.width[k]))
            assert cells.tobytes() == bits[begin + k]
    assert similarity.Entries(table.slice(60)).words is not None
