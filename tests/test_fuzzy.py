import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quillstack.operators import catalogue, fuzzy


def place_bonus(line, i):
    ch, before = line[i], line[i - 1] if i else " "
    kind = fuzzy._class
    if kind(ch) == fuzzy._SPACE:
        return 10
    if kind(ch) in (fuzzy._MARK, fuzzy._DELIMITER):
        return 8
    if kind(before) in (fuzzy._SPACE, fuzzy._DELIMITER, fuzzy._MARK):
        return {fuzzy._SPACE: 10, fuzzy._DELIMITER: 9, fuzzy._MARK: 8}[kind(before)]
    if (ch.isupper() and kind(before) == fuzzy._LOWER) or (ch.isdigit() and not before.isdigit()):
        return 5
    return 0


def brute(line, atom):
    """The best of all ways to place an atom's letters."""
    fold = lambda ch: fuzzy._lower(ch) if atom.marked else fuzzy._plain(fuzzy._lower(ch))
    m, best = len(atom.text), None
    for at in combinations(range(len(line)), m):
        if any(fold(line[p]) != c for p, c in zip(at, atom.text, strict=True)):
            continue
        if (atom.kind != "fuzzy" and at[-1] - at[0] != m - 1) or (atom.kind in ("start", "whole") and at[0]) or (atom.kind in ("end", "whole") and at[-1] != len(line) - 1):
            continue
        score = 16 + 2 * place_bonus(line, at[0])
        for p, q in zip(at, at[1:], strict=False):
            gap = q - p - 1
            score += 16 + (max(place_bonus(line, q), 4) if not gap else place_bonus(line, q) - 3 - (gap - 1))
        best = score if best is None else max(best, score)
    return best if best is None else max(best, 0)


@pytest.mark.parametrize("query", ["ab", "aba", "a b", "^ab", "ab$", "^ab$", "'ba", "!ab a", "Á", "a1", "b  !^a", "aab", "x"])
def test_against_every_placement(query, monkeypatch):
    r = random.Random(len(query))
    lines = ["", "a", "ab", None, "aB b", "Áb ab"] + ["".join(r.choice("aabBbA1 /-.áx") for _ in range(r.randrange(11))) for _ in range(300)]
    atoms = fuzzy.parse_atoms(query)
    want = []
    for line in lines:
        found = [None if line is None else brute(line, a) for a in atoms]
        fits = line is not None and all((f is None) == a.negated for f, a in zip(found, atoms, strict=True))
        want.append(sum(f for f in found if f is not None) if fits else -1)
    assert fuzzy.scores(lines, atoms).tolist() == want
    monkeypatch.setattr(fuzzy, "CELLS", 7)
    assert fuzzy.scores(lines, atoms).tolist() == want


def test_better_lines_come_first(spark):
    lines = ["Ada Quill", "armada quorum", "Quill, Ada", "a d a q", "nothing", "Ada et al.  (2001)  Quarks", "ADAQ", "Adá Quill"]
    df = spark.createDataFrame([(f"k{i}", x) for i, x in enumerate(lines)] + [("n", None), ("j", "Ada Quill")], "key string, line string").repartition(3)
    got = [r["key"] for r in catalogue.fuzzy_filter(df, "adaq", F.col("line")).collect()]
    assert set(got) == {"k0", "k1", "k3", "k5", "k6", "k7", "j"}
    assert got.index("j") < got.index("k0") < got.index("k1") and got.index("k7") == got.index("k0") + 1
    assert [r["key"] for r in catalogue.fuzzy_filter(df, "quill !,  ada", F.col("line")).collect()] == ["j", "k0", "k7"]
    assert catalogue.fuzzy_filter(df, "  ", F.col("line")).count() == 9
    assert fuzzy.scores(["a" + "x" * 300 + "b"], fuzzy.parse_atoms("ab")).tolist() == [0]
    assert catalogue.fuzzy_filter(df.limit(0), "a", F.col("line")).count() == 0


def test_memory_of_a_batch_is_bounded():
    import tracemalloc

    lines = ["Ada Quill et al.  (2001)  " + "a title of words " * 20] * 10_000
    tracemalloc.start()
    found = fuzzy.scores(lines, fuzzy.parse_atoms("adaq"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == found[0]).all() and found[0] > 0
    assert peak < 50 << 20
