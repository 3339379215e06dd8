import random

import pytest

from quillstack.operators.ranking import Ranking


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    r = random.Random(9)
    rows = [(i, f"w{min(r.randrange(40), 12)}", r.choice([0.5, 0.25, -0.0, 0.0, float("nan"), r.random(), r.random()])) for i in range(700)]
    ranking = Ranking(spark, f"file://{tmp_path_factory.mktemp('ranking')}/r", ranges=6)
    ranking.write(spark.createDataFrame(rows, "id long, work string, similarity double").repartition(5))
    order = lambda x: (float("-inf") if x[2] != x[2] else -x[2] + 0.0, x[0])
    return ranking, sorted(rows, key=order)


def test_pages_by_cursor(kept):
    ranking, want = kept
    after, got, at = None, [], 0
    while True:
        page, numbers = ranking.page("passages", after, 137)
        rows = page.collect()
        assert [x["rank"] for x in rows] == list(range(at + 1, at + len(rows) + 1)) and numbers["returned"] == len(rows) and numbers["total"] == 700
        got += [x["id"] for x in rows]
        at, after = at + len(rows), numbers["next"]
        if after is None:
            break
    assert got == [x[0] for x in want]
    # ties of a similarity go on behind the last id
    tie = next(i for i in range(100, 699) if want[i][2] == want[i + 1][2])
    page, _ = ranking.page("passages", (want[tie][2], want[tie][0]), 3)
    assert [x["id"] for x in page.collect()] == [x[0] for x in want[tie + 1 : tie + 4]]
    capped, numbers = ranking.page("passages", (want[98][2], want[98][0]), 50, cap=101)
    assert [x["rank"] for x in capped.collect()] == [100, 101] and numbers == {"total": 101, "returned": 2, "next": None}
    with pytest.raises(ValueError):
        ranking.page("passages", None, 0)


def test_works_and_back(kept):
    ranking, want = kept
    best = {}
    for i, w, s in want:
        best.setdefault(w, (i, s))
    page, numbers = ranking.page("works", None, 5)
    assert [(x["rank"], x["work"], x["id"], x["matching"]) for x in page.collect()] == [(k + 1, w, best[w][0], sum(x[1] == w for x in want)) for k, w in enumerate(list(best)[:5])]
    again, _ = ranking.page("works", numbers["next"], 50)
    assert [x["work"] for x in again.collect()] == list(best)[5:]
    # down to one work, page by page
    work = "w12"
    got, after = [], None
    while True:
        page, numbers = ranking.of_work(work, after, 90)
        got += [x["id"] for x in page.collect()]
        after = numbers["next"]
        if after is None:
            break
    assert got == [x[0] for x in want if x[1] == work] and len(got) > 90
    assert ranking.of_work("nobody")[1] == {"returned": 0, "next": None}


def test_a_page_reads_its_range(kept, spark):
    ranking, want = kept
    opened = lambda df: {f.split("bucket=")[1].split("/")[0] for f in df.inputFiles()}
    every = {str(r[0]) for r in ranking.store.latest().facts["passages"]}
    assert len(every) == 6
    for k in (0, 250, 500, 690):
        page, _ = ranking.page("passages", (want[k][2], want[k][0]), 5)
        assert len(opened(page)) <= 2
    assert len(opened(ranking.page("passages", None, 5)[0])) == 1
    version = ranking.store.latest()
    ranking.write(spark.createDataFrame([], "id long, work string, similarity double"))
    assert ranking.page("passages")[1] == {"total": 0, "returned": 0, "next": None}
    assert ranking.store.latest().number == version.number + 1
