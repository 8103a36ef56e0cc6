from __future__ import annotations

from loomtab.llm.curriculum import curriculum, scheduled, with_places


def test_places_are_those_of_the_range_sorted_order(spark):
    rows = [(i if i % 9 else None, f"{'word ' * (i * 7 % 23)}{i}" if i % 5 else None, "abc"[i * i % 3]) for i in range(400)]
    docs = spark.createDataFrame(rows + rows[1:4], "doc_id long, text string, source string").repartition(7)
    order = curriculum(docs).collect()
    got = with_places(scheduled(docs)).collect()
    assert len(got) == 403
    first, taken = {}, {}
    for place, r in enumerate(order, 1):
        first.setdefault(r["doc_id"], place)
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["size"]
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] > 3:
            assert r["first_place"] == first.get(r["doc_id"]) and r["taken"] == taken.get(r["doc_id"], 0)
    places = [r["first_place"] for r in got if r["first_place"] is not None]
    assert len(set(places)) == len(places) and max(places) <= len(order)
    assert sum(r["copies"] for r in got) == len(order) and sum(r["taken"] for r in got) == sum(r["size"] for r in order)
    want = sorted((str(r["doc_id"]), r["check"] or 0, r["taken"], r["copies"]) for r in scheduled(docs).collect())
    assert sorted((str(r["doc_id"]), r["check"] or 0, r["taken"], r["copies"]) for r in got) == want
