"""Template windows against a scan in Python, and re-parameterised questions."""

import re

from glossagrid.llm import templates
from glossagrid.llm.queries import QUERIES
from tests.llm.conftest import SMALL

ITEM = "A train leaves the old station at 9:30 and travels 120 km toward the coast with Anna Maria on board. After 2 hours it has 45 km left, so how far did Anna go?"


def found(spark, texts, items=((0, ITEM),)):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in templates.leaks(docs, bench).collect()}


def test_copies_and_new_parameters(spark):
    new = ITEM.replace("9:30", "7:15").replace("120", "300").replace("2 hours", "5 hours").replace("45", "80").replace("Anna Maria", "Bob").replace("Anna", "Bob")
    mixed = ITEM.replace("Anna Maria", "Bob").replace("Anna go", "Carl go")
    rows = found(spark, {1: f"Intro words here.\n{ITEM} And more.", 2: f"Intro. {new}", 3: ITEM.upper(), 4: "nothing of the kind at all in these words",
                         5: ITEM[:60], 6: ITEM.replace(" ", "  \n"), 7: f"{new} {ITEM}"})
    assert rows[1, 0].coverage == 1 and rows[1, 0].changed == 0
    assert rows[2, 0].coverage == 1 and rows[2, 0].changed >= 4
    assert (4, 0) not in rows and (5, 0) not in rows and rows[7, 0].changed == 0
    # One name that stands for two others is no re-parameterisation of the whole.
    assert found(spark, {1: mixed}).get((1, 0)) is None or found(spark, {1: mixed})[1, 0].coverage < 1


def test_verbatim_windows_count_beside_inconsistent_ones(spark):
    rows = found(spark, {1: ITEM.replace("Anna go", "Carl go"), 2: ITEM.replace("45 km", "45 m"),
                         3: ITEM.replace("Anna Maria", "Bob").replace("Anna go", "Carl go").replace("120", "300")})
    assert 0.5 <= rows[1, 0].coverage < 1 and rows[1, 0].changed == 0
    assert 0.5 <= rows[2, 0].coverage < 1 and rows[2, 0].changed == 0
    assert (3, 0) not in rows or rows[3, 0].coverage < 1


def test_case_white_space_and_numbers_hide_no_copy(spark):
    german = "Der Zug verlässt den Bahnhof und fährt mit Anna zur Küste, während der Bus am Markt auf Otto und seine Freunde wartet."
    numbers = "12 15 18 21 24 27 30 33 36 39"
    rows = found(spark, {3: ITEM.upper(), 6: ITEM.replace(" ", "  \n"), 8: german.lower(), 9: f"so {numbers} it goes", 10: numbers.replace("2", "7")},
                 [(0, ITEM), (1, german), (2, numbers)])
    assert set(rows) == {(3, 0), (6, 0), (8, 1), (9, 2)}
    assert all(r.coverage == 1 and r.changed == 0 for r in rows.values())


def test_short_items_are_one_window(spark):
    rows = found(spark, {1: "so we ask: what is the capital city? yes", 2: "the capital of it"}, [(5, "What is the capital city"), (6, "blank"), (7, None), (8, " "), (9, "7 8 9 10 11")])
    assert set(rows) == {(1, 5)}


def test_documents_with_passages(spark, small):
    """Documents that hold an item's words in a row are found; those that share no 8 words are not."""
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    rows = {(r.doc_id, r.item_id) for r in QUERIES["op8_template_windows"](spark, SMALL).collect()}
    docs = {i: " " + " ".join(words(t)) + " " for i, t in small.items()}
    for item, text in bench.items():
        w = words(text)
        whole = " " + " ".join(w) + " "
        parts = [" " + " ".join(w[k:k + 8]) + " " for k in range(len(w) - 7)]
        for i, held in docs.items():
            if whole in held:
                assert (i, item) in rows
            elif not any(p in held for p in parts):
                assert (i, item) not in rows
    assert rows


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta", 1)], "item_id long, text string, doc_id int")
    rows = {(r.doc_id, r.item_id) for r in templates.leaks(odd_docs, bench).collect()}
    assert rows == {(1, 1), (None, 1)}
    kept = templates.without_leaks(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
    assert templates.leaks(no_docs, bench).count() == 0 and templates.leaks(odd_docs, bench.limit(0)).count() == 0


def test_sets_of_hashes_stay_out_of_the_shuffled_plan(spark):
    """Spark writes a plan anew with every stage that ends; the sets as literals made it hundreds of thousands of characters."""
    docs, bench = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "benchmark"))
    plan = templates.leaks(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 20_000
