"""Search by posting lists gives what the scan gives."""

import random

import pytest

from newsloom.operators import search, search_index
from newsloom.sources.commits import Tables

ITEMS = "id long, title string, summary string, source string, region string, language string, search_terms string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["Pont", "rouvre", "à", "Sion", "économie", "the", "météo", "ski", "ONU", "d'eau", "été", "lac", "x", "of"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    return [(k, text(4), text(rng.randrange(12)), rng.choice(["Radio A", None]), "valais", "fr", None) for k in range(400)] + [(400, None, "", "", "", "", ""), (401, "x", None, None, None, None, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, rows):
    items = spark.createDataFrame([], ITEMS).schema
    out = Tables(spark, f"file://{tmp_path_factory.mktemp('index')}/t", {"items": items, "postings": search_index.POSTINGS}).init()
    for part in (rows[:300], rows[250:], rows[:10]):
        search_index.add(out, spark.createDataFrame(part, ITEMS))
    return out


QUERIES = ["sion", '"Economie"', '"the" pont', '"SKI" "lac"', "pont rouvre", "l'eau", "d'eau", '"of"', "x", "", "no such words", '"meteo" "onu" ete', "radio a"]


@pytest.mark.parametrize("query", QUERIES)
def test_same_rows_as_the_scan(spark, rows, tables, query):
    every = spark.createDataFrame(rows, ITEMS)
    want = sorted(r.id for r in every.filter(search.matches(query)).collect())
    assert sorted(r.id for r in search_index.find(tables, query).collect()) == want


def test_only_postings_and_hits_are_read(spark, rows, tables, monkeypatch):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [" in plan(search_index.candidates(tables.read("postings"), "economie"))
    assert "In(id, [" in plan(search_index.find(tables, "economie pont"))
    monkeypatch.setattr(search_index, "FEW", 3)
    want = sorted(r.id for r in spark.createDataFrame(rows, ITEMS).filter(search.matches("sion")).collect())
    assert sorted(r.id for r in search_index.find(tables, "sion").collect()) == want and len(want) > 3


def test_items_are_added_once(tables):
    assert tables.read("items").count() == 402 and tables.read("items").select("id").distinct().count() == 402
    assert tables.versions() == [0, 1, 2, 3]
    pairs = tables.read("postings")
    assert pairs.count() == pairs.distinct().count()
