"""The operators in plain DataFrame expressions: URL filter, containment search, sharding."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest

from checks.compare import connect, difference
from tests.llm.helpers import documents, edited, grouped, sentence
from tradelark.llm import decontaminate, shard, urls
from tradelark.llm.queries import QUERIES, SQL

NATIVE = ["op8_url_reputation", "op9_benchmark_containment", "op10_histogram_sharding"]


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_in_the_plan(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql_on_whole_tables(spark, small, name):
    connection = connect(small)
    assert difference(connection, SQL[name], QUERIES[name](spark, small)) is None
    connection.close()


# ------------------------------------------------------------------------------ URLs


def pages(spark, rows):
    return spark.createDataFrame([(at, url, "html", 0.5) for at, url in enumerate(rows)], "page_id long, url string, host string, rate double")


def test_hosts_paths_and_longest_rules(spark):
    cases = {
        "http://A.Example.NET/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/de?x=/en/": ("example.net", "/de", "net/", "block"),
        "ftp://badexample.net/en/": ("badexample.net", "/en/", "net/", "block"),
        "http://net": ("net", "", None, None),
        "http://x.org/fr/a#b": ("x.org", "/fr/a", "org/fr/", "allow"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "a://b://c/d": ("b:", "//c/d", None, None),
        "http://É.ORG?q": ("É.org", "", None, None),
        "line\nbreak://h.net/x\ny": ("h.net", "/x\ny", "net/", "block"),
        "no scheme.net/": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
    }
    found = urls.judge_urls(pages(spark, list(cases))).collect()
    for row in found:
        host, path, rule, verdict = list(cases.values())[row.page_id]
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict if verdict else row.verdict in ("allow", "block")
    assert len(found) == len(cases)


def test_reputation_is_shrunk(spark):
    rows = [("bad.a.com", 1)] * 30 + [("good.b.com", 0)] * 30 + [("new.a.com", None), ("new.b.com", None), ("one.c.com", 1), ("far.org", None)]
    found = {row.host: row for row in urls.host_reputation(spark.createDataFrame(rows, "host string, outcome int")).collect()}
    assert 1 > found["bad.a.com"].rate >= found["new.a.com"].rate > 0.5 > found["new.b.com"].rate >= found["good.b.com"].rate > 0
    assert 0.3 < found["far.org"].rate < 0.7 < found["one.c.com"].rate
    assert found["bad.a.com"].sd < found["far.org"].sd


def test_no_labelled_page_and_no_page(spark):
    assert {row.verdict for row in urls.judge_urls(pages(spark, ["http://a.org/x", None])).collect()} == {"allow"}
    assert urls.judge_urls(pages(spark, []).limit(0)).collect() == []


# ---------------------------------------------------------------------- containment


def held(docs, items, pct=80):
    def sets(rows):
        found = defaultdict(set)
        for key, text in rows:
            own = (text or "").lower().split()
            if key is not None and own:
                found[key] |= {tuple(own)} if len(own) < 5 else {tuple(own[at : at + 5]) for at in range(len(own) - 4)}
        return found

    every = sets(docs)
    return sorted(
        (doc, item, len(wanted), len(own & wanted), len(own & wanted) / len(wanted))
        for item, wanted in sets(items).items() for doc, own in every.items() if 100 * len(own & wanted) >= pct * len(wanted)
    )


@pytest.mark.parametrize("limit", ["10m", "-1"])
def test_items_in_documents(spark, limit):
    items = [(at, sentence(at, 5 + at * 3)) for at in range(20)] + [(30, "only three words"), (31, None), (32, ""), (None, "x"), (33, "a " * 30), (5, sentence(77, 12))]
    docs = [(at, f"{sentence(100 + at, 200)} {items[at][1].upper()} {sentence(200 + at, 50)}") for at in range(20)]
    docs += [(40 + at, f"{sentence(300 + at, 30)} {edited(items[at][1], at, 1 + at // 8)} tail") for at in range(6, 20)]
    docs += [(70, "Only THREE  words"), (71, "only three words more"), (72, None), (73, ""), (None, items[3][1]), (74, items[2][1]), (74, items[9][1]), (75, "a a a a a a")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("item_id", "item_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        frame = documents(spark, docs).withColumnsRenamed({"source": "hash", "lang": "item_id"})
        found = sorted(map(tuple, decontaminate.contained_items(frame, table).collect()))
        kept = decontaminate.decontaminate(frame, table)
        assert kept.columns == frame.columns
        left = sorted((row.doc_id is None, row.doc_id or 0) for row in kept.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wanted = held(docs, items)
    assert found == wanted and len(wanted) > 20
    gone = {row[0] for row in wanted}
    assert left == sorted((doc is None, doc or 0) for doc, _ in docs if doc not in gone)


def test_empty_documents_or_items(spark):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    docs = documents(spark, [(1, "a b c d e f")])
    assert decontaminate.contained_items(docs.limit(0), items).collect() == []
    assert decontaminate.contained_items(docs, items.limit(0)).collect() == []
    assert decontaminate.decontaminate(docs, items).collect() == []


def test_size_classes_have_a_depth_and_a_step_of_their_own(spark):
    """Whatever a match leaves out, it holds as many sketch hashes as the step of the item's class."""
    sizes = {1: (1, 1), 4: (1, 1), 8: (2, 3), 10: (2, 4), 64: (3, 15), 100: (3, 23), 600: (4, 124)}  # shingles: step, depth at 80 %
    items = spark.createDataFrame([(n, " ".join(f"w{n}_{at}" for at in range(n + 4))) for n in sizes], "item_id long, text string")
    sketches = grouped([(row.item_id, row) for row in decontaminate.item_sketches(items, 80).collect()], 0, 1)
    for n, (step, depth) in sizes.items():
        assert {row.step for row in sketches[n]} == {step} and len(sketches[n]) == depth
        need = (80 * n + 99) // 100
        assert depth - (n - need) == step and {row.size_class for row in sketches[n]} == {n.bit_length() - 1}


def test_a_document_may_consist_of_several_rows(spark):
    """No row alone holds enough of the item, and the second is shorter than what is needed."""
    words = [f"w{at}" for at in range(44)]
    item = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    docs = documents(spark, [(1, " ".join(words[:24])), (1, " ".join(words[20:])), (2, " ".join(words[:24])), (3, " ".join(words[20:]))])
    found = decontaminate.contained_items(docs, item).collect()
    assert [(row.doc_id, row.item_id, row.n_shingles, row.n_shared) for row in found] == [(1, 7, 40, 40)]


# -------------------------------------------------------------------------- sharding


def sharded(docs, **options):
    found = shard.shard_by_bytes(docs, **options).collect()
    slots = grouped(found, "shard", "slot")
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    return found, {key: sum(own) for key, own in grouped(found, "shard", "size").items()}


@pytest.mark.parametrize("slot_bytes", [1 << 20, 500])
def test_bytes_are_near_equal(spark, slot_bytes):
    rows = [(at, sentence(at, 1 + at % 60)) for at in range(1500)] + [(2000, None), (2001, ""), (None, "é"), (None, "é"), (5, "again")]
    docs = documents(spark, rows).repartition(5).withColumnsRenamed({"source": "shard", "lang": "_key"})
    found, size = sharded(docs, slot_bytes=slot_bytes)
    assert len(found) == len(rows) and {row.law for row in found} == {"bytes"}
    assert sorted(row.size for row in found) == sorted(len((text or "").encode()) + 1 for _, text in rows)
    assert set(size) == set(range(8)) and max(size.values()) <= min(size.values()) * 1.02
    # Equal texts share a shard.
    assert all(len(set(own)) == 1 for key, own in grouped(found, "text", "shard").items() if key)


def test_a_group_of_copies_larger_than_a_shard_is_split(spark):
    rows = [(at, "the same text of a third of all rows") for at in range(700)] + [(1000 + at, sentence(at, 8)) for at in range(1300)]
    _, size = sharded(documents(spark, rows))
    assert max(size.values()) <= min(size.values()) * 1.03


def test_one_long_text_fewer_rows_than_shards_and_none(spark):
    found, size = sharded(documents(spark, [(1, "x" * 10_000), (2, "a"), (3, "b")]))
    assert len(found) == 3 and set(size) <= set(range(8))
    assert shard.shard_by_bytes(documents(spark, [])).collect() == []
    found, size = sharded(documents(spark, [(7, "same")] * 20), shards=4)
    assert len(found) == 20
