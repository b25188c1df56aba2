"""Page ids of any kind: null counts last, text comes back as it was."""

import datetime

from corpusloom.llm import warc

TIME = datetime.datetime(2022, 1, 2)


def outcome(spark, ids, kind, payload=lambda i: "<p>a</p>"):
    rows = [(d, f"http://h.example.org/{i}", payload(i), TIME, "x", "y") for i, d in enumerate(ids)]
    pages = spark.createDataFrame(rows, f"page_id {kind}, url string, html string, fetched_at timestamp, row string, digest string")
    got = warc.archive(pages)
    return got.dtypes, sorted(((r.page_id, r.record_type, r.refers_to) for r in got.collect()), key=str)


def test_a_null_id_is_never_the_response_of_a_known_one(spark):
    _, got = outcome(spark, [None, 3, 5], "long")
    assert got == [(3, "response", None), (5, "revisit", 3), (None, "revisit", 3)]


def test_nulls_alone(spark):
    _, got = outcome(spark, [None, None], "int")
    assert got == [(None, "response", None), (None, "revisit", None)]


def test_text_ids_come_back(spark):
    ids = ["b>\r\nX: y", "a b+%2B", "", "é", None, "<urn:nil>", "7"]
    types, got = outcome(spark, ids, "string")
    assert dict(types)["page_id"] == dict(types)["refers_to"] == "string"
    assert got == sorted([(d, "response" if d == "" else "revisit", None if d == "" else "") for d in ids], key=str)


def test_distinct_payloads_of_one_text_id_are_all_responses(spark):
    _, got = outcome(spark, ["p", "p", "q"], "string", payload=lambda i: f"<p>{i}</p>")
    assert got == [("p", "response", None), ("p", "response", None), ("q", "response", None)]
