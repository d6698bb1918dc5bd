"""Odd replies and what is read from them."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import exchange as E

EMPTY = ([], [], 3, [], [])
#: reply, (summary, keywords, speakers, importance, action_items, key_quotes)
REPLIES = [
    ('{"summary":"s","keywords":["k"],"speakers":[],"importance":5,"action_items":["x"],"key_quotes":[]}', ("s", ["k"], [], 5, ["x"], [])),
    ('{"summary":"s"}', ("s", *EMPTY)),
    ("{}", (None, *EMPTY)),
    ('{"summary":null,"keywords":null,"importance":null}', (None, *EMPTY)),
    ('{"summary":"s","keywords":"alpha, beta"}', ("s", ["alpha", "beta"], [], 3, [], [])),
    ('{"summary":"s","keywords":"alpha"}', ("s", ["alpha"], [], 3, [], [])),
    ('{"summary":"s","keywords":""}', ("s", *EMPTY)),
    ('{"summary":"s","keywords":[" a ",null,"","b"]}', ("s", [" a ", "", "b"], [], 3, [], [])),
    ('{"summary":"s","keywords":[1,2.5,true]}', ("s", ["1", "2.5", "true"], [], 3, [], [])),
    ('{"summary":"s","keywords":7}', ("s", ["7"], [], 3, [], [])),
    ('{"summary":"s","importance":4.6}', ("s", [], [], 5, [], [])),
    ('{"summary":"s","importance":2.5}', ("s", [], [], 3, [], [])),
    ('{"summary":"s","importance":"4"}', ("s", [], [], 4, [], [])),
    ('{"summary":"s","importance":"4/5"}', ("s", [], [], 4, [], [])),
    ('{"summary":"s","importance":"high"}', ("s", *EMPTY)),
    ('{"summary":"s","importance":[1]}', ("s", [], [], 1, [], [])),
    ('{"summary":5}', ("5", *EMPTY)),
    ('{"summary":["a","b"]}', ('["a","b"]', *EMPTY)),
    ('{"summary":"s","action_items":"- call Bob\\n- write"}', ("s", [], [], 3, ["call Bob", "write"], [])),
    ('{"summary":"s","action_items":[{"text":"call"}]}', ("s", [], [], 3, ['{"text":"call"}'], [])),
    ('Here it is:\n```json\n{"summary":"s","keywords":["k"]}\n```\nDone.', ("s", ["k"], [], 3, [], [])),
    ('```\n{"summary":"s"}\n```', ("s", *EMPTY)),
    ('The reply is {"summary":"s","importance":1} as asked.', ("s", [], [], 1, [], [])),
    ('[{"summary":"s"}]', ("s", *EMPTY)),
    ('{"summary":"a \\"quoted\\" word"}', ('a "quoted" word', *EMPTY)),
    ('{"summary":"s","key_quotes":["one, two"]}', ("s", [], [], 3, [], ["one, two"])),
    ('{"summary":"s", "keywords":["k"', ('{"summary":"s", "keywords":["k"', *EMPTY)),
    ("nothing", ("nothing", *EMPTY)),
    ("4", ("4", *EMPTY)),
    ('"text"', ('"text"', *EMPTY)),
    ("", ("", *EMPTY)),
    ("S\nkeywords: a, b\nimportance: 2", ("S", ["a", "b"], [], 2, [], [])),
    ("S\nkeywords: [a]\nspeakers: x\nimportance: 5\naction_items: [do]\nkey_quotes: q", ("S", ["a"], ["x"], 5, ["do"], ["q"])),
    (None, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "i int, answer string")
    return df.select("i", E.parsed_annotation(F.col("answer")).alias("a")).orderBy("i").collect()


@pytest.mark.parametrize("i", range(len(REPLIES)))
def test_reply(rows, i):
    assert (tuple(rows[i]["a"]) if rows[i]["a"] else None) == REPLIES[i][1]


def test_section(spark):
    replies = ['{"summary":"s","next_steps":"write"}', '{"summary":"s","next_steps":["a","b"]}', "S\nkeywords: k\nnext_steps: - call\n- write", '{"summary":"s"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, answer string")
    got = [r["a"]["next_steps"] for r in df.select("i", E.parsed_section(F.col("answer")).alias("a")).orderBy("i").collect()]
    assert got == ["write", "a; b", "call; write", ""]


#: reply, (summary, client_name, meeting_purpose, key_topics, domain_categories, participants)
PREVIEWS = [
    ('{"summary":"S","client_name":null,"key_topics":["A"],"participants":"Bo, Cy"}', ("S", None, None, ["A"], [], ["Bo", "Cy"])),
    ('Of course: {"summary":"S","domain_categories":["Odd"]} so.', ("S", None, None, [], ["Odd"], [])),
    ("{}", ("", None, None, [], [], [])),
    ("Summary: It Is\nclient_name: N/A\nmeeting_purpose: none\nkey_topics: One, two\nthree, , \ndomain_categories: Data, other\nparticipants: - Bo,- Cy", ("it is", None, None, ["one", "two", "three"], ["data"], ["- bo", "cy"])),
    ("client_name: Acme\nparticipants:\n- Bo\n- Cy", ("", "acme", None, [], [], ["- bo", "- cy"])),
    ("summary: none\nmeeting_purpose:\nkey_topics: x", ("none", None, None, ["x"], [], [])),
    ("", ("", None, None, [], [], [])),
    (None, None),
]


def test_previews(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(PREVIEWS)], "i int, answer string")
    got = [tuple(r["p"]) if r["p"] else None for r in df.select("i", E.parsed_preview(F.col("answer")).alias("p")).orderBy("i").collect()]
    assert got == [want for _, want in PREVIEWS]


def test_sections_of_a_combined_reply(spark):
    replies = ["x\n## SUMMARY FOR SECTION 1\na SECTION 9\n## SUMMARY FOR SECTION 2\nb", "SECTION 1\na\nSECTION 2: b", "SECTION one", ""]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "doc_id int, body string")
    got = [[x.strip() for x in r["p"]] for r in df.select("doc_id", E.batched_parts(F.col("body")).alias("p")).orderBy("doc_id").collect()]
    assert got == [["a SECTION 9", "b"], ["a", ": b"], [], []]


def test_standard_stopwords(spark):
    from pyspark.ml.feature import StopWordsRemover

    from marginalia.functions.lists import ENGLISH_STOP

    assert sorted(ENGLISH_STOP) == sorted(StopWordsRemover.loadDefaultStopWords("english"))
