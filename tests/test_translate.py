import json

import pytest

from folioforge.plans import translate
from folioforge.sources import providers


@pytest.fixture
def odd():
    """Leaves out the second text of a request, and drops digits unless a hint asks for them."""

    def make():
        def chat(message, hint):
            items = json.loads(message)
            kept = items if len(items) == 1 else items[:1] + items[2:]
            return json.dumps([{"i": x["i"], "t": x["t"].upper() if hint or "never" not in x["t"] else "none"} for x in kept if "mute" not in x["t"]])

        return chat

    providers.PROVIDERS["odd"] = make
    yield "odd"
    del providers.PROVIDERS["odd"]


def test_batches_hold_all_in_order():
    assert list(translate.batched(["x"] * 13)) == [list(range(12)), [12]]
    assert list(translate.batched(["x" * 7000, "y" * 6000, "z"])) == [[0], [1], [2]]
    assert list(translate.batched([])) == []


def test_missing_answers_are_asked_for_again(odd):
    chat = providers.PROVIDERS[odd]()
    assert translate.ask(chat, ["ab", "cd", "ef", "mute"]) == ["AB", "CD", "EF", None]
    assert translate.ask(chat, []) == []


def test_calls_are_patient():
    left = [TimeoutError(), ConnectionError()]

    def chat(message, hint):
        if left:
            raise left.pop()
        return message

    assert providers.patient(chat, pause=0)("a", "") == "a"
    with pytest.raises(ValueError):
        providers.patient(lambda m, h: int("x"), pause=0)("a", "")


def test_paragraphs(spark):
    rows = [(1, 0, "Hello  World 5"), (1, 1, "12"), (1, 2, None), (2, 0, "hello world 5"), (2, 1, "Seen before 7"), (2, 2, "Bad cache 9")]
    df = spark.createDataFrame(rows, "doc_id long, ord int, line string")
    cache = spark.createDataFrame([("seenbefore7", "cached 7"), ("badcache9", "no number")], "key string, value string")
    got = {(r.doc_id, r.ord): (r.skip_reason, r.target, r.error) for r in translate.translate(df, cache=cache).collect()}
    assert got == {(1, 0): (None, "hELLO wORLD 5", None), (1, 1): ("page_num", None, None), (1, 2): ("empty", None, None), (2, 0): (None, "hELLO wORLD 5", None), (2, 1): (None, "cached 7", None), (2, 2): (None, "bAD CACHE 9", None)}
    assert translate.translate(df.limit(0)).count() == 0


def test_numbers_are_guarded(spark, odd):
    rows = [(1, 0, "never 4 mind"), (1, 1, "mute words"), (1, 2, "plain words")]
    df = spark.createDataFrame(rows, "doc_id long, ord int, line string")
    got = {r.ord: (r.target, r.error) for r in translate.translate(df, odd).collect()}
    assert got == {0: ("NEVER 4 MIND", None), 1: (None, translate.NO_ANSWER), 2: ("PLAIN WORDS", None)}


def test_numbers_that_stay_missing_are_errors(spark):
    df = spark.createDataFrame([("k", "page 4 of 5")], "key string, text string")
    got = translate.translate_texts(df, lambda: lambda message, hint: '["only 5"]').first()
    assert (got.target, got.error) == (None, translate.NUMBERS + "4")
