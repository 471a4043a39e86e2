"""Threads of any size give the same lines; greetings stay, endings go."""

import random

from conftest import rows
from pyspark.sql import functions as F

from corpuslane.llm import emails

MAIL = "email_id long, message_id string, subject string, from_address string, to_addresses array<string>, headers map<string,string>, body_text string"


def table(spark, items):
    return spark.createDataFrame(items, MAIL).withColumn("date", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,0,0,0,cast(email_id as int))"))


def test_thread_of_5000_mails(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]  # digits would be alike in endings
    texts = [" ".join(rng.choices(vocabulary, k=16)) + "." for _ in range(5000)]
    items = []
    for k in range(5000):
        old = texts[rng.randrange(k)] if k and k % 3 else ""
        items.append((k, f"m{k}", "Hot", f"a{k % 50}@x.example", None, None, f"Dear all,\n\nAnswer {k} is new here.\n{texts[k]}\n\n{old}"))
    t = table(spark, items).repartition(3)
    whole = rows(emails.new_line_numbers(t))
    assert [x for x in whole if x[0] == 4999] == [(4999, 1), (4999, 3), (4999, 4)]
    assert {n for _, n in whole} == {1, 3, 4}
    monkeypatch.setattr(emails, "MOST_CHARS", 20_000)
    monkeypatch.setattr(emails, "MOST_BROADCAST", -1)
    assert rows(emails.new_line_numbers(t)) == whole


def test_greetings_stay_and_long_endings_go(spark):
    sign = "\n\n".join(["Ann Sample", *(f"Paragraph {w} of the notice that all our mails carry" for w in "one two three four five six seven eight nine ten eleven".split())])
    items = [(k, f"m{k}", f"S{k}", "Ann Sample <ann@x.example>", None, None, f"Dear all,\n> quoted text\n> and more of it\nMy {'red blue green white'.split()[k]} answer.\n\n{sign}") for k in range(4)]
    same = "x " * 300  # paragraphs alike in their first 400 characters and not after
    items += [(10 + k, f"n{k}", f"T{k}", "bo@y.example", None, None, f"First words.\n\n{same}end {'abcd'[k] * 5}") for k in range(2)]
    assert rows(emails.new_line_numbers(table(spark, items))) == sorted([(k, n) for k in range(4) for n in (1, 4)] + [(10, 1), (10, 3), (11, 1), (11, 3)])
