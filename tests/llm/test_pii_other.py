"""Personal data beyond the base forms comes out as kind ``other``."""

from pyspark.sql import functions as F

from weekcast.llm import pii


def test_planted_forms_come_out_as_other(spark):
    texts = [f"write to user{i}.x@mail{i % 7}.example.com or call +1 (30{i % 10}) 555-01{i % 10}0 now" for i in range(60)]
    texts += [f"lot {i * 7919 % 100003:07d} and part 12-34-56-{i:02d}" for i in range(60)]
    plain = ["pay to DE89370400440532013001 soon", "look (at)  this", "call on 2024-01-15 10:30", "meet [at] noon"]
    plant = {"reach user.y(at)mail.example.com today": "user.y(at)mail.example.com",
             "or anna [AT] mail.example.org": "anna [AT] mail.example.org",
             "pay to DE89370400440532013000 soon": "DE89370400440532013000",
             "pay to GB82 WEST 1234 5698 7654 32.": "GB82 WEST 1234 5698 7654 32",
             "pay BE68539007547034 EURO": "BE68539007547034",
             "my phone is 030 555 0199, thanks": "030 555 0199",
             "Tel: (030) 5550-123": "(030) 5550-123"}
    texts += plain + list(plant)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked, p = pii.find_pii(docs)
    got = {r.text: [r.text[s.start:s.stop] for s in r.o]
           for r in marked.select("text", F.col(f"{p}other").alias("o")).collect()}
    for text, value in plant.items():
        assert got[text] == [value], text
    assert not any(got[t] for t in texts[:120] + plain)


def test_only_good_candidates(spark):
    docs = spark.createDataFrame([(1, "pay to DE89370400440532013000 soon")], "doc_id long, text string")
    marked, p = pii.find_pii(docs)
    assert [r[0] for r in marked.select(F.size(f"{p}other")).collect()] == [1]
