from stratakv.llm import quality
from tests.llm.helpers import sentence


def judged(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in quality.judge(df).orderBy("doc_id").collect()]


def test_counts(spark):
    eight = "a b c d e f g h"
    found = judged(spark, f"{eight} {eight}", f"{eight} x {eight} i", "p q\np q\n\np q\n \n", "#$ a*b", None, "🙂é x")
    assert [r["n_repeat_words"] for r in found] == [16, 16, 0, 0, 0, 0]
    assert [r["n_dup_lines"] for r in found] == [0, 0, 2, 0, 0, 0]
    assert [r["n_symbols"] for r in found] == [0, 0, 0, 3, 0, 0]
    assert [r["word_chars"] for r in found] == [16, 18, 6, 5, 0, 3]
    assert all(r["base_failed"] and not r["kept"] for r in (found[0], found[2], found[4]))


def test_overlapping_windows_count_each_word_once(spark):
    found = judged(spark, " ".join(["a"] * 30), "a b " * 12)
    assert [r["n_repeat_words"] for r in found] == [30, 24]


def test_plain_prose_stays_and_junk_goes(spark):
    prose = "the cat sat on the mat and it was a day for the dog to run in the park with all of us " * 2
    prose = " ".join(f"{w}{i}" if i % 3 == 0 else w for i, w in enumerate(prose.split()))
    found = judged(spark, prose, "#$%& " * 50, sentence(1, 40).replace(" ", "! ") + "!")
    assert [r["kept"] for r in found] == [True, False, False]


def test_a_filter_does_not_repeat_the_work(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = quality.judge(df).where("kept").select("doc_id")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert "split(" not in above and "regexp_extract_all" not in above
