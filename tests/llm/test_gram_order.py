"""The order of k-mers in near duplicates: counted over different texts, once, whatever is left for the last step."""

from sessionloom.llm import orderminhash


def test_copies_of_a_text_are_no_recurring_grams(spark):
    copies = [(f"word{i} a{i} b{i} c{i} d{i} e{i}",) for i in range(64) for _ in range(5)]
    common, rank = orderminhash.recurring_grams(spark.createDataFrame(copies, "text string"))
    assert len(common) == 0 and len(rank) == 0
    passage = [(f"one two three four five six seven own{i} x{i} y{i} z{i} v{i}",) for i in range(200)]
    common, rank = orderminhash.recurring_grams(spark.createDataFrame(passage, "text string"))
    assert len(common) == 3 and sorted(rank) == [0, 1, 2] and (common[1:] > common[:-1]).all()
