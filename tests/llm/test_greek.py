"""Words whose full lower case depends on their neighbours."""

from cadastrum.llm import decontamination


def test_final_sigma_before_a_full_stop(spark):
    text = " ".join(["ΟΔΟΣ.ΑΒ"] * 5)
    docs = spark.createDataFrame([(1, f"Start {text} End")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text)], "item_id long, text string")
    row = decontamination.contamination(docs, bench).first()
    assert (row.n_words, row.n_hit, row["items"]) == (12, 10, ["7"])
    assert decontamination.remove_contaminated(docs, bench).count() == 0
