"""Proximity matches: what a word of the corpus carries."""

from tideflow.llm import decontamination as dc


def test_only_words_that_are_looked_up_carry_their_surroundings(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a b {text} c"), (2, "nothing like it")], "doc_id long, text string")
    store = dc.token_table(docs)
    windows = dc.benchmark_windows(spark.createDataFrame([("x", text)], "item_id string, text string"))
    terms, size = dc.vocabulary(windows)
    found = dc.proximity_matches(store, dc.plan(windows, dc.postings(store, terms, size), size))
    assert found.count() == windows.count()
    # the lookup comes first and carries nothing of the probes; the join with them sees 26 words a side, not pieces
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and plan.index("Join Inner") < plan.index(" AS near#") < plan.index("Join LeftSemi")
