"""What larger tables showed: tables that the planner takes for small."""

from foliospark.llm import minhash, stages

TEXTS = [" ".join(f"w{i}{j}" for j in range(20)) for i in range(6)]
SENT = "BroadcastHashJoin"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    return spark.createDataFrame([(i, f"{TEXTS[i % 6]} {'end' * (i // 6)}", "s") for i in range(18)], "doc_id long, text string, source string")


def test_op6_does_not_leave_its_key_table_to_the_planner(spark, monkeypatch):
    written, write = [], minhash.Scratch.write
    monkeypatch.setattr(minhash.Scratch, "write", lambda self, df, rows=None: written.append(df) or write(self, df, rows))
    assert minhash.groups(documents(spark), 5).where("kept").count() == 6
    members = [df for df in written if {"key", "lo", "size"} <= set(df.columns)]
    assert members and not any(SENT in plan(df) for df in members)


def test_rejected_rows_over_the_bound_are_joined_by_shuffle(spark, monkeypatch):
    docs = documents(spark)
    keyed = stages._keyed(docs)
    for most, sent in ((3, True), (2, False)):
        monkeypatch.setattr(stages, "BROADCAST_IDS", most)
        left = stages._without(keyed, keyed.where("doc_id < 3"), docs)
        assert left.count() == 15 and (SENT in plan(left)) == sent
