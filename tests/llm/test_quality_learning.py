from listinglake.llm.quality import _features, learn


def test_repeated_ids_train_the_same_model_in_any_order(spark):
    rows = [(i % 8, f"{'good plain words here' if (i + i // 8) % 2 else '#$ || !! a a a'} {'x ' * (i % 5)}{i}") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int")
    learned = []
    for given in (rows, rows[::-1], rows[37:] + rows[:37]):
        docs = spark.createDataFrame(given, "doc_id long, text string").coalesce(1)
        learned.append(learn(docs, labels, most=8).probability(_features([t for _, t in rows])).tolist())
    assert learned[0] == learned[1] == learned[2] and len(set(learned[0])) > 1
