"""Runs of names, numbers and white space as long as a text: Java's patterns may not go a level deeper with each of them."""

from pyspark.sql import functions as F

from tabulon.llm import decontaminate

ITEM = "how many apples does a basket of forty hold when two are eaten"


def test_long_runs_of_names_and_numbers(spark):
    n = 40_000
    runs = ["see " + " ".join(["Apple"] * n), " ".join(["Apple"] * n), ",".join(["1"] * n), "x" + "\n" * n, "x." + " " * n]
    docs = spark.createDataFrame([(i, f"{run}. {ITEM}") for i, run in enumerate(runs)], "doc_id bigint, text string").repartition(5)
    got = decontaminate.contaminated(docs, spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in got} == {(i, 7, "exact") for i in range(len(runs))}
    kinds = {r["doc_id"]: r["t"] for r in docs.select("doc_id", decontaminate.tokens(F.col("text"))["t"].alias("t")).collect()}
    words = ITEM.split()
    assert kinds == {0: ["see", "<name>", *words], 1: ["apple", "<name>", *words], 2: ["<num>", *words], 3: ["x", *words], 4: ["x", *words]}


def test_units_names_and_openers_between_odd_marks(spark):
    text = "\n\r\n Ann Lee paid 1,2 ,3 kg to Ann Lee... 4.5m 6,7,8\n\tBob,9  cl"
    row = spark.createDataFrame([(text,)], "text string").select(decontaminate.tokens(F.col("text")).alias("x")).first()["x"]
    assert [(x["t"], x["w"]) for x in row] == [
        ("ann", "Ann"), ("<name>", "Lee"), ("paid", "paid"), ("<num>", "1,2"), ("<num>", "3"), ("<unit>", "kg"), ("to", "to"), ("<name>", "Ann Lee"),
        ("<num>", "4.5"), ("<unit>", "m"), ("<num>", "6,7,8"), ("bob", "Bob"), ("<num>", "9"), ("cl", "cl"),
    ]
