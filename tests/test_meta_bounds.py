from treeledger.operators import meta as M

EVENTS = "root string, seq long, op string, path string, tag string, src string, dst string"


def test_fold_follows_more_moves_than_32(spark):
    rows = [("r", 0, "add", "a/x", "t", None, None)]
    rows += [("r", i, "move", None, None, *(("a", "b") if i % 2 else ("b", "a"))) for i in range(1, 41)]
    assert [tuple(r) for r in M.fold_tags(spark.createDataFrame(rows, EVENTS)).collect()] == [("r", "a/x", "t")]


def test_closure_of_40_parents_and_of_a_cycle(spark):
    chain = [(f"t{i}", f"t{i + 1}") for i in range(40)]
    got = {tuple(r) for r in M.tag_closure(spark.createDataFrame(chain, "tag string, parent string")).collect()}
    assert got == {(f"t{i}", f"t{j}") for i in range(41) for j in range(i + 1, 41)}
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "tag string, parent string")
    assert {tuple(r) for r in M.tag_closure(ring).collect()} == {(x, y) for x in "ab" for y in "ab"}
