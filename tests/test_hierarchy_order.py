from condnet.operators.hierarchy import hierarchy


def test_descendants_ascend_either_way(spark):
    # heavy-first, 9 and what is below it would come before 2
    df = spark.createDataFrame([(1, 5, 2), (1, 5, 9), (1, 9, 7), (1, 9, 3), (1, 3, 8), (2, 1, 4)], "g int, a int, b int")
    got = [sorted((r.grp, r.node, tuple(r.path), tuple(r.descendants)) for r in hierarchy(df, "g", ["a", "b"], full=True, local=local).collect()) for local in (10**6, 3, 0)]
    assert got[0] == got[1] == got[2]
    assert {(g, n): below for g, n, _, below in got[0]} == {(1, 5): (2, 3, 7, 8, 9), (1, 9): (3, 7, 8), (1, 3): (8,), (1, 2): (), (1, 7): (), (1, 8): (), (2, 1): (4,), (2, 4): ()}
