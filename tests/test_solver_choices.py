from condnet.operators import solver


def test_more_choices_than_were_enumerated():
    ruled_out = ["l(x) <= 12", *(f"l(x) != {k}" for k in range(13))]
    assert solver.is_contradiction(ruled_out) and solver.normalized(tuple(ruled_out)) is None
    assert not solver.is_contradiction(ruled_out[:-1])
    either = [f"Or(a{k} == 1, a{k} == 2)" for k in range(13)]
    assert not solver.is_contradiction(either) and solver.is_contradiction([*either, "a3 != 1", "a3 != 2"])
    linked = [f"Or(a{k} == a{k + 1}, a{k} == {k})" for k in range(13)]
    assert solver.is_contradiction([*linked, *(f"a{k} != {j}" for k in range(13) for j in range(13)), "a13 == 5"])
    assert not solver.is_contradiction([f"Or(l(x) == {k}, l(x) != {k})" for k in range(20)])
    assert solver.is_contradiction([f"l(x) != {k}" for k in range(40)] + ["l(x) <= 39"])
    # three names, two values: found once, not once for each way of the free choices
    pigeons = [*(f"Or(p{k} == 1, p{k} == 2)" for k in range(3)), "p0 != p1", "p0 != p2", "p1 != p2"]
    assert solver.is_contradiction([*(f"Or(f{k} == 1, f{k} == 2)" for k in range(30)), *pigeons])
