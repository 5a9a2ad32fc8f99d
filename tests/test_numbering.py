import inspect

from matchlake.operators import evidence, resolve


def test_names_take_free_numbers_in_order(spark):
    taken = ["a", "a-2", "a-4", "a-07", "b-3", "z"]
    names = [(f"n{k:03d}", "ab"[k % 3 == 0], k) for k in range(90)] + [("solo", "c", 500)]
    out = resolve.mint_names(spark.createDataFrame(names, "name string, slug string, ord bigint"), spark.createDataFrame([(t,) for t in taken], "id string")).collect()
    want = {}
    held = set(taken)
    for name, slug, _ in sorted(names, key=lambda r: r[2]):
        n = 1
        while (made := slug if n == 1 else f"{slug}-{n}") in held:
            n += 1
        held.add(made)
        want[name] = made
    assert {r.name: r.id for r in out} == want


def test_no_window_sees_a_whole_group():
    assert "Window" not in inspect.getsource(resolve.mint_names) and "Window" not in inspect.getsource(evidence.review_rows)
