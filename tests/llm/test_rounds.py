"""Later rounds of near-duplicate search read only lists that can give new pairs, and miss none."""

import random

from quarry.llm import near_dup


def test_reopened_lists_give_all_new_pairs(spark):
    r = random.Random(4)
    size, central = {d: r.randrange(90, 110) for d in range(60)}, {d: r.randrange(5) for d in range(60)}
    rows = [(k, d, size[d], central[d]) for k in range(12) for d in r.sample(range(60), 20)]
    members = spark.createDataFrame(rows, "key long, doc long, n int, central long")
    at = lambda c: spark.createDataFrame([(d, x) for d, x in enumerate(c)], "doc long, component long")
    before = [d // 2 * 2 for d in range(60)]
    tested = spark.createDataFrame([], "a long, b long")
    pairs, mixed, heads = near_dup._later_pairs(members, at(before), tested, 80)
    tested = tested.unionByName(pairs)
    # Of some lists the next one joins the first one's component.
    after, keys = list(before), set()
    for h in sorted(heads.collect())[:3]:
        old, new = max(after[h.first], after[h.next]), min(after[h.first], after[h.next])
        after = [new if c == old else c for c in after]
    keys = {h.key for h in heads.collect() if after[h.first] == after[h.next]}
    again, closed = near_dup._reopened(mixed, heads, at(after))
    assert {x.key for x in again.select("key").distinct().collect()} == keys and 0 < len(keys) < 12
    assert {x.key for x in closed.collect()} == set(range(12)) - keys
    fresh = lambda rows: {(p.a, p.b) for p in near_dup._later_pairs(rows, at(after), tested, 80)[0].collect()}
    assert fresh(again) == fresh(members) != set()
