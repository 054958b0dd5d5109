"""Pairs that members of a bucket propose by their rarest shingles."""

from starlens.llm import near_dup

OWN, SHARED, GROUP = 16, 84, 30


def test_a_large_group_proposes_only_what_can_be_similar(spark):
    # Members share 84 of 100 shingles (similarity 0.72); 101 is nearly 1, and 102 the first 90 shingles of 2.
    common = list(range(1, SHARED + 1))
    sets = {i: common + [1000 * i + j for j in range(OWN)] for i in range(1, GROUP + 1)}
    sets[101] = sets[1][:-2] + [-1, -2]
    sets[102] = sets[2][:90]
    # The second bucket repeats some members of the first.
    where = [(7, i, i) for i in sets] + [(8, i, i) for i in sets if i % 2]
    found = near_dup._by_rare_shingles(
        spark.createDataFrame(where, "key long, rep long, label long"),
        spark.createDataFrame(list(sets.items()), "doc_id long, members array<long>"),
        80,
        100,
    )
    similar = {
        (a, b)
        for a in sets
        for b in sets
        if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 80 * len(set(sets[a]) | set(sets[b]))
    }
    assert {(1, 101), (2, 102)} <= similar
    proposed = {tuple(r) for r in found.collect()}
    assert similar <= proposed and len(proposed) < 3 * len(similar)
