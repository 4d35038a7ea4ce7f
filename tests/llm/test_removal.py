"""What the corpus operators must not leave out."""

import pytest

from molquarry.llm import decontaminate


@pytest.mark.parametrize("shard", [500_000, 12])
def test_removal_does_not_depend_on_the_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    words = lambda p, n: [f"{p}{i}" for i in range(n)]
    one, two = words("a", 12), words("b", 12)
    three = [*one[6:], *words("c", 6)]  # its first half stands in the first item
    rest = words("z", 40)
    docs = [
        (1, [*one, *rest[:8], *two, *rest[8:16]]),  # 24 of 40: more than half together, no item alone
        (2, [*rest[:20], *one, *three[6:], *rest[20:]]),  # overlapping items
        (3, [*rest[:20], *two[:6], *one, *two[6:], *rest[20:]]),  # two is no neighbourhood of the document
        (4, rest),
    ]
    rows = spark.createDataFrame([(i, " ".join(w), 7) for i, w in docs], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((one, two, three))], "item_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in decontaminate.remove_items(rows, bench).collect()}
    assert set(got) == {2, 3, 4}
    assert got[2].text.split() == rest
    assert got[3].text.split() == [*rest[:20], *two, *rest[20:]]
    assert got[4].n_chars == 7 and got[2].n_chars == len(got[2].text)
