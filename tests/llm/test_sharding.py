import zlib

import numpy as np
import rows

from visitflow.llm import sharding as S


def _plain(sums):
    """The same differencing with sets in place of notes."""
    parts = [[(int(v), [(i, j)]) for j, v in enumerate(row)] for i, row in enumerate(sums)]
    while len(parts) > 1:
        parts.sort(key=lambda p: max(x[0] for x in p) - min(x[0] for x in p))
        a = sorted(parts.pop(), key=lambda x: -x[0])
        b = sorted(parts.pop(), key=lambda x: x[0])
        parts.append([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b, strict=True)])
    return sorted(x[0] for x in parts[0])


def test_differencing_reaches_the_same_sums():
    rng = np.random.default_rng(3)
    for k in (2, 3, 7):
        sums = np.zeros((25, k), np.int64)
        sums[:, 0] = rng.permutation(1000)[:25] + 1
        sums[0] = rng.integers(0, 300, k)
        total, slots = S.differenced(sums)
        own = np.zeros(k, np.int64)
        for row, to in zip(sums, slots, strict=True):
            assert sorted(to) == list(range(k))
            own[to] += row
        assert (own == total).all()
        assert sorted(own.tolist()) == _plain(sums)


def test_groups_stay_together_and_slots_are_gapless(spark):
    texts = [(i, "x" * (i % 37) + str(i % 50)) for i in range(800)] + [(900 + i, "hot text") for i in range(300)]
    docs = rows.widened(rows.documents(spark, texts).unionByName(rows.odd(spark)))
    got = S.sharded(docs, 6).collect()
    assert len(got) == docs.count()
    by_text = {}
    for r in got:
        by_text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    for shard in range(6):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    for r in got:
        if r["doc_id"] is not None and 900 <= r["doc_id"]:
            assert r["text_crc32"] == zlib.crc32(b"hot text") and r["size"] == 24
    assert S.sharded(docs.limit(0), 6).count() == 0


def test_many_parts_are_as_even_as_one(spark):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.lognormal(6, 1.5, 3000)] + [60_000, 250_000]
    groups = spark.createDataFrame([(i.to_bytes(4, "big"), s) for i, s in enumerate(sizes)], "digest binary, size bigint")
    got = S.group_shards(groups, 8, part=200).collect()
    sums = np.zeros(8, np.int64)
    for r in got:
        sums[r["shard"]] += r["size"]
    assert len(got) == len(sizes)
    fair = (sum(sizes) - 250_000) / 7  # a group larger than a fair share makes a shard of its own
    rest = np.sort(sums)[:-1] if fair < 250_000 else np.sort(sums)
    assert rest.max() - rest.min() < 0.01 * rest.mean()
