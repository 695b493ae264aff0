import random
import zlib

import pytest

from seriesloom.llm import sharding


def check(rows, got, n=40):
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    for s in range(n):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_sizes_slots_and_groups(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sharding.op7_kd_tree_sharding(spark, sf).collect()
    check(rows, got)
    loads, where = [0] * 40, {}
    for r in got:
        body = rows[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.grown_shard) == (len(body) + 16, zlib.crc32(body), None)
        loads[r.shard] += r["size"]
        where.setdefault(rows[r.doc_id], set()).add(r.shard)
    assert max(loads) <= 1.05 * sum(loads) / 40 and min(loads) >= 0.95 * sum(loads) / 40
    assert all(len(s) == 1 for s in where.values())


def test_a_hot_group_is_split_and_the_rest_stays_together(spark):
    rows = [(i, "same text", "src") for i in range(4000)] + [(i, f"text {i // 2} " * 4, f"s{i % 5}") for i in range(4000, 12000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.shards(docs).collect()
    check(rows, got)
    loads, text = [0] * 40, {i: t for i, t, _ in rows}
    where = {}
    for r in got:
        loads[r.shard] += r["size"]
        where.setdefault(text[r.doc_id], set()).add(r.shard)
    assert max(loads) <= 1.1 * sum(loads) / 40 and min(loads) >= 0.9 * sum(loads) / 40
    assert len(where.pop("same text")) > 1 and all(len(s) == 1 for s in where.values())


def test_edge_cases(spark):
    rows = [(1, None, "a", 0), (1, None, "a", 0), (2, "", None, 0), (None, "x", "b", 0), (3, "y" * 300_000, "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    got = sharding.shards(docs, meta=("source", "nowhere")).collect()
    check(rows, got)
    assert sorted((r["size"], r.text_crc32) for r in got)[:2] == [(16, 0), (16, 0)]
    assert sharding.shards(docs.limit(0)).count() == 0


def plain_tree(units, n):
    """unit -> shard, by sorting: (unit, d0, d1, weight) rows over shards 0 to n - 1."""
    out, todo = {}, [(units, 0, n)]
    while todo:
        rows, a, b = todo.pop()
        if b - a == 1 or not rows:
            out |= {r[0]: a for r in rows}
            continue
        widest = max((1, 2), key=lambda d: (max(r[d] for r in rows) - min(r[d] for r in rows), -d))
        rows.sort(key=lambda r: r[widest])
        total, left, borders = sum(r[3] for r in rows), 0, []
        for i, r in enumerate(rows):
            left += r[3]
            borders.append((i + 1, left))
        each, k = total / (b - a), b - a
        over = next(i for i, (_, w) in enumerate(borders) if w >= total * (k // 2) / k)
        tried = []
        for i, w in [borders[over - 1] if over else (0, 0), borders[over]]:
            m = max(1, min(k - 1, round(w / each)))
            tried.append((max(w / m, (total - w) / (k - m)), m, i, w))
        _, m, i, w = min(tried)
        lack, sides, moved = m * each - w, (rows[:i], rows[i:]), set()
        for _ in range(sharding.MOVES):
            if abs(lack) <= sharding.EVEN * each:
                break
            fits = [r for r in sides[lack > 0] if r[0] not in moved and r[3] < 2 * abs(lack)]
            if not fits:
                break
            best = min(fits, key=lambda r: (abs(r[3] - abs(lack)), r[0]))
            moved.add(best[0])
            lack += -best[3] if lack > 0 else best[3]
        at = {r[0] for r in sides[0]} ^ moved
        todo += [([r for r in rows if r[0] in at], a, a + m), ([r for r in rows if r[0] not in at], a + m, b)]
    return out


def test_the_tree_equals_a_plain_one(spark):
    rng = random.Random(5)
    for n, count in ((1, 5), (7, 400), (12, 9)):
        units = [(i, rng.randrange(4096) << 18 | i, rng.choice((100, 2000, 2001)) << 18 | rng.randrange(1 << 9) << 9 | i, float(rng.randrange(1, 90) ** 2)) for i in range(count)]
        frame = spark.createDataFrame(units, "unit long, d0 long, d1 long, weight double")
        got = {r.unit: r.shard for r in sharding._tree(frame, ["d0", "d1"], n).collect()}
        assert got == plain_tree(units, n)


def test_rows_larger_than_the_level_leave_the_other_shards_even(spark):
    sf = "/root/testdata/sf0.001"
    got = sharding.op7_kd_tree_sharding(spark, sf).collect()
    sizes = sorted((r["size"] for r in got), reverse=True)
    level = sharding.level_bytes(sum(sizes), sizes[:40], 40)
    loads, alone = [0] * 40, {}
    for r in got:
        loads[r.shard] += r["size"]
        alone.setdefault(r.shard, []).append(r["size"])
    assert min(loads) > 0.7 * level
    assert all(x <= max(level + max(alone[s]) / 2, max(alone[s])) for s, x in enumerate(loads))


@pytest.mark.parametrize("others", [0, 200])
def test_repeated_rows_above_a_shard(spark, others, monkeypatch):
    """Equal rows of one id part like any others, in shards and in numbering."""
    monkeypatch.setattr(sharding, "SLOT_ROWS", 10)
    rows = [(7, "one text that repeats, " * 4)] * 1000 + [(1000 + i, f"another text, number {i:03}, " * 3) for i in range(others)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.shards(docs, 8).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 2 * out["size"].max()
    assert len(out) == len(rows) and all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
