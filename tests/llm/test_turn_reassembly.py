"""op11: the wheel and the stream against a plain version that looks at every conversation in every batch."""

import random

import pytest

from quillon.llm import queries, turn_reassembly
from tests.llm.test_queries_sql import agree


def plain(arrivals, batches, patience):
    """Events of (batch, conv, turn, first, role, text), one a turn and batch, by asking every conversation at every tick."""
    out, kept, seen, closed, released = [], {}, {}, set(), {}
    for b in range(batches + 1):
        for _, conv, turn, first, role, text in sorted((a for a in arrivals if a[0] == b), key=str):
            if conv in closed:
                out.append(("reject", conv, turn, b, role, text, None, None, None))
                continue
            seen[conv] = b
            kept.setdefault(conv, {}).setdefault(turn, (role, text))
            released.setdefault(conv, first)
            while released[conv] in kept[conv]:
                out.append(("release", conv, released[conv], b, *kept[conv][released[conv]], None, None, None))
                released[conv] += 1
        for conv in [c for c in seen if c not in closed and (b == batches or b - seen[c] >= patience)]:
            closed.add(conv)
            turns, first = kept[conv], min(a[3] for a in arrivals if a[1] == conv)
            missing = sum(t not in turns for t in range(first, max(turns) + 1))
            breaks = sum(t - 1 in turns and turns[t - 1][0] == r for t, (r, _) in turns.items())
            out.append(("close", conv, -1, b, None, None, ",".join(str(t) for t in sorted(turns) if t >= released[conv]), missing, breaks))
    return sorted(map(str, out))


def drawn(seed, batches, convs=9, turns=7):
    rng = random.Random(seed)
    found = {}
    for _ in range(rng.randrange(20, 120)):
        conv, turn, b = rng.randrange(convs), rng.randrange(turns), rng.randrange(batches)
        found[b, conv, turn] = (b, conv, turn, 0, rng.choice("uas"), rng.choice(["", "x|y", "ü", "long" * 50]))
    firsts = {}
    for _, conv, turn in found:
        firsts[conv] = min(firsts.get(conv, 99), turn)
    return [(b, c, t, firsts[c], r, x) for b, c, t, _, r, x in found.values()]


@pytest.mark.parametrize("seed", range(60))
@pytest.mark.parametrize("patience", [1, 2, 3])
def test_bucket_equals_a_plain_version(seed, patience):
    batches, state, got = 10, None, []
    arrivals = drawn(seed, batches)
    for b in range(batches + 1):
        bucket = turn_reassembly.Bucket(patience, state)
        for _, *row in [a for a in arrivals if a[0] == b]:
            got += bucket.arrive(b, *row)
        got += bucket.tick(b, b == batches)
        state = bucket.state()
    assert sorted(map(str, got)) == plain(arrivals, batches, patience)


def test_a_tick_reads_its_own_slot_alone():
    bucket = turn_reassembly.Bucket(2)
    for k in range(50):
        list(bucket.arrive(k % 2, k, 0, 0, "u", "t"))
    again = turn_reassembly.Bucket(2, bucket.state())
    assert list(again.tick(1)) == [] and not again.touched
    assert {e[1] for e in again.tick(2)} == set(range(0, 50, 2)) and not again.touched


def test_stream_equals_a_plain_version(spark):
    arrivals = drawn(7, 4)
    df = spark.createDataFrame(arrivals, "batch int, conv_id long, turn long, first long, role string, text string")
    got = turn_reassembly.reassemble(df.unionByName(df), 4, 1, 1).collect()
    assert sorted(str((r["event"], r["conv_id"], r["turn"], r["batch"], r["role"], r["text"], r["pending"], r["n_missing"], r["n_breaks"])) for r in got) == plain(arrivals, 4, 1)


def test_odd_conversations(spark, tmp_path):
    said = ["a|b", "", None, "ü\n𝄞", "long " * 30000, "a"]
    found = [(None if k % 7 == 0 else (1 << 60) + k % 7, None if k % 11 == 0 else k // 7 + 5, ["user", None, "a|", "system"][k % 4], said[k % 6], k, "x") for k in range(160)]
    found += [(9, 1 << 40, "user", "far", 0, "x"), (9, -3, "user", "below", 0, "x"), *found[:20]]
    spark.createDataFrame(found, "conv_id long, turn long, role string, text string, first long, batch string").write.parquet(f"{tmp_path}/conversations.parquet")
    agree(spark, "op11_turn_reassembly", str(tmp_path))


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.QUERIES["op11_turn_reassembly"](spark, str(tmp_path)).count() == 0
