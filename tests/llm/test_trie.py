import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankflow.llm import trie as T
from rankflow.llm.q_trie import op12_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out[c].append(((turn is not None, turn or 0, hashlib.md5(f"{role}:{text}".encode()).hexdigest()), (role, text)))
    return {c: [m for _, m in sorted(v)] for c, v in out.items()}


def respliced(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    found = {}
    for prefix in sorted(nodes, key=len, reverse=True):
        members = nodes[prefix]
        kids = [p for p in nodes if len(p) == len(prefix) + 1 and p[:-1] == prefix]
        saved = (len(members) - 1) * len(prefix[-1][1].encode()) if prefix else 0
        ends = sorted(c for c in members if len(convs[c]) == len(prefix))
        found[prefix] = (min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), len(kids),
                         sum(found[k][5] for k in kids) or 1, saved + sum(found[k][6] for k in kids),
                         hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(found.values())


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, 3, "clash") for r in rows], SCHEMA)


def awkward():
    """Copies, shared heads, missing bases, null and equal turns, empty texts, one id without rows of its own."""
    rng = random.Random(5)
    say = ["hi", "ja", "", "größer 的", "x" * 3000, None]
    rows = []
    for c in [*range(0, 23), 31, 33, 34, 46, 1007, 1008]:
        turns = [(t, rng.choice(["user", "assistant", None]), rng.choice(say[:3])) for t in range(rng.randrange(1, 14))]
        rows += [(c, *t) for t in turns]
    rows += [(60, None, "user", "hi"), (60, None, "user", "hi"), (60, 0, None, None), (60, 0, "z", "größer 的"), (60, -4, "u", "x" * 3000)]
    rows += [(c, t, "user", f"deep {t}") for c in (70, 75, 80) for t in range(40)]      # equal and long
    rows += [(90, t, "user", f"deep {t}") for t in range(33)]
    rows += [(None, 0, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


def test_trie_of_awkward_conversations(spark):
    rows = awkward()
    assert rows_of(T.prefix_trie(table(spark, rows))) == plain(ordered(rows))


@pytest.mark.parametrize("counters", [8, T.MAX_COUNTERS])
def test_spliced_trie_in_blocks_and_with_a_full_sketch(spark, monkeypatch, counters):
    """Running aggregates over several blocks, shuffled look-ups, and a sketch in which hardly any prefix is proven single."""
    monkeypatch.setattr(T, "BLOCK", 7)
    monkeypatch.setattr(T, "HOT", 2)
    rows = awkward()
    digested = T.digest_turns(table(spark, rows))
    share = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    monkeypatch.setattr(T, "power_of_two", lambda n: counters)
    got = T.trie(*T.splice(digested, share, F.col("conv") - F.col("conv") % 5, 8), max_counters=counters)
    assert rows_of(got) == plain(respliced(ordered(rows)))


def test_many_copies_and_one_long_conversation(spark):
    """More ends than a piece joins, and a conversation that holds half of the rows."""
    rows = [(c, t, "user", f"turn {t}") for c in range(2500) for t in range(2)] + [(9999, t, "user", f"turn {t}") for t in range(5000)]
    got = {(r["conv_id"], r["depth"]): r for r in T.prefix_trie(table(spark, rows).repartition(8)).collect()}
    assert len(got) == 5001 and got[9999, 5000]["parent_conv_id"] == 9999 and got[9999, 3]["parent_conv_id"] == 0
    want = hashlib.sha256(",".join(map(str, range(2500))).encode()).hexdigest()
    assert (got[0, 2]["n_convs"], got[0, 2]["ends_sha256"], got[0, 0]["saved_tokens"], got[0, 0]["n_leaves"]) == (2501, want, 2500 * 12, 1)


def test_empty_table_and_turnless_conversations(spark, tmp_path):
    assert T.prefix_trie(table(spark, [])).count() == 0
    # 4 takes turns of 0 only if 0 is there; 3 is turnless where its share covers all it has
    rows = [(c, 0, "user", "only") for c in (2, 3, 4, 7)]
    table(spark, rows).drop("depth", "n").write.parquet(f"{tmp_path}/conversations.parquet")
    got = op12_conversation_trie(spark, str(tmp_path))
    assert rows_of(got) == plain(respliced(ordered(rows)))
