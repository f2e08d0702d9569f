"""SuperMinHash, repair of conversations and the prefix trie against plain Python, and their odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from contextlib import contextmanager

import numpy as np
import pytest

from strandline.llm import dialogue, minhash, prefixes
from tests.llm.test_operators import none, odd_docs, prose

TURNS = "conv_id long, turn long, role string, text string, n_chars long, k1 string, block int"


@contextmanager
def settings(spark, **values):
    """Session settings for the time of a test; dots are written as two underscores."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


# 11: SuperMinHash


def plain_sets(docs):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = set() if not w else {" ".join(w)} if len(w) < 4 else {" ".join(w[k : k + 4]) for k in range(len(w) - 3)}
    return out


def plain_components(sets):
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {i: root(i) for i in sets}


def copies(rng, groups, each, words):
    """Texts with copies that differ in few words, and chains of copies of copies."""
    docs = []
    for _ in range(groups):
        base = prose(rng, rng.randint(words // 2, words)).split()
        for _ in range(each):
            new = list(base)
            for _ in range(rng.randint(0, 3)):
                new[rng.randrange(len(new))] = f"x{rng.randint(0, 99)}"
            docs.append((len(docs), " ".join(new)))
            if rng.random() < 0.5:
                base = new
    return docs


@pytest.mark.parametrize("group_rows,group_elements", [(1024, 1 << 18), (6, 200)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, group_rows, group_elements):
    if group_rows < 10:  # links are joined by rounds, too
        monkeypatch.setattr(minhash.components, "__defaults__", (5,))
    docs = copies(random.Random(4), 12, 12, 70)
    sets = plain_sets(docs)
    want = plain_components(sets)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), group_rows=group_rows, group_elements=group_elements).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and 12 < len(set(want.values())) < 100


def test_super_minhash_by_its_definition():
    """Each element deals out its ranks by swaps, one after the other; a slot keeps the least rank plus number."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 2, 9, 300, 2000)] + [np.zeros(0, np.uint64)]
    mask = (1 << 64) - 1
    for s, got in zip(sets, minhash.signatures(sets)):
        values = [float("inf")] * minhash.SLOTS
        for e in s.tolist():
            deal = list(range(minhash.SLOTS))
            for rank in range(minhash.SLOTS):
                x = int(minhash._mixed(np.array([(e + (rank + 1) * 0x9E3779B97F4A7C15) & mask], np.uint64))[0])
                pick = rank + (((x & 0xFFFFF) * (minhash.SLOTS - rank)) >> 20)
                deal[rank], deal[pick] = deal[pick], deal[rank]
                values[deal[rank]] = min(values[deal[rank]], rank + (x >> 20) * 2.0**-44)
        if len(s):
            assert (minhash._mixed(np.array(values).view(np.uint64)) >> np.uint64(48)).astype(np.uint16).tolist() == got.tolist()
        else:
            assert not got.any()


def test_estimates_follow_similarity():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.8, 0.95):
        a = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
        common = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:common], rng.integers(0, 1 << 63, len(a) - common).astype(np.uint64)]))
        sig = minhash.signatures([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.15


def test_minhash_odd_rows(spark):
    got = minhash.near_duplicates(odd_docs(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    # The copy without an id takes its component's; texts without words are alone, each by itself.
    assert len(got) == 9 and by[1] == [(2, 1, True)] * 2 and by[7] == [(2, 1, False)] and by[None] == [(2, 1, False)]
    assert by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)] and by[5] == [(0, 5, True)] and by[4][0][0] > 60_000 and by[6] == [(1, 6, True)]
    assert minhash.near_duplicates(none(spark)).count() == 0
    left = minhash.one_of_each(odd_docs(spark))
    assert left.columns == odd_docs(spark).columns and sorted((r["doc_id"] for r in left.collect()), key=str) == [1, 1, 2, 3, 4, 5, 6, None]


# 12: repair


def plain_repair(rows):
    """Faults, and the cheapest edits by a search over (cost, letters)."""
    space = lambda v: " " if v is None else str(v)
    found = {}
    for conv, turn, role, text in rows:
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found.setdefault(conv, [])
        found[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, turns in found.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        faults, seen = [], set()
        for _, role, text in turns:
            said = re.sub(r"[\x20\x09-\x0D]+", "", text)
            faults.append("b" if not said else "d" if (role, text) in seen else "" if said[-1] in ".!?" else "t")
            seen.add((role, text))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        heap, done = [(0, "", 0, 0, ())], set()
        while True:
            cost, audit, i, state, made = heapq.heappop(heap)
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == len(turns) and state in (0, 3):
                break
            to, name = (3, "assistant") if state == 2 else (2, "user")
            heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*made, f"{name}:")))
            if i < len(turns):
                _, role, text = turns[i]
                heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, made))
                if faults[i] not in ("b", "d"):
                    more = faults[i] == "t"
                    heapq.heappush(heap, (cost + more + 2, audit + "R", i + 1, to, (*made, f"{name}:{text}")))
                    if role[:1] == name[0]:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*made, f"{role}:{text}")))
                    elif role[:1] == "s" and state == 0:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, 1, (*made, f"{role}:{text}")))
        h = hashlib.sha256("\n".join(made).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, h)
    return out


def talks(rng, n, most):
    rows = []
    for c in range(n):
        turn = 0
        for k in range(rng.randint(1, most)):
            turn += rng.choice([0, 1, 1, 1, 1, 2])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "user", "tool", None, ""]) if rng.random() < 0.3 else ("user", "assistant")[k % 2]
            text = rng.choice(["Go on.", "Why?", "no end", "", " \t", None, "é!", f"say {k}.", f"say {k} \n", "a "])
            rows.append((c if rng.random() < 0.97 else None, turn if rng.random() < 0.95 else None, role, text, 1, "x", 7))
    return rows


def repaired(spark, rows):
    got = dialogue.repair(spark.createDataFrame(rows, TURNS)).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_repair_equals_brute_force(spark):
    rows = talks(random.Random(7), 150, 14)
    assert repaired(spark, rows) == plain_repair([r[:4] for r in rows])


def test_repair_of_conversations_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "PIECE", 50)
    rng = random.Random(9)
    rows = talks(rng, 5, 400) + [(99, k // 3, "user", f"n{k % 40}.", 1, "x", 7) for k in range(900)]
    with settings(spark, spark__sql__adaptive__coalescePartitions__enabled="false", spark__sql__shuffle__partitions="9"):
        frame = spark.createDataFrame(rows, TURNS)
        assert len(dialogue._plans(dialogue._dealt(dialogue.damaged(frame), 4).withColumn("letter", dialogue.F.substring("role", 1, 1)))) > 8
        got = repaired(spark, rows)
    assert got == plain_repair([r[:4] for r in rows])


def test_repair_odd_rows(spark):
    assert dialogue.repair(spark.createDataFrame([], TURNS)).count() == 0
    # A conversation whose turns are all dropped has zeros.
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "x.", 1, "", 0)]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    long = [(5, 0, "user", "a" * 1_000_000 + " " * 200_000, 1, "", 0), (5, 1, "assistant", "yes.", 1, "", 0)] * 2
    assert repaired(spark, long) == plain_repair([r[:4] for r in long])


# 13: prefix trie


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + ts[h:])
    nodes = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        parents = {q[:-1] for q in nodes if q}
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = sorted(c for c in members if whole[c] == p)
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(q[:-1] == p for q in nodes if q), sum(q not in parents for q in below), saved, digest))
    return sorted(out, key=str)


def branches(rng, n, deep):
    """Conversations that go on alike for a while, with repeated and missing turns."""
    rows = []
    for c in rng.sample(range(400), n):
        for k in range(rng.randint(1, deep)):
            same = rng.random() < 0.9
            rows.append((c, k if rng.random() < 0.98 else None, rng.choice(["user", None]) if not same else "user", rng.choice(["a", "bé", None, ""]) if not same else f"t{k}", 1, "x", 7))
    return rows + [(None, 1, "user", "lost", 1, "", 0)] + rows[:3]


@pytest.mark.parametrize("reach", [32, 2, 4])
def test_trie_equals_brute_force(spark, reach):
    rows = branches(random.Random(reach), 60, 12)
    got = prefixes.trie(spark.createDataFrame(rows, TURNS), reach=reach).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie([r[:4] for r in rows])


def test_trie_of_a_comb(spark, monkeypatch):
    """At each turn of a long conversation another one parts: as many levels of branching as turns."""
    monkeypatch.setattr(prefixes, "PIECE", 3)
    rows = [(0, k, "user", f"t{k}", 1, "", 0) for k in range(40)]
    for c in range(1, 40):
        rows += [(100 * c, k, "user", f"t{k}", 1, "", 0) for k in range(c)] + [(100 * c, c, "user", "other", 1, "", 0)]
    rows += [(100 * c, 0, "user", "t0", 1, "", 0) for c in range(40, 60)]
    want = plain_trie([r[:4] for r in rows])
    got = prefixes.trie(spark.createDataFrame(rows, TURNS), reach=8).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_trie_odd_rows(spark):
    assert prefixes.trie(spark.createDataFrame([], TURNS)).count() == 0
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 == 5)
    # The first conversation of its hundred isn't there, and all of its own turns go: a member of the root alone.
    rows = [(c, 0, None, None, 1, "", 0), (c, 1, "user", "x" * 100_000, 1, "", 0)]
    got = prefixes.trie(spark.createDataFrame(rows, TURNS)).collect()
    assert [tuple(r) for r in got] == plain_trie([r[:4] for r in rows]) and got[0]["n_leaves"] == 1
