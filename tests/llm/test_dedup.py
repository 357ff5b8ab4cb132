import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sediment.llm import neardup
from sediment.llm.common import cut
from sediment.llm.components import connected_components
from sediment.llm.exactdedup import MOST, boundaries, exact_groups
from sediment.llm.fingerprint import WIDE, added, edited_fingerprints, fingerprints, lanes
from sediment.llm.neardup import near_duplicates, shingle_set
from sediment.llm.sharding import shard_documents, write_shards

from tests.llm.conftest import ROWS

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=str)


def near(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB \t\n.é漢\x85"), max_size=60))
def test_shingle_counts(text):
    assert len(shingle_set(text)) == len(shingles(text))


def test_near_duplicates_on_odd_rows(odd, nothing):
    assert near(near_duplicates(odd)) == near_brute(ROWS)
    assert near_duplicates(nothing).count() == 0


def test_near_duplicates_in_chains_and_crowds(spark):
    """Chains of neighbours, crowds of near copies, and one large bucket of texts that are alike but not linked."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, base = [], [word() for _ in range(120)]
    for i in range(60):
        rows.append((i, " ".join(base)))
        base = base[4:] + [word() for _ in range(4)]
    common = [word() for _ in range(150)]
    for i in range(60, 150):  # about 0.7 alike: candidates, no links
        rows.append((i, " ".join(common + [word() for _ in range(28)])))
    crowd = [word() for _ in range(100)]
    for i in range(150, 260):
        own = list(crowd)
        own[rng.randrange(100)] = word()
        rows.append((i, " ".join(own)))
    rng.shuffle(rows)
    got = near(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == near_brute(rows)


def mutated(rng, n, size, most, first=0):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, rows = [word() for _ in range(size)], []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(most)):
            own[rng.randrange(size)] = word()
        rows.append((first + i, " ".join(own)))
    return rows


def test_near_duplicates_where_buckets_stay_open(spark, monkeypatch):
    """Copies of one text with few to many changes: members just under and just over the bound share large buckets, which
    are dealt into parts."""
    rows = mutated(random.Random(7), 160, 90, 9) + mutated(random.Random(8), 60, 40, 5, 1000)
    monkeypatch.setattr(neardup, "SALT", 7)
    calls, real = [], neardup._likely_in_buckets
    monkeypatch.setattr(neardup, "_likely_in_buckets", lambda *a: calls.append(1) or real(*a))
    assert near(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == near_brute(rows)
    assert calls


def test_no_task_of_near_duplicates_has_two_python_steps(spark, monkeypatch):
    plans, real, maps = [], neardup._likely_in_buckets, type(spark.range(1)).mapInArrow

    def mapped(self, *a, **b):
        plans.append(self._jdf.queryExecution().analyzed().toString())
        return maps(self, *a, **b)

    calls = []
    monkeypatch.setattr(neardup, "_likely_in_buckets", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", mapped)
    near_duplicates(spark.createDataFrame(mutated(random.Random(7), 160, 90, 9), "doc_id long, text string"))
    assert calls and len(plans) > 3 and not any("MapInArrow" in p for p in plans)


def test_open_buckets_yield_each_likely_pair_once(spark, monkeypatch):
    rows = mutated(random.Random(10), 80, 100, 9)
    sets = {i: shingle_set(t) for i, t in rows}
    alike = {(i, k): len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for i, x in sets.items() for k, y in sets.items() if i < k}
    features = spark.createDataFrame([(i, len(x), [100 + i % 2, 200]) for i, x in sets.items()], "id long, n_shingles long, bands array<long>")
    frame = spark.createDataFrame([(i, x.tobytes()) for i, x in sets.items()], "id long, shingles binary")
    members = [(100 + i % 2, 0, i, i // 2, 40) for i in sets] + [(200, 1, i, i // 2, 80) for i in sets]
    monkeypatch.setattr(neardup, "SALT", 9)
    found = neardup._likely_in_buckets(spark.createDataFrame(members, "bucket long, band int, id long, component long, size long"), features, frame, cut)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert {p for p, s in alike.items() if s >= 0.75 and p[0] // 2 != p[1] // 2} <= set(got) <= {p for p, s in alike.items() if s > 0.5}


def test_near_duplicates_of_repeated_ids(spark):
    """Rows that share an id are one document with the links of all of them."""
    a, b, c = ("one two three four five six seven", "red green blue white black grey pink", "x y z u v w")
    rows = [(3, a), (7, a), (7, b), (9, b), (9, b), (11, c), (11, c), (12, None)]
    got = sorted({(r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()})
    assert got == [(3, 3), (7, 3), (9, 3), (11, 11), (12, 12)]


def test_recall_of_links_at_the_bound():
    """Pairs with a similarity of 0.75 or a little more share a bucket and pass both signatures."""
    rng, lost, n = random.Random(9), 0, 400
    for _ in range(n):
        union = [rng.getrandbits(64) for _ in range(rng.randrange(40, 200))]
        both = -(-3 * len(union) // 4)
        cutat = both + rng.randrange(len(union) - both + 1)
        x, y = (np.unique(np.array(u, np.uint64)) for u in (union[:cutat], union[:both] + union[cutat:]))
        m, k = neardup.minima(x), neardup.minima(y)
        bits = np.bitwise_count(neardup.bit_signature(x).view(np.uint64) ^ neardup.bit_signature(y).view(np.uint64)).sum()
        alike = (((m >> 24) ^ m) & 255 == ((k >> 24) ^ k) & 255).mean()
        lost += not ((neardup.band_keys(m) == neardup.band_keys(k)).any() and alike >= neardup.SURE and neardup.BITS - bits >= neardup.EQUAL_BITS)
    assert lost == 0


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400, i) for i in range(401, 450)] + [(i, i + 1) for i in range(500, 560)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def exact_brute(rows):
    norm = [(d, SPACE.sub(" ", t or "")) for d, t in rows]
    out = []
    for d, t in norm:
        ids = [x for x, y in norm if y == t]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [16, 1])
def test_exact_groups(odd, nothing, width):
    got = sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in exact_groups(odd, hash_bytes=width).collect()), key=str)
    assert got == exact_brute(ROWS)
    assert exact_groups(nothing).count() == 0


def test_chunks_of_one_hash_are_told_apart(spark):
    """Hashes of one byte clash all the time; only the bytes of the chunks decide then."""
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice("abc d") for _ in range(rng.choice((50, 3000, 20000))))) for i in range(60)]
    rows += [(i + 100, t) for i, t in rows[::3]]
    got = sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), hash_bytes=1).collect()), key=str)
    assert got == exact_brute(rows)


def test_boundaries_follow_content():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    ends = boundaries(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    assert max(b - a for a, b in zip([0, *ends], ends)) <= MOST
    later = {e + 7 for e in ends}
    moved = set(boundaries(b"prefix!" + data))
    assert len(later & moved) > 0.9 * len(ends)
    assert boundaries(b"") == [] and boundaries(b"a" * 300_000)[-1] == 300_000


def test_shards(odd, nothing, spark, sf, tmp_path):
    rows = shard_documents(odd, 3).collect()
    assert len(rows) == len(ROWS)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in shard_documents(docs, 24).collect())
    total, before = sum(r[1] for r in rows), 0
    for k, (_, size, shard, _) in enumerate(rows):
        assert shard == min(23, (2 * before + size) * 24 // (2 * total))
        before += size
    for s in range(24):
        assert [r[3] for r in rows if r[2] == s] == list(range(sum(r[2] == s for r in rows)))
    assert shard_documents(nothing).count() == 0
    write_shards(docs, f"file://{tmp_path}/s", 4)
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == docs.count()
    with pytest.raises(ValueError):
        write_shards(odd, f"file://{tmp_path}/o", 3)
    placed = write_shards(odd, f"file://{tmp_path}/o", 3, shard_col="part").groupBy("shard").count().collect()
    back = spark.read.parquet(f"file://{tmp_path}/o")
    assert sorted(map(str, back.select("doc_id", "text", "shard").collect())) == sorted(map(str, odd.select("doc_id", "text", "shard").collect()))
    assert {(r["part"], r["count"]) for r in back.groupBy("part").count().collect()} == {(r["shard"], r["count"]) for r in placed}


def test_fingerprints_are_multiset_hashes(spark, odd, nothing):
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints(odd).collect()}
    assert got[8] == got[9] and got[3] == got[4] and got[1] != got[2] and len(set(got.values())) >= 8
    pair = spark.createDataFrame([("a\nb\nb\nc", "b\nc", "a\nb")], "x string, y string, z string")
    x, y, z = (lanes(F.col(c)) for c in "xyz")
    same = pair.select((added(y, z) == x).alias("inserted"), (added(x, y, -1) == z).alias("deleted"), F.size(x).alias("n")).first()
    assert same["inserted"] and same["deleted"] and same["n"] > WIDE
    assert edited_fingerprints(nothing).count() == 0


def test_edited_texts(odd):
    import xxhash

    def hashed(text):
        digests = [hashlib.sha256(p.encode()).hexdigest().encode() for p in text.split("\n")]
        one = lambda d, i: int.from_bytes(xxhash.xxh64_digest((i & 0xFFFFFFFF).to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(d, seed=42)), "big")
        return digests, one

    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t in order]
    got = sorted(edited_fingerprints(odd).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    for (d, _), t, n, r in zip(order, texts, texts[1:] + texts[:1], got, strict=True):
        k = len(t) // 4
        assert r["doc_id"] == d and r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if not k:
            assert r["fingerprint"] == r["edited_fingerprint"] and r["near_edited"] == 1


def test_fingerprints_measure_texts_without_line_breaks(spark):
    """Three quarters of an edited text are unchanged, and nothing of the next text is in it."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    han = lambda: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(600))
    rows = [(i, " ".join(word() for _ in range(200)) if i < 20 else han()) for i in range(24)]
    got = edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = [r for r in got if r["doc_id"] != 19]  # gets a quarter of its characters in Han ones, which are more pieces
    assert len(got) == 23 and all(0.5 < r["near_edited"] < 0.95 and r["near_next"] < 0.25 for r in got)
    assert abs(sum(r["near_edited"] for r in got) / 23 - 0.75) < 0.06
    x, y = ("one two three four", "one two three five")
    a, b, c, d = spark.range(1).select(lanes(F.lit(f"{x}\n{y}")), added(lanes(F.lit(x)), lanes(F.lit(y))), lanes(F.lit(x)), added(lanes(F.lit(f"{x}\n{y}")), lanes(F.lit(y)), -1)).first()
    assert a == b and c == d and sum(v if v < 2**15 else v - 2**16 for v in c[WIDE:]) % 2 == 0 and any(c[WIDE:])


def test_links_are_confirmed_where_texts_meet(spark):
    """Texts go through the join, not hashes of shingles, which don't compress; the sets decide."""
    from sediment.llm.common import Scratch
    from sediment.llm.neardup import _links

    words = [f"w{k}" for k in range(40)]
    texts = [(1, " ".join(words)), (2, " ".join(words[:37])), (3, " ".join(words[:20])), (4, " ".join(words).upper())]
    likely = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (1, 4), (2, 4)], "a long, b long")
    with Scratch(spark) as scratch:
        found = _links(likely, spark.createDataFrame(texts, "id long, text string"), 75, scratch.cut)
        assert sorted(map(tuple, found.collect())) == [(1, 2), (1, 4), (2, 4)]
