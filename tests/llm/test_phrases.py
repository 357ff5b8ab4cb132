"""Collocations, spelling forms and SimHash groups against plain steps, and on odd rows."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash
from sediment.llm import collocations, queries, simhash, spelling
from sediment.llm.automaton import Automaton

from tests.llm.conftest import ROWS

ENDS = re.compile(r"[.,;:!?\x0A-\x0D]")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Collocations ---------------------------------------------------------------------------------------------------------


def phrases_brute(rows, top, seen):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in ENDS.split(lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + m])) for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
    f = {k: c for k, c in f.items() if c >= seen}
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            if not any(g == lang and len(q) > len(p) and 100 * c >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), c in f.items()):
                out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize(("ranked", "part"), [(1000, 10_000), (3, 10_000), (1000, 5), (0, 3)])
def test_collocations_are_those_of_plain_counts(spark, ranked, part):
    """All words ranked or few, pivots whole or in parts: the same phrases."""
    rng = random.Random(ranked + part)
    words = [*"abcdefg", "É", "ÉÀ", "x-y", "\x1c"]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choices(words, [9, 7, 5, 3, 2, 2, 1, 1, 1, 1, 1])[0] + rng.choice([" ", " ", " ", "\t ", ". ", "\n"]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", "A a A a a"), ("en", None), (None, "")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = collocations.collocations(docs, 40, 6, ranked, part)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == phrases_brute(rows, 40, 6)


def test_collocations_of_odd_rows(odd, nothing):
    assert collocations.collocations(nothing).collect() == []
    found = sorted(map(tuple, collocations.collocations(odd, 5, 30).collect()))
    assert found == phrases_brute([(r["lang"], r["text"]) for r in odd.collect()], 5, 30) and found


def test_collocations_of_a_long_text_in_small_steps(spark, monkeypatch):
    rng = random.Random(5)
    text = " ".join(rng.choices("abcde", k=4000))
    docs = spark.createDataFrame([("en", text), ("en", "a b c d " * 200)], "lang string, text string")
    want = phrases_brute([tuple(r) for r in docs.collect()], 50, 30)
    for name, value in (("CHARS", 100), ("TOKENS", 50), ("KEPT", 20), ("MINED", 30)):
        monkeypatch.setattr(collocations, name, value)
    batch = [r for r in docs.collect()]
    windows = [(w[a - 3 if a else 0 : b + 3], a, b) for w, a, b in collocations._windows([r["text"].encode() for r in batch])]
    assert sum(b - a for _, a, b in windows) == sum(len(t) for r in batch for t in collocations._tokens(r["text"].encode())) + 2
    assert sorted(map(tuple, collocations.collocations(docs, 50, 30).collect())) == want


def test_collocations_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    found = queries.op11_collocations(spark, "/root/testdata/sf0.001")
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.SQL['op11_collocations']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and want


# Spelling -------------------------------------------------------------------------------------------------------------


def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(p != q for p, q in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def forms_brute(rows, noise):
    n = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'null' if id_ is None else id_}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % noise == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    others = {w: [y for y in n if near(w, y)] for w in n}
    best = {w: min(o, key=lambda y: (-n[y], y)) for w, o in others.items() if o}
    form = {w: y for w, y in best.items() if n[y] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), c, len(others[w]), n.get(form.get(w))) for w, c in n.items()}


def test_automaton_numbers_and_errors():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("aabcé") for _ in range(rng.randint(1, 7))) for _ in range(500)} | {"a" * 60, "a" * 61})
    found = Automaton(words)
    assert list(found) == words and found.words == len(words)
    assert len(found.next) < len({w[:k] for w in words for k in range(len(w) + 1)})  # fewer states than a trie
    for w in [*words, "zz", "", "aaé"]:
        half = len(w) // 2
        assert {words[k] for k in found.one_error(w[:half], w[half:])} == {y for y in words if y[:half] == w[:half] and near(w[half:], y[half:])}


@pytest.mark.parametrize("held", [50_000, 7, 1])
def test_spelling_is_that_of_plain_comparison(spark, held):
    """Halves whole or dealt into parts: the same neighbours."""
    rng = random.Random(9)
    base = ["".join(rng.choice("abÉÿ") for _ in range(rng.randint(6, 11))) for _ in range(12)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(40):
            w = list(base[min(rng.randrange(12), rng.randrange(12))])
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "É", "b"])
            words.append("".join(w).replace("a", rng.choice("aA")))
        rows.append((None if i == 5 else i % 50, rng.choice([" ", "-", "1"]).join(words)))
    rows.append((61, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = spelling.spelling_forms(docs, 31, held)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in found.collect()} == forms_brute(rows, 31)


def test_spelling_of_odd_rows(odd, nothing, spark):
    assert spelling.spelling_forms(nothing).collect() == []
    assert {tuple(r) for r in spelling.spelling_forms(odd).collect()} == forms_brute(ROWS, 31)
    # forms of forms lead to the root
    text = " ".join(["mountain"] * 1000 + ["mountaih"] * 100 + ["mountehh"] + ["mountaxh"] * 10 + ["mountxxh"] * 0)
    found = {r["word"]: (r["form"], r["root"]) for r in spelling.spelling_forms(spark.createDataFrame([(1, text)], "doc_id long, text string"), 1 << 33).collect()}
    assert found == {"mountain": (None, "mountain"), "mountaih": ("mountain", "mountain"), "mountaxh": ("mountaih", "mountain")}


# SimHash --------------------------------------------------------------------------------------------------------------


def simhash_brute(rows):
    prints = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", lower(text))
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return prints, grouped([r[0] for r in rows], prints)


def grouped(ids, prints):
    """The smallest id that links of two bits or fewer, or a shared id, reach (null ids link nothing)."""
    at = {i: i for i in ids if i is not None}

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    known = [(i, p) for i, p in zip(ids, prints, strict=True) if i is not None]
    for k, (i, p) in enumerate(known):
        for j, q in known[:k]:
            if (p ^ q).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                at[b] = a
    return [None if i is None else top(i) for i in ids]


def test_simhash_of_odd_rows(odd, nothing):
    assert simhash.simhash_groups(nothing).collect() == []
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    prints, groups = simhash_brute(rows)
    got = sorted(str(tuple(r)) for r in simhash.simhash_groups(odd).collect())
    assert got == sorted(str((i, f"{p:016x}", g)) for (i, _), p, g in zip(rows, prints, groups, strict=True))


def test_simhash_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints, groups = simhash_brute(rows)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    assert found == {i: (f"{p:016x}", g) for (i, _), p, g in zip(rows, prints, groups, strict=True)}


def test_pigeonring_chains_lose_no_link(spark, monkeypatch):
    """Fingerprints in clusters, with flips at the ends of segments, against all pairs."""
    rng = random.Random(4)
    prints = [0, 2**64 - 1]
    for _ in range(25):
        centre = rng.getrandbits(64)
        prints += [centre ^ sum(1 << b for b in set(rng.sample([0, 21, 22, 42, 43, 63, *range(64)], rng.randint(0, 4)))) for _ in range(12)]
    ids = [rng.randrange(10_000) for _ in prints]
    ids[3] = ids[40]  # one document with two texts
    texts = spark.createDataFrame([(i, str(p)) for i, p in zip(ids, prints, strict=True)], "doc_id long, text string")
    monkeypatch.setattr(simhash, "_fingerprints", lambda batches: (_as_print(b) for b in batches))
    found = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(texts).collect())
    assert found == sorted((i, f"{p:016x}", g) for i, p, g in zip(ids, prints, grouped(ids, prints), strict=True))


def _as_print(batch):
    import numpy as np
    import pyarrow as pa

    found = np.array([int(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])
