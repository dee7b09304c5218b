"""SimHash, the name join and the filter audit against brute force, on tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations, permutations

import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import filter_audit, name_join, simhash

DOCS = "doc_id long, text string, source string, key long, root long, part string, mask int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_fingerprint(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(ids, links):
    """Component of each place by union-find over links of places."""
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [least[find(i)] for i in range(len(ids))]


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 7))).strip() or "x"
    texts = [None, "", " \t", "One", "ONE two", "one\ttwo three", "ÀB c d", " ".join(word() for _ in range(70_000)), "a " * 300]
    base = [word() for _ in range(400)]
    for k in range(60):
        changed = list(base)
        for _ in range(k % 9):
            changed[rng.randrange(len(changed))] = word()
        texts.append(" ".join(changed))
    texts += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(i, t, "s", 1, 2, "p", 3) for i, t in enumerate(texts)]
    return [*rows, rows[12], (None, texts[20], "s", 1, 2, "p", 3), (None, "alone with null id", None, None, None, None, None)]


def test_simhash_components(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    prints = [plain_fingerprint(r[1]) for r in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    wanted = Counter(zip([r[0] for r in rows], [f"{p:016x}" for p in prints], smallest([r[0] for r in rows], links), strict=True))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(docs, wide=16).collect())
    assert got == wanted
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        simhash.simhash_components(docs, apart=4)


def test_links_of_dense_families(spark):
    """Families around a few centres, so that lists of all three widths are long."""
    rng = random.Random(1)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(250):
            bits = rng.sample(range(rng.choice([12, 64])), rng.randint(0, 6))
            found.add(centre ^ sum(1 << b for b in bits))
    found |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(map(signed, found))
    links = [(a, b) for a, b in combinations(range(len(fps)), 2) if ((fps[a] ^ fps[b]) & ((1 << 64) - 1)).bit_count() <= 3]
    wanted = dict(zip(fps, smallest(fps, links), strict=True))
    roots = dict(map(tuple, simhash.linked(spark.createDataFrame([(f, 1) for f in fps], "fp long, docs long"), wide=8).collect()))
    assert {f: roots.get(f, f) for f in fps} == wanted


def full_distance(a, b):
    """Unrestricted Damerau-Levenshtein distance (substrings may be edited again)."""
    last, far = {}, len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            cost = a[i - 1] != b[j - 1]
            if not cost:
                match = j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + i - k - 1 + 1 + j - m - 1)
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_every_edit_of_a_name_meets_it():
    rng = random.Random(5)
    names = ["a", "ab", "aab", "aaaa", "éö"] + ["".join(rng.choice("abé😀") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    for v in names:
        near = {v}
        for i in range(len(v) + 1):
            near |= {v[:i] + c + v[i:] for c in "ab😀"} | {v[:i] + c + v[i + 1 :] for c in "ab😀"} | {v[:i] + v[i + 1 :]} | {v[:i] + v[i : i + 2][::-1] + v[i + 2 :]}
        for c in near - {""}:
            assert name_join.left_keys(v) & name_join.right_keys(c), (v, c)


def test_name_join(spark):
    rng = random.Random(9)
    spell = lambda: "".join(rng.choice("aAbé 😀\t") for _ in range(rng.randint(0, 7)))
    vendors = [(i, rng.choice([None, spell(), spell(), spell()]), "x") for i in range(80)] + [(500, "", "x"), (501, " \n", "x"), (None, "ab", "x"), (3, "ab", "x")]
    clients = [(i, rng.choice([None, spell(), spell(), spell(), "hot name"]), "x") for i in range(400)] + [(None, "ab", "x"), (7, "a b", "x"), (7, "a b", "x")]
    vendors.append(vendors[5])
    form = lambda t: re.sub(r"[\x20\x09-\x0D]", "", lower(t or ""))
    wanted = defaultdict(lambda: [0, None, 0])
    for v, name in {(v, form(n)) for v, n, _ in vendors}:
        for c, other in ((c, form(n)) for c, n, _ in clients):
            if name and other and (d := full_distance(name, other)) <= 1:
                w = wanted[v, d]
                w[0] += 1
                if c is not None:
                    w[1], w[2] = c if w[1] is None else min(w[1], c), w[2] + zlib.crc32(str(c).encode())
    schema = "vendor_id long, name string, key string"
    v, c = spark.createDataFrame(vendors, schema), spark.createDataFrame(clients, schema.replace("vendor", "client"))
    got = {(r[0], r[1]): [*r[2:]] for r in name_join.joined_names(v, c).collect()}
    assert got == dict(wanted) and len(got) > 40
    assert name_join.joined_names(v.limit(0), c).count() == 0 and name_join.joined_names(v, c.limit(0)).count() == 0


def test_misspelling(spark):
    names = [(i, n) for i, n in enumerate([None, "", "a", "ab", "abc", "é😀x y", "Name With Blanks"] * 9)]
    got = spark.createDataFrame(names, "id long, name string").select("id", "name", name_join.misspelt(F.col("id"), F.col("name")).alias("w")).collect()
    for i, n, w in got:
        h = zlib.crc32(str(i).encode())
        if n and len(n) > 1 and h % 2 == 0:
            at = h % (len(n) - 1)
            n = n[:at] + n[at + 1] + n[at] + n[at + 2 :]
        assert w == n


def test_distances_by_spark(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abé") for _ in range(rng.randint(1, 6))), "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))) for _ in range(1500)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", name_join.distance_to_one(F.col("a"), F.col("b"))).collect()
    for a, b, d in got:
        true = full_distance(a, b)
        assert d == (true if true <= 1 else None), (a, b)


def audit_by_hand(docs, labels):
    texts = defaultdict(list)
    for d, t, *_ in docs:
        texts[t or ""].append(d)
    rows = []
    for d, t, source, *_ in docs:
        t = t or ""
        words = WORD.findall(t)
        others = [x for x in texts[t] if x is not None]
        fails = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), bool(others) and (d is None or min(others) < d))
        good, toxic = (any(x == d and d is not None and v[k] == 1 for x, *v in labels) for k in (0, 1))
        rows.append((source or "", {f for f, bad in zip("ABCDE", fails, strict=True) if bad}, good, toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        values = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                values[f] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), sum(f in r[1] for r in mine) - len(here), sum(r[1] == {f} for r in mine), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(values[order[step - 1]])
    return out


def test_filter_audit(spark):
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(["alpha", "beta", "Gamma", "delta%", "épée", *map(str, range(60))]) for _ in range(n))
    texts = [None, "", " ", "ABC", some(50), some(49), some(4000), "plain " * 80, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)) + " #"]
    docs = [(i, rng.choice([*texts, some(rng.randint(20, 90))]), rng.choice(["a", "a", "a", "b", "", None]), 1, 2, "p", 3) for i in range(150)]
    docs += [docs[7], docs[7], (None, texts[4], "a", 1, 2, "p", 3), (None, None, None, None, None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (9999, 1, 1)]
    d, m = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.corpus_audit(d, m).collect()}
    wanted = audit_by_hand(docs, labels)
    assert got == wanted and len(got) == 3 * 600
    assert filter_audit.corpus_audit(d.limit(0), m).count() == 0
    bare = {k: v[:4] for k, v in wanted.items()}
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails] for r in filter_audit.corpus_audit(d, m.limit(0)).collect()} == bare


def test_shapley_weights_are_the_integrals():
    for n in (1, 3, 5):
        for i in range(n):
            weights = filter_audit.shapley_weights(i, n)
            # A single document that fails the set m shares one removal equally among the filters of m.
            for m in range(1 << n):
                value = sum(w * (-1) ** (t.bit_count() + 1) for t, w in enumerate(weights) if t and t & m == t)
                assert value == (Fraction(1, m.bit_count()) * weights[1 << i] if m >> i & 1 else 0)
