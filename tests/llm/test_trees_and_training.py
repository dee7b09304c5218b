"""The k-d tree against its definition, co-training against a plain version on the same sample, and the last two stages against their targets."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import cotraining, kdtree
from lodestar.llm.hashing import word_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize(("seed", "leaves"), [(1, 8), (2, 5)])
def test_tree_splits_at_weighted_medians_of_the_widest_axis(spark, seed, leaves):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(1 << 30), rng.randrange(1 << 30), rng.randrange(1 << 26), rng.choice([1, 5, 5, 60])) for i in range(200)]
    dealt = kdtree.kd_shards(spark.createDataFrame(rows, "row long, x long, y long, z long, bytes long"), ["x", "y", "z"], "bytes", leaves=leaves, tolerance=0.0).collect()
    shard = {r.row: r.shard for r in dealt}
    assert len(dealt) == 200 and set(shard.values()) == set(range(leaves))
    values, weight = {r[0]: r[1:4] for r in rows}, {r[0]: r[4] for r in rows}
    whole = [(min(v[i] for v in values.values()), max(v[i] for v in values.values())) for i in range(3)]

    def below(ids: list, first: int, many: int, box: list) -> None:
        """The rows of a node, its shards, and its box; an axis' extent counts against the whole table's."""
        if many == 1:
            return
        left = [i for i in ids if shard[i] < first + many // 2]
        right = [i for i in ids if shard[i] >= first + many // 2]
        axes = [a for a in range(3) if max(values[i][a] for i in left) < min(values[i][a] for i in right)]
        widths = [(hi - lo) / (whole[a][1] - whole[a][0]) for a, (lo, hi) in enumerate(box)]
        axis = max(axes, key=lambda a: widths[a], default=None)
        assert axis is not None and widths[axis] >= 0.97 * max(widths), (axes, widths)
        want, edge = sum(weight[i] for i in ids) * (many // 2) / many, max(left, key=lambda i: values[i][axis])
        have = sum(weight[i] for i in left)
        # No other place to cut leaves the share closer to what is asked for.
        nxt = min(right, key=lambda i: values[i][axis])
        assert abs(have - want) <= min(abs(have - weight[edge] - want), abs(have + weight[nxt] - want))
        cut = (values[edge][axis] + values[nxt][axis]) / 2
        for part, start, n, side in ((left, first, many // 2, 0), (right, first + many // 2, many - many // 2, 1)):
            below(part, start, n, [((lo, cut) if not side else (cut, hi)) if a == axis else (lo, hi) for a, (lo, hi) in enumerate(box)])

    below(list(values), 0, leaves, whole)


def test_logistic_fit_is_the_optimum():
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(300, 6)), rng.uniform(0.5, 1, 300)
    y = (x @ np.array([2, -1, 0.5, 0, 0, 1]) + rng.normal(size=300) > 0.3).astype(float)
    got = cotraining.fit_logistic(x, y, w, steps=600)
    x1, penalty, beta = np.c_[x, np.ones(300)], np.r_[np.ones(6), 1e-6], np.zeros(7)
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-x1 @ beta))
        beta -= np.linalg.solve((x1 * (w * p * (1 - p))[:, None]).T @ x1 + np.diag(penalty), x1.T @ (w * (p - y)) + penalty * beta)
    assert np.allclose(got, beta, atol=1e-3)


def test_views_teach_each_other():
    """Each view alone sees half of the documents' classes; what one is sure of the other learns, beyond the labelled ones."""
    rng = np.random.default_rng(5)
    n = 2000
    y = rng.integers(0, 2, n).astype(float)
    views = [np.c_[(y * 2 - 1) * 1.5 + rng.normal(size=n), rng.normal(size=(n, 30))] for _ in range(2)]
    labelled = np.arange(n) < 40
    fold = np.arange(n) % 4 == 0
    rest = ~labelled

    def wrong(rounds: int) -> float:
        head = cotraining.co_train(views, y, fold, labelled, rounds=rounds)
        scores = [v @ m[:-1] + m[-1] for v, m in zip(views, head.views, strict=True)]
        return float(np.mean((head.log_odds(scores)[rest] > 0) != (y[rest] > 0)))

    assert wrong(6) < wrong(0)


def test_training_against_a_plain_version(spark):
    """The sample, the vocabulary, and the scores of all documents, counted plainly with the fitted weights."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = cotraining.train(docs, labels)
    rows = {r.doc_id: r for r in docs.collect()}
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.collect() if r.doc_id in rows and r.quality is not None and r.toxic is not None}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = {d: set(WORD.findall(lower(r.text))) for d, r in rows.items()}
    n, counts = len(known), [Counter(w for d in known for w in words[d])] + [Counter(w for d, ls in known.items() if ls[k] for w in words[d]) for k in (0, 1)]
    chosen = set()
    for k in (0, 1):
        share = sum(ls[k] for ls in known.values()) / n
        far = {w: abs(counts[k + 1][w] - c * share) / (c * max(share * (1 - share), 1e-6) + 1) ** 0.5 for w, c in counts[0].items() if c >= 3}
        chosen |= {w for w, f in far.items() if f >= cotraining.TELLING}
    hashed = {w: int(word_hashes([w.encode()])[0][0]) for w in chosen}
    assert len(chosen) <= cotraining.VOCABULARY // 2 and set(model.vocabulary.tolist()) == set(hashed.values())
    place = {h: i for i, h in enumerate(model.vocabulary.tolist())}
    v = len(place)
    got = {r.doc_id: r for r in cotraining.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    for d, r in rows.items():
        raw = (r.text or "").encode()
        x = np.zeros(v + cotraining.SHAPES)
        x[[place[hashed[w]] for w in words[d] & chosen]] = 1
        x[v:] = (cotraining.shapes([raw])[0][0] - model.mean) / model.scale
        m = cotraining.metadata([r.lang], [r.source], np.array([len(raw)]))[0]
        for head, p in ((model.quality, got[d].quality), (model.toxic, got[d].toxic)):
            odds = head.log_odds([np.array([x @ head.views[0][:-1] + head.views[0][-1]]), np.array([m @ head.views[1][:-1] + head.views[1][-1]])])
            assert abs(1 / (1 + np.exp(-odds[0])) - p) < 1e-4
        assert got[d].kept == (got[d].quality >= 0.5 and got[d].toxic <= 0.5)


def test_shape_features_by_hand():
    text = "Ab ab\n12 %%é ab ab\t"
    got = cotraining.shapes([text.encode(), b""])[0]
    raw = text.encode()
    assert np.isclose(got[0][0], (1 / len(raw)) ** 0.5) and np.isclose(got[0][2], (2 / len(raw)) ** 0.5) and np.isclose(got[0][4], (1 / len(raw)) ** 0.5)
    assert np.isclose(got[0][cotraining.CLASSES + 1], np.log1p(6)) and np.isclose(got[0][cotraining.CLASSES + 3], 2 / 6) and np.isclose(got[0][cotraining.CLASSES + 4], 3 / 6)
    assert got[1][-1] == 1 and got[0][-1] == 0


def targets_of(sizes: dict) -> dict:
    """Words of each source in the mix: weights 1, 2, 3 in turn, none above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(fixed.values()), [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s: 3.0 * sizes[s] for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return fixed | share
        fixed |= over


def test_last_stages_meet_their_targets(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    count = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD.pattern), F.lit(0)))
    sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(count).alias("n")).collect()}
    mixed = stages["mixing"](spark, docs, sf).cache()
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(count).alias("n")).collect()}
    want = targets_of(sizes)
    assert abs(sum(got.values()) / sum(want.values()) - 1) < 0.05
    longest = {r.source: r.n for r in docs.groupBy("source").agg(F.max(count).alias("n")).collect()}
    # Whole documents can't meet a target closer than by a few of them.
    assert all(abs(got.get(s, 0) - w) <= 0.05 * w + 4 * longest[s] for s, w in want.items())
    packed = stages["packing"](spark, mixed, sf).collect()
    used = defaultdict(int)
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and len(used) <= -(-sum(used.values()) // 1024) * 1.02 + 1


def test_rows_by_bitmaps(spark, monkeypatch):
    """The same rows through bitmaps and through a shuffle, over several partitions and none."""
    from lodestar.llm import common

    rows = common.materialize(spark.range(0, 90_000, 1, 5).select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("string").alias("text")))
    wanted = rows.filter(F.pmod(F.xxhash64("text"), F.lit(3)) == 0).select("row")
    some = {r.text for r in rows.join(wanted, "row", "left_semi").collect()}
    assert {r.text for r in common.only_rows(rows, wanted).collect()} == some and common.only_rows(rows, wanted).columns == ["row", "text"]
    assert common.only_rows(rows, wanted.union(wanted)).count() == len(some) and common.only_rows(rows, wanted.limit(0)).count() == 0
    monkeypatch.setattr(common, "MOST_BITMAPS", 0)
    assert {r.text for r in common.only_rows(rows, wanted).collect()} == some
