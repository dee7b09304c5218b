"""Each stage of the pipeline against brute force on what its predecessor kept, on the smallest tables."""

from collections import Counter, defaultdict

import corpus_pipeline
from lodestar.llm.common import materialize
from lodestar.llm.tokens import TokenEncoder, public_path

SF = "/root/testdata/sf0.001"
WHITE = str.maketrans("\t\n\x0b\x0c\r", " " * 5)


def words(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(WHITE).split(" ") if w]


def longest_of_equals(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(WHITE).replace(" ", "")].append((-len(r.text or ""), r.doc_id))
    return {min(g)[1] for g in groups.values()}


def least_of_linked(rows, percent):
    sets, root, by = {}, {}, defaultdict(list)
    for r in rows:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        root[r.doc_id] = r.doc_id
        for s in sets[r.doc_id]:
            by[s].append(r.doc_id)
    shared = Counter((a, b) for ids in by.values() for i, a in enumerate(ids) for b in ids[:i])

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, after = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = docs.collect()
        docs = materialize(stage(spark, docs, SF))
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = lambda rows: {r.doc_id for r in rows}
    assert ids(after["quality classifier"]) < ids(before["quality classifier"])
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i in ids(before["quality classifier"]) if i in labels and labels[i].quality and not labels[i].toxic]
    assert sum(i in ids(after["quality classifier"]) for i in clean) > 0.95 * len(clean)
    assert ids(after["exact dedup"]) == longest_of_equals(before["exact dedup"]) and len(after["exact dedup"]) == len(ids(after["exact dedup"]))
    assert ids(after["near dedup"]) == least_of_linked(before["near dedup"], 80) and len(after["near dedup"]) == len(ids(after["near dedup"]))
    texts = {r.doc_id: r.text for r in before["mixing"]}
    assert all(r.text == texts[r.doc_id] for r in after["mixing"]) and max(Counter(r.doc_id for r in after["mixing"]).values()) <= 3
    encoder = TokenEncoder(public_path("byte_bpe_50k.json"))
    assert sum(r.length for r in after["packing"]) == sum(len(encoder.encode_text(r.text or "")) // 4 + 1 for r in before["packing"])
    placed = defaultdict(list)
    for r in after["packing"]:
        placed[r.sequence_id].append((r.offset, r.length))
    for pieces in placed.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, doc int, size int, g string, e string, node int, taken int"


def test_stages_on_odd_tables(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names, an empty table."""
    rest = ("en", "s", 1, "r", 1, 2, "g", "e", 3, 4)
    long_ = " ".join(f"word{i % 5000} x{i}" for i in range(40_000))
    rows = [(1, "a b c d e f g", *rest), (1, "a b c d e f g", *rest), (2, "a b c  d e f g", *rest), (3, None, *rest), (4, "", *rest), (None, "p q r s t u", *rest), (5, long_, *rest), (6, long_ + " y", *rest), (7, "z", None, None, None, *([None] * 7)), (None,) * 12]
    odd, empty = spark.createDataFrame(rows, ODD), spark.createDataFrame([], ODD)
    stages = dict(corpus_pipeline.STAGES)
    kept = {name: stages[name](spark, odd, SF).collect() for name in ("quality classifier", "exact dedup", "near dedup", "mixing")}
    assert all(set(map(tuple, r)) <= set(rows) for r in kept.values())
    assert Counter(r.doc_id for r in kept["exact dedup"]) == Counter([2, 3, None, 5, 6, 7])
    assert Counter(r.doc_id for r in kept["near dedup"]) == Counter([1, 3, 4, None, 5, 7, None])
    assert {3, 4} <= {r.doc_id for r in kept["mixing"]}
    for name in stages:
        out = stages[name](spark, empty, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == odd.columns)
