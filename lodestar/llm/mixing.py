"""Mixing sources to target weights, in DataFrame operations only.

Each source's documents, laid end to end, are packed into blocks of `block` words. A source takes
part with as many slots as its target fills with blocks, the last one cut to the words left. Output
shards are drawn first: each of a shard's slots draws its source by the targets' weights, so a
shard's counts of sources are a multinomial draw. A source's slots are numbered over the shards by
the running sum of its counts, no further than its total; the last shard takes what is left, so
that the totals meet the targets to the word. Slot k of a source belongs to pass
k / blocks and is mapped to a block by that pass's pseudorandom permutation of the block indices
(a Feistel network on the next power of four, walked until it lands inside). Documents get their
blocks by a join on the index; all sums over a source are dealt by blocks or hashed buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, with_rows

SLOTS_AT_ONCE = 4096


def source_targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """source, source_size, weight, target of a table (source, source_size): a row a source.

    Sources by code point, null last, weigh 1, 2, 3, 1, 2, 3 ...; targets stop at `most` times the
    source's size, and the excess is shared by weight until none is above. All targets are then
    level * weight or the cap: sources are capped in the order of cap / weight.
    """
    ranked = sizes.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double"))
    every = Window.orderBy("turn", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.orderBy("turn", "source").rowsBetween(Window.unboundedPreceding, -1)
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("turn", F.col("cap") / F.col("weight"))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    stepped = capped.withColumn("level", level)
    free = F.min(F.when(F.col("turn") >= F.col("level"), F.struct("turn", "source", "level"))).over(every)["level"]
    return stepped.withColumn("free", free).select("source", "source_size", "weight", F.when(F.col("free").isNull() | (F.col("turn") < F.col("free")), F.col("cap")).otherwise(F.col("weight") * F.col("free")).alias("target"))


def permuted(index: Column, n: Column, key: Column, rounds: int = 4, walks: int = 160) -> Column:
    """A pseudorandom permutation of 0 .. n-1, one for each key."""
    half = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double")) / 2)).cast("int")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), half) - 1

    def once(x: Column) -> Column:
        state = F.struct(F.call_function("shiftright", x, half).alias("l"), x.bitwiseAND(low).alias("r"))
        for r in range(rounds):
            state = F.struct(state["r"].alias("l"), state["l"].bitwiseXOR(F.xxhash64(key, F.lit(r), state["r"]).bitwiseAND(low)).alias("r"))
        return F.call_function("shiftleft", state["l"], half) + state["r"]

    first = F.struct(index.alias("x"), F.lit(False).alias("in"))
    step = lambda s, _: F.when(s["in"], s).otherwise(F.transform(F.array(once(s["x"])), lambda y: F.struct(y.alias("x"), (y < n).alias("in")))[0])
    end = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), first, step)
    # A walk goes on with a chance of 3 in 4 at most, so one as long as this is a fault.
    return F.when(end["in"] | (n <= 0), end["x"]).otherwise(F.raise_error(F.lit("a permutation's walk has not landed")).cast("long"))


def shard_counts(due: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """source, shard, first, n: the slots of each source in each output shard, drawn by the sources' numbers of slots.

    `due`: a row a source with n_slots. Every slot of a shard draws its source; a shard's rows are
    counted where they are made. A source's running count stops at its total, which the last shard fills up.
    """
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    weighed = due.withColumn("upto", F.sum("n_slots").over(upto))  # a row a source
    table = weighed.agg(F.sort_array(F.collect_list(F.struct("upto", "source"))).alias("table"), F.sum("n_slots").alias("total"))  # one row, of the number of sources
    shards = table.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("total") / shard_slots)).cast("long"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_shards") - 2, F.lit(0))))
    drawn = shards.filter("n_shards > 1").select("table", "total", chunk.alias("shard")).repartition("shard")
    each = drawn.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(shard_slots - 1))))
    ticket = F.pmod(F.xxhash64(F.lit(seed + 1), "shard", "i"), F.col("total"))
    source = F.filter("table", lambda x: x["upto"] > F.col("ticket"))[0]["source"]
    counted = each.withColumn("ticket", ticket).select("shard", source.alias("source")).groupBy("source", "shard").agg(F.count(F.lit(1)).alias("drawn"))
    # The last shard closes every source, drawn there or not.
    last = due.join(F.broadcast(shards.select((F.col("n_shards") - 1).alias("shard")))).select("source", "shard", F.col("n_slots").alias("drawn"))  # one row joined
    both = counted.unionByName(last).join(F.broadcast(due.select(F.col("source").alias("s"), "n_slots")), F.col("source").eqNullSafe(F.col("s")))  # a row a source
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    running = both.withColumn("first", F.least("n_slots", F.coalesce(F.sum("drawn").over(before), F.lit(0))))
    return running.withColumn("n", F.least("drawn", F.col("n_slots") - F.col("first"))).filter("n > 0").select("source", "shard", "first", "n")


def slots(targets: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """source, shard, place, slot, pass, words, block_id: a row a slot of the mix; `place` is random in its shard."""
    whole = F.floor(F.col("target") + 0.5).cast("long")
    sized = targets.filter("source_size > 0").select(
        "source", "source_size", whole.alias("words_due"), F.ceil(F.col("source_size") / block).cast("long").alias("blocks"),
    )
    passes = F.floor(F.col("words_due") / F.col("source_size"))
    rest = F.col("words_due") - passes * F.col("source_size")
    due = materialize(sized.withColumn("n_slots", passes * F.col("blocks") + F.ceil(rest / block)).filter("n_slots > 0"))
    # Slots are dear to map and small to hold, so their tasks are set by their number.
    tasks = max(1, int(due.agg(F.sum("n_slots")).first()[0] or 0) // (2 * SLOTS_AT_ONCE))
    dealt = shard_counts(due.select("source", "n_slots"), shard_slots, seed).withColumnRenamed("source", "s")
    chunks = dealt.join(F.broadcast(due), F.col("s").eqNullSafe(F.col("source"))).drop("s")  # a row a source
    # A last shard may be long, so that slots are made in pieces.
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SLOTS_AT_ONCE).cast("long")))
    pieces = chunks.withColumn("from", starts).repartition(tasks, "source", "shard", "from")
    each = pieces.withColumn("slot", F.explode(F.sequence(F.col("first") + F.col("from"), F.col("first") + F.least(F.col("from") + SLOTS_AT_ONCE, F.col("n")) - 1)))
    k, of = F.col("slot") % F.col("blocks"), F.col("blocks")
    # The last block may be short; it stays last in each pass, so that the words before it are whole blocks.
    block_id = F.when(k == of - 1, k).otherwise(permuted(k, of - 1, F.xxhash64(F.lit(seed), "source", F.floor(F.col("slot") / of))))
    full = F.least(F.lit(block), F.col("source_size") - block_id * block)
    left = F.col("words_due") - F.floor(F.col("slot") / of) * F.col("source_size") - k * block
    return each.select("source", "shard", F.xxhash64(F.lit(seed + 2), "source", "slot").alias("place"), "slot", F.floor(F.col("slot") / of).alias("pass"), block_id.alias("block_id"), F.least(full, left).cast("long").alias("words"))


WORD = r"[^\x20\x09-\x0D]+"


def _laid(measured: DataFrame, seed: int) -> DataFrame:
    """The documents end to end in their sources: `begins`, the words before."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("print"), F.col("row")]
    return numbered(measured, ["source"], order, F.col("size"), "begins", spread=F.xxhash64("doc_id", "print", F.lit(seed)))


def _spans(laid: DataFrame, block: int) -> DataFrame:
    """row, source, block_id, lo, hi: the words of a block that a document fills."""
    blocks = F.explode(F.sequence(F.floor(F.col("begins") / block), F.floor((F.col("begins") + F.col("size") - 1) / block)))
    spans = laid.filter("size > 0").select("row", "source", "begins", "size", blocks.alias("block_id"))
    at = F.col("begins") - F.col("block_id") * block
    return spans.select("row", "source", "begins", "block_id", F.greatest(at, F.lit(0)).alias("lo"), F.least(at + F.col("size"), F.lit(block)).alias("hi"))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    source = F.col(source_col) if source_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))


def _measured(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    n_words = F.size(F.filter(F.split(flat, " "), lambda w: w != "")).cast("long")
    return materialize(rows.select("row", "doc_id", "source", n_words.alias("size"), F.xxhash64("text").alias("print")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 256, shard_slots: int = 1024, seed: int = 7, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: documents (row, doc_id, source, size, source_size, target, taken, shards, first_shard) and slots.

    Size is the number of words (null text: 0); null is a source of its own, after all others, and
    all of a table without the column. `shards` counts the output shards that take words of the
    document, `first_shard` is the least of them (null for none). Documents of size 0 get 0.
    Repeated rows are documents of their own. An empty table gives none. Nothing depends on the
    order of rows or on partitions but for rows alike in id and text.
    """
    if rows is None:
        rows = _rows(docs, id_col, text_col, source_col)
    measured = _measured(rows)
    targets = materialize(source_targets(measured.groupBy("source").agg(F.sum("size").alias("source_size"))))
    all_slots = materialize(slots(targets, block, shard_slots, seed))
    spans = _spans(_laid(measured, seed), block).alias("a")
    met = spans.join(all_slots.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block_id") == F.col("b.block_id")))  # a slot a pass
    words = F.greatest(F.least("words", "hi") - F.col("lo"), F.lit(0))
    by_row = met.select("row", "shard", words.alias("words")).filter("words > 0").groupBy("row").agg(F.sum("words").alias("taken"), F.size(F.collect_set("shard")).alias("shards"), F.min("shard").alias("first_shard"))
    documents = measured.join(by_row, "row", "left").alias("m").join(targets.alias("t"), F.col("m.source").eqNullSafe(F.col("t.source")))
    return documents.select("row", "doc_id", "m.source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.lit(0)).alias("shards"), "first_shard"), all_slots


def mixed_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 256, shard_slots: int = 1024, seed: int = 7) -> DataFrame:
    """shard, place, source, block_id, words: the mix itself, a row a slot with the words of its block.

    A shard's rows in the order of `place` are its training blocks; write them with
    repartitionByRange("shard", "place") to have shards by files. All blocks hold `block` words but
    a source's last and the one its target cuts.
    """
    rows = materialize(_rows(docs, id_col, text_col, source_col))
    measured = _measured(rows)
    targets = materialize(source_targets(measured.groupBy("source").agg(F.sum("size").alias("source_size"))))
    spans = _spans(_laid(measured, seed), block)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    first = F.col("block_id") * block + F.col("lo") - F.col("begins")
    cut = rows.select("row", words.alias("words")).join(spans, "row").select("source", "block_id", "lo", F.slice("words", (first + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("part"))
    blocks = cut.groupBy("source", "block_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("lo", "part"))), lambda x: x["part"])).alias("words"))  # a block's words
    all_slots = materialize(slots(targets, block, shard_slots, seed)).alias("s")
    met = all_slots.join(blocks.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s.block_id") == F.col("b.block_id")))
    return met.select("shard", "place", "s.source", "s.block_id", F.slice("b.words", F.lit(1), F.col("s.words").cast("int")).alias("words"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **options) -> DataFrame:
    """The documents of the mix, all columns as they came, as often as the words taken fill them.

    A rest of words that fill no whole document is one with the probability of its share, by a
    hash of the row, so that sources keep their targets on average. A document without words stays once.
    An empty table stays empty; repeated rows are documents of their own; without a source column all is one source.
    """
    stored = with_rows(docs, doc=F.struct(*[docs[c] for c in docs.columns]))
    source = F.col(f"doc.{source_col}") if source_col in docs.columns else F.lit(None).cast("string")
    rows = stored.select(F.col(f"doc.{id_col}").alias("doc_id"), source.alias("source"), F.col(f"doc.{text_col}").alias("text"), "row")
    documents, _ = mix(docs, rows=rows, seed=seed, **options)
    chance = F.pmod(F.xxhash64("doc_id", "row", F.lit(seed)), F.lit(1 << 20)) / (1 << 20)
    share = F.col("taken") / F.col("size")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(share) + (share - F.floor(share) > chance).cast("long")).cast("int")
    often = documents.select("row", copies.alias("copies")).filter("copies > 0")
    return stored.join(often, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
