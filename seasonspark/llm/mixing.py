"""Mixing sources to target weights.

The words of a source form one stream, cut into blocks of a fixed number of
words. Each output shard draws how many of its slots each source fills from a
multinomial over what the sources still have to give, so that the shards
together give each source's target. The slots of a source run through keyed
pseudorandom permutations of its block indices, one permutation a pass, and
the blocks are joined by source and index; the last slot of a source is cut
where the target is reached.

Where a document begins in its source's stream is a prefix sum: documents are
dealt to buckets by a hash of their id, and buckets to strips; running sums go
over the strips of a source, the buckets of a strip and the documents of a
bucket, so that no task holds a source.

Defined cases: null texts have no words and nothing is taken of them; a null
source is a source of its own, last in order; rows that repeat an id are
documents of their own; an empty table gives an empty result. What is collected
to the driver is one total per source, at most MAX_SOURCES of them, and MAX_SOURCES
times the number of shards small numbers; more sources raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import cut, rows_of, table

BLOCK = 512
SHARDS = 64
#: Documents in a bucket of the prefix sums, about, and buckets in a strip.
BUCKET_DOCS, STRIP = 500, 1_000
#: Slots that one row of the plan expands to.
STRIDE = 4_096
MAX_SOURCES = 100_000
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float, most: float = 2.0) -> list[float]:
    """share times all sizes dealt by weight; above most times its size a source gives back, until none is above."""
    budget, out, open_ = share * sum(sizes), [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        unit = max(budget, 0.0) / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        for i in over or open_:
            out[i] = most * sizes[i] if over else weights[i] * unit
            budget -= out[i]
        if not over:
            break
        open_ = [i for i in open_ if i not in set(over)]
    return out


def permuted(i, n, key, back: bool = False):
    """Where a keyed permutation of 0..n-1 puts each i: a Feistel network over the next power of four, walked until inside; or, back, what it puts at i."""
    import numpy as np

    i, n, key = np.asarray(i, np.uint64).copy(), np.asarray(n, np.uint64), np.asarray(key, np.uint64)
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float) + 1) / 2))).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.arange(len(i))

    def mixed(x, turn, k, m):
        x = (x + k + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & m

    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = i[todo] >> h, i[todo] & m
            for r in reversed(range(6)) if back else range(6):
                if back:
                    left, right = right ^ mixed(left, r, k, m), left
                else:
                    left, right = right, left ^ mixed(right, r, k, m)
            i[todo] = left << h | right
            todo = todo[i[todo] >= n[todo]]
    return i.astype(np.int64)


def pass_key(seed: int, source: int, turn):
    import numpy as np

    with np.errstate(over="ignore"):
        x = np.uint64(seed) * np.uint64(0xD1B54A32D192ED03) + np.asarray(source, np.uint64) * np.uint64(0xABC98388FB8FAC03) + np.asarray(turn, np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) + np.uint64(1)
        return (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)


def slots_for(words: int, size: int, block: int, source: int, seed: int) -> tuple[int, int]:
    """How many slots a source needs for so many words, and how many words the last of them takes.

    Only the last block of a stream is short; where each pass puts it, which the
    inverse of the pass's permutation tells at once, decides.
    """
    n = -(-size // block)
    short = size - (n - 1) * block
    if words <= 0:
        return 0, 0
    turns = -(-words // size)
    at = permuted([n - 1] * turns, [n] * turns, pass_key(seed, source, range(turns)), back=True)
    slots, before = 0, 0
    for h in [*(turn * n + int(x) for turn, x in enumerate(at)), None]:  # slots that hold the short block
        need = -(-(words - before) // block)
        if h is None or slots + need <= h:
            break
        before += (h - slots) * block
        slots = h + 1
        if words - before <= short:
            return slots, words - before
        before += short
    return slots + need, words - before - (need - 1) * block


def shard_counts(slots: list[int], shards: int, seed: int):
    """Slots of each source in each shard: multinomial draws over what is left, the last shard taking the rest."""
    import numpy as np

    rng = np.random.default_rng(seed)
    left, out = np.array(slots, np.int64), []
    for shard in range(shards):
        size = -(-int(left.sum()) // (shards - shard))
        got = np.minimum(rng.multinomial(size, left / left.sum()) if left.sum() else left, left) if shard < shards - 1 else left.copy()
        while (lack := size - int(got.sum())) > 0 and shard < shards - 1:
            room = left - got
            got += np.minimum(rng.multinomial(lack, room / room.sum()), room)
        out.append(got)
        left = left - got
    return out


def located(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Each document with its size, in words of its text or elements of its list, and where it begins in its source's stream; sizes of sources."""
    if docs.schema[text_col].dataType.typeName() == "array":
        size = F.coalesce(F.when(F.col(text_col).isNotNull(), F.size(text_col)), F.lit(0))
    else:
        size = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), F.xxhash64(id_col, text_col).alias("_mark"))
    rows = cut(rows, "mix-sizes")
    buckets = max(1, rows.count() // BUCKET_DOCS)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "_mark"), F.lit(buckets)).cast("int"))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_strip", F.floor(F.col("_bucket") / STRIP))
    strips = sums.groupBy("source", "_strip").agg(F.sum("_sum").alias("_sum"))
    of_source = Window.partitionBy("source").orderBy("_strip").rowsBetween(Window.unboundedPreceding, -1)
    strips = strips.select(F.col("source").alias("_s"), F.col("_strip").alias("_t"), F.coalesce(F.sum("_sum").over(of_source), F.lit(0)).alias("_far"))
    of_strip = Window.partitionBy("source", "_strip").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_near", F.coalesce(F.sum("_sum").over(of_strip), F.lit(0)))
    sums = sums.join(strips, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_strip") == F.col("_t")))
    sums = cut(sums.select("source", "_bucket", "_sum", (F.col("_far") + F.col("_near")).alias("_before")), "mix-buckets")
    inside = Window.partitionBy("source", "_bucket").orderBy("doc_id", "_mark").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("_run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    s = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), "_before")
    placed = run.join(s, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return placed.select("doc_id", "source", "size", "_mark", (F.col("_before") + F.col("_run")).alias("_start")), sums


def mixture(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, shards: int = SHARDS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """(documents, slots): each document with its place and its source's size and target; each output slot with its block.

    slots: shard, slot (of the source), source, index (block of the source) and
    take (words of the block, from its beginning, that the slot holds).
    """
    spark = docs.sparkSession
    placed, sums = located(docs, id_col, text_col, source_col)
    placed = cut(placed, "mix-places")
    totals = sums.groupBy("source").agg(F.sum("_sum").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r.n or 0) for r in totals]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share)
    need = [slots_for(round(t), s, block, i, seed) for i, (t, s) in enumerate(zip(wanted, sizes, strict=True))]
    plan, at = [], [0] * len(sizes)
    for shard, counts in enumerate(shard_counts([n for n, _ in need], shards, seed)):
        for i, n in enumerate(map(int, counts)):
            if n:
                plan.append((i, shard, at[i], n, need[i][0], need[i][1], -(-sizes[i] // block)))
                at[i] += n
    about = spark.createDataFrame([(i, r.source, s, float(t)) for i, (r, s, t) in enumerate(zip(totals, sizes, wanted, strict=True))], "_i int, source string, source_size bigint, target double")
    rows = spark.createDataFrame(plan, "_i int, shard int, first bigint, n bigint, slots bigint, last bigint, blocks bigint")
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STRIDE)))
    rows = rows.select("*", piece.alias("_p")).repartition("_i", "shard", "_p")
    slot = F.explode(F.sequence(F.col("first") + F.col("_p") * STRIDE, F.col("first") + F.least((F.col("_p") + 1) * STRIDE, F.col("n")) - 1))
    rows = rows.select("_i", "shard", "slots", "last", "blocks", slot.alias("slot"))

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            i, slot, n = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("_i", "slot", "blocks"))
            index = permuted(slot % n, n, pass_key(seed, i, slot // n)) if len(i) else slot
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index, pa.int64())], names=[*b.schema.names, "index"])

    slots = rows.mapInArrow(place, rows.schema.simpleString()[7:-1].replace(":", " ") + ", index bigint")
    slots = slots.select("_i", "shard", "slot", "index", F.when(F.col("slot") == F.col("slots") - 1, F.col("last")).otherwise(F.lit(block)).alias("take"))
    # One row a source on the right; see MAX_SOURCES.
    placed = placed.join(F.broadcast(about.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return placed, slots


def spans(placed: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document has words in: where in the block they begin and end."""
    start, end = F.col("_start"), F.col("_start") + F.col("size")
    cuts = placed.where("size > 0").select("*", F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block))).alias("index"))
    lo = F.greatest(start - F.col("index") * block, F.lit(0))
    hi = F.least(end - F.col("index") * block, F.lit(block))
    return cuts.select("*", lo.alias("_lo"), hi.alias("_hi"))


def taken(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Words that the mix takes of each document, by joining blocks and slots on source and index."""
    uses = slots.groupBy("_i", "index").agg(F.sum(F.when(F.col("take") == block, 1).otherwise(0)).alias("_full"), F.max(F.when(F.col("take") < block, F.col("take"))).alias("_part"))
    # Spark's estimate of the slots misses what explode() makes of the plan, and would broadcast them.
    pieces = spans(placed, block).join(uses.hint("merge"), ["_i", "index"])
    part = F.greatest(F.least(F.coalesce(F.col("_part"), F.lit(0)), F.col("_hi")) - F.col("_lo"), F.lit(0))
    words = F.col("_full") * (F.col("_hi") - F.col("_lo")) + part
    got = pieces.groupBy(F.col("_i").alias("_gi"), F.col("_start").alias("_gs")).agg(F.sum(words).alias("_taken"))
    joined = placed.join(got, (F.col("_i") == F.col("_gi")) & (F.col("_start") == F.col("_gs")) & (F.col("size") > 0), "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "_mark")


def packed_blocks(encoded: DataFrame, block: int = BLOCK, id_col: str = "doc_id", ids_col: str = "ids", source_col: str = "source", **how) -> DataFrame:
    """A row for each output slot: shard, slot (of the source), source, index (block of the source) and ids, block of them but in the last slot of a source.

    encoded: documents with their token ids; null lists are empty. Blocks are
    packed over the ends of documents and joined to the slots by source and index.
    """
    placed, slots = mixture(encoded, block=block, id_col=id_col, text_col=ids_col, source_col=source_col, **how)
    own = encoded.select(F.xxhash64(id_col, ids_col).alias("_mark"), F.col(ids_col).alias("_ids")).dropDuplicates(["_mark"])
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block)

    def piece(j):
        lo, hi = F.greatest(j * block, F.col("_start")), F.least((j + 1) * block, F.col("_start") + F.col("size"))
        return F.struct(j.alias("index"), lo.alias("at"), F.slice("_ids", (lo - F.col("_start") + 1).cast("int"), (hi - lo).cast("int")).alias("ids"))

    pieces = placed.where("size > 0").join(own.hint("merge"), "_mark").select("_i", "source", F.explode(F.transform(F.sequence(first, last), piece)).alias("_p"))
    # At most block ids a group.
    blocks = pieces.groupBy("_i", F.col("_p.index").alias("index")).agg(F.first("source").alias("source"), F.array_sort(F.collect_list(F.struct("_p.at", "_p.ids"))).alias("_ps"))
    blocks = blocks.select("_i", "index", "source", F.flatten(F.transform("_ps", lambda p: p["ids"])).alias("_ids"))
    out = slots.hint("merge").join(blocks, ["_i", "index"])
    return out.select("shard", "slot", "source", "index", F.slice("_ids", 1, F.col("take").cast("int")).alias("ids"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, slots = mixture(table(spark, sf_dir, "documents"))
    return taken(placed, slots).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The words that the slots take: a row for each slot and document in it, with the document's columns, its text those words (n_chars their length)."""
    placed, slots = mixture(docs, block=block, id_col=id_col, text_col=text_col, **how)
    begin = F.col("index") * block - F.col("_start")
    pieces = spans(placed, block).join(slots.select("_i", "index", "take").hint("merge"), ["_i", "index"])
    pieces = pieces.where(F.col("take") > F.col("_lo"))
    pieces = pieces.select("_mark", F.struct("_start", (begin + F.col("_lo")).alias("lo"), (begin + F.least("_hi", "take")).alias("hi"), "size").alias("_r"))
    used = pieces.groupBy(F.col("_mark").alias("_m")).agg(F.collect_list("_r").alias("_rs"))
    rows = rows_of(docs, _own=F.xxhash64(id_col, text_col)).join(used.hint("merge"), F.col("_own") == F.col("_m"))
    # Rows that repeat an id and text are places of their own: each takes those of one.
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_own").orderBy("_m")))
    starts = F.array_sort(F.array_distinct(F.transform("_rs", lambda r: r["_start"])))
    rows = rows.select("_row", F.transform(F.array(F.get(starts, F.col("_k") - 1)), lambda s: F.filter("_rs", lambda r: r["_start"] == s))[0].alias("_rs"))
    whole = F.col("_row")[text_col].cast("string")
    words = F.regexp_extract_all(whole, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    # In an array of one, so that the words are found once a document.
    cuts = F.transform(F.array(words), lambda w: F.transform("_rs", lambda r: F.when(r["hi"] - r["lo"] == r["size"], whole).otherwise(F.regexp_replace(F.array_join(F.slice(w, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")), ""), r"^[\x20\x09-\x0D]+", ""))))[0]
    out = rows.select("_row", F.explode(cuts).alias("_text"))
    new = {text_col: F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
