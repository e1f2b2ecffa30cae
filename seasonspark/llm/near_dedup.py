"""Near-duplicates by a chosen-path set similarity join.

Each document is the set of its word shingles. Documents with equal sets are
one class from the start. In each of several independent trees, a node holds
classes and picks one position of their minwise signatures, now and then two;
the tokens at a position deal its classes to children. Nodes of a few classes
are compared exhaustively on short sketches; larger ones branch again. A node
that is still large at the last level holds classes that are alike in all that
was picked: it is dealt at random into blocks, and every block also gets the
node's pivots, which joins groups of near copies at little cost. All that this
leaves unconnected in such a node is then compared, every two blocks with each
other but those of one large component. What the sketches cannot rule out is confirmed on the full sets, where a
pair already connected by confirmed links is skipped; the spanning links that
remain are joined into components by alternating large and small stars.

The last comparison grows with the square of the classes of a large node that
are alike but not connected. No step holds a node, a class or a component in one task, emits the pairs of a
group or brings links to the driver.

Defined cases: white space is the six ASCII characters, and only A-Z is
lower-cased; a document with fewer words than a shingle has one shingle, all of
its words; without words or text its set is empty, it links with nothing and is
its own component; rows that repeat an id and text share their component, and
each has kept true if its id is the component's; null ids come last; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import FEW, cut, discard, join_uneven, lean, rows_of, table

#: Positions of a signature.
T = 64
#: A node of at most so many classes is compared exhaustively.
NODE = 64
#: Levels of a tree.
LEVELS = 4
#: Classes of a block where all blocks of a large node are compared.
PAIRED = 256
#: Clusters of so many classes, with so many shingles in all, are confirmed by products of matrices.
MANY, HELD = 12, 3_000_000
#: Classes of a large node that every one of its blocks gets.
PIVOTS = 8
#: A node picks a second position with this probability.
SECOND = 0.25
#: Of the links at the threshold, the share that some tree must find.
RECALL = 0.9995


def trees_for(recall: float, similarity: float) -> int:
    """Independent trees to reach the recall for pairs at the threshold that all LEVELS must not part."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, LEVELS))))


def survival(similarity: float, levels: int) -> float:
    """Probability that one tree keeps a pair together over so many levels: one position and now and then a second, other one."""
    s = 1.0
    for _ in range(levels):
        s = 1 - (1 - similarity * s) * (1 - SECOND * (1 - 1 / T) * similarity * s)
    return s


def shingle_sets(texts: list[str | None], k: int) -> list:
    """Of each text the sorted 64-bit hashes of its distinct shingles of k words."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    column = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    split = pc.ascii_split_whitespace(column)
    words = split.values.dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()] or [0], np.uint64)
    h = own[words.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)
    empty = (pc.binary_length(column).to_numpy() == 0).tolist()
    offsets = split.offsets.to_numpy().tolist()
    out = []
    with np.errstate(over="ignore"):
        for i, nothing in enumerate(empty):
            if nothing:
                out.append(np.empty(0, np.uint64))
                continue
            x = h[offsets[i] : offsets[i + 1]]
            width = min(k, len(x))
            s = np.full(len(x) - width + 1, width, np.uint64)
            for j in range(width):
                s = (s ^ x[j : len(x) - width + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
                s ^= s >> np.uint64(29)
            out.append(np.unique(s))
    return out


def signature(s, keys):
    """Minwise values of a set under T keyed hashes."""
    import numpy as np

    low = np.full(T, 0xFFFFFFFF, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(s), 4096):
            x = (s[a : a + 4096, None] ^ keys[0]) * keys[1]
            np.minimum(low, x.min(0) >> np.uint64(32), out=low)
    return low.astype(np.uint32)


def hash_keys():
    import numpy as np

    rng = np.random.default_rng(20240229)
    k = rng.integers(0, 2**63, (2, T), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return k


def in_batches(column, chars: int = 8_000_000) -> Iterator[list]:
    held, size = [], 0
    for x in column:
        held.append(x.as_py())
        size += len(held[-1] or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def featured(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (digest of id and text), n_shingles, cid (digest of the set; null if empty), sig and sketch (low bytes of sig)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        keys = hash_keys()
        for b in batches:
            n, cid, sig, sketch = [], [], [], []
            for texts in in_batches(b.column(1)):
                for s in shingle_sets(texts, k):
                    n.append(len(s))
                    if not len(s):
                        cid.append(None), sig.append(None), sketch.append(None)
                        continue
                    low = signature(s, keys)
                    cid.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sig.append(low.view(np.int32))
                    sketch.append(low.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(sig, pa.list_(pa.int32())), pa.array(sketch, pa.binary())],
                names=["doc_id", "mark", "n_shingles", "cid", "sig", "sketch"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("mark"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, mark bigint, n_shingles bigint, cid binary, sig array<int>, sketch binary")


def branch(rows: DataFrame) -> DataFrame:
    """The children that each (node, cid, sig) goes to: node, cid."""
    node = F.col("node")
    pick = [F.pmod(F.xxhash64(node, F.lit(j)), F.lit(T)).cast("int") for j in (1, 2)]
    two = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(1000)) < int(1000 * SECOND)
    picks = F.when(two, F.array_distinct(F.array(*pick))).otherwise(F.array(pick[0]))
    dealt = rows.select("cid", "node", "sig", F.explode(picks).alias("_p"))
    return dealt.select(F.xxhash64("node", "_p", F.element_at("sig", F.col("_p") + 1)).alias("node"), "cid")


def counted(rows: DataFrame) -> DataFrame:
    """node, cid and the node's number of classes, of nodes with two classes or more."""
    sizes = cut(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "nodes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    members = cut(join_uneven(rows, sizes, ["node"], "n", total), "paths")
    discard(sizes)
    return members


def blocks(large: DataFrame) -> DataFrame:
    """Large nodes in blocks: random ones, and in each the node's pivots."""
    n_blocks = F.ceil(F.col("n") / NODE)
    own = large.select(F.xxhash64("node", F.pmod(F.xxhash64("cid", "node"), n_blocks)).alias("node"), "cid")
    lows = [F.min(F.struct(F.xxhash64("cid", "node", F.lit(j)), "cid")).alias(f"_p{j}") for j in range(PIVOTS)]
    pivots = large.groupBy("node", "n").agg(*lows).select("node", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)).alias("_b"), F.array(*[F.col(f"_p{j}.cid") for j in range(PIVOTS)]).alias("_ps"))
    return own.unionByName(pivots.select(F.xxhash64("node", "_b").alias("node"), F.explode(F.array_distinct("_ps")).alias("cid")))


def paired(large: DataFrame, roots: DataFrame) -> DataFrame:
    """Every two blocks of each large node as a node of their own: node, cid.

    roots: node, root of what is connected already. Components of PAIRED classes or more have blocks of their own, which need not meet each other.
    """
    rows = cut(large.select("node", "cid").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left"), "paths")
    total = rows.count()
    whole = rows.where("root is not null").groupBy("node", "root").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= PAIRED)
    rows = join_uneven(rows, whole, ["node", "root"], "_c", total, "left")
    rows = cut(rows.select("node", "cid", F.when(F.col("_c").isNotNull(), F.col("root")).otherwise(F.lit(b"")).alias("grp")), "paths")
    sizes = rows.groupBy("node", "grp").agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.ceil(F.col("n") / PAIRED))
    # Blocks are numbered through their node, a group's side by side: from first up to, not including, end.
    node = Window.partitionBy("node")
    end = F.sum("m").over(node.orderBy("grp"))
    sizes = cut(sizes.select("node", "grp", "n", "m", end.alias("end"), F.sum("m").over(node).alias("all")), "nodes")
    first = F.col("end") - F.col("m")
    dealt = join_uneven(rows, sizes, ["node", "grp"], "n", total).select("node", "cid", (first + F.pmod(F.xxhash64("cid", "node"), F.col("m"))).alias("blk"))
    one = sizes.select("node", "grp", "end", "all", F.explode(F.sequence(first, F.col("end") - 1)).alias("x")).repartition("node", "x")
    start = F.when(F.col("grp") == F.lit(b""), F.col("x")).otherwise(F.col("end"))
    both = one.where(start < F.col("all")).select("node", "x", F.explode(F.sequence(start, F.col("all") - 1)).alias("y"))
    sides = both.select("node", F.xxhash64("node", "x", "y").alias("_pair"), F.explode(F.array_distinct(F.array("x", "y"))).alias("blk"))
    return sides.join(dealt, ["node", "blk"]).select(F.col("_pair").alias("node"), "cid")


def grouped(batches: Iterator, key: str) -> Iterator:
    """Runs of equal keys in sorted batches, as tables."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, z in zip(starts, starts[1:], strict=False):
            piece = b.slice(a, z - a)
            if held and held[0][0] == k[a]:
                held.append((k[a], piece))
            else:
                if held:
                    yield pa.Table.from_batches([p for _, p in held])
                held = [(k[a], piece)]
    if held:
        yield pa.Table.from_batches([p for _, p in held])


def find(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = i = up[up[i]]
    return i


def reached(near) -> tuple[list, list]:
    """Components of two or more of a symmetric matrix of links, as arrays, and the links (i, j) that span them."""
    import numpy as np

    parts, links, open_ = [], [], np.ones(len(near), bool)
    for i in range(len(near)):
        if not open_[i]:
            continue
        open_[i] = False
        part, front = [i], np.array([i])
        while len(front):
            some = near[front] & open_
            new = np.flatnonzero(some.any(0))
            links.extend(zip(front[some[:, new].argmax(0)].tolist(), new.tolist(), strict=True))
            open_[new] = False
            part.extend(new.tolist())
            front = new
        if len(part) > 1:
            parts.append(np.sort(part))
    return parts, links


def overlaps(sets: list):
    """Sizes of the intersections of every two sets, by products of their incidence in pieces of the shared elements."""
    import numpy as np

    n, piece = len(sets), 4_096
    size = [len(x) for x in sets]
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = (times > 1) & (times < n)
    held = np.flatnonzero(some[at])
    column, row = (np.cumsum(some) - 1)[at[held]], np.repeat(np.arange(n), size)[held]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.full((n, n), float((times == n).sum()))
    for lo in range(0, int(some.sum()), piece):
        a, z = np.searchsorted(column, [lo, lo + piece])
        m = np.zeros((n, piece), np.float32)
        m[row[a:z], column[a:z] - lo] = 1
        out += m @ m.T
    return out


def candidates(members: DataFrame, similarity: float) -> DataFrame:
    """Within nodes, the clusters that the sketches cannot part: gid (digest of its members), cid."""
    least = math.floor(T * (similarity - 4.5 * math.sqrt(similarity * (1 - similarity) / T)))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        gids, cids = [], []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(gids, pa.int64()), pa.array(cids, pa.binary())], names=["gid", "cid"])
            gids.clear(), cids.clear()
            return out

        for t in grouped(batches, "node"):
            own = dict(zip(t.column("cid").to_pylist(), t.column("sketch").to_pylist(), strict=True))  # a pivot may come twice
            if len(own) < 2:
                continue
            ids = sorted(own)
            m = np.frombuffer(b"".join(own[i] for i in ids), np.uint8).reshape(len(ids), T)
            near = np.zeros((len(ids), len(ids)), bool)
            for lo in range(0, len(ids), 64):
                near[lo : lo + 64] = (m[lo : lo + 64, None, :] == m[None, :, :]).sum(2, dtype=np.uint8) >= least
            for at in reached(near)[0]:
                part = [ids[i] for i in at]
                g = int.from_bytes(hashlib.blake2b(b"".join(part), digest_size=8).digest(), "little", signed=True)
                gids.extend([g] * len(part))
                cids.extend(part)
            if len(gids) > 20_000:
                yield flush()
        yield flush()

    return members.repartition("node").sortWithinPartitions("node").mapInArrow(lean(run), "gid bigint, cid binary")


def confirmed(clusters: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """Spanning links a, b of the clusters, each confirmed on full sets. texts: cid, text."""
    percent = round(100 * similarity)

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            wanted, at = b.column(0).to_pylist(), 0
            for some in in_batches(b.column(1), 2_000_000):
                made = [s.tobytes() for s in shingle_sets(some, k)]
                # ids may repeat with other texts: only the set that the class stands for counts
                right = [(w, s) for w, s in zip(wanted[at : at + len(made)], made, strict=True) if hashlib.blake2b(s, digest_size=16).digest() == w]
                at += len(made)
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in right], pa.binary()), pa.array([s for _, s in right], pa.binary())], names=["cid", "shingles"])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for t in grouped(batches, "gid"):
            own = dict(zip(t.column("cid").to_pylist(), t.column("shingles").to_pylist(), strict=True))
            ids = sorted(own)
            s = [np.frombuffer(own[i], np.uint64) for i in ids]
            a, b = [], []
            if MANY <= len(ids) and sum(map(len, s)) <= HELD:
                size = np.array([len(x) for x in s], float)
                both = overlaps(s)
                for i, j in reached(100 * both >= percent * (size[:, None] + size[None, :] - both))[1]:
                    a.append(ids[i])
                    b.append(ids[j])
            else:
                up = list(range(len(ids)))
                for i in range(len(ids)):
                    for j in range(i):
                        x, y = find(up, i), find(up, j)
                        n, m = len(s[i]), len(s[j])
                        if x == y or 100 * min(n, m) < percent * max(n, m):
                            continue
                        both = n + m - len(np.unique(np.concatenate([s[i], s[j]])))
                        if 100 * both >= percent * (n + m - both):
                            up[x] = y
                            a.append(ids[i])
                            b.append(ids[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    held = texts.mapInArrow(lean(sets), "cid binary, shingles binary")
    rows = clusters.join(held, "cid").repartition("gid").sortWithinPartitions("gid")
    return rows.mapInArrow(lean(run), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node and root (its component's least node) of every node that has a link, by alternating stars.

    A star's centre may have any number of links: it is joined as a hot key.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    n, before = e.count(), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "_m").alias("_m"), "_n")
        large = join_uneven(both, low, ["u"], "_n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        large = cut(large, "links") if n > FEW else large
        low = large.groupBy("u").agg(F.min("v").alias("_m"), F.count(F.lit(1)).alias("_n"))
        small = join_uneven(large, low, ["u"], "_n", 2 * n).where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        nxt = cut(small.unionByName(low.select("u", F.col("_m").alias("v"))).distinct(), "links")
        now = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        discard(e, *[large] * (n > FEW))
        e, n = nxt, now[0]
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_components(docs: DataFrame, k: int = 5, similarity: float = 0.8, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    return in_components(docs, k, similarity, recall, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def in_components(docs: DataFrame, k: int, similarity: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """near_components() with mark and root (of the component; null without shingles)."""
    rows = cut(featured(docs, k, id_col, text_col), "shingles")
    low = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "sig", "sketch")).alias("_r")
    reps = rows.where("n_shingles > 0").groupBy("cid").agg(low, F.count(F.lit(1)).alias("_copies"))
    reps = cut(reps.select("cid", "_r.doc_id", "_r.sig", "_r.sketch", "_copies"), "classes")
    trees = [F.lit(r).cast("long") for r in range(trees_for(recall, similarity))]
    level = branch(reps.select("cid", "sig", F.explode(F.array(*trees)).alias("node")))
    done, used, rest = [], [], None
    for depth in range(LEVELS):
        members = counted(level)
        used.append(members)
        done.append(members.where(F.col("n") <= NODE).select("node", "cid"))
        large = members.where(F.col("n") > NODE)
        if depth < LEVELS - 1:
            if large.isEmpty():
                break
            level = branch(large.join(reps.select("cid", "sig"), "cid"))
        else:
            rest = large
            done.append(blocks(large))
    members = done[0]
    for d in done[1:]:
        members = members.unionByName(d)

    def linked(members: DataFrame) -> DataFrame:
        clusters = cut(candidates(members.join(reps.select("cid", "sketch"), "cid"), similarity).distinct(), "clusters")
        used.append(clusters)
        wanted = clusters.select("cid").distinct().join(reps.select("cid", F.col("doc_id").alias("_id")), "cid")
        texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).cast("string").alias("text"))
        texts = texts.join(wanted, F.col("_doc").eqNullSafe(F.col("_id"))).select("cid", "text")
        return confirmed(clusters, texts, k, similarity)

    roots = cut(components(linked(members)), "components")
    if rest is not None and not rest.isEmpty():
        # What the trees connected stands for its links.
        more = linked(paired(rest, roots)).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = cut(components(more), "components")
    discard(*used)
    ids = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id")
    tops = reps.select(F.col("cid").alias("node"), "doc_id", "_copies").join(roots, "node", "left")
    tops = cut(tops.select("node", "doc_id", "_copies", F.coalesce("root", "node").alias("root")), "classes")
    heads = tops.groupBy("root").agg(F.min(ids).alias("_h"), F.count(F.lit(1)).alias("_n")).select("root", F.col("_h.doc_id").alias("component_id"), "_n")
    named = join_uneven(tops, heads, ["root"], "_n", reps.count()).select(F.col("node").alias("cid"), "root", "component_id", "_copies")
    named = cut(named, "components")
    discard(tops)
    own = rows.select("doc_id", "mark", "n_shingles", "cid")
    alone = own.where("n_shingles = 0").select("doc_id", "mark", F.lit(None).cast("binary").alias("root"), "n_shingles", F.col("doc_id").alias("component_id"))
    out = join_uneven(own.where("n_shingles > 0"), named, ["cid"], "_copies", rows.count())
    out = out.select("doc_id", "mark", "root", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), k=2)


def near_dedup(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs with the smallest id of each component, with all its columns; rows without shingles all stay."""
    found = in_components(docs, k, similarity, RECALL, id_col, text_col)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "mark")).alias("_f")
    one = found.where("n_shingles > 0").groupBy("root").agg(first).select(F.col("_f.mark").alias("_keep"), F.lit(True).alias("_one"))
    kept = one.unionByName(found.where("n_shingles = 0").select(F.col("mark").alias("_keep"), F.lit(False).alias("_one")).distinct())
    rows = rows_of(docs, _own=F.xxhash64(id_col, text_col)).join(kept, F.col("_own") == F.col("_keep"))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_own").orderBy("_keep")))
    return rows.where("_k = 1 or not _one").select("_row.*")
