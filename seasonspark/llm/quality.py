"""Quality classifier by co-training of a text view and a metadata view.

Both views are logistic regressions. They start from labelled rows; in each
round either view judges all unlabelled documents and hands HANDED of its
confident verdicts of either kind, drawn by a keyed hash, to the other view's
training set. On labelled rows that neither trained on, each view is calibrated
by a slope and an offset, and a last regression weighs the two calibrated views;
a view without information gets next to no weight. All documents are then scored
from their whole text and their metadata.

The fit sees at most `most` labelled rows (MAX_LABELLED, and a quarter more),
those with the smallest hashes of their ids, and what was handed over. The scale
of features, the exchange and the scores cover every row; a task and the driver
hold HANDED rows of each kind.

Defined cases: a null text has the features of the empty one; null metadata
count as a value of its own, a null n_chars as 0; labels other than 0 and 1,
null ids in labels and ids with labels of both kinds are left out; with fewer
than 40 labelled rows, or one kind only on either side of the split, all of them
train and calibrate; without labels of both kinds every document is accepted with
score 1; repeated rows repeat their score and are handed over once; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import cut, discard, lean, table

MAX_LABELLED = 4_000
ROUNDS = 4
#: Documents of either kind that a view hands over in a round, if it is this sure.
HANDED, SURE = 200, 0.95
#: A document below this combined probability of being good is rejected.
ACCEPT = 0.5
BUCKETS = 32


def text_features(text: str | None):
    """Shares of bytes, and counts and shares of words and lines, of a whole text."""
    import numpy as np

    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = np.append(counts[:128], counts[128:].sum()) / n
    words = raw.split()
    m = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    letters = max(1, counts[65:91].sum() + counts[97:123].sum())
    again = sum(map(bytes.__eq__, words, words[1:])) / m
    own = np.array([
        counts[65:91].sum() / letters, letters / n, counts[48:58].sum() / n, again, len(set(words)) / m,
        np.log1p(len(words)), len(raw) / m / 20, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
        (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / m, max(map(len, words), default=0) / 100 if words else 0,
        len(words) == 0,
    ])
    return np.concatenate([np.sqrt(share), np.minimum(own, 20)]).astype(np.float32)


def metadata_features(source, lang, n_chars):
    import numpy as np
    import zlib

    x = np.zeros(2 * BUCKETS + 2, np.float32)
    x[zlib.crc32(f"s{source}".encode()) % BUCKETS] = 1
    x[BUCKETS + zlib.crc32(f"l{lang}".encode()) % BUCKETS] = 1
    size = np.log1p(max(0.0, float(n_chars or 0)))
    x[-2:] = size / 5, (size / 5) ** 2
    return x


def columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def meta(name, kind):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), meta("source", "string"), meta("lang", "string"), meta("n_chars", "double"))


def featured(rows: DataFrame) -> DataFrame:
    """doc_id, mark (hash of id and text), x (features of the text), source, lang, n_chars."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            xs = [text_features(t.as_py()).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(5), pa.array(xs, pa.binary()), b.column(2), b.column(3), b.column(4)], names=["doc_id", "mark", "x", "source", "lang", "n_chars"])

    rows = rows.withColumn("mark", F.xxhash64("doc_id", "text"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, mark bigint, x binary, source string, lang string, n_chars double")


def arrays(batch) -> list:
    """The two views of a batch of featured rows."""
    import numpy as np

    x, *metas = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("x", "source", "lang", "n_chars"))
    return [np.frombuffer(b"".join(x), np.float32).reshape(len(x), -1).astype(float), np.array([metadata_features(*r) for r in zip(*metas, strict=True)], float)]


def scales(held: DataFrame) -> list:
    """Mean and deviation of every feature of both views over all rows."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = None
        for b in batches:
            if b.num_rows:
                v = np.hstack(arrays(b))
                own = np.array([np.full(v.shape[1], float(len(v))), v.sum(0), (v * v).sum(0)])
                total = own if total is None else total + own
        n, s, q = (total if total is not None else np.empty((3, 0))).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n), pa.array(s), pa.array(q)], names=["k", "n", "s", "q"])

    got = held.mapInArrow(lean(run), "k int, n double, s double, q double").groupBy("k").agg(*[F.sum(c).alias(c) for c in "nsq"]).orderBy("k").collect()  # a row a feature
    n, s, q = (np.array([r[c] for r in got]) for c in "nsq")
    mean, dev = s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)) + 1e-3
    at = len(got) - 2 * BUCKETS - 2
    return [(mean[:at], dev[:at]), (mean[at:], dev[at:])]


def labelled_rows(held: DataFrame, labels: DataFrame, label_id: str, label: str, most: int) -> list:
    """Featured rows with label _y of the bounded sample."""
    good = labels.where(F.col(label).isin(0, 1) & F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.min(label).alias("_y"), F.max(label).alias("_most"))
    # Hashes spread evenly: a bound on the hash leaves about the asked number, and limit() makes it the most.
    n = good.count()
    few = good.where("_y = _most").where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) <= min(1.0, most / max(1, n)) * (1 << 30)).limit(most + most // 4)
    rows = held.join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    return sorted(rows.select("mark", "x", "source", "lang", "n_chars", F.col("_y").cast("int").alias("_y")).dropDuplicates(["mark"]).collect(), key=lambda r: r["mark"])


def handed(held: DataFrame, model: dict, taken: set, turn: int) -> list:
    """slot and featured row of the documents that the views are sure of, HANDED of each slot (2 * view + kind), outside taken."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best = {k: [] for k in range(4)}
        for b in batches:
            mark = b.column(b.schema.get_field_index("mark")).to_numpy()
            free = np.array([m not in taken for m in mark.tolist()], bool)
            with np.errstate(over="ignore"):
                order = (mark.astype(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
                order = (order ^ (order >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(1)
            for v, view in enumerate(arrays(b) if b.num_rows else ()):
                p = 1 / (1 + np.exp(-logits((view - model["scale"][v][0]) / model["scale"][v][1], model["w"][v])))
                for kind, sure in enumerate((1 - p, p)):
                    at = np.flatnonzero((sure >= SURE) & free)
                    at = at[np.argsort(order[at], kind="stable")[:HANDED]]
                    found = {o: r for o, r in best[2 * v + kind]}
                    found.update((int(order[i]), b.slice(int(i), 1).to_pylist()[0]) for i in at)
                    best[2 * v + kind] = sorted(found.items())[:HANDED]
        rows = [{"slot": k, "rank": o, **{c: r[c] for c in ("mark", "x", "source", "lang", "n_chars")}} for k, own in best.items() for o, r in own]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("slot", pa.int32()), ("rank", pa.int64()), ("mark", pa.int64()), ("x", pa.binary()), ("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.float64())]))

    found = held.mapInArrow(lean(run), "slot int, rank bigint, mark bigint, x binary, source string, lang string, n_chars double").dropDuplicates(["slot", "mark"])
    first = Window.partitionBy("slot").orderBy("rank", "mark")
    return sorted(found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= HANDED).collect(), key=lambda r: (r.slot, r["rank"], r["mark"]))


def logistic(x, y, weight=None, ridge: float = 1.0, steps: int = 25):
    """Coefficients of a ridge logistic regression, the last one the intercept, by damped Newton steps."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + keep * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def logits(x, w):
    import numpy as np

    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def cotrain(held: DataFrame, labels: DataFrame, label_id: str, label: str, most: int = MAX_LABELLED) -> dict | None:
    """The two views, their calibrations and the combination; null without both kinds of labels. held: featured rows, cut."""
    import numpy as np

    rows = labelled_rows(held, labels, label_id, label, most)
    if len({r["_y"] for r in rows}) < 2:
        return None
    scale = scales(held)

    def both(rows: list) -> list:
        x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], float)
        m = np.array([metadata_features(r["source"], r["lang"], r["n_chars"]) for r in rows], float)
        return [(v - mean) / dev for v, (mean, dev) in zip((x, m), scale, strict=True)]

    view, y = both(rows), np.array([r["_y"] for r in rows])
    turn = np.arange(len(rows)) % 4 == 3
    if len(rows) < 40 or len(set(y[turn])) < 2 or len(set(y[~turn])) < 2:
        turn[:] = True  # too few to set some aside
    train = np.flatnonzero(~turn) if not turn.all() else np.arange(len(rows))
    own = [[(v[train], y[train].astype(float))] for v in view]
    model = {"scale": scale, "w": [None, None]}
    taken = {r["mark"] for r in rows}
    given: list[set] = [set(), set()]
    for turn_no in range(ROUNDS + 1):
        for v in (0, 1):
            model["w"][v] = logistic(*(np.concatenate(c) for c in zip(*own[v], strict=True)))
        if turn_no == ROUNDS:
            break
        new = handed(held, model, taken, turn_no)
        for v in (0, 1):  # v teaches the other view
            mine = [r for r in new if r.slot // 2 == v and r["mark"] not in given[1 - v]]
            if mine:
                given[1 - v].update(r["mark"] for r in mine)
                own[1 - v].append((both(mine)[1 - v], np.array([r.slot % 2 for r in mine], float)))
    z = [logits(view[v][turn], model["w"][v]) for v in (0, 1)]
    slope = [logistic(q[:, None], y[turn], ridge=0.1) for q in z]
    calibrated = np.column_stack([logits(q[:, None], s) for q, s in zip(z, slope, strict=True)])
    return model | {"slope": slope, "mix": logistic(calibrated, y[turn], ridge=0.1)}


def judged(model: dict | None, both: list) -> list:
    """Calibrated probabilities of being good by text and by metadata, and the combined one."""
    import numpy as np

    if model is None or not len(both[0]):
        return [np.ones(len(both[0]))] * 3
    z = [logits(logits((v - mean) / dev, w)[:, None], s) for v, (mean, dev), w, s in zip(both, model["scale"], model["w"], model["slope"], strict=True)]
    return [1 / (1 + np.exp(-q)) for q in (*z, logits(np.column_stack(z), model["mix"]))]


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "quality", most: int = MAX_LABELLED) -> DataFrame:
    """One row per input row: doc_id, p_text, p_metadata, score and accepted."""
    held = cut(featured(columns(docs, id_col, text_col)), "features")
    model = cotrain(held, labels, label_id, label, most)
    kind = held.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            p = judged(model, arrays(b)) if b.num_rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.float64()) for x in p), pa.array([x >= ACCEPT for x in p[2]], pa.bool_())], names=["doc_id", "p_text", "p_metadata", "score", "accepted"])

    return held.mapInArrow(lean(run), f"doc_id {kind}, p_text double, p_metadata double, score double, accepted boolean")


def accepted(docs: DataFrame, labels: DataFrame, text_col: str = "text", most: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""
    held = cut(featured(columns(docs, "doc_id", text_col)), "features")
    model = cotrain(held, labels, "doc_id", "quality", most)
    discard(held)
    at = [docs.columns.index(c) if c in docs.columns else -1 for c in (text_col, "source", "lang", "n_chars")]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts, *metas = (b.column(i).to_pylist() if i >= 0 else [None] * b.num_rows for i in at)
            x = np.array([text_features(t) for t in texts], float)
            yield b.filter(pa.array(judged(model, [x, np.array([metadata_features(*r) for r in zip(*metas, strict=True)], float)])[2] >= ACCEPT))

    return docs.mapInArrow(lean(run), docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
