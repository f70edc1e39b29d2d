"""Near-duplicate classes: dart signatures, banded candidates, exact verification, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import dart_minhash as darts
from tallyloom.llm.common import cut, drop_rows, lean, pieces, prefilter, read, texts_of

SIMILARITY = 0.8
#: Rows of what is left of a bucket beyond which it is settled after all others; about so many rows and elements of a
#: tile; elements that two tiles are multiplied over at a time.
GROUP_ROWS, TILE, TILE_CELLS, COLUMNS = 2_000, 1024, 1_000_000, 4096


def _sign(docs: DataFrame) -> DataFrame:
    """_row, doc_id, text_hash, the digest of the elements and weights (fp1, fp2), their number and the band keys."""

    def run(batches):
        for batch in pieces(batches, "text", 1_500_000, 1024):
            element, weight, counts = darts.elements(texts_of(batch))
            keys = darts.band_keys(darts.signatures(element, weight, counts)).view(np.int64)
            starts = np.cumsum(counts) - counts  # every text has an element
            weighed = darts.mix(element ^ darts.mix(weight.view(np.uint64)))
            sums = [np.add.reduceat(darts.mix(weighed ^ np.uint64(k + 1)), starts) if len(counts) else np.zeros(0, np.uint64) for k in range(2)]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * darts.BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x.view(np.int64)) for x in sums), pa.array(counts), bands], ["_row", "doc_id", "text_hash", "fp1", "fp2", "size", "bands"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_row", F.monotonically_increasing_id()).withColumn("text_hash", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"_row bigint, doc_id {kind}, text_hash bigint, fp1 bigint, fp2 bigint, size bigint, bands array<bigint>")


def _cells_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text_hash, cells (binary) of the texts with these hashes; only these texts move, one of each kind."""

    def run(batches):
        for batch in pieces(batches, "text", 1_500_000, 1024):
            element, weight, counts = darts.elements(texts_of(batch))
            ends = np.cumsum(counts).tolist()
            parts = [darts.pack(element[e - n : e], weight[e - n : e]) for e, n in zip(ends, counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), pa.array(parts, pa.binary())], ["text_hash", "cells"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return prefilter(texts, "text_hash", wanted).groupBy("text_hash").agg(F.first("text").alias("text")).mapInArrow(lean(run), "text_hash bigint, cells binary")


def _measure(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """pairs(a, a_hash, b, b_hash) with the exact similarity as a, b, sim."""

    def run(batches):
        for batch in batches:
            sims = [darts.similarity(darts.unpack(x), darts.unpack(y)) for x, y in zip(batch.column("a_cells").to_pylist(), batch.column("b_cells").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    one = lambda x: cells.select(F.col("text_hash").alias(f"{x}_hash"), F.col("cells").alias(f"{x}_cells"))
    return pairs.join(one("a"), "a_hash").join(one("b"), "b_hash").select("a", "a_cells", "b", "b_cells").mapInArrow(lean(run), "a bigint, b bigint, sim double")


def _overlaps(low: list, high: list) -> np.ndarray:
    """(low, high) numbers that the shared weight of two texts doesn't exceed: sums of roots of products of their
    weights, which are the shared weight itself where weights are equal."""
    out = np.zeros((len(low), len(high)), np.float32)
    sides = [(np.repeat(np.arange(len(x)), [len(e) for e, _ in x]), np.concatenate([e for e, _ in x]), np.concatenate([w for _, w in x])) for x in (low, high)]
    both = np.intersect1d(sides[0][1], sides[1][1])
    at = [np.searchsorted(both, e) for _, e, _ in sides]
    for start in range(0, len(both), COLUMNS):
        part = both[start : start + COLUMNS]
        dense = []
        for (row, element, weight), spot, own in zip(sides, at, (low, high), strict=True):
            inside = np.flatnonzero((spot >= start) & (spot < start + len(part)))
            inside = inside[both[spot[inside]] == element[inside]]
            block = np.zeros((len(own), len(part)), np.float32)
            block[row[inside], spot[inside] - start] = np.sqrt(weight[inside])
            dense.append(block)
        out += dense[0] @ dense[1].T
    return out


def _connect(low: list, high: list, low_side: np.ndarray, high_side: np.ndarray, maybe: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Pairs i, j at the threshold or above, enough to connect all sides that such pairs connect. maybe: the pairs
    that have to be looked at. Each pair that counts is measured exactly."""
    weight = [np.array([float(w.sum()) for _, w in x]) for x in (low, high)]
    both = weight[0][:, None] + weight[1][None, :]
    maybe = maybe & (low_side[:, None] != high_side[None, :])
    maybe &= np.minimum(weight[0][:, None], weight[1][None, :]) >= threshold * np.maximum(weight[0][:, None], weight[1][None, :])
    rows, columns = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
    if not len(rows):
        return []
    share = np.zeros(maybe.shape)
    share[np.ix_(rows, columns)] = _overlaps([low[i] for i in rows], [high[j] for j in columns]) / both[np.ix_(rows, columns)]
    maybe &= share >= threshold / (1 + threshold) * 0.999  # single precision
    found = []
    low_side, high_side = low_side.copy(), high_side.copy()
    for i in np.flatnonzero(maybe.any(axis=1)).tolist():
        while len(left := np.flatnonzero(maybe[i] & (high_side != low_side[i]))):
            j = int(left[np.argmax(share[i, left])])
            maybe[i, j] = False
            if darts.similarity(low[i], high[j]) >= threshold:
                found.append((i, j))
                old, new = high_side[j], low_side[i]
                low_side[low_side == old] = new
                high_side[high_side == old] = new
    return found


def _settle(group: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Links a, b between the rows of a bucket that are apart from its leader (n_apart) and all others in group that
    are on another side and, by their distances from the leader (d), could be near.

    Rows that are apart and rows that aren't are dealt to tiles by a hash. Each two tiles of which one holds rows
    that are apart are a task's work, and so is one such tile with itself: a row is sent as often as there are tiles
    to meet, and no task holds more than two tiles. The same rows, met in several bands, are settled once."""
    reach = 1.0 - threshold + 1e-12
    mine = F.struct(F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b"), F.count(F.lit(1)).alias("n"))
    count = lambda x: F.greatest(F.ceil(F.count_if(x) / TILE), F.ceil(F.sum(F.when(x, F.col("size")).otherwise(0)) / TILE_CELLS)).cast("int")
    once = group.groupBy("band", "key").agg(mine.alias("of"), count(F.col("apart")).alias("n_apart"), count(~F.col("apart")).alias("n_rest"))
    once = once.groupBy("of").agg(F.min(F.struct("band", "key", "n_apart", "n_rest")).alias("one")).select("one.*")
    spot = F.xxhash64("node", F.lit(2))
    tile = F.when(F.col("apart"), F.pmod(spot, "n_apart")).otherwise(F.col("n_apart") + F.pmod(spot, F.greatest("n_rest", F.lit(1)))).cast("int")
    others = F.when(F.col("apart"), F.col("n_apart") + F.col("n_rest")).otherwise(F.col("n_apart"))
    dealt = group.join(once, ["band", "key"]).withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    dealt = dealt.select("band", "key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "text_hash", "side", "d")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        tile, node, side, d = (rows.column(x).to_numpy() for x in ("tile", "node", "side", "d"))
        own = [darts.unpack(x) for x in rows.column("cells").to_pylist()]
        low = np.flatnonzero(tile == tile.min())
        high = np.flatnonzero(tile == tile.max())
        found = []
        if rows.column("low")[0].as_py() == rows.column("high")[0].as_py() or tile.min() != tile.max():
            maybe = np.abs(d[low][:, None] - d[high][None, :]) <= reach
            found = _connect([own[i] for i in low], [own[j] for j in high], side[low], side[high], maybe, threshold)
        return pa.table({"a": pa.array([node[low[i]] for i, _ in found], pa.int64()), "b": pa.array([node[high[j]] for _, j in found], pa.int64())})

    return dealt.join(cells, "text_hash").groupBy("band", "key", "low", "high").applyInArrow(run, "a bigint, b bigint")


def _apart(group: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """What links leave of group(band, key, node, text_hash, size, leader, d): side, the row's component by the
    links, and whether that is apart from the leader's. Buckets of which nobody could still be linked go, as do
    rows that are on the leader's side and, by their distances from it, not near anyone apart."""
    reach = 1.0 - threshold + 1e-12
    label = components(links)
    sided = group.join(label, "node", "left").withColumn("side", F.coalesce("label", "node")).drop("label")
    sided = sided.join(label.select(F.col("node").alias("leader"), "label"), "leader", "left").withColumn("apart", F.col("side") != F.coalesce("label", "leader")).drop("label")
    apart = F.col("apart")
    gap = sided.groupBy("band", "key").agg(F.min(F.when(apart, F.col("d"))).alias("gap"))
    left = sided.join(gap.where("gap is not null"), ["band", "key"]).where(apart | (F.col("gap") <= F.col("d") + reach)).drop("gap")
    more = left.groupBy("band", "key").agg(F.min("side").alias("low"), F.max("side").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    return cut(left.join(more.select("band", "key", "n"), ["band", "key"]))


def _links(docs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame | None:
    """Links a, b between nodes: enough of those at the threshold or above to connect all that a band brings together.

    In each bucket one leader is compared with all others. It is the row whose buckets, of all bands, have most rows
    together: the text that most others are copies of, so that most are near it, and so that the buckets of a large
    class have one leader and each of their rows is measured once. By the triangle inequality of the
    distance 1 - similarity, a member whose distance from the leader is d can only be near members from
    d - (1 - threshold) to d + (1 - threshold). Members connected to the leader, in whatever bucket, stay only if
    someone who isn't is within that reach of them. All that are apart are then compared with all that is left, in
    tiles: first in small rests, then in large ones (GROUP_ROWS), where fewer are apart by then. So no link that
    matters is lost, and the steps are as many whatever a bucket's size and however little its rows have in common.
    """
    spread = nodes.select("node", "text_hash", "size", F.posexplode("bands").alias("band", "key"))
    common = spread.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    group = cut(spread.join(common, ["band", "key"]))
    if group.isEmpty():
        return None
    cells = cut(_cells_of(docs, group.select("text_hash")))
    lead = group.join(group.groupBy("node").agg(F.sum("n").alias("rank")), "node").groupBy("band", "key").agg(F.max(F.struct("rank", (-F.col("node")).alias("first"), "text_hash")).alias("one"))
    lead = lead.select("band", "key", (-F.col("one.first")).alias("leader"), F.col("one.text_hash").alias("leader_hash"))
    others = group.drop("n").join(lead, ["band", "key"]).where("node <> leader")
    pairs = others.select(F.col("node").alias("a"), F.col("text_hash").alias("a_hash"), F.col("leader").alias("b"), F.col("leader_hash").alias("b_hash")).distinct()
    sims = cut(_measure(pairs, cells))
    links = sims.where(F.col("sim") >= threshold).select("a", "b")
    far = others.join(sims, (F.col("node") == F.col("a")) & (F.col("leader") == F.col("b"))).select("band", "key", "node", "text_hash", "size", "leader", (1 - F.col("sim")).alias("d"))
    rest = _apart(far, links, threshold)
    large = rest.where(F.col("n") > GROUP_ROWS).drop("side", "apart", "n")
    small = rest.where(F.col("n") <= GROUP_ROWS)
    if not small.isEmpty():
        links = links.unionByName(cut(_settle(small, cells, threshold)))
    if not large.isEmpty():
        links = links.unionByName(cut(_settle(_apart(large, links, threshold), cells, threshold)))
    return links


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for every node of links(a, b).

    Labels spread to neighbours and are then replaced by their own labels, until none changes."""
    edges = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        told = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        near = labels.join(told, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = near.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        jump = cut(jump)
        labels = jump.select("node", "label")
        if jump.where("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Every row of docs(doc_id, text, ...) with its class of near-duplicates.

    Returns doc_id, class_id (the smallest doc_id of the class), class_size, kept (one row of a class), _row and text_hash.
    Similarity is the weighted Jaccard similarity of the counts of five-word shingles. Rows are in one class
    if links of at least the threshold connect them; candidates come from the bands (a pair at 0.8 is missed
    with a chance of about 3 in 100,000), and every link is verified exactly.

    Texts with equal shingle counts are one node from the start, so thousands of copies are one row in the
    bands. Texts without words are near their equals alone; null counts as empty. Null ids count as larger than all others; a class
    of null ids has a null class_id. Rows that repeat are members of one class, and one of them is kept.
    Other columns are ignored; an empty table gives an empty result.
    """
    signed = cut(_sign(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    nodes = cut(signed.groupBy("fp1", "fp2").agg(F.min("_row").alias("node"), first.alias("first"), F.count(F.lit(1)).alias("rows"), F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    links = _links(docs, nodes, threshold)
    if links is None:
        classes = nodes.select("fp1", "fp2", F.col("first.doc_id").alias("class_id"), F.col("rows").alias("class_size"), F.col("first._row").alias("keep"))
    else:
        labelled = nodes.select("fp1", "fp2", "node", "first", "rows").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
        whole = labelled.groupBy("label").agg(F.min("first").alias("best"), F.sum("rows").alias("class_size"))
        classes = labelled.join(whole, "label").select("fp1", "fp2", F.col("best.doc_id").alias("class_id"), "class_size", F.col("best._row").alias("keep"))
    return signed.select("_row", "doc_id", "text_hash", "fp1", "fp2").join(classes, ["fp1", "fp2"]).select("doc_id", "class_id", "class_size", (F.col("_row") == F.col("keep")).alias("kept"), "_row", "text_hash")


def drop_near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class; all columns stay. docs must give the same rows in the same
    partitions each time it is read, as tables do; if it does not, the run ends with an error."""
    return drop_rows(docs, near_duplicates(docs, threshold).where("not kept").select("_row", "text_hash"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, class size and survivor of every document."""
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text")).drop("_row", "text_hash")
