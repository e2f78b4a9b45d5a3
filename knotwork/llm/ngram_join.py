"""N-gram Jaccard join: a blocked sparse product of document by n-gram incidence rows, with size-derived bounds.

1. Every document becomes the sorted set of its shingle hashes. Documents with equal sets are one class.
2. A class indexes only the shingles that the size bound leaves: of n, the first n - ceil(t n) + 1 in a global order
   that puts frequent shingles last. The order comes from a fixed-size table of bucket counts over all documents; any
   order gives the same result, so its collisions cost time only. Two sets of similarity t share an indexed shingle.
3. Classes that share one are compared by bucket histograms of their sets. The L1 distance of histograms never
   exceeds the size of the symmetric difference, so a pair beyond the size-derived bound is discarded exactly.
4. What is left falls into small candidate groups. In each, incidence rows are multiplied block by block: overlap
   counts of a block of rows against all rows not yet reached; pairs below the bound are discarded, the rest link.
   Only a spanning forest of each block is emitted: components and links between components are whole without listing
   all pairs of a group. Groups over a tile fall into tiles by size, and only tiles of fitting sizes are paired.

Rows are named by a hash of doc_id and text, so rows that share a doc_id (or have none) are kept apart and repeated rows
are one. Doc_ids come in at the end: a component is named by its smallest doc_id that is not null.

Set equality, rows and overlaps are told by 64-bit hashes. Defined results: null and empty texts have an empty set and
link with nothing, their component is their own doc_id; fewer words than n form one shingle; repeated rows get the same
verdict; a component of rows without doc_id has none; rows of one doc_id may be in different components; one very long
text is one set, whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, grouped, read, released, sized, small_batches, written
from .words import LOWER, shingle_sets, text_slices

#: Buckets of the frequency table: its size does not depend on the data.
COUNT_BITS = 17
HIST = 64
#: Below a similarity of 0.9 the bound on the symmetric difference is wider, so histograms must be finer to tell sets apart.
WIDE = 512
#: The same for the rows of a candidate group: finer, so closer to the symmetric difference.
FINE = 512
#: A larger group is split into pairs of tiles: of so many histograms, or of rows with so many shingles (8 bytes each) and histograms (as much as FINE // 4 shingles).
TILE, TILE_SHINGLES = 4096, 4_000_000
#: Shingles of one block of the product: bounds its temporary arrays.
BLOCK = 1 << 18


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, data, off in text_slices(texts):
        yield first, *shingle_sets(LOWER[data], off, n)


def frequency_levels(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """For each bucket of shingles, how many doublings its count lies above the mean: a table of fixed size."""

    def count(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            for _, h, _ in _sets(b.column(0), n):
                total += np.bincount((h >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    got = docs.select(text).mapInArrow(released(count), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(1 << COUNT_BITS)
    total[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    mean = max(1.0, total.mean())
    return np.maximum(0, np.ceil(4 * np.log2(np.maximum(total, 1) / mean))).astype(np.uint8)


def buckets_for(percent: int) -> int:
    return HIST if percent >= 90 else WIDE


def profiles(docs: DataFrame, text: str, key: str, n: int, percent: int) -> DataFrame:
    """doc_id, row name, set size, two digests of the set, its histogram and its indexed shingles."""
    levels = frequency_levels(docs, text, n)
    width = buckets_for(percent)

    def run(batches):
        for b in batches:
            ids, names = b.column(0), b.column(1)
            for first, h, at in _sets(b.column(2), n):
                sizes = np.diff(at)
                row = np.repeat(np.arange(len(sizes)), sizes)
                bucket = row * width + (h >> np.uint64(20)).astype(np.int64) % width
                hist = np.minimum(np.bincount(bucket, minlength=len(sizes) * width), 255).astype(np.uint8).tobytes()
                run_sum, run_mix = np.zeros(len(h) + 1, np.uint64), np.zeros(len(h) + 1, np.uint64)
                np.cumsum(h, out=run_sum[1:])
                np.cumsum((h ^ (h >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25), out=run_mix[1:])
                level = levels[(h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
                ordered = h[np.lexsort((h, level, row))].astype(np.int64)
                keep = np.where(sizes > 0, sizes - -(-sizes * percent // 100) + 1, 0)
                index = np.repeat(at[:-1], keep) + np.arange(keep.sum()) - np.repeat(np.cumsum(keep) - keep, keep)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]), pa.int32()), pa.array(ordered[index]))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(sizes)),
                        names.slice(first, len(sizes)),
                        pa.array(sizes.astype(np.int64)),
                        pa.array((run_sum[at[1:]] - run_sum[at[:-1]]).astype(np.int64)),
                        pa.array((run_mix[at[1:]] - run_mix[at[:-1]]).astype(np.int64)),
                        pa.array([hist[i * width : i * width + width] for i in range(len(sizes))], pa.binary()),
                        lists,
                    ],
                    ["doc_id", "row", "n", "d1", "d2", "hist", "index"],
                )

    named = docs.select(F.col(key).cast("long").alias("doc_id"), _row(text, key).alias("row"), text)
    return named.mapInArrow(released(run), "doc_id bigint, row bigint, n bigint, d1 bigint, d2 bigint, hist binary, index array<bigint>")


def _row(text: str, key: str) -> Column:
    """A row's name: null and 0 as doc_id differ, and so do null and empty texts."""
    return F.xxhash64(F.col(key).cast("long"), F.col(key).isNull(), F.col(text))


def least_overlap(a, b, percent: int):
    """Smallest overlap of sets of sizes a and b at which they link."""
    return -(-percent * (a + b) // (100 + percent))


def _forest(n: int, near) -> list[tuple[int, int]]:
    """Edges of a spanning forest of rows 0..n-1; near(i, rest) gives the mask of rest that link with row i."""
    rest, edges = np.arange(n), []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            found = rest[hit].tolist()
            edges += [(i, j) for j in found]
            queue += found
            rest = rest[~hit]
    return edges


def _candidates(percent: int):
    width = buckets_for(percent)

    def run(g: dict) -> list[tuple]:
        ids, first = np.unique(g["rep"], return_index=True)
        if len(ids) < 2:
            return []
        n = g["n"][first]
        hist = np.frombuffer(b"".join(g["hist"][i] for i in first.tolist()), np.uint8).reshape(-1, width).astype(np.int16)

        def near(i, rest):
            both = n[i] + n[rest]
            return np.abs(hist[rest] - hist[i]).sum(1) <= both - 2 * least_overlap(n[i], n[rest], percent)

        return [(int(max(ids[i], ids[j])), int(min(ids[i], ids[j]))) for i, j in _forest(len(ids), near)]

    return run


def _links(k: int, percent: int):
    def run(g: dict) -> list[tuple]:
        ids, first = np.unique(g["rep"], return_index=True)
        if len(ids) < 2:
            return []
        texts = g.pop("text")
        chosen = pa.array([texts[i] for i in first.tolist()], pa.string())
        del texts
        rows = [h[s:e] for _, h, at in _sets(chosen, k) for s, e in zip(at[:-1], at[1:], strict=True)]
        del chosen
        n = np.array([len(r) for r in rows])
        at = np.concatenate([[0], np.cumsum(n)])
        names = np.concatenate(rows)
        names.sort()
        names = names[np.concatenate([[True], names[1:] != names[:-1]])]
        cols = np.empty(at[-1], np.int32)
        hist = np.empty((len(rows), FINE), np.int16)
        for i, r in enumerate(rows):
            cols[at[i] : at[i + 1]] = np.searchsorted(names, r)
            hist[i] = np.minimum(np.bincount((r >> np.uint64(20)).astype(np.int64) % FINE, minlength=FINE), 32767)  # capped counts only lower the distance
        mark = np.zeros(len(names), bool)
        del rows, names

        def near(i, rest):
            """One row of the product with the rows in rest: its overlap counts, less those out of size-derived bounds."""
            fit = []
            for part in np.array_split(rest, -(-len(rest) * FINE // BLOCK)):
                fit.append(np.abs(hist[part] - hist[i]).sum(1) <= n[i] + n[part] - 2 * least_overlap(n[i], n[part], percent))
            out = np.concatenate(fit)
            some = np.flatnonzero(out)
            own = cols[at[i] : at[i + 1]]
            mark[own] = True
            ends = np.cumsum(n[rest[some]])
            for part in np.split(some, np.flatnonzero(np.diff(ends // BLOCK)) + 1) if len(some) else ():
                which = rest[part]
                m = n[which]
                starts = np.cumsum(m) - m
                take = np.repeat(at[which] - starts, m) + np.arange(m.sum())
                overlap = np.add.reduceat(mark[cols[take]], starts, dtype=np.int32)
                out[part] = overlap >= least_overlap(n[i], m, percent)
            mark[own] = False
            return out

        return [(int(max(ids[i], ids[j])), int(min(ids[i], ids[j]))) for i, j in _forest(len(ids), near)]

    return run


def _one_of_each(posted: DataFrame) -> DataFrame:
    """Of shingles with the same classes (near copies share many), the smallest: comparing the classes once is enough.
    Equal lists are told by their length and two 64-bit digests, which Spark sums before the shuffle."""
    digest = [F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("rep")).alias("d1"), F.sum(F.shiftright(F.xxhash64("rep", F.lit(1)), 24)).alias("d2")]
    return posted.groupBy("h").agg(*digest).groupBy("m", "d1", "d2").agg(F.min("h").alias("h")).select("h")


def _band(percent: int) -> Column:
    """Sets that can link have the same or neighbouring bands: a band spans the size bound, a little more for rounding."""
    return F.col("n") if percent >= 100 else F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-9)))


#: Tiles of one band have numbers from the band's times this on.
BAND_TILES = 1 << 32


def _tiled(rows: DataFrame, key: str, weight: Column, tile: int, percent: int, large: DataFrame | None = None) -> DataFrame:
    """Give each pair of tiles (key, i, j) its rows. A key of up to one tile has one pair.

    The rows of a larger key fall into bands of sizes, and those of a band into tiles of about that weight by a hash; a tile
    meets the tiles of its own band and of the next ones, for no others hold a set of fitting size. Keys are weighed by
    plain sums, so a frequent key is never ordered or gathered in one task.
    """
    weighed = rows.withColumns({"_w": weight, "_band": _band(percent)})
    if large is None:
        large = sized(weighed.groupBy(key).agg(F.sum("_w").alias("_w")).where(F.col("_w") > tile).select(key))
    small = weighed.join(large, key, "left_anti").drop("_w", "_band").withColumns({"i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    split = weighed.join(large, key, "left_semi")
    bands = split.groupBy(key, "_band").agg(F.ceil(F.sum("_w") / tile).alias("_t"))
    near = bands.select(key, F.explode(F.array(*[F.struct((F.col("_band") + d).alias("_band"), F.lit(-d).alias("_to"), "_t") for d in (-1, 0, 1)])).alias("_x")).select(key, "_x.*")
    tiles = lambda d: F.max(F.when(F.col("_to") == d, F.col("_t")))
    around = near.groupBy(key, "_band").agg(*[tiles(d).alias(f"_t{d + 1}") for d in (-1, 0, 1)]).where("_t1 IS NOT NULL")
    code = lambda d, k: (F.col("_band") + d) * F.lit(BAND_TILES) + k
    first = lambda d: code(d, F.lit(0).cast("long"))
    others = [F.when(F.col(f"_t{d + 1}") > 0, F.sequence(first(d), first(d) + F.col(f"_t{d + 1}") - 1)).otherwise(F.array().cast("array<bigint>")) for d in (-1, 0, 1)]
    placed = split.join(sized(around), [key, "_band"]).withColumn("_b", code(0, F.pmod(F.xxhash64("rep"), F.col("_t1")))).withColumn("_o", F.explode(F.concat(*others)))
    paired = placed.select(*rows.columns, F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"))
    return small.unionByName(paired)


def jaccard_components(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 3, percent: int = 90, tile: int = TILE, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return _components(docs, text, key, n, percent, tile, tile_shingles).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, text: str, key: str, n: int, percent: int, tile: int, tile_shingles: int) -> DataFrame:
    """One row per document: doc_id, row, n_shingles, component_id, and the row of the component's first document."""
    small_batches(docs.sparkSession)
    all_rows = written(profiles(docs, text, key, n, percent))
    best = F.min(F.struct("row", "hist", "index"))
    grouped_sets = all_rows.where("n > 0").groupBy("d1", "d2", "n").agg(best.alias("r"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("doc"))
    classes = written(grouped_sets.select("d1", "d2", "n", "doc", F.col("r.row").alias("rep"), F.col("r.hist").alias("hist"), F.col("r.index").alias("index")))

    every = classes.select("rep", "n", F.explode("index").alias("h"))
    frequent = sized(every.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > tile).select("h"))
    # Of the classes that share a shingle, those whose next smaller or next larger one is within the size bound.
    by_size = Window.partitionBy("h").orderBy("n", "rep")
    few = every.join(frequent, "h", "left_anti").withColumn("less", F.lag("n").over(by_size)).withColumn("more", F.lead("n").over(by_size))
    few = few.where((F.col("less") * 100 >= F.col("n") * percent) | (F.col("n") * 100 >= F.col("more") * percent))
    posted = written(few.select("h", "rep", "n").unionByName(every.join(frequent, "h", "left_semi").select("h", "rep", "n")))
    chosen = posted.join(_one_of_each(posted), "h", "left_semi")
    listed = _tiled(chosen, "h", F.lit(1), tile, percent, frequent).join(classes.select("rep", "hist"), "rep").select("h", "i", "j", "rep", "n", "hist")
    likely = grouped(listed, ["h", "i", "j"], _candidates(percent), "u bigint, v bigint")
    label = connected_components(likely)

    # Candidates' texts go to their tiles in one shuffle, and their sets are made again there: smaller than sets of all documents.
    wanted = written(label.join(classes.select("rep", "n"), F.col("node") == F.col("rep")).select("component", "rep", "n"))
    tiles = _tiled(wanted, "component", F.col("n") + FINE // 4, tile_shingles, percent).select("component", "i", "j", "rep", "n")
    named = docs.select(_row(text, key).alias("rep"), F.coalesce(text, F.lit("")).alias("text"))
    once = named.join(sized(wanted.select("rep")), "rep", "left_semi").groupBy("rep").agg(F.first("text").alias("text"))  # repeated rows meet here, one from each task
    rows = once.join(tiles, "rep").select("component", "i", "j", "rep", "text")
    links = grouped(rows, ["component", "i", "j"], _links(n, percent), "u bigint, v bigint")
    linked = connected_components(links)
    placed = classes.select("d1", "d2", "n", "doc", "rep").join(linked, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    named_components = placed.groupBy("component").agg(F.min("doc").alias("head"))
    of_class = placed.join(named_components, "component").select("d1", "d2", "n", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("head"))
    out = all_rows.select("doc_id", "row", "n", "d1", "d2").join(of_class, ["d1", "d2", "n"], "left")
    linked_to = lambda name, own: F.when(F.col("n") > 0, F.col(name)).otherwise(F.col(own)).alias(name)
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), linked_to("component_id", "doc_id"), linked_to("head", "row"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """Of each component the document with the smallest doc_id (none last; of several rows of it, the one with the
    smallest hash), repeats of that row included; documents without words stay; columns as they are."""
    gone = _components(docs, text, key, n, percent, TILE, TILE_SHINGLES // 2).where("head <> row").select(F.col("row").alias("_row")).distinct()
    gone = sized(gone)
    return docs.join(gone, _row(text, key) == gone["_row"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
