"""Seeds and similar segments of groups of three or more sequences.

A seed is a word present in every sequence of its group, with one position per
sequence; ``ds[k] = i_1 - i_{k+1}`` and ``a`` is the sum of positions. Groups of
different sizes live in one table, ``(group_id, n_seqs, kmer, idxs, ds, a)``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kmerweave.functions import stats
from kmerweave.functions.coords import to_diagonal_multi
from kmerweave.operators.components import connected_components
from kmerweave.operators.kmers import kmer_scan
from kmerweave.operators.lineage import cut_lineage

# Positions of a list, and seeds that one row becomes.
LIST, RANGE = 512, 1 << 16
# Diagonal dimensions used for tiling; the others are checked pair by pair.
TILED_DIMS = 2
# Stretches of the first sequence, seeds of one that a task gets together, and seeds counted at a time.
TILE, SHARE, ROWS = 1024, 1 << 14, 1 << 12


def ranked_groups(groups: DataFrame, min_size=3) -> DataFrame:
    """Numbers the sequences of each group and drops groups below the minimum."""
    sizes = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_seqs")).where(
        F.col("n_seqs") >= min_size)
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy("ord")) - 1
    return groups.withColumn("rank", rank).join(sizes, "group_id").select(
        "group_id", "n_seqs", "rank", "seq")


def shared_kmers(groups: DataFrame, alphabet, wordlen, mask=()) -> DataFrame:
    """Occurrences of the words that all sequences of a group hold."""
    ranked = ranked_groups(groups)
    kmers = kmer_scan(ranked, alphabet, wordlen, mask, id_cols=("group_id", "n_seqs", "rank"))
    present = (kmers.groupBy("group_id", "n_seqs", "kmer", "rank").agg(F.lit(1).alias("one"))
               .groupBy("group_id", "n_seqs", "kmer").agg(F.count(F.lit(1)).alias("n"))
               .where("n = n_seqs").select("group_id", "kmer"))
    return kmers.join(present, ["group_id", "kmer"], "left_semi")


def position_lists(shared: DataFrame) -> DataFrame:
    """Positions of each word in each sequence of its group, in lists of up to ``LIST``:
    ``(group_id, n_seqs, kmer, rank, list, spots)``."""
    word = ["group_id", "n_seqs", "kmer", "rank"]
    number = F.row_number().over(Window.partitionBy(*word).orderBy("pos")) - 1
    return shared.withColumn("list", F.floor(number / LIST)).groupBy(*word, "list").agg(
        F.array_sort(F.collect_list("pos")).alias("spots"))


def _product(numbers):
    return F.aggregate(numbers, F.lit(1).cast("bigint"), lambda x, y: x * y)


def seeds_multi(groups: DataFrame, alphabet, wordlen, mask=()) -> DataFrame:
    """All N-way seeds. The plan does not depend on how many sequences a group has.

    The seeds of a word are the combinations of its positions, one of each sequence. Combinations of lists of positions
    are blocks, and both blocks and the seeds within a block are numbered like digits of a number with mixed radix: a list
    computes the blocks that it belongs to, and a row the seeds that its numbers stand for. A word with many seeds becomes
    many rows, by block and by range of numbers; none holds more than a list of each sequence.
    """
    lists = position_lists(cut_lineage(shared_kmers(groups, alphabet, wordlen, mask), "shared"))
    word = ["group_id", "n_seqs", "kmer"]
    counts = lists.groupBy(*word, "rank").agg(F.sum(F.size("spots")).alias("n")).groupBy(*word).agg(
        F.array_sort(F.collect_list(F.struct("rank", "n")))["n"].alias("counts"))
    radix = F.transform("counts", lambda n: F.ceil(n / LIST))
    placed = lists.join(counts, word).withColumns({"radix": radix}).withColumns({
        "own": F.get("radix", F.col("rank")), "below": _product(F.slice("radix", F.lit(1), F.col("rank")))})
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), (_product(F.col("radix")) / F.col("own")).cast("bigint") - 1))
    block = F.col("z") % F.col("below") + F.col("below") * (F.col("list") + F.col("own") * F.floor(F.col("z") / F.col("below")))
    # How many positions each list of a block has: LIST, or what is left in the last one.
    sizes = F.expr(f"""aggregate(sequence(0, size(radix) - 1), named_struct('rest', block, 'seeds', 1L), (acc, r) -> named_struct(
      'rest', acc.rest div radix[r], 'seeds', acc.seeds * least({LIST}L, counts[r] - {LIST}L * (acc.rest % radix[r]))), acc -> acc.seeds)""")
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("seeds") - 1) / RANGE)))
    rows = placed.withColumn("z", other).withColumn("block", block).withColumn("seeds", sizes).withColumn("part", parts)
    combined = rows.groupBy(*word, "block", "part").agg(
        F.array_sort(F.collect_list(F.struct("rank", "spots")))["spots"].alias("lists"), F.first("seeds").alias("seeds"))
    number = F.explode(F.sequence(F.col("part") * RANGE, F.least(F.col("seeds"), (F.col("part") + 1) * RANGE) - 1))
    idxs = F.expr("""aggregate(lists, named_struct('rest', number, 'idxs', cast(array() as array<int>)), (acc, x) -> named_struct(
      'rest', acc.rest div size(x), 'idxs', concat(acc.idxs, array(x[cast(acc.rest % size(x) as int)]))), acc -> acc.idxs)""")
    seeds = combined.withColumn("number", number).select(*word, idxs.alias("idxs"))
    ds, a = to_diagonal_multi("idxs")
    return seeds.withColumn("ds", ds).withColumn("a", a)


def in_bands_multi(ds_band=None, a_band=None):
    """Predicate for closed bands; ``None`` leaves a dimension unbounded, and so
    does a dimension that a group does not have."""
    terms = []
    for k, band in enumerate(ds_band or []):
        if band is not None:
            terms.append(F.coalesce(F.get("ds", F.lit(k)).between(*band), F.lit(True)))
    if a_band is not None:
        terms.append(F.col("a").between(*a_band))
    return reduce(lambda x, y: x & y, terms, F.lit(True))


def seed_count_multi(seeds: DataFrame, ds_band=None, a_band=None) -> DataFrame:
    return seeds.groupBy("group_id").agg(
        F.count_if(in_bands_multi(ds_band, a_band)).alias("n_seeds"))


# -- neighbourhoods ----------------------------------------------------------

def _a_radius(length):
    return F.ceil(F.col("n_seqs") * length / 2).cast("int")


def _cell(k, size):
    return F.floor(F.get("ds", F.lit(k)) / size)


def _around(cell):
    return F.explode(F.sequence(cell - 1, cell + 1))


def _within(d_radius):
    return F.forall(F.zip_with("ds", "ds2", lambda x, y: F.abs(x - y)), lambda x: x <= d_radius)


def _paired_neighbors(seeds: DataFrame, d_radius: int) -> DataFrame:
    """Adds ``n_neigh`` to any seeds, with their ``a_r``. An equi-join on tiles of the first diagonals and the
    antidiagonal finds candidates, and counts are combined before they are shuffled."""
    cells = [f"b{k}" for k in range(TILED_DIMS)] + ["ba"]
    here = seeds.select("group_id", "kmer", "idxs", "ds", "a", "a_r", *[
        _cell(k, d_radius).alias(f"b{k}") for k in range(TILED_DIMS)],
        F.floor(F.col("a") / F.col("a_r")).alias("ba"))
    other = here.select("group_id", F.col("ds").alias("ds2"), F.col("a").alias("a2"), *cells)
    for c in cells:
        other = other.withColumn(c, _around(F.col(c)))
    # Cells hold whole seeds only, so equal seeds meet exactly once.
    counts = (here.join(other, ["group_id", *cells])
              .where(_within(d_radius) & (F.abs(F.col("a") - F.col("a2")) <= F.col("a_r")))
              .groupBy("group_id", "kmer", "idxs").agg((F.count(F.lit(1)) - 1).alias("n_neigh")))
    return seeds.join(counts, ["group_id", "kmer", "idxs"])


def _places(seeds: DataFrame) -> DataFrame:
    """The occurrences that seeds are made of: ``(group_id, n_seqs, kmer, rank, pos)``."""
    return seeds.select("group_id", "n_seqs", "kmer", F.posexplode("idxs").alias("rank", "pos")).distinct()


def _incomplete(seeds: DataFrame, places: DataFrame) -> DataFrame:
    """Groups in which a word lacks some combination of its positions, or has one twice, or in which two words share a
    position."""
    word = ["group_id", "kmer"]
    combinations = places.groupBy(*word, "rank").agg(F.count(F.lit(1)).alias("n")).groupBy(*word).agg(
        _product(F.collect_list("n")).alias("all"))
    held = seeds.groupBy(*word).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("idxs").alias("different"))
    lacking = held.join(combinations, word).where("n <> all OR different <> all").select("group_id")
    double = places.groupBy("group_id", "rank", "pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group_id")
    return lacking.unionByName(double).distinct()


class _Boxes:
    """Seeds of a group next to other seeds, from where its words stand. A position holds one word, so a neighbour is known
    by its step along the first sequence, which names its word, and by its offsets from that step in the others."""

    def __init__(self, table: pa.Table, n_seqs: int, d_radius: int, a_radius: int):
        self.n, self.r, self.a_r = n_seqs, d_radius, a_radius
        self.reach = (a_radius + (n_seqs - 1) * d_radius) // n_seqs
        self.pad = self.reach + d_radius
        words = table.column("kmer").combine_chunks().dictionary_encode().indices.to_numpy()
        ranks, spots = table.column("rank").to_numpy(), table.column("pos").to_numpy()
        self.first, self.word_at = [], []
        for rank in range(n_seqs):
            mine = ranks == rank
            low, high = (int(f(spots[mine])) for f in (np.min, np.max))
            held = np.full(high - low + 1, -1, np.int32)
            held[spots[mine] - low] = words[mine]
            self.first.append(low)
            self.word_at.append(held)

    def _word(self, rank: int, spots: np.ndarray) -> np.ndarray:
        at, held = spots - self.first[rank], self.word_at[rank]
        inside = (at >= 0) & (at < len(held))
        return np.where(inside, held[np.where(inside, at, 0)], -1)

    def count(self, idxs: np.ndarray) -> np.ndarray:
        """Seeds in each box, that in its middle included, for rows of positions."""
        found, shifts = np.zeros(len(idxs), np.int64), np.arange(-self.r, self.r + 1)
        for step in range(-self.reach, self.reach + 1):
            word = self._word(0, idxs[:, 0] + step)
            rows = np.flatnonzero(word >= 0)
            fits = []
            for rank in range(1, self.n):
                if not len(rows):
                    break
                there = self._word(rank, idxs[rows, rank, None] + step + shifts) == word[rows, None]
                some = there.any(axis=1)
                rows, fits = rows[some], [x[some] for x in [*fits, there]]
            if len(rows):
                found[rows] += self._combined(fits, step)
        return found

    def _combined(self, fits: list[np.ndarray], step: int) -> np.ndarray:
        """How many choices of one fitting offset a sequence keep the sum of positions within reach."""
        width = 2 * self.r + 1
        ways = np.ones((len(fits[0]), 1), np.int64)
        for there in fits:
            longer = np.zeros((len(ways), ways.shape[1] + width - 1), np.int64)
            for k in np.flatnonzero(there.any(axis=0)):
                longer[:, k:k + ways.shape[1]] += ways * there[:, k, None]
            ways = longer
        sums = np.arange(ways.shape[1]) - (self.n - 1) * self.r + self.n * step
        return ways[:, np.abs(sums) <= self.a_r].sum(axis=1)


def _boxed_neighbors(seeds: DataFrame, places: DataFrame, d_radius: int) -> DataFrame:
    """Adds ``n_neigh`` to seeds with their ``a_r``, where every word has all combinations of its positions. Tasks get the
    seeds of a stretch of the first sequence, or a share of them, and where the words near this stretch stand; seeds do
    not meet each other."""
    out = StructType([*seeds.schema.fields, StructField("n_neigh", LongType())])
    tile = ["group_id", "tile"]
    tiled = seeds.withColumn("tile", F.floor(F.get("idxs", F.lit(0)) / TILE))
    sizes = cut_lineage(tiled.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("parts")), "tiles")
    dealt = tiled.join(F.broadcast(sizes.where("parts > 1")), tile, "left").withColumn(
        "part", F.pmod(F.xxhash64("idxs"), F.coalesce("parts", F.lit(1)))).drop("parts")
    n, pos = F.col("n_seqs"), F.col("pos")
    reach = F.floor((F.col("a_r") + (n - 1) * d_radius) / n)
    near = places.join(seeds.select("n_seqs", "a_r").distinct(), "n_seqs").where("rank = 0").select(
        "group_id", "kmer", F.explode(F.sequence(F.floor((pos - reach) / TILE), F.floor((pos + reach) / TILE))).alias("tile"))
    asked = near.distinct().join(sizes, tile).select(
        "group_id", "kmer", "tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    words = places.select("group_id", "kmer", "rank", "pos").join(asked, ["group_id", "kmer"])

    def count(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.zeros(0, np.int64)
        if left.num_rows:
            n_seqs, a_radius = left.column("n_seqs")[0].as_py(), left.column("a_r")[0].as_py()
            boxes = _Boxes(right, n_seqs, d_radius, a_radius)
            idxs = left.column("idxs").combine_chunks().flatten().to_numpy().reshape(-1, n_seqs).astype(np.int64)
            found = np.concatenate([boxes.count(idxs[k:k + ROWS]) for k in range(0, len(idxs), ROWS)])
        return left.select([f.name for f in out[:-1]]).append_column("n_neigh", pa.array(found - 1, pa.int64()))

    by = [*tile, "part"]
    return dealt.groupBy(*by).cogroup(words.groupBy(*by)).applyInArrow(count, out)


def _counted(seeds: DataFrame, d_radius: int) -> DataFrame:
    places = cut_lineage(_places(seeds), "places")
    incomplete = cut_lineage(_incomplete(seeds, places), "incomplete")
    if incomplete.isEmpty():
        return _boxed_neighbors(seeds, places, d_radius)
    whole = _boxed_neighbors(*(x.join(incomplete, "group_id", "left_anti") for x in (seeds, places)), d_radius)
    return whole.unionByName(_paired_neighbors(seeds.join(incomplete, "group_id", "left_semi"), d_radius))


def score_seeds_multi(seeds: DataFrame, length: int, g_max: float, sensitivity: float,
                      n_letters: int, wordlen: int) -> DataFrame:
    """Adds ``n_neigh`` and ``p``: neighbours of each seed in the N-dimensional box
    and the match probability of a segment centred there. Groups with all seeds of their words, as ``seeds_multi`` finds
    them, are counted from the words' positions; in others, seeds are compared with seeds."""
    return _scored(cut_lineage(seeds, "seeds"), length, g_max, sensitivity, n_letters, wordlen)


def _scored(seeds, length, g_max, sensitivity, n_letters, wordlen) -> DataFrame:
    d_radius = stats.band_radius_value(length, g_max, sensitivity)
    counted = _counted(seeds.withColumn("a_r", _a_radius(length)), d_radius)
    volume = F.pow(F.lit(2.0 * d_radius), (F.col("n_seqs") - 1).cast("double")) * length
    p = stats.match_probability_multi(
        F.col("n_neigh") + 1, volume, length, n_letters, "n_seqs", wordlen)
    return counted.withColumn("p", p)


# -- segments ----------------------------------------------------------------

def _placed(seeds: DataFrame, d_radius: int) -> DataFrame:
    return seeds.withColumn("cell", F.transform("ds", lambda d: F.floor(d / (d_radius + 1)))).withColumn(
        "a_cell", F.floor(F.col("a") / (F.col("a_r") + 1)))


def _cells_of(seeds: DataFrame, d_radius: int, dims: range, **sums) -> tuple[DataFrame, DataFrame]:
    """Seeds by cells no wider than the reach in any dimension, so that all seeds of a cell are neighbours: cells numbered
    by ``u``, with the extents of what they hold, how many seeds these are, and ``sums``; and seeds with their cell's number."""
    cell = ["group_id", "cell", "a_cell"]
    placed = _placed(seeds, d_radius)
    grouped = placed.groupBy(*cell, "n_seqs", "a_r").agg(
        *[f(F.get("ds", F.lit(k))).alias(f"{name}{k}") for k in dims for name, f in (("lo", F.min), ("hi", F.max))],
        F.min("a").alias("a_lo"), F.max("a").alias("a_hi"), F.count(F.lit(1)).alias("n_cell"),
        *[x.alias(name) for name, x in sums.items()])
    side = lambda name: F.slice(F.array(*[F.col(f"{name}{k}") for k in dims]), F.lit(1), F.size("cell"))
    cells = cut_lineage(grouped.select(
        *cell, "n_seqs", "a_r", side("lo").alias("lo"), side("hi").alias("hi"), "a_lo", "a_hi", "n_cell",
        *sums).withColumn("u", F.monotonically_increasing_id()), "cells")
    members = placed.select(*cell, "ds", "a").join(cells.select(*cell, "u"), cell).select("u", "ds", "a")
    return cells, members


def _all(test, *columns):
    return reduce(lambda x, y: x & y, [F.forall(F.zip_with(x, y, test), lambda ok: ok) for x, y in columns])


def _linked_cells(cells: DataFrame, members: DataFrame, d_radius: int) -> DataFrame:
    """Edges ``(u, v)`` that connect what neighbouring seeds connect. Extents decide about most pairs of cells. Where they
    do not, and no other cells connect the two, those seeds are compared that lie within reach of the other cell."""
    keys = ["b0", "b1", "a_cell"]
    box = ["u", "lo", "hi", "a_lo", "a_hi"]
    here = cells.select("group_id", "cell", "a_r", *box, "a_cell", *[F.get("cell", F.lit(k)).alias(f"b{k}") for k in range(2)])
    other = here.select("group_id", *keys, F.col("cell").alias("cell2"), *[F.col(c).alias(f"{c}2") for c in box])
    for c in keys:
        here = here.withColumn(c, _around(F.col(c)))
    far = F.greatest(F.col("a_hi") - F.col("a_lo2"), F.col("a_hi2") - F.col("a_lo"))
    gap = F.greatest(F.col("a_lo2") - F.col("a_hi"), F.col("a_lo") - F.col("a_hi2"))
    above = lambda x, y: x - y <= d_radius
    near = cut_lineage(
        here.join(other, ["group_id", *keys]).where("u < u2").where(
            _all(lambda x, y: F.abs(x - y) <= 1, ("cell", "cell2")) & (gap <= F.col("a_r"))
            & _all(above, ("lo2", "hi"), ("lo", "hi2")))
        .withColumn("sure", (far <= F.col("a_r")) & _all(above, ("hi", "lo2"), ("hi2", "lo"))), "near-cells")
    sure = cut_lineage(connected_components(near.where("sure").select("u", F.col("u2").alias("v"))), "sure-roots")
    root = lambda c: sure.select(F.col("u").alias(c), F.col("root").alias(f"{c}_root"))
    open_ = cut_lineage(near.where("not sure").join(root("u"), "u", "left").join(root("u2"), "u2", "left").where(
        F.coalesce("u_root", "u") != F.coalesce("u2_root", "u2")).select("a_r", *box, *[f"{c}2" for c in box]), "open-cells")

    def within_reach(me, it):
        """Seeds of the cell ``me`` that lie within reach of the extents of ``it``."""
        asked = open_.select(F.col("u").alias("u1"), "u2", "a_r", F.col(f"u{me}").alias("u"), *[
            F.col(f"{c}{it}").alias(c) for c in box[1:]])
        return asked.join(members, "u").where(
            F.col("a").between(F.col("a_lo") - F.col("a_r"), F.col("a_hi") + F.col("a_r"))
            & _all(above, ("lo", "ds"), ("ds", "hi"))).select("u1", "u2", "a_r", "ds", "a")

    left, right = within_reach("", "2"), within_reach("2", "").select("u1", "u2", F.col("ds").alias("ds2"), F.col("a").alias("a2"))
    met = left.join(right, ["u1", "u2"]).where(
        _within(d_radius) & (F.abs(F.col("a") - F.col("a2")) <= F.col("a_r"))).select("u1", "u2").distinct()
    return sure.select("u", F.col("root").alias("v")).unionByName(met.select(F.col("u1").alias("u"), F.col("u2").alias("v")))


def _clip(d, s_len, t_len):
    return F.least(s_len, F.greatest(d, -t_len))


def _seeds_inside(boxes: DataFrame, seeds: DataFrame, d_radius: int, dims: range) -> DataFrame:
    """``n_seeds`` by ``root`` of ``boxes (group_id, root, d_ranges, a_min, a_max)``, for those with any. A cell inside a box
    counts as a whole; only cells that a box cuts have their seeds compared with it."""
    cells, members = _cells_of(seeds, d_radius, dims)
    size = 4 * (d_radius + 1)
    first = F.get("d_ranges", F.lit(0))
    box = ["root", "d_ranges", "a_min", "a_max"]
    covered = boxes.select("group_id", *box, F.explode(F.sequence(
        F.floor(first["lo"] / size), F.floor(first["hi"] / size))).alias("b0"))
    held = _all(lambda x, r: x >= r["lo"], ("lo", "d_ranges")) & _all(lambda x, r: x <= r["hi"], ("hi", "d_ranges"))
    met = _all(lambda x, r: x <= r["hi"], ("lo", "d_ranges")) & _all(lambda x, r: x >= r["lo"], ("hi", "d_ranges"))
    touched = cut_lineage(
        covered.join(cells.select("group_id", "u", "lo", "hi", "a_lo", "a_hi", "n_cell", F.floor(
            F.get("lo", F.lit(0)) / size).alias("b0")), ["group_id", "b0"])
        .where(met & (F.col("a_lo") <= F.col("a_max")) & (F.col("a_hi") >= F.col("a_min")))
        .select(*box, "u", "n_cell", (held & F.col("a_lo").between(F.col("a_min"), F.col("a_max")) & F.col("a_hi").between(
            F.col("a_min"), F.col("a_max"))).alias("whole")), "touched-cells")
    cut = touched.where("not whole").join(members, "u").where(
        _all(lambda d, r: d.between(r["lo"], r["hi"]), ("ds", "d_ranges")) & F.col("a").between(F.col("a_min"), F.col("a_max")))
    return touched.where("whole").select("root", "n_cell").unionByName(cut.select("root", F.lit(1).cast("bigint").alias(
        "n_cell"))).groupBy("root").agg(F.sum("n_cell").alias("n_seeds"))


def similar_segments_multi(groups: DataFrame, alphabet, wordlen, *, k_min: int, p_min: float,
                           g_max: float, sensitivity: float, at_least_one=False,
                           mask=()) -> DataFrame:
    """Similar segments of every group: ``d_ranges`` (array of ``lo, hi`` structs),
    ``a_min``, ``a_max``, ``p``, ``n_seeds``, ``z_h0``, ``z_h1``."""
    n_letters = len(alphabet)
    d_radius = stats.band_radius_value(k_min, g_max, sensitivity)
    seeds = cut_lineage(seeds_multi(groups, alphabet, wordlen, mask), "seeds")
    scored = _scored(seeds, k_min, g_max, sensitivity, n_letters, wordlen)
    good = scored.where(F.col("p") >= p_min)
    if at_least_one:
        cols = [c for c in scored.columns if c != "group_id"]
        best = scored.groupBy("group_id").agg(F.min(F.struct(
            (-F.col("p")).alias("_p"), F.struct("kmer", "idxs").alias("_o"),
            F.struct(*cols).alias("rec"))).alias("best"))
        good = good.unionByName(best.where(-F.col("best._p") < p_min).select("group_id", "best.rec.*"))
    good = cut_lineage(good, "good")
    most = good.agg(F.max("n_seqs")).first()[0] or 2
    dims = range(most - 1)
    cells, members = _cells_of(good, d_radius, dims, p_sum=F.sum("p"), first=F.min(
        F.struct(F.struct("kmer", "idxs").alias("o"), "p", "ds")))
    roots = connected_components(_linked_cells(cells, members, d_radius))
    labelled = cells.join(roots, "u", "left").withColumn("root", F.coalesce("root", "u"))
    merged = labelled.groupBy("group_id", "n_seqs", "a_r", "root").agg(
        *[F.min(F.get("lo", F.lit(k))).alias(f"lo{k}") for k in dims],
        *[F.max(F.get("hi", F.lit(k))).alias(f"hi{k}") for k in dims],
        F.min("a_lo").alias("a_lo"), F.max("a_hi").alias("a_hi"),
        F.sum("p_sum").alias("p_sum"), F.sum("n_cell").alias("n_qualified"),
        F.min("first").alias("first"))
    lens = ranked_groups(groups).groupBy("group_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", F.length("seq").alias("len")))).alias("lens"))

    # Only the first seed of a segment widens the diagonals by the band radius.
    def side(k):
        d0 = F.get("first.ds", F.lit(k))
        s_len, t_len = F.get("lens", F.lit(0))["len"], F.get("lens", F.lit(k + 1))["len"]
        return F.struct(
            _clip(F.least(d0 - d_radius, F.col(f"lo{k}")), s_len, t_len).alias("lo"),
            _clip(F.greatest(d0 + d_radius, F.col(f"hi{k}")), s_len, t_len).alias("hi"))

    total = F.aggregate("lens", F.lit(0).cast("bigint"), lambda acc, x: acc + x["len"])
    boxes = cut_lineage(merged.join(lens, "group_id").select(
        "group_id", "n_seqs", "root",
        F.slice(F.array(*[side(k) for k in dims]), F.lit(1), (F.col("n_seqs") - 1).cast("int")).alias("d_ranges"),
        F.greatest(F.col("a_lo") - F.col("a_r"), F.lit(0)).alias("a_min"),
        F.least(F.col("a_hi") + F.col("a_r"), total).alias("a_max"),
        ((F.col("p_sum") + F.col("first.p")) / (F.col("n_qualified") + 1)).alias("p"),
        "n_qualified"), "boxes")

    counts = _seeds_inside(boxes, seeds.withColumn("a_r", _a_radius(k_min)), d_radius, dims)
    counted = boxes.join(counts, "root", "left").fillna(0, ["n_seeds"])
    volume = (F.col("a_max") - F.col("a_min")).cast("double") * F.aggregate(
        "d_ranges", F.lit(1.0), lambda acc, r: acc * (r["hi"] - r["lo"]))
    length = F.floor((F.col("a_max") - F.col("a_min")) / F.col("n_seqs"))
    z0, z1 = stats.score_num_seeds_multi("n_seeds", volume, length, "p", n_letters, "n_seqs", wordlen)
    return counted.withColumn("z_h0", z0).withColumn("z_h1", z1).drop("root")
