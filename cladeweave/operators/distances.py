"""Pairwise distances of aligned sequences, outliers and the saturation slope.

All pairs of a marker are needed, so they are computed in Arrow tasks over blocks of sequences: a task
holds two blocks of at most ``block`` sequences as byte matrices, whatever the marker's size is.  One matrix product
gives all counts of a pair packed into a number, and distances are looked up by it.  They leave a task as arrays of some hundred
sequences against a block, and become rows where no row is copied between processes.  Outliers and the
slope take only what the tasks add up (``pair_sums``): rows in proportion to sequences, not to pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeweave.operators.lineage import cut

_CODE = np.full(256, 9, dtype=np.int8)
_CODE[[65, 71, 67, 84]] = (0, 1, 2, 3)  # A G | C T: transitions stay within a half
_CODE[[97, 103, 99, 116]] = (0, 1, 2, 3)
#: For each code: valid, purine or not, first or second of its class, and their product; equal bases have product 4, others 0.
_PLANES = np.zeros((4, 10), dtype=np.float32)
_PLANES[:, :4] = ((1, 1, 1, 1), (1, 1, -1, -1), (1, -1, 1, -1), (1, -1, -1, 1))
#: Cells of a side of a pair of blocks.
BLOCK_CELLS = 1 << 25
#: Sequences of a side that are compared with the other side at a time.
STEP = 128
#: Sums of single-precision products below it are exact.
_EXACT = 1 << 24
#: Entries of a table of distances by packed counts; beyond it distances are computed pair by pair.
_TABLE = 1 << 21


def _counts(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Valid sites, transitions and transversions of every pair of rows; columns count by their weights."""
    hot = lambda m: [(m == k).astype(np.float32) for k in range(4)]
    a, b = hot(x), hot(y)
    if weights is not None:
        a = [m * weights for m in a]
    same = sum(a[k] @ b[k].T for k in range(4))
    purine = (a[0] + a[1]) @ (b[0] + b[1]).T + (a[2] + a[3]) @ (b[2] + b[3]).T
    valid = sum(a) @ sum(b).T
    return valid, purine - same, valid - purine


def placed(aln: DataFrame, block: int) -> DataFrame:
    """``marker, lo, hi, side, ord, seq``: every sequence once for each pair of blocks that it is in, sorted in its task.

    Blocks of long sequences are smaller, so that a side has at most ``BLOCK_CELLS`` cells (or one sequence).
    """
    aln = cut(aln.select("marker", "ord", "seq"))
    most = F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_CELLS) / F.greatest(F.lit(1), F.coalesce(F.max(F.length("seq")), F.lit(1))))))
    sizes = aln.groupBy("marker").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    known = aln.join(sizes, "marker").withColumn("own", F.pmod(F.xxhash64("ord"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = known.select("marker", "ord", "seq", "own", other.alias("b")).select(
        "marker", "ord", "seq", F.least("own", "b").alias("lo"), F.greatest("own", "b").alias("hi"), (F.col("own") > F.col("b")).cast("int").alias("side")
    )
    # By number: few bytes of sequences are many pairs, and partitions merged by bytes would leave cores idle.
    partitions = int(aln.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("marker", "lo", "hi", "side", "ord", "seq").repartition(partitions, "marker", "lo", "hi")
    return ordered.sortWithinPartitions("marker", "lo", "hi", "side", "ord")


def pairs_of(key: tuple, rows: list[tuple], weights: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """``ord_i, ord_j`` and the counts of the pairs of two blocks (or of one with itself), some hundred sequences at a time."""
    (_, lo, hi), sides = key, [r[0] for r in rows]
    width = max(len(r[2]) for r in rows)
    codes = np.stack([np.pad(_CODE[np.frombuffer(r[2].upper().encode(), np.uint8)], (0, width - len(r[2])), constant_values=9) for r in rows])
    ords = np.array([r[1] for r in rows])
    one = np.flatnonzero(np.array(sides) == 0)
    two = one if lo == hi else np.flatnonzero(np.array(sides) == 1)
    for at in range(0, len(one), 128):
        part = one[at : at + 128]
        counts = _counts(codes[part], codes[two], None if weights is None else weights[:width])
        i, j = np.repeat(ords[part], len(two)), np.tile(ords[two], len(part))
        keep = i < j if lo == hi else np.ones(len(i), dtype=bool)
        yield np.minimum(i, j)[keep], np.maximum(i, j)[keep], [np.rint(c.ravel()[keep]).astype(np.int64) for c in counts]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Key and rows ``side, ord, seq`` of each pair of blocks."""
    key, rows = None, []
    for b in batches:
        for marker, lo, hi, side, o, seq in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
            if (marker, lo, hi) != key:
                if rows:
                    yield key, rows
                key, rows = (marker, lo, hi), []
            rows.append((side, o, seq or ""))
    if rows:
        yield key, rows


def pair_counts(aln: DataFrame, block: int = 512) -> DataFrame:
    """``marker, ord_i, ord_j, valid, transitions, transversions`` for ``ord_i < ord_j``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches):
            for first, second, counts in pairs_of(key, rows):
                yield pa.record_batch(
                    [pa.array([key[0]] * len(first), pa.string()), pa.array(first), pa.array(second), *map(pa.array, counts)],
                    names=["marker", "ord_i", "ord_j", "valid", "transitions", "transversions"],
                )

    return placed(aln, block).mapInArrow(run, "marker string, ord_i long, ord_j long, valid long, transitions long, transversions long")


def _distances(counts: list[np.ndarray], shape: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K80, K80 with gamma rates and JC69 of counts, as ``distances``; NaN outside the domain of a formula."""
    with np.errstate(divide="ignore", invalid="ignore"):
        valid, transitions, transversions = (c.astype(np.float64) for c in counts)
        p, q = transitions / valid, transversions / valid
        a, b, c = 1 - 2 * p - q, 1 - 2 * q, 1 - 4 * (p + q) / 3
        inside = (a > 0) & (b > 0)
        k80 = np.where(inside, -0.5 * np.log(a) - 0.25 * np.log(b), np.nan)
        gamma = np.where(inside, shape / 2 * (a ** (-1 / shape) + 0.5 * b ** (-1 / shape) - 1.5), np.nan)
        return k80, gamma, np.where(c > 0, -0.75 * np.log(c), np.nan)


def _codes(rows: list[tuple]) -> np.ndarray:
    """Codes of the sequences of rows ``side, ord, seq``, one a row; a character is one cell, and what is missing is not valid."""
    width = max(len(r[2]) for r in rows)
    return _CODE[np.frombuffer("".join(r[2].ljust(width, "-") for r in rows).encode("ascii", "replace"), np.uint8)].reshape(len(rows), width)


class _Packed:
    """Counts of pairs of sequences as one number each: ``valid + base * purine + base ** 2 * same`` sites, or without ``purine``
    (sites with two purines or two pyrimidines), if no transitions are asked for.

    The three counts are sums over the same four products of a cell, so one matrix product gives them all; columns go in slices
    whose products are exact.
    """

    def __init__(self, width: int, transitions: bool):
        self.base = base = max(4, 1 << int(width).bit_length())
        self.parts = 3 if transitions else 2
        self.entries = base**self.parts
        # Slices of columns pack by an own base, so that their sums stay exact.
        whole = self.entries <= _EXACT
        self.slice, self.own = (width, base) if whole else (255, 256)
        if self.entries > 1 << 63:
            raise ValueError(f"sequences of {width} sites are too long to count pairs of")
        one = self.own ** (self.parts - 1) / 4
        two = self.own / 2 if transitions else 0
        self.factors = (1 + two + one, two + one, one, one)

    def fits(self, width: int) -> bool:
        return width <= self.slice

    def right(self, codes: np.ndarray) -> np.ndarray | None:
        """The planes of a side that is used several times, if they are one slice."""
        return self._planes(codes, (1, 1, 1, 1)).T.copy() if codes.shape[1] <= self.slice else None

    def counts(self, one: np.ndarray, two: np.ndarray, right: np.ndarray | None, weights: np.ndarray | None = None) -> np.ndarray:
        """Packed counts of all rows of ``one`` with all rows of ``two``, whose planes may be there already; columns of one slice may have weights."""
        if right is not None:
            left = self._planes(one, self.factors)
            if weights is not None:
                left *= np.tile(weights, 4)
            return (left @ right).astype(np.int32)
        total = np.zeros((len(one), len(two)), dtype=np.int64)
        for at in range(0, one.shape[1], self.slice):
            left, right = self._planes(one[:, at : at + self.slice], self.factors), self._planes(two[:, at : at + self.slice], (1, 1, 1, 1))
            found = (left @ right.T).astype(np.int64)
            for k in range(self.parts):
                total += found // self.own**k % self.own * self.base**k
        return total

    def unpack(self, packed: np.ndarray) -> list[np.ndarray]:
        """Valid sites, transitions (without them: zero) and transversions (then: all differences)."""
        packed = packed.astype(np.int64)
        valid, last = packed % self.base, packed // self.base ** (self.parts - 1)
        if self.parts == 2:
            return [valid, np.zeros_like(valid), valid - last]
        purine = packed // self.base % self.base
        return [valid, purine - last, valid - purine]

    @staticmethod
    def _planes(codes: np.ndarray, factors: tuple) -> np.ndarray:
        return np.concatenate([(plane * np.float32(f))[codes] for plane, f in zip(_PLANES, factors, strict=True)], axis=1)


def packed_parts(codes: np.ndarray, ords: np.ndarray, sides: np.ndarray, same: bool, transitions: bool, weights: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, _Packed]]:
    """Of two blocks (or one with itself, then in the order of ``ord``): ``ord`` of some rows and of columns, and their packed counts.

    A block with itself has only the columns from the first of these rows on.  Columns of ``codes`` count by their ``weights``.
    """
    one = np.flatnonzero(sides == 0)
    two = one if same else np.flatnonzero(sides == 1)
    if not len(one) or not len(two):
        return
    packing = _Packed(codes.shape[1] if weights is None else int(weights.sum()), transitions)
    if weights is not None:
        if packing.fits(int(weights.sum())):
            codes, weights = codes[:, weights > 0], weights[weights > 0].astype(np.float32)
        else:  # slices hold columns, not weights
            codes, weights = np.repeat(codes, weights, axis=1), None
    right = packing.right(codes[two])
    for at in range(0, len(one), STEP):
        part, start = one[at : at + STEP], at if same else 0
        yield ords[part], ords[two[start:]], packing.counts(codes[part], codes[two[start:]], None if right is None else right[:, start:], weights), packing


def _packed_pairs(key: tuple, rows: list[tuple], transitions: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, _Packed]]:
    """Of two blocks (or one with itself): ``ord`` of some rows and of all columns, their packed counts, and which pairs are none
    (a block with itself has each pair twice, and sequences with themselves); some hundred sequences at a time."""
    codes, ords, sides = _codes(rows), np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    same = key[1] == key[2]
    one = np.flatnonzero(sides == 0)
    two = one if same else np.flatnonzero(sides == 1)
    if not len(one) or not len(two):
        return
    packing = _Packed(codes.shape[1], transitions)
    right = packing.right(codes[two])
    for at in range(0, len(one), STEP):
        part = one[at : at + STEP]
        yield ords[part], ords[two], packing.counts(codes[part], codes[two], right), ords[part][:, None] == ords[two][None, :] if same else None, packing


@lru_cache(maxsize=4)
def _table(base: int, which: str, shape: float, places: int | None) -> np.ndarray:
    """Distances by packed counts; made in parts, as what they are computed from takes more room."""
    packing, step = _Packed(base - 1, which != "jc69"), 1 << 16
    parts = (np.arange(at, min(at + step, packing.entries)) for at in range(0, packing.entries, step))
    return half_up(np.concatenate([_distances(packing.unpack(x), shape)[_WHICH.index(which)] for x in parts]), places)


def half_up(x: np.ndarray, places: int | None) -> np.ndarray:
    """``x`` rounded as ``pyspark.sql.functions.round`` does: half up, of the decimals that a number is written with; not at all without ``places``."""
    if places is None:
        return x
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.abs(x) * 10.0**places
        down = np.floor(scaled)
        out = np.copysign((down + (scaled - down >= 0.5)) / 10.0**places, x) + 0.0
        # Next to a half, or where a product is too large to tell, decimals decide.
        unsure = np.isfinite(x) & ((np.abs(scaled - down - 0.5) < 1e-3) | (scaled >= 2.0**40))
    step = Decimal(1).scaleb(-places)
    out[unsure] = [float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP, _WIDE)) for v in x[unsure].tolist()]
    return np.where(np.isfinite(x), out, x)


_WHICH = ("k80", "k80_gamma", "jc69")
_WIDE = Context(prec=400)


def looked_up(packing: _Packed, packed: np.ndarray, which: str, shape: float = 1.0, places: int | None = None) -> np.ndarray:
    """Distances by packed counts, rounded to ``places``; NaN outside the domain of a formula."""
    if packing.entries <= _TABLE:
        return _table(packing.base, which, shape, places).take(packed)
    return half_up(_distances(packing.unpack(packed), shape)[_WHICH.index(which)], places)


def pair_distances(aln: DataFrame, which: str, gamma_shape: float = 1.0, block: int = 4096, places: int | None = None) -> DataFrame:
    """``marker, ord_i, ord_j`` and one of ``k80``, ``k80_gamma`` and ``jc69`` for ``ord_i < ord_j``, as ``distances`` gives it.

    With ``places`` distances are rounded where they are looked up: rounding each pair costs more than all else.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches):
            for first, second, packed, packing in packed_parts(*coded(rows), key[1] == key[2], which != "jc69"):
                yield part_of([key[0]], key[1] == key[2], first, second, looked_up(packing, packed, which, gamma_shape, places))

    return one_by_one(placed(aln, block).mapInArrow(run, f"marker string, {PARTS}"), ["marker"], which)


#: Distances of some sequences with others, row by row; ``halved`` if both are of one block.
PARTS = "halved boolean, firsts array<long>, seconds array<long>, found array<double>"


def coded(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, ``ord`` and side of rows ``side, ord, seq``."""
    return _codes(rows), np.array([r[1] for r in rows]), np.array([r[0] for r in rows])


def part_of(keys: list, halved: bool, first: np.ndarray, second: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    """One row: values of key columns (text, then numbers) and ``PARTS``."""
    listed = [pa.ListArray.from_arrays([0, x.size], pa.array(x.ravel(), from_pandas=True)) for x in (first, second, found)]
    typed = [pa.array([k], pa.string() if at == 0 else pa.int64()) for at, k in enumerate(keys)]
    return pa.record_batch([*typed, pa.array([halved]), *listed], names=[*(f"key{at}" for at in range(len(keys))), "halved", "firsts", "seconds", "found"])


def one_by_one(parts: DataFrame, keys: list[str], which: str) -> DataFrame:
    """``ord_i, ord_j`` (``ord_i < ord_j``) and the distance of each pair of ``PARTS``."""
    rows = parts.select(*keys, "halved", "firsts", "seconds", F.size("seconds").alias("n"), F.posexplode("found").alias("k", which))
    named = rows.select(*keys, "halved", F.expr("get(firsts, cast(k div n as int))").alias("first"), F.expr("get(seconds, k % n)").alias("second"), which)
    return named.where("NOT halved OR first < second").select(*keys, F.least("first", "second").alias("ord_i"), F.greatest("first", "second").alias("ord_j"), which)


_SUMS = "marker string, ord long, n long, total double, mean_x double, mean_y double, sxx double, sxy double"


def _totals(first: np.ndarray, second: np.ndarray, jc69: np.ndarray, none: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``ord``, number and total of the defined distances of the rows, and of the columns if they are other sequences."""
    if none is not None:
        jc69[none] = np.nan
    for axis, ords in ((1, first), (0, second))[: 1 if none is not None else 2]:
        total, n = jc69.sum(axis=axis), np.full(len(ords), jc69.shape[axis])
        if np.isnan(total).any():
            total, n = np.nansum(jc69, axis=axis), (~np.isnan(jc69)).sum(axis=axis)
        yield ords, n, total


def _moments(packing: _Packed, number: dict | np.ndarray, shape: float) -> tuple | None:
    """Number, means and centred moments of K80 (x) and K80 with gamma rates (y), from how often packed counts occur."""
    at = np.flatnonzero(number) if isinstance(number, np.ndarray) else np.array(sorted(k for k, v in number.items() if v), dtype=np.int64)
    n = number[at] if isinstance(number, np.ndarray) else np.array([number[k] for k in at.tolist()], dtype=np.int64)
    x, y, _ = _distances(packing.unpack(at), shape)
    both = ~(np.isnan(x) | np.isnan(y))
    x, y, n = x[both], y[both], n[both]
    if not len(n):
        return None
    mx, my = (n * x).sum() / n.sum(), (n * y).sum() / n.sum()
    return int(n.sum()), mx, my, (n * (x - mx) ** 2).sum(), (n * (x - mx) * (y - my)).sum()


def pair_sums(aln: DataFrame, gamma_shape: float = 1.0, block: int = 4096, totals: bool = True, moments: bool = True) -> DataFrame:
    """What outliers (``totals``) and saturation (``moments``) need of all pairs, made where the pairs are: no pair leaves its task.

    Rows with ``ord``: number and total of the JC69 distances of a sequence within a pair of blocks.  Rows without: number,
    means and centred moments of K80 (x) and K80 with gamma rates (y) of the pairs there, from how often each combination of counts occurs.
    """
    names = [x.split()[0] for x in _SUMS.split(", ")]

    def batch(columns: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=names)

    def totals_of(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ords = np.unique([r[1] for r in rows])
        total, number = np.zeros(len(ords)), np.zeros(len(ords), dtype=np.int64)
        for first, second, packed, none, packing in _packed_pairs(key, rows, False):
            jc69 = looked_up(packing, packed, "jc69", gamma_shape)
            for own, n, t in _totals(first, second, jc69, none):
                at = np.searchsorted(ords, own)
                np.add.at(total, at, t)
                np.add.at(number, at, n)
        blank = [None] * len(ords)
        yield batch([[key[0]] * len(ords), ords, number, total, blank, blank, blank, blank])

    def moments_of(key: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        counted: dict | np.ndarray = {}
        packing = None
        for _, _, packed, none, packing in _packed_pairs(key, rows, True):
            if packing.entries <= _TABLE:
                number = np.bincount(packed.ravel(), minlength=packing.entries)
                if none is not None:
                    number -= np.bincount(packed[none], minlength=packing.entries)
                counted = number if isinstance(counted, dict) else counted + number
            else:
                for k, n in zip(*(x.tolist() for x in np.unique(packed if none is None else packed[~none], return_counts=True)), strict=True):
                    counted[k] = counted.get(k, 0) + n
        if packing is None:
            return
        if key[1] == key[2]:  # each pair was met from both ends
            counted = counted // 2 if isinstance(counted, np.ndarray) else {k: n // 2 for k, n in counted.items()}
        if (found := _moments(packing, counted, gamma_shape)) is not None:
            n, mx, my, sxx, sxy = ([v] for v in found)
            yield batch([[key[0]], [None], n, [None], mx, my, sxx, sxy])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches):
            if totals:
                yield from totals_of(key, rows)
            if moments:
                yield from moments_of(key, rows)

    return placed(aln, block).mapInArrow(run, _SUMS)


_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.float64())


def distances(counts: DataFrame, gamma_shape: float = 1.0) -> DataFrame:
    """K80, K80 with gamma rates and JC69; null outside the domain of a formula."""
    p, q = F.col("transitions") / F.nullif("valid", F.lit(0)), F.col("transversions") / F.nullif("valid", F.lit(0))
    a, b, c = 1 - 2 * p - q, 1 - 2 * q, 1 - 4 * (p + q) / 3
    inside = (a > 0) & (b > 0)
    s = gamma_shape
    return counts.select(
        "marker", "ord_i", "ord_j",
        F.when(inside, -0.5 * F.log(a) - 0.25 * F.log(b)).alias("k80"),
        F.when(inside, s / 2 * (F.pow(a, F.lit(-1 / s)) + 0.5 * F.pow(b, F.lit(-1 / s)) - 1.5)).alias("k80_gamma"),
        F.when(c > 0, -0.75 * F.log(c)).alias("jc69"),
    )


def _above_fence(aln: DataFrame, mean: DataFrame, multiplier: float) -> DataFrame:
    fence = mean.groupBy("marker").agg(F.percentile("mean_dist", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    fence = fence.select("marker", (F.col("q")[1] + multiplier * (F.col("q")[1] - F.col("q")[0])).alias("upper_cut"))
    named = aln.select("marker", "ord", "name").join(mean, ["marker", "ord"])
    return named.join(fence, "marker").withColumn("is_outlier", F.col("mean_dist") > F.col("upper_cut"))


def outliers(aln: DataFrame, pairs: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Mean distance of each sequence (its own zero included) and whether it is above the upper fence, from ``distances``."""
    both = pairs.select("marker", F.col("ord_i").alias("ord"), "jc69").union(pairs.select("marker", "ord_j", "jc69"))
    mean = both.groupBy("marker", "ord").agg((F.sum("jc69") / (F.count("jc69") + 1)).alias("mean_dist"))
    return _above_fence(aln, mean, multiplier)


def outliers_of_sums(aln: DataFrame, sums: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """``outliers`` from ``pair_sums``."""
    found = sums.where("ord IS NOT NULL").groupBy("marker", "ord").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    several = aln.groupBy("marker").agg(F.count("*").alias("size")).where("size > 1").select("marker")
    mean = found.join(several, "marker").select("marker", "ord", F.when(F.col("n") > 0, F.col("total") / (F.col("n") + 1)).alias("mean_dist"))
    return _above_fence(aln, mean, multiplier)


def _judged(fit: DataFrame, cutoff: float) -> DataFrame:
    usable = (F.col("n_pairs") >= 5) & (F.col("sxx") > 0)
    slope = F.when(usable, F.col("sxy") / F.col("sxx"))
    return fit.select(
        "marker", "n_pairs", slope.alias("slope"), F.when(usable, slope < cutoff).alias("saturated"),
        F.when(F.col("n_pairs") < 5, "insufficient_data").when(~usable, "regression_failed").otherwise("ok").alias("reason"),
    )


def saturation(pairs: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """Slope of gamma K80 on K80: a proxy, not a published index; from ``distances``."""
    ok = F.col("k80").isNotNull() & F.col("k80_gamma").isNotNull()
    x, y = F.when(ok, F.col("k80")), F.when(ok, F.col("k80_gamma"))
    return _judged(pairs.groupBy("marker").agg(F.count(x).alias("n_pairs"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy")), cutoff)


def saturation_of_sums(aln: DataFrame, sums: DataFrame, cutoff: float = 0.3) -> DataFrame:
    """``saturation`` from ``pair_sums``: moments of all pairs of a marker follow from those of its blocks around their own means."""
    parts = sums.where("ord IS NULL")
    weighted = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    whole = parts.groupBy("marker").agg(F.sum("n").alias("n_pairs"), weighted("mean_x").alias("x"), weighted("mean_y").alias("y"))
    dx, dy = F.col("mean_x") - F.col("x"), F.col("mean_y") - F.col("y")
    moments = parts.join(whole, "marker").groupBy("marker", "n_pairs").agg(F.sum(F.col("sxx") + F.col("n") * dx * dx).alias("sxx"), F.sum(F.col("sxy") + F.col("n") * dx * dy).alias("sxy"))
    several = aln.groupBy("marker").agg(F.count("*").alias("size")).where("size > 1").select("marker")
    return _judged(several.join(moments, "marker", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0))), cutoff)


def decide(stats: DataFrame, slopes: DataFrame, sequences: DataFrame, min_columns: int = 50, min_length: int = 200, min_sequences: int = 100, keep_slope: float = 0.5, max_missing: float = 0.7) -> DataFrame:
    """Keep or reject each marker, with the reasons in a fixed order."""
    df = stats.join(slopes, "marker", "left").join(sequences.groupBy("marker").agg(F.count("*").alias("n_sequences")), "marker", "left")
    slope, text = F.col("slope"), lambda v: f"{v:g}"
    reasons = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.coalesce("saturated", F.lit(False)), "flagged_as_saturated"), F.when(slope.isNull(), "slope_na"), F.when(slope <= keep_slope, f"slope_le_{text(keep_slope)}"),
                F.when(F.col("missing") >= max_missing, f"missing_ge_{text(max_missing)}"), F.when(F.col("var_sites") <= 0, "no_variable_sites"),
                F.when(F.col("aln_len") < min_length, f"aln_len_lt_{min_length}"), F.when(F.col("n_sequences") < min_sequences, f"nseq_lt_{min_sequences}"),
            )
        ),
        ";",
    )
    short = F.col("total_cols") < min_columns
    why = F.when(short, f"alignment_shorter_than_{min_columns}_columns").when(reasons == "", "passed_all_thresholds").otherwise(reasons)
    kept = ~short & (reasons == "")
    return df.select(
        "marker", F.when(short, "skipped_short_alignment").when(kept, "processed_retained").otherwise("processed_rejected").alias("status"), F.when(kept, "YES").otherwise("NO").alias("decision"), why.alias("decision_reason"), "n_sequences", "aln_len", "var_sites"
    )


