"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Equal vectors of a label become one row with a weight. A unit vector x is quantised as s q (q in -127..127, one scale a vector), and the length
of what is lost, e = |x - s q|, is stored with it. For two vectors |x.y - s t (q.r)| <= e_x + |s q| e_y, so the int8 product of a pair
says that it surely is a link, surely is none, or is in between; only pairs in between are computed again in double precision.

Vectors of a label (and length) are dealt to blocks of about ``BLOCK`` by a hash; a tile is a pair of blocks, one group of
rows. A tile returns no pairs: for each row that has a link its number of links and the least row of its class within the tile, and
whether one of its pairs is in between. The rows with such a pair, of the tiles where they have it, then meet their full vectors and
settle those pairs in the same way. Counts are added up and the classes of all tiles joined by ``simhash.components``.
Shuffled are the codes (one byte a component) as often as a label has blocks, and full vectors only where pairs are open.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, and one whose label is null, links with nothing and is its own
component; vectors of different lengths never link; repeated rows and ids are vectors of their own; a null id never names a component
(component_id is null if none of its vectors has an id) and isn't kept; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, write_step
from .simhash import components
from .vector_codes import dense

THRESHOLD = 0.93
#: Rows of a block, on average; a tile holds two.
BLOCK = 4096
#: Rows of a tile that are multiplied at once.
STRIP = 512
#: More than what rounding in single precision can add to a product.
SLACK = 1e-5
_TILE = ["label", "dim", "lo", "hi"]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one; by the largest component first, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, their scales, the lengths of what is lost, and the lengths of s q."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None])
    made = q * scale[:, None]
    return q.astype(np.int8), scale, np.sqrt(((x - made) ** 2).sum(1)), np.sqrt((made * made).sum(1))


class Side:
    """One block of a tile: codes and bounds, ready for products."""

    def __init__(self, q: np.ndarray, scale: np.ndarray, lost: np.ndarray, size: np.ndarray):
        exact = np.float32 if 127 * 127 * q.shape[1] < 2**24 else np.float64  # sums of such products are exact integers
        self.q, self.scale, self.lost, self.size = q.astype(exact), scale.astype(np.float32), lost.astype(np.float32), size.astype(np.float32)

    def verdicts(self, other: Side, s: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(sure links, pairs in between) of the rows in s with all rows of the other side."""
        about = ((self.q[s] @ other.q.T) * self.scale[s, None] * other.scale).astype(np.float32)
        bound = self.lost[s, None] + self.size[s, None] * other.lost + np.float32(SLACK)
        sure = about - bound >= threshold
        return sure, (about + bound >= threshold) & ~sure


def local_roots(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least node of each row's and each column's class under the links of a tile."""
    rows, cols = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    sub, a, b = links[np.ix_(rows, cols)], left[rows], right[cols]
    top = np.iinfo(np.int64).max
    while len(rows):
        before = a.sum() + b.sum() if len(a) else 0
        for i in range(0, len(rows), STRIP):
            a[i : i + STRIP] = np.minimum(a[i : i + STRIP], np.where(sub[i : i + STRIP], b, top).min(1))
        for j in range(0, len(cols), STRIP):
            b[j : j + STRIP] = np.minimum(b[j : j + STRIP], np.where(sub[:, j : j + STRIP], a[:, None], top).min(0))
        if a.sum() + b.sum() == before:
            break
    left, right = left.copy(), right.copy()
    left[rows], right[cols] = a, b
    return left, right


def weighted(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the weights that each row and each column is linked to."""
    rows, out = np.flatnonzero(links.any(1)), (np.zeros(len(left)), np.zeros(len(right)))
    for i in range(0, len(rows), STRIP):
        at = rows[i : i + STRIP]
        strip = links[at].astype(np.float64)
        out[0][at] = strip @ right
        out[1][:] += left[at] @ strip
    return tuple(x.astype(np.int64) for x in out)


def _report(key: tuple, links: np.ndarray, open_: np.ndarray, node: list[np.ndarray], weight: list[np.ndarray]) -> pa.Table:
    """The rows of a tile that have a link or a pair in between."""
    n, has = weighted(links, weight[0], weight[-1]), (open_.any(1), open_.any(0))
    roots, blocks = local_roots(links, node[0], node[-1]), (key[2].as_py(), key[3].as_py())
    if len(node) == 1:  # both sides are the same rows, and so are both results
        n, has, roots, blocks = n[:1], has[:1], roots[:1], blocks[:1]
    cols = [np.concatenate(x) for x in (node, n, roots, has, [np.full(len(x), k) for x, k in zip(node, blocks, strict=True)])]
    keep = (cols[1] > 0) | cols[3]
    made = [pa.array(c[keep]) for c in cols]
    keys = [pa.array([key[0].as_py()] * int(keep.sum()), pa.string()), *(pa.array(np.full(int(keep.sum()), k.as_py(), np.int64)) for k in key[1:])]
    return pa.table([*keys, *made], [*_TILE, "node", "links", "root", "open", "block"])


def _sides(t: pa.Table, key: tuple) -> tuple[bool, list[np.ndarray]]:
    lo, hi = key[2].as_py(), key[3].as_py()
    block = t["block"].to_numpy()
    order = np.argsort(t["node"].to_numpy(), kind="stable")
    return lo == hi, [order[block[order] == k] for k in ((lo,) if lo == hi else (lo, hi))]


def _judged(made: list[Side], same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    a, b = made[0], made[-1]
    sure, open_ = (np.zeros((len(a.scale), len(b.scale)), bool) for _ in range(2))
    for i in range(0, len(a.scale), STRIP):
        s = slice(i, min(i + STRIP, len(a.scale)))
        sure[s], open_[s] = a.verdicts(b, s, threshold)
    if same:  # the bound isn't symmetric in its rounding, so one half speaks for both
        return tuple(x | x.T for x in (np.triu(sure, 1), np.triu(open_, 1)))
    return sure, open_


def coarse_tile(threshold: float):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        same, at = _sides(t, key)
        q = np.frombuffer(b"".join(t["q"].to_pylist()), np.int8).reshape(len(t), -1)
        rest = [t[c].to_numpy() for c in ("scale", "lost", "size")]
        sure, open_ = _judged([Side(q[i], *(c[i] for c in rest)) for i in at], same, threshold)
        return _report(key, sure, open_, *([t[c].to_numpy()[i] for i in at] for c in ("node", "weight")))

    return run


def fine_tile(threshold: float):
    """Settles the pairs in between; the same codes give the same pairs as before."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        same, at = _sides(t, key)
        x = unit(np.frombuffer(b"".join(t["u"].to_pylist()), "<f8").reshape(len(t), -1))
        _, open_ = _judged([Side(*(c[i] for c in quantised(x))) for i in at], same, threshold)
        links, (i, j) = np.zeros_like(open_), np.nonzero(np.triu(open_) if same else open_)
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            links[a, b] = np.einsum("ij,ij->i", x[at[0][a]], x[at[-1][b]]) >= threshold
        links = links | links.T if same else links
        return _report(key, links, np.zeros_like(links), *([t[c].to_numpy()[i] for i in at] for c in ("node", "weight")))

    return run


def whole_vectors(table: DataFrame) -> DataFrame:
    """vec_id, label, u (components as little-endian doubles; null if the vector can't link)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, size, whole = dense(b["embedding"])
            ends, flat = np.cumsum(size), flat.astype("<f8") + 0.0
            u = [x.tobytes() if w and (x := flat[e - n : e]).any() else None for e, n, w in zip(ends, size, whole, strict=True)]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array(u, pa.binary())], ["vec_id", "label", "u"])

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return rows.mapInArrow(run, "vec_id long, label string, u binary")


def _codes(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [quantised(unit(np.frombuffer(u.as_buffer(), "<f8")[None, :])) for u in b["u"]]
            cols = [pa.array([m[0].tobytes() for m in made], pa.binary()), *(pa.array([float(m[k][0]) for m in made], pa.float64()) for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([b["node"], b["label"], b["weight"], *cols], ["node", "label", "weight", "q", "scale", "lost", "size"])

    return reps.select("node", "label", "weight", "u").mapInArrow(run, "node long, label string, weight long, q binary, scale double, lost double, size double")


def tiles(codes: DataFrame, block: int = BLOCK) -> DataFrame:
    """The codes once for each tile they belong to: columns of ``codes`` with dim, block, lo, hi."""
    rows = codes.withColumn("dim", F.length("q").cast("long"))
    sizes = rows.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("blocks", F.expr(f"(n + {block - 1}) div {block}"))
    dealt = lookup(rows, sizes, ["label", "dim"], "n", codes.count()).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return dealt.withColumn("other", other).select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).drop("other", "blocks")


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each vector."""
    spark = table.sparkSession
    rows, _ = write_step(whole_vectors(table).withColumns({"h1": F.xxhash64("label", "u"), "h2": F.xxhash64(F.lit(1), "u", "label")}), "vectors")
    linkable = rows.filter(F.col("u").isNotNull() & F.col("label").isNotNull())
    same = linkable.groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("u").alias("u"))
    reps, _ = write_step(same.withColumn("node", F.monotonically_increasing_id()), "distinct")
    codes, codes_at = write_step(_codes(reps), "codes")
    schema = "label string, dim long, lo long, hi long, node long, links long, root long, open boolean, block long"
    coarse, _ = write_step(tiles(codes, block).groupBy(*_TILE).applyInArrow(coarse_tile(threshold), schema), "tiles")
    discard(spark, codes_at)
    open_ = coarse.filter("open").select(*_TILE, "node", "block").join(reps.select("node", "weight", "u"), "node")
    fine, _ = write_step(open_.groupBy(*_TILE).applyInArrow(fine_tile(threshold), schema), "settled")
    found = coarse.filter("links > 0").unionByName(fine).select("node", "links", "root")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    each = reps.select("node", "h1", "h2", "weight", "least").join(links, "node", "left").join(roots, "node", "left")
    each, _ = write_step(each.withColumn("root", F.coalesce("root", "node")), "named")
    least = each.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = lookup(each, least, ["root"], "n", each.count()).withColumn("n_links", F.coalesce("links", F.lit(0).cast("long")) + F.col("weight") - 1)
    linked = lookup(linkable, write_step(named.select("h1", "h2", "weight", "n_links", "component_id"), "names")[0], ["h1", "h2"], "weight", linkable.count())
    alone = rows.filter(F.col("u").isNull() | F.col("label").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
