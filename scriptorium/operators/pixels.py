"""Image operators as DataFrame plans over a pixel table (img, x, y, v).

One row a pixel, so every operator partitions by image.  Those that look at neighbours
(`by_image`) run the raster kernels in Arrow, an image at a time.  All rounding is half up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import kernels
from ..sources import scratch


def per_image():
    return Window.partitionBy("img")


def by_image(px: DataFrame, kernel, columns: str) -> DataFrame:
    """(img, x, y, ...columns): `kernel` of each whole image, which is put together in one task by one shuffle.

    `kernel` takes a 2-D array and gives {column: 2-D array} and a mask or None; pixels outside the
    mask are left out.  Pixels that the table lacks count as 0 and are not returned.
    """
    kinds = dict(px.dtypes)

    def run(table: pa.Table) -> pa.Table:
        x, y, v = (table[c].to_numpy() for c in ("x", "y", "v"))
        image = np.zeros((int(y.max()) + 1, int(x.max()) + 1), np.uint8)
        image[y, x] = v
        made, keep = kernel(image)
        at = np.flatnonzero(keep[y, x]) if keep is not None else np.arange(len(x))
        out = table.select(["img", "x", "y"]).take(pa.array(at))
        for name, values in made.items():
            out = out.append_column(name, pa.array(values[y[at], x[at]]))
        return out

    schema = f"img {kinds['img']}, x {kinds['x']}, y {kinds['y']}, {columns}"
    return px.select("img", "x", "y", "v").groupBy("img").applyInArrow(run, schema)


def by_group(rows: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """`run` (table to table) of the rows of each key, which one task holds at a time.

    Rows are sorted by key within their tasks and cut in Arrow, many groups a batch, so a small group
    does not cost a round trip of its own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # pieces of the group that may go on
        last = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            change = np.zeros(len(table), bool)
            for k in keys:
                c = table[k].combine_chunks()
                change[1:] |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
            starts = [0, *np.flatnonzero(change).tolist(), len(table)]
            done: list[pa.Table] = []
            for a, b in zip(starts, starts[1:]):
                part = table.slice(a, b - a)
                if a == 0:
                    key = tuple(table[k][0].as_py() for k in keys)
                    if held and key != last:
                        done.append(run(pa.concat_tables(held).combine_chunks()))
                        held = []
                    held.append(part)
                else:
                    done.append(run(pa.concat_tables(held).combine_chunks() if len(held) > 1 else held[0]))
                    held = [part]
            last = tuple(table[k][len(table) - 1].as_py() for k in keys)
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if held:
            yield from run(pa.concat_tables(held).combine_chunks()).to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(cut, schema)


#: Side of the tiles that large images are cut into.
TILE = 512


def by_tile(px: DataFrame, kernel, columns: str, halo: int, tile: int = TILE) -> DataFrame:
    """As `by_image` without a mask, for images of any size: a task holds a tile and the `halo` pixels
    around it, which are all that the kernel may look at.  At the border of the image there are none,
    so a kernel that repeats edges repeats those of the image.
    """
    kinds = dict(px.dtypes)
    size = px.groupBy("img").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    near = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int"))
    dealt = px.select("img", "x", "y", "v", near("x").alias("_xs"), near("y").alias("_ys"))
    dealt = dealt.withColumn("_tx", F.explode("_xs")).withColumn("_ty", F.explode("_ys")).drop("_xs", "_ys").join(size, "img")

    def run(table: pa.Table) -> pa.Table:
        x, y, v = (table[c].to_numpy() for c in ("x", "y", "v"))
        tx, ty, w, h = (table[c][0].as_py() for c in ("_tx", "_ty", "_w", "_h"))
        left, top = max(tx * tile - halo, 0), max(ty * tile - halo, 0)
        image = np.zeros((min((ty + 1) * tile + halo, h) - top, min((tx + 1) * tile + halo, w) - left), np.uint8)
        image[y - top, x - left] = v
        at = np.flatnonzero((x // tile == tx) & (y // tile == ty))
        out = table.select(["img", "x", "y"]).take(pa.array(at))
        for name, values in kernel(image)[0].items():
            out = out.append_column(name, pa.array(values[y[at] - top, x[at] - left]))
        return out

    inside = (F.col("_tx") >= 0) & (F.col("_ty") >= 0) & (F.col("_tx") * tile < F.col("_w")) & (F.col("_ty") * tile < F.col("_h"))
    schema = f"img {kinds['img']}, x {kinds['x']}, y {kinds['y']}, {columns}"
    return by_group(dealt.where(inside), ["img", "_tx", "_ty"], run, schema)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def grayscale(rgb: DataFrame) -> DataFrame:
    """(img, x, y, v) from (img, x, y, r, g, b)."""
    return rgb.select("img", "x", "y", half_up(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).cast("int").alias("v"))


def stretch(px: DataFrame) -> DataFrame:
    """Contrast stretched to 0..255; an image of one value is unchanged."""
    lo, hi = F.min("v").over(per_image()), F.max("v").over(per_image())
    v = F.when(lo == hi, F.col("v")).otherwise(half_up((F.col("v") - lo) / F.nullif(hi - lo, F.lit(0)) * 255))
    return px.withColumn("v", v.cast("int"))


def histogram(px: DataFrame) -> DataFrame:
    """(img, v, n) with all 256 values."""
    bins = px.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("v"))
    return bins.join(px.groupBy("img", "v").agg(F.count("*").alias("n")), ["img", "v"], "left").fillna(0, ["n"])


def histogram_stats(px: DataFrame) -> DataFrame:
    return px.groupBy("img").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("stddev"), F.median("v").alias("median"))


def otsu(px: DataFrame) -> DataFrame:
    """(img, threshold): greatest between-class variance, midpoint of ties, 128 if there is none."""
    counts = px.groupBy("img", "v").agg(F.count("*").alias("n"))
    spine = counts.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("t"))
    counts = spine.join(counts.withColumnRenamed("v", "t"), ["img", "t"], "left").fillna(0, ["n"])
    below = per_image().orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    c = counts.select(
        "img",
        "t",
        F.coalesce(F.sum("n").over(below), F.lit(0)).alias("w0"),
        F.coalesce(F.sum(F.col("n") * F.col("t")).over(below), F.lit(0)).alias("s0"),
        F.sum("n").over(per_image()).alias("w"),
        F.sum(F.col("n") * F.col("t")).over(per_image()).alias("s"),
    )
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    between = F.when((F.col("w0") > 0) & (w1 > 0), F.col("w0") / F.col("w") * (w1 / F.col("w")) * gap * gap).otherwise(0.0)
    best = c.withColumn("between", between).withColumn("top", F.max("between").over(per_image()))
    ties = best.groupBy("img").agg(
        F.min(F.when((F.col("top") > 0) & (F.col("between") == F.col("top")), F.col("t"))).alias("a"),
        F.max(F.when((F.col("top") > 0) & (F.col("between") == F.col("top")), F.col("t"))).alias("b"),
    )
    return ties.select("img", F.coalesce(half_up((F.col("a") + F.col("b")) / 2), F.lit(128)).cast("int").alias("threshold"))


def binarize(px: DataFrame, multiplier: float = 1.0) -> DataFrame:
    return px.join(otsu(px), "img").select("img", "x", "y", F.when(F.col("v") >= F.col("threshold") * multiplier, 255).otherwise(0).alias("v"))


def text_as_foreground(px: DataFrame) -> DataFrame:
    """Inverts an image of which more than half is white."""
    white = F.sum((F.col("v") == 255).cast("int")).over(per_image())
    return px.withColumn("v", F.when(white * 2 > F.count("*").over(per_image()), 255 - F.col("v")).otherwise(F.col("v")))


def blur(px: DataFrame, sigma: float = 1.0, tile: int | None = None) -> DataFrame:
    """3 x 3 Gaussian; edges are repeated.  Images larger than a task are cut into tiles of side `tile`."""
    kernel = lambda img: ({"v": kernels.blur(img, sigma).astype(np.int32)}, None)
    return by_tile(px, kernel, "v int", 1, tile) if tile else by_image(px, kernel, "v int")


def median(px: DataFrame, size: int = 3, tile: int | None = None) -> DataFrame:
    kernel = lambda img: ({"v": kernels.median(img, size).astype(np.int32)}, None)
    return by_tile(px, kernel, "v int", size // 2, tile) if tile else by_image(px, kernel, "v int")


def _resample(px: DataFrame, to_source, background: int) -> DataFrame:
    """Each pixel gets the value of the source pixel that `to_source(x, y, cx, cy)` names."""
    sized = px.withColumns({"cx": (F.max("x").over(per_image()) + 1) / 2, "cy": (F.max("y").over(per_image()) + 1) / 2})
    sx, sy = to_source(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
    at = sized.select("img", "x", "y", half_up(sx).cast("int").alias("sx"), half_up(sy).cast("int").alias("sy"))
    source = px.select("img", F.col("x").alias("sx"), F.col("y").alias("sy"), "v")
    return at.join(source, ["img", "sx", "sy"], "left").select("img", "x", "y", F.coalesce("v", F.lit(background)).alias("v"))


def rotate(px: DataFrame, degrees: float, background: int = 255) -> DataFrame:
    a = F.radians(F.lit(-degrees))
    c, s = F.cos(a), F.sin(a)
    return _resample(px, lambda x, y, cx, cy: (cx + (x - cx) * c - (y - cy) * s, cy + (x - cx) * s + (y - cy) * c), background)


def scale(px: DataFrame, factor: float, background: int = 255) -> DataFrame:
    return _resample(px, lambda x, y, cx, cy: (cx + (x - cx) / factor, cy + (y - cy) / factor), background)


def skew(px: DataFrame, dx: float, dy: float, background: int = 255) -> DataFrame:
    return _resample(px, lambda x, y, cx, cy: (x - dx * ((y - cy) / cy), y - dy * ((x - cx) / cx)), background)


def salt_pepper(px: DataFrame, p: float, seed: int = 0) -> DataFrame:
    """Inverts each pixel with probability `p`, by the MD5 digest of seed, image and place."""
    draw = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("img", "x", "y")])), 1, 8)
    bound = f"{round(p * (1 << 32)):08x}"  # hexadecimal digits of equal length are ordered like their numbers
    return px.withColumn("v", F.when((draw < bound) | F.lit(p >= 1), 255 - F.col("v")).otherwise(F.col("v")))


def crop_foreground(px: DataFrame) -> DataFrame:
    """The box around value 255, moved to the origin; a blank image becomes one black pixel."""
    on = F.col("v") == 255
    box = px.withColumns({n: f(F.when(on, F.col(c))).over(per_image()) for n, f, c in (("x0", F.min, "x"), ("x1", F.max, "x"), ("y0", F.min, "y"), ("y1", F.max, "y"))})
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    blank = F.col("x0").isNull() & (F.col("x") == 0) & (F.col("y") == 0)
    v = F.when(on, 255).otherwise(0)
    return box.where(inside | blank).select("img", (F.col("x") - F.coalesce("x0", F.lit(0))).alias("x"), (F.col("y") - F.coalesce("y0", F.lit(0))).alias("y"), v.alias("v"))


def fit_square(px: DataFrame, size: int = config.CHAR_SIZE) -> DataFrame:
    """Nearest resize that keeps the aspect, centred on black."""
    dims = px.groupBy("img").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    ratio = F.col("w") / F.col("h")
    nw = F.greatest(F.lit(1), F.when(ratio >= 1, size).otherwise(half_up(size * ratio)))
    nh = F.greatest(F.lit(1), F.when(ratio >= 1, half_up(size / ratio)).otherwise(size))
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    grid = dims.withColumns({"nw": nw, "nh": nh}).withColumn("x", F.explode(axis)).withColumn("y", F.explode(axis))
    sx, sy = F.col("x") - F.floor((size - F.col("nw")) / 2), F.col("y") - F.floor((size - F.col("nh")) / 2)
    pick = lambda s, n, m: F.when((s >= 0) & (s < F.col(n)), F.least(F.col(m) - 1, F.floor(s * F.col(m) / F.col(n))))
    grid = grid.select("img", "x", "y", pick(sx, "nw", "w").cast("int").alias("sx"), pick(sy, "nh", "h").cast("int").alias("sy"))
    source = px.select("img", F.col("x").alias("sx"), F.col("y").alias("sy"), "v")
    return grid.join(source, ["img", "sx", "sy"], "left").select("img", "x", "y", F.coalesce("v", F.lit(0)).alias("v"))


def gradient(px: DataFrame) -> DataFrame:
    """(img, x, y, magnitude, angle) by central differences, angle in degrees in [0, 180]."""
    return by_image(px, lambda img: (dict(zip(("magnitude", "angle"), kernels.gradient(img), strict=True)), None), "magnitude double, angle double")


def hog(px: DataFrame, cols: int = config.HOG_GRID_COLS, rows: int = config.HOG_GRID_ROWS, bins: int = config.HOG_BINS, eps: float = config.HOG_EPSILON) -> DataFrame:
    """(img, region, bin, value), zeros left out; regions and bins are counted from 0."""
    g = gradient(px).withColumns({"w": F.max("x").over(per_image()) + 1, "h": F.max("y").over(per_image()) + 1})
    part = lambda p, n, k: F.floor(((F.col(p) + 1) * k - 1) / F.col(n))  # noqa: E731  the last part that begins at or before p
    g = g.withColumn("region", (part("y", "h", rows) * cols + part("x", "w", cols)).cast("int"))
    g = g.withColumn("bin", (half_up(F.col("angle") / (180.0 / bins)) % bins).cast("int"))
    sums = g.groupBy("img", "region", "bin").agg(F.sum("magnitude").alias("m")).where("m > 0")
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("img", "region")) + eps * eps)
    return sums.select("img", "region", "bin", (F.col("m") / norm).alias("value"))


def projections(px: DataFrame) -> DataFrame:
    """(img, axis, at, n): white pixels of each row (axis y) and column (axis x)."""
    white = F.sum((F.col("v") == 255).cast("int")).alias("n")
    one = lambda a: px.groupBy("img", F.col(a).alias("at")).agg(white).select("img", F.lit(a).alias("axis"), "at", "n")
    return one("y").unionByName(one("x"))


def islands(counts: DataFrame, keys: list[str], at: str, least: int) -> DataFrame:
    """Maximal runs of `at` with n >= least: keys, run (from 0), low, high."""
    w = Window.partitionBy(*keys).orderBy(at)
    on = counts.where(F.col("n") >= least).withColumn("island", F.col(at) - F.row_number().over(w))
    found = on.groupBy(*keys, "island").agg(F.min(at).alias("low"), F.max(at).alias("high"))
    return found.withColumn("run", F.row_number().over(Window.partitionBy(*keys).orderBy("low")) - 1).drop("island")


def lines(px: DataFrame, least: int = config.HORIZONTAL_VALLEY_THRESHOLD) -> DataFrame:
    """(img, line, low, high) in y."""
    rows = projections(px).where("axis = 'y'")
    return islands(rows, ["img"], "at", least).select("img", F.col("run").alias("line"), "low", "high")


def components(px: DataFrame) -> DataFrame:
    """(img, x, y, component): 8-connected components of value 255, numbered in raster order."""

    def label(image: np.ndarray):
        return {"component": kernels.components(image).astype(np.int32)}, image == 255

    return by_image(px, label, "component int")


def components_tiled(px: DataFrame, tile: int = TILE) -> DataFrame:
    """As `components`, for images of any size.

    Each tile is labelled in a task of its own.  Only fragments at the seams between tiles can be parts
    of one component: pixels that touch across a seam are their edges, and the components of that
    graph, for one image in one task, name them.  The graph has fewer than 4 edges a seam pixel.
    """
    kinds = dict(px.dtypes)
    on = px.where("v = 255").select("img", "x", "y", F.floor(F.col("x") / tile).cast("int").alias("tx"), F.floor(F.col("y") / tile).cast("int").alias("ty"))

    def label(table: pa.Table) -> pa.Table:
        x, y = table["x"].to_numpy(), table["y"].to_numpy()
        image = np.zeros((int(y.max() - y.min()) + 1, int(x.max() - x.min()) + 1), np.uint8)
        image[y - y.min(), x - x.min()] = 255
        return table.append_column("part", pa.array(kernels.components(image)[y - y.min(), x - x.min()].astype(np.int32)))

    schema = f"img {kinds['img']}, x {kinds['x']}, y {kinds['y']}, tx int, ty int, part int"
    parts = scratch.written(on.groupBy("img", "tx", "ty").applyInArrow(label, schema), "tile-parts")
    node = F.struct("ty", "tx", "part")
    fragments = parts.groupBy("img", node.alias("node")).agg(F.min(F.struct("y", "x")).alias("first"))

    # Pixels of the last column or row of a tile look at their neighbours across the seam.
    right, below = F.col("x") % tile == tile - 1, F.col("y") % tile == tile - 1
    step = lambda dx, dy: F.struct((F.col("x") + dx).cast("int").alias("nx"), (F.col("y") + dy).cast("int").alias("ny"))
    steps = lambda on_seam, *moves: F.when(on_seam, F.array(*[step(*m) for m in moves])).otherwise(F.array().cast("array<struct<nx:int,ny:int>>"))
    across = F.concat(steps(right, (1, -1), (1, 0), (1, 1)), steps(below, (-1, 1), (0, 1), (1, 1)))
    asked = parts.select("img", node.alias("a"), F.inline(across))
    rim = (F.col("x") % tile).isin(0, tile - 1) | (F.col("y") % tile).isin(0, tile - 1)
    seam = parts.where(rim).select("img", F.col("x").cast("int").alias("nx"), F.col("y").cast("int").alias("ny"), node.alias("b"))
    edges = asked.join(seam, ["img", "nx", "ny"]).where("a <> b").select("img", "a", "b").distinct()
    named = scratch.written(_seam_components(edges, kinds["img"]), "tile-seams")
    own = fragments.join(named, ["img", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    order = Window.partitionBy("img").orderBy("first")
    numbers = own.groupBy("img", "root").agg(F.min("first").alias("first")).withColumn("component", F.row_number().over(order) - 1)
    found = own.join(numbers.select("img", "root", "component"), ["img", "root"]).select("img", "node", "component")
    pixels_ = parts.select("img", "x", "y", node.alias("node"))
    return pixels_.join(found, ["img", "node"]).select("img", "x", "y", "component")


def _seam_components(edges: DataFrame, kind: str) -> DataFrame:
    """(img, node, root) of the nodes that have edges (img, a, b): the same root within a component."""
    name = "struct<ty:int,tx:int,part:int>"

    def unite(table: pa.Table) -> pa.Table:
        flat = lambda c: np.stack([table[c].combine_chunks().field(f).to_numpy() for f in ("ty", "tx", "part")], 1)
        nodes, index = np.unique(np.concatenate([flat("a"), flat("b")]), axis=0, return_inverse=True)
        a, b = index.ravel()[: len(table)], index.ravel()[len(table) :]
        root = np.arange(len(nodes))
        while True:  # every node takes the least root of its neighbours, and roots are shortened
            low = np.minimum(root[a], root[b])
            new = root.copy()
            for side in (a, b):
                np.minimum.at(new, side, low)
                np.minimum.at(new, root[side], low)
            while not np.array_equal(shorter := new[new], new):
                new = shorter
            if (new == root).all():
                break
            root = new
        as_struct = lambda m: pa.StructArray.from_arrays([pa.array(m[:, k].astype(np.int32)) for k in range(3)], ["ty", "tx", "part"])
        images = pa.chunked_array([table["img"].combine_chunks().take(pa.array(np.zeros(len(nodes), np.int64)))])
        return pa.table({"img": images, "node": as_struct(nodes), "root": as_struct(nodes[root])})

    return edges.groupBy("img").applyInArrow(unite, f"img {kind}, node {name}, root {name}")


def boxes(parts: DataFrame) -> DataFrame:
    """(img, component, x0, x1, y0, y1, n) of labelled pixels."""
    return parts.groupBy("img", "component").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n")
    )


#: Length of the bins that intervals are dealt to.
BIN = 64


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: int = BIN) -> DataFrame:
    """Pairs of rows that agree in `keys` and whose intervals (low, high), ends included, overlap.

    An interval goes to every bin it touches and meets only those that share one; the pair is kept in
    the first bin that both touch.  `left` and `right` share no columns but `keys`.
    """
    first = lambda c: F.floor(F.col(c) / width)
    bins = lambda df, i: df.withColumn("_bin", F.explode(F.sequence(first(i[0]), first(i[1]))))
    pairs = bins(left, a).join(bins(right, b), [*keys, "_bin"])
    here = F.col("_bin") == F.greatest(first(a[0]), first(b[0]))
    return pairs.where(here & (F.col(b[0]) <= F.col(a[1])) & (F.col(b[1]) >= F.col(a[0]))).drop("_bin")


def line_components(lines_: DataFrame, boxes_: DataFrame, width: int = BIN) -> DataFrame:
    """Lines with the components that overlap them; one component may be in several, a line may have none."""
    pairs = overlapping(lines_, boxes_, ["img"], ("low", "high"), ("y0", "y1"), width)
    none = lines_.join(pairs.select("img", "line").distinct(), ["img", "line"], "left_anti")
    return pairs.unionByName(none, allowMissingColumns=True)


def words(lines_: DataFrame, parts: DataFrame, least: int = config.VERTICAL_VALLEY_THRESHOLD) -> DataFrame:
    """(img, line, word, low, high) in x, over all pixels of a line's components."""
    member = line_components(lines_, boxes(parts)).where("component is not null").select("img", "line", "component")
    columns = member.join(parts, ["img", "component"]).groupBy("img", "line", "x").agg(F.count("*").alias("n"))
    return islands(columns, ["img", "line"], "x", least).select("img", "line", F.col("run").alias("word"), "low", "high")


def word_components(words_: DataFrame, members: DataFrame, width: int = BIN) -> DataFrame:
    """Words with the components of their line that overlap them in x, in reading order."""
    m = members.where("component is not null").select("img", "line", "component", "x0", "x1", "y0", "y1")
    both = overlapping(words_, m, ["img", "line"], ("low", "high"), ("x0", "x1"), width)
    order = Window.partitionBy("img", "line", "word").orderBy("x0", "component")
    return both.withColumn("char", F.row_number().over(order) - 1)


def fit_height(components_: DataFrame, low: int = config.CHAR_MIN_HEIGHT, high: int = config.CHAR_MAX_HEIGHT) -> DataFrame:
    return components_.where((F.col("y1") - F.col("y0") + 1).between(low, high))


def lab_stats(px: DataFrame, least: int = config.HORIZONTAL_VALLEY_THRESHOLD) -> DataFrame:
    """Diagnostics of a binary image: white counts, polarity, skew, valley and text rows, lines."""
    white = F.sum((F.col("v") == 255).cast("int")).alias
    raw = px.groupBy("img").agg(F.count("*").alias("pixels"), white("raw_white"))
    fore = text_as_foreground(px)
    after = fore.groupBy("img").agg(white("white"))
    rows = projections(fore).where("axis = 'y'")
    text = rows.groupBy("img").agg(F.count_if(F.col("n") < least).alias("valley_rows"), F.count_if(F.col("n") >= least).alias("text_rows"))
    runs = lines(fore, least).groupBy("img").agg(F.count("*").alias("line_runs"))
    out = raw.join(after, "img").join(text, "img").join(runs, "img", "left").fillna(0, ["line_runs"])
    share = F.greatest(F.col("white"), F.col("pixels") - F.col("white")) / F.col("pixels")
    return out.withColumns({"inverted": F.col("white") != F.col("raw_white"), "extreme_skew": share > 0.98})
