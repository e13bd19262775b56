import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra.numpy import arrays
from pyspark.sql import functions as F

from scriptorium import config
from scriptorium.functions import kernels as k
from scriptorium.operators import pixels
from scriptorium.plans import debugging, ocr, script
from scriptorium.sources import images, tables


def art(*rows):
    return np.array([[255 if c == "#" else 0 for c in r] for r in rows], np.uint8)


def gray(*v):
    return np.array([v], np.uint8)


def test_grayscale():
    assert k.grayscale(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255]]], np.uint8)).tolist() == [[76, 150, 29]]


def test_stretch():
    assert k.stretch(gray(50, 125, 200)).tolist() == [[0, 128, 255]]
    assert k.stretch(gray(7, 7)).tolist() == [[7, 7]]


def test_otsu():
    assert k.otsu_threshold(gray(0, 0, 100, 200)) == 51
    assert k.otsu_threshold(gray(9, 9, 9)) == 128
    assert k.binarize(gray(0, 0, 100, 200), 2).tolist() == [[0, 0, 0, 255]]


def test_blur_and_median():
    img = np.full((3, 3), 255, np.uint8)
    img[1, 1] = 0
    assert k.blur(img)[1, 1] == 203
    assert np.allclose(k.gaussian_weights()[1], [0.1238, 0.2042, 0.1238], atol=1e-4)
    assert (k.median(img) == 255).all()
    img[1, 1], img[0, 0] = 255, 0
    assert k.median(img)[2, 2] == 255


def test_polarity():
    assert k.text_as_foreground(gray(255, 255, 0)).tolist() == [[0, 0, 255]]
    assert k.text_as_foreground(gray(255, 0)).tolist() == [[255, 0]]


def test_lines_words_and_components():
    two = art(*["##########....", "##########....", "##########...."], "." * 14, "." * 14, *["..############"] * 3, "." * 14, "." * 14)
    assert k.runs((two == 255).sum(1), 10) == [(0, 2), (5, 7)]
    words = art(*["###...###...###....."] * 3)
    assert k.runs((words == 255).sum(0), 2) == [(0, 2), (6, 8), (12, 14)]
    assert k.components(art("#.#", ".#.", "#.#")).max() == 0
    assert k.components(art("#.#.#")).tolist() == [[0, -1, 1, -1, 2]]
    assert k.components(art("#.#", "###")).max() == 0


def test_fit_square():
    out = k.fit_square(np.full((20, 10), 255, np.uint8), 32)
    assert out.shape == (32, 32) and np.flatnonzero(out[0]).tolist() == list(range(8, 24))
    assert k.fit_square(np.array([[255, 0]], np.uint8), 4).tolist() == [[0] * 4, [255, 255, 0, 0], [255, 255, 0, 0], [0] * 4]
    assert k.crop_foreground(art("...", ".#.", "...")).tolist() == [[255]] and k.crop_foreground(art("..")).tolist() == [[0]]


def test_hog():
    vertical = np.zeros((8, 8), np.uint8)
    vertical[:, 4:] = 255
    h = k.hog(vertical, 1, 1, 9)
    assert h.argmax() == 0 and (h > 0).sum() == 1
    y, x = np.mgrid[0:8, 0:8]
    assert k.hog(((y - x) * 10 + 100).astype(np.uint8), 1, 1, 9).argmax() == 7
    assert not k.hog(np.full((8, 8), 9, np.uint8), 1, 1, 9).any() and len(k.hog(vertical)) == 108


def test_neighbours():
    n = k.Neighbours(np.array([[1], [10], [-11]], np.float32), ["A", "B", "B"])
    label, confidence, distances, top = n.predict(np.array([[0]], np.float32))[0]
    assert label == "A" and distances == [1, 10, 11] and confidence == pytest.approx(top[0][1]) and [t[0] for t in top] == ["A", "B"]
    tie = k.Neighbours(np.array([[1], [-1], [1]], np.float32), ["x", "y", "z"], k=1)
    assert tie.predict(np.array([[0]], np.float32))[0][0] == "x"
    assert len(k.Neighbours(np.array([[1]], np.float32), ["a"]).predict(np.array([[3]], np.float32))[0][2]) == 1
    with pytest.raises(ValueError):
        k.Neighbours(np.zeros((0, 2)), [])
    with pytest.raises(ValueError):
        n.nearest(np.zeros((1, 2)))


def test_neighbours_equal_a_plain_scan():
    rng = np.random.default_rng(0)
    x, q = rng.integers(0, 3, (300, 6)).astype(np.float32), rng.integers(0, 3, (50, 6)).astype(np.float32)
    for (ids, d), v in zip(k.Neighbours(x, ["a"] * 300, k=5).nearest(q), q, strict=True):
        plain = np.sqrt(((x.astype(float) - v) ** 2).sum(1))
        assert ids.tolist() == np.lexsort((np.arange(300), plain))[:5].tolist() and np.allclose(d, plain[ids])


def test_distortions():
    img = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert (k.scale(img, 1) == img).all() and (k.rotate(img, 0) == img).all() and (k.skew(img, 0, 0) == img).all()
    turned = k.rotate(img, 90)
    assert turned[2, 2] == img[2, 2] and 255 in turned
    assert (k.salt_pepper(img, 1.0, np.random.default_rng(0)) == 255 - img).all()


def to_rows(spark, img):
    h, w = img.shape
    return spark.createDataFrame([(0, x, y, int(img[y, x])) for y in range(h) for x in range(w)], "img int, x int, y int, v int")


def to_array(df):
    rows = df.collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1), np.int64)
    for r in rows:
        out[r.y, r.x] = r[-1] if "v" not in r else r.v
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_plans_equal_kernels(spark, seed):
    rng = np.random.default_rng(seed)
    img = rng.integers(0, 256, (9, 11)).astype(np.uint8)
    px = to_rows(spark, img).cache()
    for plan, kernel in (
        (pixels.stretch, k.stretch), (pixels.blur, k.blur), (pixels.median, k.median), (pixels.binarize, k.binarize),
        (lambda p: pixels.rotate(p, 12), lambda i: k.rotate(i, 12)), (lambda p: pixels.scale(p, 0.8), lambda i: k.scale(i, 0.8)),
        (lambda p: pixels.skew(p, 1.3, -2.1), lambda i: k.skew(i, 1.3, -2.1)), (lambda p: pixels.fit_square(p, 16), lambda i: k.fit_square(i, 16)),
    ):
        assert (to_array(plan(px)) == kernel(img)).all()
    assert pixels.otsu(px).first().threshold == k.otsu_threshold(img)
    h = np.zeros(4 * 3 * 9)
    for r in pixels.hog(px).collect():
        h[r.region * 9 + r.bin] = r.value
    assert np.allclose(h, k.hog(img), atol=1e-4)
    binary = k.binarize(img)
    got = np.full(binary.shape, -1)
    for r in pixels.components(to_rows(spark, binary)).collect():
        got[r.y, r.x] = r.component
    assert (got == k.components(binary)).all()


@settings(max_examples=40, deadline=None)
@given(arrays(np.uint8, st.tuples(st.integers(1, 9), st.integers(1, 9)), elements=st.sampled_from([0, 255])))
def test_components_by_flood_fill(img):
    h, w = img.shape
    want, n = np.full(img.shape, -1), 0
    for y in range(h):
        for x in range(w):
            if img[y, x] == 255 and want[y, x] < 0:
                todo = [(y, x)]
                want[y, x] = n
                while todo:
                    a, b = todo.pop()
                    for c in range(max(0, a - 1), min(h, a + 2)):
                        for e in range(max(0, b - 1), min(w, b + 2)):
                            if img[c, e] == 255 and want[c, e] < 0:
                                want[c, e] = n
                                todo.append((c, e))
                n += 1
    assert (k.components(img) == want).all()


def drawn_invoice():
    """A page with two bars, far apart, on a line and one diagonal stroke below."""
    img = np.full((140, 240), 230, np.uint8)
    for x in (30, 110):
        img[20:50, x : x + 12] = 20
    for i in range(30):
        img[80 + i, 40 + i : 52 + i] = 20
    return img


def test_image_to_text(spark, tmp_path):
    chars = k.characters(k.preprocess(drawn_invoice()))
    shapes = [(i, label, k.hog(k.fit_square(c["raster"])).tolist()) for i, (label, c) in enumerate((("1", chars[0]), ("7", chars[-1])))]
    model = spark.createDataFrame(shapes, "sample_idx long, label string, descriptor array<float>")
    for name, img in (("drawn", drawn_invoice()), ("blank", np.full((40, 60), 230, np.uint8))):
        (tmp_path / f"{name}.png").write_bytes(tables.png(img.tobytes(), img.shape[1], img.shape[0]))
    (tmp_path / "corrupt.png").write_bytes(b"no image")
    read = images.read_images(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", r"(\w+)\.png$", 1))
    out = {r.path: r for r in ocr.ocr_documents(read, model).collect()}
    assert out["drawn"].raw_text == "1 1\n7" and len(out["drawn"].lines) == 2 and out["drawn"].confidence > 0.9
    assert out["blank"].raw_text == "" and out["blank"].confidence == 0 and out["blank"].lines == []
    assert out["corrupt"].error is not None and out["corrupt"].raw_text is None
    assert out["drawn"].timing.total > 0


def test_component_in_two_lines_counts_in_both():
    img = art("############", "#...........", "############")
    chars = k.characters(img, line_least=10, word_least=1, low=1, high=9)
    assert sorted({c["line"] for c in chars}) == [0, 1]


def test_constants():
    assert len(config.OCR_ALPHABET) == 62 and len(config.AUDIT_ACTIONS) == 14


def test_large_models_are_searched_by_blocks(spark, monkeypatch):
    from scriptorium.operators import knn

    rng = np.random.default_rng(7)
    model = spark.createDataFrame([(i, f"l{i % 5}", rng.random(6).tolist()) for i in range(120)], "sample_idx long, label string, descriptor array<float>")
    asked = spark.createDataFrame([(i, rng.random(6).tolist()) for i in range(40)], "q long, descriptor array<float>")
    rows = lambda: {r.q: (r.label, round(r.confidence, 9), [round(d, 9) for d in r.distances]) for r in knn.predict(asked, model).collect()}
    sent = rows()
    for name, value in (("BROADCAST_VALUES", 1), ("QUERY_ROWS", 16), ("MODEL_ROWS", 50)):
        monkeypatch.setattr(knn, name, value)
    assert knn.collect_model(model) is None and rows() == sent


def test_blocks_that_cannot_hold_a_neighbour_are_not_searched(spark):
    from scriptorium.operators import knn

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 50
    vectors = np.concatenate([centres[k % 40] + rng.normal(size=8) * 0.5 for k in range(2000)]).reshape(-1, 8)
    vectors[:300] = vectors[0]  # copies, which no ring parts
    model = spark.createDataFrame([(i, f"l{i % 5}", v.tolist()) for i, v in enumerate(vectors)], "sample_idx long, label string, descriptor array<float>")
    asked = spark.createDataFrame([(i, (centres[i % 40] + rng.normal(size=8) * 0.5).tolist()) for i in range(80)], "q long, descriptor array<float>")
    plain = lambda df: sorted((r.q, r.rank, r.sample_idx, round(r.distance, 9)) for r in df.collect())
    assert plain(knn.topk(asked, model, 3, block_rows=50)) == plain(knn.topk(asked, model, 3))
    blocks = knn.Blocks(model, 50)
    routed = blocks._routed(asked, 3, False)
    second = blocks.second_round(asked, blocks._searched(routed, 3), 3)
    searched = routed.select("q", "block").union(second.select("q", "block")).collect()
    assert len(searched) == len(set(searched))
    assert len(blocks.rows) >= 40 and blocks.rows.max() <= 400 and blocks.rows.sum() == 2000
    assert len(searched) < 0.35 * 80 * len(blocks.rows)


@pytest.mark.parametrize("tile", [1, 2, 5, 7, 64])
def test_tiles_of_any_size_give_the_same(spark, tile):
    rng = np.random.default_rng(tile)
    spiral = np.zeros((23, 23), np.uint8)
    for k in range(0, 12, 2):  # rings that meet at one corner each
        spiral[k, k : 23 - k] = spiral[22 - k, k : 23 - k] = 255
        spiral[k : 23 - k, k] = spiral[k + 2 : 23 - k, 22 - k] = 255
    images_ = [spiral, np.where(rng.random((19, 31)) < 0.45, 255, 0).astype(np.uint8), np.zeros((9, 9), np.uint8), np.full((12, 5), 255, np.uint8)]
    rows = [(k, x, y, int(v)) for k, m in enumerate(images_) for (y, x), v in np.ndenumerate(m)]
    px = spark.createDataFrame(rows, "img long, x int, y int, v int").repartition(5)
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(pixels.components_tiled(px, tile)) == as_set(pixels.components(px))
    grey = px.withColumn("v", (F.col("v") + F.col("x") * 7 + F.col("y") * 13) % 256).where("img < 2 or x > 1")
    assert as_set(pixels.blur(grey, tile=tile)) == as_set(pixels.blur(grey))
    assert as_set(pixels.median(grey, 5, tile=tile)) == as_set(pixels.median(grey, 5))


@pytest.mark.parametrize("width", [1, 4, 64])
def test_intervals_meet_once_in_a_shared_bin(spark, width):
    rng = np.random.default_rng(width)
    interval = lambda: sorted(int(v) for v in rng.integers(-40, 40, 2))
    left, right = [(int(rng.integers(3)), k, *interval()) for k in range(40)], [(int(rng.integers(3)), k, *interval()) for k in range(60)]
    found = pixels.overlapping(spark.createDataFrame(left, "g int, a int, low int, high int"), spark.createDataFrame(right, "g int, b int, y0 int, y1 int"), ["g"], ("low", "high"), ("y0", "y1"), width)
    pairs = [(r.a, r.b) for r in found.collect()]
    want = {(l[1], r[1]) for l in left for r in right if l[0] == r[0] and r[2] <= l[3] and r[3] >= l[2]}  # noqa: E741
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_debug_report_reads_a_page(spark):
    text = ["Ab1 zz9.", "00-42 Xy#q:"]
    pages = [k.preprocess(script.page(text)), np.zeros((5, 9), np.uint8)]
    rows = [(i, x, y, int(v)) for i, m in enumerate(pages) for (y, x), v in np.ndenumerate(m)]
    px = spark.createDataFrame(rows, "img long, x int, y int, v int")
    report = {r.img: r for r in debugging.debug_report(px, script.model(spark)).collect()}
    assert (report[1].width, report[1].height, report[1].white, report[1].lines) == (9, 5, 0, [])
    page = report[0]
    assert (page.height, page.width) == pages[0].shape and page.white == int((pages[0] == 255).sum())
    assert [" ".join("".join(c.label for c in w.characters) for w in line.words) for line in page.lines] == text
    plain = k.characters(pages[0])
    found = [c for line in page.lines for w in line.words for c in w.characters]
    assert [(c.x0, c.y0) for c in found] == [(c["x"], c["y"]) for c in plain]
    assert all(np.allclose(c.descriptor, k.hog(k.fit_square(p["raster"])), atol=1e-6) and c.confidence > 0.9 for c, p in zip(found, plain, strict=True))
