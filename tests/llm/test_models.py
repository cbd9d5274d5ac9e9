import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from veilwork.llm import cotrain, jpeg
from veilwork.llm.chat import format_preferences, harmless, preference_pairs
from veilwork.llm.cotrain import classify
from veilwork.llm.media import decode_images, store_texts
from veilwork.llm import quality_rules as quality_rules_module
from veilwork.llm.quality_rules import quality_rules, text_statistics

SF = "/root/testdata/sf0.01"


def test_classifier(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train = labels.filter("doc_id % 3 <> 0")
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    r = classify(docs.union(odd).union(docs.limit(2)).withColumn("kept", F.lit("x")), train).cache()
    assert r.count() == docs.count() + 3 and r.filter("p_quality is null").count() == 0
    held = r.join(labels.filter("doc_id % 3 = 0"), "doc_id").select(F.col("quality").alias("q"), "kept").toPandas()
    assert held.kept[held.q == 1].mean() > 0.98 and held.kept[held.q == 0].mean() < 0.15
    few = classify(docs, labels.limit(5))
    assert few.filter("kept").count() == docs.count() and few.filter("p_quality is not null").count() == 0
    assert classify(docs.limit(0), train).count() == 0


def pages(spark, n=2500, told=240):
    """Documents whose quality shows in a few of many words and, in nine of ten, in their source; few are labelled."""
    rng = random.Random(12)
    filler = ["".join(rng.choices("abcdefghijkl", k=5)) for _ in range(1500)]
    marks = {1: [f"good{i}" for i in range(30)], 0: [f"junk{i}" for i in range(30)]}
    docs, labels = [], []
    for i in range(n):
        q = int(rng.random() < 0.6)
        words = rng.choices(filler, k=40) + rng.choices(marks[q], k=2)
        rng.shuffle(words)
        source = f"{'site' if (q if rng.random() < 0.9 else 1 - q) else 'farm'}{rng.randint(0, 3)}"
        docs.append((i, " ".join(words), "en", source, 500))
        labels.append((i, q))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    known = spark.createDataFrame(labels[:told], "doc_id long, quality int")
    return frame, known, dict(labels[told:])


def test_views_teach_each_other(spark, monkeypatch):
    docs, labels, held = pages(spark)
    names = ["doc_id", "text", "lang", "source", "n_chars"]

    def right(rounds):
        models = []
        real = cotrain.trained
        monkeypatch.setattr(cotrain, "trained", lambda *a: models.append(real(*a)) or models[-1])
        got = {r.doc_id: r for r in cotrain.classify(docs, labels, rounds=rounds).collect()}
        monkeypatch.setattr(cotrain, "trained", real)
        hits = {c: np.mean([(got[i][c] > 0.5) == (q == 1) for i, q in held.items()]) for c in ("p_text", "p_meta", "p_quality")}
        return models[0], hits, got

    alone, by_labels, _ = right(0)
    model, together, got = right(3)
    assert alone.given == [] and len(model.given) == 3
    for counts in model.given:  # both views give both classes, in proportion to the prior and to the table
        assert set(counts) == {(v, q) for v in ("text", "meta") for q in (0, 1)} and min(counts.values()) >= 30
    assert model.given[2]["meta", 1] > model.given[0]["meta", 1]
    assert together["p_text"] > by_labels["p_text"] and together["p_quality"] >= by_labels["p_quality"]
    assert together["p_quality"] > max(together["p_text"], 0.9)  # both views count
    again = {r.doc_id: r.p_quality for r in cotrain.classify(docs.repartition(2), labels, rounds=3).collect()}
    assert all(abs(again[i] - r.p_quality) < 1e-8 for i, r in got.items())
    short = {r.id: (r.p_quality, r.kept) for r in cotrain.decisions(docs, labels).collect()}
    assert all(abs(short[i][0] - r.p_quality) < 1e-8 and short[i][1] == r.kept for i, r in got.items())
    assert names == docs.columns


def test_pseudo_labels_by_brute_force(spark):
    docs, labels, _ = pages(spark, 400, 120)
    names = list(cotrain.VIEW)
    model = cotrain.trained(cotrain.stored_views(docs, names), labels, "doc_id", "quality", 5000, 0.995, 0)
    stored = cotrain.stored_views(docs.filter("doc_id >= 120"), ["doc_id", "text", "lang", "source", "n_chars"])
    at = cotrain.thresholds(stored, model, 0.2)
    rows = stored.toPandas()
    x = {"text": cotrain.text_matrix(list(rows.text)), "meta": cotrain.meta_matrix(list(rows.meta))}
    odds = {"text": model.text.log_odds(x["text"]), "meta": model.meta.log_odds(x["meta"])}
    good = 1 / (1 + math.exp(-model.prior))
    found = cotrain.pseudo_labels(stored, model, at).groupby(["to", "label"])
    for by, to in (("text", "meta"), ("meta", "text")):
        step = np.floor(odds[by] * cotrain.STEP)
        for label, chosen, share in ((1, step >= at[by][0], good), (0, step <= at[by][1], 1 - good)):
            assert chosen.sum() >= math.floor(0.2 * share * len(rows))
            own = found.get_group((to, label))
            assert own["n"].sum() == chosen.sum()
            assert np.allclose((np.stack(list(own["mean"])) * own["n"].to_numpy()[:, None]).sum(axis=0), x[to][chosen].sum(axis=0))


def test_driver_holds_numbers_of_one_fit(spark):
    """5,000 labelled rows are 31 MB as numbers; the fit takes three of five of them, and takes them once."""
    rng = np.random.default_rng(5)
    rows = [(i, bytearray(rng.integers(0, 40, cotrain.TEXT_DIMS, dtype=np.uint8)), bytearray(cotrain.meta_view("en", "a", i))) for i in range(5000)]
    stored = spark.createDataFrame(rows, "id long, text binary, meta binary")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, quality int")
    tracemalloc.start()
    try:
        model = cotrain.trained(stored, labels, "doc_id", "quality", 5000, 0.995, 0)
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
    assert model is not None and len(model.text.weights) == cotrain.TEXT_DIMS + 1


def test_design_is_numbers_and_ones():
    rng = np.random.default_rng(6)
    x, more = rng.integers(0, 256, (7, cotrain.TEXT_DIMS), dtype=np.uint8), rng.random((2, cotrain.TEXT_DIMS))
    want = np.hstack([np.vstack([x / cotrain.SCALE, more]), np.ones((9, 1))])
    assert (cotrain.design(x, *more) == want).all() and (cotrain.design(want) == np.hstack([want, np.ones((9, 1))])).all()


def test_classifier_edges(spark):
    docs, labels, _ = pages(spark, 300, 120)
    odd = [(None, None, None, None, None), (3, "another text of a labelled id", "en", "x", -5), (7, "x " * 500_000, "en", "x", 10**12), (9, "y" * 3_000_000, None, None, None), (5000, "", "", "", 0)]
    more = spark.createDataFrame(odd, docs.schema)
    clash = docs.union(more).union(docs.filter("doc_id = 4")).withColumns({c: F.lit("x") for c in ("p_text", "label", "told_id", "id")})
    ties = labels.union(labels.limit(10).selectExpr("doc_id", "1 - quality")).union(spark.createDataFrame([(None, 1), (11, None)], labels.schema))
    got = cotrain.classify(clash, ties)
    assert set(got.columns) == set(clash.columns) | {"p_meta", "p_quality", "kept"}
    rows = got.collect()
    assert len(rows) == 306 and all(0 <= r.p_quality <= 1 for r in rows)
    assert len({r.p_quality for r in rows if r.doc_id == 4}) == 1
    assert cotrain.classify(docs, labels.limit(0)).filter("kept").count() == 300


def slow_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_statistics():
    rng = random.Random(8)
    texts = [None, "", "\n\n", "a b c", "a a a a", "a b c a b c", "é\u2003x 日 #", "x\x85y\x1cz", "l\nl\n l\nl"]
    texts += ["".join(rng.choices("ab \n#", k=120)) for _ in range(100)]
    for t in texts:
        assert text_statistics(t) == slow_statistics(t), t


def test_outliers_go(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 400)), "en" if i % 4 else None, "hot") for i in range(900)]
    junk = [(1000 + i, " ".join(f"{w}%%%" for w in prose(100).split()), "en", "hot") for i in range(60)]
    odd = [(None, None, None, None), (5000, "", "en", "hot"), (5001, "a b " * 100, "en", "hot"), (0, rows[0][1], None, "hot"), (5002, prose(100), "xx", "rare")]
    df = spark.createDataFrame(rows + junk + odd, "doc_id long, text string, lang string, source string").withColumn("distance", F.lit("x"))
    got = quality_rules(df.repartition(4)).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(rows + junk + odd)
    assert all(kept[i] for i in range(900)) and not any(kept[1000 + i] for i in range(60))
    assert (kept[None], kept[5000], kept[5001], kept[5002]) == (False, False, False, True)
    assert quality_rules(df.limit(0)).count() == 0
    again = {r.doc_id: r.distance for r in quality_rules(df.repartition(2)).collect()}
    assert again == {r.doc_id: r.distance for r in got}


def test_distances_by_brute_force(spark):
    """The same steps over whole arrays in numpy, group by group."""
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))
    rows = [(i, prose(rng.randint(50, 500)) + " #" * rng.choice([0, 0, 3, 30]), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "rare"])) for i in range(400)]
    rows += [(1000, prose(80), "fr", "single"), (1001, prose(20), "xx", "failed"), (1002, None, "en", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    x, failed = {}, {}
    for i, t, *_ in rows:
        n, chars, *rest = text_statistics(t)
        w = max(n, 1)
        v = [math.log1p(n), math.log1p(chars / w), *[math.log1p(100 * k / w) for k in rest]]
        x[i] = np.array([math.floor(abs(a * quality_rules_module.UNIT) + 0.5) for a in v], float)
        failed[i] = n < 50 or 100 * rest[2] > 50 * n
    floor = np.diag((quality_rules_module.FLOOR * quality_rules_module.UNIT) ** 2)
    scale = quality_rules_module.consistency()
    far = lambda m, v: float((v - m[0]) @ m[1] @ (v - m[0]))

    def steps(members, model, lent):
        last = None
        for _ in range(quality_rules_module.STEPS):
            step = np.array([math.floor(math.log1p(far(model, v)) * quality_rules_module.UNIT) for v in members])
            need = math.ceil(len(members) * quality_rules_module.SUBSET)
            cut = np.sort(step)[need - 1]
            inner = members[step <= cut]
            m = [float(len(inner)), inner.sum(axis=0), inner.T @ inner]
            both = m if lent is None else [a + b for a, b in zip(m, lent, strict=True)]
            mean = both[1] / both[0]
            model = mean, np.linalg.inv((both[2] / both[0] - np.outer(mean, mean)) * scale + floor)
            if last is not None and all(np.array_equal(a, b) for a, b in zip(m, last, strict=True)):
                break
            last = m
        return model, m

    good = np.array([x[i] for i, *_ in rows if not failed[i]])
    centre = np.median(good, axis=0)
    mad = np.median(abs(good - centre), axis=0)
    general, m = steps(good, (centre, np.diag(1 / ((mad * 1.4826) ** 2 + np.diag(floor)))), None)
    lent = [a * quality_rules_module.BORROWED / m[0] for a in m]
    models = {}
    for key in {(r[2], r[3]) for r in rows}:
        own = np.array([x[r[0]] for r in rows if (r[2], r[3]) == key and not failed[r[0]]])
        models[key] = steps(own, general, lent)[0] if len(own) else general
    got = {r.doc_id: r for r in quality_rules(df).collect()}
    for i, _, lang, source in rows:
        want = far(models[lang, source], x[i])
        assert abs(got[i].distance - want) < 1e-6 * max(1, want), i
        assert got[i].kept == (not failed[i] and want <= quality_rules_module.CUTOFF)


def test_pictures_keep_their_bytes():
    for n in (64, 378, 379, 6400, 64 * 9000):
        payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        picture = jpeg.decode(jpeg.store(payload))
        assert jpeg.stored(picture) == payload


def test_texts_in_pictures(spark):
    texts = [None, "", "x", "é" * 32, "word " * 20_000, "x"]
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)] + [(None, "x", "y")], "doc_id long, text string, media string")
    got = store_texts(df, keep_media=True).cache()
    by = {r.doc_id: r for r in got.collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert by[2].feature == by[5].feature == by[None].feature
    bad = spark.createDataFrame([(1, None), (2, b"junk"), (3, b"")], "doc_id long, media binary")
    pics = {r.doc_id: r for r in decode_images(got.select("doc_id", "media").union(bad.withColumn("doc_id", F.col("doc_id") + 100))).collect()}
    assert pics[4].rgb and len(pics[4].rgb) == pics[4].height * pics[4].width * 3
    assert pics[101].rgb is None and pics[102].error and pics[103].error is None


class Writer:
    """A scalar bit writer with one eight-bit code a symbol, for scans of any shape."""

    def __init__(self):
        self.symbols, self.out = [], []

    def symbol(self, s, extra=0, size=0):
        if s not in self.symbols:
            self.symbols.append(s)
        self.out.append(("s", s))
        self.bits(extra, size)

    def bits(self, v, n):
        if n:
            self.out.append(("b", v, n))

    def table(self):
        return bytes(7) + bytes([len(self.symbols)]) + bytes(8), bytes(self.symbols)

    def data(self):
        text = "".join(f"{self.symbols.index(x[1]):08b}" if x[0] == "s" else f"{x[1]:0{x[2]}b}" for x in self.out)
        text += "1" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def test_any_progressive_scan():
    """Sparse coefficients through scalar scans: runs, end-of-band runs, refinement of old and new coefficients."""
    rng = np.random.default_rng(3)
    coef = np.where(rng.random((6, 64)) < 0.15, rng.integers(-9, 10, (6, 64)), 0)
    coef[2, 1:] = coef[3, 1:] = 0
    dc, w = Writer(), Writer()
    last = 0
    for b in range(6):
        d = int(coef[b, 0] >> 1) - last
        last += d
        size = abs(d).bit_length()
        dc.symbol(size, d if d > 0 else d + (1 << size) - 1, size)
    low = np.sign(coef) * (abs(coef) >> 1)
    for b in range(6):
        run = 0
        for k in range(1, 64):
            v = int(low[b, k])
            if not v:
                run += 1
                continue
            while run > 15:
                w.symbol(0xF0)
                run -= 16
            size = abs(v).bit_length()
            w.symbol(run << 4 | size, v if v > 0 else v + (1 << size) - 1, size)
            run = 0
        if run:
            w.symbol(0x00)
    r = Writer()
    for b in range(6):
        new = [k for k in range(1, 64) if abs(coef[b, k]) == 1]
        end, run, held = (new[-1] if new else 0), 0, []
        for k in range(1, end + 1):
            if low[b, k]:
                held.append(int(abs(coef[b, k]) & 1))
            elif abs(coef[b, k]) == 1:
                r.symbol(run << 4 | 1, int(coef[b, k] > 0), 1)
                for x in held:
                    r.bits(x, 1)
                run, held = 0, []
            else:
                run += 1
                if run == 16:
                    r.symbol(0xF0)
                    for x in held:
                        r.bits(x, 1)
                    run, held = 0, []
        if end < 63:
            if end and held:
                raise AssertionError
            r.symbol(0x00)
            for k in range(end + 1, 64):
                if low[b, k]:
                    r.bits(int(abs(coef[b, k]) & 1), 1)
    head = jpeg._segment(0xDB, b"\x00" + b"\x01" * 64) + jpeg._segment(0xC2, bytes([8, 0, 10, 0, 20, 1, 1, 0x11, 0]))
    table = lambda kind, x: jpeg._segment(0xC4, bytes([kind]) + x.table()[0] + x.table()[1])
    bits = "".join(str(int(v) & 1) for v in coef[:, 0]) + "11"
    data = b"\xff\xd8" + head + table(0, dc) + jpeg._scan([1], 0, 0, 0, 1, dc.data()) + jpeg._scan([1], 0, 0, 0, 0x10, bytes([int(bits, 2)]))
    data += table(0x10, w) + jpeg._scan([1], 0, 1, 63, 1, w.data()) + table(0x10, r) + jpeg._scan([1], 0, 1, 63, 0x10, r.data()) + b"\xff\xd9"
    pic = jpeg.decode(data)
    assert (pic.parts[1].coef == coef).all()
    square = np.zeros((6, 64))
    square[:, jpeg.ZIGZAG] = coef
    c = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    want = np.clip(np.einsum("bvu,ux,vy->byx", square.reshape(6, 8, 8), c, c) + 128, 0, 255)
    got = jpeg.to_rgb(pic)[:, :, 0].astype(float)
    whole = want.reshape(2, 3, 8, 8).transpose(0, 2, 1, 3).reshape(16, 24)[:10, :20]
    assert abs(got - whole).max() <= 1.01


def test_colours_by_brute_force():
    """Planes by the cosine sums in floating point, chroma repeated, colours by their formula."""
    payload = np.random.default_rng(7).integers(96, 160, 378 * 6, dtype=np.uint8).tobytes()
    pic = jpeg.decode(jpeg.store(payload))
    c = np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
    planes = []
    for part in pic.parts.values():
        square = np.zeros((len(part.coef), 64))
        square[:, jpeg.ZIGZAG] = part.coef * pic.quants[part.quant]
        blocks = np.clip(np.einsum("bvu,ux,vy->byx", square.reshape(-1, 8, 8), c, c) + 128, 0, 255)
        plane = blocks.reshape(-1, part.wide, 8, 8).transpose(0, 2, 1, 3).reshape(-1, part.wide * 8)
        scale = 2 // part.h
        planes.append(np.kron(plane, np.ones((scale, scale)))[: pic.height, : pic.width])
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    want = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    assert (pic.parts[1].h, pic.parts[2].h) == (2, 1)
    assert abs(jpeg.to_rgb(pic).astype(float) - np.clip(want, 0, 255)).max() <= 4


def test_damaged_pictures(spark):
    good = jpeg.store(bytes(range(64)))
    frame = lambda h, w, *parts: b"\xff\xd8" + jpeg._HEAD + jpeg._segment(0xC2, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([i, hv, 0]) for i, hv in enumerate(parts))) + b"\xff\xd9"
    bad = [good[:n] for n in (3, 5, 30, 200, len(good) - 2)] + [b"\xff\xd8\xff\xc2", b"\xff\xd8\xff", frame(65535, 65535, 0x11), frame(8, 8, 0x11, 0x11, 0x11, 0x11), frame(8, 8, 0x33, 0x21, 0x11), frame(8, 8, 0x11, 0, 0x11), frame(0, 8, 0x11), b"GIF89a"]
    rows = [(i, bytearray(x)) for i, x in enumerate([good, *bad])]
    got = {r.id: r for r in decode_images(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert got[0].error is None and got[0].rgb
    assert all(got[i + 1].rgb is None and got[i + 1].error for i in range(len(bad)))


def test_preferences(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (1, 3, "assistant", "end<|im_end|>"),
        (2, 0, "user", "q"), (2, 1, "assistant", "bad"), (2, 1, "assistant", "bad"),
        (3, 0, "user", "other"), (4, 0, "user", None), (4, 1, "assistant", "x"), (None, 0, "user", "q"), (5, 0, "user", "q"), (5, 1, "assistant", "good"), (5, 2, "user", "more"), (5, 3, "assistant", "end<|im_end|>"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit(1)).repartition(3)
    got = {r.conv_id: r for r in format_preferences(preference_pairs(df)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    two = got[2]
    assert (two.chosen_id, two.rejected_id, two.n_common) == (1, 2, 1)
    assert (got[None].chosen_id, got[None].rejected_id, got[None].n_common) == (1, None, 1)  # ids come before null
    assert (got[5].chosen_id, got[5].n_common, got[5].chosen_text, got[5].rejected_text) == (1, 4, "", "")
    assert (got[1].chosen_id, got[1].rejected_id) == (1, None) and [t.text for t in got[1].rejected] == ["q", "good", "more", "good"]
    for r in got.values():
        chosen, rejected = [(t.role, t.text) for t in r.chosen], [(t.role, t.text) for t in r.rejected]
        n = 0
        while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
            n += 1
        assert r.n_common == n
        show = lambda ts: "".join(f"<|im_start|>{a or ''}\n{(b or '').replace('<|', '<\u200b|')}<|im_end|>\n" for a, b in ts)
        assert (r.prompt, r.chosen_text, r.rejected_text) == (show(chosen[:n]), show(chosen[n:]), show(rejected[n:]))
        for text, loss, turns in ((r.chosen_text, r.chosen_loss, chosen[n:]), (r.rejected_text, r.rejected_loss, rejected[n:])):
            assert [text[s.start : s.end] for s in loss] == [show([t])[len("<|im_start|>assistant\n") : -1] for t in turns if t[0] == "assistant"]
    assert got[4].rejected_text == "" and got[4].chosen_text.startswith("<|im_start|>assistant")
    assert format_preferences(preference_pairs(df.limit(0))).count() == 0
    assert spark.range(1).select(harmless(F.lit(None))).first()[0] == ""
