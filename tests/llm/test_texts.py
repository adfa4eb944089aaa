"""Operators 3 to 9."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridcover.llm import components, decontaminate, fm_index, jaccard, jpeg, language, quality, tokens, toxicity

SF = "/root/testdata/sf0.001"
ODD = ["", None, "  a  b ", "x<|endoftext|> y <|endoftext|>", "it's we'll 'S", "日本語 text ½ ² Ⅷ　a\n\n\n b", "\x1c\x1f a", "ªº µ × ÷ ²³ é", "😀😀 a", "don''t", "1٣2", " " * 50, "\r\n\t x", "a\xa0b", "\x85\x85a", "ǅ ƻ", " 　z"]


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- 3


def test_token_counts(spark, odd_docs, no_docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = ODD + [r["text"] for r in docs(spark).select("text").limit(60).collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in tokens.count_tokens(df, path).collect()}
    for k, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((t or "").encode()), n, n > 512), t
    assert tokens.count_tokens(odd_docs, path).count() == 11 and tokens.count_tokens(no_docs, path).count() == 0


def test_proven_tokens_are_one_token():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    proven = tokens.whole_tokens(lib)
    assert len(proven) > 49_000 and "<|endoftext|>" not in proven
    some = random.Random(0).sample(sorted(proven), 500)
    assert all(len(e.ids) == 1 for e in lib.encode_batch(some, add_special_tokens=False))
    c = tokens.Counter(lib, proven, memory=5)  # a memory that is emptied all the time
    assert [c.count([t])[0] for t in ("unheard zzgrblx words qqwx", "more zzyzx", "again zzgrblx")] == [len(lib.encode(t).ids) for t in ("unheard zzgrblx words qqwx", "more zzyzx", "again zzgrblx")]


def test_tokens_of_long_texts(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for t in ODD if t] + ["It's <|endoftext|>  10 naïve\u2009words...\n\n " * 50, "日本 " * 300]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    c = tokens.Counter(lib, tokens.whole_tokens(lib))
    assert c.count([None, *texts, ""]) == [0, *want, 0]
    monkeypatch.setattr(tokens, "LONG", 1)
    assert c.count([None, *texts, ""]) == [0, *want, 0]


# -- 4


def test_quality(spark, odd_docs, no_docs):
    df, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from gridcover.llm.common import held_out

    model = quality.learn(df, labels.where(~held_out("doc_id", 5, 0)), "quality")
    assert 0 < len(model.rules) < 300
    got = quality.score(df, model).join(labels, "doc_id").where(held_out("doc_id", 5, 0)).toPandas()
    assert ((got["quality_score"] >= 0.3) == (got["quality"] == 1)).mean() > 0.9
    plan = quality.score(df, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan and "Exchange" not in plan
    odd = quality.score(odd_docs, model).collect()
    assert len(odd) == 11 and all(0 <= r["quality_score"] <= 1 for r in odd) and quality.score(no_docs, model).count() == 0
    none = quality.learn(no_docs, labels.where("1 = 0"), "quality")
    assert quality.score(odd_docs, none).select("quality_score").distinct().first()[0] == pytest.approx(0.5)


def test_rules_mean_the_same_in_numpy_and_columns(spark):
    rng = np.random.default_rng(1)
    x = {"a": rng.normal(size=400), "b": rng.normal(size=400)}
    y = ((x["a"] > 0.3) & (x["b"] <= 0.5)).astype(int)
    model = quality.fit(x, y)
    z = model.intercept + sum(w * r.holds(x) for r, w in model.rules)
    df = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in enumerate(zip(x["a"], x["b"]))], "k int, a double, b double")
    got = df.select("k", model.score({"a": F.col("a"), "b": F.col("b")}).alias("s")).orderBy("k").toPandas()["s"].to_numpy()
    assert np.allclose(got, 1 / (1 + np.exp(-z))) and ((got > 0.5) == (y == 1)).mean() > 0.97
    assert quality.fit({"a": np.zeros(0)}, np.zeros(0)).intercept == 0


# -- 5


def brute_components(sets):
    ids = sorted(sets)
    up = {i: i for i in ids}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize(("seed", "group", "split"), [(0, 500, 5000), (1, 500, 6), (2, 7, 3)])
def test_jaccard_against_brute_force(spark, monkeypatch, seed, group, split):
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "SPLIT", split)
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 5)))
    shared = [[word() for _ in range(12)] for _ in range(3)]
    texts, base = [], [word() for _ in range(120)]
    for k in range(150):  # a family around a base: from few to many edits
        t = list(base)
        for _ in range(k // 10):
            t[r.randrange(len(t))] = word() + "x"
        texts.append(" ".join(t))
    for _ in range(60):  # others, with common passages
        t = [word() for _ in range(r.choice([1, 3, 4, 5, 6, 20, 80]))]
        texts.append(" ".join(t + r.choice(shared) * r.choice([0, 1, 1])))
    texts += [texts[3], texts[3].upper(), texts[160], "", None, " \t", "one two", "One  two", "a b c d e", "a b c d e f"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    sets = {i: shingle_set(t) for i, t in zip(ids, texts)}
    want = brute_components(sets)
    got = {x["doc_id"]: x for x in jaccard.join_components(df).collect()}
    assert {i: x["n_shingles"] for i, x in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: x["component_id"] for i, x in got.items()} == want
    kept = {x["doc_id"] for x in jaccard.keep_one(df).collect()}
    assert kept == {i for i in ids if want[i] == i}


def test_each_pair_of_a_split_list_meets_once():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n, root = 40, rng.integers(0, 4, 40)
        main = np.bincount(root).argmax()
        s = jaccard.Splits(np.array([7], np.uint64), np.array([main]), np.array([rng.integers(1, 4)]), np.array([rng.integers(1, 5)]))
        index, name, side = s.cells(np.where(np.arange(n) < 35, 7, 9).astype(np.uint64), root, rng.integers(0, 1 << 40, n))
        met = {}
        for cell in np.unique(name):
            at = np.flatnonzero(name == cell)
            for x in at:
                for y in at:
                    if index[x] < index[y] and (side[x] == side[y] == 0 or {side[x], side[y]} == {1, 2}):
                        met[index[x], index[y]] = met.get((index[x], index[y]), 0) + 1
        want = {(x, y) for x in range(n) for y in range(x + 1, n) if (x < 35) == (y < 35) and not (y < 35 and root[x] == root[y] == main)}
        assert set(met) == want and set(met.values()) == {1}


def test_pairs_of_a_long_list_leave_in_parts():
    import tracemalloc

    def bucket(n, lists):  # all members have one size, no leader and components of their own, so that no pair is ruled out
        zero = np.zeros(n * lists, np.int64)
        c = np.tile(np.arange(n), lists)
        values = [np.repeat(np.arange(lists), n) + 5, c, zero + 100, c, zero - 1, zero, zero, zero + np.repeat(np.arange(lists), n), zero, zero]
        return pa.RecordBatch.from_arrays([pa.array([v.astype(kind).tobytes()], pa.binary()) for v, kind in zip(values, jaccard._POSTING, strict=True)], names=[f"c{k}" for k in range(len(values))])

    b = bucket(1700, 1)
    tracemalloc.start()
    pairs, largest = 0, 0
    for part in jaccard._met(iter([b])):
        pairs, largest = pairs + part.num_rows, max(largest, part.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == 1700 * 1699 // 2 and largest <= 2 * jaccard.PAIRS and peak < 100 << 20  # all at once, as 8 columns of longs, are 92 MB, which were held several times
    # pairs that meet in several lists keep their counts and last positions, in however many parts
    total = {}
    for part in jaccard._met(iter([bucket(900, 3)])):
        for x, y, k, i in zip(*(part.column(name).to_pylist() for name in ("x", "y", "k", "i")), strict=True):
            had = total.get((x, y), (0, -1))
            total[x, y] = (had[0] + k, max(had[1], i))
    assert len(total) == 900 * 899 // 2 and set(total.values()) == {(3, 2)}


def test_jaccard_odd_tables(spark, odd_docs, no_docs):
    got = jaccard.join_components(odd_docs).collect()
    assert len(got) == 11 and {x["doc_id"]: x["component_id"] for x in got if x["doc_id"] is not None} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8}
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 10
    assert jaccard.join_components(no_docs).count() == 0 and jaccard.keep_one(no_docs).count() == 0


def test_matches_of_long_texts():
    from gridcover.llm.common import matches

    for t in (b"", b" ", b"a bc  d\n"):
        assert list(matches(jaccard._WORD, t)) == list(matches(jaccard._WORD, t, 0)) == t.split()


def test_prefix_order():
    s = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 50).astype(np.uint64))
    assert jaccard.prefix_length(5) == 2 and jaccard.prefix_length(1) == 1
    hot = s[:4]
    assert set(jaccard.prefix(s, hot).tolist()) == set(s[4:15].tolist())
    assert jaccard._apart(s[:5], s[:5], hot) == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(1000, 1100)]
    up = {}

    def root(a):
        up.setdefault(a, a)
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "x long, y long").repartition(6)).collect()}
    assert got == {n: root(n) for n in up if root(n) != n}
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


# -- 6


def test_language(spark, odd_docs, no_docs):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn_from(df)
    assert model[0] == ["de", "en", "es", "fr"] and np.allclose(np.exp(model[1].astype(float)).sum(axis=0), 1, atol=1e-3)
    from gridcover.llm.common import held_out

    got = language.identify(df, model).where(held_out("doc_id", 5, 0)).toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["lang_score"].between(0, 1).all()
    odd = {(r["doc_id"], r["text"]): r["lang_pred"] for r in language.identify(odd_docs, model).select("doc_id", "text", "lang_pred").collect()}
    assert all((v == "und") == (not t or not any(c.isalpha() for c in t)) for (_, t), v in odd.items())
    assert language.identify(no_docs, model).count() == 0
    empty = language.learn(no_docs)
    assert {r["lang_pred"] for r in language.identify(odd_docs, empty).collect()} == {"und"}


def test_grams_of_a_text_do_not_depend_on_its_neighbours():
    a, _, _ = language.grams(["abc déf", "x", ""], 1 << 12)
    b, starts, letters = language.grams(["abc déf"], 1 << 12)
    assert (a[: len(b)] == b).all() and letters.tolist() == [6]
    c, _, _ = language.grams(["x"], 1 << 12)
    assert (a[len(b) : len(b) + len(c)] == c).all()
    assert language.score_texts(["A" * 10, None, "12"], ["p", "q"], np.zeros((1 << 12, 2), np.float32))[0] == ["p", "und", "und"]


def test_long_texts_are_read_in_pieces(monkeypatch):
    r = random.Random(6)
    texts = ["".join(r.choice("aé bcß \n.1") for _ in range(n)) for n in (0, 1, 50, 400, 999)] + ["x" * 300, "7 " * 200 + "ab", "A b " * 90]
    want = {k: np.sort(language.grams([t], 1 << 12)[0], axis=0) for k, t in enumerate(texts)}
    monkeypatch.setattr(language, "CHARS_AT_ONCE", 64)
    got: dict[int, list] = {}
    for at, ids, starts, _ in language._grams(texts, 1 << 12):
        for k, i, j in zip(at, starts, [*starts[1:], len(ids)]):
            got.setdefault(int(k), []).append(ids[i:j])
    assert len(got[4]) > 1 and all((np.sort(np.concatenate(got[k]), axis=0) == want[k]).all() for k in want)


# -- 7


def test_media_round_trip(spark, odd_docs, no_docs):
    got = {}
    for r in jpeg.features(jpeg.store(odd_docs)).collect():
        got.setdefault(r["doc_id"], r)
    for r in odd_docs.select("doc_id", "text").where("doc_id is not null").collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert g["feature"].startswith("512x")
    media = jpeg.store(odd_docs).where("doc_id = 1").first()["media"]
    assert got[1]["media_bytes"] == len(media) and got[1]["media_sha256"] == hashlib.sha256(media).hexdigest() and media[:2] == b"\xff\xd8"
    assert jpeg.features(jpeg.store(no_docs)).count() == 0


def test_long_payloads_become_several_images():
    p = np.random.default_rng(0).integers(0, 256, 64 * (jpeg.MOST_ROWS + 3)).astype(np.uint8).tobytes()
    form = jpeg.encode_all([p, b"\xff" * 64])
    back = jpeg.read_back(form)
    assert back[0][0] == p and [x[1] for x in back[0][1]] == [65528, 24] and back[1][0] == b"\xff" * 64


def full_jpeg(coefficients, factors, restart, apart=False, late=False):
    """An encoder of its own for whole blocks: coefficients[part][down][across] is a list of 64 numbers in zigzag order. apart: a scan for
    each part, the first one last; late: the height is told by a DNL segment after the first scan."""
    dc = ((0, 2, 3, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(11)))
    symbols = [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 9)]
    ac = ((0,) * 7 + (len(symbols),) + (0,) * 8, tuple(symbols))
    dcc, acc = ({s: (c, n) for s, c, n in jpeg.canonical(t)} for t in (dc, ac))
    bits = ""

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v >= 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        out = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") if bits else b""
        bits = ""
        return out

    h, v = (max(f[k] for f in factors) for k in (0, 1))
    down, across = len(coefficients[0]) // factors[0][1], len(coefficients[0][0]) // factors[0][0]
    width, height = across * h * 8 - 3, down * v * 8 - 5

    def units(parts):
        """The blocks of each MCU, as (part, row, column)."""
        if len(parts) > 1:
            return [[(p, u // across * factors[p][1] + y, u % across * factors[p][0] + x) for p in parts for y in range(factors[p][1]) for x in range(factors[p][0])] for u in range(down * across)]
        (p,) = parts
        wide, high = (-(-n * f // (8 * most)) for n, f, most in ((width, factors[p][0], h), (height, factors[p][1], v)))
        return [[(p, y, x)] for y in range(high) for x in range(wide)]

    def coded(parts):
        nonlocal bits
        body, last = b"", [0] * len(factors)
        for k, unit in enumerate(units(parts)):
            if restart and k and k % restart == 0:
                body += flush() + bytes([0xFF, 0xD0 + (k // restart - 1) % 8])
                last = [0] * len(factors)
            for part, y, x in unit:
                block = coefficients[part][y][x]
                n, extra = number(block[0] - last[part])
                last[part] = block[0]
                bits += format(dcc[n][0], f"0{dcc[n][1]}b") + extra
                run = 0
                for c in block[1:]:
                    if not c:
                        run += 1
                        continue
                    while run > 15:
                        bits += format(acc[0xF0][0], f"0{acc[0xF0][1]}b")
                        run -= 16
                    n, extra = number(c)
                    bits += format(acc[run << 4 | n][0], f"0{acc[run << 4 | n][1]}b") + extra
                    run = 0
                if run:
                    bits += format(acc[0][0], f"0{acc[0][1]}b")
        return body + flush()

    seg = jpeg._segment
    frame = b"".join(bytes([k + 1, a << 4 | b, 0]) for k, (a, b) in enumerate(factors))
    told = b"\0\0" if late else height.to_bytes(2, "big")
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0, 3]) + bytes([1] * 63)) + seg(0xC0, bytes([8]) + told + width.to_bytes(2, "big") + bytes([len(factors)]) + frame)
    out += jpeg._huffman_segment(0, dc) + jpeg._huffman_segment(0x10, ac) + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"")
    for n, parts in enumerate([[k] for k in reversed(range(len(factors)))] if apart else [list(range(len(factors)))]):
        out += seg(0xDA, bytes([len(parts)]) + b"".join(bytes([k + 1, 0]) for k in parts) + b"\0\x3f\0") + coded(parts)
        if late and not n:
            out += seg(0xDC, height.to_bytes(2, "big"))
    return out + b"\xff\xd9", width, height


@pytest.mark.parametrize("kind", ["together", "apart", "late"])
@pytest.mark.parametrize(("factors", "restart"), [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2), ([(1, 1), (2, 2)], 2)])
def test_whole_images(factors, restart, kind):
    rng = np.random.default_rng(3)
    h, v = (max(f[k] for f in factors) for k in (0, 1))
    co = [[[[int(rng.integers(-300, 300)), *(int(x) if rng.random() < 0.1 else 0 for x in rng.integers(-100, 100, 63))] for _ in range(4 * a)] for _ in range(3 * b)] for a, b in factors]
    data, width, height = full_jpeg(co, factors, restart, kind == "apart", kind == "late")
    w, hh, thumb = jpeg.decode(data)
    want = np.clip(np.floor(np.array([[b[0] for b in row] for row in co[0]]) * 3 / 8 + 128.5), 0, 255)
    (a, b) = factors[0]
    assert (w, hh) == (width, height) and (thumb == want[: -(-height * b // (8 * v)), : -(-width * a // (8 * h))]).all()
    for bad in (data[:-2], data[:200], b"GIF89a", data.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises(ValueError):
            jpeg.decode(bad)


# -- 8


def brute_hits(text, items):
    words = decontaminate.words_of
    w, hit, found = words(text), set(), set()
    for i, t in items:
        p = words(t)
        for k in range(max(1, len(p) - 9) if p else 0):
            win = p[k : k + 10]
            for at in range(len(w) - len(win) + 1):
                if w[at : at + len(win)] == win:
                    hit.update(range(at, at + len(win)))
                    found.add(i)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize(("block", "in_a_pass"), [(4 << 20, 4), (100, 4), (100, 2)])
def test_decontamination(spark, monkeypatch, block, in_a_pass):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontaminate, "BLOCKS_A_PASS", in_a_pass)
    r = random.Random(8)
    word = lambda: r.choice(["a", "b", "c", "dé", "ee", "F1"])
    items = [("10", " ".join(word() for _ in range(14))), ("9", "x y"), ("2", "A, b? c!"), ("3", ""), ("4", None), ("7", "q " * 25), ("8", "ß_ünder score-x")]
    texts = [" ".join(word() for _ in range(r.randrange(60))) for _ in range(40)]
    texts += ["z " + "".join(c.upper() if c < "{" else c for c in items[0][1]) + " z", "x... Y x y y", "q " * 40, None, "", "?!", "ß ünder score x", items[0][1] + " " + items[0][1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {x["doc_id"]: x for x in decontaminate.find(df, bench).collect()}
    for k, t in enumerate(texts):
        n, hit, found = brute_hits(t, items)
        assert (got[k]["n_words"], sum(b - a for a, b in got[k]["spans"]), got[k]["items"]) == (n, hit, found), t
    clean = {x["doc_id"]: x["text"] for x in decontaminate.remove(df, bench).collect()}
    assert all(brute_hits(t, items)[1] == 0 for t in clean.values())
    assert all(clean[k] == t for k, t in enumerate(texts) if brute_hits(t, items)[1] == 0)
    assert clean[40].split() == ["z", "z"]


def test_removal_leaves_no_window_whatever_the_blocks(spark, odd_docs, monkeypatch):
    r = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    items = [(str(k), " ".join(words[k : k + 14])) for k in range(0, 26, 6)] + [("s", "x y"), ("t", "u v")]  # windows that overlap each other
    texts = [" ".join(words[: r.randrange(10, 40)] + ["z"] + words[r.randrange(20) :]) for _ in range(6)]
    texts += ["a " + " ".join(words[2:22]) + " b", "x u v y u x y v", "u x x y y v z", None, "", "no hit"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = []
    for block in (4 << 20, 200):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got.append({x["doc_id"]: x["text"] for x in decontaminate.remove(df, bench).collect()})
        assert len(got[-1]) == len(texts) and all(brute_hits(t, items)[1] == 0 for t in got[-1].values())
    assert got[0] == got[1]
    kept = decontaminate.remove(odd_docs, bench)
    assert kept.dtypes == odd_docs.dtypes and kept.count() == 11


def test_decontamination_of_odd_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and then the cat"), (1, "gato come"), (None, "word word")], "item_id long, text string")
    out = decontaminate.find(odd_docs, bench)
    assert out.count() == 11 and decontaminate.find(no_docs, bench).count() == 0
    assert decontaminate.find(odd_docs, bench.where("1 = 0")).where("size(items) > 0").count() == 0
    kept = decontaminate.remove(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == 11 and kept.where("doc_id = 4").first()["n_chars"] < 60_000


def test_index(monkeypatch):
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, 400).astype(np.int32)
    text[rng.integers(0, 400, 12)] = 0
    text[-1] = 0
    index = fm_index.FMIndex(text)
    pats = [rng.integers(1, 5, int(n)).astype(np.int32) for n in rng.integers(1, 6, 60)]
    wide = np.zeros((60, 5), np.int32)
    for k, p in enumerate(pats):
        wide[k, : len(p)] = p
    lo, hi = index.search(wide, np.array([len(p) for p in pats]))
    for k, p in enumerate(pats):
        want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 7)
    p = decontaminate.Phrases([("1", "a b c")])
    assert decontaminate.search_shard(p, [p.symbols("x a b c a b c")])[0].tolist() == [[0, 1, 7]]


# -- 9


def slow_kernel(a, b):
    """Straight from the definition."""
    from itertools import combinations

    def features(w):
        codes = [toxicity._MARK, *(ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 36 for c in w), toxicity._MARK]
        out = {}
        for at in combinations(range(len(codes)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.REACH:
                key = tuple(codes[i] for i in at)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        size = sum(toxicity.DECAY ** (2 * (at[-1] - at[0] + 1)) for at in combinations(range(len(codes)), toxicity.ORDER) if at[-1] - at[0] < toxicity.REACH)
        return out, size

    (x, n), (y, m) = features(a), features(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / (n * m) ** 0.5


def test_kernel_is_its_definition():
    words = ["idiot", "idxiot", "banana", "ab", "trashtrash", "éèß"]
    got = toxicity.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(slow_kernel(a, b), abs=1e-5)


def test_toxicity(spark, odd_docs, no_docs):
    r = random.Random(1)
    word = lambda: "".join(r.choice(["th", "er", "an", "in", "on", "re"]) for _ in range(r.randrange(1, 5)))
    rows = []
    for k in range(500):
        t = [word() for _ in range(60)]
        toxic = k % 4 == 0
        if toxic:
            for bad in r.sample(["moron", "scumbag", "clodpate"], 2):
                t.insert(r.randrange(len(t)), bad)
        rows.append((k, " ".join(t), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("doc_id < 400"))
    got = toxicity.score(df, machine).where("doc_id >= 400").toPandas()
    assert ((got["toxicity"] >= toxicity.TOXIC) == (got["toxic"] == 1)).mean() == 1.0
    texts = ["thereon moron inan", "thereon m.o.r.o.n inan", "an m o r o n in", "thereon MORXON!", "thereon scuumbag", "thereon inan rere", None, ""]
    s = [r["toxicity"] for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1), machine).orderBy("k").collect()]
    assert all(x >= toxicity.TOXIC for x in s[:5]) and all(x < toxicity.TOXIC for x in s[5:])
    assert toxicity.score(odd_docs, machine).count() == 11 and toxicity.score(no_docs, machine).count() == 0
    none = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("toxic = 0"))
    assert toxicity.score(odd_docs, none).select("toxicity").distinct().first()[0] == 0


def test_toxicity_of_a_thinned_class(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice(["th", "er", "an", "in", "on", "re"]) for _ in range(r.randrange(1, 4)))
    rows = []
    for k in range(1600):
        t = [word() for _ in range(12)]
        toxic = k % 10 == 0
        if toxic or k % 10 == 1:  # half of those who use the word are toxic
            t.insert(r.randrange(len(t)), "moron")
        rows.append((k, " ".join(t), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    some = spark.createDataFrame([(1, "thereon moron inan"), (2, "thereon inan rere")], "doc_id long, text string")
    score = lambda n: [x["toxicity"] for x in toxicity.score(some, toxicity.learn(texts, labels, fit_rows=n)).orderBy("doc_id").collect()]
    full, thin = score(3000), score(160)  # 160 toxic labels, 1440 clean ones
    assert 0.4 < full[0] < 0.6 and thin == pytest.approx(full, abs=0.15)


def test_toxicity_of_sentences_with_one_and_with_two_words(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice(["th", "er", "an", "in", "on", "re"]) for _ in range(r.randrange(1, 4)))
    rows = []
    for k in range(1200):
        t = [[word() for _ in range(12)] for _ in range(3)]
        bad = r.choice(["moron", "scumbag"])
        if k % 5 == 0:  # toxic: two in one sentence, at times the same twice
            t[1][3], t[1][8] = bad, r.choice(["moron", "scumbag"])
        elif k % 5 == 1:  # clean: one, or one each in two sentences
            t[0][3], t[2][8] = bad, r.choice(["moron", word()])
        rows.append((k, ". ".join(map(" ".join, t)) + ".", int(k % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("doc_id < 800"))
    got = toxicity.score(df, machine).where("doc_id >= 800").toPandas()
    assert ((got["toxicity"] >= toxicity.TOXIC) == (got["toxic"] == 1)).mean() > 0.98
    x = np.random.default_rng(1).integers(0, 5, (60, 4)).astype(float)
    assert all((toxicity._front(x) @ w).max() == (x @ w).max() for w in np.random.default_rng(2).integers(0, 9, (50, 4)).astype(float))


def test_forgetting_words_changes_nothing(monkeypatch):
    m = toxicity.fit_words([("moron", 5.0), ("scum", 4.0)], ["there", "inan", "rere", "onth"])
    texts = ["there moron", "inan scum rere", "a b c"]
    want = m.best_tokens(texts)
    monkeypatch.setattr(toxicity, "MEMORY", 1)
    assert [m.best_tokens([t])[0] for t in texts] == want
