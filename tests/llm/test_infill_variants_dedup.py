"""Fill-in-the-middle, spelling variants and streaming deduplication against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from test_operators import MESSY, SCHEMA
from wardline.llm import exact_dedup, infill, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# fill in the middle


def test_ranks_against_counting():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        seq = rng.integers(0, 5, n)
        m = infill.WaveletMatrix(seq)
        at = np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, 40)]))
        for c in range(5):
            assert m.rank(c, at).tolist() == [int((seq[:i] == c).sum()) for i in at]


UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"(?s)\A[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|\A[\x20\x09-\x0D]+\Z"}


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_units_and_cuts_against_regular_expressions(unit):
    random.seed(5)
    items = ["", "\n", "\n\n", "a", "a\n", " ", " a", "é", "😀\né b\n\n c", *("".join(random.choice(["a", "é", "漢", "😀", " ", "\n", "\t", "bc"]) for _ in range(random.randint(0, 40))) for _ in range(300))]
    data = np.frombuffer("".join(items).encode(), np.uint8)
    size = np.array([len(t.encode()) for t in items])
    end = np.cumsum(size)
    u = infill.Units(data, end - size, end, unit)
    found = [re.findall(UNITS[unit], t) for t in items]
    assert u.n.tolist() == [len(f) for f in found]
    for share in (0, 0.3, 0.7, 1):
        k = (u.n * share).astype(np.int64)
        assert u.chars(u.cut(k)).tolist() == [len("".join(f[:x])) for f, x in zip(found, k)]


def plain_infill(doc_id, text, unit, rate=100, spm=50, seed=7):
    t = text or ""
    units = re.findall(UNITS[unit], t)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, t
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc_id, len(units), form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit,rate,spm", [("line", 100, 50), ("word", 60, 0), ("char", 100, 100)])
def test_infill_on_awkward_tables(spark, unit, rate, spm):
    rows = [*MESSY, (8, "holds <S> itself\n", None, None, None), (9, "\r\n\n x", None, None, None), (10, "a\n" * 70_000, None, None, None), (11, "é\n漢😀\nz", None, None, None)]
    out = infill.fill_in_middle(spark.createDataFrame(rows, SCHEMA), unit, rate, spm)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = [tuple(r) for r in out.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()]
    assert sorted((r[:6] for r in back), key=repr) == sorted((plain_infill(r[0], r[1], unit, rate, spm) for r in rows), key=repr)
    assert sorted((r[0] or -1, r[6]) for r in back) == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert infill.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


def test_op11(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = [(*w[:5], hashlib.sha256(w[5].encode()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
            for d in docs for w in [plain_infill(d["doc_id"], d["text"], "line")]]
    got = entry.queries()["op11_wavelet_infill"](spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and "op11_wavelet_infill" in entry.oracle_sql()


# spelling variants


def one_edit(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1:] == u for i in range(len(v)))


def plain_counts(rows, shortest=6, fewest=5):
    n = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= shortest:
                n[w] = n.get(w, 0) + 1
    return {w: c for w, c in n.items() if c >= fewest}


def plain_variants(n, factor=5):
    by_part = {}
    for w in n:  # words at one edit share a half; compare within
        for a in (len(w), len(w) - 1):
            for key in ((a, w[:a // 2]), (a, "-", w[len(w) - (a - a // 2):])):
                by_part.setdefault(key, []).append(w)
    near = {w: set() for w in n}
    for group in by_part.values():
        for i, u in enumerate(group):
            for v in group[:i]:
                if abs(len(u) - len(v)) < 2 and one_edit(u, v):
                    near[u].add(v)
                    near[v].add(u)
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def shown(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_bit_recurrences_against_all_pairs():
    random.seed(2)
    for a in (1, 2, 3, 7):
        words = sorted({"".join(random.choice("abé") for _ in range(random.choice([a, a + 1]))) for _ in range(300)})
        others = sorted({"".join(random.choice("abc") for _ in range(random.choice([a, a + 1]))) for _ in range(200)})
        for right in (words, others):
            want = {(i, j) for i, u in enumerate(words) for j, v in enumerate(right) if one_edit(u, v) and min(len(u), len(v)) == a}
            got = variants.near_in_block(words, right, a, queries=50)
            assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("block", [7, 2048])
def test_variants_against_all_pairs_and_chains(spark, block):
    random.seed(block)
    base = ["".join(random.choice("abcdé") for _ in range(random.randint(1, 8))) for _ in range(150)]
    words = {w: random.randint(1, 9) * random.choice([1, 6, 40, 300]) for w in base}
    for w in base:
        words.setdefault(w[:2] + random.choice("xyz") + w[3:], random.randint(1, 5))
    words |= {"aaaaaa": 1000, "aaaaab": 150, "aaaabb": 20, "aaabbb": 3, "q" * 3000: 2, "q" * 2999 + "r": 50}
    words.pop("", None)
    want = plain_variants(words)
    assert shown(variants.variants(spark.createDataFrame(sorted(words.items()), "word string, n long"), 5, block)) == want
    assert [r[2] for r in want if r[0] == "aaabbb"] == ["aaaaaa"] or [r[1] for r in want if r[0] == "aaabbb"] != ["aaaabb"]


def test_variants_on_awkward_tables(spark):
    long = " ".join(f"Wörter{'abcdefghij'[i % 10]}" for i in range(50_000))
    rows = [*MESSY, (20, long, None, None, None), (21, "ÉCOLES écoles ×÷×÷×÷ " * 6, None, None, None), (None, "misspelt " * 7, None, None, None), (None, "mispelt " * 7, None, None, None)]
    got = shown(variants.spelling_variants(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain_variants(plain_counts([r[:2] for r in rows])) and {"misspelt", "Écoles"} <= {r[0] for r in got}
    assert variants.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        variants.variants(spark.createDataFrame([("a", 1)], "word string, n long"), factor=1)


def test_op12(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = entry.queries()["op12_spelling_variants"](spark, sf)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert shown(got) == plain_variants(plain_counts(map(tuple, docs)))


# streaming deduplication


def plain_dedup(rows):
    """rows: (doc_id, text) in file and row order."""
    groups = {}
    for at, (i, t) in enumerate(rows):
        groups.setdefault((t or "").translate(LOWER), []).append((i is not None, i or 0, at))
    out = []
    for t, members in groups.items():
        keep = max(members)
        out += [(i if known else None, keep[1] if keep[0] else None, len(members), (known, i, at) == keep, hashlib.sha256(t.encode()).hexdigest()) for known, i, at in members]
    return sorted(out, key=repr)


def test_dedup_on_awkward_tables(spark, tmp_path):
    rows = [*MESSY, (12, "HELLO WORLD, hello!", "en", 1, 1.0), (13, "ÉTÉ À LA MER", "fr", 1, 1.0), (None, "No id here", "en", 1, 1.0)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    got = exact_dedup.stream_dedup(spark, path)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_dedup([r[:2] for r in rows])
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], SCHEMA).write.parquet(empty)
    assert exact_dedup.stream_dedup(spark, empty).collect() == []


def test_dedup_goes_on_from_its_state(spark, tmp_path):
    """Files that come later meet the state of earlier ones, in one batch per file; a folder without news gives the same rows."""
    path, home = str(tmp_path / "in"), str(tmp_path / "home")
    lots = [[(i, f"Text {i % 7}") for i in range(20)], [(100, "text 3"), (101, "new"), (102, None)], [(5000, "TEXT 3"), (50, "NEW"), (51, "")]]
    seen = []
    for lot in lots:
        spark.createDataFrame(lot, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
        seen += lot
        for _ in range(2):
            assert sorted(map(tuple, exact_dedup.stream_dedup(spark, path, home, files_per_batch=1).collect()), key=repr) == plain_dedup(seen)
    together = exact_dedup.stream_dedup(spark, path, str(tmp_path / "other"), files_per_batch=1)
    assert sorted(map(tuple, together.collect()), key=repr) == plain_dedup(seen)


def test_a_shared_digest_does_not_merge_texts(spark, tmp_path):
    """With a digest of one hex digit nearly every digest holds different texts; contents tell them apart."""
    rows = [(i, f"Text {i % 40}") for i in range(120)] + [(500, "text 7"), (None, "lone")]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    got = exact_dedup.stream_dedup(spark, path, digest=lambda t: F.substr(exact_dedup.text_digest(t), F.lit(1), F.lit(1))).collect()
    want = plain_dedup(rows)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((*w[:4], w[4][:1]) for w in want), key=repr)


def test_op13(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = entry.queries()["op13_stream_dedup"](spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"}
    assert sorted(map(tuple, got.collect()), key=repr) == plain_dedup(map(tuple, docs)) and "op13_stream_dedup" in entry.oracle_sql()
