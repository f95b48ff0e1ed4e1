"""The registered queries and the pipeline, as the driver calls them, against plain versions of their contracts."""

import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from test_operators import brute_components, brute_fingerprint, brute_links, check_packing, distance, expected_ids

NAMES = ["op1_language_id", "op2_backoff_lm", "op3_nn_descent", "op4_decontaminate", "op5_external_shuffle", "op6_simhash", "op7_ordinal_quality", "op8_lexical_packing",
         "op9_toxicity", "op10_binary_records", "pipeline"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def run(spark, sf, name):
    return entry.queries()[name](spark, sf)


def test_all_are_registered_without_sql():
    assert set(NAMES) <= set(entry.queries()) and not set(NAMES) & set(entry.oracle_sql())


def test_op1(spark, sf, docs):
    df = run(spark, sf, NAMES[0])
    assert dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    rows = df.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in rows)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"]]) > 0.95


def test_op2(spark, sf, docs):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    toks = {i: (d["text"] or "").encode().translate(low).split() + [b"\n"] for i, d in docs.items()}
    c = {}
    for i, t in toks.items():
        if fold(i, 10):
            for w in t:
                c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    rows = run(spark, sf, NAMES[1]).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = toks[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(r["doc_id"], 10) == 0, len(t), sum(w in c for w in t), n)
        assert np.isclose(r["base_score"], sum(np.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t), rtol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op3(spark, sf):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {r["vec_id"]: tuple(r)[1:] for r in run(spark, sf, NAMES[2]).collect()} == brute_links(vectors, 0.95)


def test_op4(spark, sf, docs):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in run(spark, sf, NAMES[3]).collect()}
    assert {(i, k) for i, d in docs.items() for k, p in items.items() if p in d["text"]} <= set(got)
    plain = lambda t: "".join(" " if c.isspace() else c.lower() for c in t)
    for i in [i for i, d in docs.items() if len(d["text"]) < 300][:8]:
        for k in list(items)[:10]:
            d = distance(plain(items[k]), plain(docs[i]["text"]))
            assert ((i, k) in got) == (d <= len(items[k]) // 10)


def test_op5(spark, sf, docs):
    rows = run(spark, sf, NAMES[4]).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
    slots = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(24)}
    assert all(v == list(range(len(v))) for v in slots.values()) and len({len(v) for v in slots.values()}) <= 2
    for r in rows:
        b = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(b) + 8, zlib.crc32(b))


def test_op6(spark, sf, docs):
    fps = [(i, brute_fingerprint(d["text"], 3)) for i, d in docs.items()]
    comp = brute_components(fps, 3)
    assert {r["doc_id"]: tuple(r)[1:] for r in run(spark, sf, NAMES[5]).collect()} == {i: (f"{x:016x}", comp[i]) for i, x in fps}


def test_op7(spark, sf, docs):
    rows = run(spark, sf, NAMES[6]).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(0 <= r["expected"] <= 1 and r["kept"] == (r["tail"] >= 0.4) for r in rows)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert np.mean([r["kept"] == (label[r["doc_id"]] == 1) for r in rows if r["doc_id"] in label]) > 0.95


def test_op8(spark, sf, docs):
    df = run(spark, sf, NAMES[7])
    assert df.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ids = dict(expected_ids([(i, d["text"]) for i, d in docs.items()]))
    at = {}
    for r in sorted(df.collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids[r["doc_id"]])
        at[r["doc_id"]] = r["start"] + r["length"]
        assert zlib.crc32(np.array(ids[r["doc_id"]][r["start"]:at[r["doc_id"]]], "<u4").tobytes()) == r["ids_crc32"]
    assert at == {i: len(x) for i, x in ids.items()}


def test_op9(spark, sf, docs):
    rows = run(spark, sf, NAMES[8]).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in rows)


def test_op10(spark, sf, docs):
    rows = sorted(map(tuple, run(spark, sf, NAMES[9]).collect()))
    start, want = 0, []
    for i, ids in expected_ids([(i, docs[i]["text"]) for i in sorted(docs)]):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows == want


def brute_overlap_groups(rows, k=5, least=0.8):
    """The smallest id reachable through pairs whose sets of k-word shingles overlap by `least` or more, every pair compared."""
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(low)) for i, t in rows}
    sets = {i: {tuple(w[j:j + k]) for j in range(max(len(w) - k + 1, min(len(w), 1)))} for i, w in words.items()}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b) and comp[i] != comp[j]:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = {n: new if c == old else c for n, c in comp.items()}
    return comp


def test_near_duplicate_stage_on_all_of_a_larger_table(spark):
    """Recall and false drops over every pair of sf0.01, before the other stages."""
    import corpus_pipeline

    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    comp = brute_overlap_groups([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()])
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, "").select("doc_id").collect()]
    assert sorted(got) == sorted(i for i, c in comp.items() if i == c)


def test_pipeline_stages(spark, sf, docs):
    """Each stage against a plain version on what its predecessor kept."""
    import corpus_pipeline
    from wardline.llm import quality, toxicity

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "decontamination", "packing"]

    def kept(name, given):
        out = steps[name](spark, given, sf)
        assert out.columns == frame.columns
        rows = out.collect()
        return spark.createDataFrame(rows, frame.schema), [r["doc_id"] for r in rows]

    model = toxicity.learn(frame, labels)
    one, ids = kept("toxicity", frame)
    assert sorted(ids) == sorted(i for i, d in docs.items() if model.score(d["text"]) < toxicity.THRESHOLD)

    model = quality.learn(one, labels.selectExpr("doc_id", "quality as grade"))
    two, good = kept("quality", one)
    assert sorted(good) == sorted(i for i in ids if model.tails(model.features.rows([docs[i]["text"]]).astype(float))[0, 0] >= quality.KEEP)

    comp = brute_overlap_groups([(i, docs[i]["text"]) for i in good])
    three, single = kept("near_duplicates", two)
    assert sorted(single) == sorted(i for i in good if comp[i] == i)
    assert len({docs[i]["text"] for i in single}) == len(single)

    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    four, clean = kept("decontamination", three)
    assert set(clean) <= set(single) and not any(p in docs[i]["text"] for i in clean for p in items)
    assert {i for i in single if not any(p[j:j + 12] in docs[i]["text"] for p in items for j in range(len(p) - 11))} <= set(clean)

    rows = steps["packing"](spark, four, sf).collect()
    check_packing(rows, expected_ids([(i, docs[i]["text"]) for i in clean]))
    whole = entry.queries()["pipeline"](spark, sf).select("doc_id", "start", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows)
