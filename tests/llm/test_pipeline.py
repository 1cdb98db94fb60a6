"""The pipeline on a small made-up corpus: what each stage must drop, mask and keep."""

import base64
import random

import corpus_pipeline
from stagewise.llm.common import stored


def corpus():
    """Rows of documents, and what is planted in them."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("ri", "bo", "lan", "mer", "tol", "ves") for b in (
        "ver", "at", "den", "sin", "kor", "lum", "pa", "ent")]

    def prose(n=40):
        return "\n".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() + "."
                         for _ in range(n // 9 + 1))

    good = [(d, prose()) for d in range(150)]
    bad = [(d, "\n".join(rng.choice(["BUY!! NOW!! $$$ &&&", "%%% ### $$$ &&& ***"])
                         for _ in range(5))) for d in range(150, 260)]
    hidden = base64.b64encode(b"password=hunter22hunter").decode()
    far = base64.b64encode(("é" * 60 + " token=abcdef123456 " + "z" * 200).encode()).decode()
    secret = [(300, prose() + f"\n{prose(9)} {hidden}"), (301, prose() + f"\nid_{hidden} there"),
              (302, prose() + "\nsecret: swordfish99 was said"), (303, prose() + f"\n{far}")]
    one, other = prose(), prose()
    no_id = [(None, one), (None, other), (400, prose()), (400, prose())]
    copies = [(500 + i, good[3][1]) for i in range(5)]
    labels = [(d, 1, 0) for d, _ in good] + [(d, 0, 0) for d, _ in bad]
    return good, bad, secret, no_id, copies, labels


def test_pipeline(spark, tmp_path):
    good, bad, secret, no_id, copies, labels = corpus()
    rows = good + bad + secret + no_id + copies
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], schema).repartition(
        3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = results[name] = stored(stage(spark, docs, str(tmp_path)))
        if name != "packing":
            assert docs.columns == names
    kept = [(r.doc_id, r.text) for r in results["quality_classifier"].collect()]
    assert {d for d, _ in kept} >= {d for d, _ in good + secret} - {None}
    assert not {d for d, _ in kept} & {d for d, _ in bad}
    # Of the copies one is left with its lines, the others have lost them and fall together;
    # unlike documents stay, whatever their ids.
    near = [(r.doc_id, r.text) for r in results["simhash_near_dedup"].collect()]
    assert {d for d, _ in near} >= {d for d, _ in good + secret} - {None}
    assert sum(d is None and t != "" for d, t in near) == 2
    assert sum(d == 400 for d, _ in near) == 2
    masked = {r.doc_id: r.text for r in results["secret_scan"].collect()}
    for d in (300, 301, 302, 303):
        assert "[SECRET]" in masked[d]
        assert "hunter" not in masked[d] and "swordfish" not in masked[d]
    assert "cGFzc3dvcmQ9aHVudGVyMjJodW50ZX" not in masked[300] + masked[301]
    assert base64.b64encode(b"oken=abcdef123456").decode()[:12] not in masked[303]
    pieces = results["packing"].collect()
    assert {p.doc_id for p in pieces} == set(masked)
    cells = sorted(p.sequence_id * 2048 + p.offset + i for p in pieces for i in range(p.length))
    assert cells == list(range(sum(p.length for p in pieces)))


def test_stages_take_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)))
        assert docs.collect() == []
