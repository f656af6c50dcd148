"""The pipeline's stages on planted documents, each against a plain statement of what it must do."""

import random

import corpus_pipeline as P
from tests.llm.test_lines_and_fingerprints import plain_dedup
from tests.llm.test_near_duplicates import near, plain_components, plain_fingerprint
from tests.llm.test_scans import plain_contamination

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, tmp_path):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("aeiourstln", k=rng.randrange(3, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    texts, toxic = [], {}
    for i in range(240):
        t = "\n".join(prose(rng.randrange(8, 40)) for _ in range(rng.randrange(1, 5)))
        toxic[i] = int(i % 6 == 0)
        if toxic[i]:
            t += " " + " ".join(rng.choices(["grimsplat", "vorknast", "bluzzdarg"], k=4))
        texts.append(t)
    item = prose(25)
    copy = "\n".join(prose(30) for _ in range(3))
    # Planted: a line in twelve documents, copies and near copies, a benchmark passage, a toxic document, odd texts.
    texts = [t + "\nSubscribe to our letter " if 1 <= i % 20 <= 1 else t for i, t in enumerate(texts)]
    planted = {"copies": [copy, copy, copy + " end"], "leak": ["start " + " ".join(item.split()[3:20])], "toxic": ["so " + "grimsplat vorknast " * 3 + prose(9)], "odd": ["", None]}
    where = {}
    for kind, more in planted.items():
        where[kind] = list(range(len(texts), len(texts) + len(more)))
        texts += more
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0, y) for i, y in toxic.items()]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, where, toxic, [(1, item), (2, None)]


def test_stages_and_run(spark, tmp_path):
    sf_dir, rows, where, toxic, items = make(spark, tmp_path)
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "bpe"]
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{sf_dir}/stage{k}")
        docs = spark.read.parquet(f"{sf_dir}/stage{k}")
        kept.append({r.doc_id: r for r in docs.collect()})
    first, second, third, fourth, last = kept

    gone = {i for i, *_ in rows} - set(first)
    clean = [i for i, y in toxic.items() if not y]
    assert set(where["toxic"]) <= gone and not gone & {*where["copies"], *where["leak"], *where["odd"]}
    assert len(gone & set(clean)) <= 0.03 * len(clean)

    order = sorted(first)
    want = plain_dedup([first[i].text for i in order], 10)
    assert [(second[i].text, second[i].n_chars) for i in order] == [(t, len(t)) for t, _, _ in want]
    assert not any("Subscribe" in r.text for r in second.values())

    fps = {i: plain_fingerprint(r.text) for i, r in second.items()}
    values = sorted(set(fps.values()))
    root = plain_components(values, near(values))
    least = {}
    for i in sorted(fps):
        least.setdefault(root[fps[i]], i)
    assert set(third) == set(least.values()) and len(set(third) & set(where["copies"])) == 1

    assert set(fourth) == {i for i, r in third.items() if not plain_contamination(r.text, items)[1]}
    assert not set(fourth) & set(where["leak"])

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.word_vocabulary())
    assert {i: r.ids for i, r in last.items()} == {i: tokenizer.encode(r.text or "", add_special_tokens=False).ids for i, r in fourth.items()}
    again = {r.doc_id: (r.text, r.ids) for r in P.run(spark, sf_dir).collect()}
    assert again == {i: (r.text, r.ids) for i, r in last.items()}


def test_stages_on_no_documents(spark, tmp_path):
    sf_dir, *_ = make(spark, tmp_path)
    docs = spark.createDataFrame([], COLUMNS)
    for name, stage in P.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
