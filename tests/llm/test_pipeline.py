"""Each stage of the pipeline against brute force on what the stage before kept, and the whole run."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_contracts import WORD, LOWER, brute_hits, brute_kept, normal  # noqa: E402
from test_neardup import brute as brute_classes  # noqa: E402

import corpus_pipeline  # noqa: E402
from foliant.llm import queries, secrets  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, written and read again as the driver does."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def table(df):
    return {r.doc_id: r for r in df.collect()}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "secret scans", "best-fit packing"]


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == COLUMNS
        assert all(r.n_chars == len(r.text) for r in df.collect() if r.text is not None)


def test_quality(stages):
    before, after = table(stages[0]), table(stages[1])
    rows = [(d, r.text or "", r.source) for d, r in before.items()]
    judged = {r[0]: k for r, k in zip(rows, brute_kept(rows, 10, 0.2), strict=True)}
    assert set(after) == {d for d, k in judged.items() if k[-2]}
    for d, r in after.items():
        assert r.text == before[d].text if judged[d][-1] == 0 else len(r.text) < len(before[d].text)


def test_near_duplicates(stages):
    before, after = table(stages[1]), table(stages[2])
    classes = brute_classes([(d, r.text) for d, r in before.items()])
    assert set(after) == {d for d, c in classes.items() if c == d}
    assert all(after[d] == before[d] for d in after) and len(after) < len(before)


def test_decontamination(spark, stages):
    before, after = table(stages[2]), table(stages[3])
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wanted = {}
    for d, words, hit, _ in brute_hits([(d, r.text or "", r.source) for d, r in before.items()], items):
        if not (hit and 20 * len(hit) >= len(words)):
            wanted[d] = [w for i, w in enumerate(words) if i not in hit]
    assert {d: WORD.findall(r.text.translate(LOWER)) for d, r in after.items()} == wanted
    assert not any(hit for _, _, hit, _ in brute_hits([(d, r.text, r.source) for d, r in after.items()], items))


def test_secrets(stages):
    before, after = table(stages[3]), table(stages[4])
    assert set(before) == set(after)
    for d, r in after.items():
        spans = secrets.all_spans(before[d].text)
        assert (r.text == before[d].text) == (not spans)
        assert not any(before[d].text[a:b] in r.text for a, _, b in spans)


def test_packing(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = stages[5].collect()
    lengths = Counter()
    for r in got:
        lengths[r.doc_id] += r.length
    assert lengths == {d: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for d, r in table(stages[4]).items()}


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, stages[5].select(names).collect()))


def test_boilerplate_goes(spark):
    shared = "The same line stands on every page here"
    rows = [(i, f"{shared}\n" + " ".join(f"own{i}x{j}" for j in range(30)), "en", "s", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert all(normal(shared) not in normal(r.text) and r.n_chars == len(r.text) for r in corpus_pipeline.quality_rules(spark, docs, SF).collect())
