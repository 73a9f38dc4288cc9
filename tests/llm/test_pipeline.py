"""The registered queries on the smallest data, and the pipeline against plain Python."""

import importlib
import sys
from pathlib import Path

import pytest
from check import duck, table

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_dedup import near_classes  # noqa: E402
from test_tokens import check_packing  # noqa: E402
from wayfold.llm import secrets, toxicity  # noqa: E402
from wayfold.llm.queries import QUERIES, TWINS  # noqa: E402


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(name, spark, folder):
    df = QUERIES[name](spark, folder)
    cur = duck(folder).execute(TWINS[name])
    assert table([tuple(r) for r in df.collect()], df.columns) == table(cur.fetchall(), [d[0] for d in cur.description])


def test_one_query_per_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


def test_stages(spark, folder, documents):
    docs, columns = documents, documents.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "secrets", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())

    clean = stage["toxicity"](spark, docs, folder)
    rejected = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.predicted}
    assert clean.columns == columns and texts(clean) == [t for t in texts(docs) if t[0] not in rejected]

    once = stage["exact_dedup"](spark, clean, folder)
    first = {}
    for i, text in texts(clean):
        first.setdefault(" ".join((text or "").split(" ")), (i, text))
    assert once.columns == columns and len(texts(once)) <= len(first)

    apart = stage["near_dedup"](spark, once, folder)
    assert apart.columns == columns and [i for i, _ in texts(apart)] == sorted({c for _, c, _ in near_classes(texts(once))})

    bare = stage["secrets"](spark, apart, folder)
    ranks = secrets.dictionary(apart)
    assert bare.columns == columns and texts(bare) == [(i, secrets._redacted(t, ranks)) for i, t in texts(apart)]
    assert all(r.n_chars == len(r.text) for r in bare.collect())

    used, least = check_packing(stage["packing"](spark, bare, folder).collect(), texts(bare))
    assert used <= least + 1


def test_empty_documents(spark, folder, documents):
    docs = documents.where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_the_entry_works_without_this_package(monkeypatch):
    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("wayfold.llm")]:
        monkeypatch.delitem(sys.modules, name)
    real = importlib.import_module

    def gone(name, *more):
        if name in entry.OPTIONAL:
            raise ModuleNotFoundError(name=name)
        return real(name, *more)

    monkeypatch.setattr(entry, "import_module", gone)
    assert not [n for n in entry.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
