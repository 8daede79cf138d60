import importlib
import re

import __spark_entry__ as entry


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    core = [n for n in queries if n != "pipeline" and not re.match(r"op\d+_", n)]
    assert len(core) > 300 and all(re.match(r"[a-z]{2,3}\d\d_", n) for n in core)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "gid", "rank", "score"] and df.count() > 0


def test_core_does_not_need_the_corpus_part():
    import sys

    kept = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith("stratalens.llm") or k == "corpus_pipeline"}
    try:
        registry = importlib.import_module("stratalens.plans.registry")
        assert registry.QUERIES and not any(k.startswith("stratalens.llm") for k in sys.modules)
    finally:
        sys.modules.update(kept)
