"""The queries of the training-data operators: against SQL, and on awkward and empty tables."""

import pytest

import __spark_entry__
from stratakv.llm import licenses, minhash, mixing, pieces, quality, substring, suffix, toxicity
from stratakv.llm.queries import ORACLES, QUERIES
from tests.helpers import SMALL, against_duckdb
from tests.llm.helpers import awkward


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    against_duckdb(QUERIES[name](spark, SMALL), ORACLES[name])


def test_all_are_registered():
    known = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in known if k.startswith("op") and k[2].isdigit()}
    assert "pipeline" in known


WORK = {
    "quality": quality.judge,
    "minhash": lambda d: minhash.classes(d),
    "substring": lambda d: substring.dedup(d),
    "substring_digest": lambda d: substring.dedup(d, digest=True),
    "suffix": suffix.dedup,
    "mixing": lambda d: mixing.mix(mixing.sizes_of(d)),
    "emit": mixing.emit,
    "pieces": lambda d: pieces.encode(d, pieces.vocabulary(), check=True),
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, d.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic"))),
    "licenses": licenses.scan,
}
ONE_FOR_ONE = ("quality", "minhash", "substring", "substring_digest", "suffix", "mixing", "pieces", "toxicity")


@pytest.mark.parametrize("name", sorted(WORK))
def test_awkward_rows(spark, name):
    docs = awkward(spark)
    found = WORK[name](docs).collect()
    if name in ONE_FOR_ONE:
        key = lambda x: (x is None, x or 0)
        assert sorted((r["doc_id"] for r in found), key=key) == sorted((r[0] for r in docs.select("doc_id").collect()), key=key)


@pytest.mark.parametrize("name", sorted(WORK))
def test_empty_table(spark, name):
    assert WORK[name](awkward(spark).limit(0)).collect() == []
