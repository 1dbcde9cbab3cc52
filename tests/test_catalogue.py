"""Every query against its SQL twin on whole tables, and those without one against known answers."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lectern.plans import catalogue
from tests.compare import duck, same


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql_twin(name, spark, sf, con):
    same(catalogue.QUERIES[name](spark, sf), con, catalogue.ORACLES[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200


def test_reference_titles_inferred(spark, sf):
    rows = catalogue.QUERIES["reference_title_inference"](spark, sf).collect()
    assert {(r.title, r.mode) for r in rows if r.number == 1} == {(None, "worker")}


def test_concept_links_once_per_section(spark, sf):
    linked = [r.linked for r in catalogue.QUERIES["concept_links"](spark, sf).collect()]
    # The planted sentence names its part twice, and links it once.
    assert len(linked) == 200 and set(linked) <= {0, 1} and sum(linked) >= 1


def test_readiness_counts_errors(spark, sf):
    rows = catalogue.QUERIES["readiness"](spark, sf).collect()
    assert len(rows) == 200 and not any(r.ready for r in rows) and all(r.n_errors >= 3 for r in rows)


@pytest.mark.parametrize("name", ["bilingual_layout", "packet_summary", "passthrough_units", "prepared_validation", "translation_units", "merged_notes", "transport_metrics"])
def test_a_sentence_of_one_letter_is_a_unit_as_in_the_twin(spark, tmp_path, name):
    rows = {"doc_id": [4616, 5, 6], "text": ["A.", "É.", "One. A."], "lang": ["en"] * 3, "source": ["s"] * 3, "n_chars": [2, 2, 7]}
    pq.write_table(pa.table(rows), tmp_path / "documents.parquet")
    same(catalogue.QUERIES[name](spark, str(tmp_path)), duck(tmp_path), catalogue.ORACLES[name])
