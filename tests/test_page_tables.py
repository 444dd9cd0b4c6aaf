"""Page operators read the table of pages: a page there gives what the form page gives."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pagewarden import registry
from pagewarden.plans.page_queries import FORM_PAGE


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    pq.write_table(pa.table({"page_id": [1, 7], "url": ["https://x.org", "https://y.org"], "html": [FORM_PAGE, FORM_PAGE]}), d / "pages.parquet")
    pq.write_table(pa.table({"conv_id": [3, 3], "turn": [0, 1], "role": ["user", "assistant"], "text": ["max verstappen", "max verstappen"]}), d / "conversations.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["p1_visible_elements", "p4_accessible_names", "p5_sensitive_inputs", "s4_forms", "j1_label_lookup", "j4_query_name_hits"])
def test_pages_of_the_table_are_read(spark, sf_dir, name):
    of = {}
    for r in registry.queries()[name](spark, sf_dir).collect():
        of.setdefault(r.page_id, []).append(str({k: v for k, v in r.asDict().items() if k != "page_id"}))
    assert sorted(of) == [-1, 1, 7]
    assert sorted(of[1]) == sorted(of[7]) == sorted(of[-1])


def test_person_queries_of_conversations(spark, sf_dir):
    got = {r.id: r.person for r in registry.queries()["t9_person_queries"](spark, sf_dir).collect()}
    assert sorted(got) == [-3001, 1, 2, 3, 4] and got[-3001] == got[1]
