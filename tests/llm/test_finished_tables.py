"""What the steps of the join wrote goes when the next has written."""

from __future__ import annotations

import os
import random
from urllib.parse import urlparse

from quantloom.llm import components, jaccard
from quantloom.shared import shared_folder


def left(spark) -> list[str]:
    return sorted(x.rsplit("-", 1)[0] for x in os.listdir(urlparse(shared_folder(spark)).path))


def test_finished_tables_are_deleted(spark):
    before = left(spark).count("links")
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in components.connected_components(chain).collect()} == {0}
    assert left(spark).count("links") == before + 1

    rng = random.Random(3)
    texts = [[str(rng.randrange(999)) for _ in range(60)] for _ in range(6)]
    docs = spark.createDataFrame([(10 * i + k, " ".join(x[: 60 - k])) for i, x in enumerate(texts) for k in range(2)], "doc_id long, text string")
    was = {x: left(spark).count(x) for x in ("op3-blocks", "op3-groups", "op3-near", "op3-members")}
    got = {r.doc_id: r.component_id for r in jaccard.similarity_classes(docs).collect()}
    assert got == {10 * i + k: 10 * i for i in range(6) for k in range(2)}
    assert {x: left(spark).count(x) for x in was} == was
