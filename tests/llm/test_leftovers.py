"""The shared folder holds only results after a query has run."""

from pathlib import Path

import corpus_pipeline
import pytest

from loomgraph.llm import kmeans, mixing, neardup, ranked, suffixes
from loomgraph.shared import shared_folder

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the tables")
@pytest.mark.parametrize("query", [mixing.op1_mixing, neardup.op8_neardup, ranked.op11_ranked, suffixes.op12_suffix_dedup, kmeans.op13_kmeans, corpus_pipeline.run])
def test_only_the_result_is_left(spark, query):
    folder = Path(shared_folder(spark).replace("file:", "", 1))
    before = {p.name for p in folder.glob("loomgraph-*")}
    assert query(spark, SF).count()
    left = {p.name for p in folder.glob("loomgraph-*")} - before
    # the pipeline's last stages read what the near-duplicate and the mixing stage decided, and the documents left
    assert len(left) <= (3 if query is corpus_pipeline.run else 1)
