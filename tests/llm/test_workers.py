"""What a stage makes in a Python worker goes when the worker is given to another stage."""

import pyarrow as pa
import public_tokenizers

from codestrata.llm import arrow, bpe
from codestrata.llm.pipeline import BPE_RANKS


def test_a_codec_goes_with_its_stage(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(8)
    assert bpe.encode_documents(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN).count() == 400

    def held(batches):
        for batch in batches:
            yield {"n": pa.array([len(arrow._kept)] * batch.num_rows)}

    assert {r["n"] for r in arrow.map_rows(docs, "n int", held).collect()} == {0}
