import importlib.util

import pytest

NULLS = [(None, "a null id has a text of five words or more"), (None, None)]


@pytest.fixture(scope="session")
def tokenizer():
    if importlib.util.find_spec("public_tokenizers") is None:
        pytest.skip("no tokenizer files")
    from marketlens.llm.queries import tokenizer_path

    return tokenizer_path()


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def table(spark):
    def make(rows, clash=False):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if clash:  # extra columns with the names that operators use
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(c) for c in ("p", "n", "rid", "gone", "all", "rest", "node", "judge", "line", "score", "predicted", "tokens", "key", "part", "row", "_bad", "_gone", "target", "component", "kept")})
        return df

    return make
