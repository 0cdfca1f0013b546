import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"


def local(df) -> pd.DataFrame:
    return pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)


@pytest.fixture(scope="session")
def docs(spark):
    """doc_id and text of the smallest table."""
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)
