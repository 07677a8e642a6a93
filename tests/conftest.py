import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stringloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    for path in glob.glob(SF + "/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.fixture(scope="session")
def texts(spark):
    """Short strings with copies, near copies and rare words; few equal distances."""
    import random
    rng = random.Random(7)
    stems = ["ivory lamp desk oak", "steel bolt hex long kit", "cotton shirt blue men", "green tea leaf organic box"]
    extra = [f"w{i:02d}" for i in range(40)]
    out = []
    for i in range(90):
        words = rng.choice(stems).split()
        words += rng.choices(extra, k=rng.randint(0, 3))
        if rng.random() < 0.3:
            words.pop(rng.randrange(len(words)))
        if rng.random() < 0.2:
            words = rng.choices(extra, k=4)
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="session")
def text_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, string string").repartition(3)
