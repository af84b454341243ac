import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """A DataFrame from a matrix: columns x0.., y and id."""
    import numpy as np

    def make(x, y=None, parts=3):
        x = np.asarray(x, float)
        names = [f"x{i}" for i in range(x.shape[1])]
        rows = [(i, *map(float, r), *([] if y is None else [y[i].item() if hasattr(y[i], "item") else y[i]])) for i, r in enumerate(x)]
        return spark.createDataFrame(rows, ["id", *names, *([] if y is None else ["y"])]).repartition(parts), names

    return make
