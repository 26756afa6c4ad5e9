"""What a tuned session bounds."""

import pyarrow as pa
from pyspark.sql import functions as F


def test_batches_to_python_are_bounded(spark):
    texts = spark.range(0, 30, 1, 1).select(F.repeat(F.lit("ab "), 350_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    found = [r["bytes"] for r in texts.mapInArrow(sizes, "bytes long").collect()]
    assert sum(found) >= 30 * 1_050_000 and max(found) <= (4 << 20) + 1_100_000
