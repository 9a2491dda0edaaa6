"""A table extracted in stripes of right ascension: resumable, and read back by the stripes that a range touches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Stripes:
    """``count`` stripes of equal width over 360 degrees in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, count: int = 12):
        self.spark, self.root, self.count, self.width = spark, root.rstrip("/"), count, 360.0 / count

    def _done(self, k: int) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/stripe={k}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def missing(self) -> list[int]:
        return [k for k in range(self.count) if not self._done(k)]

    def extract(self, df: DataFrame, ra: str = "ra") -> list[int]:
        """Writes the stripes that aren't there yet and returns them; an extract that broke off goes on where it stopped.

        Each stripe is a query of its own for ra >= low and ra < high, which a source with statistics
        prunes. Rows without a right ascension in [0, 360) are in no stripe.
        """
        todo = self.missing()
        for k in todo:
            part = df.where((F.col(ra) >= k * self.width) & (F.col(ra) < (k + 1) * self.width if k < self.count - 1 else F.col(ra) < 360.0))
            part.write.mode("overwrite").parquet(f"{self.root}/stripe={k}")
        return todo

    def read(self, low: float = 0.0, high: float = 360.0, ra: str = "ra") -> DataFrame:
        """Rows with low <= ra < high, from the stripes that overlap the range alone; a stripe that isn't there is an error."""
        if absent := self.missing():
            raise ValueError(f"stripes not extracted yet: {absent}")
        rows = self.spark.read.parquet(self.root)
        first, last = math.floor(low / self.width), math.ceil(high / self.width) - 1
        return rows.where(F.col("stripe").between(first, last) & (F.col(ra) >= low) & (F.col(ra) < high))
