"""Results kept by name."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def not_there(error: AnalysisException) -> bool:
    """Whether a read failed because nothing is stored at the path, and for no other reason."""
    return error.getCondition() == "PATH_NOT_FOUND"


def inputs_key(spark, inputs) -> str:
    """A short name for the present state of input files: their paths, sizes and times of change."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(inputs)).select(
        "path", "length", "modificationTime")  # the contents are not read
    rows = sorted(map(str, found.collect()))  # one row a file
    return hashlib.sha1("\n".join(rows).encode()).hexdigest()[:16]


def cached(spark, path: str, build, inputs=()) -> DataFrame:
    """The result stored at a path, built and stored first if there is none. With ``inputs``, paths of the files that
    it is built from, it is kept for their present state, so changed inputs are not answered with an old result."""
    if inputs:
        path = f"{path}/{inputs_key(spark, inputs)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if not not_there(error):
            raise
        build().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)
