"""Tables that several queries of a session read again and again, made once and cut from their lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_kept: dict[tuple[str, str, str], DataFrame] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    return folder


def kept(spark: SparkSession, sf: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` as a checkpoint in the folder that ``spark.checkpoint.dir`` names, one for each application, input and name.

    Tables of applications that have ended are forgotten here; their files lie
    in the shared folder, whose owner clears it. Without the setting a
    temporary folder serves, in local mode only.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    for key in [k for k in _kept if k[0] != context.applicationId]:
        del _kept[key]
    key = (context.applicationId, sf, name)
    if key not in _kept:
        _kept[key] = make().checkpoint()
    return _kept[key]
