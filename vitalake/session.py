"""Session settings every job in this package relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# UTC so that labels and windows do not depend on the machine; ANSI so that a bad cast is an
# error and not a silent NULL; AQE so that partition counts, broadcast and skew splits follow
# the measured sizes of a stage and not a guess.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot does not compile methods over 8,000 bytes; past that, smaller generated methods win.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a running session; partition counts stay as the cluster set them."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@lru_cache(maxsize=1)
def own_folder() -> str:
    """One folder of this process for what a session on this machine alone shares; it goes when the process ends."""
    folder = tempfile.mkdtemp(prefix="vitalake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def local_session(cores: int | str = 8, name: str = "vitalake", memory: str = "12g") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", own_folder())
        # Call sites of columns are kept for error messages only, and cost a third of planning.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Bytes of input per shuffle partition: a partition then sorts in the memory of one task.
SHUFFLE_BYTES = 256 * 1024**2


def bytes_under(spark: SparkSession, path: str) -> int:
    """Size of the files under a path, from the file listing: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.sum("length")).first()[0] or 0


# Shuffle partitions at most: map tasks times these is the number of blocks a shuffle has to serve. Partitions
# then grow beyond SHUFFLE_BYTES and sort on disk; no data is left out.
MAX_PARTITIONS = 50_000


def size_shuffles(spark: SparkSession, input_bytes: int, per_partition: int = SHUFFLE_BYTES) -> int:
    """Raise the number of shuffle partitions to fit an input; AQE merges those that end up small.

    AQE splits no partition but those of skewed joins, so too few of them is what it cannot mend.
    """
    wanted = min(-(-input_bytes // per_partition), MAX_PARTITIONS)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    return parts


def shared_dir(spark: SparkSession, name: str) -> str:
    """Folder `name` under the shared folder the cluster names in spark.checkpoint.dir.

    Only a session on this machine alone may go without that setting; it gets the folder of its process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder all executors share")
        root = own_folder()
    return f"{root.rstrip('/')}/{name}"
