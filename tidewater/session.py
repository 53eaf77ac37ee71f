"""Session helpers shared by every package: settings, checkpoints, sized joins."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "tidewater", cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a context: they needn't have it installed nor share a folder with the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_tidewater_shipped", False):
        return
    home = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="tidewater-")) / "tidewater.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent).as_posix())
    sc.addPyFile(str(to))
    sc._tidewater_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one only in a local session that names none (tests)."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A cluster must name one: a folder of one machine isn't shared."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(sc, "_tidewater_folder"):
        sc._tidewater_folder = tempfile.mkdtemp(prefix="tidewater-ckpt-")
    return sc._tidewater_folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: lineage ends here and survives a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str, max_rows: int = 200_000) -> DataFrame:
    """Join ``small`` (already cut, so counting it is cheap) by broadcast up to ``max_rows``, else by shuffle.

    The rows are keys and scalars of fixed width, so the row bound is a size bound. Beyond it the join is a
    sort-merge join between two exchanges, whose hot partitions adaptive execution splits.
    """
    few = small.limit(max_rows + 1).count() <= max_rows
    return big.join(F.broadcast(small) if few else small, on, how)
