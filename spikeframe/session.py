"""Session defaults and lineage cutting."""

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name="spikeframe", master=None, **conf):
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # ticks repeat the same stages: equal class text lets them share compiled code
        "spark.sql.codegen.useIdInClassName": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of one task where a step's rows are known before; more rows make more tasks.
ROWS_PER_TASK = 1 << 20


def partitions_for(spark, rows):
    """The session's shuffle partitions, or more where so many rows would fill them."""
    return max(shuffle_partitions(spark), -(-rows // ROWS_PER_TASK))


def spread(df: DataFrame, rows: int, *keys) -> DataFrame:
    """Dealt by `keys` to `partitions_for` about so many rows; unchanged where one task may hold them all.

    The number is given, so adaptive execution merges none of them, and a grouping by the keys holds no more
    than a task's rows: without it, it would start inside the tasks of the files, whose rows follow the files' size.
    """
    return df.repartition(partitions_for(df.sparkSession, rows), *keys) if rows > ROWS_PER_TASK else df


def ensure_checkpoint_dir(spark):
    """Use the shared folder the cluster names; only local runs get one of their own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spikeframe-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and keeps the hash partitioning."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark, name):
    """A new folder below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rsplit('/', 1)[0]}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, *by) -> DataFrame:
    """The rows, written as Parquet (in a folder for each value of `by`) and read again.

    Their size is then the files' size. A checkpoint keeps the estimate of the plan it cuts off: joins multiply
    estimates, so a loop of joins of its own results squares them every round, until the number alone fills the driver.
    """
    schema = df.schema
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def delete_folder(spark, path):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def ship_package(spark):
    """Put this package on the executors' Python path, once per Spark context.

    The driver serves the archive itself, so it lies in the driver's own temporary folder.
    """
    context, root = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(root)
    if any(f.endswith(f"/{name}.zip") for f in context.listFiles):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-code-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)
