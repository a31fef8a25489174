"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings only, so they can be applied to a session somebody else built.
# Skewed join keys are split by AQE even where that costs one more exchange.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A shuffle of a few kilobytes can feed much processor work (a model per series): AQE may keep
    # as many tasks as there are cores for it.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    "spark.sql.ansi.enabled": "true",
    # The JVM does not compile methods above 8000 bytecodes; wide row expressions then run
    # interpreted. Beyond the limit Spark splits the projection into methods that compile.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Models are nested functions over arrays, and each level of nesting takes the analyzer one round.
    "spark.sql.analyzer.maxIterations": "1000",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: str = "8") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("demandloom")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Static: expressions are built in bulk, and recording a call site for each one
        # costs more than the rest of the planning.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def cut_lineage(df):
    """Reliable checkpoint in the shared folder the cluster names; a temporary one only where none is set."""
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        context.setCheckpointDir(folder)
    elif context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for tables of one run, under the shared folder the cluster names in spark.checkpoint.dir.

    It lies in a folder of the application's id, to be removed when the application is done.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        import tempfile

        return tempfile.mkdtemp(prefix="tables-")
    import uuid

    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}/tables-{uuid.uuid4().hex}"
