"""Incremental ingest: only files not seen before, folded additively and exactly once."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from hirecube.operators.clean import LEFT_OUT, audit_of_cells, audited_cube, clean_movements, file_audit, to_cube
from hirecube import vocab
from hirecube.operators.cube import CUBE_SCHEMA, merge_cube
from hirecube.session import checkpoint
from hirecube.sources.raw import profile_files, split_lines
from hirecube.sources.tables import VersionedTable, _only_missing, write_cube

DELTA_SCHEMA = f"{CUBE_SCHEMA}, arquivo string, batch_id bigint"
CUBE_SCHEMA_NAMES = [*vocab.CUBE_KEYS, *vocab.CUBE_MEASURES]
ROWS_PER_TASK = 250_000
LEDGER_SCHEMA = "arquivo string, tamanho bigint, modificado timestamp, batch_id bigint"


class CubeStore:
    """A cube kept as one delta per micro-batch plus an occasional merged base.

    A batch overwrites its own ``batch_id`` folder, so a replayed batch replaces
    itself instead of counting twice. Months may arrive late or in any order. Each
    version of the base names the last batch that it contains, so months of the
    base may be repaired, replaced or restored between batches. All batches of a
    store may come from any number of ``progress`` folders: the store keeps a
    ledger of the files it has taken (path, size, modification time, batch),
    written after the batch's delta, and a delta counts only once its ledger
    entry is there. A file already in the ledger is not taken again, whatever
    the progress folder; a file re-issued under the same path with another size
    or time replaces its own earlier delta, which is subtracted from a base that
    holds it. Batches are numbered by the store, one after its last.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.base = VersionedTable(spark, f"{self.root}/base")

    def put(self, delta: DataFrame, batch_id: int) -> None:
        """Rows of the cube, or cells of ``audited_cube``, whose month ``LEFT_OUT`` only the audit reads."""
        write_cube(delta, f"{self.root}/deltas/batch_id={batch_id}")

    def cells(self, batch_id: int) -> DataFrame:
        """What ``put`` wrote of ``audited_cube``."""
        return self.spark.read.schema("arquivo string, _tipo int, total_admissoes bigint").parquet(f"{self.root}/deltas/batch_id={batch_id}")

    def ledger(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER_SCHEMA).parquet(f"{self.root}/ledger")
        except AnalysisException as error:
            _only_missing(error)
            return self.spark.createDataFrame([], LEDGER_SCHEMA)

    def next_batch(self) -> int:
        """One after the last batch of the ledger or of a delta written before there was a ledger."""
        row = self.ledger().agg(F.max("batch_id")).first()[0]
        old = self.deltas().where(F.col("arquivo").isNull()).agg(F.max("batch_id")).first()[0]
        return max(-1 if row is None else row, -1 if old is None else old) + 1

    def new_files(self, files: DataFrame) -> DataFrame:
        """Of ``arquivo, tamanho, modificado``, the files that the ledger doesn't hold as they are."""
        return files.join(self.ledger(), ["arquivo", "tamanho", "modificado"], "left_anti")

    def record(self, files: DataFrame, batch_id: int) -> None:
        files.select("arquivo", "tamanho", "modificado").coalesce(1).write.mode("errorifexists").parquet(
            f"{self.root}/ledger/batch_id={batch_id}")

    def _live(self, upto: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Deltas counted up to batch ``upto`` (all if None), and those replaced by then, each with the batch that replaced it."""
        ledger = self.ledger() if upto is None else self.ledger().where(F.col("batch_id") <= upto)
        later = ledger.select("arquivo", F.col("batch_id").alias("by"))
        entries = ledger.select("arquivo", "batch_id").alias("e").join(
            later.alias("l"), (F.col("e.arquivo") == F.col("l.arquivo")) & (F.col("l.by") > F.col("e.batch_id")), "left"
        ).groupBy("e.arquivo", "e.batch_id").agg(F.min("by").alias("replaced_by"))
        deltas = self.deltas() if upto is None else self.deltas().where(F.col("batch_id") <= upto)
        old = deltas.where(F.col("arquivo").isNull()).withColumn("replaced_by", F.lit(None).cast("bigint"))
        kept = deltas.join(entries, ["arquivo", "batch_id"]).unionByName(old)
        return kept.where(F.col("replaced_by").isNull()).drop("replaced_by"), kept.where(F.col("replaced_by").isNotNull())

    def put_audit(self, outcome: DataFrame, batch_id: int) -> None:
        outcome.write.mode("overwrite").parquet(f"{self.root}/audit/batch_id={batch_id}")

    def audit(self) -> DataFrame:
        """One row per file taken from the source so far, rejected files included."""
        return self.spark.read.parquet(f"{self.root}/audit")

    def deltas(self) -> DataFrame:
        try:
            return self.spark.read.schema(DELTA_SCHEMA).parquet(f"{self.root}/deltas").where(F.col("data") != LEFT_OUT)
        except AnalysisException as error:
            _only_missing(error)
            return self.spark.createDataFrame([], DELTA_SCHEMA)

    def _contained(self) -> int:
        last = self.base.last_batch()
        return -1 if last is None else last

    def _parts(self, upto: int | None = None) -> list[DataFrame]:
        held = self._contained()
        live, replaced = self._live(upto)
        fresh = live.where(F.col("batch_id") > held).drop("batch_id", "arquivo")
        # held by the base, then replaced by a batch that the base does not hold: taken out again
        undo = replaced.where((F.col("batch_id") <= held) & (F.col("replaced_by") > held)).select(
            *[(-F.col(c)).alias(c) if c in ("soma_salario", "soma_idade", "total_admissoes") else F.col(c) for c in CUBE_SCHEMA_NAMES])
        return [fresh, undo] if self.base.current() is None else [self.base.read(schema=CUBE_SCHEMA), fresh, undo]

    def read(self, months: list[str] | None = None, snap: int | None = None) -> DataFrame:
        """The cube as of now. Months prune the partitions of the base and of every delta."""
        parts = self._parts()
        if months:
            parts = [p.where(F.col("data").isin(months)) for p in parts]
        return self._merged(parts, snap)

    def _merged(self, parts: list[DataFrame], snap: int | None = None) -> DataFrame:
        """Parts added up by key. Each part is folded already, so rows go to their key's task as they are, and a task
        gets a bounded number; partial sums in the tasks that read would only hold nearly every row of a file split."""
        rows = reduce(DataFrame.unionByName, parts)
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK))
        return merge_cube(rows.repartition(tasks, *vocab.CUBE_KEYS), snap=snap)

    def compact(self) -> int | None:
        """Fold base and deltas into a new base; safe to repeat or to lose half-way."""
        newest = self.next_batch() - 1
        newest = None if newest < 0 else newest
        held = self._contained()
        if newest is None or held >= newest:
            return None
        return self.base.write(self._merged(self._parts(newest)), "data", last_batch=newest)


def fold_lines(lines: DataFrame, profile: DataFrame | None = None, by_file: bool = False, **bounds) -> DataFrame:
    """Lines of whole files -> cube; ``by_file`` keeps the file (``arquivo``) as one more key."""
    known = checkpoint(profile_files(lines)) if profile is None else profile
    keep = ("arquivo",) if by_file else ()
    return to_cube(clean_movements(split_lines(lines, known), keep), [*vocab.CUBE_KEYS, *keep] if by_file else None, **bounds)


def ingest_new_months(
    spark: SparkSession,
    source: str,
    store: str,
    progress: str,
    glob: str = "*.txt",
    months: list[str] | None = None,
    max_files_per_batch: int | None = None,
    **bounds,
) -> StreamingQuery:
    """Take the files that arrived in ``source`` since the last run, then stop.

    The store's ledger is the registry of files taken; the streaming checkpoint in
    ``progress`` only spares listing them again, so another progress folder
    neither loses nor doubles anything. A file
    never spans two batches, so the rule about a file's last row sees whole files.
    ``months`` (``yyyymm``) takes the files with one of them in their name; the
    others aren't touched, and a later run finds them however old they are by then.
    """
    if months:
        glob = glob.replace("*", f"*{{{','.join(months)}}}*", 1)
    reader = spark.readStream.format("text").option("pathGlobFilter", glob).option("maxFileAge", "36500d")
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    lines = reader.load(source).select(
        "value",
        F.col("_metadata.file_path").alias("arquivo"),
        F.col("_metadata.file_name").alias("nome"),
        "_metadata.file_block_start",
        F.col("_metadata.file_size").alias("tamanho"),
        F.col("_metadata.file_modification_time").alias("modificado"),
    )
    cube_store = CubeStore(spark, store)

    def fold(batch: DataFrame, _: int) -> None:
        files = checkpoint(cube_store.new_files(batch.select("arquivo", "tamanho", "modificado").distinct()))
        if not files.take(1):
            return
        number = cube_store.next_batch()
        whole = batch.join(files.select("arquivo"), "arquivo", "left_semi").drop("nome", "tamanho", "modificado")
        profile = checkpoint(profile_files(whole))
        cube_store.put(audited_cube(split_lines(whole, profile), **bounds), number)
        cube_store.put_audit(file_audit(profile).join(audit_of_cells(cube_store.cells(number)), "arquivo", "left"), number)
        cube_store.record(files, number)

    query = (
        lines.writeStream.foreachBatch(fold)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query

