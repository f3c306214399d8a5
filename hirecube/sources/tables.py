"""Clean data, cube and result tables at rest."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hirecube import vocab
from hirecube.operators.clean import OUTPUT_NAMES
from hirecube.operators.cube import CUBE_SCHEMA, with_disability
from hirecube.operators.once import select_once
from hirecube.sources.raw import count_fields

CLEAN_SCHEMA = ", ".join(
    f"`{name}` " + {"idade": "int", "salario": "double"}.get(name, "string") for name in OUTPUT_NAMES.values()
)
CLEAN_NEEDED = [
    "competencia_mov", "municipio", "cnae20subclasse", "grau_instrucao", "genero", "raca_cor", "salario", "idade",
]
PROJECTION_SCHEMA = (
    "filtro_tipo string, filtro_valor string, grupo_tipo string, grupo_codigo string, grupo_valor string, "
    "data date, salario_real double, salario_projetado double, salario_projetado_low double, "
    "salario_projetado_high double"
)
COEFFICIENT_SCHEMA = "variavel string, coeficiente double, p_valor double"
PROJECTION_KEYS = ["filtro_tipo", "filtro_valor", "grupo_tipo", "grupo_valor"]


def _partitioned(df: DataFrame, by: str):
    """Writer over rows gathered by partition value.

    REBALANCE lets adaptive execution split values that hold very many rows and
    merge small ones, so files come out near the advisory size in either case.
    """
    return df.hint("rebalance", by).write.partitionBy(by)


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One partition per month of the rows themselves; months present in ``df`` are replaced."""
    writer = _partitioned(df, "competencia_mov").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def _read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text. Lines longer than the header are skipped, short ones padded with nulls.

    The parser calls both malformed and hands back their text, on which cells are counted.
    """
    names = spark.read.option("header", True).csv(path).columns
    partitions = spark.read.text(path).columns[1:]
    schema = ", ".join(f"`{c}` string" for c in [*names, "_ruim"])
    rows = spark.read.schema(schema).option("header", True).option("columnNameOfCorruptRecord", "_ruim").csv(path)
    cells = count_fields(F.col("_ruim"), ",")
    kept = rows.where(F.col("_ruim").isNull() | (cells <= len(names) - len(partitions)))
    # the parser sees malformed lines only while all columns are asked for
    return select_once(kept, *[F.col(f"`{c}`") for c in names])


def read_clean(spark: SparkSession, path: str, fmt: str = "parquet", months: list[str] | None = None) -> DataFrame:
    """Only the columns the cube needs; months prune partitions."""
    if fmt == "csv":
        rows = _read_clean_csv(spark, path)
    else:
        rows = spark.read.schema(CLEAN_SCHEMA).format(fmt).load(path)
    rows = with_disability(rows)
    if months:
        rows = rows.where(F.col("competencia_mov").isin(months))
    casts = {"salario": "double", "idade": "int"}
    return rows.select(
        *[F.col(c).cast(casts.get(c, "string")).alias(c) for c in CLEAN_NEEDED], F.col(vocab.DISABILITY)
    )


def write_cube(cube: DataFrame, path: str, mode: str = "overwrite", dynamic: bool = False) -> None:
    """Snappy Parquet by month. ``dynamic`` replaces only the months present in ``cube``."""
    rows = cube.withColumnRenamed("n", "total_admissoes") if "n" in cube.columns else cube
    writer = _partitioned(rows, "data").mode(mode).option("compression", "snappy")
    writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static").parquet(path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CUBE_SCHEMA).parquet(path)


def _only_missing(error: AnalysisException) -> None:
    """Raise the error again unless it says that nothing is there."""
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """Optional monthly weights; no file means no weights."""
    schema = "mes string, peso_qualidade double"
    try:
        found = spark.read.option("sep", ";").option("header", True).csv(path)
    except AnalysisException as error:
        _only_missing(error)
        return spark.createDataFrame([], schema)
    return found.select("mes", F.col("peso_qualidade").try_cast("double").alias("peso_qualidade"))


def publish_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).format("parquet").saveAsTable(name)


def ensure_result_tables(spark: SparkSession, prefix: str = "") -> None:
    """Empty result tables with fixed schemas, replacing what was there."""
    projections = spark.createDataFrame([], PROJECTION_SCHEMA)
    projections.write.mode("overwrite").format("parquet").partitionBy("filtro_tipo", "grupo_tipo").saveAsTable(
        f"{prefix}projecoes_salariais"
    )
    publish_table(spark.createDataFrame([], COEFFICIENT_SCHEMA), f"{prefix}coeficientes_regressao")


def upserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows of other keys, and all new rows."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


class VersionedTable:
    """Parquet versions under one folder, with a pointer to the current one.

    A table partitioned by a column keeps its rows in ``store/<column>=<value>/lote=<write>/``
    and each version has an immutable manifest: the folders, one or more per value,
    that make it up. A write adds only its own folders and a manifest that takes
    the rest over from the version before, so replacing one month, or upserting
    the series of one partition value, touches nothing else; older versions stay
    readable, and ``collect_unused`` removes folders that no kept version names.
    An unpartitioned table is written whole to a new folder.

    The pointer gets its line only after the write has succeeded. Readers never
    see half a table, a lost job leaves the old version in place, and every older
    version is a restore point. A pointer line is a folder named by its version
    that must not exist yet, so of two writers one gets an error. ``ultimo_lote``
    is the last batch of a stream that a version contains; writes that add no
    batch carry it on.
    """

    POINTER = "pasta string, ultimo_lote bigint, manifesto bigint, particao string, esquema string, versao bigint"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.POINTER).parquet(f"{self.root}/pointer")
        except AnalysisException as error:
            _only_missing(error)
            return self.spark.createDataFrame([], self.POINTER)

    def _line(self, version: int | None = None):
        lines = self._pointer() if version is None else self._pointer().where(F.col("versao") == version)
        return lines.orderBy(F.desc("versao")).first()

    def versions(self) -> list[tuple[int, str]]:
        return [tuple(r) for r in self._pointer().select(
            "versao", F.coalesce("pasta", F.concat(F.lit("manifest/"), F.col("manifesto").cast("string")))).orderBy("versao").collect()]

    def current(self) -> tuple[int, str] | None:
        row = self._line()
        return None if row is None else (row["versao"], row["pasta"] or f"manifest/{row['manifesto']}")

    def last_batch(self, version: int | None = None) -> int | None:
        """Last batch that the current version, or another one, contains."""
        row = self._line(version)
        return None if row is None else row["ultimo_lote"]

    def manifest(self, version: int | None = None) -> list[tuple[str, str]]:
        """``(value, folder)`` of every folder of a partitioned version, in order of value and folder."""
        row = self._line(version)
        if row is None or row["manifesto"] is None:
            return []
        found = self.spark.read.schema("valor string, caminho string").parquet(f"{self.root}/manifest/versao={row['manifesto']}")
        return [tuple(r) for r in found.orderBy("valor", "caminho").collect()]

    def read(self, version: int | None = None, schema: str | None = None) -> DataFrame:
        row = self._line(version)
        if row is None:
            raise FileNotFoundError(f"no version {'' if version is None else version} under {self.root}")
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        if row["pasta"] is not None:
            return reader.parquet(f"{self.root}/{row['pasta']}")
        folders = [f for _, f in self.manifest(row["versao"])]
        if not folders:
            return self.spark.createDataFrame([], schema or StructType.fromJson(json.loads(row["esquema"])))
        found = reader.option("basePath", f"{self.root}/store").parquet(*[f"{self.root}/store/{f}" for f in folders]).drop("lote")
        return found.select(*[c for c in found.columns if c != row["particao"]], row["particao"]) if schema is None else found

    def _store(self, df: DataFrame, by: str, version: int) -> list[tuple[str, str]]:
        """Append ``df`` under a new write name; its folders as ``(value, folder)``, from the file listing alone."""
        lote = f"w{version:06d}_{datetime.now(timezone.utc).strftime('%Y%m%d_%H%M%S_%f')}"
        store = f"{self.root}/store"
        rows = df.withColumn("lote", F.lit(lote))
        rows.hint("rebalance", by).write.partitionBy(by, "lote").mode("append").option("compression", "snappy").parquet(store)
        try:
            files = self.spark.read.option("basePath", store).parquet(f"{store}/*/lote={lote}").inputFiles()
        except AnalysisException as error:
            _only_missing(error)
            return []
        folders = sorted({f.rsplit("/", 2)[0].rsplit("/", 1)[1] + "/lote=" + lote for f in files})
        return [(unquote(f.split("/", 1)[0].split("=", 1)[1]), f) for f in folders]

    def _commit(self, version: int, entries: list[tuple[str, str]], by: str, schema: StructType, last_batch: int | None) -> int:
        self.spark.createDataFrame(entries, "valor string, caminho string").coalesce(1).write.mode("errorifexists").parquet(
            f"{self.root}/manifest/versao={version}")
        self._point(version, None, last_batch, version, by, schema.json())
        return version

    def write(self, df: DataFrame, partition_by: str | None = None, last_batch: int | None = None) -> int:
        last = self.current()
        version = 1 if last is None else last[0] + 1
        if last_batch is None and last is not None:
            last_batch = self.last_batch(last[0])
        if partition_by:
            return self._commit(version, self._store(df, partition_by, version), partition_by, df.schema, last_batch)
        stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
        folder = f"v{version:06d}_{stamp}"
        df.write.mode("errorifexists").option("compression", "snappy").parquet(f"{self.root}/{folder}")
        self._point(version, folder, last_batch)
        return version

    def restore(self, version: int) -> int:
        """Make an older version current again, with the batches that it contains; nothing is copied."""
        row = self._line(version)
        new = self.current()[0] + 1
        self._point(new, row["pasta"], row["ultimo_lote"], row["manifesto"], row["particao"], row["esquema"])
        return new

    def _point(self, version: int, folder: str | None, last_batch: int | None, manifest: int | None = None,
               by: str | None = None, schema: str | None = None) -> None:
        line = self.spark.createDataFrame(
            [(folder, last_batch, manifest, by, schema)], "pasta string, ultimo_lote bigint, manifesto bigint, particao string, esquema string")
        try:
            line.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/pointer/versao={version}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise RuntimeError(f"another writer has made version {version} of {self.root}") from error

    def _partitioned_by(self) -> str | None:
        row = self._line()
        return None if row is None else row["particao"]

    def upsert(self, new: DataFrame, keys: list[str], partition_by: str | None = None) -> int:
        """Rows of ``new`` replace those of equal ``keys``. In a partitioned table whose column is a key,
        only the folders of the values that ``new`` holds are read and written anew."""
        by = self._partitioned_by()
        if by is None or by not in keys:
            return self.write(upserted(self.read(), new, keys) if self.current() else new, partition_by)
        values = [r[0] for r in new.select(F.col(by).cast("string")).distinct().collect()]
        entries = self.manifest()
        touched = [(v, f) for v, f in entries if v in values]
        old = self.read().where(F.col(by).cast("string").isin(values)) if touched else None
        rows = upserted(old, new.select(*self.read().columns), keys) if old is not None else new
        version = self.current()[0] + 1
        fresh = self._store(rows, by, version)
        return self._commit(version, [e for e in entries if e[0] not in values] + fresh, by, rows.schema, self.last_batch())

    def replace_months(self, fixed: DataFrame, months: list[str]) -> int:
        """The named months exchanged for ``fixed``, as one new version; other months' folders are taken over as they are."""
        if self._partitioned_by() != "data":
            kept = self.read(schema=CUBE_SCHEMA).where(~F.col("data").isin(months))
            return self.write(kept.unionByName(fixed.select(*kept.columns)), "data")
        version = self.current()[0] + 1
        rows = fixed.select(*self.read(schema=CUBE_SCHEMA).columns)
        kept = [e for e in self.manifest() if e[0] not in months]
        return self._commit(version, kept + self._store(rows, "data", version), "data", rows.schema, self.last_batch())

    def collect_unused(self, keep: int = 1) -> list[str]:
        """Delete store folders that none of the last ``keep`` versions names; folders of writes
        newer than the current version (another writer's) stay. The deleted folders are returned."""
        lines = self._pointer().orderBy(F.desc("versao")).limit(keep).collect()
        if not lines:
            return []
        named = {f for r in lines for _, f in self.manifest(r["versao"])}
        newest = lines[0]["versao"]
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/store/*/lote=*")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = []
        for status in fs.globStatus(path) or []:
            folder = "/".join(str(status.getPath().toString()).rsplit("/", 2)[1:])
            if folder not in named and int(folder.split("lote=w", 1)[1][:6]) <= newest:
                fs.delete(status.getPath(), True)
                gone.append(folder)
        return sorted(gone)
